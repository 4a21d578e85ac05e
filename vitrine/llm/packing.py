"""Best-fit packing: large items matched in pairs, smaller ones best-fit into the gaps."""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.arrow import gather, lengths_to_starts, text_slices
from vitrine.llm.common import positions
from vitrine.session import cut_lineage

CAPACITY = 2_048
#: Characters for which lower-casing and splitting at white space agree in every library used here.
PLAIN = r"^[\t\n\r\x20-\x7e\x{a1}-\x{12f}\x{131}-\x{148}\x{14a}-\x{17f}]*$"
#: Fixed pattern of the tokenizer's own pre-tokens.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
#: Distinct pre-tokens that a task remembers; it forgets them when there are more.
CACHE = 500_000
#: Text that is tokenised at once.
SLICE_BYTES = 16 << 20


def byte_letters() -> dict[int, int]:
    """The letters that byte-level vocabularies write bytes with: visible Latin-1 as itself, the others from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in visible)}


class WordIds:
    """Token ids of texts under a word-end BPE tokenizer; each distinct pre-token of a slice is tokenised once.

    Plain texts are lower-cased and split at white space in Arrow; the distinct chunks are cut by the tokenizer's own
    pattern, and their distinct pre-tokens go to the tokenizer's model. Other texts, and those with a special token's
    string, go through the whole tokenizer.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cut = regex.compile(r"\n|" + PRE_TOKEN).findall
        self.letters = byte_letters()
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}

    def word(self, word: str) -> bytes:
        if len(self.known) >= CACHE:
            self.known.clear()
        text = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        ids = self.known[word] = array("I", [t.id for t in self.tokenizer.model.tokenize(text)]).tobytes()
        return ids

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def texts(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text as unsigned 32-bit numbers."""
        plain = pc.match_substring_regex(texts, PLAIN)
        for special in self.specials:
            plain = pc.and_not(plain, pc.match_substring(texts, special))
        lower = pc.utf8_lower(pc.if_else(plain, texts, pa.scalar("", texts.type)))
        for space in "\t\n\r":
            lower = pc.replace_substring(lower, space, " ")
        chunks = pc.split_pattern(lower, " ")
        coded = chunks.flatten().dictionary_encode()
        cut = pa.array(self.cut("\n".join(coded.dictionary.to_numpy(zero_copy_only=False))), pa.string()).dictionary_encode()
        words = ["" if w == "\n" else w for w in cut.dictionary.to_numpy(zero_copy_only=False)]
        ids = [(self.known.get(w) or self.word(w)) if w else b"" for w in words]
        starts, flat = lengths_to_starts(np.fromiter(map(len, ids), np.int64, len(ids)) // 4), np.frombuffer(b"".join(ids), "<u4")
        at = cut.indices.to_numpy()
        ends = np.flatnonzero(np.array([w == "" for w in words])[at]) if len(words) else np.zeros(0, np.int64)
        chunk_at, flat = gather(starts, flat, at)
        chunk_starts = np.concatenate(([0], chunk_at[ends], chunk_at[-1:]))
        starts, flat = gather(chunk_starts, flat, coded.indices.to_numpy())
        offsets = chunks.offsets.to_numpy()
        bounds = starts[offsets - offsets[0]]
        everything = flat
        for i, fast in enumerate(plain.to_pylist()):
            yield everything[bounds[i]:bounds[i + 1]] if fast else self.whole(texts[i].as_py())


def document_pieces(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Per piece: ``doc_id, row, piece, start, length, ids_crc32``. ``row`` tells repeated rows apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = WordIds(tokenizer_file), np.array([end_id], "<u4")
        for batch, texts in text_slices(batches, most=SLICE_BYTES):
            doc, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(words.texts(texts)):
                ids = np.concatenate((ids, end))
                for n, low in enumerate(range(0, len(ids), capacity)):
                    part = ids[low:low + capacity]
                    doc.append(i)
                    piece.append(n)
                    start.append(low)
                    length.append(len(part))
                    crc.append(zlib.crc32(part))
            at = pa.array(doc, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                ["doc_id", "row", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, row long, piece int, start long, length long, ids_crc32 long")


def pack_lengths(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Pack counted lengths. Returns slots ``(length, first rank, past last rank, first sequence, offset)``.

    Equal lengths are interchangeable, so a step places as many of a length as it has bins of one kind. Lengths above a
    third of the capacity are matched first, from the longest, each with the longest one that still fits: at most two
    share a bin. Shorter ones follow from the longest, each into the tightest gap; when there is none, new bins open.
    The work and the answer depend on the capacity, not on the number of documents.
    """
    left = {n: c for n, c in counts.items() if c}
    used = dict.fromkeys(left, 0)
    large = sorted(n for n in left if 3 * n > capacity)
    kinds: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}  # by gap: how many bins, and the (length, first rank) in them
    gaps: list[int] = []

    def put(bins: int, gap: int, slots: list[tuple[int, int]]) -> None:
        if gap not in kinds:
            kinds[gap] = []
            insort(gaps, gap)
        kinds[gap].append((bins, slots))

    def take(length: int, n: int) -> int:
        first = used[length]
        used[length] += n
        left[length] -= n
        return first

    for length in reversed(large):
        while left[length]:
            at = bisect_left(large, capacity - length + 1) - 1
            while at >= 0 and left[large[at]] - (large[at] == length) <= 0:
                at -= 1
            if at < 0:
                n = left[length]
                put(n, capacity - length, [(length, take(length, n))])
                continue
            mate = large[at]
            n = left[length] // 2 if mate == length else min(left[length], left[mate])
            put(n, capacity - length - mate, [(length, take(length, n)), (mate, take(mate, n))])
    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[length]:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                each = capacity // length
                bins, rest = divmod(left[length], each)
                for n, k in ((bins, each), (1, rest)):
                    if n and k:
                        put(n, capacity - k * length, [(length, take(length, n)) for _ in range(k)])
                continue
            gap = gaps[at]
            bins, slots = kinds[gap].pop()
            n = min(bins, left[length])
            if bins > n:
                kinds[gap].append((bins - n, [(k, first + n) for k, first in slots]))
            elif not kinds[gap]:
                del kinds[gap]
                gaps.pop(at)
            put(n, gap - length, [*slots, (length, take(length, n))])
    out, sequence = [], 0
    for gap in gaps:
        for bins, slots in kinds[gap]:
            offset = 0
            for length, first in slots:
                out.append((length, first, first + bins, sequence, offset))
                offset += length
            sequence += bins
    return out


def pack_documents(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A null or empty text is the end token alone. Repeated rows are packed each. A null id stays null. An empty table
    gives an empty result. Reruns agree up to which of two equal rows goes where.

    Only the histogram of lengths (at most ``capacity`` numbers) reaches the driver. A piece finds its place by its rank
    among the pieces of its length; ranks are made without gathering a length in one task.
    """
    pieces = cut_lineage(document_pieces(docs, tokenizer_file, capacity, end_id))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = np.array(sorted(pack_lengths(counts, capacity)), np.int64).reshape(-1, 5)
    ranked = positions(pieces, ["length"], [F.col("doc_id"), F.col("piece"), F.col("row")], "rank")
    shared = docs.sparkSession.sparkContext.broadcast(slots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = shared.value
        spread = np.int64(1) << 48
        starts = slots[:, 0] * spread + slots[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(starts, length * spread + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")),
                 pa.array(slots[at, 3] + rank - slots[at, 1]), pa.array(slots[at, 4])],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
