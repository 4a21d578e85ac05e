"""Token counts from distinct pre-tokens."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.arrow import sums_by_row, text_slices

LIMIT = 4_096
#: Where the fast split does not hold: runs of spaces, spaces at the ends, and the mark that stands for a space.
ODD = r"^ |  | $|\x{2581}"
RUNS = re.compile(r" *[^ ]+| +")


class PieceCounter:
    """Pieces of pre-tokens under a sentencepiece BPE model that maps a space to a mark and trims nothing.

    No piece has the mark after another character, so a text's pieces are those of its pre-tokens: a run of spaces and the
    run of other characters after it. The model is checked for that when it is loaded.
    """

    def __init__(self, model_file: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        if any("▁" in p.lstrip("▁") or "\n" in p for p in pieces):
            raise ValueError("a piece crosses a pre-token boundary")

    def count(self, pre_tokens: list[str]) -> np.ndarray:
        """Pieces per pre-token, spaces included. A leading line feed keeps the model's own prefix apart: two pieces more."""
        return np.fromiter((len(x) for x in self.model.encode(["\n" + t for t in pre_tokens], num_threads=1)), np.int64, len(pre_tokens)) - 2


def count_slice(texts: pa.Array, counter: PieceCounter) -> np.ndarray:
    """Tokens per text: one model call for the distinct pre-tokens of the slice, joined to each text's occurrences."""
    odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False)
    plain = pc.if_else(pa.array(odd), pa.scalar("", texts.type), texts)
    words = pc.split_pattern(plain, " ")
    coded = words.flatten().dictionary_encode()
    pieces = counter.count([" " + w if w else "" for w in coded.dictionary.to_numpy(zero_copy_only=False)])
    totals = sums_by_row(pieces[coded.indices.to_numpy()], _offsets(words))
    if odd.any():
        at = np.flatnonzero(odd)
        frequencies = [Counter(RUNS.findall(" " + texts[int(i)].as_py().replace("▁", " "))) for i in at]
        distinct = list(set().union(*frequencies))
        known = dict(zip(distinct, counter.count(distinct).tolist()))
        totals[at] = [sum(n * known[t] for t, n in f.items()) for f in frequencies]
    return totals


def _offsets(lists: pa.ListArray) -> np.ndarray:
    offsets = lists.offsets.to_numpy()
    return offsets - offsets[0]


def count_tokens(docs: DataFrame, model_file: str, limit: int = LIMIT) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_tokens, over_limit``.

    Counts are those of the sentencepiece model without begin and end tokens. Null and empty texts have no tokens.
    Every row is counted, repeated or not; a null id stays null. An empty table gives an empty result.

    Pre-tokens are counted once per distinct value of a slice of a few MB inside the task that holds the texts, and
    joined there to the texts' occurrences; no ids are built and nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(model_file)
        for batch, texts in text_slices(batches):
            n = count_slice(texts, counter)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pc.binary_length(texts).cast(pa.int64()), pa.array(n), pa.array(n > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
