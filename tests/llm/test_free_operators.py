"""Near-dedup, packing, token counts, fingerprints, resampling and toxicity, against brute force or held-out labels."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from llm_helpers import ascii_lower, awkward, docs_of  # noqa: F401
from tokenizers import Tokenizer

from vitrine.llm import chain, chunking, common, components, links, near_dedup, toxicity
from vitrine.llm.components import connected_components
from vitrine.llm.fingerprints import fingerprint_documents, fingerprint_edits
from vitrine.llm.near_dedup import drop_near_copies, near_duplicates
from vitrine.llm.packing import pack_documents, pack_lengths
from vitrine.llm.resampling import resample
from vitrine.llm.token_counts import count_tokens

WORDS = [f"word{i}" for i in range(4000)]


def prose(seed, n=80):
    return " ".join(random.Random(seed).choices(WORDS, k=n))


def edited(text, seed, changes):
    words, rng = text.split(), random.Random(seed)
    for _ in range(changes):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return " ".join(words)


# ---------------------------------------------------------------- near-dedup


def plain_set(text):
    words = ascii_lower(text or "").encode().split()
    if not words:
        return frozenset()
    return frozenset([tuple(words)]) if len(words) < 5 else frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4))


def plain_components(rows, per_cent=85):
    sets = {i: plain_set(t) for i, t in rows}
    leader = {i: i for i in sets}

    def find(i):
        while leader[i] != i:
            i = leader[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= per_cent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                leader[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_match_all_pairs(docs_of):
    rows = [(i, prose(i)) for i in range(40)]
    rows += [(100 + i, edited(rows[i][1], i, 1)) for i in range(30)]
    rows += [(200 + i, edited(rows[100 - 60 + i % 30][1], 7 * i, 2)) for i in range(40)]
    rows += [(300 + i, rows[3][1]) for i in range(25)] + [(400 + i, edited(prose(999, 400), i, 5)) for i in range(60)]
    rows += [(500, "a b"), (501, "A  B"), (502, "a b c"), (503, ""), (504, None), (505, " ")]
    want = plain_components(rows)
    got = near_duplicates(docs_of(rows).repartition(5)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    kept = drop_near_copies(docs_of(rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in want.items() if i == c)


def test_near_duplicates_shared_passage_without_links(docs_of):
    passage = prose(5, 60)
    rows = [(i, passage + " " + prose(1000 + i, 25)) for i in range(120)] + [(900, passage + " " + prose(1003, 25) + " tail")]
    got = {r.doc_id: r.component_id for r in near_duplicates(docs_of(rows)).collect()}
    assert got == {i: c for i, (_, c) in plain_components(rows).items()}
    assert got[900] == 3


def test_near_duplicates_awkward_rows(awkward, docs_of):
    got = near_duplicates(awkward).collect()
    assert len(got) == awkward.count()
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    assert {r.component_id for r in got if r.doc_id in (2, 7)} == {2}
    kept = drop_near_copies(awkward)
    assert kept.columns == awkward.columns
    ids = sorted((r.doc_id for r in kept.collect() if r.doc_id is not None))
    assert ids == sorted(set(ids)) and 7 not in ids and 2 in ids and {3, 5, 9} <= set(ids)
    assert near_duplicates(docs_of([])).count() == 0 and drop_near_copies(docs_of([])).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001 + i) for i in range(100)] + [(5000, 5000)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{i: 1000 for i in range(1000, 1101)}}


def test_components_by_rounds_alone(spark, monkeypatch):
    monkeypatch.setattr(components, "LAST_EDGES", 0)
    test_components_of_chains_and_stars(spark)
    structs = spark.createDataFrame([((0, 1), (0, 2)), ((0, 3), (0, 2)), ((9, 9), (9, 8))], "a struct<x:long,y:long>, b struct<x:long,y:long>")
    want = {(0, 1): (0, 1), (0, 2): (0, 1), (0, 3): (0, 1), (9, 9): (9, 8), (9, 8): (9, 8)}
    assert {tuple(r.id): tuple(r.component) for r in connected_components(structs).collect()} == want
    monkeypatch.undo()
    assert {tuple(r.id): tuple(r.component) for r in connected_components(structs).collect()} == want


@pytest.mark.parametrize("linked", [True, False])
def test_pairs_compared_grow_with_the_texts(docs_of, monkeypatch, linked):
    """2,000 near copies, or 2,000 unlinked texts around one passage: a few pairs for each text are checked, and none is lost."""
    compared, verify = [], near_dedup.verified

    def counted(pairs, sets, per_cent):
        compared.append(pairs.count())
        return verify(pairs, sets, per_cent)

    monkeypatch.setattr(near_dedup, "verified", counted)
    base = prose(31, 120)
    rows = [(i, edited(prose(31, 400), i, 1)) if linked else (i, base + " " + prose(5000 + i, 40)) for i in range(2000)]
    got = near_duplicates(docs_of(rows)).collect()
    assert len({r.component_id for r in got}) == (1 if linked else 2000)
    assert sum(compared) <= 10 * len(rows)


def hub(seed, n, width=160, changes=4):
    """Edits of one text: each is close to the text and to some of the others, and too far from the rest."""
    base = prose(seed, width)
    return [edited(base, 100 * seed + i, 1 + i % changes) for i in range(n)]


@pytest.mark.parametrize("per_cent", [80, 85])
def test_members_that_miss_the_pivot_of_a_large_group(docs_of, per_cent):
    rows = list(enumerate(hub(71, 150) + hub(72, 60) + hub(73, 40, 60, 2)))
    got = near_duplicates(docs_of(rows).repartition(4), tensor=near_dedup.Tensor(slots=13), per_cent=per_cent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain_components(rows, per_cent)


def test_settling_pairs_meet_the_largest_component(spark):
    rows = [(1, i, 100, 0) for i in range(50)] + [(1, 60 + i, 100, 60 + i) for i in range(5)] + [(1, 70, 40, 70), (2, 80, 100, 80), (2, 81, 100, 81)]
    pairs = links.settling_pairs(spark.createDataFrame(rows, "key long, id long, size long, component long"), 85).collect()
    assert sorted(r.b for r in pairs) == [60, 61, 62, 63, 64]
    assert all(r.a < 50 for r in pairs) and len({r.a for r in pairs}) > 1


def test_crowded_members_are_found_by_few_cells(spark):
    """The members of every key with several components; a member of a large group is not met once for each of its keys."""
    rows = [(key, i, 100, i) for key in range(40) for i in range(30)] + [(100 + i, 500 + i, 100, 500) for i in range(5)]
    rows += [(0 - i, 700 + i, 100, 700 + i) for i in range(1, 4)] + [(200, 700 + i, 100, 700 + i) for i in range(1, 4)]
    got = links.crowded_members(spark.createDataFrame(rows, "key long, id long, size long, component long"))
    assert sorted(r.id for r in got.collect()) == [*range(30), 701, 702, 703]


def test_closing_writes_no_row_for_each_cell_of_a_crowded_group(spark, monkeypatch):
    written, cut = [], links.cut_lineage
    monkeypatch.setattr(links, "cut_lineage", lambda df: written.append((df.columns, df.count())) or cut(df))
    cells = spark.createDataFrame([(key, i, 100, i) for key in range(40) for i in range(30)], "key long, id long, size long, component long")
    links.crowded_members(cells).count()
    assert sum(n for _, n in written) <= 40 + 30


@pytest.mark.parametrize("most", [1 << 26, 64])
def test_sifted_rows_keep_all_wanted_and_few_others(spark, monkeypatch, most):
    monkeypatch.setattr(common, "MOST_BITS", most)
    rows = spark.range(-5_000, 5_000).selectExpr("id AS doc_id", "string(id) AS text")
    wanted = rows.where("doc_id % 20 = 0").select("doc_id")
    got = common.sifted(rows, wanted, "doc_id")
    assert got.columns == ["doc_id", "text"]
    kept = [r.doc_id for r in got.collect()]
    assert len(kept) == len(set(kept)) and {i for i in range(-5_000, 5_000) if i % 20 == 0} <= set(kept)
    assert most == 64 or len(kept) < 2_500
    assert common.sifted(rows, wanted.where("false"), "doc_id").count() == 0


# ---------------------------------------------------------------- packing


def packed(counts, capacity):
    bins = defaultdict(list)
    for length, first, past, sequence, offset in pack_lengths(counts, capacity):
        for k in range(past - first):
            bins[sequence + k].append((offset, length, first + k))
    return bins


@pytest.mark.parametrize("seed", range(6))
def test_packing_places_every_length_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 2048])
    counts = {n: rng.randint(0, 60) for n in rng.sample(range(1, capacity + 1), min(capacity, 40))}
    bins = packed(counts, capacity)
    seen = defaultdict(set)
    for content in bins.values():
        at = 0
        for offset, length, rank in sorted(content):
            assert offset == at
            at += length
            seen[length].add(rank)
        assert at <= capacity and sum(3 * n > capacity for _, n, _ in content) <= 2
    assert {n: len(r) for n, r in seen.items()} == {n: c for n, c in counts.items() if c}
    tokens = sum(n * c for n, c in counts.items())
    free = list()  # best-fit decreasing, one at a time
    for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        fits = [g for g in free if g >= n]
        gap = min(fits) if fits else capacity
        if fits:
            free.remove(gap)
        free.append(gap - n)
    assert -(-tokens // capacity) <= len(bins) <= len(free) * 1.03 + 1


def test_packing_ids_match_the_tokenizer(awkward, docs_of):
    extra = docs_of([(100 + i, t) for i, t in enumerate(
        ["<|endoftext|> inside <|STARTOFTEXT|>", "ΑΣ ὈΔΟΣ", "İstanbul ŉ é", "don't '' 's!'s 12 3½ ²", "\x1ca b\x0b c d", "tab\tend\n"])])
    docs = awkward.unionByName(extra)
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    want = defaultdict(list)
    for r in docs.collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[start:start + 2048], "<u4")
            want[r.doc_id].append((piece, start, len(part), zlib.crc32(part.tobytes())))
    got, bins = defaultdict(list), defaultdict(list)
    for r in pack_documents(docs, path).collect():
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        bins[r.sequence_id].append((r.offset, r.length))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    for content in bins.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= 2048
    assert pack_documents(docs_of([]), path).count() == 0


# ---------------------------------------------------------------- token counts


def test_token_counts_match_the_model(awkward, docs_of):
    extra = docs_of([(100 + i, t) for i, t in enumerate(
        [" ", "a  b", "\n", " x", "x ", "▁a▁▁b", "<s> x </s>", "a\tb\r\nc", "中文 字", "　x", "é", "x" * 5000, "\x00a"])])
    docs = awkward.unionByName(extra)
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    want = sorted(((r.doc_id, len((r.text or "").encode()), len(model.encode(r.text or ""))) for r in docs.collect()), key=str)
    got = count_tokens(docs, path).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=str) == want
    assert all(r.over_limit == (r.n_tokens > 4096) for r in got) and any(r.over_limit for r in got)
    assert count_tokens(docs_of([]), path).count() == 0


# ---------------------------------------------------------------- fingerprints


def test_fingerprints_of_edits(docs_of, spark):
    rows = [(i * 3, prose(i, 5 + 40 * (i % 9))) for i in range(150)] + [(1000, None), (1001, ""), (1002, prose(4, 165)), (1003, "äöü")]
    got = {r.doc_id: r for r in fingerprint_edits(docs_of(rows).repartition(6)).collect()}
    order = sorted(rows, reverse=True)
    chunker = chunking.Chunker()
    for k, (ident, text) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        after = text[:len(text) - half] + following[:half]
        sets = chunker.sets([text.encode(), after.encode(), following.encode()])
        r = got[ident]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(after.encode()).hexdigest()
        assert (r.fingerprint, r.edited_fingerprint) == (chunking.fingerprint(sets[0]), chunking.fingerprint(sets[1]))
        assert r.near_edited == pytest.approx(chunking.containment(sets[0], sets[1])) and r.near_next == pytest.approx(chunking.containment(sets[0], sets[2]))
    plain = {r.doc_id: r.fingerprint for r in fingerprint_documents(docs_of(rows)).collect()}
    assert plain == {i: r.fingerprint for i, r in got.items()}
    digests, lengths = chunking.read_fingerprint(got[3].fingerprint)
    assert list(digests) == sorted(digests) and (lengths > 0).all()


def test_fingerprints_awkward_rows(awkward, docs_of):
    got = fingerprint_edits(awkward).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in awkward.collect())
    assert fingerprint_edits(docs_of([])).count() == 0
    one = fingerprint_edits(docs_of([(1, "abcdef")])).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abcabc").hexdigest()


def test_chunks_resist_a_shift():
    chunker = chunking.Chunker()
    text = prose(1, 800).encode()
    a, b = chunker.sets([text, b"inserted at the front " + text])
    assert chunking.containment(a, b) > 0.95
    assert chunker.sets([b"x", text])[1][0].tolist() == a[0].tolist()  # neighbours do not matter


# ---------------------------------------------------------------- resampling and toxicity


def labelled(spark, docs_of, n=240):
    rng, rows, labels = random.Random(2), [], []
    for i in range(n):
        bad = i % 4 == 0
        words = prose(i, 60).split()
        if bad:
            for w in rng.sample(["vileword", "nastyterm", "foulname"], 2):
                words[rng.randrange(60)] = w
                words.insert(rng.randrange(60), "!!!")
        rows.append((i, " ".join(words)))
        labels.append((i, int(not bad), int(bad)))
    return docs_of(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_resampling_prefers_the_target(spark, docs_of):
    docs, labels = labelled(spark, docs_of)
    got = {r.doc_id: r for r in resample(docs, labels, share=0.75).collect()}
    assert sum(r.kept for r in got.values()) == 180
    assert sorted(r.rank for r in got.values()) == list(range(240))
    assert np.mean([got[i].kept for i in range(240) if i % 4]) > 0.9
    again = {r.doc_id: r for r in resample(docs.repartition(3), labels, share=0.75).collect()}
    assert again == got


def test_resampling_edge_tables(spark, awkward, docs_of):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = resample(awkward, none).collect()
    assert len(got) == awkward.count() and all(r.kept and r.log_weight == pytest.approx(0, abs=1e-6) for r in got)
    assert resample(docs_of([]), none).count() == 0


def test_toxicity_on_held_out_rows(spark, docs_of):
    docs, labels = labelled(spark, docs_of)
    model = toxicity.fit_toxicity(docs, labels)
    got = toxicity.score_toxicity(docs, model).collect()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1
    tested = [r for r in got if r.held_out]
    assert np.mean([r.predicted == int(r.doc_id % 4 == 0) for r in tested]) > 0.95
    texts = {r.doc_id: r.text for r in docs.collect()}
    places = [texts[r.doc_id][s.start:s.stop] for r in got if r.predicted for s in r.spans]
    assert np.mean([any(w in p for w in ("vileword", "nastyterm", "foulname", "!!!")) for p in places]) > 0.9
    clean = toxicity.drop_toxic(docs, model)
    assert clean.columns == docs.columns and clean.count() == sum(1 - r.predicted for r in got)


def test_toxicity_edge_tables(spark, awkward, docs_of):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit_toxicity(awkward, none)
    got = toxicity.score_toxicity(awkward, model).collect()
    assert len(got) == awkward.count() and all(r.score == 0 and r.predicted == 0 for r in got)
    docs, labels = labelled(spark, docs_of)
    model = toxicity.fit_toxicity(docs, labels)
    assert toxicity.score_toxicity(awkward, model).count() == awkward.count()
    assert toxicity.drop_toxic(docs_of([]), model).count() == 0


def test_chain_marginals_match_enumeration():
    rng = np.random.default_rng(0)
    sizes = [3, 0, 1, 4, 2]
    u = rng.normal(size=sum(sizes))
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    model = chain.ChainModel.empty()
    model.step, model.start = rng.normal(size=(2, 2)), 0.3
    p, steps = model.marginals(u, bounds)
    want, want_steps = np.zeros(len(u)), np.zeros((2, 2))
    for a, b in zip(bounds[:-1], bounds[1:]):
        n, total, ones, pairs = b - a, 0.0, np.zeros(b - a), np.zeros((2, 2))
        for code in range(1 << n):
            s = [(code >> i) & 1 for i in range(n)]
            w = np.exp(sum(u[a + i] for i in range(n) if s[i]) + (model.start * s[0] if n else 0) + sum(model.step[x, y] for x, y in zip(s, s[1:])))
            total += w
            ones += w * np.array(s)
            for x, y in zip(s, s[1:]):
                pairs[x, y] += w
        if n:
            want[a:b] = ones / total
            want_steps += pairs / total
    assert np.allclose(p, want) and np.allclose(steps, want_steps)


def test_word_places_are_those_of_the_text():
    texts = pa.array(["", "Hello, you  idiot!\n***x***", "...", "ünï\tcode (ok)"])
    words = chain.read_words(texts)
    for k, text in enumerate(texts.to_pylist()):
        for i in range(words.bounds[k], words.bounds[k + 1]):
            assert text[words.starts[i]:words.ends[i]].lower() == words.distinct[words.at[i]]
    assert np.diff(words.bounds).tolist() == [0, 4, 0, 3]
