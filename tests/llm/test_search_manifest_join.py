"""Ranked search, the Merkle manifest and the n-gram join, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_helpers import ascii_lower, awkward, docs_of  # noqa: F401
from pyspark.sql import functions as F
from test_free_operators import edited, prose

from vitrine.llm.manifest import folded, merkle_proofs, siblings, verified_manifest
from vitrine.llm.range_max import PostingList, best_documents
from vitrine.llm.ranked_search import ranked_search
from vitrine.llm.vertical_join import Bands, jaccard_join, jaccard_links

# ---------------------------------------------------------------- ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_search(docs, items, k=10):
    """All scores of all documents; rows (item_id, rank, doc_id, score)."""
    words = [(i, TERM.findall(ascii_lower(t or ""))) for i, t in docs]
    words = [(i, w) for i, w in words if w]
    documents, total = len(words), sum(len(w) for _, w in words)
    df = Counter(t for _, w in words for t in set(w))
    out = []
    for item, text in items:
        scores = []
        for doc, w in words:
            m, tfs, score = 100 - 75 + 75 * len(w) * documents // total, Counter(w), 0
            for t in TERM.findall(ascii_lower(text or "")):
                if tfs[t]:
                    score += math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1))) * (10**9 * tfs[t] // (1000 * tfs[t] + 8 * m))
            if score > 0:
                scores.append((-score, doc))
        out += [(item, n + 1, doc, -score) for n, (score, doc) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


def test_search_matches_all_scores(spark, docs_of):  # noqa: F811
    rng = random.Random(3)
    zipf = [f"t{int(rng.paretovariate(0.7)) % 500}" for _ in range(40_000)]
    rows = [(i, " ".join(zipf[(i * 37) % 39_000:][:rng.randint(1, 120)])) for i in range(700)]
    rows += [(1000 + i, rows[5][1]) for i in range(40)] + [(2000, rows[9][1].upper() + " ünï 中文"), (2001, None), (2002, " .,;"), (2003, "T1 " * 5000)]
    items = [(i, " ".join(rng.choices(zipf, k=rng.randint(1, 30)))) for i in range(25)] + [(90, rows[5][1]), (91, "nowhere"), (92, None), (93, "Ünï-中文!"), (94, "t1 t1 t1")]
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit("x"))
    want = plain_search(rows, items)
    assert found(ranked_search(docs_of(rows).repartition(7), asked)) == want
    assert found(ranked_search(docs_of(rows).repartition(2), asked, block_terms=60)) == want
    assert found(ranked_search(docs_of(rows), asked, k=2)) == plain_search(rows, items, 2)


def test_search_awkward_rows(spark, awkward, docs_of):  # noqa: F811
    items = spark.createDataFrame([(1, "fox thyme"), (1, "fox thyme"), (None, "one"), (2, None)], "item_id long, text string")
    got = found(ranked_search(awkward, items))
    assert [r[2] for r in got if r[0] == 1 and r[1] == 1] == [2, 2]
    assert [r[1:3] for r in got if r[0] is None] == [(1, 12)]
    assert not [r for r in got if r[0] == 2]
    assert ranked_search(docs_of([]), items).count() == 0 and ranked_search(awkward, items.limit(0)).count() == 0
    nameless = docs_of([(None, "fox"), (4, "fox"), (3, "fox"), (8, "other"), (9, "words")])
    assert [r.doc_id for r in ranked_search(nameless, items.limit(1)).orderBy("rank").collect()] == [3, 4, None]


@pytest.mark.parametrize("seed", range(20))
def test_intervals_give_the_best_documents(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 400))
    lists, scores = [], np.zeros(n, np.int64)
    for _ in range(rng.integers(1, 8)):
        docs = np.flatnonzero(rng.random(n) < rng.random())
        if len(docs):
            impacts, repeats = rng.integers(1, 6, len(docs)).astype(np.int64), int(rng.integers(1, 3))
            lists.append((PostingList(docs, impacts), repeats))
            scores[docs] += repeats * impacts
    want = [(int(scores[d]), int(d)) for d in np.lexsort((np.arange(n), -scores))[:7] if scores[d] > 0]
    assert best_documents(lists, n, 7) == want


def test_clear_winners_leave_most_intervals_closed():
    """A few documents far above the rest: the bounds close the others without a look at each."""
    n, seen = 100_000, []

    class Watched(PostingList):
        def maxima(self, low, high):
            seen.append(len(low))
            return super().maxima(low, high)

    common = Watched(np.arange(n), np.ones(n, np.int64))
    rare = Watched(np.arange(500, n, 9_000), np.full(12, 50, np.int64)[: len(np.arange(500, n, 9_000))])
    assert [d for _, d in best_documents([(common, 1), (rare, 1)], n, 10)] == list(range(500, n, 9_000))[:10]
    assert sum(seen) < 2_000


# ---------------------------------------------------------------- manifest


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(nodes):
    """The top of a list of digests, and for each of them its siblings level by level."""
    paths, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, at in enumerate(places):
            run = nodes[at // 16 * 16:at // 16 * 16 + 16]
            paths[leaf].append((at % 16, run))
            places[leaf] = at // 16
        nodes = [digest("".join(nodes[i:i + 16])) for i in range(0, len(nodes), 16)]
    return nodes[0], paths


def plain_leaf(row, text):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row.doc_id, row.source, row.lang, row.n_chars, text)))


def plain_manifest(rows):
    by_source = {}
    for r in rows:
        by_source.setdefault(b"" if r.source is None else b"=" + r.source.encode(), []).append(r)
    sources = sorted(by_source)
    for s in sources:
        by_source[s].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, plain_leaf(r, r.text)))
    trees = {s: plain_tree([plain_leaf(r, r.text) for r in by_source[s]]) for s in sources}
    root, tops = plain_tree([trees[s][0] for s in sources])
    out = []
    for n, s in enumerate(sources):
        for r, path in zip(by_source[s], trees[s][1]):
            path = path + tops[n]
            changed = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.text is not None
            node = plain_leaf(r, ascii_lower(r.text) if changed else r.text)
            for at, run in path:
                node = digest("".join([*run[:at], node, *run[at + 1:]]))
            proof = digest("".join(d for at, run in path for d in [*run[:at], *run[at + 1:]]))
            out.append((r.doc_id, plain_leaf(r, r.text), trees[s][0], root, proof, node, node == root))
    return sorted(out, key=repr)


def manifest_rows(df):
    return sorted((tuple(r) for r in verified_manifest(df).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


def test_manifest_matches_plain_trees(docs_of):  # noqa: F811
    rows = [(i, f"Text {i}", "big") for i in range(300)] + [(1000 + i, f"Straße {i}", f"s{i}") for i in range(20)] + [(5000 + i, "Other", "ünder") for i in range(17)]
    rows += [(7000, "One Leaf", None), (8000, "", "empty"), (8001, None, "empty")]
    df = docs_of(rows).repartition(5)
    assert manifest_rows(df) == plain_manifest(df.collect())
    assert {r[-1] for r in manifest_rows(df)} == {True, False}


@pytest.mark.parametrize("n, sources", [(1, 1), (16, 1), (17, 1), (257, 1), (3, 3), (40, 40)])
def test_manifest_of_other_shapes(docs_of, n, sources):  # noqa: F811
    df = docs_of([(i, f"T{i}", f"s{i % sources}") for i in range(n)])
    assert manifest_rows(df) == plain_manifest(df.collect())


def test_manifest_awkward_rows(awkward, docs_of):  # noqa: F811
    assert manifest_rows(awkward) == plain_manifest(awkward.collect())
    assert manifest_rows(docs_of([])) == []
    proofs = merkle_proofs(awkward)
    assert proofs.select(F.min(folded(F.col("leaf"), F.col("path")) == F.col("root"))).first()[0]
    assert proofs.where(F.length(siblings(F.col("path"))) % 64 != 0).count() == 0


# ---------------------------------------------------------------- n-gram join


def plain_grams(text):
    words = ascii_lower(text or "").encode().split()
    if not words:
        return frozenset()
    return frozenset([tuple(words)]) if len(words) < 3 else frozenset(tuple(words[i:i + 3]) for i in range(len(words) - 2))


def plain_links(rows, per_cent=90):
    sets = [(i, plain_grams(t)) for i, t in rows]
    out = {}
    for n, (a, x) in enumerate(sets):
        for b, y in sets[n + 1:]:
            both = len(x & y)
            if x and y and 100 * both >= per_cent * (len(x) + len(y) - both):
                out[a, b] = (both, x == y)
    return sets, out


def plain_join(rows, per_cent=90):
    sets, links = plain_links(rows, per_cent)
    leader = {i: i for i, _ in sets}

    def find(i):
        while leader[i] != i:
            i = leader[i]
        return i

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        leader[y] = x
    return {i: (len(s), find(i)) for i, s in sets}


def near_copies():
    rows = [(i, prose(i, 30 + 9 * i)) for i in range(40)]
    rows += [(100 + i, edited(rows[i][1], i, 1)) for i in range(40)] + [(200 + i, edited(rows[20 + i % 20][1], 7 * i, 1 + i % 6)) for i in range(60)]
    rows += [(300 + i, rows[3][1].upper()) for i in range(10)] + [(400 + i, edited(prose(999, 300), i, 4)) for i in range(60)]
    return rows + [(500, "a b"), (501, "A  B"), (502, "a b c"), (503, ""), (504, None), (505, " "), (506, "a b c d e f g h i j k l"), (507, "a b c d e f g h i j k l m")]


def test_join_matches_all_pairs(docs_of):  # noqa: F811
    rows = near_copies()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join(docs_of(rows).repartition(5)).collect()}
    assert got == plain_join(rows)


def test_links_match_all_pairs(docs_of):  # noqa: F811
    rows = near_copies()
    first = {}
    for i, t in rows:
        first.setdefault(plain_grams(t), i)
    want = {(a, b): both for (a, b), (both, same) in plain_links(rows)[1].items() if not same and a in first.values() and b in first.values()}
    got = {tuple(sorted((r.class_a, r.class_b))): r.overlap for r in jaccard_links(docs_of(rows).repartition(3)).collect()}
    assert got == want


def test_join_of_texts_around_one_passage(docs_of):  # noqa: F811
    passage = prose(5, 70)
    rows = [(i, passage + " " + prose(1000 + i, 12)) for i in range(150)] + [(900, passage + " " + prose(1003, 12) + " tail")]
    got = {r.doc_id: r.component_id for r in jaccard_join(docs_of(rows)).collect()}
    assert got == {i: c for i, (_, c) in plain_join(rows).items()}


def test_join_awkward_rows(awkward, docs_of):  # noqa: F811
    got = jaccard_join(awkward).collect()
    assert len(got) == awkward.count()
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert {r.component_id for r in got if r.doc_id in (2, 7)} == {2}
    assert jaccard_join(docs_of([])).count() == 0


@pytest.mark.parametrize("per_cent", [50, 80, 90, 95])
def test_bands_hold_every_linked_pair_of_sizes(per_cent):
    bands = Bands(per_cent)
    for small in range(1, 700):
        for large in range(small, bands.reach(small) + 1):
            low, high = bands.of(small), bands.of(large)
            overlap = -(-per_cent * (small + large) // (100 + per_cent))
            assert high - low in (0, 1)
            if overlap <= small:
                assert small + large - 2 * overlap < bands.fragments(low)
