"""License scan, exact dedup, mixing and sharding, against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from llm_helpers import ascii_lower, awkward, docs_of  # noqa: F401

from vitrine.llm.exact_dedup import drop_exact_copies, exact_dedup
from vitrine.llm.license_rules import RULES
from vitrine.llm.licenses import scan_licenses
from vitrine.llm.mixing import emit_mix, mix_sources
from vitrine.llm.sharding import shard_documents, write_shards


# ---------------------------------------------------------------- exact dedup


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("fan_in", [2, 16])
def test_exact_dedup_matches_grouping(awkward, keep, fan_in):
    rows = [(r.doc_id, ascii_lower(r.text or "")) for r in awkward.collect()]
    groups = defaultdict(list)
    for ident, text in rows:
        groups[text].append(ident)
    got = exact_dedup(awkward.repartition(5), keep=keep, fan_in=fan_in).collect()
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r.text_sha256) for r in got) == Counter((i, hashlib.sha256(t.encode()).hexdigest()) for i, t in rows)
    digest = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = digest[r.text_sha256]
        known = [i for i in ids if i is not None]
        assert r.group_size == len(ids)
        assert r.keep_id == ((max if keep == "largest" else min)(known) if known else None)
    assert sum(r.kept for r in got) == len(groups)


def test_exact_dedup_hot_group(docs_of):
    docs = docs_of([(i, "same TEXT" if i % 3 == 0 else f"text {i}") for i in range(3000)]).repartition(7)
    got = exact_dedup(docs, keep="largest").where("group_size > 1").collect()
    assert len(got) == 1000 and {r.keep_id for r in got} == {2997} and [r.doc_id for r in got if r.kept] == [2997]


def test_exact_dedup_keeps_columns(awkward):
    got = drop_exact_copies(awkward)
    assert got.columns == awkward.columns
    assert len(got.collect()) == len({ascii_lower(r.text or "") for r in awkward.collect()})
    assert {r.doc_id for r in got.collect() if r.text and r.text.lower().startswith("the quick") and "more" not in r.text} == {7}


def test_exact_dedup_empty(docs_of):
    assert exact_dedup(docs_of([])).count() == 0
    assert drop_exact_copies(docs_of([])).count() == 0


# ---------------------------------------------------------------- mixing


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        weights = sum(weight[s] for s in names if s not in full)
        share = {s: 3 * sizes[s] if s in full else rest * weight[s] / weights for s in names}
        above = {s for s in names if s not in full and share[s] > 3 * sizes[s]}
        if not above:
            return share
        full |= above


def test_mixing_targets_and_totals(docs_of):
    rows = [(i, " ".join("w" * (1 + (i * 7919) % 50)), ("b", "a", None, "é", "z")[min(4, i % 11)]) for i in range(2200)]
    got = mix_sources(docs_of(rows).repartition(6)).collect()
    by_id = {r[0]: r for r in rows}
    sizes, taken = Counter(), Counter()
    for r in got:
        source = by_id[r.doc_id][2]
        assert r.size == len(by_id[r.doc_id][1].split())
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        sizes[source] += r.size
        taken[source] += r.taken
    targets = plain_targets(dict(sizes))
    assert math.isclose(sum(targets.values()), sum(sizes.values()))
    for r in got:
        source = by_id[r.doc_id][2]
        assert r.source_size == sizes[source] and math.isclose(r.target, targets[source])
    for source, target in targets.items():
        assert abs(taken[source] - target) <= 3 * 50


def test_mixing_awkward_rows_and_emission(awkward, docs_of):
    plan = mix_sources(awkward).collect()
    assert len(plan) == awkward.count()
    emitted = emit_mix(awkward)
    assert emitted.columns == awkward.columns
    copies = Counter(r.doc_id for r in emitted.collect())
    for ident in {r.doc_id for r in plan}:
        rows = [r for r in plan if r.doc_id == ident]
        if all(r.size for r in rows):
            assert copies[ident] == sum(r.taken // r.size for r in rows)
    assert mix_sources(docs_of([])).count() == 0
    assert emit_mix(docs_of([])).count() == 0
    assert sorted(mix_sources(awkward).collect(), key=str) == sorted(plan, key=str)


# ---------------------------------------------------------------- sharding


def shards_of(got):
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    return by


@pytest.mark.parametrize("copies", [0, 1500])
def test_sharding_balances_bytes(docs_of, copies):
    rows = [(i, "same" * 30 if i < copies else f"text {i} " * (1 + i % 40)) for i in range(4000)]
    got = shard_documents(docs_of(rows).repartition(5)).collect()
    texts = dict(rows)
    for r in got:
        assert r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
        assert r.law == "bytes" and r.grown_shard is None
    by = shards_of(got)
    total, longest = sum(r.size for r in got), max(r.size for r in got)
    assert set(by) == set(range(16))
    for rows_in in by.values():
        assert sorted(r.slot for r in rows_in) == list(range(len(rows_in)))
        assert abs(sum(r.size for r in rows_in) - total / 16) <= 2 * longest + 0.002 * total / 16
    if not copies:
        homes = defaultdict(set)
        for r in got:
            homes[r.text_crc32].add(r.shard)
        assert all(len(h) == 1 for h in homes.values())


def test_sharding_awkward_rows(awkward, docs_of, tmp_path):
    got = shard_documents(awkward).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in awkward.collect())
    assert {r.text_crc32 for r in got if r.doc_id == 5} == {0} and {r.size for r in got if r.doc_id == 5} == {1}
    for rows_in in shards_of(got).values():
        assert sorted(r.slot for r in rows_in) == list(range(len(rows_in)))
    assert shard_documents(docs_of([])).count() == 0
    write_shards(awkward, str(tmp_path / "shards"), shards=4)
    back = awkward.sparkSession.read.parquet(str(tmp_path / "shards"))
    assert sorted(map(str, back.select("doc.*").collect())) == sorted(map(str, awkward.collect()))


# ---------------------------------------------------------------- licenses


def plain_scan(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text or ""))
    base = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    places = [(i, label) for phrase, label in base.items() for i in range(len(words)) if words[i:i + len(phrase.split())] == phrase.split()]
    return len(words), places


def plain_rules(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text or ""))
    spaced = "".join(f" {w} " for w in words)
    found = [(m.start(), m.end(), n) for n, r in enumerate(RULES) for m in re.finditer(r.pattern, spaced)]
    kept = [d for d in found if not any(e != d and e[0] <= d[0] and e[1] >= d[1] and ((e[0], e[1]) != (d[0], d[1]) or e[2] < d[2]) for e in found)]
    return {RULES[n].label for _, _, n in kept}, len(kept)


TEXTS = [
    "Licensed under the Apache License, Version 2.0.", "MIT License", "mit  LICENSE\nMIT-license", "Licensed under CC BY-NC 4.0.",
    "This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-2.0-only", "the commit licenses",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this", "gnu lesser general public license v2.1 or cc0",
    "cc by cc by cc-by-sa 3.0", None, "", "...", "ÄPACHE LICENSE", "apache license", "Released under the BSD 3-Clause license. All rights reserved.",
    "x " * 3000 + "mit license", "mit license " * 400,
]


def test_license_scan_matches_plain_search(docs_of):
    docs = docs_of([(i, t) for i, t in enumerate(TEXTS)])
    for r in scan_licenses(docs).collect():
        n, places = plain_scan(TEXTS[r.doc_id])
        starts = [i for i, _ in places]
        assert (r.n_words, r.n_base) == (n, len(places))
        assert (r.first_word, r.last_word) == ((min(starts), max(starts)) if starts else (None, None))
        base = {label for _, label in places}
        labels, kept = plain_rules(TEXTS[r.doc_id])
        assert r.base_labels == ",".join(sorted(base)) and r.labels == ",".join(sorted(base | labels))
        assert len(r.detections) == kept and 0 <= r.score <= 1 and (r.score > 0) == bool(base | labels)


def test_license_rules_are_many_and_gated():
    assert len(RULES) > 300
    for r in RULES:
        sample = re.sub(r"\(\?: ([^|)]*?) (\|[^)]*)?\)\??", r" \1 ", r.pattern)
        assert r.literal in r.pattern or r.literal in sample
        assert f" {r.keyword} " in r.pattern


def test_license_scan_edge_tables(awkward, docs_of):
    assert scan_licenses(awkward).count() == awkward.count()
    assert scan_licenses(docs_of([])).count() == 0
