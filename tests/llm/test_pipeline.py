"""The pipeline, stage by stage, against plain Python; the registration guard."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from llm_helpers import ascii_lower, docs_of  # noqa: F401
from test_free_operators import edited, plain_components, prose
from test_native_operators import plain_targets
from tokenizers import Tokenizer

import corpus_pipeline
from vitrine.llm import toxicity


@pytest.fixture(scope="module")
def folder(spark, docs_of, tmp_path_factory):  # noqa: F811
    """Documents with toxic texts, exact and near copies, nulls and a long text, under three sources."""
    rows, labels = [], []
    for i in range(120):
        words = prose(i, 50).split()
        toxic = i % 4 == 0
        if toxic:
            words[10] = words[30] = "vileword"
            words.append("nastyterm")
        rows.append((i, " ".join(words), ("x", "y", None)[i % 3]))
        labels.append((i, 1, int(toxic)))
    rows += [(200 + i, rows[4 * i + 1][1].upper(), "x") for i in range(10)]
    rows += [(300 + i, edited(rows[4 * i + 2][1], i, 1), "y") for i in range(10)]
    rows += [(400, None, "x"), (401, "", None), (402, prose(77, 6000), "x")]
    path = tmp_path_factory.mktemp("sf")
    docs_of(rows).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages_match_plain_versions(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        before, docs = docs.collect(), spark.read.parquet(str(tmp_path / name))
        kept[name] = before, docs.collect()

    before, after = kept["toxicity"]
    model = toxicity.fit_toxicity(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    scored = {r.doc_id: r.predicted for r in toxicity.score_toxicity(spark.read.parquet(f"{folder}/documents.parquet"), model).collect()}
    assert sorted(r.doc_id for r in after) == sorted(i for i, p in scored.items() if not p)
    assert np.mean([scored[i] == int(i % 4 == 0) for i in range(120)]) > 0.97

    before, after = kept["exact_dedup"]
    groups = defaultdict(list)
    for r in before:
        groups[ascii_lower(r.text or "")].append(r.doc_id)
    assert sorted(r.doc_id for r in after) == sorted(max(ids) for ids in groups.values())

    before, after = kept["near_dedup"]
    components = plain_components([(r.doc_id, r.text) for r in before], 80)
    strict = plain_components([(r.doc_id, r.text) for r in before], 85)
    assert any(i != c and strict[i][1] == i for i, (_, c) in components.items())
    assert sorted(r.doc_id for r in after) == sorted(i for i, (_, c) in components.items() if i == c)

    before, after = kept["mix_sources"]
    sizes, taken = Counter(), Counter()
    for r in before:
        sizes[r.source] += len((r.text or "").split())
    copies = Counter(r.doc_id for r in after)
    for r in before:
        taken[r.source] += copies[r.doc_id] * len((r.text or "").split())
        assert copies[r.doc_id] <= 3
    longest = max(len((r.text or "").split()) for r in before)
    for source, target in plain_targets(dict(sizes)).items():
        assert abs(taken[source] - target) <= 3 * longest

    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in after:
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        for n, low in enumerate(range(0, len(ids), 2048)):
            want[r.doc_id, n, low, len(ids[low:low + 2048]), zlib.crc32(ids[low:low + 2048].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want
    assert sorted(map(str, corpus_pipeline.run(spark, folder).select("doc_id", "piece", "length").collect())) == sorted(
        str(r) for r in spark.createDataFrame([(r.doc_id, r.piece, r.length) for r in packed], "doc_id long, piece int, length long").collect())


def test_registered_queries_follow_the_package():
    import __spark_entry__ as entry

    keys = entry.queries()
    assert "pipeline" in keys and all(any(k.startswith(f"op{n}_") for k in keys) for n in range(1, 11))
    assert set(entry.oracle_sql()) <= set(keys)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mix_sources", "best_fit_packing"]
