"""The registered queries of the corpus operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm import (
    exact_dedup, fingerprints, licenses, manifest, mixing, near_dedup, packing, ranked_search, resampling, sharding, token_counts, toxicity,
    vertical_join,
)
from vitrine.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def register(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return register


def tokenizer_file(name: str) -> str:
    """Where the public vocabularies are installed; the same place on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _rows(rules) -> str:
    cells = [(n, r.label, f" {r.keyword} ", r.pattern, r.certainty) for n, r in enumerate(rules)]
    return ", ".join(f"({n}, '{label}', '{keyword}', '{pattern}', {certainty}::DOUBLE)" for n, label, keyword, pattern, certainty in cells)


def _found(rules: str) -> str:
    """SQL: word intervals of all matches of a rule table."""
    n = "(length({0}) - length(replace({0}, ' ', ''))) // 2"
    return f"""
    SELECT doc_id, rule, label, certainty, start, start + {n.format("split_part(part, chr(2), 1)")} AS stop FROM (
        SELECT *, sum({n.format("part")}) OVER (PARTITION BY doc_id, rule ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)::BIGINT AS start FROM (
            SELECT doc_id, rule, label, certainty, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM (
                SELECT doc_id, r.*, string_split(regexp_replace(s, '(' || pattern || ')', chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS parts
                FROM spaced JOIN {rules} r ON contains(s, keyword))))
    WHERE i > 1"""


BASE_RULES = [licenses.Rule(label, licenses.words(phrase)[1:-1], licenses.words(phrase), licenses.words(phrase), 0.75) for phrase, label in licenses.BASE.items()]


@query("op1_license_scan", rf"""
WITH rules(rule, label, keyword, pattern, certainty) AS (VALUES {_rows(licenses.RULES)}),
base_rules(rule, label, keyword, pattern, certainty) AS (VALUES {_rows(BASE_RULES)}),
inner_words AS (
    SELECT doc_id, trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', '  ', 'g')) AS w FROM documents),
spaced AS (SELECT doc_id, CASE WHEN w = '' THEN '' ELSE ' ' || w || ' ' END AS s FROM inner_words),
base AS ({_found("base_rules")}),
found AS ({_found("rules")}),
swept AS (
    SELECT *, max(stop) OVER (PARTITION BY doc_id ORDER BY start, stop DESC, rule ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
    FROM found),
outermost AS (SELECT * FROM swept WHERE reach IS NULL OR stop > reach),
per_base AS (
    SELECT doc_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word,
           array_to_string(list_sort(list_distinct(list(label))), ',') AS base_labels FROM base GROUP BY doc_id),
per_all AS (
    SELECT doc_id, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, max(certainty) AS score
    FROM (SELECT doc_id, label, certainty FROM base UNION ALL SELECT doc_id, label, certainty FROM outermost) GROUP BY doc_id),
per_kept AS (SELECT doc_id, count(*) AS n_detections FROM outermost GROUP BY doc_id)
SELECT s.doc_id, ((length(s) - length(replace(s, ' ', ''))) // 2)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score, coalesce(n_detections, 0) AS n_detections
FROM spaced s LEFT JOIN per_base USING (doc_id) LEFT JOIN per_all USING (doc_id) LEFT JOIN per_kept USING (doc_id)
""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    return found.withColumn("n_detections", F.size("detections").cast("long")).drop("detections")


@query("op2_near_dedup", r"""
WITH RECURSIVE worded AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents),
shingles AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
    FROM worded, unnest(range(1, greatest(len(w) - 3, CASE WHEN len(w) > 0 THEN 2 ELSE 1 END))) AS u(i)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
    SELECT x, y FROM shared s JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * s.n >= 85 * (a.n + b.n - s.n)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
least_id AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x),
classes AS (SELECT doc_id, string_agg(g, chr(10) ORDER BY g) AS c FROM shingles GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept,
       CASE WHEN c IS NOT NULL THEN min(d.doc_id) OVER (PARTITION BY c) END AS class_id
FROM documents d JOIN least_id USING (doc_id) LEFT JOIN sizes USING (doc_id) LEFT JOIN classes USING (doc_id)
""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op5_exact_dedup", """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
WINDOW same AS (PARTITION BY t)
""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


@query("op6_best_fit_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


@query("op7_token_counts")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


@query("op8_mix_sources", r"""
WITH sized AS (
    SELECT doc_id, source, length(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
sources AS (
    SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS top,
           [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
    FROM sized GROUP BY source),
levels AS (  -- in order of top / weight: what is left for the rest once these and all before are full
    SELECT *, sum(source_size) OVER () - coalesce(sum(top) OVER before, 0) AS rest, sum(weight) OVER after AS weights
    FROM sources
    WINDOW before AS (ORDER BY top / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
           after AS (ORDER BY top / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
level AS (
    SELECT rest, weights FROM levels WHERE top::DOUBLE * weights >= rest::DOUBLE * weight ORDER BY top / weight, source NULLS LAST LIMIT 1),
targets AS (
    SELECT s.source, s.source_size,
           CASE WHEN top < (rest::DOUBLE / weights) * weight THEN top::DOUBLE ELSE rest::DOUBLE * weight / weights::DOUBLE END AS target,
           ('0x' || substr(md5('mix' || coalesce('=' || s.source, '')), 1, 4))::INT / 65536.0::DOUBLE AS start
    FROM sources s, level),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id) - 1 AS nth FROM sized)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       CAST((floor((CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) * (nth + 1) + start)
             - floor((CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) * nth + start)) * size AS BIGINT) AS taken
FROM ranked r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source
""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


@query("op9_histogram_sharding")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


@query("op10_toxicity")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, model)
    return scored.withColumn("n_spans", F.size("spans").cast("long")).drop("spans")


@query("op4_fingerprints")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


@query("op3_importance_resampling")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op11_ranked_search", r"""
WITH terms AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
asked AS (
    SELECT item_id, term, count(*) AS repeats FROM (
        SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
lengths AS (SELECT doc_id, count(*) AS n FROM terms GROUP BY doc_id),
whole AS (SELECT count(*) AS documents, sum(n)::BIGINT AS total FROM lengths),
norms AS (SELECT doc_id, 100 - 75 + (75 * n * documents) // total AS m FROM lengths, whole),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM terms WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (
    SELECT term, floor(1000 * ln((2 * documents + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
    FROM (SELECT term, count(*) AS df FROM tfs GROUP BY term), whole),
scores AS (
    SELECT item_id, doc_id, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
    FROM asked JOIN tfs USING (term) JOIN weights USING (term) JOIN norms USING (doc_id) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _levels(name: str, start: str) -> str:
    """SQL: the nodes of all levels of trees whose leaves ``start`` gives as (tree, idx, digest, n)."""
    return f"""{name} AS (
    SELECT tree, 0 AS level, idx, digest, n FROM {start}
    UNION ALL
    SELECT tree, any_value(level) + 1, idx // 16, sha256(string_agg(digest, '' ORDER BY idx)), any_value((n + 15) // 16) FROM {name} WHERE n > 1 GROUP BY tree, idx // 16)"""


def _folds(name: str, start: str, nodes: str) -> str:
    """SQL: leaves folded up to the tops of their trees, with their siblings; ``start`` gives (doc_id, tree, idx, node, proof)."""
    return f"""{name}_runs AS (SELECT tree, level, idx // 16 AS up, string_agg(digest, '' ORDER BY idx) AS run FROM {nodes} WHERE n > 1 GROUP BY ALL),
{name} AS (
    SELECT doc_id, tree, 0 AS level, idx, node, proof FROM {start}
    UNION ALL
    SELECT doc_id, f.tree, f.level + 1, idx // 16, sha256(substr(run, 1, 64 * (idx % 16)) || node || substr(run, 64 * (idx % 16) + 65)),
           proof || substr(run, 1, 64 * (idx % 16)) || substr(run, 64 * (idx % 16) + 65)
    FROM {name} f JOIN {name}_runs r ON f.tree = r.tree AND f.level = r.level AND idx // 16 = up),
{name}_tops AS (SELECT * FROM {name} QUALIFY level = max(level) OVER (PARTITION BY doc_id))"""


def _field(value: str) -> str:
    return f"coalesce(strlen(({value})::VARCHAR)::VARCHAR || ':' || ({value})::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(_field(f) for f in ('doc_id', 'source', 'lang', 'n_chars', text))})"


@query("op12_merkle_manifest", f"""
WITH RECURSIVE hashed AS (
    SELECT doc_id, coalesce('=' || source, '') AS tree, {_leaf('text')} AS leaf,
           {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS forged,
           xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
               lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))) % 5 = 0 AS tampered
    FROM documents),
leaves AS (
    SELECT doc_id, tree, leaf AS digest, CASE WHEN tampered THEN forged ELSE leaf END AS offered,
           row_number() OVER (PARTITION BY tree ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM hashed),
{_levels("nodes", "leaves")},
subroots AS (SELECT tree AS source_tree, digest AS subroot, digest, '*' AS tree, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1),
{_levels("tops", "subroots")},
inside AS (SELECT doc_id, tree, idx, offered AS node, '' AS proof FROM leaves),
{_folds("below", "inside", "nodes")},
outside AS (SELECT b.doc_id, '*' AS tree, s.idx, b.node, b.proof FROM below_tops b JOIN subroots s ON s.source_tree = b.tree),
{_folds("above", "outside", "tops")}
SELECT l.doc_id, l.digest AS leaf, s.subroot, r.digest AS root, sha256(a.proof) AS proof_sha256, a.node AS folded_root, a.node = r.digest AS verified
FROM leaves l JOIN above_tops a USING (doc_id) JOIN subroots s ON s.source_tree = l.tree, (SELECT digest FROM tops WHERE n = 1) r
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.verified_manifest(table(spark, sf_dir, "documents"))


@query("op13_jaccard_join", r"""
WITH RECURSIVE worded AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents),
shingles AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g
    FROM worded, unnest(range(1, greatest(len(w) - 1, CASE WHEN len(w) > 0 THEN 2 ELSE 1 END))) AS u(i)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
    SELECT x, y FROM shared s JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * s.n >= 90 * (a.n + b.n - s.n)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
least_id AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x),
classes AS (SELECT doc_id, string_agg(g, chr(10) ORDER BY g) AS c FROM shingles GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, CASE WHEN c IS NOT NULL THEN min(d.doc_id) OVER (PARTITION BY c) END AS class_id
FROM documents d JOIN least_id USING (doc_id) LEFT JOIN sizes USING (doc_id) LEFT JOIN classes USING (doc_id)
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vertical_join.jaccard_join(table(spark, sf_dir, "documents"))
