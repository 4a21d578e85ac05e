"""Document fingerprints from content-defined chunks, and what is left of them after an edit."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.arrow import text_slices
from vitrine.llm.chunking import Chunker, containment, fingerprint

#: Text that is chunked at once.
SLICE_BYTES = 4 << 20


def fingerprint_documents(docs: DataFrame, chunker: Chunker = Chunker()) -> DataFrame:
    """One row per document: ``doc_id, fingerprint``, without any exchange. Cases as in ``fingerprint_edits``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, "text", SLICE_BYTES):
            sets = chunker.sets([t.encode() for t in texts.to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(fingerprint, sets), pa.string())], ["doc_id", "fingerprint"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, fingerprint string")


def with_followers(docs: DataFrame) -> DataFrame:
    """Deal (doc_id, text) by ranges of descending id, so that the next document is the next row; a round trip at the end.

    Columns bucket, ghost, doc_id, text, in order inside each bucket. The ranges come from approximate quantiles of the
    ids (one number for each partition). A bucket ends with a ghost: a copy of the first document of the next bucket, and
    of the very first one in the last bucket. So every text is sent once, and two for each range twice.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    number = F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf")))
    given = docs.select("doc_id", F.col("text").cast("string").alias("text"), number.alias("number"))
    inner = sorted(set(given.where("doc_id IS NOT NULL").approxQuantile("number", [i / n for i in range(1, n)], 1 / (10 * n)) or []))
    if len(inner) > 1:
        splits = [float("-inf"), *inner, float("inf")]
        dealt = Bucketizer(splits=splits, inputCol="number", outputCol="cut").transform(given).withColumn("bucket", -F.col("cut").cast("int"))
    else:
        dealt = given.withColumn("bucket", F.lit(0))
    dealt = dealt.select("bucket", "doc_id", "text")
    firsts = [(r["bucket"], r["first"]) for r in dealt.groupBy("bucket").agg(F.max("doc_id").alias("first")).orderBy("bucket").collect()]
    kind = docs.schema["doc_id"].dataType.simpleString()
    heads = spark.createDataFrame([(b, first, firsts[i - 1][0]) for i, (b, first) in enumerate(firsts)], f"bucket int, first {kind}, before int")
    marked = dealt.join(F.broadcast(heads), "bucket", "left")
    copies = F.when(F.col("doc_id").eqNullSafe(F.col("first")), F.array(
        F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("ghost")), F.struct(F.col("before").alias("bucket"), F.lit(True).alias("ghost")),
    )).otherwise(F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("ghost"))))
    rows = marked.select(F.explode(copies).alias("c"), "doc_id", "text").select("c.bucket", "c.ghost", "doc_id", "text")
    return rows.repartitionById(n, F.pmod(F.col("bucket"), F.lit(n)).cast("int")).sortWithinPartitions("bucket", "ghost", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))


def fingerprint_edits(docs: DataFrame, chunker: Chunker = Chunker()) -> DataFrame:
    """One row per document: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many of the next document, by
    descending id; the first follows the last, and a single document follows itself. Rows repeated with the same id
    follow one another by hash of the text; a null id comes last. A null text counts as empty: its fingerprint is empty,
    and likeness is 1 to an empty text and 0 to any other. Equal texts have equal fingerprints. An empty table gives an
    empty result. Only doc_id and text are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # the last row of the slice before: bucket, id, text, chunks
        for batch, texts in text_slices(batches, "text", SLICE_BYTES):
            whole = texts.to_pylist()
            own = chunker.sets([t.encode() for t in whole])
            pairs, edited = [], []
            for bucket, ghost, ident, text, chunks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), whole, own):
                if before is not None and before[0] == bucket:
                    half = len(before[2]) // 2
                    pairs.append((before[1], before[2], before[3], chunks))
                    edited.append((before[2][:len(before[2]) - half] + text[:half]).encode())
                before = None if ghost else (bucket, ident, text, chunks)
            after = chunker.sets(edited)
            yield pa.RecordBatch.from_arrays([
                pa.array([p[0] for p in pairs], batch.column(2).type), pa.array([len(p[1]) for p in pairs], pa.int64()),
                pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()),
                pa.array([fingerprint(p[2]) for p in pairs], pa.string()), pa.array([fingerprint(a) for a in after], pa.string()),
                pa.array([containment(p[2], a) for p, a in zip(pairs, after)], pa.float64()),
                pa.array([containment(p[2], p[3]) for p in pairs], pa.float64())],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return with_followers(docs).mapInArrow(
        run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
