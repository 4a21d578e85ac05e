"""A training corpus from raw documents: toxic documents out, copies out, near copies out, sources mixed, sequences packed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vitrine.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from vitrine.llm.common import table
from vitrine.llm.queries import tokenizer_file
from vitrine.session import scratch_folder

#: Similarity of near copies as per cent of the union of their five-word shingles, and tables that show 0.9998 of the pairs at it.
NEAR_PER_CENT, NEAR_TABLES = 80, near_dedup.Tensor(slots=13)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain model, fitted on the labelled ones among them, predicts to be toxic go."""
    return toxicity.drop_toxic(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id stays."""
    return exact_dedup.drop_exact_copies(docs, keep="largest")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the row with the smallest id stays."""
    return near_dedup.drop_near_copies(docs, tensor=NEAR_TABLES, per_cent=NEAR_PER_CENT)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that the sources meet their target weights."""
    return mixing.emit_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every document, or piece of a long one, in the training sequences."""
    return packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", clean), ("exact_dedup", exact), ("near_dedup", near), ("mix_sources", mix), ("best_fit_packing", pack),
]

#: The learned stages have no SQL form; tests/llm holds the whole run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written under the checkpoint folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        folder = scratch_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
