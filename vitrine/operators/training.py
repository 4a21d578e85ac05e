"""Training-set curation: trusted records, splits, readiness, hard negatives, embeddings and probes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions import scores as S
from vitrine.functions import text as X
from vitrine.functions.text import or_else
from vitrine.operators.filters import is_not_non_product
from vitrine.operators.quality import duplicate_ids
from vitrine.taxonomy import QueryVocabulary, Taxonomy

# Class sizes and dataset thresholds of the readiness decision.
WEAK_CLASS, SUFFICIENT_CLASS, READY_CLASSES, READY_EXAMPLES = 20, 50, 3, 200
SPLITS = (0.70, 0.15, 0.15)


def inferred_styles(p, words: QueryVocabulary) -> Column:
    found = F.transform(X.parts_found(X.training_text(p), words.training_styles), F.initcap)
    return F.when(F.coalesce(F.size(p["metadata.style"]), F.lit(0)) > 0, p["metadata.style"]).otherwise(found)


def inferred_colours(p, words: QueryVocabulary) -> Column:
    found = F.transform(X.parts_found(X.training_text(p), words.colours), F.initcap)
    stored = X.first_filled(p["metadata.colour"], p["metadata.color"])
    return F.when(stored.isNotNull(), F.array(stored)).otherwise(found)


def trusted_training_records(products: DataFrame, taxonomy: Taxonomy, words: QueryVocabulary, storage: str, dim: int, *,
                             min_confidence: float = S.CONFIDENCE_FLOOR, require_stable_image: bool = True) -> DataFrame:
    """Labelled records of confident, typed, unique, embedded products with a stable image."""
    found = X.identify_product(X.training_text(products), taxonomy)
    rows = products.withColumn("_product", found)
    wanted = (
        (or_else(F.col("classifier_confidence"), 0.0) >= min_confidence) & F.col("_product.type").isNotNull()
        & is_not_non_product(F.col("catalog_status")) & (or_else(F.col("brand_id"), "") != "") & S.has_embedding(F.col("embedding"), dim))
    if require_stable_image:
        wanted &= S.training_stable_image(F.col("image_url"), F.col("image_status"), storage)
    rows = rows.where(wanted).join(duplicate_ids(products), "id", "left_anti")
    source = or_else(X.first_filled(F.col("classification_source")), "heuristic")
    label = lambda mapping, c: F.coalesce(F.element_at(X.literal_map(mapping), c), c)
    return rows.select(
        F.col("id").alias("product_id"), "brand_id", X.first_filled(F.col("product_name"), F.col("item_name")).alias("name"),
        or_else(F.col("description"), "").alias("description"), or_else(X.first_filled(F.col("metadata.caption"), F.col("description")), "").alias("caption"),
        "image_url", or_else(X.first_filled(F.col("normalized_main_category"), F.col("audience")), "").alias("category"),
        or_else(X.first_filled(F.col("normalized_subcategory"), F.col("subcategory")), "").alias("subcategory"),
        label({f: taxonomy.family_label(f) for f in taxonomy.families}, F.col("_product.family")).alias("product_family"),
        label(taxonomy.type_labels, F.col("_product.type")).alias("product_type"),
        inferred_colours(rows, words).alias("colour"), inferred_styles(rows, words).alias("style"), F.col("metadata.fit").alias("fit"),
        or_else(F.col("audience"), "").alias("audience"), F.col("classifier_confidence").alias("label_confidence"),
        F.when(source.isin("ai", "openai", "manual"), "ai+validated").otherwise(source).alias("label_source"), "embedding")


def grouped_split(records: DataFrame, *, seed: str = "split-v1", ratios=SPLITS, group: str = "brand_id", fallback: str = "product_id") -> DataFrame:
    """Add ``split``: every group falls whole into train, validation or test by a hash of its key."""
    if abs(sum(ratios) - 1) > 1e-8:
        raise ValueError("split ratios must sum to 1")
    key = X.first_filled(F.col(group), F.col(fallback))
    digest = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key), 256), 1, 12)
    bucket = F.conv(digest, 16, 10).cast("double") / F.lit(float(16 ** 12))
    return records.withColumn("split", F.when(bucket < ratios[0], "train").when(bucket < ratios[0] + ratios[1], "validation").otherwise("test"))


def training_readiness(records: DataFrame) -> DataFrame:
    """(section, key, n, status): counts by type, category and style with the class status."""
    cell = lambda section, key: F.struct(F.lit(section).alias("section"), key.alias("key"))
    plain = F.array(cell("type", or_else(F.col("product_type"), "Unknown")), cell("category", or_else(X.first_filled(F.col("subcategory"), F.col("category")), "Unknown")))
    styles = F.transform("style", lambda s: F.struct(F.lit("style").alias("section"), s.alias("key")))
    counts = records.select(F.explode(F.concat(plain, styles)).alias("c")).select("c.*").groupBy("section", "key").agg(F.count("*").alias("n"))
    status = F.when(F.col("n") >= SUFFICIENT_CLASS, "SUFFICIENT").when(F.col("n") >= WEAK_CLASS, "WEAK").otherwise("INSUFFICIENT")
    return counts.withColumn("status", F.when(F.col("section") == "type", status).when((F.col("section") == "style") & (F.col("n") >= 50), "ELIGIBLE"))


def training_decision(records: DataFrame, stable_images: int | None = None) -> DataFrame:
    types = training_readiness(records).where("section = 'type'")
    row = types.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("usable_examples"), F.count_if(F.col("status") == "SUFFICIENT").alias("sufficient_types"))
    n, k = F.col("usable_examples"), F.col("sufficient_types")
    stable = n if stable_images is None else F.lit(stable_images)
    decision = (F.when((n < READY_EXAMPLES) | (k < READY_CLASSES) | (stable < READY_EXAMPLES), "TRAINING_NOT_READY")
                .when((n >= 1000) & (k >= 8), "READY_FOR_FINE_TUNING_REVIEW").otherwise("READY_FOR_LINEAR_PROBE"))
    return row.withColumn("decision", decision)


def review_set(products: DataFrame, taxonomy: Taxonomy, words: QueryVocabulary, limit: int | None = 500) -> DataFrame:
    """Products with low confidence or no type, with blank columns for a reviewer; ``limit`` is the set's size."""
    kind = X.identify_product(X.training_text(products), taxonomy)["type"]
    rows = products.select(
        F.col("id").alias("product_id"), F.col("image_url").alias("image"), F.col("product_name").alias("name"), F.col("description").alias("caption"),
        F.col("brand_name").alias("brand"), F.col("normalized_subcategory").alias("current_category"), F.lit("").alias("proposed_category"),
        F.element_at(X.literal_map(taxonomy.type_labels), kind).alias("current_product_type"), F.lit("").alias("proposed_product_type"),
        inferred_styles(products, words).alias("style"), inferred_colours(products, words).alias("colour"),
        or_else(F.col("classifier_confidence"), 0.0).alias("confidence"), F.lit("").alias("approved"), F.lit("").alias("rejected"), F.lit("").alias("corrected"))
    kept = rows.where((F.col("confidence") < S.CONFIDENCE_FLOOR) | F.col("current_product_type").isNull())
    return kept if limit is None else kept.orderBy("product_id").limit(limit)


def hard_negative_kind(query: Column, product_text: Column, taxonomy: Taxonomy, words: QueryVocabulary) -> Column:
    """Kind of near miss between a query and a returned product, or null."""
    wanted, found = X.identify_product(query, taxonomy), X.identify_product(product_text, taxonomy)
    asked, seen = X.parts_found(F.lower(query), words.colours), X.parts_found(F.lower(product_text), words.colours)
    shared = F.size(F.array_intersect(asked, seen)) > 0
    same = lambda f: wanted[f].eqNullSafe(found[f])
    return (F.when(wanted["family"].isNotNull() & ~same("family") & shared, "same_colour_wrong_family")
            .when(same("family") & ~same("type"), "same_family_wrong_type")
            .when(same("type") & (F.size(asked) > 0) & ~shared, "right_type_wrong_colour"))


# ---------------------------------------------------------------- embeddings and probes


def hashed_features(dim: int) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """The stand-in encoder: signed word hashes, unit length. Pass a real model's factory in its place."""
    import hashlib

    def make():
        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dim))
            for row, text in enumerate(texts):
                for word in text.lower().split():
                    h = int.from_bytes(hashlib.sha256(word.encode()).digest()[:8], "big")
                    out[row, h % dim] += 1.0 if h >> 63 else -1.0
                if not out[row].any():
                    out[row, 0] = 1.0
            return out / np.sqrt((out * out).sum(axis=1, keepdims=True))

        return encode

    return make


def embed_backfill(products: DataFrame, encoder_factory: Callable, dim: int) -> DataFrame:
    """(id, embedding) for products without one, from brand, name and description joined by a bar.

    The encoder is made once per task and works on whole Arrow batches.
    """
    filled = [F.nullif(F.col(c), F.lit("")) for c in ("brand_name", "item_name", "description")]
    todo = products.where("embedding IS NULL").select("id", F.concat_ws(" | ", *filled).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder_factory()
        for batch in batches:
            vectors = np.asarray(model(batch.column("text").to_pylist()), dtype=np.float32)
            if vectors.shape != (batch.num_rows, dim):
                raise ValueError(f"the encoder returned {vectors.shape[1:]} dimensions, expected {dim}")
            if batch.num_rows and np.abs(np.sqrt((vectors * vectors).sum(axis=1)) - 1).max() > 0.02:
                raise ValueError("the encoder returned vectors that are not of unit length")
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (batch.num_rows + 1) * dim, dim), pa.int32()), pa.array(vectors.ravel(), pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), lists], names=["id", "embedding"])

    return todo.mapInArrow(encode, "id string, embedding array<float>")


def class_prototypes(labelled: DataFrame) -> DataFrame:
    """(label, embedding): the mean vector of each class."""
    cells = labelled.where("embedding IS NOT NULL").select("label", F.posexplode("embedding").alias("pos", "x"))
    means = cells.groupBy("label", "pos").agg(F.bround(F.avg(F.col("x").cast("double")), 12).alias("x"))
    return means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("v")).select(
        "label", F.transform("v", lambda c: c["x"]).alias("embedding"))


def linear_probe(train: DataFrame, test: DataFrame, *, max_iter: int = 100) -> DataFrame:
    """(id, actual, predicted) of a class-balanced logistic regression on the embeddings."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IndexToString, StringIndexer
    from pyspark.ml.functions import array_to_vector

    vector = lambda df: df.withColumn("features", array_to_vector(F.col("embedding").cast("array<double>")))
    counts = train.groupBy("label").agg(F.count("*").alias("n"))
    sizes = counts.agg(F.sum("n").alias("total"), F.count("*").alias("classes")).first()
    if sizes["classes"] < 2:
        raise ValueError("a linear probe needs at least two classes")
    weighted = train.join(counts, "label").withColumn("weight", F.lit(float(sizes["total"])) / (F.lit(float(sizes["classes"])) * F.col("n")))
    indexer = StringIndexer(inputCol="label", outputCol="index", handleInvalid="skip", stringOrderType="alphabetAsc").fit(counts)
    model = LogisticRegression(featuresCol="features", labelCol="index", weightCol="weight", maxIter=max_iter).fit(vector(indexer.transform(weighted)))
    guessed = model.transform(vector(test))
    named = IndexToString(inputCol="prediction", outputCol="predicted", labels=indexer.labels).transform(guessed)
    return named.select("id", F.col("label").alias("actual"), "predicted")
