"""Reading the catalog tables with fixed schemas; a missing failures table is an empty one."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

METADATA = (
    "struct<colour:string,color:string,style:array<string>,fit:string,primary_colour:string,secondary_colours:array<string>,"
    "product_type:string,product_family:string,caption:string,hashtags:array<string>,alt_text:string,post_text:string>"
)
PRODUCTS = (
    "id string, brand_id string, brand_name string, brand string, product_name string, item_name string, description string, "
    "image_url string, image_status string, product_url string, source_url string, source string, instagram_post_id string, "
    "price double, currency string, niche_score double, category_id bigint, subcategory string, normalized_main_category string, "
    "normalized_subcategory string, audience string, classifier_confidence double, classification_source string, "
    "catalog_status string, likes_count int, comments_count int, source_hashtag string, scraped_at timestamp, "
    f"created_at timestamp, embedding array<float>, metadata {METADATA}"
)
BRANDS = (
    "id string, name string, brand_name string, instagram_username string, category string, followers int, niche_score double, "
    "profile_picture_url string, instagram_profile_url string, profile_url string"
)
CATEGORIES = "id bigint, parent_id bigint, name string, slug string, audience string, display_order int"
FAILURES = "brand_id string, brand_name string, stage string, message string, recoverable boolean, occurred_at timestamp, resolved_at timestamp"
INTERACTIONS = "user_id string, product_id string, action string, timestamp timestamp"
SCHEMAS = {"products": PRODUCTS, "brands": BRANDS, "categories": CATEGORIES, "failures": FAILURES, "interactions": INTERACTIONS}


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Spread a table of few files over all cores before costly per-row work.

    A small file often is one row group and so one task. A table of many files is left where it lies.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def failures_or_empty(spark: SparkSession, path: str) -> DataFrame:
    try:
        return read_table(spark, path, FAILURES)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], FAILURES)


def scan_catalog(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(brands, products, failures) of a catalog folder."""
    return (
        read_table(spark, f"{path}/brands", BRANDS),
        read_table(spark, f"{path}/products", PRODUCTS),
        failures_or_empty(spark, f"{path}/failures"),
    )


def with_missing_columns(df: DataFrame, schema: str) -> DataFrame:
    """Add the absent columns of a schema as typed nulls, so that a missing key reads as null."""
    from pyspark.sql import functions as F
    from pyspark.sql.types import _parse_datatype_string

    wanted = _parse_datatype_string(schema)
    return df.select(*[
        df[f.name].cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in wanted
    ])
