"""Document-analysis results: previews, roll-ups, page cost, reprocess cache.

An analysis result is (apiVersion, model_id, content, pages[], documents[].fields{}).
The OCR service itself is not called; its results are a source.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.textfn import preview

# --- fixed values (must equal the reference) -------------------------------
PREVIEW_CHARS = 400
# model -> (price per page, pages per month at that price, price per page above)
PRICES = (
    ("prebuilt-read", 0.0015, 1_000_000, 0.0006),
    ("prebuilt-layout", 0.010, None, None),
    ("prebuilt-invoice", 0.010, None, None),
    ("custom-classification", 0.003, None, None),
    ("custom-extraction", 0.050, None, None),
)
FREE_PAGES_PER_MONTH = 500
# ---------------------------------------------------------------------------

FIELD_T = T.StructType([T.StructField("content", T.StringType()), T.StructField("confidence", T.DoubleType())])
RESULT_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("apiVersion", T.StringType()),
    T.StructField("model_id", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("pages", T.ArrayType(T.StructType([T.StructField("pageNumber", T.IntegerType())]))),
    T.StructField("documents", T.ArrayType(T.StructType([
        T.StructField("fields", T.MapType(T.StringType(), FIELD_T))]))),
    T.StructField("month", T.IntegerType()),
])


def price_table(spark) -> DataFrame:
    """The fixed price list (5 rows): safe to broadcast."""
    schema = "model_id string, price double, tier_pages long, price_above double"
    return spark.createDataFrame([tuple(p) for p in PRICES], schema)


def doc_preview(results: DataFrame) -> DataFrame:
    """PRJ11: first 400 characters, newlines as spaces, '...' when longer."""
    return results.select("doc_id", preview(F.col("content"), PREVIEW_CHARS).alias("preview"))


def doc_summary(results: DataFrame) -> DataFrame:
    """AG15: API version (default unknown), number of pages, model."""
    return results.select("doc_id", F.coalesce("apiVersion", F.lit("unknown")).alias("api_version"),
                          F.size(F.coalesce("pages", F.array())).alias("n_pages"), "model_id")


def doc_cost(results: DataFrame, free_tier: bool = False) -> DataFrame:
    """CMP7: pages and cost per (month, model).

    Each model has a per-page price; the read model drops to its lower price
    for the pages above the monthly tier. Costs are computed on monthly page
    totals (partial aggregation, no running window needed). ``free_tier``
    treats the first 500 pages of each month and model as free.
    """
    spark = results.sparkSession
    pages = results.groupBy("month", "model_id").agg(
        F.count(F.lit(1)).alias("docs"),
        F.sum(F.size(F.coalesce("pages", F.array()))).cast("long").alias("pages"))
    billable = F.greatest(F.col("pages") - F.lit(FREE_PAGES_PER_MONTH), F.lit(0)) if free_tier else F.col("pages")
    j = pages.join(F.broadcast(price_table(spark)), "model_id", "left")
    in_tier = F.when(F.col("tier_pages").isNull(), billable).otherwise(F.least(billable, F.col("tier_pages")))
    above = F.when(F.col("tier_pages").isNull(), F.lit(0)).otherwise(
        F.greatest(billable - F.col("tier_pages"), F.lit(0)))
    cost = in_tier * F.col("price") + above * F.coalesce(F.col("price_above"), F.col("price"))
    return j.select("month", "model_id", "docs", "pages", cost.alias("cost"))


def page_cost(pages, model_id: str) -> float:
    """Cost of one batch of ``pages`` on ``model_id`` below the volume tier (driver-side helper)."""
    price = {p[0]: p[1] for p in PRICES}[model_id]
    return pages * price


def content_key(content_col: str = "content"):
    return F.sha2(F.coalesce(F.col(content_col), F.lit("")), 256)


def reprocess_cache(batch: DataFrame, processed: DataFrame, content_col: str = "content") -> DataFrame:
    """CMP8: documents of ``batch`` whose content hash is not in ``processed``."""
    done = processed.select(content_key(content_col).alias("content_hash")).distinct()
    return batch.withColumn("content_hash", content_key(content_col)).join(done, "content_hash", "left_anti")


def invoice_fields(results: DataFrame) -> DataFrame:
    """CMP9: fields of the first document of each invoice result as rows."""
    inv = results.where(F.col("model_id") == "prebuilt-invoice")
    first = F.get(F.col("documents"), 0)
    return inv.select("doc_id", F.explode(first["fields"]).alias("field_name", "field")) \
        .select("doc_id", "field_name", F.col("field.content").alias("content"),
                F.col("field.confidence").alias("confidence"))


def jsonb_compat(df: DataFrame) -> DataFrame:
    """CMP13: every array / map / struct column as JSON text, driven by the schema."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            cols.append(F.to_json(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
