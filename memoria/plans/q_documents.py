"""Queries over document-analysis results."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import documents as doc
from ..sources import derived as d
from ..sources.tables import Tables
from .catalog import query


def _ar(spark, sf_dir):
    return d.analysis_results(Tables(spark, sf_dir))


@query("doc_preview")
def q_preview(spark, sf_dir):
    return doc.doc_preview(_ar(spark, sf_dir))


@query("doc_summary")
def q_summary(spark, sf_dir):
    return doc.doc_summary(_ar(spark, sf_dir))


@query("doc_cost")
def q_cost(spark, sf_dir):
    return doc.doc_cost(_ar(spark, sf_dir)).withColumn("cost", F.round("cost", 6))


@query("doc_reprocess_cache")
def q_cache(spark, sf_dir):
    t = Tables(spark, sf_dir)
    batch = t.documents.select("doc_id", F.col("text").alias("content"))
    processed = _ar(spark, sf_dir).where(F.col("doc_id") % 4 == 0)
    return doc.reprocess_cache(batch, processed).select("doc_id", "content_hash")


@query("invoice_fields")
def q_invoice(spark, sf_dir):
    return doc.invoice_fields(_ar(spark, sf_dir))


@query("jsonb_compat")
def q_jsonb(spark, sf_dir):
    return doc.jsonb_compat(_ar(spark, sf_dir).select("doc_id", "pages", "documents"))
