"""Registered queries of the corpus operators, each over its whole table with production parameters."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import Tables
from . import clusters, extract, licences, lm, mixing, neardup, neighbours, packing, quality, ranking, repeats, trie, urlfilter

URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
             ("allow", "com/fr/"), ("block", "com/de/")]
# vantage-point pruning of the registered search; see the recall test
SEARCH_FACTOR = 1.1


def document_number(url: Column) -> Column:
    """The number that is the last name of a URL's path, with a slash or a file ending after it or not."""
    return F.regexp_extract(
        url, r"://[^/?#]*/(?:[^/?#]*/)*([0-9]+)(?:/|\.[A-Za-z0-9]+)?(?:[?#]|\z)", 1).try_cast("bigint")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.main_text(Tables(spark, sf_dir).pages)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(Tables(spark, sf_dir).documents)


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.find_licences(Tables(spark, sf_dir).documents)


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.entropy_mix(Tables(spark, sf_dir).documents)


def op5_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.classes(Tables(spark, sf_dir).documents)
    return found.select("doc_id", F.col("class").alias("class_id"), "links")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lattice_scores(Tables(spark, sf_dir).documents)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_bytes(Tables(spark, sf_dir).documents)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(Tables(spark, sf_dir).documents)


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    # a page shows the document whose number ends its path; a label of that document is one of the page
    number = document_number(F.col("url"))
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    labelled = t.pages.select("url", number.alias("doc_id")).join(
        t.labels.select("doc_id", bad.alias("bad")), "doc_id").select("url", "bad")
    return urlfilter.url_filter(t.pages, labelled, URL_RULES)


def op10_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(Tables(spark, sf_dir).embeddings, factor=SEARCH_FACTOR)


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return ranking.quality_scores(t.documents, t.labels)


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster(Tables(spark, sf_dir).embeddings)


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.rebuilt_trie(Tables(spark, sf_dir).conversations)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_html_extraction, op2_quality_rules, op3_license_scans, op4_source_mixing, op5_minhash_neardup,
        op6_lm_scoring, op7_suffix_dedup, op8_packing, op9_url_filters, op10_nearest_vectors,
        op11_quality_classifier, op12_centroid_clusters, op13_conversation_trie)
}
