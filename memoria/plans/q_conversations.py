"""Queries over conversations."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import conversations as conv
from ..sources import derived as d
from ..sources.tables import Tables
from .catalog import query


def _cc(spark, sf_dir):
    return d.classified_conversations(Tables(spark, sf_dir))


@query("conversation_classify")
def q_classify(spark, sf_dir):
    return conv.classify(_cc(spark, sf_dir))


@query("conversation_stats")
def q_stats(spark, sf_dir):
    return conv.conversation_stats(_cc(spark, sf_dir))


@query("store_conversation")
def q_store(spark, sf_dir):
    s = conv.store_conversation(_cc(spark, sf_dir))
    return s.select("thread_id", "observation", "memory_type", "importance", "message_count", "conversation_length",
                    F.element_at("outcome", "status").alias("status"))
