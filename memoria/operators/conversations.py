"""Conversation roll-ups and keyword classification (experience store input).

The reference lower-cases all messages of a conversation, joins them with a
space and tests plain substrings. Here every message is tested on its own and
the flags are OR-ed per conversation (partial aggregation, no text moved); a
keyword that contains a space can also match across the join of messages,
which is found by folding summaries of a few characters per message.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.textfn import contains_any
from .retention import HIGH, MEDIUM

# --- fixed values (must equal the reference) -------------------------------
# First matching class wins: (memory_type, importance, keywords)
KEYWORD_CLASSES = (
    ("preference", HIGH, ("remember", "important", "preference", "like", "dislike")),
    ("error", MEDIUM, ("error", "mistake", "wrong", "failed")),
    ("skill", HIGH, ("learn", "skill", "how to", "tutorial")),
)
DEFAULT_CLASS = ("interaction", MEDIUM)
OBSERVATION_PREFIX = "Processed conversation about "
OBSERVATION_CHARS = 100
STORE_REASONING = "Agent successfully handled user interaction"
STORE_ACTION = "Generated appropriate responses"
STORE_TAGS = ("conversation", "interaction")
# ---------------------------------------------------------------------------


SEGMENT_ROWS = 1024


def _multi_word() -> list[tuple[str, str]]:
    return [(cls, w) for cls, _, words in KEYWORD_CLASSES for w in words if " " in w]


def _merge(words: list[str], reach: int):
    """The summary of two neighbouring texts joined by a space, from their summaries.

    A summary is (head, tail, found): the first and last ``reach`` characters and
    whether each keyword occurs across a join inside. Merging is associative, so
    segments can be folded in any grouping that keeps their order.
    """
    def run(a, b):
        seam = F.concat(a["tail"], F.lit(" "), b["head"])
        found = F.array(*[a["found"][i] | b["found"][i] | seam.contains(w) for i, w in enumerate(words)])
        head = F.when(F.length(a["head"]) < reach, F.substring(F.concat(a["head"], F.lit(" "), b["head"]), 1, reach)) \
            .otherwise(a["head"])
        both = F.concat(a["tail"], F.lit(" "), b["tail"])
        tail = F.when(F.length(b["tail"]) < reach, F.right(both, F.lit(reach))).otherwise(b["tail"])
        return F.struct(head.alias("head"), tail.alias("tail"), found.alias("found"))
    return run


def _fold(items, words, reach: int):
    """The summaries of an array in its order as one."""
    first = F.struct(*[items[0][c].alias(c) for c in ("head", "tail", "found")])
    return F.aggregate(F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))), first, _merge(words, reach))


def _spanning_flags(msgs: DataFrame, conv: str, order: str) -> DataFrame | None:
    """Per conversation: which multi-word keywords lie across the join of its messages.

    Messages are summarised by a few characters each; the summaries of a block of
    ``SEGMENT_ROWS`` order values are folded, then those of the blocks of a
    conversation, so no text moves and no conversation is ordered as a whole.
    """
    multi = _multi_word()
    if not multi:
        return None
    words = [w for _, w in multi]
    reach = max(map(len, words)) - 1
    none = F.array(*[F.lit(False)] * len(words))
    one = msgs.select(conv, F.col(order).alias("_at"), F.floor(F.col(order) / SEGMENT_ROWS).alias("_block"),
                      F.substring("_low", 1, reach).alias("head"), F.right("_low", F.lit(reach)).alias("tail"),
                      none.alias("found"))
    item = F.struct("_at", "head", "tail", "found")
    part = one.groupBy(conv, "_block").agg(F.array_sort(F.collect_list(item)).alias("_items"))
    part = part.select(conv, "_block", _fold(F.col("_items"), words, reach).alias("_s")).select(conv, "_block", "_s.*")
    item = F.struct("_block", "head", "tail", "found")
    full = part.groupBy(conv).agg(F.array_sort(F.collect_list(item)).alias("_items"))
    full = full.select(conv, _fold(F.col("_items"), words, reach)["found"].alias("_f"))
    classes = {cls for cls, _ in multi}
    return full.select(conv, *[
        reduce(lambda a, b: a | b, [F.col("_f")[i] for i, (c, _) in enumerate(multi) if c == cls]).cast("int").alias(f"_span_{cls}")
        for cls in sorted(classes)])


def classify(messages: DataFrame, conv: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """SC27 per conversation: (memory_type, importance) by the first matching keyword class.

    ``order`` is a number. Null texts are no messages.
    """
    low = messages.where(F.col(text).isNotNull()).select(conv, order, F.lower(F.col(text)).alias("_low"))
    aggs = [F.max(contains_any(F.col("_low"), words).cast("int")).alias(f"_has_{cls}")
            for cls, _, words in KEYWORD_CLASSES]
    flags = messages.select(conv).distinct().join(low.groupBy(conv).agg(*aggs), conv, "left")
    span = _spanning_flags(low, conv, order)
    if span is not None:
        flags = flags.join(span, conv, "left")

    def hit(cls):
        c = F.coalesce(F.col(f"_has_{cls}"), F.lit(0)) == 1
        if f"_span_{cls}" in flags.columns:
            c = c | (F.coalesce(F.col(f"_span_{cls}"), F.lit(0)) == 1)
        return c
    mtype = F.when(hit(KEYWORD_CLASSES[0][0]), F.lit(KEYWORD_CLASSES[0][0]))
    imp = F.when(hit(KEYWORD_CLASSES[0][0]), F.lit(KEYWORD_CLASSES[0][1]))
    for cls, rank, _ in KEYWORD_CLASSES[1:]:
        mtype = mtype.when(hit(cls), F.lit(cls))
        imp = imp.when(hit(cls), F.lit(rank))
    return flags.select(conv, mtype.otherwise(F.lit(DEFAULT_CLASS[0])).alias("memory_type"),
                        imp.otherwise(F.lit(DEFAULT_CLASS[1])).alias("importance"))


def conversation_stats(messages: DataFrame, conv: str = "conv_id", order: str = "turn",
                       text: str = "text", with_text: bool = True) -> DataFrame:
    """AG11: message count, total characters and (optionally) the lowered text joined by a space."""
    stats = messages.groupBy(conv).agg(F.count(F.lit(1)).alias("message_count"),
                                       F.sum(F.length(text)).cast("bigint").alias("conversation_length"))
    if not with_text:
        return stats
    from .summaries import TEXT_BLOCK_ROWS, ordered_join
    low = messages.select(conv, order, F.lower(F.col(text)).alias("_t"))
    joined = ordered_join(low, [conv], order, "_t", " ", block=TEXT_BLOCK_ROWS)
    return stats.join(joined.withColumnRenamed("text", "content_lower"), conv, "inner")


def store_conversation(messages: DataFrame, as_of=None, conv: str = "conv_id", order: str = "turn",
                       text: str = "text") -> DataFrame:
    """CMP6: one experience row per conversation (classification, observation, outcome map, tags)."""
    from ..functions.timefn import as_of_lit
    stats = messages.groupBy(conv).agg(
        F.count(F.lit(1)).alias("message_count"),
        F.sum(F.length(text)).cast("bigint").alias("conversation_length"),
        F.min_by(F.col(text), F.col(order)).alias("_first"))
    cls = classify(messages, conv, order, text)
    now = as_of_lit(as_of)
    return stats.join(cls, conv, "inner").select(
        F.col(conv).alias("thread_id"),
        F.concat(F.lit(OBSERVATION_PREFIX), F.substring("_first", 1, OBSERVATION_CHARS)).alias("observation"),
        F.lit(STORE_REASONING).alias("reasoning"), F.lit(STORE_ACTION).alias("action"),
        F.create_map(F.lit("message_count"), F.col("message_count").cast("string"),
                     F.lit("conversation_length"), F.col("conversation_length").cast("string"),
                     F.lit("status"), F.lit("success"),
                     F.lit("session_id"), F.col(conv).cast("string")).alias("outcome"),
        "importance", "memory_type", now.alias("created_at"), now.alias("last_accessed"),
        F.lit(1).alias("access_count"), F.array(*[F.lit(t) for t in STORE_TAGS]).alias("tags"),
        "message_count", "conversation_length")
