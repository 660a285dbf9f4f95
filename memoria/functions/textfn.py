"""String expressions."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def summary_or_truncate(summary: Column, content: Column, limit: int = 100, keep: int = 97) -> Column:
    """Given summary, or content cut to ``keep`` characters + '...' when longer than ``limit``.

    An empty given summary counts as missing (it is falsy in the reference).
    """
    cut = F.when(F.length(content) > limit, F.concat(F.substring(content, 1, keep), F.lit("..."))) \
        .otherwise(content)
    return F.when(summary.isNotNull() & (summary != F.lit("")), summary).otherwise(cut)


def preview(text: Column, n: int = 400) -> Column:
    """First ``n`` characters, newlines replaced by spaces, '...' if longer."""
    head = F.translate(F.substring(text, 1, n), "\n", " ")
    return F.when(F.length(text) > n, F.concat(head, F.lit("..."))).otherwise(head)


def contains_any(text: Column, words) -> Column:
    """Plain substring test against a list of words (not word boundaries)."""
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])
