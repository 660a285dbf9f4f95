"""URL filter: given rules first, then association rules mined from labelled pages (native columns only).

Labelled URLs become transactions of tokens (scheme, domain suffixes, path
directories, file ending, query keys). Tokens that too few bad pages hold can be
in no rule and go first; tokens that occur in exactly the same labelled pages
are one item, since any rule holds for one of them as for the others. Spark's
FP-growth finds the item combinations of any length that reach the support
among the bad pages; how many pages in all hold them is counted through an
inverted index, and those that predict a bad page are kept if confidence and lift
reach the limits. Long ones that add no confidence to a part of theirs decide
nothing and are dropped. To match, each rule is filed in an inverted index under
its rarest item; the distinct token sets of all URLs probe the index by their
items and the found rules are verified whole.
"""
from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

# so many bad pages: where each page is bad with 0.8 at most, 20 in a row come about with 1 %
MIN_SUPPORT_ROWS = 20
MIN_CONFIDENCE = 0.8
MIN_LIFT = 1.5
# rules with more tokens are dropped if they add no confidence
SHORT_RULE = 3

# groups over which the rows that share a token, or all tokens, are dealt
SALTS = 16

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """Host after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """Path after the host up to ``?``, ``#`` or the end; empty if there is none."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """Struct (rule, action) of the longest rule ``(action, "host/path")`` that fits, else null."""
    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[1], r[0]))
    out = F.lit(None).cast("struct<rule:string,action:string>")
    for action, rule in reversed(ordered):
        rh, _, rp = rule.partition("/")
        fits = ((host == rh) | F.endswith(host, F.lit("." + rh))) & F.startswith(path, F.lit("/" + rp))
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(action).alias("action"))).otherwise(out)
    return out


def url_tokens(url: Column) -> Column:
    """Sorted distinct tokens of a URL; digits inside path names are written as 0. Null: empty array."""
    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.concat(F.lit("host:"), F.array_join(
                               F.slice(labels, i, F.size(labels)), ".")))
    names = F.filter(F.split(F.regexp_replace(path, "[0-9]+", "0"), "/"), lambda x: x != "")
    dirs = F.transform(names, lambda x: F.concat(F.lit("dir:"), F.regexp_replace(x, r"\..*$", "")))
    ending = F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1)
    keys = F.regexp_extract_all(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), F.lit(r"(?:^|&)([^=&]+)"), F.lit(1))
    scheme = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    none = F.array().cast("array<string>")
    tokens = F.concat(
        F.when(scheme != "", F.array(F.concat(F.lit("scheme:"), F.lower(scheme)))).otherwise(none),
        F.when(host != "", suffixes).otherwise(none), dirs,
        F.when(ending != "", F.array(F.concat(F.lit("ending:"), F.lower(ending)))).otherwise(none),
        F.transform(keys, lambda k: F.concat(F.lit("key:"), k)))
    return F.when(url.isNull(), none).otherwise(F.sort_array(F.array_distinct(tokens)))


def _best_part(sets: DataFrame) -> DataFrame:
    """(tokens, part): the highest confidence of a rule that is a proper part of each long frequent set.

    ``sets`` (tokens, rule confidence or null) holds every part of its sets, so
    one pass per length over the parts with one token less is enough.
    """
    longest = sets.agg(F.max(F.size("tokens"))).first()[0]
    best = sets.where("size(tokens) = 1").select("tokens", F.col("confidence").alias("best"))
    out = None
    for n in range(2, longest + 1):
        parts = sets.where(F.size("tokens") == n).select(
            "tokens", "confidence", F.explode("tokens").alias("_x")).select(
            F.col("tokens").alias("whole"), "confidence", F.array_remove("tokens", F.col("_x")).alias("tokens"))
        level = materialize(parts.join(best, "tokens").groupBy("whole").agg(
            F.max("best").alias("part"), F.max("confidence").alias("confidence")), "parts")
        best = level.select(F.col("whole").alias("tokens"), F.greatest("part", "confidence").alias("best"))
        if n > SHORT_RULE:
            level = level.select(F.col("whole").alias("tokens"), "part")
            out = level if out is None else out.unionByName(level)
    return out


def _salted(small: DataFrame) -> DataFrame:
    """A row for every salt, to meet rows of a hot key that are dealt by :func:`_salt`."""
    return small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))


def _salt(*cols: str) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(SALTS))


def token_classes(rows: DataFrame, least_bad: int) -> DataFrame:
    """(token, item): the tokens that ``least_bad`` bad rows hold, named by the smallest token of the same rows.

    ``rows`` is a table of (row, tokens, bad). Two 64-bit exclusive-ors of row hashes, and the
    number of rows, tell sets of rows apart.
    """
    each = rows.select("row", "bad", F.explode("tokens").alias("token"))
    sets = each.groupBy("token").agg(
        F.count_if("bad").alias("_bad"), F.count(F.lit(1)).alias("_n"), F.bit_xor(F.xxhash64(F.lit(1), "row")).alias("_a"),
        F.bit_xor(F.xxhash64(F.lit(2), "row")).alias("_b")).where(F.col("_bad") >= least_bad)
    same = ["_n", "_a", "_b"]
    named = sets.groupBy(*same).agg(F.min("token").alias("item"))
    return materialize(sets.join(named, same).select("token", "item"), "classes")


def _items(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """(tokens, items) of distinct token sets that hold an item, items sorted."""
    each = sets.select("tokens", F.explode("tokens").alias("token")).withColumn("_salt", _salt("tokens"))
    return each.join(_salted(classes), ["token", "_salt"]).groupBy("tokens").agg(
        F.sort_array(F.collect_set("item")).alias("items"))


def _held(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(items, rule): the rules that item sets hold whole, found under each rule's rarest item (ties: the smaller one)."""
    probes = sets.select("items", F.explode("items").alias("item")).withColumn("_salt", _salt("items"))
    freq = probes.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    index = rules.select(F.col("items").alias("rule"), F.explode("items").alias("item")).join(freq, "item", "left").groupBy(
        "rule").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "item"))["item"].alias("item"))
    hits = probes.join(_salted(index), ["item", "_salt"])
    return hits.where(F.size(F.array_except("rule", "items")) == 0).select("items", "rule")


def _mine(labelled: DataFrame, min_support: float | None, min_rows: int, min_confidence: float,
          min_lift: float) -> tuple[DataFrame, DataFrame]:
    """(rules, classes) of :func:`mine_rules`."""
    spark = labelled.sparkSession
    rows = materialize(labelled.where("bad is not null and size(tokens) > 0").select(
        F.monotonically_increasing_id().alias("row"), F.array_distinct("tokens").alias("tokens"), "bad"), "labelled")
    n, n_bad = rows.agg(F.count(F.lit(1)), F.count_if("bad")).first()
    least = min_rows if min_support is None else max(1, math.ceil(min_support * n - 1e-9))
    none = spark.createDataFrame([], "tokens array<string>, confidence double, support_rows long")
    if n_bad < least:
        return none, spark.createDataFrame([], "token string, item string")
    classes = token_classes(rows, least)
    counted = rows.groupBy("tokens").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("n_bad"))
    # equal item sets of all rows, with their numbers of rows
    sets = materialize(_items(counted, classes).join(counted, "tokens").groupBy("items").agg(
        F.sum("n").alias("n"), F.sum("n_bad").alias("n_bad")), "itemsets")
    bad = sets.where("n_bad > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "n_bad"))).select("items")
    total = sets.agg(F.sum("n_bad")).first()[0] or 0
    if total < least:
        return none, classes
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # half a row less: the product with the number of rows is rounded up
    found = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / total, numPartitions=parts).fit(bad).freqItemsets
    found = materialize(found.select(F.sort_array("items").alias("items"), F.col("freq").cast("long").alias("hit")), "frequent")
    every = _held(sets.select("items"), found.select("items")).join(sets.select("items", "n"), "items").groupBy(
        F.col("rule").alias("items")).agg(F.sum("n").alias("all"))
    conf = F.col("hit") / F.col("all")
    is_rule = (conf >= min_confidence) & (conf >= min_lift * n_bad / n)
    both = materialize(found.join(every, "items").select(
        F.col("items").alias("tokens"), F.when(is_rule, conf).alias("confidence"), F.col("hit").alias("support_rows")),
        "measured")
    rules = both.where("confidence is not null")
    if rules.where(F.size("tokens") > SHORT_RULE).limit(1).count():
        rules = rules.join(_best_part(both.select("tokens", "confidence")), "tokens", "left").where(
            "part is null or part < confidence")
    return rules.select("tokens", "confidence", "support_rows"), classes


def mine_rules(labelled: DataFrame, min_support: float | None = None, min_rows: int = MIN_SUPPORT_ROWS,
               min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT) -> DataFrame:
    """Rules (tokens, confidence, support_rows) that predict a bad page, from rows (tokens, bad).

    A rule holds on ``min_rows`` bad rows at least, however many rows there are;
    ``min_support``, a share of all rows, replaces that count if given. A token
    of a rule stands for all tokens that occur in the same rows (see
    :func:`token_classes`), of which it is the smallest. Rules of more than
    ``SHORT_RULE`` tokens whose confidence a part of theirs reaches are left out.
    Rows without tokens or with a null label are left out. No labelled row or no
    bad row: no rules.
    """
    return _mine(labelled, min_support, min_rows, min_confidence, min_lift)[0]


def match_rules(token_sets: DataFrame, rules: DataFrame, classes: DataFrame) -> DataFrame:
    """(tokens, n_rules, confidence) of the distinct token sets that at least one rule fits."""
    named = materialize(_items(token_sets, classes), "items")
    hits = _held(named.select("items").distinct(), rules.select(F.col("tokens").alias("items")))
    best = hits.join(rules.select(F.col("tokens").alias("rule"), "confidence"), "rule").groupBy("items").agg(
        F.count(F.lit(1)).alias("n_rules"), F.max("confidence").alias("confidence"))
    return named.join(best, "items").select("tokens", "n_rules", "confidence")


def url_filter(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str]], **limits) -> DataFrame:
    """Verdict of every page URL: page_id, host, path, rule, verdict, n_mined, confidence.

    ``labelled`` holds (url, bad boolean). The longest fitting rule of ``rules``
    decides; else a page is blocked if a mined rule matches, or allowed. A null
    URL, or one without ``://``, has empty host and path, no fitting rule, and
    is allowed unless a mined rule matches its other tokens. URLs of any length
    are read whole; one row per input row, repeated rows too; an empty table gives
    an empty result; other columns of ``pages`` are not read.
    """
    given = {"min_support": None, "min_rows": MIN_SUPPORT_ROWS, "min_confidence": MIN_CONFIDENCE, "min_lift": MIN_LIFT}
    mined, classes = _mine(labelled.select(url_tokens(F.col("url")).alias("tokens"), "bad"), **{**given, **limits})
    mined = materialize(mined, "rules")
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
                        url_tokens(F.col("url")).alias("tokens"))
    rows = rows.withColumn("_fit", fitting_rule(F.col("host"), F.col("path"), rules))
    matched = match_rules(rows.select("tokens").distinct(), mined, classes)
    # equal token sets of many pages are dealt over groups
    out = rows.withColumn("_salt", _salt("page_id", "host", "path")).join(_salted(matched), ["tokens", "_salt"], "left")
    verdict = F.coalesce(F.col("_fit.action"),
                         F.when(F.col("n_rules") > 0, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("_fit.rule").alias("rule"), verdict.alias("verdict"),
                      F.coalesce("n_rules", F.lit(0)).cast("long").alias("n_mined"), "confidence")
