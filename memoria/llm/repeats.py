"""Exact repeated passages by a depth-limited radix sort of suffixes.

Suffixes are ordered only through their first ``window`` (100) bytes, digit by
digit, and a suffix that is alone in its group after a digit is dropped; the
groups left after the last digit are exactly the repeated windows.

* Digit 1 is a 32-byte gram. Every window start is filed under the gram that
  is smallest by hash among those inside its window (the leftmost of equals),
  so equal windows have the same gram at the same place, neighbouring starts
  share it, and one record (a run of starts) stands for about 35 suffixes. A
  gram that occurs once ends the order of its whole run.
* Digit 2 is the text of the run: equal runs repeat each other window by
  window, so all but the earliest are settled at once.
* Digits 3 and 4 do the same for the parts of a run whose windows lie within
  eight bytes of each other, for runs whose gram occurs in different
  surroundings: first the bytes that all windows of the part share, then its
  whole text.
* The last digit is the window itself, for the parts at the very edge of a
  repeated passage.

Digits are compared by 64-bit hashes of the bytes, the last by 128 bits. Equal
texts are recognised before and take part once, by their smallest id.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialize, text_or_empty
from .rolling import Substrings, buffers, mix

WINDOW = 100
GRAM = 32
PART = 8

_U = np.uint64
_LOW = _U(0xFFFFFFFF)
NULL_ID = -(2 ** 63)
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def runs(raws: list[bytes], window: int = WINDOW, gram: int = GRAM):
    """Runs of window starts that share a gram: (text number, start, starts, gram hash, run hash, place of the gram)."""
    data = np.frombuffer(b"".join(raws), dtype=np.uint8)
    lens = np.fromiter(map(len, raws), np.int64, len(raws))
    first = np.cumsum(lens) - lens
    none = np.zeros(0, dtype=np.int64)
    if len(data) < window:
        return none, none, none, none, none, none
    sub = Substrings(data)
    at = np.arange(len(data) - gram + 1)
    h = sub.hash(at, at + gram)
    # the smallest gram of every window: hash above, place below, by doubling
    key = (h & ~_LOW) | at.astype(np.uint64)
    grams = window - gram + 1
    reach = 1
    low = key
    while reach * 2 <= grams:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < grams:
        low = np.minimum(low[:len(low) - (grams - reach)], low[grams - reach:])
    anchor = (low & _LOW).astype(np.int64)
    # starts whose window stays inside its text
    doc = np.repeat(np.arange(len(raws)), np.maximum(lens - window + 1, 0))
    inside = np.arange(len(doc)) - np.repeat(np.cumsum(np.maximum(lens - window + 1, 0))
                                             - np.maximum(lens - window + 1, 0),
                                             np.maximum(lens - window + 1, 0)) + first[doc]
    anchor = anchor[inside]
    new = np.ones(len(inside), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1] + 1)
    cut = np.flatnonzero(new)
    n = np.diff(np.append(cut, len(inside)))
    start = inside[cut]
    run = sub.hash(start, start + n + window - 1)
    # the place of the gram in the run is part of the run
    run = mix(run ^ (anchor[cut] - start).astype(np.uint64))
    return doc[cut], start - first[doc[cut]], n, h[anchor[cut]], run, anchor[cut] - start


def _emit_runs(window: int, gram: int):
    def run(batches):
        def rows():
            for b in batches:
                for t, n, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                    yield (t, n), text.as_py().encode()

        for held in buffers(rows(), 2_000_000):
            # equal texts of a buffer give equal runs: once is enough
            once = dict(held)
            keys = list(once)
            doc, start, n, g, r, shift = runs(list(once.values()), window, gram)
            text, size = (np.array([k[i] for k in keys], dtype=np.int64)[doc] for i in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(g.astype(np.int64)), pa.array(r.astype(np.int64)), pa.array(text),
                 pa.array(size.astype(np.int32)), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int16)),
                 pa.array(shift.astype(np.int16))],
                ["gram", "run", "text_hash", "n_bytes", "start", "n", "shift"])
    return run


RUN_SCHEMA = "gram long, run long, text_hash long, n_bytes int, start int, n short, shift short"


def _emit_parts(window: int):
    """Runs (start, n, shift) to their parts: windows whose distance to the gram falls into one class of PART."""
    def run(batches):
        for b in batches:
            out = [[], [], [], [], []]
            for i in range(b.num_rows):
                raw = np.frombuffer(b.column("text")[i].as_py().encode(), dtype=np.uint8)
                spans = b.column("spans")[i].values
                start, n, shift = (spans.field(j).to_numpy().astype(np.int64) for j in range(3))
                anchor = start + shift
                low, high = (shift - n + 1) // PART, shift // PART
                times = high - low + 1
                c = np.repeat(low - (np.cumsum(times) - times), times) + np.arange(times.sum())
                anchor, s0, e0 = (np.repeat(x, times) for x in (anchor, start, start + n - 1))
                first = np.maximum(s0, anchor - PART * c - (PART - 1))
                last = np.minimum(e0, anchor - PART * c)
                sub = Substrings(raw, 2)
                core = sub.hash(anchor - PART * c, anchor - PART * c + window - (PART - 1))
                core = mix(core ^ c.astype(np.uint64))
                whole = mix(sub.hash(first, last + window) ^ (anchor - first).astype(np.uint64))
                for col, v in zip(out, (core, whole, np.full(len(c), i), first, last - first + 1)):
                    col.append(v)
            if not b.num_rows:
                continue
            core, whole, row, first, n = (np.concatenate(x) for x in out)
            row = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(core.astype(np.int64)), pa.array(whole.astype(np.int64)), b.column("id").take(row),
                 b.column("text_hash").take(row), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int16))],
                ["gram", "run", "id", "text_hash", "start", "n"])
    return run


def _emit_windows(window: int):
    def run(batches):
        for b in batches:
            out = [[], [], [], []]
            for i in range(b.num_rows):
                raw = np.frombuffer(b.column("text")[i].as_py().encode(), dtype=np.uint8)
                spans = b.column("spans")[i].values
                start, n = (spans.field(j).to_numpy() for j in (0, 1))
                p = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
                p = np.unique(p).astype(np.int64)
                out[0].append(Substrings(raw, 2).hash(p, p + window))
                out[1].append(Substrings(raw, 3).hash(p, p + window))
                out[2].append(np.full(len(p), i))
                out[3].append(p)
            if not b.num_rows:
                continue
            h1, h2, row, p = (np.concatenate(x) for x in out)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h1.astype(np.int64)), pa.array(h2.astype(np.int64)),
                 b.column("id").take(pa.array(row)), b.column("text_hash").take(pa.array(row)),
                 pa.array(p.astype(np.int32))], ["h1", "h2", "id", "text_hash", "start"])
    return run


def _merge(starts, ends):
    """Maximal runs of the union of half-open spans."""
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(s), dtype=bool)
    new[1:] = s[1:] > e[:-1]
    cut = np.flatnonzero(new)
    return s[cut], e[np.append(cut[1:], len(s)) - 1]


def _finish(batches):
    """Rows (doc_id or _row, text, copy, spans) to their results; spans are half-open byte ranges.

    With ``_row`` the remaining text goes along; the bytes of a character that
    was cut in two are dropped from it.
    """
    for b in batches:
        out = [[], [], [], [], []]
        for text, copy, spans in zip(b.column("text"), b.column("copy").to_pylist(), b.column("spans")):
            raw = (text.as_py() or "").encode()
            if copy:
                parts = [(0, len(raw))]
            elif spans.is_valid and len(spans):
                s, e = _merge(*(spans.values.field(j).to_numpy() for j in (0, 1)))
                parts = list(zip(s.tolist(), e.tolist()))
            else:
                parts = []
            kept, at = [], 0
            for s, e in parts:
                kept.append(raw[at:s])
                at = e
            kept = b"".join([*kept, raw[at:]])
            for col, v in zip(out, (len(raw), len(raw) - len(kept), len(parts), hashlib.sha256(kept).hexdigest(),
                                    kept.decode("utf-8", "ignore"))):
                col.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        names = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
        arrays = [pa.array(c, k) for c, k in zip(out, kinds)]
        if "_row" in b.schema.names:
            yield pa.RecordBatch.from_arrays([b.column("_row"), arrays[1], arrays[4]], ["_row", "n_removed", "kept"])
        else:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *arrays[:4]], ["doc_id", *names[:4]])


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with id (null: the smallest), text (null: empty), text_hash and n_bytes."""
    t = text_or_empty("text")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), t.alias("text"),
                       F.xxhash64(t).alias("text_hash"), F.octet_length(t).cast("int").alias("n_bytes"))


def _settle(records: DataFrame, window: int, more: list[str]) -> tuple[DataFrame, DataFrame]:
    """Spans of records that repeat an earlier equal one, and the earliest ones whose group holds different ones.

    ``records`` has gram (the digit so far), run (the whole record), id, text_hash, start, n.
    """
    place = F.struct("id", "text_hash", "start")
    first = [F.first(c).alias(c) for c in ("n", *more)]
    groups = materialize(records.groupBy("gram", "run").agg(F.min(place).alias("p"), F.max(place).alias("q"), *first),
                         "groups")
    shared = groups.where("p != q").select("gram", "run", "p")
    again = records.join(shared, ["gram", "run"]).where(place != F.col("p"))
    settled = materialize(again.select("id", "text_hash", "start",
                                       (F.col("start") + F.col("n") + (window - 1)).alias("end")), "settled")
    mixed = groups.groupBy("gram").agg(F.min("run").alias("_a"), F.max("run").alias("_b")).where("_a != _b")
    edge = groups.join(mixed.select("gram"), "gram").select("p.id", "p.text_hash", "p.start", "n", *more)
    return settled, edge


def _with_text(edge: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """(id, text_hash, text, spans): the open records of every text beside it."""
    per = materialize(edge.groupBy("id", "text_hash").agg(F.collect_list(F.struct(*columns)).alias("spans")), "edges")
    return per.join(rows.select("id", "text_hash", "text"), ["id", "text_hash"]).select(
        "id", "text_hash", "text", "spans")


def removed_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(id, text_hash, copy, spans): what to remove of every document that repeats anything.

    ``copy`` marks documents whose whole text stands in a document of smaller
    id; ``spans`` are the byte ranges of the others, possibly overlapping.
    """
    rows = _keyed(docs)
    long_rows = rows.where(F.col("n_bytes") >= window)
    known = materialize(long_rows.select("id", "text_hash", "n_bytes"), "texts")
    firsts = materialize(known.groupBy("text_hash", "n_bytes").agg(F.min("id").alias("id")), "firsts")

    # digit 1
    records = materialize(long_rows.select("text_hash", "n_bytes", "text").mapInArrow(
        _emit_runs(window, gram), RUN_SCHEMA), "runs")
    twice = records.groupBy("gram").agg(
        F.min("text_hash").alias("t0"), F.max("text_hash").alias("t1"), F.min("start").alias("s0"),
        F.max("start").alias("s1")).where("t0 != t1 or s0 != s1").select("gram")
    twice = materialize(twice, "grams")
    # dealt anew by the whole record: a frequent gram does not stay in one task
    one = ["gram", "text_hash", "n_bytes", "start"]
    cand = records.join(twice, "gram").repartition(*one).dropDuplicates(one)
    cand = materialize(cand.join(firsts, ["text_hash", "n_bytes"]).drop("n_bytes"), "suffixes")
    discard(records)
    discard(twice)

    # digit 2, and the runs that it leaves open
    settled, edge = _settle(cand, window, ["shift"])
    parts = materialize(_with_text(edge, rows, ["start", "n", "shift"]).mapInArrow(
        _emit_parts(window), "gram long, run long, id long, text_hash long, start int, n short"), "parts")
    # digits 3 and 4: parts whose common bytes occur once are dropped, equal parts settled
    once = parts.groupBy("gram").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("gram")
    parts = materialize(parts.join(once, "gram"), "open")
    settled2, edge = _settle(parts, window, [])
    # the last digit
    suffix = materialize(_with_text(edge, rows, ["start", "n"]).mapInArrow(
        _emit_windows(window), "h1 long, h2 long, id long, text_hash long, start int"), "windows")
    place = F.struct("id", "text_hash", "start")
    lead = suffix.groupBy("h1", "h2").agg(F.min(place).alias("p"), F.max(place).alias("q")).where("p != q").select(
        "h1", "h2", "p")
    late = suffix.join(lead, ["h1", "h2"]).where(place != F.col("p"))
    late = late.select("id", "text_hash", "start", (F.col("start") + window).alias("end"))
    spans = settled.unionByName(settled2).unionByName(late)
    spans = spans.groupBy("id", "text_hash").agg(F.collect_list(F.struct("start", "end")).alias("spans"))

    copies = known.join(firsts.select("text_hash", "n_bytes", F.col("id").alias("_first")),
                        ["text_hash", "n_bytes"]).where("id != _first").select("id", "text_hash").distinct()
    none = F.lit(None).cast("array<struct<start:int,end:int>>")
    out = spans.select("id", "text_hash", F.lit(False).alias("copy"), "spans").unionByName(
        copies.select("id", "text_hash", F.lit(True).alias("copy"), none.alias("spans")))
    return materialize(out, "spans")


def repeated_bytes(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """What is left of every document without the windows that start earlier elsewhere.

    Returns one row per input row: doc_id, n_bytes, n_removed, n_spans,
    kept_sha256. A null text is empty; a null id comes first in order; rows of
    one id and different texts are ordered by the hash of the text; rows that
    repeat both are one document and get the same result each; an empty table
    gives an empty result; other columns are not read.
    """
    spans = removed_spans(docs, window, gram)
    rows = _keyed(docs.select("doc_id", "text")).withColumn(
        "doc_id", F.when(F.col("id") != NULL_ID, F.col("id")))
    joined = rows.join(spans, ["id", "text_hash"], "left").select("doc_id", "text", "copy", "spans")
    return joined.mapInArrow(
        _finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def strip_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``docs`` with the repeated bytes cut from ``text``; ``n_chars``, if there, is counted anew.

    The bytes of a character that was cut in two are dropped. Documents of which
    nothing is left go. Other columns are unchanged.
    """
    spans = removed_spans(docs, window, gram)
    t = text_or_empty("text")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                       F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"),
                       F.xxhash64(t).alias("text_hash"), t.alias("text"))
    joined = rows.join(spans, ["id", "text_hash"], "left").select("_row", "text", "copy", "spans")
    schema = T.StructType([*joined.select("_row").schema.fields, T.StructField("n_removed", T.LongType()),
                           T.StructField("kept", T.StringType())])
    done = joined.mapInArrow(_finish, schema)
    cut = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("_row.text"))
    done = done.withColumn("_text", cut).where("n_removed = 0 or kept != ''")
    cols = []
    for c in docs.columns:
        own = F.col("_row").getField(c)
        if c == "text":
            own = F.col("_text")
        elif c == "n_chars":
            own = F.when(F.col("n_removed") > 0, F.length("_text").cast(docs.schema[c].dataType)).otherwise(own)
        cols.append(own.alias(c))
    return done.select(*cols)
