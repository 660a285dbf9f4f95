"""Document quality by Bradley-Terry pairwise ranking.

Every labelled good document is preferred to labelled bad ones. A pair's
probability is the logistic function of the difference of two document scores,
each linear in features of the text, so the weights are a logistic regression on
feature differences without intercept. Newton rounds sum the gradient and
curvature of all pairs inside tasks; only one vector and matrix passes the
driver. The decision is a quantile of the training scores: the one at which the
labels part best, mapped to ``CUT`` of the final score.

Features are sums over segments of the text (a segment ends at the first
separator after ``SEGMENT_BYTES``; repeats are looked for inside segments), so a
text of any length is read whole in bounded memory.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_side, text_or_empty
from .rolling import Substrings

SEGMENT_BYTES = 500_000
BUFFER_BYTES = 1_000_000
BLOCK_WORDS = 64
# pairs per document of the more frequent class
PAIRS = 4
# rows of the rarer class are copied so that none meets more partners than this in one group
PARTNERS = 256
RIDGE = 1e-3
MAX_ROUNDS = 50
TOLERANCE = 1e-7
CUT = 0.7
QUANTILES = 1000
LABEL_SALTS = 16

_U = np.uint64
_WS = np.zeros(256, dtype=bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, dtype=bool)
_LOWER[97:123] = True
_MARKS = [b for b in range(33, 127) if not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123)]

# sums over a text: bytes per value, then these
_SUMS = ["words", "word_bytes", "lag1", "lag2", "lag3", "blocks_distinct", "shouted", "lines", "same_lines", "long_words"]
N_SUMS = 256 + len(_SUMS)


def _sums(data: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """(n, N_SUMS) counts of the segments that make up ``data``; a separator ends each."""
    out = np.zeros((n, N_SUMS))
    out[:, :256] = np.bincount(doc * 256 + data, minlength=n * 256).reshape(n, 256)
    hashes = Substrings(data)
    ws = _WS[data]
    edge = np.diff(np.concatenate([[1], ws.astype(np.int8), [1]]))
    start, end = np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0]
    add = lambda name, of, w=None: np.add.at(out[:, 256 + _SUMS.index(name)], of, 1.0 if w is None else w)
    if len(start):
        of, h, size = doc[start], hashes.hash(start, end), end - start
        count = lambda name, w: out[:, 256 + _SUMS.index(name)].__iadd__(np.bincount(of, w, n))
        count("words", np.ones(len(of)))
        count("word_bytes", size.astype(float))
        count("long_words", (size > 30).astype(float))
        for lag in (1, 2, 3):
            same = np.zeros(len(of))
            same[lag:] = (h[lag:] == h[:-lag]) & (of[lag:] == of[:-lag])
            count(f"lag{lag}", same)
        first = np.searchsorted(of, of)
        block = (np.arange(len(of)) - first) // BLOCK_WORDS
        group = of.astype(np.int64) * (len(of) // BLOCK_WORDS + 1) + block
        order = np.lexsort((h, group))
        g, hh = group[order], h[order]
        fresh = np.ones(len(order), dtype=bool)
        fresh[1:] = (g[1:] != g[:-1]) | (hh[1:] != hh[:-1])
        count("blocks_distinct", np.bincount(order, fresh, len(order)))
        case = np.concatenate([[0], np.cumsum(_UPPER[data])]), np.concatenate([[0], np.cumsum(_LOWER[data])])
        up, low = (c[end] - c[start] for c in case)
        count("shouted", ((up > 1) & (low == 0)).astype(float))
    stop = np.nonzero(data == 10)[0]
    if len(stop):
        begin = np.concatenate([[0], stop[:-1] + 1])
        inside = doc[begin] == doc[stop]
        begin = np.where(inside, begin, np.searchsorted(doc, doc[stop]))
        of, h = doc[stop], hashes.hash(begin, stop)
        add("lines", of)
        same = np.zeros(len(of))
        same[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
        add("same_lines", of, same)
    return out


def _segments(raw: bytes, limit: int):
    at = 0
    while len(raw) - at > limit:
        end = at + limit
        while end < len(raw) and not _WS[raw[end]]:
            end += 1
        yield raw[at:end]
        at = end + 1
    yield raw[at:]


def features(sums: np.ndarray) -> np.ndarray:
    """Feature rows of the summed counts; all zero for a text without words."""
    hist, extra = sums[:, :256], dict(zip(_SUMS, sums[:, 256:].T))
    size = np.maximum(hist.sum(axis=1), 1)
    words = np.maximum(extra["words"], 1)
    share = lambda v, of: np.sqrt(v / of)
    upper, lower = hist[:, 65:91].sum(axis=1), hist[:, 97:123].sum(axis=1)
    marks = hist[:, _MARKS]
    cols = [share(marks[:, i], size) for i in range(len(_MARKS))]
    cols += [share(hist[:, 48:58].sum(axis=1), size), share(upper, size), share(lower, size),
             share(hist[:, 128:].sum(axis=1), size), share(hist[:, 10], size), share(hist[:, 9], size),
             share(hist[:, :32].sum(axis=1), size), share(marks.sum(axis=1), size),
             np.log1p(extra["words"]), np.minimum(extra["words"], 20) / 20, np.log1p(extra["word_bytes"] / words),
             share(extra["lag1"], words), share(extra["lag2"], words), share(extra["lag3"], words),
             np.minimum((extra["lag1"] + extra["lag2"] + extra["lag3"]) / words, 0.1) * 10,
             1 - extra["blocks_distinct"] / words, share(extra["shouted"], words),
             np.minimum(extra["shouted"] / words, 0.1) * 10, share(extra["long_words"], words),
             share(extra["same_lines"], np.maximum(extra["lines"], 1)), np.log1p(words / (extra["lines"] + 1)),
             np.minimum(marks.sum(axis=1) / words, 1.0)]
    return np.stack(cols, axis=1) * (extra["words"] > 0)[:, None]


N_FEATURES = features(np.zeros((1, N_SUMS))).shape[1]


def _extract(segment_bytes: int, buffer_bytes: int):
    """(…, text) rows to (…, f): the features of every whole text."""
    def flush(held):
        sums = np.zeros((held[-1][0] + 1, N_SUMS))
        for at in _packed(held, buffer_bytes):
            parts = [p for _, p in at]
            data = np.frombuffer(b"\n".join(parts) + b"\n", dtype=np.uint8)
            lens = np.array([len(p) + 1 for p in parts])
            seg = np.repeat(np.arange(len(parts)), lens)
            rows = _sums(data, seg, len(parts))
            rows[:, 10] -= 1      # the newline put behind the segment
            np.add.at(sums, [k for k, _ in at], rows)
        return features(sums)

    def _packed(held, limit):
        part, size = [], 0
        for k, raw in held:
            for s in _segments(raw, segment_bytes):
                part.append((k, s))
                size += len(s)
                if size >= limit:
                    yield part
                    part, size = [], 0
        if part:
            yield part

    def run(batches):
        for b in batches:
            texts = b.column("text")
            keep = [n for n in b.schema.names if n != "text"]
            at = 0
            while at < b.num_rows:
                held, size = [], 0
                while at + len(held) < b.num_rows and size < buffer_bytes:
                    raw = texts[at + len(held)].as_py().encode()
                    held.append((len(held), raw))
                    size += len(raw)
                f = flush(held).astype(np.float32)
                part = b.slice(at, len(held))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(f) + 1, dtype=np.int32) * f.shape[1]),
                                                pa.array(f.ravel()))
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in keep], flat], [*keep, "f"])
                at += len(held)
    return run


def held_out(doc_id: Column) -> Column:
    """True for documents whose labels are not learnt from (a null id hashes the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def text_features(documents: DataFrame) -> DataFrame:
    """(doc_id, held_out, f) of every document."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"),
                            text_or_empty("text").alias("text"))
    return rows.mapInArrow(_extract(SEGMENT_BYTES, BUFFER_BYTES), "doc_id long, held_out boolean, f array<float>")


def preferences(labelled: DataFrame) -> DataFrame:
    """(d): features of a good document less those of a bad one, for every preference pair.

    ``labelled`` has doc_id, good, f. Rows of each class are numbered in the order of a
    hash. Each row of the larger class meets ``PAIRS`` rows of the smaller, which
    takes its turns evenly; a row of the smaller class is copied once for every
    ``PARTNERS`` partners.
    """
    n = int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["good", "_h", "f"]
    laid = labelled.withColumn("_h", F.xxhash64("doc_id", "f")).repartitionByRange(n, *order).sortWithinPartitions(*order)
    laid = materialize(laid.select("good", "f", F.monotonically_increasing_id().alias("_row")), "labelled")
    per = laid.groupBy("good", F.shiftright("_row", 33).alias("_range")).agg(
        F.min("_row").alias("_first"), F.count("*").alias("_n"))
    # one row per range and class
    ranges = sorted(per.collect(), key=lambda r: (r["good"], r["_range"]))
    count = {g: sum(r["_n"] for r in ranges if r["good"] is g) for g in (True, False)}
    if not count[True] or not count[False]:
        return None
    offsets, seen = [], {True: 0, False: 0}
    for r in ranges:
        offsets.append((r["good"], r["_range"], seen[r["good"]] - r["_first"]))
        seen[r["good"]] += r["_n"]
    shift = small_side(laid.sparkSession.createDataFrame(offsets, "good boolean, _range long, _shift long"))
    rows = laid.withColumn("_range", F.shiftright("_row", 33)).join(shift, ["good", "_range"]).select(
        "good", "f", (F.col("_row") + F.col("_shift")).alias("pos"))
    more = count[True] >= count[False]
    many, few = max(count.values()), min(count.values())
    copies = -(-PAIRS * many // (few * PARTNERS))
    turn = F.explode(F.sequence(F.lit(0), F.lit(PAIRS - 1)))
    large = rows.where(F.col("good") == more).select("f", "pos", turn.alias("j")).withColumn(
        "t", F.col("pos") * PAIRS + F.col("j")).select(
        F.col("f").alias("f_many"), (F.col("t") % few).alias("partner"),
        F.floor(F.col("t") / few / PARTNERS).cast("int").alias("copy"))
    small = rows.where(F.col("good") != more).select(
        F.col("f").alias("f_few"), F.col("pos").alias("partner"),
        F.explode(F.sequence(F.lit(0), F.lit(copies))).alias("copy"))
    sign = 1.0 if more else -1.0
    pairs = large.join(small, ["partner", "copy"])
    return materialize(pairs.select(F.zip_with(
        "f_many", "f_few", lambda a, b: ((a - b) * F.lit(sign)).cast("float")).alias("d")), "pairs")


def _newton_sums(w: np.ndarray, spread: np.ndarray):
    """(i, v): gradient, curvature, loss and number of the pairs of a task, one after another in i."""
    def run(batches):
        n = len(w)
        g, h, loss, count = np.zeros(n), np.zeros((n, n)), 0.0, 0
        for b in batches:
            d = b.column("d").flatten().to_numpy(zero_copy_only=False).reshape(-1, n) / spread
            z = d @ w
            p = 1.0 / (1.0 + np.exp(np.clip(z, -500, 500)))     # probability of the wrong order
            g += d.T @ p
            h += (d * (p * (1 - p))[:, None]).T @ d
            loss += float(np.logaddexp(0.0, -z).sum())
            count += len(d)
        flat = np.concatenate([g, h.ravel(), [loss, count]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["i", "v"])
    return run


def _summed(df: DataFrame) -> np.ndarray:
    got = {r["i"]: r["v"] for r in df.groupBy("i").agg(F.sum("v").alias("v")).collect()}
    return np.array([got[i] for i in range(len(got))])


def _moments(batches):
    s, n = np.zeros(N_FEATURES), 0
    for b in batches:
        d = b.column("d").flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES).astype(float)
        s += (d * d).sum(axis=0)
        n += len(d)
    flat = np.concatenate([s, [n]])
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["i", "v"])


def fit(pairs: DataFrame) -> np.ndarray:
    """Weights of the features that make the preferred documents score higher."""
    total = _summed(pairs.mapInArrow(_moments, "i int, v double"))
    spread = np.sqrt(total[:-1] / total[-1])
    spread[spread < 1e-9] = 1.0
    n = N_FEATURES
    w, best, step = np.zeros(n), np.inf, np.zeros(n)
    for _ in range(MAX_ROUNDS):
        sums = _summed(pairs.mapInArrow(_newton_sums(w, spread), "i int, v double"))
        ridge = RIDGE * sums[-1]
        loss = (sums[-2] + 0.5 * ridge * (w @ w)) / sums[-1]
        if loss > best:           # a step too far: half of it
            step = step / 2
            w = w - step
            if np.abs(step).max() < TOLERANCE:
                break
            continue
        if best - loss < TOLERANCE:
            break
        best = loss
        grad = sums[:n] - ridge * w
        step = np.linalg.solve(sums[n:n + n * n].reshape(n, n) + ridge * np.eye(n), grad)
        w = w + step
    else:
        raise RuntimeError(f"the ranking weights did not settle in {MAX_ROUNDS} rounds")
    return w / spread


def _raw(w: np.ndarray) -> Column:
    """Document score: features times weights."""
    weights = F.array(*[F.lit(float(x)) for x in w])
    return F.aggregate(F.zip_with("f", weights, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)


def threshold(scored: DataFrame) -> float:
    """The score quantile of the labelled rows (good, raw) that parts the labels best, between its neighbours."""
    probs = F.array(*[F.lit(i / QUANTILES) for i in range(QUANTILES + 1)])
    got = {r["good"]: np.array(r["q"]) for r in scored.groupBy("good").agg(
        F.percentile_approx("raw", probs, 100_000).alias("q")).collect()}
    if len(got) < 2:
        return float(next(iter(got.values()))[0 if True in got else -1]) if got else 0.0
    cuts = np.unique(np.concatenate(list(got.values())))
    below = {g: np.searchsorted(q, cuts, side="left") / len(q) for g, q in got.items()}
    gain = below[False] - below[True]
    # equally good cuts in a row: the middle of the gap
    top = np.nonzero(gain >= gain.max() - 1e-12)[0]
    at = int(top[-1])
    low = cuts[at - 1] if at else cuts[at]
    return float((low + cuts[at]) / 2)


def quality_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """score (0 to 1) and predicted label of every document, learnt from ``labels`` of the documents not held out.

    Returns doc_id, held_out, score, predicted. A null text is empty and, like
    any text without words, scores as the zero feature vector; texts of any
    length are read whole; repeated and null ids are scored row by row, a null id
    has no label; labels that are null are ignored, an id labelled twice counts
    twice; without labels of both classes every score is 1, the decision having
    nothing to go by; an empty table gives an empty result; other columns,
    labels.toxic, lang and source among them, are not read.
    """
    feats = materialize(text_features(documents), "features")
    known = labels.where("doc_id is not null and quality is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good"),
        F.explode(F.sequence(F.lit(0), F.lit(LABEL_SALTS - 1))).alias("_salt"))
    salted = feats.where("not held_out").withColumn(
        "_salt", (F.monotonically_increasing_id() % LABEL_SALTS).cast("int"))
    # the planner sees the files of the labels, not their copies: without the hint it broadcasts tables of any length
    train = materialize(salted.join(known.hint("merge"), ["doc_id", "_salt"]).select("doc_id", "good", "f"), "train")
    pairs = preferences(train)
    if pairs is None:
        score = F.lit(1.0)
    else:
        w = fit(pairs)
        at = threshold(train.select("good", _raw(w).alias("raw")))
        # the cut is CUT of the score; far scores keep their order
        z = F.least(F.greatest(_raw(w) - F.lit(at), F.lit(-30.0)), F.lit(30.0)) + F.lit(float(np.log(CUT / (1 - CUT))))
        score = F.round(1.0 / (1.0 + F.exp(-z)), 12)
    return feats.select("doc_id", "held_out", score.alias("score")).withColumn(
        "predicted", F.when(F.col("score") >= CUT, 1).otherwise(0))
