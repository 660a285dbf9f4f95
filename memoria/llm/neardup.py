"""Near-duplicates by weighted MinHash (BagMinHash) over five-word shingles.

A text is the multiset of its shingles. For every shingle, Poisson processes
over the (time, weight) plane are derived from its hash: one for each of the
weight intervals [0,1), [1,2), [2,4), [4,8), ..., of rate proportional to its
length, each point carrying a signature slot and a weight inside the interval,
whose bits halve the interval step by step. A text of weight w sees the points
below w; a slot keeps the identity of its earliest point. Two texts agree in a
slot with probability sum(min) / sum(max), the weighted Jaccard similarity, and
only about slots * log(slots) points are drawn for a text, however long.

Signatures are cut into bands. Equal texts are one node. Members of a band
bucket are compared with one centre, first the member that shares the most
places in buckets with others, later one by hash. A bucket is settled once its
members are in one class. Members of small buckets that are still open are
compared between their classes. Those of larger ones meet on their rarest
shingles: texts of weights v and w reach similarity s only if they share
s / (1 + s) * (v + w) shingles, hence one of the first
w - s / (1 + s) * (v + w) + 1 of either in any common order of all shingles.
Shingles of a single class come first in that order and lead to no pair, then
the others by the number of texts that hold them, so that a text with many
shingles of its own meets none. Every comparison is verified by the exact
multiset overlap, so that no link is taken without it.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_or_empty
from .graph import contract
from .rolling import Substrings, buffers, mix

SHINGLE = 5
BANDS, ROWS = 20, 4
SLOTS = BANDS * ROWS
# overlap: similarity >= NUM / DEN
NUM, DEN = 8, 10
# slots that must agree before two texts are compared; at similarity 0.8, 64 of 80 agree on average
# and fewer than 40 with a probability below 1e-9
MIN_AGREE = 40
CENTRE_ROUNDS = 2
# bytes of text that a worker hashes at once; a longer text is one buffer
BUFFER_BYTES = 1_000_000
# open buckets of at most so many members are compared inside, larger ones on their rarest shingles
SMALL_BUCKET = 16

_U = np.uint64
_WS = np.zeros(256, dtype=bool)
_WS[[9, 10, 11, 12, 13, 32]] = True

NODE_SCHEMA = "doc_id long, node binary, weight long, bands array<long>, slots binary"


def shingle_bags(raws: list[bytes], size: int = SHINGLE):
    """(document number, shingle, times) of all texts, sorted by document and shingle.

    A text of one to ``size`` - 1 words is one shingle; a text without words has none.
    """
    data = np.frombuffer(b" ".join(raws) + b" ", dtype=np.uint8)
    lens = np.fromiter(map(len, raws), np.int64, len(raws)) + 1
    first = np.cumsum(lens) - lens
    space = _WS[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    word = Substrings(data).hash(start, end)
    doc = np.searchsorted(first, start, side="right") - 1
    n = np.bincount(doc, minlength=len(raws))
    at = np.cumsum(n) - n
    h = np.zeros(len(word), dtype=np.uint64)
    # Horner over the next words of the same text, as many as there are up to ``size``
    place = np.arange(len(word)) - at[doc]
    short = n[doc] < size
    for j in range(size):
        here = np.arange(len(word)) + j
        inside = here < (at + n)[doc]
        h = np.where(inside, h * _U(0x9E3779B97F4A7C15) + word[np.minimum(here, len(word) - 1)], h)
    keep = np.where(short, place == 0, place <= n[doc] - size)
    doc, h = doc[keep], mix(h[keep])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    cut = np.flatnonzero(new)
    times = np.diff(np.append(cut, len(h)))
    return doc[cut], h[cut], times


def _unit(h: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from hashes."""
    return ((h >> _U(11)).astype(np.float64) + 0.5) * 2.0 ** -53


def signatures(doc: np.ndarray, shingle: np.ndarray, times: np.ndarray, n_docs: int, slots: int = SLOTS):
    """Identities of the earliest points, (n_docs, slots); zero rows for texts without shingles."""
    weight = np.bincount(doc, weights=times, minlength=n_docs)
    # processes: one per shingle and weight interval that the text reaches
    pd, ps, lo, hi, top = [], [], [], [], []
    level, low, high = 0, 0, 1
    live = np.arange(len(doc))
    while len(live):
        pd.append(doc[live])
        ps.append(mix(shingle[live] ^ mix(np.full(len(live), level + 1, dtype=np.uint64))))
        lo.append(np.full(len(live), low, dtype=np.float64))
        hi.append(np.full(len(live), high, dtype=np.float64))
        top.append(times[live])
        live = live[times[live] > high]
        level, low, high = level + 1, high, high * 2
    if not pd:
        return np.zeros((n_docs, slots), dtype=np.uint64)
    pd, ps, lo, hi, top = (np.concatenate(x) for x in (pd, ps, lo, hi, top))
    best = np.full(n_docs * slots, np.inf)
    ident = np.zeros(n_docs * slots, dtype=np.uint64)
    state = ps.copy()
    rate = slots * (hi - lo)

    def step(at, now):
        """The next point of processes ``at`` after times ``now``."""
        state[at] = mix(state[at] + _U(0x9E3779B97F4A7C15))
        return now - np.log(_unit(state[at])) / rate[at]

    due = step(np.arange(len(pd)), np.zeros(len(pd)))
    horizon = np.where(weight > 0, (np.log(slots) + 3.0) / np.maximum(weight, 1), 0.0)
    open_docs = weight > 0
    while open_docs.any():
        at = np.flatnonzero(open_docs[pd] & (due <= horizon[pd]))
        while len(at):
            point = mix(state[at] ^ _U(0xD6E8FEB86659FD93))
            inner = lo[at] + (hi[at] - lo[at]) * _unit(mix(point + _U(1)))
            seen = inner < top[at]
            key = pd[at] * slots + (point % _U(slots)).astype(np.int64)
            k, t, p = key[seen], due[at][seen], point[seen]
            np.minimum.at(best, k, t)
            won = best[k] == t
            ident[k[won]] = p[won]
            due[at] = step(at, due[at])
            at = at[due[at] <= horizon[pd[at]]]
        open_docs &= np.isinf(best).reshape(n_docs, slots).any(axis=1)
        # slots still without a point: look further
        horizon = np.where(open_docs, horizon * 2, horizon)
    return ident.reshape(n_docs, slots)


def _sign(batches):
    """(doc_id, node, text) to nodes; bands only with the first row of a text in a buffer."""
    schema = pa.schema([("doc_id", pa.int64()), ("node", pa.binary()), ("weight", pa.int64()),
                        ("bands", pa.list_(pa.int64())), ("slots", pa.binary())])

    def rows():
        for b in batches:
            for d, n, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                yield (d, n), t.as_py().encode()

    for held in buffers(rows(), BUFFER_BYTES):
        number: dict[bytes, int] = {}
        own = [number.setdefault(n, len(number)) for (_, n), _ in held]
        raws: list[bytes] = [b""] * len(number)
        for (_, raw), i in zip(held, own):
            raws[i] = raw
        doc, sh, times = shingle_bags(raws)
        sig = signatures(doc, sh, times, len(raws))
        weight = np.bincount(doc, weights=times, minlength=len(raws)).astype(np.int64)
        band = np.zeros((len(raws), BANDS), dtype=np.uint64)
        for r in range(ROWS):
            band = mix(band * _U(0x9E3779B97F4A7C15) + sig[:, r::ROWS])
        band = mix(band + np.arange(BANDS, dtype=np.uint64)).astype(np.int64)
        byte = (sig & _U(255)).astype(np.uint8)
        out, seen = [[], [], [], [], []], set()
        for ((d, n), _), i in zip(held, own):
            fresh = i not in seen and weight[i] > 0
            seen.add(i)
            for col, v in zip(out, (d, n, int(weight[i]), band[i].tolist() if fresh else None,
                                    byte[i].tobytes() if fresh else None)):
                col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)


def _bags(batches):
    """(node, text) to (node, shingles, times) as sorted arrays."""
    def rows():
        for b in batches:
            for n, t in zip(b.column(0).to_pylist(), b.column(1)):
                yield n, t.as_py().encode()

    for held in buffers(rows(), BUFFER_BYTES):
        doc, sh, times = shingle_bags([raw for _, raw in held])
        cut = np.searchsorted(doc, np.arange(len(held) + 1))
        yield pa.RecordBatch.from_arrays(
            [pa.array([n for n, _ in held], pa.binary()),
             pa.array([sh[a:b].astype("<u8").tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary()),
             pa.array([times[a:b].astype("<i8").tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())],
            ["node", "shingles", "times"])


def _verify(num: int, den: int):
    def run(batches):
        for b in batches:
            ok, last, x, xn = [], None, None, None
            cols = [b.column(i) for i in range(b.num_columns)]
            centre = cols[0].to_pylist()
            for i in range(b.num_rows):
                if centre[i] != last:
                    last = centre[i]
                    x, xn = (np.frombuffer(cols[j][i].as_py(), t) for j, t in ((2, "<u8"), (3, "<i8")))
                y, yn = (np.frombuffer(cols[j][i].as_py(), t) for j, t in ((4, "<u8"), (5, "<i8")))
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                both = int(np.minimum(xn[at], yn)[x[at] == y].sum())
                ok.append(den * both >= num * (int(xn.sum()) + int(yn.sum()) - both))
            yield pa.RecordBatch.from_arrays([cols[0], cols[1]], ["a", "b"]).filter(pa.array(ok, pa.bool_()))
    return run


def nodes_of(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, node, text); a node is a distinct text."""
    t = text_or_empty("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(t)).alias("node"), t.alias("text"))


def classes(docs: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """(doc_id, node, class, links): near-duplicate class of every document.

    One row per input row. ``class`` is the smallest doc_id of the class (null
    ids count as smaller than all others and stay null), ``links`` the number of
    verified links of the document's text. Equal texts are in one class; texts
    without words are alone with their equals; repeated rows share a class; an
    empty table gives an empty result. Other columns are not read.
    """
    rows = nodes_of(docs)
    signed = materialize(rows.mapInArrow(_sign, NODE_SCHEMA), "signatures")
    bands = signed.where("bands is not null").dropDuplicates(["node"])
    keyed = bands.select("node", "weight", "slots", F.explode("bands").alias("bucket"))
    sizes = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = materialize(keyed.select("node", "bucket").join(sizes, "bucket"), "members")
    nodes = materialize(members.groupBy("node").agg(F.sum("n").alias("met")), "candidates")
    members = members.select("bucket", "node")
    facts = materialize(bands.select("node", "weight", "slots").join(nodes, "node", "left_semi"), "facts")
    # one row of each candidate text, found by its smallest id, so that copies do not meet in one task
    own = signed.join(nodes, "node", "left_semi").groupBy("node").agg(
        F.min("doc_id").alias("_id"), F.lit(True).alias("_some"))
    texts = rows.join(own.withColumnRenamed("node", "_node"),
                      (F.col("node") == F.col("_node")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    bags = materialize(texts.select("node", "text").mapInArrow(
        _bags, "node binary, shingles binary, times binary").dropDuplicates(["node"]), "bags")
    labels = nodes.select("node", F.col("node").alias("label"))
    links = None
    tested = None
    for r in range(CENTRE_ROUNDS + 1):
        placed = members.join(labels, "node")
        if r == 0:
            placed = placed.join(nodes, "node")
        placed = materialize(placed, "placed")
        first = F.xxhash64(F.lit(r), "node", "bucket") if r else F.struct(-F.col("met"), F.xxhash64("node"))
        split = placed.groupBy("bucket").agg(
            F.min_by("node", first).alias("centre"), F.count(F.lit(1)).alias("n"),
            F.min("label").alias("_lo"), F.max("label").alias("_hi")).where("_lo != _hi")
        split = materialize(split.select("bucket", "centre", "n"), "split")
        if split.limit(1).count() == 0:
            break
        if r < CENTRE_ROUNDS:
            heads = placed.select("bucket", F.col("node").alias("centre"), F.col("label").alias("_cl"))
            pairs = placed.join(split.join(heads, ["bucket", "centre"]), "bucket").where("label != _cl").select(
                F.col("centre").alias("a"), F.col("node").alias("b"))
        else:
            # whatever is left: the members of different classes of a bucket
            left = placed.join(split.where(F.col("n") <= SMALL_BUCKET), "bucket", "left_semi")
            pairs = left.select("bucket", F.col("node").alias("a"), F.col("label").alias("_la")).join(
                left.select("bucket", F.col("node").alias("b"), F.col("label").alias("_lb")), "bucket").where(
                "_la < _lb").select("a", "b")
            large = placed.join(split.where(F.col("n") > SMALL_BUCKET), "bucket", "left_semi").select(
                "node", "label").distinct()
            pairs = pairs.unionByName(_rare_pairs(large, bags, num, den))
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = materialize(_plausible(pairs, facts, num, den), "pairs")
        good = materialize(_overlapping(pairs, bags, num, den), "links")
        links = good if links is None else links.unionByName(good)
        tested = pairs if tested is None else tested.unionByName(pairs)
        labels = contract(labels, good)
    if links is None:
        links = nodes.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(
        F.count(F.lit(1)).alias("links"))
    least = signed.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id")).alias("_m"))
    found = least.join(labels, "node", "left").join(degree, "node", "left").select(
        "node", "_m", F.coalesce("label", "node").alias("label"), F.coalesce("links", F.lit(0)).alias("links"))
    found = materialize(found, "found")
    named = found.groupBy("label").agg(F.min("_m").alias("_c"))
    found = materialize(found.join(named, "label").select("node", F.col("_c.doc_id").alias("class"), "links", "label"),
                        "classes")
    return signed.select("doc_id", "node").join(found, "node").select("doc_id", "node", "class", "links", "label")


def _tokens(batches):
    """(node, side, shingles, times) to one row (token, node, side, weight, times) per shingle."""
    for b in batches:
        sh = [np.frombuffer(v.as_py(), "<i8") for v in b.column(2)]
        times = [np.frombuffer(v.as_py(), "<i8") for v in b.column(3)]
        # runs of texts of about 2^18 shingles together
        run = np.cumsum([len(x) for x in sh]) >> 18
        for at in np.flatnonzero(np.diff(run, prepend=-1)).tolist():
            some = range(at, int(np.searchsorted(run, run[at], side="right")))
            row = np.repeat(np.arange(at, at + len(some)), [len(sh[i]) for i in some])
            total = np.array([times[i].sum() for i in some], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([sh[i] for i in some])), b.column(0).take(pa.array(row)),
                 b.column(1).take(pa.array(row)), pa.array(total[row - at]),
                 pa.array(np.concatenate([times[i] for i in some]))],
                ["token", "node", "side", "weight", "times"])


def _rare_pairs(classed: DataFrame, bags: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of nodes of different classes that can reach the similarity, from rows (node, label).

    Exact: a pair that reaches it shares a shingle in the prefixes that its two
    weights leave, whatever the common order of shingles is.
    """
    some = classed.select("node", F.xxhash64("label").alias("side"))
    tokens = materialize(bags.join(some, "node").select("node", "side", "shingles", "times").mapInArrow(
        _tokens, "token long, node binary, side long, weight long, times long"), "tokens")
    spread = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.min("side").alias("_lo"),
                                         F.max("side").alias("_hi")).select(
        "token", F.when(F.col("_lo") == F.col("_hi"), 0).otherwise(F.col("df")).alias("df"))
    before = Window.partitionBy("node").orderBy("df", "token").rowsBetween(Window.unboundedPreceding, -1)
    placed = tokens.join(spread, "token").withColumn("pos", F.coalesce(F.sum("times").over(before), F.lit(0)))
    rare = placed.where((F.col("df") > 0) & (den * (F.col("weight") - F.col("pos")) >= num * F.col("weight")))
    rare = materialize(rare.select("token", "node", "side", "weight", "pos"), "rare")
    a, b = (rare.select("token", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "side", "weight", "pos")])
            for x in "ab")
    least = num * (F.col("weight_a") + F.col("weight_b"))
    fits = ((F.col("node_a") < F.col("node_b")) & (F.col("side_a") != F.col("side_b"))
            & ((num + den) * (F.col("weight_a") - F.col("pos_a")) >= least)
            & ((num + den) * (F.col("weight_b") - F.col("pos_b")) >= least))
    return a.join(b, (a["token"] == b["token"]) & fits).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def _plausible(pairs: DataFrame, facts: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs that weights and signatures allow to reach the similarity."""
    a, b = (facts.select(F.col("node").alias(c), F.col("weight").alias(f"w{c}"), F.col("slots").alias(f"s{c}"))
            for c in "ab")
    both = pairs.join(a, "a").join(b, "b")
    sized = both.where(F.lit(den) * F.least("wa", "wb") >= F.lit(num) * F.greatest("wa", "wb"))
    same = F.lit(0)
    for i in range(SLOTS):
        same = same + (F.substring("sa", i + 1, 1) == F.substring("sb", i + 1, 1)).cast("int")
    return sized.where(same >= MIN_AGREE).select("a", "b")


def _overlapping(pairs: DataFrame, bags: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs whose multisets overlap enough, verified exactly."""
    a, b = (bags.select(F.col("node").alias(c), F.col("shingles").alias(f"x{c}"), F.col("times").alias(f"n{c}"))
            for c in "ab")
    both = pairs.join(b, "b").join(a, "a").select("a", "b", "xa", "na", "xb", "nb")
    return both.mapInArrow(_verify(num, den), "a binary, b binary")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of ``docs``, all columns unchanged, of every near-duplicate class: that of the smallest doc_id.

    Among rows that share that id the one with the smallest text hash stays.
    """
    found = classes(docs)
    heads = found.groupBy("label").agg(F.min(F.struct(
        F.col("doc_id").isNotNull().alias("some"), "doc_id", "node")).alias("_m")).select(
        F.col("_m.doc_id").alias("_id"), F.col("_m.node").alias("_node"))
    heads = materialize(heads, "heads")
    t = text_or_empty("text")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                        F.col("doc_id").cast("long").alias("_did"), F.unhex(F.md5(t)).alias("_dn"))
    kept = keyed.join(heads, F.col("_did").eqNullSafe(F.col("_id")) & (F.col("_dn") == F.col("_node")), "left_semi")
    # rows repeated whole: one of them
    return kept.groupBy("_did", "_dn").agg(F.first("_row").alias("_row")).select("_row.*")
