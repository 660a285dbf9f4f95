"""Prefix trie of conversations by whole-sequence collapse.

Equal conversations are first collapsed into one weighted sequence with the list
of conversations that end there. Sequences that are a proper prefix of another
are dropped by an anti-join, which leaves the leaves; then the prefixes of every
distinct sequence are aggregated with its weight, so the work follows the
distinct turns and not the copies.

A prefix is named by its depth and two 64-bit exclusive-ors of the hashes of its
turns, each hashed with its place: one window gives all prefixes of a
conversation. Conversations of any length are cut into blocks of ``BLOCK`` turns,
whose totals are carried on, so that no key is bound to one task.

Sums over subtrees need no descent. A node's saved bytes are members less one
times the bytes of its last turn. Members times bytes, summed over a subtree, is
the sum of the remaining bytes of its members. The bytes themselves count every
node once; a node belongs to its smallest sequence, the nodes of a sequence are a
final run of its path, so each sequence adds the bytes of its own run to every
node that it passes.
"""
from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

BLOCK = 1024
HEADS = 9          # a rebuilt conversation takes up to HEADS - 1 turns of its head conversation
FAMILY = 5
ENDS_PER_CHUNK = 4096
# children of one parent are dealt over this many groups
SALTS = 64
KEY = ["depth", "ka", "kb"]
NO_ENDS = hashlib.sha256(b"").hexdigest()

OUTPUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turn_digest() -> dict[str, Column]:
    """What the trie needs of a turn: two hashes of role and text, and the text's UTF-8 bytes."""
    return {"ha": F.xxhash64(F.lit(1), "role", "text"), "hb": F.xxhash64(F.lit(2), "role", "text"),
            "bytes": F.octet_length("text").cast("long")}


def turn_texts() -> dict[str, Column]:
    return {"role": F.col("role"), "text": F.col("text")}


def numbered(conversations: DataFrame, payload: dict[str, Column]) -> DataFrame:
    """(conv_id, pos, first rows of its conversation, payload) with turns numbered from 1.

    Turns are ordered by turn (null first), then role and text. The rows are
    range-partitioned by (conv_id, order), so a long conversation is spread over
    many ranges; the counts of earlier ranges are added per (conversation, range).
    """
    order = ["conv_id", "turn", "role", "text"]
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    # the number of a row is its partition and its place there
    laid = materialize(laid.select("conv_id", F.monotonically_increasing_id().alias("_row"),
                                   *[c.alias(name) for name, c in payload.items()]), "turns")
    laid = laid.withColumn("_range", F.shiftright("_row", 33))
    per = laid.groupBy("conv_id", "_range").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("conv_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    per = materialize(per.select("conv_id", "_range", "_first", "_n",
                                 F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")), "ranges")
    lengths = per.groupBy("conv_id").agg(F.sum("_n").alias("n_turns"))
    pos = (F.col("_row") - F.col("_first") + F.col("_before") + 1).alias("pos")
    return laid.join(per.drop("_n"), ["conv_id", "_range"]).select("conv_id", pos, *payload), lengths


def rebuild(conversations: DataFrame, payload: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) after every conversation took over the head of its family.

    Conversation c becomes the first h turns of conversation c - c % 5 (all if it
    has fewer, none if there is no such conversation) and its own turns after its
    first h, h = crc32(c) % 9. ``turns`` has conv_id, depth (from 1) and the
    payload, by default role and text; ``conversations`` has conv_id of all, also
    of those left without a turn. % keeps the sign of c.
    """
    payload = turn_texts() if payload is None else payload
    turns, lengths = numbered(conversations, payload)
    turns = materialize(turns, "numbered")
    c = F.col("conv_id")
    own = lengths.select("conv_id", (F.crc32(c.cast("string")) % HEADS).alias("h"),
                         (c - c % FAMILY).alias("base"))
    bases = lengths.where(c % FAMILY == 0).select(c.alias("base"), F.col("n_turns").alias("base_turns"))
    plan = materialize(own.join(bases, "base", "left").select(
        "conv_id", "h", "base", F.least("h", F.coalesce("base_turns", F.lit(0))).alias("take")), "plan")
    # a family's head is short; the rest of a conversation is found by blocks, so that a long one is spread
    heads = turns.where((c % FAMILY == 0) & (F.col("pos") < HEADS)).withColumnRenamed("conv_id", "base").join(
        plan.where("take > 0"), "base").where("pos <= take").select("conv_id", F.col("pos").alias("depth"), *payload)
    blocks = plan.join(lengths, "conv_id").select(
        "conv_id", "h", "take",
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n_turns") / BLOCK))).alias("_block"))
    rest = turns.withColumn("_block", F.floor(F.col("pos") / BLOCK)).join(blocks, ["conv_id", "_block"]).where(
        "pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("take")).alias("depth"), *payload)
    return heads.unionByName(rest), plan.select("conv_id")


def prefix_names(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(paths, totals): the name and bytes of every prefix, and of every whole conversation that has turns.

    ``turns`` has conv_id, depth, ha, hb, bytes. ``paths`` adds the block, the
    hashes xa and xb of the turn in its place, and bytes up to the depth.
    """
    placed = turns.select("conv_id", "depth", "bytes", F.floor((F.col("depth") - 1) / BLOCK).alias("_block"),
                          F.xxhash64("depth", "ha", "hb").alias("xa"),
                          F.xxhash64(F.lit(7), "hb", "depth", "ha").alias("xb"))
    placed = materialize(placed.repartition("conv_id", "_block"), "placed")
    inside = Window.partitionBy("conv_id", "_block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    local = placed.select("*", F.bit_xor("xa").over(inside).alias("la"), F.bit_xor("xb").over(inside).alias("lb"),
                          F.sum("bytes").over(inside).alias("lbytes"))
    totals = placed.groupBy("conv_id", "_block").agg(
        F.bit_xor("xa").alias("ta"), F.bit_xor("xb").alias("tb"), F.sum("bytes").alias("tbytes"),
        F.max("depth").alias("last"))
    totals = materialize(totals, "blocks")
    before = Window.partitionBy("conv_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    carried = totals.select("conv_id", "_block", F.coalesce(F.bit_xor("ta").over(before), zero).alias("ca"),
                            F.coalesce(F.bit_xor("tb").over(before), zero).alias("cb"),
                            F.coalesce(F.sum("tbytes").over(before), zero).alias("cbytes"))
    paths = local.join(carried, ["conv_id", "_block"]).select(
        "conv_id", "_block", "depth", F.col("la").bitwiseXOR(F.col("ca")).alias("ka"),
        F.col("lb").bitwiseXOR(F.col("cb")).alias("kb"), "xa", "xb", "bytes",
        (F.col("lbytes") + F.col("cbytes")).alias("upto"))
    whole = totals.groupBy("conv_id").agg(F.max("last").alias("depth"), F.bit_xor("ta").alias("ka"),
                                          F.bit_xor("tb").alias("kb"), F.sum("tbytes").alias("total"))
    return materialize(paths, "paths"), whole


def _along(sequences: DataFrame, paths: DataFrame, cols: list[str]) -> DataFrame:
    """Every prefix of every sequence, the empty one included, with the sequence's ``cols``.

    A sequence is joined block by block with the path of its representative.
    """
    zero = F.lit(0).cast("long")
    root = sequences.select(*cols, "len", *[zero.alias(c) for c in ("depth", "ka", "kb", "xa", "xb", "bytes", "upto")])
    blocks = sequences.where("len > 0").select(
        *cols, "len", F.explode(F.sequence(zero, F.floor((F.col("len") - 1) / BLOCK))).alias("_block"))
    steps = paths.withColumnRenamed("conv_id", "rep").join(blocks, ["rep", "_block"])
    return root.unionByName(steps.drop("_block"))


def collapse(turns: DataFrame, conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sequences, ends, paths): one row per distinct whole sequence, and the conversations that end in each.

    ``sequences`` has len, ka, kb, its weight (conversations), rep (the smallest)
    and total bytes; ``ends`` has depth, ka, kb, conv_id.
    """
    paths, whole = prefix_names(turns)
    zero = F.lit(0).cast("long")
    ends = materialize(conversations.join(whole, "conv_id", "left").select(
        "conv_id", *[F.coalesce(c, zero).alias(c) for c in ("depth", "ka", "kb", "total")]), "ends")
    sequences = ends.groupBy(*KEY).agg(F.count("*").alias("weight"), F.min("conv_id").alias("rep"),
                                       F.max("total").alias("total"))
    return materialize(sequences.withColumnRenamed("depth", "len"), "sequences"), ends.drop("total"), paths


def _chunks(limit: int):
    """Sorted (depth, ka, kb, conv_id) rows to rows with up to ``limit`` ids as text."""
    def run(batches):
        for b in batches:
            depth, ka, kb, ids = (b.column(i).to_pylist() for i in range(4))
            at = 0
            while at < len(ids):
                end = at + 1
                while end < len(ids) and end - at < limit and (depth[end], ka[end], kb[end]) == (
                        depth[at], ka[at], kb[at]):
                    end += 1
                yield pa.RecordBatch.from_pydict({"depth": [depth[at]], "ka": [ka[at]], "kb": [kb[at]],
                                                  "first": [ids[at]], "part": [",".join(map(str, ids[at:end]))]})
                at = end
    return run


def _digest(batches):
    """Sorted chunks to one SHA-256 per key; a digest takes its chunks one after another."""
    key, held = None, None
    done: dict[str, list] = {"depth": [], "ka": [], "kb": [], "ends_sha256": []}

    def close():
        if key is not None:
            for name, v in zip(done, (*key, held.hexdigest())):
                done[name].append(v)

    for b in batches:
        for *new, part in zip(*(b.column(c).to_pylist() for c in (*KEY, "part"))):
            if new == key:
                held.update(b"," + part.encode())
                continue
            close()
            key, held = new, hashlib.sha256(part.encode())
        if len(done["depth"]) >= 4096:
            yield pa.RecordBatch.from_pydict(done)
            done = {k: [] for k in done}
    close()
    if done["depth"]:
        yield pa.RecordBatch.from_pydict(done)


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, ka, kb, ends_sha256): hash of the comma-joined ascending ids that end in a node.

    Ids are sorted over ranges and joined into chunks there; a digest is then fed
    with the chunks in order, so a list of any length needs no memory.
    """
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*KEY, "conv_id"]
    laid = ends.select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order)
    chunks = laid.mapInArrow(_chunks(ENDS_PER_CHUNK), "depth long, ka long, kb long, first long, part string")
    return chunks.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(
        _digest, "depth long, ka long, kb long, ends_sha256 string")


def prefix_trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of ``turns``, the textless root (depth 0) included.

    ``turns`` has conv_id, depth (1, 2, ... without gaps), ha, hb and bytes (see
    :func:`turn_digest`), ``conversations`` all conv_id once. Returns conv_id (the smallest
    member), depth, parent_conv_id (null at the root), n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256, and the node's name ka, kb.
    """
    sequences, ends, paths = collapse(turns, conversations)
    # which prefixes go on, whose they are, and the bytes before them
    found = _along(sequences, paths, ["rep"]).groupBy(*KEY).agg(
        F.min("rep").alias("owner"), F.max(F.col("len") > F.col("depth")).alias("inner"),
        F.max(F.col("upto") - F.col("bytes")).alias("before"))
    found = materialize(found, "prefixes")
    own_name = ["len", "ka", "kb"]
    proper = found.where("inner").select(F.col("depth").alias("len"), "ka", "kb")
    leaves = sequences.join(proper, own_name, "left_anti").select("rep", F.lit(1).cast("long").alias("leaf"))
    runs = found.groupBy(F.col("owner").alias("rep")).agg(F.min_by("before", "depth").alias("run_from"))
    weighted = sequences.join(leaves, "rep", "left").join(runs, "rep", "left").select(
        "rep", *own_name, "weight", (F.col("weight") * F.col("total")).alias("all_bytes"),
        F.coalesce("run_from", "total").alias("run_from"), F.coalesce("leaf", F.lit(0)).alias("leaf"),
        (F.col("total") - F.coalesce("run_from", "total")).alias("run"))
    weighted = materialize(weighted, "weighted")
    before = F.max(F.col("upto") - F.col("bytes"))
    nodes = _along(weighted.drop("ka", "kb"), paths, ["rep", "weight", "all_bytes", "run_from", "leaf", "run"]).groupBy(
        *KEY).agg(
        F.min("rep").alias("conv_id"), F.sum("weight").alias("n_convs"), F.sum("leaf").alias("n_leaves"),
        F.max(F.col("ka").bitwiseXOR(F.col("xa"))).alias("pa"), F.max(F.col("kb").bitwiseXOR(F.col("xb"))).alias("pb"),
        (F.sum("all_bytes") - F.sum("weight") * before
         - (F.sum("run") + F.min_by("run_from", "rep") - before)).alias("saved_tokens"))
    nodes = materialize(nodes.withColumn("_salt", F.pmod(F.xxhash64("ka", "kb"), F.lit(SALTS))), "nodes")
    # parents meet their children in groups of (parent, salt)
    parent = [(F.col("depth") - 1).alias("depth"), F.col("pa").alias("ka"), F.col("pb").alias("kb")]
    groups = nodes.where("depth > 0").groupBy(*parent, "_salt").agg(F.count("*").alias("n"))
    groups = materialize(groups.join(nodes.select(*KEY, F.col("conv_id").alias("parent_conv_id")), KEY), "children")
    counts = groups.groupBy(*KEY).agg(F.sum("n").alias("n_children"))
    up = groups.select((F.col("depth") + 1).alias("depth"), F.col("ka").alias("pa"), F.col("kb").alias("pb"),
                       "_salt", "parent_conv_id")
    full = nodes.join(up, ["depth", "pa", "pb", "_salt"], "left").join(counts, KEY, "left").join(
        end_digests(ends), KEY, "left")
    return full.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"), "ka", "kb")


def node_texts(nodes: DataFrame, turns: DataFrame) -> DataFrame:
    """``nodes`` with the role and text of their last turn, from ``turns`` (conv_id, depth, role, text); null at the root."""
    return nodes.join(turns.select("conv_id", "depth", "role", "text"), ["conv_id", "depth"], "left")


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The prefix trie of the rebuilt conversations, all columns of ``OUTPUT``.

    A null role or text is empty; rows without a conv_id belong to no
    conversation; rows of one turn are ordered by role and text, and repeated rows are
    turns of their own; a conversation may be left without turns and then ends in
    the root; texts count whole, of any length; an empty table has no node, not
    even a root; other columns are not read.
    """
    turns, conversations = rebuild(conversations, turn_digest())
    return prefix_trie(turns, conversations).select(*OUTPUT)
