"""Trace closure, dependency peeling, segment summaries, ordered upserts: against plain versions."""
import json
import random

import pytest

from memoria.operators import conversations as conv
from memoria.operators import snapshots as snap
from memoria.operators import tracing as tr

MAP = "correlation_id string, root_trace_id string, child_trace_ids string, orchestration_id long"


def maps(spark, links):
    return spark.createDataFrame([(f"c{i}", r, None if k is None else json.dumps(k), i) for i, (r, k) in enumerate(links)], MAP)


def brute_closure(links):
    kids = {}
    for r, k in links:
        kids.setdefault(r, set()).update(x for x in (k or []) if x is not None)
    out = {}
    for r in kids:
        if r is None:
            continue
        seen, level, edge = {r: 0}, 0, {r}
        while edge:
            level += 1
            edge = {x for e in edge for x in kids.get(e, ())} - set(seen)
            seen.update(dict.fromkeys(edge, level))
        out.update({(r, t): d for t, d in seen.items()})
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_trace_closure_of_any_shape(spark, seed):
    rng = random.Random(seed)
    links = [(f"t{rng.randrange(25)}", [f"t{rng.randrange(40)}" for _ in range(rng.randrange(3))]) for _ in range(25)]
    links += [(f"deep{i}", [f"deep{i + 1}"]) for i in range(40)] + [("loop", ["loop2"]), ("loop2", ["loop", "loop2"])]
    links += [("none", None), (None, ["t1"]), ("nulls", [None, "x"]), ("empty", [])]
    got = {(r[0], r[1]): r[2] for r in tr.trace_closure(maps(spark, links)).collect()}
    want = brute_closure(links)
    assert got == want and got["deep0", "deep40"] == 40


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_trace_closure_with_shared_children_and_cycles(spark, monkeypatch, levels):
    monkeypatch.setattr(tr, "LEVELS", levels)
    rng = random.Random(levels)
    links = [(f"t{rng.randrange(30)}", [f"t{rng.randrange(30)}" for _ in range(rng.randrange(3))]) for _ in range(25)]
    links += [("a", ["b", "b", "a"]), ("a", ["b"]), ("b", ["c", "d"]), ("c", ["e"]), ("d", ["e"]), ("e", ["f"]), ("a", ["f"])]
    links += [(f"ring{i}", [f"ring{(i + 1) % 11}", f"leaf{i}"]) for i in range(11)] + [("in", ["ring3"]), ("self", ["self"])]
    rows = tr.trace_closure(maps(spark, links)).collect()
    assert {(r[0], r[1]): r[2] for r in rows} == brute_closure(links) and len(rows) == len(brute_closure(links))


def test_trace_closure_writes_no_pair_twice(spark, monkeypatch):
    from memoria import session
    rows, real = [], session.written

    def counted(df, tag):
        out = real(df, tag)
        rows.append(out.count())
        return out
    monkeypatch.setattr(session, "written", counted)
    links = [(f"t{i}{r}", [f"t{i}_{k}" for k in kids]) for i in range(50) for r, kids in (("", (1, 2, 3)), ("_3", (4, 5)), ("_5", (6, 7)))]
    got = tr.trace_closure(maps(spark, links)).count()
    assert got == 50 * 16 and sum(rows) <= got


def test_stitch_shuffles_each_side_of_a_join_once(spark):
    m = maps(spark, [("a", ["b"]), ("a", ["b"]), (None, ["b"]), ("b", None)])
    records = spark.createDataFrame([("b", "node", 1.0), ("a", "span", None), ("x", "span", 2.0)], "trace_id string, kind string, value double")
    out = tr.trace_stitch(m, records)
    assert sorted((r["correlation_id"], r["root_trace_id"], r["trace_id"], r["depth"]) for r in out.collect()) == [
        ("c0", "a", "a", 0), ("c0", "a", "b", 1), ("c1", "a", "a", 0), ("c1", "a", "b", 1), ("c3", "b", "b", 0)]
    plan = tr.trace_stitch(m, records.hint("merge"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 4


def test_stitch_finds_all_kinds_at_any_depth(spark):
    m = maps(spark, [("a", ["b"]), ("b", ["c"]), ("c", ["d"])])
    one = lambda schema, *r: spark.createDataFrame(list(r), schema)
    records = tr.trace_records(
        one("trace_id string, tokens_in long", ("d", 1), (None, 2)),
        one("trace_id string, payload_bytes long, sent_at timestamp_ntz", ("c", 5, None)),
        one("trace_context string, anomaly_score double, occurred_at timestamp_ntz", ('{"trace_id": "b"}', 0.5, None), ("{}", 1.0, None), (None, 1.0, None)),
        one("trace_id string, quantity double, span_ts timestamp_ntz", ("d", 2.0, None), ("z", 1.0, None)))
    got = sorted((r["correlation_id"], r["kind"], r["depth"]) for r in tr.trace_stitch(m, records).collect())
    assert got == [("c0", "event", 1), ("c0", "message", 2), ("c0", "node", 3), ("c0", "span", 3), ("c1", "event", 0),
                   ("c1", "message", 1), ("c1", "node", 2), ("c1", "span", 2), ("c2", "message", 0), ("c2", "node", 1),
                   ("c2", "span", 1)]


# ------------------------------------------------------------ dependency levels
def edges(spark, rows):
    return spark.createDataFrame(rows, "node long, upstream long")


def brute_levels(rows):
    ups = {}
    for n, u in rows:
        ups.setdefault(n, set())
        if u is not None:
            ups[n].add(u)
            ups.setdefault(u, set())
    level = {}

    def of(n):
        if n not in level:
            level[n] = max((of(u) + 1 for u in ups[n]), default=0)
        return level[n]
    return {n: of(n) for n in ups}


@pytest.mark.parametrize("seed", [3, 4])
def test_levels_of_a_random_graph(spark, seed):
    rng = random.Random(seed)
    rows = [(n, rng.randrange(n)) for n in range(1, 60) for _ in range(rng.randrange(4))] + [(100, None), (0, None), (5, 2), (5, 2)]
    assert dict(snap.migration_order(edges(spark, rows)).collect()) == brute_levels(rows)


def test_levels_of_a_long_chain(spark):
    chain = [(i, i - 1) for i in range(1, 300)]
    assert dict(snap.migration_order(edges(spark, chain)).collect()) == brute_levels(chain)


def test_a_chain_that_is_no_forest(spark):
    rows = [(i, i - 1) for i in range(1, 12)] + [(11, 3)]
    assert dict(snap.migration_order(edges(spark, rows)).collect()) == brute_levels(rows)


@pytest.mark.parametrize("rows", [
    [(1, 2), (2, 1)],
    [(1, 0), (2, 1), (2, 4), (3, 2), (4, 3), (5, 4), (5, 1)],
    [(1, 1)],
])
def test_cycles_raise(spark, rows):
    with pytest.raises(ValueError, match="cycle"):
        snap.migration_order(edges(spark, rows))


def test_a_cycle_is_found_when_the_frontier_is_empty(spark, monkeypatch):
    written = []
    real = snap.written
    monkeypatch.setattr(snap, "written", lambda df, tag: written.append(tag) or real(df, tag))
    # two upstreams for one node, then a cycle of 40 nodes
    rows = [(1, 0), (1, 50), (2, 1)] + [(100 + i, 100 + (i + 1) % 40) for i in range(40)]
    with pytest.raises(ValueError, match="cycle"):
        snap.migration_order(edges(spark, rows))
    assert written.count("peeled") == 3      # levels 1 and 2, and one round that finds nothing


# ------------------------------------------------------------ segment summaries
@pytest.mark.parametrize("segment", [1, 3, 1024])
def test_keywords_across_messages(spark, monkeypatch, segment):
    monkeypatch.setattr(conv, "SEGMENT_ROWS", segment)
    rng = random.Random(9)
    bits = ["how", "to", "HOW", "xhow", "tox", "ho", "w to", "to how", "", "how to be", "o", "remember", "so wrong", " ", "to "]
    rows, texts = [], {}
    for c in range(150):
        said = [rng.choice(bits) for _ in range(rng.randint(1, 7))]
        order = rng.sample(range(40), len(said))
        rows += [(c, o, t) for o, t in zip(order, said)]
        texts[c] = " ".join(t for _, t in sorted(zip(order, said))).lower()
    rows += [(900, 1, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string").repartition(4)
    got = {r["conv_id"]: (r["memory_type"], r["importance"]) for r in conv.classify(df).collect()}
    for c, t in texts.items():
        want = next(((m, i) for m, i, words in conv.KEYWORD_CLASSES if any(w in t for w in words)), conv.DEFAULT_CLASS)
        assert got[c] == want, (t, got[c])
    assert got[900] == conv.DEFAULT_CLASS
    plan = conv.classify(df)._jdf.queryExecution().toString()
    assert "Window" not in plan and "row_number" not in plan


@pytest.mark.parametrize("keywords", [("a b c",), ("x y", "a b c d")])
def test_keywords_of_several_words_over_short_messages(spark, monkeypatch, keywords):
    monkeypatch.setattr(conv, "KEYWORD_CLASSES", (("skill", 3, keywords),))
    monkeypatch.setattr(conv, "SEGMENT_ROWS", 2)
    rng = random.Random(4)
    rows = [(c, i, rng.choice(["a", "b", "c", "d", "x", "y", "a b", "c d", ""])) for c in range(200) for i in range(rng.randint(1, 6))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string").repartition(3)
    got = {r["conv_id"]: r["memory_type"] for r in conv.classify(df).collect()}
    for c in got:
        text = " ".join(t for k, _, t in rows if k == c)
        assert got[c] == ("skill" if any(w in text for w in keywords) else "interaction"), text


# ------------------------------------------------------------ ordered upserts
def test_publish_keeps_one_row_per_key(spark):
    schema = "k long, v string, at long"
    target = spark.createDataFrame([(1, "a", 5), (2, "a", 5), (4, "a", 1)], schema)
    source = spark.createDataFrame([(1, "b", 4), (1, "c", 3), (2, "x", 5), (3, "p", 1), (3, "q", 2), (None, "n", 1), (None, "m", 1)], schema)
    plain = snap.publish_merge(target, source, "k")
    assert sorted(map(tuple, plain.collect()), key=str) == [(1, "c", 3), (2, "x", 5), (3, "q", 2), (4, "a", 1), (None, "n", 1)]
    newest = snap.publish_merge(target, source, "k", order="at")
    want = [(1, "a", 5), (2, "x", 5), (3, "q", 2), (4, "a", 1), (None, "n", 1)]
    assert sorted(map(tuple, newest.collect()), key=str) == want
    assert sorted(map(tuple, snap.publish_merge(newest, source, "k", order="at").collect()), key=str) == want
    assert newest.columns == target.columns
