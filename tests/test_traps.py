"""Literal cases for the easy-to-get-wrong semantics (both sides of each boundary)."""
import datetime as dt

from pyspark.sql import functions as F

from memoria.functions.textfn import summary_or_truncate
from memoria.functions.timefn import as_of_lit, days_between
from memoria.operators import conversations as conv
from memoria.operators import memory as mem
from memoria.operators import migration as mig
from memoria.operators import retention as ret
from memoria.operators import summaries as summ
from memoria.operators.search import semantic_search
from memoria.streaming.jobs import maintenance_gate

AS_OF = dt.datetime(2024, 2, 1)


def test_days_floor_24h_not_midnights(spark):
    # T1: 23 h across midnight is 0 days; a negative gap floors to -1
    df = spark.createDataFrame([(dt.datetime(2024, 1, 31, 1, 0), dt.datetime(2024, 2, 1, 0, 0)),
                                (dt.datetime(2024, 2, 1, 0, 0), dt.datetime(2024, 1, 31, 1, 0))],
                               "a timestamp_ntz, b timestamp_ntz")
    got = [r[0] for r in df.select(days_between(F.col("b"), F.col("a"))).collect()]
    assert got == [0, -1]


def _exp(spark, rows):
    return spark.createDataFrame(rows, "thread_id long, seq long, importance int, memory_type string, "
                                       "created_at timestamp_ntz, last_accessed timestamp_ntz, access_count int")


def test_retention_thresholds_are_strict(spark):
    # T2: LOW keeps exactly 7 days, forgets 8; CRITICAL never forgotten
    d7, d8 = AS_OF - dt.timedelta(days=7), AS_OF - dt.timedelta(days=8)
    rows = [(1, 1, 1, "fact", d7, AS_OF, 5), (1, 2, 1, "fact", d8, AS_OF, 5),
            (1, 3, 4, "error", AS_OF - dt.timedelta(days=900), AS_OF - dt.timedelta(days=900), 0),
            (1, 4, 2, "error", d8, AS_OF, 5), (1, 5, 2, "fact", d8, AS_OF - dt.timedelta(days=31), 2)]
    got = dict(_exp(spark, rows).select("seq", ret.should_forget(AS_OF).alias("f")).collect())
    assert got == {1: False, 2: True, 3: False, 4: True, 5: True}


def test_forget_score_values(spark):
    rows = [(1, 1, 2, "preference", AS_OF - dt.timedelta(days=10), AS_OF - dt.timedelta(days=5), 3)]
    s = _exp(spark, rows).select(ret.forget_score(AS_OF)).first()[0]
    assert abs(s - (10 * 0.1 + 5 * 0.2 - 10 - 6 - 10)) < 1e-9


def test_forget_quota_ties_in_input_order(spark):
    # T10 + SRT1: equal scores keep input order; CRITICAL counts toward the total only
    base = AS_OF - dt.timedelta(days=1)
    rows = [(7, i, 1, "fact", base, base, 1) for i in range(5)] + [(7, 99, 4, "fact", base, base, 1)]
    out = ret.forget_ranking(_exp(spark, rows), max_memories=3, as_of=AS_OF)
    assert sorted(r["seq"] for r in out.collect()) == [0, 1, 2]


def test_summary_truncation_boundary(spark):
    # T15: 100 characters stay whole, 101 become 97 + '...'; empty summary counts as missing
    df = spark.createDataFrame([("a" * 100, None), ("b" * 101, ""), ("c" * 101, "given")], "content string, summary string")
    got = [r[0] for r in df.select(summary_or_truncate(F.col("summary"), F.col("content"))).collect()]
    assert got == ["a" * 100, "b" * 97 + "...", "given"]


def test_expiry_nulls(spark):
    # T7: null expiry never expires; null persistence is deleted by no rule
    df = spark.createDataFrame([
        ("1", "agent", False, None, 1, dt.datetime(2024, 1, 1), 0.1, 0.1),
        ("2", "agent", None, dt.datetime(2024, 1, 1), 0, dt.datetime(2024, 1, 1), 0.1, 0.1),
        ("3", "agent", False, dt.datetime(2024, 1, 1), 1, dt.datetime(2024, 1, 1), 0.9, 0.9)],
        "id string, agent_id string, is_persistent boolean, expires_at timestamp_ntz, access_count int, "
        "created_at timestamp_ntz, importance double, confidence double")
    kept = [r["id"] for r in mem.cleanup_expired(df, AS_OF).collect()]
    assert sorted(kept) == ["1", "2"]
    flagged = [r["id"] for r in df.where(mem.forget_flag(AS_OF)).collect()]
    assert flagged == ["3"]


def test_enrich_expiry_by_type(spark):
    req = spark.createDataFrame([("a", "s", "scratch", "x"), ("b", "s", "conversation", "x"), ("c", "s", "plan", "x"),
                                 ("d", "s", "observation", "x"), ("e", "s", "fact", "x"), ("f", "", "fact", "x")],
                                "id string, session_id string, memory_type string, content string")
    got = {r["id"]: r["expires_at"] for r in mem.enrich(req, AS_OF).collect()}
    assert got == {"a": AS_OF + dt.timedelta(hours=1), "b": AS_OF + dt.timedelta(days=7),
                   "c": AS_OF + dt.timedelta(days=3), "d": AS_OF + dt.timedelta(days=30), "e": None}


def test_fan_out_counts(spark):
    # T6: 3 memories, 2 reflections, 0 tasks -> memories 6, reflections 6, tasks 0
    m = spark.createDataFrame([("m1", "a", "s1", AS_OF), ("m2", "a", "s1", AS_OF), ("m3", "a", "s2", AS_OF)],
                              "id string, agent_id string, session_id string, created_at timestamp_ntz")
    r = spark.createDataFrame([("r1", "a"), ("r2", "a")], "id string, agent_id string")
    t = spark.createDataFrame([], "id string, agent_id string")
    row = mem.agent_activity(m, r, t).first()
    assert (row["unique_sessions"], row["total_memories"], row["total_reflections"], row["total_tasks"]) == (2, 6, 6, 0)


def test_two_stage_ranking(spark):
    # T5: similarity picks 2*limit candidates; the combined score orders only those
    vec = spark.createDataFrame([("v1", "a", [1.0, 0.0]), ("v2", "a", [0.9, 0.1]), ("v3", "a", [0.0, 1.0])],
                                "id string, agent_id string, vector array<double>")
    q = spark.createDataFrame([(1, "a", [1.0, 0.0])], "query_id long, agent_id string, vector array<double>")
    m = spark.createDataFrame([("v1", "c", "s", "fact", 0.1, 1.0, 0, AS_OF, []), ("v2", "c", "s", "fact", 0.9, 1.0, 4, AS_OF, []),
                               ("v3", "c", "s", "fact", 1.0, 1.0, 0, AS_OF, [])],
                              "id string, content string, summary string, memory_type string, importance double, "
                              "confidence double, access_count int, created_at timestamp_ntz, tags array<string>")
    out = semantic_search(m, vec, q, limit=1, min_score=0.0, as_of=AS_OF).collect()
    # v3 has the best importance but is not among the 2 nearest; v2 wins on combined score
    assert [(r["id"], r["access_count"]) for r in out] == [("v2", 5)]


def test_keyword_substring_and_order(spark):
    # T14: 'unlikely' contains 'like'; first class wins; 'how' + 'to' across messages matches
    df = spark.createDataFrame([(1, 0, "u", "That is unlikely"), (2, 0, "u", "It failed"), (2, 1, "a", "a tutorial"),
                                (3, 0, "u", "tell me how"), (3, 1, "a", "to cook"), (4, 0, "u", "hello")],
                               "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: (r["memory_type"], r["importance"]) for r in conv.classify(df).collect()}
    assert got == {1: ("preference", 3), 2: ("error", 2), 3: ("skill", 3), 4: ("interaction", 2)}


def test_blank_rule_and_missing_key(spark):
    # FLT10 + T17: a missing key is null and therefore blank; case matters
    df = spark.createDataFrame([(None,), ("",), (" None ",), ("null",), ("NULL",), ('{"x":1}',)], "g string")
    got = [r[0] for r in df.select(mig.is_blank(F.col("g"))).collect()]
    assert got == [True, True, True, True, False, False]


def test_quoting_each_part(spark):
    # T9
    df = spark.createDataFrame([("main.sch.t_payload",)], "n string")
    assert df.select(mig.quoted_table_name(F.col("n"))).first()[0] == "`main`.`sch`.`t_payload`"


def test_maintenance_gate_total_seconds(spark):
    # T13: a day and five minutes is 86700 s, not 300 s
    st = spark.createDataFrame([(1, 1, AS_OF - dt.timedelta(days=1, minutes=5)), (2, 46, AS_OF)],
                               "thread_id long, memory_count long, last_maintenance timestamp_ntz")
    got = {r["thread_id"]: r["run_maintenance"] for r in maintenance_gate(st, 50, AS_OF).collect()}
    assert got == {1: True, 2: True}


def test_partial_summaries_mark_first_50(spark):
    # T11: only the first 50 of a session are marked; the count is the full count
    rows = [(str(i), i, "agent", "s", "conversation", f"m{i}", False, AS_OF - dt.timedelta(days=10, minutes=60 - i))
            for i in range(60)]
    m = spark.createDataFrame(rows, "id string, seq long, agent_id string, session_id string, memory_type string, "
                                    "content string, is_summarized boolean, created_at timestamp_ntz")
    s, marked = summ.summarize_conversations(m, AS_OF)
    assert s.first()["message_count"] == 60
    assert marked.where("is_summarized").count() == 50


def test_json_helpers(spark):
    from pyspark.sql import types as T

    from memoria.functions.jsonfn import parse_or_default, parse_python_literal
    df = spark.createDataFrame([("{'a': 1, 'b': None, 'c': 'None here'}",), ("not json",), (None,)], "v string")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType()),
                           T.StructField("c", T.StringType())])
    rows = df.select(parse_python_literal(F.col("v"), schema).alias("p")).collect()
    assert (rows[0]["p"]["a"], rows[0]["p"]["b"], rows[0]["p"]["c"]) == (1, None, "None here")
    d = df.select(parse_or_default(F.col("v"), "map<string,string>", F.create_map().cast("map<string,string>")).alias("m"))
    assert [len(r["m"]) if r["m"] is not None else None for r in d.collect()][1:] == [0, 0]


def test_name_list_and_missing_keys(spark):
    df = spark.createDataFrame([('["a", "b"]',), ("[]",), ("{",)], "value string")
    out = mig.parse_name_list(df).collect()
    assert out[0]["_names"] == ["a", "b"] and out[0]["error"] is None
    assert out[1]["error"] == "Endpoint list is empty" and out[2]["error"] == "Invalid JSON format"
    cfg = spark.createDataFrame([("https://x", None), ("", "y")], "workspace_url string, token string")
    got = [r["missing_keys"] for r in mig.missing_keys(cfg, ["workspace_url", "token"]).collect()]
    assert got == [["token"], ["workspace_url"]]


def test_results_do_not_depend_on_session_time_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        df = spark.createDataFrame([(dt.datetime(2024, 3, 9, 12, 0), dt.datetime(2024, 3, 10, 12, 0))],
                                   "a timestamp_ntz, b timestamp_ntz")
        assert df.select(days_between(F.col("b"), F.col("a"))).first()[0] == 1
        flat = spark.createDataFrame([(1, "e", "SUCCESS")], "request_seq long, endpoint_name string, overall_status string")
        assert mig.with_report_columns(flat, "dev", AS_OF).first()["date"] == "01-02-2024 11:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_thread_activity_golden_counts(spark):
    # SURVEY §5: one thread with 5 checkpoints (steps -1..3) and one with 22
    # (steps -1..20, 6 user inputs, 16 loop steps); ids sort in time order.
    from memoria.operators.tracing import latest_checkpoint, thread_activity
    rows, t0 = [], dt.datetime(2025, 7, 23, 13, 0, 0)
    inputs_b = {-1, 2, 6, 10, 14, 18}
    for thread, steps, inputs in (("t_a", range(-1, 4), {-1}), ("t_b", range(-1, 21), inputs_b)):
        prev = None
        for i, step in enumerate(steps):
            cid = f"{thread}-{i:04d}"
            src = "input" if step in inputs else "loop"
            meta = "{'source': '%s', 'step': %d, 'writes': None, 'parents': {}}" % (src, step)
            rows.append((thread, "", cid, prev, meta, t0 + dt.timedelta(seconds=4 * i)))
            prev = cid
    cps = spark.createDataFrame(rows, "thread_id string, checkpoint_ns string, checkpoint_id string, "
                                      "parent_checkpoint_id string, metadata string, ts timestamp_ntz")
    got = {r["thread_id"]: r for r in thread_activity(cps).collect()}
    assert (got["t_a"]["checkpoints"], got["t_a"]["min_step"], got["t_a"]["max_step"]) == (5, -1, 3)
    assert (got["t_b"]["checkpoints"], got["t_b"]["min_step"], got["t_b"]["max_step"]) == (22, -1, 20)
    assert (got["t_b"]["input_steps"], got["t_b"]["loop_steps"]) == (6, 16)
    latest = {r["thread_id"]: r["step"] for r in latest_checkpoint(cps).collect()}
    assert latest == {"t_a": 3, "t_b": 20}


def test_local_clock_normalised_to_utc(spark):
    # T3: a local +05:30 reading and the UTC reading of the same instant become equal
    from memoria.functions.timefn import to_utc
    df = spark.createDataFrame([(dt.datetime(2025, 7, 23, 19, 9, 21), dt.datetime(2025, 7, 23, 13, 39, 21))],
                               "local_ts timestamp_ntz, utc_ts timestamp_ntz")
    r = df.select((to_utc(F.col("local_ts"), "Asia/Kolkata") == F.col("utc_ts")).alias("same")).first()
    assert r["same"]


def test_days_between_matches_python_on_random_pairs(spark):
    # T1 on many pairs: Spark's 24-hour floor equals Python's timedelta.days
    import random
    rnd = random.Random(7)
    base = dt.datetime(2024, 1, 1)
    pairs = [(base + dt.timedelta(seconds=rnd.randint(-10**8, 10**8), microseconds=rnd.randint(0, 999999)),
              base + dt.timedelta(seconds=rnd.randint(-10**8, 10**8), microseconds=rnd.randint(0, 999999)))
             for _ in range(500)]
    df = spark.createDataFrame(pairs, "a timestamp_ntz, b timestamp_ntz")
    got = [r[0] for r in df.select(days_between(F.col("b"), F.col("a"))).collect()]
    assert got == [(b - a).days for a, b in pairs]


def test_forget_score_and_rule_match_python_on_random_rows(spark):
    import random
    rnd = random.Random(11)
    types = ["preference", "fact", "interaction", "skill", "error"]
    rows = []
    for i in range(400):
        created = AS_OF - dt.timedelta(seconds=rnd.randint(0, 200 * 86400))
        last = min(created + dt.timedelta(seconds=rnd.randint(0, 90 * 86400)), AS_OF)
        rows.append((1, i, rnd.randint(1, 4), rnd.choice(types), created, last, rnd.randint(1, 6)))
    got = {r["seq"]: (r["s"], r["f"]) for r in _exp(spark, rows).select(
        "seq", ret.forget_score(AS_OF).alias("s"), ret.should_forget(AS_OF).alias("f")).collect()}
    penalty = {1: 0, 2: -10, 3: -25, 4: -1000}
    limit = {1: 7, 2: 30, 3: 90, 4: 365}
    for _, i, imp, mt, created, last, acc in rows:
        age, rec = (AS_OF - created).days, (AS_OF - last).days
        score = 0.0
        score += age * 0.1
        score += rec * 0.2
        score += penalty[imp]
        score -= acc * 2
        score += 5 if mt == "error" else (-10 if mt == "preference" else 0)
        forget = (imp != 4) and (age > limit[imp] or (rec > 30 and acc < 3) or (mt == "error" and age > 7))
        assert got[i] == (score, forget), (i, got[i], score, forget)
