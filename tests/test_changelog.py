"""Change logs, compaction, time to live and the bucketed maintenance store."""
import datetime as dt
import os
import shutil

import pytest
from pyspark.sql import functions as F

from memoria.operators import summaries as summ
from memoria.sources import derived as d
from memoria.sources.tables import Tables
from memoria.streaming import changelog, jobs, ttl

SF = "/root/testdata/sf0.001"
SCHEMA = "k long, v string, at long"


def rows(spark, *r, schema=SCHEMA):
    return spark.createDataFrame(list(r), schema)


def table(spark, out, schema=SCHEMA, key="k"):
    return sorted((tuple(r) for r in changelog.read_latest(spark, out, key, schema).collect()), key=str)


# ------------------------------------------------------------ newest wins
def test_newest_order_wins_over_arrival(spark, tmp_out):
    changelog.start(rows(spark, (1, "base", 5), (2, "base", 5)), tmp_out, "at")
    changelog.append(rows(spark, (1, "new", 9), (2, "late", 3), (3, "x", 1)), tmp_out, 0, "k", "at")
    changelog.append(rows(spark, (1, "late", 7), (3, "y", 2), (3, "z", 1)), tmp_out, 1, "k", "at")
    assert table(spark, tmp_out) == [(1, "new", 9), (2, "base", 5), (3, "y", 2)]


def test_ties_go_to_the_later_epoch_then_to_the_larger_text(spark, tmp_out):
    changelog.start(rows(spark, (1, "base", 5)), tmp_out, "at")
    changelog.append(rows(spark, (1, "a", 5), (1, "c", 5), (1, "b", 5), (2, "zz", 1), (2, None, 1)), tmp_out, 0, "k", "at")
    assert table(spark, tmp_out) == [(1, "c", 5), (2, "zz", 1)]
    changelog.append(rows(spark, (1, "a", 5)), tmp_out, 1, "k", "at")
    assert table(spark, tmp_out) == [(1, "a", 5), (2, "zz", 1)]


def test_tombstones_hide_older_rows_that_arrive_late(spark, tmp_out):
    gone = F.col("v") == "-"
    changelog.append(rows(spark, (1, "a", 1), (2, "b", 1), (None, "n", 1)), tmp_out, 0, "k", "at", gone)
    changelog.append(rows(spark, (1, "-", 5), (2, "-", None), (None, "m", 2)), tmp_out, 1, "k", "at", gone)
    changelog.append(rows(spark, (1, "late", 3)), tmp_out, 2, "k", "at", gone)
    want = [(2, "b", 1), (None, "m", 2)]
    assert table(spark, tmp_out) == want
    changelog.compact(spark, tmp_out, "k")
    changelog.append(rows(spark, (1, "later still", 4)), tmp_out, 3, "k", "at", gone)
    assert table(spark, tmp_out) == want
    changelog.append(rows(spark, (1, "back", 6)), tmp_out, 4, "k", "at", gone)
    assert table(spark, tmp_out) == [(1, "back", 6), *want]


def test_a_retried_epoch_and_an_incomplete_one(spark, tmp_out):
    for _ in range(2):
        changelog.append(rows(spark, (1, "a", 1)), tmp_out, 0, "k")
    changelog.append(rows(spark, (1, "b", 1)), tmp_out, 1, "k")
    os.remove(os.path.join(tmp_out, "changes", "epoch=000000000001", "_SUCCESS"))
    assert table(spark, tmp_out) == [(1, "a", 1)]
    changelog.append(rows(spark, (1, "b", 1)), tmp_out, 1, "k")
    assert table(spark, tmp_out) == [(1, "b", 1)]


def test_empty_table_and_empty_batch(spark, tmp_out):
    assert table(spark, tmp_out) == []
    assert changelog.compact(spark, tmp_out, "k") == 0
    changelog.append(rows(spark, (1, "a", 1)).limit(0), tmp_out, 0, "k")
    assert table(spark, tmp_out) == []


# ------------------------------------------------------------ compaction
def filled(spark, out):
    changelog.start(rows(spark, (1, "base", 0), (9, "base", 0)), out, "at")
    for e in range(4):
        changelog.append(rows(spark, (1, f"e{e}", e), (e + 10, "x", 1)), out, e, "k", "at")
    return table(spark, out)


def test_compaction_keeps_the_table_and_shortens_the_log(spark, tmp_out):
    want = filled(spark, tmp_out)
    assert changelog.compact(spark, tmp_out, "k") == 2
    assert table(spark, tmp_out) == want
    assert changelog.epochs(spark, tmp_out, changelog.version(spark, tmp_out)["through"]) == []
    assert changelog.vacuum(spark, tmp_out) == 5          # four epochs and the first base
    assert changelog.names(spark, os.path.join(tmp_out, "changes")) == []
    assert table(spark, tmp_out) == want
    changelog.append(rows(spark, (1, "e9", 9)), tmp_out, 4, "k", "at")
    assert (1, "e9", 9) in table(spark, tmp_out)
    assert changelog.compact(spark, tmp_out, "k") == 3 and changelog.compact(spark, tmp_out, "k") == 3


def test_crash_between_base_and_pointer(spark, tmp_out, monkeypatch):
    want = filled(spark, tmp_out)

    def crash(*a):
        raise RuntimeError("lost the driver")
    with monkeypatch.context() as m:
        m.setattr(changelog, "commit", crash)
        with pytest.raises(RuntimeError):
            changelog.compact(spark, tmp_out, "k")
    assert changelog.version(spark, tmp_out)["version"] == 1 and table(spark, tmp_out) == want
    changelog.vacuum(spark, tmp_out)                      # the orphan base goes, the log stays
    assert table(spark, tmp_out) == want
    changelog.compact(spark, tmp_out, "k")
    assert table(spark, tmp_out) == want


def test_crash_between_pointer_and_vacuum_and_a_replayed_epoch(spark, tmp_out):
    want = filled(spark, tmp_out)
    before = changelog.read_latest(spark, tmp_out, "k", SCHEMA)
    changelog.compact(spark, tmp_out, "k")
    # a stream that did not come to note epoch 3 writes it again after the fold
    changelog.append(rows(spark, (1, "e3", 3), (13, "x", 1)), tmp_out, 3, "k", "at")
    assert table(spark, tmp_out) == want
    assert sorted(map(tuple, before.collect()), key=str) == want   # a reader of the old version is not disturbed


def test_a_version_is_written_once(spark, tmp_out):
    filled(spark, tmp_out)
    with pytest.raises(FileExistsError):
        changelog.commit(spark, tmp_out, 1, "other", 7)
    assert changelog.version(spark, tmp_out)["base"].startswith("base-")


def test_sync_over_three_runs_then_snapshot(spark, tmp_out):
    schema = rows(spark, (1, "a", 1)).schema
    landing, out, ck = (os.path.join(tmp_out, n) for n in ("landing", "out", "ck"))
    arrivals = [[(1, "b", 2), (2, "x", 1), (2, "w", 0)], [(1, "late", 1), (3, "-", 4)], [(3, "late", 3), (2, "y", 5), (1, "c", 2)]]
    for i, a in enumerate(arrivals):
        jobs.land(rows(spark, *a).coalesce(1), os.path.join(landing, f"f{i}"))
        jobs.sync_stream(spark, rows(spark, (1, "a", 0), (3, "z", 0)), landing + "/*", out, ck, "k", schema,
                         {"availableNow": True}, order="at", deleted=F.col("v") == "-")
    want = [(1, "c", 2), (2, "y", 5)]
    assert table(spark, out) == want
    assert sorted((tuple(r) for r in jobs.sync_snapshot(spark, out, "k", schema).collect()), key=str) == want
    assert changelog.epochs(spark, out, changelog.version(spark, out)["through"]) == []


# ------------------------------------------------------------ time to live
ENTRY = "prefix string, key string, value string, created_at timestamp_ntz, ttl_minutes int"


def entry(key, value, minute, ttl_minutes):
    return ("p", key, value, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute), ttl_minutes)


def feed(spark, base, *batches):
    landing, out = os.path.join(base, "landing"), os.path.join(base, "out")
    schema = rows(spark, entry("a", "x", 0, 1), schema=ENTRY).schema
    for i, b in enumerate(batches):
        jobs.land(rows(spark, *b, schema=ENTRY).coalesce(1), os.path.join(landing, f"f{i}"))
        ttl.store_ttl_stream(spark, landing + "/*", out, os.path.join(base, "ck"), schema)
    return out, schema


def alive(spark, out, schema, as_of=None):
    return sorted((r["key"], r["value"]) for r in ttl.live_entries(spark, out, schema, as_of).collect())


def test_late_older_value_does_not_replace_or_prolong(spark, tmp_out):
    out, schema = feed(spark, tmp_out, [entry("a", "new", 100, 10), entry("b", "keep", 5, None), entry("c", "c", 99, 1)],
                       [entry("a", "old", 50, 1000), entry("d", "dead on arrival", 20, 5)])
    assert alive(spark, out, schema) == [("a", "new"), ("b", "keep")]
    later = dt.datetime(2024, 1, 1, 1, 50)
    assert alive(spark, out, schema, later) == [("b", "keep")]           # 110 minutes: expiry is not strict
    assert alive(spark, out, schema, later - dt.timedelta(milliseconds=1)) == [("a", "new"), ("b", "keep")]


def test_ttl_ties_and_sweep(spark, tmp_out):
    out, schema = feed(spark, tmp_out, [entry("a", "1", 10, 60), entry("a", "2", 10, 60), entry("z", "z", 1, 1)],
                       [entry("b", "b", 10, None)], [entry("a", "0", 10, 60)])
    assert alive(spark, out, schema) == [("a", "0"), ("b", "b")]
    ttl.sweep(spark, out, dt.datetime(2024, 1, 1, 1))
    assert alive(spark, out, schema) == [("a", "0"), ("b", "b")]
    assert changelog.read_latest(spark, out, ttl.KEY, schema).count() == 2


# ------------------------------------------------------------ maintained store
def experiences(spark):
    return d.experiences(Tables(spark, SF))


def dump(df):
    return sorted(map(tuple, df.select("thread_id", "seq", "memory_type", "observation", "access_count").collect()), key=str)


def parts(spark, n=3):
    e = experiences(spark)
    return e, [e.where(F.col("seq") % n == i) for i in range(n)]


def test_only_touched_buckets_are_written(spark, tmp_out):
    e = experiences(spark)
    threads = [r[0] for r in e.select("thread_id").distinct().orderBy("thread_id").limit(3).collect()]
    jobs.maintenance_step(spark, e, 0, tmp_out, e.schema, 10_000, buckets=16)
    first = jobs.store_state(spark, tmp_out, 1)["buckets"]
    extra = e.where(F.col("thread_id") == threads[0]).withColumn("seq", F.col("seq") + 10 ** 9)
    jobs.maintenance_step(spark, extra, 1, tmp_out, e.schema, 10_000, buckets=16)
    second = jobs.store_state(spark, tmp_out, 2)["buckets"]
    assert set(first.values()) == {0} and sorted(second.values()).count(1) == 1
    written = [n for n in os.listdir(os.path.join(tmp_out, "store", "epoch=000000000001")) if n.startswith("_bucket")]
    assert len(written) == 1 and second[written[0].split("=")[1]] == 1
    assert jobs.read_store(spark, tmp_out, e.schema).where("seq between 1000000000 and 1000000000000").count() > 0
    assert jobs.read_store(spark, tmp_out, e.schema, 1).where("seq between 1000000000 and 1000000000000").count() == 0


def test_retried_micro_batch_gives_the_same_store(spark, tmp_out):
    e, batches = parts(spark)
    for i, b in enumerate(batches):
        jobs.maintenance_step(spark, b, i, tmp_out, e.schema, 5)
    want = dump(jobs.read_store(spark, tmp_out, e.schema))
    jobs.maintenance_step(spark, batches[2], 2, tmp_out, e.schema, 5)
    assert dump(jobs.read_store(spark, tmp_out, e.schema)) == want


@pytest.mark.parametrize("lost", ["states/epoch=000000000001", "store/epoch=000000000000", "gate/epoch=000000000000"])
def test_a_lost_version_fails(spark, tmp_out, lost):
    e, batches = parts(spark, 2)
    jobs.maintenance_step(spark, batches[0], 0, tmp_out, e.schema, 5)
    path = os.path.join(tmp_out, lost)
    shutil.move(path, path + ".away")
    with pytest.raises(FileNotFoundError):
        jobs.maintenance_step(spark, batches[1], 1, tmp_out, e.schema, 5)


def test_stream_runs_go_on_from_the_stored_state(spark, tmp_out):
    e, batches = parts(spark, 2)
    landing, out, ck = (os.path.join(tmp_out, n) for n in ("landing", "out", "ck"))
    other = os.path.join(tmp_out, "steps")
    for i, b in enumerate(batches):
        jobs.land(b.coalesce(1), os.path.join(landing, f"f{i}"))
        jobs.maintenance_stream(spark, landing + "/*", out, ck, e.schema, 5)
        jobs.maintenance_step(spark, b, i, other, e.schema, 5)
    assert dump(jobs.read_store(spark, out, e.schema)) == dump(jobs.read_store(spark, other, e.schema))


# ------------------------------------------------------------ cycles and quota
def test_three_cycles_leave_one_summary_per_thread(spark):
    e = experiences(spark)
    times = [dt.datetime(2024, 2, 1) + dt.timedelta(days=30 * i) for i in range(3)]
    filler = lambda t: e.withColumns({"seq": F.col("seq") + int(t.timestamp()), "created_at": F.lit(t).cast("timestamp_ntz"),
                                      "last_accessed": F.lit(t).cast("timestamp_ntz"), "importance": F.lit(3)})
    store = e
    for t in times:
        store = summ.maintenance_cycles(store.unionByName(filler(t - dt.timedelta(days=20))), [t], 10_000)
        assert store.dtypes == e.dtypes
        n = store.where(F.array_contains("tags", "summary")).groupBy("thread_id").count()
        assert n.count() > 0 and n.where("count != 1").count() == 0
    assert store.where("seq is null or key is null").count() == 0


def test_lineage_names_every_replaced_row(spark):
    e = experiences(spark)
    store, lineage = summ.maintenance_cycle(e, 20)
    s = store.where(F.array_contains("tags", "summary")).select(
        "thread_id", "seq", F.col("outcome")["original_memory_count"].cast("long").alias("n"))
    got = lineage.groupBy("thread_id", "seq").count()
    assert sorted(map(tuple, s.collect())) == sorted(map(tuple, got.collect()))
    assert store.join(lineage.select("thread_id", F.col("replaces").alias("seq")), ["thread_id", "seq"]).count() == 0


def test_forget_ranks_equal_a_plain_ranking(spark, monkeypatch):
    from pyspark.sql import Window

    from memoria.operators import retention as ret
    e = experiences(spark)
    # one hot thread over many blocks, null seq, equal scores, threads below and above the quota
    hot = e.withColumn("thread_id", F.lit(77).cast("long"))
    odd = e.limit(5).withColumns({"thread_id": F.lit(77).cast("long"), "seq": F.lit(None).cast("long")})
    same = e.where("seq % 7 = 0").withColumns({"thread_id": F.lit(78).cast("long"), "created_at": F.lit("2024-01-01").cast("timestamp_ntz"),
                                               "last_accessed": F.lit("2024-01-01").cast("timestamp_ntz"), "memory_type": F.lit("fact"),
                                               "importance": F.lit(1), "access_count": F.lit(1)})
    rows_ = e.unionByName(hot).unionByName(odd.limit(1)).unionByName(same)
    w = Window.partitionBy("thread_id").orderBy(F.desc("forget_score"), F.asc("seq"))
    total = Window.partitionBy("thread_id")
    want = rows_.withColumn("quota", F.greatest(F.lit(0), F.count("*").over(total) - 20)).where("importance != 4") \
        .withColumn("forget_score", ret.forget_score()).withColumn("forget_rank", F.row_number().over(w)) \
        .where("forget_rank <= quota").select("thread_id", "seq", "forget_rank", "quota").collect()
    for block in (1, 16, 1 << 16):
        monkeypatch.setattr(ret, "SEQ_BLOCK", block)
        got = ret.forget_ranking(rows_, 20).select("thread_id", "seq", "forget_rank", "quota").collect()
        assert sorted(map(str, got)) == sorted(map(str, want))
