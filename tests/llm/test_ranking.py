"""Pairwise quality ranking: features and sums against plain versions, decisions on held-out documents."""
import collections
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from memoria.llm import ranking

from .data import DOC_SCHEMA, documents, prose

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def plain_sums(raw):
    words = WORD.findall(raw)
    low = lambda w: any(97 <= c < 123 for c in w)
    caps = lambda w: sum(65 <= c < 91 for c in w)
    lines = raw.split(b"\n")
    blocks = [words[i:i + ranking.BLOCK_WORDS] for i in range(0, len(words), ranking.BLOCK_WORDS)]
    lag = [sum(words[i] == words[i - k] for i in range(k, len(words))) for k in (1, 2, 3)]
    return [len(words), sum(map(len, words)), *lag, sum(len(set(b)) for b in blocks),
            sum(caps(w) > 1 and not low(w) for w in words), len(lines),
            sum(a == b for a, b in zip(lines, lines[1:])), sum(len(w) > 30 for w in words)]


def test_sums_equal_plain_counts():
    texts = [(r[1] or "").encode() for r in documents()] + [b"same\nsame\nSAME", b"\n\n", b"AB AB ab", b"x " * 300]
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    seg = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    got = ranking._sums(data, seg, len(texts))
    for t, row in zip(texts, got):
        hist = collections.Counter(t + b"\n")
        assert [row[b] for b in range(256)] == [hist[b] for b in range(256)]
        assert row[256:].tolist() == plain_sums(t)


def test_segments_hold_every_byte_between_separators():
    raw = (b"word " * 1000) + b"z" * 400 + b" end"
    parts = list(ranking._segments(raw, 50))
    assert b" ".join(parts) == raw
    assert list(ranking._segments(b"", 50)) == [b""] and list(ranking._segments(b"q" * 300, 50))[0] == b"q" * 300


def corpus(n=400, seed=5):
    """Prose, and three kinds of junk that no single count tells from it."""
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        t, good = prose(rng, rng.randint(20, 200)), 1
        kind = rng.random()
        if kind < 0.08:
            t, good = " ".join(w for w in t.split() for _ in range(4)), 0
        elif kind < 0.16:
            t, good = " ".join(w + "###" for w in t.split()), 0
        elif kind < 0.24:
            t, good = t.upper() + "!!", 0
        docs.append((i, t, "en", "src", len(t)))
        if rng.random() < 0.8:
            labels.append((i, good, 0))
    return docs, labels


def frames(spark, docs, labels):
    return (spark.createDataFrame(docs, DOC_SCHEMA).repartition(3),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_held_out_documents_are_decided(spark):
    docs, labels = corpus()
    truth = {i: int(not (re.search("###|!!", t) or re.search(r"(\S+) \1 \1 \1", t))) for i, t, *_ in docs}
    got = ranking.quality_scores(*frames(spark, docs, labels)).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97


def test_labels_of_held_out_documents_change_nothing(spark):
    docs, labels = corpus(200)
    swapped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q, 1) for i, q, _ in labels]
    a, b = (sorted(ranking.quality_scores(*frames(spark, docs, x)).collect()) for x in (labels, swapped))
    assert [(r["doc_id"], r["predicted"]) for r in a] == [(r["doc_id"], r["predicted"]) for r in b]
    assert np.allclose([r["score"] for r in a], [r["score"] for r in b], atol=1e-6)


@pytest.mark.parametrize("n_good,n_bad", [(40, 6), (7, 30), (5, 1)])
def test_preference_pairs_are_dealt_evenly(spark, monkeypatch, n_good, n_bad):
    monkeypatch.setattr(ranking, "PARTNERS", 8)
    rows = [(True, [float(i), 1.0]) for i in range(n_good)] + [(False, [1000.0 * (i + 1), 0.0]) for i in range(n_bad)]
    labelled = spark.createDataFrame(rows, "good boolean, f array<float>").withColumn("doc_id", F.lit(1))
    pairs = ranking.preferences(labelled.repartition(3))
    d = [r["d"] for r in pairs.collect()]
    assert len(d) == ranking.PAIRS * max(n_good, n_bad) and all(x[1] == 1.0 for x in d)
    met = collections.Counter((x[0] % 1000, (x[0] - x[0] % 1000)) for x in d)
    good, bad = collections.Counter(), collections.Counter()
    for (g, b), n in met.items():
        good[g] += n
        bad[b] += n
    assert len(good) == n_good and len(bad) == n_bad
    for c in (good, bad):
        assert max(c.values()) - min(c.values()) <= 1


def test_fit_reaches_the_least_loss(spark, monkeypatch):
    monkeypatch.setattr(ranking, "N_FEATURES", 3)
    rng = np.random.default_rng(1)
    d = rng.normal(size=(600, 3)).astype(np.float32) + np.array([0.5, -0.2, 0.0], np.float32)
    pairs = spark.createDataFrame([(x.tolist(),) for x in d], "d array<float>").repartition(4)
    w = ranking.fit(pairs)
    spread = np.sqrt((d.astype(float) ** 2).mean(axis=0))
    x, v = d / spread, w * spread
    grad = x.T @ (1 / (1 + np.exp(x @ v))) - ranking.RIDGE * len(x) * v
    assert np.abs(grad).max() < 1e-2 and w[0] > 0 > w[1]


def test_awkward_rows(spark):
    docs, labels = corpus(150)
    docs += [r for r in documents() if r[0] is None or r[0] >= 150] + [
        (None, None, None, None, None), (7, docs[7][1], "en", "src", 1), (900, "w" * 700_000 + " end", "en", "s", 1),
        (901, "many words " * 120_000, "en", "s", 1)]
    labels += [(None, 1, 0), (3, None, 0), (5, 0, None), (5, 1, None), (99999, 1, 0)]
    d, la = frames(spark, docs, labels)
    for c in ("f", "good", "score", "held_out", "words", "_salt", "quality"):
        d = d.withColumn(c, F.lit("clash"))
    la = la.withColumn("text", F.lit("clash")).withColumn("f", F.lit("clash"))
    got = ranking.quality_scores(d, la).collect()
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(r[0] for r in docs)
    empty = {r["score"] for r in got if r["doc_id"] in (150, 151, 152)}
    assert len(empty) == 1 and 0 <= empty.pop() <= 1


def test_copied_labels_are_not_broadcast(spark, monkeypatch, tmp_out):
    docs, labels = corpus(60)
    d, la = frames(spark, docs, labels)
    la.coalesce(1).write.parquet(f"{tmp_out}/labels")      # small files are broadcast, the copies of their rows must not be
    plans, real = {}, ranking.materialize
    monkeypatch.setattr(ranking, "materialize", lambda df, tag: plans.update(
        {tag: df._jdf.queryExecution().executedPlan().toString()}) or real(df, tag))
    got = ranking.quality_scores(d, spark.read.parquet(f"{tmp_out}/labels"))
    assert got.count() == len(docs)
    assert "SortMergeJoin" in plans["train"] and "Broadcast" not in plans["train"]


def test_empty_tables_and_one_class(spark):
    docs, labels = corpus(60)
    d, la = frames(spark, docs, labels)
    assert ranking.quality_scores(d.limit(0), la).count() == 0
    for labelled in (la.limit(0), la.where("quality = 1")):
        got = ranking.quality_scores(d, labelled).collect()
        assert len(got) == len(docs) and {r["score"] for r in got} == {1.0}
