"""Conversation prefix trie against a plain trie."""
import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from memoria.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def rem(c, m):
    return c - m * int(c / m)


def rebuilt(rows):
    convs = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            convs[c].append(((t is not None, t or 0), r or "", x or ""))
    seq = {c: [(r, x) for _, r, x in sorted(v)] for c, v in convs.items()}
    out = {}
    for c in seq:
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = seq.get(c - rem(c, 5), [])[:h] + seq[c][h:]
    return out


def brute(rows):
    convs = rebuilt(rows)
    members = collections.defaultdict(list)
    for c, s in convs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    kids = collections.Counter(n[:-1] for n in members if n)
    val = {n: (len(m) - 1) * len(n[-1][1].encode()) if n else 0 for n, m in members.items()}
    out = []
    for n, m in members.items():
        below = [v for v in members if v[:len(n)] == n]
        ends = sorted(c for c in m if len(convs[c]) == len(n))
        out.append((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), kids[n],
                    sum(1 for v in below if not kids[v]), sum(val[v] for v in below),
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select(*trie.OUTPUT).collect()), key=str)


def frame(spark, rows, parts=3):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.repartition(parts) if rows else df


def talks(seed, n=60, texts=3, longest=11):
    """Conversations over few texts, so that many share prefixes or are equal."""
    rng = random.Random(seed)
    pool = [("user", "hi"), ("assistant", "é" * 5), ("user", ""), ("system", "long " * 40)][:texts + 1]
    rows = []
    for c in rng.sample(range(4 * n), n):
        for t in range(rng.randint(1, longest)):
            r, x = pool[min(int(rng.expovariate(1.2)), len(pool) - 1)]
            rows.append((c, t, r, x))
    return rows


@pytest.mark.parametrize("seed,texts", [(1, 1), (2, 3)])
def test_equals_plain_trie(spark, seed, texts):
    rows = talks(seed, texts=texts)
    assert got(trie.rebuilt_trie(frame(spark, rows))) == brute(rows)


def test_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 4)
    monkeypatch.setattr(trie, "ENDS_PER_CHUNK", 3)
    rows = talks(3, n=25)
    rows += [(None, 1, "user", "x"), (900, None, None, None), (900, None, "user", None), (900, 1, None, "t"),
             (901, 1, "user", "twin"), (901, 1, "user", "twin"), (901, 1, "system", "twin"), (-7, 0, "user", "neg"),
             (-7, 1, "user", "neg"), (-5, 0, "user", "base"), (1001, 0, "user", "no head")]
    rows += [(1200 + k, t, "user", "same") for k in range(30) for t in range(9)]
    rows += [(1300, t, "user", f"turn {t % 3}") for t in range(70)] + [(1301, 0, "user", "y" * 100_000)]
    df = frame(spark, rows)
    for c in ("depth", "pos", "ka", "h", "base", "bytes", "len", "rep", "_row", "owner", "weight"):
        df = df.withColumn(c, F.lit("clash"))
    assert got(trie.rebuilt_trie(df)) == brute(rows)


def test_turnless_only_and_empty(spark):
    rows = [(1001, 0, "user", "gone"), (1002, 0, "user", "gone too")]
    assert {len(s) for s in rebuilt(rows).values()} == {0}
    assert got(trie.rebuilt_trie(frame(spark, rows))) == brute(rows)
    assert trie.rebuilt_trie(frame(spark, [])).count() == 0


def test_rebuilt_texts_and_node_texts(spark):
    rows = talks(4, n=20)
    turns, convs = trie.rebuild(frame(spark, rows))
    want = rebuilt(rows)
    flat = sorted((c, i + 1, r, x) for c, s in want.items() for i, (r, x) in enumerate(s))
    assert sorted(tuple(r) for r in turns.select("conv_id", "depth", "role", "text").collect()) == flat
    assert {r[0] for r in convs.collect()} == set(want)
    shown = trie.node_texts(trie.rebuilt_trie(frame(spark, rows)), turns).collect()
    assert len(shown) == len(brute(rows))
    for r in shown:
        assert (r["role"], r["text"]) == (want[r["conv_id"]][r["depth"] - 1] if r["depth"] else (None, None))
