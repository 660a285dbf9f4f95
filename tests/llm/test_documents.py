"""Document operators against brute force on a small table with every awkward case."""
import collections
import hashlib
import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from memoria.llm import lm, mixing, neardup, packing, quality, repeats

from .data import clashing, documents, frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ROWS = documents()


def words(t):
    return WORD.findall(t or "")


def key(d):
    return -1 if d is None else d


# quality ---------------------------------------------------------------------------------------

def measure(t):
    t = t or ""
    w = words(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    hit = {i + j for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for j in range(5)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit))


def test_quality_counts(spark):
    got = quality.quality_rules(frame(spark)).collect()
    assert len(got) == len(ROWS)
    want = collections.Counter((r[0], *measure(r[1])) for r in ROWS)
    assert collections.Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"],
                                r["n_repeat_words"]) for r in got) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert set(range(40)) <= kept and not kept & {150, 151, 152, 153, 156, 161, 163}


def test_quality_host_verdict_tightens_the_limit(spark):
    good = " ".join(f"plain{i}" for i in range(40))
    soft = good + " #### "            # 4 symbols on 41 words: above the soft limit, below the hard one
    soft = soft.replace("####", "##")  # 2 on 41 words
    rows = [(i, soft, "en", "bad", 1) for i in range(30)] + [(100 + i, good, "en", "good", 1) for i in range(60)]
    rows += [(200, soft, "en", "good", 1), (201, good, "en", "bad", 1)]
    got = {r["doc_id"]: r for r in quality.quality_rules(frame(spark, rows)).collect()}
    assert got[0]["host_strict"] == ["symbols"] and not got[0]["kept"]
    assert got[200]["kept"] and got[201]["kept"] and got[100]["kept"]


def test_quality_shrinks_small_hosts(spark):
    soft = " ".join(f"plain{i}" for i in range(40)) + " ##"
    good = " ".join(f"plain{i}" for i in range(40))
    rows = [(i, good, "en", f"h{i % 20}", 1) for i in range(400)] + [(900, soft, "en", "tiny", 1)]
    got = {r["doc_id"]: r for r in quality.quality_rules(frame(spark, rows)).collect()}
    assert got[900]["kept"] and got[900]["host_strict"] == []


# mixing ----------------------------------------------------------------------------------------

def brute_targets(sizes, share=1.5):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target = {s: 0.0 for s in order}
    left, live = share * sum(sizes.values()), set(order)
    while live and left > 1e-9:
        total = sum(weight[s] for s in live)
        gain = {s: left * weight[s] / total for s in live}
        left = 0.0
        for s in list(live):
            target[s] += gain[s]
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                live.discard(s)
    return target


@pytest.mark.parametrize("rows", [ROWS, [(i, "w " * (i + 1), "en", f"s{i % 7}", 1) for i in range(300)]])
def test_mix_meets_targets(spark, rows):
    got = mixing.entropy_mix(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    want = brute_targets(sizes)
    taken = collections.Counter()
    largest = collections.Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert math.isclose(r["target"], want[r["source"]], rel_tol=1e-9, abs_tol=1e-6)
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(1, 0.02 * want[s], 0.5 * largest[s] if len(rows) < 100 else 0)
    again = mixing.entropy_mix(frame(spark, rows, 3)).collect()
    assert collections.Counter(map(tuple, again)) == collections.Counter(map(tuple, got))


def test_mix_solution_is_exponentially_tilted(spark):
    rows = [(i, "w " * (1 + i % 50), "en", "ab"[i % 2], 1) for i in range(400)]
    got = [r for r in mixing.entropy_mix(frame(spark, rows)).collect() if 0 < r["rate"] < 2]
    for s in "ab":
        slopes = {round(math.log(r["rate"]) / r["size"], 5) for r in got if r["source"] == s}
        assert not slopes or max(slopes) - min(slopes) < 1e-4


def test_mix_rows_repeated(spark):
    docs = frame(spark)
    taken = collections.Counter()
    for r in mixing.entropy_mix(docs).collect():
        if r["size"]:
            taken[r["source"]] += r["taken"]
    rows = mixing.repeat_rows(clashing(docs))
    assert rows.columns == clashing(docs).columns
    got = collections.Counter()
    for r in rows.collect():
        got[r["source"]] += len(words(r["text"]))
    for s in taken:
        assert abs(got[s] - taken[s]) <= 0.02 * taken[s] + 200


# near-duplicates -------------------------------------------------------------------------------

def bag(t):
    w = words(t)
    if not w:
        return None
    return collections.Counter([tuple(w)] if len(w) < 5 else [tuple(w[i:i + 5]) for i in range(len(w) - 4)])


def brute_classes(rows):
    bags = [bag(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = (rows[i][1] or "") == (rows[j][1] or "")
            if not same and bags[i] and bags[j]:
                both = sum((bags[i] & bags[j]).values())
                same = 10 * both >= 8 * sum((bags[i] | bags[j]).values())
            if same:
                parent[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    return collections.Counter((d, min(g, key=key)) for g in groups.values() for d in g)


def test_near_duplicates_equal_brute_force(spark):
    got = neardup.classes(frame(spark)).collect()
    assert collections.Counter((r["doc_id"], r["class"]) for r in got) == brute_classes(ROWS)


def test_near_duplicates_chain_and_large_group(spark):
    import random
    rng = random.Random(3)
    w = [f"t{i}" for i in range(200)]
    rows, cur = [], list(w)
    for i in range(40):                       # a chain: ends are unlike, neighbours alike
        cur[(i * 5) % 200] = f"c{i}"
        rows.append((i, " ".join(cur), "en", "s", 1))
    for i in range(150):                      # one base, each copy with its own edits
        v = list(w[::-1])
        v[rng.randrange(200)] = f"e{i}"
        rows.append((1000 + i, " ".join(v), "en", "s", 1))
    got = neardup.classes(frame(spark, rows)).collect()
    assert collections.Counter((r["doc_id"], r["class"]) for r in got) == brute_classes(rows)


def edited_copies(n, seed=5):
    """One text, its copies with 0 to 12 edits each, some of them edited once more: many pairs near 0.8."""
    import random
    rng = random.Random(seed)
    w = [f"t{i % 190}" for i in range(200)]
    rows = []
    for i in range(n):
        v = list(w)
        for _ in range(rng.randrange(13)):
            v[rng.randrange(200)] = f"e{rng.randrange(40)}"
        rows.append((i, " ".join(v), "en", "s", 1))
        if i % 7 == 0:
            v[rng.randrange(200)] = f"f{i}"
            rows.append((n + i, " ".join(v + ["tail"] * (i % 30)), "en", "s", 1))
    return rows


def test_near_duplicates_large_open_buckets(spark):
    rows = edited_copies(220)
    want = brute_classes(rows)
    assert len({c for _, c in want}) > 20          # buckets stay open after the centres
    got = neardup.classes(frame(spark, rows)).collect()
    assert collections.Counter((r["doc_id"], r["class"]) for r in got) == want


def test_rare_shingles_lose_no_link(spark):
    import numpy as np
    import pyspark.sql.functions as F
    rows = edited_copies(120)
    texts = sorted({r[1] for r in rows})
    doc, sh, times = neardup.shingle_bags([t.encode() for t in texts])
    cut = np.searchsorted(doc, np.arange(len(texts) + 1))
    bags = spark.createDataFrame(
        [(str(i).encode(), sh[x:y].astype("<u8").tobytes(), times[x:y].astype("<i8").tobytes())
         for i, (x, y) in enumerate(zip(cut[:-1], cut[1:]))], "node binary, shingles binary, times binary")
    got = {frozenset((int(r["a"]), int(r["b"]))) for r in neardup._rare_pairs(
        bags.select("node", F.col("node").alias("label")), bags, 8, 10).collect()}
    own = [bag(t) for t in texts]
    want = {frozenset((i, j)) for i in range(len(texts)) for j in range(i)
            if 10 * sum((own[i] & own[j]).values()) >= 8 * sum((own[i] | own[j]).values())}
    assert want and want <= got
    assert len(got) < len(texts) * (len(texts) - 1) // 2


def test_weighted_similarity_estimate(spark):
    import numpy as np
    rng = np.random.default_rng(1)
    sh = rng.integers(1, 2 ** 63, 300, dtype=np.uint64)
    a, b = rng.integers(1, 9, 300), rng.integers(1, 9, 300)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    agree = []
    for k in range(40):
        s = neardup.mix(sh ^ np.uint64(k * 7919))
        order = np.argsort(s)
        sig = neardup.signatures(np.repeat([0, 1], 300), np.concatenate([s[order], s[order]]),
                                 np.concatenate([a[order], b[order]]), 2)
        agree.append((sig[0] == sig[1]).mean())
    assert abs(np.mean(agree) - true) < 0.02


def test_keep_one(spark):
    docs = clashing(frame(spark))
    got = neardup.keep_one(docs)
    assert got.columns == docs.columns
    heads = {c for _, c in brute_classes(ROWS)}
    assert sorted((key(r["doc_id"]) for r in got.collect())) == sorted(map(key, heads))


# repeated passages -----------------------------------------------------------------------------

def brute_repeats(rows, w=100):
    order = sorted({(key(d), (t or "")): None for d, t, *_ in rows})
    seen, out = set(), {}
    for d, t in order:
        raw = t.encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - w + 1):
            s = raw[p:p + w]
            if s in seen:
                gone[p:p + w] = b"\x01" * w
            seen.add(s)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        kept = bytes(x for x, g in zip(raw, gone) if not g)
        out[d, t] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_repeats_equal_brute_force(spark):
    got = repeats.repeated_bytes(clashing(frame(spark))).collect()
    want = brute_repeats(ROWS)
    assert collections.Counter(tuple(r) for r in got) == collections.Counter(
        (r[0], *want[key(r[0]), r[1] or ""]) for r in ROWS)
    assert any(r["n_spans"] > 0 and r["n_removed"] < r["n_bytes"] for r in got)


def test_strip_repeats_keeps_columns(spark):
    docs = clashing(frame(spark))
    got = repeats.strip_repeats(docs)
    assert got.columns == docs.columns
    want = brute_repeats(ROWS)
    for r in got.collect():
        assert r["text"] is None or len(r["text"]) == r["n_chars"] or r["n_chars"] is None
    left = collections.Counter(r["doc_id"] for r in got.collect())
    gone = [r[0] for r in ROWS if want[key(r[0]), r[1] or ""][1] and
            want[key(r[0]), r[1] or ""][1] == want[key(r[0]), r[1] or ""][0]]
    assert not set(gone) & set(left)


# lattice scores --------------------------------------------------------------------------------

def low(t):
    return "".join(c.lower() if c.isascii() else c for c in (t or ""))


def test_lattice_scores(spark):
    got = lm.lattice_scores(clashing(frame(spark)), chunk_bytes=3000).collect()
    assert len(got) == len(ROWS)
    held = {r[0]: zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5 == 1 for r in ROWS}
    c = collections.Counter()
    for r in ROWS:
        if not held[r[0]]:
            c.update(words(low(r[1])) + ["</s>"])
    n, v = sum(c.values()), len(c)
    want = collections.Counter()
    for r in ROWS:
        tokens = words(low(r[1])) + ["</s>"]
        base = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in tokens)
        want[r[0], held[r[0]], len(tokens), sum(c[x] > 0 for x in tokens), n, round(base, 6)] += 1
    assert collections.Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"],
                                round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    # a small chunk size changes nothing
    once = lm.lattice_scores(frame(spark)).collect()
    assert collections.Counter((r["doc_id"], round(r["score"], 6)) for r in got) == collections.Counter(
        (r["doc_id"], round(r["score"], 6)) for r in once)


def test_forward_sums_all_segmentations():
    import numpy as np
    lat = lm.lattice(lm.vocabulary_path())
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=lm.vocabulary_path())
    lp = lat.prior
    for w in ["the", "inan", "thés", "日本x", "a"]:
        t = "▁" + w

        def total(i):
            if i == len(t):
                return 1.0
            out = 0.0
            for k in range(1, len(t) - i + 1):
                piece = sp.piece_to_id(t[i:i + k])
                if piece != sp.unk_id() and not sp.is_byte(piece):
                    out += math.exp(lp[piece]) * total(i + k)
                elif k == 1:
                    out += math.exp(sum(lp[lat.byte[x]] for x in t[i].encode())) * total(i + 1)
            return out

        assert math.isclose(lat.log_prob([w.encode()], lp)[0], math.log(total(0)), rel_tol=1e-9)
    a = lat.expected([b"the", b"inan"], np.array([2.0, 1.0]), lp)
    assert a.sum() >= 3


def test_lattice_learns(spark):
    """Fitted pieces give held-out texts a higher likelihood than the vocabulary's own scores."""
    fitted = lm.lattice_scores(frame(spark), rounds=2).where("held_out").collect()
    prior = lm.lattice_scores(frame(spark), rounds=0).where("held_out").collect()
    words_only = [(f["score"], p["score"]) for f, p in zip(sorted(fitted), sorted(prior)) if f["n_tokens"] > 20]
    assert words_only and sum(f for f, _ in words_only) > sum(p for _, p in words_only)


# packing ---------------------------------------------------------------------------------------

def test_packing_round_trip(spark):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(packing.vocabulary_path())
    got = packing.pack(clashing(frame(spark))).collect()
    by_doc = collections.defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
    for d in {r[0] for r in ROWS}:
        texts = [r[1] or "" for r in ROWS if r[0] == d]
        ids = tok.encode(texts[0], add_special_tokens=False).ids + [1]
        pieces = sorted(by_doc[d], key=lambda r: r["start"])
        assert sum(p["length"] for p in pieces) == len(ids) * len(texts)
        for p in pieces:
            part = ids[p["start"]:p["start"] + p["length"]]
            raw = b"".join(x.to_bytes(4, "little") for x in part)
            assert p["ids_crc32"] == zlib.crc32(raw) and p["doc_tokens"] == len(ids)
    used = collections.defaultdict(list)
    for r in got:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in used.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= packing.WINDOW
    total = sum(r["length"] for r in got)
    assert len(used) <= total / packing.WINDOW + 2


def test_long_words_are_swept_exactly(monkeypatch):
    import random
    import time

    import numpy as np
    lat = lm.lattice(lm.vocabulary_path())
    rng = random.Random(3)
    marks = "abcdefghitheingtion" * 3 + "éßñ日本語ключ\U0001f600\x01"
    words_ = ["".join(rng.choice(marks) for _ in range(rng.randint(1, 120))).encode() for _ in range(40)]
    n = np.array([rng.randint(0, 5) for _ in words_])
    want, counts = lat.log_prob(words_, lat.prior), lat.expected(words_, n, lat.prior)
    monkeypatch.setattr(lm, "LONG_WORD", 0)
    for block in (7, 1 << 16):
        monkeypatch.setattr(lm, "SWEEP", block)
        assert np.allclose(lat.log_prob(words_, lat.prior), want, rtol=1e-9)
        assert np.allclose(lat.expected(words_, n, lat.prior), counts, rtol=1e-6, atol=1e-9)
    began = time.process_time()
    long = "".join(rng.choice(marks) for _ in range(1_000_000)).encode()
    assert lat.log_prob([long], lat.prior)[0] < -1e6 and time.process_time() - began < 30


def test_encoder_equals_tokenizer():
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(packing.vocabulary_path())
    enc = packing.WordEncoder(packing.vocabulary_path())
    texts = [r[1] or "" for r in ROWS] + ["it's they'll İstanbul éa x́!", "a b\x1cc", "don't!!! 3,4",
                                          "<|endoftext|> x", "ǅ ſ ß", "word́. next"]
    for t in texts:
        assert enc.encode(t).tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_encoder_on_random_texts_in_small_segments(monkeypatch):
    import random

    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(packing.vocabulary_path())
    monkeypatch.setattr(packing.WordEncoder, "SEGMENT_BYTES", 40)
    monkeypatch.setattr(packing.WordEncoder, "MAX_PARTS", 150)
    enc = packing.WordEncoder(packing.vocabulary_path())
    rng = random.Random(11)
    signs = "abcXYZéÉßñÑ×÷İıŁłſŒªº0123.,!?'\"()-_[]{}$€£日本語ключ \t\n\x0b\x0c\r\x1c\x85\xa0\u2028\u3000\U0001f600"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 90))) for _ in range(600)]
    texts += ["word" * 100 + ".", "?" * 90, "É" * 70 + "!!", ""]
    for at in range(0, len(texts), 50):
        some = texts[at:at + 50]
        for t, ids in zip(some, enc.encode_many([t.encode() for t in some])):
            assert ids.tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_equal_rows_are_spread_over_bins(spark):
    rows = [(None, "equal text", "en", "s", 10)] * 20_000
    got = packing.pack(frame(spark, rows), pieces_per_bin=8192)
    bins = got.withColumn("bin", F.shiftright("sequence_id", 32)).groupBy("bin").count().collect()
    assert len(bins) == 3 and sum(r["count"] for r in bins) == 20_000 and max(r["count"] for r in bins) < 8192
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_best_fit_takes_the_tightest_window():
    import random
    rng = random.Random(5)
    lengths = sorted((rng.randint(1, 100) for _ in range(400)), reverse=True)
    at, offset = packing.best_fit_decreasing(lengths, 100)
    room = []
    for n, w, o in zip(lengths, at, offset):
        fits = [r for r in room if r >= n]
        if fits:
            assert room[w] == min(fits) and o == 100 - room[w]
        else:
            assert w == len(room) and o == 0
            room.append(100)
        room[w] -= n


# empty tables ----------------------------------------------------------------------------------

@pytest.mark.parametrize("run", [quality.quality_rules, mixing.entropy_mix, neardup.classes, lm.lattice_scores,
                                 repeats.repeated_bytes, packing.pack, quality.keep_good, neardup.keep_one,
                                 repeats.strip_repeats, mixing.repeat_rows])
def test_empty_table(spark, run):
    assert run(frame(spark, [])).count() == 0
