"""The corpus pipeline on the smallest tables, stage by stage against brute force."""
import collections
import zlib

import corpus_pipeline
from memoria.llm import packing
from memoria.llm.common import materialize

from .test_documents import brute_classes, brute_repeats, brute_targets, key, measure, words

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in df.collect()]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF), "test")
        assert docs.columns == columns, name
        kept.append(rows_of(docs))
    start = rows_of(spark.read.parquet(f"{SF}/documents.parquet"))
    good, single, cut, mixed = kept

    # rules: rows unchanged, none that fails the base, none that is plain prose missing
    assert not collections.Counter(good) - collections.Counter(start)
    assert all(measure(r[1])[0] >= 10 and 100 * measure(r[1])[4] <= 20 * measure(r[1])[0] for r in good)
    ids = {r[0] for r in good}
    for r in start:
        n, chars, symbols, dup, rep = measure(r[1])
        plain = n >= 20 and not symbols and not dup and not rep and "!!" not in r[1]
        assert not plain or r[0] in ids

    # near-duplicates: one row of each class, that of its smallest id
    assert not collections.Counter(single) - collections.Counter(good)
    assert {r[0] for r in single} == {c for _, c in brute_classes(good)}

    # passages: what brute force leaves
    want = brute_repeats(single)
    by_id = {r[0]: r for r in cut}
    for r in single:
        size, gone, _, _ = want[key(r[0]), r[1]]
        assert (r[0] in by_id) == (gone < size)
        if not gone:
            assert by_id[r[0]] == r
        elif gone < size:
            assert by_id[r[0]][4] == len(by_id[r[0]][1])

    # mixing: whole rows, twice at most, near the targets
    times = collections.Counter(mixed)
    assert max(times.values()) <= 2 and set(times) <= set(cut)
    sizes, taken = collections.Counter(), collections.Counter()
    for r in cut:
        sizes[r[3]] += len(words(r[1]))
    for r in mixed:
        taken[r[3]] += len(words(r[1]))
    for s, t in brute_targets(sizes).items():
        longest = max(len(words(r[1])) for r in cut if r[3] == s)
        assert abs(taken[s] - t) <= max(0.02 * t, longest)

    # packing: every id of every row once, in gapless sequences
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    enc = packing.WordEncoder(packing.vocabulary_path())
    pieces = collections.Counter()
    for r in mixed:
        ids = enc.encode(r[1]).tolist() + [1]
        for at in range(0, len(ids), 2048):
            part = ids[at:at + 2048]
            pieces[r[0], at, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))] += 1
    assert pieces == collections.Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in packed)
    used = collections.defaultdict(list)
    for r in packed:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in used.values():
        spans.sort()
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:i]) for i in range(len(spans))]
        assert sum(n for _, n in spans) <= 2048


def test_awkward_and_empty_tables(spark):
    """Nulls, empty texts, repeated rows and clashing columns pass all stages; so does a table without rows."""
    from .data import clashing, frame
    docs = frame(spark)
    for table in (clashing(docs), docs.limit(0)):
        columns, at = table.columns, table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            at = materialize(stage(spark, at, SF), "test")
            assert at.columns == columns, name
        packed = corpus_pipeline.STAGES[-1][1](spark, at, SF)
        ids = {r["doc_id"] for r in packed.collect()}
        assert ids == {r["doc_id"] for r in at.collect()}
    assert not ids
