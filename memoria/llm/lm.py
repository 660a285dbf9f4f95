"""Language-model scores of documents by a subword lattice.

The pieces are those of an existing public vocabulary; a word is written as
``\\u2581`` + word, and its probability is the sum over all ways to segment it
of the product of the pieces' probabilities, found by a forward recursion in
log space. A text's probability is the product over its words and one end.
Piece probabilities start from the vocabulary's own scores (its order of rank)
and are fitted to the training words by expectation maximisation over the same
lattices. Recursions run over the distinct words of the corpus, many words of
one length at a time.

Texts are tokenised once, into chunks of bounded size that hold word numbers;
only the distinct words of a chunk are shuffled to the corpus vocabulary and
their scores shuffled back to the chunk.
"""
from __future__ import annotations

import itertools
import math
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, text_or_empty

CHUNK_BYTES = 12_000_000
EM_ROUNDS = 2
PIECE_SMOOTHING = 0.5
MAX_PIECE = 16
# longer words are swept one by one, in blocks of positions
LONG_WORD = 400
SWEEP = 1 << 16
# steps of a sweep between two scalings: a step shrinks the sums by less than e^-60
RESCALE = 8
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BASE = np.uint64(0x9E3779B97F4A7C15)

CHUNK_SCHEMA = ("chunk long, doc_ids array<long>, held array<boolean>, n_words binary, tokens binary, "
                "words array<binary>, train binary")


def vocabulary_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def is_held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1


def _chunks(limit: int):
    """Rows of (doc_id, text) to chunks: per document word numbers, per chunk its distinct words."""
    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0

        def close():
            nonlocal seq
            held = [is_held_out(d) for d in doc_ids]
            lens = np.fromiter(map(len, tokens), np.int64, len(tokens))
            flat = np.concatenate(tokens) if tokens else np.zeros(0, np.int32)
            trained = flat[np.repeat(~np.array(held, dtype=bool), lens)]
            counts = np.bincount(trained, minlength=len(number))
            row = [pa.array([part << 32 | seq], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())),
                   pa.array([held], pa.list_(pa.bool_())), pa.array([lens.astype("<i8").tobytes()], pa.binary()),
                   pa.array([flat.astype("<i4").tobytes()], pa.binary()),
                   pa.array([list(number)], pa.list_(pa.binary())),
                   pa.array([counts.astype("<i8").tobytes()], pa.binary())]
            seq += 1
            return pa.RecordBatch.from_arrays(row, ["chunk", "doc_ids", "held", "n_words", "tokens", "words", "train"])

        doc_ids, tokens, size = [], [], 0
        number: dict = defaultdict(itertools.count().__next__)
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                raw = text.as_py().encode().translate(_LOWER)
                doc_ids.append(doc_id)
                # bytes.split() cuts at exactly the six ASCII separators
                tokens.append(np.fromiter(map(number.__getitem__, raw.split()), np.int32))
                size += len(raw)
                if size >= limit:
                    yield close()
                    doc_ids, tokens, size = [], [], 0
                    number = defaultdict(itertools.count().__next__)
        if doc_ids:
            yield close()
    return run


def _explode_words(batches):
    """(chunk, wid, word, n) of the distinct words of every chunk."""
    for b in batches:
        for i in range(b.num_rows):
            words = b.column("words")[i].values
            n = np.frombuffer(b.column("train")[i].as_py(), "<i8")
            chunk = np.full(len(words), b.column("chunk")[i].as_py(), np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(chunk), pa.array(np.arange(len(words), dtype=np.int32)), words, pa.array(n)],
                ["chunk", "wid", "word", "n"])


class Lattice:
    """The pieces of a SentencePiece vocabulary, and sums over segmentations of many words at once."""

    def __init__(self, path: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.n = sp.get_piece_size()
        hashes, ids = [], []
        self.byte = np.full(256, -1, dtype=np.int64)
        rank = np.full(self.n, float(self.n))
        for i in range(self.n):
            piece, score = sp.id_to_piece(i), sp.get_score(i)
            if sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                hashes.append(self._hash(piece))
                ids.append(i)
                rank[i] = min(1.0 - score, float(self.n))
        order = np.argsort(np.array(hashes, dtype=np.uint64))
        self.hashes = np.array(hashes, dtype=np.uint64)[order]
        self.ids = np.array(ids, dtype=np.int64)[order]
        # the scores of the vocabulary are ranks; Zipf's law turns them into probabilities
        prior = 1.0 / (rank + 2.0)
        self.prior = np.log(prior / prior.sum())

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def find(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.ids[at], -1)

    def edges(self, points: np.ndarray):
        """For words of one length as code points (n, L): list of (start, length, piece ids, rows)."""
        n, size = points.shape
        out = []
        h = np.zeros((n, size), dtype=np.uint64)
        p1 = points.astype(np.uint64) + np.uint64(1)
        for k in range(1, min(MAX_PIECE, size) + 1):
            m = size - k + 1
            h = h[:, :m] * _BASE + p1[:, k - 1:]
            ids = self.find(h)
            for i in range(m):
                rows = np.flatnonzero(ids[:, i] >= 0)
                if len(rows):
                    out.append((i, k, ids[rows, i], rows))
            if k == 1:
                single = ids
        # characters without a piece of their own are spelled in bytes
        spelled = []
        for r, i in zip(*np.nonzero(single < 0)):
            spelled.append((int(i), int(r), self.byte[list(chr(points[r, i]).encode("utf-8", "surrogatepass"))]))
        return out, spelled

    def forward(self, edges, spelled, n: int, size: int, lp: np.ndarray) -> np.ndarray:
        """Log of the summed probability of all segmentations of every prefix, (n, size + 1)."""
        alpha = np.full((n, size + 1), -np.inf)
        alpha[:, 0] = 0.0
        by_end, bytes_at = defaultdict(list), defaultdict(list)
        for e in edges:
            by_end[e[0] + e[1]].append(e)
        for s in spelled:
            bytes_at[s[0] + 1].append(s)
        for j in range(1, size + 1):
            for i, _, ids, rows in by_end[j]:
                alpha[rows, j] = np.logaddexp(alpha[rows, j], alpha[rows, i] + lp[ids])
            for i, r, b in bytes_at[j]:
                alpha[r, j] = np.logaddexp(alpha[r, j], alpha[r, i] + lp[b].sum())
        return alpha

    def backward(self, edges, spelled, n: int, size: int, lp: np.ndarray) -> np.ndarray:
        beta = np.full((n, size + 1), -np.inf)
        beta[:, size] = 0.0
        by_start, bytes_at = defaultdict(list), defaultdict(list)
        for e in edges:
            by_start[e[0]].append(e)
        for s in spelled:
            bytes_at[s[0]].append(s)
        for i in range(size - 1, -1, -1):
            for _, k, ids, rows in by_start[i]:
                beta[rows, i] = np.logaddexp(beta[rows, i], beta[rows, i + k] + lp[ids])
            for _, r, b in bytes_at[i]:
                beta[r, i] = np.logaddexp(beta[r, i], beta[r, i + 1] + lp[b].sum())
        return beta

    def batches(self, words: list[bytes], rows: int = 20_000):
        """(row numbers, code points) of words grouped by length, in bounded blocks."""
        text = ["▁" + w.decode("utf-8", "surrogatepass") for w in words]
        lens = np.fromiter(map(len, text), np.int64, len(text))
        order = np.argsort(lens, kind="stable")
        cuts = np.flatnonzero(np.diff(lens[order])) + 1
        for group in np.split(order, cuts):
            size = int(lens[group[0]]) if len(group) else 0
            step = max(1, rows * 12 // max(size, 12))
            for at in range(0, len(group), step):
                part = group[at:at + step]
                points = np.frombuffer("".join(text[i] for i in part).encode("utf-32-le", "surrogatepass"), "<u4")
                yield part, points.reshape(len(part), size)

    # one long word --------------------------------------------------------------------------------
    def _starting(self, points: np.ndarray, lo: int, hi: int):
        """For starts lo..hi-1: piece ids per length (MAX_PIECE, hi - lo), and log probabilities of spelled characters."""
        ids = np.full((MAX_PIECE, hi - lo), -1, dtype=np.int64)
        h = np.zeros(hi - lo, dtype=np.uint64)
        p1 = points[lo:hi + MAX_PIECE - 1].astype(np.uint64) + np.uint64(1)
        for k in range(1, MAX_PIECE + 1):
            m = min(hi, len(points) - k + 1) - lo
            if m <= 0:
                break
            h = h[:m] * _BASE + p1[k - 1:k - 1 + m]
            ids[k - 1, :m] = self.find(h)
        return ids, np.flatnonzero(ids[0] < 0)

    def _weights(self, points: np.ndarray, lo: int, hi: int, lp: np.ndarray) -> np.ndarray:
        """Probabilities of the pieces (MAX_PIECE, hi - lo) that start at lo..hi-1, by length."""
        ids, spelled = self._starting(points, lo, hi)
        w = np.where(ids >= 0, np.exp(lp[ids]), 0.0)
        for i in spelled:
            w[0, i] = math.exp(lp[self._bytes(points[lo + i])].sum())
        return w

    def _bytes(self, point) -> np.ndarray:
        return self.byte[list(chr(point).encode("utf-8", "surrogatepass"))]

    def sweep(self, points: np.ndarray, lp: np.ndarray, back: bool) -> np.ndarray:
        """Logs of the sums over all segmentations of every prefix, or suffix, of one word, (size + 1).

        Sums run in a ring of the last MAX_PIECE ones, scaled anew every few steps, over
        blocks of ``SWEEP`` positions.
        """
        size = len(points)
        out = np.empty(size + 1)
        ring, scale = np.zeros(MAX_PIECE), 0.0
        ring[-1] = 1.0
        out[size if back else 0] = 0.0
        for at in range(0, size, SWEEP):
            n = min(SWEEP, size - at)
            rows = np.zeros((n, MAX_PIECE))
            if back:
                w = self._weights(points, size - at - n, size - at, lp)[:, ::-1]
                rows[:, ::-1] = w.T
            else:
                lo = max(0, at - MAX_PIECE + 1)
                w = self._weights(points, lo, at + n, lp)
                for k in range(1, MAX_PIECE + 1):
                    # pieces of length k that end at at+1..at+n
                    first = max(lo, at + 1 - k)
                    ends = np.arange(first + k, at + n + 1)
                    rows[ends - at - 1, MAX_PIECE - k] = w[k - 1, first - lo:first - lo + len(ends)]
            held = np.concatenate([ring, np.empty(n)])
            for a in range(0, n, RESCALE):
                b = min(a + RESCALE, n)
                for j in range(a, b):
                    held[j + MAX_PIECE] = rows[j] @ held[j:j + MAX_PIECE]
                with np.errstate(divide="ignore"):
                    logs = np.log(held[a + MAX_PIECE:b + MAX_PIECE]) + scale
                if back:
                    out[size - at - b:size - at - a] = logs[::-1]
                else:
                    out[at + a + 1:at + b + 1] = logs
                top = held[b:b + MAX_PIECE].max()
                held[b:b + MAX_PIECE] /= top
                scale += math.log(top)
            ring = held[n:]
        return out

    def long_expected(self, points: np.ndarray, lp: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in one word."""
        a, b = self.sweep(points, lp, False), self.sweep(points, lp, True)
        out = np.zeros(self.n)
        for lo in range(0, len(points), SWEEP):
            hi = min(lo + SWEEP, len(points))
            ids, spelled = self._starting(points, lo, hi)
            for k in range(1, MAX_PIECE + 1):
                i = np.flatnonzero(ids[k - 1] >= 0)
                piece = ids[k - 1, i]
                i += lo
                out += np.bincount(piece, np.exp(a[i] + lp[piece] + b[i + k] - a[-1]), self.n)
            for i in spelled + lo:
                bs = self._bytes(points[i])
                np.add.at(out, bs, math.exp(a[i] + lp[bs].sum() + b[i + 1] - a[-1]))
        return out

    def log_prob(self, words: list[bytes], lp: np.ndarray) -> np.ndarray:
        """Natural log of the marginal probability of every word."""
        out = np.zeros(len(words))
        for part, points in self.batches(words):
            if points.shape[1] > LONG_WORD:
                out[part] = [self.sweep(p, lp, False)[-1] for p in points]
                continue
            e, s = self.edges(points)
            out[part] = self.forward(e, s, *points.shape, lp)[:, -1]
        return out

    def expected(self, words: list[bytes], n: np.ndarray, lp: np.ndarray) -> np.ndarray:
        """Expected number of times each piece is used in the words, word w taken n[w] times."""
        out = np.zeros(self.n)
        for part, points in self.batches(words):
            if points.shape[1] > LONG_WORD:
                for p, times in zip(points, n[part]):
                    out += times * self.long_expected(p, lp)
                continue
            e, s = self.edges(points)
            a = self.forward(e, s, *points.shape, lp)
            b = self.backward(e, s, *points.shape, lp)
            total, times = a[:, -1], n[part]
            for i, k, ids, rows in e:
                w = np.exp(a[rows, i] + lp[ids] + b[rows, i + k] - total[rows]) * times[rows]
                out += np.bincount(ids, weights=w, minlength=self.n)
            for i, r, bs in s:
                w = math.exp(a[r, i] + lp[bs].sum() + b[r, i + 1] - total[r]) * times[r]
                np.add.at(out, bs, w)
        return out


_LATTICES: dict[str, Lattice] = {}


def lattice(path: str) -> Lattice:
    if path not in _LATTICES:
        _LATTICES[path] = Lattice(path)
    return _LATTICES[path]


def _gathered(batches, rows: int = 100_000):
    """Batches joined to about ``rows`` rows, so that words of one length are many."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def fit_pieces(vocab: DataFrame, path: str, n_ends: int, rounds: int = EM_ROUNDS) -> np.ndarray:
    """Log probabilities of all pieces and, last, of the end, from rows (word, n).

    A round sums expected counts per task, then per piece; what reaches the
    driver is one number per piece of the vocabulary.
    """
    lp = np.append(lattice(path).prior, 0.0)
    for _ in range(rounds):
        def expect(batches, lp=lp[:-1]):
            lat = lattice(path)
            total = np.zeros(lat.n)
            for b in _gathered(batches):
                total += lat.expected(b.column("word").to_pylist(), b.column("n").to_numpy(), lp)
            ids = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(total[ids])], ["piece", "c"])

        counted = vocab.where("n > 0").select("word", "n").mapInArrow(expect, "piece int, c double")
        found = counted.groupBy("piece").agg(F.sum("c").alias("c")).toPandas()
        counts = np.full(len(lp), PIECE_SMOOTHING)
        counts[found["piece"].to_numpy()] += found["c"].to_numpy()
        counts[-1] += n_ends
        lp = np.log(counts / counts.sum())
    return lp


def lattice_scores(docs: DataFrame, path: str | None = None, rounds: int = EM_ROUNDS,
                   chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Base and lattice score of every document.

    Returns one row per input row: doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score (log10 of the marginal probability of the
    text's words and one end). Documents whose crc32(doc_id as text) mod 5 is 1
    are held out, all others are learnt from; a null id counts as the empty
    text. Null and empty texts are the one end token. Without any training row
    the base is log10(0.5 / 0.5) per token and pieces keep their prior. Other
    columns are not read.
    """
    path = path or vocabulary_path()
    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty("text").alias("text"))
    chunks = materialize(rows.mapInArrow(_chunks(chunk_bytes), CHUNK_SCHEMA), "chunks")
    each = chunks.select("chunk", "words", "train").mapInArrow(
        _explode_words, "chunk long, wid int, word binary, n long")
    vocab = materialize(each.groupBy("word").agg(F.sum("n").alias("n")), "vocabulary")
    n_docs = chunks.select(F.explode("held").alias("h")).agg(F.count_if(~F.col("h"))).first()[0]
    n_train, n_types = vocab.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    n_train, n_types = n_train + n_docs, n_types + (n_docs > 0)
    lp = fit_pieces(vocab, path, n_docs, rounds)
    denominator = n_train + 0.5 * (n_types + 1)

    def score(batches, lp=lp[:-1]):
        lat = lattice(path)
        for b in _gathered(batches):
            got = lat.log_prob(b.column("word").to_pylist(), lp) / math.log(10)
            yield from b.append_column("lp", pa.array(got)).to_batches()

    scored = vocab.mapInArrow(score, "word binary, n long, lp double")
    back = materialize(each.select("chunk", "wid", "word").join(scored, "word").select("chunk", "wid", "n", "lp"),
                       "scores")
    end = (n_docs, lp[-1] / math.log(10))

    def finish(chunk: pa.Table, found: pa.Table) -> pa.Table:
        # one chunk row beside the scores of its words
        size = found.num_rows
        c, word_lp = np.zeros(size), np.zeros(size)
        wid = found["wid"].to_numpy()
        c[wid], word_lp[wid] = found["n"].to_numpy(), found["lp"].to_numpy()
        base = np.log10((c + 0.5) / denominator)
        lens = np.frombuffer(chunk["n_words"][0].as_py(), "<i8")
        tokens = np.frombuffer(chunk["tokens"][0].as_py(), "<i4")
        doc = np.repeat(np.arange(len(lens)), lens)

        def total(x):
            return np.bincount(doc, weights=x[tokens], minlength=len(lens))

        known = total((c > 0).astype(float)).astype(np.int64) + (end[0] > 0)
        return pa.table({
            "doc_id": chunk["doc_ids"].combine_chunks()[0].values, "held_out": chunk["held"].combine_chunks()[0].values,
            "n_tokens": pa.array(lens + 1), "n_known": pa.array(known),
            "train_tokens": pa.array(np.full(len(lens), n_train, np.int64)),
            "base_score": pa.array(total(base) + math.log10((end[0] + 0.5) / denominator)),
            "score": pa.array(total(word_lp) + end[1])})

    discard(vocab)
    return chunks.select("chunk", "doc_ids", "held", "n_words", "tokens").groupBy("chunk").cogroup(
        back.groupBy("chunk")).applyInArrow(
        finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                "base_score double, score double")
