"""Packing documents into fixed windows: best-fit decreasing with a segment tree.

Each document is tokenised (public word-level BPE vocabulary) and ended with
id 1. Overlong documents are first cut into full windows; what is left is
dealt to bins of bounded size by a hash and packed there, longest first, each
piece into the open window with the least remaining room that still holds it.
A segment tree over the remaining capacities 0..window finds that window in
log2(window) steps. Token ids never leave the task that made them; only piece
lengths and checksums are shuffled.
"""
from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .rolling import Substrings

WINDOW = 2048
END_ID = 1
# pieces per bin: waste falls with the size, memory and time of a task grow with it
PIECES_PER_BIN = 8192
# documents whose texts are taken from a batch together; long ones are cut into segments inside
DOCS_AT_ONCE = 64

PIECE_SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def vocabulary_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Token ids of texts by the tokenizer, with a bounded table of the parts of words seen so far.

    The tokenizer drops white space and never merges across it, so the ids of a
    text are those of its words in order. A word of letters followed by ASCII
    punctuation is split there, where the tokenizer splits too, into two parts;
    any other word is one part. Many texts are cut into parts at once with array
    operations and the parts looked up by two 64-bit hashes; only parts not seen
    before reach the tokenizer, letter runs many at a time, each ending at an
    end-of-word id.
    """

    MAX_PARTS = 1_500_000
    SEGMENT_BYTES = 1_000_000
    GROUP = 256
    SPACE = np.zeros(256, dtype=bool)
    SPACE[[9, 10, 11, 12, 13, 32]] = True
    PUNCT = np.zeros(256, dtype=bool)
    PUNCT[np.frombuffer(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~", np.uint8)] = True

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab()
        self.word_end = np.zeros(max(vocab.values()) + 1, dtype=bool)
        for w, i in vocab.items():
            self.word_end[i] = w.endswith("</w>")
        self.reset()

    def reset(self):
        # an open hash table from (key, check) to a part; key 0 is a free place
        self.key = np.zeros(1 << 17, dtype=np.uint64)
        self.check = np.zeros(1 << 17, dtype=np.uint64)
        self.part = np.zeros(1 << 17, dtype=np.int32)
        self.n_parts = 0
        self.first = np.zeros(1 << 16, dtype=np.int64)
        self.count = np.zeros(1 << 16, dtype=np.int64)
        self.ids = np.zeros(1 << 18, dtype=np.uint32)
        self.n_ids = 0

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        while n > len(a):
            a = np.concatenate([a, np.zeros_like(a)])
        return a

    # the table -----------------------------------------------------------------------------------
    def _find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Parts of the keys, -1 where there is none."""
        out = np.full(len(key), -1, dtype=np.int32)
        mask = np.uint64(len(self.key) - 1)
        at, left = (key & mask).astype(np.int64), np.arange(len(key))
        while len(left):
            held = self.key[at]
            hit = (held == key[left]) & (self.check[at] == check[left])
            out[left[hit]] = self.part[at[hit]]
            go = ~hit & (held != 0)
            left, at = left[go], (at[go] + 1) & int(mask)
        return out

    def _put(self, key: np.ndarray, check: np.ndarray, part: np.ndarray):
        mask = len(self.key) - 1
        at, left = (key & np.uint64(mask)).astype(np.int64), np.arange(len(key))
        while len(left):
            free = np.flatnonzero(self.key[at] == 0)
            # of several keys that want one place the first gets it
            place, who = np.unique(at[free], return_index=True)
            who = free[who]
            self.key[place], self.check[place], self.part[place] = key[left[who]], check[left[who]], part[left[who]]
            go = np.ones(len(left), dtype=bool)
            go[who] = False
            left, at = left[go], (at[go] + 1) & mask

    def _add(self, key: np.ndarray, check: np.ndarray, counts: np.ndarray, flat: np.ndarray):
        """New parts with the numbers of their ids and the ids one after another."""
        at, n = self.n_parts, len(key)
        if 2 * (at + n) > len(self.key):
            held = np.flatnonzero(self.key)
            old = self.key[held], self.check[held], self.part[held]
            size = len(self.key)
            while 2 * (at + n) > size:
                size *= 4
            self.key, self.check = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
            self.part = np.zeros(size, np.int32)
            self._put(*old)
        self.first, self.count = self._room(self.first, at + n), self._room(self.count, at + n)
        self.ids = self._room(self.ids, self.n_ids + len(flat))
        self.ids[self.n_ids:self.n_ids + len(flat)] = flat
        self.first[at:at + n] = self.n_ids + np.cumsum(counts) - counts
        self.count[at:at + n] = counts
        self.n_ids += len(flat)
        self.n_parts += n
        self._put(key, check, np.arange(at, at + n, dtype=np.int32))

    # learning ------------------------------------------------------------------------------------
    def _whole(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tok.encode_batch_fast(names, add_special_tokens=False)]
        return (np.fromiter(map(len, ids), np.int64, len(ids)),
                np.fromiter((x for i in ids for x in i), np.uint32, sum(map(len, ids))))

    def _letters(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        groups = [names[i:i + self.GROUP] for i in range(0, len(names), self.GROUP)]
        counts, flat = [], []
        for g, e in zip(groups, self.tok.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, dtype=np.uint32)
            ends = np.flatnonzero(self.word_end[ids]) + 1
            n, ids = (np.diff(ends, prepend=0), ids) if len(ends) == len(g) else self._whole(g)
            counts.append(n)
            flat.append(ids)
        return np.concatenate(counts), np.concatenate(flat)

    def _learn(self, raw: bytes, start, end, key, check, letters):
        for kind, encode in ((True, self._letters), (False, self._whole)):
            of = np.flatnonzero(letters == kind)
            if len(of):
                names = [raw[a:b].decode() for a, b in zip(start[of].tolist(), end[of].tolist())]
                self._add(key[of], check[of], *encode([x.lower() for x in names] if kind else names))

    # encoding ------------------------------------------------------------------------------------
    def _parts(self, data: np.ndarray):
        """(start, end, letters) of the parts of a buffer in order."""
        space = self.SPACE[data]
        edge = np.diff(np.concatenate([[1], space.astype(np.int8), [1]]))
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        # letters are those of ASCII and U+00C0 to U+017F, without the multiplication and division signs
        # and the dotted capital I, whose lower case is two characters; continuation bytes go with their lead
        other = ~(((data | 32) - 97 < 26) | ((data >= 0x80) & (data < 0xC0)))
        lead = np.flatnonzero((data >= 0xC3) & (data <= 0xC5))
        if len(lead):
            after = data[np.minimum(lead + 1, len(data) - 1)]
            pair = data[lead].astype(np.int32) << 8 | after
            other[lead] = (pair == 0xC397) | (pair == 0xC3B7) | (pair == 0xC4B0)
        # the trailing punctuation of a word begins after the last byte that is none
        solid = np.flatnonzero(~(space | self.PUNCT[data]))
        last = np.searchsorted(solid, end) - 1
        cut = np.where(last >= 0, solid[np.maximum(last, 0)] + 1 if len(solid) else 0, 0)
        cut = np.maximum(cut, start)
        sums = np.concatenate([[0], np.cumsum(other)])
        letters = (cut > start) & (sums[cut] == sums[start])
        cut = np.where(letters | (cut == start), cut, end)
        a, b = np.stack([start, cut], axis=1).ravel(), np.stack([cut, end], axis=1).ravel()
        kind = np.stack([letters, np.zeros_like(letters)], axis=1).ravel()
        real = a < b
        return a[real], b[real], kind[real]

    def _segments(self, raw: bytes):
        """A text in pieces that end at white space, or the text."""
        at = 0
        while len(raw) - at > self.SEGMENT_BYTES:
            end = at + self.SEGMENT_BYTES
            while end < len(raw) and not self.SPACE[raw[end]]:
                end += 1
            yield raw[at:end]
            at = end
        yield raw[at:]

    def _buffer(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids per text) of texts that are encoded together."""
        raw = b"\n".join(texts) + b"\n"
        data = np.frombuffer(raw, dtype=np.uint8)
        start, end, letters = self._parts(data)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        key, check = (Substrings(data, seed).hash(start, end) for seed in (1, 2))
        key |= np.uint64(1)
        if self.n_parts > self.MAX_PARTS:
            self.reset()
        part = self._find(key, check)
        new = np.flatnonzero(part < 0)
        if len(new):
            _, one = np.unique(np.stack([key[new], check[new]], axis=1), axis=0, return_index=True)
            one = new[one]
            self._learn(raw, start[one], end[one], key[one], check[one], letters[one])
            part[new] = self._find(key[new], check[new])
        lens = self.count[part]
        ends = np.cumsum(lens)
        index = np.arange(ends[-1]) + np.repeat(self.first[part] - (ends - lens), lens)
        bound = np.cumsum([len(t) + 1 for t in texts])
        upto = np.concatenate([[0], ends])[np.searchsorted(start, bound)]
        return self.ids[index], np.diff(upto, prepend=0)

    def encode_many(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each UTF-8 text as unsigned 32-bit integers."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        held, owner, size = [], [], 0

        def flush():
            nonlocal held, owner, size
            ids, counts = self._buffer(held)
            for k, piece in zip(owner, np.split(ids, np.cumsum(counts)[:-1])):
                out[k].append(piece)
            held, owner, size = [], [], 0

        for k, raw in enumerate(texts):
            for segment in self._segments(raw):
                held.append(segment)
                owner.append(k)
                size += len(segment)
                if size >= self.SEGMENT_BYTES:
                    flush()
        if held:
            flush()
        return [p[0] if len(p) == 1 else np.concatenate(p) for p in out]

    def encode(self, text: str) -> np.ndarray:
        """Ids of one text as unsigned 32-bit integers."""
        return self.encode_many([text.encode()])[0]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The encoder of this Python worker; its cache serves all tasks the worker runs."""
    if path not in _ENCODERS:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _cut(path: str, window: int):
    def run(batches):
        enc = encoder(path)
        task = TaskContext.get().partitionId() + 1
        seen: dict[tuple, int] = {}
        for b in batches:
            texts = b.column(1)
            doc_ids = b.column(0).to_pylist()
            for at in range(0, b.num_rows, DOCS_AT_ONCE):
                out = ([], [], [], [], [], [], [])
                raw = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in texts[at:at + DOCS_AT_ONCE]]
                for doc_id, ids in zip(doc_ids[at:at + DOCS_AT_ONCE], enc.encode_many(raw)):
                    ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                    for start in range(0, len(ids), window):
                        piece = ids[start:start + window]
                        row = doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids)
                        # equal pieces are told apart by their number in the task
                        twin = seen[row] = seen.get(row, -1) + 1
                        for col, v in zip(out, (*row, twin, task if twin else 0)):
                            col.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out],
                                                 ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "twin", "task"])
    return run


def pieces(docs: DataFrame, path: str | None = None, window: int = WINDOW) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): the documents cut into windows, whole ids once each.

    ``twin`` and ``task`` number the pieces of a task that are equal otherwise; they are 0 for the first.
    """
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        _cut(path or vocabulary_path(), window), PIECE_SCHEMA + ", twin long, task long")


class CapacityTree:
    """Segment tree over remaining capacities: the tightest open window that holds a piece."""

    def __init__(self, window: int):
        self.size = 1 << math.ceil(math.log2(window + 1))
        self.full = [False] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(self.size)]

    def add(self, capacity: int, window_id: int):
        self.open[capacity].append(window_id)
        i = capacity + self.size
        while i and not self.full[i]:
            self.full[i] = True
            i >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """(capacity, window id) of the fullest window with at least ``length`` left, removed from the tree."""
        i = length + self.size
        if not self.full[i]:
            # climb to the first node with an open right sibling, then descend to its leftmost leaf
            while i > 1 and not (i % 2 == 0 and self.full[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.full[2 * i] else 2 * i + 1
        capacity = i - self.size
        window_id = self.open[capacity].pop()
        if not self.open[capacity]:
            self.full[i] = False
            i >>= 1
            while i and not (self.full[2 * i] or self.full[2 * i + 1]):
                self.full[i] = False
                i >>= 1
        return capacity, window_id


def best_fit_decreasing(lengths, window: int) -> tuple[list[int], list[int]]:
    """(window number, offset) of every piece; ``lengths`` must not increase."""
    tree, at, offset, n = CapacityTree(window), [], [], 0
    for length in lengths:
        found = tree.take(length)
        if found is None:
            found, n = (window, n), n + 1
        capacity, wid = found
        at.append(wid)
        offset.append(window - capacity)
        if capacity > length:
            tree.add(capacity - length, wid)
    return at, offset


def _pack_bin(window: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"),
                               ("ids_crc32", "ascending")])
        at, offset = best_fit_decreasing(table["length"].to_pylist(), window)
        base = table["_bin"][0].as_py() << 32
        return table.drop_columns(["_bin"]).append_column(
            "sequence_id", pa.array(np.array(at, dtype=np.int64) + base)).append_column(
            "offset", pa.array(offset, pa.int64()))
    return run


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW,
         pieces_per_bin: int = PIECES_PER_BIN) -> DataFrame:
    """Pieces of all documents with their place in sequences of at most ``window`` tokens.

    Returns one row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset. A null or empty text is the one id that ends it.
    Texts of any length are read whole, in segments. Repeated rows are packed each
    on their own and spread over the bins; ties among equal lengths go by
    doc_id, start and checksum; an empty table gives an empty result; other
    columns are not read. ``sequence_id`` is the bin number times 2^32 plus the
    number within the bin, so ids are unique but not consecutive.
    """
    cut = materialize(pieces(docs, path, window), "pieces")
    bins = max(1, math.ceil(cut.count() / pieces_per_bin))
    # equal pieces, such as those of rows without an id, are dealt over the bins too
    key = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "twin", "task"), F.lit(bins)).alias("_bin")
    return cut.withColumn("_bin", key).drop("twin", "task").groupBy("_bin").applyInArrow(
        _pack_bin(window), PIECE_SCHEMA + ", sequence_id long, offset long")
