"""Byte-level BPE of whole corpora with a public rank file, in NumPy."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the published pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"

_NONE = np.int32(2**31 - 1)
_FREE = np.uint32(2**32 - 1)


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file: one line per token, base64 bytes and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Vocabulary:
    """Token ids of the single bytes and a hash table from pairs of ids to the id of the joined token.

    The table is open-addressed in two NumPy arrays, so that many pairs are looked up at once. A vocabulary has a
    fixed size of some 50,000 tokens, whatever the corpus.
    """

    def __init__(self, ranks: dict[bytes, int]):
        if max(ranks.values()) >= 1 << 16:
            raise ValueError("pairs of ids are kept in 32 bits: at most 65,536 tokens")
        self._pairs: dict[int, int] | None = None
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        left, right, joined = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), joined.append(rank)
        key = (np.array(left, dtype=np.uint32) << np.uint32(16)) | np.array(right, dtype=np.uint32)
        self.bits = max(10, int(np.ceil(np.log2(max(len(key), 1) * 2.5))))
        self.keys = np.full(1 << self.bits, _FREE, dtype=np.uint32)
        self.vals = np.full(1 << self.bits, _NONE, dtype=np.int32)
        joined = np.array(joined, dtype=np.int32)
        at = self._slot(key)
        todo = np.arange(len(key))
        while len(todo):  # all keys try their slot; of those on one free slot the first stays
            spot = at[todo]
            _, first = np.unique(spot, return_index=True)
            win = first[self.keys[spot[first]] == _FREE]
            self.keys[spot[win]], self.vals[spot[win]] = key[todo[win]], joined[todo[win]]
            todo = np.delete(todo, win)
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key * np.uint32(2654435769) >> np.uint32(32 - self.bits)).astype(np.int64)

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Id (which is the rank) of each joined pair; the largest int32 where the pair is no token."""
        key = (a.astype(np.uint32) << np.uint32(16)) | b.astype(np.uint32)
        at = self._slot(key)
        k = self.keys[at]
        out = np.where(k == key, self.vals[at], _NONE)
        open_ = np.flatnonzero((k != key) & (k != _FREE))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            k = self.keys[at[open_]]
            hit = k == key[open_]
            out[open_[hit]] = self.vals[at[open_[hit]]]
            open_ = open_[~hit & (k != _FREE)]
        return out


    def pairs(self) -> dict[int, int]:
        """The same table as a dictionary, for the few words that are merged pair by pair."""
        if self._pairs is None:
            used = self.keys != _FREE
            self._pairs = dict(zip(self.keys[used].tolist(), self.vals[used].tolist()))
        return self._pairs


def encode_long(word: bytes, vocab: Vocabulary) -> np.ndarray:
    """Ids of one very long word: least rank first, then leftmost, from a heap over a linked list; n log n steps."""
    pairs, none = vocab.pairs(), int(_NONE)
    ids = vocab.byte_id[np.frombuffer(word, dtype=np.uint8)].tolist()
    n = len(ids)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    ranks = [pairs.get(a << 16 | b, none) for a, b in zip(ids, ids[1:])]
    heap = [(r, i) for i, r in enumerate(ranks) if r != none]
    heapq.heapify(heap)
    ranks.append(none)  # of the pair that starts at a place
    while heap:
        r, i = heapq.heappop(heap)
        if not alive[i] or ranks[i] != r:
            continue
        j = after[i]
        ids[i], alive[j], after[i] = r, False, after[j]
        if after[i] < n:
            before[after[i]] = i
        for at in (before[i], i):
            if at >= 0:
                ranks[at] = pairs.get(ids[at] << 16 | ids[after[at]], none) if after[at] < n else none
                if ranks[at] != none:
                    heapq.heappush(heap, (ranks[at], at))
    return np.array([ids[i] for i in range(n) if alive[i]], dtype=np.int32)


def encode_words(words: list[bytes], vocab: Vocabulary, longest: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, end to end, and the number of ids of each.

    Words of similar length share a padded matrix of ids beside a matrix of the ranks of neighbouring pairs. Each
    round every row merges its leftmost pair of minimum rank, along with the later disjoint occurrences of that same
    pair (a new token's pairs all rank behind the pair that made it, so these would be the next merges anyway). Only
    pairs beside a merge are looked up again; rows and columns are compacted, and finished rows leave the matrix. A
    round looks at a whole row, so words of more than ``longest`` bytes go to :func:`encode_long`.
    """
    count = np.zeros(len(words), dtype=np.int64)
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # word numbers, lengths, ids end to end
    length = np.fromiter((len(w) for w in words), dtype=np.int64, count=len(words))
    for i in np.flatnonzero(length > longest):
        ids = encode_long(words[i], vocab)
        done.append((np.array([i]), np.array([len(ids)]), ids))
    bucket = np.where(length > longest, -1, np.ceil(np.log2(np.maximum(length, 1)) * 2)).astype(int)
    for b in np.unique(bucket[bucket >= 0]):
        every = np.flatnonzero(bucket == b)
        step = max(1, 2_000_000 // max(1, int(length[every].max())))  # at most two million cells at a time
        for own in (every[i : i + step] for i in range(0, len(every), step)):
            n = length[own]
            width = int(n.max())
            if width == 0:
                continue
            inside = np.arange(width)[None, :] < n[:, None]
            ids = np.full((len(own), width), -1, dtype=np.int32)
            ids[inside] = vocab.byte_id[np.frombuffer(b"".join(words[i] for i in own), dtype=np.uint8)]
            rank = np.full((len(own), width), _NONE, dtype=np.int32)  # rank[:, i]: of the pair (i, i + 1)
            pair = inside.copy()
            pair[:, :-1] &= inside[:, 1:]
            pair[:, -1] = False
            r, c = np.nonzero(pair)
            rank[r, c] = vocab.join(ids[r, c], ids[r, c + 1])
            while len(own):
                least = rank.min(axis=1)
                over = least == _NONE
                if over.any():
                    kept = np.arange(ids.shape[1])[None, :] < n[over][:, None]
                    done.append((own[over], n[over], ids[over][kept]))
                    own, n, ids, rank, least = own[~over], n[~over], ids[~over], rank[~over], least[~over]
                    if not len(own):
                        break
                merge = rank == least[:, None]
                beside = merge[:, 1:] & merge[:, :-1]
                if beside.any():  # aaa: of touching occurrences every second one, from the left
                    for row in np.flatnonzero(beside.any(axis=1)):
                        at = np.flatnonzero(merge[row])
                        new = np.concatenate(([True], np.diff(at) > 1))
                        start = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
                        merge[row, at[(np.arange(len(at)) - start) % 2 == 1]] = False
                r, c = np.nonzero(merge)
                ids[r, c] = least[r]
                keep = np.arange(ids.shape[1])[None, :] < n[:, None]
                keep[r, c + 1] = False
                n = keep.sum(axis=1)
                inside = np.arange(int(n.max()))[None, :] < n[:, None]
                new_at = (np.cumsum(keep, axis=1) - 1)[r, c]
                flat_ids, flat_rank = ids[keep], rank[keep]
                ids = np.full(inside.shape, -1, dtype=np.int32)
                rank = np.full(inside.shape, _NONE, dtype=np.int32)
                ids[inside], rank[inside] = flat_ids, flat_rank
                for rr, cc in ((r, new_at), (r[new_at > 0], new_at[new_at > 0] - 1)):
                    last = cc + 1 >= n[rr]
                    rank[rr[last], cc[last]] = _NONE
                    rr, cc = rr[~last], cc[~last]
                    rank[rr, cc] = vocab.join(ids[rr, cc], ids[rr, cc + 1])
    for own, n, _ in done:
        count[own] = n
    start = np.cumsum(count) - count
    out = np.empty(int(count.sum()), dtype=np.int32)
    for own, n, ids in done:
        out[np.repeat(start[own] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
    return out, count


class _Numbers(dict):
    """Word -> number in order of arrival; new words are noted."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


class Encoder:
    """Encodes texts; keeps the ids of words it met, up to a bound, so that a word is merged once per worker."""

    def __init__(self, vocab: Vocabulary, pattern: str = PATTERN, most_words: int = 150_000):
        self.vocab, self.split, self.most = vocab, regex.compile(pattern), most_words
        self._forget()

    def _forget(self) -> None:
        self.number = _Numbers()
        self.ids, self.first, self.size = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _learn(self) -> None:
        new = self.number.new
        if new:
            ids, count = encode_words([w.encode("utf-8", "replace") for w in new], self.vocab)
            self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(count) - count])
            self.size = np.concatenate([self.size, count])
            self.ids = np.concatenate([self.ids, ids])
            self.number.new = []

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, end to end, and the number of ids of each text; null and empty texts have none."""
        sizes, parts = np.zeros(len(texts), dtype=np.int64), []
        for used, flat in self._numbered(texts):
            size = self.size[flat]
            total = int(size.sum())
            sizes += np.bincount(used, weights=size, minlength=len(texts)).astype(np.int64)
            parts.append(self.ids[np.repeat(self.first[flat] - (np.cumsum(size) - size), size) + np.arange(total)])
        return (np.concatenate(parts) if parts else np.empty(0, np.int32)), sizes

    def count(self, texts: list[str | None]) -> np.ndarray:
        """The number of ids of each text."""
        sizes = np.zeros(len(texts), dtype=np.int64)
        for used, flat in self._numbered(texts):
            sizes += np.bincount(used, weights=self.size[flat], minlength=len(texts)).astype(np.int64)
        return sizes

    def _numbered(self, texts: list[str | None], most: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Portions of (text number, word number), in order, of about ``most`` words; a long text fills several."""
        if len(self.number) > self.most:
            self._forget()
        get, used, flat, held = self.number.__getitem__, [], [], 0
        for i, text in enumerate(texts):
            if not text:
                continue
            found = (m.group() for m in self.split.finditer(text)) if len(text) > 1_000_000 else iter((self.split.findall(text),))
            while True:
                words = list(islice(found, most)) if len(text) > 1_000_000 else next(found, None)
                if not words:
                    break
                numbers = np.fromiter(map(get, words), dtype=np.int64, count=len(words))
                used.append(np.full(len(words), i)), flat.append(numbers)
                held += len(words)
                if held >= most:
                    self._learn()
                    yield np.concatenate(used), np.concatenate(flat)
                    used, flat, held = [], [], 0
                    if len(self.number) > self.most:
                        self._forget()
                        get = self.number.__getitem__
        if held:
            self._learn()
            yield np.concatenate(used), np.concatenate(flat)


_encoders: dict[str, Encoder] = {}  # of this worker process, by rank file


def _encoder(path: str, vocab) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(vocab.value)
    return _encoders[path]


def _portions(batch: pa.RecordBatch, most_chars: int = 2_000_000) -> Iterator[tuple[int, list[str | None]]]:
    """Slices of a batch with about ``most_chars`` characters: first row and texts."""
    texts, first, chars = [], 0, 0
    for i, text in enumerate(batch.column(batch.num_columns - 1)):
        texts.append(text.as_py())
        chars += len(texts[-1] or "")
        if chars >= most_chars:
            yield first, texts
            texts, first, chars = [], i + 1, 0
    if texts:
        yield first, texts


def _vocabulary(spark: SparkSession, path: str):
    return spark.sparkContext.broadcast(Vocabulary(read_ranks(path)))  # fixed size, a few MB


def token_ids(docs: DataFrame, id_col: str = "doc_id", text: str = "text", ranks: str = RANKS) -> DataFrame:
    """(id, ids): the token ids of every text, one row per input row, without special tokens.

    A narrow map over the documents: no shuffle, only id and text are read, texts are never cut. Words are split by
    the published pattern and merged by :func:`encode_words`.

    Defined results: an empty and a null text give an empty list; a null id is passed on; repeated rows stay
    repeated; strings of special tokens are ordinary text; other columns are never read.
    """
    spark = docs.sparkSession
    vocab = _vocabulary(spark, ranks)
    src = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(ranks, vocab)
        for batch in batches:
            for first, texts in _portions(batch):
                ids, sizes = enc.encode(texts)
                ends = np.concatenate(([0], np.cumsum(sizes)))
                if ends[-1] >= 2**31 - 1:
                    raise ValueError("more than two thousand million ids in one portion")
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), lists], [id_col, "ids"])

    kind = src.schema["_id"].dataType
    return src.mapInArrow(run, T.StructType([T.StructField(id_col, kind), T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def token_counts(docs: DataFrame, text: str = "text", out: str = "n_tokens", ranks: str = RANKS) -> DataFrame:
    """The other columns of ``docs`` and the number of tokens of ``text`` (0 for null and empty texts)."""
    vocab = _vocabulary(docs.sparkSession, ranks)
    others = [f for f in docs.schema.fields if f.name != text]
    src = docs.select(*[F.col(f"`{f.name}`") for f in others], F.col(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(ranks, vocab)
        for batch in batches:
            for first, texts in _portions(batch):
                cols = [batch.column(i).slice(first, len(texts)) for i in range(len(others))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(enc.count(texts), pa.int64())], [*[f.name for f in others], out])

    return src.mapInArrow(run, T.StructType([*others, T.StructField(out, T.LongType())]))
