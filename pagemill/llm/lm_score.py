"""Operator 12: language-model scores by Elias-Fano n-gram tries.

The model is an interpolated Kneser-Ney trigram model with three discounts: raw counts for trigrams, numbers of distinct words
before for bigrams, and for single words the contract's base distribution, which knows one unknown word. The words are
runs without white space, A-Z lower-cased, and every document has one end.

The corpus is coded once, as chunks of about ``CHUNK`` tokens: sorted word hashes and local ids. Then

1. every chunk sends its distinct words with their training counts to word shards, which give each trained word an id by
   frequency and its count over all chunks;
2. every chunk sends its distinct trigrams with their training counts to the shard of the middle word v. All that the model
   knows about v is there: its predecessors u, its successors w, and the trigrams. A shard builds its trie and gives every trigram of every
   chunk its log probability;
3. the chunk adds these up for its documents.

Nothing is capped, and what is sent grows with the distinct trigrams of chunks, so a frequent word, pair or line adds one entry for each
chunk. A middle word of more than ``HOT`` training occurrences is divided by a hash of the word before it, and each part is then a context of
its own (a class of predecessors, between the bigram and the trigram context), so no shard holds a frequent word whole. One pair u v stays
whole; its entries are bounded by its distinct successors in each chunk. The chunk table is bucketed by chunk, so that 2. and 3.
move ids and probabilities to it, not the table. Discounts are estimated by each shard, whose words are a random part of all.

A trie (:class:`Trie`) has its levels as flat arrays in one buffer, which can be mapped from a file: words, successors, predecessors and
trigrams are Elias-Fano sequences, and probabilities and back-off weights 16-bit fixed point numbers of steps of 1/1024. A successor is looked
up by the successor search of an Elias-Fano sequence (the bucket of its high bits, then its low bits); a trigram is stored
under its context as the place of w among the successors of v, so the third level is searched relative to the second.

Words are known by 64-bit hashes. Defined results: null and empty texts have only their end; a null doc_id is not held out;
repeated rows count and are scored as often as they are there; without training documents every word is unknown.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, materialise, new_name, scratch_path, shuffle_partitions, splitmix, working

CHUNK = 2_000_000
#: Entries of a word shard or a trigram shard, on average.
SHARD = 1_000_000
HOT = 1_000_000
STEP = 1024
#: Values looked up together: their arrays stay in a core's cache.
BLOCK = 1 << 14
BOS, END, UNKNOWN, FIRST = 0, 1, 2, 3
_ID_BITS = 40
_U = np.uint64


# --- Elias-Fano


_BYTES = _U(0x0101010101010101)
_TOPS = _U(0x8080808080808080)
#: The place of the r-th one of each byte.
_IN_BYTE = np.array([[*(i for i in range(8) if b >> i & 1), *[0] * 8][:8] for b in range(256)], np.int64)


def _select(words: np.ndarray, before: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Places of the k-th ones (from 0) of a bit vector; before: ones in front of each word. Within a word by sums of its bytes."""
    at = np.searchsorted(before, k, side="right") - 1
    r, w = (k - before[at]).astype(np.uint64), words[at]
    s = w - ((w >> _U(1)) & _U(0x5555555555555555))
    s = (s & _U(0x3333333333333333)) + ((s >> _U(2)) & _U(0x3333333333333333))
    s = ((s + (s >> _U(4))) & _U(0x0F0F0F0F0F0F0F0F)) * _BYTES
    skip = ((((((r * _BYTES) | _TOPS) - s) & _TOPS) >> _U(7)) * _BYTES >> _U(56)) << _U(3)
    r -= (s << _U(8)) >> skip & _U(255)
    return at * 64 + skip.astype(np.int64) + _IN_BYTE[(w >> skip & _U(255)).astype(np.int64), r.astype(np.int64)]


class EliasFano:
    """A sequence that never falls: low bits packed, high bits as one for each value after a zero for each step."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray, zeros: np.ndarray) -> None:
        self.n, self.bits, self.low, self.high, self.ones, self.zeros = n, bits, low, high, ones, zeros

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = values.astype(np.uint64)
        n = len(v)
        universe = int(v[-1]) + 1 if n else 1
        bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        low = np.zeros(n * bits // 64 + 2, np.uint64)
        if bits:
            part = v & _U((1 << bits) - 1)
            at = np.arange(n, dtype=np.uint64) * _U(bits)
            word, off = (at >> _U(6)).astype(np.int64), at & _U(63)
            np.bitwise_or.at(low, word, part << off)
            over = np.flatnonzero(off + _U(bits) > 64)
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (_U(64) - off[over]))
        places = (v >> _U(bits)).astype(np.int64) + np.arange(n)
        size = (int(places[-1]) if n else 0) + 2
        flags = np.zeros((size + 63) // 64 * 64, bool)
        flags[places] = True
        high = np.packbits(flags, bitorder="little").view(np.uint64)
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)[:-1]]).astype(np.int64)
        return cls(n, bits, low, high, ones, np.arange(len(high)) * 64 - ones)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * _U(self.bits)
        word, off = (at >> _U(6)).astype(np.int64), at & _U(63)
        upper = np.where(off > 0, self.low[word + 1] << ((_U(64) - off) & _U(63)), _U(0))
        return (self.low[word] >> off | upper) & _U((1 << self.bits) - 1)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        """The values at places i."""
        top = (_select(self.high, self.ones, i) - i).astype(np.uint64)
        return top << _U(self.bits) | self._low(i)

    def find(self, x: np.ndarray) -> np.ndarray:
        """The place of each value, or -1: the bucket of the high bits, then a binary search by the low bits."""
        x, inverted = x.astype(np.uint64), ~self.high
        return np.concatenate([np.zeros(0, np.int64), *(self._find(x[i : i + BLOCK], inverted) for i in range(0, len(x), BLOCK))])

    def _find(self, x: np.ndarray, inverted: np.ndarray) -> np.ndarray:
        out = np.full(len(x), -1, np.int64)
        if not self.n:
            return out
        top = (x >> _U(self.bits)).astype(np.int64)
        some = np.flatnonzero(top <= int(self.high_zeros) - 1)
        x, top = x[some], top[some]
        # a bucket's ones follow the zero that ends the bucket before
        place = np.where(top > 0, _select(inverted, self.zeros, np.maximum(top - 1, 0)) + 1, 0)
        lo = place - top
        word, off = place >> 6, (place & 63).astype(np.uint64)
        following = np.where(off > 0, self.high[np.minimum(word + 1, len(self.high) - 1)] << ((_U(64) - off) & _U(63)), _U(0))
        run = ~(self.high[np.minimum(word, len(self.high) - 1)] >> off | following)
        size = np.bitwise_count((run & (~run + _U(1))) - _U(1)).astype(np.int64)
        long = np.flatnonzero(size > 63)
        if len(long):
            size[long] = _select(inverted, self.zeros, top[long]) - top[long] - lo[long]
        want = x & _U((1 << self.bits) - 1)
        left, hi = lo.copy(), lo + size
        open_ = np.flatnonzero(size > 8)
        while len(open_):
            mid = (left[open_] + hi[open_]) // 2
            less = self._low(mid) < want[open_]
            left[open_] = np.where(less, mid + 1, left[open_])
            hi[open_] = np.where(less, hi[open_], mid)
            open_ = open_[left[open_] < hi[open_]]
        open_, end = np.flatnonzero(left < lo + size), lo + size
        while len(open_):  # few are left in each bucket
            here = self._low(left[open_])
            out[some[open_[here == want[open_]]]] = left[open_[here == want[open_]]]
            open_ = open_[here < want[open_]]
            left[open_] += 1
            open_ = open_[left[open_] < end[open_]]
        return out

    @property
    def high_zeros(self) -> int:
        return len(self.high) * 64 - self.n

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.bits], np.int64), self.low, self.high, self.ones, self.zeros]

    @classmethod
    def load(cls, arrays: list[np.ndarray]) -> EliasFano:
        return cls(int(arrays[0][0]), int(arrays[0][1]), *arrays[1:])


# --- the trie


def _fixed(logs: np.ndarray) -> np.ndarray:
    """Base-10 logs of probabilities as 16-bit fixed point numbers, from 0 (1.0) on."""
    return np.clip(np.rint(-logs * STEP), 0, 65_535).astype(np.uint16)


def discounts(counts: np.ndarray) -> np.ndarray:
    """Discounts for counts 1, 2 and 3 or more, from the numbers of counts; 0.5, 1, 1.5 where there are too few."""
    n = np.bincount(np.minimum(counts, 5), minlength=6)[1:5].astype(float)
    if (n <= 0).any():
        return np.array([0.0, 0.5, 1.0, 1.5])
    y = n[0] / (n[0] + 2 * n[1])
    return np.array([0.0, *np.clip([k + 1 - (k + 2) * y * n[k + 1] / n[k] if k < 3 else 0 for k in range(3)], 0.05, [0.95, 1.95, 2.95])])


class Trie:
    """The part of the model that belongs to some middle words. Keys are ids with the word's own log probability on top."""

    LEVELS = ("words", "middles", "starts", "successors", "contexts", "trigrams")
    VALUES = ("middle_weight", "successor_logp", "context_weight", "trigram_logp")

    def __init__(self, data: bytes | memoryview | np.ndarray) -> None:
        """Opens a buffer (bytes or a mapped file) without copying its levels."""
        flat = np.frombuffer(data, np.uint8) if not isinstance(data, np.ndarray) else data
        n = int(flat[:8].view(np.int64)[0])
        sizes = flat[8 : 8 + 8 * n].view(np.int64).tolist()
        at, parts = 8 + 8 * n, []
        for size in sizes:
            parts.append(flat[at : at + size])
            at += -(-size // 8) * 8
        self.ranks = int(parts[0].view(np.int64)[0])
        for i, name in enumerate(self.LEVELS):
            a = parts[1 + 5 * i : 6 + 5 * i]
            setattr(self, name, EliasFano.load([a[0].view(np.int64), a[1].view(np.uint64), a[2].view(np.uint64), a[3].view(np.int64), a[4].view(np.int64)]))
        for i, name in enumerate(self.VALUES):
            setattr(self, name, parts[1 + 5 * len(self.LEVELS) + i].view(np.uint16))

    @classmethod
    def open(cls, path: str) -> Trie:
        """Maps a trie file."""
        return cls(np.memmap(path, np.uint8, "r"))

    @staticmethod
    def build(v: np.ndarray, u: np.ndarray, w: np.ndarray, c: np.ndarray, fixed: tuple[float, float, float] | None = None) -> bytes:
        """From distinct trigrams u v w with their counts, sorted by v, u, w; v may carry a class of predecessors.

        fixed: discounts for counts 1, 2 and more, instead of estimates.
        """
        given = np.array([0.0, *fixed]) if fixed else None
        words = np.unique(np.concatenate([v, u, w]))
        size = max(len(words), 1)
        tv, tu, tw = (np.searchsorted(words, x) for x in (v, u, w))
        context, of_context = np.unique(tv * size + tu, return_inverse=True)
        total = np.bincount(of_context, c, len(context))
        d = (discounts(c) if given is None else given)[np.minimum(c, 3)]
        context_weight = np.bincount(of_context, d, len(context)) / np.maximum(total, 1)
        # bigrams: the number of distinct words before
        successor, of_successor, before = np.unique(tv * size + tw, return_inverse=True, return_counts=True)
        middle, start, of_middle = np.unique(successor // size, return_index=True, return_inverse=True)
        sums = np.bincount(of_middle, before, len(middle))
        d2 = (discounts(before) if given is None else given)[np.minimum(before, 3)]
        middle_weight = np.bincount(of_middle, d2, len(middle)) / np.maximum(sums, 1)
        single = 10.0 ** -own_logp(words[successor % size])
        p2 = (before - d2) / np.maximum(sums[of_middle], 1) + middle_weight[of_middle] * single
        p3 = (c - d) / np.maximum(total[of_context], 1) + context_weight[of_context] * p2[of_successor]
        rank = of_successor - start[of_middle[of_successor]]
        ranks = int(rank.max(initial=0)) + 1
        levels = [EliasFano.of(x) for x in (words, middle, start, successor, context, of_context * ranks + rank)]
        with np.errstate(divide="ignore"):
            values = [_fixed(np.log10(x)) for x in (middle_weight, p2, context_weight, p3)]
        parts = [np.array([ranks], np.int64), *(a for e in levels for a in e.arrays()), *values]
        raw = [a.tobytes() for a in parts]
        head = np.array([len(raw), *map(len, raw)], np.int64).tobytes()
        return head + b"".join(x + b"\0" * (-len(x) % 8) for x in raw)

    def logp(self, v: np.ndarray, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Fixed-point log probabilities of w after u v."""
        size = max(self.words.n, 1)

        def place(x: np.ndarray) -> np.ndarray:
            some, back = np.unique(x, return_inverse=True)
            return self.words.find(some)[back]

        new = np.ones(len(v), bool)  # sorted trigrams ask for a context once
        new[1:] = (v[1:] != v[:-1]) | (u[1:] != u[:-1])
        tv, tu, tw = place(v[new]), place(u[new]), place(w)
        middle, context = np.full(len(tv), -1, np.int64), np.full(len(tv), -1, np.int64)
        ok = np.flatnonzero(tv >= 0)
        middle[ok] = self.middles.find(tv[ok])
        ok = np.flatnonzero((middle >= 0) & (tu >= 0))
        context[ok] = self.contexts.find(tv[ok] * size + tu[ok])
        of = np.cumsum(new) - 1
        tv, middle, context = tv[of], middle[of], context[of]
        both, third = np.full(len(v), -1, np.int64), np.full(len(v), -1, np.int64)
        ok = np.flatnonzero((middle >= 0) & (tw >= 0))
        both[ok] = self.successors.find(tv[ok] * size + tw[ok])
        ok = np.flatnonzero((context >= 0) & (both >= 0))
        third[ok] = self.trigrams.find(context[ok] * self.ranks + both[ok] - self.starts[middle[ok]].astype(np.int64))
        out = np.rint(own_logp(w) * STEP).astype(np.int64)
        ok = np.flatnonzero(middle >= 0)
        out[ok] += self.middle_weight[middle[ok]]
        ok = np.flatnonzero(both >= 0)
        out[ok] = self.successor_logp[both[ok]]
        ok = np.flatnonzero(context >= 0)
        out[ok] += self.context_weight[context[ok]]
        ok = np.flatnonzero(third >= 0)
        out[ok] = self.trigram_logp[third[ok]]
        return out


def own_logp(keys: np.ndarray) -> np.ndarray:
    """Minus log10 of the single-word probability that a key carries."""
    return (keys >> _U(_ID_BITS)).astype(np.float64) / STEP


def keyed(ids: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Ids with single-word probabilities on top; the first words of sentences are never predicted and carry none."""
    q = np.rint(-np.log10(p) * STEP).astype(np.uint64)
    return np.where(ids == BOS, _U(0), q) << _U(_ID_BITS) | ids.astype(np.uint64)


# --- arrays as compressed bytes


def _pack(a: np.ndarray) -> bytes:
    """Unsigned 64-bit numbers as byte planes, compressed: zero bytes cost nothing."""
    planes = np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return len(a).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpack(b: bytes) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    raw = pa.decompress(b[8:], 8 * n, "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).view("<u8").reshape(-1)


def _deltas(x: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Differences to the value before, but whole values where ``new`` is set; numbers wrap around."""
    out = x.copy()
    out[1:] -= np.where(new[1:], _U(0), x[:-1])
    return out


def _undeltas(d: np.ndarray, new: np.ndarray) -> np.ndarray:
    total = np.cumsum(d, dtype=np.uint64)
    at = np.flatnonzero(new)
    return total - np.repeat(total[at] - d[at], np.diff(np.append(at, len(d))))


def _pack_trigrams(v: np.ndarray, u: np.ndarray, w: np.ndarray, c: np.ndarray) -> bytes:
    first = np.zeros(len(v), bool)
    first[:1] = True
    other_v = first | np.concatenate([[True], v[1:] != v[:-1]])
    other_u = other_v | np.concatenate([[True], u[1:] != u[:-1]])
    parts = [_pack(x) for x in (_deltas(v, first), _deltas(u, other_v), _deltas(w, other_u), c.astype(np.uint64))]
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def _unpack_trigrams(b: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    parts, at = [], 0
    while at < len(b):
        n = int.from_bytes(b[at : at + 8], "little")
        parts.append(_unpack(b[at + 8 : at + 8 + n]))
        at += 8 + n
    first = np.zeros(len(parts[0]), bool)
    first[:1] = True
    v = _undeltas(parts[0], first)
    other_v = first | np.concatenate([[True], v[1:] != v[:-1]])
    u = _undeltas(parts[1], other_v)
    other_u = other_v | np.concatenate([[True], u[1:] != u[:-1]])
    return v, u, _undeltas(parts[2], other_u), parts[3].astype(np.int64)


# --- chunks

_CHUNKS = "chunk long, doc_ids array<long>, held binary, lengths binary, hashes binary, tokens binary, words long, trained long, trained_docs long"


def coded(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text, held_out) as chunks of word ids, one row for each."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids: dict[bytes, int] = defaultdict(count().__next__)
        doc_ids: list[int | None] = []
        held: list[bool] = []
        parts: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            nonlocal number, ids
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, ids), np.uint64, len(ids))
            order = np.argsort(hashes)
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            lengths = np.array([len(p) for p in parts], np.uint64)
            tokens = rank[np.concatenate(parts)] if len(order) else np.zeros(0, np.uint32)
            kept = ~np.array(held, bool)
            row = [number, list(doc_ids), np.array(held, np.uint8).tobytes(), _pack(lengths), hashes[order].tobytes(), _pack(tokens), len(order), int(lengths[kept].sum()), int(kept.sum())]
            number += 1
            ids = defaultdict(count().__next__)
            doc_ids.clear()
            held.clear()
            parts.clear()
            types = [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 4, *[pa.int64()] * 3]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], [c.split()[0] for c in _CHUNKS.split(", ")])

        size = 0
        for b in batches:
            for doc_id, text, out_of in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                words = (text.as_py() or b"").lower().split()  # bytes: only A-Z, and only ASCII white space
                if parts and size + len(words) > CHUNK:
                    yield out()
                    size = 0
                parts.append(np.fromiter(map(ids.__getitem__, words), np.int64, len(words)))
                doc_ids.append(doc_id)
                held.append(bool(out_of))
                size += len(words) + 1
        if parts:
            yield out()

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"), F.coalesce("held_out", F.lit(False)).alias("held_out"))
    return chosen.mapInArrow(work, _CHUNKS)


def _training(lengths: np.ndarray, held: np.ndarray) -> np.ndarray:
    return np.repeat(held == 0, lengths.astype(np.int64))


def word_ids(chunks: DataFrame, shards: int) -> DataFrame:
    """(chunk, shard, payload, n): ids and counts of each chunk's words, in the order of their hashes; n: a shard's trained words, once for each shard."""
    shift = _U(64 - (shards.bit_length() - 1))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, held, lengths, hashes, tokens in zip(*(b.column(c) for c in ("chunk", "held", "lengths", "hashes", "tokens")), strict=True):
                h = np.frombuffer(hashes.as_py(), np.uint64)
                t = _unpack(tokens.as_py()).astype(np.int64)
                c = np.bincount(t[_training(_unpack(lengths.as_py()), np.frombuffer(held.as_py(), np.uint8))], minlength=len(h)).astype(np.uint64)
                of = (h >> shift).astype(np.int64) if shards > 1 else np.zeros(len(h), np.int64)
                cuts = np.searchsorted(of, np.arange(shards + 1))
                some = np.flatnonzero(np.diff(cuts))
                payload = [len(p := _pack(h[cuts[s] : cuts[s + 1]])).to_bytes(8, "little") + p + _pack(c[cuts[s] : cuts[s + 1]]) for s in some]
                yield pa.RecordBatch.from_arrays([pa.array([chunk.as_py()] * len(some), pa.int64()), pa.array(some, pa.int32()), pa.array(payload, pa.binary())], ["chunk", "shard", "payload"])

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _by_shard(batches):
            hashes, counts = [], []
            for _, p in rows:
                n = int.from_bytes(p[:8], "little")
                hashes.append(_unpack(p[8 : 8 + n]))
                counts.append(_unpack(p[8 + n :]).astype(np.int64))
            words, back = np.unique(np.concatenate(hashes), return_inverse=True)
            total = np.bincount(back, np.concatenate(counts), len(words)).astype(np.int64)
            order = np.lexsort((words, -total))
            ids = np.empty(len(words), np.uint64)
            ids[order] = FIRST + np.arange(len(words), dtype=np.uint64) * _U(shards) + _U(shard)
            ids[total == 0] = UNKNOWN
            at, out = 0, []
            for h in hashes:
                mine = back[at : at + len(h)]
                at += len(h)
                p = _pack(ids[mine])
                out.append(len(p).to_bytes(8, "little") + p + _pack(total[mine]))
            n = [int((total > 0).sum())] + [0] * (len(rows) - 1)
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.int64()), pa.array([shard] * len(rows), pa.int32()), pa.array(out, pa.binary()), pa.array(n, pa.int64())], ["chunk", "shard", "payload", "n"])

    sent = chunks.select("chunk", "held", "lengths", "hashes", "tokens").mapInArrow(send, "chunk long, shard int, payload binary")
    return _to_shards(sent, shards).mapInArrow(give, "chunk long, shard int, payload binary, n long")


def _to_shards(rows: DataFrame, shards: int) -> DataFrame:
    return rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "chunk")


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    at, held = None, []
    for b in batches:
        for shard, chunk, payload in zip(b.column("shard").to_pylist(), b.column("chunk").to_pylist(), b.column("payload"), strict=True):
            if shard != at and held:
                yield at, held
                held = []
            at = shard
            held.append((chunk, payload.as_py()))
    if held:
        yield at, held


class _Chunk:
    """A chunk's distinct trigrams, sorted by shard, and where each token's trigram is among them."""

    def __init__(self, row: dict, ids: list[bytes], stats: tuple[int, int, int, int], shards: int) -> None:
        trained, vocabulary, trained_docs, hot = stats
        self.lengths = _unpack(row["lengths"]).astype(np.int64)
        self.held = np.frombuffer(row["held"], np.uint8)
        word_id, counts = [], []
        for p in ids:
            n = int.from_bytes(p[:8], "little")
            word_id.append(_unpack(p[8 : 8 + n]))
            counts.append(_unpack(p[8 + n :]))
        word_id = np.concatenate([*word_id, np.array([BOS, END], np.uint64)])
        counts = np.concatenate([*counts, np.array([trained_docs] * 2, np.uint64)]).astype(np.int64)
        n, docs = len(counts) - 2, len(self.lengths)
        # two starts, the words and an end for each document
        seq = np.full(int(self.lengths.sum()) + 3 * docs, n, np.int32)
        ends = np.cumsum(self.lengths + 3) - 1
        seq[ends] = n + 1
        predicted = np.ones(len(seq), bool)
        predicted[ends] = predicted[ends - self.lengths - 1] = predicted[ends - self.lengths - 2] = False
        seq[predicted] = _unpack(row["tokens"])
        predicted[ends] = True
        self.base = np.log10(counts + 0.5) - np.log10(trained + 0.5 * (vocabulary + 1))
        self.trained = counts > 0
        self.keys, code = np.unique(keyed(word_id, (counts + 0.5) / (trained + 0.5 * (vocabulary + 1))), return_inverse=True)
        occurs = np.zeros(len(self.keys), np.int64)
        occurs[code] = counts
        at = np.flatnonzero(predicted).astype(np.int32)
        del predicted
        self.tokens = seq[at]
        self.starts = np.cumsum(self.lengths + 1) - self.lengths - 1  # where each document starts among the predicted tokens
        x, size = code.astype(np.int32)[seq], len(self.keys)
        del seq
        key = x[at - 1].astype(np.int64)
        key *= size
        key += x[at - 2]
        if size < 1 << 21:
            key *= size
            key += x[at]
            triple, of = np.unique(key, return_inverse=True)
            v, u, w = triple // (size * size), triple // size % size, triple % size
        else:  # three codes do not fit 63 bits
            pair, key = np.unique(key, return_inverse=True)
            triple, of = np.unique(key * size + x[at], return_inverse=True)
            v, u, w = pair[triple // size] // size, pair[triple // size] % size, triple % size
        del key, triple, x, at
        self.of = of.astype(np.int32)
        c = np.bincount(self.of[np.repeat(self.held == 0, self.lengths + 1)], minlength=len(v))
        ident = self.keys & _U((1 << _ID_BITS) - 1)
        mixed, parts = splitmix(ident), np.maximum(1, -(-occurs // hot)).astype(np.uint64)
        part = mixed[u] % parts[v]
        shard = (splitmix(mixed[v] ^ part) % _U(shards)).astype(np.int64)
        shard[ident[v] == UNKNOWN] = -1  # nothing is known after an unknown word
        self.order = np.argsort(shard, kind="stable").astype(np.int32)
        self.shard, self.c, self.part = shard[self.order], c[self.order].astype(np.int32), part[self.order].astype(np.int32)
        self.v, self.u, self.w = (k[self.order].astype(np.int32) for k in (v, u, w))

    def payloads(self, shards: int) -> Iterator[tuple[int, bytes]]:
        cuts = np.searchsorted(self.shard, np.arange(shards + 1))
        for s in np.flatnonzero(np.diff(cuts)):
            mine = slice(cuts[s], cuts[s + 1])
            v, u, w = (self.keys[k[mine]] for k in (self.v, self.u, self.w))
            # the classes of a frequent word are contexts of their own; a shard may have several, so its entries are sorted again
            v ^= self.part[mine].astype(np.uint64) << _U(_ID_BITS)
            yield int(s), _pack_trigrams(v, u, w, self.c[mine])

    def scores(self, answers: list[bytes]) -> tuple[np.ndarray, ...]:
        """For each document: tokens, base score, score, known tokens."""
        unknown = int(np.searchsorted(self.shard, 0))
        q = np.empty(len(self.order), np.int32)
        q[self.order[:unknown]] = np.rint(own_logp(self.keys[self.w[:unknown]]) * STEP)
        at = unknown
        for a in answers:
            got = _unpack(a)
            q[self.order[at : at + len(got)]] = got
            at += len(got)
        total = lambda x, kind: np.add.reduceat(x, self.starts, dtype=kind) if len(self.starts) else np.zeros(0, kind)
        model = -total(q[self.of], np.int64) / STEP
        return self.lengths + 1, total(self.base[self.tokens], np.float64), model, total(self.trained[self.tokens], np.int64)


def _answers(rows: list[tuple[int, bytes]], fixed: tuple[float, float, float] | None) -> tuple[bytes, list[bytes]]:
    """The trie of a shard, and for each chunk the log probabilities of its trigrams."""
    parts = [_unpack_trigrams(p) for _, p in rows]
    v, u, w, c = (np.concatenate(x) for x in zip(*parts, strict=True))
    cuts = np.cumsum([0, *(len(p[0]) for p in parts)])
    del parts
    order = np.lexsort((w, u, v))
    v, u, w = v[order], u[order], w[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (u[1:] != u[:-1]) | (w[1:] != w[:-1])
    at = np.flatnonzero(new)
    total = np.add.reduceat(c[order], at)
    v, u, w = v[at], u[at], w[at]
    learnt = total > 0
    data = Trie.build(v[learnt], u[learnt], w[learnt], total[learnt], fixed)
    q = np.empty(len(order), np.uint64)
    q[order] = Trie(data).logp(v, u, w)[np.cumsum(new) - 1]
    return data, [_pack(q[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def score(docs: DataFrame, held_out_of: int = 5, remainder: int = 1, keep: str | None = None, fixed: tuple[float, float, float] | None = None) -> DataFrame:
    """Scores of all documents by a model of those whose crc32(doc_id) mod ``held_out_of`` is not ``remainder``.

    With ``keep``, the tries are written there as a Parquet table (shard, trie), one flat buffer in each row. ``fixed``: see :meth:`Trie.build`.
    """
    spark = docs.sparkSession
    held = crc_bucket(F.col("doc_id"), held_out_of) == remainder
    path, name = scratch_path(spark, "lm-chunks"), f"lm_chunks_{new_name()}"
    rows = coded(docs.select("doc_id", "text", held.alias("held_out")))
    buckets = shuffle_partitions(spark)
    rows.write.option("compression", "zstd").option("path", path).bucketBy(buckets, "chunk").format("parquet").saveAsTable(name)
    chunks = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only: the files are outside of the warehouse
    total = chunks.agg(F.sum("words"), F.sum("trained"), F.sum("trained_docs")).first()
    words, tokens, trained_docs = (x or 0 for x in total)
    trained = tokens + trained_docs
    word_shards = 1 << max(0, (words // SHARD).bit_length())
    ids = materialise(word_ids(chunks, word_shards), "lm-ids")
    vocabulary = (ids.agg(F.sum("n")).first()[0] or 0) + (trained_docs > 0)
    stats = (trained, vocabulary, trained_docs, HOT)
    shards = max(1, -(-tokens // SHARD))

    def joined(left: DataFrame, other: DataFrame, named: str) -> DataFrame:
        """Chunks with what belongs to them, in the order of shards. The table's buckets stay where they are."""
        by_chunk = other.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("shard", "payload"))).alias(named))
        return left.join(by_chunk, "chunk", "left")

    fields = ["chunk", "held", "lengths", "tokens"]
    with_ids = joined(chunks.select(*fields, "doc_ids"), ids, "ids")

    def one(b: pa.RecordBatch, i: int, extra: str) -> tuple[dict, list[bytes]]:
        row = {c: b.column(c)[i].as_py() for c in ("chunk", "held", "lengths", "tokens")}
        return row, [x["payload"] for x in b.column(extra)[i].as_py() or []]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("lm_score")
        for b in batches:
            for i in range(b.num_rows):
                row, mine = one(b, i, "ids")
                for s, p in _Chunk(row, mine, stats, shards).payloads(shards):
                    yield pa.RecordBatch.from_arrays([pa.array([row["chunk"]], pa.int64()), pa.array([s], pa.int32()), pa.array([p], pa.binary())], ["chunk", "shard", "payload"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("lm_score")
        for shard, entries in _by_shard(batches):
            data, out = _answers(entries, fixed)
            chunk = [c for c, _ in entries]
            if keep:
                chunk, out = [*chunk, None], [*out, data]
            yield pa.RecordBatch.from_arrays([pa.array(chunk, pa.int64()), pa.array([shard] * len(chunk), pa.int32()), pa.array(out, pa.binary())], ["chunk", "shard", "payload"])

    sent = with_ids.select(*fields, "ids").mapInArrow(send, "chunk long, shard int, payload binary")
    answers = materialise(_to_shards(sent, shards).mapInArrow(answer, "chunk long, shard int, payload binary"), "lm-answers")
    if keep:
        answers.where("chunk IS NULL").select("shard", F.col("payload").alias("trie")).write.parquet(keep)
    final = joined(with_ids, answers.where("chunk IS NOT NULL"), "answers")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("lm_score")
        for b in batches:
            for i in range(b.num_rows):
                row, mine = one(b, i, "ids")
                c = _Chunk(row, mine, stats, shards)
                n, base, model, known = c.scores([x["payload"] for x in b.column("answers")[i].as_py() or []])
                columns = [b.column("doc_ids")[i].values, pa.array(c.held == 1), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(n), trained), pa.int64()), pa.array(base, pa.float64()), pa.array(model, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return final.select(*fields, "doc_ids", "ids", "answers").mapInArrow(add, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
