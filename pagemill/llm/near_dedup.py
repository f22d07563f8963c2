"""Operator 8: near-duplicate documents by fast similarity sketching.

Words are ``[^\\x20\\x09-\\x0D]+`` runs after lower-casing A-Z; a document's set holds its distinct four-word
shingles (five in the pipeline), or the whole sequence if it has fewer words. The sketch has ``BANDS *
ROWS`` coordinates. Every round hashes each element to a bin and a value; round i >= t sends all elements
to bin i - t, so after 2t rounds every coordinate is filled, by the smallest value of the earliest round
that reached it. Documents that agree on all rows of a band are candidates: at a likeness of 0.8 a pair
misses all 50 bands of 6 rows with a probability below 3e-7. Links are confirmed on the full sets
(:mod:`linking`), so no false link stands.

Defined results: texts without words have an empty set and are linked with nothing; equal sets are one item
and always linked; rows with null doc_id take no part (component null, kept true); repeated rows share their
component and are all kept if theirs is the smallest id. Other columns are not read. Sets are identified by
a 64-bit hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linking
from .common import CACHES, materialise, splitmix, unused, working
from .linking import bitmap, link, may_hold

SHINGLE = 4
BANDS, ROWS = 50, 6
BINS = 64
ROWS_AT_ONCE = 2000
RARE, COLUMNS = 32, 1024
PERCENT = 80
_SEEDS = splitmix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ODD = splitmix(np.arange(101, 117, dtype=np.uint64)) | np.uint64(1)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Words()
CACHES.append(_WORDS.clear)


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingle hashes of a text (uint64)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    if len(h) <= width:
        total = (h * _ODD[: len(h)]).sum(dtype=np.uint64, keepdims=True)
        return splitmix(total + np.uint64(len(h) % width))
    n = len(h) - width + 1
    total = h[:n] * _ODD[0]
    for i in range(1, width):
        total += h[i : i + n] * _ODD[i]
    return np.unique(splitmix(total))


def sketch(values: np.ndarray, t: int = BANDS * ROWS) -> np.ndarray:
    """Fast similarity sketch: t values, each the round (upper 16 bits) and the smallest hash of that round in its bin."""
    out = np.full(t, np.iinfo(np.uint64).max, np.uint64)
    at, n = 0, len(values)
    while at < 2 * t and (at == 0 or out.max() == np.iinfo(np.uint64).max):
        rounds = np.arange(at, min(2 * t, at + max(1, ceil(1.2 * t * log(t) / n) if at == 0 else ceil(t / n))))
        h = splitmix(values[None, :] ^ _SEEDS[rounds][:, None])
        bins = ((h >> np.uint64(40)) * np.uint64(t)) >> np.uint64(24)
        late = rounds >= t
        bins[late] = (rounds[late] - t).astype(np.uint64)[:, None]
        v = (rounds.astype(np.uint64) << np.uint64(48))[:, None] | (splitmix(h) >> np.uint64(16))
        np.minimum.at(out, bins.ravel().astype(np.int64), v.ravel())
        at = int(rounds[-1]) + 1
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    s = sketch(values).reshape(BANDS, ROWS)
    mixed = splitmix((s * _ODD[:ROWS]).sum(1, dtype=np.uint64))
    return splitmix(mixed + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _near(a: np.ndarray, b: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Likeness >= 0.8 needs sizes within 0.8 and at most (a + b) / 9 unshared elements."""
    return (100 * np.minimum(a, b) >= PERCENT * np.maximum(a, b)) & (9 * apart <= a + b)


def _linked(a: bytes, b: bytes) -> bool:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * shared >= PERCENT * (len(x) + len(y) - shared)


def _all_shared(contents: list[bytes]):
    """For the sets of a block: the sizes of all intersections at once.

    Elements that up to ``RARE`` sets hold are counted pair by pair, the others by products of indicator matrices,
    ``COLUMNS`` elements at a time.
    """
    sets = [np.frombuffer(c, np.uint64) for c in contents]
    n, sizes = len(sets), np.array([len(s) for s in sets])
    value, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    by = np.argsort(value, kind="stable")
    value, owner = value[by], owner[by]
    start = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
    held = np.diff(np.r_[start, len(value)])
    element, held = np.repeat(np.arange(len(start)), held), np.repeat(held, held)
    shared = np.zeros((n, n), np.float32)
    rare = (held > 1) & (held <= RARE)
    o, v = owner[rare], element[rare]
    for d in range(1, RARE):
        same = v[d:] == v[:-d]
        if not same.any():
            break
        a, b = o[:-d][same], o[d:][same]
        shared += np.bincount(a * n + b, minlength=n * n).reshape(n, n)
    shared += shared.T
    often = held > RARE
    o, v = owner[often], np.unique(element[often], return_inverse=True)[1]
    for lo in range(0, int(v[-1]) + 1 if len(v) else 0, COLUMNS):
        a, b = np.searchsorted(v, [lo, lo + COLUMNS])
        part = np.zeros((n, COLUMNS), np.float32)
        part[o[a:b], v[a:b] - lo] = 1
        shared += part @ part.T

    def candidates(i: int, js: np.ndarray) -> np.ndarray:
        both = shared[i, js].astype(np.int64)
        return js[100 * both >= PERCENT * (sizes[i] + sizes[js] - both)]

    return candidates, lambda i, j: True


def _set_id(values: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(values.tobytes(), digest_size=8).digest(), "little", signed=True)


def near_groups(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept."""
    return _fates(docs, width).drop("mark")


def _fates(docs: DataFrame, width: int) -> DataFrame:
    """As :func:`near_groups`, with mark, a hash of the text."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("near_dedup")
        seen: set[int] = set()
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS_AT_ONCE):
                b = whole.slice(lo, ROWS_AT_ONCE)
                sizes, ids, keys = [], [], []
                for i, text in zip(b.column(0), b.column(1), strict=True):
                    s = shingles(text.as_py(), width)
                    sizes.append(len(s))
                    ids.append(_set_id(s) if len(s) and i.is_valid else None)
                    # copies within a task give their bands once
                    keys.append(None if ids[-1] is None or ids[-1] in seen else band_keys(s))
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(ids[-1])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "mark", "n_shingles", "id", "keys"])

    marked = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    base = materialise(marked.mapInArrow(describe, "doc_id long, mark long, n_shingles long, id long, keys array<long>"), "sets")
    able = base.where("keys IS NOT NULL")

    def candidates(rows: DataFrame) -> DataFrame:
        return rows.select(F.explode("keys").alias("key"), "id", F.lit(0).alias("role"))

    def store_of(ids: DataFrame) -> DataFrame:
        # one text of each set is enough; the others are not cut into shingles again
        texts = base.where("id IS NOT NULL").join(ids, "id", "left_semi").groupBy("id").agg(F.min("mark").alias("mark"))
        held = docs.sparkSession.sparkContext.broadcast(bitmap(texts.select(F.col("mark").alias("id"))))  # 8 MB at any size

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            working("near_dedup")
            seen: set[int] = set()
            out: list[tuple] = []
            size = 0
            for b in batches:
                for text in b.column(0).filter(pa.array(may_hold(held.value, b.column(1).to_numpy()))):
                    s = shingles(text.as_py(), width)
                    i = _set_id(s)
                    if i in seen or not len(s):
                        continue
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(i)
                    bins = np.minimum(np.bincount((s >> np.uint64(58)).astype(np.int64), minlength=BINS), 255).astype(np.uint8)
                    out.append((i, len(s), bins.tobytes(), s.tobytes()))
                    size += 8 * len(s)
                    if size > 4 << 20:
                        yield rows_of(out)
                        out, size = [], 0
            yield rows_of(out)

        kinds = pa.schema([("id", pa.int64()), ("size", pa.int64()), ("sig", pa.binary()), ("payload", pa.binary())])

        def rows_of(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kinds.types[k]) for k in range(4)], schema=kinds)

        return docs.select("text", F.xxhash64("text").alias("mark")).mapInArrow(sets, "id long, size long, sig binary, payload binary").join(ids, "id", "left_semi")

    groups = link(candidates(able), candidates(able.sample(linking.SAMPLED, seed=7)), store_of, _near, _linked, _all_shared, "near_dedup")
    firsts = base.where("id IS NOT NULL").groupBy("id").agg(F.min("doc_id").alias("first"))
    firsts = materialise(firsts.join(groups, "id", "left"), "firsts")
    least = firsts.where("component IS NOT NULL").groupBy("component").agg(F.min("first").alias("least"))
    by_set = materialise(firsts.join(least, "component", "left").select("id", F.coalesce("least", "first").alias("component_id")), "components")
    found = base.select("doc_id", "mark", "n_shingles", "id")
    linked = found.where("id IS NOT NULL").join(by_set, "id").select("doc_id", "mark", "n_shingles", "component_id")
    alone = found.where("id IS NULL").select("doc_id", "mark", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "mark")


def keep_one(docs: DataFrame, width: int = 5) -> DataFrame:
    """The rows of ``docs`` that stay: one document per group. Rows that share a doc_id are decided by their own texts."""
    doc, mark = unused(docs.columns, "gone_doc", "gone_mark")
    gone = _fates(docs, width).where("NOT kept").select(F.col("doc_id").alias(doc), F.col("mark").alias(mark)).distinct()
    return docs.join(gone, (docs.doc_id == F.col(doc)) & (F.xxhash64(docs.text) == F.col(mark)), "left_anti")
