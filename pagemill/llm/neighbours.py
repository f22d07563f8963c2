"""Operator 6: approximate nearest neighbours by a permutation index.

``PIVOTS`` vectors, chosen by a hash of vec_id, are the pivots (a bounded sample; every row is indexed). A
vector is represented by its ``LENGTH`` nearest pivots in order, and posted in the inverted files of these
pivots with its place there. A query reads the files of its own nearest pivots; the footrule distance (the sum of
the shifts of places, a missing pivot counting as place LENGTH) ranks the vectors, and of each shard the best
``SHARE`` (at least ``LEAST``) are ranked again by their true distance.

Rows have a number of their own, which the written index keeps. They are dealt to shards of about ``SHARD`` by it, each vector once;
the queries, one row in 100, are copied to every shard, where a task holds the shard's files and lets the queries stream past. Recall
against brute force is measured in the tests.

Defined results: vectors that are null, zero or hold null or non-finite components, and rows with null
vec_id, take no part; vectors of another length than the most frequent one take no part either; with fewer than
``K`` candidates all are returned. Rows that share a vec_id are rows like others: each one that asks has ranks of its own, and finds the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

PIVOTS, LENGTH = 256, 128
SHARE, LEAST = 0.1, 500
SHARD = 8192
K = 10
EVERY = 100


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, v (array<double>) of the vectors that take part."""
    d = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return d.where(whole & F.exists("v", lambda x: x != 0))


def orders(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The nearest pivots of each vector, in order; ties go to the earlier pivot."""
    d = (v**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2 * v @ pivots.T
    return np.argsort(d, axis=1, kind="stable")[:, :LENGTH].astype(np.int16)


class InvertedFiles:
    """The posting lists of one shard: for each pivot the vectors that have it, with its place."""

    def __init__(self, order: np.ndarray, pivots: int) -> None:
        n, self.length = order.shape
        flat = order.ravel().astype(np.int64)
        by = np.argsort(flat, kind="stable")
        self.vector = (by // self.length).astype(np.int64)
        self.place = (by % self.length).astype(np.int64)
        self.start = np.searchsorted(flat[by], np.arange(pivots + 1))
        self.n = n

    def footrule(self, query: np.ndarray) -> np.ndarray:
        m = self.length
        # as if no pivot were shared; each shared one then replaces its two penalties by its shift
        out = np.full(self.n, m * (m + 1), np.int64)
        for place, pivot in enumerate(query):
            a, b = self.start[pivot], self.start[pivot + 1]
            p = self.place[a:b]
            out[self.vector[a:b]] += np.abs(p - place) - (m - p) - (m - place)
        return out


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.values.to_numpy(zero_copy_only=False).reshape(len(flat), -1) if len(flat) else np.zeros((0, 1))


def search(rows: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row whose vec_id is divisible by 100."""
    d = usable(rows)
    widths = d.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not widths:
        return rows.sparkSession.createDataFrame([], schema)
    d = materialise(d.where(F.size("v") == widths[0].w).withColumn("row", F.monotonically_increasing_id()), "vectors")
    n = d.count()
    # a bounded sample: PIVOTS distinct vectors
    chosen = d.groupBy("v").agg(F.min("vec_id").alias("vec_id")).orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS)
    pivots = rows.sparkSession.sparkContext.broadcast(np.array([r.v for r in chosen.collect()]))
    shards = max(1, -(-n // SHARD))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                o = orders(_matrix(pa.chunked_array([b.column(1)])), pivots.value)
                width = o.shape[1]
                at = pa.array(np.arange(0, o.size + 1, width, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(at, pa.array(o.ravel()))], ["vec_id", "v", "row", "pivots"])

    # written once: both sides below read it
    indexed = materialise(d.mapInArrow(index, "vec_id long, v array<double>, row long, pivots array<short>"), "permutations")
    base = indexed.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")).withColumn("asks", F.lit(False))
    asked = indexed.where(F.col("vec_id") % EVERY == 0).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("asks", F.lit(True))
    dealt = base.unionByName(asked).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "asks", "vec_id", "row")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, files = None, [], None
        ids = own = v = None
        for b in batches:
            of, asks = b.column("shard").to_numpy(), b.column("asks").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((of[1:] != of[:-1]) | (asks[1:] != asks[:-1])) + 1).tolist(), b.num_rows] if b.num_rows else []
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                part = b.slice(lo, hi - lo)
                if of[lo] != shard:
                    shard, held, files = of[lo], [], None
                if not asks[lo]:
                    held.append(part)
                    continue
                if files is None and held:
                    whole = pa.Table.from_batches(held)
                    ids, own, v = whole.column("vec_id").to_numpy(), whole.column("row").to_numpy(), _matrix(whole.column("v"))
                    files, held = InvertedFiles(_matrix(whole.column("pivots")), len(pivots.value)), []
                if files is not None:
                    yield _answers(part, ids, own, v, files, k)

    found = dealt.mapInArrow(near, "row long, query_id long, vec_id long, score double")
    w = Window.partitionBy("row").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _answers(queries: pa.RecordBatch, ids: np.ndarray, own: np.ndarray, v: np.ndarray, files: InvertedFiles, k: int) -> pa.RecordBatch:
    """The k nearest rows of a shard, sorted by vec_id, that each query finds in it."""
    keep = min(len(ids), max(LEAST, int(SHARE * len(ids))))
    asked, out = pa.Table.from_batches([queries]), []
    for row, q, x, o in zip(asked.column("row").to_numpy(), asked.column("vec_id").to_numpy(), _matrix(asked.column("v")), _matrix(asked.column("pivots")), strict=True):
        ranked = files.footrule(o)
        ranked[own == row] = np.iinfo(np.int64).max
        best = _smallest(ranked, keep)
        best = best[own[best] != row]
        far = np.sqrt(((v[best] - x) ** 2).sum(1))
        first = np.lexsort((ids[best], far))[:k]
        out.append((np.full(len(first), row), np.full(len(first), q), ids[best[first]], far[first]))
    names = ["row", "query_id", "vec_id", "score"]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names)


def _smallest(values: np.ndarray, n: int) -> np.ndarray:
    """Places of the n smallest values, ties by place."""
    limit = np.partition(values, n - 1)[n - 1]
    low = np.flatnonzero(values < limit)
    return np.concatenate([low, np.flatnonzero(values == limit)[: n - len(low)]])
