"""Components of texts that are linked, from buckets of candidates and an exact check.

Items are known by a 64-bit hash of their content, so equal items are one item and copies are never
compared. A candidate table holds (key, id, role): two items that share a key, one of them with role 0,
may be linked. The work goes in three steps, each exact for what it covers:

1. In every bucket the smallest item is checked against all others and then leaves it. This is linear in the bucket,
   and in a bucket of true near copies it leaves one component. While buckets of more than ``FEW`` blocks (see 3) hold
   several components, this is done again, ``STARS`` times at most.
2. Buckets that hold one component only are done. What is left of small buckets (up to ``SMALL`` items) is compared
   pair by pair.
3. What is left of larger buckets is compared in blocks of about ``BLOCK`` items or ``BYTES`` bytes, whichever is less: a task
   holds the contents of two blocks, compares across components only, and gives a spanning forest of the links it finds. So
   the links made grow with the items of a bucket, not with their pairs; what is compared, and the contents copied for it (each item once for
   every block), grow with the square of what is left of the bucket over ``BLOCK``.

No bucket, pair or partner is dropped. The tables by key are reduced by combining aggregates and joined back, so that a
hot key is split by the skew join; only the first reading of the candidates uses a window, from which keys that hold
1/10000 of a sample (or eight of its rows) are kept apart: their smallest items come from a combining aggregate, a table of
at most 10,000 rows. The sample chooses the way, not the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import delete, materialise, working

SMALL = 4
BLOCK = 1024
BYTES = 8 << 20
FEW, STARS = 2, 3
BITS = 26
LEAST_HOT = 8
#: Share of the rows that is sampled to find hot keys.
SAMPLED = 0.01
Near = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
Verify = Callable[[bytes, bytes], bool]
#: contents -> (candidates, linked): candidates(i, js) narrows js to those that item i may be linked with, linked(i, j) decides.
Prepare = Callable[[list[bytes]], tuple[Callable[[int, np.ndarray], np.ndarray], Callable[[int, int], bool]]]


def bitmap(ids: DataFrame) -> np.ndarray:
    """A filter of 2^26 bits (8 MB, whatever the number of ids) that holds every value of column ``id``, a hash.

    It only saves work: beyond some 10^8 ids it is nearly full and lets all through, to the exact join that follows.
    """
    top = F.shiftrightunsigned("id", 64 - BITS)
    words = ids.select(F.shiftright(top, 6).alias("w"), F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(id, {64 - BITS}) % 64 AS INT))").alias("b"))
    got = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (BITS - 6), np.uint64)
    if got.num_rows:
        out[got.column("w").to_numpy().astype(np.int64)] = got.column("b").to_numpy().view(np.uint64)
    return out


def may_hold(words: np.ndarray, items: np.ndarray) -> np.ndarray:
    """Whether the filter holds each of these hashes (int64), or one that shares its place."""
    at = items.view(np.uint64) >> np.uint64(64 - BITS)
    return (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def _shared(candidates: DataFrame, sample: DataFrame) -> DataFrame:
    """The rows of buckets that hold two items or more, one of them with role 0; hub: the smallest item."""
    limit = max(LEAST_HOT, sample.count() // 10_000)
    hot = sample.groupBy("key").count().where(F.col("count") >= limit).select("key").limit(10_001)
    summary = [F.min("id").alias("hub"), F.max("id").alias("top"), F.min("role").alias("first")]
    w = Window.partitionBy("key")

    def windowed(rows: DataFrame) -> DataFrame:
        rows = rows.select("key", "id", "role", F.min("id").over(w).alias("hub"), F.max("id").over(w).alias("top"), F.min("role").over(w).alias("first"))
        return rows.where("hub < top AND first = 0").select("key", "id", "role", "hub")

    hot = materialise(hot, "hot-keys")
    if hot.isEmpty():
        return windowed(candidates)
    hot = F.broadcast(hot)  # each holds 1/10000 of the sample: at most 10,000 rows
    apart = candidates.join(hot, "key", "left_semi")
    hubs = F.broadcast(apart.groupBy("key").agg(*summary).where("hub < top AND first = 0").drop("top", "first"))
    return windowed(candidates.join(hot, "key", "left_anti")).unionByName(apart.join(hubs, "key").select("key", "id", "role", "hub"))


def _verified(pairs: DataFrame, store: DataFrame, near: Near, verify: Verify) -> DataFrame:
    """The pairs (a, b) that are linked: sizes and signatures are compared first, then the contents."""
    p = pairs
    for side in ("a", "b"):
        p = p.join(store.select(F.col("id").alias(side), F.col("size").alias(f"size_{side}"), F.col("sig").alias(f"sig_{side}")), side)

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sigs = [np.stack([np.frombuffer(x, np.uint8) for x in b.column(c).to_pylist()]).astype(np.int16) for c in ("sig_a", "sig_b")]
            apart = np.abs(sigs[0] - sigs[1]).sum(1)
            ok = near(b.column("size_a").to_numpy(), b.column("size_b").to_numpy(), apart)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(ok))

    p = p.mapInArrow(likely, "a long, b long")
    for side in ("a", "b"):
        p = p.join(store.select(F.col("id").alias(side), F.col("payload").alias(f"payload_{side}")), side)

    def sure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [verify(x.as_py(), y.as_py()) for x, y in zip(b.column("payload_a"), b.column("payload_b"), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return p.mapInArrow(sure, "a long, b long")


def components(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """(id, component) of every linked item; component: the smallest id. Alternating star contraction.

    A round joins every item with the smallest item it knows, until nothing moves. With ``rounds`` it stops
    sooner: items of one component may then have several labels, but never the label of another one.
    """
    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    state, done = None, 0
    while rounds is None or done < rounds:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        small = small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct()
        before, edges, done = edges, materialise(small, "edges"), done + 1
        delete(before)
        if rounds is None:
            now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.shiftright(F.xxhash64("v", "u"), 32))).first()
            if now == state:
                break
            state = now
    least = edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
    roots = edges.select(F.col("v").alias("id")).distinct().join(edges.select(F.col("u").alias("id")), "id", "left_anti")
    return least.unionByName(roots.select("id", F.col("id").alias("component")))


def forest(mine: np.ndarray, ids: np.ndarray, roles: np.ndarray, labels: np.ndarray, contents: list[bytes], prepare: Prepare) -> list[tuple[int, int]]:
    """Links between the two blocks of a task (or inside its only block) that join different components: a spanning forest."""
    across = len(np.unique(mine)) > 1
    candidates, linked = prepare(contents)
    labels, found = np.unique(labels, return_inverse=True)[1], []
    for i in range(len(ids)):
        js = (mine != mine[i]) if across else (np.arange(len(ids)) > i)
        js = js & (labels != labels[i]) & (ids != ids[i])
        if roles[i]:
            js &= roles == 0
        if across and mine[i] != mine[0]:
            continue
        for j in candidates(i, np.flatnonzero(js)):
            if labels[j] != labels[i] and linked(i, int(j)):
                labels[labels == labels[j]] = labels[i]
                found.append((int(ids[i]), int(ids[j])))
    return found


def _blocks(rest: DataFrame, store: DataFrame, prepare: Prepare, operator: str) -> DataFrame:
    """Links across components in larger buckets (rest: key, id, role, component, blocks), a spanning forest of each pair of blocks."""
    r = rest.withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    r = r.select("key", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "id", "role", "component")
    r = r.join(store.select("id", "payload"), "id").select("key", "lo", "hi", "mine", "id", "role", "component", "payload")
    r = r.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "mine", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working(operator)
        held: list[pa.RecordBatch] = []

        def done() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            mine, ids, roles, labels = (t.column(c).to_numpy() for c in ("mine", "id", "role", "component"))
            pairs = forest(mine, ids, roles, labels, t.column("payload").to_pylist(), prepare)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([min(p) for p in pairs], pa.int64()), pa.array([max(p) for p in pairs], pa.int64())], ["a", "b"])

        at = None
        for b in batches:
            if not b.num_rows:
                continue
            where = np.stack([b.column(c).to_numpy() for c in ("key", "lo", "hi")])
            cuts = [0, *(np.flatnonzero((where[:, 1:] != where[:, :-1]).any(0)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                here = tuple(where[:, lo].tolist())
                if here != at and held:
                    yield done()
                at = here
                held.append(b.slice(lo, hi - lo))
        if held:
            yield done()

    return r.mapInArrow(run, "a long, b long")


def link(candidates: DataFrame, sample: DataFrame, store_of: Callable[[DataFrame], DataFrame], near: Near, verify: Verify, prepare: Prepare, operator: str) -> DataFrame:
    """(id, component) of every item that is linked with another one.

    candidates and sample: (key long, id long, role int), the second over a sample of the first.
    store_of(ids) -> (id, size, sig, payload) for those ids; sig: one byte per bin.
    near(sizes, sizes, L1 distance of signatures): false only where no link is possible.
    """
    members = materialise(_shared(candidates, sample), "buckets")
    store = materialise(store_of(members.select("id").distinct()).dropDuplicates(["id"]), "store")
    weights = store.select("id", F.octet_length("payload").alias("bytes"))
    rest, links = members.select("key", "id", "role", "hub").distinct(), None
    for turn in range(STARS):
        hubs = rest.where("hub IS NOT NULL AND id <> hub")
        found = _verified(hubs.select(F.least("hub", "id").alias("a"), F.greatest("hub", "id").alias("b")).distinct(), store, near, verify)
        found = materialise(found, "links")
        links = found if links is None else links.unionByName(found)
        labels = components(links, rounds=2)
        left = rest.where("hub IS NULL OR id <> hub").select("key", "id", "role").join(labels, "id", "left").join(weights, "id")
        left = left.select("key", "id", "role", "bytes", F.coalesce("component", "id").alias("component"))
        by_key = left.groupBy("key").agg(
            F.min("component").alias("lo"), F.max("component").alias("top"), F.min("role").alias("first"), F.count(F.lit(1)).alias("n"),
            F.sum("bytes").alias("all"), F.min("id").alias("next"), F.min_by("component", "id").alias("own"),
        ).where("lo < top AND first = 0")
        blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("all") / BYTES)).cast("int").alias("blocks")
        left = left.join(by_key.select("key", "n", blocks, "next", "own"), "key")
        # the next hub's own component needs no check with it
        hub = F.when((F.col("component") != F.col("own")) | (F.col("id") == F.col("next")), F.col("next"))
        rest = materialise(left.select("key", "id", "role", "component", "n", "blocks", hub.alias("hub")), "rest")
        if rest.where(F.col("blocks") > FEW).isEmpty():
            break
    x, y = (rest.where(F.col("n") <= SMALL).select("key", F.col("id").alias(i), F.col("role").alias(f"r{i}"), F.col("component").alias(f"c{i}")) for i in "ab")
    pairs = x.join(y, "key").where("a < b AND ca <> cb AND (ra = 0 OR rb = 0)").select("a", "b").distinct()
    links = links.unionByName(materialise(_verified(pairs, store, near, verify), "links"))
    links = links.unionByName(materialise(_blocks(rest.where(F.col("n") > SMALL), store, prepare, operator), "links"))
    return components(links)
