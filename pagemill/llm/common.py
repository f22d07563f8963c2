"""Shared helpers: table access, scratch tables in the shared folder, stable hashes."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Functions that free what this worker process remembers between tasks.
CACHES: list[Callable[[], None]] = []
_WORKING = ""
#: Of each thread, so that pipelines in several threads of a driver keep their scratch tables apart.
_COLLECTORS = threading.local()


def working(operator: str) -> None:
    """Called by tasks: what another operator's tasks have left in this reused worker process is freed."""
    global _WORKING
    if operator != _WORKING:
        for clear in CACHES:
            clear()
        pa.default_memory_pool().release_unused()
        _WORKING = operator


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see, ``spark.checkpoint.dir``.

    Where it is unset, a new temporary folder, but only with local masters: there driver and executors are one process.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir is not set: this cluster has no folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='pagemill-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_name() -> str:
    return uuid.uuid4().hex


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/pagemill-{name}-{new_name()}"
    for made in getattr(_COLLECTORS, "lists", ()):
        made.append(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a Parquet table in the shared folder and read it back.

    Cuts the lineage: what follows reruns from the written files when an executor is lost.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def delete(*tables: DataFrame | str) -> None:
    """Delete scratch tables (or folders). Only for callers that have stored every result built on them."""
    spark = SparkSession.getActiveSession()
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for t in tables:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t if isinstance(t, str) else t.scratch)
        path.getFileSystem(conf).delete(path, True)


@contextmanager
def collecting(made: list[str]) -> Iterator[None]:
    """Adds the paths of the scratch tables made inside to ``made``, whose owner deletes them when their results are stored."""
    before = getattr(_COLLECTORS, "lists", ())
    _COLLECTORS.lists = (*before, made)
    try:
        yield
    finally:
        _COLLECTORS.lists = before


def unused(names: list[str], *wanted: str) -> list[str]:
    """The wanted column names, lengthened until they clash with none of ``names`` (upper and lower case are the same)."""
    taken, out = {n.lower() for n in names}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def crc_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null ids count as remainder -1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus, F.lit(-1))


def splitmix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64, over a uint64 array."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ranged_by_id(docs: DataFrame, parts: int, descending: bool, carry_edges: bool) -> DataFrame:
    """Deal (doc_id, text) rows to ``parts`` contiguous ranges of doc_id, each sorted.

    Adds ``part`` (0 is the lowest range) and ``edge``. With ``carry_edges`` each range also gets, as rows
    with ``edge`` true at its end, the first rows of the range that follows it in descending order (the
    lowest range gets those of the highest). Null ids count as smallest. The bounds are quantiles of
    doc_id alone, one per partition; a range that shares one doc_id can't be divided further.
    """
    from pyspark.ml.feature import Bucketizer

    spark = docs.sparkSession
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").cast("double").alias("_key"))
    bounds: list[float] = []
    if parts > 1:
        bounds = sorted(set(d.approxQuantile("_key", [i / parts for i in range(1, parts)], 0.1 / parts)))
    splits = [-float("inf"), *bounds, float("inf")]
    d = d.withColumn("_key", F.coalesce("_key", F.lit(-1.7976931348623157e308)))
    d = Bucketizer(splits=splits, inputCol="_key", outputCol="_part").setHandleInvalid("keep").transform(d) if bounds else d.withColumn("_part", F.lit(0))
    d = d.select("doc_id", "text", F.col("_part").cast("int").alias("part"))
    if carry_edges:
        from pyspark.sql import Window

        w = Window.orderBy("part")
        whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        tops = (
            d.groupBy("part").agg(F.max("doc_id").alias("top"), F.count("doc_id").alias("ids"))
            .select(F.col("part").alias("_from"), "top", F.coalesce(F.lead("part").over(w), F.first("part").over(whole)).alias("_to"))
        )
        # tops has one row per range, at most `parts`
        d = (
            d.join(F.broadcast(tops), d.part == tops._from, "left")
            .withColumn("_t", F.expr("CASE WHEN doc_id <=> top THEN array(struct(part AS p, false AS e), struct(_to AS p, true AS e)) ELSE array(struct(part AS p, false AS e)) END"))
            .select("doc_id", "text", F.explode("_t").alias("_t"))
            .select("doc_id", "text", F.col("_t.p").alias("part"), F.col("_t.e").alias("edge"))
        )
    else:
        d = d.withColumn("edge", F.lit(False))
    order = F.col("doc_id").desc_nulls_last() if descending else F.col("doc_id").asc_nulls_first()
    n = max(1, len(splits) - 1)
    return d.repartitionById(n, F.col("part")).sortWithinPartitions("part", "edge", order, "text")
