"""Operator 3 [native]: mix sources to target weights by systematic sampling.

Sizes are counts of ``[^\\x20\\x09-\\x0D]+`` runs. Sources, ordered by code point with null last, take weights
3, 1, 2 in turn and share 150 % of all words; a target stops at twice its source's size and the excess goes
to the others by weight. Within a source every document expects ``target / source size`` copies; the prefix
sum of these, plus one offset per source drawn from its name, emits a copy at every integer it crosses.
Documents are taken in order of size class, so both long and short ones are sampled evenly and the words
taken stay near the target.

The prefix sum is distributed: documents are numbered inside (source, size class, shard), where a shard holds
about 1/4096 of all documents at most, and the few thousand shard totals are summed per source.

Defined results: null text has size 0; a source with no words has target 0 and takes nothing; repeated rows
are separate documents; columns other than doc_id, text and source are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, unused

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CEILING = 2
SHARDS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def source_targets(sizes: DataFrame) -> DataFrame:
    """One row per source: source_size, docs, target. Windows run over one row per source.

    The target is min(weight * level, 2 * size): sources are capped in order of 2 * size / weight until the
    level that shares the rest by weight lies below the next cap; later levels are no higher.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    k = (F.row_number().over(by_name) - 1) % len(WEIGHTS)
    weight = F.lit(0)
    for i, w in enumerate(WEIGHTS):
        weight = F.when(k == i, w).otherwise(weight)
    t = totals.withColumn("weight", weight.cast("double")).withColumn("cap", (F.col("source_size") * CEILING).cast("double"))
    everything = Window.partitionBy(F.lit(1))
    ratio = F.col("cap") / F.col("weight")
    before = Window.partitionBy(F.lit(1)).orderBy(ratio, F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("all_size", F.sum("source_size").over(everything)).withColumn("all_weight", F.sum("weight").over(everything))
    t = t.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("gone", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    t = t.withColumn("level", (F.col("all_size") * F.lit(SHARE) - F.col("capped")) / (F.col("all_weight") - F.col("gone")))
    t = t.withColumn("fits", F.when(F.col("level") <= ratio, F.col("level")))
    t = t.withColumn("level", F.max("fits").over(everything))
    target = F.least(F.col("cap"), F.coalesce(F.col("weight") * F.col("level"), F.col("cap")))
    return t.select("source", "source_size", "docs", target.alias("target"))


def _offset(source: F.Column) -> F.Column:
    """A multiple of 2^-20 in [0, 1), drawn from the source's name."""
    return F.conv(F.substring(F.md5(F.concat(F.lit("mix|"), F.coalesce(source, F.lit("<null>"))).cast("binary")), 1, 5), 16, 10).cast("long") / F.lit(1048576.0)


def copies(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, copies, source."""
    sizes = materialise(sized(docs), "mix-sizes")
    length = F.length(F.bin("size"))
    top = F.expr("shiftright(size, greatest(length(bin(size)) - 4, 0)) % 8")
    d = sizes.withColumn("size_class", (length * 8 + top).cast("int"))
    targets = materialise(source_targets(sizes), "mix-targets")
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    classes = d.groupBy("source", "size_class").agg(F.count(F.lit(1)).alias("n")).select(F.col("source").alias("c_source"), F.col("size_class").alias("c_class"), (1 + F.floor(F.col("n") * SHARDS / total)).cast("long").alias("shards"))
    same = F.col("source").eqNullSafe(F.col("c_source")) & (F.col("size_class") == F.col("c_class"))
    draw = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")
    d = d.join(classes, same, "left").select("doc_id", "source", "size", "size_class", F.pmod(draw, F.col("shards")).alias("shard"))
    d = materialise(d, "mix-order")
    key = ["source", "size_class", "shard"]
    in_source = Window.partitionBy("source").orderBy("size_class", "shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = d.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(in_source), F.lit(0)))
    shards = shards.join(targets.withColumnRenamed("source", "t_source"), F.col("source").eqNullSafe(F.col("t_source")))
    shards = shards.select(F.col("source").alias("s_source"), F.col("size_class").alias("s_class"), F.col("shard").alias("s_shard"), "before", "source_size", "target")
    at_shard = F.col("source").eqNullSafe(F.col("s_source")) & (F.col("size_class") == F.col("s_class")) & (F.col("shard") == F.col("s_shard"))
    d = d.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy("size", F.col("doc_id").asc_nulls_first())) - 1)
    d = d.join(shards, at_shard)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    low = F.floor(_offset(F.col("source")) + (F.col("before") + F.col("place")) * rate)
    high = F.floor(_offset(F.col("source")) + (F.col("before") + F.col("place") + 1) * rate)
    d = d.withColumn("copies", F.least(high - low, F.ceil(rate)).cast("long"))
    return d.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source")


def mix(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (all columns), each as often as the mix takes it.

    The draw is joined back by doc_id, source and size. Rows that share all three share their copies: each gets
    the whole part of the mean, and those whose text hash falls below the rest get one more.
    """
    doc, source, size, some, rows, times = unused(docs.columns, "mix_doc", "mix_source", "mix_size", "mix_copies", "mix_rows", "mix_times")
    key = [F.col("doc_id").alias(doc), F.col("source").alias(source), F.col("size").alias(size)]
    taken = copies(docs).groupBy(*key).agg(F.sum("copies").alias(some), F.count(F.lit(1)).alias(rows)).where(F.col(some) > 0)
    words = F.coalesce(F.regexp_count(docs.text, F.lit(WORD)), F.lit(0)).cast("long")
    d = docs.join(taken, docs.doc_id.eqNullSafe(F.col(doc)) & docs.source.eqNullSafe(F.col(source)) & (words == F.col(size)))
    each, rest = F.floor(F.col(some) / F.col(rows)), F.col(some) % F.col(rows)
    n = (each + (F.pmod(F.xxhash64(docs.text), F.col(rows)) < rest).cast("int")).cast("int")
    d = d.withColumn(times, F.explode(F.when(n > 0, F.sequence(F.lit(1), n))))
    return d.select(*(F.col(f"`{c}`") for c in docs.columns))


ORACLE = r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS docs FROM sizes GROUP BY source
), weighed AS (
  SELECT *, CAST(CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS weight,
    CAST(source_size * 2 AS DOUBLE) AS cap FROM totals
), ordered AS (
  SELECT *, sum(source_size) OVER () AS all_size, sum(weight) OVER () AS all_weight,
    coalesce(sum(cap) OVER o, 0.0) AS capped, coalesce(sum(weight) OVER o, 0.0) AS gone
  FROM weighed WINDOW o AS (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), levels AS (
  SELECT *, (CAST(all_size AS DOUBLE) * 1.5 - capped) / (all_weight - gone) AS level FROM ordered
), targets AS (
  SELECT source, source_size, docs, least(cap, coalesce(weight * max(CASE WHEN level <= cap / weight THEN level END) OVER (), cap)) AS target FROM levels
), classed AS (
  SELECT *, length(bin(size)) * 8 + (size >> CAST(greatest(length(bin(size)) - 4, 0) AS BIGINT)) % 8 AS size_class FROM sizes
), sharded AS (
  SELECT *, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT %
    CAST(1 + floor(count(*) OVER (PARTITION BY source, size_class) * 4096 / (SELECT count(*) FROM sizes)) AS BIGINT) AS shard FROM classed
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY size_class, shard, size, doc_id ASC NULLS FIRST) - 1 AS place FROM sharded
), joined AS (
  SELECT p.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
    ('0x' || substr(md5('mix|' || coalesce(p.source, '<null>')), 1, 5))::BIGINT / 1048576.0 AS shift
  FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source
), drawn AS (
  SELECT *, CAST(least(floor(CAST(shift AS DOUBLE) + (place + 1) * rate) - floor(CAST(shift AS DOUBLE) + place * rate), ceil(rate)) AS BIGINT) AS copies FROM joined
)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies, source FROM drawn
"""
