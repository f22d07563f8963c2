"""Counters at each sample, one alert rule over wide rows, and promoted warnings (W02, W03, W20). The rules over long samples are in ``series``.

Rows without a time are in no window: they keep their place in the result, with a null increase, and as neither escalated nor demoted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``condition`` over the columns of a wide sample row must hold for ``hold_s`` seconds."""

    name: str
    condition: str
    hold_s: int
    severity: str


def seconds(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp")) / F.lit(1_000_000.0)


def trailing(rows: DataFrame, keys: list[str], at: str, size: int, value: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows of a series from ``size`` before a row up to it, rows of its own time included.

    A series is cut into slices of ``size``. A row's window has the rows of its slice up to it, a running sum, and those of the slice before from
    ``size`` before it on: these rows also go to the next slice, ``size`` later, where they are a running sum from the end. So the work
    doesn't grow with the rows in a window, and nothing is subtracted. Rows must have a time.
    """
    d = rows.withColumn("_in", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_slice", F.floor(F.col(at) / size) + F.col("_in")).withColumn("_k", F.col(at) + F.col("_in") * size)
    part = Window.partitionBy(*keys, "_slice")
    own = F.sum(F.when(F.col("_in") == 0, value)).over(part.orderBy("_k"))
    older = F.sum(F.when(F.col("_in") == 1, value)).over(part.orderBy(F.desc("_k")))
    return d.withColumns({"_own": own, "_older": older}).where("_in = 0").withColumn(name, F.coalesce(F.col("_own") + F.col("_older"), "_own", "_older")).drop("_in", "_slice", "_k", "_own", "_older")


def counter_increase(samples: DataFrame, window_s: int, tie: str = "event_id") -> DataFrame:
    """Increase over the window per series (metric, label); a drop is a reset and counts from 0. No extrapolation.

    A series is cut into slices as long as the window: the value before a slice comes from the last ones of the slices before it
    (one row per slice), and the sum over a window needs the rows of its slice and of the one before. So no task holds
    the history of a series.
    """
    size, series = window_s * 1_000_000, ["metric", "label"]
    untimed = samples.where("ts IS NULL").withColumn("increase", F.lit(None).cast("double"))
    d = samples.where("ts IS NOT NULL").withColumn("_s", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("_at", F.floor(F.col("_s") / size))
    last = d.groupBy(*series, "_at").agg(F.max_by("value", F.struct("ts", tie)).alias("_last"))
    last = last.select(*(F.col(c).alias(f"_{c}") for c in series), F.col("_at").alias("_before"), F.lag("_last").over(Window.partitionBy(*series).orderBy("_at")).alias("_carried"))
    same = d.metric.eqNullSafe(F.col("_metric")) & d.label.eqNullSafe(F.col("_label")) & (F.col("_at") == F.col("_before"))
    d = d.join(last, same).drop("_metric", "_label", "_before")
    before = F.coalesce(F.lag("value").over(Window.partitionBy(*series, "_at").orderBy("ts", tie)), F.col("_carried"))
    step = F.when(before.isNull(), 0.0).when(F.col("value") < before, F.col("value")).otherwise(F.col("value") - before)
    d = trailing(d.withColumn("_d", step), series, "_s", size, F.col("_d"), "increase")
    return d.drop("_d", "_s", "_at", "_carried").unionByName(untimed)


def alert_eval(rows: DataFrame, rules: tuple[Rule, ...], key: str = "label") -> DataFrame:
    """Samples at which a rule fires: its condition has held since a start at least ``hold_s`` ago.

    Rules over columns that ``rows`` lacks are errors. Runs are found within days; the run that is open as a day begins is
    carried into it (one row per series, rule and day), so no task holds the history of a series.
    """
    out = []
    for r in rules:
        holds = F.coalesce(F.expr(r.condition), F.lit(False))
        out.append(F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), F.lit(r.hold_s).alias("hold_s"), holds.alias("holds")))
    d = rows.select(key, "ts", F.inline(F.array(*out))).withColumn("_day", F.floor(seconds("ts") / 86_400))
    part = [key, "rule", "_day"]
    w = Window.partitionBy(*part).orderBy("ts", "holds")
    d = d.withColumn("_island", F.sum(F.when(F.col("holds").eqNullSafe(F.lag("holds").over(w)), 0).otherwise(1)).over(w))
    d = d.withColumn("_start", F.min("ts").over(Window.partitionBy(*part, "_island")))
    carried = _open_runs(d, key).select(F.col(key).alias("_k"), F.col("rule").alias("_r"), F.col("_day").alias("_d"), "_carried")
    d = d.where("holds").join(carried, F.col(key).eqNullSafe(F.col("_k")) & (F.col("rule") == F.col("_r")) & (F.col("_day") == F.col("_d")))
    d = d.withColumn("since", F.when(F.col("_island") == 1, F.coalesce("_carried", "_start")).otherwise(F.col("_start")))
    return d.where(seconds("ts") - seconds("since") >= F.col("hold_s")).select(key, "ts", "rule", "severity", "since")


def _open_runs(d: DataFrame, key: str) -> DataFrame:
    """Per series, rule and day: the start of the run that is open as the day begins; null without one. Windows over one row per day."""
    last = F.max_by(F.struct("holds", "_start"), F.struct("ts", "holds"))
    days = d.groupBy(key, "rule", "_day").agg(F.min("holds").alias("all_hold"), F.min("ts").alias("first"), last.alias("last"))
    days = days.withColumn("open", F.when(F.col("all_hold"), F.col("first")).when(F.col("last.holds"), F.col("last._start")))
    by_day = Window.partitionBy(key, "rule").orderBy("_day")
    days = days.withColumn("_stretch", F.sum(F.when(F.col("all_hold"), 0).otherwise(1)).over(by_day))
    at_end = F.first("open", ignorenulls=True).over(Window.partitionBy(key, "rule", "_stretch").orderBy("_day").rowsBetween(Window.unboundedPreceding, 0))
    return days.withColumn("_end", at_end).withColumn("_carried", F.lag("_end").over(by_day))


def promote_warnings(alerts: DataFrame, key: str = "label", tie: str = "event_id") -> DataFrame:
    """warn alerts with 3 or more in the last hour are escalated; two stable windows before a row demote it."""
    hour, warn = 3600, F.col("level") == "warn"
    untimed = alerts.where("ts IS NULL").withColumns({"warns_1h": F.lit(0).cast("long"), "escalate": F.lit(False), "demote": F.lit(False)})
    d = alerts.where("ts IS NOT NULL").withColumn("_s", F.unix_timestamp("ts")).withColumn("_at", F.floor(F.col("_s") / hour))
    order = Window.partitionBy(key, "_at").orderBy("ts", tie)
    d = d.withColumns({"_n": F.row_number().over(order), "_p1": F.lag("level", 1).over(order), "_p2": F.lag("level", 2).over(order)})
    # the two rows before an hour's first: from the last two of each of the two hours with rows before it
    newest = Window.partitionBy(key, "_at").orderBy(F.desc("ts"), F.desc(tie))
    tail = d.withColumn("_m", F.row_number().over(newest)).where("_m <= 2").groupBy(key, "_at").agg(F.array_sort(F.collect_list(F.struct("_m", "level"))).alias("_t"))
    by_hour = Window.partitionBy(key).orderBy("_at")
    both = F.concat(*(F.coalesce(F.lag("_t", i).over(by_hour), F.expr("CAST(array() AS array<struct<_m:int,level:string>>)")) for i in (1, 2)))
    tail = tail.select(F.col(key).alias("_k"), F.col("_at").alias("_h"), F.transform(both, lambda x: x["level"]).alias("_c"))
    d = d.join(tail, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_at") == F.col("_h")))
    one = F.when(F.col("_n") > 1, F.col("_p1")).otherwise(F.get("_c", F.lit(0)))
    two = F.when(F.col("_n") > 2, F.col("_p2")).otherwise(F.get("_c", 2 - F.col("_n")))
    calm = F.coalesce((one == "ok") & (two == "ok"), F.lit(False))
    d = trailing(d.withColumn("demote", calm), [key], "_s", hour, warn.cast("int"), "warns_1h").withColumn("warns_1h", F.coalesce("warns_1h", F.lit(0)))
    out = d.withColumn("escalate", F.coalesce(warn & (F.col("warns_1h") >= 3), F.lit(False)))
    return out.select(*alerts.columns, "warns_1h", "escalate", "demote").unionByName(untimed)
