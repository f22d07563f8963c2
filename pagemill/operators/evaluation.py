"""Accuracy against references and engine comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.pandas_udfs import char_edits, nfc, sequence_ratio, word_edits

def word_distance(a: Column, b: Column) -> Column:
    """Edit distance of two arrays of words; a null array is an empty one."""
    none = F.array().cast("array<string>")
    return word_edits(F.coalesce(a, none), F.coalesce(b, none))


def cer_wer(pairs: DataFrame) -> DataFrame:
    """Adds cer and wer: edits of characters and words over the reference's length; 0 or 1 for an empty reference.

    A null reference or hypothesis is an empty one. Texts are of any length (see :func:`edits`).
    """
    d = pairs.withColumns({f"_{c[0]}": tx.collapsed(nfc(F.coalesce(c, F.lit("")))) for c in ("reference", "hypothesis")})
    d = d.withColumns({f"_{c}w": F.filter(F.split(f"_{c}", " "), lambda w: w != "") for c in "rh"})
    d = d.withColumns({"_ce": char_edits("_r", "_h"), "_we": word_edits("_rw", "_hw")})
    empty = F.when(F.col("_h") == "", 0.0).otherwise(1.0)
    rate = lambda edits, n: F.when(F.col("_r") == "", empty).otherwise(F.col(edits) / n)
    return d.withColumns({"cer": rate("_ce", F.length("_r")), "wer": rate("_we", F.size("_rw"))}).drop("_r", "_h", "_rw", "_hw", "_ce", "_we")


def eval_summary(scored: DataFrame, *by: str) -> DataFrame:
    """Mean of the rounded scores, per engine and more; summed as decimals, so that ties round alike everywhere."""
    n = F.count(F.lit(1))
    mean = lambda c: F.round(F.sum(F.round(c, 4).cast("decimal(18,4)")) / n, 4).cast("double").alias(f"mean_{c}")
    return scored.groupBy(*by).agg(n.alias("samples"), mean("cer"), mean("wer"))


def pair_eval(references: DataFrame, pages: DataFrame) -> DataFrame:
    """References with their hypothesis: the pages' texts in order with blank lines between."""
    text = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "text"))).alias("_p"))
    return references.join(text.select("doc_id", F.array_join(F.transform("_p", lambda p: p["text"]), "\n\n").alias("hypothesis")), "doc_id")


def text_accuracy(expected: Column, actual: Column) -> Column:
    return F.when(F.coalesce(expected, F.lit("")) != "", F.round(sequence_ratio(tx.loose(expected), tx.loose(actual)), 4))


def engine_delta(a: DataFrame, b: DataFrame, measures: tuple[str, ...] = ("latency_ms", "confidence", "text_accuracy", "f1")) -> DataFrame:
    """b - a per document; null where either is."""
    j = a.select("doc_id", *(F.col(m).alias(f"raw_{m}") for m in measures)).join(b.select("doc_id", *(F.col(m).alias(f"new_{m}") for m in measures)), "doc_id")
    return j.withColumns({f"delta_{m}": F.round(F.col(f"new_{m}") - F.col(f"raw_{m}"), 4) for m in measures})


def delta_summary(deltas: DataFrame, measures: tuple[str, ...] = ("latency_ms", "confidence", "text_accuracy", "f1")) -> DataFrame:
    cols = [F.round(F.avg(f"{s}_{m}"), 4).alias(f"{s}_avg_{m}") for m in measures for s in ("raw", "new")]
    return deltas.agg(F.count(F.lit(1)).alias("documents"), *cols)


def canary_compare(pages: DataFrame, base: str, canary: str) -> DataFrame:
    """(engine, failed, fallback, flagged, empty, latency_ms): the cohort measures and the thresholds they breach."""
    rate = lambda c: F.avg(F.col(c).cast("int"))
    per = pages.groupBy("engine").agg(rate("failed").alias("failed"), rate("fallback").alias("fallback"), rate("flagged").alias("flagged"), F.count(F.when(F.col("empty"), 1)).alias("empty"), F.expr("percentile_cont(0.95) WITHIN GROUP (ORDER BY latency_ms)").alias("p95"))
    x = per.where(F.col("engine") == base).select(F.col("failed").alias("base_failed"), F.col("p95").alias("base_p95"))
    y = per.where(F.col("engine") == canary).crossJoin(x)  # one row each
    out = {"breach_failure": F.col("failed") - F.col("base_failed") > 0.005, "breach_fallback": F.col("fallback") > 0.05, "breach_flags": F.col("flagged") > 0.01, "breach_latency": F.col("p95") > 2 * F.col("base_p95"), "breach_empty": F.col("empty") > 0}
    return y.withColumns(out).withColumn("abort", F.greatest(*out))
