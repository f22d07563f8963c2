"""Event analytics over OCR and reliability events.

``as_of`` is always explicit. Percentiles are exact and interpolated. Top-k results carry a unique tie-break.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Window argument -> label and length.
WINDOWS = {
    "1h": ("last_1h", timedelta(hours=1)),
    "6h": ("last_6h", timedelta(hours=6)),
    "": ("last_24h", timedelta(hours=24)),
    "24h": ("last_24h", timedelta(hours=24)),
    "7d": ("last_7d", timedelta(days=7)),
    "30d": ("last_30d", timedelta(days=30)),
}
#: The signals counted by :func:`litellm_signal_counts`.
LITELLM_SIGNALS = (
    "litellm_retry", "litellm_retry_cancelled", "litellm_circuit_reject", "litellm_circuit_open", "litellm_circuit_opened", "litellm_circuit_recovered", "litellm_response_rejected",
)


def parse_window(raw: str) -> tuple[str, timedelta]:
    if raw not in WINDOWS:
        raise ValueError("invalid window; accepted: 1h, 6h, 24h, 7d, 30d")
    return WINDOWS[raw]


def since(df: DataFrame, as_of: datetime, length: timedelta, column: str = "recorded_at") -> DataFrame:
    return df.where(F.col(column) >= F.lit(as_of - length))


def percentile(q: float, column: str) -> Column:
    return F.expr(f"percentile_cont({q}) WITHIN GROUP (ORDER BY {column})")


def missing(column: str) -> Column:
    """'' means missing."""
    return F.nullif(F.col(column), F.lit(""))


def hourly_volume(events: DataFrame, hours: int = 168) -> DataFrame:
    by = events.groupBy(F.date_trunc("hour", "recorded_at").alias("hour")).agg(F.count(F.lit(1)).alias("ocr_events"))
    return by.orderBy(F.desc("hour")).limit(hours)


def outcome_mix(events: DataFrame) -> DataFrame:
    by = events.groupBy("outcome").agg(F.count(F.lit(1)).alias("events"))
    total = F.sum("events").over(Window.partitionBy(F.lit(1)))  # one row per outcome
    return by.withColumn("pct", F.round(100.0 * F.col("events") / F.nullif(total, F.lit(0)), 2))


def latency_by(events: DataFrame, group: str, measure: str, least: int = 5) -> DataFrame:
    by = events.where(F.col(measure) > 0).groupBy(group).agg(F.count(F.lit(1)).alias("n"), *(percentile(q, measure).alias(f"p{round(q * 100)}_{measure}") for q in (0.5, 0.95, 0.99)))
    return by.where(F.col("n") >= least).withColumn(group, missing(group)).orderBy(F.desc_nulls_last(f"p95_{measure}"), group)


def top_failure_reasons(events: DataFrame, n: int = 20) -> DataFrame:
    by = events.groupBy("extraction_failure_reason").agg(F.count(F.lit(1)).alias("events"))
    return by.orderBy(F.desc("events"), "extraction_failure_reason").limit(n)


def slowest_events(events: DataFrame, n: int = 100) -> DataFrame:
    cols = ["recorded_at", "job_id", "outcome", "lang", "target", "extract_ms", "ocr_ms", "translate_ms", "total_ms", "extraction_failure_reason", "file"]
    return events.orderBy(F.desc("total_ms"), F.desc("recorded_at"), "id").limit(n).select(*cols)


def rolling_summary(events: DataFrame, as_of: datetime) -> DataFrame:
    """One row over the last 24 hours; success is ``succeeded`` only, zero latencies don't count."""
    recent = since(events, as_of, timedelta(hours=24))
    n = F.count(F.lit(1))
    ok = F.count(F.when(F.col("outcome") == "succeeded", 1))
    p95, p99 = (F.expr(f"percentile_cont({q}) WITHIN GROUP (ORDER BY total_ms) FILTER (WHERE total_ms > 0)") for q in (0.95, 0.99))
    return recent.agg(n.alias("events_24h"), p95.alias("p95_total_ms_24h"), p99.alias("p99_total_ms_24h"), F.round(100.0 * ok / F.nullif(n, F.lit(0)), 2).alias("success_rate_pct_24h"))


def reliability_hourly(events: DataFrame, as_of: datetime) -> DataFrame:
    recent = since(events, as_of, timedelta(days=7))
    return recent.groupBy(F.date_trunc("hour", "recorded_at").alias("hour"), "integration", "event_name").agg(F.count(F.lit(1)).alias("events"))


def reliability_top_reasons(events: DataFrame, as_of: datetime, n: int = 50) -> DataFrame:
    recent = since(events, as_of, timedelta(hours=24))
    by = recent.groupBy("integration", "event_name", missing("reason").alias("reason")).agg(F.count(F.lit(1)).alias("events"))
    return by.orderBy(F.desc("events"), "integration", "event_name", F.asc_nulls_first("reason")).limit(n)


def litellm_signal_counts(events: DataFrame, as_of: datetime) -> DataFrame:
    recent = since(events, as_of, timedelta(hours=24)).where((F.col("integration") == "litellm") & F.col("event_name").isin(*LITELLM_SIGNALS))
    return recent.groupBy("event_name").agg(F.count(F.lit(1)).alias("events"))


def ocr_signals_by_endpoint(events: DataFrame, as_of: datetime) -> DataFrame:
    recent = since(events, as_of, timedelta(hours=24)).where(F.col("integration") == "ocr")
    return recent.groupBy("event_name", missing("endpoint").alias("endpoint")).agg(F.count(F.lit(1)).alias("events"))


def windowed_summary(events: DataFrame, as_of: datetime, window: str = "24h") -> DataFrame:
    """One row; zero latencies count, success is ``succeeded`` or ``cached``, an empty window gives zeros."""
    label, length = parse_window(window)
    recent = since(events, as_of, length)
    n = F.count(F.lit(1))
    good = F.count(F.when(F.col("outcome").isin("succeeded", "cached"), 1))
    whole = recent.agg(
        n.alias("events_total"), good.alias("succeeded_total"), F.when(n == 0, 0.0).otherwise(good * 100.0 / n).alias("success_rate_pct"),
        *(F.coalesce(percentile(q, "total_ms"), F.lit(0.0)).alias(f"p{round(q * 100)}_total_ms") for q in (0.5, 0.95, 0.99)),
    )
    per = recent.groupBy("outcome").agg(n.alias("c"))
    outcomes = per.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("outcome", "c")))).alias("outcomes"))
    return whole.crossJoin(outcomes).select(F.lit(label).alias("window"), "*")  # one row each


def reliability_windowed(events: DataFrame, as_of: datetime, window: str = "24h") -> DataFrame:
    recent = since(events, as_of, parse_window(window)[1])
    return recent.groupBy("integration", "event_name", "reason").agg(F.count(F.lit(1)).alias("count")).orderBy("integration", "event_name", "reason")


def prune(events: DataFrame, as_of: datetime, retention: timedelta = timedelta(days=30), column: str = "recorded_at") -> tuple[DataFrame, DataFrame]:
    """Rows to keep, and one row with the number deleted. A row exactly at the cutoff stays."""
    old = F.col(column) < F.lit(as_of - retention)
    return events.where(~old), events.where(old).agg(F.count(F.lit(1)).alias("deleted_count"))
