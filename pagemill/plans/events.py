"""Queries over OCR and reliability events."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from ..operators import events as op
from ..sources import results as rs
from .registry import Tables, query, scratch

NOW = "(SELECT max(recorded_at) FROM {})"
OCR_NOW, REL_NOW = NOW.format("ocr_events"), NOW.format("reliability_events")


@query("A01_hourly_volume", "ocr_events", oracle="SELECT date_trunc('hour', recorded_at) AS hour, count(*) AS ocr_events FROM ocr_events GROUP BY 1 ORDER BY 1 DESC LIMIT 168")
def _(t: Tables):
    return op.hourly_volume(t["ocr_events"])


@query("A02_outcome_mix", "ocr_events", oracle="SELECT outcome, count(*) AS events, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct FROM ocr_events GROUP BY outcome")
def _(t: Tables):
    return op.outcome_mix(t["ocr_events"])


def _latency(group: str, measure: str) -> str:
    cols = ", ".join(f"quantile_cont({measure}, {q}) AS p{n}_{measure}" for q, n in ((0.5, 50), (0.95, 95), (0.99, 99)))
    return f"SELECT nullif({group}, '') AS {group}, count(*) AS n, {cols} FROM ocr_events e WHERE {measure} > 0 GROUP BY e.{group} HAVING count(*) >= 5"


@query("A03_ocr_latency_by_lang", "ocr_events", oracle=_latency("lang", "ocr_ms"))
def _(t: Tables):
    return op.latency_by(t["ocr_events"], "lang", "ocr_ms")


@query("A04_total_latency_by_target", "ocr_events", oracle=_latency("target", "total_ms"))
def _(t: Tables):
    return op.latency_by(t["ocr_events"], "target", "total_ms")


@query("A05_top_failure_reasons", "ocr_events", oracle="SELECT extraction_failure_reason, count(*) AS events FROM ocr_events GROUP BY 1 ORDER BY events DESC, 1 LIMIT 20")
def _(t: Tables):
    return op.top_failure_reasons(t["ocr_events"])


@query("A06_slowest_events", "ocr_events", oracle="SELECT recorded_at, job_id, outcome, lang, target, extract_ms, ocr_ms, translate_ms, total_ms, extraction_failure_reason, file FROM ocr_events ORDER BY total_ms DESC, recorded_at DESC, id LIMIT 100")
def _(t: Tables):
    return op.slowest_events(t["ocr_events"])


@query("A07_rolling_24h_summary", "ocr_events", oracle=f"""
SELECT count(*) AS events_24h, quantile_cont(total_ms, 0.95) FILTER (WHERE total_ms > 0) AS p95_total_ms_24h, quantile_cont(total_ms, 0.99) FILTER (WHERE total_ms > 0) AS p99_total_ms_24h,
  round(100.0 * count(*) FILTER (WHERE outcome = 'succeeded') / nullif(count(*), 0), 2) AS success_rate_pct_24h
FROM ocr_events WHERE recorded_at >= {OCR_NOW} - INTERVAL 24 HOUR""")
def _(t: Tables):
    return op.rolling_summary(t["ocr_events"], t.as_of())


@query("A08_reliability_hourly", "reliability_events", oracle=f"SELECT date_trunc('hour', recorded_at) AS hour, integration, event_name, count(*) AS events FROM reliability_events WHERE recorded_at >= {REL_NOW} - INTERVAL 7 DAY GROUP BY 1, 2, 3")
def _(t: Tables):
    return op.reliability_hourly(t["reliability_events"], t.as_of("reliability_events"))


@query("A09_reliability_top_reasons", "reliability_events", oracle=f"SELECT integration, event_name, nullif(reason, '') AS reason, count(*) AS events FROM reliability_events e WHERE recorded_at >= {REL_NOW} - INTERVAL 24 HOUR GROUP BY integration, event_name, e.reason ORDER BY events DESC, integration, event_name, e.reason LIMIT 50")
def _(t: Tables):
    return op.reliability_top_reasons(t["reliability_events"], t.as_of("reliability_events"))


@query("A10_litellm_signal_counts", "reliability_events", oracle=f"SELECT event_name, count(*) AS events FROM reliability_events WHERE recorded_at >= {REL_NOW} - INTERVAL 24 HOUR AND integration = 'litellm' AND event_name IN {op.LITELLM_SIGNALS} GROUP BY 1")
def _(t: Tables):
    return op.litellm_signal_counts(t["reliability_events"], t.as_of("reliability_events"))


@query("A11_ocr_signals_by_endpoint", "reliability_events", oracle=f"SELECT event_name, nullif(endpoint, '') AS endpoint, count(*) AS events FROM reliability_events e WHERE recorded_at >= {REL_NOW} - INTERVAL 24 HOUR AND integration = 'ocr' GROUP BY event_name, e.endpoint")
def _(t: Tables):
    return op.ocr_signals_by_endpoint(t["reliability_events"], t.as_of("reliability_events"))


@query("A12_windowed_summary", "ocr_events", oracle=f"""
SELECT 'last_24h' AS "window", count(*) AS events_total, count(*) FILTER (WHERE outcome IN ('succeeded', 'cached')) AS succeeded_total,
  count(*) FILTER (WHERE outcome IN ('succeeded', 'cached')) * 100.0 / count(*) AS success_rate_pct,
  quantile_cont(total_ms, 0.5) AS p50_total_ms, quantile_cont(total_ms, 0.95) AS p95_total_ms, quantile_cont(total_ms, 0.99) AS p99_total_ms,
  count(*) FILTER (WHERE outcome = 'succeeded') AS succeeded, count(*) FILTER (WHERE outcome = 'cached') AS cached
FROM ocr_events WHERE recorded_at >= {OCR_NOW} - INTERVAL 24 HOUR""")
def _(t: Tables):
    s = op.windowed_summary(t["ocr_events"], t.as_of())
    return s.select(*[c for c in s.columns if c != "outcomes"], F.col("outcomes")["succeeded"].alias("succeeded"), F.col("outcomes")["cached"].alias("cached"))


@query("A13_reliability_windowed", "reliability_events", oracle=f"SELECT integration, event_name, reason, count(*) AS count FROM reliability_events WHERE recorded_at >= {REL_NOW} - INTERVAL 7 DAY GROUP BY ALL")
def _(t: Tables):
    return op.reliability_windowed(t["reliability_events"], t.as_of("reliability_events"), "7d")


@query("P07_window_arg", "ocr_events", oracle=" UNION ALL ".join(f"SELECT '{k}' AS arg, '{label}' AS label, count(*) AS events FROM ocr_events WHERE recorded_at >= {OCR_NOW} - INTERVAL {round(d.total_seconds())} SECOND" for k, (label, d) in op.WINDOWS.items()))
def _(t: Tables):
    now, e = t.as_of(), t["ocr_events"]
    hits = [F.count(F.when(F.col("recorded_at") >= F.lit(now - d), 1)).alias(k or "default") for k, (_, d) in op.WINDOWS.items()]
    rows = F.array(*(F.struct(F.lit(k).alias("arg"), F.lit(label).alias("label"), F.col(k or "default").alias("events")) for k, (label, _) in op.WINDOWS.items()))
    return e.agg(*hits).select(F.inline(rows))


@query("S10_retention_prune", "reliability_events", oracle=f"SELECT count(*) FILTER (WHERE recorded_at >= {REL_NOW} - INTERVAL 10 DAY) AS kept_count, count(*) FILTER (WHERE recorded_at < {REL_NOW} - INTERVAL 10 DAY) AS deleted_count FROM reliability_events")
def _(t: Tables):
    path = scratch(t.spark, "retention-table")
    rs.write_events(t["reliability_events"], path)
    gone = rs.prune_events(t.spark, path, t.as_of("reliability_events"), timedelta(days=10))
    return t.spark.read.parquet(path).agg(F.count(F.lit(1)).alias("kept_count"), F.lit(gone).cast("long").alias("deleted_count"))


@query("W01_share_of_total", "reliability_events", oracle="SELECT event_name, count(*) AS events, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM reliability_events GROUP BY 1")
def _(t: Tables):
    from pyspark.sql import Window

    by = t["reliability_events"].groupBy("event_name").agg(F.count(F.lit(1)).alias("events"))
    return by.withColumn("share", F.round(F.col("events") / F.sum("events").over(Window.partitionBy(F.lit(1))), 6))


@query("T01_topk", "ocr_events", oracle="SELECT job_id, lang, total_ms FROM ocr_events ORDER BY total_ms DESC, lang DESC, id LIMIT 50")
def _(t: Tables):
    return t["ocr_events"].orderBy(F.desc("total_ms"), F.desc("lang"), "id").limit(50).select("job_id", "lang", "total_ms")


@query("T02_nulls_last", "ocr_events", oracle="SELECT id, nullif(lang, '') AS lang FROM ocr_events ORDER BY nullif(lang, '') DESC NULLS LAST, id LIMIT 100")
def _(t: Tables):
    return t["ocr_events"].select("id", op.missing("lang").alias("lang")).orderBy(F.desc_nulls_last("lang"), "id").limit(100)
