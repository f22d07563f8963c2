"""Lifecycle events: queries, contract, counters, timelines, objectives, incidents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Events that every correlation should have.
REQUIRED_EVENTS = ("job_created", "ocr_started", "ocr_completed", "translation_started", "chunk_retry", "provider_failover", "render_started", "render_completed", "export_completed", "job_completed")
REQUIRED_FIELDS = ("event", "job_id", "correlation_id", "provider", "event_time")


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def ratio(a: Column, b: Column) -> Column:
    """0 where the denominator is 0."""
    return F.when(b == 0, 0.0).otherwise(a / b)


def query_lifecycle(events: DataFrame, correlation_id: str = "", job_id: str = "", event: str = "", limit: int = 100) -> DataFrame:
    for column, value in (("correlation_id", correlation_id), ("job_id", job_id), ("event", event)):
        if value:
            events = events.where(F.col(column) == value)
    return events.orderBy(F.desc("event_time"), F.desc("event_id")).limit(limit if limit > 0 else 100)


def invalid_events(events: DataFrame) -> DataFrame:
    """Events without a required field or with a negative counter, with the reasons."""
    empty = [F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", F.lit(f"missing {c}")) for c in REQUIRED_FIELDS]
    below = [F.when(F.col(c) < 0, F.lit(f"negative {c}")) for c in ("duration_ms", "retry_count", "queue_depth")]
    return events.withColumn("reasons", F.array_compact(F.array(*empty, *below))).where(F.size("reasons") > 0)


def missing_events(events: DataFrame, key: str = "correlation_id") -> DataFrame:
    """Required events that a correlation lacks."""
    need = F.array(*(F.lit(x) for x in REQUIRED_EVENTS))
    have = events.groupBy(key).agg(F.collect_set("event").alias("have"))
    return have.select(key, F.array_sort(F.array_except(need, "have")).alias("missing"))


def pipeline_snapshot(events: DataFrame) -> DataFrame:
    """One row of counters, latencies and ratios; negative durations count as 0."""
    e, ms = F.col("event"), F.greatest(F.col("duration_ms"), F.lit(0))
    out = {"retries_total": "chunk_retry", "failovers_total": "provider_failover", "chunk_started_total": "chunk_started", "chunk_completed_total": "chunk_completed", "export_started_total": "export_started", "export_completed_total": "export_completed", "job_failed_total": "job_failed", "job_completed_total": "job_completed"}
    cols = [count_if(e == v).alias(k) for k, v in out.items()]
    timed = {"ocr": e == "ocr_completed", "translation": (e == "translation_started") & (F.col("duration_ms") > 0), "render": e == "render_completed"}
    for name, when in timed.items():
        total, n = F.coalesce(F.sum(F.when(when, ms)), F.lit(0)), count_if(when)
        cols += [total.alias(f"{name}_total_ms"), n.alias(f"{name}_count"), ratio(total, n).alias(f"{name}_avg_ms")]
    for name in ("chunk", "export"):
        cols.append(ratio(count_if(e == f"{name}_completed"), count_if(e == f"{name}_started")).alias(f"{name}_success_rate"))
    return events.agg(*cols)


def queue_wait(jobs: DataFrame) -> DataFrame:
    """started_at - created_at in milliseconds, not below 0."""
    ms = F.greatest(F.expr("timestampdiff(MILLISECOND, created_at, started_at)"), F.lit(0))
    total, n = F.coalesce(F.sum(ms), F.lit(0)), F.count(ms)
    return jobs.agg(total.alias("total_ms"), n.alias("count"), ratio(total, n).alias("avg_ms"))


def timeline(events: DataFrame) -> DataFrame:
    """Events of a correlation in order, with the time since the one before."""
    w = Window.partitionBy("correlation_id").orderBy("event_time", "event_id")
    gap = F.expr("timestampdiff(MILLISECOND, prev, event_time)")
    return events.withColumn("step", F.row_number().over(w)).withColumn("prev", F.lag("event_time").over(w)).select("correlation_id", "step", "event", "event_time", gap.alias("gap_ms"))


def dedupe_events(events: DataFrame) -> DataFrame:
    """One event per job, event, attempt and time."""
    return events.dropDuplicates(["job_id", "event", "retry_count", "event_time"])


def state_changes(rows: DataFrame, key: str, order: list[str], payload: list[str], terminal: Column) -> DataFrame:
    """Rows that differ from the one before in ``payload``, up to the first terminal one."""
    w = Window.partitionBy(key).orderBy(*order)
    now = F.to_json(F.struct(*payload))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    d = rows.withColumn("_now", now).withColumn("_prev", F.lag("_now").over(w)).withColumn("_over", F.coalesce(F.max(terminal.cast("int")).over(before), F.lit(0)))
    return d.where((F.col("_over") == 0) & ~F.col("_now").eqNullSafe(F.col("_prev"))).drop("_now", "_prev", "_over")


def latest_n(rows: DataFrame, owner: str | None, n: int, *order: Column) -> DataFrame:
    """The newest n rows per owner, or of all."""
    if owner is None:
        return rows.orderBy(*order).limit(n)
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(owner).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


#: Most seconds of a day's median job, from its creation to the event named, by the kind of its type.
LATENCY_OBJECTIVES = {"image": ("translate_image", "render_completed", 8.0), "pdf": ("translate_pdf", "job_completed", 180.0)}


def job_latencies(events: DataFrame, jobs: DataFrame) -> DataFrame:
    """day, image_p50_s, pdf_p50_s: medians over the jobs created that day that came to their end; null without any."""
    at = lambda name, pick: pick(F.when(F.col("event") == name, F.col("event_time")))
    ends = {k: at(end, F.max).alias(f"_{k}") for k, (_, end, _) in LATENCY_OBJECTIVES.items()}
    per = events.where("job_id IS NOT NULL").groupBy("job_id").agg(at("job_created", F.min).alias("_begin"), *ends.values()).join(jobs.select("job_id", "type").distinct(), "job_id")
    took = {k: (F.unix_micros(F.col(f"_{k}").cast("timestamp")) - F.unix_micros(F.col("_begin").cast("timestamp"))) / 1e6 for k in LATENCY_OBJECTIVES}
    per = per.select(F.to_date("_begin").alias("day"), *(F.when((F.col("type") == kind) & (took[k] >= 0), took[k]).alias(k) for k, (kind, _, _) in LATENCY_OBJECTIVES.items()))
    return per.where("day IS NOT NULL").groupBy("day").agg(*(F.expr(f"percentile_cont(0.5) WITHIN GROUP (ORDER BY {k})").alias(f"{k}_p50_s") for k in LATENCY_OBJECTIVES))


def slo_attainment(events: DataFrame, jobs: DataFrame | None = None) -> DataFrame:
    """Daily objectives: OCR success >= 99 %, translation >= 99.5 %, render >= 99 %, retries per chunk p95 <= 3, and with ``jobs``
    (job_id, type) the median latencies of image and PDF jobs; two missed days in a row ask for action. An objective without
    jobs is met.
    """
    e = F.col("event")
    day = events.groupBy(F.to_date("event_time").alias("day")).agg(
        ratio(count_if(e == "ocr_completed"), count_if(e == "ocr_started")).alias("ocr_success"),
        ratio(count_if(e == "chunk_completed"), count_if(e == "translation_started")).alias("translation_completion"),
        ratio(count_if(e == "render_completed"), count_if(e == "render_started")).alias("render_completion"),
        F.expr("percentile_cont(0.95) WITHIN GROUP (ORDER BY retry_count) FILTER (WHERE event = 'chunk_retry')").alias("retries_p95"),
        F.max("queue_depth").alias("max_queue_depth"),
    )
    met = (F.col("ocr_success") >= 0.99) & (F.col("translation_completion") >= 0.995) & (F.col("render_completion") >= 0.99) & (F.coalesce(F.col("retries_p95"), F.lit(0.0)) <= 3)
    if jobs is not None:
        slow = job_latencies(events, jobs)
        day = day.join(slow.withColumnRenamed("day", "_day"), F.col("day").eqNullSafe(F.col("_day")), "left").drop("_day")
        for k, (_, _, most) in LATENCY_OBJECTIVES.items():
            met = met & F.coalesce(F.col(f"{k}_p50_s") <= most, F.lit(True))
    backlog = F.when(F.col("max_queue_depth") > 1000, "critical").when(F.col("max_queue_depth") > 500, "warn").otherwise("ok")
    w = Window.partitionBy(F.lit(1)).orderBy("day")  # one row per day
    day = day.withColumn("met", met).withColumn("backlog", backlog)
    return day.withColumn("action_item", ~F.col("met") & ~F.coalesce(F.lag("met").over(w), F.lit(True)))


def incident_summary(events: DataFrame, signals: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """Per correlation: events, stage counts, severity and its reasons, in the order of the checks.

    signals (correlation_id, queue_depth, retry_backlog, provider_timeouts, provider_retries, degraded, render_fallback). With ``scores``
    (correlation_id, provider, score) also the provider with the lowest score, the first by name on ties, and its score.
    """
    stages = events.groupBy("correlation_id", F.coalesce(F.nullif("event", F.lit("")), F.lit("unknown")).alias("stage")).agg(F.count(F.lit(1)).alias("n"))
    per = stages.groupBy("correlation_id").agg(F.sum("n").alias("event_count"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", "n")))).alias("stage_counts"))
    d = per.join(signals, "correlation_id", "left")
    q, r = F.col("queue_depth"), F.col("retry_backlog")
    storm = (F.col("provider_timeouts") > 8) & (F.col("provider_retries") > 80)
    critical = F.coalesce((q >= 1000) | (r >= 1000) | storm, F.lit(False))
    warned = F.coalesce((q >= 500) | (r >= 500), F.lit(False))
    degraded, fallback = F.coalesce(F.col("degraded") > 0, F.lit(False)), F.coalesce(F.col("render_fallback") > 0, F.lit(False))
    calm = ~critical & ~warned
    reasons = [
        F.when(q >= 1000, "queue_depth>=1000").when(q >= 500, "queue_depth>=500"),
        F.when(r >= 1000, "retry_backlog>=1000").when(r >= 500, "retry_backlog>=500"),
        F.when(storm, "timeout_storm_guard_triggered"),
        F.when(calm & degraded, "degraded_mode_events_present"),
        F.when(calm & ~degraded & fallback, "render_fallback_events_present"),
    ]
    severity = F.when(critical, "critical").when(warned | degraded | fallback, "warning").otherwise("normal")
    d = d.withColumn("severity", severity).withColumn("reasons", F.array_compact(F.array(*reasons)))
    if scores is None:
        return d
    low = scores.where("score IS NOT NULL").groupBy("correlation_id").agg(F.min(F.struct("score", "provider")).alias("_low"))
    return d.join(low, "correlation_id", "left").withColumns({"lowest_provider": F.col("_low.provider"), "lowest_score": F.col("_low.score")}).drop("_low")


def before_in_time(rows: DataFrame, column: str, at: str, slice_s: int = 86_400) -> DataFrame:
    """Adds ``_before``: the value of the row before in time. Slices of time carry their last value to the next one, one row for each slice."""
    d = rows.withColumn("_slice", F.floor(F.unix_timestamp(at) / slice_s))
    last = d.groupBy("_slice").agg(F.max_by(column, at).alias("_last"))
    last = last.select(F.col("_slice").alias("_of"), F.lag("_last").over(Window.orderBy("_slice")).alias("_carried"))
    d = d.join(last, F.col("_slice").eqNullSafe(F.col("_of")))
    return d.withColumn("_before", F.coalesce(F.lag(column).over(Window.partitionBy("_slice").orderBy(at)), F.col("_carried"))).drop("_slice", "_of", "_carried")


def pressure(samples: DataFrame) -> DataFrame:
    """Sum of four counters per sample, its level, and the change since the sample before. Samples without a time stand before all others."""
    p = F.col("litellm_retry") + F.col("litellm_circuit_opened") + F.col("ocr_retry") + F.col("ocr_rejected")
    d = before_in_time(samples.withColumn("pressure", p), "pressure", "sampled_at")
    d = d.withColumn("delta", F.coalesce(F.col("pressure") - F.col("_before"), F.lit(0))).drop("_before")
    level = F.when(F.col("pressure") >= 20, "critical").when(F.col("pressure") >= 8, "warn").otherwise("normal")
    return d.withColumn("level", level).withColumn("trend", F.when(F.col("delta") > 0, "up").when(F.col("delta") < 0, "down").otherwise("flat"))
