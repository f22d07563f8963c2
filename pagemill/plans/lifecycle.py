"""Queries over lifecycle events, providers, jobs and queues."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import errors
from ..operators import jobs as jb
from ..operators import lifecycle as lc
from ..operators import providers as pv
from .registry import Tables, query

JOBS_NOW = "(SELECT max(updated_at) FROM jobs)"
QUEUE_NOW = "(SELECT max(score_ts) FROM queue_entries)"


def _likes(column: str, phrases: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{p}')" for p in phrases) + ")"


@query("P08_lifecycle_query", "lifecycle_events", oracle="SELECT event_id, event, job_id FROM lifecycle_events WHERE correlation_id = 'corr-7' AND event = 'chunk_retry' ORDER BY event_time DESC, event_id DESC LIMIT 100")
def _(t: Tables):
    return lc.query_lifecycle(t["lifecycle_events"], correlation_id="corr-7", event="chunk_retry", limit=0).select("event_id", "event", "job_id")


@query("P09_lifecycle_contract", "lifecycle_events", oracle=f"""
SELECT correlation_id, array_to_string(list_sort(list_filter({list(lc.REQUIRED_EVENTS)}, lambda x: NOT list_contains(have, x))), ',') AS missing, 0 AS invalid
FROM (SELECT correlation_id, list(DISTINCT event) AS have FROM lifecycle_events GROUP BY 1)""")
def _(t: Tables):
    bad = lc.invalid_events(t["lifecycle_events"]).groupBy("correlation_id").agg(F.count(F.lit(1)).cast("int").alias("invalid"))
    m = lc.missing_events(t["lifecycle_events"]).join(bad, "correlation_id", "left")
    return m.select("correlation_id", F.array_join("missing", ",").alias("missing"), F.coalesce("invalid", F.lit(0)).alias("invalid"))


@query("P10_classify_job_error", "jobs", oracle=f"SELECT CASE WHEN {_likes('lower(error)', errors.PERMANENT)} THEN 'permanent' WHEN {_likes('lower(error)', errors.TRANSIENT)} THEN 'transient' ELSE 'unknown' END AS kind, error, count(*) AS jobs FROM jobs GROUP BY ALL")
def _(t: Tables):
    return t["jobs"].groupBy(errors.classify_job_error(F.col("error")).alias("kind"), "error").agg(F.count(F.lit(1)).alias("jobs"))


@query("P11_classify_chunk_error", "jobs", oracle=f"SELECT error, CASE WHEN {_likes('error', errors.CHUNK_NETWORK)} THEN 'network_timeout' WHEN {_likes('error', errors.CHUNK_RATE_LIMIT)} THEN 'rate_limit' ELSE '' END AS cause, count(*) AS jobs FROM jobs GROUP BY ALL")
def _(t: Tables):
    return t["jobs"].groupBy("error", errors.classify_chunk_error(F.col("error")).alias("cause")).agg(F.count(F.lit(1)).alias("jobs"))


@query("P12_classify_provider_error", "jobs", "reliability_events", oracle=f"""
SELECT status, error, CASE WHEN status IS NOT NULL THEN status IN (429, 502, 503, 504) ELSE {_likes('lower(error)', errors.PROVIDER_TRANSIENT)} END AS transient, count(*) AS n
FROM (SELECT CASE WHEN r.id % 3 = 0 THEN r.status END AS status, j.error FROM reliability_events r JOIN jobs j ON j.event_id = r.id) GROUP BY ALL""")
def _(t: Tables):
    j = t["reliability_events"].alias("r").join(t["jobs"].alias("j"), F.col("j.event_id") == F.col("r.id")).select(F.when(F.col("r.id") % 3 == 0, F.col("r.status")).alias("status"), "error")
    return j.groupBy("status", "error", errors.is_provider_transient(F.col("status"), F.col("error")).alias("transient")).agg(F.count(F.lit(1)).alias("n"))


@query("P13_timeout_reason", "jobs", oracle="""
SELECT error, reason, CASE WHEN reason <> '' THEN 'timeout_' || reason ELSE 'provider_error' END AS failover, count(*) AS n FROM (
  SELECT error, CASE WHEN event_id % 10 = 0 THEN 'network_timeout' WHEN contains(lower(error), 'gateway timeout') OR contains(lower(error), 'status 504') THEN 'gateway_timeout'
    WHEN contains(lower(error), 'client.timeout exceeded') OR contains(lower(error), 'i/o timeout') OR contains(lower(error), 'timed out') THEN 'client_timeout'
    WHEN contains(lower(error), 'context deadline exceeded') THEN 'context_deadline' ELSE '' END AS reason FROM jobs) GROUP BY ALL""")
def _(t: Tables):
    typed = F.when(F.col("event_id") % 10 == 0, "network_timeout").otherwise("")
    d = t["jobs"].withColumn("reason", errors.timeout_reason(F.col("error"), typed))
    return d.groupBy("error", "reason", errors.failover_reason(F.col("reason")).alias("failover")).agg(F.count(F.lit(1)).alias("n"))


@query("P14_low_confidence_flag", "jobs", oracle="SELECT job_id, printf('low OCR confidence: %.2f', ocr_confidence) AS warning FROM jobs WHERE ocr_confidence > 0 AND ocr_confidence < 0.72")
def _(t: Tables):
    return t["jobs"].select("job_id", jb.low_confidence(F.col("ocr_confidence")).alias("warning")).where("warning IS NOT NULL")


@query("P17_job_event_type", "jobs", oracle="""SELECT status, stage, CASE WHEN status = 'completed' THEN 'job_complete' WHEN status = 'failed' THEN 'job_failed' ELSE
  CASE lower(stage) WHEN 'detecting_text' THEN 'ocr_complete' WHEN 'translating' THEN 'translation_progress' WHEN 'retrying' THEN 'retrying' WHEN 'fallback_provider' THEN 'fallback_provider_active' WHEN 'rendering' THEN 'rendering_progress' WHEN 'rebuilding_layout' THEN 'rendering_progress' ELSE 'job_update' END END AS event_type, count(*) AS jobs FROM jobs GROUP BY ALL""")
def _(t: Tables):
    return t["jobs"].groupBy("status", "stage", jb.job_event_type(F.col("status"), F.col("stage")).alias("event_type")).agg(F.count(F.lit(1)).alias("jobs"))


@query("P18_job_stage_rollup", "jobs", oracle="""
SELECT stage, stage_message, coarse, narrative, hint, count(*) AS jobs FROM (SELECT stage, stage_message, CASE
  WHEN status = 'completed' THEN 'complete' WHEN stage = 'detecting_languages' OR contains(mark, 'language') THEN 'languages'
  WHEN contains(mark, 'render') OR contains(mark, 'typography') OR contains(mark, 'layout') THEN 'render' WHEN contains(mark, 'translat') THEN 'translate'
  WHEN contains(mark, 'extract') OR contains(mark, 'ocr') OR contains(mark, 'detect') THEN 'extract'
  WHEN stage_progress >= 0.95 THEN 'render' WHEN stage_progress >= 0.65 THEN 'translate' WHEN stage_progress >= 0.35 THEN 'languages' WHEN stage_progress > 0.05 THEN 'extract' ELSE 'queued' END AS coarse,
  CASE stage WHEN 'detecting_text' THEN 'Detecting text regions' WHEN 'translating' THEN 'Translating content' WHEN 'rebuilding_layout' THEN 'Rebuilding typography' WHEN 'rendering' THEN 'Rendering final image'
    ELSE CASE WHEN contains(lower(stage_message), 'layout') THEN 'Preserving layout geometry' WHEN contains(lower(stage_message), 'language') THEN 'Detecting languages and script direction' WHEN contains(lower(stage_message), 'translat') THEN 'Translating content' WHEN contains(lower(stage_message), 'render') THEN 'Rendering final image' END END AS narrative,
  CASE WHEN stage = 'retrying' OR contains(lower(stage_message), 'retry') THEN 'retrying' WHEN stage = 'fallback_provider' OR contains(lower(stage_message), 'backup') OR contains(lower(stage_message), 'switching') THEN 'switching' END AS hint
  FROM (SELECT *, lower(stage) || ' ' || lower(stage_message) AS mark FROM jobs)) GROUP BY ALL""")
def _(t: Tables):
    s, m = F.col("stage"), F.col("stage_message")
    d = t["jobs"].select("stage", "stage_message", jb.infer_stage(F.col("status"), s, m, F.col("stage_progress")).alias("coarse"), jb.stage_narrative(s, m).alias("narrative"), jb.reliability_hint(s, m).alias("hint"))
    return d.groupBy(*d.columns).agg(F.count(F.lit(1)).alias("jobs"))


@query("P19_failure_category", "jobs", oracle="""SELECT error, CASE WHEN error = '' THEN 'interrupted' WHEN contains(lower(error), 'timeout') THEN 'timed_out' WHEN contains(lower(error), 'network') OR contains(lower(error), 'fetch') THEN 'connection_interrupted'
  WHEN contains(lower(error), 'retry') OR contains(lower(error), 'circuit') THEN 'provider_could_not_complete' ELSE 'translation_failed' END AS category, CAST(NULL AS VARCHAR) AS help, count(*) AS jobs FROM jobs GROUP BY ALL""")
def _(t: Tables):
    return t["jobs"].groupBy("error", errors.failure_category(F.col("error")).alias("category"), errors.help_class(F.col("error")).alias("help")).agg(F.count(F.lit(1)).alias("jobs"))


@query("P20_job_response", "jobs", oracle="""SELECT job_id, correlation_id, status, mode, updated_at, CASE WHEN type = 'translate_pdf' THEN total_pages END AS total_pages, CASE WHEN stage <> '' THEN stage END AS stage,
  CASE WHEN stage <> '' THEN stage_message END AS stage_message, CASE WHEN stage <> '' THEN stage_progress END AS stage_progress, CASE WHEN ocr_confidence > 0 THEN ocr_confidence END AS ocr_confidence, CASE WHEN status = 'failed' THEN error END AS error FROM jobs""")
def _(t: Tables):
    return jb.project_job(t["jobs"])


@query("P21_component_rollup", "queue_entries", "jobs", oracle=f"""
WITH stats AS (SELECT count(*) FILTER (WHERE queue = 'inflight' AND score_ts <= {QUEUE_NOW} - INTERVAL 10 MINUTE) AS stuck, count(*) FILTER (WHERE queue = 'dead') AS dead FROM queue_entries),
parts AS (SELECT 'queues' AS name, CASE WHEN stuck > 0 OR dead > 0 THEN 'warning' ELSE 'ok' END AS status, '' AS error FROM stats
  UNION ALL SELECT type, CASE WHEN count(*) FILTER (WHERE status = 'failed') * 10 > count(*) THEN 'error' ELSE 'ok' END, max(error) FILTER (WHERE status = 'failed') FROM jobs GROUP BY type)
SELECT CASE WHEN bool_or(status IN ('down', 'error', 'warning')) THEN 'degraded' ELSE 'ok' END AS status,
  coalesce(string_agg(CASE WHEN status NOT IN ('ok', 'disabled', 'warning') THEN name || ': ' || CASE WHEN error <> '' THEN error ELSE status END END, '; ' ORDER BY name), '') AS startup_failures FROM parts""")
def _(t: Tables):
    now = t.as_of("queue_entries", "score_ts")
    queues = jb.queue_component(jb.queue_stats(t["queue_entries"], now)).select(F.lit("queues").alias("name"), "status", F.lit("").alias("error"))
    failed = F.col("status") == "failed"
    kinds = t["jobs"].groupBy("type").agg(F.when(lc.count_if(failed) * 10 > F.count(F.lit(1)), "error").otherwise("ok").alias("s"), F.max(F.when(failed, F.col("error"))).alias("error"))
    d = jb.rollup_health(queues.unionByName(kinds.select(F.col("type").alias("name"), F.col("s").alias("status"), "error")))
    return d.withColumn("startup_failures", F.array_join("startup_failures", "; "))


@query("P22_dead_letter_search", "queue_entries", "jobs", oracle="SELECT q.job_id, j.status, j.type FROM queue_entries q JOIN jobs j USING (job_id) WHERE q.queue = 'dead' AND j.status = 'failed' AND contains(lower(concat_ws(' ', q.job_id, coalesce(q.reason, ''), j.status, j.type, j.mode, '', '')), 'timed out')")
def _(t: Tables):
    d = t["queue_entries"].where("queue = 'dead'").join(t["jobs"].select("job_id", "status", "type", "mode"), "job_id")
    d = d.withColumns({"source": F.lit(""), "target": F.lit(""), "dead_lettered_at": F.col("score_ts").cast("string")})
    return jb.search_dead(d, status="failed", text=" Timed out ").select("job_id", "status", "type")


@query("P22_dead_letter_counts", "queue_entries", "jobs", oracle="""
WITH d AS (SELECT CASE WHEN j.event_id % 3 > 0 THEN j.status END AS status, CASE WHEN j.event_id % 5 > 0 THEN j.type END AS type FROM queue_entries q JOIN jobs j USING (job_id) WHERE q.queue = 'dead')
SELECT 'status' AS "by", coalesce(status, 'unknown') AS name, count(*) AS n FROM d GROUP BY 2 UNION ALL SELECT 'type', coalesce(type, 'unknown'), count(*) FROM d GROUP BY 2""")
def _(t: Tables):
    i = F.col("event_id")
    known = t["jobs"].select("job_id", F.when(i % 3 > 0, F.col("status")).alias("status"), F.when(i % 5 > 0, F.col("type")).alias("type"))
    return jb.dead_counts(t["queue_entries"].where("queue = 'dead'").join(known, "job_id"))


@query("A14_pipeline_snapshot", "lifecycle_events", oracle="""
SELECT count(*) FILTER (WHERE event = 'chunk_retry') AS retries_total, count(*) FILTER (WHERE event = 'provider_failover') AS failovers_total, count(*) FILTER (WHERE event = 'chunk_started') AS chunk_started_total,
  count(*) FILTER (WHERE event = 'chunk_completed') AS chunk_completed_total, count(*) FILTER (WHERE event = 'export_started') AS export_started_total, count(*) FILTER (WHERE event = 'export_completed') AS export_completed_total,
  count(*) FILTER (WHERE event = 'job_failed') AS job_failed_total, count(*) FILTER (WHERE event = 'job_completed') AS job_completed_total,
  CAST(sum(duration_ms) FILTER (WHERE event = 'ocr_completed') AS BIGINT) AS ocr_total_ms, count(*) FILTER (WHERE event = 'ocr_completed') AS ocr_count, avg(duration_ms) FILTER (WHERE event = 'ocr_completed') AS ocr_avg_ms,
  CAST(sum(duration_ms) FILTER (WHERE event = 'translation_started' AND duration_ms > 0) AS BIGINT) AS translation_total_ms, count(*) FILTER (WHERE event = 'translation_started' AND duration_ms > 0) AS translation_count, avg(duration_ms) FILTER (WHERE event = 'translation_started' AND duration_ms > 0) AS translation_avg_ms,
  CAST(sum(duration_ms) FILTER (WHERE event = 'render_completed') AS BIGINT) AS render_total_ms, count(*) FILTER (WHERE event = 'render_completed') AS render_count, avg(duration_ms) FILTER (WHERE event = 'render_completed') AS render_avg_ms,
  count(*) FILTER (WHERE event = 'chunk_completed') / count(*) FILTER (WHERE event = 'chunk_started') AS chunk_success_rate, count(*) FILTER (WHERE event = 'export_completed') / count(*) FILTER (WHERE event = 'export_started') AS export_success_rate
FROM lifecycle_events""")
def _(t: Tables):
    return lc.pipeline_snapshot(t["lifecycle_events"])


@query("A15_queue_wait", "lifecycle_events", oracle="""
SELECT CAST(coalesce(sum(greatest(ms, 0)), 0) AS BIGINT) AS total_ms, count(ms) AS count, coalesce(avg(greatest(ms, 0)), 0) AS avg_ms FROM (
  SELECT date_diff('microsecond', max(event_time) FILTER (WHERE event = 'job_created'), max(event_time) FILTER (WHERE event = 'ocr_started')) // 1000 AS ms FROM lifecycle_events GROUP BY job_id)""")
def _(t: Tables):
    at = {"created_at": "job_created", "started_at": "ocr_started"}
    return lc.queue_wait(t["lifecycle_events"].groupBy("job_id").agg(*(F.max(F.when(F.col("event") == e, F.col("event_time"))).alias(c) for c, e in at.items())))


_SNAPSHOT = """SELECT provider, count(*) FILTER (WHERE result = 'success') AS success_total, count(*) FILTER (WHERE result <> 'success') AS failure_total, count(*) FILTER (WHERE result = 'transient') AS retry_total,
  count(*) FILTER (WHERE result = 'success' AND position > 0) AS failover_total, avg(latency_ms) FILTER (WHERE result = 'success') AS avg_latency_ms,
  count(*) FILTER (WHERE result = 'success' AND latency_ms <= 250) AS le_250_ms, count(*) FILTER (WHERE result = 'success' AND latency_ms > 250 AND latency_ms <= 500) AS le_500_ms, count(*) FILTER (WHERE result = 'success' AND latency_ms > 500 AND latency_ms <= 1000) AS le_1000_ms,
  count(*) FILTER (WHERE result = 'success' AND latency_ms > 1000 AND latency_ms <= 2000) AS le_2000_ms, count(*) FILTER (WHERE result = 'success' AND latency_ms > 2000) AS gt_2000_ms FROM provider_attempts GROUP BY provider"""


@query("A16_provider_snapshot", "provider_attempts", oracle=_SNAPSHOT)
def _(t: Tables):
    return pv.provider_snapshot(t["provider_attempts"])


@query("A17_provider_rates", "provider_attempts", oracle=f"SELECT provider, success_total / (success_total + failure_total) AS success_rate, retry_total / (success_total + failure_total) AS retry_rate, failover_total / (success_total + failure_total) AS failover_rate, avg_latency_ms FROM ({_SNAPSHOT})")
def _(t: Tables):
    return pv.provider_rates(pv.provider_snapshot(t["provider_attempts"]))


@query("A18_timeout_and_render_counts", "reliability_events", oracle="SELECT coalesce(nullif(reason, ''), 'unknown') AS reason, count(*) AS total FROM reliability_events GROUP BY 1")
def _(t: Tables):
    return pv.count_by(t["reliability_events"], "reason")


@query("A19_checkpoint_health", "jobs", oracle="""
SELECT type, hits, misses, hit_rate, persist_failure_rate, CASE WHEN hit_rate < 40 THEN 'hit_critical' WHEN persist_failure_rate >= 15 THEN 'persist_critical' WHEN hit_rate < 70 THEN 'hit_warn' WHEN persist_failure_rate >= 5 THEN 'persist_warn' ELSE 'normal' END AS cause
FROM (SELECT *, hits / (hits + misses) * 100 AS hit_rate, persist_failures / (persists + persist_failures) * 100 AS persist_failure_rate FROM (
  SELECT type, count(*) FILTER (WHERE event_id % 10 < 6) AS hits, count(*) FILTER (WHERE event_id % 10 >= 6) AS misses, count(*) FILTER (WHERE status <> 'failed') AS persists, count(*) FILTER (WHERE status = 'failed') AS persist_failures FROM jobs GROUP BY type))""")
def _(t: Tables):
    c = t["jobs"].groupBy("type").agg(lc.count_if(F.col("event_id") % 10 < 6).alias("hits"), lc.count_if(F.col("event_id") % 10 >= 6).alias("misses"), lc.count_if(F.col("status") != "failed").alias("persists"), lc.count_if(F.col("status") == "failed").alias("persist_failures"))
    return pv.checkpoint_health(c).select("type", "hits", "misses", "hit_rate", "persist_failure_rate", "cause")


@query("A20_degraded_counts", "jobs", oracle="""SELECT count(*) FILTER (WHERE event_id % 6 IN (0, 1, 2)) AS total_events, count(*) FILTER (WHERE event_id % 6 = 1) AS render_fallback_events, count(*) FILTER (WHERE event_id % 6 = 2) AS ocr_low_confidence_events,
  count(*) FILTER (WHERE event_id % 6 = 3) AS adaptive_reduce_events, count(*) FILTER (WHERE event_id % 6 = 4) AS adaptive_boost_events, count(*) FILTER (WHERE event_id % 6 = 5) AS adaptive_clamp_events FROM jobs""")
def _(t: Tables):
    kinds = F.array(*(F.lit(x) for x in ("degraded", "render_fallback", "ocr_low_confidence", "adaptive_reduce", "adaptive_boost", "adaptive_clamp")))
    return pv.degraded_counts(t["jobs"].select(F.element_at(kinds, (F.col("event_id") % 6 + 1).cast("int")).alias("kind")))


@query("A21_integration_counters", "reliability_events", oracle="""
SELECT count(*) FILTER (WHERE event_name = 'litellm_retry') AS litellm_retry_attempts_total, count(*) FILTER (WHERE event_name = 'litellm_circuit_reject') AS litellm_circuit_reject_total, count(*) FILTER (WHERE event_name IN ('litellm_circuit_open', 'litellm_circuit_opened')) AS litellm_circuit_opened_total,
  count(*) FILTER (WHERE event_name = 'ocr_retry') AS ocr_retry_attempts_total, count(*) FILTER (WHERE event_name = 'ocr_provider_fallback') AS ocr_provider_fallback_total,
""" + ", ".join(f"count(*) FILTER (WHERE event_name = '{w}_response_rejected') AS {w}_response_rejected_total, " + ", ".join(f"count(*) FILTER (WHERE event_name = '{w}_response_rejected' AND reason = '{r}') AS {w}_response_rejected_{n}_total" for r, n in (("invalid_json", "json"), ("invalid_schema", "shape"), ("body_too_large", "body"))) for w in ("litellm", "ocr")) + " FROM reliability_events")
def _(t: Tables):
    return pv.integration_counters(t["reliability_events"])


@query("A21_positive_aggregates", "provider_attempts", oracle="""
WITH a AS (SELECT CAST(event_id % 5 AS DOUBLE) / 4 AS c, CASE WHEN event_id % 7 = 0 THEN -1 ELSE latency_ms END AS ms, CAST(event_id % 3 - 1 AS DOUBLE) / 8 AS d FROM provider_attempts)
SELECT count(*) FILTER (WHERE c > 0) AS confidence_count, coalesce(avg(c) FILTER (WHERE c > 0), 0) AS confidence_avg, count(*) FILTER (WHERE ms > 0) AS latency_ms_count, coalesce(avg(ms) FILTER (WHERE ms > 0), 0) AS latency_ms_avg,
  count(*) FILTER (WHERE d <> 0) AS confidence_delta_count, coalesce(avg(d) FILTER (WHERE d <> 0), 0) AS confidence_delta_avg FROM a""")
def _(t: Tables):
    i = F.col("event_id")
    a = t["provider_attempts"].select(((i % 5).cast("double") / 4).alias("confidence"), F.when(i % 7 == 0, -1).otherwise(F.col("latency_ms")).alias("latency_ms"), ((i % 3 - 1).cast("double") / 8).alias("confidence_delta"))
    return pv.positive_aggregates(a)


_STATS = f"""SELECT count(*) FILTER (WHERE queue = 'ready') AS queue_depth, count(*) FILTER (WHERE queue = 'inflight') AS inflight_depth, count(*) FILTER (WHERE queue = 'retry') AS retry_backlog, count(*) FILTER (WHERE queue = 'dead') AS dead_letter_count,
  count(*) FILTER (WHERE queue = 'inflight' AND score_ts <= {QUEUE_NOW} - INTERVAL 10 MINUTE) AS stuck_jobs FROM queue_entries"""


@query("A24_queue_stats", "queue_entries", oracle=_STATS)
def _(t: Tables):
    return jb.queue_stats(t["queue_entries"], t.as_of("queue_entries", "score_ts"))


@query("A25_overload_level", "queue_entries", oracle="""
SELECT day, queue_depth, retry_backlog, stuck_jobs, CASE WHEN queue_depth >= 400 OR retry_backlog >= 240 OR stuck_jobs >= 40 THEN 'severe' WHEN queue_depth >= 200 OR retry_backlog >= 120 OR stuck_jobs >= 20 THEN 'overloaded'
  WHEN queue_depth <= 30 AND retry_backlog <= 10 AND stuck_jobs = 0 THEN 'low' ELSE 'normal' END AS level FROM (
  SELECT date_trunc('hour', score_ts) AS day, count(*) FILTER (WHERE queue = 'ready') * 20 AS queue_depth, count(*) FILTER (WHERE queue = 'retry') * 10 AS retry_backlog, count(*) FILTER (WHERE queue = 'inflight') * 4 AS stuck_jobs FROM queue_entries GROUP BY 1)""")
def _(t: Tables):
    q = F.col("queue")
    by = t["queue_entries"].groupBy(F.date_trunc("hour", "score_ts").alias("day")).agg((lc.count_if(q == "ready") * 20).alias("queue_depth"), (lc.count_if(q == "retry") * 10).alias("retry_backlog"), (lc.count_if(q == "inflight") * 4).alias("stuck_jobs"))
    return jb.overload_level(by)


@query("A32_slo_attainment", "lifecycle_events", "jobs", oracle="""
WITH j AS (SELECT job_id, min(event_time) FILTER (WHERE event = 'job_created') AS begun, max(event_time) FILTER (WHERE event = 'render_completed') AS rendered, max(event_time) FILTER (WHERE event = 'job_completed') AS done FROM lifecycle_events GROUP BY 1),
l AS (SELECT CAST(begun AS DATE) AS day, CASE WHEN type = 'translate_image' THEN epoch_us(rendered) - epoch_us(begun) END AS image, CASE WHEN type = 'translate_pdf' THEN epoch_us(done) - epoch_us(begun) END AS pdf FROM j JOIN jobs USING (job_id)),
p AS (SELECT day, quantile_cont(image / 1e6, 0.5) FILTER (WHERE image >= 0) AS image_p50_s, quantile_cont(pdf / 1e6, 0.5) FILTER (WHERE pdf >= 0) AS pdf_p50_s FROM l WHERE day IS NOT NULL GROUP BY 1),
d AS (SELECT CAST(event_time AS DATE) AS day, """ + ", ".join(f"CASE WHEN count(*) FILTER (WHERE event = '{b}') = 0 THEN 0.0 ELSE count(*) FILTER (WHERE event = '{a}') / count(*) FILTER (WHERE event = '{b}') END AS {n}" for a, b, n in (("ocr_completed", "ocr_started", "ocr_success"), ("chunk_completed", "translation_started", "translation_completion"), ("render_completed", "render_started", "render_completion"))) + """,
  quantile_cont(retry_count, 0.95) FILTER (WHERE event = 'chunk_retry') AS retries_p95, max(queue_depth) AS max_queue_depth FROM lifecycle_events GROUP BY 1),
m AS (SELECT d.*, image_p50_s, pdf_p50_s, ocr_success >= 0.99 AND translation_completion >= 0.995 AND render_completion >= 0.99 AND coalesce(retries_p95, 0) <= 3 AND coalesce(image_p50_s <= 8, true) AND coalesce(pdf_p50_s <= 180, true) AS met, CASE WHEN max_queue_depth > 1000 THEN 'critical' WHEN max_queue_depth > 500 THEN 'warn' ELSE 'ok' END AS backlog FROM d LEFT JOIN p ON p.day = d.day)
SELECT * REPLACE (CAST(day AS VARCHAR) AS day, round(image_p50_s, 6) AS image_p50_s, round(pdf_p50_s, 6) AS pdf_p50_s), NOT met AND NOT coalesce(lag(met) OVER (ORDER BY day), true) AS action_item FROM m""")
def _(t: Tables):
    return lc.slo_attainment(t["lifecycle_events"], t["jobs"]).withColumns({"image_p50_s": F.round("image_p50_s", 6), "pdf_p50_s": F.round("pdf_p50_s", 6)}).withColumn("day", F.col("day").cast("string"))


@query("A33_incident_summary", "lifecycle_events", oracle="""
WITH s AS (SELECT correlation_id, max(queue_depth) AS q, count(*) FILTER (WHERE event = 'chunk_retry') * 40 AS r, count(*) FILTER (WHERE event = 'provider_failover') AS pt, sum(retry_count) AS pr, count(*) FILTER (WHERE event = 'job_failed') % 3 AS dg, count(*) FILTER (WHERE event = 'render_started') % 2 AS rf, count(*) AS event_count FROM lifecycle_events GROUP BY 1),
f AS (SELECT *, q >= 1000 OR r >= 1000 OR (pt > 8 AND pr > 80) AS crit, q >= 500 OR r >= 500 AS warned FROM s),
v AS (SELECT correlation_id, concat('p', CAST(event_id % 3 AS VARCHAR)) AS provider, max(duration_ms) % 50 / 64.0 AS score FROM lifecycle_events GROUP BY ALL),
lo AS (SELECT correlation_id, provider AS lowest_provider, CAST(score AS DOUBLE) AS lowest_score FROM v QUALIFY row_number() OVER (PARTITION BY correlation_id ORDER BY score, provider) = 1)
SELECT correlation_id, lowest_provider, lowest_score, event_count, CASE WHEN crit THEN 'critical' WHEN warned OR dg > 0 OR rf > 0 THEN 'warning' ELSE 'normal' END AS severity, concat_ws(';',
  CASE WHEN q >= 1000 THEN 'queue_depth>=1000' WHEN q >= 500 THEN 'queue_depth>=500' END, CASE WHEN r >= 1000 THEN 'retry_backlog>=1000' WHEN r >= 500 THEN 'retry_backlog>=500' END,
  CASE WHEN pt > 8 AND pr > 80 THEN 'timeout_storm_guard_triggered' END, CASE WHEN NOT crit AND NOT warned AND dg > 0 THEN 'degraded_mode_events_present' END, CASE WHEN NOT crit AND NOT warned AND dg = 0 AND rf > 0 THEN 'render_fallback_events_present' END) AS reasons FROM f LEFT JOIN lo USING (correlation_id)""")
def _(t: Tables):
    e = F.col("event")
    life = t["lifecycle_events"]
    s = life.groupBy("correlation_id").agg(
        F.max("queue_depth").alias("queue_depth"), (lc.count_if(e == "chunk_retry") * 40).alias("retry_backlog"), lc.count_if(e == "provider_failover").alias("provider_timeouts"),
        F.sum("retry_count").alias("provider_retries"), (lc.count_if(e == "job_failed") % 3).alias("degraded"), (lc.count_if(e == "render_started") % 2).alias("render_fallback"),
    )
    scores = life.groupBy("correlation_id", F.concat(F.lit("p"), (F.col("event_id") % 3).cast("string")).alias("provider")).agg((F.max("duration_ms") % 50 / 64).alias("score"))
    return lc.incident_summary(life, s, scores).select("correlation_id", "lowest_provider", "lowest_score", "event_count", "severity", F.array_join("reasons", ";").alias("reasons"))


@query("A34_pressure", "reliability_events", oracle="""
WITH s AS (SELECT date_trunc('hour', recorded_at) AS sampled_at, count(*) FILTER (WHERE event_name = 'litellm_retry') + count(*) FILTER (WHERE event_name = 'litellm_circuit_open') + count(*) FILTER (WHERE event_name = 'ocr_retry') + count(*) FILTER (WHERE event_name = 'ocr_response_rejected') AS pressure FROM reliability_events GROUP BY 1),
d AS (SELECT *, coalesce(pressure - lag(pressure) OVER (ORDER BY sampled_at), 0) AS delta FROM s)
SELECT sampled_at, pressure, delta, CASE WHEN pressure >= 20 THEN 'critical' WHEN pressure >= 8 THEN 'warn' ELSE 'normal' END AS level, CASE WHEN delta > 0 THEN 'up' WHEN delta < 0 THEN 'down' ELSE 'flat' END AS trend FROM d""")
def _(t: Tables):
    n = F.col("event_name")
    s = t["reliability_events"].groupBy(F.date_trunc("hour", "recorded_at").alias("sampled_at")).agg(*(lc.count_if(n == v).alias(k) for k, v in (("litellm_retry", "litellm_retry"), ("litellm_circuit_opened", "litellm_circuit_open"), ("ocr_retry", "ocr_retry"), ("ocr_rejected", "ocr_response_rejected"))))
    return lc.pressure(s).select("sampled_at", "pressure", "delta", "level", "trend")


@query("A35_canary_summary", "jobs", oracle="SELECT type, count(*) AS files, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed FROM jobs GROUP BY 1")
def _(t: Tables):
    return jb.canary_summary(t["jobs"])


@query("J01_dead_letter_list", "queue_entries", "jobs", oracle="SELECT q.job_id, q.pos, coalesce(q.reason, '') AS reason, j.status, j.type, j.mode FROM (SELECT * FROM queue_entries WHERE queue = 'dead' ORDER BY pos DESC LIMIT 200) q LEFT JOIN (SELECT * FROM jobs WHERE event_id % 2 = 1 AND event_id % 3 > 0) j USING (job_id)")
def _(t: Tables):
    return jb.dead_letter_list(t["queue_entries"], t["jobs"].where("event_id % 2 = 1 AND event_id % 3 > 0"), 500)


@query("J04_provider_trend", "provider_attempts", oracle="""
WITH a AS (SELECT concat(provider, '-', CAST(request_id % 7 AS STRING)) AS provider, avg(CAST(result = 'success' AS INT)) FILTER (WHERE event_id % 2 = 0 AND request_id % 7 < 6) AS cur, avg(CAST(result = 'success' AS INT)) FILTER (WHERE event_id % 2 = 1 AND request_id % 7 > 0) AS prev FROM provider_attempts GROUP BY 1)
SELECT provider, round(cur, 6) AS current, round(prev, 6) AS previous, round(cur - prev, 6) AS delta, CASE WHEN cur - prev IS NULL THEN 'n/a' WHEN cur - prev <= -0.10 THEN 'critical' WHEN cur - prev <= -0.05 THEN 'warning' WHEN cur - prev >= 0.05 THEN 'improving' ELSE 'stable' END AS severity FROM a WHERE cur IS NOT NULL OR prev IS NOT NULL""")
def _(t: Tables):
    d = t["provider_attempts"].withColumn("k", F.col("request_id") % 7).withColumn("provider", F.concat_ws("-", "provider", F.col("k").cast("string")))
    score = F.avg((F.col("result") == "success").cast("int")).alias("score")
    out = pv.provider_trend(d.where("event_id % 2 = 0 AND k < 6").groupBy("provider").agg(score), d.where("event_id % 2 = 1 AND k > 0").groupBy("provider").agg(score))
    return out.select("provider", *(F.round(c, 6).alias(c) for c in ("current", "previous", "delta")), "severity")


@query("J09_replay_dead", "queue_entries", "jobs", oracle="""
WITH ids AS (SELECT DISTINCT job_id FROM jobs WHERE event_id % 5 = 0), dead AS (SELECT DISTINCT job_id FROM queue_entries WHERE queue = 'dead'), hit AS (SELECT job_id FROM ids WHERE job_id IN (SELECT job_id FROM dead))
SELECT 'jobs' AS part, CASE WHEN job_id IN (SELECT job_id FROM hit) THEN 'pending' ELSE status END AS state, count(*) AS n FROM jobs GROUP BY 1, 2
UNION ALL SELECT 'queue', CASE WHEN job_id IN (SELECT job_id FROM hit) AND queue = 'dead' THEN 'ready' ELSE queue END, count(*) FROM queue_entries WHERE NOT (queue = 'retry' AND job_id IN (SELECT job_id FROM hit)) GROUP BY 1, 2
UNION ALL SELECT 'not_found', 'not_found', count(*) FROM ids WHERE job_id NOT IN (SELECT job_id FROM hit)""")
def _(t: Tables):
    jobs, queue, lost = jb.replay_dead(t["jobs"], t["queue_entries"], t["jobs"].where("event_id % 5 = 0"), t.as_of("jobs", "updated_at"))
    n = F.count(F.lit(1)).alias("n")
    a = jobs.groupBy(F.lit("jobs").alias("part"), F.col("status").alias("state")).agg(n)
    return a.unionByName(queue.groupBy(F.lit("queue").alias("part"), F.col("queue").alias("state")).agg(n)).unionByName(lost.agg(n).select(F.lit("not_found").alias("part"), F.lit("not_found").alias("state"), "n"))


@query("J13_correlate_stages", "lifecycle_events", oracle="SELECT correlation_id, row_number() OVER w AS step, event, event_time, date_diff('microsecond', lag(event_time) OVER w, event_time) // 1000 AS gap_ms FROM lifecycle_events WINDOW w AS (PARTITION BY correlation_id ORDER BY event_time, event_id)")
def _(t: Tables):
    return lc.timeline(t["lifecycle_events"])


@query("W10_provider_health", "provider_attempts", oracle="""
WITH r AS (SELECT provider, CAST(attempt_time AS DATE) AS day, CASE result WHEN 'success' THEN 1.2 WHEN 'transient' THEN 0.35 ELSE 0.15 END AS target, attempt_time, event_id FROM provider_attempts),
f AS (SELECT provider, day, list_reduce(list_prepend(1.0::DOUBLE, list(target::DOUBLE ORDER BY attempt_time, event_id) OVER (PARTITION BY provider ORDER BY attempt_time, event_id)), lambda s, x: least(1.5, greatest(0.05, 0.78 * s + 0.22 * x))) AS score, row_number() OVER (PARTITION BY provider, day ORDER BY attempt_time DESC, event_id DESC) AS last, count(*) OVER (PARTITION BY provider, day) AS attempts FROM r)
SELECT provider, CAST(day AS VARCHAR) AS day, CAST(attempts AS INT) AS attempts, round(score, 6) AS score FROM f WHERE last = 1""")
def _(t: Tables):
    return pv.provider_health(t["provider_attempts"]).withColumns({"score": F.round("score", 6), "day": F.col("day").cast("string")})


@query("W10_provider_ranking", "provider_attempts", oracle="""
WITH f AS (SELECT provider, list_reduce(list_prepend(1.0::DOUBLE, list(CASE result WHEN 'success' THEN 1.2 WHEN 'transient' THEN 0.35 ELSE 0.15 END::DOUBLE ORDER BY attempt_time, event_id)), lambda s, x: least(1.5, greatest(0.05, 0.78 * s + 0.22 * x))) AS score FROM provider_attempts GROUP BY 1)
SELECT provider, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, list_position(['paddle', 'tesseract', 'unlimited'], provider)) AS INT) AS rank FROM f""")
def _(t: Tables):
    last = pv.provider_health(t["provider_attempts"]).groupBy("provider").agg(F.max_by("score", "day").alias("score"))
    return pv.rank_providers(last, ["paddle", "tesseract", "unlimited"]).withColumn("score", F.round("score", 6))


@query("W14_state_change_dedupe", "jobs", oracle="""
WITH o AS (SELECT correlation_id, event_id, status, stage, lag(status || '|' || stage) OVER w AS prev, coalesce(max(CAST(status = 'failed' AS INT)) OVER (PARTITION BY correlation_id ORDER BY updated_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over FROM jobs WINDOW w AS (PARTITION BY correlation_id ORDER BY updated_at, event_id))
SELECT correlation_id, event_id, status, stage FROM o WHERE over = 0 AND prev IS DISTINCT FROM status || '|' || stage""")
def _(t: Tables):
    return lc.state_changes(t["jobs"], "correlation_id", ["updated_at", "event_id"], ["status", "stage"], F.col("status") == "failed").select("correlation_id", "event_id", "status", "stage")


@query("W15_retry_plan", "jobs", oracle=f"""
WITH f AS (SELECT job_id, error, attempt + 1 AS next_attempt, max_attempts - 1 AS effective_max, CASE WHEN {_likes('lower(error)', errors.PERMANENT)} THEN 'permanent' WHEN {_likes('lower(error)', errors.TRANSIENT)} THEN 'transient' ELSE 'unknown' END AS kind FROM jobs WHERE status = 'failed'),
g AS (SELECT *, kind = 'transient' AND next_attempt < effective_max AS again, least(60.0, 2.0 * pow(2, greatest(next_attempt - 1, 0))) AS base FROM f)
SELECT job_id, kind, next_attempt, effective_max, CASE WHEN again THEN 'pending' ELSE 'failed' END AS next_status, CASE WHEN again THEN base + 3 END AS delay_s, CASE WHEN again THEN base * 1.25 + 3 END AS delay_max_s, CASE WHEN NOT again THEN error END AS dead_reason FROM g""")
def _(t: Tables):
    return jb.retry_plan(t["jobs"], True, t.as_of("jobs", "updated_at")).drop("next_retry_at")


@query("W16_promote_recover", "queue_entries", oracle=f"""SELECT CASE WHEN (queue = 'retry' AND score_ts <= {QUEUE_NOW} - INTERVAL 5 DAY) OR (queue = 'inflight' AND score_ts <= {QUEUE_NOW} - INTERVAL 5 DAY - INTERVAL 10 MINUTE) THEN 'ready' ELSE queue END AS queue,
  (queue = 'retry' AND score_ts <= {QUEUE_NOW} - INTERVAL 5 DAY) OR (queue = 'inflight' AND score_ts <= {QUEUE_NOW} - INTERVAL 5 DAY - INTERVAL 10 MINUTE) AS moved, count(*) AS n FROM queue_entries GROUP BY ALL""")
def _(t: Tables):
    from datetime import timedelta

    q = jb.promote_recover(t["queue_entries"], t.as_of("queue_entries", "score_ts") - timedelta(days=5))
    return q.groupBy("queue", "moved").agg(F.count(F.lit(1)).alias("n"))


@query("W17_latest_n", "lifecycle_events", oracle="SELECT correlation_id, event_id FROM lifecycle_events QUALIFY row_number() OVER (PARTITION BY correlation_id ORDER BY event_time DESC, event_id DESC) <= 10")
def _(t: Tables):
    return lc.latest_n(t["lifecycle_events"], "correlation_id", 10, F.desc("event_time"), F.desc("event_id")).select("correlation_id", "event_id")


@query("W19_fallback_chain_outcome", "provider_attempts", oracle="""
WITH a AS (SELECT request_id, count(*) AS n, min(position) FILTER (WHERE result = 'success') AS p, CAST(rank() OVER () AS INT) AS x FROM provider_attempts GROUP BY request_id),
o AS (SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY position) AS k, provider, result FROM provider_attempts),
s AS (SELECT request_id, count(*) AS n, min(k) FILTER (WHERE result = 'success') AS first FROM o GROUP BY 1)
SELECT s.request_id, CASE WHEN first <= 2 THEN o.provider END AS provider_used, CAST(CASE WHEN first <= 2 THEN first - 1 ELSE least(n - 1, 1) END AS INT) AS fallbacks, coalesce(first > 2, true) AND n - 1 > 1 AS budget_exhausted
FROM s LEFT JOIN o ON o.request_id = s.request_id AND o.k = s.first""")
def _(t: Tables):
    return pv.fallback_chain_outcome(t["provider_attempts"], 1)


@query("W21_queue_age", "queue_entries", oracle=f"SELECT CAST(floor(epoch({QUEUE_NOW})) - floor(epoch(min(score_ts))) AS BIGINT) AS oldest_s, 'critical' AS level FROM queue_entries WHERE queue = 'ready'")
def _(t: Tables):
    return jb.queue_age(t["queue_entries"], t.as_of("queue_entries", "score_ts"))


@query("O01_key_union", "provider_attempts", "lifecycle_events", oracle="SELECT provider FROM provider_attempts UNION SELECT provider FROM lifecycle_events")
def _(t: Tables):
    return t["provider_attempts"].select("provider").union(t["lifecycle_events"].select("provider")).distinct()


@query("O02_dedupe_events", "lifecycle_events", oracle="SELECT count(*) AS n FROM (SELECT DISTINCT job_id, event, retry_count, event_time FROM lifecycle_events)")
def _(t: Tables):
    twice = t["lifecycle_events"].unionByName(t["lifecycle_events"])
    return lc.dedupe_events(twice).agg(F.count(F.lit(1)).alias("n"))


@query("O03_missing_set", "jobs", "queue_entries", oracle="SELECT job_id FROM jobs EXCEPT SELECT job_id FROM queue_entries")
def _(t: Tables):
    return t["jobs"].select("job_id").join(t["queue_entries"].select("job_id"), "job_id", "left_anti")


@query("O04_source_concat", "ocr_events", "reliability_events", oracle="SELECT source, count(*) AS n FROM (SELECT 'ocr' AS source FROM ocr_events UNION ALL SELECT 'reliability' FROM reliability_events) GROUP BY 1")
def _(t: Tables):
    return t["ocr_events"].select(F.lit("ocr").alias("source")).unionByName(t["reliability_events"].select(F.lit("reliability").alias("source"))).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
