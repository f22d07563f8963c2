"""Views over the driver's tables in the shapes that the operators take, as SQL that Spark and DuckDB both run.

Derived values are invented for coverage; see FIXTURES.md.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = ("events", "documents", "pages", "benchmark", "labels", "conversations")

OCR_EVENTS = """SELECT event_id AS id, ts AS recorded_at,
  concat('job-', CAST(event_id AS STRING)) AS job_id,
  concat('file-', CAST(user_id AS STRING), '.pdf') AS file,
  CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'de' WHEN 2 THEN 'en' WHEN 3 THEN 'fr' ELSE 'ar' END AS lang,
  CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'en' WHEN 2 THEN 'de' ELSE 'fr' END AS target,
  CASE event_id % 3 WHEN 0 THEN 'empty text' WHEN 1 THEN 'force_ocr requested' ELSE 'pdf: open failed' END AS extraction_failure_reason,
  CASE event_type WHEN 'error' THEN 'also_failed' WHEN 'view' THEN 'cached' WHEN 'signup' THEN 'translation_failed' ELSE 'succeeded' END AS outcome,
  CAST(user_id % 40 AS BIGINT) AS extract_ms,
  CASE WHEN event_id % 11 = 0 THEN CAST(0 AS BIGINT) ELSE CAST(floor(value * 60) AS BIGINT) END AS ocr_ms,
  CAST(floor(value * 30) AS BIGINT) AS translate_ms,
  CASE WHEN event_id % 17 = 0 THEN CAST(0 AS BIGINT) ELSE CAST(floor(value * 100) AS BIGINT) END AS total_ms
FROM events"""

RELIABILITY_EVENTS = """SELECT event_id AS id, ts AS recorded_at,
  CASE WHEN user_id % 2 = 0 THEN 'litellm' ELSE 'ocr' END AS integration,
  CASE WHEN user_id % 2 = 0 THEN
    CASE event_id % 5 WHEN 0 THEN 'litellm_retry' WHEN 1 THEN 'litellm_circuit_open' WHEN 2 THEN 'litellm_circuit_reject' WHEN 3 THEN 'litellm_response_rejected' ELSE 'litellm_other' END
  ELSE
    CASE event_id % 4 WHEN 0 THEN 'ocr_retry' WHEN 1 THEN 'ocr_response_rejected' WHEN 2 THEN 'ocr_provider_fallback' ELSE 'ocr_completed' END
  END AS event_name,
  CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'invalid_json' ELSE 'invalid_schema' END AS reason,
  CASE WHEN user_id % 2 = 0 THEN '' ELSE CASE event_id % 2 WHEN 0 THEN '/api/v1/ocr' ELSE '/api/v1/ocr/pdf' END END AS endpoint,
  CAST(event_id % 4 AS BIGINT) AS attempt,
  CAST(CASE event_type WHEN 'error' THEN 503 ELSE 200 END AS BIGINT) AS status
FROM events"""

LIFECYCLE_EVENTS = """SELECT event_id, ts AS event_time, CASE event_id % 15 WHEN 0 THEN 'job_created' WHEN 1 THEN 'upload_received' WHEN 2 THEN 'ocr_started' WHEN 3 THEN 'ocr_completed' WHEN 4 THEN 'translation_started' WHEN 5 THEN 'chunk_started' WHEN 6 THEN 'chunk_completed' WHEN 7 THEN 'chunk_retry' WHEN 8 THEN 'provider_failover' WHEN 9 THEN 'render_started' WHEN 10 THEN 'render_completed' WHEN 11 THEN 'export_started' WHEN 12 THEN 'export_completed' WHEN 13 THEN 'job_failed' ELSE 'job_completed' END AS event,
  concat('job-', CAST(CAST(floor(event_id / 15) AS BIGINT) AS STRING)) AS job_id,
  concat('corr-', CAST(user_id AS STRING)) AS correlation_id,
  CASE user_id % 3 WHEN 0 THEN 'paddle' WHEN 1 THEN 'surya' ELSE 'pipeline' END AS provider,
  CAST(floor(value * 50) AS BIGINT) AS duration_ms,
  CAST(event_id % 4 AS BIGINT) AS retry_count,
  CAST(user_id * 10 AS BIGINT) AS queue_depth
FROM events"""

METRIC_SAMPLES = """SELECT ts, event_id, 'provider_timeout_total' AS metric,
  CASE user_id % 3 WHEN 0 THEN 'p0' WHEN 1 THEN 'p1' ELSE 'p2' END AS label,
  CAST(count(*) OVER (PARTITION BY user_id % 3 ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS value
FROM events WHERE event_type = 'error'"""
#: The same for Spark: rows are counted within hours, and hours are carried (one row for each), so that no window holds a series.
_METRIC_SAMPLES_SPARK = """WITH m AS (SELECT ts, event_id, user_id % 3 AS k, floor(unix_micros(CAST(ts AS TIMESTAMP)) / 3600000000) AS hour FROM events WHERE event_type = 'error'),
h AS (SELECT k AS hk, hour AS hh, sum(count(*)) OVER (PARTITION BY k ORDER BY hour NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM m GROUP BY k, hour)
SELECT ts, event_id, 'provider_timeout_total' AS metric, CASE k WHEN 0 THEN 'p0' WHEN 1 THEN 'p1' ELSE 'p2' END AS label,
  CAST(coalesce(earlier, 0) + row_number() OVER (PARTITION BY k, hour ORDER BY ts NULLS LAST, event_id NULLS LAST) AS DOUBLE) AS value
FROM m JOIN h ON k <=> hk AND hour <=> hh"""

#: Samples of all metrics of the alert rules, two seconds apart, with a slow change between calm and trouble, resets, and gaps without any sample.
_GROWN = "(floor(e / 1200) * 800 + greatest(0, e % 1200 - 400))"
RULE_SAMPLES = f"""SELECT TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '2' SECOND * e AS ts, e AS event_id, metric,
  concat('p', CAST(s % 3 AS STRING)) AS label, concat('i', CAST(CAST(floor(s / 3) AS BIGINT) % 2 AS STRING)) AS instance,
  CAST(CASE metric
    WHEN 'queue_depth' THEN CASE WHEN bad THEN 1000 ELSE 200 END + user_id
    WHEN 'queue_stuck_jobs' THEN CASE WHEN bad THEN 1 + user_id % 3 ELSE 0 END
    WHEN 'queue_dead_letter_volume' THEN CASE WHEN bad THEN 10 + user_id % 5 ELSE 2 END
    WHEN 'pipeline_chunk_success_ratio' THEN CASE WHEN bad THEN 0.9 ELSE 0.99 END
    WHEN 'pipeline_export_success_ratio' THEN CASE WHEN bad THEN 0.97 ELSE 0.99 END
    WHEN 'queue_retry_backlog' THEN CASE WHEN bad THEN 200 + user_id ELSE 10 END
    WHEN 'ocr_provider_fallback_budget_exhausted_total' THEN CASE WHEN s % 3 = 0 THEN floor({_GROWN} / 150) ELSE floor({_GROWN} / 20) % 500 END
    WHEN 'litellm_circuit_opened_total' THEN floor({_GROWN} / 50)
    WHEN 'pipeline_retries_total' THEN floor({_GROWN} / 2) % 5000
    WHEN 'litellm_circuit_reject_total' THEN floor({_GROWN} / 2) % 2000
    WHEN 'degraded_render_fallback_total' THEN floor({_GROWN} / 20)
    ELSE floor({_GROWN} / 5) % 700 END AS DOUBLE) AS value
FROM (SELECT event_id AS e, user_id, CAST(floor(event_id / 17) AS BIGINT) AS s, event_id % 1200 >= 400 AS bad,
  CASE event_id % 17 WHEN 0 THEN 'queue_depth' WHEN 1 THEN 'queue_stuck_jobs' WHEN 2 THEN 'queue_dead_letter_volume' WHEN 3 THEN 'pipeline_chunk_success_ratio'
    WHEN 4 THEN 'pipeline_export_success_ratio' WHEN 5 THEN 'queue_retry_backlog' WHEN 6 THEN 'ocr_provider_fallback_budget_exhausted_total' WHEN 7 THEN 'litellm_circuit_opened_total'
    WHEN 8 THEN 'pipeline_retries_total' WHEN 9 THEN 'litellm_circuit_reject_total' WHEN 10 THEN 'degraded_render_fallback_total' WHEN 11 THEN 'provider_timeout_total'
    WHEN 12 THEN 'degraded_mode_total' WHEN 13 THEN 'adaptive_concurrency_clamp_total' WHEN 14 THEN 'adaptive_concurrency_reduce_total' WHEN 15 THEN 'adaptive_concurrency_boost_total'
    ELSE 'pipeline_timeouts_total' END AS metric FROM events) WHERE e % 3000 NOT BETWEEN 700 AND 799"""

JOBS = """SELECT event_id, concat('job-', CAST(event_id AS STRING)) AS job_id, concat('corr-', CAST(user_id AS STRING)) AS correlation_id,
  CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'processing' WHEN 'signup' THEN 'pending' ELSE 'completed' END AS status,
  CASE event_id % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'translate_pdf' ELSE 'translate_image' END AS type,
  CASE event_id % 3 WHEN 0 THEN 'overlay' WHEN 1 THEN 'ocr_only' ELSE 'layout' END AS mode,
  CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN 'detecting_text' WHEN 2 THEN 'translating' WHEN 3 THEN 'retrying' WHEN 4 THEN 'fallback_provider' WHEN 5 THEN 'rendering' ELSE 'rebuilding_layout' END AS stage,
  CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'Extracting page text' WHEN 2 THEN 'Detecting language' WHEN 3 THEN 'Switching to backup' ELSE 'working' END AS stage_message,
  CAST(event_id % 21 AS DOUBLE) / 20 AS stage_progress,
  CASE event_id % 6 WHEN 0 THEN 'litellm status 429' WHEN 1 THEN 'Gateway Timeout' WHEN 2 THEN 'Invalid API key' WHEN 3 THEN 'connection refused' WHEN 4 THEN 'unsupported language: request timeout' ELSE 'disk full' END AS error,
  CAST(event_id % 4 AS BIGINT) AS attempt, CAST(3 AS BIGINT) AS max_attempts,
  CAST(event_id % 9 AS DOUBLE) / 10 AS ocr_confidence, CAST(event_id % 30 AS BIGINT) AS total_pages, ts AS updated_at
FROM events"""

QUEUE_ENTRIES = """SELECT CASE event_id % 4 WHEN 0 THEN 'ready' WHEN 1 THEN 'inflight' WHEN 2 THEN 'retry' ELSE 'dead' END AS queue,
  concat('job-', CAST(event_id AS STRING)) AS job_id, ts AS score_ts, event_id AS pos,
  CASE event_id % 8 WHEN 3 THEN 'timed out' WHEN 7 THEN 'disk full' END AS reason
FROM events WHERE event_type IN ('error', 'view', 'signup')"""

PROVIDER_ATTEMPTS = """SELECT CAST(floor(event_id / 3) AS BIGINT) AS request_id, CAST(event_id % 3 AS BIGINT) AS position,
  CASE event_id % 3 WHEN 0 THEN 'paddle' WHEN 1 THEN 'tesseract' ELSE 'unlimited' END AS provider,
  CASE WHEN event_type IN ('purchase', 'click') THEN 'success' WHEN event_type = 'error' THEN 'permanent' ELSE 'transient' END AS result,
  CAST(floor(value * 50) AS BIGINT) AS latency_ms, ts AS attempt_time, event_id
FROM events"""

_LINES_SPARK = "(SELECT doc_id, lang, pos, line FROM documents LATERAL VIEW posexplode(split(text, '\\\\n')) AS pos, line)"
_LINES_DUCK = "(SELECT doc_id, lang, CAST(p - 1 AS INTEGER) AS pos, line FROM (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents))"
_BLOCKS = """SELECT doc_id, 1 AS page_no, CAST(pos AS BIGINT) AS idx, line AS text, lang,
  CAST((doc_id * 31 + pos * 17) % 100 AS DOUBLE) / 100 AS confidence,
  CAST((pos % 2) * 500 AS DOUBLE) AS x1, CAST(floor(pos / 2) * 40 AS DOUBLE) AS y1,
  CAST((pos % 2) * 500 + 40 + least(length(line), 44) * 10 AS DOUBLE) AS x2,
  CAST(floor(pos / 2) * 40 + 20 + (pos % 5) * 4 AS DOUBLE) AS y2
FROM {lines}"""

BLOCKS_B = """SELECT doc_id, page_no, idx, concat(text, '*') AS text, lang,
  CAST((doc_id * 13 + idx * 29) % 100 AS DOUBLE) / 100 AS confidence,
  x1 + idx % 7 AS x1, y1 + idx % 5 AS y1, x2 + idx % 7 AS x2, y2 + idx % 5 AS y2
FROM blocks WHERE idx % 9 <> 4"""

#: Every text, whole, in passages of 200 characters; a passage and a misread copy are a pair.
_EVAL = """SELECT doc_id, CAST(pos AS BIGINT) AS pos, lang, document_type, CASE doc_id % 2 WHEN 0 THEN 'paddle' ELSE 'unlimited' END AS engine,
  passage AS reference, translate(passage, 'eo', 'ac') AS hypothesis FROM {passages}"""
_PASSAGES_SPARK = "(SELECT doc_id, lang, source AS document_type, pos, passage FROM documents LATERAL VIEW posexplode(regexp_extract_all(text, '(?s).{{1,200}}', 0)) AS pos, passage)"
_PASSAGES_DUCK = "(SELECT doc_id, lang, document_type, p - 1 AS pos, passage FROM (SELECT doc_id, lang, source AS document_type, unnest(r) AS passage, generate_subscripts(r, 1) AS p FROM (SELECT *, regexp_extract_all(text, '(?s).{1,200}') AS r FROM documents)))"

SPARK = {
    "ocr_events": OCR_EVENTS, "reliability_events": RELIABILITY_EVENTS, "lifecycle_events": LIFECYCLE_EVENTS, "metric_samples": _METRIC_SAMPLES_SPARK, "rule_samples": RULE_SAMPLES, "jobs": JOBS,
    "queue_entries": QUEUE_ENTRIES, "provider_attempts": PROVIDER_ATTEMPTS, "blocks": _BLOCKS.format(lines=_LINES_SPARK), "blocks_b": BLOCKS_B,
    "eval_pairs": _EVAL.format(passages=_PASSAGES_SPARK),
}
DUCKDB = SPARK | {"metric_samples": METRIC_SAMPLES, "blocks": _BLOCKS.format(lines=_LINES_DUCK), "eval_pairs": _EVAL.format(passages=_PASSAGES_DUCK)}
NEEDS = {"blocks_b": ("blocks",)}


def bound(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, or a binding over one."""
    if name not in SPARK:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = SPARK[name].replace("FROM blocks", "FROM {blocks}").replace("FROM events", "FROM {events}").replace("FROM documents", "FROM {documents}")
    used = {n: bound(spark, sf_dir, n) for n in ("blocks", "events", "documents") if f"{{{n}}}" in sql}
    return spark.sql(sql, **used)


def with_bindings(sql: str, names: tuple[str, ...]) -> str:
    """DuckDB SQL with the bindings it uses as common table expressions in front."""
    ordered: list[str] = []
    for n in names:
        ordered += [x for x in (*NEEDS.get(n, ()), n) if x in DUCKDB and x not in ordered]
    if not ordered:
        return sql
    ctes = ", ".join(f"{n} AS ({DUCKDB[n]})" for n in ordered)
    body = sql.strip()
    return f"WITH RECURSIVE {ctes}, {body[4:].strip().removeprefix('RECURSIVE ')}" if body.upper().startswith("WITH") else f"WITH RECURSIVE {ctes} {body}"
