"""Queries over logs, stored results, metric text and sinks; streams replayed over the tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import lifecycle as lc
from ..operators import providers as pv
from ..sources import logs as lg
from ..sources import results as rs
from ..streaming import streams as st
from .registry import Tables, query, scratch


def log_lines(t: Tables) -> DataFrame:
    """One log line per event: OCR events, reliability events, job and chunk messages, and lines that aren't records."""
    i = F.col("event_id")
    k = i % 10
    ms = F.col("value").cast("double") * 400
    msg = F.when(k == 0, lg.FALLBACK).when(k == 1, "litellm_retry").when(k == 2, "ocr_retry").when(k == 3, "chunk_translated").when(k == 4, "slow_chunk_translation").when(k == 5, "job_finished").otherwise("other")
    at = F.when(i % 13 == 0, F.lit("not a time")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    total = F.when(i % 4 == 0, F.concat(F.lit('"'), i.cast("string"), F.lit('"'))).when(i % 4 == 1, F.lit('"1.5"')).when(i % 4 == 2, F.concat(i.cast("string"), F.lit(".75"))).otherwise(i.cast("string"))
    dur = F.when(i % 20 == 3, F.lit('"77"')).otherwise(F.floor(ms).cast("long").cast("string"))
    json = F.concat(F.lit('{"time":"'), at, F.lit('","level":"INFO","msg":"'), msg, F.lit('","job_id":"job-'), (F.col("user_id") % 50).cast("string"), F.lit('","total_ms":'), total, F.lit(',"duration_ms":'), dur, F.lit(',"chunk_count":'), (i % 9).cast("string"), F.lit(',"attempt":'), (i % 3).cast("string"), F.lit(',"reason":"r'), (i % 2).cast("string"), F.lit('"}'))
    line = F.when(i % 17 == 0, "").when(i % 17 == 1, F.concat(F.lit("{broken "), json)).when(i % 17 == 2, F.lit("[1, 2]")).otherwise(F.concat(F.lit(" "), json))
    return t["events"].select("event_id", line.alias("value"))


REC = """rec AS (SELECT event_id, ts, user_id, value, event_id % 10 AS k, CASE WHEN event_id % 13 = 0 THEN NULL ELSE date_trunc('second', ts) END AS seen,
  CASE event_id % 4 WHEN 0 THEN event_id WHEN 1 THEN 0 WHEN 2 THEN event_id ELSE event_id END AS total_ms, CASE WHEN event_id % 20 = 3 THEN NULL ELSE CAST(floor(CAST(value AS DOUBLE) * 400) AS BIGINT) END AS dur FROM events WHERE event_id % 17 > 2)"""


def _records(t: Tables) -> DataFrame:
    return lg.parse_log_lines(log_lines(t))


@query("S01_log_scan", "events", oracle=f"WITH {REC} SELECT CASE k WHEN 0 THEN 'ocr_fallback_triggered' WHEN 1 THEN 'litellm_retry' WHEN 2 THEN 'ocr_retry' WHEN 3 THEN 'chunk_translated' WHEN 4 THEN 'slow_chunk_translation' WHEN 5 THEN 'job_finished' ELSE 'other' END AS msg, count(*) AS n FROM rec GROUP BY 1")
def _(t: Tables):
    path = scratch(t.spark, "log-lines")
    log_lines(t).select("value").write.text(path)
    return lg.read_logs(t.spark, path).groupBy("msg").agg(F.count(F.lit(1)).alias("n"))


@query("S02_log_scan_since", "events", oracle=f"WITH {REC} SELECT 'drop' AS variant, count(*) AS n FROM rec WHERE seen >= TIMESTAMP '2024-01-15' UNION ALL SELECT 'keep', count(*) FROM rec WHERE seen >= TIMESTAMP '2024-01-15' OR seen IS NULL")
def _(t: Tables):
    r, cut = _records(t), datetime(2024, 1, 15)
    n = F.count(F.lit(1)).alias("n")
    return lg.filter_since(r, cut).agg(n).select(F.lit("drop").alias("variant"), "n").unionByName(lg.filter_since(r, cut, True).agg(n).select(F.lit("keep").alias("variant"), "n"))


@query("S03_route_log_events", "events", oracle=f"WITH {REC} SELECT CASE k WHEN 0 THEN 'ocr_events' WHEN 1 THEN 'litellm' ELSE 'ocr' END AS part, CASE WHEN k = 0 THEN NULL ELSE CAST(event_id % 3 AS BIGINT) END AS attempt, count(*) AS n FROM rec WHERE k < 3 GROUP BY ALL")
def _(t: Tables):
    ocr, rel = lg.route(_records(t))
    n = F.count(F.lit(1)).alias("n")
    return ocr.groupBy(F.lit("ocr_events").alias("part"), F.lit(None).cast("long").alias("attempt")).agg(n).unionByName(rel.groupBy(F.col("integration").alias("part"), "attempt").agg(n))


@query("S04_coerce_fields", "events", oracle=f"WITH {REC} SELECT CAST(sum(total_ms) AS BIGINT) AS total, count(*) FILTER (WHERE total_ms = 0) AS zeros, count(*) AS n FROM rec WHERE k = 0")
def _(t: Tables):
    return lg.route(_records(t))[0].agg(F.sum("total_ms").alias("total"), F.count(F.when(F.col("total_ms") == 0, 1)).alias("zeros"), F.count(F.lit(1)).alias("n"))


@query("A22_chunk_log_summary", "events", oracle=f"WITH {REC} SELECT count(dur) AS total_chunks, count(*) FILTER (WHERE dur > 30000 OR (k = 4 AND dur IS NOT NULL)) AS slow_chunks, max(dur) AS max_ms, round(avg(dur), 2) AS avg_ms FROM rec WHERE k IN (3, 4)")
def _(t: Tables):
    return lg.chunk_log_summary(_records(t))


@query("A23_job_log_metrics", "events", oracle=f"""
WITH {REC}, s AS (SELECT concat('job-', CAST(user_id % 50 AS STRING)) AS job_id, k, dur, CASE WHEN event_id % 13 = 0 THEN 'not a time' ELSE strftime(seen, '%Y-%m-%dT%H:%M:%SZ') END AS t, event_id FROM rec)
SELECT job_id, max(dur) FILTER (WHERE k = 3) AS max_chunk_ms, (list(dur ORDER BY t <> 'not a time', t, dur) FILTER (WHERE k = 5 AND dur IS NOT NULL))[-1] AS duration_ms,
  (list(event_id % 9 ORDER BY t <> 'not a time', t, event_id % 9) FILTER (WHERE k = 5))[-1] AS chunk_count FROM s GROUP BY 1""")
def _(t: Tables):
    return lg.job_log_metrics(_records(t)).select("job_id", "max_chunk_ms", "duration_ms", "chunk_count")


def _result_json(t: Tables) -> DataFrame:
    block = F.struct("text", "confidence", F.array("x1", "y1", "x2", "y2").alias("bbox"))
    per = t["blocks"].groupBy("doc_id", (F.col("idx") % 3).alias("p")).agg(F.array_sort(F.collect_list(F.struct("idx", block.alias("b")))).alias("q"))
    page = F.struct((F.col("p") + 1).alias("page"), F.lit("t").alias("text"), F.transform("q", lambda x: x["b"]).alias("blocks"))
    docs = per.groupBy("doc_id").agg(F.array_sort(F.collect_list(page)).alias("pages"))
    top = F.when(F.col("doc_id") % 4 == 0, F.slice(F.col("pages")[0]["blocks"], 1, 1))
    return docs.select("doc_id", F.to_json(F.struct(top.alias("blocks"), "pages")).alias("json"))


@query("S05_result_scan", "blocks", oracle="SELECT doc_id, count(DISTINCT idx % 3) AS pages, CASE WHEN doc_id % 4 = 0 THEN 1 ELSE count(*) END AS blocks FROM blocks GROUP BY doc_id")
def _(t: Tables):
    pages, blocks = rs.explode_results(_result_json(t))
    n = F.count(F.lit(1))
    return pages.groupBy("doc_id").agg(n.alias("pages")).join(blocks.groupBy("doc_id").agg(n.alias("blocks")), "doc_id")


@query("S06_manifest_scan", "documents", oracle="SELECT CAST(doc_id AS VARCHAR) AS id, lang AS language, CAST(1 + doc_id % 3 AS INT) AS pages, doc_id % 2 = 0 AS has_text FROM documents")
def _(t: Tables):
    path = scratch(t.spark, "manifest")
    d = t["documents"]
    d.select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("language"), F.expr("transform(sequence(0, doc_id % 3), i -> concat('img/', doc_id, '.png'))").alias("pages"), F.lit("r").alias("reference")).write.json(path)
    m = rs.read_manifest(t.spark, path)
    files = d.select(F.concat(F.lit("img/"), F.col("doc_id"), F.lit(".png")).alias("path")).unionByName(d.where("doc_id % 2 = 0").select(F.concat(F.lit("img/"), F.col("doc_id"), F.lit(".txt")).alias("path")))
    have = rs.pair_files(files).select("id", F.lit(True).alias("has_text"))
    return m.join(have, "id", "left").select("id", "language", F.size("pages").alias("pages"), F.coalesce("has_text", F.lit(False)).alias("has_text"))


@query("S07_metrics_scan", "metric_samples", oracle="SELECT metric, CASE WHEN event_id % 2 = 0 THEN label ELSE '' END AS label, count(*) AS n, CAST(sum(value) AS DOUBLE) AS total FROM metric_samples WHERE event_id % 7 > 0 GROUP BY ALL")
def _(t: Tables):
    i = F.col("event_id")
    v = F.col("value").cast("long").cast("string")
    line = F.when(i % 7 == 0, F.concat(F.lit("# HELP "), "metric")).when(i % 2 == 0, F.concat("metric", F.lit('{provider="'), "label", F.lit('"} '), v)).otherwise(F.concat("metric", F.lit(" "), v, F.lit(".0")))
    m = rs.parse_metrics(t["metric_samples"].select(line.alias("value")))
    return m.groupBy("metric", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("S09_event_sink", "reliability_events", oracle="SELECT CAST(CAST(recorded_at AS DATE) AS VARCHAR) AS event_date, count(*) * 2 AS n FROM reliability_events GROUP BY 1")
def _(t: Tables):
    path = scratch(t.spark, "event-table")
    rs.write_events(t["reliability_events"], path)
    rs.write_events(t["reliability_events"], path)
    return t.spark.read.parquet(path).groupBy(F.col("event_date").cast("string").alias("event_date")).agg(F.count(F.lit(1)).alias("n"))


@query("S11_report_sink", "jobs", oracle="SELECT count(*) AS results, count(DISTINCT type) AS types, count(*) AS summary_files FROM jobs")
def _(t: Tables):
    path = scratch(t.spark, "report")
    rs.write_report(t["jobs"].select("job_id", "type", "status"), t["jobs"].agg(F.count(F.lit(1)).alias("files")), path)
    r, s = t.spark.read.json(f"{path}/results"), t.spark.read.json(f"{path}/summary")
    return r.agg(F.count(F.lit(1)).alias("results"), F.countDistinct("type").alias("types")).crossJoin(s.select(F.col("files").alias("summary_files")))


@query("S12_trend_upsert", "jobs", oracle="SELECT CAST(updated_at AS DATE)::VARCHAR AS day, CASE WHEN CAST(updated_at AS DATE) >= DATE '2024-01-20' THEN max(event_id) ELSE min(event_id) END AS v FROM jobs GROUP BY CAST(updated_at AS DATE)")
def _(t: Tables):
    d = t["jobs"].withColumn("day", F.to_date("updated_at").cast("string"))
    base = d.groupBy("day").agg(F.min("event_id").alias("v")).where("day < '2024-01-25'")
    return rs.upsert_by_key(base, d.where("day >= '2024-01-20'").select("day", F.col("event_id").alias("v")), "day", "v")


@query("P23_snapshot_contract", "lifecycle_events", oracle="""
SELECT correlation_id AS id, CAST((CASE WHEN n % 3 = 0 THEN 1 ELSE 0 END) + (CASE WHEN n % 5 = 0 THEN 1 ELSE 0 END) + (CASE WHEN n % 7 = 0 THEN 1 ELSE 0 END) AS INT) AS problems, n % 4 = 0 AS score_above_one, n % 3 > 0 AND n % 5 > 0 AND n % 7 > 0 AND n % 4 > 0 AS valid FROM (SELECT correlation_id, count(*) AS n FROM lifecycle_events GROUP BY 1)""")
def _(t: Tables):
    n = F.col("n")
    per = t["lifecycle_events"].groupBy("correlation_id").agg(F.count(F.lit(1)).alias("n"))
    derived = F.concat(F.lit('{"queue_depth":'), F.when(n % 5 == 0, '"x"').otherwise(n.cast("string")), F.lit(',"triage_severity_hint":"'), F.when(n % 7 == 0, "loud").otherwise("normal"), F.lit('","triage_trigger_reasons":[]}'))
    head = F.when(n % 3 == 0, F.lit("{")).otherwise(F.lit('{"generated_at":"t",'))
    score = F.when(n % 4 == 0, "1.2").otherwise("0.8")
    json = F.concat(head, F.lit('"correlation_id":"'), "correlation_id", F.lit('","lifecycle_events":[],"provider_metrics":{},"ocr_metrics":{},"provider_policy_snapshot":{"provider_policy_scores":{"p":'), score, F.lit('}},"derived_summary":'), derived, F.lit("}"))
    return rs.check_snapshot(per.select(F.col("correlation_id").alias("id"), json.alias("json"))).select("id", F.size("reasons").alias("problems"), "score_above_one", "valid")


def _stream(t: Tables, table: str, **options) -> DataFrame:
    """A binding written out and read back as a stream."""
    path, src = scratch(t.spark, "stream-in"), t[table]
    src.write.parquet(path)
    st.use_rocksdb(t.spark)
    return t.spark.readStream.schema(src.schema).options(**options).parquet(path)


def _replayed(t: Tables, table: str, build, mode: str = "append") -> DataFrame:
    """The sink's table as the stream ends; update and complete modes have a column ``batch``."""
    spark, out = t.spark, scratch(t.spark, "stream-out")
    w = build(_stream(t, table)).writeStream.option("checkpointLocation", scratch(spark, "stream-state")).trigger(availableNow=True)
    if mode == "append":
        w.format("parquet").option("path", out).start().awaitTermination()
    else:
        w.outputMode(mode).foreachBatch(lambda d, n: d.write.mode("overwrite").parquet(f"{out}/batch={n}")).start().awaitTermination()
    return spark.read.parquet(out)


@query("ST01_stream_route_logs", "events", oracle=f"WITH {REC} SELECT CASE k WHEN 0 THEN 'ocr_events' ELSE 'reliability_events' END AS part, count(*) AS n FROM rec WHERE k < 3 GROUP BY 1")
def _(t: Tables):
    spark = t.spark
    src, a, b = (scratch(spark, n) for n in ("log-stream", "ocr-table", "reliability-table"))
    log_lines(t).select("value").write.text(src)
    st.route_logs(spark.readStream.text(src), a, b, scratch(spark, "route-state")).awaitTermination()
    n = F.count(F.lit(1)).alias("n")
    return spark.read.parquet(a).agg(n).select(F.lit("ocr_events").alias("part"), "n").unionByName(spark.read.parquet(b).agg(n).select(F.lit("reliability_events").alias("part"), "n"))


@query("ST02_stream_hourly", "ocr_events", oracle="SELECT date_trunc('hour', recorded_at) AS hour, outcome, count(*) AS events FROM ocr_events GROUP BY 1, 2 HAVING date_trunc('hour', recorded_at) + INTERVAL 1 HOUR <= (SELECT max(recorded_at) - INTERVAL 10 MINUTE FROM ocr_events)")
def _(t: Tables):
    return _replayed(t, "ocr_events", lambda s: st.hourly(s, "outcome"))


@query("ST03_stream_increase_alerts", "metric_samples", oracle="""
WITH m AS (SELECT event_id, ts, label, value % 100 AS value FROM metric_samples), w AS (SELECT label, ts, event_id, value, date_trunc('hour', ts) - INTERVAL 1 HOUR * unnest(generate_series(0, 23)) + INTERVAL 24 HOUR AS e FROM m),
d AS (SELECT e, label, CASE WHEN value < lag(value) OVER o THEN value ELSE coalesce(value - lag(value) OVER o, 0) END AS d FROM w WINDOW o AS (PARTITION BY e, label ORDER BY ts, event_id)),
i AS (SELECT e, label, sum(d) AS increase FROM d WHERE e <= (SELECT max(m.ts) - INTERVAL 10 MINUTE FROM metric_samples m) GROUP BY 1, 2),
h AS (SELECT *, increase > 20 AS holds, lag(increase > 20) OVER o AS before, lag(e) OVER o AS last FROM i WINDOW o AS (PARTITION BY label ORDER BY e)),
g AS (SELECT *, sum(CASE WHEN before AND last >= e - INTERVAL 1 HOUR THEN 0 ELSE 1 END) OVER (PARTITION BY label ORDER BY e) AS run FROM h WHERE holds),
s AS (SELECT *, min(e) OVER (PARTITION BY label, run) AS since FROM g)
SELECT epoch_us(e) // 1000000 AS evaluated, label, increase, epoch_us(since) // 1000000 AS since FROM s WHERE e - since >= INTERVAL 6 HOUR""")
def _(t: Tables):
    return _replayed(t, "metric_samples", lambda s: st.increase_alerts(s.withColumn("value", F.col("value") % 100), "24 hours", "1 hour", 3600, 20.0, 21_600))


@query("ST04_stream_dedupe", "lifecycle_events", oracle="SELECT count(*) AS n FROM (SELECT DISTINCT job_id, event, retry_count, event_time FROM lifecycle_events)")
def _(t: Tables):
    return _replayed(t, "lifecycle_events", lambda s: st.dedupe(s.unionByName(s))).agg(F.count(F.lit(1)).alias("n"))


@query("ST05_stream_job_state", "jobs", oracle="SELECT status, count(*) AS n FROM jobs GROUP BY 1")
def _(t: Tables):
    d = _replayed(t, "jobs", st.job_states, "update")
    d = d.groupBy("job_id").agg(F.max_by("status", "batch").alias("status"))
    return d.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("ST05_stream_job_changes", "jobs", oracle="""
WITH RECURSIVE o AS (SELECT correlation_id, status, stage, updated_at, row_number() OVER (PARTITION BY correlation_id ORDER BY updated_at, event_id) AS k FROM jobs),
f AS (SELECT correlation_id, k, status, stage, updated_at AS seen, true AS news FROM o WHERE k = 1
  UNION ALL SELECT o.correlation_id, o.k, CASE WHEN quiet THEN f.status ELSE o.status END, CASE WHEN quiet THEN f.stage ELSE o.stage END, CASE WHEN quiet THEN f.seen ELSE o.updated_at END, NOT quiet AND (forgotten OR o.status <> f.status OR o.stage <> f.stage)
  FROM f JOIN (SELECT *, k - 1 AS before FROM o) AS o ON o.correlation_id = f.correlation_id AND o.before = f.k,
  LATERAL (SELECT o.updated_at > f.seen + INTERVAL 24 HOUR AS forgotten), LATERAL (SELECT NOT forgotten AND f.status IN ('completed', 'failed') AS quiet)),
x AS (SELECT correlation_id, status, stage FROM f WHERE news
  UNION ALL SELECT correlation_id, 'stuck', stage FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY correlation_id ORDER BY k DESC) = 1) WHERE status = 'processing' AND seen + INTERVAL 20 MINUTE <= (SELECT max(j.updated_at) FROM jobs j))
SELECT correlation_id AS job_id, status, stage, count(*) AS n FROM x GROUP BY 1, 2, 3""")
def _(t: Tables):
    # a user's jobs as one long job; the source is one file, so one batch sees its rows in order
    d = _replayed(t, "jobs", lambda s: st.job_changes(s.withColumn("job_id", F.col("correlation_id"))))
    return d.groupBy("job_id", "status", "stage").agg(F.count(F.lit(1)).alias("n"))


@query("ST06_stream_provider_health", "provider_attempts", oracle="""
SELECT provider, round(list_reduce(list_prepend(1.0::DOUBLE, list(CASE result WHEN 'success' THEN 1.2 WHEN 'transient' THEN 0.35 ELSE 0.15 END::DOUBLE ORDER BY attempt_time, event_id)), lambda s, x: least(1.5, greatest(0.05, 0.78 * s + 0.22 * x))), 6) AS score FROM provider_attempts GROUP BY 1""")
def _(t: Tables):
    out = scratch(t.spark, "provider-scores")
    st.provider_scores(_stream(t, "provider_attempts"), out, scratch(t.spark, "stream-state")).awaitTermination()
    d = t.spark.read.parquet(out)
    return d.groupBy("provider").agg(F.round(F.max_by("score", "batch"), 6).alias("score"))


@query("ST07_stream_lifecycle_metrics", "lifecycle_events", oracle="SELECT count(*) FILTER (WHERE event = 'chunk_retry') AS retries_total, count(*) FILTER (WHERE event = 'job_failed') AS job_failed_total, count(*) FILTER (WHERE event = 'ocr_completed') AS ocr_count FROM lifecycle_events")
def _(t: Tables):
    d = _replayed(t, "lifecycle_events", st.lifecycle_metrics, "complete")
    last = Window.orderBy(F.desc("batch"))  # one row per batch
    return d.withColumn("_n", F.row_number().over(last)).where("_n = 1").select("retries_total", "job_failed_total", "ocr_count")


@query("ST08_stream_correlation_sessions", "lifecycle_events", oracle="""
WITH g AS (SELECT correlation_id, event_time, CASE WHEN event_time - lag(event_time) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM lifecycle_events WINDOW w AS (PARTITION BY correlation_id ORDER BY event_time)), s AS (SELECT *, sum(new) OVER (PARTITION BY correlation_id ORDER BY event_time ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT correlation_id, min(event_time) AS start, max(event_time) + INTERVAL 30 MINUTE AS "end", count(*) AS events FROM s GROUP BY correlation_id, k HAVING max(event_time) + INTERVAL 30 MINUTE <= (SELECT max(event_time) - INTERVAL 10 MINUTE FROM lifecycle_events)""")
def _(t: Tables):
    return _replayed(t, "lifecycle_events", st.sessions)
