"""Jobs and queues: stages, responses, dead letters, retries."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.errors import classify_job_error, holds_any
from .lifecycle import count_if

#: Fixed values.
STALE = timedelta(minutes=10)
LOW_CONFIDENCE = 0.72
EVENT_TYPES = {"detecting_text": "ocr_complete", "translating": "translation_progress", "retrying": "retrying", "fallback_provider": "fallback_provider_active", "rendering": "rendering_progress", "rebuilding_layout": "rendering_progress"}
IMAGE_STAGES = {"detecting_text": "detecting", "understanding_layout": "layout", "detecting_languages": "languages", "translating": "translating", "retrying": "translating", "fallback_provider": "translating", "rebuilding_layout": "typography", "rendering": "rendering", "completed": "rendering"}
NARRATIVES = {"detecting_text": "Detecting text regions", "understanding_layout": "Preserving layout geometry", "detecting_languages": "Detecting languages and script direction", "translating": "Translating content", "rebuilding_layout": "Rebuilding typography", "rendering": "Rendering final image"}
NARRATIVE_MARKS = (("layout", "understanding_layout"), ("language", "detecting_languages"), ("translat", "translating"), ("render", "rendering"), ("typography", "rebuilding_layout"), ("rebuild", "rebuilding_layout"))


def pick(c: Column, table: dict[str, str], default: str | None = None) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def job_event_type(status: Column, stage: Column) -> Column:
    return F.when(status == "completed", "job_complete").when(status == "failed", "job_failed").otherwise(pick(F.lower(stage), EVENT_TYPES, "job_update"))


def infer_stage(status: Column, stage: Column, message: Column, progress: Column) -> Column:
    s, m = F.lower(F.coalesce(stage, F.lit(""))), F.lower(F.coalesce(message, F.lit("")))
    mark, p = F.concat_ws(" ", s, m), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(progress, F.lit(0.0))))
    return (
        F.when(status == "completed", "complete")
        .when((s == "detecting_languages") | mark.contains("language"), "languages")
        .when(holds_any(mark, ("render", "typography", "layout")), "render")
        .when(mark.contains("translat"), "translate")
        .when(holds_any(mark, ("extract", "ocr", "detect")), "extract")
        .when(p >= 0.95, "render").when(p >= 0.65, "translate").when(p >= 0.35, "languages").when(p > 0.05, "extract")
        .otherwise("queued")
    )


def stage_narrative(stage: Column, message: Column) -> Column:
    m, out = F.lower(F.coalesce(message, F.lit(""))), F.lit(None).cast("string")
    for mark, key in reversed(NARRATIVE_MARKS):
        out = F.when(m.contains(mark), NARRATIVES[key]).otherwise(out)
    return F.coalesce(pick(F.lower(stage), NARRATIVES), out)


def reliability_hint(stage: Column, message: Column) -> Column:
    s, m = F.lower(F.coalesce(stage, F.lit(""))), F.lower(F.coalesce(message, F.lit("")))
    return F.when((s == "retrying") | m.contains("retry"), "retrying").when((s == "fallback_provider") | holds_any(m, ("backup", "switching")), "switching")


def low_confidence(confidence: Column, limit: float = LOW_CONFIDENCE) -> Column:
    """A warning with two decimals where 0 < confidence < limit."""
    return F.when((confidence > 0) & (confidence < limit), F.format_string("low OCR confidence: %.2f", confidence))


def project_job(jobs: DataFrame) -> DataFrame:
    """Absent fields are null: pages only for PDFs, stage fields with a stage, the error only when failed."""
    staged = F.col("stage") != ""
    return jobs.select(
        "job_id", "correlation_id", "status", "mode", "updated_at",
        F.when(F.col("type") == "translate_pdf", F.col("total_pages")).alias("total_pages"),
        *(F.when(staged, F.col(c)).alias(c) for c in ("stage", "stage_message", "stage_progress")),
        F.when(F.col("ocr_confidence") > 0, F.col("ocr_confidence")).alias("ocr_confidence"),
        F.when(F.col("status") == "failed", F.col("error")).alias("error"),
    )


def rollup_health(components: DataFrame) -> DataFrame:
    """(name, status, error) -> overall status and the failures that stop a start."""
    bad = F.col("status").isin("down", "error", "warning")
    note = F.when(~F.col("status").isin("ok", "disabled", "warning"), F.concat_ws(": ", "name", F.coalesce(F.nullif("error", F.lit("")), "status")))
    return components.agg(F.when(F.bool_or(bad), "degraded").otherwise("ok").alias("status"), F.array_sort(F.collect_list(note)).alias("startup_failures"))


def queue_component(stats: DataFrame) -> DataFrame:
    return stats.withColumn("status", F.when((F.col("stuck_jobs") > 0) | (F.col("dead_letter_count") > 0), "warning").otherwise("ok"))


def search_dead(dead: DataFrame, status: str = "all", kind: str = "all", text: str = "", newest: bool = True) -> DataFrame:
    d = dead
    if status != "all":
        d = d.where(F.coalesce("status", F.lit("")) == status)
    if kind != "all":
        d = d.where(F.coalesce("type", F.lit("")) == kind)
    if text.strip():
        hay = F.lower(F.concat_ws(" ", *(F.coalesce(F.col(c), F.lit("")) for c in ("job_id", "reason", "status", "type", "mode", "source", "target"))))
        d = d.where(hay.contains(text.strip().lower()))
    at = F.coalesce(F.try_to_timestamp("dead_lettered_at"), F.timestamp_seconds(F.lit(0)))
    return d.withColumn("dead_at", at).orderBy(F.desc("dead_at") if newest else F.asc("dead_at"), "job_id")


def dead_counts(dead: DataFrame) -> DataFrame:
    """Dead letters by status and by type; a missing one is ``unknown``."""
    named = F.array(*(F.struct(F.lit(c).alias("by"), F.coalesce(F.col(c), F.lit("unknown")).alias("name")) for c in ("status", "type")))
    return dead.select(F.inline(named)).groupBy("by", "name").agg(F.count(F.lit(1)).alias("n"))


def queue_stats(queue: DataFrame, as_of: datetime) -> DataFrame:
    q = F.col("queue")
    return queue.agg(
        count_if(q == "ready").alias("queue_depth"), count_if(q == "inflight").alias("inflight_depth"), count_if(q == "retry").alias("retry_backlog"),
        count_if(q == "dead").alias("dead_letter_count"), count_if((q == "inflight") & (F.col("score_ts") <= F.lit(as_of - STALE))).alias("stuck_jobs"),
    )


def overload_level(stats: DataFrame) -> DataFrame:
    depth, retry, stuck = F.col("queue_depth"), F.col("retry_backlog"), F.col("stuck_jobs")
    level = (
        F.when((depth >= 400) | (retry >= 240) | (stuck >= 40), "severe")
        .when((depth >= 200) | (retry >= 120) | (stuck >= 20), "overloaded")
        .when((depth <= 30) & (retry <= 10) & (stuck == 0), "low")
        .otherwise("normal")
    )
    return stats.withColumn("level", level)


def dead_letter_list(queue: DataFrame, jobs: DataFrame, limit: int = 25) -> DataFrame:
    """Newest dead letters with reason and job; ids without a job are listed too."""
    limit = min(limit if limit > 0 else 25, 200)
    newest = queue.where(F.col("queue") == "dead").orderBy(F.desc("pos")).limit(limit).select("job_id", "pos", F.coalesce("reason", F.lit("")).alias("reason"))
    return newest.join(jobs.select("job_id", "status", "type", "mode"), "job_id", "left")


def replay_dead(jobs: DataFrame, queue: DataFrame, ids: DataFrame, as_of: datetime) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Jobs after the replay, the queue after it, and the ids that were not found."""
    dead = queue.where(F.col("queue") == "dead").select("job_id").distinct()
    asked = ids.select("job_id").distinct()
    found = asked.join(dead, "job_id", "left_semi").join(jobs.select("job_id"), "job_id", "left_semi")
    marked = jobs.join(found.withColumn("_hit", F.lit(True)), "job_id", "left")
    hit = F.coalesce("_hit", F.lit(False))
    new = {"status": F.lit("pending"), "error": F.lit(""), "attempt": F.lit(0), "max_attempts": F.when(F.col("max_attempts") <= 0, 3).otherwise(F.col("max_attempts")), "updated_at": F.lit(as_of)}
    after = marked.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in new.items()}).drop("_hit")
    rest = queue.join(found.withColumn("_hit", F.lit(True)), "job_id", "left").where(~(F.coalesce("_hit", F.lit(False)) & F.col("queue").isin("dead", "retry"))).drop("_hit")
    ready = queue.where(F.col("queue") == "dead").join(found, "job_id", "left_semi").dropDuplicates(["job_id"])
    ready = ready.withColumns({"queue": F.lit("ready"), "score_ts": F.lit(as_of).cast(queue.schema["score_ts"].dataType), "reason": F.lit(None).cast("string")})
    return after, rest.unionByName(ready), asked.join(found, "job_id", "left_anti")


def retry_plan(jobs: DataFrame, overloaded: bool, as_of: datetime) -> DataFrame:
    """Failed jobs -> pending at a time, or dead. Delays are without jitter; delay_max_s is their bound with it."""
    reason = F.coalesce(F.nullif(F.trim("error"), F.lit("")), F.lit("job failed without an error message"))
    most = F.when(F.col("max_attempts") <= 0, 3).otherwise(F.col("max_attempts"))
    effective = F.when(F.lit(overloaded) & (most > 1), most - 1).otherwise(most)
    d = jobs.where(F.col("status") == "failed").withColumn("reason", reason).withColumn("next_attempt", F.col("attempt") + 1).withColumn("effective_max", effective)
    d = d.withColumn("kind", classify_job_error(F.col("reason")))
    again = (F.col("kind") == "transient") & (F.col("next_attempt") < F.col("effective_max"))
    base = F.least(F.lit(60.0), 2.0 * F.pow(F.lit(2.0), F.greatest(F.col("next_attempt") - 1, F.lit(0)).cast("double")))
    extra = 3.0 if overloaded else 0.0
    return d.select(
        "job_id", "kind", "next_attempt", "effective_max", F.when(again, "pending").otherwise("failed").alias("next_status"),
        F.when(again, base + extra).alias("delay_s"), F.when(again, base * 1.25 + extra).alias("delay_max_s"),
        F.when(again, F.lit(as_of) + F.make_dt_interval(secs=base + extra)).alias("next_retry_at"), F.when(~again, F.col("reason")).alias("dead_reason"),
    )


def promote_recover(queue: DataFrame, as_of: datetime) -> DataFrame:
    """The next queue: due retries and stale inflight jobs are ready; what stays inflight keeps its marker."""
    due = (F.col("queue") == "retry") & (F.col("score_ts") <= F.lit(as_of))
    stale = (F.col("queue") == "inflight") & (F.col("score_ts") <= F.lit(as_of - STALE))
    return queue.withColumn("moved", due | stale).withColumn("queue", F.when(due | stale, "ready").otherwise(F.col("queue")))


def queue_age(queue: DataFrame, as_of: datetime) -> DataFrame:
    """Age of the oldest ready job: warn above 5 minutes, critical above 15."""
    age = (F.unix_timestamp(F.lit(as_of)) - F.unix_timestamp(F.min("score_ts"))).cast("long")
    d = queue.where(F.col("queue") == "ready").agg(age.alias("oldest_s"))
    return d.withColumn("level", F.when(F.col("oldest_s") > 900, "critical").when(F.col("oldest_s") > 300, "warn").otherwise("ok"))


def canary_summary(jobs: DataFrame) -> DataFrame:
    s = F.col("status")
    return jobs.groupBy("type").agg(F.count(F.lit(1)).alias("files"), count_if(s == "completed").alias("completed"), count_if(s == "failed").alias("failed"))
