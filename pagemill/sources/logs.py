"""Structured logs (S01-S05, A22, A23): JSON lines in, event tables and log metrics out."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ("time", "level", "msg", "job_id", "file", "lang", "target", "extraction_failure_reason", "outcome", "extract_ms", "ocr_ms", "translate_ms", "total_ms", "reason", "endpoint", "attempt", "status", "duration_ms", "chunk_idx", "chunk_count", "total_retry_events", "timeout_retry_count", "split_count", "backoff_ms", "err")
FALLBACK = "ocr_fallback_triggered"
CHUNK_MESSAGES = ("chunk_translated", "chunk_translation_failed", "slow_chunk_translation")
SLOW_MS = 30_000
INTEGER = r"^[+-]?\d+$"


def parse_log_lines(lines: DataFrame) -> DataFrame:
    """(value) -> one row per JSON object with the known fields as text, and the object itself (``record``); other lines are skipped.

    A line is parsed once: the generator keeps later filters from pulling the parser into themselves, and fields are read from the parsed
    object, which also knows their types.
    """
    t = F.trim("value")
    d = lines.where(t.startswith("{")).select(F.inline(F.array(F.struct(F.try_parse_json(t).alias("record"))))).where("record IS NOT NULL")
    return d.select("record", *(F.try_variant_get("record", f"$.{f}", "string").alias(f) for f in FIELDS))


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    return parse_log_lines(spark.read.text(path))


def log_time(c: Column) -> Column:
    return F.try_to_timestamp(c)


def filter_since(records: DataFrame, since: datetime, keep_untimed: bool = False) -> DataFrame:
    at = log_time(F.col("time"))
    later = at >= F.lit(since)
    return records.where(F.coalesce(later, F.lit(keep_untimed)))


def field_string(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _kind(name: str) -> Column:
    """The JSON type of a field: STRING, BIGINT, DOUBLE, DECIMAL(..), BOOLEAN, ...; null where it is missing."""
    return F.schema_of_variant(F.try_variant_get("record", f"$.{name}", "variant"))


def field_int64(name: str) -> Column:
    """Integers as they are, other numbers cut off, text only if it is an integer; else 0."""
    kind, text = _kind(name), F.try_variant_get("record", f"$.{name}", "string")
    number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    found = F.when(number, F.try_variant_get("record", f"$.{name}", "bigint")).when((kind == "STRING") & text.rlike(INTEGER), text.try_cast("bigint"))
    return F.coalesce(found, F.lit(0).cast("bigint"))


def route(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """OCR events and reliability events; the exact message wins over the prefix, others are left out."""
    at = log_time(F.col("time")).alias("recorded_at")
    num = lambda n: field_int64(n).alias(n)
    text = lambda n: field_string(F.col(n)).alias(n)
    ocr = records.where(F.col("msg") == FALLBACK).select(at, *(text(n) for n in ("job_id", "file", "lang", "target", "extraction_failure_reason", "outcome")), *(num(n) for n in ("extract_ms", "ocr_ms", "translate_ms", "total_ms")))
    other = records.where((F.col("msg") != FALLBACK) & (F.col("msg").startswith("litellm_") | F.col("msg").startswith("ocr_")))
    kind = F.when(F.col("msg").startswith("litellm_"), "litellm").otherwise("ocr").alias("integration")
    rel = other.select(at, kind, F.col("msg").alias("event_name"), text("reason"), text("endpoint"), num("attempt"), num("status"))
    return ocr, rel


def _integer(name: str) -> Column:
    """The value only if it is an integer in the log, not text."""
    return F.when(_kind(name) == "BIGINT", F.try_variant_get("record", f"$.{name}", "bigint"))


def chunk_log_summary(records: DataFrame, deduplicated: bool = False) -> DataFrame:
    """Chunk events: count, slow ones, longest, mean. A slow chunk is logged twice and counts twice, unless deduplicated."""
    d = records.where(F.col("msg").isin(*CHUNK_MESSAGES)).withColumn("ms", _integer("duration_ms")).where("ms IS NOT NULL")
    if deduplicated:
        d = d.groupBy("job_id", "chunk_idx", "ms").agg(F.max("msg").alias("m"), F.bool_or(F.col("msg") == CHUNK_MESSAGES[2]).alias("s")).withColumn("msg", F.when(F.col("s"), CHUNK_MESSAGES[2]).otherwise(F.col("m")))
    slow = (F.col("ms") > SLOW_MS) | (F.col("msg") == CHUNK_MESSAGES[2])
    return d.agg(F.count(F.lit(1)).alias("total_chunks"), F.count(F.when(slow, 1)).alias("slow_chunks"), F.coalesce(F.max("ms"), F.lit(0)).alias("max_ms"), F.round(F.coalesce(F.avg("ms"), F.lit(0.0)), 2).alias("avg_ms"))


def job_log_metrics(records: DataFrame) -> DataFrame:
    """Per job: each field of the last ``job_finished`` that has it as an integer, and the longest chunk.

    Last by time, times that cannot be read first; at equal times the greater value.
    """
    names = ("duration_ms", "chunk_count", "total_retry_events", "timeout_retry_count", "split_count")
    done, chunk = F.col("msg") == "job_finished", F.col("msg").isin(*CHUNK_MESSAGES[:2])
    last = [F.max_by(_integer(n), F.when(done & _integer(n).isNotNull(), F.struct(log_time(F.col("time")), _integer(n)))).alias(n) for n in names]
    return records.where("job_id IS NOT NULL").groupBy("job_id").agg(*last, F.max(F.when(chunk, _integer("duration_ms"))).alias("max_chunk_ms"))
