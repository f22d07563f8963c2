"""OCR results, eval manifests, metric text (S05-S07, P23) and sinks."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK = "struct<text:string,confidence:double,reading_order:int,bbox:array<double>,region_class:string,hierarchy_level:int,column_id:int>"
RESULT = f"struct<text:string,confidence:double,blocks:array<{BLOCK}>,pages:array<struct<page:int,text:string,confidence:double,blocks:array<{BLOCK}>>>>"
MANIFEST = "id string, language string, document_type string, pages array<string>, reference string, features array<string>"
IMAGES = ("png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp")
#: Keys and signals an incident snapshot needs.
ROOT_KEYS = ("generated_at", "correlation_id", "lifecycle_events", "provider_metrics", "ocr_metrics", "provider_policy_snapshot", "derived_summary")
NUMERIC = ("queue_depth", "retry_backlog", "degraded_total", "render_fallback_total", "ocr_low_confidence_total", "provider_timeouts_total", "provider_retries_total", "ocr_rejected_total")


def explode_results(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, json) -> pages, blocks. Top-level blocks come first; without them, those of the pages."""
    d = rows.select("doc_id", F.from_json("json", RESULT).alias("r")).where("r IS NOT NULL")
    pages = d.select("doc_id", F.posexplode_outer("r.pages").alias("i", "p")).where("p IS NOT NULL").select("doc_id", F.coalesce("p.page", F.col("i") + 1).alias("page_no"), "p.text", "p.confidence")
    flat = F.flatten(F.transform(F.coalesce("r.pages", F.expr("CAST(array() AS array<struct<page:int,text:string,confidence:double,blocks:array<" + BLOCK + ">>>)")), lambda p: F.coalesce(p["blocks"], F.expr(f"CAST(array() AS array<{BLOCK}>)"))))
    chosen = F.when(F.size("r.blocks") > 0, F.col("r.blocks")).otherwise(flat)
    blocks = d.select("doc_id", F.posexplode(chosen).alias("idx", "b")).select("doc_id", "idx", "b.*")
    return pages, blocks


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array, or JSON lines."""
    head = spark.read.text(path).where(F.trim("value") != "").select(F.trim("value").startswith("[")).first()  # the first line with text
    return spark.read.schema(MANIFEST).json(path, multiLine=bool(head and head[0]))


def pair_files(files: DataFrame) -> DataFrame:
    """(path) -> images with the text file of the same stem."""
    d = files.withColumn("stem", F.regexp_replace("path", r"\.[^./]+$", "")).withColumn("ext", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)))
    text = d.where("ext = 'txt'").select("stem", F.col("path").alias("reference"))
    return d.where(F.col("ext").isin(*IMAGES)).join(text, "stem").select(F.element_at(F.split("stem", "/"), -1).alias("id"), F.array("path").alias("pages"), "reference")


def parse_metrics(lines: DataFrame) -> DataFrame:
    """(value) -> metric, label, value; bare metrics and those with one provider label, comments skipped."""
    number = r"([-+]?\d+(?:\.\d+)?)$"
    t = F.trim("value")
    d = lines.where((t != "") & ~t.startswith("#")).withColumn("t", t)
    d = d.withColumn("kind", F.when(F.col("t").rlike(rf'^[a-zA-Z_:][a-zA-Z0-9_:]*\{{provider="[^"]+"\}}\s+{number}'), 1).when(F.col("t").rlike(rf"^[a-zA-Z_:][a-zA-Z0-9_:]*\s+{number}"), 2)).where("kind IS NOT NULL")
    return d.select(F.regexp_extract("t", r"^([a-zA-Z_:][a-zA-Z0-9_:]*)", 1).alias("metric"), F.regexp_extract("t", r'provider="([^"]+)"', 1).alias("label"), F.regexp_extract("t", number, 1).cast("double").alias("value"))


def check_snapshot(rows: DataFrame) -> DataFrame:
    """(id, json) -> reasons why an incident snapshot is not valid; scores above 1 are reported apart."""
    j = lambda p: F.get_json_object("json", f"$.{p}")
    reasons = [F.when(~F.array_contains(F.coalesce(F.json_object_keys("json"), F.array().cast("array<string>")), k), F.lit(f"missing {k}")) for k in ROOT_KEYS]
    number = r"^[-+]?\d+(\.\d+)?([eE][-+]?\d+)?$"
    reasons += [F.when(j(f"derived_summary.{n}").isNotNull() & ~j(f"derived_summary.{n}").rlike(number), F.lit(f"{n} must be numeric or null")) for n in NUMERIC]
    reasons.append(F.when(~F.coalesce(j("derived_summary.triage_severity_hint").isin("normal", "warning", "critical"), F.lit(False)), F.lit("severity")))
    reasons.append(F.when(F.from_json(j("derived_summary.triage_trigger_reasons"), "array<string>").isNull(), F.lit("reasons must be an array")))
    scores = F.map_values(F.coalesce(F.from_json(j("provider_policy_snapshot.provider_policy_scores"), "map<string,double>"), F.expr("CAST(map() AS map<string,double>)")))
    reasons.append(F.when(F.exists(scores, lambda s: s.isNull() | (s < 0)), F.lit("score must be within [0, 1]")))
    return rows.withColumn("reasons", F.array_compact(F.array(*reasons))).withColumn("score_above_one", F.exists(scores, lambda s: s > 1)).withColumn("valid", (F.size("reasons") == 0) & ~F.col("score_above_one"))


def write_events(events: DataFrame, path: str, column: str = "recorded_at", batch: int | None = None) -> None:
    """Append, partitioned by day. With a batch number also by batch, and what that batch has written before is replaced."""
    d = events.withColumn("event_date", F.to_date(column))
    if batch is None:
        d.write.partitionBy("event_date").mode("append").parquet(path)
    else:
        d.withColumn("batch", F.lit(batch).cast("long")).write.partitionBy("event_date", "batch").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def prune_events(spark: SparkSession, path: str, as_of: datetime, retention: timedelta = timedelta(days=30), column: str = "recorded_at", inner: tuple[str, ...] = ()) -> int:
    """Delete the rows of a table by day (see :func:`write_events`) that are older than the retention; their number.

    Whole days before the cutoff's day lose their folders. Of that day, the rows that stay are written beside the table and then take
    its folder's place. A run that stopped half way is taken up by the next one: if the old folder is there, what was
    written beside is thrown away; if it is gone, that takes its place. Rows at the cutoff stay, and so do rows without a time.
    ``inner``: columns that partition the days further.
    """
    cutoff = as_of - retention
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(conf)
    beside = f"{path.rstrip('/')}/_retention"
    if fs.exists(at(beside)):
        for f in fs.listStatus(at(beside)):
            day = f.getPath().getName()
            if not fs.exists(at(f"{path}/{day}")) and fs.exists(at(f"{beside}/{day}/_SUCCESS")):
                fs.rename(f.getPath(), at(f"{path}/{day}"))
        fs.delete(at(beside), True)
    day = F.to_date(F.col("event_date").cast("string"))
    table = spark.read.parquet(path)
    edge = f"event_date={cutoff.date().isoformat()}"
    gone = table.where(day < F.lit(cutoff.date())).groupBy(day.cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n")).collect()  # one row for each day
    at_edge = table.where(day == F.lit(cutoff.date()))
    old, kept = at_edge.agg(F.count(F.when(F.col(column) < F.lit(cutoff), 1)), F.count(F.when(~F.coalesce(F.col(column) < F.lit(cutoff), F.lit(False)), 1))).first()
    if old and kept:
        rest = at_edge.where(~F.coalesce(F.col(column) < F.lit(cutoff), F.lit(False))).drop("event_date")
        rest.write.partitionBy(*inner).parquet(f"{beside}/{edge}") if inner else rest.write.parquet(f"{beside}/{edge}")
    for r in gone:
        fs.delete(at(f"{path}/event_date={r.day}"), True)
    if old:
        fs.delete(at(f"{path}/{edge}"), True)
        if kept:
            fs.rename(at(f"{beside}/{edge}"), at(f"{path}/{edge}"))
    fs.delete(at(beside), True)
    return sum(r.n for r in gone) + old


def write_report(results: DataFrame, summary: DataFrame, path: str) -> None:
    """Results as JSON lines beside a one-row summary."""
    results.write.mode("overwrite").json(f"{path}/results")
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")


def upsert_by_key(base: DataFrame, updates: DataFrame, key: str, recency: str) -> DataFrame:
    """Rows of ``updates`` replace those with the same key; of several, the most recent stays."""
    w = Window.partitionBy(key).orderBy(F.desc(recency))
    new = updates.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return base.join(new.select(key), key, "left_anti").unionByName(new)
