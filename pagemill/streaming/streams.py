"""Streaming twins of the batch operators (ST01-ST08). Event time with a watermark of ten minutes; later rows are dropped."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.lifecycle import pipeline_snapshot
from ..operators.providers import provider_health
from ..sources.logs import parse_log_lines, route
from ..sources.results import write_events

WATERMARK = "10 minutes"


def use_rocksdb(spark: SparkSession) -> None:
    """State with timers and several values needs the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def log_writer(ocr_path: str, reliability_path: str):
    """Writes a batch of log lines to both event tables, in partitions of the day and the batch.

    A batch that is run again, because a failure came between the two writes or before the stream's own commit, overwrites its
    partitions: every line is in its table once.
    """

    def write(batch: DataFrame, n: int) -> None:
        kept = parse_log_lines(batch)
        for df, path in zip(route(kept), (ocr_path, reliability_path), strict=True):
            write_events(df, path, batch=n)

    return write


def route_logs(lines: DataFrame, ocr_path: str, reliability_path: str, checkpoint: str):
    """Both event tables from one stream of log lines, each line exactly once."""
    return lines.writeStream.foreachBatch(log_writer(ocr_path, reliability_path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly(events: DataFrame, *by: str, column: str = "recorded_at") -> DataFrame:
    d = events.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, WATERMARK)
    return d.groupBy(F.window(column, "1 hour"), *by).agg(F.count(F.lit(1)).alias("events")).select(F.col("window.start").alias("hour"), *by, "events")


def increases(samples: DataFrame, length: str = "10 minutes", slide: str = "30 seconds") -> DataFrame:
    """Increase per label in sliding windows, from the samples inside a window; a drop is a reset and counts from 0.

    A group holds one counter's samples of one window: their number is the window's length times the rate of sampling.
    """
    d = samples.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", WATERMARK)
    g = d.groupBy(F.window("ts", length, slide), "label").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))).alias("v"))

    def step(acc: Column, x: Column) -> Column:
        more = F.when(acc["last"].isNull(), 0.0).when(x["value"] < acc["last"], x["value"]).otherwise(x["value"] - acc["last"])
        return F.struct((acc["sum"] + more).alias("sum"), x["value"].alias("last"))

    zero = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("last"))
    return g.select("window", "label", F.aggregate("v", zero, step)["sum"].alias("increase"))


class Hold(StatefulProcessor):
    """Evaluations of a label in order: fires once the condition has held for ``hold_s`` seconds at evaluations ``every_s`` apart."""

    def __init__(self, threshold: float, hold_s: int, every_s: int) -> None:
        self.threshold, self.hold_s, self.every_s = threshold, hold_s, every_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", "since long, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        since, last = self.run.get() if self.run.exists() else (None, None)
        for r in pd.concat(list(rows)).sort_values("evaluated").itertuples():
            if not r.increase > self.threshold:
                since = None
            elif since is None or r.evaluated - last > self.every_s:
                since = r.evaluated
            last = r.evaluated
            if since is not None and r.evaluated - since >= self.hold_s:
                out.append((r.evaluated, key[0], r.increase, since))
        self.run.update((since, last))
        yield pd.DataFrame(out, columns=["evaluated", "label", "increase", "since"])

    def close(self) -> None:
        pass


def increase_alerts(samples: DataFrame, length: str, slide: str, slide_s: int, threshold: float, hold_s: int) -> DataFrame:
    """Windows (W02) whose increase has been above the threshold for ``hold_s`` seconds (W03), one evaluation per slide.

    An evaluation without samples ends a run. evaluated and since are windows' ends in seconds.
    """
    d = increases(samples, length, slide).select("label", "increase", F.unix_timestamp("window.end").alias("evaluated"))
    return d.groupBy("label").transformWithStateInPandas(Hold(threshold, hold_s, slide_s), "evaluated long, label string, increase double, since long", "Append", "None")


def dedupe(events: DataFrame) -> DataFrame:
    """One event per job, event, attempt and time within the watermark."""
    d = events.withColumn("event_time", F.col("event_time").cast("timestamp")).withWatermark("event_time", WATERMARK)
    return d.dropDuplicatesWithinWatermark(["job_id", "event", "retry_count", "event_time"])


def lifecycle_metrics(events: DataFrame) -> DataFrame:
    return pipeline_snapshot(events)


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    d = events.withColumn("event_time", F.col("event_time").cast("timestamp")).withWatermark("event_time", WATERMARK)
    s = d.groupBy(F.session_window("event_time", gap), "correlation_id").agg(F.count(F.lit(1)).alias("events"))
    return s.select("correlation_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")


def provider_scores(attempts: DataFrame, path: str, checkpoint: str):
    """Scores per provider as a table with a version for each batch (``batch=N``): a batch's fold starts from the version before it.

    A batch that is run again writes its version again. Within a batch the fold is the batch operator's: by hours, in the JVM.
    """

    def write(batch: DataFrame, n: int) -> None:
        old = batch.sparkSession.read.schema("provider string, score double").parquet(f"{path}/batch={n - 1}") if n else None
        new = provider_health(batch, old).groupBy("provider").agg(F.max_by("score", "day").alias("score"))
        if old is not None:
            new = new.unionByName(old.join(new.select("provider"), "provider", "left_anti"))
        new.write.mode("overwrite").parquet(f"{path}/batch={n}")

    return attempts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class JobState(StatefulProcessor):
    """Emits a job when its status or stage changes; ten minutes of event time without news in work make it stuck; a terminal status closes it.

    A job is forgotten 24 hours after its last news, or after its end: rows up to then say nothing about a closed job, later ones
    begin it anew. Timers delete what has been forgotten, and are themselves deleted when news move them, so state holds the jobs of one day.
    """

    STUCK, TTL = 10 * 60 * 1000, 24 * 60 * 60 * 1000
    TERMINAL = ("completed", "failed")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "status string, stage string, at long")

    def _due(self, state: tuple) -> int:
        """The state's next timer: that of a job in work is its end of patience, which sets the one that forgets it."""
        return state[2] + (self.STUCK if state[0] == "processing" else self.TTL)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        before = old = self.last.get()
        parts = list(rows)
        d = parts[0] if len(parts) == 1 else pd.concat(parts)
        times = d["updated_at"].to_numpy()
        order = np.lexsort((d["event_id"].to_numpy(), times))
        seen = times.astype("datetime64[ms]").astype(np.int64)
        for status, stage, at in zip(*(c[order].tolist() for c in (d["status"].to_numpy(), d["stage"].to_numpy(), seen)), strict=True):
            if old is not None and at > old[2] + self.TTL:
                old = None
            if old is not None and old[0] in self.TERMINAL:
                continue
            if old is None or (old[0], old[1]) != (status, stage):
                out.append((key[0], status, stage))
            old = (status, stage, at)
        if old != before:
            if before is not None:
                for due in {self._due(before), before[2] + self.TTL}:
                    self.handle.deleteTimer(due)
            self.last.update(old)
            self.handle.registerTimer(self._due(old))
        if out:
            yield pd.DataFrame(out, columns=["job_id", "status", "stage"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        old, now = self.last.get(), expiredTimerInfo.getExpiryTimeInMs()
        if old is None:
            return
        end = old[2] + self.TTL
        if old[0] == "processing" and old[2] + self.STUCK == now:
            yield pd.DataFrame({"job_id": [key[0]], "status": ["stuck"], "stage": [old[1]]})
            if timerValues.getCurrentWatermarkInMs() < end:
                self.handle.registerTimer(end)
            else:
                self.last.clear()
        elif end <= now:
            self.last.clear()

    def close(self) -> None:
        pass


def job_states(jobs: DataFrame) -> DataFrame:
    """The latest status and stage of each job; update mode emits a job when it gets news."""
    return jobs.groupBy("job_id").agg(F.max_by(F.struct("status", "stage"), F.struct("updated_at", "event_id")).alias("_s")).select("job_id", "_s.status", "_s.stage")


def job_changes(jobs: DataFrame) -> DataFrame:
    """As :func:`job_states`, but only real changes, with timers for stuck and forgotten jobs; one state round trip per job and batch.

    Rows without a time have no place in a job's course and are left out.
    """
    d = jobs.select("job_id", "event_id", "status", "stage", F.col("updated_at").cast("timestamp").alias("updated_at"))
    d = d.where("updated_at IS NOT NULL").withWatermark("updated_at", WATERMARK)
    return d.groupBy("job_id").transformWithStateInPandas(JobState(), "job_id string, status string, stage string", "Append", "EventTime")
