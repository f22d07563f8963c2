"""Range and instant vectors over a grid of steps, and alert rules over them.

Samples are (ts, metric, value) and the columns that make a series. A step at time T sees the samples of (T - window, T]. Samples are first
reduced to one row for each series and step, then every such row goes to the steps that see it, and these are summed or the
latest is taken. So there is no window over a series: all work is partitioned by series and step, and sums are combined before they
are sent. Samples without time or value have no place on the grid; null metrics and labels are values like others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEP_S = 30
#: How far an instant vector looks back.
LOOKBACK_S = 300
#: Steps that are made in one row.
STRETCH = 1000


@dataclass(frozen=True)
class Operand:
    """``metric`` (or its increase over ``window_s`` seconds) compared with a threshold; ``total_by`` sums over all series of a label."""

    metric: str
    op: str
    threshold: float
    window_s: int | None = None
    total_by: bool = False


@dataclass(frozen=True)
class Rule:
    """All operands must hold, for the same labels, at every step of ``hold_s`` seconds."""

    name: str
    operands: tuple[Operand, ...]
    hold_s: int
    severity: str


#: The alert rules.
RULES = (
    Rule("QueueDepthHigh", (Operand("queue_depth", ">=", 500),), 600, "warning"),
    Rule("QueueDepthCritical", (Operand("queue_depth", ">=", 1000),), 300, "critical"),
    Rule("StuckJobsDetected", (Operand("queue_stuck_jobs", ">=", 1),), 600, "warning"),
    Rule("DeadLetterGrowth", (Operand("queue_dead_letter_volume", ">=", 10),), 300, "critical"),
    Rule("ChunkSuccessDrop", (Operand("pipeline_chunk_success_ratio", "<", 0.95),), 600, "warning"),
    Rule("ExportSuccessDrop", (Operand("pipeline_export_success_ratio", "<", 0.98),), 600, "warning"),
    Rule("ProviderTimeoutSpike", (Operand("provider_timeout_total", ">", 20, 300, total_by=True),), 300, "warning"),
    Rule("RetryBacklogHigh", (Operand("queue_retry_backlog", ">=", 50),), 600, "warning"),
    Rule("RetryBacklogCritical", (Operand("queue_retry_backlog", ">=", 200),), 300, "critical"),
    Rule("DegradedModeSpike", (Operand("degraded_mode_total", ">", 20, 600),), 300, "warning"),
    Rule("RenderFallbackSpike", (Operand("degraded_render_fallback_total", ">", 5, 600),), 300, "warning"),
    Rule("AdaptiveClampFrequent", (Operand("adaptive_concurrency_clamp_total", ">", 10, 600),), 300, "warning"),
    Rule("TimeoutStormDetected", (Operand("pipeline_timeouts_total", ">", 8, 600), Operand("pipeline_retries_total", ">", 80, 600)), 300, "critical"),
    Rule(
        "OCRFallbackBudgetExhausted",
        (Operand("ocr_provider_fallback_budget_exhausted_total", ">", 0, 600), Operand("ocr_provider_fallback_budget_exhausted_total", "<", 3, 600)),
        300, "warning",
    ),
    Rule("OCRFallbackBudgetExhaustedCritical", (Operand("ocr_provider_fallback_budget_exhausted_total", ">=", 3, 600),), 300, "critical"),
    Rule("CircuitBreakerOpen", (Operand("litellm_circuit_opened_total", ">", 0, 600),), 120, "warning"),
    Rule("CircuitRejectSpike", (Operand("litellm_circuit_reject_total", ">", 30, 300),), 300, "critical"),
    Rule("BackendDown", (Operand("up", "==", 0),), 120, "critical"),
)


def _same(d: DataFrame, names: dict[str, str]) -> Column:
    out = F.lit(True)
    for a, b in names.items():
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out


def with_deltas(samples: DataFrame, series: tuple[str, ...] = ("metric", "label"), tie: str = "event_id", slice_s: int = 3600) -> DataFrame:
    """Adds ``delta``, the growth since the sample before in the series: 0 for the first one, and the whole value after a reset.

    A series is cut into slices of time; the value before a slice is the last one of the slices before it, one row for each slice.
    """
    d = samples.where("ts IS NOT NULL AND value IS NOT NULL").withColumn("_at", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (slice_s * 1_000_000)))
    last = d.groupBy(*series, "_at").agg(F.max_by("value", F.struct("ts", tie)).alias("_last"))
    carried = F.lag("_last").over(Window.partitionBy(*series).orderBy("_at")).alias("_carried")
    last = last.select(*(F.col(c).alias(f"_{c}") for c in series), F.col("_at").alias("_slice"), carried)
    d = d.join(last, _same(d, {c: f"_{c}" for c in series}) & (F.col("_at") == F.col("_slice")))
    before = F.coalesce(F.lag("value").over(Window.partitionBy(*series, "_at").orderBy("ts", tie)), F.col("_carried"))
    delta = F.when(before.isNull(), 0.0).when(F.col("value") < before, F.col("value")).otherwise(F.col("value") - before)
    return d.withColumn("delta", delta).select(*samples.columns, "delta")


def step_of(step_s: int = STEP_S) -> Column:
    """The number of the first step that sees a sample."""
    return F.ceil(F.unix_micros(F.col("ts").cast("timestamp")) / (step_s * 1_000_000))


def step_time(step: str, step_s: int = STEP_S) -> Column:
    return F.timestamp_seconds(F.col(step) * step_s)


def _by_step(samples: DataFrame, series: tuple[str, ...], tie: str, step_s: int) -> DataFrame:
    """One row for each series and step: growth, last value, and the table's last step."""
    d = with_deltas(samples, series, tie).withColumn("step", step_of(step_s))
    d = d.groupBy(*series, "step").agg(F.sum("delta").alias("growth"), F.max_by("value", F.struct("ts", tie)).alias("last"))
    return d.crossJoin(F.broadcast(samples.where("ts IS NOT NULL AND value IS NOT NULL").agg(F.max(step_of(step_s)).alias("end"))))


def _seen_by(steps: Column | int) -> Column:
    return F.explode(F.sequence(F.col("step"), F.least(F.col("step") + steps - 1, F.col("end"))))


def increases(samples: DataFrame, window_s: int, series: tuple[str, ...] = ("metric", "label"), tie: str = "event_id", step_s: int = STEP_S) -> DataFrame:
    """(series, step, increase, rate) at every step that sees a sample; windows are whole numbers of steps."""
    if window_s % step_s:
        raise ValueError("the window is not a whole number of steps")
    d = _by_step(samples, series, tie, step_s).select(*series, "growth", _seen_by(F.lit(window_s // step_s)).alias("step"))
    d = d.groupBy(*series, "step").agg(F.sum("growth").alias("increase"))
    return d.withColumn("rate", F.col("increase") / window_s)


def total_by(grid: DataFrame, keys: tuple[str, ...], value: str = "rate") -> DataFrame:
    """``sum by (keys)`` at every step."""
    return grid.groupBy(*keys, "step").agg(F.sum(value).alias(value))


def share(grid: DataFrame, of: str, among: tuple[str, ...], keys: tuple[str, ...] = ("label",), floor: float = 1.0, value: str = "increase") -> DataFrame:
    """Part of metric ``of`` in the sum of metrics ``among``, which counts as ``floor`` at least; only at steps that have all of them."""
    d = grid.where(F.col("metric").isin(*among)).groupBy(*keys, "step").agg(
        F.sum(F.when(F.col("metric") == of, F.col(value))).alias("part"), F.sum(value).alias("whole"), F.count_distinct("metric").alias("n")
    )
    return d.where(F.col("n") == len(among)).select(*keys, "step", (F.col("part") / F.greatest("whole", F.lit(floor))).alias("share"))


def up(samples: DataFrame, step_s: int = STEP_S) -> DataFrame:
    """(step, end, last): at every step from the first sample to the last one, 1 if a sample came since the step before, else 0."""
    seen = samples.where("ts IS NOT NULL AND value IS NOT NULL").select(step_of(step_s).alias("step")).distinct()
    every = seen.agg(F.min("step").alias("begin"), F.max("step").alias("end")).where("begin IS NOT NULL")
    # stretches of steps are dealt over all tasks before they are filled: one row would be one task
    every = every.select("begin", "end", F.explode(F.sequence(F.floor(F.col("begin") / STRETCH), F.floor(F.col("end") / STRETCH))).alias("_of"))
    every = every.repartition(int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_of")
    first = F.col("_of") * STRETCH
    every = every.select("end", F.explode(F.sequence(F.greatest("begin", first), F.least("end", first + (STRETCH - 1)))).alias("step"))
    return every.join(seen.withColumn("_seen", F.lit(1.0)), "step", "left").select("step", "end", F.coalesce("_seen", F.lit(0.0)).alias("last"))


def firing(samples: DataFrame, rules: tuple[Rule, ...] = RULES, label: str = "label", instance: str = "instance", tie: str = "event_id", step_s: int = STEP_S) -> DataFrame:
    """(rule, severity, label, instance, step) at which a rule fires: it holds there and held at each step of ``hold_s`` seconds before.

    Every rule is evaluated; one whose metrics have no samples holds nowhere, and ``up`` is made from the gaps between all samples.
    A summed operand has no instance.
    """
    spark, series = samples.sparkSession, ("metric", label, instance)
    rows = [(number, r.name, r.severity, len(r.operands), r.hold_s // step_s, i, o.metric, o.op, float(o.threshold), o.window_s is not None, (o.window_s or LOOKBACK_S) // step_s, o.total_by) for number, r in enumerate(rules) for i, o in enumerate(r.operands)]
    rows = [(n, *r) for n, r in enumerate(rows)]
    operands = F.broadcast(spark.createDataFrame(rows, "place int, number int, rule string, severity string, needed int, hold int, operand int, metric string, op string, threshold double, grows boolean, steps int, summed boolean"))
    found = _by_step(samples.where(F.col("metric") != "up"), series, tie, step_s).select(*series, "step", "end", "growth", "last")
    alive = up(samples, step_s).select(F.lit("up").alias("metric"), F.lit(None).cast(dict(samples.dtypes)[label]).alias(label), F.lit(None).cast(dict(samples.dtypes)[instance]).alias(instance), "step", "end", F.lit(0.0).alias("growth"), "last")
    d = found.unionByName(alive).join(operands.select("place", "metric", "steps"), "metric").withColumn("_from", F.col("step")).withColumn("step", _seen_by(F.col("steps")))
    # an operand is grouped by its place and named afterwards: narrow rows in the largest step
    keys = ["place", label, instance, "step", "end"]
    d = d.groupBy(*keys).agg(F.sum("growth").alias("growth"), F.max_by("last", "_from").alias("last"))
    d = d.join(operands.drop("metric", "steps"), "place")
    d = d.withColumn("value", F.when(F.col("grows"), F.col("growth")).otherwise(F.col("last"))).withColumn(instance, F.when(~F.col("summed"), F.col(instance)))
    d = d.groupBy(*keys).agg(F.sum("value").alias("value")).join(operands.drop("metric", "steps"), "place")
    value, limit = F.col("value"), F.col("threshold")
    holds = F.when(F.col("op") == ">", value > limit).when(F.col("op") == ">=", value >= limit).when(F.col("op") == "<", value < limit).when(F.col("op") == "==", value == limit)
    alert = ["number", label, instance, "step"]
    d = d.where(holds).groupBy(*alert, "needed", "hold", "end").agg(F.count(F.lit(1)).alias("n")).where("n = needed")
    later = d.withColumn("_from", F.col("step")).withColumn("step", _seen_by(F.col("hold") + 1))
    d = later.groupBy(*alert).agg(F.count(F.lit(1)).alias("n"), F.max("_from").alias("_from"))
    d = d.where("_from = step").join(operands.where("operand = 0").select("number", "rule", "severity", "hold"), "number")
    return d.where("n = hold + 1").select("rule", "severity", label, instance, "step")
