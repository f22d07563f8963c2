"""Provider metrics, health and fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lifecycle import count_if, ratio

#: Fixed values of the health fold.
SMOOTHING, LOW, HIGH, START = 0.22, 0.05, 1.5, 1.0
TARGETS = {"success": 1.2, "transient": 0.35, "permanent": 0.15}
BUCKETS = ((250, "le_250_ms"), (500, "le_500_ms"), (1000, "le_1000_ms"), (2000, "le_2000_ms"))


def provider_snapshot(attempts: DataFrame) -> DataFrame:
    """Totals per provider from attempts (request_id, position, provider, result, latency_ms).

    A failover is a success at a later position, after the ones before failed; latencies are those of successes.
    """
    ok = F.col("result") == "success"
    ms, cols, below = F.when(ok, F.col("latency_ms")), [], F.lit(False)
    for limit, name in BUCKETS:
        cols.append(count_if(ok & ~below & (F.col("latency_ms") <= limit)).alias(name))
        below = F.col("latency_ms") <= limit
    return attempts.groupBy("provider").agg(
        count_if(ok).alias("success_total"), count_if(~ok).alias("failure_total"), count_if(F.col("result") == "transient").alias("retry_total"),
        count_if(ok & (F.col("position") > 0)).alias("failover_total"), F.coalesce(F.avg(ms), F.lit(0.0)).alias("avg_latency_ms"),
        *cols, count_if(ok & ~below).alias("gt_2000_ms"),
    )


def provider_rates(snapshot: DataFrame) -> DataFrame:
    total = F.col("success_total") + F.col("failure_total")
    return snapshot.select("provider", *(ratio(F.col(f"{n}_total"), total).alias(f"{n}_rate") for n in ("success", "retry", "failover")), "avg_latency_ms")


def count_by(rows: DataFrame, column: str) -> DataFrame:
    """Counts with '' and null as unknown."""
    return rows.groupBy(F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit("unknown")).alias(column)).agg(F.count(F.lit(1)).alias("total"))


def safe_percent(a: Column, b: Column) -> Column:
    return F.when((b > 0) & (a / b < float("inf")), a / b * 100).otherwise(0.0)


def checkpoint_health(counters: DataFrame) -> DataFrame:
    """hits, misses, persists, persist_failures -> rates, levels and the overall level (hit-critical, persist-critical, hit-warn, persist-warn)."""
    hit, bad = safe_percent(F.col("hits"), F.col("hits") + F.col("misses")), safe_percent(F.col("persist_failures"), F.col("persists") + F.col("persist_failures"))
    d = counters.withColumn("hit_rate", hit).withColumn("persist_failure_rate", bad)
    h = F.when(F.col("hit_rate") < 40, "critical").when(F.col("hit_rate") < 70, "warn").otherwise("normal")
    p = F.when(F.col("persist_failure_rate") >= 15, "critical").when(F.col("persist_failure_rate") >= 5, "warn").otherwise("normal")
    d = d.withColumn("hit_level", h).withColumn("persist_level", p)
    cause = F.when(F.col("hit_level") == "critical", "hit_critical").when(F.col("persist_level") == "critical", "persist_critical").when(F.col("hit_level") == "warn", "hit_warn").when(F.col("persist_level") == "warn", "persist_warn").otherwise("normal")
    return d.withColumn("cause", cause).withColumn("level", F.regexp_replace("cause", "^(hit|persist)_", ""))


def degraded_counts(events: DataFrame) -> DataFrame:
    """Column kind: degraded, render_fallback, ocr_low_confidence, adaptive_*. The last don't add to the total."""
    k = F.col("kind")
    names = ("render_fallback", "ocr_low_confidence", "adaptive_reduce", "adaptive_boost", "adaptive_clamp")
    return events.agg(count_if(k.isin("degraded", "render_fallback", "ocr_low_confidence")).alias("total_events"), *(count_if(k == n).alias(f"{n}_events") for n in names))


def integration_counters(events: DataFrame) -> DataFrame:
    """One row of retry, circuit and reject counters over reliability events; reject kinds also add to the reject total."""
    n, r = F.col("event_name"), F.col("reason")
    cols = [
        count_if(n == "litellm_retry").alias("litellm_retry_attempts_total"), count_if(n == "litellm_circuit_reject").alias("litellm_circuit_reject_total"),
        count_if(n.isin("litellm_circuit_open", "litellm_circuit_opened")).alias("litellm_circuit_opened_total"), count_if(n == "ocr_retry").alias("ocr_retry_attempts_total"),
        count_if(n == "ocr_provider_fallback").alias("ocr_provider_fallback_total"),
    ]
    for who in ("litellm", "ocr"):
        rejected = n == f"{who}_response_rejected"
        cols += [count_if(rejected).alias(f"{who}_response_rejected_total"), count_if(rejected & (r == "invalid_json")).alias(f"{who}_response_rejected_json_total"), count_if(rejected & (r == "invalid_schema")).alias(f"{who}_response_rejected_shape_total"), count_if(rejected & (r == "body_too_large")).alias(f"{who}_response_rejected_body_total")]
    return events.agg(*cols)


def positive_aggregates(rows: DataFrame) -> DataFrame:
    """Means that ignore non-positive confidence and latency, and zero confidence changes."""
    conf, ms, delta = (F.when(c, v) for c, v in ((F.col("confidence") > 0, F.col("confidence")), (F.col("latency_ms") > 0, F.col("latency_ms")), (F.col("confidence_delta") != 0, F.col("confidence_delta"))))
    return rows.agg(*(x for v, n in ((conf, "confidence"), (ms, "latency_ms"), (delta, "confidence_delta")) for x in (F.count(v).alias(f"{n}_count"), F.coalesce(F.avg(v), F.lit(0.0)).alias(f"{n}_avg"))))


def provider_health(attempts: DataFrame, carried: DataFrame | None = None) -> DataFrame:
    """Health per provider and day, folded in order of time and carried from day to day.

    Within (LOW, HIGH) every target pulls the score inside, so the clamp only matters at the seed, and any run of attempts
    is a map s -> a * s + b. An hour's b is a sum of its targets, each weighed by the attempts after it; hours are
    combined to days and days are carried, so that no row holds more than 24 hours or a provider's days. Results that are
    not known count as failures. ``carried`` (provider, score): seeds from an earlier run.
    """
    target = F.lit(min(TARGETS.values()))
    for name, value in TARGETS.items():
        target = F.when(F.col("result") == name, value).otherwise(target)
    keep = 1 - SMOOTHING
    hour = attempts.select("provider", F.date_trunc("hour", "attempt_time").alias("hour"), "attempt_time", "event_id", target.alias("target"))
    whole = Window.partitionBy("provider", "hour")
    after = F.count(F.lit(1)).over(whole) - F.row_number().over(whole.orderBy("attempt_time", "event_id"))
    hour = hour.withColumn("term", F.lit(SMOOTHING) * F.col("target") * F.pow(F.lit(keep), after.cast("double")))
    hours = hour.groupBy("provider", "hour").agg(F.count(F.lit(1)).cast("int").alias("n"), F.sum("term").alias("b"))
    runs = hours.groupBy("provider", F.to_date("hour").alias("day")).agg(F.array_sort(F.collect_list(F.struct("hour", "n", "b"))).alias("hs"), F.sum("n").cast("int").alias("attempts"))
    own = F.aggregate("hs", F.lit(0.0), lambda acc, x: acc * F.pow(F.lit(keep), x["n"].cast("double")) + x["b"])
    runs = runs.select("provider", "day", "attempts", F.pow(F.lit(keep), F.col("attempts").cast("double")).alias("a"), own.alias("b"))
    seeds = carried.select("provider", F.col("score").alias("seed")) if carried is not None else runs.select("provider").distinct().withColumn("seed", F.lit(START))
    chain = runs.groupBy("provider").agg(F.array_sort(F.collect_list(F.struct("day", "attempts", "a", "b"))).alias("days"))
    chain = chain.join(seeds, "provider", "left").withColumn("seed", F.least(F.lit(HIGH), F.greatest(F.lit(LOW), F.coalesce("seed", F.lit(START)))))
    zero = F.struct(F.col("seed").alias("score"), F.expr("CAST(array() AS array<struct<day:date,attempts:int,score:double>>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        score = acc["score"] * x["a"] + x["b"]
        return F.struct(score.alias("score"), F.concat(acc["out"], F.array(F.struct(x["day"].alias("day"), x["attempts"].alias("attempts"), score.alias("score")))).alias("out"))

    done = chain.select("provider", F.aggregate("days", zero, step)["out"].alias("out"))
    return done.select("provider", F.inline("out"))


def rank_providers(scores: DataFrame, base: list[str]) -> DataFrame:
    """By score, then by place in ``base``."""
    place = F.array_position(F.array(*(F.lit(x) for x in base)), F.col("provider"))
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), place)))  # one row per provider


def fallback_chain_outcome(attempts: DataFrame, budget: int = 2) -> DataFrame:
    """Per request: provider used, fallbacks, and whether the budget of fallbacks ran out before a success.

    The reference stops at a failure when the budget is used up and more providers are left.
    """
    per = attempts.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("position", "provider", "result"))).alias("tries"))
    first = F.array_position(F.transform("tries", lambda x: x["result"]), "success").cast("int")
    per = per.select("request_id", F.size("tries").alias("n"), first.alias("first"), "tries")
    reached = (F.col("first") > 0) & ((F.col("first") - 1 <= budget) | F.lit(budget < 0))
    exhausted = ~reached & F.lit(budget >= 0) & (F.col("n") - 1 > budget)
    fallbacks = F.when(reached, F.col("first") - 1).otherwise(F.least(F.col("n") - 1, F.lit(budget if budget >= 0 else 1 << 30)))
    used = F.when(reached, F.try_element_at("tries", F.greatest(F.col("first"), F.lit(1)))["provider"])
    return per.select("request_id", used.alias("provider_used"), fallbacks.alias("fallbacks"), exhausted.alias("budget_exhausted"))


def provider_trend(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(provider, score) of two snapshots -> change and severity; n/a if either is missing."""
    j = current.withColumnRenamed("score", "current").join(previous.withColumnRenamed("score", "previous"), "provider", "full_outer")
    d = F.col("current") - F.col("previous")
    level = F.when(d.isNull(), "n/a").when(d <= -0.10, "critical").when(d <= -0.05, "warning").when(d >= 0.05, "improving").otherwise("stable")
    return j.withColumn("delta", d).withColumn("severity", level)
