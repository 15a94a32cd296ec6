"""Roll-ups of per-meeting metrics, and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def finite(x):
    """Neither null, NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(F.coalesce(x, F.lit(0.0))) & (F.abs(x) < float("inf"))


def macro_average(metrics: DataFrame) -> DataFrame:
    """metric, value (mean over meetings that have one), meetings."""
    return metrics.groupBy("metric").agg(F.avg("value").alias("value"), F.count("value").alias("meetings"))


def gates(checks: DataFrame, metrics: DataFrame) -> DataFrame:
    """suite, metric, value, passed, reason.

    checks: suite, metric, max, min and, if there, eq and tol; metrics: metric, value and, if there,
    not_scored (a number of meetings). A metric that is missing, not finite or not scored on
    some meeting fails.
    """
    metrics = metrics if "not_scored" in metrics.columns else metrics.withColumn("not_scored", F.lit(0))
    return judged(checks.join(metrics.select("metric", "value", "not_scored", F.lit(True).alias("there")), "metric", "left"))


def judged(met: DataFrame) -> DataFrame:
    """The same of checks that met their metrics: ``there`` is null where there is none; other columns come along."""
    met = met.withColumns({c: F.lit(None).cast("double") for c in ("eq", "tol") if c not in met.columns}).withColumn("value", F.col("value").cast("double"))
    value, tol = F.col("value"), F.coalesce("tol", F.lit(0.0))
    over, under = value > F.col("max") + tol, value < F.col("min") - tol
    off = F.abs(value - F.col("eq")) > tol
    reason = (
        F.when(F.col("there").isNull(), "metric not in report")
        .when(F.coalesce("not_scored", F.lit(0)) > 0, F.concat(F.lit("not scored on "), F.col("not_scored").cast("string"), F.lit(" meetings")))
        .when(~finite(value), "metric has no numeric value")
        .otherwise(F.concat_ws("; ", F.when(over, "exceeds max"), F.when(under, "below min"), F.when(off, "differs")))
    )
    others = [c for c in met.columns if c not in ("suite", "metric", "value", "max", "min", "eq", "tol", "not_scored", "there")]
    told = met.withColumn("reason", reason)
    return told.select(*others, "suite", "metric", "value", (F.col("reason") == "").alias("passed"), F.when(F.col("reason") == "", "ok").otherwise(F.col("reason")).alias("reason"))


def suites(checked: DataFrame) -> DataFrame:
    """suite, passed (all checks do), failed (sorted names, comma-joined)."""
    failed = F.array_join(F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("metric")))), ",")
    return checked.groupBy("suite").agg(F.bool_and("passed").alias("passed"), failed.alias("failed"))
