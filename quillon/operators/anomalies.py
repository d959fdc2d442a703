"""Robust residual anomalies, and episodes of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.series import with_lags

THRESHOLD, HIGH, CRITICAL = 3.5, 5.0, 7.5
SCALE = 0.67449


def seasonal_residuals(h: DataFrame, season: int = 24) -> DataFrame:
    """actual, forecast (the value one season before) and residual where there is one; closure: an hour without rows."""
    lagged = with_lags(h, (season,)).where(F.col(f"lag_{season}").isNotNull())
    return lagged.select("series", "hour", F.col("y").alias("actual"), F.col(f"lag_{season}").alias("forecast"), (F.col("y") - F.col(f"lag_{season}")).alias("residual"), (F.col("n") == 0).alias("closure"))


def robust_scale(residuals: DataFrame) -> DataFrame:
    """Median and median absolute deviation of each series' residuals outside closures; exact, by sorted aggregation in each series."""
    open_rows = residuals.where(~F.col("closure"))
    center = open_rows.groupBy("series").agg(F.median("residual").alias("center"))
    spread = open_rows.join(center, "series").groupBy("series").agg(F.first("center").alias("center"), F.median(F.abs(F.col("residual") - F.col("center"))).alias("mad"))
    return spread.where("mad > 0")


def label(residuals: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    z = F.lit(SCALE) * (F.col("residual") - F.col("center")) / F.col("mad")
    size = F.abs("z")
    return (
        residuals.join(robust_scale(residuals), "series")
        .withColumn("z", z)
        .withColumn("is_statistical", size >= threshold)
        .withColumn("actionable", F.col("is_statistical") & ~F.col("closure"))
        .withColumn("kind", F.when(F.col("closure") & F.col("is_statistical"), "closure").when(~F.col("is_statistical"), "normal").when(F.col("z") > 0, "positive").otherwise("negative"))
        .withColumn("severity", F.when(~F.col("actionable"), "none").when(size >= CRITICAL, "critical").when(size >= HIGH, "high").otherwise("moderate"))
        .drop("center", "mad")
    )


def episodes(labelled: DataFrame, max_gap: int = 1) -> DataFrame:
    """Runs of actionable hours no more than max_gap apart, each as one row."""
    w = Window.partitionBy("series").orderBy("hour")
    gap = F.col("hour") - F.lag("hour").over(w)
    marked = labelled.where("actionable").withColumn("fresh", (gap.isNull() | (gap > max_gap)).cast("int")).withColumn("episode", F.sum("fresh").over(w))
    peak = F.max_by(F.struct("hour", "z", "severity"), F.struct(F.abs("z"), -F.col("hour")))
    ups, downs = F.count_if(F.col("z") > 0), F.count_if(F.col("z") < 0)
    return (
        marked.groupBy("series", "episode")
        .agg(
            F.min("hour").alias("start_hour"), F.max("hour").alias("end_hour"), F.count(F.lit(1)).alias("n_hours"),
            F.when((ups > 0) & (downs > 0), "mixed").when(ups > 0, "positive").otherwise("negative").alias("direction"),
            peak.alias("peak"), F.round(F.sum("actual"), 2).alias("actual_sum"), F.round(F.sum("forecast"), 2).alias("forecast_sum"),
            F.round(F.sum("residual"), 2).alias("residual_sum"), F.round(F.try_divide(F.sum("residual"), F.sum("actual")), 6).alias("residual_ratio"),
            F.array_join(F.sort_array(F.collect_set("severity")), ", ").alias("severities"),
        )
        .select(
            "series", "episode", "start_hour", "end_hour", (F.col("end_hour") - F.col("start_hour") + 1).alias("duration"), "n_hours", "direction",
            F.col("peak.hour").alias("peak_hour"), F.round("peak.z", 6).alias("peak_z"), "actual_sum", "forecast_sum", "residual_sum", "residual_ratio", "severities",
        )
    )


def top(labelled: DataFrame, k: int) -> DataFrame:
    """The k actionable hours furthest from normal, ranked; ties to the earlier hour and then the series' name."""
    order = [F.abs("z").desc(), F.col("hour"), F.col("series")]
    few = labelled.where("actionable").orderBy(*order).limit(k)
    return few.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # k rows
