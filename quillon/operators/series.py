"""Hourly series and operators on them. Windows are partitioned by series, so a table of many series spreads over tasks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hour_number(ts: str) -> Column:
    """Whole hours since 1970, whatever the session's time zone."""
    return F.expr(f"timestampdiff(HOUR, TIMESTAMP_NTZ '1970-01-01 00:00:00', {ts})").cast("long")


def hourly(events: DataFrame, series: str = "event_type", ts: str = "ts", value: str = "value") -> DataFrame:
    """series, hour, y (sum), n (rows) on each series' full hourly spine; hours without rows are 0."""
    raw = events.groupBy(F.col(series).alias("series"), hour_number(ts).alias("hour")).agg(F.round(F.sum(value), 2).alias("y"), F.count(F.lit(1)).alias("n"))
    return on_spine(raw)


def on_spine(raw: DataFrame) -> DataFrame:
    ends = raw.groupBy("series").agg(F.min("hour").alias("lo"), F.max("hour").alias("hi"))
    spine = ends.select("series", F.explode(F.sequence("lo", "hi")).alias("hour"))
    return spine.join(raw, ["series", "hour"], "left").select("series", "hour", F.coalesce("y", F.lit(0.0)).alias("y"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def _by_hour():
    return Window.partitionBy("series").orderBy("hour")


def with_lags(h: DataFrame, lags=(1, 24, 168)) -> DataFrame:
    return h.withColumns({f"lag_{k}": F.lag("y", k).over(_by_hour()) for k in lags})


def with_rolling(h: DataFrame, widths=(24,), past_only: bool = True) -> DataFrame:
    """Mean and deviation of the last hours: before this one (population deviation), or up to it (sample deviation); null until the window is full."""
    out = {}
    for w in widths:
        frame = _by_hour().rowsBetween(-w, -1) if past_only else _by_hour().rowsBetween(-w + 1, 0)
        full = F.count("y").over(frame) == w
        out[f"mean_{w}"] = F.when(full, F.avg("y").over(frame))
        out[f"std_{w}"] = F.when(full, (F.stddev_pop("y") if past_only else F.stddev_samp("y")).over(frame))
    return h.withColumns(out)


def with_calendar(h: DataFrame) -> DataFrame:
    """Cyclic hour and weekday (Monday 0) and a trend index."""
    hour, day = F.pmod("hour", F.lit(24)), F.pmod(F.floor(F.col("hour") / 24) + 3, F.lit(7))
    turn = 2 * math.pi
    return h.withColumns(
        {
            "hour_sin": F.sin(turn * hour / 24), "hour_cos": F.cos(turn * hour / 24),
            "day_sin": F.sin(turn * day / 7), "day_cos": F.cos(turn * day / 7),
            "trend": (F.row_number().over(_by_hour()) - 1).cast("double"),
        }
    )


def autocorrelation(h: DataFrame, lags=(1, 24, 168)) -> DataFrame:
    """Pearson correlation of each series with itself, lags apart."""
    lagged = with_lags(h, lags)
    return lagged.groupBy("series").agg(*[F.corr("y", f"lag_{k}").alias(f"acf_{k}") for k in lags])


def split_last(h: DataFrame, horizon: int) -> DataFrame:
    """Adds is_test: whether the row is among its series' last hours, and place from 0."""
    ends = h.groupBy("series").agg(F.min("hour").alias("first_hour"), F.max("hour").alias("last_hour"))
    return h.join(ends, "series").withColumns({"place": F.col("hour") - F.col("first_hour"), "is_test": F.col("hour") > F.col("last_hour") - horizon})


def folds(h: DataFrame, initial: int, horizon: int) -> DataFrame:
    """Expanding windows: fold, train_end of each series. A row is trained on if place < train_end, and tested if it is in the next horizon."""
    n = h.groupBy("series").agg((F.max("hour") - F.min("hour") + 1).alias("n"), F.min("hour").alias("first_hour"))
    ends = F.expr(f"filter(sequence(0, greatest(0, cast((n - {initial}) / {horizon} as int))), k -> {initial} + (k + 1) * {horizon} <= n)")
    return n.select("series", "first_hour", F.explode(ends).alias("fold")).withColumn("fold", F.col("fold").cast("long")).withColumn("train_end", (F.lit(initial) + F.col("fold") * horizon).cast("long"))


def baseline_residuals(h: DataFrame, initial: int, horizon: int, season: int = 24) -> DataFrame:
    """Residuals of mean, naive and seasonal-naive forecasts in each fold; joins are on place, not on all pairs of rows.

    Each test row reads what its forecasts need by an equi-join: the running sums up to the fold's end, the last value, and the value one season before, wrapped into the last trained season.
    """
    w = _by_hour()
    rows = h.withColumns({"place": F.row_number().over(w) - 1, "seen": F.sum("y").over(w.rowsBetween(Window.unboundedPreceding, 0))}).select("series", "place", "y", "seen")
    f = folds(h, initial, horizon).select("series", "fold", "train_end")
    test = f.select("series", "fold", "train_end", F.explode(F.expr(f"sequence(train_end, train_end + {horizon - 1})")).alias("place")).join(rows.select("series", "place", "y"), ["series", "place"])
    last = rows.select("series", (F.col("place") + 1).alias("train_end"), F.col("y").alias("naive"), (F.col("seen") / (F.col("place") + 1)).alias("mean"))
    back = (F.col("train_end") - season + F.pmod(F.col("place") - F.col("train_end"), F.lit(season))).alias("from_place")
    season_rows = rows.select("series", F.col("place").alias("from_place"), F.col("y").alias("seasonal"))
    wide = test.join(last, ["series", "train_end"]).select("*", back).join(season_rows, ["series", "from_place"])
    return wide.select(
        "series", "fold", "place", F.col("y").alias("actual"),
        F.expr("stack(3, 'mean', mean, 'naive', naive, 'seasonal_naive', seasonal) as (model, forecast)"),
    ).withColumn("residual", F.col("actual") - F.col("forecast"))


def seasonal_scale(h: DataFrame, season: int = 24) -> DataFrame:
    """Mean absolute seasonal difference of each series."""
    return h.withColumn("before", F.lag("y", season).over(_by_hour())).groupBy("series").agg(F.avg(F.abs(F.col("y") - F.col("before"))).alias("scale"))


def forecast_errors(residuals: DataFrame, keys: list[str]) -> DataFrame:
    a, f, e = F.col("actual"), F.col("forecast"), F.col("residual")
    den = F.abs(a) + F.abs(f)
    return residuals.groupBy(*keys).agg(
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        (200 * F.avg(F.when(den == 0, 0.0).otherwise(F.abs(a - f) / F.when(den == 0, 1.0).otherwise(den)))).alias("smape"), F.count(F.lit(1)).alias("n"),
    )
