"""Hourly series of the events table: features, baselines, folds, anomalies and episodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.io import table
from quillon.operators import anomalies, series
from quillon.plans.registry import query, r6, rounded

HOURLY = """
raw AS (SELECT event_type AS series, epoch_us(ts) // 3600000000 AS hour, round(sum(value), 2) AS y, count(*) AS n FROM events GROUP BY ALL),
ends AS (SELECT series, min(hour) AS lo, max(hour) AS hi FROM raw GROUP BY series),
spine AS (SELECT series, unnest(range(lo, hi + 1)) AS hour FROM ends),
h AS (SELECT spine.series, spine.hour, coalesce(raw.y, 0.0) AS y, CAST(coalesce(raw.n, 0) AS BIGINT) AS n FROM spine LEFT JOIN raw ON raw.series = spine.series AND raw.hour = spine.hour)
"""
INITIAL, HORIZON = 336, 24


def hours(spark, sf_dir) -> DataFrame:
    return series.hourly(table(spark, sf_dir, "events"))


@query(f"""WITH {HOURLY} SELECT series, hour, y, n FROM h""")
def ts_hourly(spark, sf_dir):
    """Hourly sums on a full spine (date spine, re-indexing with fill)."""
    return hours(spark, sf_dir)


@query(f"""WITH {HOURLY},
w AS (SELECT *, lag(y, 1) OVER s AS lag_1, lag(y, 24) OVER s AS lag_24, lag(y, 168) OVER s AS lag_168,
  CASE WHEN count(y) OVER p = 24 THEN avg(y) OVER p END AS mean_24, CASE WHEN count(y) OVER p = 24 THEN stddev_pop(y) OVER p END AS std_24,
  CAST(row_number() OVER s - 1 AS DOUBLE) AS trend
  FROM h WINDOW s AS (PARTITION BY series ORDER BY hour), p AS (PARTITION BY series ORDER BY hour ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING))
SELECT series, hour, y, n, lag_1, lag_24, lag_168, round(mean_24, 6) AS mean_24, round(std_24, 6) AS std_24,
  round(sin(2 * pi() * (hour % 24) / 24), 6) AS hour_sin, round(cos(2 * pi() * (hour % 24) / 24), 6) AS hour_cos,
  round(sin(2 * pi() * ((hour // 24 + 3) % 7) / 7), 6) AS day_sin, round(cos(2 * pi() * ((hour // 24 + 3) % 7) / 7), 6) AS day_cos, trend
FROM w WHERE lag_168 IS NOT NULL AND mean_24 IS NOT NULL""")
def ts_lag_features(spark, sf_dir):
    """Lags, leakage-safe rolling statistics, cyclic calendar and trend of complete rows."""
    f = series.with_calendar(series.with_rolling(series.with_lags(hours(spark, sf_dir))))
    return rounded(f.where("lag_168 is not null and mean_24 is not null"))


@query(f"""WITH {HOURLY},
w AS (SELECT series, hour, y, CASE WHEN count(y) OVER p = 24 THEN avg(y) OVER p END AS mean_24, CASE WHEN count(y) OVER p = 24 THEN stddev_samp(y) OVER p END AS std_24
  FROM h WINDOW p AS (PARTITION BY series ORDER BY hour ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))
SELECT series, hour, y, round(mean_24, 6) AS mean_24, round(std_24, 6) AS std_24 FROM w""")
def rolling_eda(spark, sf_dir):
    """Trailing rolling mean and sample deviation, the current hour included."""
    return rounded(series.with_rolling(hours(spark, sf_dir), past_only=False).drop("n"))


@query(f"""WITH {HOURLY},
w AS (SELECT series, y, lag(y, 1) OVER s AS a, lag(y, 24) OVER s AS b, lag(y, 168) OVER s AS c FROM h WINDOW s AS (PARTITION BY series ORDER BY hour))
SELECT series, round(corr(y, a), 6) AS acf_1, round(corr(y, b), 6) AS acf_24, round(corr(y, c), 6) AS acf_168 FROM w GROUP BY series""")
def ts_autocorr(spark, sf_dir):
    """Autocorrelation at three lags."""
    return rounded(series.autocorrelation(hours(spark, sf_dir)))


@query(f"""WITH {HOURLY}
SELECT series, count(*) AS n_hours, min(y) AS min_y, max(y) AS max_y, round(avg(y), 6) AS mean_y, round(median(y), 6) AS median_y, round(stddev_samp(y), 6) AS std_y,
  round(quantile_cont(y, 0.25), 6) AS q25, round(quantile_cont(y, 0.75), 6) AS q75, count(*) FILTER (y = 0) AS n_zero FROM h GROUP BY series""")
def ts_describe(spark, sf_dir):
    """Descriptive statistics of each series."""
    return rounded(
        hours(spark, sf_dir).groupBy("series").agg(
            F.count(F.lit(1)).alias("n_hours"), F.min("y").alias("min_y"), F.max("y").alias("max_y"), F.avg("y").alias("mean_y"), F.median("y").alias("median_y"),
            F.stddev_samp("y").alias("std_y"), F.percentile("y", F.lit(0.25)).alias("q25"), F.percentile("y", F.lit(0.75)).alias("q75"), F.count_if(F.col("y") == 0).alias("n_zero"),
        )
    )


@query("""WITH e AS (SELECT event_type AS series, epoch_us(ts) // 3600000000 AS hour, ts, value FROM events),
d AS (SELECT series, count(*) AS n_rows, count(*) - count(DISTINCT ts) AS n_repeated, count(*) FILTER (value IS NULL) AS n_missing, count(*) FILTER (value < 0) AS n_negative, count(*) FILTER (value = 0) AS n_zero, count(DISTINCT hour) AS n_hours, max(hour) - min(hour) + 1 AS n_expected FROM e GROUP BY series),
g AS (SELECT series, count(*) FILTER (step <> 1) AS n_irregular FROM (SELECT series, hour - lag(hour) OVER (PARTITION BY series ORDER BY hour) AS step FROM (SELECT DISTINCT series, hour FROM e)) GROUP BY series)
SELECT series, n_rows, n_repeated, n_missing, n_negative, n_zero, n_hours, n_expected - n_hours AS n_absent_hours, n_irregular,
  CASE WHEN n_missing > 0 OR n_negative > 0 THEN 'invalid' WHEN n_repeated > 0 OR n_expected > n_hours THEN 'warning' ELSE 'valid' END AS status FROM d JOIN g USING (series)""")
def ts_validation(spark, sf_dir):
    """Validation report of each raw series: repeats, gaps against the spine, irregular steps, bad values, a status."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("series"), series.hour_number("ts").alias("hour"), "ts", "value")
    d = e.groupBy("series").agg(
        F.count(F.lit(1)).alias("n_rows"), (F.count(F.lit(1)) - F.count_distinct("ts")).alias("n_repeated"), F.count_if(F.col("value").isNull()).alias("n_missing"),
        F.count_if(F.col("value") < 0).alias("n_negative"), F.count_if(F.col("value") == 0).alias("n_zero"), F.count_distinct("hour").alias("n_hours"), (F.max("hour") - F.min("hour") + 1).alias("n_expected"),
    )
    steps = e.select("series", "hour").distinct().withColumn("step", F.col("hour") - F.lag("hour").over(Window.partitionBy("series").orderBy("hour")))
    g = steps.groupBy("series").agg(F.count_if(F.col("step") != 1).alias("n_irregular"))
    status = F.when((F.col("n_missing") > 0) | (F.col("n_negative") > 0), "invalid").when((F.col("n_repeated") > 0) | (F.col("n_expected") > F.col("n_hours")), "warning").otherwise("valid")
    return d.join(g, "series").select("series", "n_rows", "n_repeated", "n_missing", "n_negative", "n_zero", "n_hours", (F.col("n_expected") - F.col("n_hours")).alias("n_absent_hours"), "n_irregular", status.alias("status"))


_FOLDS = f"""
p AS (SELECT series, y, row_number() OVER s - 1 AS place, sum(y) OVER (PARTITION BY series ORDER BY hour ROWS UNBOUNDED PRECEDING) AS seen FROM h WINDOW s AS (PARTITION BY series ORDER BY hour)),
n AS (SELECT series, count(*) AS n FROM h GROUP BY series),
f AS (SELECT series, k AS fold, {INITIAL} + k * {HORIZON} AS train_end FROM (SELECT series, n, unnest(range(0, 10000)) AS k FROM n) WHERE {INITIAL} + (k + 1) * {HORIZON} <= n),
t AS (SELECT f.series, fold, train_end, place, y FROM f JOIN p ON p.series = f.series AND place >= train_end AND place < train_end + {HORIZON}),
x AS (SELECT t.*, l.y AS naive, l.seen / (l.place + 1) AS mean, s.y AS seasonal FROM t JOIN p l ON l.series = t.series AND l.place = t.train_end - 1
      JOIN p s ON s.series = t.series AND s.place = t.train_end - 24 + (t.place - t.train_end) % 24),
r AS (SELECT series, fold, place, y AS actual, 'mean' AS model, mean AS forecast FROM x UNION ALL SELECT series, fold, place, y, 'naive', naive FROM x UNION ALL SELECT series, fold, place, y, 'seasonal_naive', seasonal FROM x),
e AS (SELECT series, fold, model, avg(abs(actual - forecast)) AS mae, sqrt(avg((actual - forecast) * (actual - forecast))) AS rmse,
      200 * avg(CASE WHEN abs(actual) + abs(forecast) = 0 THEN 0 ELSE abs(actual - forecast) / (abs(actual) + abs(forecast)) END) AS smape FROM r GROUP BY ALL)
"""


@query(f"""WITH {HOURLY}, {_FOLDS} SELECT series, fold, model, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(smape, 6) AS smape FROM e""")
def ts_expanding_folds(spark, sf_dir):
    """Errors of three baselines in expanding windows (folds of a day after two weeks)."""
    residuals = series.baseline_residuals(hours(spark, sf_dir), INITIAL, HORIZON)
    return rounded(series.forecast_errors(residuals, ["series", "fold", "model"]).drop("n"))


_SUMMARY = """
best AS (SELECT series, fold, min_by(model, (round(mae, 6), model)) AS model FROM e GROUP BY ALL),
wins AS (SELECT series, model, count(*) AS wins FROM best GROUP BY ALL),
s AS (SELECT series, model, count(DISTINCT fold) AS n_folds, avg(mae) AS mean_mae, coalesce(stddev_samp(mae), 0) AS std_mae, avg(rmse) AS mean_rmse FROM e GROUP BY ALL)
"""


@query(f"""WITH {HOURLY}, {_FOLDS}, {_SUMMARY}
SELECT series, model, n_folds, round(mean_mae, 6) AS mean_mae, round(std_mae, 6) AS std_mae, round(mean_rmse, 6) AS mean_rmse, CAST(coalesce(wins, 0) AS BIGINT) AS wins,
  CAST(rank() OVER (PARTITION BY series ORDER BY round(mean_mae, 6)) AS INTEGER) AS rank FROM s LEFT JOIN wins USING (series, model)""")
def ts_fold_summary(spark, sf_dir):
    """Each model over folds: mean and deviation, folds won (arg-min with ties by name), competition rank."""
    return rounded(_summary(spark, sf_dir))


def _summary(spark, sf_dir):
    residuals = series.baseline_residuals(hours(spark, sf_dir), INITIAL, HORIZON)
    e = series.forecast_errors(residuals, ["series", "fold", "model"])
    best = e.groupBy("series", "fold").agg(F.min_by("model", F.struct(r6("mae"), "model")).alias("model"))
    wins = best.groupBy("series", "model").agg(F.count(F.lit(1)).alias("wins"))
    s = e.groupBy("series", "model").agg(F.count_distinct("fold").alias("n_folds"), F.avg("mae").alias("mean_mae"), F.coalesce(F.stddev_samp("mae"), F.lit(0.0)).alias("std_mae"), F.avg("rmse").alias("mean_rmse"))
    ranked = s.join(wins, ["series", "model"], "left").withColumn("wins", F.coalesce("wins", F.lit(0)))
    return ranked.withColumn("rank", F.rank().over(Window.partitionBy("series").orderBy(r6("mean_mae"))))


@query(f"""WITH {HOURLY}, {_FOLDS}, {_SUMMARY},
b AS (SELECT series, max(mean_mae) FILTER (model = 'naive') AS naive_mae FROM s GROUP BY series),
c AS (SELECT s.*, row_number() OVER (PARTITION BY s.series ORDER BY round(mean_mae, 6), round(std_mae, 6), round(mean_rmse, 6), model) AS k, naive_mae FROM s JOIN b ON s.series = b.series WHERE n_folds >= 2)
SELECT series, model, round(mean_mae, 6) AS mean_mae, round(100 * (naive_mae - mean_mae) / naive_mae, 6) AS gain_percent,
  CASE WHEN mean_mae <= 0.9 * naive_mae THEN 'recommended' WHEN mean_mae < naive_mae THEN 'weak' ELSE 'none' END AS advice FROM c WHERE k = 1""")
def ts_recommend(spark, sf_dir):
    """The model chosen for each series under a constraint, with its gain over the naive forecast."""
    s = _summary(spark, sf_dir)
    naive = s.groupBy("series").agg(F.max(F.when(F.col("model") == "naive", F.col("mean_mae"))).alias("naive_mae"))
    w = Window.partitionBy("series").orderBy(r6("mean_mae"), r6("std_mae"), r6("mean_rmse"), "model")
    best = s.where("n_folds >= 2").join(naive, "series").withColumn("k", F.row_number().over(w)).where("k = 1")
    advice = F.when(F.col("mean_mae") <= 0.9 * F.col("naive_mae"), "recommended").when(F.col("mean_mae") < F.col("naive_mae"), "weak").otherwise("none")
    return rounded(best.select("series", "model", "mean_mae", (100 * (F.col("naive_mae") - F.col("mean_mae")) / F.col("naive_mae")).alias("gain_percent"), advice.alias("advice")))


@query(f"""WITH {HOURLY}, m AS (SELECT series, max(hour) AS last FROM h GROUP BY series),
tr AS (SELECT h.* FROM h JOIN m ON h.series = m.series WHERE hour <= last - 24),
c AS (SELECT series, avg(y) AS mean, arg_max(y, hour) AS naive FROM tr GROUP BY series),
sc AS (SELECT series, avg(abs(y - b)) AS scale FROM (SELECT series, y, lag(y, 24) OVER (PARTITION BY series ORDER BY hour) AS b FROM tr) GROUP BY series),
x AS (SELECT h.series, h.y AS actual, c.mean, c.naive, b.y AS seasonal FROM h JOIN m ON h.series = m.series JOIN c ON c.series = h.series JOIN h b ON b.series = h.series AND b.hour = h.hour - 24 WHERE h.hour > last - 24),
r AS (SELECT series, actual, 'mean' AS model, mean AS forecast FROM x UNION ALL SELECT series, actual, 'naive', naive FROM x UNION ALL SELECT series, actual, 'seasonal_naive', seasonal FROM x)
SELECT r.series, model, round(avg(abs(actual - forecast)), 6) AS mae, round(sqrt(avg((actual - forecast) ** 2)), 6) AS rmse, round(avg(abs(actual - forecast)) / min(scale), 6) AS mase FROM r JOIN sc ON sc.series = r.series GROUP BY ALL""")
def ts_baselines_holdout(spark, sf_dir):
    """Chronological holdout of the last day: three baselines with MASE on the training scale."""
    h = series.split_last(hours(spark, sf_dir), 24)
    train, test = h.where("not is_test"), h.where("is_test")
    level = train.groupBy("series").agg(F.avg("y").alias("mean"), F.max_by("y", "hour").alias("naive"))
    before = h.select("series", (F.col("hour") + 24).alias("hour"), F.col("y").alias("seasonal"))
    wide = test.select("series", "hour", F.col("y").alias("actual")).join(level, "series").join(before, ["series", "hour"])
    long = wide.select("series", "actual", F.expr("stack(3, 'mean', mean, 'naive', naive, 'seasonal_naive', seasonal) as (model, forecast)")).withColumn("residual", F.col("actual") - F.col("forecast"))
    e = series.forecast_errors(long, ["series", "model"]).join(series.seasonal_scale(train), "series")
    return rounded(e.select("series", "model", "mae", "rmse", (F.col("mae") / F.col("scale")).alias("mase")))


@query("""SELECT CAST(hour(ts) AS INTEGER) AS hour_of_day, count(*) AS n, round(avg(value), 6) AS mean_value, round(sum(value) / (SELECT sum(value) FROM events), 6) AS share FROM events GROUP BY ALL""")
def hour_profile(spark, sf_dir):
    """Profile by hour of the day."""
    e = table(spark, sf_dir, "events")
    g = e.groupBy(F.hour("ts").alias("hour_of_day")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"), F.sum("value").alias("s"))
    total = g.agg(F.sum("s").alias("total"))
    return rounded(g.crossJoin(F.broadcast(total)).select("hour_of_day", "n", "mean_value", (F.col("s") / F.col("total")).alias("share")))  # one row


@query("""WITH d AS (SELECT epoch_us(ts) // 86400000000 AS day, count(*) AS n, sum(value) AS v FROM events WHERE event_type = 'error' GROUP BY ALL),
b AS (SELECT min(epoch_us(ts) // 86400000000) AS lo, max(epoch_us(ts) // 86400000000) AS hi FROM events),
s AS (SELECT unnest(range(lo, hi + 1)) AS day FROM b)
SELECT day, CAST(coalesce(n, 0) AS BIGINT) AS n, round(coalesce(v, 0), 6) AS total FROM s LEFT JOIN d USING (day)""")
def daily_counts_filled(spark, sf_dir):
    """Errors a day, with days that have none."""
    e = table(spark, sf_dir, "events").withColumn("day", F.floor(series.hour_number("ts") / 24))
    spine = e.agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    d = e.where("event_type = 'error'").groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"))
    return spine.join(d, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("v", F.lit(0.0)), 6).alias("total"))


_LABELS = """
l AS (SELECT series, hour, n, y AS actual, lag(y, 24) OVER (PARTITION BY series ORDER BY hour) AS forecast FROM h),
r AS (SELECT series, hour, actual, forecast, actual - forecast AS residual, n = 0 AS closure FROM l WHERE forecast IS NOT NULL),
c AS (SELECT series, median(residual) AS center FROM r WHERE NOT closure GROUP BY series),
m AS (SELECT r.series, min(center) AS center, median(abs(residual - center)) AS mad FROM r JOIN c ON r.series = c.series WHERE NOT closure GROUP BY r.series HAVING median(abs(residual - center)) > 0),
z AS (SELECT r.*, 0.67449::DOUBLE * (residual - center) / mad AS z FROM r JOIN m ON r.series = m.series),
lab AS (SELECT *, abs(z) >= 3.5 AS is_statistical, abs(z) >= 3.5 AND NOT closure AS actionable,
  CASE WHEN closure AND abs(z) >= 3.5 THEN 'closure' WHEN abs(z) < 3.5 THEN 'normal' WHEN z > 0 THEN 'positive' ELSE 'negative' END AS kind,
  CASE WHEN NOT (abs(z) >= 3.5 AND NOT closure) THEN 'none' WHEN abs(z) >= 7.5 THEN 'critical' WHEN abs(z) >= 5 THEN 'high' ELSE 'moderate' END AS severity FROM z)
"""


def labelled(spark, sf_dir) -> DataFrame:
    return anomalies.label(anomalies.seasonal_residuals(hours(spark, sf_dir)))


@query(f"""WITH {HOURLY}, {_LABELS} SELECT series, hour, actual, forecast, round(residual, 6) AS residual, closure, round(z, 6) AS z, is_statistical, actionable, kind, severity FROM lab""")
def anomaly_labels(spark, sf_dir):
    """Modified z-scores of seasonal residuals, closures apart, with kinds and severities."""
    return rounded(labelled(spark, sf_dir))


@query(f"""WITH {HOURLY}, {_LABELS},
g AS (SELECT *, CASE WHEN hour - lag(hour) OVER w <= 1 THEN 0 ELSE 1 END AS fresh FROM lab WHERE actionable WINDOW w AS (PARTITION BY series ORDER BY hour)),
e AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY series ORDER BY hour) AS BIGINT) AS episode FROM g)
SELECT series, episode, min(hour) AS start_hour, max(hour) AS end_hour, max(hour) - min(hour) + 1 AS duration, count(*) AS n_hours,
  CASE WHEN count(*) FILTER (z > 0) > 0 AND count(*) FILTER (z < 0) > 0 THEN 'mixed' WHEN count(*) FILTER (z > 0) > 0 THEN 'positive' ELSE 'negative' END AS direction,
  arg_max(hour, (abs(z), -hour)) AS peak_hour, round(arg_max(z, (abs(z), -hour)), 6) AS peak_z, round(sum(actual), 2) AS actual_sum, round(sum(forecast), 2) AS forecast_sum,
  round(sum(residual), 2) AS residual_sum, round(CASE WHEN sum(actual) <> 0 THEN sum(residual) / sum(actual) END, 6) AS residual_ratio, array_to_string(list_sort(list(DISTINCT severity)), ', ') AS severities
FROM e GROUP BY series, episode""")
def anomaly_episodes(spark, sf_dir):
    """Episodes of actionable anomalies, gap-sessionised: the flagship query."""
    return anomalies.episodes(labelled(spark, sf_dir))


@query(f"""WITH {HOURLY}, {_LABELS}, t AS (SELECT *, row_number() OVER (ORDER BY abs(z) DESC, hour, series) AS rank FROM lab WHERE actionable)
SELECT series, hour, round(z, 6) AS z, severity, CAST(rank AS INTEGER) AS rank FROM t WHERE rank <= 15""")
def anomaly_topk(spark, sf_dir):
    """The fifteen strongest actionable anomalies."""
    return rounded(anomalies.top(labelled(spark, sf_dir), 15).select("series", "hour", "z", "severity", "rank"))


@query(f"""WITH {HOURLY}, {_LABELS},
g AS (SELECT series, hour, z, CASE WHEN hour - lag(hour) OVER w <= 1 THEN 0 ELSE 1 END AS fresh FROM lab WHERE actionable WINDOW w AS (PARTITION BY series ORDER BY hour)),
e AS (SELECT *, sum(fresh) OVER (PARTITION BY series ORDER BY hour) AS episode FROM g)
SELECT series, min(hour) AS start_hour, max(hour) AS end_hour, count(*) AS n_hours, round(max(abs(z)), 6) AS peak FROM e GROUP BY series, episode""")
def episodes_session_window(spark, sf_dir):
    """The same episodes by Spark's session windows; its streaming twin is in quillon.streaming."""
    rows = labelled(spark, sf_dir).where("actionable").withColumn("at", F.timestamp_seconds(F.col("hour") * 3600))
    g = rows.groupBy("series", F.session_window("at", "1 hour")).agg(F.min("hour").alias("start_hour"), F.max("hour").alias("end_hour"), F.count(F.lit(1)).alias("n_hours"), F.max(F.abs("z")).alias("peak"))
    return rounded(g.select("series", "start_hour", "end_hour", "n_hours", "peak"))


@query(f"""WITH {HOURLY} SELECT series, arg_max(hour, (y, -hour)) AS peak_hour, max(y) AS peak_y, arg_min(hour, (y, hour)) AS low_hour, min(y) AS low_y FROM h GROUP BY series""")
def peak_rows(spark, sf_dir):
    """Arg-max and arg-min rows of each series; ties to the earliest hour."""
    return hours(spark, sf_dir).groupBy("series").agg(F.max_by("hour", F.struct("y", -F.col("hour"))).alias("peak_hour"), F.max("y").alias("peak_y"), F.min_by("hour", F.struct("y", "hour")).alias("low_hour"), F.min("y").alias("low_y"))


@query(f"""WITH {HOURLY}, t AS (SELECT series, y, hour, row_number() OVER (PARTITION BY series ORDER BY y DESC, hour) AS k, sum(y) OVER (PARTITION BY series) AS total FROM h),
c AS (SELECT *, sum(y) OVER (PARTITION BY series ORDER BY k) / total AS run FROM t)
SELECT series, min(k) FILTER (run >= 0.5 - 1e-9) AS hours_for_half, min(k) FILTER (run >= 0.9 - 1e-9) AS hours_for_most, round(sum(y) FILTER (k <= 10) / min(total), 6) AS top10_share FROM c GROUP BY series""")
def first_reach(spark, sf_dir):
    """How many of the busiest hours hold half and nine tenths of a series (first reach of a running share)."""
    w = Window.partitionBy("series").orderBy(F.desc("y"), "hour")
    t = hours(spark, sf_dir).withColumns({"k": F.row_number().over(w).cast("long"), "run_sum": F.sum("y").over(w.rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("y").over(Window.partitionBy("series"))})
    run = F.col("run_sum") / F.col("total")
    reach = lambda goal: F.min(F.when(run >= goal - 1e-9, F.col("k")))
    return rounded(t.groupBy("series").agg(reach(0.5).alias("hours_for_half"), reach(0.9).alias("hours_for_most"), (F.sum(F.when(F.col("k") <= 10, F.col("y"))) / F.min("total")).alias("top10_share")))
