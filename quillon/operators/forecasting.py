"""Forecasts that carry state from hour to hour, one series a group; and additive decomposition by windows."""

from __future__ import annotations

from collections.abc import Callable
from itertools import product
from typing import Protocol

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OUT = "series string, hour long, actual double, forecast double"


def _smooth(y: np.ndarray, season: int, a: float, b: float, g: float, phi: float):
    level, trend, seasonal, sse = y[:season].mean(), 0.0, list(y[:season] - y[:season].mean()), 0.0
    for t in range(season, len(y)):
        expected = level + phi * trend + seasonal[t - season]
        sse += (y[t] - expected) ** 2
        before = level
        level = a * (y[t] - seasonal[t - season]) + (1 - a) * (level + phi * trend)
        trend = b * (level - before) + (1 - b) * phi * trend
        seasonal.append(g * (y[t] - level) + (1 - g) * seasonal[t - season])
    return sse, level, trend, seasonal


def holt_winters(h: DataFrame, season: int, horizon: int) -> DataFrame:
    """Additive trend (damped) and season; parameters from a small grid by least squared errors; forecasts are not negative."""

    def run(pdf):
        pdf = pdf.sort_values("hour")
        y, rest = pdf["y"].to_numpy()[:-horizon], pdf.iloc[-horizon:]
        if len(y) < 2 * season:
            return pdf.iloc[:0].assign(actual=0.0, forecast=0.0)[["series", "hour", "actual", "forecast"]]
        grid = product((0.1, 0.3), (0.01, 0.1), (0.1, 0.3), (0.9, 0.98))
        phi, (_, level, trend, seasonal) = min(((p[3], _smooth(y, season, *p)) for p in grid), key=lambda x: x[1][0])
        steps = np.arange(1, horizon + 1)
        damp = np.cumsum(phi**steps)
        ahead = np.maximum(0, level + damp * trend + np.array([seasonal[len(y) - season + (k - 1) % season] for k in steps]))
        return rest.assign(actual=rest["y"], forecast=ahead)[["series", "hour", "actual", "forecast"]]

    return h.select("series", "hour", "y").groupBy("series").applyInPandas(run, OUT)


def recursive(h: DataFrame, horizon: int, lags: tuple[int, ...] = (1, 2, 24)) -> DataFrame:
    """A linear model on lags, fitted in each series' past; each forecast is clipped at 0 and becomes the next step's lag."""

    def run(pdf):
        pdf = pdf.sort_values("hour")
        y, rest, most = list(pdf["y"].to_numpy()[:-horizon]), pdf.iloc[-horizon:], max(lags)
        if len(y) < 2 * most:
            return pdf.iloc[:0].assign(actual=0.0, forecast=0.0)[["series", "hour", "actual", "forecast"]]
        x = np.array([[1.0, *[y[t - k] for k in lags]] for t in range(most, len(y))])
        beta = np.linalg.solve(x.T @ x + 1e-6 * np.eye(x.shape[1]), x.T @ np.array(y[most:]))
        for _ in range(horizon):
            y.append(max(0.0, float(beta @ np.array([1.0, *[y[-k] for k in lags]]))))
        return rest.assign(actual=rest["y"], forecast=y[-horizon:])[["series", "hour", "actual", "forecast"]]

    return h.select("series", "hour", "y").groupBy("series").applyInPandas(run, OUT)


def decompose(h: DataFrame, season: int) -> DataFrame:
    """series, hour, y, trend, seasonal, remainder; null where the centred window is not whole."""
    w = Window.partitionBy("series").orderBy("hour")
    half = season // 2
    wide, full = w.rowsBetween(-half, half), F.count("y").over(w.rowsBetween(-half, half)) == 2 * half + 1
    ends = (F.lag("y", half).over(w) + F.lead("y", half).over(w)) / 2
    trend = F.when(full, (F.sum("y").over(wide) - ends) / season)
    parts = h.select("series", "hour", "y").withColumn("trend", trend).withColumn("phase", F.pmod("hour", F.lit(season)))
    phase = parts.where("trend is not null").groupBy("series", "phase").agg(F.avg(F.col("y") - F.col("trend")).alias("raw"))
    level = phase.groupBy("series").agg(F.avg("raw").alias("level"))
    seasonal = phase.join(level, "series").select("series", "phase", (F.col("raw") - F.col("level")).alias("seasonal"))
    return parts.join(seasonal, ["series", "phase"]).select("series", "hour", "y", "trend", "seasonal", (F.col("y") - F.col("trend") - F.col("seasonal")).alias("remainder"))


# ---- what is known of the next hour ----


def next_features(h: DataFrame, lags: tuple[int, ...] = (1, 24, 168), windows: tuple[int, ...] = (24, 168)) -> DataFrame:
    """The feature row of the hour after each series' last: lags, means and deviations of the last hours, calendar, trend; null where the past is too short."""
    last = h.groupBy("series").agg(F.max("hour").alias("last"), F.count(F.lit(1)).cast("double").alias("trend"))
    back = h.join(last, "series").where(F.col("hour") > F.col("last") - max(*lags, *windows)).withColumn("age", F.col("last") + 1 - F.col("hour"))
    inside = lambda n: F.when(F.col("age") <= n, F.col("y"))
    whole = lambda n, f: F.when(F.count(inside(n)) == n, f(inside(n)))
    parts = [F.max(F.when(F.col("age") == k, F.col("y"))).alias(f"lag_{k}") for k in lags]
    parts += [whole(n, f).alias(f"{name}_{n}") for n in windows for name, f in (("mean", F.avg), ("std", F.stddev_pop))]
    turn = lambda f, place, n: f(2 * F.pi() * place / n)
    hour, day = F.col("hour") % 24, (F.floor(F.col("hour") / 24) + 3) % 7
    rows = back.groupBy("series", "last", "trend").agg(*parts).withColumn("hour", F.col("last") + 1)
    return rows.withColumns({"hour_sin": turn(F.sin, hour, 24), "hour_cos": turn(F.cos, hour, 24), "day_sin": turn(F.sin, day, 7), "day_cos": turn(F.cos, day, 7)}).drop("last")


# ---- forecasters as a parameter ----


class Forecaster(Protocol):
    """What ``forecast_with`` needs: a fit on the past, then so many steps ahead."""

    def fit(self, y: np.ndarray) -> None: ...

    def predict(self, steps: int) -> np.ndarray: ...


class Mean:
    def fit(self, y):
        self.level = float(y.mean())

    def predict(self, steps):
        return np.full(steps, self.level)


class SeasonalNaive:
    def __init__(self, season: int = 24):
        self.season = season

    def fit(self, y):
        self.last = y[-self.season :]

    def predict(self, steps):
        return np.resize(self.last, steps)


class Boosted:
    """Gradient boosting of one-split trees on lags; each prediction is clipped at 0 and becomes the next step's lag. Splits lie at quantiles, so a round looks at histograms alone."""

    def __init__(self, lags: tuple[int, ...] = (1, 2, 24), rounds: int = 40, rate: float = 0.2, bins: int = 16):
        self.lags, self.rounds, self.rate, self.bins = lags, rounds, rate, bins

    def _rows(self, y: np.ndarray, places) -> np.ndarray:
        return np.array([[y[t - k] for k in self.lags] for t in places])

    def fit(self, y):
        self.past = list(map(float, y))
        places = range(max(self.lags), len(y))
        x, goal = self._rows(y, places), np.asarray(y, float)[max(self.lags) :]
        self.base, self.trees = float(goal.mean()), []
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        at = [np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)]  # bin b holds values up to the cut b
        left = goal - self.base
        for _ in range(self.rounds):
            best = None
            for j, (c, b) in enumerate(zip(cuts, at, strict=True)):
                n, s = np.bincount(b, minlength=len(c) + 1).cumsum(), np.bincount(b, weights=left, minlength=len(c) + 1).cumsum()
                below, above = n[:-1], n[-1] - n[:-1]
                sound = (below > 0) & (above > 0)
                gain = np.where(sound, s[:-1] ** 2 / np.maximum(below, 1) + (s[-1] - s[:-1]) ** 2 / np.maximum(above, 1), -np.inf)
                k = int(gain.argmax()) if len(gain) else -1
                if k >= 0 and np.isfinite(gain[k]) and (best is None or gain[k] > best[0] + 1e-9):
                    best = gain[k], j, float(c[k]), s[k] / below[k], (s[-1] - s[k]) / above[k]
            if best is None:
                return
            _, j, cut, low, high = best
            self.trees.append((j, cut, self.rate * low, self.rate * high))
            left = left - np.where(x[:, j] <= cut, self.rate * low, self.rate * high)

    def predict(self, steps):
        y = list(self.past)
        for _ in range(steps):
            row = [y[-k] for k in self.lags]
            y.append(max(0.0, self.base + sum(low if row[j] <= cut else high for j, cut, low, high in self.trees)))
        return np.array(y[len(self.past) :])


def forecast_with(h: DataFrame, make: Callable[[], Forecaster], horizon: int, least: int) -> DataFrame:
    """Forecasts of the last hours of each series that has at least so many hours before them, by a forecaster of its own."""

    def run(pdf):
        pdf = pdf.sort_values("hour")
        y, rest = pdf["y"].to_numpy(float)[:-horizon], pdf.iloc[-horizon:]
        if len(y) < least:
            return pdf.iloc[:0].assign(actual=0.0, forecast=0.0)[["series", "hour", "actual", "forecast"]]
        model = make()
        model.fit(y)
        return rest.assign(actual=rest["y"], forecast=model.predict(horizon))[["series", "hour", "actual", "forecast"]]

    return h.select("series", "hour", "y").groupBy("series").applyInPandas(run, OUT)


# ---- tests of a series ----


def partial_autocorrelations(r: list[Column]) -> list[Column]:
    """Partial autocorrelations at lags 1, 2, ... from the autocorrelations at these lags (Durbin and Levinson's recursion)."""
    out, phi = [], []
    for k, rk in enumerate(r):
        top, below = rk, F.lit(1.0)
        for j, p in enumerate(phi):
            top, below = top - p * r[k - 1 - j], below - p * r[j]
        own = F.try_divide(top, below)
        phi = [p - own * phi[k - 1 - j] for j, p in enumerate(phi)] + [own]
        out.append(own)
    return out


def unit_root(h: DataFrame) -> DataFrame:
    """series, n, and the augmented Dickey-Fuller statistic with a constant and one lagged difference: the t value of the level in the regression of the change, from one aggregation."""
    w = Window.partitionBy("series").orderBy("hour")
    rows = h.select("series", (F.col("y") - F.lag("y").over(w)).alias("d"), F.lag("y").over(w).alias("x"), (F.lag("y").over(w) - F.lag("y", 2).over(w)).alias("g")).where("g is not null")
    s = rows.groupBy("series").agg(F.count(F.lit(1)).alias("n"), *[F.covar_pop(a, b).alias(a + b) for a, b in ("xx", "gg", "dd", "xg", "xd", "gd")])
    c = lambda name: F.col(name)
    less = lambda ab, a, b: c(ab) - F.try_divide(c(a) * c(b), c("gg"))  # what the lagged difference explains is taken off
    s = s.withColumns({"sxx": less("xx", "xg", "xg"), "sxd": less("xd", "xg", "gd"), "sdd": less("dd", "gd", "gd")})
    slope = F.try_divide(c("sxd"), c("sxx"))
    error = F.sqrt(F.try_divide(c("sdd") - slope * c("sxd"), (c("n") - 3) * c("sxx")))
    return s.select("series", "n", F.try_divide(slope, error).alias("statistic"))
