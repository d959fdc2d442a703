"""PCA from one aggregation: sums and products on the cluster, a small eigenproblem on the driver, scores as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators import metrics


@dataclass
class Model:
    columns: list[str]
    mean: np.ndarray
    scale: np.ndarray
    loadings: np.ndarray  # a row for each component kept
    variance: np.ndarray  # of all components

    def rows(self) -> list[tuple]:
        share = self.variance / self.variance.sum()
        return [(i + 1, c, float(v), float(share[i]), float(share[: i + 1].sum())) for i, row in enumerate(self.loadings) for c, v in zip(self.columns, row, strict=True)]

    def error(self) -> Column:
        """Mean squared residual of a row, in code that Spark compiles."""
        z = [(F.col(c) - float(m)) / float(s) for c, m, s in zip(self.columns, self.mean, self.scale, strict=True)]
        residual = np.eye(len(z)) - self.loadings.T @ self.loadings
        out = F.lit(0.0)
        for row in residual:
            e = F.lit(0.0)
            for w, x in zip(row, z, strict=True):
                e = e + float(w) * x
            out = out + e * e
        return out / len(z)


def fit(normal: DataFrame, columns: list[str], share: float) -> Model:
    """Standardised by population deviation; as many components as explain the share. Constant columns and clearly negative eigenvalues are refused."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    one = normal.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)], *[F.covar_samp(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    n = len(columns)
    mean, scale = (np.array([one[f"{k}{i}"] for i in range(n)]) for k in "ms")
    if (scale <= 0).any():
        raise ValueError("a column has no variance")
    cov = np.zeros((n, n))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = one[f"c{i}_{j}"] / (scale[i] * scale[j])
    values, vectors = np.linalg.eigh(cov)
    if values.min() < -1e-8:
        raise ValueError("the covariance has a negative eigenvalue")
    order = np.argsort(-values, kind="stable")
    values, vectors = np.maximum(values[order], 0), vectors[:, order].T
    for v in vectors:
        if v[np.abs(v).argmax()] < 0:
            v *= -1
    running = np.cumsum(values) / values.sum()
    running[-1] = 1.0
    return Model(columns, mean, scale, vectors[: int(np.argmax(running >= share - 1e-12)) + 1], values)


def detect(model: Model, rows: DataFrame, normal: DataFrame, keep: list[str], quantile: float) -> DataFrame:
    """error and is_anomaly (strictly above the quantile of normal rows' errors)."""
    threshold = metrics.quantile(normal.select(model.error().alias("e")), "e", [], quantile).first()[0]
    return rows.select(*keep, model.error().alias("error")).withColumn("is_anomaly", F.col("error") > float(threshold))


def checks(model: Model, rows: DataFrame, tolerance: float = 1e-8) -> list[tuple[str, bool]]:
    """What must hold of a fit with all components: names of conditions and whether they do."""
    full, v = model.loadings, model.variance
    worst = rows.agg(F.max(model.error())).first()[0] or 0.0
    share = v / v.sum()
    return [
        ("orthonormal", bool(np.allclose(full @ full.T, np.eye(len(full)), atol=tolerance))), ("variances_fall", bool((np.diff(v) <= tolerance).all())), ("variances_not_negative", bool((v >= 0).all())),
        ("shares_add_up", bool(abs(share.sum() - 1) < tolerance)), ("reconstruction_is_whole", bool(worst < 1e-12)), ("signs_fixed", bool(all(r[np.abs(r).argmax()] > 0 for r in full))),
    ]
