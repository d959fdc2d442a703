"""Effects of a binary treatment as weighted aggregates, balance diagnostics and sensitivity formulas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clipped(p: Column, lo: float = 0.05, hi: float = 0.95) -> Column:
    return F.when(p.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), p)))


def difference(df: DataFrame, t: str = "t", y: str = "y", z: float = 1.959963984540054) -> DataFrame:
    arm = lambda v, f: f(F.when(F.col(t) == v, F.col(y)))
    s = df.agg(*[arm(v, f).alias(f"{n}{v}") for v in (0, 1) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))])
    effect, se = F.col("m1") - F.col("m0"), F.sqrt(F.col("v1") / F.col("n1") + F.col("v0") / F.col("n0"))
    return s.select(effect.alias("effect"), se.alias("se"), (effect - z * se).alias("lower"), (effect + z * se).alias("upper"), F.col("n0"), F.col("n1"))


def weighting(df: DataFrame, t: str = "t", y: str = "y", p: str = "p") -> DataFrame:
    """Horvitz-Thompson average effect, Hajek effect on the treated, effective sample sizes, overlap."""
    tt, yy, pp = F.col(t), F.col(y), clipped(F.col(p))
    w = F.when(tt == 1, 1 / pp).otherwise(1 / (1 - pp))
    odds = pp / (1 - pp)
    hajek = F.sum(F.when(tt == 1, yy)) / F.count_if(tt == 1) - F.sum(F.when(tt == 0, odds * yy)) / F.sum(F.when(tt == 0, odds))
    return df.agg(
        F.avg(tt * yy / pp - (1 - tt) * yy / (1 - pp)).alias("ate"), hajek.alias("att"),
        *[(F.pow(F.sum(F.when(tt == v, w)), F.lit(2.0)) / F.sum(F.when(tt == v, w * w))).alias(f"ess{v}") for v in (0, 1)],
        F.max(w).alias("max_weight"), F.avg(F.col(p).between(0.1, 0.9).cast("double")).alias("overlap"),
        F.avg(((F.col(p) < 0.05) | (F.col(p) > 0.95)).cast("double")).alias("clipped_share"),
    )


def doubly_robust_score(t: str = "t", y: str = "y", p: str = "p", m0: str = "m0", m1: str = "m1") -> Column:
    tt, yy, pp, a, b = F.col(t), F.col(y), clipped(F.col(p)), F.col(m0), F.col(m1)
    return b - a + tt * (yy - b) / pp - (1 - tt) * (yy - a) / (1 - pp)


def doubly_robust(df: DataFrame, **columns) -> DataFrame:
    s = df.select(doubly_robust_score(**columns).alias("s"))
    return s.agg(F.avg("s").alias("aipw"), (F.stddev_samp("s") / F.sqrt(F.count("s"))).alias("se"), F.count("s").alias("n"))


def mean_differences(df: DataFrame, covariates: list[str], t: str = "t", weight: str | None = None) -> DataFrame:
    """Standardised mean difference of each covariate, plain and weighted (reliability weights)."""
    long = df.select(F.col(t).alias("t"), (F.col(weight) if weight else F.lit(1.0)).alias("w"), F.expr("stack({}, {}) as (covariate, x)".format(len(covariates), ", ".join(f"'{c}', cast({c} as double)" for c in covariates))))
    arms = []
    for v in (0, 1):
        on = F.col("t") == v
        arms += [F.avg(F.when(on, F.col("x"))).alias(f"m{v}"), F.var_samp(F.when(on, F.col("x"))).alias(f"v{v}")]
        arms += [F.sum(F.when(on, F.col("w"))).alias(f"w{v}"), F.sum(F.when(on, F.col("w") * F.col("w"))).alias(f"ww{v}")]
        arms += [F.sum(F.when(on, F.col("w") * F.col("x"))).alias(f"wx{v}"), F.sum(F.when(on, F.col("w") * F.col("x") * F.col("x"))).alias(f"wxx{v}")]
    s = long.groupBy("covariate").agg(*arms)
    smd = F.try_divide(F.col("m1") - F.col("m0"), F.sqrt((F.col("v1") + F.col("v0")) / 2))
    for v in (0, 1):
        mean = F.col(f"wx{v}") / F.col(f"w{v}")
        s = s.withColumn(f"wm{v}", mean).withColumn(f"wv{v}", (F.col(f"wxx{v}") - F.col(f"w{v}") * mean * mean) / (F.col(f"w{v}") - F.col(f"ww{v}") / F.col(f"w{v}")))
    weighted = F.try_divide(F.col("wm1") - F.col("wm0"), F.sqrt((F.col("wv1") + F.col("wv0")) / 2))
    return s.select("covariate", smd.alias("smd"), weighted.alias("weighted_smd"))


def gram(df: DataFrame, columns: list[str]) -> DataFrame:
    """Sums of products of all pairs of columns and an intercept: i, j, s with i <= j. One aggregation, one row a pair."""
    names = ["intercept", *columns]
    wide = df.select(F.lit(1.0).alias("intercept"), *[F.col(c).cast("double").alias(c) for c in columns])
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    sums = wide.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"s{k}") for k, (a, b) in enumerate(pairs)])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), F.col(f"s{k}").alias("s")) for k, (a, b) in enumerate(pairs)])))


def least_squares(df: DataFrame, x: list[str], y: str) -> tuple:
    """Coefficients (intercept first) and standard errors from the Gram matrix; the driver solves a system of len(x) + 1 unknowns."""
    import numpy as np

    names = ["intercept", *x, y]
    m = np.zeros((len(names), len(names)))
    for r in gram(df, [*x, y]).collect():
        i, j = names.index(r["i"]), names.index(r["j"])
        m[i, j] = m[j, i] = r["s"]
    a, b, n = m[:-1, :-1], m[:-1, -1], m[0, 0]
    if np.linalg.matrix_rank(a) < len(a):
        raise ValueError("the design matrix has dependent columns")
    beta = np.linalg.solve(a, b)
    sigma = max(0.0, (m[-1, -1] - beta @ b) / (n - len(a)))
    return beta, np.sqrt(sigma * np.diag(np.linalg.inv(a)))


def e_value(rr: Column) -> Column:
    """How strong a hidden confounder would have to be, on the risk-ratio scale."""
    up = F.when(rr >= 1, rr).otherwise(1 / rr)
    return up + F.sqrt(up * (up - 1))


def robustness_value(t_stat: Column, dof: Column) -> Column:
    f = F.abs(t_stat) / F.sqrt(dof)
    return (F.sqrt(F.pow(f, F.lit(4.0)) + 4 * f * f) - f * f) / 2


def effect_errors(df: DataFrame, effect: str, truth: str) -> DataFrame:
    """Bias, and root mean square error of individual effects."""
    e = F.col(effect) - F.col(truth)
    return df.agg(F.avg(e).alias("bias"), F.abs(F.avg(e)).alias("abs_bias"), F.sqrt(F.avg(e * e)).alias("pehe"))
