"""Causal aggregates: customers treated by market segment, with fixed nuisance columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.io import table
from quillon.operators import causal
from quillon.plans.registry import query, rounded

_FRAME = """fr AS (SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'AUTOMOBILE') THEN 1 ELSE 0 END AS t, c_acctbal AS x1, c_nationkey::DOUBLE AS x2, coalesce(o.y, 0) AS y,
1 / (1 + exp(-(0.00005 * c_acctbal - 0.02 * c_nationkey))) AS p, 100 + 0.001 * c_acctbal AS m0, 120 + 0.001 * c_acctbal AS m1 FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice) / 1000 AS y FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey)"""


def frame(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg((F.sum("o_totalprice") / 1000).alias("y"))
    c = table(spark, sf_dir, "customer").join(o, "c_custkey", "left")
    return c.select(
        "c_custkey", F.col("c_mktsegment").isin("BUILDING", "AUTOMOBILE").cast("int").alias("t"), F.col("c_acctbal").alias("x1"), F.col("c_nationkey").cast("double").alias("x2"), F.coalesce("y", F.lit(0.0)).alias("y"),
        (1 / (1 + F.exp(-(0.00005 * F.col("c_acctbal") - 0.02 * F.col("c_nationkey"))))).alias("p"), (100 + 0.001 * F.col("c_acctbal")).alias("m0"), (120 + 0.001 * F.col("c_acctbal")).alias("m1"),
    )


@query(f"WITH {_FRAME}, a AS (SELECT avg(y) FILTER (t = 1) AS m1, avg(y) FILTER (t = 0) AS m0, var_samp(y) FILTER (t = 1) AS v1, var_samp(y) FILTER (t = 0) AS v0, count(*) FILTER (t = 1) AS n1, count(*) FILTER (t = 0) AS n0 FROM fr), s AS (SELECT *, m1 - m0 AS e, sqrt(v1 / n1 + v0 / n0) AS se FROM a) SELECT round(e, 4) AS effect, round(se, 4) AS se, round(e - 1.959963984540054 * se, 4) AS lower, round(e + 1.959963984540054 * se, 4) AS upper, n0, n1 FROM s")
def causal_diff(spark, sf_dir):
    """Difference in means with a normal interval."""
    return rounded(causal.difference(frame(spark, sf_dir)), 4)


_P = "greatest(0.05, least(0.95, p))"


@query(f"WITH {_FRAME}, w AS (SELECT *, {_P} AS pc, CASE WHEN t = 1 THEN 1 / {_P} ELSE 1 / (1 - {_P}) END AS w FROM fr) SELECT round(avg(t * y / pc - (1 - t) * y / (1 - pc)), 4) AS ate, round(avg(y) FILTER (t = 1) - sum(pc / (1 - pc) * y) FILTER (t = 0) / sum(pc / (1 - pc)) FILTER (t = 0), 4) AS att, round(sum(w) FILTER (t = 0) ** 2 / sum(w * w) FILTER (t = 0), 4) AS ess0, round(sum(w) FILTER (t = 1) ** 2 / sum(w * w) FILTER (t = 1), 4) AS ess1, round(max(w), 4) AS max_weight, round(avg((p BETWEEN 0.1 AND 0.9)::INT), 4) AS overlap, round(avg((p < 0.05 OR p > 0.95)::INT), 4) AS clipped_share FROM w")
def causal_ipw(spark, sf_dir):
    """Inverse-probability weighting with clipping, effective sample sizes and overlap."""
    return rounded(causal.weighting(frame(spark, sf_dir)), 4)


@query(f"WITH {_FRAME}, s AS (SELECT m1 - m0 + t * (y - m1) / {_P} - (1 - t) * (y - m0) / (1 - {_P}) AS s FROM fr) SELECT round(avg(s), 4) AS aipw, round(stddev_samp(s) / sqrt(count(s)), 4) AS se, count(s) AS n FROM s")
def causal_aipw(spark, sf_dir):
    """Doubly robust estimate from fixed nuisance columns."""
    return rounded(causal.doubly_robust(frame(spark, sf_dir)), 4)


@query(f"WITH {_FRAME} SELECT c_custkey, t, round(m1 - m0 + t * (y - m1) / {_P} - (1 - t) * (y - m0) / (1 - {_P}), 4) AS score FROM fr")
def dr_scores(spark, sf_dir):
    """Doubly robust score of each row."""
    return rounded(frame(spark, sf_dir).select("c_custkey", "t", causal.doubly_robust_score().alias("score")), 4)


@query(" UNION ALL ".join(f"(WITH {_FRAME}, w AS (SELECT t, {c} AS x, CASE WHEN t = 1 THEN 1 / {_P} ELSE 1 / (1 - {_P}) END AS w FROM fr), a AS (SELECT t, avg(x) AS m, var_samp(x) AS v, sum(w) AS sw, sum(w * w) AS sww, sum(w * x) / sum(w) AS wm, sum(w * x * x) AS swxx FROM w GROUP BY t), b AS (SELECT *, (swxx - sw * wm * wm) / (sw - sww / sw) AS wv FROM a) SELECT '{c}' AS covariate, round((max(m) FILTER (t = 1) - max(m) FILTER (t = 0)) / sqrt((max(v) FILTER (t = 1) + max(v) FILTER (t = 0)) / 2), 6) AS smd, round((max(wm) FILTER (t = 1) - max(wm) FILTER (t = 0)) / sqrt((max(wv) FILTER (t = 1) + max(wv) FILTER (t = 0)) / 2), 6) AS weighted_smd FROM b)" for c in ("x1", "x2")))
def smd(spark, sf_dir):
    """Standardised mean differences, plain and weighted."""
    pc = causal.clipped(F.col("p"))
    f = frame(spark, sf_dir).withColumn("w", F.when(F.col("t") == 1, 1 / pc).otherwise(1 / (1 - pc)))
    return rounded(causal.mean_differences(f, ["x1", "x2"], weight="w"))


@query(f"WITH {_FRAME}, s AS (SELECT regr_slope(y, x1) AS b1, avg(t) AS mt FROM fr), g AS (SELECT covar_pop(t, t) AS tt, covar_pop(t, x1) AS tx, covar_pop(x1, x1) AS xx, covar_pop(t, y) AS ty, covar_pop(x1, y) AS xy FROM fr) SELECT round((ty * xx - xy * tx) / (tt * xx - tx * tx), 4) AS effect, round((xy * tt - ty * tx) / (tt * xx - tx * tx), 6) AS slope FROM g")
def ols_effect(spark, sf_dir):
    """Effect adjusted for one covariate by least squares, in closed form from covariances."""
    g = frame(spark, sf_dir).agg(*[F.covar_pop(a, b).alias(f"{a}_{b}") for a, b in (("t", "t"), ("t", "x1"), ("x1", "x1"), ("t", "y"), ("x1", "y"))])
    d = F.col("t_t") * F.col("x1_x1") - F.col("t_x1") * F.col("t_x1")
    return g.select(F.round((F.col("t_y") * F.col("x1_x1") - F.col("x1_y") * F.col("t_x1")) / d, 4).alias("effect"), F.round((F.col("x1_y") * F.col("t_t") - F.col("t_y") * F.col("t_x1")) / d, 6).alias("slope"))


@query(f"WITH {_FRAME}, r AS (SELECT greatest(a, b) / least(a, b) AS rr FROM (SELECT avg((y > 500)::INT) FILTER (t = 1) + 0.0001 AS a, avg((y > 500)::INT) FILTER (t = 0) + 0.0001 AS b FROM fr)), d AS (SELECT (avg(y) FILTER (t = 1) - avg(y) FILTER (t = 0)) / sqrt(var_samp(y) FILTER (t = 1) / count(*) FILTER (t = 1) + var_samp(y) FILTER (t = 0) / count(*) FILTER (t = 0)) AS ts, count(*) - 3 AS dof FROM fr), f AS (SELECT abs(ts) / sqrt(dof) AS f FROM d) SELECT round(rr + sqrt(rr * (rr - 1)), 4) AS e_value, round((sqrt(f ** 4 + 4 * f * f) - f * f) / 2, 6) AS robustness_value, CASE WHEN rr + sqrt(rr * (rr - 1)) >= 2 THEN 'robust' ELSE 'fragile' END AS status FROM r, f")
def sensitivity(spark, sf_dir):
    """E-value and robustness value of the effect."""
    f = frame(spark, sf_dir)
    risk = lambda v: F.avg(F.when(F.col("t") == v, (F.col("y") > 500).cast("int"))) + 0.0001
    r = f.agg(risk(1).alias("a"), risk(0).alias("b")).select((F.greatest("a", "b") / F.least("a", "b")).alias("rr"))
    d = causal.difference(f).select((F.col("effect") / F.col("se")).alias("ts"), (F.col("n0") + F.col("n1") - 3).alias("dof"))
    e = causal.e_value(F.col("rr"))
    out = r.crossJoin(d)  # one row each
    return out.select(F.round(e, 4).alias("e_value"), F.round(causal.robustness_value(F.col("ts"), F.col("dof")), 6).alias("robustness_value"), F.when(e >= 2, "robust").otherwise("fragile").alias("status"))


@query(f"WITH {_FRAME} SELECT round(avg(m1 - m0 - 20.5), 6) AS bias, round(abs(avg(m1 - m0 - 20.5)), 6) AS abs_bias, round(sqrt(avg((m1 - m0 - 20.5) ** 2)), 6) AS pehe FROM fr")
def benchmark_errors(spark, sf_dir):
    """Bias and individual-effect error against a known effect."""
    f = frame(spark, sf_dir).select((F.col("m1") - F.col("m0")).alias("ite"), F.lit(20.5).alias("truth"))
    return rounded(causal.effect_errors(f, "ite", "truth"))


_X = ["l_quantity", "l_extendedprice", "l_discount"]


@query("WITH z AS (SELECT " + ", ".join(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS {c}" for c in _X) + " FROM lineitem) " + " UNION ALL ".join(f"SELECT '{a}' AS i, '{b}' AS j, round(sum({a} * {b}) / (count(*) - 1), 4) AS s FROM z" for k, a in enumerate(_X) for b in _X[k:]))
def gram_matrix(spark, sf_dir):
    """Covariances of standardised columns, all pairs in one aggregation."""
    li = table(spark, sf_dir, "lineitem").select(*_X)
    one = li.agg(*[f(c).alias(f"{n}_{c}") for c in _X for n, f in (("m", F.avg), ("s", F.stddev_pop))], F.count(F.lit(1)).alias("n"))
    z = li.crossJoin(F.broadcast(one)).select("n", *[((F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")).alias(c) for c in _X])  # one row
    pairs = [(a, b) for k, a in enumerate(_X) for b in _X[k:]]
    sums = z.agg(F.min("n").alias("n"), *[F.sum(F.col(a) * F.col(b)).alias(f"{a}|{b}") for a, b in pairs])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), F.round(F.col(f"`{a}|{b}`") / (F.col("n") - 1), 4).alias("s")) for a, b in pairs])))


@query("SELECT l_orderkey, l_linenumber, " + ", ".join(f"round(({c} - (SELECT avg({c}) FROM lineitem WHERE l_returnflag = 'N')) / (SELECT stddev_pop({c}) FROM lineitem WHERE l_returnflag = 'N'), 6) AS z_{c[2:]}" for c in _X) + " FROM lineitem")
def zscore(spark, sf_dir):
    """Columns standardised by the normal class alone (population deviation)."""
    li = table(spark, sf_dir, "lineitem")
    one = li.where("l_returnflag = 'N'").agg(*[f(c).alias(f"{n}_{c}") for c in _X for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    return rounded(li.crossJoin(F.broadcast(one)).select("l_orderkey", "l_linenumber", *[((F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")).alias(f"z_{c[2:]}") for c in _X]))  # one row


@query("SELECT c_custkey, " + ", ".join(f"(c_mktsegment = '{s}')::INTEGER AS is_{s.lower()}" for s in ("AUTOMOBILE", "BUILDING", "FURNITURE")) + " FROM customer")
def onehot(spark, sf_dir):
    """One-hot columns of a fixed vocabulary; unknown values are all zero."""
    return table(spark, sf_dir, "customer").select("c_custkey", *[F.coalesce((F.col("c_mktsegment") == s).cast("int"), F.lit(0)).alias(f"is_{s.lower()}") for s in ("AUTOMOBILE", "BUILDING", "FURNITURE")])
