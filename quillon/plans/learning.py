"""Fitted models, sequential methods and seeded generators. Fits can't be had from SQL; tests hold them against definitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions.arrays import total
from quillon.io import table
from quillon.operators import forecasting, learners, metrics, pca
from quillon.plans.causal import frame
from quillon.plans.registry import query, rounded
from quillon.plans.resampling import _h
from quillon.plans.timeseries import HOURLY, hours
from quillon.sources import synthetic

def _unit(seed: int, *parts) -> str:
    return f"(({_h(f"'{seed}'", 'id', *[f"'{p}'" for p in parts])})::DOUBLE + 0.5) / 4294967296"


def _normal(seed: int, *parts) -> str:
    return f"sqrt(-2 * ln({_unit(seed, *parts, 'r')})) * cos(2 * pi() * {_unit(seed, *parts, 'a')})"


_X = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query()
def pca_reconstruction(spark, sf_dir):
    """Anomaly scores: PCA fitted on normal rows, reconstruction errors above a quantile of theirs."""
    li = table(spark, sf_dir, "lineitem").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    model = pca.fit(li.where("l_returnflag = 'N'"), _X, 0.7)
    found = pca.detect(model, li, li.where("l_returnflag = 'N'"), ["id", "l_returnflag"], 0.99)
    sums = found.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_anomaly").alias("n_anomalies"), F.avg("error").alias("mean_error"), F.max("error").alias("max_error"))
    return rounded(sums.join(metrics.quantile(found, "error", ["l_returnflag"], 0.5, "median_error"), "l_returnflag"))


@query()
def pca_components(spark, sf_dir):
    """Components in order of variance, signs fixed by the largest loading."""
    model = pca.fit(table(spark, sf_dir, "lineitem").where("l_returnflag = 'N'"), _X, 1.0)
    return spark.createDataFrame(model.rows(), "component int, feature string, loading double, variance_share double, cumulative double")


@query()
def logreg(spark, sf_dir):
    """Balanced logistic regression on standardised columns, held-out scores by hash folds."""
    return learners.held_out_scores(frame(spark, sf_dir), ["x1", "x2", "y"], "t", "c_custkey", "logistic")


@query()
def rf(spark, sf_dir):
    """Random forest with balanced weights, held-out scores by hash folds."""
    return learners.held_out_scores(frame(spark, sf_dir), ["x1", "x2", "y"], "t", "c_custkey", "forest")


@query()
def gbt(spark, sf_dir):
    """Gradient-boosted trees, held-out scores by hash folds."""
    return learners.held_out_scores(frame(spark, sf_dir), ["x1", "x2", "y"], "t", "c_custkey", "boosting")


@query()
def holt_winters(spark, sf_dir):
    """Additive damped Holt-Winters forecasts of the last day of each series."""
    return rounded(forecasting.holt_winters(hours(spark, sf_dir), 24, 24))


@query()
def recursive_forecast(spark, sf_dir):
    """One model step at a time, each prediction clipped and fed back as a lag."""
    return rounded(forecasting.recursive(hours(spark, sf_dir), 24))


@query(f"""WITH {HOURLY}, w AS (SELECT series, hour, y, CASE WHEN count(y) OVER p = 25 THEN (sum(y) OVER p - (lag(y, 12) OVER s + lead(y, 12) OVER s) / 2) / 24 END AS trend FROM h WINDOW s AS (PARTITION BY series ORDER BY hour), p AS (PARTITION BY series ORDER BY hour ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING)),
ph AS (SELECT series, hour % 24 AS phase, avg(y - trend) AS raw FROM w WHERE trend IS NOT NULL GROUP BY ALL), lv AS (SELECT series, avg(raw) AS level FROM ph GROUP BY series)
SELECT w.series, hour, y, round(trend, 6) AS trend, round(raw - level, 6) AS seasonal, round(y - trend - (raw - level), 6) AS remainder FROM w JOIN ph ON ph.series = w.series AND phase = hour % 24 JOIN lv ON lv.series = w.series""")
def seasonal_decomposition(spark, sf_dir):
    """Additive decomposition: centred moving average, hourly means of what is left, remainder."""
    return rounded(forecasting.decompose(hours(spark, sf_dir), 24))


@query()
def avg_linkage(spark, sf_dir):
    """Average-linkage clusters of label means."""
    e = table(spark, sf_dir, "embeddings")
    means = e.select("label", F.posexplode("embedding").alias("k", "x")).groupBy("label", "k").agg(F.avg("x").alias("x")).groupBy("label").agg(F.sort_array(F.collect_list(F.struct("k", "x"))).alias("v")).select("label", F.col("v.x").alias("v"))
    return learners.average_linkage(means, "label", "v", 4)


@query()
def lsa_embed(spark, sf_dir):
    """Latent semantic vectors of benchmark passages by a truncated SVD of their TF-IDF."""
    from quillon.operators import retrieval

    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return learners.lsa(retrieval.tfidf(b, min_df=1), 8)


_SHIFTS = " ".join(f"WHEN '{name}' THEN {v[0]}" for name, v in synthetic.ATTACKS.items())


@query(f"""WITH b AS (SELECT id, CASE WHEN id < 2000 THEN 'normal' {" ".join(f"WHEN id < {2000 + (k + 1) * 200} THEN '{name}'" for k, name in enumerate(synthetic.ATTACKS))} END AS scenario FROM range(2800) r(id)),
f AS (SELECT scenario, exp(6 + 0.8 * ({_normal(42, 'common')}) + 0.4 * ({_normal(42, 'b')})) * CASE scenario {_SHIFTS} ELSE 1 END AS bytes_sent FROM b) SELECT scenario, count(*) AS n, sum((scenario <> 'normal')::INT)::BIGINT AS n_anomalies, round(avg(bytes_sent), 3) AS mean_bytes FROM f GROUP BY scenario""")
def synth_flows(spark, sf_dir):
    """Seeded synthetic network flows, normal and four kinds of attack."""
    return synthetic.flows(spark, 2000, 200, seed=42).groupBy("scenario").agg(F.count(F.lit(1)).alias("n"), F.sum("is_anomaly").alias("n_anomalies"), F.round(F.avg("bytes_sent"), 3).alias("mean_bytes"))


@query(f"""WITH b AS (SELECT id, {_normal(7, 'x1')} AS x1, {_normal(7, 'x2')} AS x2 FROM range(2000) r(id)), s AS (SELECT *, ({_unit(7, 't')} < 1 / (1 + exp(-(0.8 * x1 - 0.5 * x2))))::INT AS t FROM b)
SELECT t, count(*) AS n, round(avg(1 + x1 - 0.5 * x2 + 2.0 * t + {_normal(7, 'e')}), 4) AS mean_y, 2.0::DOUBLE AS mean_effect FROM s GROUP BY t""")
def synth_scm(spark, sf_dir):
    """Seeded structural causal model with known individual effects."""
    return synthetic.structural(spark, "observed_confounding", 2000, seed=7).groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("y"), 4).alias("mean_y"), F.round(F.avg("ite"), 4).alias("mean_effect"))


@query(f"""WITH v AS (SELECT id % 3 AS cluster, [{", ".join(f"CASE WHEN id % 3 = {k % 3} THEN 0.8::DOUBLE ELSE 0.3::DOUBLE END {'+' if k < 6 else '-'} 0.1 * ({_unit(5, k % 6)} - 0.5)" for k in range(12))}] AS v FROM range(300) r(id))
SELECT cluster::INTEGER AS cluster, count(*) AS n, round(min(list_sum(v)), 6) AS least, round(max(list_sum(v)), 6) AS most FROM v GROUP BY cluster""")
def synth_fuzzy(spark, sf_dir):
    """Seeded clusters of fuzzy sets of constant cardinality."""
    f = synthetic.fuzzy_clusters(spark, 300, seed=5, epsilon=0.1)
    return f.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.round(F.min(total(F.col("v"))), 6).alias("least"), F.round(F.max(total(F.col("v"))), 6).alias("most"))
