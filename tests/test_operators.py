"""Operators on small fixtures whose answers can be worked out by hand."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import arrays, text
from quillon.operators import anomalies, causal, checks, forecasting, graph, learners, metrics, pca, retrieval, series, splits


def one(df):
    return df.first().asDict()


def test_fuzzy_similarities(spark):
    df = spark.createDataFrame([([0.2, 0.8], [0.4, 0.4]), ([0.0, 0.0], [0.0, 0.0])], "u array<double>, v array<double>")
    u, v = F.col("u"), F.col("v")
    got = df.select(arrays.jaccard(u, v), arrays.dice(u, v), arrays.cosine(u, v), arrays.balance(u, v), arrays.rational_similarity(u, v, {"ad2": 1.0}, {"ad2": 1.0, "b": 1.0, "g": 1.0}), arrays.is_fuzzy(u)).collect()
    assert got[0][0] == pytest.approx(0.6 / 1.2) and got[0][1] == pytest.approx(1.2 / 1.8)
    assert got[0][2] == pytest.approx((0.08 + 0.32) / (np.hypot(0.2, 0.8) * np.hypot(0.4, 0.4))) and got[0][3] == pytest.approx(0.9)
    assert got[0][4] == pytest.approx(0.36 / (0.36 + 0.6 * 0.6))
    assert tuple(got[1])[:3] == (1.0, 0.0, 0.0) and got[1][4] == 1.0 and got[1][5]


def test_cardinalities_add_up(spark):
    rng = random.Random(1)
    rows = [([rng.randint(0, 1000) / 1000 for _ in range(n)], [rng.randint(0, 1000) / 1000 for _ in range(n)]) for n in range(1, 13)]
    df = spark.createDataFrame(rows, "u array<double>, v array<double>")
    c = arrays.cardinalities(F.col("u"), F.col("v"))
    for r in df.select(F.size("u").alias("n"), *[x.alias(k) for k, x in c.items()]).collect():
        assert r["alpha"] + r["beta"] + r["gamma"] + r["delta"] == pytest.approx(r["n"])


def test_text_functions(spark):
    df = spark.createDataFrame([("RNA-seq, Version 2!",), ("Éa-b_1 ß2",)], "t string")
    assert [r[0] for r in df.select(text.tokens(F.col("t"))).collect()] == [["rna", "seq", "version", "2"], ["éa", "b_1", "ß2"]]
    doi = spark.createDataFrame([("https://doi.org/10.1000/ABC",), ("doi: 10.12/x",), ("10.1234/é x",)], "d string")
    assert [r[0] for r in doi.select(text.normal_doi(F.col("d"))).collect()] == ["10.1000/abc", None, None]
    assert one(spark.range(1).select(text.crlf(F.lit("a\r\nb\rc\nd")).alias("x")))["x"] == "a\r\nb\r\nc\r\nd"


def ranked(spark):
    docs = spark.createDataFrame([(7, "A repeated enzyme inhibition mechanism."), (2, "enzyme inhibition"), (9, "enzyme inhibition"), (5, "")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "enzyme inhibition")], "id long, text string")
    return retrieval.top(retrieval.bm25(retrieval.build(docs), retrieval.query_terms(q, "id", "text")), 10)


def test_bm25_order_and_ties(spark):
    assert [r["doc_id"] for r in ranked(spark).orderBy("rank").collect()] == [2, 9, 7]


def test_index_can_be_loaded_again(spark, tmp_path):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 17}" for k in range(1, 4 + i % 9))) for i in range(60)] + [(100, None), (101, " . ")], "doc_id long, text string")
    terms = retrieval.query_terms(spark.createDataFrame([(1, "w3 w5 w16 unknown"), (2, "w0 w1")], "id long, text string"), "id", "text")
    built = retrieval.build(docs)
    built.write(str(tmp_path / "index"))
    loaded = retrieval.load(spark, str(tmp_path / "index"))
    assert one(loaded.size) == one(built.size) and one(loaded.size)["n_docs"] == 60 and loaded.lengths.count() == 60
    rows = lambda index: sorted((r["query_id"], r["doc_id"], round(r["score"], 9)) for r in retrieval.bm25(index, terms).collect())
    assert rows(loaded) == rows(built) == rows(retrieval.build(docs, only=terms)) and rows(built)
    n, average = 60, sum(3 + i % 9 for i in range(60)) / 60
    words = {i: [f"w{(i * k) % 17}" for k in range(1, 4 + i % 9)] for i in range(60)}
    df = {t: sum(t in w for w in words.values()) for t in ("w0", "w1")}
    naive = {i: sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / average)) for t in ("w0", "w1") if t in w) for i, w in words.items()}
    assert {i: s for q, i, s in rows(built) if q == 2} == pytest.approx({i: s for i, s in naive.items() if s})


def test_closure_has_no_depth_limit(spark):
    ring = spark.range(16).selectExpr("id AS src", "(id + 1) % 16 AS dst")
    assert graph.closure(ring).count() == 256 and graph.cycles(ring).count() == 16
    assert {(r["src"], r["dst"]): r["depth"] for r in graph.closure(ring).collect()} == {(a, b): (b - a - 1) % 16 + 1 for a in range(16) for b in range(16)}
    chain = graph.closure(spark.range(1000).selectExpr("id AS src", "id + 1 AS dst"))
    assert chain.count() == 1000 * 1001 // 2 and chain.where("depth != dst - src").count() == 0


def test_retrieval_metrics(spark):
    hits = spark.createDataFrame([(1, 1, 10), (1, 2, 12), (2, 1, 99), (2, 2, 11)], "query_id long, rank int, doc_id long")
    gold = spark.createDataFrame([(1, 10), (1, 12), (2, 11)], "query_id long, doc_id long")
    m = one(retrieval.metrics(hits, gold, (1, 2)))
    assert (m["query_recall_1"], m["query_recall_2"], m["mrr"]) == (0.5, 1.0, 0.75)
    assert m["doc_recall_1"] == pytest.approx(1 / 3) and m["doc_recall_2"] == 1.0


def auc_by_hand(rows):
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    return sum((p > n) + 0.5 * (p == n) for p, n in itertools.product(pos, neg)) / (len(pos) * len(neg))


def test_ranking_metrics(spark):
    rng = random.Random(4)
    rows = [(rng.randint(0, 20) / 20, rng.randint(0, 1)) for _ in range(200)]
    df = spark.createDataFrame(rows, "score double, label int")
    assert one(metrics.roc_auc(df))["roc_auc"] == pytest.approx(auc_by_hand(rows))
    n_pos, ap, seen, hit = sum(y for _, y in rows), 0.0, 0, 0
    for s in sorted({s for s, _ in rows}, reverse=True):
        fresh = [y for t, y in rows if t == s]
        seen, hit = seen + len(fresh), hit + sum(fresh)
        ap += sum(fresh) / n_pos * hit / seen
    assert one(metrics.average_precision(metrics.pr_points(df)))["average_precision"] == pytest.approx(ap)
    assert one(metrics.roc_auc(df.where("label = 1")))["roc_auc"] is None


def test_confusion_and_report(spark):
    df = spark.createDataFrame([(0, 0.9), (1, 0.8), (0, 0.1), (1, 0.2), (0, 0.1), (1, 0.9), (0, 0.7), (1, 0.6)], "y int, p double")
    r = one(metrics.confusion_by(df, [], F.col("y"), F.col("p") >= 0.5))
    assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (3, 2, 1, 2) and r["f1"] == pytest.approx(6 / 9)
    empty = one(metrics.confusion_by(df.where("y = 0 and p < 0.5"), [], F.col("y"), F.col("p") >= 0.5))
    assert empty["precision"] == 0.0
    bins = metrics.probability_bins(df, "p", "y").orderBy("bin").collect()
    assert len(bins) == 10 and sum(b["n"] for b in bins) == 8 and bins[4]["rate"] is None


def test_adjusted_rand(spark):
    same = spark.createDataFrame([(i % 3, (i + 1) % 3) for i in range(30)], "a int, b int")
    assert one(metrics.adjusted_rand(same, "a", "b"))["adjusted_rand"] == pytest.approx(1.0)


def series_frame(spark, values):
    return spark.createDataFrame([("s", h, float(y), 1) for h, y in enumerate(values)], "series string, hour long, y double, n long")


def test_lags_rolling_and_acf(spark):
    h = series_frame(spark, range(10))
    r = series.with_rolling(series.with_lags(h, (1, 3)), (4,)).orderBy("hour").collect()
    assert r[0]["lag_1"] is None and r[5]["lag_3"] == 2 and r[3]["mean_4"] is None
    assert r[4]["mean_4"] == 1.5 and r[4]["std_4"] == pytest.approx(np.std([0, 1, 2, 3]))
    assert one(series.autocorrelation(h, (1,)))["acf_1"] == pytest.approx(1.0)


def test_baselines_by_folds(spark):
    y = [float((t * 7) % 13) for t in range(60)]
    got = series.baseline_residuals(series_frame(spark, y), 24, 12, 24).collect()
    folds = {r["fold"] for r in got}
    assert folds == {0, 1, 2}
    for r in got:
        end = 24 + 12 * r["fold"]
        expected = {"mean": np.mean(y[:end]), "naive": y[end - 1], "seasonal_naive": y[end - 24 + (r["place"] - end) % 24]}[r["model"]]
        assert r["forecast"] == pytest.approx(expected) and end <= r["place"] < end + 12


def test_anomaly_labels_and_episodes(spark):
    values = [-3, -2, -1, 0, 1, 2, 3] * 10 + [100, -100, 250]
    rows = [("s", i, 0.0, 0.0, float(v), i == 72) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "series string, hour long, actual double, forecast double, residual double, closure boolean")
    lab = anomalies.label(df).orderBy("hour").collect()
    assert [r["hour"] for r in lab if r["actionable"]] == [70, 71] and lab[72]["kind"] == "closure"
    assert one(anomalies.robust_scale(df))["mad"] == 2.0
    (e,) = anomalies.episodes(anomalies.label(df)).collect()
    assert (e["start_hour"], e["end_hour"], e["duration"], e["direction"]) == (70, 71, 2, "mixed")


def test_episode_gaps(spark):
    rows = [("s", h, 1.0, 0.0, 1.0, False, 4.0, True, True, "positive", "moderate") for h in (1, 2, 5, 6, 7, 10)]
    df = spark.createDataFrame(rows, "series string, hour long, actual double, forecast double, residual double, closure boolean, z double, is_statistical boolean, actionable boolean, kind string, severity string")
    got = anomalies.episodes(df).orderBy("episode").collect()
    assert [(e["start_hour"], e["end_hour"]) for e in got] == [(1, 2), (5, 7), (10, 10)]


def test_causal_fixtures(spark):
    d = one(causal.difference(spark.createDataFrame([(0, 1.0), (0, 2.0), (0, 3.0), (1, 3.0), (1, 4.0), (1, 5.0)], "t int, y double")))
    assert d["effect"] == 2 and d["se"] == pytest.approx(np.sqrt(2 / 3))
    x = [-1, -1, 0, 0, 1, 1, 2, 2] * 12
    rows = [(i % 2, float(v), float(v + 1), 0.5, float(v)) for i, v in enumerate(x)]
    f = spark.createDataFrame(rows, "t int, x double, z double, p double, y double")
    assert all(r["smd"] == pytest.approx(0) for r in causal.mean_differences(f, ["x", "z"]).collect())
    w = one(causal.weighting(f))
    assert w["ess0"] == pytest.approx(48) and w["ess1"] == pytest.approx(48) and w["overlap"] == 1 and w["max_weight"] == 2
    beta, se = causal.least_squares(f.withColumn("out", 2 * F.col("t") + 3 * F.col("x") + 1), ["t", "x"], "out")
    assert beta == pytest.approx([1, 2, 3]) and max(se) < 1e-6
    with pytest.raises(ValueError):
        causal.least_squares(f, ["x", "z"], "y")
    assert one(spark.range(1).select(causal.e_value(F.lit(2.0)).alias("e")))["e"] == pytest.approx(2 + np.sqrt(2))


def test_graph(spark):
    e = spark.createDataFrame([("X", "T"), ("X", "Y"), ("T", "Y"), ("Y", "Z")], "src string, dst string")
    assert {(r["src"], r["dst"], r["depth"]) for r in graph.closure(e).collect()} == {("X", "T", 1), ("X", "Y", 1), ("T", "Y", 1), ("Y", "Z", 1), ("X", "Z", 2), ("T", "Z", 2)}
    assert graph.cycles(e).count() == 0
    assert {r[0] for r in graph.cycles(e.union(spark.createDataFrame([("Y", "X")], "src string, dst string"))).collect()} == {"X", "T", "Y"}
    chain = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 40)], "a long, b long")
    assert {(r["node"], r["label"]) for r in graph.components(chain).collect()} == {(i, 0) for i in range(21)} | {(40, 40), (50, 40)}
    order = spark.createDataFrame([("X", 0), ("T", 1), ("Y", 0), ("Z", 3)], "name string, time_order int")
    assert [tuple(r) for r in graph.audit(e, order).collect()] == [("T", "Y")]


def test_contracts(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert checks.require(df, ["k", "v"], ["k"], {"positive": "k > 0"}) is df
    for bad in (dict(columns=["v", "k"]), dict(keys=["k"]), dict(checks={"small": "k < 2"})):
        with pytest.raises(ValueError):
            checks.require(df.union(df), **bad)
    right = spark.createDataFrame([(1, 10), (2, 20)], "k int, w int")
    assert checks.joined(df, right, ["k"]).count() == 2
    with pytest.raises(ValueError):
        checks.joined(df, right.where("k = 1"), ["k"])
    with pytest.raises(ValueError):
        checks.joined(df, right.union(right), ["k"])


def test_splits(spark):
    df = spark.range(500).withColumn("g", (F.col("id") % 3).cast("string"))
    a, b = (sorted(r["id"] for r in splits.hash_sample(df, "id", "s", 20).collect()) for _ in range(2))
    assert a == b and len(a) == 20
    s = splits.stratified(df, "g", "id", "x", 0.2).groupBy("g").agg(F.count_if("is_test").alias("n")).collect()
    assert {r["g"]: r["n"] for r in s} == {"0": 34, "1": 34, "2": 34}


def test_pca_equals_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 2)) @ np.array([[1.0, 0.5, 0.2], [0.0, 1.0, -0.7]]) + rng.normal(scale=0.1, size=(300, 3))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, a double, b double, c double")
    model = pca.fit(df, ["a", "b", "c"], 0.9)
    z = (x - x.mean(0)) / x.std(0)
    values, vectors = np.linalg.eigh(np.cov(z.T))
    keep = vectors[:, np.argsort(-values)][:, : len(model.loadings)]
    expected = ((z - z @ keep @ keep.T) ** 2).mean(1)
    got = {r["id"]: r["error"] for r in pca.detect(model, df, df, ["id"], 0.99).collect()}
    assert [got[i] for i in range(300)] == pytest.approx(list(expected), abs=1e-8)
    with pytest.raises(ValueError):
        pca.fit(df.withColumn("c", F.lit(1.0)), ["a", "c"], 0.9)


def test_forecasts_follow_a_season(spark):
    y = [10 + 5 * np.sin(2 * np.pi * t / 24) for t in range(24 * 8)]
    for f in (forecasting.holt_winters(series_frame(spark, y), 24, 24), forecasting.recursive(series_frame(spark, y), 24)):
        r = f.collect()
        assert len(r) == 24 and max(abs(x["actual"] - x["forecast"]) for x in r) < 1.0
    d = forecasting.decompose(series_frame(spark, y), 24).where("trend is not null").collect()
    assert max(abs(x["remainder"]) for x in d) < 1e-6 and max(abs(x["trend"] - 10) for x in d) < 1e-6


def test_average_linkage(spark):
    points = [(i, [float(np.cos(a)), float(np.sin(a))]) for i, a in enumerate([0, 0.05, 0.1, 1.5, 1.55, 3.0])]
    got = {r["id"]: r["cluster"] for r in learners.average_linkage(spark.createDataFrame(points, "id long, v array<double>"), "id", "v", 3).collect()}
    assert got[0] == got[1] == got[2] and got[3] == got[4] and len(set(got.values())) == 3
