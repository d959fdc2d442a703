"""Studies, exact order statistics, pairs, forecasters, settings and workflows against plain versions."""

import itertools
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon import workflows
from quillon.functions.text import hash_unit
from quillon.operators import effects, forecasting, graph, learners, metrics, pairs, pca, splits, studies
from quillon.sources import config, files


def test_order_statistics_and_quantiles(spark):
    rng = np.random.default_rng(5)
    groups = {"ties": rng.integers(0, 4, 300).astype(float), "wide": np.exp(5 * rng.normal(size=400)), "one": np.array([7.0]), "same": np.full(50, -2.5)}
    df = spark.createDataFrame([(g, float(x)) for g, xs in groups.items() for x in xs] + [("wide", None), ("none", None)], "g string, x double")
    for buckets in (3, 1000):
        for rank in (1, 7, 250):
            got = {r["g"]: r["x"] for r in metrics.order_statistic(df, "x", ["g"], F.lit(rank), buckets).collect()}
            assert got == {g: float(np.sort(xs)[rank - 1]) if len(xs) >= rank else None for g, xs in groups.items()}
    for q in (0.0, 0.1, 1 / 3, 0.5, 0.99, 1.0):
        got = {r["g"]: r["quantile"] for r in metrics.quantile(df, "x", ["g"], q).collect()}
        assert got == pytest.approx({g: float(np.quantile(xs, q)) for g, xs in groups.items()})
        assert metrics.quantile(df, "x", [], q).first()[0] == pytest.approx(float(np.quantile(np.concatenate(list(groups.values())), q)))


def test_average_ranks_with_few_buckets(spark):
    rng = np.random.default_rng(6)
    rows = [(int(g), float(x)) for g, x in zip(rng.integers(0, 3, 500), rng.integers(0, 60, 500) ** 2)]
    got = metrics.average_ranks(spark.createDataFrame(rows, "g int, x double"), "x", ["g"], buckets=7).collect()
    assert len(got) == 500
    for r in got:
        mine = [x for g, x in rows if g == r["g"]]
        assert r["rank_x"] == sum(x < r["x"] for x in mine) + (sum(x == r["x"] for x in mine) + 1) / 2


@pytest.mark.parametrize("chunk", [16_000_000, 200])
def test_nearest_in_chunks_and_tiles(spark, monkeypatch, chunk):
    monkeypatch.setattr(pairs, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(pairs, "TILE", 7)
    monkeypatch.setattr(pairs, "QUERY_TILE", 3)
    rng = np.random.default_rng(9)
    x = rng.integers(0, 3, (90, 3)).astype(float)
    df = spark.createDataFrame([(i, list(map(float, v)), i % 4) for i, v in enumerate(x)], "id long, v array<double>, part int").repartition(4)
    asked = df.where("id % 10 = 0")
    dist = np.sqrt(((x[:, None] - x[None, :]) ** 2).sum(2))
    got = sorted((r["query_id"], r["rank"], r["id"]) for r in pairs.nearest(df, asked, "id", "v", pairs.distance, 5, near_is_large=False, within=1.5).collect())
    expected = [(q, k + 1, j) for q in range(0, 90, 10) for k, j in enumerate(sorted((j for j in range(90) if j != q and dist[q, j] <= 1.5), key=lambda j: (round(dist[q, j], 9), j))[:5])]
    assert got == expected
    by_part = sorted((r["query_id"], r["part"], r["rank"], r["id"]) for r in pairs.nearest(df, asked, "id", "v", lambda q, c: q @ c.T, 2, group="part").collect())  # any similarity
    dot = x @ x.T
    assert by_part == [(q, g, k + 1, j) for q in range(0, 90, 10) for g in range(4) for k, j in enumerate(sorted((j for j in range(g, 90, 4) if j != q), key=lambda j: (-dot[q, j], j))[:2])]
    s = {r["same_label"]: (r["n"], r["least"], r["most"], r["mean_similarity"]) for r in pairs.summary(df, asked, "id", "v", pairs.distance, "part").collect()}
    for same in (True, False):
        values = [dist[q, j] for q in range(0, 90, 10) for j in range(90) if j != q and (q % 4 == j % 4) == same]
        assert s[same] == (len(values), pytest.approx(min(values)), pytest.approx(max(values)), pytest.approx(np.mean(values)))
    assert pairs.nearest(df, asked.limit(0), "id", "v", pairs.distance, 5).count() == 0


def test_numbering_goes_on_over_ranges(spark):
    df = spark.range(0, 3000, 3).withColumnRenamed("id", "k").repartition(7)
    assert [(r["k"], r["_i"]) for r in splits.numbered(df, "k").orderBy("k").collect()] == [(3 * i, i) for i in range(1000)]


def stumps_by_hand(y, lags, rounds, rate, bins, steps):
    """Boosted one-split trees, every split tried by a loop."""
    places = range(max(lags), len(y))
    x, goal = [[y[t - k] for k in lags] for t in places], [y[t] for t in places]
    base = sum(goal) / len(goal)
    left, trees = [g - base for g in goal], []
    for _ in range(rounds):
        best = None
        for j in range(len(lags)):
            for cut in np.unique(np.quantile([r[j] for r in x], np.linspace(0, 1, bins + 1)[1:-1])):
                low, high = [e for r, e in zip(x, left) if r[j] <= cut], [e for r, e in zip(x, left) if r[j] > cut]
                if low and high:
                    gain = sum(low) ** 2 / len(low) + sum(high) ** 2 / len(high)
                    if best is None or gain > best[0] + 1e-9:
                        best = gain, j, cut, rate * sum(low) / len(low), rate * sum(high) / len(high)
        _, j, cut, low, high = best
        trees.append((j, cut, low, high))
        left = [e - (low if r[j] <= cut else high) for r, e in zip(x, left)]
    y = list(y)
    for _ in range(steps):
        row = [y[-k] for k in lags]
        y.append(max(0.0, base + sum(low if row[j] <= cut else high for j, cut, low, high in trees)))
    return y[-steps:]


def test_boosted_trees_equal_a_plain_version(spark):
    rng = np.random.default_rng(2)
    y = [float(20 + 10 * math.sin(2 * math.pi * t / 24) + rng.normal()) for t in range(150)]
    model = forecasting.Boosted(lags=(1, 3, 24), rounds=12, bins=8)
    model.fit(np.array(y))
    assert list(model.predict(10)) == pytest.approx(stumps_by_hand(y, (1, 3, 24), 12, 0.2, 8, 10))
    h = spark.createDataFrame([(s, t, y[t] + k) for k, s in enumerate("ab") for t in range(150)] + [("short", t, 1.0) for t in range(30)], "series string, hour long, y double")
    got = forecasting.forecast_with(h, forecasting.Boosted, 24, 72)
    assert got.groupBy("series").count().collect() and {r["series"] for r in got.collect()} == {"a", "b"}
    errors = got.agg(F.avg(F.abs(F.col("actual") - F.col("forecast")))).first()[0]
    assert errors < got.join(h.groupBy("series").agg(F.avg("y").alias("m")), "series").agg(F.avg(F.abs(F.col("actual") - F.col("m")))).first()[0] / 2


def test_unit_root_and_partial_autocorrelation_equal_least_squares(spark):
    rng = np.random.default_rng(3)
    y = np.cumsum(rng.normal(size=200))
    h = spark.createDataFrame([("s", t, float(v)) for t, v in enumerate(y)], "series string, hour long, y double")
    d = np.diff(y)
    x = np.column_stack([np.ones(198), y[1:-1], d[:-1]])
    beta, *_ = np.linalg.lstsq(x, d[1:], rcond=None)
    rest = d[1:] - x @ beta
    t = beta[1] / math.sqrt(rest @ rest / (198 - 3) * np.linalg.inv(x.T @ x)[1, 1])
    assert forecasting.unit_root(h).first()["statistic"] == pytest.approx(t)
    r = [0.8, 0.5, 0.45, 0.3]
    got = spark.range(1).select(*[c.alias(f"p{k}") for k, c in enumerate(forecasting.partial_autocorrelations([F.lit(v) for v in r]))]).first()
    for k in range(1, 5):
        m = np.array([[1.0 if i == j else r[abs(i - j) - 1] for j in range(k)] for i in range(k)])
        assert got[k - 1] == pytest.approx(np.linalg.solve(m, np.array(r[:k]))[-1])


def test_holt_winters_and_recursive_equal_their_recurrences(spark):
    y = [float(10 + 3 * (t % 4) + 0.1 * t) for t in range(60)]
    h = spark.createDataFrame([("s", t, v) for t, v in enumerate(y)], "series string, hour long, y double")
    got = [r["forecast"] for r in forecasting.holt_winters(h, 4, 4).orderBy("hour").collect()]
    past, best = y[:-4], None
    for a, b, g, phi in itertools.product((0.1, 0.3), (0.01, 0.1), (0.1, 0.3), (0.9, 0.98)):
        first = sum(past[:4]) / 4
        level, trend, season, sse = first, 0.0, [v - first for v in past[:4]], 0.0
        for t in range(4, len(past)):
            sse += (past[t] - level - phi * trend - season[t - 4]) ** 2
            new = a * (past[t] - season[t - 4]) + (1 - a) * (level + phi * trend)
            trend, level = b * (new - level) + (1 - b) * phi * trend, new
            season.append(g * (past[t] - level) + (1 - g) * season[t - 4])
        if best is None or sse < best[0]:
            best = sse, [max(0, level + sum(phi**k for k in range(1, s + 1)) * trend + season[len(past) - 4 + (s - 1) % 4]) for s in range(1, 5)]
    assert got == pytest.approx(best[1])
    walked, lags = list(past), (1, 2, 24)
    x = np.array([[1.0, *[past[t - k] for k in lags]] for t in range(24, len(past))])
    beta = np.linalg.solve(x.T @ x + 1e-6 * np.eye(4), x.T @ np.array(past[24:]))
    for _ in range(4):
        walked.append(max(0.0, float(beta @ [1.0, *[walked[-k] for k in lags]])))
    assert [r["forecast"] for r in forecasting.recursive(h, 4).orderBy("hour").collect()] == pytest.approx(walked[-4:])


def test_pca_equals_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 3)) @ np.array([[2, 0.5, 0], [0, 1, 0.3], [0, 0, 0.4]]) + [5, -2, 1]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double")
    model = pca.fit(df, ["a", "b", "c"], 0.6)
    z = (x - x.mean(0)) / x.std(0)
    values, vectors = np.linalg.eigh(np.cov(z.T))
    assert model.variance == pytest.approx(values[::-1])
    kept = vectors[:, ::-1][:, : len(model.loadings)].T
    assert np.abs(model.loadings) == pytest.approx(np.abs(kept))
    error = ((z - z @ kept.T @ kept) ** 2).mean(1)
    assert len(kept) < 3
    found = pca.detect(model, df, df, ["id"], 0.95).orderBy("id").collect()
    assert [r["error"] for r in found] == pytest.approx(error)
    assert [r["is_anomaly"] for r in found] == list(error > np.quantile(error, 0.95))
    assert all(ok for _, ok in pca.checks(pca.fit(df, ["a", "b", "c"], 1.0), df.limit(50)))


@pytest.mark.parametrize("kind", sorted(learners.CANDIDATES))
def test_learners_find_what_is_there(spark, kind):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(600, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] + 0.5 * rng.normal(size=600) > 0).astype(int)
    df = spark.createDataFrame([(i, *map(float, r), int(t), i // 10) for i, (r, t) in enumerate(zip(x, y))], "id long, a double, b double, c double, y int, g int")
    for group in (None, "g"):
        found = learners.held_out_scores(df, ["a", "b", "c"], "y", "id", kind, group=group)
        assert found.count() == 600 and 0.88 < metrics.roc_auc(found).first()["roc_auc"] < 0.99
        if group:
            folds = found.join(df.select("id", "g"), "id").groupBy("g").agg(F.count_distinct("fold").alias("n"))
            assert folds.agg(F.max("n")).first()[0] == 1
    if kind == "logistic":
        table = learners.introspection(df, ["a", "b", "c"], "y")
        assert [q for m, q, _ in table if m == "logistic"] == ["coefficient a", "coefficient b", "coefficient c"] and table[3][1] == "importance a"
        assert [v for m, q, v in table if q == "greatest depth"][0] <= 5


def test_average_linkage_equals_a_plain_version(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(14, 5))
    z = x / np.linalg.norm(x, axis=1, keepdims=True)
    s, groups = z @ z.T, [[i] for i in range(14)]
    while len(groups) > 4:
        a, b = max(itertools.combinations(range(len(groups)), 2), key=lambda p: np.mean([s[i, j] for i in groups[p[0]] for j in groups[p[1]]]))
        groups = [g for k, g in enumerate(groups) if k not in (a, b)] + [groups[a] + groups[b]]
    got = learners.average_linkage(spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "id long, v array<double>"), "id", "v", 4).collect()
    found = {}
    for r in got:
        found.setdefault(r["cluster"], set()).add(r["id"])
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, groups))


def test_lsa_equals_a_singular_value_decomposition(spark):
    rng = np.random.default_rng(13)
    m = np.abs(rng.normal(size=(9, 20))) * (rng.random((9, 20)) < 0.5)
    w = spark.createDataFrame([(i, f"t{j}", float(m[i, j])) for i in range(9) for j in range(20) if m[i, j]], "doc_id long, term string, weight double")
    got = np.array([r["vector"] for r in learners.lsa(w, 4).orderBy("doc_id").collect()])
    u, d, _ = np.linalg.svd(m)
    z = u[:, :4] * d[:4]
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    assert got @ got.T == pytest.approx(z @ z.T)


def test_nested_neighbours_equal_a_plain_version(spark):
    rng = np.random.default_rng(14)
    x, y = rng.normal(size=(80, 4)), None
    y = (x[:, 0] + 0.3 * rng.normal(size=80) > 0).astype(int)
    df = spark.createDataFrame([(i, list(map(float, v)), int(t)) for i, (v, t) in enumerate(zip(x, y))], "id long, v array<double>, y int")
    folds = {r["id"]: r["f"] for r in df.select("id", (hash_unit(F.lit("nest"), F.col("id").cast("string")) % 3).alias("f")).collect()}
    z = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = z @ z.T

    def auc(asked, pool, k):
        rows = []
        for i in asked:
            near = sorted((j for j in pool(i) if j != i), key=lambda j: (-s[i, j], j))[:k]
            w = [max(s[i, j], 0) for j in near]
            rows.append((round(sum(a * y[j] for a, j in zip(w, near)) / sum(w), 9) if sum(w) else 0.5, y[i]))
        pos, neg = [a for a, t in rows if t], [a for a, t in rows if not t]
        return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))

    for r in learners.nested_neighbours(df, "id", "v", F.col("y") == 1, (3, 9), 3).collect():
        inner = {k: auc([i for i in range(80) if folds[i] != r["fold"]], lambda i: [j for j in range(80) if folds[j] not in (r["fold"], folds[i])], k) for k in (3, 9)}
        best = max((3, 9), key=lambda k: (inner[k], -k))
        assert (r["k"], r["inner_auc"]) == (best, pytest.approx(inner[best]))
        assert r["outer_auc"] == pytest.approx(auc([i for i in range(80) if folds[i] == r["fold"]], lambda i: [j for j in range(80) if folds[j] != r["fold"]], best))


def test_adjustment_sets_close_all_back_doors():
    edges = [("x", "t"), ("x", "y"), ("z", "t"), ("z", "w"), ("w", "y"), ("t", "m"), ("m", "y")]

    def paths(a, b, seen=()):
        if a == b:
            yield [b]
            return
        for s, d in edges:
            for n in ({s, d} - {a} if a in (s, d) else ()):
                if n not in seen and n != a:
                    for rest in paths(n, b, (*seen, a)):
                        yield [a, *rest]

    below = {"t": {"m", "y"}, "m": {"y"}, "x": {"t", "y", "m"}, "z": {"t", "w", "y", "m"}, "w": {"y"}, "y": set()}

    def blocked(path, given):
        for a, v, b in zip(path, path[1:], path[2:]):
            collider = (a, v) in edges and (b, v) in edges
            if (not collider and v in given) or (collider and v not in given and not below[v] & given):
                return True
        return False

    back = [p for p in paths("t", "y") if (p[1], "t") in edges]
    sound = [set(c) for n in range(4) for c in itertools.combinations("wxz", n) if all(blocked(p, set(c)) for p in back)]
    least = [c for c in sound if not any(o < c for o in sound)]
    assert sorted(map(sorted, effects.adjustment_sets(edges, "t", "y", ["x", "z", "w", "m"]))) == sorted(map(sorted, least)) == [["w", "x"], ["x", "z"]]
    with pytest.raises(ValueError):
        effects.adjustment_sets([(f"v{i}", "t") for i in range(20)], "t", "y", [f"v{i}" for i in range(20)])


def test_archives_and_bundles(spark, tmp_path):
    np.savez(tmp_path / "a.npz", x=np.arange(24.0).reshape(4, 2, 3), y=np.arange(12.0).reshape(4, 3))
    rows = files.npz_replication(spark, str(tmp_path / "a.npz"), 1).orderBy("row").collect()
    assert [tuple(r) for r in rows] == [(i, 6.0 * i + 1, 6.0 * i + 4, 3.0 * i + 1) for i in range(4)]
    with pytest.raises(ValueError):
        files.npz_replication(spark, str(tmp_path / "a.npz"), 3)
    (tmp_path / "train.csv").write_text("k,v\n1,2\n")
    (tmp_path / "words.csv").write_bytes("name\ncafé €\n".encode("cp1252"))
    got = files.bundle(spark, str(tmp_path), {"train": ("k int, v int", "UTF-8"), "words": ("name string", "windows-1252")})
    assert got["train"].first()["v"] == 2 and got["words"].first()["name"] == "café €"
    with pytest.raises(ValueError):
        files.bundle(spark, str(tmp_path), {"train": ("k int, v int", "UTF-8"), "test": ("k int, v int", "UTF-8")})


def test_repair_loop_stops_and_keeps_its_journal(spark, tmp_path):
    tasks = spark.range(6).withColumnRenamed("id", "task")
    seen = []

    def attempt(left, i):
        seen.append(left.count())
        return left.select("task", (F.col("task") < 2 * i).alias("success"))

    found = studies.repair_loop(tasks, attempt, "task", 5, journal=lambda made: files.append_journal(made, str(tmp_path / "j")))
    rows = {(r["task"], r["iteration"], r["success"]) for r in found.collect()}
    assert seen == [6, 4, 2] and rows == {(t, i, t < 2 * i) for t in range(6) for i in range(1, 4) if t >= 2 * (i - 1)}
    assert spark.read.json(str(tmp_path / "j")).count() == len(rows)


def test_acquire_rounds_and_random_policy(spark):
    pool = spark.range(200).selectExpr("id", "cast(id % 17 AS double) AS u")
    got = studies.acquire(pool, "id", 10, 5, 3, lambda p, c: F.col("u"), "s").collect()
    start = {r["id"] for r in got if r["round"] == 0}
    assert len(start) == 10 and len({r["id"] for r in got}) == 25
    for k in (1, 2, 3):
        before = {r["id"] for r in got if r["round"] < k}
        assert min(r["id"] % 17 for r in got if r["round"] == k) >= max(sorted((i % 17 for i in range(200) if i not in before), reverse=True)[4:5])
    again = studies.acquire(pool, "id", 10, 5, 1, lambda p, c: F.lit(0), "s").where("round = 1").collect()
    assert len(again) == 5 and not {r["id"] for r in again} & start


def test_study_stops_at_its_cap(spark, tmp_path):
    tasks, begun = spark.range(20).withColumnRenamed("id", "task").repartition(5), []

    def arm(name, cost):
        def attempt(left):
            begun.append(name)
            return left.select("task", F.lit(cost).alias("usd"))

        return attempt

    found = studies.run_study(tasks, {"a": arm("a", 1.0), "b": arm("b", 2.0), "c": arm("c", 1.0)}, "task", "usd", 35.0, journal=lambda made: files.append_journal(made, str(tmp_path / "j"))).collect()
    assert begun == ["a", "b"] and {(r["arm"], r["task"], r["spent"]) for r in found} == {("a", i, i + 1.0) for i in range(20)} | {("b", i, 22.0 + 2 * i) for i in range(7)}
    assert spark.read.json(str(tmp_path / "j")).count() == len(found)


def test_counterexamples_of_claims(spark):
    first = studies.counterexample(spark, ["x", "y"], [-1, 0, 1, 2, 3], 2, "x * x + y * y >= x * d OR y > 0", "x * x + y * y - x * d").first()
    assert (first["x"], first["y"], first["observed"]) == (1, 0, -1)
    assert studies.counterexample(spark, ["x"], list(range(-9, 10)), 4, "x * x >= 0", "x").count() == 0


def test_fold_inputs(spark):
    rows = spark.range(6).withColumnRenamed("id", "k")
    folds = rows.select("k", F.lit(0).alias("fold"), F.when(F.col("k") < 2, "test").otherwise("train").alias("part"))
    train, test = studies.fold_inputs(folds, rows, "k", 0)
    assert train.count() == 4 and test.count() == 2
    with pytest.raises(ValueError):
        studies.fold_inputs(folds, rows, "k", 1)


def test_graph_from_mapping(spark):
    variables, edges = graph.from_mapping(spark, {"variables": [{"name": "x", "time_order": 0}, {"name": "t", "role": "treatment", "time_order": 1}, {"name": "y", "observed": False}], "edges": [["x", "t"], ["t", "y"], ["x", "t"]]})
    assert variables.count() == 3 and [tuple(r) for r in edges.collect()] == [("t", "y"), ("x", "t")]
    names = [{"name": n} for n in "abc"]
    for bad in ([["a", "b"], ["b", "c"], ["c", "a"]], [["a", "a"]], [["a", "z"]]):
        with pytest.raises(ValueError):
            graph.from_mapping(spark, {"variables": names, "edges": bad})
    with pytest.raises(ValueError):
        graph.from_mapping(spark, {"variables": names + names, "edges": []})


def test_settings_have_exact_keys(tmp_path):
    p = tmp_path / "a.json"
    keys = {"name": str, "k": int, "inner": {"share": (int, float)}}
    for text, ok in (('{"name": "x", "k": 1, "inner": {"share": 0.5}}', True), ('{"name": "x", "k": 1}', False), ('{"name": "x", "k": 1, "inner": {"share": 0.5}, "more": 1}', False), ('{"name": "x", "k": true, "inner": {"share": 0.5}}', False), ('{"name": "x", "k": 1, "k": 2, "inner": {"share": 1}}', False), ('{"name": 3, "k": 1, "inner": {"share": 1}}', False)):
        p.write_text(text)
        if ok:
            assert config.load(str(p), keys)["inner"]["share"] == 0.5
        else:
            with pytest.raises(ValueError):
                config.load(str(p), keys)


def test_workflows(spark, tmp_path, capsys):
    import os

    for name in workflows.WORKFLOWS:
        assert workflows.plan(name)
    assert workflows.main(["causal", "--data", "x", "--out", "y", "--dry-run"]) == 0 and "causal_ipw" in capsys.readouterr().out
    with pytest.raises(ValueError):
        workflows.plan("nothing")
    if os.path.isdir("/root/testdata/sf0.001"):
        made = workflows.run(spark, "causal", "/root/testdata/sf0.001", str(tmp_path)).collect()
        assert [r["query"] for r in made] == sorted(workflows.plan("causal"))
        assert all(spark.read.parquet(f"{tmp_path}/{r['query']}").count() == r["rows"] and json.loads(r["columns"]) for r in made)


def test_stage_tables_can_be_dropped(spark):
    from quillon import io

    t = io.staged(spark.range(5), "dropped")
    assert t.count() == 5 and io.drop_stages(spark) > 0 and not io.written
    with pytest.raises(Exception):
        spark.read.parquet(t.inputFiles()[0]).count()


def test_folds_of_a_bundle(spark):
    whole = spark.range(10).withColumnRenamed("id", "k")
    sound = whole.select("k", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("fold")).select("fold", "k", F.when(F.col("k") % 2 == F.col("fold"), "test").otherwise("train").alias("part"))
    assert studies.check_folds(sound, "k", whole).first()["sound"]
    extra = sound.unionByName(spark.createDataFrame([(0, 99, "test"), (1, 0, "test")], "fold int, k long, part string"))
    r = studies.check_folds(extra, "k", whole).first()
    assert (r["n_unknown"], r["n_several"], r["n_shared"], r["sound"]) == (1, 1, 1, False)
