"""Evaluation metrics over labelled documents with a fixed score, orders and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.io import table
from quillon.operators import metrics
from quillon.plans.registry import query, rounded

#: Score of a labelled document: a fixed function of its length, in steps of a hundredth.
_SCORED = """s AS (SELECT d.doc_id, d.lang, d.source, l.toxic AS label, l.quality, ((d.n_chars * 37) % 101) / 101.0::DOUBLE AS score FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"""


def scored(spark, sf_dir) -> DataFrame:
    d, lab = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), table(spark, sf_dir, "labels")
    return lab.join(d, "doc_id").select("doc_id", "lang", "source", F.col("toxic").alias("label"), "quality", (F.pmod(F.col("n_chars") * 37, F.lit(101)) / F.lit(101.0)).alias("score"))


_COUNTS = "count(*) FILTER (label = 1 AND p) AS tp, count(*) FILTER (label = 0 AND p) AS fp, count(*) FILTER (label = 1 AND NOT p) AS fn, count(*) FILTER (label = 0 AND NOT p) AS tn"
_RATES = """round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1,
round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(coalesce(fp / nullif(fp + tn, 0), 0), 6) AS fpr, round(coalesce(fn / nullif(fn + tp, 0), 0), 6) AS fnr"""


@query(f"WITH {_SCORED}, c AS (SELECT source, lang, {_COUNTS} FROM (SELECT *, score >= 0.5 AS p FROM s) GROUP BY source, lang) SELECT source, lang, tp, fp, fn, tn, {_RATES} FROM c")
def confusion_by_entity(spark, sf_dir):
    """Confusion counts and rates of each source and language (zero for empty denominators)."""
    return rounded(metrics.confusion_by(scored(spark, sf_dir), ["source", "lang"], F.col("label"), F.col("score") >= 0.5))


@query(f"WITH {_SCORED}, b AS (SELECT least(floor(score * 10), 9)::INTEGER AS bin, count(*) AS n, avg(score) AS m, avg(label) AS r FROM s GROUP BY ALL), g AS (SELECT unnest(range(0, 10))::INTEGER AS bin) SELECT bin, coalesce(n, 0)::BIGINT AS n, round(m, 6) AS mean_score, round(r, 6) AS rate FROM g LEFT JOIN b USING (bin)")
def prob_bins(spark, sf_dir):
    """Ten probability bins, empty ones kept."""
    return rounded(metrics.probability_bins(scored(spark, sf_dir), "score", "label"))


@query(f"WITH {_SCORED}, c AS (SELECT source, count(*) AS n, sum(label) AS n_pos, avg(label) AS rate FROM s GROUP BY source) SELECT source, n, n_pos::BIGINT AS n_pos, round(rate, 6) AS rate FROM c WHERE n >= 5 AND n_pos >= 1 ORDER BY rate DESC, n DESC, source LIMIT 10")
def top_entities(spark, sf_dir):
    """The ten sources of greatest rate among those with enough rows."""
    g = scored(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("n_pos"), F.avg("label").alias("rate"))
    return rounded(g.where("n >= 5 and n_pos >= 1").orderBy(F.desc("rate"), F.desc("n"), "source").limit(10))


@query(f"WITH {_SCORED}, c AS (SELECT score, sum(label) AS pos, count(*) - sum(label) AS neg FROM s GROUP BY score), r AS (SELECT *, coalesce(sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM c) SELECT sum(pos)::BIGINT AS n_pos, sum(neg)::BIGINT AS n_neg, round(sum(neg * above + 0.5 * neg * pos) / (sum(pos) * sum(neg)), 6) AS roc_auc FROM r")
def roc_auc(spark, sf_dir):
    """ROC-AUC by ranks with ties averaged."""
    return rounded(metrics.roc_auc(scored(spark, sf_dir)))


_POINTS = f"""{_SCORED}, c AS (SELECT score, sum(label)::DOUBLE AS pos, (count(*) - sum(label))::DOUBLE AS neg FROM s GROUP BY score),
r AS (SELECT score, pos, sum(pos) OVER w AS rp, sum(neg) OVER w AS rn, sum(pos) OVER () AS alls FROM c WINDOW w AS (ORDER BY score DESC)),
pts AS (SELECT score, coalesce(rp / nullif(rp + rn, 0), 0) AS precision, coalesce(rp / nullif(alls, 0), 0) AS recall, coalesce(pos / nullif(alls, 0), 0) AS step, coalesce(2 * rp / nullif(rp + rn + alls, 0), 0) AS f1 FROM r)"""


@query(f"WITH {_POINTS} SELECT round(score, 6) AS score, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM pts")
def pr_curve(spark, sf_dir):
    """The precision-recall curve at distinct scores."""
    return rounded(metrics.pr_points(scored(spark, sf_dir)).select("score", "precision", "recall", "f1"))


@query(f"WITH {_POINTS} SELECT round(sum(step * precision), 6) AS average_precision FROM pts")
def pr_auc(spark, sf_dir):
    """Average precision, step-wise over tied groups."""
    return rounded(metrics.average_precision(metrics.pr_points(scored(spark, sf_dir))))


@query(f"WITH {_POINTS} SELECT round(score, 6) AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM pts ORDER BY round(f1, 9) DESC, score DESC LIMIT 1")
def best_f1(spark, sf_dir):
    """The threshold of greatest F1."""
    return rounded(metrics.best_f1(metrics.pr_points(scored(spark, sf_dir)).withColumn("f1", F.round("f1", 9))))


@query(f"WITH {_SCORED}, p AS (SELECT avg(label) AS prevalence FROM s) SELECT round(avg((score - label) ** 2), 6) AS brier, round(avg((prevalence - label) ** 2), 6) AS brier_of_prior, round(min(prevalence), 6) AS prevalence FROM s, p")
def brier(spark, sf_dir):
    """Brier score, beside that of the constant prior."""
    s = scored(spark, sf_dir)
    prior = s.agg(F.avg("label").alias("prevalence"))
    both = s.crossJoin(F.broadcast(prior))  # one row
    e = lambda p: F.avg(F.pow(F.col(p) - F.col("label"), F.lit(2.0)))
    return rounded(both.agg(e("score").alias("brier"), e("prevalence").alias("brier_of_prior"), F.min("prevalence").alias("prevalence")))


@query("""WITH l AS (SELECT l.doc_id, CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' ELSE 'poor' END AS truth, n_chars FROM labels l JOIN documents d USING (doc_id)),
p AS (SELECT doc_id, truth, CASE WHEN n_chars % 7 = 0 THEN 'toxic' WHEN n_chars % 3 = 0 THEN 'poor' ELSE 'good' END AS called FROM l),
k AS (SELECT unnest(['good', 'poor', 'toxic']) AS label)
SELECT label, count(*) FILTER (truth = label) AS support, count(*) FILTER (called = label) AS called, count(*) FILTER (truth = label AND called = label) AS hit,
  round(coalesce(count(*) FILTER (truth = label AND called = label) / nullif(count(*) FILTER (called = label), 0), 0), 6) AS precision,
  round(coalesce(count(*) FILTER (truth = label AND called = label) / nullif(count(*) FILTER (truth = label), 0), 0), 6) AS recall,
  round(coalesce(2 * count(*) FILTER (truth = label AND called = label) / nullif(count(*) FILTER (called = label) + count(*) FILTER (truth = label), 0), 0), 6) AS f1 FROM k, p GROUP BY label""")
def multiclass_report(spark, sf_dir):
    """Per-class report of three classes."""
    return rounded(metrics.class_report(_three(spark, sf_dir), "truth", "called"))


def _three(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    truth = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").otherwise("poor")
    called = F.when(F.col("n_chars") % 7 == 0, "toxic").when(F.col("n_chars") % 3 == 0, "poor").otherwise("good")
    return table(spark, sf_dir, "labels").join(d, "doc_id").select(truth.alias("truth"), called.alias("called"))


@query("""WITH p AS (SELECT CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' ELSE 'poor' END AS truth, CASE WHEN n_chars % 7 = 0 THEN 'toxic' WHEN n_chars % 3 = 0 THEN 'poor' ELSE 'good' END AS called FROM labels l JOIN documents d USING (doc_id))
SELECT truth, count(*) FILTER (called = 'good') AS good, count(*) FILTER (called = 'poor') AS poor, count(*) FILTER (called = 'toxic') AS toxic FROM p GROUP BY truth""")
def confusion_matrix(spark, sf_dir):
    """Dense confusion matrix by pivot over fixed classes."""
    return _three(spark, sf_dir).groupBy("truth").pivot("called", ["good", "poor", "toxic"]).count().na.fill(0)


@query("""WITH x AS (SELECT l_returnflag AS g, l_quantity AS a, l_extendedprice AS b FROM lineitem),
r AS (SELECT *, rank() OVER (PARTITION BY g ORDER BY a) + (count(*) OVER (PARTITION BY g, a) - 1) / 2 AS ra, rank() OVER (PARTITION BY g ORDER BY b) + (count(*) OVER (PARTITION BY g, b) - 1) / 2 AS rb FROM x)
SELECT g AS l_returnflag, count(*) AS n, round(corr(ra, rb), 6) AS spearman FROM r GROUP BY g""")
def spearman_by_flag(spark, sf_dir):
    """Spearman correlation of quantity and price, with average ranks for ties."""
    x = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")
    return rounded(metrics.spearman(x, "l_quantity", "l_extendedprice", ["l_returnflag"]))


@query("""WITH x AS (SELECT label AS a, (vec_id * 7919) % 10 AS b FROM embeddings),
n AS (SELECT count(*) * (count(*) - 1) / 2 AS alls FROM x), ab AS (SELECT sum(n * (n - 1) / 2) AS v FROM (SELECT count(*) AS n FROM x GROUP BY a, b)),
a AS (SELECT sum(n * (n - 1) / 2) AS v FROM (SELECT count(*) AS n FROM x GROUP BY a)), b AS (SELECT sum(n * (n - 1) / 2) AS v FROM (SELECT count(*) AS n FROM x GROUP BY b))
SELECT round((ab.v - a.v * b.v / alls) / ((a.v + b.v) / 2 - a.v * b.v / alls), 6) AS adjusted_rand FROM n, ab, a, b""")
def ari(spark, sf_dir):
    """Adjusted Rand index of two labelings."""
    x = table(spark, sf_dir, "embeddings").select(F.col("label").alias("a"), (F.col("vec_id") * 7919 % 10).alias("b"))
    return rounded(metrics.adjusted_rand(x, "a", "b"))


# ---- conformal intervals ----

_RESIDUALS = """res AS (SELECT l_returnflag AS stratum, abs(l_extendedprice - l_quantity * 2500) AS residual, l_quantity AS spread, (l_orderkey + l_linenumber) % 4 <> 0 AS calibrating FROM lineitem)"""


def _residuals(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("stratum"), F.abs(F.col("l_extendedprice") - F.col("l_quantity") * 2500).alias("residual"), F.col("l_quantity").alias("spread"), ((F.col("l_orderkey") + F.col("l_linenumber")) % 4 != 0).alias("calibrating")
    )


def conformal_quantile(df: DataFrame, keys: list[str], value: str, alpha: float) -> DataFrame:
    """The ceil((n + 1)(1 - alpha))-th smallest value of each group, infinity if there are fewer."""
    found = metrics.order_statistic(df, value, keys, F.ceil((F.col("n") + 1) * F.lit(1 - alpha)))
    return found.select(*keys, F.coalesce(value, F.lit(float("inf"))).alias("radius"), "n")


@query(f"WITH {_RESIDUALS}, c AS (SELECT stratum, residual, row_number() OVER (PARTITION BY stratum ORDER BY residual) AS k, count(*) OVER (PARTITION BY stratum) AS n FROM res WHERE calibrating), q AS (SELECT stratum, min(residual) FILTER (k = ceil((n + 1) * 0.9::DOUBLE)) AS radius, min(n) AS n FROM c GROUP BY stratum) SELECT q.stratum, q.n, round(radius, 6) AS radius, round(avg((residual <= radius)::INT), 6) AS coverage FROM q JOIN res USING (stratum) WHERE NOT calibrating GROUP BY ALL")
def conformal_radius(spark, sf_dir):
    """Finite-sample conformal radius of each stratum, and its coverage on the other rows."""
    r = _residuals(spark, sf_dir)
    q = conformal_quantile(r.where("calibrating"), ["stratum"], "residual", 0.1)
    t = r.where("not calibrating").join(F.broadcast(q), "stratum")  # a row for each return flag
    return rounded(t.groupBy("stratum", "n", "radius").agg(F.avg((F.col("residual") <= F.col("radius")).cast("int")).alias("coverage")))


@query(f"WITH {_RESIDUALS}, f AS (SELECT stratum, greatest(quantile_cont(spread, 0.1), 1e-12) AS floor FROM res WHERE calibrating GROUP BY stratum), c AS (SELECT stratum, residual / greatest(spread, floor) AS s FROM res JOIN f USING (stratum) WHERE calibrating), k AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY s) AS k, count(*) OVER (PARTITION BY stratum) AS n FROM c), q AS (SELECT stratum, min(s) FILTER (k = ceil((n + 1) * 0.9::DOUBLE)) AS q FROM k GROUP BY stratum) SELECT stratum, round(min(q), 6) AS q, round(avg(q * greatest(spread, floor)), 6) AS mean_half_width, round(avg((residual <= q * greatest(spread, floor))::INT), 6) AS coverage FROM res JOIN f USING (stratum) JOIN q USING (stratum) WHERE NOT calibrating GROUP BY stratum")
def conformal_norm(spark, sf_dir):
    """Conformal half widths normalised by a spread with a floor."""
    r = _residuals(spark, sf_dir)
    floor = metrics.quantile(r.where("calibrating"), "spread", ["stratum"], 0.1, "floor").withColumn("floor", F.greatest("floor", F.lit(1e-12)))
    base = r.join(F.broadcast(floor), "stratum").withColumn("width", F.greatest("spread", "floor")).withColumn("s", F.col("residual") / F.col("width"))
    q = conformal_quantile(base.where("calibrating"), ["stratum"], "s", 0.1).select("stratum", F.col("radius").alias("q"))
    t = base.where("not calibrating").join(F.broadcast(q), "stratum").withColumn("half", F.col("q") * F.col("width"))
    return rounded(t.groupBy("stratum").agg(F.min("q").alias("q"), F.avg("half").alias("mean_half_width"), F.avg((F.col("residual") <= F.col("half")).cast("int")).alias("coverage")))


@query(f"WITH {_RESIDUALS}, q AS (SELECT quantile_cont(spread, 1/3::DOUBLE) AS a, quantile_cont(spread, 2/3::DOUBLE) AS b FROM res), s AS (SELECT CASE WHEN spread <= a THEN 'low' WHEN spread > b THEN 'high' ELSE 'middle' END AS tercile, residual FROM res, q) SELECT tercile, count(*) AS n, CASE WHEN count(*) >= 20 THEN round(avg((residual <= 40000)::INT), 6) END AS coverage FROM s GROUP BY tercile")
def strata_coverage(spark, sf_dir):
    """Coverage by tercile of spread, hidden where there are few rows."""
    r = _residuals(spark, sf_dir)
    q = metrics.quantile(r, "spread", [], 1 / 3, "a").crossJoin(metrics.quantile(r, "spread", [], 2 / 3, "b"))  # one row each
    t = r.crossJoin(F.broadcast(q)).withColumn("tercile", F.when(F.col("spread") <= F.col("a"), "low").when(F.col("spread") > F.col("b"), "high").otherwise("middle"))  # one row
    return rounded(t.groupBy("tercile").agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) >= 20, F.avg((F.col("residual") <= 40000).cast("int"))).alias("coverage")))


# ---- attempts: events as attempts of users (theorems) in arms ----

_ATTEMPTS = """att AS (SELECT user_id AS theorem, event_type AS arm, value, value > 40 AS ok, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS sample FROM events)"""


def attempts(spark, sf_dir):
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").withColumn("sample", F.row_number().over(w)).select(F.col("user_id").alias("theorem"), F.col("event_type").alias("arm"), "value", (F.col("value") > 40).alias("ok"), "sample")


@query(f"WITH {_ATTEMPTS}, t AS (SELECT arm, theorem, bool_or(ok AND sample <= 1) AS p1, bool_or(ok AND sample <= 5) AS p5, bool_or(ok) AS solved, sum(value) AS cost, count(*) AS n, min(sample) FILTER (ok) AS first FROM att GROUP BY ALL) SELECT arm, count(*) AS n_theorems, round(avg(p1::INT), 6) AS pass_1, round(avg(p5::INT), 6) AS pass_5, round(avg(solved::INT), 6) AS solved_rate, round(sum(cost), 2) AS total_cost, sum(n)::BIGINT AS n_attempts, count(*) FILTER (first > 1) AS n_repaired, count(*) FILTER (first IS NULL) AS n_exhausted FROM t GROUP BY arm")
def pass_at_k(spark, sf_dir):
    """Success within the first attempts of each arm."""
    t = attempts(spark, sf_dir).groupBy("arm", "theorem").agg(
        F.bool_or(F.col("ok") & (F.col("sample") <= 1)).alias("p1"), F.bool_or(F.col("ok") & (F.col("sample") <= 5)).alias("p5"), F.bool_or("ok").alias("solved"),
        F.sum("value").alias("cost"), F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("ok"), F.col("sample"))).alias("first"),
    )
    rate = lambda c: F.avg(F.col(c).cast("int"))
    return rounded(
        t.groupBy("arm").agg(
            F.count(F.lit(1)).alias("n_theorems"), rate("p1").alias("pass_1"), rate("p5").alias("pass_5"), rate("solved").alias("solved_rate"), F.round(F.sum("cost"), 2).alias("total_cost"),
            F.sum("n").alias("n_attempts"), F.count_if(F.col("first") > 1).alias("n_repaired"), F.count_if(F.col("first").isNull()).alias("n_exhausted"),
        )
    )


@query(f"WITH {_ATTEMPTS}, t AS (SELECT theorem, bool_or(ok AND sample <= 1) FILTER (arm = 'view') AS a, bool_or(ok AND sample <= 1) FILTER (arm = 'click') AS b FROM att GROUP BY theorem), c AS (SELECT count(*) FILTER (a AND b) AS n_both, count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (b AND NOT a) AS only_b, count(*) FILTER (NOT a AND NOT b) AS n_none FROM t) SELECT *, round(least(1, 2 * list_sum([exp(lgamma(only_a + only_b + 1) - lgamma(i + 1) - lgamma(only_a + only_b - i + 1) - (only_a + only_b) * ln(2)) FOR i IN range(0, least(only_a, only_b) + 1)])), 6) AS p_value FROM c")
def mcnemar(spark, sf_dir):
    """Paired outcomes of two arms and the exact two-sided McNemar test; the binomial tail is summed in logarithms."""
    first = lambda arm: F.bool_or(F.when(F.col("arm") == arm, F.col("ok") & (F.col("sample") <= 1)))
    t = attempts(spark, sf_dir).groupBy("theorem").agg(first("view").alias("a"), first("click").alias("b"))
    a, b = F.col("a"), F.col("b")
    c = t.agg(F.count_if(a & b).alias("n_both"), F.count_if(a & ~b).alias("only_a"), F.count_if(b & ~a).alias("only_b"), F.count_if(~a & ~b).alias("n_none"))
    d = F.col("only_a") + F.col("only_b")
    start = F.struct((-d * F.log(F.lit(2.0))).alias("t"), F.lit(0.0).alias("s"))
    step = lambda acc, i: F.struct((acc["t"] + F.log(d - i) - F.log(i + 1)).alias("t"), (acc["s"] + F.exp(acc["t"])).alias("s"))
    tail = F.aggregate(F.sequence(F.lit(0).cast("long"), F.least("only_a", "only_b")), start, step, lambda acc: acc["s"])
    return rounded(c.withColumn("p_value", F.least(F.lit(1.0), 2 * tail)))


@query(f"WITH {_ATTEMPTS}, m AS (SELECT arm, avg(value) AS mean_value, avg(ok::INT) AS rate FROM att WHERE arm IN ('view', 'click') GROUP BY arm), l AS (SELECT arm, unnest([struct_pack(metric := 'mean_value', v := mean_value), struct_pack(metric := 'rate', v := rate)], recursive := true) FROM m) SELECT metric, round(max(v) FILTER (arm = 'view'), 6) AS baseline, round(max(v) FILTER (arm = 'click'), 6) AS selected, round(max(v) FILTER (arm = 'click') - max(v) FILTER (arm = 'view'), 6) AS delta FROM l GROUP BY metric")
def arm_deltas(spark, sf_dir):
    """Differences of metrics between two arms, by pivot."""
    m = attempts(spark, sf_dir).where(F.col("arm").isin("view", "click")).groupBy("arm").agg(F.avg("value").alias("mean_value"), F.avg(F.col("ok").cast("int")).alias("rate"))
    long = m.unpivot(["arm"], ["mean_value", "rate"], "metric", "v")
    p = long.groupBy("metric").pivot("arm", ["view", "click"]).agg(F.max("v"))
    return rounded(p.select("metric", F.col("view").alias("baseline"), F.col("click").alias("selected"), (F.col("click") - F.col("view")).alias("delta")))


# ---- grids: nested means, crossings, consistency ----

_GRID = """grid AS (SELECT o_orderpriority AS policy, year(o_orderdate) AS budget, (o_custkey % 5)::INTEGER AS fold, avg(o_totalprice) AS mae FROM orders GROUP BY ALL)"""


def grid(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("policy"), F.year("o_orderdate").cast("long").alias("budget"), (F.col("o_custkey") % 5).cast("int").alias("fold")).agg(F.avg("o_totalprice").alias("mae"))


@query(f"WITH {_GRID}, f AS (SELECT policy, fold, avg(mae) AS m FROM grid GROUP BY ALL) SELECT policy, round(avg(m), 6) AS mean_of_means, round(stddev_samp(m), 6) AS std_of_means, count(*) AS n_folds FROM f GROUP BY policy")
def nested_mean(spark, sf_dir):
    """Mean over budgets in each fold, then over folds."""
    f = grid(spark, sf_dir).groupBy("policy", "fold").agg(F.avg("mae").alias("m"))
    return rounded(f.groupBy("policy").agg(F.avg("m").alias("mean_of_means"), F.stddev_samp("m").alias("std_of_means"), F.count(F.lit(1)).alias("n_folds")))


@query(f"WITH {_GRID}, g AS (SELECT median(mae) AS goal FROM grid), c AS (SELECT fold, policy, min(budget) FILTER (mae <= goal) AS first_budget FROM grid, g GROUP BY ALL) SELECT fold, max(first_budget) FILTER (policy LIKE '1%') AS urgent, max(first_budget) FILTER (policy LIKE '5%') AS low, max(first_budget) FILTER (policy LIKE '1%') - max(first_budget) FILTER (policy LIKE '5%') AS saving FROM c GROUP BY fold")
def crossing(spark, sf_dir):
    """First budget at which each policy reaches a target, and the saving of one over another."""
    g = grid(spark, sf_dir)
    goal = g.agg(F.median("mae").alias("goal"))
    c = g.crossJoin(F.broadcast(goal)).groupBy("fold", "policy").agg(F.min(F.when(F.col("mae") <= F.col("goal"), F.col("budget"))).alias("first_budget"))  # one row
    at = lambda p: F.max(F.when(F.col("policy").startswith(p), F.col("first_budget")))
    return c.groupBy("fold").agg(at("1").alias("urgent"), at("5").alias("low"), (at("1") - at("5")).alias("saving"))


@query(f"WITH {_GRID}, e AS (SELECT p.policy, b.budget, f.fold FROM (SELECT DISTINCT policy FROM grid) p, (SELECT DISTINCT budget FROM grid) b, (SELECT DISTINCT fold FROM grid) f) SELECT count(*) AS n_expected, count(grid.policy) AS n_found, count(*) - count(grid.policy) AS n_missing, (SELECT count(*) FROM (SELECT 1 FROM grid GROUP BY policy, budget, fold HAVING count(*) > 1)) AS n_repeated, count(*) = count(grid.policy) AS complete FROM e LEFT JOIN grid ON grid.policy = e.policy AND grid.budget = e.budget AND grid.fold = e.fold")
def report_consistency(spark, sf_dir):
    """Whether a grid of results is the full product of its axes, without repeats."""
    g = grid(spark, sf_dir)
    counts = g.agg(F.count_distinct("policy").alias("p"), F.count_distinct("budget").alias("b"), F.count_distinct("fold").alias("f"))
    keys = g.groupBy("policy", "budget", "fold").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("n_found"), F.count_if(F.col("n") > 1).alias("n_repeated"))
    n = F.col("p") * F.col("b") * F.col("f")
    return counts.crossJoin(keys).select(n.alias("n_expected"), "n_found", (n - F.col("n_found")).alias("n_missing"), "n_repeated", (n == F.col("n_found")).alias("complete"))  # one row each


@query("""WITH f AS (SELECT ('0x' || substr(sha256('fold|' || o_orderkey), 1, 8))::BIGINT % 5 AS fold, o_totalprice AS y, o_orderpriority AS g FROM orders), m AS (SELECT g, avg(y) AS p FROM f GROUP BY g),
e AS (SELECT fold, avg(abs(y - p)) AS mae, sqrt(avg((y - p) ** 2)) AS rmse FROM f JOIN m USING (g) GROUP BY fold)
SELECT round(avg(mae), 6) AS mean_mae, round(stddev_samp(mae), 6) AS std_mae, round(stddev_pop(mae), 6) AS std_mae_pop, round(min(mae), 6) AS min_mae, round(max(mae), 6) AS max_mae, round(avg(rmse), 6) AS mean_rmse, round(1 / (1 + exp(-avg(mae) / 1e5)), 6) AS squashed FROM e""")
def fold_stats(spark, sf_dir):
    """Regression errors over hash folds, with both deviations."""
    from quillon.functions.text import hash_unit

    o = table(spark, sf_dir, "orders").select((hash_unit(F.lit("fold"), F.col("o_orderkey").cast("string")) % 5).alias("fold"), F.col("o_totalprice").alias("y"), F.col("o_orderpriority").alias("g"))
    m = o.groupBy("g").agg(F.avg("y").alias("p"))
    d = F.col("y") - F.col("p")
    e = o.join(F.broadcast(m), "g").groupBy("fold").agg(F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"))  # m: a row for each priority
    return rounded(e.agg(F.avg("mae").alias("mean_mae"), F.stddev_samp("mae").alias("std_mae"), F.stddev_pop("mae").alias("std_mae_pop"), F.min("mae").alias("min_mae"), F.max("mae").alias("max_mae"), F.avg("rmse").alias("mean_rmse"), (1 / (1 + F.exp(-F.avg("mae") / 1e5))).alias("squashed")))
