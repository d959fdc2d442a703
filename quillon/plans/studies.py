"""Queries of studies: audits, cold folds, cross-fitting, refuters, rounds of attempts and acquisitions, series tests, decisions on claims."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions.text import hash_unit, tokens
from quillon.io import staged, table
from quillon.operators import causal, forecasting, learners, nested, pca, studies
from quillon.plans.causal import _FRAME, frame
from quillon.plans.registry import query, rounded
from quillon.plans.resampling import _h
from quillon.plans.retrieval import _BM25, first, scored
from quillon.plans.timeseries import HOURLY, hours


def _quoted(x: str) -> str:
    return f"'{x}'"


# ---- strings of atoms, drafts ----

_PIECES = ["CCO", "c1ccccc1", "C(=O)N", "[NH4+]", "BrC#N", "Cl", "[Si](C)C", "OS(=O)(=O)[O-]", "[nH]1cccc1", "FC(F)F", "P(=O)(O)O", "N=C"]
_LIST = "[" + ", ".join(map(_quoted, _PIECES)) + "]"


def _share(condition: str) -> str:
    return f"round(len(list_filter(atoms, lambda t: {condition})) / nullif(len(atoms), 0), 6)"


@query(rf"""WITH s AS (SELECT p_partkey, {_LIST}[p_partkey % 12 + 1] || {_LIST}[(p_partkey // 12) % 12 + 1] || {_LIST}[(p_partkey * 7) % 12 + 1] AS s FROM part),
r AS (SELECT *, [regexp_extract(m, '^\[?(Cl|Br|Si|Se|[A-Z][a-z]?|[cnops])', 1) FOR m IN regexp_extract_all(s, '\[(?:[A-Z][a-z]?|[cnops])[^\]]*\]|Cl|Br|Si|Se|[BCNOFPSI]|[cnops]')] AS raw FROM s),
a AS (SELECT *, [CASE WHEN regexp_matches(t, '^[cnops]$') THEN upper(t) ELSE t END FOR t IN raw] AS atoms FROM r)
SELECT p_partkey, length(s)::INTEGER AS length, len(atoms)::INTEGER AS n_atoms, {_share("t = 'C'")} AS share_c, {_share("t = 'N'")} AS share_n, {_share("t = 'O'")} AS share_o, {_share("t = 'S'")} AS share_s, {_share("t = 'P'")} AS share_p,
{_share("t IN ('F', 'Cl', 'Br', 'I')")} AS share_halogen, {_share("t NOT IN ('C', 'N', 'O', 'S', 'P', 'F', 'Cl', 'Br', 'I')")} AS share_other, round(len(list_filter(raw, lambda t: regexp_matches(t, '^[cnops]$'))) / nullif(len(atoms), 0), 6) AS share_aromatic,
length(regexp_replace(s, '[^0-9]', '', 'g')) AS n_ring_marks, length(regexp_replace(s, '[^(]', '', 'g')) AS n_branches, length(regexp_replace(s, '[^=]', '', 'g')) AS n_double, length(regexp_replace(s, '[^#]', '', 'g')) AS n_triple, length(regexp_replace(s, '[^+-]', '', 'g')) AS n_charges FROM a""")
def string_descriptors(spark, sf_dir):
    """Fifteen descriptors of strings of atoms, made from three pieces each."""
    pieces, k = F.array(*map(F.lit, _PIECES)), F.col("p_partkey")
    piece = lambda at: F.get(pieces, (at % 12).cast("int"))
    s = table(spark, sf_dir, "part").select("p_partkey", F.concat(piece(k), piece(F.floor(k / 12)), piece(k * 7)).alias("s"))
    return rounded(s.select("p_partkey", *[c.alias(n) for n, c in studies.string_descriptors(F.col("s")).items()]))


_DRAFTS = """dr AS (SELECT o_orderkey AS draft, CASE o_orderkey % 4 WHEN 0 THEN 'No claim is named here, n_regions=5' WHEN 1 THEN 'By [C' || o_custkey || '] and [X9] n_nations=' || (24 + o_orderkey % 3) || ' of them'
WHEN 2 THEN 'See [C' || o_custkey || '] in REPORT of ' || n_name || '.' ELSE '[C' || o_custkey || '] [C' || o_custkey || '] other=-1.5' END AS text FROM orders JOIN nation ON n_nationkey = o_orderkey % 25)"""


@query(rf"""WITH {_DRAFTS}, c AS (SELECT DISTINCT draft, unnest(regexp_extract_all(text, '\[([A-Za-z]\d+)\]', 1)) AS claim FROM dr), fin AS (SELECT 'C' || c_custkey AS claim FROM customer WHERE c_acctbal > 0),
an AS (SELECT 'n_regions' AS name, count(*)::DOUBLE AS value FROM region UNION ALL SELECT 'n_nations', count(*) FROM nation), m AS (SELECT draft, unnest(regexp_extract_all(text, '\b([A-Za-z_][A-Za-z0-9_]*)=(-?\d+(?:\.\d+)?)', 1)) AS name, unnest(regexp_extract_all(text, '\b([A-Za-z_][A-Za-z0-9_]*)=(-?\d+(?:\.\d+)?)', 2))::DOUBLE AS given FROM dr)
SELECT draft, 'unsupported_claim' AS code, 'error' AS severity, claim AS subject FROM c ANTI JOIN fin USING (claim)
UNION ALL SELECT draft, CASE WHEN value IS NULL THEN 'unknown_numeric_claim' ELSE 'numeric_mismatch' END, 'error', name FROM m LEFT JOIN an USING (name) WHERE value IS NULL OR abs(given - value) > 0.005
UNION ALL SELECT draft, 'source_phrase_overlap', 'warning', title FROM dr, (SELECT 'Report of ' || n_name AS title FROM nation) WHERE contains(lower(text), lower(title))
UNION ALL SELECT draft, 'missing_claim_trace', 'warning', '' FROM dr WHERE NOT regexp_matches(text, '\[[A-Za-z]\d+\]')""")
def draft_audit(spark, sf_dir):
    """Findings in drafts: claims against a ledger, numbers against saved results, phrases of sources, missing traces."""
    k, name = F.col("o_orderkey"), F.concat(F.lit("[C"), "o_custkey", F.lit("]"))
    text = (
        F.when(k % 4 == 0, "No claim is named here, n_regions=5")
        .when(k % 4 == 1, F.concat(F.lit("By "), name, F.lit(" and [X9] n_nations="), 24 + k % 3, F.lit(" of them")))
        .when(k % 4 == 2, F.concat(F.lit("See "), name, F.lit(" in REPORT of "), "n_name", F.lit(".")))
        .otherwise(F.concat(name, F.lit(" "), name, F.lit(" other=-1.5")))
    )
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    drafts = table(spark, sf_dir, "orders").join(nation, F.col("n_nationkey") == k % 25).select(k.alias("draft"), text.alias("text"))
    finalizable = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.concat(F.lit("C"), "c_custkey").alias("claim"))
    count = lambda name, of: table(spark, sf_dir, of).agg(F.lit(name).alias("name"), F.count(F.lit(1)).cast("double").alias("value"))
    return studies.audit_drafts(drafts, "draft", "text", finalizable, count("n_regions", "region").unionByName(count("n_nations", "nation")), nation.select(F.concat(F.lit("Report of "), "n_name").alias("title")))


# ---- folds ----

_COLD = f"f AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_quantity::BIGINT % 10 AS cat, l_extendedprice AS price, (l_returnflag = 'R')::BIGINT AS y, {_h(_quoted('cold'), 'l_suppkey')} % 5 AS fold FROM lineitem)"


def _oof_sql(label: str) -> str:
    return f"""c AS (SELECT cat, fold, count(*) AS n, sum({label}) AS s FROM f GROUP BY ALL), e AS (SELECT fold, sum(n) AS n, sum(s) AS s FROM c GROUP BY fold), k AS (SELECT cat, sum(n) AS n, sum(s) AS s FROM c GROUP BY cat),
r AS (SELECT c.cat, c.fold, coalesce((k.s - c.s) / nullif(k.n - c.n, 0), ((SELECT sum(s) FROM e) - e.s) / nullif((SELECT sum(n) FROM e) - e.n, 0)) AS score FROM c JOIN e ON e.fold = c.fold JOIN k ON k.cat = c.cat),
oof AS (SELECT id, f.fold, {label} AS label, score FROM f JOIN r ON r.cat = f.cat AND r.fold = f.fold)"""


def _rated(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_quantity").cast("long") % 10).alias("cat"), F.col("l_extendedprice").alias("price"), (F.col("l_returnflag") == "R").cast("long").alias("y"), "l_suppkey")
    return studies.cold_folds(li, "l_suppkey", 5, "cold")


@query(f"""WITH {_COLD}, {_oof_sql('y')} SELECT fold::INTEGER AS fold, tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(coalesce(fp / nullif(fp + tn, 0), 0), 6) AS fpr, round(coalesce(fn / nullif(fn + tp, 0), 0), 6) AS fnr
FROM (SELECT fold, count(*) FILTER (label = 1 AND score >= 0.337) AS tp, count(*) FILTER (label = 0 AND score >= 0.337) AS fp, count(*) FILTER (label = 1 AND score < 0.337) AS fn, count(*) FILTER (label = 0 AND score < 0.337) AS tn FROM oof GROUP BY fold)""")
def cold_group_oof(spark, sf_dir):
    """Cross-validation with whole suppliers in a fold: out-of-fold scores and each fold's confusion."""
    return rounded(studies.fold_report(studies.out_of_fold_rates(_rated(spark, sf_dir), "id", "cat", "y"), 0.337, ["fold"]))


@query(" UNION ALL ".join(f"(WITH {_COLD}, {_oof_sql(f'(price > {t})::BIGINT')} SELECT {t}::DOUBLE AS threshold, count(*) AS n, sum(label)::BIGINT AS n_positive, round(avg((label - score) ** 2), 6) AS brier, round(avg(((score >= 0.5)::INT = label)::INT), 6) AS accuracy FROM oof)" for t in (10000, 30000, 50000)))
def threshold_rerun(spark, sf_dir):
    """The same frozen folds under other label thresholds."""
    rows, out = _rated(spark, sf_dir), None
    for t in (10000, 30000, 50000):
        oof = studies.out_of_fold_rates(rows.withColumn("y", (F.col("price") > t).cast("long")), "id", "cat", "y")
        right = ((F.col("score") >= 0.5).cast("int") == F.col("label")).cast("int")
        part = oof.agg(F.lit(float(t)).alias("threshold"), F.count(F.lit(1)).alias("n"), F.sum("label").alias("n_positive"), F.avg((F.col("label") - F.col("score")) * (F.col("label") - F.col("score"))).alias("brier"), F.avg(right).alias("accuracy"))
        out = part if out is None else out.unionByName(part)
    return rounded(out)


@query(f"""WITH b AS (SELECT o_orderkey AS id, {_h(_quoted('bundle'), 'o_orderkey')} % 4 AS k FROM orders), f AS (SELECT id, fold, CASE WHEN id % 977 <> 0 AND (k = fold OR (id % 1000 = 0 AND (k + 1) % 4 = fold)) THEN 'test' ELSE 'train' END AS part FROM b, (SELECT unnest(range(0, 4)) AS fold) g),
t AS (SELECT id, count(*) AS n FROM f WHERE part = 'test' GROUP BY id) SELECT 0::BIGINT AS n_shared, (SELECT count(*) FROM t WHERE n > 1) AS n_several, (SELECT count(*) FROM b WHERE id NOT IN (SELECT id FROM t)) AS n_untested, 0::BIGINT AS n_unknown, false AS sound""")
def fold_bundle(spark, sf_dir):
    """A bundle of fold-indexed rows checked against the whole: some rows are tested twice or never."""
    b = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (hash_unit(F.lit("bundle"), F.col("o_orderkey").cast("string")) % 4).alias("k"))
    fold = F.col("fold")
    test = (F.col("id") % 977 != 0) & ((F.col("k") == fold) | ((F.col("id") % 1000 == 0) & ((F.col("k") + 1) % 4 == fold)))
    f = b.select("id", "k", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("fold")).select("fold", "id", F.when(test, "test").otherwise("train").alias("part"))
    return studies.check_folds(f, "id", b)


# ---- effects ----


@query(f"""WITH {_FRAME}, f AS (SELECT *, {_h(_quoted('xfit'), 'c_custkey')} % 3 AS fold FROM fr), c AS (SELECT x2, fold, count(*) AS n, sum(t) AS n1, coalesce(sum(y) FILTER (t = 1), 0) AS y1, coalesce(sum(y) FILTER (t = 0), 0) AS y0 FROM f GROUP BY ALL),
s AS (SELECT c.x2, c.fold, sum(o.n) AS n, sum(o.n1) AS n1, sum(o.y1) AS y1, sum(o.y0) AS y0 FROM c LEFT JOIN c o ON o.x2 = c.x2 AND o.fold <> c.fold GROUP BY ALL), a AS (SELECT g.fold, sum(n) AS n, sum(n1) AS n1, sum(y1) AS y1, sum(y0) AS y0 FROM (SELECT DISTINCT fold FROM c) g JOIN c ON c.fold <> g.fold GROUP BY ALL),
e AS (SELECT s.x2, s.fold, coalesce(s.n1 / nullif(s.n, 0), a.n1 / a.n) AS p, coalesce(s.y1 / nullif(s.n1, 0), a.y1 / a.n1) AS m1, coalesce(s.y0 / nullif(s.n - s.n1, 0), a.y0 / (a.n - a.n1)) AS m0 FROM s JOIN a ON a.fold = s.fold),
z AS (SELECT e.m1 - e.m0 + f.t * (f.y - e.m1) / greatest(0.05, least(0.95, e.p)) - (1 - f.t) * (f.y - e.m0) / (1 - greatest(0.05, least(0.95, e.p))) AS z FROM f JOIN e ON e.x2 = f.x2 AND e.fold = f.fold) SELECT round(avg(z), 4) AS aipw, round(stddev_samp(z) / sqrt(count(z)), 4) AS se, count(z) AS n FROM z""")
def cross_fitted_dr(spark, sf_dir):
    """Doubly robust effect with nuisance means of each stratum from the other folds."""
    f = frame(spark, sf_dir).drop("p", "m0", "m1")
    return rounded(causal.doubly_robust(studies.cross_fitted(f, "c_custkey", "x2", 3, "xfit")), 4)


def _strata_sql(source: str, by: str, stratum: str) -> str:
    return f"SELECT {by} sum(n * (y1 - y0)) / sum(n) AS effect FROM (SELECT {by} {stratum}, count(*) AS n, avg(y) FILTER (t = 1) AS y1, avg(y) FILTER (t = 0) AS y0 FROM {source} GROUP BY ALL) WHERE y1 IS NOT NULL AND y0 IS NOT NULL {'GROUP BY rep' if by else ''}"


@query(f"""WITH {_FRAME}, k AS (SELECT unnest(range(0, 20)) AS rep), cp AS (SELECT rep, c_custkey, x2, t, y FROM fr, k), pl AS (SELECT rep, x2, y, ({_h(_quoted('refute-placebo'), 'rep', 'c_custkey')} / 4294967296.0 < (SELECT avg(t) FROM fr))::INT AS t FROM cp),
ca AS (SELECT *, {_h(_quoted('refute-cause'), 'rep', 'c_custkey')} % 3 AS cause FROM cp), su AS (SELECT * FROM cp WHERE {_h(_quoted('refute-subset'), 'rep', 'c_custkey')} / 4294967296.0 < 0.8), est AS ({_strata_sql('fr', '', 'x2')}),
al AS (SELECT 'placebo' AS "check", effect FROM ({_strata_sql('pl', 'rep,', 'x2')}) UNION ALL SELECT 'random_common_cause', effect FROM ({_strata_sql('ca', 'rep,', 'x2, cause')}) UNION ALL SELECT 'subset', effect FROM ({_strata_sql('su', 'rep,', 'x2')}))
SELECT "check", round(est.effect, 4) AS estimate, round(avg(al.effect), 4) AS effect, round(max(abs(al.effect - CASE WHEN "check" = 'placebo' THEN 0 ELSE est.effect END)), 4) AS spread FROM al, est GROUP BY "check", est.effect""")
def refutation_suite(spark, sf_dir):
    """An estimate against placebo treatments, random common causes and random subsets."""
    return rounded(studies.refute(frame(spark, sf_dir), "c_custkey", "x2", 20), 4)


# ---- series ----


@query(f"""WITH {HOURLY}, l AS (SELECT series, max(hour) AS last, count(*)::DOUBLE AS trend FROM h GROUP BY series), a AS (SELECT h.series, last + 1 AS hour, trend, last + 1 - hour AS age, y FROM h JOIN l ON l.series = h.series)
SELECT series, hour, trend, max(y) FILTER (age = 1) AS lag_1, max(y) FILTER (age = 24) AS lag_24, max(y) FILTER (age = 168) AS lag_168, round(CASE WHEN count(y) FILTER (age <= 24) = 24 THEN avg(y) FILTER (age <= 24) END, 6) AS mean_24, round(CASE WHEN count(y) FILTER (age <= 24) = 24 THEN stddev_pop(y) FILTER (age <= 24) END, 6) AS std_24,
round(CASE WHEN count(y) FILTER (age <= 168) = 168 THEN avg(y) FILTER (age <= 168) END, 6) AS mean_168, round(CASE WHEN count(y) FILTER (age <= 168) = 168 THEN stddev_pop(y) FILTER (age <= 168) END, 6) AS std_168, round(sin(2 * pi() * (hour % 24) / 24), 6) AS hour_sin, round(cos(2 * pi() * (hour % 24) / 24), 6) AS hour_cos,
round(sin(2 * pi() * ((hour // 24 + 3) % 7) / 7), 6) AS day_sin, round(cos(2 * pi() * ((hour // 24 + 3) % 7) / 7), 6) AS day_cos FROM a GROUP BY series, hour, trend""")
def ts_next_features(spark, sf_dir):
    """The feature row of the next hour of each series."""
    return rounded(forecasting.next_features(hours(spark, sf_dir)))


@query(f"""WITH {HOURLY}, w AS (SELECT series, y, lag(y, 1) OVER s AS a, lag(y, 2) OVER s AS b, lag(y, 3) OVER s AS c FROM h WINDOW s AS (PARTITION BY series ORDER BY hour)), r AS (SELECT series, corr(y, a) AS r1, corr(y, b) AS r2, corr(y, c) AS r3 FROM w GROUP BY series), p AS (SELECT *, (r2 - r1 * r1) / (1 - r1 * r1) AS p2 FROM r)
SELECT series, round(r1, 6) AS pacf_1, round(p2, 6) AS pacf_2, round((r3 - (r1 - p2 * r1) * r2 - p2 * r1) / (1 - (r1 - p2 * r1) * r1 - p2 * r2), 6) AS pacf_3 FROM p""")
def ts_pacf(spark, sf_dir):
    """Partial autocorrelations at the first three lags."""
    from quillon.operators import series

    r = series.autocorrelation(hours(spark, sf_dir), (1, 2, 3))
    return rounded(r.select("series", *[c.alias(f"pacf_{k + 1}") for k, c in enumerate(forecasting.partial_autocorrelations([F.col(f"acf_{k}") for k in (1, 2, 3)]))]))


@query(f"""WITH {HOURLY}, w AS (SELECT series, y - lag(y) OVER s AS d, lag(y) OVER s AS x, lag(y) OVER s - lag(y, 2) OVER s AS g FROM h WINDOW s AS (PARTITION BY series ORDER BY hour)), o AS (SELECT * FROM w WHERE g IS NOT NULL),
m AS (SELECT series, regr_slope(d, g) AS bd, regr_intercept(d, g) AS ad, regr_slope(x, g) AS bx, regr_intercept(x, g) AS ax FROM o GROUP BY series), e AS (SELECT series, d - ad - bd * g AS ed, x - ax - bx * g AS ex FROM o JOIN m USING (series)),
b AS (SELECT series, count(*) AS n, sum(ex * ed) / sum(ex * ex) AS slope, sum(ex * ex) AS sxx, sum(ed * ed) AS sdd FROM e GROUP BY series) SELECT series, n, round(slope / sqrt((sdd - slope * slope * sxx) / (n - 3) / sxx), 4) AS statistic FROM b""")
def ts_unit_root(spark, sf_dir):
    """Augmented Dickey-Fuller statistic of each series."""
    return rounded(forecasting.unit_root(hours(spark, sf_dir)), 4)


@query(f"""WITH {HOURLY}, l AS (SELECT series, max(hour) AS last FROM h GROUP BY series), m AS (SELECT h.series, avg(y) AS mean FROM h JOIN l USING (series) WHERE hour <= last - 24 GROUP BY h.series)
SELECT h.series, h.hour, h.y AS actual, round(m.mean, 6) AS mean, b.y AS seasonal FROM h JOIN l ON l.series = h.series JOIN m ON m.series = h.series JOIN h b ON b.series = h.series AND b.hour = h.hour - 24 WHERE h.hour > last - 24""")
def plugin_forecast(spark, sf_dir):
    """Two forecasters, passed as parameters, on the last day of each series."""
    h = hours(spark, sf_dir)
    a = forecasting.forecast_with(h, forecasting.Mean, 24, 24).withColumnRenamed("forecast", "mean")
    b = forecasting.forecast_with(h, forecasting.SeasonalNaive, 24, 24).select("series", "hour", F.col("forecast").alias("seasonal"))
    return rounded(a.join(b, ["series", "hour"]))


@query()
def boosted_forecast(spark, sf_dir):
    """Recursive forecasts by boosted trees on lags, each prediction fed back."""
    return rounded(forecasting.forecast_with(hours(spark, sf_dir), forecasting.Boosted, 24, 72))


# ---- checks of fits ----


@query("SELECT * FROM (VALUES ('orthonormal', true), ('variances_fall', true), ('variances_not_negative', true), ('shares_add_up', true), ('reconstruction_is_whole', true), ('signs_fixed', true)) v(condition, holds)")
def math_checks(spark, sf_dir):
    """Conditions that a full decomposition must meet, its reconstruction on all rows."""
    li = table(spark, sf_dir, "lineitem")
    model = pca.fit(li, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], 1.0)
    return spark.createDataFrame(pca.checks(model, li), "condition string, holds boolean")


_CASES = [("exact", 5, "SUPPORT", [1, 2], 1), ("wrong document", 6, "SUPPORT", [1, 2], 0), ("wrong stance", 5, "CONTRADICT", [1, 2], 0), ("partial rationale", 5, "SUPPORT", [1], 0), ("rationale too late", 5, "SUPPORT", [7, 8, 9, 1, 2], 0), ("more than needed", 5, "SUPPORT", [2, 1, 9], 1)]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', {s})" for n, *_, s in _CASES) + ') v("case", score)')
def adversarial_suite(spark, sf_dir):
    """Predictions that an evaluator must score 0 (wrong document, stance or rationale), and those it must score 1."""
    rows = spark.createDataFrame([c[:4] for c in _CASES], "case string, doc long, stance string, called array<int>")
    return rows.select("case", nested.strict_score(F.col("doc"), F.lit(5), F.col("stance"), F.lit("SUPPORT"), F.col("called"), F.array(F.lit(1), F.lit(2)), 3).alias("score"))


# ---- rounds ----


@query(f"""WITH t AS (SELECT DISTINCT conv_id FROM conversations), a AS (SELECT conv_id, i AS iteration, {_h(_quoted('repair'), 'conv_id', 'i')} % 3 = 0 AS success FROM t, (SELECT unnest(range(1, 5)) AS i) k), f AS (SELECT conv_id, min(iteration) FILTER (success) AS first FROM a GROUP BY conv_id)
SELECT conv_id, iteration::INTEGER AS iteration, success FROM a JOIN f USING (conv_id) WHERE first IS NULL OR iteration <= first""")
def repair_attempts(spark, sf_dir):
    """Attempts at each task until one succeeds, four at most."""
    tasks = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    attempt = lambda left, i: left.select("conv_id", (hash_unit(F.lit("repair"), F.col("conv_id").cast("string"), F.lit(str(i))) % 3 == 0).alias("success"))
    return studies.repair_loop(tasks, attempt, "conv_id", 4)


@query(f"""WITH t AS (SELECT DISTINCT conv_id FROM conversations), a AS (SELECT arm, conv_id, {_h(_quoted('cost'), 'arm', 'conv_id')} % 100 AS cents, {_h(_quoted('won'), 'arm', 'conv_id')} % 2 = 0 AS success FROM t, (SELECT unnest(['plain', 'guided', 'repaired']) AS arm) k),
r AS (SELECT *, sum(cents) OVER (ORDER BY CASE arm WHEN 'plain' THEN 0 WHEN 'guided' THEN 1 ELSE 2 END, conv_id) AS spent FROM a) SELECT arm, conv_id, cents, success, spent::DOUBLE AS spent FROM r WHERE spent <= 7000""")
def study_run(spark, sf_dir):
    """A study of three arms under a cost cap, with the running cost of each attempt."""
    tasks = table(spark, sf_dir, "conversations").select("conv_id").distinct()

    def arm(name):
        draw = lambda what: hash_unit(F.lit(what), F.lit(name), F.col("conv_id").cast("string"))
        return lambda left: left.select("conv_id", (draw("cost") % 100).alias("cents"), (draw("won") % 2 == 0).alias("success"))

    return studies.run_study(tasks, {name: arm(name) for name in ("plain", "guided", "repaired")}, "conv_id", "cents", 7000.0)


@query("WITH v AS (SELECT unnest(range(1, 13)) AS v), g AS (SELECT x.v AS a, y.v AS b, 6 AS d FROM v x, v y) SELECT a, b, d::BIGINT AS d, (a * a + b * b - 2 * a * b + 2 * (a + b) - 4 * d)::BIGINT AS observed FROM g WHERE NOT (a * a + b * b - 2 * a * b + 2 * (a + b) >= 4 * d) ORDER BY a, b LIMIT 1")
def fraction_grid(spark, sf_dir):
    """First pair of sixths at which a claim about them fails, in whole numbers (the first point is the feature)."""
    claim = "a * a + b * b - 2 * a * b + 2 * (a + b)"
    return studies.counterexample(spark, ["a", "b"], list(range(1, 13)), 6, f"{claim} >= 4 * d", f"{claim} - 4 * d")


@query()
def structure_baseline(spark, sf_dir):
    """A forest on the descriptors of strings of atoms, judged on held-out folds (a baseline of a structure study)."""
    pieces, k = F.array(*map(F.lit, _PIECES)), F.col("p_partkey")
    piece = lambda at: F.get(pieces, (at % 12).cast("int"))
    s = table(spark, sf_dir, "part").select("p_partkey", F.concat(piece(k), piece(F.floor(k / 12)), piece(k * 7)).alias("s"))
    d = {n: F.coalesce(c.cast("double"), F.lit(0.0)) for n, c in studies.string_descriptors(F.col("s")).items()}
    rows = s.select("p_partkey", *[c.alias(n) for n, c in d.items()], (F.get(pieces, (F.floor(k / 12) % 12).cast("int")).contains("N")).cast("int").alias("nitrogen"))
    scores = learners.held_out_scores(rows, [n for n in d if n != "share_n"], "nitrogen", "p_partkey", "forest")
    return rounded(scores.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.avg(((F.col("score") >= 0.5).cast("int") == F.col("label")).cast("int")).alias("accuracy")))


def _rounds_sql(rounds: int) -> str:
    parts = [f"p AS (SELECT vec_id, embedding[1]::DOUBLE AS e, {_h(_quoted('al'), 'vec_id')} AS h FROM embeddings)", "c0 AS (SELECT vec_id, e, 0 AS round, row_number() OVER (ORDER BY h, vec_id) AS place FROM p ORDER BY h, vec_id LIMIT 20)"]
    for r in range(1, rounds + 1):
        order = f"abs(p.e - (SELECT avg(e) FROM c{r - 1})) DESC, h, vec_id"
        parts.append(f"c{r} AS (SELECT * FROM c{r - 1} UNION ALL SELECT * FROM (SELECT vec_id, e, {r} AS round, row_number() OVER (ORDER BY {order}) AS place FROM p WHERE vec_id NOT IN (SELECT vec_id FROM c{r - 1}) ORDER BY {order} LIMIT 10))")
    return f"WITH {', '.join(parts)} SELECT vec_id, round, place::INTEGER AS place FROM c{rounds}"


@query(_rounds_sql(3))
def acquire_rounds(spark, sf_dir):
    """Three rounds of active learning: those farthest from the mean of what is chosen so far (the batch is the feature)."""
    pool = table(spark, sf_dir, "embeddings").select("vec_id", F.get("embedding", F.lit(0)).cast("double").alias("e"))

    def distance(pool, chosen):
        return F.abs(F.col("e") - F.lit(pool.join(F.broadcast(chosen.select("vec_id")), "vec_id", "left_semi").agg(F.avg("e")).first()[0]))  # a few dozen rows are chosen

    return studies.acquire(pool, "vec_id", 20, 10, 3, distance, "al")


# ---- decisions ----

_NEGATED = "[" + ", ".join(map(_quoted, studies.NEGATIONS)) + "]"


@query(rf"""WITH {_BM25}, hit AS (SELECT query_id AS claim, doc_id, rank, score / (SELECT max(score) FROM b) AS strength FROM b WHERE rank <= 3), cl AS (SELECT item_id AS claim, list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS t FROM benchmark),
sn AS (SELECT doc_id, s, unnest(range(0, len(s))) AS sid FROM (SELECT doc_id, list_filter(string_split_regex(text, '[.\n]+'), lambda x: trim(x) <> '') AS s FROM documents)), st AS (SELECT doc_id, sid, list_distinct(regexp_extract_all(lower(s[sid + 1]), '[\p{{L}}\p{{N}}_]+')) AS held FROM sn),
sc AS (SELECT claim, doc_id, rank, strength, sid, len(list_intersect(cl.t, held)) / len(cl.t) AS score, list_has_any(held, {_NEGATED}) <> list_has_any(cl.t, {_NEGATED}) AS against FROM hit JOIN cl USING (claim) JOIN st USING (doc_id)),
ci AS (SELECT *, row_number() OVER (PARTITION BY claim, doc_id ORDER BY round(score, 9) DESC, sid) AS k FROM sc WHERE score >= 0.3 QUALIFY k <= 2), pe AS (SELECT claim, doc_id, rank, strength, array_to_string(list_sort(list(sid)), ',') AS sentences, sqrt(strength * max(score)) AS confidence, arg_min(against, k) AS against FROM ci GROUP BY claim, doc_id, rank, strength),
tp AS (SELECT *, row_number() OVER (PARTITION BY claim ORDER BY round(confidence, 6) DESC, rank, doc_id) AS o FROM pe QUALIFY o = 1)
SELECT cl.claim, CASE WHEN coalesce(confidence >= 0.35, false) THEN CASE WHEN against THEN 'CONTRADICT' ELSE 'SUPPORT' END ELSE 'NOT_ENOUGH_INFO' END AS verdict, CASE WHEN confidence >= 0.35 THEN doc_id END AS doc_id, CASE WHEN confidence >= 0.35 THEN sentences END AS sentences, round(coalesce(confidence, 0), 4) AS confidence FROM cl LEFT JOIN tp USING (claim)""")
def verify_claims(spark, sf_dir):
    """Claims verified by retrieval, sentences, stance and a decision with its citation."""
    hits = staged(first(scored(spark, sf_dir)[2]).select(F.col("query_id").alias("claim"), "doc_id", "rank", "score"), "hits")
    top = hits.agg(F.max("score").alias("top"))
    hits = hits.where("rank <= 3").crossJoin(F.broadcast(top)).select("claim", "doc_id", "rank", (F.col("score") / F.col("top")).alias("strength"))  # one row
    claims = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("claim"), F.array_distinct(tokens(F.col("text"))).alias("tokens"))
    cited = table(spark, sf_dir, "documents").join(hits.select("doc_id").distinct(), "doc_id", "left_semi")
    parts = cited.select("doc_id", F.posexplode(F.filter(F.split("text", r"[.\n]+"), lambda x: F.trim(x) != "")).alias("sid", "s"))
    sentences = parts.select("doc_id", "sid", F.array_distinct(tokens(F.col("s"))).alias("tokens"))
    return rounded(studies.verify_claims(hits, claims, sentences, 0.3, 2, 0.35), 4)
