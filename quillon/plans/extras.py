"""Nested evidence, leak scans, gates between reports, ensembles, effect methods behind one function."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import text as tx
from quillon.io import table
from quillon.operators import effects, learners, nested
from quillon.plans.causal import _FRAME, frame
from quillon.plans.evaluation import scored
from quillon.plans.registry import query, rounded

_SENT = r"""sent AS (SELECT doc_id, list_filter(string_split_regex(text, '[.\n]+'), lambda x: trim(x) <> '') AS s FROM documents),
ev AS (SELECT doc_id, len(s) AS n, list_sort(list_distinct([(doc_id * 7) % len(s), (doc_id * 11 + 3) % len(s)])) AS gold, list_sort(list_distinct([(doc_id * 7) % len(s), (doc_id * 5 + 1) % len(s), (doc_id * 11 + 3) % len(s), (doc_id * 13) % len(s)])) AS called, CASE WHEN doc_id % 3 = 0 THEN 'SUPPORT' ELSE 'CONTRADICT' END AS stance FROM sent WHERE len(s) > 0)"""


def evidence(spark, sf_dir):
    """Gold and called sentence numbers of each document."""
    s = F.filter(F.split("text", r"[.\n]+"), lambda x: F.trim(x) != "")
    d = table(spark, sf_dir, "documents").select("doc_id", F.size(s).cast("long").alias("n")).where("n > 0")
    pick = lambda *pairs: F.sort_array(F.array_distinct(F.array(*[(F.col("doc_id") * a + b) % F.col("n") for a, b in pairs])))
    return d.select("doc_id", "n", pick((7, 0), (11, 3)).alias("gold"), pick((7, 0), (5, 1), (11, 3), (13, 0)).alias("called"), F.when(F.col("doc_id") % 3 == 0, "SUPPORT").otherwise("CONTRADICT").alias("stance"))


@query(f"""WITH {_SENT}, m AS (SELECT list_has_all(called[1:3], gold) AS whole, len(list_intersect(gold, called)) AS hit, len(gold) AS g, len(called) AS c FROM ev) SELECT count(*) AS n_claims, count(*) FILTER (whole) AS n_whole, round(avg(whole::INT), 6) AS abstract_rate, round(sum(CASE WHEN whole THEN hit ELSE 0 END) / sum(c), 6) AS sentence_precision, round(sum(CASE WHEN whole THEN hit ELSE 0 END) / sum(g), 6) AS sentence_recall FROM m""")
def rationale_metrics(spark, sf_dir):
    """Claims whose gold sentences are among the first three called, and sentence scores over these."""
    return rounded(nested.rationales(evidence(spark, sf_dir), "gold", "called", 3))


@query(f"""WITH {_SENT}, x AS (SELECT doc_id, stance, unnest(called) AS sid FROM ev) SELECT doc_id // 10 AS claim, doc_id, array_to_string(list_sort(list(DISTINCT sid)), ',') AS sentences, min(stance) AS stance, count(DISTINCT stance) > 1 AS conflict FROM x GROUP BY doc_id""")
def regroup_citations(spark, sf_dir):
    """Citations exploded and regrouped: one row a document, sorted sentences, one stance, conflicts marked."""
    e = evidence(spark, sf_dir).select((F.floor(F.col("doc_id") / 10)).alias("claim"), "doc_id", "stance", F.explode("called").alias("sid"))
    return nested.regroup(e, ["claim", "doc_id"], "sid", "stance").withColumn("sentences", F.array_join("sentences", ","))


@query(r"""SELECT (SELECT count(*) FROM events WHERE regexp_matches(props, '"(/|[A-Za-z]:\\\\)')) AS n_absolute_paths, (SELECT count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O')) AS n_other_split, (SELECT count(*) FROM documents WHERE regexp_matches(text, '(/home/|/root/|[A-Z]:\\)')) AS n_local_texts""")
def leakage_scan(spark, sf_dir):
    """Machine-local paths in nested values and texts, and rows of splits that aren't allowed."""
    e = table(spark, sf_dir, "events").agg(F.count_if(F.rlike("props", F.lit(r'"(/|[A-Za-z]:\\\\)'))).alias("n_absolute_paths"))
    o = table(spark, sf_dir, "orders").agg(F.count_if(~F.col("o_orderstatus").isin("F", "O")).alias("n_other_split"))
    d = table(spark, sf_dir, "documents").agg(F.count_if(F.rlike("text", F.lit(r"(/home/|/root/|[A-Z]:\\)"))).alias("n_local_texts"))
    return e.crossJoin(o).crossJoin(d)  # one row each


@query(r"""WITH f AS (SELECT conv_id, turn, '```lean' || chr(10) || 'theorem x : p := by ' || text || chr(10) || '```' AS raw FROM conversations), b AS (SELECT conv_id, turn, regexp_extract(raw, '(?s)```[a-z]*\n(.*?)\n```', 1) AS inner_text FROM f) SELECT conv_id, turn, CASE WHEN trim(regexp_extract(inner_text, '(?s)^.*?\bby\b(.*)$', 1)) = '' THEN 'error: empty proof' ELSE trim(regexp_extract(inner_text, '(?s)^.*?\bby\b(.*)$', 1)) END AS body FROM b""")
def fence_normaliser(spark, sf_dir):
    """The body of a fenced block after its first ``by``; an empty one becomes an error mark."""
    raw = F.concat(F.lit("```lean\ntheorem x : p := by "), "text", F.lit("\n```"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", nested.fenced_body(raw).alias("body"))


_MEMBERS = "mem AS (SELECT o_orderkey, o_totalprice * (0.9 + 0.05 * k) + 100 * ((o_orderkey + k) % 3) AS pred, k FROM orders, (SELECT unnest(range(0, 5)) AS k) m)"


@query(f"WITH {_MEMBERS} SELECT o_orderkey, round(avg(pred), 4) AS mean_pred, round(stddev_samp(pred), 4) AS disagreement FROM mem GROUP BY o_orderkey")
def ensemble_disagreement(spark, sf_dir):
    """Mean and deviation of each row's predictions across an ensemble."""
    k = F.col("k")
    m = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"))
    pred = F.col("o_totalprice") * (0.9 + 0.05 * k) + 100 * ((F.col("o_orderkey") + k) % 3)
    return rounded(m.withColumn("pred", pred).groupBy("o_orderkey").agg(F.avg("pred").alias("mean_pred"), F.stddev_samp("pred").alias("disagreement")), 4)


@query("""WITH v AS (SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS e FROM embeddings) SELECT a.vec_id, round(list_sum([a.e[i] * b.e[i] FOR i IN range(1, len(a.e) + 1)]), 6) AS product_sum, round(list_sum([abs(a.e[i] - b.e[i]) FOR i IN range(1, len(a.e) + 1)]), 6) AS gap_sum, (4 * len(a.e))::INTEGER AS width FROM v a JOIN v b ON b.vec_id = a.vec_id + 1""")
def relation_features(spark, sf_dir):
    """Features of a pair of vectors: both, their product, their absolute difference."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("a"))
    w = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    f = v.join(w, "vec_id").withColumn("x", nested.relation(F.col("a"), F.col("b")))
    part = F.floor(F.size("x") / 4).cast("int")
    add = lambda k: F.aggregate(F.slice("x", part * k + 1, part), F.lit(0.0), lambda s, e: s + e)
    return rounded(f.select("vec_id", add(2).alias("product_sum"), add(3).alias("gap_sum"), F.size("x").alias("width")))


@query("""WITH a AS (SELECT source, count(*) AS n, avg(toxic) AS r FROM labels JOIN documents USING (doc_id) WHERE labels.doc_id % 2 = 0 GROUP BY source), b AS (SELECT source, count(*) AS n, avg(toxic) AS r FROM labels JOIN documents USING (doc_id) GROUP BY source) SELECT count(*) AS n_shared, count(*) FILTER (a.n <= b.n) AS n_consistent, count(*) FILTER (abs(a.r - b.r) <= 0.25) AS n_close, bool_and(a.n <= b.n) AS released FROM a JOIN b USING (source)""")
def report_gates(spark, sf_dir):
    """Two reports compared key by key; all gates must hold for a release."""
    s = scored(spark, sf_dir)
    summary = lambda df, n, r: df.groupBy("source").agg(F.count(F.lit(1)).alias(n), F.avg("label").alias(r))
    j = summary(s.where("doc_id % 2 = 0"), "n_a", "r_a").join(summary(s, "n_b", "r_b"), "source")
    fits = F.col("n_a") <= F.col("n_b")
    return j.agg(F.count(F.lit(1)).alias("n_shared"), F.count_if(fits).alias("n_consistent"), F.count_if(F.abs(F.col("r_a") - F.col("r_b")) <= 0.25).alias("n_close"), F.bool_and(fits).alias("released"))


@query("""WITH e AS (SELECT user_id % 7 AS policy, event_type, value FROM events) SELECT policy, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS n_hit, round(coalesce(count(*) FILTER (event_type = 'purchase') / nullif(count(*) FILTER (event_type IN ('purchase', 'error')), 0), 0), 6) AS precision, round(coalesce(sum(value) FILTER (event_type = 'purchase') / nullif(sum(value), 0), 0), 6) AS value_share FROM e GROUP BY policy""")
def policy_ratios(spark, sf_dir):
    """Pooled ratios of each policy, 0 where nothing is below the line."""
    hit, decided = F.col("event_type") == "purchase", F.col("event_type").isin("purchase", "error")
    e = table(spark, sf_dir, "events").withColumn("policy", F.col("user_id") % 7)
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return rounded(e.groupBy("policy").agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("n_hit"), zero(F.count_if(hit).cast("double"), F.count_if(decided)).alias("precision"), zero(F.sum(F.when(hit, F.col("value"))), F.sum("value")).alias("value_share")))


@query(r"""WITH d AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'https://doi.org/10.' || (1000 + p_partkey) || '/' || replace(p_name, ' ', '-') WHEN 1 THEN 'doi: 10.' || (1000 + p_partkey) || '/X' WHEN 2 THEN 'none' ELSE '10.12/short' END AS raw, 1600 + p_partkey % 600 AS year FROM part), n AS (SELECT p_partkey, year, regexp_replace(lower(trim(raw)), '^(https?://(dx\.)?doi\.org/|doi:\s*)', '') AS doi FROM d)
SELECT p_partkey, CASE WHEN regexp_matches(doi, '^10\.[0-9]{4,9}/\S+$') THEN doi END AS doi, CASE WHEN NOT regexp_matches(doi, '^10\.[0-9]{4,9}/\S+$') THEN 'bad_doi' WHEN year NOT BETWEEN 1665 AND 2100 THEN 'bad_year' ELSE 'verified' END AS status FROM n""")
def doi_status(spark, sf_dir):
    """Identifiers in normal form and the status of their records."""
    k = F.col("p_partkey")
    raw = F.when(k % 4 == 0, F.concat(F.lit("https://doi.org/10."), k + 1000, F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("-")))).when(k % 4 == 1, F.concat(F.lit("doi: 10."), k + 1000, F.lit("/X"))).when(k % 4 == 2, "none").otherwise("10.12/short")
    d = table(spark, sf_dir, "part").select("p_partkey", tx.normal_doi(raw).alias("doi"), (1600 + k % 600).alias("year"))
    return d.select("p_partkey", "doi", F.when(F.col("doi").isNull(), "bad_doi").when(~F.col("year").between(1665, 2100), "bad_year").otherwise("verified").alias("status"))


@query("""WITH d AS (SELECT l_returnflag AS g, l_partkey, max(l_shipdate) AS last, count(*) AS n FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY n DESC, l_partkey) AS k FROM d) SELECT g, l_partkey, n, k::INTEGER AS k FROM r WHERE k <= 3""")
def top_per_group(spark, sf_dir):
    """Three most frequent parts of each flag, ties by key."""
    d = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("g"), "l_partkey").agg(F.count(F.lit(1)).alias("n"))
    return d.withColumn("k", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("n"), "l_partkey"))).where("k <= 3")


_PC = "greatest(0.05, least(0.95, p))"


@query(f"""WITH {_FRAME}, a AS (SELECT avg(y) FILTER (t = 1) - avg(y) FILTER (t = 0) AS e, sqrt(var_samp(y) FILTER (t = 1) / count(*) FILTER (t = 1) + var_samp(y) FILTER (t = 0) / count(*) FILTER (t = 0)) AS se FROM fr),
g AS (SELECT count(*) AS n, covar_pop(t, t) AS tt, covar_pop(t, x1) AS tx, covar_pop(x1, x1) AS xx, covar_pop(t, y) AS ty, covar_pop(x1, y) AS xy, covar_pop(y, y) AS yy FROM fr), b AS (SELECT *, (ty * xx - xy * tx) / (tt * xx - tx * tx) AS bt, (xy * tt - ty * tx) / (tt * xx - tx * tx) AS bx FROM g),
z AS (SELECT avg(s) AS e, stddev_samp(s) / sqrt(count(s)) AS se FROM (SELECT m1 - m0 + t * (y - m1) / {_PC} - (1 - t) * (y - m0) / (1 - {_PC}) AS s FROM fr))
SELECT 'difference_in_means' AS method, round(e, 4) AS effect, round(se, 4) AS se, 'ok' AS status FROM a UNION ALL SELECT 'g_computation', round(bt, 4), round(sqrt(n * (yy - bt * ty - bx * xy) / (n - 3) / (n * (tt - tx * tx / xx))), 4), 'ok' FROM b
UNION ALL SELECT 'ipw', round(avg(t * y / {_PC} - (1 - t) * y / (1 - {_PC})), 4), NULL, 'ok' FROM fr UNION ALL SELECT 'aipw', round(e, 4), round(se, 4), 'ok' FROM z""")
def effect_methods(spark, sf_dir):
    """Four estimators behind one function, with the status of each."""
    f = frame(spark, sf_dir)
    rows = [effects.estimate(f, m, ["x1"]) for m in ("difference_in_means", "g_computation", "ipw", "aipw")]
    return rounded(spark.createDataFrame(rows, "method string, effect double, se double, status string"), 4)


@query()
def backdoor_sets(spark, sf_dir):
    """Minimal adjustment sets of a small graph."""
    edges = [("x", "t"), ("x", "y"), ("z", "t"), ("z", "w"), ("w", "y"), ("t", "y")]
    return spark.createDataFrame([(", ".join(s),) for s in effects.adjustment_sets(edges, "t", "y", ["x", "z", "w"])], "adjustment string")


@query()
def cv_candidates(spark, sf_dir):
    """Candidates compared by AUC of held-out scores over the same hash folds."""
    from quillon.operators import metrics

    f, out = frame(spark, sf_dir), None
    for kind in ("logistic", "forest"):
        s = learners.held_out_scores(f, ["x1", "x2", "y"], "t", "c_custkey", kind)
        row = metrics.roc_auc(s.select("score", "label")).select(F.lit(kind).alias("model"), F.round("roc_auc", 6).alias("roc_auc"))
        out = row if out is None else out.unionByName(row)
    return out


@query()
def nested_knn(spark, sf_dir):
    """Weighted nearest-neighbour scores, k chosen in inner folds, judged on outer folds."""
    return rounded(learners.nested_neighbours(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("label") < 3, (5, 15), 3))


@query()
def model_introspection(spark, sf_dir):
    """Coefficients, importances and tree depths of fitted models."""
    rows = learners.introspection(frame(spark, sf_dir), ["x1", "x2", "y"], "t")
    return rounded(spark.createDataFrame(rows, "model string, quantity string, value double"))
