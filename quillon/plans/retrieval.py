"""Retrieval over documents with benchmark passages as queries, and decisions on the hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.io import staged, table
from quillon.operators import retrieval
from quillon.plans.registry import query, rounded

_BM25 = r"""
tok AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS t FROM documents),
size AS (SELECT count(*) AS n_docs, avg(len(t)) AS avgdl FROM tok WHERE len(t) > 0),
post AS (SELECT doc_id, term, count(*) AS tf, min(dl) AS dl FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM tok) GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
qt AS (SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))) AS term FROM benchmark),
bm AS (SELECT query_id, doc_id, sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score FROM qt JOIN post USING (term) JOIN df USING (term), size GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM bm QUALIFY rank <= 10)
"""
_SECOND = """
s0 AS (SELECT query_id, doc_id, count(*) AS shared, min(dl) AS dl FROM qt JOIN post USING (term) GROUP BY ALL),
s1 AS (SELECT query_id, doc_id, shared / sqrt(dl) AS score FROM s0),
s AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM s1 QUALIFY rank <= 10)
"""


def scored(spark, sf_dir) -> tuple[retrieval.Index, DataFrame, DataFrame]:
    """The index of the queries' terms, built in one pass, the terms, and the scores of both rankings."""
    terms = staged(retrieval.query_terms(table(spark, sf_dir, "benchmark"), "item_id", "text"), "terms")
    index = retrieval.build(table(spark, sf_dir, "documents"), only=terms)
    return index, terms, retrieval.scores(index, terms)


def first(scores: DataFrame) -> DataFrame:
    return retrieval.top(scores, 10, digits=6)


def second(scores: DataFrame) -> DataFrame:
    """A second ranking: distinct query terms in the document over the root of its length."""
    return retrieval.top(scores.withColumn("score", F.col("shared") / F.sqrt("dl")), 10, digits=6)


def ranked(spark, sf_dir) -> DataFrame:
    return first(scored(spark, sf_dir)[2])


@query(f"WITH {_BM25} SELECT query_id, doc_id, rank::INTEGER AS rank, round(score, 4) AS score FROM b")
def bm25_topk(spark, sf_dir):
    """The ten best documents of each query by BM25 over an inverted index."""
    return rounded(ranked(spark, sf_dir).select("query_id", "doc_id", "rank", "score"), 4)


_FUSED = f"""{_BM25}, {_SECOND},
u AS (SELECT coalesce(b.query_id, s.query_id) AS query_id, coalesce(b.doc_id, s.doc_id) AS doc_id, b.rank AS r1, s.rank AS r2, b.score AS s1, s.score AS s2 FROM b FULL JOIN s ON b.query_id = s.query_id AND b.doc_id = s.doc_id),
f AS (SELECT *, coalesce(1.0 / (60 + r1), 0) + coalesce(1.0 / (60 + r2), 0) AS raw FROM u),
g AS (SELECT *, raw / max(raw) OVER w AS rrf, CASE WHEN s1 IS NULL THEN 0 WHEN max(s1) OVER w = min(s1) OVER w THEN 1 ELSE (s1 - min(s1) OVER w) / (max(s1) OVER w - min(s1) OVER w) END AS n1,
  CASE WHEN s2 IS NULL THEN 0 WHEN max(s2) OVER w = min(s2) OVER w THEN 1 ELSE (s2 - min(s2) OVER w) / (max(s2) OVER w - min(s2) OVER w) END AS n2 FROM f WINDOW w AS (PARTITION BY query_id))"""


@query(f"WITH {_FUSED} SELECT query_id, doc_id, round(rrf, 4) AS rrf, round(n1, 4) AS first_scaled, round(n2, 4) AS second_scaled FROM g")
def rrf_fusion(spark, sf_dir):
    """Reciprocal rank fusion of two rankings, with scores scaled to [0, 1] in each query."""
    _, _, scores = scored(spark, sf_dir)
    return rounded(retrieval.fuse(first(scores), second(scores)).select("query_id", "doc_id", "rrf", "first_scaled", "second_scaled"), 4)


@query(rf"""WITH {_FUSED}, ti AS (SELECT doc_id, t AS held FROM tok), q AS (SELECT item_id AS query_id, list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS qt FROM benchmark),
h AS (SELECT g.query_id, g.doc_id, 0.45 * rrf + 0.35 * n2 + 0.15 * n1 + 0.05 * coalesce(len(list_intersect(qt, held)) / nullif(len(qt), 0), 0) AS score FROM g JOIN ti ON ti.doc_id = g.doc_id JOIN q ON q.query_id = g.query_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM h) SELECT query_id, doc_id, rank::INTEGER AS rank, round(score, 4) AS score FROM k WHERE rank <= 5""")
def rrf_hybrid(spark, sf_dir):
    """Fused rankings with the coverage of the query's tokens by the document."""
    _, terms, scores = scored(spark, sf_dir)
    a, b = first(scores), second(scores)
    sizes = terms.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_terms"))
    cover = a.select("query_id", "doc_id", "shared").union(b.select("query_id", "doc_id", "shared")).distinct().join(sizes, "query_id").select("query_id", "doc_id", (F.col("shared") / F.col("n_terms")).alias("coverage"))
    h = retrieval.hybrid(retrieval.fuse(a, b), cover, 5, digits=6)
    return rounded(h.select("query_id", "doc_id", "rank", "score"), 4)


_GOLD = "gold AS (SELECT item_id AS query_id, doc_id FROM benchmark JOIN documents ON contains(documents.text, benchmark.text))"


def gold(spark, sf_dir, index: retrieval.Index, terms: DataFrame) -> DataFrame:
    """Documents that hold a query's text: candidates hold its rarest term, then the text is compared."""
    docs, asked = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    df = index.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rare = terms.join(df, "term").groupBy("query_id").agg(F.min_by("term", F.struct("df", "term")).alias("term"))
    near = staged(rare.join(index.postings.select("term", "doc_id"), "term").select("query_id", "doc_id"), "gold-candidates")
    return near.join(asked, "query_id").join(docs.select("doc_id", "text"), "doc_id").where(F.contains("text", "passage")).select("query_id", "doc_id")


@query(f"WITH {_BM25}, {_GOLD}, p AS (SELECT gold.query_id, min(rank) AS first, count(*) AS n_gold, count(*) FILTER (rank <= 1) AS in_1, count(*) FILTER (rank <= 5) AS in_5, count(*) FILTER (rank <= 10) AS in_10 FROM gold LEFT JOIN b ON b.query_id = gold.query_id AND b.doc_id = gold.doc_id GROUP BY ALL) SELECT count(*) AS n_queries, round(avg(coalesce(1 / first, 0)), 6) AS mrr, " + ", ".join(f"round(avg((in_{k} > 0)::INT), 6) AS query_recall_{k}, round(sum(in_{k}) / sum(n_gold), 6) AS doc_recall_{k}" for k in (1, 5, 10)) + " FROM p")
def retrieval_metrics(spark, sf_dir):
    """Recall and reciprocal rank of BM25 against documents that hold the passage."""
    index, terms, scores = scored(spark, sf_dir)
    return rounded(retrieval.metrics(first(scores), gold(spark, sf_dir, index, terms)))


@query(f"WITH {_BM25}, {_GOLD}, p AS (SELECT query_id, doc_id FROM b WHERE rank <= 3), t AS (SELECT count(*) AS tp FROM p SEMI JOIN gold USING (query_id, doc_id)), c AS (SELECT (SELECT count(*) FROM p) AS n_predicted, (SELECT count(*) FROM gold) AS n_gold, tp FROM t) SELECT n_predicted, n_gold, tp AS n_hit, round(tp / n_predicted, 6) AS precision, round(coalesce(tp / nullif(n_gold, 0), 0), 6) AS recall, round(2 * tp / (n_predicted + n_gold), 6) AS f1 FROM c")
def citation_metrics(spark, sf_dir):
    """Set-based precision, recall and F1 of cited documents."""
    index, terms, scores = scored(spark, sf_dir)
    p = first(scores).where("rank <= 3").select("query_id", "doc_id", F.lit(1).alias("p"))
    both = p.join(gold(spark, sf_dir, index, terms).withColumn("g", F.lit(1)), ["query_id", "doc_id"], "full_outer")
    c = both.agg(F.count("p").alias("n_predicted"), F.count("g").alias("n_gold"), F.count_if(F.col("p").isNotNull() & F.col("g").isNotNull()).alias("n_hit"))
    n = F.col("n_hit")
    return rounded(c.withColumns({"precision": F.coalesce(F.try_divide(n, F.col("n_predicted")), F.lit(0.0)), "recall": F.coalesce(F.try_divide(n, F.col("n_gold")), F.lit(0.0)), "f1": F.coalesce(F.try_divide(2 * n, F.col("n_predicted") + F.col("n_gold")), F.lit(0.0))}))


@query(f"""WITH {_BM25}, g AS (SELECT query_id, rank, doc_id, score, max(score) OVER (PARTITION BY query_id) AS best FROM b), pol AS (SELECT * FROM (VALUES (0.5, 3), (0.5, 10), (0.8, 3), (0.8, 10), (0.95, 3)) v(t, m)),
d AS (SELECT query_id, t::DOUBLE AS threshold, m::BIGINT AS most, count(*) FILTER (rank <= m AND score >= t * best) AS n FROM g, pol GROUP BY ALL) SELECT threshold, most, count(*) AS n_queries, sum(n)::BIGINT AS n_cited, round(avg((n > 1)::INT), 6) AS multiple_share FROM d GROUP BY threshold, most""")
def policy_sweep(spark, sf_dir):
    """A grid of threshold and count policies evaluated on all rankings."""
    w = Window.partitionBy("query_id")
    g = ranked(spark, sf_dir).withColumn("best", F.max("score").over(w))
    policies = spark.sql("SELECT cast(t AS double) AS threshold, cast(m AS bigint) AS most FROM VALUES (0.5, 3), (0.5, 10), (0.8, 3), (0.8, 10), (0.95, 3) AS v(t, m)")
    d = g.crossJoin(F.broadcast(policies)).groupBy("query_id", "threshold", "most").agg(F.count_if((F.col("rank") <= F.col("most")) & (F.col("score") >= F.col("threshold") * F.col("best"))).alias("n"))  # five policies
    return rounded(d.groupBy("threshold", "most").agg(F.count(F.lit(1)).alias("n_queries"), F.sum("n").alias("n_cited"), F.avg((F.col("n") > 1).cast("int")).alias("multiple_share")))


@query(f"""WITH {_BM25}, m AS (SELECT query_id, doc_id, rank, score, score / (SELECT max(score) FROM b) AS p FROM b),
k AS (SELECT query_id, list_sort(list(doc_id) FILTER (rank <= 3 AND p >= 0.3)) AS ids, max(p) AS best, arg_min(doc_id, (-round(p, 6), rank, doc_id)) AS first FROM m GROUP BY query_id)
SELECT query_id, CASE WHEN best >= 0.3 THEN 'cited' ELSE 'none' END AS verdict, array_to_string(ids, ',') AS citations, first AS best_doc, round(best, 4) AS confidence FROM k""")
def verify_decisions(spark, sf_dir):
    """Decisions from hits: threshold, at most three citations, best by a lexicographic key, else none."""
    m = ranked(spark, sf_dir)
    top = m.agg(F.max("score").alias("top"))
    s = m.crossJoin(F.broadcast(top)).withColumn("p", F.col("score") / F.col("top"))  # one row
    ids = F.array_join(F.sort_array(F.collect_list(F.when((F.col("rank") <= 3) & (F.col("p") >= 0.3), F.col("doc_id")))), ",")
    k = s.groupBy("query_id").agg(ids.alias("citations"), F.max("p").alias("confidence"), F.min_by("doc_id", F.struct(-F.round("p", 6), "rank", "doc_id")).alias("best_doc"))
    text = F.when(F.col("citations") == "", None).otherwise(F.col("citations"))
    return rounded(k.select("query_id", F.when(F.col("confidence") >= 0.3, "cited").otherwise("none").alias("verdict"), text.alias("citations"), "best_doc", "confidence"), 4)


@query(r"""WITH t AS (SELECT item_id AS doc_id, regexp_extract_all(translate(lower(text), 'áàâäéèêëíìîïóòôöúùûüñç', 'aaaaeeeeiiiioooouuuunc'), '[\p{L}\p{N}_]+') AS t FROM benchmark),
g AS (SELECT doc_id, unnest(list_concat(t, [t[i] || ' ' || t[i + 1] FOR i IN range(1, len(t))])) AS term FROM t), tf AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 2),
w AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM benchmark)) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term)) SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w""")
def tfidf_terms(spark, sf_dir):
    """TF-IDF of words and word pairs: sublinear, smoothed, accents stripped, unit length."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return rounded(retrieval.tfidf(b, min_df=2))
