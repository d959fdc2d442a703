"""Inverted-index retrieval, fusion of rankings and retrieval metrics.

An index is built in one pass over the texts and written (``build``, ``write``, ``load``): a row for each term and
document, and a row under the empty term for each document, which tells its length. A search deals the index's rows of
query terms out by document, meets them with the queries' weighted terms (broadcast while they are few) and adds up in
place, so that what is shuffled grows with the index of the query terms and not with queries times documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions.text import tokens
from quillon.io import staged

K1, B = 1.2, 0.75  # fixed values
#: (query, term) rows up to which they are sent to all tasks.
BROADCAST_TERMS = 500_000


def query_terms(queries: DataFrame, query_id: str, text: str) -> DataFrame:
    return queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(tokens(F.col(text)))).alias("term"))


def _spread(corpus: DataFrame) -> DataFrame:
    """The corpus in as many partitions as there are cores, where its files give fewer (a few small files): tokenising is what costs. Larger inputs stay where they are."""
    cores = corpus.sparkSession.sparkContext.defaultParallelism
    return corpus.repartition(cores, "doc_id") if corpus.rdd.getNumPartitions() < cores else corpus


def postings(corpus: DataFrame, doc_id: str = "doc_id", text: str = "text", only: DataFrame | None = None) -> DataFrame:
    """term, doc_id, tf and dl (tokens of the document), and for each document with tokens a row with the empty term. only: a table with the terms to index; others are dropped before anything is counted."""
    t = _spread(corpus.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).select("doc_id", tokens(F.col("text")).alias("t")).where(F.size("t") > 0)
    rows = t.select("doc_id", F.size("t").alias("dl"), F.explode(F.concat("t", F.array(F.lit("")))).alias("term"))
    if only is not None:
        rows = rows.join(only.select("term").union(only.sparkSession.range(1).select(F.lit(""))).distinct(), "term", "left_semi")
    return rows.groupBy("term", "doc_id", "dl").agg(F.count(F.lit(1)).alias("tf"))


@dataclass(frozen=True)
class Index:
    """A written table of postings (term, doc_id, dl, tf)."""

    table: DataFrame

    @property
    def postings(self) -> DataFrame:
        return self.table.where("term != ''")

    @property
    def lengths(self) -> DataFrame:
        """doc_id and dl of each document that has tokens."""
        return self.table.where("term = ''").select("doc_id", "dl")

    @property
    def size(self) -> DataFrame:
        """n_docs and avgdl; one row."""
        return self.lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))

    def write(self, path: str) -> None:
        """By term, so that a search's filter on terms reads few row groups."""
        self.table.repartitionByRange("term").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(path)


def build(corpus: DataFrame, doc_id: str = "doc_id", text: str = "text", only: DataFrame | None = None) -> Index:
    """The index of the corpus, or of the terms of only, written once to the shared folder."""
    return Index(staged(postings(corpus, doc_id, text, only), "postings"))


def load(spark: SparkSession, path: str) -> Index:
    return Index(spark.read.parquet(path))


def scores(index: Index, terms: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """query_id, doc_id, score (BM25), shared (distinct query terms that the document holds) and dl of every document that holds a query term; terms is a written table of query_id, term."""
    wanted = index.postings.join(terms.select("term").distinct(), "term", "left_semi")
    df = wanted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = staged(terms.join(df, "term").crossJoin(F.broadcast(index.size)).select("query_id", "term", idf.alias("idf"), "avgdl"), "weighted-terms")  # size is one row
    few = weighted.count() <= BROADCAST_TERMS
    tf = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    by_doc = wanted.repartition("doc_id")  # what is added up below stays in its task
    met = by_doc.join(F.broadcast(weighted) if few else weighted, "term")
    return met.groupBy("query_id", "doc_id").agg(F.sum(F.col("idf") * tf).alias("score"), F.count(F.lit(1)).alias("shared"), F.first("dl").alias("dl"))


def bm25(index: Index, terms: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """query_id, doc_id, score of every document that holds a query term."""
    return scores(index, terms, k1, b).select("query_id", "doc_id", "score")


def top(hits: DataFrame, k: int, score: str = "score", digits: int | None = 9) -> DataFrame:
    """The k best documents of each query, ranked; ties to the smaller doc_id."""
    key = F.round(score, digits) if digits is not None else F.col(score)
    w = Window.partitionBy("query_id").orderBy(key.desc(), F.col("doc_id"))
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def fuse(first: DataFrame, second: DataFrame, c: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (query_id, doc_id, rank, score), scaled by the query's best, with each list's scores scaled to [0, 1]."""
    both = first.select("query_id", "doc_id", F.col("rank").alias("r1"), F.col("score").alias("s1")).join(second.select("query_id", "doc_id", F.col("rank").alias("r2"), F.col("score").alias("s2")), ["query_id", "doc_id"], "full_outer")
    w = Window.partitionBy("query_id")
    part = lambda r: F.coalesce(F.lit(1.0) / (c + F.col(r)), F.lit(0.0))
    raw = both.withColumn("rrf_raw", part("r1") + part("r2"))

    def scaled(s):
        lo, hi = F.min(s).over(w), F.max(s).over(w)
        return F.when(F.col(s).isNull(), 0.0).when(hi == lo, 1.0).otherwise(F.try_divide(F.col(s) - lo, hi - lo))

    return raw.withColumns({"rrf": F.col("rrf_raw") / F.max("rrf_raw").over(w), "first_scaled": scaled("s1"), "second_scaled": scaled("s2")})


def hybrid(fused: DataFrame, cover: DataFrame, k: int, digits: int | None = 9) -> DataFrame:
    """.45 fusion + .35 second + .15 first + .05 share of the query's (its title's) tokens that the document holds (fixed weights). cover: query_id, doc_id, coverage of the fused pairs."""
    named = fused.join(cover, ["query_id", "doc_id"])
    score = 0.45 * F.col("rrf") + 0.35 * F.col("second_scaled") + 0.15 * F.col("first_scaled") + 0.05 * F.col("coverage")
    return top(named.withColumn("score", score), k, digits=digits)


def metrics(hits: DataFrame, gold: DataFrame, ks=(1, 5, 10)) -> DataFrame:
    """Over queries with gold documents: share with a gold document among the first k, share of gold documents there, mean reciprocal rank."""
    found = gold.join(hits.select("query_id", "doc_id", "rank"), ["query_id", "doc_id"], "left")
    per = found.groupBy("query_id").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n_gold"), *[F.count_if(F.col("rank") <= k).alias(f"in_{k}") for k in ks])
    return per.agg(
        F.count(F.lit(1)).alias("n_queries"), F.avg(F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0))).alias("mrr"),
        *[F.avg((F.col(f"in_{k}") > 0).cast("double")).alias(f"query_recall_{k}") for k in ks],
        *[(F.sum(f"in_{k}") / F.sum("n_gold")).alias(f"doc_recall_{k}") for k in ks],
    )


def tfidf(corpus: DataFrame, doc_id: str = "doc_id", text: str = "text", min_df: int = 1) -> DataFrame:
    """Sublinear, smoothed, length-1 TF-IDF of words and pairs of neighbouring words: doc_id, term, weight."""
    t = corpus.select(F.col(doc_id).alias("doc_id"), tokens(F.translate(F.lower(text), "áàâäéèêëíìîïóòôöúùûüñç", "aaaaeeeeiiiioooouuuunc")).alias("t"))
    pairs = F.when(F.size("t") >= 2, F.zip_with(F.slice("t", F.lit(1), F.size("t") - 1), F.slice("t", F.lit(2), F.size("t") - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    tf = t.select("doc_id", F.explode(F.concat("t", pairs)).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_df)
    n = F.broadcast(corpus.agg(F.count(F.lit(1)).alias("n")))
    raw = tf.join(df, "term").crossJoin(n).withColumn("w", (1 + F.log("tf")) * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc_id")))
    return raw.select("doc_id", "term", (F.col("w") / norm).alias("weight"))
