"""Operators on nested evidence: rationales, citations, pair features, fenced text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rationales(df: DataFrame, gold: str, called: str, most: int) -> DataFrame:
    """A claim counts if all its gold sentences are among the first ``most`` called; sentence scores count hits of such claims only."""
    whole = F.size(F.array_except(gold, F.slice(called, 1, most))) == 0
    m = df.select(whole.alias("whole"), F.size(F.array_intersect(gold, called)).alias("hit"), F.size(gold).alias("g"), F.size(called).alias("c"))
    hits = F.sum(F.when(F.col("whole"), F.col("hit")).otherwise(0))
    return m.agg(F.count(F.lit(1)).alias("n_claims"), F.count_if("whole").alias("n_whole"), F.avg(F.col("whole").cast("int")).alias("abstract_rate"), F.coalesce(F.try_divide(hits, F.sum("c")), F.lit(0.0)).alias("sentence_precision"), F.coalesce(F.try_divide(hits, F.sum("g")), F.lit(0.0)).alias("sentence_recall"))


def regroup(rows: DataFrame, keys: list[str], item: str, stance: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_set(item)).alias("sentences"), F.min(stance).alias("stance"), (F.count_distinct(stance) > 1).alias("conflict"))


def relation(a: Column, b: Column) -> Column:
    """Both vectors, their product and their absolute difference, as one array."""
    return F.concat(a, b, F.zip_with(a, b, lambda x, y: x * y), F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def fenced_body(raw: Column) -> Column:
    inner = F.regexp_extract(raw, r"(?s)```[a-z]*\n(.*?)\n```", 1)
    body = F.trim(F.regexp_extract(inner, r"(?s)^.*?\bby\b(.*)$", 1))
    return F.when(body == "", "error: empty proof").otherwise(body)


def strict_score(doc: Column, gold_doc: Column, stance: Column, gold_stance: Column, called: Column, gold: Column, most: int) -> Column:
    """1 if document and stance are right and all gold sentences are among the first ``most`` called, else 0."""
    whole = F.size(F.array_except(gold, F.slice(called, 1, most))) == 0
    return ((doc == gold_doc) & (stance == gold_stance) & whole).cast("int")


def relation_terms(pairs: DataFrame, weights: DataFrame) -> DataFrame:
    """claim, term, claim_weight, evidence_weight, product and gap for each term of either side; pairs: claim, evidence; weights: doc_id, term, weight."""
    left = pairs.join(weights.select(F.col("doc_id").alias("claim"), "term", F.col("weight").alias("claim_weight")), "claim").select("claim", "term", "claim_weight")
    right = pairs.join(weights.select(F.col("doc_id").alias("evidence"), "term", F.col("weight").alias("evidence_weight")), "evidence").select("claim", "term", "evidence_weight")
    both = left.join(right, ["claim", "term"], "full_outer").na.fill(0.0, ["claim_weight", "evidence_weight"])
    c, e = F.col("claim_weight"), F.col("evidence_weight")
    return both.withColumns({"product": c * e, "gap": F.abs(c - e)})
