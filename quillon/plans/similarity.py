"""Fuzzy-set and vector similarities over embeddings, neighbours, components, acquisition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import arrays as ar
from quillon.functions.text import hash_unit
from quillon.io import table
from quillon.operators import pairs
from quillon.plans.registry import query, rounded

#: Vectors as fuzzy sets. Where an operator is defined on all pairs, a stated query set (ids divisible by 50) meets all vectors.
_FUZZY = """fz AS (SELECT vec_id, label, list_transform(embedding, lambda x: greatest(0, least(1, (x::DOUBLE + 1) / 2))) AS v FROM embeddings)"""


def fuzzy(spark, sf_dir) -> DataFrame:
    v = F.transform("embedding", lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x.cast("double") + 1) / 2)))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", v.alias("v"))


_MIN, _MAX = "list_sum([least(a.v[i], b.v[i]) FOR i IN range(1, len(a.v) + 1)])", "list_sum([greatest(a.v[i], b.v[i]) FOR i IN range(1, len(a.v) + 1)])"
_DOT = "list_sum([a.v[i] * b.v[i] FOR i IN range(1, len(a.v) + 1)])"


@query(f"""WITH {_FUZZY} SELECT a.vec_id AS a_id, b.vec_id AS b_id, round({_MIN} / {_MAX}, 6) AS jaccard, round(2 * {_MIN} / (list_sum(a.v) + list_sum(b.v)), 6) AS dice,
round({_DOT} / (sqrt(list_sum([x * x FOR x IN a.v])) * sqrt(list_sum([x * x FOR x IN b.v]))), 6) AS cosine, round(1 - abs(list_sum(a.v) - list_sum(b.v)) / len(a.v), 6) AS balance,
round(({_MIN}) * ({_MIN}) / ({_MIN} * {_MIN} + 0.5 * {_MIN} * ({_MAX} - {_MIN})), 6) AS rational FROM fz a JOIN fz b ON b.vec_id = a.vec_id + 1""")
def fuzzy_pairs(spark, sf_dir):
    """Similarities of neighbouring fuzzy sets: Jaccard, Dice, cosine, balance, and a rational form."""
    a = fuzzy(spark, sf_dir).select(F.col("vec_id").alias("a_id"), F.col("v").alias("u"))
    b = fuzzy(spark, sf_dir).select(F.col("vec_id").alias("b_id"), (F.col("vec_id") - 1).alias("a_id"), "v")
    u, v = F.col("u"), F.col("v")
    rational = ar.rational_similarity(u, v, {"ad2": 1.0}, {"ad2": 1.0, "b": 0.5, "g": 0.5})
    return rounded(a.join(b, "a_id").select("a_id", "b_id", ar.jaccard(u, v).alias("jaccard"), ar.dice(u, v).alias("dice"), ar.cosine(u, v).alias("cosine"), ar.balance(u, v).alias("balance"), rational.alias("rational")))


@query(f"""WITH {_FUZZY} SELECT count(*) AS n, count(*) FILTER (len(v) > 0 AND len(list_filter(v, lambda x: x < 0 OR x > 1)) = 0) AS n_fuzzy, round(avg(list_sum(v)), 6) AS mean_cardinality, round(min(list_min(v)), 6) AS least, round(max(list_max(v)), 6) AS most FROM fz""")
def fuzzy_validation(spark, sf_dir):
    """Whether vectors are fuzzy sets, and their cardinalities."""
    f = fuzzy(spark, sf_dir)
    return rounded(f.agg(F.count(F.lit(1)).alias("n"), F.count_if(ar.is_fuzzy(F.col("v"))).alias("n_fuzzy"), F.avg(ar.total(F.col("v"))).alias("mean_cardinality"), F.min(F.array_min("v")).alias("least"), F.max(F.array_max("v")).alias("most")))


_SIMS = f"""{_FUZZY}, sims AS (SELECT a.vec_id AS query_id, b.vec_id, b.label, a.label AS own, {_MIN} / {_MAX} AS s FROM fz a JOIN fz b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)"""


@query(f"""WITH {_SIMS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) AS k FROM sims), v AS (SELECT query_id, own, label, sum(s) AS w FROM r WHERE k <= 15 GROUP BY ALL), t AS (SELECT query_id, own, sum(w) AS total FROM v GROUP BY ALL)
SELECT query_id, own AS label, arg_max(v.label, (round(w, 6), -v.label)) AS voted, round(max(w) / min(total), 6) AS share FROM v JOIN t USING (query_id, own) GROUP BY ALL""")
def fuzzy_knn(spark, sf_dir):
    """Similarity-weighted vote of the fifteen nearest."""
    whole = fuzzy(spark, sf_dir)
    f, near = whole.select("vec_id", "label"), pairs.nearest(whole, whole.where("vec_id % 50 = 0"), "vec_id", "v", pairs.jaccard, 15)
    votes = near.join(f.withColumnRenamed("label", "their"), "vec_id").groupBy("query_id", "their").agg(F.sum("similarity").alias("w"))
    g = votes.groupBy("query_id").agg(F.max_by("their", F.struct(F.round("w", 6), -F.col("their"))).alias("voted"), (F.max("w") / F.sum("w")).alias("share"))
    return rounded(g.join(f.withColumnRenamed("vec_id", "query_id"), "query_id").select("query_id", "label", "voted", "share"))


@query(f"""WITH {_SIMS} SELECT own = label AS same_label, count(*) AS n, round(avg(s), 6) AS mean_similarity, round(min(s), 6) AS least, round(max(s), 6) AS most FROM sims GROUP BY ALL""")
def similarity_gap(spark, sf_dir):
    """Similarities within and between labels."""
    f = fuzzy(spark, sf_dir)
    return rounded(pairs.summary(f, f.where("vec_id % 50 = 0"), "vec_id", "v", pairs.jaccard, "label"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), n AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS l FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) / (q.l * c.l) AS s FROM n q JOIN n c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, round(s, 6) AS similarity FROM r WHERE rank <= 5""")
def cosine_topk(spark, sf_dir):
    """The five nearest vectors by cosine."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    s = pairs.nearest(e, e.where("vec_id % 50 = 0"), "vec_id", "e", pairs.cosine, 5, digits=6)
    return rounded(s.select("query_id", "rank", "vec_id", "similarity"))


_NEAR = """edges AS (SELECT a.vec_id AS src, b.vec_id AS dst, sqrt(list_sum([(a.embedding[i]::DOUBLE - b.embedding[i]) ** 2 FOR i IN range(1, 65)])) AS dist FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)"""


@query(f"""WITH {_NEAR}, r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(dist, 6), dst) AS k FROM edges WHERE dist <= 1.2) SELECT src, dst, round(dist, 6) AS dist FROM r WHERE k <= 8""")
def radius_graph(spark, sf_dir):
    """Neighbours within a radius, eight a source at most."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    s = pairs.nearest(e, e.where("vec_id % 50 = 0"), "vec_id", "e", pairs.distance, 8, near_is_large=False, within=1.2, digits=6)
    return rounded(s.select(F.col("query_id").alias("src"), F.col("vec_id").alias("dst"), F.col("similarity").alias("dist")))


@query("""WITH p AS (SELECT p_partkey, p_size::DOUBLE AS a, p_retailprice AS b FROM part), r AS (SELECT max(a) - min(a) AS ra, max(b) - min(b) AS rb FROM p), d AS (SELECT q.p_partkey AS query_id, c.p_partkey AS other, (abs(q.a - c.a) / ra + abs(q.b - c.b) / rb) / 2 AS mean_gap, greatest(abs(q.a - c.a) / ra, abs(q.b - c.b) / rb) AS max_gap FROM p q JOIN p c ON q.p_partkey <> c.p_partkey, r WHERE q.p_partkey % 50 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(mean_gap, 9), round(max_gap, 9), other) AS k FROM d) SELECT query_id, other, round(mean_gap, 6) AS mean_gap, round(max_gap, 6) AS max_gap FROM k WHERE k <= 3""")
def nearest_pairs(spark, sf_dir):
    """Nearest rows under range-normalised absolute differences."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b"))
    r = p.agg(*[(F.max(c) - F.min(c)).alias(f"r{c}") for c in "ab"])
    v = p.crossJoin(F.broadcast(r)).select("id", F.array(F.col("a") / F.col("ra"), F.col("b") / F.col("rb")).alias("v"))  # one row
    d = pairs.nearest(v, v.where("id % 50 = 0"), "id", "v", pairs.mean_gap, 3, near_is_large=False, then=pairs.max_gap)
    return rounded(d.select("query_id", F.col("id").alias("other"), F.col("similarity").alias("mean_gap"), F.col("most").alias("max_gap")))


@query("""WITH s AS (SELECT vec_id, label, ('0x' || substr(sha256('acq|' || vec_id), 1, 8))::BIGINT AS h, abs(embedding[1]::DOUBLE) AS u FROM embeddings), chosen AS (SELECT vec_id FROM s ORDER BY h, vec_id LIMIT 50), rest AS (SELECT * FROM s ANTI JOIN chosen USING (vec_id)), r AS (SELECT *, row_number() OVER (ORDER BY u DESC, h) AS k FROM rest) SELECT vec_id, label, round(u, 6) AS uncertainty, k::INTEGER AS k FROM r WHERE k <= 20""")
def acquire_step(spark, sf_dir):
    """One step of active learning: hash-ordered start set, then the most uncertain of the rest."""
    s = table(spark, sf_dir, "embeddings").select("vec_id", "label", hash_unit(F.lit("acq"), F.col("vec_id").cast("string")).alias("h"), F.abs(F.get("embedding", F.lit(0)).cast("double")).alias("u"))
    chosen = s.orderBy("h", "vec_id").limit(50).select("vec_id")
    few = s.join(chosen, "vec_id", "left_anti").orderBy(F.desc("u"), "h").limit(20)
    return rounded(few.withColumn("k", F.row_number().over(Window.orderBy(F.desc("u"), "h"))).select("vec_id", "label", F.col("u").alias("uncertainty"), "k"))  # twenty rows


@query("""WITH RECURSIVE e AS (SELECT a.p_partkey AS src, b.p_partkey AS dst FROM (SELECT *, row_number() OVER (PARTITION BY p_name, p_brand ORDER BY p_partkey) AS k FROM part) a JOIN (SELECT *, row_number() OVER (PARTITION BY p_name, p_brand ORDER BY p_partkey) AS k FROM part) b ON a.p_name = b.p_name AND a.p_brand = b.p_brand AND b.k = a.k + 1)
SELECT p_partkey AS node, min(p_partkey) OVER (PARTITION BY p_name, p_brand) AS label FROM part WHERE (p_name, p_brand) IN (SELECT (p_name, p_brand) FROM part GROUP BY p_name, p_brand HAVING count(*) > 1)""")
def chain_components(spark, sf_dir):
    """Connected components of a graph of long chains (each part with the next of its name and brand)."""
    from quillon.operators.graph import components

    w = Window.partitionBy("p_name", "p_brand").orderBy("p_partkey")
    e = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("a"), F.lead("p_partkey").over(w).alias("b")).where("b is not null")
    return components(e)
