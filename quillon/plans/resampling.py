"""Hash-ordered samples, splits and resampling, reproducible in any engine with SHA-256."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions.text import hash_unit
from quillon.io import table
from quillon.operators import splits
from quillon.plans.registry import query, rounded


def _h(*parts: str) -> str:
    return "('0x' || substr(sha256(" + " || '|' || ".join(parts) + "), 1, 8))::BIGINT"


@query(f"SELECT o_orderkey, o_orderpriority FROM orders ORDER BY sha256('7|' || o_orderkey), o_orderkey LIMIT 100")
def hash_sample(spark, sf_dir):
    """A hundred orders in the order of their hashes: a seeded sample (the limit is the feature)."""
    return splits.hash_sample(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", "7", 100)


_SPLIT = f"sp AS (SELECT o_orderkey, o_custkey, o_orderpriority, CASE WHEN {_h(chr(39) + 'split' + chr(39), 'o_custkey')} % 10 < 8 THEN 'train' ELSE 'test' END AS part FROM orders)"


@query(f"WITH {_SPLIT} SELECT o_orderkey, o_custkey, part FROM sp")
def hash_split(spark, sf_dir):
    """A split by customers: all orders of a customer on one side."""
    return splits.by_hash(table(spark, sf_dir, "orders"), "o_custkey", "split").select("o_orderkey", "o_custkey", "part")


@query(f"WITH {_SPLIT}, a AS (SELECT count(*) FILTER (part = 'train') AS n_train, count(*) FILTER (part = 'test') AS n_test FROM sp), c AS (SELECT count(*) AS n FROM (SELECT o_custkey FROM sp GROUP BY o_custkey HAVING count(DISTINCT part) > 1)), p AS (SELECT count(*) AS n FROM (SELECT o_orderpriority FROM sp WHERE part = 'train' INTERSECT SELECT o_orderpriority FROM sp WHERE part = 'test')) SELECT n_train, n_test, c.n AS n_shared_customers, p.n AS n_shared_priorities, n_train + n_test = (SELECT count(*) FROM orders) AS covers FROM a, c, p")
def split_audit(spark, sf_dir):
    """Invariants of the split: disjoint in customers, covering."""
    o = table(spark, sf_dir, "orders")
    return splits.audit(splits.by_hash(o, "o_custkey", "split"), o, "o_custkey", "o_orderpriority")


@query(f"WITH k AS (SELECT DISTINCT o_custkey FROM orders), held AS (SELECT o_custkey FROM k WHERE {_h(chr(39) + 'cold' + chr(39), 'o_custkey')} % 5 = 0) SELECT 'test' AS part, count(*) AS n, count(DISTINCT o_custkey) AS n_customers FROM orders SEMI JOIN held USING (o_custkey) UNION ALL SELECT 'train', count(*), count(DISTINCT o_custkey) FROM orders ANTI JOIN held USING (o_custkey)")
def cold_split(spark, sf_dir):
    """Held-out customers by semi and anti join."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    held = o.select("o_custkey").distinct().where(hash_unit(F.lit("cold"), F.col("o_custkey").cast("string")) % 5 == 0)
    summary = lambda df, part: df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("n_customers")).select(F.lit(part).alias("part"), "n", "n_customers")
    return summary(o.join(held, "o_custkey", "left_semi"), "test").unionByName(summary(o.join(held, "o_custkey", "left_anti"), "train"))


@query(f"WITH r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256('strat|' || o_orderkey), o_orderkey) AS k, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) SELECT o_orderpriority, count(*) FILTER (k <= ceil(0.2::DOUBLE * n)) AS n_test, count(*) FILTER (k > ceil(0.2::DOUBLE * n)) AS n_train FROM r GROUP BY ALL")
def stratified_split(spark, sf_dir):
    """A fifth of each stratum, by hash order."""
    s = splits.stratified(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderkey", "strat", 0.2)
    return s.groupBy("o_orderpriority").agg(F.count_if("is_test").alias("n_test"), F.count_if(~F.col("is_test")).alias("n_train"))


@query(f"WITH f AS (SELECT doc_id, {_h(chr(39) + 'f' + chr(39), 'doc_id')} % 5 AS fold FROM labels), k AS (SELECT unnest(range(0, 5)) AS test_fold) SELECT test_fold, count(*) FILTER (fold = test_fold) AS n_test, count(*) FILTER (fold <> test_fold) AS n_train FROM k, f GROUP BY test_fold")
def train_only_folds(spark, sf_dir):
    """Folds derived from labelled rows alone: what each fold trains and tests on."""
    f = table(spark, sf_dir, "labels").select((hash_unit(F.lit("f"), F.col("doc_id").cast("string")) % 5).alias("fold")).groupBy("fold").agg(F.count(F.lit(1)).alias("n"))
    total = f.agg(F.sum("n").alias("total"))
    return f.crossJoin(F.broadcast(total)).select(F.col("fold").alias("test_fold"), F.col("n").alias("n_test"), (F.col("total") - F.col("n")).alias("n_train"))  # five rows


_ARMS = "arms AS (SELECT user_id, avg(value) FILTER (event_type = 'view') AS a, avg(value) FILTER (event_type = 'click') AS b FROM events GROUP BY user_id HAVING a IS NOT NULL AND b IS NOT NULL), pr AS (SELECT row_number() OVER (ORDER BY user_id) - 1 AS i, b - a AS d FROM arms), n AS (SELECT count(*) AS n FROM pr)"


@query(f"WITH {_ARMS}, dr AS (SELECT rep, {_h(chr(39) + 'boot' + chr(39), 'rep', 'k')} % n AS i FROM (SELECT unnest(range(0, 200)) AS rep) r, n, LATERAL (SELECT unnest(range(0, n)) AS k) s), m AS (SELECT rep, avg(d) AS m FROM dr JOIN pr USING (i) GROUP BY rep) SELECT (SELECT n FROM n) AS n, round((SELECT avg(d) FROM pr), 6) AS delta, round(quantile_cont(m, 0.025), 6) AS lower, round(quantile_cont(m, 0.975), 6) AS upper FROM m")
def bootstrap_ci(spark, sf_dir):
    """Paired bootstrap interval of a difference of means, by hashed draws."""
    return rounded(splits.bootstrap(splits.paired(table(spark, sf_dir, "events")), 200, "boot"))


@query(f"WITH {_ARMS}, s AS (SELECT rep, avg(CASE WHEN {_h(chr(39) + 'flip' + chr(39), 'rep', 'i')} % 2 = 0 THEN d ELSE -d END) AS m FROM (SELECT unnest(range(0, 500)) AS rep) r, pr GROUP BY rep) SELECT count(*) FILTER (abs(m) >= abs((SELECT avg(d) FROM pr)) - 1e-9) AS n_extreme, round((count(*) FILTER (abs(m) >= abs((SELECT avg(d) FROM pr)) - 1e-9) + 1) / 501, 6) AS p_value FROM s")
def signflip(spark, sf_dir):
    """Sign-flip permutation test of paired differences."""
    return rounded(splits.sign_flip(splits.paired(table(spark, sf_dir, "events")), 500, "flip"))


@query(f"WITH b AS (SELECT c_custkey, (c_mktsegment IN ('BUILDING', 'AUTOMOBILE'))::INT AS t, c_acctbal AS y FROM customer), r AS (SELECT rep, avg(y) FILTER (h < 0.4) - avg(y) FILTER (h >= 0.4) AS e FROM (SELECT rep, y, {_h(chr(39) + 'placebo' + chr(39), 'rep', 'c_custkey')} / 4294967296.0 AS h FROM (SELECT unnest(range(0, 100)) AS rep) k, b) GROUP BY rep), o AS (SELECT avg(y) FILTER (t = 1) - avg(y) FILTER (t = 0) AS e FROM b) SELECT round(o.e, 4) AS effect, round((count(*) FILTER (abs(r.e) >= abs(o.e)) + 1) / 101, 6) AS p_value FROM r, o GROUP BY o.e")
def refutation(spark, sf_dir):
    """Placebo treatments: how often a hashed assignment does as well."""
    b = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").isin("BUILDING", "AUTOMOBILE").alias("t"), F.col("c_acctbal").alias("y"))
    o = b.agg((F.avg(F.when(F.col("t"), F.col("y"))) - F.avg(F.when(~F.col("t"), F.col("y")))).alias("effect"))
    h = hash_unit(F.lit("placebo"), F.col("rep").cast("string"), F.col("c_custkey").cast("string")) / F.lit(4294967296.0)
    r = b.select("c_custkey", "y", F.explode(F.sequence(F.lit(0), F.lit(99))).alias("rep")).withColumn("h", h).groupBy("rep").agg((F.avg(F.when(F.col("h") < 0.4, F.col("y"))) - F.avg(F.when(F.col("h") >= 0.4, F.col("y")))).alias("e"))
    both = r.crossJoin(F.broadcast(o))  # one row
    return both.groupBy("effect").agg(((F.count_if(F.abs("e") >= F.abs("effect")) + 1) / 101).alias("p_value")).select(F.round("effect", 4).alias("effect"), F.round("p_value", 6).alias("p_value"))
