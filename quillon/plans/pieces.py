"""One query for each small operator: scans and sinks, casts, joins, set operations, scores and guards, each with its own SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions.text import hash_unit
from quillon.io import shared_dir, staged, table
from quillon.operators import graph, metrics, nested, retrieval
from quillon.plans.registry import query, rounded
from quillon.plans.resampling import _h
from quillon.sources import files


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# ---- scans and sinks ----


@query("SELECT n_nationkey, n_name, n_regionkey, (n_nationkey + 0.5)::DOUBLE AS score FROM nation")
def csv_round_trip(spark, sf_dir):
    """A table written as CSV in a declared order and scanned again under its contract."""
    path = _folder(spark, "csv")
    files.write_csv(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey", (F.col("n_nationkey") + F.lit(0.5)).cast("double").alias("score")), path, ["n_nationkey"])
    return files.csv(spark, path, "n_nationkey long, n_name string, n_regionkey long, score double")


@query("SELECT conv_id, turn, role, length(text) AS n_chars FROM conversations")
def jsonl_round_trip(spark, sf_dir):
    """Rows written as JSON lines and scanned strictly."""
    path = _folder(spark, "jsonl")
    files.write_jsonl(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").cast("long").alias("n_chars")), path)
    return files.jsonl(spark, path, "conv_id long, turn int, role string, n_chars long")


@query(r"SELECT doc_id, len(s)::INTEGER AS n_sentences, s[1] AS title, length(array_to_string(s, ' ')) AS n_searchable FROM (SELECT doc_id, list_filter(string_split_regex(text, '[.\n]+'), lambda x: trim(x) <> '') AS s FROM documents)")
def corpus_sentences(spark, sf_dir):
    """Documents as titles and arrays of sentences."""
    s = F.filter(F.split("text", r"[.\n]+"), lambda x: F.trim(x) != "")
    d = table(spark, sf_dir, "documents").select("doc_id", s.alias("s"))
    return d.select("doc_id", F.size("s").alias("n_sentences"), F.get("s", F.lit(0)).alias("title"), F.length(F.array_join("s", " ")).cast("long").alias("n_searchable"))


@query("SELECT doc_id, lang, source FROM documents")
def restricted_scan(spark, sf_dir):
    """A view of declared columns; labels and texts are never read."""
    return files.only(table(spark, sf_dir, "documents"), ["doc_id", "lang", "source"])


# ---- projections ----


@query("SELECT c_custkey AS id, CASE WHEN trim(c_name) <> '' THEN trim(c_name) END AS name, c_mktsegment AS segment FROM customer")
def renamed_identifiers(spark, sf_dir):
    """Columns renamed, identifiers trimmed, blank ones null."""
    name = F.trim("c_name")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(name != "", name).alias("name"), F.col("c_mktsegment").alias("segment"))


@query("SELECT user_id, event_id, try_cast(CASE WHEN event_id % 3 = 0 THEN 'n/a' ELSE (event_id % 50)::VARCHAR || '.5' END AS DOUBLE) AS number, event_id % 3 = 0 AS was_bad FROM events")
def coerced_numbers(spark, sf_dir):
    """Texts cast to numbers; those that don't parse become null and are flagged."""
    raw = F.when(F.col("event_id") % 3 == 0, "n/a").otherwise(F.concat((F.col("event_id") % 50).cast("string"), F.lit(".5")))
    return table(spark, sf_dir, "events").select("user_id", "event_id", raw.try_cast("double").alias("number"), raw.try_cast("double").isNull().alias("was_bad"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def membership_filter(spark, sf_dir):
    """Rows by a mask, by membership in a list, and by absence from a set."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    poor = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return o.join(poor, "o_custkey", "left_anti").select("o_orderkey", "o_totalprice")


# ---- joins and sets ----


@query("SELECT l.doc_id, l.quality, d.n_chars FROM labels l JOIN documents d ON d.doc_id = l.doc_id")
def one_to_one_join(spark, sf_dir):
    """Two tables with unique keys; a repeated key on either side is refused."""
    from quillon.operators.checks import require

    lab, d = require(table(spark, sf_dir, "labels").select("doc_id", "quality"), keys=["doc_id"]), require(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), keys=["doc_id"])
    return lab.join(d, "doc_id")


@query("WITH w AS (SELECT unnest([7, 3, 11, 3]) AS k, unnest([0, 1, 2, 3]) AS place) SELECT place, k, n_name FROM w JOIN nation ON n_nationkey = k")
def ordered_gather(spark, sf_dir):
    """Rows looked up in a given order, repeats included."""
    w = spark.sql("SELECT place, k FROM (SELECT posexplode(array(7, 3, 11, 3)) AS (place, k))")
    return w.join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("k")).select("place", "k", "n_name")


@query("SELECT r_regionkey, r_name, CASE r_name WHEN 'ASIA' THEN 'east' WHEN 'EUROPE' THEN 'west' END AS side FROM region")
def map_join(spark, sf_dir):
    """A column through a dictionary; unknown values become null."""
    sides = F.create_map(F.lit("ASIA"), F.lit("east"), F.lit("EUROPE"), F.lit("west"))
    return table(spark, sf_dir, "region").select("r_regionkey", "r_name", F.try_element_at(sides, F.col("r_name")).alias("side"))


@query("SELECT DISTINCT k FROM (SELECT s_nationkey AS k FROM supplier UNION ALL SELECT c_nationkey FROM customer WHERE c_acctbal > 9000)")
def candidate_union(spark, sf_dir):
    """The distinct union of candidate keys."""
    c = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k"))
    return table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")).union(c).distinct()


@query("SELECT a.vec_id, a.x, b.y FROM (SELECT vec_id, embedding[1]::DOUBLE AS x FROM embeddings) a JOIN (SELECT vec_id, embedding[2]::DOUBLE AS y FROM embeddings) b USING (vec_id)")
def column_concat(spark, sf_dir):
    """Two frames side by side, aligned by key."""
    e = table(spark, sf_dir, "embeddings")
    part = lambda at, name: e.select("vec_id", F.get("embedding", F.lit(at)).cast("double").alias(name))
    return part(0, "x").join(part(1, "y"), "vec_id")


# ---- scores and guards ----

_FIT = "f AS (SELECT o_orderkey, o_totalprice AS y, avg(o_totalprice) OVER (PARTITION BY o_orderpriority) AS p FROM orders)"


@query(f"WITH {_FIT} SELECT count(*) AS n, round(avg(abs(y - p)), 4) AS mae, round(sqrt(avg((y - p) ** 2)), 4) AS rmse, round(1 - sum((y - p) ** 2) / (count(*) * var_pop(y)), 6) AS r2 FROM f")
def regression_metrics(spark, sf_dir):
    """Errors and explained share of a prediction by group means."""
    o = table(spark, sf_dir, "orders").select("o_orderpriority", F.col("o_totalprice").alias("y"))
    f = o.join(F.broadcast(o.groupBy("o_orderpriority").agg(F.avg("y").alias("p"))), "o_orderpriority")  # a row for each priority
    e = F.col("y") - F.col("p")
    return f.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(e)), 4).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 4).alias("rmse"), F.round(1 - F.sum(e * e) / (F.count(F.lit(1)) * F.var_pop("y")), 6).alias("r2"))


@query(f"WITH s AS (SELECT {_h(chr(39) + 'dummy' + chr(39), 'doc_id')} % 4 AS fold, quality FROM labels), t AS (SELECT g.fold, avg(quality) AS prior FROM (SELECT DISTINCT fold FROM s) g JOIN s ON s.fold <> g.fold GROUP BY g.fold) SELECT t.fold::INTEGER AS fold, count(*) AS n, round(min(prior), 6) AS prior, round(avg((quality - prior) ** 2), 6) AS brier, round(avg(((prior >= 0.5)::INT = quality)::INT), 6) AS accuracy FROM s JOIN t ON t.fold = s.fold GROUP BY t.fold")
def dummy_prior(spark, sf_dir):
    """The share of positives in the other folds as everyone's score."""
    s = table(spark, sf_dir, "labels").select((hash_unit(F.lit("dummy"), F.col("doc_id").cast("string")) % 4).cast("int").alias("fold"), F.col("quality").cast("int").alias("y"))
    by = s.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s"))
    every = by.agg(F.sum("n").alias("a"), F.sum("s").alias("b"))
    prior = by.crossJoin(every).select("fold", ((F.col("b") - F.col("s")) / (F.col("a") - F.col("n"))).alias("prior"))  # one row
    d = F.col("y") - F.col("prior")
    return rounded(s.join(F.broadcast(prior), "fold").groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.min("prior").alias("prior"), F.avg(d * d).alias("brier"), F.avg(((F.col("prior") >= 0.5).cast("int") == F.col("y")).cast("int")).alias("accuracy")))  # four rows


@query("SELECT vec_id, round(1 / (1 + exp(-4 * embedding[1]::DOUBLE)), 6) AS squashed, round(ln((embedding[2]::DOUBLE + 2) / (2 - embedding[2]::DOUBLE)), 6) AS logit FROM embeddings")
def sigmoid_logit(spark, sf_dir):
    """A score squashed to (0, 1), and log odds."""
    x = lambda k: F.get("embedding", F.lit(k)).cast("double")
    return rounded(table(spark, sf_dir, "embeddings").select("vec_id", (1 / (1 + F.exp(-4 * x(0)))).alias("squashed"), F.log((x(1) + 2) / (2 - x(1))).alias("logit")))


@query("SELECT vec_id, round(quantile_cont(x, 0.25), 6) AS q25, round(quantile_cont(x, 0.5), 6) AS q50, round(quantile_cont(x, 0.9), 6) AS q90 FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY vec_id")
def array_percentiles(spark, sf_dir):
    """Percentiles, linear between neighbours, inside each row's array."""
    s = F.col("s")

    def at(q):
        place = F.lit(q) * (F.size(s) - 1)
        low = F.floor(place).cast("int")
        return F.get(s, low) + (place - low) * (F.get(s, F.ceil(place).cast("int")) - F.get(s, low))

    e = table(spark, sf_dir, "embeddings").select("vec_id", F.sort_array(F.transform("embedding", lambda x: x.cast("double"))).alias("s"))
    return rounded(e.select("vec_id", at(0.25).alias("q25"), at(0.5).alias("q50"), at(0.9).alias("q90")))


@query("SELECT user_id, round(coalesce(count(*) FILTER (event_type = 'purchase') / nullif(count(*) FILTER (event_type = 'click'), 0), 0), 6) AS ratio, round(coalesce(avg(value) FILTER (event_type = 'error'), 0), 6) AS mean_or_zero, round(avg((event_type = 'view')::INT), 6) AS prevalence FROM events GROUP BY user_id")
def guarded_ratios(spark, sf_dir):
    """Ratios that are 0 where nothing is below the line, means that are 0 where there is nothing, prevalence."""
    hit = lambda t: F.count_if(F.col("event_type") == t)
    none = F.coalesce(F.avg(F.when(F.col("event_type") == "error", F.col("value"))), F.lit(0.0))
    return rounded(table(spark, sf_dir, "events").groupBy("user_id").agg(metrics.ratio(hit("purchase"), hit("click")).alias("ratio"), none.alias("mean_or_zero"), F.avg((F.col("event_type") == "view").cast("int")).alias("prevalence")))


@query(f"WITH g AS (SELECT o_orderpriority AS model, {_h(chr(39) + 'sum' + chr(39), 'o_orderkey')} % 3 AS fold, avg(o_totalprice) AS score FROM orders GROUP BY ALL) SELECT model, count(*) AS n_folds, round(avg(score), 4) AS mean_score, round(stddev_samp(score), 4) AS std_score, round(max(score) - min(score), 4) AS span, rank() OVER (ORDER BY round(avg(score), 4) DESC)::INTEGER AS place FROM g GROUP BY model")
def benchmark_summary(spark, sf_dir):
    """Models over folds: mean, deviation, span and place."""
    fold = (hash_unit(F.lit("sum"), F.col("o_orderkey").cast("string")) % 3).alias("fold")
    g = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("model"), fold).agg(F.avg("o_totalprice").alias("score"))
    s = rounded(g.groupBy("model").agg(F.count(F.lit(1)).alias("n_folds"), F.avg("score").alias("mean_score"), F.stddev_samp("score").alias("std_score"), (F.max("score") - F.min("score")).alias("span")), 4)
    return s.withColumn("place", F.rank().over(Window.orderBy(F.desc("mean_score"))))  # a row for each model


# ---- pairs of texts, crystals ----


@query(r"""WITH t AS (SELECT item_id AS doc_id, regexp_extract_all(translate(lower(text), 'áàâäéèêëíìîïóòôöúùûüñç', 'aaaaeeeeiiiioooouuuunc'), '[\p{L}\p{N}_]+') AS t FROM benchmark), g AS (SELECT doc_id, unnest(list_concat(t, [t[i] || ' ' || t[i + 1] FOR i IN range(1, len(t))])) AS term FROM t), tf AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM benchmark)) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term)), u AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM w), m AS (SELECT max(doc_id) AS m FROM t),
a AS (SELECT doc_id AS claim, term, w AS c FROM u WHERE doc_id < (SELECT m FROM m)), b AS (SELECT doc_id - 1 AS claim, term, w AS e FROM u), j AS (SELECT claim, term, coalesce(c, 0) AS c, coalesce(e, 0) AS e FROM a FULL JOIN b USING (claim, term))
SELECT claim, count(*) AS n_terms, round(sum(c * e), 6) AS product_sum, round(sum(abs(c - e)), 6) AS gap_sum FROM j WHERE claim IN (SELECT doc_id FROM t) AND claim < (SELECT m FROM m) GROUP BY claim""")
def relation_terms(spark, sf_dir):
    """Sparse features of pairs of texts (each with the next): both sides' TF-IDF, product and absolute difference of each term."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    w = staged(retrieval.tfidf(b), "tfidf")
    last = b.agg(F.max("doc_id").alias("m"))
    pairs = b.select(F.col("doc_id").alias("claim")).crossJoin(last).where("claim < m").select("claim", (F.col("claim") + 1).alias("evidence"))  # one row
    f = nested.relation_terms(pairs, w)
    return rounded(f.groupBy("claim").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("product").alias("product_sum"), F.sum("gap").alias("gap_sum")))


_SITES = f"""s AS (SELECT p_partkey AS crystal, k AS site, 3.0::DOUBLE + (p_size % 5) * 0.25 AS a, {_h(chr(39) + 'x' + chr(39), 'p_partkey', 'k')} % 8 / 8.0::DOUBLE AS x, {_h(chr(39) + 'y' + chr(39), 'p_partkey', 'k')} % 8 / 8.0::DOUBLE AS y, {_h(chr(39) + 'z' + chr(39), 'p_partkey', 'k')} % 8 / 8.0::DOUBLE AS z FROM part, (SELECT unnest(range(0, 3)) AS k) r)"""


@query(f"""WITH {_SITES}, i AS (SELECT unnest(range(-1, 2)) AS i), n AS (SELECT p.crystal, p.site AS src, q.site AS dst, i.i AS i, j.i AS j, k.i AS k, p.a * sqrt((q.x + i.i - p.x) ** 2 + (q.y + j.i - p.y) ** 2 + (q.z + k.i - p.z) ** 2) AS dist FROM s p JOIN s q ON q.crystal = p.crystal, i, i j, i k),
r AS (SELECT *, row_number() OVER (PARTITION BY crystal, src ORDER BY round(dist, 6), dst, i, j, k) AS place FROM n WHERE dist <= 3.2 AND NOT (src = dst AND i = 0 AND j = 0 AND k = 0)) SELECT crystal, src::INTEGER AS src, dst::INTEGER AS dst, i::INTEGER AS i, j::INTEGER AS j, k::INTEGER AS k, round(dist, 6) AS dist FROM r WHERE place <= 6""")
def crystal_graph(spark, sf_dir):
    """Neighbours of sites within a cutoff, over the periodic images of a cubic cell, six a site at most (parts stand for crystals)."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("crystal"), (3.0 + (F.col("p_size") % 5) * 0.25).alias("a"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("site"))
    at = lambda c: (hash_unit(F.lit(c), F.col("crystal").cast("string"), F.col("site").cast("string")) % 8 / 8.0)
    zero = F.lit(0.0)
    cell = F.array(F.array("a", zero, zero), F.array(zero, F.col("a"), zero), F.array(zero, zero, F.col("a")))
    sites = p.select("crystal", "site", cell.alias("cell"), F.array(at("x"), at("y"), at("z")).alias("frac"))
    return rounded(graph.periodic_neighbours(sites, 3.2, 6))
