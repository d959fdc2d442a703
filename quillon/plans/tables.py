"""Projections, validation, joins, set operations, reshaping and text predicates over the business tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import text as tx
from quillon.io import staged, table
from quillon.operators import checks
from quillon.plans.registry import query, rounded


@query("""SELECT o_orderkey AS order_id, trim(o_orderstatus) AS status, o_orderstatus = 'F' AS is_final, 'train:' || o_orderkey AS pair_key, 9 - log10(o_totalprice) AS p_price_raw,
round(9 - log10(o_totalprice), 6) AS p_price, (o_totalprice <= 100000)::TINYINT AS label_100000, (o_totalprice <= 300000)::TINYINT AS label_300000,
CASE WHEN o_totalprice < 50000 THEN 'small' WHEN o_totalprice < 200000 THEN 'medium' ELSE 'large' END AS size_class, CASE WHEN o_totalprice = floor(o_totalprice) THEN o_totalprice::BIGINT END AS whole_price FROM orders""".replace("9 - log10(o_totalprice) AS p_price_raw,\n", ""))
def contract_scan(spark, sf_dir):
    """A scan to a fixed column contract: renames, unit conversion, threshold labels, branches, composite keys, integral keys."""
    o = table(spark, sf_dir, "orders")
    labels = {f"label_{t}": (F.col("o_totalprice") <= t).cast("tinyint") for t in (100000, 300000)}
    whole = F.when(F.col("o_totalprice") == F.floor("o_totalprice"), F.col("o_totalprice").cast("long"))
    size = F.when(F.col("o_totalprice") < 50000, "small").when(F.col("o_totalprice") < 200000, "medium").otherwise("large")
    return o.select(
        F.col("o_orderkey").alias("order_id"), F.trim("o_orderstatus").alias("status"), F.col("o_orderstatus").eqNullSafe("F").alias("is_final"), F.concat_ws(":", F.lit("train"), "o_orderkey").alias("pair_key"),
        F.round(9 - F.log10("o_totalprice"), 6).alias("p_price"), *[c.alias(k) for k, c in labels.items()], size.alias("size_class"), whole.alias("whole_price"),
    )


@query("""SELECT event_id, (props->>'$.k')::INTEGER AS k, length(props) AS n_chars, len(json_keys(props)) AS n_keys FROM events""")
def json_props(spark, sf_dir):
    """Nested JSON properties to columns."""
    e = table(spark, sf_dir, "events").select("event_id", "props", F.from_json("props", "k int").alias("p"))
    return e.select("event_id", F.col("p.k").alias("k"), F.length("props").cast("long").alias("n_chars"), F.size(F.json_object_keys("props")).cast("long").alias("n_keys"))


@query("""WITH d AS (SELECT sum(n - 1) AS n FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_partkey, l_suppkey HAVING count(*) > 1))
SELECT (SELECT count(*) FROM events WHERE event_id IS NULL OR ts IS NULL OR user_id IS NULL) AS n_incomplete, (SELECT count(*) FROM labels WHERE quality NOT IN (0, 1) OR toxic NOT IN (0, 1)) AS n_not_binary,
(SELECT count(*) FROM labels l ANTI JOIN documents d ON l.doc_id = d.doc_id) AS n_dangling, coalesce((SELECT n FROM d), 0)::BIGINT AS n_repeated_pairs, (SELECT count(DISTINCT l_partkey) FROM lineitem) AS n_parts, (SELECT count(DISTINCT l_suppkey) FROM lineitem) AS n_suppliers""")
def record_validation(spark, sf_dir):
    """Counts of incomplete, non-binary, dangling and repeated records."""
    e, lab, li = (table(spark, sf_dir, t) for t in ("events", "labels", "lineitem"))
    pairs = li.groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    parts = [
        e.agg(F.count_if(F.col("event_id").isNull() | F.col("ts").isNull() | F.col("user_id").isNull()).alias("n_incomplete")),
        lab.agg(F.count_if(~F.col("quality").isin(0, 1) | ~F.col("toxic").isin(0, 1)).alias("n_not_binary")),
        checks.dangling(lab, table(spark, sf_dir, "documents"), "doc_id").agg(F.count(F.lit(1)).alias("n_dangling")),
        pairs.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n") - 1)), F.lit(0)).alias("n_repeated_pairs")),
        li.agg(F.count_distinct("l_partkey").alias("n_parts"), F.count_distinct("l_suppkey").alias("n_suppliers")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out


@query("""SELECT 'labels' AS source, (SELECT count(*) FROM labels SEMI JOIN documents USING (doc_id)) AS n_matched, (SELECT count(*) FROM documents ANTI JOIN labels USING (doc_id)) AS n_extra, (SELECT count(*) FROM labels ANTI JOIN documents USING (doc_id)) AS n_missing
UNION ALL SELECT 'orders', (SELECT count(*) FROM orders SEMI JOIN customer ON o_custkey = c_custkey), (SELECT count(*) FROM customer ANTI JOIN orders ON o_custkey = c_custkey), (SELECT count(*) FROM orders ANTI JOIN customer ON o_custkey = c_custkey)""")
def alignment_joins(spark, sf_dir):
    """Key sets of two sides compared by semi and anti joins."""
    lab, d = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select("doc_id")
    o, c = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return checks.alignment(lab, d, "doc_id", "labels").unionByName(checks.alignment(o, c, "k", "orders"))


@query("""SELECT l_suppkey AS supplier, l_partkey AS part, (l_suppkey * 100000 + l_partkey)::BIGINT AS flat_index, round(-log10(avg(l_extendedprice) / 1e9), 6) AS p_affinity, (avg(l_extendedprice) <= 40000)::TINYINT AS label, s_nationkey, p_size FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY ALL""")
def pair_features(spark, sf_dir):
    """Pairs of suppliers and parts with a label and features of both sides (many-to-one joins on unique keys)."""
    pairs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("supplier"), F.col("l_partkey").alias("part")).agg(F.avg("l_extendedprice").alias("affinity"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("supplier"), "s_nationkey")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), "p_size")
    wide = pairs.join(s, "supplier").join(p, "part")
    return wide.select("supplier", "part", (F.col("supplier") * 100000 + F.col("part")).alias("flat_index"), F.round(-F.log10(F.col("affinity") / 1e9), 6).alias("p_affinity"), (F.col("affinity") <= 40000).cast("tinyint").alias("label"), "s_nationkey", "p_size")


@query("""SELECT count(*) AS n_rows, count(DISTINCT l_partkey) AS n_parts, count(DISTINCT l_suppkey) AS n_suppliers, min(l_extendedprice) AS min_price, max(l_extendedprice) AS max_price, round(avg((l_extendedprice <= 40000)::INT), 6) AS positive_rate, count(*) FILTER (NOT isfinite(l_extendedprice)) AS n_not_finite FROM lineitem""")
def label_summary(spark, sf_dir):
    """Summary of an interaction table."""
    x = F.col("l_extendedprice")
    return rounded(table(spark, sf_dir, "lineitem").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("l_partkey").alias("n_parts"), F.count_distinct("l_suppkey").alias("n_suppliers"), F.min(x).alias("min_price"), F.max(x).alias("max_price"), F.avg((x <= 40000).cast("int")).alias("positive_rate"), F.count_if(F.isnan(x) | (F.abs(x) == float("inf"))).alias("n_not_finite")))


_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, count(DISTINCT {c}) AS n_distinct, min({c}) AS min_value, max({c}) AS max_value, round(avg({c}), 4) AS mean_value, round(stddev_pop({c}), 4) AS std_value, var_pop({c}) = 0 AS is_constant FROM lineitem" for c in _NUMERIC))
def table_profile(spark, sf_dir):
    """Profile of numeric columns, by one unpivot."""
    long = table(spark, sf_dir, "lineitem").select(*_NUMERIC).unpivot([], _NUMERIC, "feature", "x")
    return rounded(long.groupBy("feature").agg(F.count_distinct("x").alias("n_distinct"), F.min("x").alias("min_value"), F.max("x").alias("max_value"), F.avg("x").alias("mean_value"), F.stddev_pop("x").alias("std_value"), (F.var_pop("x") == 0).alias("is_constant")), 4)


@query("""SELECT o_orderstatus AS value, count(*) AS n, count(DISTINCT o_custkey) AS n_customers FROM orders GROUP BY ALL""")
def value_counts(spark, sf_dir):
    """Value counts with nulls kept."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("value")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("n_customers"))


_PAIRS = [(a, b) for i, a in enumerate(_NUMERIC) for b in _NUMERIC[i + 1 :]]


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for a, b in _PAIRS) + ") WHERE abs(r) >= 0.0001")
def corr_pairs(spark, sf_dir):
    """Correlations of all pairs of columns above a threshold, in one aggregation."""
    one = table(spark, sf_dir, "lineitem").agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in _PAIRS])
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.col(f"`{a}|{b}`"), 6).alias("r")) for a, b in _PAIRS])
    return one.select(F.inline(cells)).where(F.abs("r") >= 0.0001)


@query("""WITH g AS (SELECT p_name, p_brand, count(*) AS n, list_sort(list(p_partkey)) AS ids FROM part GROUP BY ALL HAVING count(*) > 1) SELECT p_name, p_brand, n, ids[1] AS first_id, ids[-1] AS last_id, n * (n - 1) // 2 AS n_pairs FROM g""")
def collision_groups(spark, sf_dir):
    """Groups of rows with equal features, and their pairs."""
    g = table(spark, sf_dir, "part").groupBy("p_name", "p_brand").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first_id"), F.max("p_partkey").alias("last_id")).where("n > 1")
    return g.select("p_name", "p_brand", "n", "first_id", "last_id", (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("n_pairs"))


@query("""SELECT doc_id, """ + ", ".join(f"round(coalesce((length(s) - length(replace(s, '{c}', ''))) / nullif(length(s), 0), 0), 6) AS share_{c.lower()}" for c in "AEIOU") + """ FROM (SELECT doc_id, regexp_replace(upper(text), '[^AEIOU]', '', 'g') AS s FROM documents)""")
def sequence_features(spark, sf_dir):
    """Composition of texts over an alphabet."""
    return rounded(table(spark, sf_dir, "documents").select("doc_id", *[c.alias(k) for k, c in tx.composition(F.col("text"), "AEIOU").items()]))


@query(r"""WITH t AS (SELECT p_partkey, regexp_extract_all(p_type || ' ' || p_name, '\[[^\]]*\]|CL|BR|[BCNOFPSI]|[cnops]') AS a FROM part)
SELECT p_partkey, len(a) AS n_atoms, len(list_filter(a, lambda x: upper(x) = 'C')) AS n_c, len(list_filter(a, lambda x: upper(x) = 'O')) AS n_o, array_to_string(list_sort(list_distinct(a)), ',') AS kinds FROM t""")
def token_regex(spark, sf_dir):
    """Alternation tokeniser of atom-like strings: digraphs before letters, aromatic letters apart."""
    atoms = F.regexp_extract_all(F.concat_ws(" ", "p_type", "p_name"), F.lit(r"\[[^\]]*\]|CL|BR|[BCNOFPSI]|[cnops]"), F.lit(0))
    t = table(spark, sf_dir, "part").select("p_partkey", atoms.alias("a"))
    count = lambda c: F.size(F.filter("a", lambda x: F.upper(x) == c)).cast("long")
    return t.select("p_partkey", F.size("a").cast("long").alias("n_atoms"), count("C").alias("n_c"), count("O").alias("n_o"), F.array_join(F.sort_array(F.array_distinct("a")), ",").alias("kinds"))


_FAMILIES = {"licence": [r"license", r"rights reserved"], "contact": [r"@", r"https?://"], "digits": [r"[0-9]{3}", r"[0-9]+\.[0-9]+"]}
_HITS = {k: " OR ".join(f"regexp_matches(p, '{x}')" for x in v) for k, v in _FAMILIES.items()}
_HIT_COUNT = " + ".join(f"regexp_matches(p, '{x}')::INT" for v in _FAMILIES.values() for x in v)


@query(rf"""WITH t AS (SELECT doc_id, regexp_replace(lower(trim(text)), '\s+', ' ', 'g') AS p FROM documents),
f AS (SELECT doc_id, list_filter([{', '.join(f"CASE WHEN {_HITS[k]} THEN '{k}' END" for k in sorted(_FAMILIES))}], lambda x: x IS NOT NULL) AS fams, {_HIT_COUNT} AS n FROM t)
SELECT doc_id, CASE WHEN len(fams) = 1 THEN fams[1] ELSE 'ambiguous' END AS family, n::INTEGER AS n_cues, round(least(0.95, 0.65 + 0.1 * (n - 1))::DOUBLE, 6) AS score FROM f WHERE n > 0""")
def query_classify(spark, sf_dir):
    """Cue patterns in families: one family decides, none or several are ambiguous."""
    t = table(spark, sf_dir, "documents").select("doc_id", tx.cue_families(F.col("text"), _FAMILIES).alias("fams"), tx.cue_count(F.col("text"), _FAMILIES).alias("n_cues"))
    return t.where("n_cues > 0").select("doc_id", F.when(F.size("fams") == 1, F.get("fams", F.lit(0))).otherwise("ambiguous").alias("family"), "n_cues", F.round(F.least(F.lit(0.95), 0.65 + 0.1 * (F.col("n_cues") - 1)), 6).alias("score"))


@query(r"""WITH m AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '\b(the|and|was)\b')) AS word FROM conversations) SELECT conv_id, word, count(*) AS n, min(turn) AS first_turn FROM m GROUP BY ALL""")
def text_audit(spark, sf_dir):
    """Marked words of conversations, exploded and counted."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\b(the|and|was)\b"), F.lit(1))).alias("word"))
    return c.groupBy("conv_id", "word").agg(F.count(F.lit(1)).alias("n"), F.min("turn").alias("first_turn"))


@query(r"""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, len(regexp_extract_all(html, '<p[ >]')) AS n_paragraphs, len(regexp_extract_all(html, '<a href=')) AS n_links FROM pages""")
def html_extract(spark, sf_dir):
    """Fields of raw pages by regular expressions."""
    n = lambda p: F.size(F.regexp_extract_all("html", F.lit(p), F.lit(0))).cast("long")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"), n("<p[ >]").alias("n_paragraphs"), n("<a href=").alias("n_links"))


@query(r"""SELECT doc_id, length(text) AS n_chars_found, octet_length(encode(text)) AS n_bytes, sha256(text) AS hash, substr(sha256(replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10), chr(13) || chr(10))), 1, 20) AS canonical_id, length(text) = n_chars AS length_matches FROM documents""")
def provenance_manifest(spark, sf_dir):
    """Sizes and hashes of each document, raw and in canonical line ends."""
    return table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("n_chars_found"), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("hash"), F.substring(F.sha2(tx.crlf(F.col("text")), 256), 1, 20).alias("canonical_id"), (F.length("text") == F.col("n_chars")).alias("length_matches"))


@query("""WITH o AS (SELECT o_orderkey AS k, sum(l_quantity) AS q, count(*) AS n, count(DISTINCT p_type) AS types, sum(l_quantity * p_size) / sum(l_quantity) AS m, sum(l_quantity * p_size * p_size) / sum(l_quantity) AS m2 FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL) SELECT k AS order_id, n AS n_lines, types AS n_types, round(m, 6) AS mean_size, round(sqrt(greatest(m2 - m * m, 0)), 6) AS std_size FROM o""")
def composition_summary(spark, sf_dir):
    """Weighted composition of orders over part sizes."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_id"), "l_partkey", F.col("l_quantity").alias("w"))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type", F.col("p_size").alias("x"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"))
    w, x = F.col("w"), F.col("x")
    g = li.join(o, "order_id", "left_semi").join(p, "l_partkey").groupBy("order_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_distinct("p_type").alias("n_types"), (F.sum(w * x) / F.sum(w)).alias("mean_size"), (F.sum(w * x * x) / F.sum(w)).alias("m2"))
    return rounded(g.select("order_id", "n_lines", "n_types", "mean_size", F.sqrt(F.greatest(F.col("m2") - F.col("mean_size") * F.col("mean_size"), F.lit(0.0))).alias("std_size")))


@query("""SELECT conv_id, count(*) AS n_turns, count(*) FILTER (role = 'user') AS n_user, (count(*) FILTER (length(text) = 0)) AS n_empty, bool_and(length(text) > 20 OR role = 'user') AS long_enough, sum(CASE WHEN contains(text, 'the') THEN 2 WHEN contains(text, 'of') THEN 1 ELSE 0 END)::BIGINT AS score, bool_and(length(text) > 20 OR role = 'user') AND count(*) >= 2 AS pass FROM conversations GROUP BY conv_id""")
def rubric_gate(spark, sf_dir):
    """Rubric scores of conversations with hard gates."""
    long = F.bool_and((F.length("text") > 20) | (F.col("role") == "user"))
    points = F.sum(F.when(F.contains("text", F.lit("the")), 2).when(F.contains("text", F.lit("of")), 1).otherwise(0))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.count_if(F.col("role") == "user").alias("n_user"), F.count_if(F.length("text") == 0).alias("n_empty"), long.alias("long_enough"), points.alias("score"), (long & (F.count(F.lit(1)) >= 2)).alias("pass"))


@query(r"""WITH q AS (SELECT item_id, list_filter(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')), lambda x: length(x) > 2) AS t FROM benchmark WHERE item_id % 50 = 0), s AS (SELECT item_id, doc_id, len(list_filter(t, lambda x: contains(lower(text), x))) AS hits FROM documents, q), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY hits DESC, doc_id) AS rank FROM s WHERE hits > 0) SELECT item_id, doc_id, hits, rank::INTEGER AS rank FROM r WHERE rank <= 20""")
def lexical_rank(spark, sf_dir):
    """For each query (ids divisible by 50) the twenty documents that hold most of its terms as substrings."""
    terms = F.filter(F.array_distinct(tx.tokens(F.col("text"))), lambda x: F.length(x) > 2)
    asked = staged(table(spark, sf_dir, "benchmark").where("item_id % 50 = 0").select("item_id", F.explode(terms).alias("term")), "query-terms")
    known = asked.agg(F.collect_set("term").alias("terms"))  # the distinct terms of a stated query set, in one row
    held = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("small")).crossJoin(F.broadcast(known))  # each term is looked for once in a text
    met = held.select("doc_id", F.explode(F.filter("terms", lambda t: F.contains("small", t))).alias("term")).join(F.broadcast(asked), "term")
    s = met.groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("hits"))
    w = Window.partitionBy("item_id").orderBy(F.desc("hits"), "doc_id")
    return s.withColumn("rank", F.row_number().over(w)).where("rank <= 20").select("item_id", "doc_id", "hits", "rank")


@query("""SELECT c_custkey, printf('Customer %d of %s has %.2f', c_custkey, c_mktsegment, c_acctbal) AS line FROM customer""")
def template_text(spark, sf_dir):
    """Text rendered from a template."""
    return table(spark, sf_dir, "customer").select("c_custkey", F.format_string("Customer %d of %s has %.2f", "c_custkey", "c_mktsegment", "c_acctbal").alias("line"))


@query("""SELECT a, b, c, a * a + b * b - c * c AS gap FROM (SELECT unnest(range(1, 25)) AS a) x, (SELECT unnest(range(1, 25)) AS b) y, (SELECT unnest(range(1, 25)) AS c) z WHERE a < b AND a * a + b * b = c * c ORDER BY a, b, c LIMIT 1""")
def rational_grid(spark, sf_dir):
    """First point of an integer grid at which a claim (here: no sum of two squares is a square) fails, with exact arithmetic."""
    side = F.sequence(F.lit(1).cast("long"), F.lit(24).cast("long"))
    g = spark.range(1).select(F.explode(side).alias("a")).select("a", F.explode(side).alias("b")).where("a < b").select("a", "b", F.explode(side).alias("c"))
    gap = F.col("a") * F.col("a") + F.col("b") * F.col("b") - F.col("c") * F.col("c")
    return g.withColumn("gap", gap).where("gap = 0").orderBy("a", "b", "c").limit(1)


@query("""WITH e AS (SELECT user_id, event_type, event_id, value, sum(value) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM events) SELECT user_id, bool_or(event_type = 'signup') AS signed_up, arg_max(event_type, event_id) AS last_action, coalesce(arg_max(event_type, event_id) FILTER (event_type IN ('purchase', 'error')) = 'purchase', false) AS approved, max(event_id) AS last_event, round(max(run), 2) AS total_cost, min(event_id) FILTER (run > 500) AS first_over FROM e GROUP BY user_id""")
def event_state(spark, sf_dir):
    """State of each user from an append-only log, with a running cost and where it passes a cap."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf_dir, "events").withColumn("run", F.sum("value").over(w))
    decision = F.max_by(F.when(F.col("event_type").isin("purchase", "error"), F.col("event_type")), F.when(F.col("event_type").isin("purchase", "error"), F.col("event_id")))
    return e.groupBy("user_id").agg(
        F.bool_or(F.col("event_type") == "signup").alias("signed_up"), F.max_by("event_type", "event_id").alias("last_action"), F.coalesce(decision == "purchase", F.lit(False)).alias("approved"),
        F.max("event_id").alias("last_event"), F.round(F.max("run"), 2).alias("total_cost"), F.min(F.when(F.col("run") > 500, F.col("event_id"))).alias("first_over"),
    )


@query("""SELECT o_orderkey, o_custkey FROM orders o WHERE o_orderstatus = 'F' AND EXISTS (SELECT 1 FROM lineitem l JOIN supplier s ON l_suppkey = s_suppkey WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND s_acctbal > 0)""")
def ledger_state(spark, sf_dir):
    """Claims with a status for which some supporting, verified link exists (semi-join with a ledger)."""
    verified = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    links = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_suppkey").join(verified, "l_suppkey", "left_semi")
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").join(links, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey", "o_custkey")


@query("""SELECT c_custkey AS id, 'customer' AS side FROM customer UNION ALL SELECT s_suppkey, 'supplier' FROM supplier""")
def union_all(spark, sf_dir):
    """Rows of two sides under one contract."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("side"))
    return c.unionByName(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("side")))


@query("""WITH RECURSIVE e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier), c(src, dst, depth) AS (SELECT src, dst, 1 FROM e UNION SELECT c.src, e.dst, depth + 1 FROM c JOIN e ON c.dst = e.src) SELECT src, dst, min(depth)::INTEGER AS depth FROM c GROUP BY src, dst""")
def graph_closure(spark, sf_dir):
    """Reachability in a small graph, with the least number of steps."""
    from quillon.operators.graph import closure

    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    e = n.select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst")).union(s.select(F.concat(F.lit("n"), "s_nationkey"), F.concat(F.lit("s"), "s_suppkey")))
    return closure(e.distinct())


@query("""WITH p AS (SELECT * FROM (VALUES ('a', 0.01), ('b', 0.04), ('c', 0.03), ('d', 0.005), ('e', 0.2)) t(name, p)), r AS (SELECT name, p::DOUBLE AS p, row_number() OVER (ORDER BY p, name) AS k, count(*) OVER () AS m FROM p) SELECT name, p, round(max(least(1, (m - k + 1) * p)) OVER (ORDER BY k), 6) AS adjusted FROM r""")
def holm(spark, sf_dir):
    """Holm's step-down adjustment of a few p-values."""
    p = spark.sql("SELECT name, cast(p AS double) AS p FROM VALUES ('a', 0.01), ('b', 0.04), ('c', 0.03), ('d', 0.005), ('e', 0.2) AS t(name, p)")
    w = Window.orderBy("p", "name")
    k, m = F.row_number().over(w), F.count(F.lit(1)).over(Window.partitionBy())
    r = p.withColumn("raw", F.least(F.lit(1.0), (m - k + 1) * F.col("p")))
    return rounded(r.withColumn("adjusted", F.max("raw").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("raw"))
