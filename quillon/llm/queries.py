"""The registered queries of the training-data operators, one for each, over whole tables, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.io import table
from quillon.llm import classifier, exact_topk, license_scan, near_dedup, packing, piece_bpe, quality_rules, sharding, token_files, url_filters

WORD_VOCABULARY = 49_408


def tokenizer_path(name: str) -> str:
    """Where the installed public tokenizer files lie; a parameter of the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes_of(table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2, vocabulary=WORD_VOCABULARY)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1)


def op5_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "pattern")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classifier.score(docs, classifier.learn(docs, table(spark, sf_dir, "labels")))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    return sharding.assign(docs).select(  # the text itself isn't asked for, so it isn't shuffled
        "doc_id",
        F.col("_size").alias("size"),
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("_shard").alias("shard"),
        F.col("_slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES = {
    f.__name__: f
    for f in (op1_license_scans, op2_minhash_near_dedup, op3_token_files, op4_best_fit_packing, op5_piece_codec, op6_exact_topk, op7_url_filters, op8_quality_classifier, op9_quality_rules, op10_sharding)
}


def _license_sql() -> str:
    rows = [(i, name, license_scan.size_class(len(words)), " ".join(words)) for i, (name, text) in enumerate(license_scan.TEMPLATES) if len(words := license_scan.plain_words(text)) >= license_scan.SHINGLE]
    values = ", ".join(f"({i}, '{name}', {size}, '{words}')" for i, name, size, words in rows)
    return rf"""
WITH t AS (SELECT *, string_split(words, ' ') AS w FROM (VALUES {values}) v(template, license, size, words)),
tt AS (SELECT template, license, size, list_distinct([w[i] || ' ' || w[i+1] || ' ' || w[i+2] FOR i IN range(1, len(w) - 1)]) AS ts FROM t),
d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, [w[i] || ' ' || w[i+1] || ' ' || w[i+2] FOR i IN range(1, len(w) - 1)] AS s FROM d WHERE len(w) >= 3),
c AS (SELECT doc_id, s, template, license, size, ts FROM s JOIN tt ON list_has_any(s, ts)),
w AS (SELECT doc_id, license, size, ts, k * (size // 4) AS start, s[k * (size // 4) + 1 : k * (size // 4) + size] AS win
      FROM (SELECT *, unnest(range(0, len(s) // (size // 4) + 1)) AS k FROM c)),
m AS (SELECT doc_id, license, size, start, list_intersect(ts, win) AS shared, len(list_intersect(ts, win)) / len(ts) AS containment,
             start + list_min([i - 1 FOR i IN range(1, len(win) + 1) IF list_contains(ts, win[i])]) AS place
      FROM w WHERE list_has_any(ts, win)),
g AS (SELECT * FROM m WHERE containment >= {license_scan.MIN_CONTAINMENT}),
k AS (SELECT * FROM g WHERE NOT EXISTS (SELECT 1 FROM g o WHERE o.doc_id = g.doc_id AND o.size = g.size AND o.start = g.start
                                        AND o.containment > g.containment AND list_has_all(o.shared, g.shared))),
b AS (SELECT *, max(containment) OVER (PARTITION BY doc_id, license) AS best FROM k)
SELECT doc_id, license, CAST(min(place) AS INTEGER) AS first_word, count(DISTINCT place) AS n_places, max(containment) AS containment
FROM b WHERE containment = best GROUP BY doc_id, license
"""


_TOPK_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""


def _url_sql() -> str:
    def fits(host: str, path: str) -> str:
        return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}'))"

    ordered = sorted(url_filters.SITE_RULES, key=lambda r: -len(r[1] + r[2]))
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in ordered) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in ordered) + " END"
    holds = lambda *words: " AND ".join(f"list_contains(words, '{w}')" for w in words)
    looks = {  # in the order in which one outdoes the other
        "poker-rules": "contains(small, '/rules/poker.')", "session-link": r"regexp_matches(small, '(^|[^a-z0-9])sessionid=')", "payday-loan": holds("payday", "loan"),
        "online-pharmacy": holds("online", "pharmacy"), "gambling-poker": holds("poker"), "gambling-casino": holds("casino"), "free-download": holds("free", "download"),
        "adult-porn": "len(list_filter(words, lambda w: starts_with(w, 'porn'))) > 0", "adult": holds("xxx"), "ad-host": r"regexp_matches(small, '^[^:/?#]*://([^/?#]*\.)?ads([^a-z0-9]|$)')",
    }
    pattern = "CASE " + " ".join(f"WHEN {look} THEN '{name}'" for name, look in looks.items()) + " END"
    return rf"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, string_split_regex(lower(coalesce(url, '')), '[^a-z0-9]+') AS words, lower(coalesce(url, '')) AS small FROM pages),
j AS (SELECT page_id, host, path, {rule} AS rule, {verdict} AS by_rule, {pattern} AS by_pattern FROM p)
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN by_pattern IS NULL OR by_pattern = 'poker-rules' THEN 'allow' ELSE 'block' END) AS verdict,
       CASE WHEN rule IS NULL THEN by_pattern END AS pattern FROM j
"""


_RULES_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS body, text, source, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
win AS (SELECT doc_id, i, w[i:i+4] AS five FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, five) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY doc_id),
l AS (SELECT doc_id, text, source, lower(regexp_replace(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[\x20\x09-\x0D]+', ' ', 'g')) AS plain
      FROM (SELECT doc_id, text, source, unnest(string_split(text, chr(10))) AS line FROM documents)),
o AS (SELECT source, plain FROM l WHERE plain <> '' GROUP BY source, plain HAVING count(DISTINCT text) > {quality_rules.MIN_DOCS}
      AND count(DISTINCT text) > {quality_rules.HOST_SHARE} * (SELECT count(DISTINCT text) FROM documents x WHERE x.source IS NOT DISTINCT FROM l.source)),
gone AS (SELECT doc_id, sum(len(string_split(plain, ' '))) AS n FROM l SEMI JOIN o ON l.source IS NOT DISTINCT FROM o.source AND l.plain = o.plain GROUP BY doc_id),
b AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum([length(x) FOR x IN w]), 0) AS BIGINT) AS word_chars,
             CAST(length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
             CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed
      FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (n_removed > 0 AND (n_words - n_removed < 10 OR n_words - n_removed < {quality_rules.MIN_KEPT_SHARE} * n_words)) AS kept, n_removed FROM f
"""


ORACLE_SQL = {"op1_license_scans": _license_sql(), "op6_exact_topk": _TOPK_SQL, "op7_url_filters": _url_sql(), "op9_quality_rules": _RULES_SQL}
