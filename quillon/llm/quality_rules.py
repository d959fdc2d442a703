"""Quality rules with cross-document line frequency, in DataFrame functions only.

A document first passes rules on its own text (``base_failed``). Then lines count: each line is normalised (case and
white space) and hashed together with its host; the documents of a host that hold it are counted, equal texts once.
Lines above the limit, ``max(min_docs, share * documents of the host)``, are removed, and a document that keeps too few
words or too small a share of its words is rejected as depleted. With ``max_docs`` the share's limit is never above that count, so that it doesn't loosen without
bound on a large host; the query's rule is that of its SQL, without it. ``judge`` gives the verdicts and counts, ``keep_good``
the kept documents with the texts that remain.

Defined cases: a null text counts as empty; a text without words fails the base rules; a null host is a host of its
own; repeated rows each get a verdict, and count once as they have equal texts; columns besides the named ones are
ignored by the queries and pass through ``keep_good`` untouched (also a stored length of the text as it was); an empty table gives an empty result.

Scale: both passes over the text are map-only. What is shuffled is one (hash, text hash) pair for each line, combined
before the shuffle. The lines above the limit, hashes by host, are sent to all tasks while there are at most ``MAX_SENT``
(a host's are at most its mean number of lines over its share), and the second pass finds and removes them in place: no
row carries text across a shuffle. Where there are more, the places of such lines are joined to the documents instead,
with equal results: ``judge`` then shuffles counts, ``keep_good`` the kept documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import SPACE_CLASS, SPACES, bind, staged, words_of

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
MIN_DOCS = 20
HOST_SHARE = 0.05
#: The pipeline's absolute limit: on hosts of more than MAX_DOCS / HOST_SHARE = 20,000 texts the limit grows no more.
MAX_DOCS = 1_000
MIN_KEPT_SHARE = 0.3
#: Hashes of lines above the limit, of all hosts together, up to which they are sent to all tasks (8 bytes each).
MAX_SENT = 1_000_000


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of five words found at least twice in the text."""

    def covered(windows: Column) -> Column:
        placed = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))

        def spots(s: Column) -> Column:
            same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
            return F.transform(F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["at"])

        start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        step = lambda acc, at: F.struct((acc["n"] + F.least(F.lit(WINDOW), at - acc["last"])).alias("n"), at.alias("last"))
        return bind(placed, lambda s: F.aggregate(F.sort_array(spots(s)), start, step, lambda acc: acc["n"]))

    def windows(hashes: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(hashes) - WINDOW),
            lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]),
        )

    def count(w: Column) -> Column:
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(bind(hashed, lambda h: bind(windows(h), count)))


def base_columns(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "")
    return (
        docs.withColumn("_words", words_of(F.col(text)))
        .withColumn("_lines", lines)
        .withColumns(
            {
                "n_words": F.size("_words").cast("long"),
                "word_chars": F.length(F.array_join("_words", "")).cast("long"),
                "n_symbols": (F.length(whole) - F.length(F.regexp_replace(whole, r"[#*$%&|<>]", ""))).cast("long"),
                "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
                "n_repeat_words": repeated_words(F.col("_words")).cast("long"),
            }
        )
        .drop("_words", "_lines")
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    )


def _host_key(host: str) -> Column:
    return F.xxhash64(F.lit(11), F.col(host))


def _lines_of(docs: DataFrame, doc_id: str, text: str, host: str) -> DataFrame:
    """A row for each line that has words: whose it is, its hash within its host, its words."""
    return (
        docs.select(F.col(doc_id).alias("doc"), F.xxhash64(text).alias("text_key"), _host_key(host).alias("host_key"), F.posexplode(F.split(text, "\n")).alias("at", "line"))
        .withColumn("plain", _plain(F.col("line")))
        .where("plain != ''")
        .select("doc", "text_key", "host_key", "at", F.xxhash64("host_key", "plain").alias("line_key"), F.size(F.split("plain", " ")).alias("words"))
    )


def frequent_lines(docs: DataFrame, doc_id: str, text: str, host: str, min_docs: int, host_share: float, max_docs: int | None) -> DataFrame:
    """Keys of the lines above the limit of their host."""
    per_line = (
        _lines_of(docs, doc_id, text, host)
        .select("host_key", "line_key", "text_key")
        .distinct()
        .groupBy("host_key", "line_key")
        .agg(F.count(F.lit(1)).alias("n_docs"))
        .where(F.col("n_docs") > min_docs)
    )
    per_host = (
        docs.where(F.col(text).isNotNull())
        .select(_host_key(host).alias("host_key"), F.xxhash64(text).alias("text_key"))
        .distinct()
        .groupBy("host_key")
        .agg(F.count(F.lit(1)).alias("host_docs"))
    )
    limit = host_share * F.col("host_docs")
    if max_docs is not None:
        limit = F.least(limit, F.lit(float(max_docs)))
    return staged(per_line.join(per_host, "host_key").where(F.col("n_docs") > limit).select("host_key", "line_key"), "frequent-lines")


def _plain(line: Column) -> Column:
    """A line without differences of case and white space."""
    return F.lower(F.regexp_replace(F.btrim(line, F.lit(SPACES)), SPACE_CLASS, " "))


def _with_lines(rows: DataFrame, over: DataFrame, text: str) -> DataFrame:
    """rows (with host_key) and line_keys, the hashes of the lines above the limit of the row's host that its text holds (null or empty: none). over has at most MAX_SENT rows."""
    by_host = over.groupBy("host_key").agg(F.collect_list("line_key").alias("host_lines"))
    hashed = F.transform(F.split(text, "\n"), lambda line: F.xxhash64("host_key", _plain(line)))
    held = F.when(F.col("host_lines").isNotNull(), F.array_intersect(hashed, "host_lines"))  # blank lines are never above the limit
    return rows.join(F.broadcast(by_host), "host_key", "left").withColumn("line_keys", held).drop("host_lines")


def _in_lines(text: str, body, empty: Column) -> Column:
    """body(lines, whether a line is above the limit), of the lines of the text if it holds any such line."""
    gone = lambda line: F.array_contains("line_keys", F.xxhash64("host_key", _plain(line)))
    return F.when(F.coalesce(F.size("line_keys"), F.lit(0)) > 0, body(F.split(text, "\n"), gone)).otherwise(empty)


def _removed(text: str) -> Column:
    words = lambda lines, gone: F.aggregate(lines, F.lit(0).cast("long"), lambda n, x: n + F.when(gone(x), F.size(F.split(_plain(x), " "))).otherwise(0))
    return _in_lines(text, words, F.lit(0).cast("long"))


def _hits(docs: DataFrame, doc_id: str, text: str, host: str, over: DataFrame) -> DataFrame:
    """A row for each place of a document that holds a line above the limit: doc, text_key, host_key, at, words."""
    hits = _lines_of(docs, doc_id, text, host).join(over, ["host_key", "line_key"], "left_semi")
    return hits.groupBy("doc", "text_key", "host_key", "at").agg(F.max("words").alias("words"))


def removed_lines(docs: DataFrame, doc_id: str, text: str, host: str, over: DataFrame) -> DataFrame:
    """For each document that loses lines: _doc, _key and _host, how many words these lines hold, and their places among the text's lines."""
    hits = _hits(docs, doc_id, text, host, over)
    lost = hits.groupBy("doc", "text_key", "host_key").agg(F.sum("words").alias("n_removed"), F.collect_list("at").alias("places"))
    return lost.select(F.col("doc").alias("_doc"), F.col("text_key").alias("_key"), F.col("host_key").alias("_host"), "n_removed", "places")


def without_lines(text: Column, places: Column) -> Column:
    """The text without its lines at these places; the other lines stay as they are."""
    lines = F.split(text, "\n")
    at = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), places)
    return bind(lines, lambda all_lines: F.array_join(F.transform(at, lambda i: F.get(all_lines, i)), "\n"))


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", min_docs: int = MIN_DOCS, host_share: float = HOST_SHARE, min_kept_share: float = MIN_KEPT_SHARE, max_docs: int | None = None) -> DataFrame:
    """A row for each document: the counts, base_failed, n_removed (words in removed lines) and kept."""
    over = frequent_lines(docs, doc_id, text, host, min_docs, host_share, max_docs)
    narrow = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"), _host_key(host).alias("host_key"))
    if over.count() <= MAX_SENT:
        found = base_columns(_with_lines(narrow, over, "text").withColumn("n_removed", _removed("text")).drop("line_keys", "host_key"), "text")
    else:
        lost = removed_lines(docs, doc_id, text, host, over).drop("places")
        counts = base_columns(narrow, "text").withColumn("text_key", F.xxhash64("text")).drop("text")
        found = counts.join(lost, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("text_key") == F.col("_key")) & (F.col("host_key") == F.col("_host")), "left")
    return (
        found.withColumn("n_removed", F.coalesce("n_removed", F.lit(0)).cast("long"))
        .withColumn("kept", ~F.col("base_failed") & ~_depleted(min_kept_share))
        .select(F.col("doc").alias(doc_id), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed")
    )


def _depleted(min_kept_share: float) -> Column:
    left = F.col("n_words") - F.col("n_removed")
    return (F.col("n_removed") > 0) & ((left < MIN_WORDS) | (left < min_kept_share * F.col("n_words")))


def keep_good(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", min_docs: int = MIN_DOCS, host_share: float = HOST_SHARE, min_kept_share: float = MIN_KEPT_SHARE, max_docs: int | None = None) -> DataFrame:
    """The documents that the rules keep, their texts without the lines above the limit; all other columns are as given."""
    over = frequent_lines(docs, doc_id, text, host, min_docs, host_share, max_docs)
    names = docs.columns
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    at = {c: f"c{i}" for i, c in enumerate(names)}
    body = at[text]
    if over.count() <= MAX_SENT:
        found = base_columns(_with_lines(inner.withColumn("host_key", _host_key(at[host])), over, body), body)
        rest = _in_lines(body, lambda lines, gone: F.array_join(F.filter(lines, lambda x: ~gone(x)), "\n"), F.col(body))
        judged = F.struct("n_words", "base_failed", _removed(body).alias("n_removed"), rest.alias("rest"))
        once = found.select(*[F.col(c) for c in at.values() if c != body], F.explode(F.array(judged)).alias("judged"))  # a filter on generated columns isn't pushed below them, so nothing is computed twice
        kept = once.select("*", "judged.*").where(~F.col("base_failed") & ~_depleted(min_kept_share))
        rest = F.col("rest")
    else:
        lost = staged(removed_lines(docs, doc_id, text, host, over), "removed-lines")
        good = base_columns(inner, body).where(~F.col("base_failed"))
        same = F.col(at[doc_id]).eqNullSafe(F.col("_doc")) & (F.xxhash64(body) == F.col("_key")) & (_host_key(at[host]) == F.col("_host"))
        kept = good.join(lost, same, "left").withColumn("n_removed", F.coalesce("n_removed", F.lit(0))).where(~_depleted(min_kept_share))
        rest = F.when(F.col("places").isNull(), F.col(body)).otherwise(without_lines(F.col(body), F.col("places")))
    return kept.select(*[(rest if c == text else F.col(at[c])).alias(c) for c in names])
