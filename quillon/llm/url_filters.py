"""URL filters: rules are indexed by their rarest literal token; a URL's tokens fetch candidate rules, and only those run regular expressions.

Two kinds of rules share one index. Site rules name a host (and its subdomains) and a path prefix; the longest that fits
decides. Where none fits, pattern rules decide: a rule fits where all its patterns occur in the URL, without regard to
case; rules that allow (exceptions) outdo those that block, and a URL that no rule fits is allowed. DataFrame functions only.

Patterns: ``*`` stands for anything, ``^`` for one character that is no letter or digit or for either end of the URL,
``|`` at an end ties the pattern to that end of the URL, ``||`` at the begin ties it to the begin of a host label;
all else is literal. A pattern's literal tokens are its runs of a-z and 0-9 that can't go on in a URL (between other
characters, ``^``, ``|`` or ``||``); a rule that has none is indexed under the empty token, which every URL holds.

Defined cases: a null URL, or one without ``://``, has an empty host and path and is allowed unless a pattern fits; a very
long URL is read whole; repeated rows each get the verdict; columns besides the id and the URL are ignored; an empty
table gives an empty result; without rules all is allowed; of two fitting rules of one rank the name that sorts last decides.

Scale: rules are a table (``rule_table`` makes one of lists). A rule's token is the one that the fewest URLs hold, counted
over all of them, so tokens that most URLs share fetch nothing. The index is broadcast while it has at most
``BROADCAST_RULES`` rules, else tokens are shuffled to it. The rows that are joined back with their verdict are (id, URL),
no page: where the URLs with a fitting rule are too many to broadcast, (id, URL) of all pages is shuffled.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import staged

#: (verdict, host, path); the contract's rules.
SITE_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
#: (verdict, name, patterns that must all occur).
PATTERN_RULES = [
    ("block", "ad-host", ["||ads^"]),
    ("block", "adult", ["^xxx^"]),
    ("block", "adult-porn", ["^porn*^"]),
    ("block", "free-download", ["^free^", "^download^"]),
    ("block", "gambling-casino", ["^casino^"]),
    ("block", "gambling-poker", ["^poker^"]),
    ("block", "online-pharmacy", ["^online^", "^pharmacy^"]),
    ("block", "payday-loan", ["^payday^", "^loan^"]),
    ("block", "session-link", ["^sessionid=*|"]),
    ("allow", "poker-rules", ["/rules/poker."]),
]
BROADCAST_RULES = 200_000
RULE = "rule string, verdict string, site boolean, rank int, host_regex string, prefix string, url_regex string, tokens array<string>"


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _tokens(host: Column, path: Column, url: Column) -> Column:
    """Host labels, path segments and words, each kind apart; the empty word is always among them."""
    tag = lambda kind, values: F.transform(values, lambda v: F.concat(F.lit(kind), v))
    words = F.concat(F.split(F.lower(F.coalesce(url, F.lit(""))), "[^a-z0-9]+"), F.array(F.lit("")))
    return F.array_distinct(F.concat(tag("h:", F.split(host, r"\.")), tag("p:", F.split(path, "/")), tag("w:", words)))


def pattern_regex(pattern: str) -> str:
    """The expression, to be found in the URL, that a pattern stands for."""
    rest, before, after = pattern.lower(), "", ""
    if rest.startswith("||"):
        rest, before = rest[2:], r"^[^:/?#]*://(?:[^/?#]*\.)?"
    elif rest.startswith("|"):
        rest, before = rest[1:], "^"
    if rest.endswith("|"):
        rest, after = rest[:-1], r"\z"
    signs = {"*": ".*", "^": r"(?:^|[^a-z0-9]|\z)"}
    return before + "".join(signs.get(c) or re.escape(c) for c in rest) + after


def pattern_tokens(pattern: str) -> list[str]:
    """Runs of a-z and 0-9 that are whole tokens of every URL in which the pattern occurs."""
    text = pattern.lower()
    whole = lambda c: c not in ("", "*") and not re.match("[a-z0-9]", c)
    return [m[0] for m in re.finditer("[a-z0-9]+", text) if whole(text[m.start() - 1 : m.start()]) and whole(text[m.end() : m.end() + 1])]


def rule_rows(site_rules=SITE_RULES, pattern_rules=PATTERN_RULES) -> list[tuple]:
    """The columns of RULE: each rule's name, verdict, rank, expressions for host and URL, path prefix and literal tokens."""
    out = []
    for verdict, host, path in site_rules:
        segments = path.split("/")[:-1]  # the last may go on in a URL
        tokens = [f"h:{x}" for x in host.split(".")] + [f"p:{x}" for x in segments if x]
        out.append((host + path, verdict, True, len(host + path), rf"(?s)^(?:.*\.)?{re.escape(host)}\z", path, "", tokens))
    for verdict, name, patterns in pattern_rules:
        looks = "".join(f"(?=.*?{pattern_regex(p)})" if not p.startswith("|") else f"(?={pattern_regex(p)[1:]})" for p in patterns)
        tokens = sorted({f"w:{t}" for p in patterns for t in pattern_tokens(p)}) or ["w:"]
        out.append((name, verdict, False, 0 if verdict == "allow" else -1, "", "", f"(?is)^{looks}", tokens))
    return out


def rule_table(spark: SparkSession, site_rules=SITE_RULES, pattern_rules=PATTERN_RULES) -> DataFrame:
    """The rules as a table; one constant holds them all."""
    rows = [dict(zip(("rule", "verdict", "site", "rank", "host_regex", "prefix", "url_regex", "tokens"), r, strict=True)) for r in rule_rows(site_rules, pattern_rules)]
    kind = "array<struct<" + ", ".join(c.replace(" ", ":", 1) for c in RULE.split(", ")) + ">>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), kind)))


def judge(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules: DataFrame | None = None) -> DataFrame:
    """A row for each page: id, host, path, rule (null if no site rule fits), verdict, and pattern (the pattern rule that decided, if any). rules: a table with the columns of RULE."""
    spark = pages.sparkSession
    rules = staged((rule_table(spark) if rules is None else rules).withColumn("number", F.monotonically_increasing_id()), "rules")
    small = rules.count() <= BROADCAST_RULES
    near = F.broadcast if small else (lambda df: df)
    parts = pages.select(F.col(page_id).alias("page"), F.col(url).alias("url")).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    tokens = parts.select("page", "url", "host", "path", F.explode(_tokens(F.col("host"), F.col("path"), F.col("url"))).alias("token"))

    own = rules.select("number", F.explode("tokens").alias("token"))
    seen = tokens.select("token").join(near(own.select("token").distinct()), "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = own.join(seen, "token", "left").groupBy("number").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
    index = staged(rules.drop("tokens").join(rarest, "number").drop("number"), "rule-index")
    best = (
        tokens.join(near(index), "token")
        .where(F.rlike("host", F.col("host_regex")) & F.startswith("path", F.col("prefix")) & F.rlike(F.coalesce("url", F.lit("")), F.col("url_regex")))
        .groupBy(F.col("page").alias("_page"), F.col("url").alias("_url"))
        .agg(F.max_by(F.struct("rule", "verdict", "site"), F.struct("rank", "rule")).alias("best"))
    )
    return (
        parts.join(best, F.col("page").eqNullSafe(F.col("_page")) & F.col("url").eqNullSafe(F.col("_url")), "left")
        .select(
            F.col("page").alias(page_id),
            "host",
            "path",
            F.when(F.col("best.site"), F.col("best.rule")).alias("rule"),
            F.coalesce("best.verdict", F.lit("allow")).alias("verdict"),
            F.when(~F.col("best.site"), F.col("best.rule")).alias("pattern"),
        )
    )
