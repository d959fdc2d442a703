"""Column builders over text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores, in any script."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda t: t != "")


def count_of(text: Column, piece: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(piece), F.lit("")))) / len(piece)).cast("long")


def composition(text: Column, letters: str) -> dict[str, Column]:
    """Share of each letter among the allowed letters of an upper-cased text."""
    kept = F.regexp_replace(F.upper(text), f"[^{letters}]", "")
    return {f"share_{c.lower()}": F.coalesce(F.try_divide(count_of(kept, c), F.length(kept)), F.lit(0.0)) for c in letters}


def coverage(a: Column, b: Column) -> Column:
    """Share of a's distinct tokens that b holds."""
    distinct = F.array_distinct(a)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(distinct, b)), F.size(distinct)), F.lit(0.0))


def cue_families(text: Column, families: dict[str, list[str]]) -> Column:
    """Names of the families of which some pattern occurs in the text, sorted."""
    plain = F.regexp_replace(F.lower(F.trim(text)), r"\s+", " ")
    hit = [F.when(_any(plain, patterns), F.lit(name)) for name, patterns in sorted(families.items())]
    return F.array_compact(F.array(*hit))


def cue_count(text: Column, families: dict[str, list[str]]) -> Column:
    plain = F.regexp_replace(F.lower(F.trim(text)), r"\s+", " ")
    parts = [F.rlike(plain, F.lit(p)).cast("int") for ps in families.values() for p in ps]
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def _any(text: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | F.rlike(text, F.lit(p))
    return out


def crlf(text: Column) -> Column:
    """Line ends in one form, carriage return and line feed."""
    plain = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.replace(plain, F.lit("\n"), F.lit("\r\n"))


def hash_unit(*parts: Column) -> Column:
    """An integer below 2^32 from the parts' SHA-256, equal in every engine that has SHA-256."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 8), 16, 10).cast("long")


def normal_doi(text: Column) -> Column:
    bare = F.regexp_replace(F.lower(F.trim(text)), r"^(https?://(dx\.)?doi\.org/|doi:\s*)", "")
    return F.when(F.rlike(bare, F.lit(r"^10\.[0-9]{4,9}/\S+$")), bare)
