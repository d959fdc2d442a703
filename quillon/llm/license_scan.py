"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies them.

A text is read as lower-case words (runs of letters and digits) and hashed three-word shingles. Templates are sorted
into size classes. In a class whose windows hold W shingles, a template has at most 3W/4 of them and the windows start
every W/4 shingles, so each occurrence lies whole in one window, of whose shingles it makes up over 3/8 (in the least
class, whose windows are short, perhaps less). All windows of all texts are hashed; nothing else retrieves.

MinHash takes its one-permutation form: a window's signature are its ``BANDS`` smallest distinct shingle hashes, each a
band of its own, and a template is retrieved by every window that shares a band with it. Let U be the distinct shingles
of window and template together and I the shared ones. Each of the BANDS smallest of U that is shared is a band of both,
so all bands miss with a probability of C(U-I, BANDS) / C(U, BANDS), less than (1 - I/U)^BANDS: for any template and window
of up to 32 shingles 0, for longer ones under 3e-5 at a containment of 0.8 and under 4e-7 for whole notices. Signatures of
large windows are merged from those of their halves, so each window is hashed once.

Retrieved pairs are verified: the share of the template's distinct shingles in the window is counted exactly and must
reach ``MIN_CONTAINMENT``. Of variants of one notice in a window (the GPL's versions, say) the one that holds all that the
other shares, and a greater share of itself, is reported.

Defined cases: null, empty and short texts hold no license; a document that repeats a notice, and repeated rows, give
one row for each document and license (its places of best containment); rows without doc_id count as one document; long
texts go through in segments that overlap by a window; templates of fewer than three words are left out; other columns
are ignored; an empty table, or no templates, give an empty result.

Scale: map-only up to the final grouping by document, which carries matches only. A row holds one segment's windows.
Templates are a parameter; the index of their bands is broadcast, its size is bounded by MAX_TEMPLATES * BANDS rows, and
windows are probed by the set of its keys in place.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import bind
from quillon.llm.license_texts import TEMPLATES

SHINGLE = 3
BANDS = 32
LEAST_WINDOW = 8
SEGMENT = 8192
MIN_CONTAINMENT = 0.8
MAX_TEMPLATES = 2_000


def plain_words(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def size_class(n_words: int) -> int:
    """Shingles of a window for templates of that many words: the least 8 * 2^k of which the template's shingles are at most 3/4."""
    size = LEAST_WINDOW
    while 4 * (n_words - SHINGLE + 1) > 3 * size:
        size *= 2
    return size


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shingles(words: Column) -> Column:
    made = bind(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - SHINGLE), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(SHINGLE)])),
    )
    return F.when(F.size(words) < SHINGLE, F.array().cast("array<bigint>")).otherwise(made)


def _least(hashes: Column) -> Column:
    """The bands of a set of shingles."""
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, BANDS)


def template_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """template, license, window size, distinct shingles and bands."""
    rows = [{"template": i, "license": name, "size": size_class(len(words)), "words": " ".join(words)} for i, (name, text) in enumerate(templates) if len(words := plain_words(text)) >= SHINGLE]
    if len(rows) > MAX_TEMPLATES:
        raise ValueError(f"at most {MAX_TEMPLATES} templates")
    made = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), "array<struct<template:int,license:string,size:int,words:string>>")))
    return made.select("template", "license", "size", F.array_distinct(_shingles(F.split("words", " "))).alias("t_shingles")).withColumn("t_bands", _least(F.col("t_shingles")))


def _segments(docs: DataFrame, doc_id: str, text: str, overlap: int) -> DataFrame:
    """doc, base (number of the first shingle), own (shingles up to the next segment) and part (they and the overlap)."""
    def cut(h: Column) -> Column:
        bases = F.when(F.size(h) > 0, F.sequence(F.lit(0), F.size(h) - 1, F.lit(SEGMENT)))
        return F.transform(bases, lambda b: F.struct(b.alias("base"), F.least(F.lit(SEGMENT), F.size(h) - b).alias("own"), F.slice(h, b + 1, SEGMENT + overlap).alias("part")))

    segments = bind(_shingles(_words(F.col(text))), cut)  # shingles are made once; null, and no row, where there are none
    return docs.select(F.col(doc_id).alias("doc"), F.explode(segments).alias("s")).select("doc", "s.base", "s.own", "s.part")


def _bands(size: int) -> Column:
    """The bands of each window of a segment; those of large windows from their halves'."""
    starts, step = F.sequence(F.lit(0), F.floor((F.size("part") - 1) / F.lit(size // 4)).cast("int")), size // 4
    if size == LEAST_WINDOW or size // 2 <= BANDS:
        return F.transform(starts, lambda k: _least(F.slice("part", k * step + 1, size)))
    half = lambda k: F.coalesce(F.get(f"bands_{size // 2}", k), F.array().cast("array<bigint>"))
    return F.transform(starts, lambda k: _least(F.concat(half(2 * k), half(2 * k + 4))))


def _window(size: int):
    step = size // 4
    return lambda k: F.struct(F.lit(size).alias("size"), (F.col("base") + k * step).alias("start"), F.slice("part", k * step + 1, size).alias("window"))


def _hits(segments: DataFrame, keys: dict[int, list[int]]) -> DataFrame:
    """doc, size, start, window and bands of the windows that share a band with a template of their class; keys: bands of all templates of each class."""
    known = {size: ", ".join(f"{x}L" for x in sorted(xs)) for size, xs in keys.items()}
    found, size, rows = [], LEAST_WINDOW, segments
    if small := [known[size] for size in known if size <= BANDS]:  # these windows are their own signatures: a shingle's bands are probed once for all windows that hold it
        of = ", ".join(small)
        rows = rows.withColumn("spots", F.expr(f"CASE WHEN exists(part, x -> x IN ({of})) THEN filter(sequence(0, size(part) - 1), i -> part[i] IN ({of})) ELSE cast(array() AS array<int>) END"))
    while size <= max(keys):
        step = size // 4
        if size > BANDS:
            rows = rows.withColumn(f"bands_{size}", _bands(size))
            near = f"filter(sequence(0, cast(floor((own - 1) / {step}) AS int)), k -> exists(bands_{size}[k], x -> x IN ({known.get(size)})))"
        else:
            held = f"transform(filter(spots, i -> part[i] IN ({known.get(size)})), i -> sequence(cast(greatest(0, ceil((i - {size - 1}) / {step})) AS int), cast(floor(i / {step}) AS int)))"
            near = f"filter(array_distinct(flatten({held})), k -> k * {step} < own)"
        if size in keys:
            found.append(F.transform(F.expr(near), _window(size)))
        size *= 2
    return rows.select("doc", F.explode(F.concat(*found)).alias("w")).select("doc", "w.*").withColumn("bands", _least(F.col("window")))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates=TEMPLATES, min_containment: float = MIN_CONTAINMENT) -> DataFrame:
    """A row for each document and license found in it: first_word (of the first place, from 0), n_places and containment, of the places of best containment."""
    spark = docs.sparkSession
    table = template_table(spark, templates)
    keys = {r["size"]: r["all"] for r in table.groupBy("size").agg(F.array_distinct(F.flatten(F.collect_list("t_bands"))).alias("all")).collect()}  # at most MAX_TEMPLATES * BANDS numbers
    if not keys:
        return docs.sparkSession.createDataFrame([], f"{doc_id} {dict(docs.dtypes)[doc_id]}, license string, first_word int, n_places long, containment double")
    windows = _hits(_segments(docs, doc_id, text, max(keys)), keys)
    index = table.select("template", "license", "size", "t_shingles", F.explode("t_bands").alias("band"))
    shared = F.array_intersect("t_shingles", "window")
    first = F.array_min(F.filter(F.transform(F.col("window"), lambda x, i: F.when(F.array_contains("t_shingles", x), i)), lambda i: i.isNotNull()))
    hit = F.struct("license", F.col("containment").alias("share"), "shared", (F.col("start") + first).alias("at"))
    in_window = (
        windows.select("doc", "size", "start", "window", F.explode("bands").alias("band"))
        .join(F.broadcast(index), ["size", "band"])
        .withColumn("shared", shared)
        .withColumn("containment", F.size("shared") / F.size("t_shingles"))
        .where(F.col("containment") >= min_containment)
        .groupBy("doc", "size", "start")
        .agg(F.collect_set(hit).alias("hits"))  # at most one for each template
    )
    outdone = lambda h, hits: F.exists(hits, lambda o: (o["share"] > h["share"]) & (F.size(F.array_except(h["shared"], o["shared"])) == 0))
    return (
        in_window.select("doc", F.inline(F.filter("hits", lambda h: ~outdone(h, F.col("hits")))))
        .groupBy("doc", "license", "share")
        .agg(F.min("at").alias("first_word"), F.count_distinct("at").alias("n_places"))
        .groupBy("doc", "license")
        .agg(F.max_by(F.struct("first_word", "n_places", F.col("share").alias("containment")), "share").alias("best"))
        .select(F.col("doc").alias(doc_id), "license", "best.first_word", "best.n_places", "best.containment")
    )
