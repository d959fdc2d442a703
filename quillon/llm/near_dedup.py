"""Near-duplicate documents by improved consistent weighted sampling (ICWS) over TF-IDF shingles.

Shingles are five words (white space apart, A-Z as a-z; a shorter text is one shingle). A shingle's weight in a document
is its count times 1 + IDF_SHARE * min(1, log(N / df) / log(1 / COMMON)): the inverse document frequency, saturated for
shingles that less than a share COMMON of the documents holds, so that it depends on that share and not on the table's
size. It is damped by IDF_SHARE because copies raise the frequency of what they share: without it the few words by which
copies in a large group differ would outweigh all else. Document frequencies of common shingles are exact: a pass over
all documents fills ``SKETCH`` counters, and a second one counts the shingles of the counters that reach COMMON * N one by
one. The rest is below COMMON, where all weights are equal. At most 1 / COMMON times the mean number of shingles of a
document are common, whatever the table's size.

ICWS draws ``BANDS * ROWS`` samples of each document, each equal for two documents with a probability of their weighted
Jaccard similarity; ROWS samples make a band. Documents that share a band (a bucket) are candidates, and a link is an exact weighted
Jaccard similarity of at least ``THRESHOLD``. A class is a connected component of links; equal texts are one node.

Work in a bucket is not quadratic. First, each bucket elects a pivot, the member closest to the consensus of its samples
(in rounds, ``SALT`` members at a time, so that no task holds a large bucket), and members are verified against it. Then
only pairs whose documents are still in different classes are left: for them, the smaller class's members are compared
with the larger class's in tiles of ``TILE`` rows, so links that a pivot doesn't show are found too. Before a text is
fetched, the samples must agree in ``LEAST_EQUAL`` of 30 places, which a pair of similarity 0.8 misses with a probability
of under 2e-4; documents that then still have someone close in another class get a longer signature, and its samples must
agree in ``LONG_EQUAL`` of ``LONG_SAMPLES`` places (missed with a probability of under 1e-4), which leaves few pairs whose
similarity is below 0.65.

Defined cases: null texts are classes of their own (class_id is the doc_id); equal texts, empty ones too, share a class;
a class's id is its smallest doc_id, null if none of its rows has one; exactly one row of a class is kept, a row of that
id (of repeated rows, and of different near copies with the same id, one); repeated rows each get a row; rows of one id
with unlike texts are in classes of their own texts; other columns are ignored; an empty table gives an empty result.

Scale: map-only passes over the text give the frequencies (a table of fixed size) and the signatures (about 200
bytes a document); later steps work on these. Texts are shuffled for candidate documents alone. Rows of keys that
more than 200 rows share (large buckets, texts with many copies, pivots of many) aren't brought together: what
they are joined with is broadcast, for at most ``MAX_LARGE`` keys, or dealt to blocks of them. The labels' spreading along
links joins narrow rows, which adaptive execution splits where one node has very many. Python holds one piece of
text at a time and gives its memory back at the end of a task. Stage tables are written to the shared folder.
"""

from __future__ import annotations

import contextlib
import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import staged
from quillon.llm.text_arrays import PIECE, lengths, mixed, releasing, slices, text_windows
from quillon.operators.graph import components

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 10, 3
SAMPLES = BANDS * ROWS
LEAST_EQUAL = 16
IDF_SHARE = 0.25
COMMON = 0.01
SKETCH_BITS = 18
SKETCH = 1 << SKETCH_BITS
CHUNKS = 1024
SALT = 128
BUCKET_TILE = 500
TILE = 200
LONG_SAMPLES = 192
LONG_EQUAL = 132
LARGE = 200
TEXT_BLOCK = 50
BATCH = 1_000
MAX_LARGE = 20_000
ID_BUCKETS = 1 << 20


# ---- one document ----


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Draws of Gamma(2, 1), their inverses, logarithms of other such draws, and a seed for each sample."""
    rng = np.random.default_rng(1999)
    r, c = rng.gamma(2, 1, 1 << 16).astype(np.float32), rng.gamma(2, 1, 1 << 16)
    r = np.maximum(r, np.float32(1e-3))
    return r, (1 / r).astype(np.float32), np.log(c).astype(np.float32), rng.integers(0, 1 << 64, SAMPLES + LONG_SAMPLES, dtype=np.uint64)


def icws(shingles: np.ndarray, weights: np.ndarray, begin: int = 0, end: int = SAMPLES) -> np.ndarray:
    """Consistent samples (of the numbers begin up to end) of a weighted set, each as a 32-bit hash of (shingle, level)."""
    r_of, inverse, log_c, seeds = _tables()
    seeds, n = seeds[begin:end], end - begin
    log_w, out, best = np.log(weights).astype(np.float32), np.empty(n, np.uint32), np.full(n, np.inf, np.float32)
    step = max(1, (4096 * SAMPLES) // n)
    for a in range(0, len(shingles), step):
        s, lw = shingles[a : a + step], log_w[a : a + step]
        h = (s[None, :] ^ seeds[:, None]) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        parts = h.view(np.uint16).reshape(n, -1, 4)
        i = parts[:, :, 3]
        r, beta = r_of[i], parts[:, :, 1] * np.float32(2**-16)
        level = np.floor(lw * inverse[i] + beta)
        cost = log_c[parts[:, :, 2]] - r * (level - beta + 1)
        at = cost.argmin(1)
        rows = np.arange(n)
        low = cost[rows, at]
        won = low < best
        found = mixed(s[at] ^ (level[rows, at].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        out[won], best[won] = (found >> np.uint64(32)).astype(np.uint32)[won], low[won]
    return out


def _counter(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def idf_factor(df, n_docs: int, idf_share: float = IDF_SHARE):
    """The factor of a shingle that df of n_docs documents hold."""
    return 1 + idf_share * np.minimum(1, np.log(max(n_docs, 1) / np.maximum(df, 1)) / np.log(1 / COMMON))


@dataclass(frozen=True)
class Weights:
    """Factors of shingles: those of common ones, which lie in the marked counters, and that of all others."""

    rare: float
    shingles: np.ndarray
    factors: np.ndarray
    marked: np.ndarray

    def of(self, shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
        out = counts * self.rare
        if len(self.shingles):
            near = np.flatnonzero(self.marked[_counter(shingles)])
            place = np.minimum(np.searchsorted(self.shingles, shingles[near]), len(self.shingles) - 1)
            same = self.shingles[place] == shingles[near]
            out[near[same]] = counts[near[same]] * self.factors[place[same]]
        return out


def weighted_sets(column: pa.Array, weights: Weights):
    """Shingles (sorted) and weights of each text."""
    for hashes in text_windows(column, SHINGLE):
        shingles, counts = np.unique(hashes, return_counts=True)
        yield shingles, weights.of(shingles, counts)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    small, large = (a, b) if len(a[0]) <= len(b[0]) else (b, a)
    if not len(small[0]):
        return 0.0
    at = np.minimum(np.searchsorted(large[0], small[0]), len(large[0]) - 1)
    shared = np.minimum(small[1], large[1][at])[large[0][at] == small[0]].sum()
    return float(shared / (small[1].sum() + large[1].sum() - shared))


def _text_slices(batch: pa.RecordBatch, name: str = "text"):
    for a, b in slices(lengths(batch.column(name)), PIECE):
        yield batch.slice(a, b - a)


# ---- passes over the text ----


def frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Counters of document frequencies, and the number of documents that have words."""

    def count(batches):
        counts, n = np.zeros(SKETCH, np.uint32), 0
        for batch in batches:
            for part in _text_slices(batch):
                once = [np.unique(h) for h in text_windows(part.column("text"), SHINGLE)]
                counts += np.bincount(_counter(np.concatenate(once)), minlength=SKETCH).astype(np.uint32)
                n += sum(len(h) > 0 for h in once)
        pieces = counts.astype("<u4").reshape(CHUNKS, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([c.tobytes() for c in pieces], pa.binary()), pa.array([n] + [0] * (CHUNKS - 1), pa.int64())], ["chunk", "counts", "n"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(SKETCH // CHUNKS, np.int64)
        for c in table.column("counts"):
            data = c.as_py()
            total += np.frombuffer(data, "<u4" if len(data) == 4 * len(total) else "<i8")
        return pa.table({"chunk": pa.array([table.column("chunk")[0].as_py()], pa.int32()), "counts": pa.array([total.astype("<i8").tobytes()], pa.binary()), "n": pa.array([int(np.asarray(table.column("n")).sum())], pa.int64())})

    kind = "chunk int, counts binary, n long"
    rows = sorted(texts.select("text").mapInArrow(releasing(count), kind).groupBy("chunk").applyInArrow(add, kind).collect())  # CHUNKS rows, SKETCH counters in all
    if not rows:
        return np.zeros(SKETCH, np.int64), 0
    return np.concatenate([np.frombuffer(r["counts"], "<i8") for r in rows]), sum(r["n"] for r in rows)


def document_weights(texts: DataFrame, idf_share: float = IDF_SHARE) -> Weights:
    """Factors from the document frequencies of all texts (column text); those of common shingles are counted exactly."""
    counts, n = frequencies(texts)
    floor = max(2, int(np.ceil(COMMON * n)))
    near, rare = counts >= floor, float(idf_factor(1, n, idf_share))
    if not near.any():
        return Weights(rare, np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, bool))
    asked = texts.sparkSession.sparkContext.broadcast(near)  # SKETCH bits

    def count(batches):
        marked = asked.value
        for batch in batches:
            for part in _text_slices(batch):
                found = [h[marked[_counter(h)]] for h in map(np.unique, text_windows(part.column("text"), SHINGLE))]
                shingles, many = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(shingles.view(np.int64)), pa.array(many, pa.int64())], ["shingle", "df"])

    exact = texts.select("text").mapInArrow(releasing(count), "shingle long, df long").groupBy("shingle").agg(F.sum("df").alias("df")).where(F.col("df") >= floor)
    rows = exact.toArrow()  # at most 1 / COMMON times a document's mean number of shingles
    shingles, df = (rows.column(c).to_numpy().astype(np.int64) for c in ("shingle", "df"))
    shingles = shingles.view(np.uint64)
    order, marked = np.argsort(shingles), np.zeros(SKETCH, bool)
    marked[_counter(shingles)] = True
    return Weights(rare, shingles[order], idf_factor(df[order], n, idf_share), marked)


def _keyed(texts: DataFrame) -> DataFrame:
    """doc, key1, key2 (hashes of the text) and text of the rows that have one."""
    return texts.where("text is not null").select("doc", F.xxhash64("text").alias("key1"), F.xxhash64(F.lit(7), "text").alias("key2"), "text")


def signatures(texts: DataFrame, weights) -> DataFrame:
    """For each row with text: row (its number), doc, key1, key2 and sig (null for texts without words)."""

    def sign(batches):
        of = weights.value
        for batch in batches:
            for part in _text_slices(batch):
                sigs = [icws(s, w).astype("<u4").tobytes() if len(s) else None for s, w in weighted_sets(part.column("text"), of)]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(sigs, pa.binary())], [*names, "sig"])

    names = ["row", "doc", "key1", "key2"]
    return _keyed(texts).withColumn("row", F.monotonically_increasing_id()).select(*names, "text").mapInArrow(releasing(sign), "row long, doc long, key1 long, key2 long, sig binary")


# ---- joins in which a key can have very many rows ----


def large_keys(sized: DataFrame, *keys: str, least: int = LARGE) -> DataFrame | None:
    """Of a table with one row (keys, size) for each key: those that more than least rows share, and more than a MAX_LARGE-th of all rows, so that they are fewer than MAX_LARGE; None if there are none."""
    total, most = sized.agg(F.sum("size"), F.max("size")).first()
    threshold = max(least, (total or 0) // MAX_LARGE)
    return staged(sized.where(F.col("size") > threshold).select(*keys, "size").coalesce(1), "large") if (most or 0) > threshold else None


def joined(rows: DataFrame, other: DataFrame, large: DataFrame | None, *keys: str) -> DataFrame:
    """rows joined with other, which has one row for each key. Rows of large keys stay in their tasks: other's rows of these, fewer than MAX_LARGE, are broadcast."""
    if large is None:
        return rows.join(other, list(keys))
    few = F.broadcast(large.select(*keys))
    there = rows.join(F.broadcast(other.join(few, list(keys), "left_semi")), list(keys))
    rest = rows.join(few, list(keys), "left_anti").join(other.join(few, list(keys), "left_anti"), list(keys))
    return there.unionByName(rest)


# ---- buckets and pivots ----


def buckets(nodes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Table of node, sig, band, key and size for each band of each node, in buckets of at least two; and the large keys."""
    band = lambda b: F.xxhash64(F.lit(b), F.substring("sig", 4 * ROWS * b + 1, 4 * ROWS))
    rows = nodes.where("sig is not null").select("node", F.posexplode(F.array(*[band(b) for b in range(BANDS)])).alias("band", "key"))
    sizes = staged(rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "bucket-sizes")
    large = large_keys(sizes, "key")
    shared = joined(rows, sizes, large, "key")
    return staged(shared.join(nodes.select("node", "sig"), "node"), "members"), large


def _elect(rows: pa.Table) -> pa.Table:
    """Of the members of a bucket (or a part of one), that whose samples agree most with the consensus."""
    nodes = np.asarray(rows.column("node"))
    if len(nodes) <= 2:
        best = int(nodes.argmin())
    else:
        sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), "<u4").reshape(-1, SAMPLES)
        score = np.zeros(len(nodes), np.int64)
        for column in sig.T:
            _, place, many = np.unique(column, return_inverse=True, return_counts=True)
            score += place == many.argmax()
        best = int(np.lexsort((nodes, -score))[0])
    return rows.take([best])  # a copy, so that the batch can go


def pivots(members: DataFrame, large: DataFrame | None) -> DataFrame:
    """key, pivot, pivot_sig for each bucket; members is a stage table with key, node, sig, size."""
    left = members.select("key", "node", "sig", "size")

    def elect(batches):
        chosen = []
        for group in _groups(batches, ("key", "salt")):
            chosen.append(_elect(group))
            if len(chosen) == 1000:
                yield from _chosen(chosen)
                chosen = []
        yield from _chosen(chosen)

    def _chosen(tables):
        if tables:
            yield from pa.concat_tables(tables).select(["key", "node", "sig", "salt"]).combine_chunks().to_batches()

    while True:
        parts = F.ceil(F.col("size") / SALT)
        salted = left.withColumn("salt", F.pmod(F.xxhash64(F.lit(5), "node"), parts).cast("int"))
        left = staged(_dealt(salted, "key", "salt").mapInArrow(releasing(elect), "key long, node long, sig binary, salt int"), "pivots")
        sizes = left.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
        if sizes.agg(F.coalesce(F.max("size"), F.lit(0))).first()[0] <= 1:
            return left.select("key", F.col("node").alias("pivot"), F.col("sig").alias("pivot_sig"))
        left = joined(left.select("key", "node", "sig"), sizes, large, "key")


def _equal_places(a: str, b: str) -> Column:
    """How many samples two signatures share."""
    at = lambda s, i: F.substring(s, 4 * i + 1, 4)
    return functools.reduce(lambda x, y: x + y, [(at(a, i) == at(b, i)).cast("int") for i in range(SAMPLES)])


# ---- exact similarity ----


def _mark(*columns) -> Column:
    return F.pmod(F.xxhash64(F.lit(3), *columns), F.lit(ID_BUCKETS)).cast("int")


def _marks(rows: DataFrame, *columns: str) -> DataFrame:
    """ID_BUCKETS marks at most, of the given rows; broadcast, they tell most other rows apart before any shuffle."""
    return F.broadcast(rows.select(_mark(*columns).alias("_mark")).distinct())


def node_texts(texts: DataFrame, nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """node, text of the given nodes (column id, distinct). Copies of a text are one row before they are shuffled."""
    wanted = staged(nodes.join(ids, nodes["node"] == ids["id"], "left_semi").select("node", "key1", "key2"), "wanted")
    keyed = _keyed(texts)
    near = keyed.join(_marks(wanted, "key1", "key2"), _mark("key1", "key2") == F.col("_mark"), "left_semi")
    return near.groupBy("key1", "key2").agg(F.first("text").alias("text")).join(wanted, ["key1", "key2"]).select("node", "text")


def verified(pairs: DataFrame, texts: DataFrame, weights) -> DataFrame:
    """x, y, similarity of the pairs (x, y) of nodes; texts has node, text. A y of many pairs is compared in blocks of TEXT_BLOCK."""

    def compare(batches):
        of, last, own = weights.value, None, None
        for batch in batches:
            for part in _text_slices(batch, "x_text"):
                y, y_text, found = part.column("y").to_pylist(), part.column("y_text"), []
                for i, a in enumerate(weighted_sets(part.column("x_text"), of)):
                    if last != y[i]:
                        last, own = y[i], next(weighted_sets(y_text.slice(i, 1), of))
                    found.append(weighted_jaccard(a, own))
                yield pa.RecordBatch.from_arrays([part.column("x"), part.column("y"), pa.array(found, pa.float64())], ["x", "y", "similarity"])

    left = pairs.join(texts.select(F.col("node").alias("x"), F.col("text").alias("x_text")), "x")
    right = texts.select(F.col("node").alias("y"), F.col("text").alias("y_text"))
    large = large_keys(pairs.groupBy("y").agg(F.count(F.lit(1)).alias("size")), "y", least=TEXT_BLOCK)
    if large is None:
        both = left.join(right, "y")
    else:
        blocks = F.broadcast(large.select("y", F.ceil(F.col("size") / TEXT_BLOCK).cast("int").alias("blocks")))
        many = F.coalesce("blocks", F.lit(1))
        left = left.join(blocks, "y", "left").withColumn("block", F.pmod(F.xxhash64("x"), many).cast("int")).drop("blocks")
        right = right.join(blocks, "y", "left").select("y", "y_text", F.explode(F.sequence(F.lit(0), many - 1)).alias("block"))
        both = left.join(right, ["y", "block"])
    return both.select("x", "y", "x_text", "y_text").mapInArrow(releasing(compare), "x long, y long, similarity double")


# ---- links that pivots don't show ----


def _tiled(members: DataFrame, classes: DataFrame, large: DataFrame | None) -> DataFrame:
    """Rows of buckets that hold several classes, in tiles: each row in a block of its own bucket, and those outside the bucket's largest class once more in each block, as asking rows (in blocks too)."""
    labelled = members.join(classes, "node")
    parts = labelled.groupBy("key", "label", "class_size").agg(F.count(F.lit(1)).alias("n"))
    shared = parts.groupBy("key").agg(F.count(F.lit(1)).alias("n_classes"), F.sum("n").alias("n"), F.max(F.struct("class_size", "label", "n")).alias("top")).where("n_classes > 1")
    blocks = lambda n: F.ceil(n / BUCKET_TILE).cast("int")
    sized = shared.select("key", F.col("top.label").alias("top"), blocks(F.col("n")).alias("right_blocks"), blocks(F.col("n") - F.col("top.n")).alias("left_blocks"))
    rows = joined(labelled, sized, large, "key")
    own = lambda c: F.pmod(F.xxhash64(F.lit(9), "node"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    kept = ("key", "band", "node", "sig", "label", "class_size")
    right = rows.select(*kept, F.lit(False).alias("asks"), own("right_blocks").alias("rb"), every("left_blocks").alias("lb"))
    left = rows.where("label != top").select(*kept, F.lit(True).alias("asks"), every("right_blocks").alias("rb"), own("left_blocks").alias("lb"))
    return right.unionByName(left)


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *keys).sortWithinPartitions(*keys)


def _groups(batches, names: tuple[str, ...]):
    """Tables of the rows of equal keys, from batches sorted by them."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = pa.concat_tables([held, table]) if held is not None else table
        keys = np.stack([np.asarray(held.column(c)) for c in names], 1)
        at = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1])
        for a, b in zip(at[:-1], at[1:], strict=True):
            yield held.slice(int(a), int(b - a))
        held = held.slice(int(at[-1]))
    if held is not None and len(held):
        yield held


def _close(table: pa.Table):
    """For each asking row of a tile: its place and those of close rows of other classes. A pair counts in the first band that it shares only."""
    asks = np.asarray(table.column("asks"))
    if not asks.any() or asks.all():
        return
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), "<u4").reshape(-1, SAMPLES)
    label, band, right = np.asarray(table.column("label")), table.column("band")[0].as_py(), np.flatnonzero(~asks)
    theirs = sig[right]
    for i in np.flatnonzero(asks):
        same = theirs == sig[i]
        near = np.flatnonzero((same.sum(1) >= LEAST_EQUAL) & (label[right] != label[i]))
        if len(near):
            first = same[near].reshape(len(near), BANDS, ROWS).all(2).argmax(1)
            near = near[first == band]
        if len(near):
            yield int(i), right[near]


def loose_nodes(tiles: DataFrame) -> DataFrame:
    """Nodes that are close to a node of another class."""

    def run(batches):
        for table in _groups(batches, ("key", "rb", "lb")):
            found = {k for i, near in _close(table) for k in (i, *near.tolist())}
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(table.column("node"))[sorted(found)])], ["id"])

    return _dealt(tiles, "key", "rb", "lb").mapInArrow(releasing(run), "id long").distinct()


def long_signatures(texts: DataFrame, weights) -> DataFrame:
    """node, text, long_sig: LONG_SAMPLES more samples, 16 bits each."""

    def run(batches):
        of = weights.value
        for batch in batches:
            for part in _text_slices(batch):
                sigs = [(icws(s, w, SAMPLES, SAMPLES + LONG_SAMPLES) >> np.uint32(16)).astype("<u2").tobytes() for s, w in weighted_sets(part.column("text"), of)]
                yield pa.RecordBatch.from_arrays([part.column("node"), part.column("text"), pa.array(sigs, pa.binary())], ["node", "text", "long_sig"])

    return texts.select("node", "text").mapInArrow(releasing(run), "node long, text string, long_sig binary")


def units(tiles: DataFrame, sigs: DataFrame) -> DataFrame:
    """(class, x): x is close to some member of the class, by long signatures too, and is in another, not larger class."""

    def run(batches):
        for table in _groups(batches, ("key", "rb", "lb")):
            node, label, size = (np.asarray(table.column(c)) for c in ("node", "label", "class_size"))
            long, found = np.frombuffer(b"".join(table.column("long_sig").to_pylist()), "<u2").reshape(-1, LONG_SAMPLES), set()
            for i, near in _close(table):
                for k in near[(long[near] == long[i]).sum(1) >= LONG_EQUAL].tolist():
                    own, other = (int(size[i]), int(label[i])), (int(size[k]), int(label[k]))
                    found.add((other[1], int(node[i])) if other > own else (own[1], int(node[k])))
            if found:
                a, b = zip(*sorted(found), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["class", "x"])

    return _dealt(tiles.join(sigs, "node"), "key", "rb", "lb").mapInArrow(releasing(run), "class long, x long").distinct()


def class_links(asked: DataFrame, classes: DataFrame, signed: DataFrame, weights) -> DataFrame:
    """Edges (a, b) between x and a member of the class, for each unit (class, x) that has any. Classes are cut into tiles, and those that ask into blocks; signed has node, text, long_sig of all nodes that can be on an edge."""
    asks = asked.groupBy(F.col("class").alias("label")).agg(F.ceil(F.count(F.lit(1)) / BUCKET_TILE).cast("int").alias("ask_blocks"))
    sizes = classes.groupBy("label").agg(F.first("class_size").alias("class_size")).join(asks, "label")
    wanted = sizes.select(F.col("label").alias("class"), F.ceil(F.col("class_size") / TILE).cast("int").alias("tiles"), "ask_blocks", F.greatest("class_size", F.col("ask_blocks") * BUCKET_TILE).alias("size"))
    wanted, large = wanted.drop("size"), large_keys(wanted, "class")
    own = lambda c: F.pmod(F.xxhash64(F.lit(9), "node"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    members = joined(classes.select("node", F.col("label").alias("class")), wanted, large, "class")
    right = members.select("class", "node", own("tiles").alias("tile"), F.lit(False).alias("asks"), every("ask_blocks").alias("block"))
    left = joined(asked.select("class", F.col("x").alias("node")), wanted, large, "class").select("class", "node", every("tiles").alias("tile"), F.lit(True).alias("asks"), own("ask_blocks").alias("block"))

    def link(batches):
        of, at, held = weights.value, None, []
        for batch in batches:
            for part in _text_slices(batch):
                sets = weighted_sets(part.column("text"), of)
                for *key, ask, node, sig, own in zip(*(part.column(c).to_pylist() for c in ("class", "tile", "block", "asks", "node", "long_sig")), sets, strict=True):
                    if at != key:
                        at, held = key, []
                    sig = np.frombuffer(sig, "<u2")
                    if not ask:
                        held.append((node, sig, own))  # a tile's members, TILE on average, come first
                        continue
                    for other, s, w in held:
                        if (s == sig).sum() >= LONG_EQUAL and weighted_jaccard(own, w) >= THRESHOLD:
                            yield pa.RecordBatch.from_arrays([pa.array([other], pa.int64()), pa.array([node], pa.int64())], ["a", "b"])
                            break

    rows = right.unionByName(left).join(signed, "node")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "class", "tile", "block").sortWithinPartitions("class", "tile", "block", "asks").mapInArrow(releasing(link), "a long, b long")


# ---- the operator ----


@contextlib.contextmanager
def _small_batches(spark: SparkSession):
    """Arrow batches of at most BATCH rows while tables with texts are made here: a batch lies in memory twice, in the JVM and in Python."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(BATCH, int(before)) if int(before) > 0 else BATCH))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _rows(docs: DataFrame, doc_id: str, text: str, idf_share: float) -> DataFrame:
    """A row for each document that has a text: doc, key1, key2, class_id, kept, n_links."""
    spark = docs.sparkSession
    texts = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
    with _small_batches(spark):
        weights = spark.sparkContext.broadcast(document_weights(texts, idf_share))  # common shingles, and a bit for each counter
        signed = staged(signatures(texts, weights), "signatures")
    order = F.struct(F.col("doc").isNull().alias("none"), "doc", "key1", "key2", "row")  # ids before null
    distinct = signed.groupBy("key1", "key2").agg(F.min(order).alias("first"), F.first("sig").alias("sig"), F.count(F.lit(1)).alias("size"))
    nodes = staged(distinct.withColumn("node", F.monotonically_increasing_id()), "nodes")
    with _small_batches(spark):
        labels, links = _classes(nodes, texts, weights)

    degrees = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    named = nodes.join(labels, "node", "left").join(degrees, "node", "left")
    named = staged(named.select("key1", "key2", "size", "first", F.coalesce("label", "node").alias("label"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "named")
    classes = named.groupBy("label").agg(F.min("first").alias("best"), F.count(F.lit(1)).alias("size"))
    led = joined(named.drop("size"), classes.drop("size"), large_keys(classes, "label"), "label")
    led = led.select("key1", "key2", "best", "n_links")
    rows = joined(signed.select("row", "doc", "key1", "key2"), led, large_keys(nodes.select("key1", "key2", "size"), "key1", "key2"), "key1", "key2")
    return rows.select("doc", "key1", "key2", F.col("best.doc").alias("class_id"), (F.col("row") == F.col("best.row")).alias("kept"), "n_links")


def classes_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", idf_share: float = IDF_SHARE) -> DataFrame:
    """A row for each document: doc_id, class_id (the class's smallest doc_id), kept (one row of each class) and n_links (links found between its text and others)."""
    known = _rows(docs, doc_id, text, idf_share).select(F.col("doc").alias(doc_id), "class_id", "kept", "n_links")
    alone = docs.where(F.col(text).isNull()).select(F.col(doc_id).cast("long").alias(doc_id))
    return known.unionByName(alone.select(doc_id, F.col(doc_id).alias("class_id"), F.lit(True).alias("kept"), F.lit(0).cast("long").alias("n_links")))


def _classes(nodes: DataFrame, texts: DataFrame, weights) -> tuple[DataFrame, DataFrame]:
    """node, label of the nodes that have links; and the links (a, b) found."""
    members, large = buckets(nodes)
    led = pivots(members, large)
    close = joined(members, led, large, "key").where("node != pivot").select(F.col("node").alias("x"), F.col("pivot").alias("y"), "sig", "pivot_sig").where(_equal_places("sig", "pivot_sig") >= LEAST_EQUAL).select("x", "y").distinct()
    pairs = staged(close, "pairs")
    ids = pairs.select(F.col("x").alias("id")).union(pairs.select("y")).distinct()
    near = staged(node_texts(texts, nodes, ids), "texts")
    links = staged(verified(pairs, near, weights).where(F.col("similarity") >= THRESHOLD).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    first = components(links)

    involved = members.select("node").distinct().join(first, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
    sizes = involved.groupBy("label").agg(F.count(F.lit(1)).alias("class_size"))
    classes = staged(joined(involved, sizes, large_keys(sizes.withColumnRenamed("class_size", "size"), "label"), "label"), "classes")
    tiles = _tiled(members, classes, large)
    ids = staged(loose_nodes(tiles), "loose")
    if not ids.limit(1).count():
        return first, links
    signed = staged(long_signatures(node_texts(texts, nodes, ids), weights), "long-signatures")
    asked = staged(units(tiles, signed.select("node", "long_sig")), "units")
    more = staged(class_links(asked, classes, signed, weights), "more-links")
    if not more.limit(1).count():
        return first, links
    label = lambda c: classes.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))
    merged = components(more.join(label("a"), "a").join(label("b"), "b").select(F.col("a_label").alias("a"), F.col("b_label").alias("b")))
    moved = merged.select(F.col("node").alias("label"), F.col("label").alias("to"))
    every = links.union(more.select(F.least("a", "b"), F.greatest("a", "b"))).distinct()
    return classes.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label")), every


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class, with all its columns: of the rows of its smallest doc_id, one. Rows without text all stay."""
    own = _rows(docs, doc_id, text, IDF_SHARE).groupBy("doc", "key1", "key2").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    touched = staged(own.where("not kept or n > 1").select(F.col("doc").alias("_doc"), F.col("key1").alias("_key1"), F.col("key2").alias("_key2"), F.col("kept").alias("_kept")), "copies")
    names = docs.columns
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    doc, body = (F.col(f"c{names.index(c)}") for c in (doc_id, text))
    keys = [doc.cast("long"), F.xxhash64(body), F.xxhash64(F.lit(7), body)]
    same = _mark(*keys) == F.col("_mark")
    marks = _marks(touched, "_doc", "_key1", "_key2")
    near, rest = inner.join(marks, same & body.isNotNull(), "left_semi"), inner.join(marks, same & body.isNotNull(), "left_anti")
    met = near.join(touched, keys[0].eqNullSafe(F.col("_doc")) & (keys[1] == F.col("_key1")) & (keys[2] == F.col("_key2")), "left")
    fields = [f"c{i}" for i in range(len(names))]
    several = met.where("_kept").groupBy("_doc", "_key1", "_key2").agg(F.first(F.struct(*fields)).alias("one")).select("one.*")  # rows that are repeated and kept
    return rest.unionByName(met.where("_kept is null").select(*fields)).unionByName(several).toDF(*names)
