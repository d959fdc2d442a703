"""Best-fit packing with certified bounds.

Texts become token ids and pieces of at most ``CAPACITY`` tokens. The pieces' lengths are dealt to partitions of about
``PART_ROWS`` rows by a hash, and each partition is packed best-fit decreasing. Dual-feasible functions bound the
partition's bin count from below: one that meets its bound is certified as best possible. The bins that aren't full of the
partitions with a gap give up their pieces; these are dealt anew, across partitions, and packed again, as long as this
saves bins. Where the whole is then still above its own bound, the same is done with such bins of all partitions (each
certified one may waste part of its last bin). It ends when the whole is certified or a round saves nothing; the result
tells the bins used and their bound.

Dual-feasible functions used, for lengths x of capacity C: u_a(x) = C if x > C-a, 0 if x < a, else x, for each a up to
C/2; and f_k(x) = x if (k+1)x/C is whole, else floor((k+1)x/C) * C/k, for k up to 20. The sum of any over C, rounded
up, is a bound.

Defined cases: a null or empty text is a piece that holds the end id alone; null ids are kept; repeated rows are packed
each; other columns are ignored; an empty table gives an empty result.

Scale: tokenising is map-only and its narrow result (a row for each piece, no text) is written once. Pieces are dealt by
their row number in that table, so that repeated rows are dealt like any others. A task packs about PART_ROWS rows,
however many partitions there are; the driver sees counts only.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import staged
from quillon.llm.text_arrays import releasing
from quillon.llm.word_ids import encoder, text_rows

CAPACITY = 4096
PART_ROWS = 20_000
LOOSE = 0.995

PIECE = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"
_PIECE = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_NAMES = ["doc_id", "piece", "start", "length", "ids_crc32"]


def pieces_of(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of each document, without their ids, and with a row number."""
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches):
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for rows, texts in text_rows(batch, "text"):
                out = []
                for doc, data in zip(rows.column("doc").to_pylist(), encoder(tokenizer).encode(texts), strict=True):
                    data += end
                    for k, a in enumerate(range(0, len(data), 4 * capacity)):
                        part = data[a : a + 4 * capacity]
                        out.append((row, doc, k, a // 4, len(part) // 4, zlib.crc32(part)))
                        row += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _PIECE, strict=True)], schema=_PIECE)

    return docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text")).mapInArrow(releasing(run), PIECE)


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY, counts: np.ndarray | None = None) -> int:
    """The best bound on the number of bins that the dual-feasible functions give."""
    many = np.bincount(lengths, weights=counts, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    total, number = np.cumsum(many * size), np.cumsum(many)
    best = -(-int(total[-1]) // capacity)
    a = np.arange(1, capacity // 2 + 1)
    large = number[-1] - number[capacity - a]
    middle = total[capacity - a] - total[a - 1]
    best = max(best, int((large + -(-middle // capacity)).max(initial=0)))
    for k in range(1, 21):
        times = (k + 1) * size
        value = np.where(times % capacity == 0, size * k, times // capacity * capacity)  # k times f_k
        best = max(best, -(-int((many * value).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and how full each bin is."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    fills, some = [], 0  # some: bit r is set if a bin has r free
    for i in order.tolist():
        n = int(lengths[i])
        fits = some >> n
        if fits:
            room = n + ((fits & -fits).bit_length() - 1)
            b = free[room].pop()
            if not free[room]:
                some ^= 1 << room
        else:
            b, room = len(fills), capacity
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += n
        if left := room - n:
            free[left].append(b)
            some |= 1 << left
    return bins, offsets, np.asarray(fills, np.int64)


_PLACED = PIECE + ", part int, bin long, offset long, fill long, bins long, bound long"


def _pack(pieces: DataFrame, n_parts: int, seed: int, capacity: int) -> DataFrame:
    """Deals the pieces out and packs each partition."""

    def run(table: pa.Table) -> pa.Table:
        lengths = np.asarray(table.column("length"))
        bins, offsets, fills = best_fit_decreasing(lengths, capacity)
        bound = lower_bound(lengths, capacity)
        more = {"bin": bins, "offset": offsets, "fill": fills[bins], "bins": np.full(len(bins), len(fills)), "bound": np.full(len(bins), bound)}
        for name, values in more.items():
            table = table.append_column(name, pa.array(values, pa.int64()))
        return table

    key = F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(n_parts)).cast("int")
    return pieces.select("row", *_NAMES, key.alias("part")).groupBy("part").applyInArrow(run, _PLACED)


def _parts(n: int) -> int:
    return max(1, -(-n // PART_ROWS))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (a written table with a row number) with sequence_id and offset, whether the partition is certified, and of the whole the sequences used and their lower bound."""
    sizes = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most capacity rows
    zero = F.lit(0).cast("long")
    if not sizes:
        return pieces.select(*_NAMES, zero.alias("sequence_id"), zero.alias("offset"), F.lit(True).alias("certified"), zero.alias("sequences"), zero.alias("bound"))
    least = lower_bound(np.array([r["length"] for r in sizes]), capacity, np.array([r["n"] for r in sizes]))

    def bins_in(df: DataFrame) -> int:
        return df.where("offset = 0").count()

    first = staged(_pack(pieces, _parts(sum(r["n"] for r in sizes)), 0, capacity), "packed-0")
    done, used, turn = first.withColumn("round", F.lit(0)), bins_in(first), 0
    slack = F.col("fill") < LOOSE * capacity
    for give in (slack & (F.col("bins") > F.col("bound")), slack):  # partitions with a gap, then all
        while used > least:
            loose = done.where(give)
            before, n = bins_in(loose), loose.count()
            if before < 2:
                break
            turn += 1
            again = staged(_pack(loose, _parts(n), turn, capacity), f"packed-{turn}")
            after = bins_in(again)
            if after >= before:
                break
            done = done.where(~give).unionByName(again.withColumn("round", F.lit(turn)))
            used += after - before
    number = F.shiftleft(F.col("round").cast("long"), 48) + F.shiftleft(F.col("part").cast("long"), 20) + F.col("bin")
    return done.select(*_NAMES, number.alias("sequence_id"), "offset", (F.col("bins") <= F.col("bound")).alias("certified"), F.lit(used).cast("long").alias("sequences"), F.lit(least).cast("long").alias("bound"))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return pack(staged(pieces_of(docs, tokenizer, end_id, capacity, doc_id, text), "pieces"), capacity)
