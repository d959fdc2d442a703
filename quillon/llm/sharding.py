"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns ``VNODES`` points of a 64-bit ring. A row's hash lies in one of ``CELLS`` equal cells; a cell belongs to
the shard of the next point clockwise. A shard takes what its own arcs bring up to its capacity, (1 + SLACK) times the
mean; the arcs beyond go on clockwise to the next shard with room. The driver runs this on the cells' byte counts (a
table of at most CELLS rows). A cell that must be cut is cut at a hash, found from running sums of CELLS finer cells in
it. Thus the finished ring is a function of the hash alone, a table of bounded size, and the rows stay where they are.

A key whose rows together hold more than SLACK of a shard (a repeated id) would lie in one place of the ring. Its rows
are written to a table first and hashed by key and row number, so that they spread over the ring like any others. There
are at most n_shards / SLACK such keys.

The law that holds is ``bytes``: no shard exceeds its capacity by more than one finest cell (a single row, or the rows of
a key that hold no more than SLACK of a shard, unless the table has far over CELLS * CELLS rows), hence all are near
equal. With one more shard the arcs of its points move to it and capacities shrink, so only what overflows moves between
old shards.

Defined cases: a null text has no bytes (size 1, crc of nothing); a null id is hashed by text; repeated rows get slots
of their own; ``assign`` passes other columns through, also those named like its helpers (its three results' names apart,
which it refuses); an empty table gives an empty result.

Scale: aggregations by cell with partial sums (nothing else is shuffled to find the ring; single keys are counted in
cells that are heavy enough to hold a heavy one alone), a broadcast join with the ring (at most CELLS + cuts rows), and
one shuffle by cell and shard to number the rows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import staged

SHARDS = 8
VNODES = 128
CELL_BITS = 14
CELLS = 1 << CELL_BITS
FINE_BITS = 14
SLACK = 0.001


def cell_owners(n_shards: int, vnodes: int = VNODES) -> list[list[int]]:
    """For each cell the shards in the order in which points follow clockwise."""
    points = sorted(
        (int.from_bytes(hashlib.sha256(f"shard {s} point {v}".encode()).digest()[:8], "big") >> (64 - CELL_BITS), s) for s in range(n_shards) for v in range(vnodes)
    )
    places = [p for p, _ in points]
    out = []
    for cell in range(CELLS):
        at, order = bisect_left(places, cell), []
        for k in range(len(points)):
            if (s := points[(at + k) % len(points)][1]) not in order:
                order.append(s)
            if len(order) == n_shards:
                break
        out.append(order)
    return out


def fill(loads: dict[int, int], owners: list[list[int]], n_shards: int, slack: float = SLACK) -> dict[int, list[tuple[int, int]]]:
    """Bounded loads: for each cell, (bytes, shard) in turn. Own arcs come first, in ring order; what a full shard can't take goes on clockwise."""
    capacity = -(-int(sum(loads.values()) * (1 + slack)) // n_shards) + 1
    room, out = dict.fromkeys(range(n_shards), capacity), {c: [] for c in loads}
    waiting = [(cell, loads[cell]) for cell in sorted(loads)]
    for turn in range(n_shards):
        later = []
        for cell, left in waiting:
            shard = owners[cell][turn]
            if took := min(left, room[shard]):
                room[shard] -= took
                out[cell].append((took, shard))
            if left > took:
                later.append((cell, left - took))
        waiting = later
    return out


def _hashed(docs: DataFrame, key: str, text: str) -> DataFrame:
    own = F.xxhash64(F.coalesce(F.col(key).cast("string"), F.concat(F.lit("text:"), F.coalesce(F.col(text), F.lit("")))))
    return docs.withColumn("_size", (F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 1).cast("long")).withColumn("_hash", own)


def _celled(rows: DataFrame) -> DataFrame:
    cell = lambda shift, mask: F.shiftrightunsigned("_hash", shift).bitwiseAND(F.lit(mask)).cast("int")
    return rows.withColumns({"_cell": cell(64 - CELL_BITS, CELLS - 1), "_fine": cell(64 - CELL_BITS - FINE_BITS, (1 << FINE_BITS) - 1)})


def _spread(hashed: DataFrame, n_shards: int, slack: float) -> DataFrame:
    """The rows with cells; those of heavy keys are written, and hashed by row."""
    spark, narrow = hashed.sparkSession, _celled(hashed.select("_hash", "_size"))
    loads = {r["_cell"]: r["n"] for r in narrow.groupBy("_cell").agg(F.sum("_size").alias("n")).collect()}  # at most CELLS rows
    most = sum(loads.values()) * slack / n_shards
    near = [(c,) for c, n in sorted(loads.items()) if n > most]
    if not near:
        return _celled(hashed)
    alone = narrow.join(F.broadcast(_packed(spark, near, ["_cell"])), "_cell").groupBy("_hash").agg(F.sum("_size").alias("n"), F.count(F.lit(1)).alias("rows"))
    heavy = [(r["_hash"],) for r in alone.where((F.col("rows") > 1) & (F.col("n") > most)).collect()]  # at most n_shards / slack
    if not heavy:
        return _celled(hashed)
    few = F.broadcast(_packed(spark, heavy, [], "_hash"))
    numbered = staged(hashed.join(few, "_hash", "left_semi").withColumn("_row", F.monotonically_increasing_id()), "heavy-keys")
    apart = numbered.withColumn("_hash", F.xxhash64("_hash", "_row")).drop("_row")
    return _celled(hashed.join(few, "_hash", "left_anti").unionByName(apart))


def ring(celled: DataFrame, n_shards: int = SHARDS, vnodes: int = VNODES, slack: float = SLACK) -> list[tuple[int, int, int, int]]:
    """The finished ring as (cell, first fine cell, last fine cell, shard), for rows with _cell, _fine and _size."""
    spark, narrow = celled.sparkSession, celled.select("_cell", "_fine", "_size")
    loads = {r["_cell"]: r["n"] for r in narrow.groupBy("_cell").agg(F.sum("_size").alias("n")).collect()}  # at most CELLS rows
    shares = fill(loads, cell_owners(n_shards, vnodes), n_shards, slack)
    goals = []  # (cell, part, bytes up to the part's end), but for each cell's last part: at most one a shard and turn
    for cell, parts in sorted(shares.items()):
        run = 0
        for k, (n, _) in enumerate(parts[:-1]):
            goals.append((cell, k, run := run + n))
    begins = {}
    if goals:
        table = F.broadcast(_packed(spark, goals, ["_cell", "_part"], "_goal"))
        sums = narrow.join(F.broadcast(_packed(spark, sorted({(g[0],) for g in goals}), ["_cell"])), "_cell", "left_semi").groupBy("_cell", "_fine").agg(F.sum("_size").alias("n"))
        running = sums.withColumn("run", F.sum("n").over(Window.partitionBy("_cell").orderBy("_fine")))  # at most 2 ** FINE_BITS rows a cell
        over = running.join(table, "_cell").where("run > _goal").groupBy("_cell", "_part").agg(F.min("_fine").alias("begin"))
        begins = {(r["_cell"], r["_part"]): r["begin"] for r in over.collect()}  # where the next part begins; a row for each goal
    last, out = (1 << FINE_BITS) - 1, []
    for cell, parts in sorted(shares.items()):
        cuts = [0, *[begins.get((cell, k), last + 1) for k in range(len(parts) - 1)], last + 1]
        out += [(cell, a, b - 1, s) for a, b, (_, s) in zip(cuts[:-1], cuts[1:], parts, strict=True) if a < b]
    return out


def assign(docs: DataFrame, key: str = "doc_id", text: str = "text", n_shards: int = SHARDS, vnodes: int = VNODES, slack: float = SLACK) -> DataFrame:
    """All columns of docs, and _size, _shard and _slot (gapless from 0 in each shard)."""
    spark, names = docs.sparkSession, docs.columns
    if clash := {"_size", "_shard", "_slot"} & set(names):
        raise ValueError(f"columns {sorted(clash)} are results")
    at = {c: f"c{i}" for i, c in enumerate(names)}
    inner = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in at.items()])
    celled = _spread(_hashed(inner, at[key], at[text]), n_shards, slack)
    arcs = ring(celled, n_shards, vnodes, slack)
    table = _arc_table(spark, arcs) if arcs else spark.createDataFrame([], "_cell int, _from int, _to int, _shard int")
    placed = celled.join(F.broadcast(table), "_cell").where(F.col("_fine").between(F.col("_from"), F.col("_to")))
    counts = placed.groupBy("_shard", "_cell").agg(F.count(F.lit(1)).alias("n")).collect()  # at most CELLS rows and the cuts
    offsets, run = [], {}
    for r in sorted(counts):
        offsets.append((r["_cell"], r["_shard"], run.get(r["_shard"], 0)))
        run[r["_shard"]] = run.get(r["_shard"], 0) + r["n"]
    begins = _packed(spark, offsets, ["_cell", "_shard"], "_before")
    order = Window.partitionBy("_cell", "_shard").orderBy("_hash", F.col(at[key]).asc_nulls_first(), "_size")
    numbered = placed.withColumn("_rank", F.row_number().over(order) - 1).join(F.broadcast(begins), ["_cell", "_shard"])
    return numbered.select(*[F.col(a).alias(c) for c, a in at.items()], "_size", "_shard", (F.col("_before") + F.col("_rank")).cast("long").alias("_slot"))


def _arc_table(spark, rows):
    values = F.from_json(F.lit("[" + ",".join(f"[{c},{a},{b},{s}]" for c, a, b, s in rows) + "]"), "array<array<int>>")
    return spark.range(1).select(F.explode(values).alias("v")).select(*[F.col("v")[i].alias(n) for i, n in enumerate(("_cell", "_from", "_to", "_shard"))])


def _packed(spark, rows, keys, value=None):
    """A small table: keys as int and value as long."""
    values = F.from_json(F.lit("[" + ",".join(str(list(r)) for r in rows) + "]"), "array<array<bigint>>")
    out = spark.range(1).select(F.explode(values).alias("v"))
    more = [] if value is None else [F.col("v")[len(keys)].alias(value)]
    return out.select(*[F.col("v")[i].cast("int").alias(n) for i, n in enumerate(keys)], *more)


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """The sharded table as Parquet, one folder a shard, rows with their slots."""
    assign(docs, **options).write.partitionBy("_shard").parquet(path)
