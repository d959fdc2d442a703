"""Reachability and audits of directed graphs given as edge tables."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.io import checkpointed, staged


def from_mapping(spark: SparkSession, data: Mapping[str, Any]) -> tuple[DataFrame, DataFrame]:
    """Variables (name, role, observed, time_order) and edges (src, dst) of {"variables": [...], "edges": [[src, dst], ...]}; repeated names, unknown ends, loops and cycles are refused."""
    if set(data) != {"variables", "edges"}:
        raise ValueError("a graph has variables and edges")
    rows = [(str(v["name"]), str(v.get("role", "covariate")), bool(v.get("observed", True)), int(v.get("time_order", 0))) for v in data["variables"]]
    names, pairs = {r[0] for r in rows}, [(str(a), str(b)) for a, b in data["edges"]]
    if len(names) != len(rows):
        raise ValueError("repeated variable")
    if unknown := {x for e in pairs for x in e} - names:
        raise ValueError(f"unknown variables {sorted(unknown)}")
    into, todo = {n: {a for a, b in pairs if b == n} for n in names}, names  # take away what nothing leads to, again and again
    while free := {n for n in todo if not into[n] & todo}:
        todo = todo - free
    if todo:
        raise ValueError(f"a cycle among {sorted(todo)}")
    return spark.createDataFrame(rows, "name string, role string, observed boolean, time_order int"), spark.createDataFrame(sorted(set(pairs)), "src string, dst string")


def closure(edges: DataFrame) -> DataFrame:
    """src, dst and the least number of steps, of all pairs, however far apart.

    Path lengths double: a pair at a distance of more than h and at most 2h steps has a node h steps from its start, so
    each round joins the pairs of exactly h steps with all pairs known, and the rounds grow with the logarithm of the
    longest distance. Each round's new pairs are checkpointed.
    """
    known = checkpointed(edges.select("src", "dst").distinct().withColumn("depth", F.lit(1)))
    half = 1
    while True:
        first = known.where(F.col("depth") == half).select("src", F.col("dst").alias("_via"))
        second = known.select(F.col("src").alias("_via"), "dst", "depth")
        further = first.join(second, "_via").groupBy("src", "dst").agg((F.min("depth") + half).alias("depth"))
        fresh = checkpointed(further.join(known, ["src", "dst"], "left_anti"))
        if not fresh.limit(1).count():
            return known
        known, half = known.unionByName(fresh), 2 * half


def cycles(edges: DataFrame) -> DataFrame:
    """Nodes that reach themselves."""
    return closure(edges).where("src = dst").select(F.col("src").alias("node"))


def audit(edges: DataFrame, order: DataFrame) -> DataFrame:
    """Edges against the stated time order: order has name, time_order."""
    a = order.select(F.col("name").alias("src"), F.col("time_order").alias("t_src"))
    b = order.select(F.col("name").alias("dst"), F.col("time_order").alias("t_dst"))
    return edges.join(a, "src").join(b, "dst").where("t_src > t_dst").select("src", "dst")


def components(edges: DataFrame) -> DataFrame:
    """node and label (the smallest node of its component) of the nodes on edges (a, b).

    Labels spread along edges and then jump to the label's label, so rounds grow with the logarithm of a component's width. Each round is a written table, of which the planner knows the size.
    """
    both = staged(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a != b").distinct(), "edges")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).withColumn("label", F.least("node", "label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        met = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        far = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        moved = staged(met.join(far, "label").select("node", "old", F.least("label", "far").alias("label")), "labels")
        if not moved.where("label != old").limit(1).count():
            return moved.select("node", "label")
        labels = moved.select("node", "label")


def periodic_neighbours(sites: DataFrame, cutoff: float, most: int, images: int = 1) -> DataFrame:
    """crystal, src, dst, image (i, j, k) and dist of the nearest ``most`` sites within a cutoff of each site, over the periodic images up to ``images`` cells away; ties by site and image.

    sites: crystal, site, cell (three lattice vectors) and frac (coordinates in them). A crystal is a small group; its sites meet each other only.
    """
    steps = F.sequence(F.lit(-images), F.lit(images))
    a = sites.select("crystal", F.col("site").alias("src"), "cell", F.col("frac").alias("f"))
    b = sites.select("crystal", F.col("site").alias("dst"), F.col("frac").alias("g"))
    met = a.join(b, "crystal").withColumn("i", F.explode(steps)).withColumn("j", F.explode(steps)).withColumn("k", F.explode(steps))
    move = F.array(*[F.col("g")[n] + F.col(c) - F.col("f")[n] for n, c in enumerate("ijk")])
    square = sum(((sum((F.col("m")[v] * F.col("cell")[v][n] for v in range(3)), F.lit(0.0))) * (sum((F.col("m")[v] * F.col("cell")[v][n] for v in range(3)), F.lit(0.0))) for n in range(3)), F.lit(0.0))
    near = met.withColumn("m", move).withColumn("dist", F.sqrt(square)).where((F.col("dist") <= cutoff) & ~((F.col("src") == F.col("dst")) & (F.abs("i") + F.abs("j") + F.abs("k") == 0)))
    w = Window.partitionBy("crystal", "src").orderBy(F.round("dist", 6), "dst", "i", "j", "k")
    return near.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("crystal", "src", "dst", "i", "j", "k", "dist")
