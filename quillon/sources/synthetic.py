"""Seeded generators, distributed over spark.range; values depend on seed and row alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.text import hash_unit

ATTACKS = {"exfiltration": (4.0, 1.0, 1.0), "scan": (0.2, 0.3, 6.0), "flood": (1.0, 0.2, 8.0), "beacon": (0.5, 3.0, 0.5)}
EFFECTS = {"null": 0.0, "heterogeneous": 1.0}


def _unit(seed: int, *parts) -> Column:
    """Uniform on (0, 1) from a hash of seed, row and name, the same in every engine that has SHA-256."""
    return (hash_unit(F.lit(str(seed)), F.col("id").cast("string"), *[F.lit(str(p)) for p in parts]) + 0.5) / F.lit(float(1 << 32))


def normal(seed: int, *parts) -> Column:
    """Standard normal by the Box-Muller transform."""
    return F.sqrt(-2 * F.log(_unit(seed, *parts, "r"))) * F.cos(2 * F.pi() * _unit(seed, *parts, "a"))


def flows(spark: SparkSession, n_normal: int, n_attack: int, seed: int) -> DataFrame:
    """flow_id, bytes_sent, duration, packets, is_anomaly, scenario: correlated log-normal flows, and four attacks that shift them."""
    total = n_normal + n_attack * len(ATTACKS)
    kind = F.when(F.col("id") < n_normal, "normal")
    for k, name in enumerate(ATTACKS):
        kind = kind.when(F.col("id") < n_normal + (k + 1) * n_attack, name)
    common, scale = normal(seed, "common"), lambda j: _case({n: v[j] for n, v in ATTACKS.items()})
    base = spark.range(total).withColumn("scenario", kind)
    return base.select(
        F.col("id").alias("flow_id"), (F.exp(6 + 0.8 * common + 0.4 * normal(seed, "b")) * scale(0)).alias("bytes_sent"), (F.exp(1 + 0.5 * common + 0.5 * normal(seed, "d")) * scale(1)).alias("duration"),
        (F.exp(3 + 0.7 * common + 0.3 * normal(seed, "p")) * scale(2)).alias("packets"), (F.col("scenario") != "normal").cast("int").alias("is_anomaly"), "scenario",
    )


def _case(values: dict[str, float]) -> Column:
    out = F.when(F.lit(False), 1.0)
    for name, v in values.items():
        out = out.when(F.col("scenario") == name, v)
    return out.otherwise(1.0)


def structural(spark: SparkSession, scenario: str, n: int, seed: int) -> DataFrame:
    """x1, x2, u, t, y, ite: treatment from a logistic model of the scenario, outcome with a known effect."""
    x1, x2, u = (normal(seed, c) for c in ("x1", "x2", "u"))
    logit = {
        "randomized": F.lit(0.0), "observed_confounding": 0.8 * F.col("x1") - 0.5 * F.col("x2"), "nonlinear": F.col("x1") * F.col("x2"), "heterogeneous": 0.8 * F.col("x1"),
        "hidden_confounding": 0.5 * F.col("x1") + 1.2 * F.col("u"), "positivity_stress": 3.0 * F.col("x1"), "null": 0.8 * F.col("x1"),
    }[scenario]
    ite = F.lit(EFFECTS.get(scenario, 2.0)) + (F.col("x1") if scenario == "heterogeneous" else F.lit(0.0))
    rows = spark.range(n).withColumns({"x1": x1, "x2": x2, "u": u})
    treated = rows.withColumns({"t": (_unit(seed, "t") < 1 / (1 + F.exp(-logit))).cast("int"), "ite": ite})
    outcome = 1 + F.col("x1") - 0.5 * F.col("x2") + (F.col("u") if scenario == "hidden_confounding" else F.lit(0.0)) + F.col("t") * F.col("ite") + normal(seed, "e")
    return treated.withColumn("y", outcome)


def fuzzy_clusters(spark: SparkSession, n: int, seed: int, epsilon: float, dimension: int = 12) -> DataFrame:
    """id, cluster (0 to 2), v: prototypes with bounded noise that sums to zero, so cardinality is constant in a cluster."""
    cluster = F.pmod("id", F.lit(3)).cast("int")
    base = spark.range(n).withColumn("cluster", cluster)
    noise = [epsilon * (_unit(seed, k) - 0.5) for k in range(dimension // 2)]
    proto = lambda k: F.when(F.col("cluster") == k % 3, 0.8).otherwise(0.3)
    cells = [proto(k) + (noise[k] if k < dimension // 2 else -noise[k - dimension // 2]) for k in range(dimension)]
    return base.select("id", "cluster", F.array(*cells).alias("v"))
