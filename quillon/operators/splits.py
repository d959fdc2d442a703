"""Splits and resampling by hashes: the same rows on any cluster, in any order of execution."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import hash_unit
from quillon.io import staged


def hash_sample(df: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    return df.orderBy(F.sha2(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")), 256), key).limit(n)


def by_hash(df: DataFrame, key: str, seed: str, train_tenths: int = 8) -> DataFrame:
    """Adds part: train or test, decided by the key alone; no shuffle."""
    return df.withColumn("part", F.when(hash_unit(F.lit(seed), F.col(key).cast("string")) % 10 < train_tenths, "train").otherwise("test"))


def stratified(df: DataFrame, stratum: str, key: str, seed: str, share: float) -> DataFrame:
    """Adds is_test: the first share of each stratum in hash order."""
    order = F.sha2(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")), 256)
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n"))
    placed = df.withColumn("_k", F.row_number().over(Window.partitionBy(stratum).orderBy(order, key)))
    return placed.join(sizes, stratum).withColumn("is_test", F.col("_k") <= F.ceil(F.lit(share) * F.col("_n"))).drop("_k", "_n")


def audit(split: DataFrame, whole: DataFrame, entity: str, other: str) -> DataFrame:
    """Sizes of the parts, entities and other values that both have, and whether the parts cover the whole."""
    train, test = split.where("part = 'train'"), split.where("part = 'test'")
    shared = lambda c, name: train.select(c).intersect(test.select(c)).agg(F.count(F.lit(1)).alias(name))
    sizes = split.agg(F.count_if(F.col("part") == "train").alias("n_train"), F.count_if(F.col("part") == "test").alias("n_test"))
    n = whole.agg(F.count(F.lit(1)).alias("_n"))
    out = sizes.crossJoin(shared(entity, "n_shared_customers")).crossJoin(shared(other, "n_shared_priorities")).crossJoin(n)  # one row each
    return out.select("n_train", "n_test", "n_shared_customers", "n_shared_priorities", (F.col("n_train") + F.col("n_test") == F.col("_n")).alias("covers"))


def paired(events: DataFrame) -> DataFrame:
    """i (from 0, by user) and d: each user's mean value of clicks less that of views."""
    arm = lambda a: F.avg(F.when(F.col("event_type") == a, F.col("value")))
    arms = events.groupBy("user_id").agg(arm("view").alias("a"), arm("click").alias("b")).where("a is not null and b is not null")
    return numbered(arms, "user_id").select(F.col("_i").alias("i"), (F.col("b") - F.col("a")).alias("d"))


def numbered(df: DataFrame, key: str) -> DataFrame:
    """Adds _i, from 0 in the order of a unique key: ranges of the key are numbered apart, then moved by the sizes of those before."""
    parts = staged(df.repartitionByRange(key).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).drop("_n")  # a row for each range
    local = F.row_number().over(Window.partitionBy("_part").orderBy(key))
    return parts.join(F.broadcast(before), "_part").withColumn("_i", (F.col("_before") + local - 1).cast("long")).drop("_part", "_before")


def bootstrap(pairs: DataFrame, replicates: int, seed: str) -> DataFrame:
    """n, the mean difference, and its 95 % percentile interval over hashed draws with replacement."""
    spark, whole = pairs.sparkSession, pairs.agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("delta"))
    n = max(pairs.count(), 1)
    slots = spark.range(replicates * n).select(F.floor(F.col("id") / n).alias("rep"), (F.col("id") % n).alias("k"))
    draws = slots.select("rep", (hash_unit(F.lit(seed), F.col("rep").cast("string"), F.col("k").cast("string")) % n).alias("i"))
    means = draws.join(pairs, "i").groupBy("rep").agg(F.avg("d").alias("m"))
    ends = means.agg(F.percentile("m", F.lit(0.025)).alias("lower"), F.percentile("m", F.lit(0.975)).alias("upper"))  # a row for each replicate
    return whole.crossJoin(ends)  # one row each


def sign_flip(pairs: DataFrame, replicates: int, seed: str) -> DataFrame:
    observed = pairs.agg(F.avg("d").alias("o"))
    sign = F.when(hash_unit(F.lit(seed), F.col("rep").cast("string"), F.col("i").cast("string")) % 2 == 0, F.col("d")).otherwise(-F.col("d"))
    means = pairs.select("i", "d", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep")).groupBy("rep").agg(F.avg(sign).alias("m"))
    extreme = F.count_if(F.abs("m") >= F.abs("o") - 1e-9)
    return means.crossJoin(F.broadcast(observed)).agg(extreme.alias("n_extreme"), ((extreme + 1) / (replicates + 1)).alias("p_value"))  # one row
