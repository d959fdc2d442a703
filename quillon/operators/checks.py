"""Contracts on tables: required columns, unique keys, references, full grids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require(df: DataFrame, columns: list[str] | None = None, keys: list[str] | None = None, checks: dict[str, str] | None = None) -> DataFrame:
    """The table itself, or ValueError: columns are there in this order, keys are unique and not null, each named condition holds for all rows. One aggregation for conditions and one for keys."""
    if columns is not None and df.columns != list(columns):
        raise ValueError(f"columns are {df.columns}, not {list(columns)}")
    if checks:
        bad = df.agg(*[F.count_if(~F.coalesce(F.expr(c), F.lit(False))).alias(n) for n, c in checks.items()]).first().asDict()
        if failed := {n: k for n, k in bad.items() if k}:
            raise ValueError(f"rows that break a condition: {failed}")
    if keys:
        null = F.lit(False)
        for k in keys:
            null = null | F.col(k).isNull()
        if df.where(null).limit(1).count():
            raise ValueError(f"null in key {keys}")
        if df.groupBy(*keys).count().where("count > 1").limit(1).count():
            raise ValueError(f"repeated key {keys}")
    return df


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", check: str = "many_to_one") -> DataFrame:
    """An equi-join with its cardinality checked: right keys unique (and left ones, for one_to_one), no left row without a partner."""
    require(right, keys=keys)
    if check == "one_to_one":
        require(left, keys=keys)
    if left.join(right, keys, "left_anti").limit(1).count():
        raise ValueError(f"rows without a partner on {keys}")
    return left.join(right, keys, how)


def dangling(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    return child.join(parent.select(key), key, "left_anti")


def alignment(left: DataFrame, right: DataFrame, key: str, name: str) -> DataFrame:
    """How many left rows match, how many right rows are extra, how many left rows miss; one pass over both key sets."""
    a = left.groupBy(key).agg(F.count(F.lit(1)).alias("a"))
    b = right.groupBy(key).agg(F.count(F.lit(1)).alias("b"))
    both = a.join(b, key, "full_outer")
    c = lambda x: F.coalesce(F.sum(x), F.lit(0))
    return both.agg(c(F.when(F.col("b").isNotNull(), F.col("a"))).alias("n_matched"), c(F.when(F.col("a").isNull(), F.col("b"))).alias("n_extra"), c(F.when(F.col("b").isNull(), F.col("a"))).alias("n_missing")).select(F.lit(name).alias("source"), "n_matched", "n_extra", "n_missing")
