"""Evaluation metrics as aggregates. Rankings go through counts by score, and running sums are taken bucket by bucket, so no task sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1000


def ratio(a: Column, b: Column, zero: float | None = 0.0) -> Column:
    out = F.try_divide(a.cast("double"), b.cast("double"))
    return out if zero is None else F.coalesce(out, F.lit(zero))


def confusion(truth: Column, predicted: Column) -> dict[str, Column]:
    t, p = truth.cast("boolean"), predicted.cast("boolean")
    return {"tp": F.count_if(t & p), "fp": F.count_if(~t & p), "fn": F.count_if(t & ~p), "tn": F.count_if(~t & ~p)}


def rates(zero: float | None = 0.0) -> dict[str, Column]:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return {
        "precision": ratio(tp, tp + fp, zero), "recall": ratio(tp, tp + fn, zero), "f1": ratio(2 * tp, 2 * tp + fp + fn, zero),
        "accuracy": ratio(tp + tn, tp + tn + fp + fn, zero), "fpr": ratio(fp, fp + tn, zero), "fnr": ratio(fn, fn + tp, zero),
    }


def confusion_by(df: DataFrame, keys: list[str], truth: Column, predicted: Column, zero: float | None = 0.0) -> DataFrame:
    return df.groupBy(*keys).agg(*[c.alias(k) for k, c in confusion(truth, predicted).items()]).withColumns(rates(zero))


def by_score(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """score, pos, neg: how many rows of each class have each score."""
    return df.groupBy(score).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))


def running(df: DataFrame, order: str, sums: list[str], buckets: int = BUCKETS, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """Adds run_<c>: the sum of c over rows of a greater value of ``order``, own row included.

    Rows fall into buckets of equal width; sums of whole buckets are one small table, and only within a bucket does a window sort rows.
    """
    at = F.greatest(F.lit(0), F.least(F.lit(buckets - 1), F.floor((F.col(order) - lo) / (hi - lo) * buckets))).cast("int")
    parts = df.withColumn("_bucket", at)
    totals = parts.groupBy("_bucket").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    above = Window.orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_bucket", *[F.coalesce(F.sum(f"_t_{c}").over(above), F.lit(0)).alias(f"_b_{c}") for c in sums])  # at most ``buckets`` rows
    inside = Window.partitionBy("_bucket").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    out = parts.join(F.broadcast(before), "_bucket").withColumns({f"run_{c}": F.sum(c).over(inside) + F.col(f"_b_{c}") for c in sums})
    return out.drop("_bucket", *[f"_b_{c}" for c in sums])


def roc_auc(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Rank-sum AUC with average ranks for ties; null if a class is missing."""
    r = running(by_score(scored, score, label), score, ["pos", "neg"])
    wins = F.sum(F.col("neg") * (F.col("run_pos") - F.col("pos")) + F.col("neg") * F.col("pos") * 0.5)
    return r.agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), wins.alias("w")).select("n_pos", "n_neg", F.try_divide("w", F.col("n_pos").cast("double") * F.col("n_neg")).alias("roc_auc"))


def pr_points(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Precision, recall and F1 at each distinct score used as a threshold."""
    counts = by_score(scored, score, label)
    total = counts.agg(F.sum("pos").alias("_all"))
    r = running(counts, score, ["pos", "neg"]).crossJoin(F.broadcast(total))  # one row
    p = ratio(F.col("run_pos"), F.col("run_pos") + F.col("run_neg"))
    return r.withColumns({"precision": p, "recall": ratio(F.col("run_pos"), F.col("_all")), "step": ratio(F.col("pos"), F.col("_all"))}).withColumn("f1", ratio(2 * F.col("run_pos"), F.col("run_pos") + F.col("run_neg") + F.col("_all")))


def average_precision(points: DataFrame) -> DataFrame:
    return points.agg(F.sum(F.col("step") * F.col("precision")).alias("average_precision"))


def best_f1(points: DataFrame, score: str = "score") -> DataFrame:
    """The threshold of greatest F1; the highest among equals."""
    best = F.max_by(F.struct(score, "precision", "recall", "f1"), F.struct("f1", score)).alias("best")
    return points.agg(best).select(F.col(f"best.{score}").alias("threshold"), "best.precision", "best.recall", "best.f1")


def _bucketed(df: DataFrame, value: str, keys: list[str], buckets: int) -> tuple[DataFrame, DataFrame]:
    """Distinct values of each group with their counts (_c), bucket, and the group's n; and how many rows lie before each bucket. No task sees more of a group than a bucket's distinct values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    ends = counts.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.sum("_c").alias("n"))
    both = counts.join(ends, keys) if keys else counts.crossJoin(F.broadcast(ends))  # one row
    at = F.coalesce(F.try_divide((F.col(value) - F.col("_lo")).cast("double"), (F.col("_hi") - F.col("_lo")).cast("double")), F.lit(0.0))
    placed = both.withColumn("_bucket", F.least(F.lit(buckets - 1), F.floor(at * buckets)).cast("int")).drop("_lo", "_hi")
    up_to = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = placed.groupBy(*keys, "_bucket", "n").agg(F.sum("_c").alias("_in"))  # at most ``buckets`` rows a group
    return placed, sums.withColumn("_before", F.sum("_in").over(up_to) - F.col("_in"))


def average_ranks(df: DataFrame, value: str, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Adds the mean rank of equal values, from 1, in each group."""
    placed, sums = _bucketed(df, value, keys, buckets)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = placed.join(sums.drop("n", "_in"), [*keys, "_bucket"]).withColumn(f"rank_{value}", F.col("_before") + F.sum("_c").over(inside) - (F.col("_c") - 1) / 2)
    return df.join(ranked.select(*keys, value, f"rank_{value}"), [*keys, value])


def order_statistic(df: DataFrame, value: str, keys: list[str], rank: Column, buckets: int = BUCKETS) -> DataFrame:
    """keys, n and value: of each group's n values the one of that rank (from 1, a column over n); null where there are fewer."""
    placed, sums = _bucketed(df, value, keys, buckets)
    target = sums.withColumn("_rank", rank).where((F.col("_before") < F.col("_rank")) & (F.col("_before") + F.col("_in") >= F.col("_rank")))
    few = placed.drop("n").join(target.select(*keys, "_bucket", "_before", "_rank"), [*keys, "_bucket"])
    inside = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    found = few.withColumn("_run", F.col("_before") + F.sum("_c").over(inside)).where(F.col("_run") >= F.col("_rank")).groupBy(*keys).agg(F.min(value).alias(value))
    groups = sums.select(*keys, "n").distinct()
    return groups.join(found, keys, "left") if keys else groups.crossJoin(found)  # one row each


def quantile(df: DataFrame, value: str, keys: list[str], q: float, name: str = "quantile") -> DataFrame:
    """keys and the quantile, linear between the two values next to it; exact."""
    place = F.lit(float(q)) * (F.col("n") - 1)
    low = order_statistic(df, value, keys, F.floor(place) + 1).withColumnRenamed(value, "_low")
    high = order_statistic(df, value, keys, F.ceil(place) + 1).drop("n").withColumnRenamed(value, "_high")
    both = low.join(high, keys) if keys else low.crossJoin(high)  # one row each
    part = place - F.floor(place)
    return both.select(*keys, (F.col("_low") * (1 - part) + F.col("_high") * part).alias(name))


def spearman(df: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """Rank correlation of each group; null below three rows or if a side is constant."""
    df = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    ranked = average_ranks(average_ranks(df, a, keys), b, keys)
    rho = F.when((F.count(F.lit(1)) >= 3) & (F.min(a) != F.max(a)) & (F.min(b) != F.max(b)), F.corr(f"rank_{a}", f"rank_{b}"))
    return ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), rho.alias("spearman"))


def probability_bins(df: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """Equal bins of [0, 1], the last one closed; empty bins stay, with null rates."""
    at = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    found = df.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("rate"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(F.broadcast(found), "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def class_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support of each class."""
    cells = df.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))
    sides = cells.select(F.col(truth).alias("label"), F.col("n").alias("support"), F.lit(0).alias("called"), F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0).alias("hit")).unionAll(
        cells.select(F.col(predicted), F.lit(0), F.col("n"), F.lit(0))
    )
    s = sides.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("support", "called", "hit")])
    return s.withColumns({"precision": ratio(F.col("hit"), F.col("called")), "recall": ratio(F.col("hit"), F.col("support")), "f1": ratio(2 * F.col("hit"), F.col("called") + F.col("support"))})


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labelings, from one grouping-sets aggregation."""
    cells = df.groupingSets([[F.col(a), F.col(b)], [F.col(a)], [F.col(b)], []], a, b).agg(F.grouping_id().alias("g"), F.count(F.lit(1)).cast("double").alias("n"))
    two = F.col("n") * (F.col("n") - 1) / 2
    s = cells.groupBy().agg(*[F.sum(F.when(F.col("g") == g, two)).alias(name) for g, name in ((0, "both"), (1, "rows"), (2, "cols"), (3, "all"))])
    expected, most = F.try_divide(F.col("rows") * F.col("cols"), F.col("all")), (F.col("rows") + F.col("cols")) / 2
    return s.select(F.coalesce(F.try_divide(F.col("both") - expected, most - expected), F.lit(1.0)).alias("adjusted_rand"))
