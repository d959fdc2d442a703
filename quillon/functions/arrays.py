"""Column builders over arrays of doubles: fuzzy-set and vector similarities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(v: Column) -> Column:
    """Sigma count: the sum of an array, 0 for an empty one."""
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def paired(u: Column, v: Column, f) -> Column:
    return total(F.zip_with(u, v, f))


def safe_ratio(a: Column, b: Column, otherwise: float | None = 0.0) -> Column:
    """a / b, and ``otherwise`` where b is 0."""
    ratio = F.try_divide(a, b)
    return ratio if otherwise is None else F.coalesce(ratio, F.lit(otherwise))


def cardinalities(u: Column, v: Column) -> dict[str, Column]:
    """alpha: sum of min(u, v) complements per side, as fuzzy contingency counts of two memberships."""
    return {
        "delta": paired(u, v, lambda a, b: F.least(a, b)),
        "beta": paired(u, v, lambda a, b: F.greatest(a - b, F.lit(0.0))),
        "gamma": paired(u, v, lambda a, b: F.greatest(b - a, F.lit(0.0))),
        "alpha": paired(u, v, lambda a, b: F.lit(1.0) - F.greatest(a, b)),
    }


def jaccard(u: Column, v: Column, zero: float = 1.0) -> Column:
    return safe_ratio(paired(u, v, lambda a, b: F.least(a, b)), paired(u, v, lambda a, b: F.greatest(a, b)), zero)


def dice(u: Column, v: Column, zero: float = 0.0) -> Column:
    return safe_ratio(2 * paired(u, v, lambda a, b: F.least(a, b)), total(u) + total(v), zero)


def dot(u: Column, v: Column) -> Column:
    return paired(u, v, lambda a, b: a * b)


def cosine(u: Column, v: Column, zero: float = 0.0) -> Column:
    return safe_ratio(dot(u, v), F.sqrt(dot(u, u)) * F.sqrt(dot(v, v)), zero)


def balance(u: Column, v: Column) -> Column:
    return F.lit(1.0) - F.abs(total(u) - total(v)) / F.size(u)


def rational_similarity(u: Column, v: Column, top: dict[str, float], bottom: dict[str, float]) -> Column:
    """A quotient of two quadratic forms in the fuzzy contingency counts; 0/0 is 1 for equal sets, else 0."""
    c = cardinalities(u, v)

    def form(w):
        quad = w.get("ad2", 0.0) * c["delta"] * c["delta"] + w.get("ab", 0.0) * c["alpha"] * c["beta"]
        return quad + c["delta"] * (w.get("a", 0.0) * c["alpha"] + w.get("b", 0.0) * c["beta"] + w.get("g", 0.0) * c["gamma"])

    below = form(bottom)
    return F.when(below == 0, (u == v).cast("double")).otherwise(F.try_divide(form(top), below))


def is_fuzzy(v: Column) -> Column:
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & x.between(0, 1)), F.lit(False))
