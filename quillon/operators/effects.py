"""Effect estimators behind one function, and adjustment sets of small graphs."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import causal

MAX_CANDIDATES = 15
METHODS = ("difference_in_means", "g_computation", "ipw", "aipw")


def estimate(df: DataFrame, method: str, covariates: list[str]) -> tuple[str, float | None, float | None, str]:
    """(method, effect, standard error, status); df has t, y, p, m0, m1. Blocked where an arm is empty or overlap fails."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    n0, n1, overlap = df.agg(F.count_if(F.col("t") == 0), F.count_if(F.col("t") == 1), F.avg(F.col("p").between(0.01, 0.99).cast("double"))).first()
    if not n0 or not n1:
        return method, None, None, "blocked: an arm is empty"
    if method in ("ipw", "aipw") and overlap < 0.9:
        return method, None, None, "blocked: no overlap"
    if method == "difference_in_means":
        r = causal.difference(df).first()
        return method, round(r["effect"], 6), round(r["se"], 6), "ok"
    if method == "g_computation":
        beta, se = causal.least_squares(df, ["t", *covariates], "y")
        return method, round(float(beta[1]), 6), round(float(se[1]), 6), "ok"
    if method == "ipw":
        return method, round(causal.weighting(df).first()["ate"], 6), None, "ok"
    r = causal.doubly_robust(df).first()
    return method, round(r["aipw"], 6), round(r["se"], 6), "ok"


def _separated(edges: list[tuple[str, str]], a: str, b: str, given: set[str]) -> bool:
    """d-separation: no path from a to b is open given a set (Bayes-ball over edges, with its direction of travel)."""
    parents, children = {}, {}
    for s, d in edges:
        parents.setdefault(d, set()).add(s)
        children.setdefault(s, set()).add(d)
    above, todo = set(), list(given)  # ancestors of the given, themselves included
    while todo:
        v = todo.pop()
        if v not in above:
            above.add(v)
            todo += parents.get(v, ())
    seen, todo = set(), [(a, "up")]
    while todo:
        v, way = todo.pop()
        if (v, way) in seen:
            continue
        seen.add((v, way))
        if v == b:
            return False
        if way == "up" and v not in given:
            todo += [(p, "up") for p in parents.get(v, ())] + [(c, "down") for c in children.get(v, ())]
        elif way == "down":
            if v not in given:
                todo += [(c, "down") for c in children.get(v, ())]
            if v in above:
                todo += [(p, "up") for p in parents.get(v, ())]
    return True


def adjustment_sets(edges: list[tuple[str, str]], treatment: str, outcome: str, observed: list[str]) -> list[tuple[str, ...]]:
    """Minimal sets of observed variables, none after the treatment, that close all back doors. All subsets are tried, so more than MAX_CANDIDATES usable variables are refused."""
    below, todo = set(), [treatment]
    while todo:
        v = todo.pop()
        for s, d in edges:
            if s == v and d not in below:
                below.add(d)
                todo.append(d)
    back, usable, found = [e for e in edges if e[0] != treatment], sorted(v for v in observed if v not in below and v not in (treatment, outcome)), []
    if len(usable) > MAX_CANDIDATES:
        raise ValueError(f"more than {MAX_CANDIDATES} candidates for adjustment")
    for size in range(len(usable) + 1):
        for chosen in combinations(usable, size):
            if not any(set(f) <= set(chosen) for f in found) and _separated(back, treatment, outcome, set(chosen)):
                found.append(chosen)
    return found
