"""Workflows: named lists of queries, run one after the other and written as Parquet with a manifest. As a program: python -m quillon.workflows NAME --data FOLDER --out FOLDER."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.plans import QUERIES

WORKFLOWS = {
    "series": ["ts_validation", "ts_hourly", "ts_lag_features", "ts_baselines_holdout", "ts_expanding_folds", "ts_recommend", "anomaly_labels", "anomaly_episodes", "ts_pacf", "ts_unit_root"],
    "retrieval": ["bm25_topk", "rrf_hybrid", "retrieval_metrics", "citation_metrics", "policy_sweep", "verify_claims"],
    "causal": ["causal_diff", "causal_ipw", "causal_aipw", "smd", "cross_fitted_dr", "refutation_suite", "sensitivity"],
    "interactions": ["pair_features", "string_descriptors", "cold_group_oof", "threshold_rerun", "label_summary", "split_audit"],
    "similarity": ["fuzzy_validation", "fuzzy_pairs", "fuzzy_knn", "similarity_gap", "nearest_pairs"],
}


def plan(workflow: str) -> list[str]:
    """The queries of a workflow, in order (a dry run)."""
    if workflow not in WORKFLOWS:
        raise ValueError(f"unknown workflow {workflow}; there are {sorted(WORKFLOWS)}")
    if missing := [q for q in WORKFLOWS[workflow] if q not in QUERIES]:
        raise ValueError(f"unknown queries {missing}")
    return WORKFLOWS[workflow]


def run(spark: SparkSession, workflow: str, sf_dir: str, out: str) -> DataFrame:
    """Runs a workflow; a query that fails ends it and leaves the tables before it. The manifest (query, rows, columns) is returned, and written last: a folder without one is not whole."""
    found = []
    for name in plan(workflow):
        QUERIES[name](spark, sf_dir).write.mode("overwrite").parquet(f"{out}/{name}")
        written = spark.read.parquet(f"{out}/{name}")
        found.append((name, written.count(), json.dumps(written.dtypes)))
    manifest = spark.createDataFrame(found, "query string, rows long, columns string").coalesce(1)
    manifest.write.mode("overwrite").json(f"{out}/manifest")
    return manifest.orderBy(F.col("query"))


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quillon.workflows")
    parser.add_argument("workflow", choices=sorted(WORKFLOWS))
    parser.add_argument("--data", required=True)
    parser.add_argument("--out", required=True)
    parser.add_argument("--dry-run", action="store_true")
    args = parser.parse_args(argv)
    if args.dry_run:
        print("\n".join(plan(args.workflow)))
        return 0
    run(SparkSession.builder.appName(f"workflow {args.workflow}").getOrCreate(), args.workflow, args.data, args.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
