"""Timings of the headline queries: one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from tidegate.plans import catalogue

HEADLINE = ["time_split", "velocity_full", "velocity_split_keys", "velocity_orders_ties", "linkage", "target_encoding", "missingness", "cardinality", "auc_screen", "ranking_metrics", "single_sweep", "headline_policies", "swap_sets", "sensitivity_grid", "bootstrap_metric_diff", "feature_psi", "score_stability", "build_features"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        times = []
        for _ in range(1 + int(os.environ.get("BENCH_RUNS", "3"))):  # the first warms up
            began = time.perf_counter()
            catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(statistics.median(times[1:]), 3)
    out = {"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}
    if os.environ.get("BENCH_SQL"):  # the same queries in an in-process engine, for comparison
        out["sql"] = sql_times(sf_dir, cpus)
    print(json.dumps(out))


def sql_times(sf_dir: str, cpus: str) -> dict[str, float]:
    import duckdb

    con = duckdb.connect(config={"threads": int(cpus)})
    for name in os.listdir(sf_dir):
        if name.endswith(".parquet"):
            con.execute(f"create view {name[:-8]} as select * from '{sf_dir}/{name}'")
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        con.execute(catalogue.ORACLES[name]).fetchall()
        took[name] = round(time.perf_counter() - began, 3)
    return took


if __name__ == "__main__":
    main()
