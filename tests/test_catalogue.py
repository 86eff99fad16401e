"""Registered queries against their SQL on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from tidegate.plans import catalogue, decision

SF = "/root/testdata/sf0.001"
SOME = ["time_split", "velocity_split_keys", "linkage", "linkage_split_keys", "card_key_uid", "keys_of_fractions", "synthetic_source", "tree_scores", "build_features", "threshold_grid", "swap_sets", "target_encoding", "cardinality", "auc_screen", "ranking_metrics", "single_sweep", "headline_policies", "sensitivity_grid", "bootstrap_metric_diff", "feature_psi", "score_stability"]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def plain(v):
    if pd.isna(v):
        return None
    return v if isinstance(v, (str, bool)) else round(float(v), 4)


@pytest.mark.parametrize("name", SOME)
def test_query(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    want = con.execute(catalogue.ORACLES[name]).df()[list(got.columns)]
    rows = lambda d: sorted(([plain(v) for v in r] for r in d.astype(object).values.tolist()), key=str)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for u, v in zip(x, y):
            assert u == v or (u is not None and v is not None and u == pytest.approx(v, abs=2e-4, rel=1e-6))


def test_rules_flag_first_rows_only(spark, monkeypatch):
    rows = [(i, i * 86_400, 500.0 if i >= 90 else 1.0 + i / 100, int(i % 9 == 0), str(i) if i == 95 else "one", i / 100, i / 200) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, dt long, amount double, y int, uid string, score double, score_b double")
    monkeypatch.setattr(decision.views, "txn", lambda spark, d: df)
    assert [r.id for r in decision.decided(spark, "").test.where("rules").collect()] == [95]


def test_every_query_has_sql_or_a_reason():
    assert set(catalogue.QUERIES) - set(catalogue.ORACLES) == {"gbt_scores"}
