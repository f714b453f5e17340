"""Registered queries against their SQL statements on DuckDB. PORTENTIA_FULL=1 runs all of them."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = os.environ.get("PORTENTIA_SF_DIR", "/root/testdata/sf0.01")
TABLES = ("events", "lineitem", "embeddings")
SAMPLE = [
    "clean_flows", "network_states", "impute_normal_median", "missing_check", "flows_per_hour",
    "contiguous_states", "label_sequences", "scaler_params", "forecast_targets", "attack_periods",
    "prediction_errors", "top_feature_errors", "score_describe", "anomaly_features",
    "forecast_engine", "live_forecast", "attack_stage", "signal_eval", "early_warning",
    "combined_warning", "rollout", "rollout_eval", "roc_auc", "stream_late_drop", "stream_forecast",
    "rollout_linear", "rollout_fitted", "stratified_split_exact", "stream_slow_sensor", "stream_idle_flush",
    "stream_attack_periods", "stream_versions",
]
NAMES = sorted(entry.oracle_sql()) if os.environ.get("PORTENTIA_FULL") else SAMPLE


def cell(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, (bool, str)):
        return str(v)
    if isinstance(v, pd.Timestamp):
        return v.isoformat()
    return f"{float(v):.6f}"


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(cell(v) for v in row) for row in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_every_statement_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "forecast_state" in df.columns


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, SF).toPandas()
    want = duck.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)
