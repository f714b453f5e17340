"""Missing values, null keys, shared folders, dated tables and saved models."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import minute
from portentia import Timeline, runtime
from portentia.operators import models as M
from portentia.operators import prediction as P
from portentia.operators import sequences as S
from portentia.operators.anomaly import describe_scores
from portentia.operators.scaling import fit_scaler
from portentia.operators.states import build_states, feature_medians
from portentia.plans.pipeline import Settings, run_batch
from portentia.sources import tables
from portentia.timeline import with_row_index

NAN, INF = float("nan"), float("inf")


def test_nan_and_infinity_are_missing_everywhere(spark):
    rows = [(minute(0), "a", v) for v in (1.0, NAN, 3.0)] + [(minute(1), "a", INF), (minute(1), "a", 2.0), (minute(2), "b", -INF)]
    flows = spark.createDataFrame(rows, "ts timestamp, label string, v double")
    medians = feature_medians(flows, ["v"])
    assert medians.first()["median"] == 2.0
    tl = Timeline(60)
    filled = {r["time_window"]: r["v"] for r in build_states(flows, ["v"], tl, "label", "b", medians=medians).collect()}
    assert list(filled.values()) and filled[minute(0)] == 2.0 and filled[minute(1)] == 2.0 and filled[minute(2)] == 2.0
    bare = {r["time_window"]: r["v"] for r in build_states(flows, ["v"], tl, "label", "b").collect()}
    assert bare[minute(0)] == 2.0 and bare[minute(1)] == 2.0 and bare[minute(2)] is None
    scaler = fit_scaler(flows, ["v"], fit_rows="all").first()
    assert scaler["mean_v"] == 2.0 and scaler["std_v"] == pytest.approx(np.std([1, 3, 2]))


def test_batch_run_on_dirty_parquet(spark, tmp_path):
    rows = [(minute(i // 3), "x" if i % 11 else "bad", (NAN, INF, float(i % 7))[i % 3 if i % 4 == 0 else 2]) for i in range(240)]
    spark.createDataFrame(rows, "ts timestamp, label string, v double").write.parquet(f"{tmp_path}/flows")
    settings = Settings(features=("v",), label="label", positive="bad", ratio_threshold=0.5)
    out = run_batch(spark.read.parquet(f"{tmp_path}/flows"), f"{tmp_path}/out", settings)
    bad = out["states"].filter(F.isnan("v") | F.abs("v").isin(INF) | F.col("v").isNull())
    assert bad.count() == 0 and out["engine"].count() > 0


def test_rows_with_a_null_key_stay(spark):
    rows = [(k, minute(i), i % 2, float(i)) for k in ("a", None) for i in range(30)]
    df = spark.createDataFrame(rows, "sensor string, time_window timestamp, is_positive int, mse double")
    tl = Timeline(60, ("sensor",), block_buckets=7)
    numbered = with_row_index(df, tl).collect()
    assert len(numbered) == 60 and all(r["row_index"] == int(r["mse"]) for r in numbered)
    split = S.chronological_split(df, tl, 0.5).groupBy("sensor", "split").count().collect()
    assert sorted((str(r["sensor"]), r["split"], r["count"]) for r in split) == [
        ("None", "test", 15), ("None", "train", 15), ("a", "test", 15), ("a", "train", 15)
    ]
    assert S.attack_periods(df, tl).filter("sensor is null").count() == 15
    described = describe_scores(df, by="sensor").collect()
    assert {r["sensor"]: r["q50"] for r in described} == {"a": 14.5, None: 14.5}


def test_time_order(spark):
    tl = Timeline(60)

    def ordered(pairs):
        df = spark.createDataFrame([(minute(0) + dt.timedelta(seconds=s), i) for s, i in pairs], "time_window timestamp, id long")
        return S.is_time_ordered(df, tl, "id").first()["is_monotonic"]

    assert ordered([(0, 1), (10, 2), (70, 2), (4000, 9)])
    assert not ordered([(0, 1), (10, 3), (20, 2)])
    assert not ordered([(0, 5), (7000, 4)])


def test_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()
        conf = spark.conf

    if not spark.conf.get("spark.checkpoint.dir", None):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            runtime.shared_base(Session())
    assert runtime.shared_base(spark)


def test_dates_are_replaced_one_by_one(spark, tmp_path):
    day = [(minute(0) + dt.timedelta(days=d, minutes=m), d) for d in range(2) for m in range(5)]
    df = spark.createDataFrame(day, "time_window timestamp, d int")
    path = f"{tmp_path}/t"
    tables.write_table(df.filter("d = 0"), path)
    first = {f.name for f in (tmp_path / "t").rglob("*.parquet")}
    tables.write_table(df.filter("d = 1"), path, replace="dates")
    assert first <= {f.name for f in (tmp_path / "t").rglob("*.parquet")}
    assert tables.read_table(spark, path).count() == 10
    tables.write_table(df.filter("d = 1").limit(2), path, replace="dates")
    assert tables.read_table(spark, path).count() == 7


def test_saved_models_score_alike(spark, tmp_path):
    rows = [(minute(i), *[float((i * (k + 3)) % 11) for k in range(len(M.HORIZON_FEATURES))], float(i % 3 == 0)) for i in range(90)]
    schema = "time_window timestamp, " + ", ".join(f"{c} double" for c in M.HORIZON_FEATURES) + ", label double"
    df = spark.createDataFrame(rows, schema)
    model = M.fit_horizon(df, "logistic", max_iter=50)
    model.save(f"{tmp_path}/m")
    again = M.HorizonModel.load(spark, f"{tmp_path}/m", "logistic")
    want = {r["time_window"]: r["probability"] for r in model.predict(df).collect()}
    assert {r["time_window"]: r["probability"] for r in again.predict(df).collect()} == want
    assert M.logistic_gradient(M.fit_horizon(df, "logistic"), df) < 1e-3


def test_linear_weights_are_stored(spark, tmp_path):
    weights = np.arange(12.0).reshape(4, 3)
    tables.save_weights(spark, weights, f"{tmp_path}/w")
    assert (tables.load_weights(spark, f"{tmp_path}/w") == weights).all()
    wide = spark.createDataFrame([([0.0], [0.0])], "x array<double>, y array<double>")
    with pytest.raises(ValueError):
        P.normal_equations(wide, 5_000, 10)
