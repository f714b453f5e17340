"""Keyed state on the stream: watermarks and timers of single keys, scores from kept vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import minute
from portentia import Timeline
from portentia.operators import prediction as P
from portentia.operators import rollout as O
from portentia.operators import sequences as S
from portentia.operators.prediction import score_states
from portentia.operators.risk import live_forecast
from portentia.operators.scaling import fit_scaler, scale_states, scaler_table
from portentia.operators.sequences import attack_periods, exact_stratified_split
from portentia.operators.states import build_states
from portentia.streaming import keyed, live, versions

TL = Timeline(60, ("site",))
SCHEMA = "site string, ts timestamp, label string, v double"


def flow(site, second, label="ok", v=1.0):
    return (site, minute(0) + (minute(1) - minute(0)) * (second / 60), label, v)


def run_states(spark, base, rows, tl=TL, **options):
    spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(f"{base}/in")
    stream = live.stream_table(spark, f"{base}/in", spark.createDataFrame([], SCHEMA).schema)
    states = keyed.keyed_states(stream, ["v"], tl, "label", "bad", **options)
    keyed.run_keyed(states, f"{base}/out", f"{base}/cp", timers=True)
    got = spark.read.schema(states.schema).parquet(f"{base}/out").collect()
    return sorted(((r["site"] if "site" in r else "", r["time_window"].minute, r["flow_count"], r["v"], r["label_ratio"]) for r in got), key=str)


def test_buckets_close_by_their_own_key(spark, tmp_path):
    """A slow key, and the null key, lose nothing to a fast one; late rows of a closed bucket are dropped."""
    base = str(tmp_path)
    first = run_states(spark, base, [flow("fast", 10), flow("fast", 50, "bad", 3.0), flow("fast", 500), flow("slow", 5), flow(None, 7)])
    assert first == [("fast", 0, 2, 2.0, 0.5)]
    second = run_states(spark, base, [flow("fast", 20, v=9.0), flow("slow", 30, v=5.0), flow("slow", 61), flow(None, 70, v=None)])
    assert second == sorted([*first, ("slow", 0, 2, 3.0, 0.0), (None, 0, 1, 1.0, 0.0)], key=str)
    third = run_states(spark, base, [flow(None, 90, v=float("nan")), flow(None, 130)])
    assert set(third) - set(second) == {(None, 1, 2, None, 0.0)}


def test_delay_and_timeline_without_keys(spark, tmp_path):
    """With a delay a bucket stays open for late rows; without keys all flows are one series."""
    base = str(tmp_path)
    tl = Timeline(60)
    assert run_states(spark, base, [flow("a", 10), flow("b", 70)], tl, delay_seconds=30) == []
    assert run_states(spark, base, [flow("b", 20, v=3.0), flow("a", 95)], tl, delay_seconds=30) == [("", 0, 2, 2.0, 0.0)]


def test_silent_keys_give_up_their_buckets(spark, tmp_path):
    """By a timer, once; what comes later for the bucket is late, and the key goes on with the next one."""
    base = str(tmp_path)
    options = {"idle_seconds": 0.001, "medians": {"v": 4.0}}
    assert run_states(spark, base, [flow("a", 10, v=None), flow("b", 10)], **options) == []
    second = run_states(spark, base, [flow("b", 20)], **options)
    assert second == [("a", 0, 1, 4.0, 0.0)]
    third = run_states(spark, base, [flow("a", 40), flow("a", 65), flow("b", 50)], **options)
    assert third == second
    fourth = run_states(spark, base, [flow("c", 1)], **options)
    assert set(fourth) - set(second) == {("a", 1, 1, 1.0, 0.0), ("b", 0, 3, 1.0, 0.0)}


def series(n=90):
    rng = np.random.default_rng(4)
    rows = []
    for site in ("a", "b", None):
        for k in range(n):
            if not (site == "b" and k in (30, 31, 60)):
                rows += [flow(site, 60 * k + 5, "bad" if 40 < k < 44 else "ok", float(x)) for x in rng.normal(3 + k % 5, 1, 1 + k % 2)]
                if k % 17 == 3:
                    rows[-1] = flow(site, 60 * k + 6, "ok", None)
    return rows


@pytest.mark.parametrize("linear", [False, True])
def test_scores_equal_batch_across_gaps_and_restarts(spark, tmp_path, linear):
    rows = [(*r[:3], 2.0 if linear and r[3] is None else r[3]) for r in series()]
    flows = spark.createDataFrame(rows, SCHEMA)
    states = build_states(flows, ["v"], TL, "label", "bad").cache()
    features = ["v", "flow_count"]
    scaler = fit_scaler(states, features, TL)
    if linear:
        weights = P.fit_next_state(states, TL, features, scaler)
        batch, predictor = P.score_linear(states, TL, features, scaler, weights), P.linear_predictor(weights)
    else:
        batch, predictor = score_states(states, TL, features, scaler), keyed.window_mean
    table = {r["feature"]: (r["mean"], r["std"]) for r in scaler_table(scaler, features).collect()}
    base = str(tmp_path)
    for part in range(3):
        flows.filter(F.floor(F.minute("ts") / 30 + F.hour("ts") * 2) == part).write.mode("append").parquet(f"{base}/in")
        stream = live.stream_table(spark, f"{base}/in", flows.schema)
        scored = keyed.keyed_scores(live.stream_states(stream, ["v"], TL, "label", "bad"), features, TL, table, predictor)
        keyed.run_keyed(keyed.keyed_forecast(scored), f"{base}/out", f"{base}/cp")
    got = {(r["site"], r["time_window"]): r for r in spark.read.parquet(f"{base}/out").collect()}
    last = max(t for _, t in got)
    want = {(r["site"], r["time_window"]): r for r in live_forecast(batch.filter("mse IS NOT NULL AND NOT isnan(mse)"), TL).collect()}
    want = {k: r for k, r in want.items() if k[1] <= last}
    assert set(got) == set(want) and len({k for k, _ in want}) == 3
    for k, r in want.items():
        for c in ("mse", "mae", "baseline"):
            assert got[k][c] == pytest.approx(r[c], abs=1e-9)
        assert [got[k][c] for c in (*keyed.COUNTS, "current_level", "state_10")] == [r[c] for c in (*keyed.COUNTS, "current_level", "state_10")]


def test_settings_of_the_session_come_back(spark):
    before = {k: spark.conf.get(k, None) for k in (keyed._PROVIDER, keyed._IDLE_BATCHES)}
    with keyed.keyed_state(spark, timers=True):
        assert "RocksDB" in spark.conf.get(keyed._PROVIDER)
    assert before == {k: spark.conf.get(k, None) for k in before}


def test_attack_periods_on_the_stream(spark, tmp_path):
    flows = spark.createDataFrame(series(), SCHEMA)
    states = build_states(flows, ["v"], TL, "label", "bad")
    flows.write.parquet(f"{tmp_path}/in")
    stream = live.stream_table(spark, f"{tmp_path}/in", flows.schema)
    periods = live.stream_attack_periods(stream, TL, "label", "bad")
    live.run_available(periods, f"{tmp_path}/out", f"{tmp_path}/cp")
    names = ["site", "start", "end", "duration"]
    got = spark.read.parquet(f"{tmp_path}/out").select(names).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, attack_periods(states, TL).select(names).collect()), key=str) and got


@pytest.mark.parametrize("fraction", [0.0, 0.5, 0.8, 1.0])
def test_exact_split_of_every_class(spark, fraction):
    """Also of small, null and single-row classes and of repeated ids."""
    rows = [(k % 90, label) for label, n in (("x", 1000), ("y", 7), ("z", 1), (None, 33)) for k in range(n)]
    df = spark.createDataFrame(rows, "i long, label string").repartition(4)
    split = exact_stratified_split(df, "label", ["i"], fraction)
    assert split.columns == ["i", "label", "split"]
    got = {(r["label"], r["split"]): r["count"] for r in split.groupBy("label", "split").count().collect()}
    for label, n in (("x", 1000), ("y", 7), ("z", 1), (None, 33)):
        assert got.get((label, "train"), 0) == int(fraction * n) and got.get((label, "test"), 0) == n - int(fraction * n)


def test_rollout_of_fitted_weights_is_the_recursion(spark):
    states = build_states(spark.createDataFrame(series(), SCHEMA), ["v"], TL, "label", "bad").fillna(2.0, ["v"])
    features = ["v", "flow_count"]
    scaler = fit_scaler(states, features, TL)
    weights = P.fit_next_state(states, TL, features, scaler, length=4)
    paths = O.forecast_paths(states, TL, features, scaler, steps=6, length=4, weights=weights).collect()
    seq = {(r["site"], r["time_window"]): np.array(r["x"]) for r in S.sequences(scale_states(states, features, scaler), TL, features, 4).collect()}
    predict, met = P.linear_predictor(weights), 0
    for r in paths:
        x = seq.get((r["site"], r["time_window"]))
        if x is not None:
            met += 1
            for step in r["path"]:
                now = predict(x[None])[0]
                assert step == pytest.approx(now, abs=1e-9)
                x = np.vstack([x[1:], now])
    assert met > 100


def test_huber_fit_settles_and_resists_outliers(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 2, 2))
    y = x[:, 1] * 0.5 + 0.2 * x[:, 0] + rng.normal(0, 0.1, (3000, 2))
    y[:200] += 40.0
    rows = [(a.tolist(), b.tolist()) for a, b in zip(x, y)]
    seq = spark.createDataFrame(rows, "x array<array<double>>, y array<double>").repartition(3).cache()
    weights = P.fit_huber(seq, 2, 2, ridge=1e-3)
    gradient = P.huber_moments(seq, 2, 2, weights, 1.0)
    assert np.abs(gradient[:-1] - 1e-3 * weights[:-1]).max() < 0.2
    assert abs(weights[-1]).max() < 0.2 < abs(P.fit_linear(seq, 2, 2)[-1]).max()
    assert np.allclose(weights[2:4], 0.5 * np.eye(2), atol=0.05)


def test_new_versions_take_effect_and_repeated_batches_keep_theirs(spark, tmp_path):
    base = str(tmp_path)

    def limits(p95):
        return spark.createDataFrame([(p95, 9.0)], "p95 double, p99 double")

    def arrive(values):
        spark.createDataFrame([(v,) for v in values], "mse double").write.mode("append").parquet(f"{base}/in")
        stream = live.stream_table(spark, f"{base}/in", limits(0.0).selectExpr("p95 AS mse").schema)
        versions.run_versioned(stream, f"{base}/p", f"{base}/out", f"{base}/work", versions.above_thresholds)
        return sorted((r["mse"], r["above_95"], r["parameter_version"]) for r in spark.read.parquet(f"{base}/out").collect())

    with pytest.raises(Exception):
        versions.newest_version(spark, f"{base}/p")
    versions.save_version(limits(1.0), f"{base}/p", 1)
    assert arrive([2.0]) == [(2.0, 1, 1)]
    versions.save_version(limits(3.0), f"{base}/p", 2)
    # the micro-batch had begun before with version 1 and is repeated
    spark.range(1).selectExpr("1 AS version").write.parquet(f"{base}/work/versions/batch=1")
    assert arrive([2.5]) == [(2.0, 1, 1), (2.5, 1, 1)]
    assert arrive([2.8])[-1] == (2.8, 0, 2)
