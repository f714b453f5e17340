import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import minute, minutes_of, series, states_df
from portentia import Timeline
from portentia.operators import anomaly as A
from portentia.operators import prediction as P
from portentia.operators import risk as R
from portentia.operators import rollout as O
from portentia.operators import stage as G
from portentia.operators.scaling import fit_scaler, scale_states
from portentia.operators.sequences import sequences

TL = Timeline(60, ("key",), block_buckets=32)
ROWS = series(200, gap=0.02, positive=0.02)
F2 = ["a", "b"]


@pytest.fixture(scope="module")
def states(spark):
    return states_df(spark, ROWS).cache()


@pytest.fixture(scope="module")
def scaler(states):
    return fit_scaler(states, F2, fit_rows="all")


def expected_scores(scaler, length=10):
    s = scaler.first()
    mean, std = np.array([s["mean_a"], s["mean_b"]]), np.array([s["std_a"], s["std_b"]])
    z = (np.array([[r[3], r[4]] for r in ROWS]) - mean) / std
    out = {}
    for j in range(length, len(ROWS)):
        if ROWS[j][1] - ROWS[j - length][1] == length:
            err = np.abs(z[j - length : j].mean(axis=0) - z[j])
            out[ROWS[j][1]] = ((err**2).mean(), err.mean(), err)
    return z, out


def test_scores_match_brute_force(states, scaler):
    _, want = expected_scores(scaler)
    got = P.score_states(states, TL, F2, scaler).collect()
    assert len(got) == len(want)
    for r in got:
        mse, mae, err = want[minutes_of(r["time_window"])]
        assert r["mse"] == pytest.approx(mse) and r["mae"] == pytest.approx(mae)
        assert r["errors"] == pytest.approx(list(err))
        assert minutes_of(r["source_time"]) == minutes_of(r["time_window"]) - 1
    source = P.score_states(states, TL, F2, scaler, stamp="source").collect()
    assert {minutes_of(r["time_window"]) + 1 for r in source} == set(want)


def test_any_predictor_on_sequences(states, scaler):
    _, want = expected_scores(scaler)
    seq = sequences(scale_states(states, F2, scaler), TL, F2)
    got = P.score_sequences(seq, TL, 2, lambda x: x.mean(axis=1)).collect()
    assert {minutes_of(r["time_window"]): pytest.approx(r["mse"]) for r in got} == {
        t: w[0] for t, w in want.items()
    }


def test_linear_model_equals_least_squares(states, scaler):
    seq = sequences(scale_states(states, F2, scaler), TL, F2, length=3)
    weights = P.fit_linear(seq, 2, length=3, ridge=0.5)
    rows = seq.collect()
    x = np.array([np.append(np.ravel(r["x"]), 1.0) for r in rows])
    y = np.array([r["y"] for r in rows])
    penalty = 0.5 * np.eye(7)
    penalty[-1, -1] = 0
    assert weights == pytest.approx(np.linalg.solve(x.T @ x + penalty, x.T @ y))
    scored = P.score_sequences(seq, TL, 2, P.linear_predictor(weights), 3)
    assert scored.agg(F.avg("mse")).first()[0] == pytest.approx(((x @ weights - y) ** 2).mean())


def test_feature_attribution_and_ties(spark):
    rows = [("k", minute(0), [1.0, 3.0, 3.0]), ("k", minute(1), [0.5, 0.0, 0.2])]
    df = spark.createDataFrame(rows, "key string, time_window timestamp, errors array<double>")
    names = ["x", "y", "z"]
    top = P.top_feature_errors(df, TL, names, 2).orderBy("time_window", "rank").collect()
    assert [(r["feature"], r["error"]) for r in top] == [("y", 3.0), ("z", 3.0), ("x", 0.5), ("z", 0.2)]
    assert [r["top_feature"] for r in P.with_top_feature(df, names).orderBy("time_window").collect()] == ["y", "x"]
    assert P.top_mean_scores(df, (2,)).orderBy("time_window").first()["top2_error"] == 3.0
    assert P.feature_error_map(df, names).first()["feature_errors"]["x"] == 1.0


def test_anomaly_features_against_pandas(spark, states, scaler):
    scores = P.score_states(states, TL, F2, scaler).cache()
    thresholds = A.baseline_thresholds(scores, F.col("is_positive") == 0)
    got = A.anomaly_features(scores, TL, thresholds).orderBy("time_window").toPandas()
    m = got["mse"]
    p = scores.filter("is_positive = 0").toPandas()["mse"]
    flags = (m > p.quantile(0.95)).astype(int)
    median = m.rolling(10, min_periods=3).median()
    want = {
        "rolling_3": m.rolling(3, min_periods=1).mean(),
        "rolling_10": m.rolling(10, min_periods=1).mean(),
        "max_5": m.rolling(5, min_periods=1).max(),
        "change_1": m.diff(),
        "change_3": m - m.shift(3),
        "ratio_10": m / (median + 1e-6),
        "above95_count_10": flags.rolling(10, min_periods=1).sum(),
    }
    for name, values in want.items():
        assert got[name].astype(float).to_numpy() == pytest.approx(values.to_numpy(), nan_ok=True), name


def risk_row(spark, **values):
    base = dict(mse=0.0, rolling_3=0.0, rolling_5=0.0, rolling_10=0.0, max_10=0.0, change_1=None,
                change_3=None, ratio_10=None, above95_count_5=0, above95_count_10=0,
                is_positive=0, p95=1.0, p99=2.0)
    base.update(values)
    types = {k: "int" if k in ("is_positive",) or "count" in k else "double" for k in base}
    schema = ", ".join(f"{k} {t}" for k, t in types.items())
    return R.forecast_engine(spark.createDataFrame([tuple(base.values())], schema)).first()


def test_risk_boundaries(spark):
    at = risk_row(spark, mse=1.0, rolling_3=2.0)  # exactly on a threshold does not exceed it
    assert at["risk_5"] == 1.5 and at["forecast_5"] == "LOW"
    assert at["forecast_reason"] == R.REASON_NONE
    four = risk_row(spark, mse=2.1)
    assert four["risk_5"] == 4.0 and four["forecast_5"] == "MEDIUM"
    seven = risk_row(spark, mse=2.1, rolling_5=1.5, change_1=2.5)
    assert seven["risk_5"] == 7.0 and seven["forecast_state"] == "HIGH"
    high = risk_row(spark, mse=9.0, rolling_3=9.0, rolling_5=9.0, rolling_10=9.0, max_10=9.0,
                    change_1=9.0, change_3=9.0, ratio_10=9.0, above95_count_5=5, above95_count_10=9,
                    is_positive=1)
    assert (high["risk_5"], high["risk_10"], high["risk_15"]) == (10.0, 10.0, 10.0)
    assert high["ground_truth"] == "ATTACK"
    assert high["forecast_reason"].split("; ") == [
        R.REASON_IMMEDIATE, R.REASON_PERSISTENT, R.REASON_SUSTAINED, R.REASON_OVER_5X, R.REASON_REPEATED,
    ]


def test_live_levels(spark):
    df = spark.createDataFrame([(7.0,), (8.0,), (4.0,), (3.9,)], "s double")
    assert [r[0] for r in df.select(R.level("s", R.LIVE_CUTS)).collect()] == [
        "MEDIUM", "HIGH", "MEDIUM", "LOW",
    ]


def test_live_forecast_against_python(spark):
    rng = np.random.default_rng(5)
    mse = rng.gamma(2.0, 0.4, 80)
    df = spark.createDataFrame(
        [("k", minute(2 * i), float(v)) for i, v in enumerate(mse)],
        "key string, time_window timestamp, mse double",
    )
    got = R.live_forecast(df, TL).orderBy("time_window").collect()
    for i, r in enumerate(got):
        before = mse[max(0, i - 30) : i]
        baseline = max(np.median(before), 1e-6) if len(before) else R.LIVE_P95
        n5 = int((mse[max(0, i - 4) : i + 1] > R.LIVE_P95).sum())
        m5 = int((mse[max(0, i - 4) : i + 1] > R.LIVE_P99).sum())
        ratio = mse[i] / baseline
        score = 4.0 if mse[i] > R.LIVE_P99 else 2.0 if mse[i] > R.LIVE_P95 else 0.0
        score += 2 * (n5 >= 2) + (n5 >= 3) + (m5 >= 2) + (2 if ratio >= 3 else ratio >= 2)
        assert r["baseline"] == pytest.approx(baseline)
        assert (r["above95_count_5"], r["above99_count_5"]) == (n5, m5)
        assert r["risk_5"] == pytest.approx(min(score, 10.0))


def test_stage_rules_in_order(spark):
    rows = [
        (0.1, 0.0, 0.5, "LOW", "iat"),
        (5.0, 0.0, 0.0, "LOW", "iat"),
        (0.1, 4.0, 0.0, "MEDIUM", "dst port syn flag cnt flow iat"),
        (0.1, 4.0, 0.0, "MEDIUM", "flow iat mean"),
        (0.1, 1.0, 0.0, "HIGH", "x"),
        (None, None, None, None, "x"),
    ]
    df = spark.createDataFrame(
        rows, "mse double, forecast_score double, label_ratio double, forecast_state string, t string"
    )
    got = [r["stage"] for r in G.attack_stage(df, F.col("t")).collect()]
    assert [s["stage"] for s in got] == [
        G.INFILTRATION[0], G.PRE_ATTACK[0], G.RECONNAISSANCE[0], G.COMMAND[0], G.SUSPICIOUS[0], G.NORMAL[0],
    ]
    assert got[2]["evidence"][1] == "Signals: dst port, syn flag, syn flag cnt"
    assert got[3]["evidence"][1] == "Signals: iat, flow iat"
    assert got[5]["evidence"] == [G.EVIDENCE_NONE, "Forecast state: LOW", "Forecast score: 0.0/10"]


@pytest.mark.parametrize("value, text", [(0.625, "0.62"), (0.875, "0.88"), (0.525, "0.53"), (2.0, "2.00")])
def test_two_decimals(spark, value, text):
    assert spark.range(1).select(G.two_decimals(F.lit(value))).first()[0] == text


@pytest.mark.parametrize("method", ["window_mean", "persistence"])
def test_rollout_is_the_recursion(states, scaler, method):
    z, _ = expected_scores(scaler)
    steps = 6
    paths = O.forecast_paths(states, TL, F2, scaler, steps, method)
    got = {}
    for r in O.rollout_signals(paths, TL).collect():
        got.setdefault(minutes_of(r["time_window"]), {})[r["step"]] = r
    trend = {minutes_of(r["time_window"]): r for r in O.rollout_trend(paths, TL).collect()}
    origins = 0
    for j in range(9, len(ROWS)):
        if ROWS[j][1] - ROWS[j - 9][1] != 9:
            continue
        origins += 1
        window, last, shocks, risks = list(z[j - 9 : j + 1]), z[j], [], []
        for k in range(1, steps + 1):
            p = np.mean(window, axis=0) if method == "window_mean" else window[-1]
            window = [*window[1:], p]
            r = got[ROWS[j][1]][k]
            shocks.append(np.sqrt(((p - last) ** 2).mean()))
            assert r["transition_shock"] == pytest.approx(shocks[-1], abs=1e-12)
            assert r["predicted_state_change"] == r["transition_shock"]
            assert r["future_state_deviation"] == pytest.approx(np.sqrt((p**2).mean()))
            assert r["max_deviation"] == pytest.approx(np.abs(p).max())
            risks.append(0.7 * shocks[-1] + 0.3 * np.sqrt((p**2).mean()))
            assert r["simulation_risk"] == pytest.approx(risks[-1])
            last = p
        assert got[ROWS[j][1]][1]["future_stability"] == pytest.approx(np.mean(shocks[1:]), abs=1e-12)
        assert trend[ROWS[j][1]]["risk_change"] == pytest.approx(risks[-1] - risks[0])
    assert len(got) == origins > 50
    with pytest.raises(ValueError):
        O.step_weights(method, 0)


def test_rollout_evaluation_stops_at_gaps(spark, states, scaler):
    z, _ = expected_scores(scaler)
    baseline = spark.createDataFrame([(0.5, 1.0, 2.0)], "median double, p95 double, p99 double")
    got = O.rollout_evaluation(states, TL, F2, scaler, baseline, steps=5).collect()
    want = {}
    for j in range(9, len(ROWS) - 5):
        if ROWS[j][1] - ROWS[j - 9][1] != 9:
            continue
        window = list(z[j - 9 : j + 1])
        for k in range(1, 6):
            p = np.mean(window, axis=0)
            window = [*window[1:], p]
            if ROWS[j + k][1] - ROWS[j][1] != k:
                break
            want[(ROWS[j][1], k)] = ((p - z[j + k]) ** 2).mean()
    assert len(got) == len(want)
    for r in got:
        mse = want[(minutes_of(r["time_window"]), r["step"])]
        assert r["mse"] == pytest.approx(mse)
        assert r["anomaly_ratio"] == pytest.approx(mse / 0.5)
        assert r["above_99"] == int(mse > 2.0)
