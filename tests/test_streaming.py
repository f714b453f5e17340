import pytest

from helpers import minute
from portentia import Timeline
from portentia.operators.prediction import score_states, with_top_feature
from portentia.operators.quality import compare_tables
from portentia.operators.risk import live_forecast
from portentia.operators.scaling import fit_scaler, scaler_table
from portentia.operators.states import build_states
from portentia.streaming import live

TL = Timeline(60, ("site",))
SCHEMA = "site string, ts timestamp, label string, v double"


def flow(site, second, label="ok", v=1.0):
    return (site, minute(0) + (minute(1) - minute(0)) * (second / 60), label, v)


def arrive(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(path)


def run_states(spark, base, **options):
    stream = live.stream_table(spark, f"{base}/in", spark.createDataFrame([], SCHEMA).schema)
    live.run_available(
        live.stream_states(stream, ["v"], TL, "label", "bad", **options), f"{base}/out", f"{base}/cp"
    )
    return spark.read.parquet(f"{base}/out")


def test_late_rows_are_dropped_and_flush_closes(spark, tmp_path):
    base = str(tmp_path)
    arrive(spark, [flow("a", 10, "bad", 4.0), flow("a", 50, v=2.0), flow("b", 70)], f"{base}/in")
    first = run_states(spark, base)
    assert [(r["site"], r["flow_count"], r["v"], r["label_ratio"]) for r in first.collect()] == [("a", 2, 3.0, 0.5)]
    # Minute 0 is closed, minute 1 is still open.
    arrive(spark, [flow("a", 30, v=99.0), flow("b", 75, v=3.0), flow("a", 130)], f"{base}/in")
    second = run_states(spark, base).orderBy("time_window").collect()
    assert [(r["site"], r["flow_count"], r["v"]) for r in second] == [("a", 2, 3.0), ("b", 2, 2.0)]
    arrive(spark, [flow("b", 131)], f"{base}/in")
    closed = run_states(spark, base)
    assert closed.count() == 2
    tail = live.flush(spark.read.parquet(f"{base}/in"), closed, ["v"], TL, "label", "bad")
    assert sorted((r["site"], r["flow_count"]) for r in tail.collect()) == [("a", 1), ("b", 1)]


def test_stored_medians_fill_the_stream(spark, tmp_path):
    base = str(tmp_path)
    arrive(spark, [flow("a", 1, v=None), flow("a", 2, v=4.0), flow("a", 65)], f"{base}/in")
    row = run_states(spark, base, medians={"v": 2.0}).first()
    assert row["v"] == 3.0


def test_missing_column_stops_before_the_stream_starts(spark, tmp_path):
    stream = live.stream_table(spark, str(tmp_path), spark.createDataFrame([], SCHEMA).schema)
    with pytest.raises(ValueError, match="missing columns"):
        live.stream_states(stream, ["nope"], TL, "label", "bad")


def test_streamed_scores_and_risk_equal_batch(spark, tmp_path):
    """Two sites with gaps, three arrivals, every step restarted from its checkpoint."""
    base = str(tmp_path)
    rows = [
        flow(site, 60 * m + 7 * j, "bad" if (m + j) % 5 == 0 else "ok", float((m * 7 + j * 3 + k) % 11))
        for k, site in enumerate("ab")
        for m in range(90)
        if (m + 3 * k) % 37 != 20
        for j in range(1 + m % 3)
    ]
    flows = spark.createDataFrame(rows, SCHEMA)
    states = build_states(flows, ["v"], TL, "label", "bad").cache()
    features = ["v", "flow_count"]
    scaler = fit_scaler(states, features, fit_rows="all")
    stored = {r["feature"]: (r["mean"], r["std"]) for r in scaler_table(scaler, features).collect()}
    for low, high in ((0, 25), (25, 61), (61, 90)):
        part = [r for r in rows if minute(low) <= r[1] < minute(high)]
        arrive(spark, part, f"{base}/in")
        stream = live.stream_table(spark, f"{base}/in", flows.schema)
        scored = live.stream_scores(stream, ["v"], TL, "label", "bad", stored)
        live.run_available(scored, f"{base}/scores", f"{base}/cp")
        errors = live.stream_table(spark, f"{base}/scores", scored.schema)
        live.run_live_forecast(errors, TL, f"{base}/risk", f"{base}/work")
    batch = with_top_feature(score_states(states, TL, features, scaler), features)
    last = minute(89)
    batch = batch.filter(batch.time_window < last).cache()
    streamed = spark.read.parquet(f"{base}/scores")
    assert streamed.count() == batch.count() > 50
    diff = compare_tables(streamed, batch, ["site", "time_window"], ["mse", "mae", "is_positive"])
    assert all(r["rows"] == batch.count() and r["mismatches"] == 0 for r in diff.collect())
    risk = spark.read.parquet(f"{base}/risk")
    want = live_forecast(batch, TL)
    columns = ["baseline", "ratio", "risk_5", "risk_10", "above95_count_10"]
    diff = compare_tables(risk, want, ["site", "time_window"], columns).collect()
    assert all(r["rows"] == want.count() == risk.count() and r["mismatches"] == 0 for r in diff)
    assert live.latest_row(risk, TL).count() == 2
