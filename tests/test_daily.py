"""Dates added one run at a time."""

import os

import pytest

from helpers import minute
from portentia import Timeline
from portentia.operators.anomaly import anomaly_features
from portentia.operators.prediction import score_states
from portentia.operators.risk import forecast_engine
from portentia.operators.states import build_states
from portentia.plans import daily
from portentia.plans.pipeline import Settings

TL = Timeline(3600, ("site",))
SETTINGS = Settings(("v",), "label", "bad", TL)


def flows(spark):
    """Five days of hours; one site has no flow for almost two days, one ends early."""
    rows = []
    for s in ("x", "y", None):
        for h in range(120):
            if not (s == "y" and 50 <= h < 95) and not (s is None and h > 70):
                rows += [(s, minute(60 * h + i), "bad" if h % 31 == 0 else "ok", None if h % 13 == 0 else float((h * 5 + i) % 9)) for i in range(2)]
    return spark.createDataFrame(rows, "site string, ts timestamp, label string, v double")


def listing(path):
    return {(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def rows(df):
    return sorted((tuple(r.asDict().values()) for r in df.select(sorted(df.columns)).collect()), key=str)


def test_days_in_runs_equal_one_run(spark, tmp_path, monkeypatch):
    df, out = flows(spark).cache(), str(tmp_path)
    days = sorted({str(r[0]) for r in df.selectExpr("CAST(ts AS DATE)").distinct().collect()})
    daily.fit_parameters(df, out, SETTINGS)
    daily.add_dates(df, out, SETTINGS, days[0], days[1])
    before = listing(f"{out}/states") | listing(f"{out}/engine")

    def killed(features):
        raise KeyboardInterrupt

    monkeypatch.setattr(daily, "forecast_engine", killed)
    with pytest.raises(KeyboardInterrupt):
        daily.add_dates(df, out, SETTINGS, days[2], days[2])
    monkeypatch.undo()
    written = listing(f"{out}/states") | listing(f"{out}/scores") | listing(f"{out}/anomaly")
    daily.add_dates(df, out, SETTINGS, days[2], days[2])
    after = listing(out)
    assert all(after[k] == v for k, v in (before | written).items())
    daily.add_dates(df, out, SETTINGS, days[2], days[2])
    assert listing(f"{out}/engine") == {k: v for k, v in after.items() if "/engine/" in k[0]}
    with pytest.raises(ValueError, match="there already"):
        daily.add_dates(df, out, SETTINGS, days[1], days[3])
    tables = daily.add_dates(df, out, SETTINGS, days[3], days[-1])
    medians, scaler, thresholds = (spark.read.parquet(f"{out}/{p}") for p in ("medians", "scaler", "thresholds"))
    states = build_states(df, ["v"], TL, "label", "bad", medians=medians)
    scores = score_states(states, TL, ["v", "flow_count"], scaler)
    anomaly = anomaly_features(scores, TL, thresholds)
    for name, whole in (("states", states), ("scores", scores), ("anomaly", anomaly), ("engine", forecast_engine(anomaly))):
        assert rows(tables[name]) == rows(whole), name
    assert daily.records(spark, out).count() == 12
