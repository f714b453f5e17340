import pytest

from helpers import minute
from portentia import Timeline
from portentia.operators import snapshot as N
from portentia.operators.campaigns import campaign_table
from portentia.plans.pipeline import Settings, run_batch
from portentia.sources.tables import read_table


def test_batch_job_writes_every_stage(spark, tmp_path):
    rows = [
        (s, minute(m), "bad" if 50 <= m < 60 else "ok", None if m % 13 == 0 else float((m * 5 + i) % 9))
        for s in ("x", "y")
        for m in range(120)
        for i in range(2)
    ]
    flows = spark.createDataFrame(rows, "site string, ts timestamp, label string, v double")
    settings = Settings(("v",), "label", "bad", Timeline(60, ("site",)))
    campaigns = campaign_table(spark, [("c", str(minute(50)), str(minute(59)))])
    tables = run_batch(flows, str(tmp_path), settings, campaigns)
    assert tables["states"].count() == 240
    assert tables["scores"].count() == tables["engine"].count() == tables["snapshots"].count() == 220
    assert tables["dataset"].count() == 220
    assert tables["targets"].filter("starts_within_5 = 1").count() == 10
    assert tables["report"].filter("evaluation = 'Attack'").count() == 2 * 6
    assert [r["feature"] for r in tables["scaler"].collect()] == ["v", "flow_count"]
    part = read_table(spark, f"{tmp_path}/snapshots", str(minute(60)), str(minute(61)))
    assert part.count() == 2
    row = N.at(tables["snapshots"], settings.tl, str(minute(55))).first()
    assert row["stage"]["stage"].startswith("Active") and row["label_ratio"] == 1.0
    with pytest.raises(LookupError):
        N.at(tables["snapshots"], settings.tl, str(minute(500)))
    summary = N.forecast_summary(tables["engine"], settings.tl).first()
    assert summary["states"] == summary["low"] + summary["medium"] + summary["high"] == 220
