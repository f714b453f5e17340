import pytest
from pyspark.sql import functions as F

from helpers import minute, minutes_of
from portentia import Timeline
from portentia.operators import campaigns as C
from portentia.operators.quality import crosstab, label_extent, time_extent, value_counts

TL = Timeline(60)
COLUMNS = "time_window timestamp, is_positive int, forecast_5 string, forecast_10 string, forecast_15 string, mse double"


def engine(spark, signals, n=200):
    """Minutes 0..n-1, LOW except where given."""
    rows = []
    for i in range(n):
        level = signals.get(i, "LOW")
        rows.append((minute(i), int(100 <= i <= 110), level, level, "LOW", 5.0 if level == "HIGH" else 0.1))
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="module")
def campaigns(spark):
    rows = [("none", 40, 45), ("single", 80, 90), ("double", 150, 160), ("outside", 900, 910)]
    return C.campaign_table(spark, [(n, str(minute(a)), str(minute(b))) for n, a, b in rows])


SIGNALS = {60: "MEDIUM", 130: "HIGH", 141: "MEDIUM", 142: "HIGH", 143: "HIGH", 155: "HIGH"}


def test_signal_evaluation(spark, campaigns):
    rows = C.signal_evaluation(engine(spark, SIGNALS), campaigns, TL).collect()
    got = {(r["campaign"], r["horizon"], r["signal_level"]): r for r in rows}
    assert len(got) == 4 * 3 * 2
    nothing = got[("none", 5, "MEDIUM/HIGH")]
    assert nothing["first_signal"] is None and nothing["signal_count"] == 0
    assert nothing["signal_rate"] == 0.0
    single = got[("single", 5, "MEDIUM/HIGH")]
    assert (single["first_lead"], single["sustained_signal"], single["signal_count"]) == (20, None, 1)
    assert got[("single", 5, "HIGH")]["first_signal"] is None
    double = got[("double", 10, "MEDIUM/HIGH")]
    assert (double["first_lead"], double["sustained_lead"], double["signal_count"]) == (20, 9, 4)
    assert double["signal_rate"] == pytest.approx(4 / 30)
    assert got[("double", 10, "HIGH")]["sustained_lead"] == 8
    assert got[("outside", 5, "HIGH")]["signal_count"] == 0


def test_false_signals_and_report(spark, campaigns):
    e = engine(spark, SIGNALS)
    got = {(r["horizon"], r["signal_level"]): r for r in C.false_signals(e, campaigns, TL).collect()}
    normal = 200 - 11 - 6 - 11 - 11
    assert got[(5, "MEDIUM/HIGH")]["signal_count"] == 5
    assert got[(5, "MEDIUM/HIGH")]["signal_rate"] == pytest.approx(5 / normal)
    assert got[(15, "HIGH")]["signal_count"] == 0
    assert C.evaluation_report(e, campaigns, TL).count() == 24 + 6


def test_interval_join_has_every_pair(spark, campaigns):
    e = engine(spark, {})
    for chunk in (1, 7, 1000):
        got = C.interval_join(e, campaigns, TL, "start", "end", chunk_buckets=chunk)
        assert got.groupBy("campaign").count().count() == 3
        assert got.count() == 6 + 11 + 11


def test_keyed_campaigns_only_match_their_key(spark):
    tl = Timeline(60, ("site",))
    e = engine(spark, {}, 50).withColumn("site", F.explode(F.array(F.lit("x"), F.lit("y"))))
    campaigns = C.campaign_table(spark, [("c", str(minute(40)), str(minute(45)))]).withColumn(
        "site", F.lit("x")
    )
    got = C.pre_attack_window(e, campaigns, tl, 10)
    assert got.count() == 10 and got.filter("site = 'y'").count() == 0
    assert C.normal_period(e, campaigns, tl).count() == 100 - 6


def test_early_warning(spark, campaigns):
    thresholds = spark.createDataFrame([(1.0,)], "p95 double")
    rows = {140: "HIGH", 142: "HIGH", 143: "HIGH", 149: "HIGH"}
    got = {
        r["campaign"]: r
        for r in C.early_warning(engine(spark, rows), campaigns, thresholds, TL).collect()
    }
    d = got["double"]
    assert (d["samples"], d["crossings"], d["crossing_lead"]) == (30, 4, 10.0)
    # Only minutes 143 and 144 look back on three crossings within five rows.
    assert (d["sustained_count"], d["sustained_lead"]) == (2, 7.0)
    assert d["max_mse"] == 5.0 and d["median_mse"] == pytest.approx(0.1)
    assert got["outside"]["samples"] == 0 and got["outside"]["first_crossing"] is None
    timeline = C.early_warning_timeline(engine(spark, rows), campaigns, TL).filter("campaign = 'double'")
    assert timeline.orderBy("time_window").first()["rolling_5"] == pytest.approx(0.1)


def test_combined_warning(spark, campaigns):
    e = engine(spark, SIGNALS)
    thresholds = spark.createDataFrame([(1.0, 2.0)], "p95 double, p99 double")
    rollout = spark.createDataFrame(
        [(minute(145), 5, minute(150), 1), (minute(146), 5, minute(151), 1), (minute(140), 5, minute(145), 1),
         (minute(149), 1, minute(150), 0)],
        "time_window timestamp, step int, target_time timestamp, above_99 int",
    )
    got = {
        (r["campaign"], r["signal"], r["horizon"]): r
        for r in C.combined_warning(e, rollout, e, campaigns, thresholds, TL).collect()
    }
    assert len(got) == 4 * 8
    assert got[("double", "state anomaly", 0)]["lead"] == 20.0
    assert got[("double", "recursive forecast", 5)]["lead"] == 5.0
    assert got[("double", "recursive forecast", 1)]["warning_time"] is None
    assert got[("double", "forecast engine", 5)]["lead"] == 20.0
    assert got[("outside", "forecast engine", 5)]["lead"] == 770.0  # no lower bound
    assert got[("single", "forecast engine", 5)]["warning_time"] is None
    bounded = {
        (r["campaign"], r["horizon"]): r["lead"]
        for r in C.combined_warning(e, rollout, e, campaigns, thresholds, TL, lookback=10)
        .filter("signal = 'forecast engine'")
        .collect()
    }
    assert bounded[("double", 5)] == 8.0 and bounded[("outside", 5)] is None


def test_campaign_profile(spark):
    states = engine(spark, {}, 60).withColumn("v", F.minute("time_window").cast("double"))
    states = states.withColumn("flat", F.lit(2.0))
    periods = C.campaign_table(
        spark,
        [("a", str(minute(0)), str(minute(9))), ("b", str(minute(10)), str(minute(19))),
         ("n", str(minute(30)), str(minute(30))), ("n", str(minute(32)), str(minute(32)))],
    )
    rows = C.campaign_profile(states, periods, TL, ["flat", "v"], "a", "b", "n").collect()
    assert [r["feature"] for r in rows] == ["v", "flat"]
    assert (rows[0]["first_mean"], rows[0]["second_mean"], rows[0]["normal_mean"]) == (4.5, 14.5, 31.0)
    assert rows[0]["difference_pct"] == pytest.approx(10 / 4.5 * 100)


def test_around_and_counts(spark):
    e = engine(spark, {})
    assert C.around(e, str(minute(50)), TL, 30, 10).count() == 41
    assert {r["is_positive"]: r["rows"] for r in value_counts(e, "is_positive").collect()} == {0: 189, 1: 11}
    table = crosstab(e, F.col("is_positive"), "p", "forecast_5", ["HIGH", "LOW"]).orderBy("p").collect()
    assert [tuple(r) for r in table] == [(0, 0, 189), (1, 0, 11)]
    assert time_extent(e, "time_window").first()["rows"] == 200
    extent = label_extent(e, "time_window", F.col("is_positive") == 1, F.col("is_positive") == 0).first()
    assert minutes_of(extent["first_positive"]) == 100 and extent["positive_rows"] == 11
