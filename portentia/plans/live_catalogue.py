"""The registered streaming queries: the test tables replayed as files that keep arriving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from portentia.operators.scaling import scaler_table
from portentia.plans import fixture as X
from portentia.plans.catalogue import FEATURES, TL, Query
from portentia.operators import prediction as P
from portentia.operators.quality import compare_tables
from portentia.operators.states import POSITIVE, feature_medians
from portentia.operators.risk import HORIZONS, LIVE_P95, LIVE_P99
from portentia.runtime import run_dir
from portentia.streaming import keyed, live, versions
from portentia.timeline import Timeline

T0 = TL.time

# Arrival of the replayed slices, and the rule that holds rows back until the last one.
CUTS = ("2024-01-11", "2024-01-21")


def _slice() -> Column:
    first, second = (F.lit(c).cast("timestamp") for c in CUTS)
    return F.when(F.col("ts") < first, 0).when(F.col("ts") < second, 1).otherwise(2)


def _events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = X.table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
    return X.typed_flows(events.parquet(sf_dir))


def _scaler(states: DataFrame) -> dict[str, tuple[float, float]]:
    rows = scaler_table(X.scaler(states), FEATURES).collect()  # one row per feature
    return {r["feature"]: (r["mean"], r["std"]) for r in rows}


def _states(stream: DataFrame) -> DataFrame:
    return live.stream_states(
        stream, X.FLOW_FEATURES, TL, X.LABEL, X.POSITIVE_LABEL, ratio_threshold=X.RATIO_THRESHOLD
    )


def _scores(stream: DataFrame, scaler: dict[str, tuple[float, float]], predictor=keyed.window_mean) -> DataFrame:
    return keyed.keyed_scores(_states(stream), FEATURES, TL, scaler, predictor)


def stream_states(spark, sf):
    """Closed buckets from the stream, open ones from the final flush."""
    out = run_dir(spark, "stream_states")
    live.run_available(_states(_events_stream(spark, sf)), f"{out}/states", f"{out}/checkpoint")
    closed = spark.read.parquet(f"{out}/states")
    flushed = live.flush(
        X.flows(spark, sf), closed, X.FLOW_FEATURES, TL, X.LABEL, X.POSITIVE_LABEL,
        ratio_threshold=X.RATIO_THRESHOLD,
    )
    return closed.unionByName(flushed)


def stream_late_drop(spark, sf):
    """Every 50th row of the first two slices arrives with the third: most are too late."""
    out = run_dir(spark, "stream_late_drop")
    held = (F.col("event_id") % 50 == 0) & (_slice() < 2)
    flows = X.flows(spark, sf).withColumn("arrival", F.when(held, 2).otherwise(_slice()))
    for arrival in range(3):
        flows.filter(F.col("arrival") == arrival).drop("arrival").write.mode("append").parquet(
            f"{out}/flows"
        )
        stream = live.stream_table(spark, f"{out}/flows", flows.drop("arrival").schema)
        live.run_available(_states(stream), f"{out}/states", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/states").select(T0, "flow_count", "label_ratio", POSITIVE)


def _streamed_scores(spark, sf, states, predictor=keyed.window_mean):
    out = run_dir(spark, "stream_scores")
    scored = _scores(_events_stream(spark, sf), _scaler(states), predictor)
    keyed.run_keyed(scored, f"{out}/scores", f"{out}/checkpoint")
    return spark.read.schema(scored.schema).parquet(f"{out}/scores")


def stream_scores(spark, sf):
    """Closed states meet the last ten vectors kept for their key."""
    return _streamed_scores(spark, sf, X.states(spark, sf)).select(
        T0, "source_time", POSITIVE, "mse", "mae", "top_feature", "top_feature_error"
    )


def live_vs_batch(spark, sf):
    """Replayed errors against the batch errors of the same minutes."""
    states = X.states(spark, sf)
    return compare_tables(_streamed_scores(spark, sf, states), X.scores(states), [T0], ["mse", "mae"])


def stream_scores_linear(spark, sf):
    """A fitted linear model on the stream against the batch scores of the same weights."""
    states = X.states(spark, sf)
    scaler = X.scaler(states)
    weights = P.fit_next_state(states, TL, FEATURES, scaler)
    streamed = _streamed_scores(spark, sf, states, P.linear_predictor(weights))
    batch = P.score_linear(states, TL, FEATURES, scaler, weights)
    return compare_tables(streamed, batch, [T0], ["mse", "mae"])


def stream_forecast(spark, sf):
    """Three arrivals; the last errors of the key are in its state, so each arrival is read once."""
    scaler = _scaler(X.states(spark, sf))
    out = run_dir(spark, "stream_forecast")
    flows = X.flows(spark, sf)
    for arrival in range(3):
        flows.filter(_slice() == arrival).write.mode("append").parquet(f"{out}/flows")
        scored = _scores(live.stream_table(spark, f"{out}/flows", flows.schema), scaler)
        keyed.run_keyed(keyed.keyed_forecast(scored), f"{out}/risk", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/risk").select(
        T0, "mse", "baseline", "ratio", "current_level",
        "above95_count_5", "above95_count_10", "above99_count_5", "above99_count_10",
        *[f"risk_{h}" for h in HORIZONS], *[f"state_{h}" for h in HORIZONS],
        "top_feature", "reason",
    )


def stream_attack_periods(spark, sf):
    """Runs of positive states from the stream, closed by the watermark."""
    out = run_dir(spark, "stream_periods")
    periods = live.stream_attack_periods(_events_stream(spark, sf), TL, X.LABEL, X.POSITIVE_LABEL, ratio_threshold=X.RATIO_THRESHOLD)
    live.run_available(periods, f"{out}/periods", f"{out}/checkpoint")
    return spark.read.schema(periods.schema).parquet(f"{out}/periods")


SENSORS = Timeline(bucket_seconds=3600, keys=("sensor",))


def _sensor_states(spark, sf, name: str, arrival: Column, arrivals: int, idle_seconds: float | None = None) -> DataFrame:
    """States by sensor of flows that arrive in parts; rows without an arrival never come."""
    out = run_dir(spark, name)
    flows = X.flows(spark, sf).withColumn("sensor", F.expr("nullif(CAST(user_id AS BIGINT) % 4, 3)"))
    for part in range(arrivals):
        flows.filter(arrival == part).write.mode("append").parquet(f"{out}/flows")
        stream = live.stream_table(spark, f"{out}/flows", flows.schema)
        states = keyed.keyed_states(
            stream, ["value", "k"], SENSORS, X.LABEL, X.POSITIVE_LABEL, ratio_threshold=X.RATIO_THRESHOLD, idle_seconds=idle_seconds
        )
        keyed.run_keyed(states, f"{out}/states", f"{out}/checkpoint", timers=True)
    return spark.read.schema(states.schema).parquet(f"{out}/states")


def stream_slow_sensor(spark, sf):
    """One sensor arrives ten days behind the others and loses nothing: buckets close by their own sensor's time."""
    slow = F.coalesce((F.col("sensor") == 0).cast("int"), F.lit(0))
    return _sensor_states(spark, sf, "slow_sensor", _slice() + slow, 4)


def stream_idle_flush(spark, sf):
    """One sensor falls silent for good: a timer closes its last bucket. Those of the others are still open."""
    silent = F.coalesce(F.col("sensor") == 0, F.lit(False)) & (_slice() == 2)
    return _sensor_states(spark, sf, "idle_flush", F.when(~silent, _slice()), 3, idle_seconds=0.001)


def stream_filled_states(spark, sf):
    """Stored medians fill what is missing on the stream."""
    flows = X.flows(spark, sf)
    gaps = F.when(F.col("event_id") % 97 != 0, F.col("value"))
    medians = {r["feature"]: r["median"] for r in feature_medians(flows.withColumn("value", gaps), ["value", "k"]).collect()}
    out = run_dir(spark, "filled_states")
    stream = _events_stream(spark, sf).withColumn("value", gaps)
    states = keyed.keyed_states(
        stream, ["value", "k"], TL, X.LABEL, X.POSITIVE_LABEL, ratio_threshold=X.RATIO_THRESHOLD, medians=medians
    )
    keyed.run_keyed(states, f"{out}/states", f"{out}/checkpoint", timers=True)
    return spark.read.schema(states.schema).parquet(f"{out}/states")


def stream_versions(spark, sf):
    """Thresholds by version: the live defaults for the first arrival, those of the data from the second on."""
    scores = X.scores(X.states(spark, sf)).select(T0, POSITIVE, "mse")
    out = run_dir(spark, "versions")
    defaults = spark.range(1).select(F.lit(LIVE_P95).alias("p95"), F.lit(LIVE_P99).alias("p99"))
    versions.save_version(defaults, f"{out}/parameters", 1)
    first, second = (F.lit(c).cast("timestamp") for c in CUTS)
    arrival = F.when(F.col(T0) < first, 0).when(F.col(T0) < second, 1).otherwise(2)
    for part in range(3):
        if part == 1:
            versions.save_version(X.thresholds(scores), f"{out}/parameters", 2)
        scores.filter(arrival == part).write.mode("append").parquet(f"{out}/scores")
        stream = live.stream_table(spark, f"{out}/scores", scores.schema)
        versions.run_versioned(stream, f"{out}/parameters", f"{out}/judged", f"{out}/work", versions.above_thresholds)
    return spark.read.parquet(f"{out}/judged").select(T0, "mse", "above_95", "above_99", "parameter_version")


STREAMING: dict[str, Query] = {
    "stream_states": stream_states,
    "stream_late_drop": stream_late_drop,
    "stream_scores": stream_scores,
    "live_vs_batch": live_vs_batch,
    "stream_forecast": stream_forecast,
    "stream_scores_linear": stream_scores_linear,
    "stream_slow_sensor": stream_slow_sensor,
    "stream_idle_flush": stream_idle_flush,
    "stream_filled_states": stream_filled_states,
    "stream_attack_periods": stream_attack_periods,
    "stream_versions": stream_versions,
}
