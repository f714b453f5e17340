"""Adapter: the test tables in the roles of flows, labels and campaigns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from portentia.operators.anomaly import anomaly_features, baseline_thresholds
from portentia.operators.campaigns import campaign_table
from portentia.operators.prediction import score_states
from portentia.operators.risk import forecast_engine
from portentia.operators.scaling import fit_scaler
from portentia.operators.states import POSITIVE, build_states
from portentia.runtime import stage
from portentia.sources.flows import clean_flows
from portentia.timeline import Timeline

OTHER_TYPES = ("click", "purchase", "signup", "view")
LABEL = "event_type"
POSITIVE_LABEL = "error"
FLOW_FEATURES = ["value", "user_id", "k", *OTHER_TYPES]
STATE_FEATURES = [*FLOW_FEATURES, "flow_count"]
DIRTY_FEATURES = ["value", "user_id", "k"]
RATIO_THRESHOLD = 0.4

# Quarter-hour buckets give real gaps and enough full windows at sf0.01; horizons and lead times
# count buckets.
TIMELINE = Timeline(bucket_seconds=900)

# Terms of the test tables' vocabulary for the stage rules.
RECONNAISSANCE_TERMS = ("flow_count", "value")
COMMAND_TERMS = ("click", "purchase", "signup", "view")

CAMPAIGNS = (
    ("A", "2024-01-05 02:00:00", "2024-01-05 03:30:00"),
    ("B", "2024-01-12 09:45:00", "2024-01-12 11:00:00"),
    ("C", "2024-01-19 18:00:00", "2024-01-19 18:45:00"),
    ("D", "2024-01-26 23:30:00", "2024-01-27 01:00:00"),
    ("E", "2024-03-01 00:00:00", "2024-03-01 01:00:00"),
)
PERIODS = (
    ("first", "2024-01-05 00:00:00", "2024-01-06 23:45:00"),
    ("second", "2024-01-12 00:00:00", "2024-01-13 23:45:00"),
    ("normal", "2024-01-01 00:00:00", "2024-01-03 23:45:00"),
    ("normal", "2024-01-20 00:00:00", "2024-01-21 23:45:00"),
)


def linear_weights(length: int = 10) -> list[list[float]]:
    """Weights of a linear next-state model by a rule, so that SQL can state them too: (length * f + 1) rows of f.

    Every feature is 0.09 of each of its last values, and 0.001 more per lag of the feature before it; the intercept
    grows by 0.01 a feature.
    """
    f = len(STATE_FEATURES)
    lagged = [
        [0.09 * (i == j) + 0.001 * (k + 1) * ((i + 1) % f == j) for j in range(f)] for k in range(length) for i in range(f)
    ]
    return [*lagged, [0.01 * (j + 1) for j in range(f)]]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def typed_flows(events: DataFrame) -> DataFrame:
    """Events as typed flows. The event time is cast: a watermark needs a zoned timestamp."""
    return events.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        LABEL,
        F.col("value").cast("double").alias("value"),
        F.col("user_id").cast("double").alias("user_id"),
        F.get_json_object("props", "$.k").cast("double").alias("k"),
        *[(F.col(LABEL) == t).cast("double").alias(t) for t in OTHER_TYPES],
    )


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed_flows(table(spark, sf_dir, "events"))


def raw_text_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as dirty text rows: day-first times, stray headers, gaps, infinities and junk."""
    e = F.col("event_id")
    value: Column = (
        F.when(e % 97 == 0, F.lit(None).cast("string"))
        .when(e % 89 == 0, "Infinity")
        .when(e % 83 == 0, "bad")
        .otherwise(F.col("value").cast("string"))
    )
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.when(e % 101 == 0, "not a time")
        .otherwise(F.date_format("ts", "dd/MM/yyyy HH:mm:ss"))
        .alias("Timestamp"),
        F.when(e % 1009 == 0, "Label")
        .when(e % 7 == 0, F.concat(F.lit(" "), F.upper(LABEL), F.lit(" ")))
        .otherwise(F.col(LABEL))
        .alias("Label"),
        value.alias("value"),
        F.col("user_id").cast("string").alias("user_id"),
        F.get_json_object("props", "$.k").alias("k"),
    )


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_flows(
        raw_text_flows(spark, sf_dir), DIRTY_FEATURES, passthrough=["event_id"]
    )


def states(spark: SparkSession, sf_dir: str, tl: Timeline = TIMELINE) -> DataFrame:
    """The state table, written once: everything downstream reads it instead of the flows."""
    built = build_states(
        flows(spark, sf_dir), FLOW_FEATURES, tl, LABEL, POSITIVE_LABEL,
        ratio_threshold=RATIO_THRESHOLD,
    )
    return stage(built, "states")


def scaler(states_df: DataFrame, tl: Timeline = TIMELINE) -> DataFrame:
    return fit_scaler(states_df, STATE_FEATURES, tl)


def scores(states_df: DataFrame, tl: Timeline = TIMELINE) -> DataFrame:
    """The score table, written once: thresholds, counts and windows all read it."""
    return stage(
        score_states(states_df, tl, STATE_FEATURES, scaler(states_df, tl)), "scores"
    )


def thresholds(scores_df: DataFrame) -> DataFrame:
    return baseline_thresholds(scores_df, F.col(POSITIVE) == 0)


def anomaly(scores_df: DataFrame, tl: Timeline = TIMELINE) -> DataFrame:
    return anomaly_features(scores_df, tl, thresholds(scores_df))


def engine(scores_df: DataFrame, tl: Timeline = TIMELINE) -> DataFrame:
    return forecast_engine(anomaly(scores_df, tl))


def campaigns(spark: SparkSession) -> DataFrame:
    return campaign_table(spark, CAMPAIGNS)


def periods(spark: SparkSession) -> DataFrame:
    return campaign_table(spark, PERIODS)
