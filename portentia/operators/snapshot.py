"""Read side: everything known about a bucket on one row, lookups and summaries."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portentia.operators.prediction import with_top_feature
from portentia.operators.stage import (
    COMMAND_TERMS,
    RECONNAISSANCE_TERMS,
    attack_stage,
    top_feature_text,
)
from portentia.operators.states import FLOW_COUNT, RATIO
from portentia.sources.flows import require_rows
from portentia.timeline import Timeline


def staged(
    engine: DataFrame,
    features: Iterable[str],
    k: int = 10,
    reconnaissance_terms: Iterable[str] = RECONNAISSANCE_TERMS,
    command_terms: Iterable[str] = COMMAND_TERMS,
) -> DataFrame:
    """Engine rows with the attack stage judged from their ``k`` most deviating features."""
    text = top_feature_text(F.col("errors"), list(features), k)
    return attack_stage(
        engine, text, reconnaissance_terms=reconnaissance_terms, command_terms=command_terms
    )


def snapshot_table(
    engine: DataFrame, states: DataFrame, tl: Timeline, features: Iterable[str], k: int = 10, **terms
) -> DataFrame:
    """State, error, forecast, top features and stage of every bucket, joined once for all times."""
    features = list(features)
    joined = engine.drop(RATIO).join(states.select(*tl.id, FLOW_COUNT, RATIO), tl.id)
    return with_top_feature(staged(joined, features, k, **terms), features).withColumn(
        "top_features", top_feature_text(F.col("errors"), features, k)
    )


def at(table: DataFrame, tl: Timeline, moment: str) -> DataFrame:
    """Rows of one bucket; an error when there are none."""
    rows = table.filter(F.col(tl.time) == F.lit(moment).cast("timestamp"))
    return require_rows(rows, f"{tl.time} = {moment}")


def risk_events(engine: DataFrame, *levels: str) -> DataFrame:
    """Rows whose overall level is one of the given ones (HIGH by default)."""
    return engine.filter(F.col("forecast_state").isin(*(levels or ("HIGH",))))


def enriched_timeline(
    engine: DataFrame, scores: DataFrame, states: DataFrame, tl: Timeline
) -> DataFrame:
    """Forecast levels with the errors and state columns of the same buckets, where there are any."""
    return (
        engine.select(*tl.id, "forecast_state", "forecast_score")
        .join(scores.select(*tl.id, "mse", "mae"), tl.id, "left")
        .join(states.select(*tl.id, FLOW_COUNT, RATIO), tl.id, "left")
    )


def forecast_summary(engine: DataFrame, tl: Timeline) -> DataFrame:
    """Counts per level, mean and maximum score, and the first bucket with the maximum."""
    state = F.col("forecast_state")
    first_peak = F.struct(F.col("forecast_score"), -F.unix_timestamp(tl.time))
    return engine.agg(
        F.count(F.lit(1)).alias("states"),
        F.count_if(state == "LOW").alias("low"),
        F.count_if(state == "MEDIUM").alias("medium"),
        F.count_if(state == "HIGH").alias("high"),
        F.avg("forecast_score").alias("mean_score"),
        F.max("forecast_score").alias("max_score"),
        F.max_by(F.col(tl.time), first_peak).alias("highest_score_time"),
        F.max_by("forecast_state", first_peak).alias("highest_score_state"),
    )
