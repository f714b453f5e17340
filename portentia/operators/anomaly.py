"""Thresholds, rolling anomaly features and score statistics."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from portentia.functions.rows import same_keys, with_row
from portentia.operators.quantiles import exact_quantiles, one_row
from portentia.operators.states import POSITIVE
from portentia.timeline import Timeline, over_blocks

# Fixed value: keeps the ratio to the rolling median defined when the median is 0.
RATIO_EPSILON = 1e-6


def percentile_name(p: float) -> str:
    return f"p{round(p * 100)}"


def baseline_thresholds(
    scores: DataFrame,
    baseline: Column | None = None,
    probs: Iterable[float] = (0.90, 0.95, 0.99),
    value: str = "mse",
) -> DataFrame:
    """One row with the exact percentiles of a score over the baseline rows."""
    probs = list(probs)
    rows = scores if baseline is None else scores.filter(baseline)
    long = exact_quantiles(rows, [value], probs)
    return one_row(long, {(value, p): percentile_name(p) for p in probs})


def anomaly_features(scores: DataFrame, tl: Timeline, thresholds: DataFrame) -> DataFrame:
    """Rolling statistics of the prediction error; frames count rows and do cross gaps."""
    mse = F.col("mse")
    flagged = with_row(scores, thresholds).withColumns(
        {
            "above_95": F.coalesce((mse > F.col("p95")).cast("int"), F.lit(0)),
            "above_99": F.coalesce((mse > F.col("p99")).cast("int"), F.lit(0)),
        }
    )

    def build(w: WindowSpec) -> dict[str, Column]:
        def last(n: int) -> WindowSpec:
            return w.rowsBetween(-(n - 1), 0)

        median = F.when(
            F.count("mse").over(last(10)) >= 3, F.percentile(mse, 0.5).over(last(10))
        )
        return {
            "rolling_3": F.avg("mse").over(last(3)),
            "rolling_5": F.avg("mse").over(last(5)),
            "rolling_10": F.avg("mse").over(last(10)),
            "max_5": F.max("mse").over(last(5)),
            "max_10": F.max("mse").over(last(10)),
            "change_1": mse - F.lag("mse", 1).over(w),
            "change_3": mse - F.lag("mse", 3).over(w),
            "ratio_10": mse / (median + F.lit(RATIO_EPSILON)),
            "above95_count_5": F.sum("above_95").over(last(5)),
            "above95_count_10": F.sum("above_95").over(last(10)),
        }

    return over_blocks(flagged, tl, build, before=9, rows=True)


def forecast_dataset(features: DataFrame, targets: DataFrame, tl: Timeline, columns: Iterable[str]) -> DataFrame:
    """Anomaly features joined with the targets of the same bucket."""
    return features.join(targets.select(*tl.id, *columns), tl.id, "inner")


def describe_scores(
    scores: DataFrame, value: str = "mse", by: str | None = None
) -> DataFrame:
    """Count, mean, sample deviation, min, quartiles, max; overall or per class."""
    keys = [by] if by else []
    basic = (scores.groupBy(*keys) if keys else scores).agg(
        F.count(value).alias("count"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    quartiles = exact_quantiles(scores, [value], [0.25, 0.5, 0.75], by=keys)
    spread = (quartiles.groupBy(*keys) if keys else quartiles).agg(
        *[
            F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(name)
            for p, name in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))
        ]
    )
    joined = same_keys(basic, spread, keys) if keys else with_row(basic, spread)
    return joined.select(*keys, "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def detection_rates(
    scores: DataFrame, thresholds: DataFrame, names: Iterable[str] = ("p90", "p95", "p99")
) -> DataFrame:
    """Share of rows above each threshold, per class."""
    names = list(names)
    return (
        with_row(scores, thresholds)
        .groupBy(POSITIVE)
        .agg(
            F.count(F.lit(1)).alias("states"),
            *[F.avg((F.col("mse") > F.col(n)).cast("double")).alias(f"rate_{n}") for n in names],
        )
    )


def score_summary(scores: DataFrame, tl: Timeline) -> DataFrame:
    """Rows, mean and maximum error, and the first time the maximum was reached."""
    peak = F.max_by(F.col(tl.time), F.struct(F.col("mse"), -F.unix_timestamp(tl.time)))
    return scores.agg(
        F.count(F.lit(1)).alias("states_analyzed"),
        F.avg("mse").alias("mean_mse"),
        F.max("mse").alias("max_mse"),
        F.avg("mae").alias("mean_mae"),
        peak.alias("highest_anomaly_time"),
    )
