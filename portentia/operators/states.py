"""Flows to fixed-width states, with median imputation inside the aggregate."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portentia.functions.columns import finite, matches_label
from portentia.functions.rows import with_row
from portentia.operators.quantiles import approximate_quantiles, exact_quantiles
from portentia.timeline import Timeline

FLOW_COUNT = "flow_count"
RATIO = "label_ratio"
POSITIVE = "is_positive"


def feature_medians(
    df: DataFrame, features: Iterable[str], exact: bool = True, where: Column | None = None
) -> DataFrame:
    """Median per feature as rows (feature, median) over its finite values.

    Exact medians read the flows twice (a sketch, then the counts around it); ``exact=False`` reads them once.
    """
    features = list(features)
    if where is not None:
        df = df.withColumns({c: F.when(where, F.col(c)) for c in features})
    fit = exact_quantiles if exact else approximate_quantiles
    return fit(df, features, [0.5]).select("feature", F.col("quantile").alias("median"))


def median_row(medians: DataFrame, features: Iterable[str], prefix: str = "__median_") -> DataFrame:
    """The median table as one row, one column per feature."""
    return medians.agg(
        *[
            F.max(F.when(F.col("feature") == c, F.col("median"))).alias(prefix + c)
            for c in features
        ]
    )


def state_aggregates(
    features: list[str], label: str, positive: str, fill: dict[str, Column] | None
) -> list[Column]:
    """Aggregates of one bucket. A missing, NaN or infinite value counts as its fill value, or not at all."""
    aggs = [F.count(F.lit(1)).alias(FLOW_COUNT), F.avg(matches_label(label, positive)).alias(RATIO)]
    for c in features:
        # A sum per feature keeps a wide aggregate within what Spark compiles as one stage.
        own = finite(F.col(c).cast("double"))
        value = F.avg(own) if fill is None else F.sum(F.coalesce(own, fill[c])) / F.count(F.lit(1))
        aggs.append(value.alias(c))
    return aggs


def literal_fill(features: list[str], medians: dict[str, float]) -> dict[str, Column]:
    return {c: F.lit(medians.get(c)).cast("double") for c in features}


def state_columns(
    id_columns: list[str], features: list[str], ratio_threshold: float
) -> list[Column]:
    """The output columns of a state table, with the positive flag."""
    flag = (F.col(RATIO) > F.lit(ratio_threshold)).cast("int").alias(POSITIVE)
    return [*[F.col(c) for c in (*id_columns, *features, FLOW_COUNT, RATIO)], flag]


def build_states(
    flows: DataFrame,
    features: Iterable[str],
    tl: Timeline,
    label: str,
    positive: str,
    time: str = "ts",
    ratio_threshold: float = 0.0,
    medians: DataFrame | dict[str, float] | None = None,
) -> DataFrame:
    """One row per (keys, bucket): feature means, flow count, positive ratio and flag.

    With ``medians`` a missing value counts as the feature's median. The medians enter the aggregate
    as one scalar row, so the flows are read once for the states and joined with nothing. Map-side
    partial aggregation absorbs hot buckets.
    """
    features = list(features)
    fill = None
    if isinstance(medians, dict):
        fill = literal_fill(features, medians)
    elif medians is not None:
        flows = with_row(flows, median_row(medians, features))
        fill = {c: F.col(f"__median_{c}") for c in features}
    return (
        flows.groupBy(*tl.keys, tl.floor(time).alias(tl.time))
        .agg(*state_aggregates(features, label, positive, fill))
        .select(*state_columns(tl.id, features, ratio_threshold))
    )


def fill_medians(df: DataFrame, features: Iterable[str], medians: DataFrame, last: float | None = None) -> DataFrame:
    """Replace missing feature values with their median, then with ``last`` if given."""
    features = list(features)
    filled = with_row(df, median_row(medians, features))
    out = {}
    for c in features:
        options = [finite(F.col(c).cast("double")), F.col(f"__median_{c}")]
        if last is not None:
            options.append(F.lit(last))
        out[c] = F.coalesce(*options)
    return filled.withColumns(out).drop(*[f"__median_{c}" for c in features])


def fill_normal_medians(states: DataFrame, features: Iterable[str]) -> DataFrame:
    """Fill from the medians of non-positive rows, then 0."""
    features = list(features)
    medians = feature_medians(states, features, where=F.col(POSITIVE) == 0)
    return fill_medians(states, features, medians, last=0.0)


def fill_zero(df: DataFrame, features: Iterable[str]) -> DataFrame:
    """Missing, NaN and infinite values become 0."""
    return df.withColumns(
        {c: F.coalesce(finite(F.col(c).cast("double")), F.lit(0.0)) for c in features}
    )
