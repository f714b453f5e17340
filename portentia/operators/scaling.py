"""Per-feature mean and population deviation, and z-scaling with them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portentia.functions.columns import finite
from portentia.functions.rows import with_row
from portentia.operators.sequences import normal_coverage
from portentia.timeline import Timeline


def fit_scaler(
    states: DataFrame,
    features: Iterable[str],
    tl: Timeline | None = None,
    fit_rows: str = "normal_windows",
    length: int = 10,
) -> DataFrame:
    """One row with ``mean_<f>`` and ``std_<f>``; a constant feature gets deviation 1.

    ``fit_rows="normal_windows"`` fits on rows inside gap-free all-normal sequences;
    ``"all"`` uses every row. Deviations are population deviations.
    """
    features = list(features)
    if fit_rows == "normal_windows":
        states = normal_coverage(states, tl, length).filter(F.col("covered") == 1)
    elif fit_rows != "all":
        raise ValueError(f"unknown fit_rows: {fit_rows}")
    aggs: list[Column] = []
    for c in features:
        own = finite(F.col(c).cast("double"))
        std = F.stddev_pop(own)
        aggs.append(F.avg(own).alias(f"mean_{c}"))
        aggs.append(F.when(std == 0, F.lit(1.0)).otherwise(std).alias(f"std_{c}"))
    return states.agg(*aggs)


def scaler_table(scaler: DataFrame, features: Iterable[str]) -> DataFrame:
    """The one-row scaler as rows (feature, pos, mean, std)."""
    entries = [
        F.struct(
            F.lit(c).alias("feature"),
            F.lit(i).alias("pos"),
            F.col(f"mean_{c}").alias("mean"),
            F.col(f"std_{c}").alias("std"),
        )
        for i, c in enumerate(features)
    ]
    return scaler.select(F.inline(F.array(*entries)))


def scaler_row(table: DataFrame) -> DataFrame:
    """The inverse of :func:`scaler_table`, for a scaler loaded from the parameter store.

    The table holds one row per feature, so reading it to the driver is bounded by the schema.
    """
    rows = table.orderBy("pos").collect()
    spark = table.sparkSession
    return spark.range(1).select(
        *[
            F.lit(r[kind]).cast("double").alias(f"{kind}_{r['feature']}")
            for r in rows
            for kind in ("mean", "std")
        ]
    )


def with_scaler(df: DataFrame, scaler: DataFrame) -> DataFrame:
    """Attach the one-row scaler to every row."""
    return with_row(df, scaler)


def scaled(c: str) -> Column:
    return (F.col(c) - F.col(f"mean_{c}")) / F.col(f"std_{c}")


def scale_states(df: DataFrame, features: Iterable[str], scaler: DataFrame) -> DataFrame:
    features = list(features)
    out = with_scaler(df, scaler)
    return out.withColumns({c: scaled(c) for c in features}).select(*df.columns)


def unscale_states(df: DataFrame, features: Iterable[str], scaler: DataFrame) -> DataFrame:
    features = list(features)
    out = with_scaler(df, scaler)
    return out.withColumns(
        {c: F.col(c) * F.col(f"std_{c}") + F.col(f"mean_{c}") for c in features}
    ).select(*df.columns)
