"""Attaching a one-row table (thresholds, medians, a scaler) to every row of another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Add the columns of a one-row table as a scalar subquery: evaluated once, no join.

    A table with more than one row fails at run time; an empty one gives nulls.
    """
    names = row.columns
    value = row.select(F.struct(*names).alias("v")).scalar()
    return df.withColumn("__row", value).select(
        *df.columns, *[F.col(f"__row.`{n}`").alias(n) for n in names]
    )


def same_keys(df: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on key columns by null-safe equality: a null key is a key like any other.

    Every operator that joins on series keys or classes goes by this rule, as grouping and windows do.
    """
    side = other.withColumnsRenamed({k: f"__k_{k}" for k in keys})
    on = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"__k_{k}"))
        on = one if on is None else on & one
    return df.join(side, on, how).drop(*[f"__k_{k}" for k in keys])
