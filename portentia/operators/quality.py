"""Data-quality counts and table comparison."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portentia.functions.columns import to_number


def missing_check(raw: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Per text column: rows, originally missing, missing after conversion, non-numeric. One pass."""
    columns = list(columns)

    def absent(c: str) -> Column:
        text = F.trim(F.col(c))
        return text.isNull() | (text == "") | (F.lower(text) == "nan")

    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, c in enumerate(columns):
        number = to_number(c)
        gone = number.isNull() | F.isnan(number)
        aggs += [
            F.count_if(absent(c)).alias(f"__m{i}"),
            F.count_if(gone).alias(f"__a{i}"),
            F.count_if(gone & ~absent(c)).alias(f"__x{i}"),
        ]
    return raw.agg(*aggs).select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("feature"),
                        F.col("__rows").alias("rows"),
                        F.col(f"__m{i}").alias("originally_missing"),
                        F.col(f"__a{i}").alias("missing_after_conversion"),
                        F.col(f"__x{i}").alias("non_numeric"),
                    )
                    for i, c in enumerate(columns)
                ]
            )
        )
    )


def compare_tables(
    a: DataFrame, b: DataFrame, on: Iterable[str], columns: Iterable[str], tolerance: float = 1e-6
) -> DataFrame:
    """Per column: compared rows, maximum and mean absolute difference, mismatches."""
    on, columns = list(on), list(columns)
    left = a.select(*on, *[F.col(c).alias(f"{c}_a") for c in columns])
    right = b.select(*on, *[F.col(c).alias(f"{c}_b") for c in columns])
    joined = left.join(right, on)
    aggs = []
    for i, c in enumerate(columns):
        difference = F.abs(F.col(f"{c}_a").cast("double") - F.col(f"{c}_b").cast("double"))
        aggs += [
            F.count(difference).alias(f"__n{i}"),
            F.max(difference).alias(f"__max{i}"),
            F.avg(difference).alias(f"__avg{i}"),
            F.count_if(difference > tolerance).alias(f"__bad{i}"),
        ]
    return joined.agg(*aggs).select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("feature"),
                        F.col(f"__n{i}").alias("rows"),
                        F.col(f"__max{i}").alias("max_difference"),
                        F.col(f"__avg{i}").alias("mean_difference"),
                        F.col(f"__bad{i}").alias("mismatches"),
                    )
                    for i, c in enumerate(columns)
                ]
            )
        )
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, nulls included."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("rows"))


def crosstab(df: DataFrame, row: Column, name: str, column: str, values: Iterable[str]) -> DataFrame:
    """Counts of ``column`` values per ``row`` value. The values are given, so one job is enough."""
    values = list(values)
    return (
        df.withColumn(name, row)
        .groupBy(name)
        .agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])
    )


def time_extent(df: DataFrame, time: str) -> DataFrame:
    return df.agg(
        F.min(time).alias("first_time"),
        F.max(time).alias("last_time"),
        F.count_if(F.col(time).isNull()).alias("invalid_times"),
        F.count(F.lit(1)).alias("rows"),
    )


def label_extent(df: DataFrame, time: str, positive: Column, benign: Column) -> DataFrame:
    """First positive time, last benign time, number of positive rows."""
    return df.agg(
        F.min(F.when(positive, F.col(time))).alias("first_positive"),
        F.max(F.when(benign, F.col(time))).alias("last_benign"),
        F.count_if(positive).alias("positive_rows"),
    )
