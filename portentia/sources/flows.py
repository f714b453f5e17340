"""Reading raw flow logs and turning their text into typed, clean rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from portentia.functions.columns import (
    finite,
    is_header_text,
    parse_day_first,
    to_finite_number,
)

TIME_COLUMNS = ("time_window", "source_time", "target_time")


def read_csv(spark: SparkSession, path: str | list[str], columns: Iterable[str]) -> DataFrame:
    """Header CSV as text columns. The schema is given, so the file is not read to infer it."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return strip_columns(spark.read.schema(schema).option("header", True).csv(path))


def csv_columns(spark: SparkSession, path: str) -> list[str]:
    """Header names of a CSV data set (reads one line)."""
    return spark.read.option("header", True).csv(path).columns


def read_split_csv(
    spark: SparkSession, parts: dict[str, str], columns: Iterable[str]
) -> DataFrame:
    """Several CSV data sets as one, with the name of each part in ``split``."""
    columns = list(columns)
    frames = [
        read_csv(spark, path, columns).withColumn("split", F.lit(name))
        for name, path in parts.items()
    ]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def strip_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def parse_times(df: DataFrame, columns: Iterable[str] = TIME_COLUMNS) -> DataFrame:
    """Parse whichever of the known time columns are present."""
    present = {
        c: F.col(c).try_cast("timestamp") for c in columns if c in df.columns
    }
    return df.withColumns(present) if present else df


def feature_columns(df: DataFrame, exclude: Iterable[str], numeric_only: bool = False) -> list[str]:
    """Ordered feature list: every column that is not excluded."""
    skip = set(exclude)
    return [
        f.name
        for f in df.schema.fields
        if f.name not in skip
        and (not numeric_only or isinstance(f.dataType, T.NumericType))
    ]


def require_columns(df: DataFrame, columns: Iterable[str]) -> None:
    """Schema check, before any job or stream starts."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """For API edges only: fail when a result is empty."""
    if df.isEmpty():
        raise LookupError(f"no rows: {what}")
    return df


def clean_flows(
    raw: DataFrame,
    features: Iterable[str],
    time: str = "Timestamp",
    label: str = "Label",
    passthrough: Iterable[str] = (),
    out_time: str = "ts",
) -> DataFrame:
    """Drop stray header rows and rows without a valid time; coerce features to finite doubles."""
    features = list(features)
    require_columns(raw, [time, label, *features, *passthrough])
    return (
        raw.filter(~is_header_text(label, label))
        .select(
            *passthrough,
            parse_day_first(time).alias(out_time),
            F.col(label),
            *[to_finite_number(c).alias(c) for c in features],
        )
        .filter(F.col(out_time).isNotNull())
    )


def with_features(
    df: DataFrame, features: Iterable[str], defaults: dict[str, float | None]
) -> DataFrame:
    """Fixed feature order; an absent feature is filled with its stored default."""
    features = list(features)
    others = [c for c in df.columns if c not in features]
    return df.select(
        *others,
        *[
            F.col(c).cast("double").alias(c)
            if c in df.columns
            else F.lit(defaults.get(c)).cast("double").alias(c)
            for c in features
        ],
    )


def finite_features(df: DataFrame, features: Iterable[str]) -> DataFrame:
    return df.withColumns({c: finite(F.col(c).cast("double")) for c in features})


def in_time_range(
    df: DataFrame, start: str, end: str, time: str = "time_window", closed: bool = False
) -> DataFrame:
    """Rows with ``start <= time < end`` (or ``<= end`` when closed).

    The bounds take the type of the column, so the comparison reaches the scan.
    """
    t = F.col(time)
    kind = df.schema[time].dataType
    lower, upper = F.lit(start).cast(kind), F.lit(end).cast(kind)
    return df.filter((t >= lower) & ((t <= upper) if closed else (t < upper)))


def first_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """Deterministic row-limited read: a top-n by the given order."""
    return df.orderBy(*order).limit(n)
