"""Table sinks and the store of fitted parameters (medians, scalers, coefficients, models)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, time: str | None = "time_window", replace: str = "table") -> None:
    """Parquet partitioned by calendar date, so that time ranges prune files.

    The rows of a date go to as many files as their size asks for: adaptive execution splits and joins them.
    ``replace="dates"`` rewrites only the dates that occur in ``df`` and leaves the others as they are.
    """
    if replace not in ("table", "dates"):
        raise ValueError(f"unknown replace: {replace}")
    if time is None:
        df.write.mode("overwrite").parquet(path)
        return
    (
        df.withColumn("date", F.to_date(time))
        .hint("rebalance", F.col("date"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic" if replace == "dates" else "static")
        .partitionBy("date")
        .parquet(path)
    )


def read_table(
    spark: SparkSession,
    path: str,
    start: str | None = None,
    end: str | None = None,
    time: str = "time_window",
) -> DataFrame:
    """Read a dated table; a time range also prunes date partitions."""
    df = spark.read.parquet(path)
    for bound, after in ((start, True), (end, False)):
        if bound is None:
            continue
        limit = F.lit(bound).cast("timestamp")
        if after:
            df = df.filter((F.col("date") >= F.to_date(limit)) & (F.col(time) >= limit))
        else:
            df = df.filter((F.col("date") <= F.to_date(limit)) & (F.col(time) < limit))
    return df


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def save_parameters(df: DataFrame, path: str) -> None:
    """A small fitted table: one row per feature (and key, if any)."""
    df.write.mode("overwrite").parquet(path)


def load_parameters(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_weights(spark: SparkSession, weights: np.ndarray, path: str) -> None:
    """The matrix of a linear next-state model, one row per matrix row; its size depends on the features only."""
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(weights)]
    spark.createDataFrame(rows, "i int, row array<double>").write.mode("overwrite").parquet(path)


def load_weights(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.parquet(path).orderBy("i").collect()
    return np.array([r["row"] for r in rows])


def as_dict(params: DataFrame, name: str, value: str) -> dict[str, float | None]:
    """A parameter table as a dict. Its size is the number of features, not of rows."""
    return {r[name]: r[value] for r in params.select(name, value).collect()}
