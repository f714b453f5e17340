"""Versioned parameters under a running stream: a new version takes effect without a restart.

A version is a folder of a table partitioned by ``version``. Every micro-batch looks up the newest version, applies it and
names it on every row. The version is recorded before the results are written, so a micro-batch that is repeated after a
failure uses the one it used before and overwrites its own output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portentia.functions.rows import with_row

Apply = Callable[[DataFrame, DataFrame], DataFrame]


def save_version(parameters: DataFrame, path: str, version: int) -> None:
    """Store parameters as a version of their own; earlier ones stay."""
    parameters.write.mode("overwrite").parquet(f"{path}/version={version}")


def newest_version(spark: SparkSession, path: str) -> int:
    """The highest version stored; an error if there is none."""
    found = spark.read.parquet(path).agg(F.max("version")).first()[0]
    if found is None:
        raise LookupError(f"no parameters below {path}")
    return int(found)


def load_version(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{path}/version={version}")


def _recorded(spark: SparkSession, path: str) -> int | None:
    try:
        row = spark.read.schema("version int").parquet(path).first()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return None if row is None else row["version"]


def run_versioned(stream: DataFrame, parameters: str, path: str, work: str, apply: Apply) -> None:
    """``apply(rows, parameters)`` on what is available now, with ``parameter_version`` added to every result."""

    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        record = f"{work}/versions/batch={batch_id}"
        version = _recorded(spark, record)
        if version is None:
            version = newest_version(spark, parameters)
            spark.range(1).select(F.lit(version).alias("version")).write.mode("overwrite").parquet(record)
        out = apply(batch, load_version(spark, parameters, version))
        out.withColumn("parameter_version", F.lit(version)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    query = (
        stream.writeStream.foreachBatch(process).option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()


def above_thresholds(rows: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Flags of errors above the percentiles (p95, p99) of a one-row parameter table."""
    judged = with_row(rows, thresholds.select("p95", "p99"))
    return judged.select(
        *rows.columns, (F.col("mse") > F.col("p95")).cast("int").alias("above_95"), (F.col("mse") > F.col("p99")).cast("int").alias("above_99")
    )
