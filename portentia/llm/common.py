"""Shared pieces of the text operators: inputs, partition counts, connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portentia.runtime import stage

#: Text that one task of a rebuilt partitioning should hold.
TASK_BYTES = 24 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table. Texts are large rows: fewer of them go to Python at a time than Spark's default."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def keyed_text(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the key and the text, under fixed names, whatever other columns the table has."""
    return df.select(df[key].cast("long").alias("doc_id"), df[text].cast("string").alias("text"))


def partitions(df: DataFrame, per_task: int = TASK_BYTES, text: str = "text") -> int:
    """How many partitions the bytes of a text column need (one pass over that column)."""
    total = df.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    return max(df.sparkSession.sparkContext.defaultParallelism, total // per_task + 1)


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of undirected links (a, b): one row (node, component), component the smallest node.

    Alternating large-star and small-star steps on DataFrames; every round is written to the shared folder,
    which cuts the lineage, and the rounds end when the links stop changing (after about log n of them). Neighbour
    sets are never gathered: each step needs only the minimum of a node's neighbours, a partially aggregated value,
    joined back to the links.
    """
    edges = stage(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "links"
    )
    seen = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
            .alias("e")
        )
        edges = stage(small.select("e.u", "e.v").where("u != v").distinct(), "links")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.groupBy("u").agg(F.min("v").alias("v")).select(
        F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), "v"))).alias("e")
    ).select(F.col("e.u").alias("node"), F.col("e.v").alias("component")).distinct()
