"""Session settings and the shared folder that intermediate tables are written to."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

Result = TypeVar("Result")

_local_base: str | None = None


def session(app: str = "portentia", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on (UTC, AQE on).

    State tables are wide: the field limit of code generation is raised above twice their width.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.codegen.maxFields", "500")
    )
    if master:
        builder = builder.master(master)
    for name, value in conf.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_base(spark: SparkSession) -> str:
    """The cluster's shared folder, as ``spark.checkpoint.dir`` names it.

    A temporary folder of this machine serves only a session that runs in one process (master ``local``): executors on
    other machines would each write to a disk of their own, so a cluster without the setting is refused.
    """
    global _local_base
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_base is None:
        _local_base = tempfile.mkdtemp(prefix="portentia-")
    return _local_base


def run_dir(spark: SparkSession, name: str = "run") -> str:
    """A fresh folder below the shared base."""
    return f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str = "stage", **options: object) -> DataFrame:
    """Write an intermediate table (with options of Spark's writer) and read it back.

    Used where a result that is small next to its input (states next to flows) has several
    consumers: the input is then scanned once, later branches read only the columns they need,
    and a lost executor re-reads the table instead of repeating the lineage.
    """
    spark = df.sparkSession
    path = run_dir(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_parallel(spark: SparkSession, jobs: Iterable[Callable[[], Result]], at_once: int = 6) -> list[Result]:
    """Results of independent driver functions, each of which runs Spark jobs, in order.

    Fits made of hundreds of small jobs leave most of a cluster idle; several of them at a time fill it.
    """
    with ThreadPoolExecutor(at_once) as pool:
        started = [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]
        return [s.result() for s in started]
