"""Live path: flows to states, states to next-state errors, errors to rolling risk.

States and scores are declarative windowed aggregates, so late data, recovery and state size are
governed by the watermark. The rolling risk looks back over *rows*; it runs per micro-batch on the
batch operator, with the last rows of every key carried along in a small table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from portentia.functions.vectors import arg_max_name
from portentia.operators.prediction import error_metrics
from portentia.operators.risk import LIVE_BASELINE_ROWS, live_forecast
from portentia.operators.states import (
    FLOW_COUNT,
    POSITIVE,
    RATIO,
    build_states,
    literal_fill,
    state_aggregates,
    state_columns,
)
from portentia.runtime import stage
from portentia.sources.flows import require_columns
from portentia.timeline import Timeline

_BUCKET = "__bucket"


def _seconds(n: int) -> str:
    return f"{n} seconds"


def stream_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A folder of Parquet files as a stream; each run takes everything that is new."""
    return spark.readStream.schema(schema).parquet(path)


def run_available(
    stream: DataFrame, path: str, checkpoint: str, mode: str = "append"
) -> None:
    """Process what is available now, appending to a Parquet table; then stop."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def _closed_states(
    flows: DataFrame,
    features: list[str],
    tl: Timeline,
    label: str,
    positive: str,
    time: str,
    ratio_threshold: float,
    medians: dict[str, float] | None,
    delay: str,
) -> DataFrame:
    require_columns(flows, [*tl.keys, time, label, *features])
    fill = None if medians is None else literal_fill(features, medians)
    return (
        flows.withWatermark(time, delay)
        .groupBy(*tl.keys, F.window(time, _seconds(tl.bucket_seconds)).alias(_BUCKET))
        .agg(*state_aggregates(features, label, positive, fill))
    )


def stream_states(
    flows: DataFrame,
    features: Iterable[str],
    tl: Timeline,
    label: str,
    positive: str,
    time: str = "ts",
    ratio_threshold: float = 0.0,
    medians: dict[str, float] | None = None,
    delay: str = "0 seconds",
) -> DataFrame:
    """States of closed buckets. Rows for a bucket that is already closed are dropped.

    A bucket closes when the watermark (latest event time minus ``delay``, advanced after every
    micro-batch and shared by all keys) passes its end. ``medians`` is the stored fill table.
    """
    features = list(features)
    states = _closed_states(
        flows, features, tl, label, positive, time, ratio_threshold, medians, delay
    )
    return states.withColumn(tl.time, F.col(f"{_BUCKET}.start")).select(
        *state_columns(tl.id, features, ratio_threshold)
    )


def stream_attack_periods(
    flows: DataFrame,
    tl: Timeline,
    label: str,
    positive: str,
    time: str = "ts",
    ratio_threshold: float = 0.0,
    delay: str = "0 seconds",
) -> DataFrame:
    """Maximal gap-free runs of positive states, each as soon as it can grow no more: start, end, duration in buckets.

    Closed positive states form sessions of their key: neighbouring buckets lie one bucket apart, so a gap of one and a
    half keeps a run together and ends it. The watermark closes sessions; a key's state is its open run.
    """
    states = _closed_states(flows, [], tl, label, positive, time, ratio_threshold, None, delay)
    rows = states.filter(F.col(RATIO) > F.lit(ratio_threshold)).select(
        *tl.keys, F.window_time(_BUCKET).alias("__at"), F.col(f"{_BUCKET}.start").alias(tl.time)
    )
    run = F.session_window("__at", _seconds(tl.bucket_seconds + max(tl.bucket_seconds // 2, 1)))
    keys = list(tl.keys) or ["__all"]  # sessions need a key
    return rows.withColumns({} if tl.keys else {"__all": F.lit(0)}).groupBy(*keys, run.alias("__run")).agg(
        F.min(tl.time).alias("start"), F.max(tl.time).alias("end"), F.count(F.lit(1)).alias("duration")
    ).drop("__run", "__all")


def flush(
    flows: DataFrame,
    closed: DataFrame,
    features: Iterable[str],
    tl: Timeline,
    label: str,
    positive: str,
    time: str = "ts",
    ratio_threshold: float = 0.0,
    medians: dict[str, float] | None = None,
) -> DataFrame:
    """States of the buckets that are still open at the end of a finite stream.

    The last closed bucket is read first (one value), so the bound is a literal of the column's own type and reaches the
    scan of the flows: only what is open is read again.
    """
    # The watermark is global, so everything after the last closed bucket is open.
    last = closed.agg(F.max(F.unix_timestamp(tl.time))).first()[0]
    tail = flows
    if last is not None:
        start = F.timestamp_seconds(F.lit(last + tl.bucket_seconds)).cast(flows.schema[time].dataType)
        tail = flows.filter(F.col(time) >= start)
    return build_states(
        tail, features, tl, label, positive, time, ratio_threshold, medians
    )


def stream_scores(
    flows: DataFrame,
    features: Iterable[str],
    tl: Timeline,
    label: str,
    positive: str,
    scaler: dict[str, tuple[float, float]],
    time: str = "ts",
    ratio_threshold: float = 0.0,
    medians: dict[str, float] | None = None,
    delay: str = "0 seconds",
    length: int = 10,
) -> DataFrame:
    """Next-state errors of a stream, with the moving-average predictor.

    The ``length`` input states and their target are one sliding window of ``length + 1`` buckets.
    Buckets are distinct, so the window is gap-free exactly when it holds ``length + 1`` states; the
    prediction is the mean of all but the last. No state is kept per key: windows of one key spread
    over all tasks, and a pending prediction is simply a window that has not closed yet.

    ``features`` are flow features; the flow count of the bucket is scored as the last one.
    ``scaler`` maps each of them to (mean, std).
    """
    flow_features = list(features)
    features = [*flow_features, FLOW_COUNT]
    bucket = tl.bucket_seconds
    states = _closed_states(
        flows, flow_features, tl, label, positive, time, ratio_threshold, medians, delay
    )
    flag = (F.col(RATIO) > F.lit(ratio_threshold)).cast("int")
    rows = states.select(
        *tl.keys,
        F.window_time(_BUCKET).alias("__at"),
        F.col(f"{_BUCKET}.start").alias(tl.time),
        *[F.col(c).cast("double").alias(c) for c in features],
        RATIO,
        flag.alias(POSITIVE),
    ).withColumn("__span", F.window("__at", _seconds((length + 1) * bucket), _seconds(bucket)))
    target_start = tl.shift(F.col("__span.end"), -1)
    is_target = F.col(tl.time) == target_start

    def at_target(c: str) -> Column:
        return F.max(F.when(is_target, F.col(c)))

    windows = rows.groupBy(*tl.keys, "__span").agg(
        F.count(F.lit(1)).alias("__states"),
        at_target(POSITIVE).alias(POSITIVE),
        at_target(RATIO).alias(RATIO),
        *[
            x
            for c in features
            for x in (
                F.avg(F.when(~is_target, F.col(c))).alias(f"__p_{c}"),
                at_target(c).alias(c),
            )
        ],
    )
    errors = F.array(
        *[F.abs((F.col(c) - F.col(f"__p_{c}")) / F.lit(scaler[c][1])) for c in features]
    )
    scored = windows.filter(F.col("__states") == length + 1).select(
        *tl.keys,
        target_start.alias(tl.time),
        tl.shift(F.col("__span.end"), -2).alias("source_time"),
        POSITIVE,
        RATIO,
        F.inline(F.array(error_metrics(errors))),
    )
    return scored.withColumns(
        {
            "top_feature": arg_max_name(F.col("errors"), features),
            "top_feature_error": F.array_max("errors"),
        }
    )


def run_live_forecast(
    scores: DataFrame, tl: Timeline, path: str, work: str
) -> None:
    """Rolling risk for every new error row of a score stream; process what is available.

    Every micro-batch is judged together with the last rows of each key from before it. Results and
    carried rows are written per batch id, so a repeated batch overwrites its own output.
    """
    process = forecast_batch(tl, path, f"{work}/carry")
    query = (
        scores.filter(F.col("mse").isNotNull() & F.col(tl.time).isNotNull())
        .writeStream.foreachBatch(process)
        .option("checkpointLocation", f"{work}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def forecast_batch(
    tl: Timeline, path: str, carry: str, history: int = LIVE_BASELINE_ROWS
) -> Callable[[DataFrame, int], None]:
    """The micro-batch step of :func:`run_live_forecast`."""

    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("__new", F.lit(True))
        if batch_id > 0:
            earlier = spark.read.schema(batch.schema).parquet(f"{carry}/batch={batch_id - 1}")
            rows = rows.unionByName(earlier.withColumn("__new", F.lit(False)))
        rows = stage(rows, "live")
        live_forecast(rows, tl).filter("__new").drop("__new").write.mode("overwrite").parquet(
            f"{path}/batch={batch_id}"
        )
        # Spark limits each task to `history` rows per key before this shuffle.
        latest = (
            Window.partitionBy(*tl.keys) if tl.keys else Window.partitionBy(F.lit(0))
        ).orderBy(F.col(tl.time).desc())
        (
            rows.withColumn("__age", F.row_number().over(latest))
            .filter(F.col("__age") <= history)
            .drop("__age", "__new")
            .write.mode("overwrite")
            .parquet(f"{carry}/batch={batch_id}")
        )

    return process


def latest_row(table: DataFrame, tl: Timeline) -> DataFrame:
    """The newest row of every key."""
    row = F.struct(*[F.col(c) for c in table.columns if c not in tl.keys])
    return table.groupBy(*tl.keys).agg(F.max_by(row, tl.time).alias("r")).select(*tl.keys, "r.*")
