"""State kept per key: buckets with a watermark of their own, and the last vectors and errors of each series.

Three things a shared watermark cannot do. Buckets close by the event time of their own key, so a slow sensor loses
nothing to a fast one; a key that falls silent gives up its open buckets by a timer, without a second read of the flows;
and a score needs the last vectors of its key only, so every state is read once, instead of once per sliding window it
lies in, and only keys with new rows write anything.

Flows are added up per (key, bucket) within every Arrow batch before the shuffle, so a key with a third of the flows
sends a few rows a batch to its task, and its state is a few open buckets.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from portentia.functions.columns import finite, matches_label
from portentia.functions.vectors import arg_max_name
from portentia.operators.risk import LIVE_BASELINE_FLOOR, LIVE_BASELINE_ROWS, LIVE_P95, LIVE_P99, live_outputs
from portentia.operators.states import FLOW_COUNT, POSITIVE, RATIO, literal_fill, state_columns
from portentia.sources.flows import require_columns
from portentia.timeline import Timeline

# Processors travel with their helpers, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

Predictor = Callable[[np.ndarray], np.ndarray]

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_IDLE_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
_ALL = "__all"
MICROS = 1_000_000
COUNTS = ("above95_count_5", "above95_count_10", "above99_count_5", "above99_count_10")


@contextmanager
def keyed_state(spark: SparkSession, timers: bool = False) -> Iterator[None]:
    """The settings that queries with keyed state start under; those of the session come back afterwards.

    Timers by the clock ask for another micro-batch for ever, so with ``timers`` a run over what is available makes none
    without data; they then fire with the next data of any key.
    """
    wanted = {_PROVIDER: _ROCKSDB} | ({_IDLE_BATCHES: "false"} if timers else {})
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_keyed(stream: DataFrame, path: str, checkpoint: str, timers: bool = False) -> None:
    """Process what is available now, appending to a Parquet table; then stop."""
    with keyed_state(stream.sparkSession, timers):
        query = (
            stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start()
        )
        query.awaitTermination()


def _by_key(df: DataFrame, tl: Timeline):
    """Grouped by the keys, or by a constant on a timeline without keys."""
    return df.groupBy(*tl.keys) if tl.keys else df.withColumn(_ALL, F.lit(0)).groupBy(_ALL)


def _key_fields(df: DataFrame, tl: Timeline) -> list[T.StructField]:
    return [df.schema[k] for k in tl.keys]


class OpenBuckets(StatefulProcessor):
    """The open buckets of one key as running sums, closed by the key's own event time or by silence.

    Rows of a closed bucket are late and dropped, whoever closed it. All rows of a micro-batch are added before the
    watermark moves on.
    """

    def __init__(self, keys: list[str], bucket: int, delay: int, idle_ms: int | None):
        self.keys, self.bucket, self.delay, self.idle_ms = len(keys), bucket, delay, idle_ms
        self.row = Row(*keys, "bucket", "sums", "idle")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "bucket long", "sums array<double>")
        self.mark = handle.getValueState("mark", "latest long, closed long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        latest, closed = self.mark.get() if self.mark.exists() else (None, None)
        sums = {k[0]: list(v[0]) for k, v in self.open.iterator()}
        for row in rows:
            if closed is None or row["bucket"] >= closed:
                old = sums.get(row["bucket"])
                sums[row["bucket"]] = row["sums"] if old is None else [a + b for a, b in zip(old, row["sums"])]
            latest = row["latest"] if latest is None else max(latest, row["latest"])
        passed = (latest - self.delay) // self.bucket
        closed = passed if closed is None else max(closed, passed)
        self.mark.update((latest, closed))
        yield from self._close(key, sums, closed, False)
        for bucket in [b for b in sums if b >= closed]:
            self.open.updateValue((bucket,), (sums[bucket],))
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if any(b >= closed for b in sums):
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        sums = {k[0]: list(v[0]) for k, v in self.open.iterator()}
        if sums:
            latest, _ = self.mark.get()
            closed = max(sums) + 1
            self.mark.update((latest, closed))
            yield from self._close(key, sums, closed, True)

    def _close(self, key: Any, sums: dict[int, list[float]], closed: int, idle: bool) -> Iterator[Row]:
        for bucket in sorted(b for b in sums if b < closed):
            if self.open.containsKey((bucket,)):
                self.open.removeKey((bucket,))
            yield self.row(*key[: self.keys], bucket, sums[bucket], idle)

    def close(self) -> None:
        pass


def _added_up(keys: list[str], features: list[str]):
    """Sums per (key, bucket) of every Arrow batch."""
    picked = [("at", "max"), ("one", "sum"), ("positive", "sum")]
    for c in features:
        picked += [(c, "sum"), (c, "count")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]).group_by([*keys, "bucket"]).aggregate(picked)
            parts = [table.column(f"{c}_{how}").cast(pa.float64()).fill_null(0.0).to_numpy() for c, how in picked[1:]]
            sums = np.stack(parts, axis=1)
            offsets = np.arange(0, sums.size + 1, sums.shape[1], dtype=np.int32)
            columns = [table.column(k).combine_chunks() for k in (*keys, "bucket", "at_max")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(sums.ravel()))], names=[*keys, "bucket", "latest", "sums"]
            )

    return run


def keyed_states(
    flows: DataFrame, features: Iterable[str], tl: Timeline, label: str, positive: str, time: str = "ts",
    ratio_threshold: float = 0.0, medians: dict[str, float] | None = None, delay_seconds: int = 0,
    idle_seconds: float | None = None,
) -> DataFrame:
    """States of buckets that closed by the event time of their own key, or by its silence.

    A bucket closes when the latest event time of its key, less the delay, passes its end; with ``idle_seconds`` also
    when the key has had no flow for that long by the clock and a micro-batch runs. Later rows of it are dropped.
    ``medians`` is the stored fill table. Start the query inside :func:`keyed_state`, or with :func:`run_keyed`, with ``timers``.
    """
    features = list(features)
    require_columns(flows, [*tl.keys, time, label, *features])
    keys, width = list(tl.keys), tl.bucket_seconds * MICROS
    own = {c: finite(F.col(c).cast("double")) for c in features}
    if medians is not None:
        fill = literal_fill(features, medians)
        own = {c: F.coalesce(own[c], fill[c]) for c in features}
    at = F.unix_micros(F.col(time).cast("timestamp"))
    rows = flows.where(F.col(time).isNotNull()).select(
        *keys, F.floor(at / F.lit(width)).cast("long").alias("bucket"), at.alias("at"), F.lit(1).alias("one"),
        matches_label(label, positive).cast("double").alias("positive"), *[own[c].alias(f"__{i}") for i, c in enumerate(features)],
    )
    fields = _key_fields(flows, tl)
    partial = T.StructType([*fields, *T.StructType.fromDDL("bucket long, latest long, sums array<double>").fields])
    added = rows.mapInArrow(_added_up(keys, [f"__{i}" for i in range(len(features))]), partial)
    closed = T.StructType([*fields, *T.StructType.fromDDL("bucket long, sums array<double>, idle boolean").fields])
    processor = OpenBuckets(keys, width, delay_seconds * MICROS, None if idle_seconds is None else int(idle_seconds * 1000))
    states = _by_key(added, tl).transformWithState(processor, closed, "append", "ProcessingTime")
    total = F.col("sums")[0]

    def mean(i: int) -> Column:
        s, n = F.col("sums")[2 + 2 * i], F.col("sums")[3 + 2 * i]
        return F.when(n > 0, s / n) if medians is None else F.when(n == total, s / total)

    return states.select(
        *keys, F.timestamp_seconds(F.col("bucket") * F.lit(tl.bucket_seconds)).alias(tl.time),
        *[mean(i).alias(c) for i, c in enumerate(features)],
        total.cast("long").alias(FLOW_COUNT), (F.col("sums")[1] / total).alias(RATIO),
    ).select(*state_columns(tl.id, features, ratio_threshold))


def window_mean(x: np.ndarray) -> np.ndarray:
    """The mean of each window, (n, length, f) to (n, f), over the values that are there."""
    there = ~np.isnan(x)
    counts = there.sum(axis=1)
    return np.where(counts > 0, np.where(there, x, 0.0).sum(axis=1) / np.maximum(counts, 1), np.nan)


class RecentScores(StatefulProcessor):
    """The last vectors and errors of one key: scores every new state whose predecessors have no gap."""

    def __init__(self, keys: list[str], length: int, predictor: Predictor, limits: tuple[float, float], history: int):
        self.keys, self.length, self.predictor, self.limits, self.history = len(keys), length, predictor, limits, history
        self.row = Row(*keys, "bucket", POSITIVE, RATIO, "mse", "mae", "errors", *COUNTS, "trailing")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState("recent", "bucket long, vector array<double>")
        self.errors = handle.getListState("errors", "mse double")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        nothing = float("nan")
        held = [(r[0], r[1]) for r in self.recent.get()]
        new = sorted(rows, key=lambda r: r["bucket"])
        vectors = [*(v for _, v in held), *(r["vector"] for r in new)]
        at = np.array([*(b for b, _ in held), *(r["bucket"] for r in new)], dtype=np.int64)
        table = np.array([[nothing if x is None else x for x in v] for v in vectors], dtype=np.float64)
        # ready: states after `length` others without a gap; they meet the predictor as one batch
        index = np.arange(len(held), len(at))
        ready = index[index >= self.length]
        ready = ready[at[ready] - at[ready - self.length] == self.length]
        if len(ready):
            x = table[ready[:, None] + np.arange(-self.length, 0)]
            errors = np.abs(table[ready] - np.asarray(self.predictor(x)))
            past = [r[0] for r in self.errors.get()]
            for k, e in zip(ready.tolist(), errors):
                row = new[k - len(held)]
                mse, mae = float((e * e).mean()), float(e.mean())
                known = mse == mse
                judged = self._judge(past, mse) if known else (None,) * 5
                values = [None if v != v else v for v in e.tolist()]
                yield self.row(
                    *key[: self.keys], row["bucket"], row[POSITIVE], row[RATIO], mse if known else None,
                    mae if known else None, values, *judged,
                )
                if known:
                    past = [*past, mse][-self.history :]
            if past:  # an empty list cannot be put
                self.errors.put([(x,) for x in past])
        keep = range(max(0, len(at) - self.length), len(at))
        self.recent.put([(int(at[k]), vectors[k]) for k in keep])

    def _judge(self, past: list[float], mse: float) -> tuple:
        """Counts above both limits among the last 5 and 10 errors, this one included, and the median of those before."""
        last = [*past, mse]
        counts = [sum(x > limit for x in last[-n:]) for limit in self.limits for n in (5, 10)]
        return (*counts, float(np.median(past)) if past else None)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        return iter(())

    def close(self) -> None:
        pass


def keyed_scores(
    states: DataFrame, features: Iterable[str], tl: Timeline, scaler: dict[str, tuple[float, float]],
    predictor: Predictor = window_mean, length: int = 10, limits: tuple[float, float] = (LIVE_P95, LIVE_P99),
    history: int = LIVE_BASELINE_ROWS,
) -> DataFrame:
    """Next-state errors of a stream of states, each judged by the errors of its key before it.

    ``predictor`` maps scaled windows (n, length, f) to the next vectors (n, f): the moving average, or a fitted model
    such as ``linear_predictor``. The states of a key must come in order, as closed buckets do. Gives the columns of a
    score row, the counts above ``limits`` and ``trailing``, the median of up to ``history`` errors before.
    """
    features = list(features)
    vector = F.array(*[(F.col(c).cast("double") - F.lit(float(scaler[c][0]))) / F.lit(float(scaler[c][1])) for c in features])
    rows = states.select(*tl.keys, tl.index().alias("bucket"), POSITIVE, RATIO, vector.alias("vector"))
    fields = [*_key_fields(states, tl), *T.StructType.fromDDL(
        f"bucket long, {POSITIVE} int, {RATIO} double, mse double, mae double, errors array<double>, "
        + ", ".join(f"{c} long" for c in COUNTS) + ", trailing double"
    ).fields]
    processor = RecentScores(list(tl.keys), length, predictor, limits, history)
    scored = _by_key(rows, tl).transformWithState(processor, T.StructType(fields), "append", "None")
    start = F.timestamp_seconds(F.col("bucket") * F.lit(tl.bucket_seconds))
    return scored.select(
        *tl.keys, start.alias(tl.time), tl.shift(start, -1).alias("source_time"), POSITIVE, RATIO, "mse", "mae", "errors",
        arg_max_name(F.col("errors"), features).alias("top_feature"), F.array_max("errors").alias("top_feature_error"),
        *COUNTS, "trailing",
    )


def keyed_forecast(scores: DataFrame, limits: tuple[float, float] = (LIVE_P95, LIVE_P99)) -> DataFrame:
    """Rolling risk of every score of :func:`keyed_scores`: only expressions on its row are left to do."""
    floored = F.greatest(F.col("trailing"), F.lit(LIVE_BASELINE_FLOOR))
    judged = scores.where(F.col("mse").isNotNull()).withColumns({
        "p95": F.lit(limits[0]), "p99": F.lit(limits[1]),
        "baseline": F.when(F.col("trailing").isNull(), F.lit(limits[0])).otherwise(floored),
    })
    return live_outputs(judged.drop("trailing"))
