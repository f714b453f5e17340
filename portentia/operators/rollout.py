"""Recursive multi-step forecasts for every origin at once, and their evaluation.

A linear predictor applied to its own output stays linear in the original window: step ``k`` is a power of the model's
companion matrix applied to the last ``length`` vectors. The powers do not depend on data. They are worked out once,
side by side as one matrix, and every Arrow batch of origins takes all its steps in one matrix product; this holds for
the moving average and persistence as well as for fitted weights. All origins are independent rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from portentia.functions import vectors as V
from portentia.functions.columns import safe_ratio
from portentia.functions.rows import with_row
from portentia.operators.scaling import scale_states
from portentia.operators.sequences import vector
from portentia.operators.states import POSITIVE
from portentia.timeline import Timeline, over_blocks, unbroken

# Task functions travel with their helpers, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Weights of shock and deviation in the risk, and the trend band.
RISK_SHOCK = 0.70
RISK_DEVIATION = 0.30
TREND_BAND = 0.1


def method_weights(method: str, n_features: int, length: int = 10) -> np.ndarray:
    """A simple predictor as weights of a linear model: (length * f + 1, f), the last row being the intercept."""
    one_step = {
        "window_mean": np.full(length, 1.0 / length),
        "persistence": np.append(np.zeros(length - 1), 1.0),
    }[method]
    return np.vstack([np.kron(one_step[:, None], np.eye(n_features)), np.zeros(n_features)])


def step_matrix(weights: np.ndarray, steps: int) -> np.ndarray:
    """From a window and a one, (length * f + 1), to all steps of its rollout, (steps * f).

    Column block ``k`` holds the first rows of the ``k``-th power of the companion matrix.
    """
    if steps < 1:
        raise ValueError("at least one step")
    size, f = weights.shape
    window = np.eye(size)[:, : size - 1]  # the window as a linear map of itself
    constant = np.eye(size)[:, -1:]
    out = []
    for _ in range(steps):
        step = window @ weights[:-1] + constant @ weights[-1:]
        out.append(step)
        window = np.hstack([window[:, f:], step])
    return np.hstack(out)


def step_weights(method: str, steps: int, length: int = 10) -> list[list[float]]:
    """Weights of the last ``length`` vectors (oldest first) for each forecast step of a simple predictor."""
    return step_matrix(method_weights(method, 1, length), steps)[:-1].T.tolist()


def _dense(column: pa.Array, width: int) -> np.ndarray:
    """Nested lists as the rows of a matrix; missing values are NaN."""
    while pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        column = column.flatten()
    return column.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _lists(values: np.ndarray) -> pa.Array:
    """An array of any dimension as nested lists, NaN as null."""
    column = pa.array(values.ravel(), from_pandas=True)
    for width in values.shape[:0:-1]:
        column = pa.ListArray.from_arrays(np.arange(0, len(column) + 1, width, dtype=np.int32), column)
    return column


def forecast_paths(
    states: DataFrame,
    tl: Timeline,
    features: Iterable[str],
    scaler: DataFrame,
    steps: int = 15,
    method: str = "window_mean",
    length: int = 10,
    weights: np.ndarray | None = None,
) -> DataFrame:
    """One row per valid origin: the last observed vector and the ``path`` of scaled forecasts.

    ``weights`` are those of a fitted model over ``length`` states, as ``fit_next_state`` gives them; without them the
    named method predicts.
    """
    features = list(features)
    f = len(features)
    scaled = scale_states(states, features, scaler)
    onward = step_matrix(method_weights(method, f, length) if weights is None else weights, steps)

    def build(w: WindowSpec) -> dict[str, Column]:
        return {
            "__x": F.collect_list(vector(features)).over(w.rowsBetween(-(length - 1), 0)),
            "__ok": unbroken(tl, w, back=length - 1),
        }

    origins = over_blocks(scaled, tl, build, before=length - 1).filter("__ok").select(*tl.id, F.flatten("__x").alias("__x"))
    names = tl.id

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _dense(batch.column("__x"), length * f)
                path = x @ onward[:-1] + onward[-1]
                columns = [_lists(x[:, -f:]), _lists(path.reshape(len(x), steps, f))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *columns], names=[*names, "last", "path"])

    schema = T.StructType(
        [*(origins.schema[c] for c in names), *T.StructType.fromDDL("last array<double>, path array<array<double>>").fields]
    )
    return origins.mapInArrow(project, schema)


def with_signals(paths: DataFrame, tl: Timeline) -> DataFrame:
    """Add ``signals``: per step shock, deviation, change, stability and risk.

    Everything about an origin is on its own row, so no step is brought back together by a shuffle.
    """

    def change(path: Column) -> Column:
        previous = F.concat(F.array(F.col("last")), F.slice(path, 1, F.size(path) - 1))
        return F.zip_with(path, previous, lambda p, s: V.rms(V.minus(p, s)))

    def mean_after_first(shocks: Column) -> Column:
        later = F.aggregate(shocks, F.lit(0.0), lambda acc, x: acc + x) - shocks[0]
        return F.when(F.size(shocks) > 1, later / (F.size(shocks) - 1))

    def step(i: Column, shock: Column, stability: Column, p: Column, deviation: Column) -> Column:
        return F.struct(
            (i + 1).cast("int").alias("step"),
            tl.shift(tl.time, i + 1).alias("target_time"),
            shock.alias("transition_shock"),
            deviation.alias("future_state_deviation"),
            V.mean_abs(p).alias("mean_abs_deviation"),
            V.max_abs(p).alias("max_deviation"),
            shock.alias("predicted_state_change"),
            stability.alias("future_stability"),
            (shock * RISK_SHOCK + deviation * RISK_DEVIATION).alias("simulation_risk"),
        )

    def signals(path: Column, shocks: Column, stability: Column) -> Column:
        return F.transform(
            path, lambda p, i: V.let(V.rms(p), lambda d: step(i, F.get(shocks, i), stability, p, d))
        )

    return paths.withColumn(
        "signals",
        V.let(
            F.col("path"),
            lambda path: V.let(
                change(path),
                lambda shocks: V.let(
                    mean_after_first(shocks), lambda stability: signals(path, shocks, stability)
                ),
            ),
        ),
    )


def rollout_signals(paths: DataFrame, tl: Timeline) -> DataFrame:
    """One row per origin and step with the signals of that step."""
    # The outer form keeps Spark from testing the array for emptiness, which would compute it twice.
    return with_signals(paths, tl).select(*tl.id, F.inline_outer("signals"))


def rollout_states(
    paths: DataFrame, tl: Timeline, features: Iterable[str], scaler: DataFrame
) -> DataFrame:
    """Forecast states in original units, one row per origin and step, one column per feature."""
    features = list(features)
    exploded = paths.select(*tl.id, F.posexplode_outer("path").alias("__i", "__p"))
    step = (F.col("__i") + 1).cast("int")
    return with_row(exploded, scaler).select(
        *tl.id,
        step.alias("step"),
        tl.shift(tl.time, step).alias("target_time"),
        *[
            (F.col("__p")[i] * F.col(f"std_{c}") + F.col(f"mean_{c}")).alias(c)
            for i, c in enumerate(features)
        ],
    )


def rollout_trend(paths: DataFrame, tl: Timeline) -> DataFrame:
    """Change of risk from the first to the last step of every origin, as a trend."""
    change = V.let(
        F.col("signals"),
        lambda s: F.element_at(s, -1)["simulation_risk"] - F.element_at(s, 1)["simulation_risk"],
    )
    ends = with_signals(paths, tl).select(*tl.id, F.explode(F.array(change)).alias("risk_change"))
    change = F.col("risk_change")
    return ends.withColumn(
        "trend",
        F.when(change > TREND_BAND, "INCREASING")
        .when(change < -TREND_BAND, "DECREASING")
        .otherwise("STABLE"),
    )


def rollout_scenarios(labelled: DataFrame) -> DataFrame:
    """Per scenario: first, mean and maximum shock, deviation and risk (first = earliest step)."""
    return labelled.groupBy("scenario").agg(
        F.min_by("transition_shock", F.struct("step", "target_time")).alias("first_shock"),
        F.avg("transition_shock").alias("mean_shock"),
        F.max("transition_shock").alias("max_shock"),
        F.avg("future_state_deviation").alias("mean_deviation"),
        F.max("future_state_deviation").alias("max_deviation"),
        F.avg("simulation_risk").alias("mean_risk"),
        F.max("simulation_risk").alias("max_risk"),
    )


def rollout_evaluation(
    states: DataFrame,
    tl: Timeline,
    features: Iterable[str],
    scaler: DataFrame,
    baseline: DataFrame,
    steps: int = 15,
    method: str = "window_mean",
    length: int = 10,
    weights: np.ndarray | None = None,
) -> DataFrame:
    """Every forecast step against the state that was then observed, up to the first gap.

    ``baseline`` is a one-row table (median, p95, p99) of normal one-step errors; ``weights`` as in
    :func:`forecast_paths`. History and future come from the same window, so no row is joined to its future by a second
    shuffle.
    """
    features = list(features)
    f = len(features)
    scaled = scale_states(states, features, scaler)
    onward = step_matrix(method_weights(method, f, length) if weights is None else weights, steps)
    seen = F.struct(
        F.col(tl.time).alias("t"), F.col(POSITIVE).alias("positive"), vector(features).alias("v")
    )

    def build(w: WindowSpec) -> dict[str, Column]:
        return {
            "__x": F.collect_list(vector(features)).over(w.rowsBetween(-(length - 1), 0)),
            "__future": F.collect_list(seen).over(w.rowsBetween(1, steps)),
            "__ok": unbroken(tl, w, back=length - 1),
        }

    origins = over_blocks(
        scaled, tl, build, before=length - 1, after=steps, rows=True
    ).filter(F.col("__ok") & (F.size("__future") == steps)).select(
        *tl.id, F.flatten("__x").alias("__x"), F.flatten("__future.v").alias("__y"),
        F.col("__future.t").alias("__t"), F.col("__future.positive").alias("__positive"),
    )
    kept = [*tl.id, "__t", "__positive"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = _dense(batch.column("__x"), length * f), _dense(batch.column("__y"), steps * f)
                error = (x @ onward[:-1] + onward[-1] - y).reshape(len(x), steps, f)
                columns = [_lists((error * error).mean(axis=2)), _lists(np.abs(error).mean(axis=2))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *columns], names=[*kept, "__mse", "__mae"])

    schema = T.StructType(
        [*(origins.schema[c] for c in kept), *T.StructType.fromDDL("__mse array<double>, __mae array<double>").fields]
    )
    each = F.arrays_zip(F.col("__t").alias("t"), F.col("__positive").alias("positive"), F.col("__mse").alias("mse"), F.col("__mae").alias("mae"))
    paired = (
        origins.mapInArrow(compare, schema)
        .select(*tl.id, F.posexplode(each).alias("__i", "__p"))
        .withColumn("step", (F.col("__i") + 1).cast("int"))
        .filter(F.col("__p.t") == tl.shift(tl.time, F.col("step")))
        .select(
            *tl.id, "step", F.col("__p.t").alias("target_time"), F.col("__p.positive").alias(POSITIVE), "__p.mse", "__p.mae"
        )
    )
    return with_row(paired, baseline).select(
        *paired.columns,
        safe_ratio("mse", "median").alias("anomaly_ratio"),
        (F.col("mse") > F.col("p95")).cast("int").alias("above_95"),
        (F.col("mse") > F.col("p99")).cast("int").alias("above_99"),
    )


def rollout_summary(evaluation: DataFrame, steps: Iterable[int] = (1, 5, 10, 15)) -> DataFrame:
    """Per step and class: rows, mean error, share above p99."""
    return (
        evaluation.filter(F.col("step").isin(*steps))
        .groupBy("step", POSITIVE)
        .agg(
            F.count(F.lit(1)).alias("samples"),
            F.avg("mse").alias("mean_mse"),
            F.avg(F.col("above_99").cast("double")).alias("rate_99"),
        )
    )
