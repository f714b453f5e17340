"""Next-state prediction errors, their attribution to features, and the linear next-state model."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from portentia.functions import vectors as V
from portentia.operators.scaling import scale_states, scaled, with_scaler
from portentia.operators.sequences import sequences
from portentia.operators.states import POSITIVE, RATIO
from portentia.runtime import stage
from portentia.timeline import Timeline, over_blocks, unbroken

# Task functions travel with their helpers, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

Predictor = Callable[[np.ndarray], np.ndarray]

METHODS = ("window_mean", "persistence")


def _expected(method: str, c: str, w: WindowSpec, length: int) -> Column:
    if method == "window_mean":
        return F.avg(c).over(w.rowsBetween(-length, -1))
    if method == "persistence":
        return F.lag(c, 1).over(w)
    raise ValueError(f"unknown method: {method}")


def score_states(
    states: DataFrame,
    tl: Timeline,
    features: Iterable[str],
    scaler: DataFrame,
    method: str = "window_mean",
    length: int = 10,
    stamp: str = "target",
) -> DataFrame:
    """Scaled prediction error of every state that follows ``length`` gap-free states.

    Features stay wide columns through the window, so the moving statistics run in one window
    operator; the errors then become one vector and the metrics are taken from it. Scaling is linear, so errors are scaled after the prediction and the means cancel. Rows are stamped with
    the predicted minute (``stamp="target"``) or with the last input minute (``"source"``).
    """
    features = list(features)

    def build(w: WindowSpec) -> dict[str, Column]:
        out = {f"__p_{c}": _expected(method, c, w, length) for c in features}
        out["source_time"] = F.lag(tl.time, 1).over(w)
        out["__valid"] = unbroken(tl, w, back=length)
        return out

    valid = over_blocks(states, tl, build, before=length).filter("__valid")
    wide = with_scaler(valid, scaler)
    errors = [F.abs((F.col(c) - F.col(f"__p_{c}")) / F.col(f"std_{c}")) for c in features]
    predicted = [(F.col(f"__p_{c}") - F.col(f"mean_{c}")) / F.col(f"std_{c}") for c in features]
    time = F.col(tl.time if stamp == "target" else "source_time")
    return wide.select(
        *tl.keys,
        time.alias(tl.time),
        F.col("source_time"),
        F.col(tl.time).alias("target_time"),
        POSITIVE,
        RATIO,
        F.inline(F.array(error_metrics(F.array(*errors)))),
        V.mean_abs(F.array(*predicted)).alias("predicted_magnitude"),
        V.mean_abs(F.array(*[scaled(c) for c in features])).alias("actual_magnitude"),
    )


def error_metrics(errors: Column) -> Column:
    """Struct (mse, mae, errors) of a vector of absolute errors, which is built once."""
    return V.let(
        errors,
        lambda e: F.struct(
            V.mean_square(e).alias("mse"), V.mean_abs(e).alias("mae"), e.alias("errors")
        ),
    )


def with_top_feature(scores: DataFrame, features: Iterable[str]) -> DataFrame:
    """Name and error of the feature that is furthest from its prediction."""
    features = list(features)
    return scores.withColumns(
        {
            "top_feature": V.arg_max_name(F.col("errors"), features),
            "top_feature_error": F.array_max("errors"),
        }
    )


def top_feature_errors(scores: DataFrame, tl: Timeline, features: Iterable[str], k: int = 10) -> DataFrame:
    """The ``k`` largest feature errors of every row, ranked. Needs no shuffle."""
    names = V.names(list(features))
    return scores.select(
        *tl.id, F.posexplode(V.ranked(F.col("errors"), k)).alias("__i", "__e")
    ).select(
        *tl.id,
        (F.col("__i") + 1).cast("int").alias("rank"),
        F.element_at(names, F.col("__e.pos") + 1).alias("feature"),
        F.col("__e.value").alias("error"),
    )


def top_mean_scores(scores: DataFrame, ks: Iterable[int] = (5, 10)) -> DataFrame:
    """Alternative scores: mean of the ``k`` largest feature errors."""
    return scores.withColumns({f"top{k}_error": V.top_mean(F.col("errors"), k) for k in ks})


def feature_error_map(scores: DataFrame, features: Iterable[str]) -> DataFrame:
    return scores.withColumn("feature_errors", V.error_map(F.col("errors"), list(features)))


def _nested(column: pa.Array, width: int) -> np.ndarray:
    """An Arrow list column (or list of lists) as a dense array, without per-row Python."""
    while pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        column = column.flatten()
    return column.to_numpy(zero_copy_only=False).reshape(-1, width)


def score_sequences(
    seq: DataFrame, tl: Timeline, n_features: int, predictor: Predictor, length: int = 10
) -> DataFrame:
    """Score sequences with any predictor: a function from (n, length, f) to (n, f) arrays.

    Works on Arrow batches; returns keys, target time, flag, mse, mae and the feature errors.
    """
    fields = [seq.schema[k] for k in tl.keys]
    schema = T.StructType(
        [
            *fields,
            T.StructField(tl.time, T.TimestampType()),
            T.StructField("source_time", T.TimestampType()),
            T.StructField(POSITIVE, T.IntegerType()),
            T.StructField("mse", T.DoubleType()),
            T.StructField("mae", T.DoubleType()),
            T.StructField("errors", T.ArrayType(T.DoubleType())),
        ]
    )
    keys, time = list(tl.keys), tl.time
    names = [*keys, time, "source_time", POSITIVE, "mse", "mae", "errors"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _nested(batch.column("__x"), length * n_features).reshape(-1, length, n_features)
            y = _nested(batch.column("__y"), n_features)
            err = np.abs(np.asarray(predictor(x)) - y)
            offsets = np.arange(0, err.size + 1, n_features, dtype=np.int32)
            columns = [batch.column(k) for k in keys] + [
                batch.column("target_time"),
                batch.column(time),
                batch.column("target_positive"),
                pa.array((err**2).mean(axis=1)),
                pa.array(err.mean(axis=1)),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(err.ravel())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    narrow = seq.select(
        *tl.id, "target_time", F.col("target_positive").cast("int").alias("target_positive"),
        F.col("x").alias("__x"), F.col("y").alias("__y"),
    )
    return narrow.mapInArrow(score, schema)


#: Matrices beyond this many rows (about 0.9 GB) are not gathered; shares are first added in so many groups.
MAX_WIDTH, SUM_PARTS = 10_000, 64


def fit_linear(
    seq: DataFrame, n_features: int, length: int = 10, ridge: float = 1.0
) -> np.ndarray:
    """Ridge regression of the next vector on the ``length`` previous ones.

    Returns weights of shape (length * f + 1, f), the last row being the intercept.
    """
    gram, moments = normal_equations(seq, n_features, length)
    return np.linalg.solve(gram + _penalty(len(gram), ridge), moments)


#: Passes that a Huber fit may take; it ends as soon as its gradient is small.
HUBER_PASSES = 500


def fit_huber(
    seq: DataFrame, n_features: int, length: int = 10, ridge: float = 1.0, delta: float = 1.0, tolerance: float = 1e-5
) -> np.ndarray:
    """As :func:`fit_linear` with the Huber loss: quadratic up to ``delta``, linear beyond, so that outliers pull less.

    Starts at least squares. Every step solves the normal equations, which are added up once, for the residuals cut to
    ``delta``; a pass over the rows then adds up lagged vectors times cut residuals only. The loss bends no more than the
    square, so every plain step lowers it; steps are carried on along their last direction while that helps. Ends when the
    gradient is below ``tolerance`` of the largest moment.
    """
    gram, moments = normal_equations(seq, n_features, length)
    system = gram + _penalty(len(gram), ridge)
    scale = max(1.0, float(np.abs(moments).max()))
    weights = previous = np.linalg.solve(system, moments)
    ahead, momentum = weights, 1.0
    for _ in range(HUBER_PASSES):
        gradient = huber_moments(seq, n_features, length, ahead, delta) - _penalty(len(gram), ridge) @ ahead
        if np.abs(gradient).max() <= tolerance * scale:
            return ahead
        weights = ahead + np.linalg.solve(system, gradient)
        if ((weights - previous) * (system @ (ahead - weights))).sum() > 0:
            momentum, ahead = 1.0, weights  # overshot: start the acceleration again
        else:
            grown = (1 + (1 + 4 * momentum * momentum) ** 0.5) / 2
            ahead = weights + (momentum - 1) / grown * (weights - previous)
            momentum = grown
        previous = weights
    raise RuntimeError(f"the Huber loss did not settle in {HUBER_PASSES} passes")


def huber_moments(seq: DataFrame, n_features: int, length: int, weights: np.ndarray, delta: float) -> np.ndarray:
    """Sum over all rows of the lagged vector times the residuals cut to ``delta``: minus the gradient of the loss."""
    width = length * n_features + 1

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, n_features))
        for batch in batches:
            if batch.num_rows:
                x = _nested(batch.column("x"), length * n_features)
                cut = np.clip(_nested(batch.column("y"), n_features) - (x @ weights[:-1] + weights[-1]), -delta, delta)
                total[:-1] += x.T @ cut
                total[-1] += cut.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["i", "v"])

    sums = seq.select("x", "y").mapInArrow(part, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(width * n_features)
    out[sums["i"].to_numpy()] = sums["v"].to_numpy()
    return out.reshape(width, n_features)


def huber_gradient(
    states: DataFrame, tl: Timeline, features: Iterable[str], scaler: DataFrame, weights: np.ndarray,
    length: int = 10, ridge: float = 1.0, delta: float = 1.0,
) -> float:
    """Largest entry of the gradient of the Huber loss at the weights, relative to the largest moment, over all rows."""
    features = list(features)
    seq = sequences(scale_states(states, features, scaler), tl, features, length, normal_only=True)
    gram, moments = normal_equations(seq, len(features), length)
    left = huber_moments(seq, len(features), length, weights, delta) - _penalty(len(gram), ridge) @ weights
    return float(np.abs(left).max() / max(1.0, np.abs(moments).max()))


def normal_equations(seq: DataFrame, n_features: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Products of the lagged vectors with themselves and with the next vector, summed over all rows.

    Every task adds up its share; the shares are added as whole matrix rows on the cluster. The matrix reaches the
    driver: its size depends on the number of features only and is refused beyond MAX_WIDTH.
    """
    width = length * n_features + 1
    if width > MAX_WIDTH:
        raise ValueError(f"{width} lagged values; the normal equations are solved on the driver up to {MAX_WIDTH}")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((width, width + n_features))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _nested(batch.column("x"), length * n_features)
            y = _nested(batch.column("y"), n_features)
            design = np.hstack([x, np.ones((len(x), 1))])
            gram += design.T @ np.hstack([design, y])
        offsets = np.arange(0, gram.size + 1, gram.shape[1], dtype=np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(width, dtype=np.int32)),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(gram.ravel())),
            ],
            names=["i", "row"],
        )

    def add(rows: pa.Table) -> pa.Table:
        """Rows of one index, a few at a time by `part`, to one."""
        values = rows.column("row").combine_chunks()
        total = values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1).sum(axis=0)
        return pa.table([rows.column("i").slice(0, 1), pa.array([total])], names=["i", "row"])

    shares = seq.select("x", "y").mapInArrow(partial, "i int, row array<double>")
    # two levels, so that no group holds the rows of all tasks
    for parts in (SUM_PARTS, 1):
        part = F.pmod(F.spark_partition_id(), F.lit(parts)).alias("part")
        shares = shares.select("i", "row", part).groupBy("i", "part").applyInArrow(add, "i int, row array<double>")
    sums = shares.toArrow().sort_by("i")
    system = np.zeros((width, width + n_features))
    system[sums["i"].to_numpy()] = np.array(sums["row"].to_pylist())
    return system[:, :width], system[:, width:]


def _penalty(width: int, ridge: float) -> np.ndarray:
    penalty = ridge * np.eye(width)
    penalty[-1, -1] = 0.0
    return penalty


def residual(
    states: DataFrame, tl: Timeline, features: Iterable[str], scaler: DataFrame, weights: np.ndarray,
    length: int = 10, ridge: float = 1.0,
) -> float:
    """Largest residual of the normal equations at the weights, relative to the largest moment."""
    features = list(features)
    seq = sequences(scale_states(states, features, scaler), tl, features, length, normal_only=True)
    gram, moments = normal_equations(seq, len(features), length)
    left = (gram + _penalty(len(gram), ridge)) @ weights - moments
    return float(np.abs(left).max() / max(1.0, np.abs(moments).max()))


def linear_predictor(weights: np.ndarray) -> Predictor:
    def predict(x: np.ndarray) -> np.ndarray:
        return x.reshape(len(x), -1) @ weights[:-1] + weights[-1]

    return predict


def fit_next_state(
    states: DataFrame,
    tl: Timeline,
    features: Iterable[str],
    scaler: DataFrame,
    length: int = 10,
    ridge: float = 1.0,
    loss: str = "squared",
) -> np.ndarray:
    """Fit the linear next-state model on gap-free, all-normal sequences of scaled states.

    ``loss`` is "squared" or "huber"; the latter reads the sequences many times, so they are written once.
    """
    features = list(features)
    seq = sequences(
        scale_states(states, features, scaler), tl, features, length, normal_only=True
    )
    if loss == "huber":
        return fit_huber(stage(seq.select("x", "y"), "sequences"), len(features), length, ridge)
    if loss != "squared":
        raise ValueError(f"unknown loss: {loss}")
    return fit_linear(seq, len(features), length, ridge)


def score_linear(
    states: DataFrame,
    tl: Timeline,
    features: Iterable[str],
    scaler: DataFrame,
    weights: np.ndarray,
    length: int = 10,
) -> DataFrame:
    """Errors of a fitted linear model over all gap-free windows."""
    features = list(features)
    seq = sequences(scale_states(states, features, scaler), tl, features, length)
    return score_sequences(seq, tl, len(features), linear_predictor(weights), length)
