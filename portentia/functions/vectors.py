"""Expressions over array<double> vectors, and their wide-column equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it as often as ``body`` likes.

    Array expressions are not shared between uses when the optimizer merges projections; a lambda
    variable is.
    """
    return F.transform(F.array(value), body)[0]


def _fold(values: Column, term) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + term(v))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def mean_square(v: Column) -> Column:
    return let(v, lambda u: _fold(u, lambda x: x * x) / F.size(u))


def rms(v: Column) -> Column:
    return F.sqrt(mean_square(v))


def mean_abs(v: Column) -> Column:
    return let(v, lambda u: _fold(u, F.abs) / F.size(u))


def max_abs(v: Column) -> Column:
    return F.array_max(F.transform(v, F.abs))


def mse(a: Column, b: Column) -> Column:
    return mean_square(minus(a, b))


def mae(a: Column, b: Column) -> Column:
    return mean_abs(minus(a, b))


def scale(v: Column, mean: Column, std: Column) -> Column:
    """Z-scale a vector with vectors of means and deviations."""
    return F.zip_with(minus(v, mean), std, lambda x, s: x / s)


def unscale(v: Column, mean: Column, std: Column) -> Column:
    return F.zip_with(F.zip_with(v, std, lambda x, s: x * s), mean, lambda x, m: x + m)


def top_mean(v: Column, k: int) -> Column:
    """Mean of the ``k`` largest elements (all of them when the vector is shorter)."""
    best = F.slice(F.sort_array(v, asc=False), 1, k)
    return let(best, lambda u: _fold(u, lambda x: x) / F.size(u))


def ranked(v: Column, k: int) -> Column:
    """The ``k`` largest elements as structs (value, pos), ties in position order."""
    tagged = F.transform(v, lambda x, i: F.struct((-x).alias("neg"), i.alias("pos")))
    return F.transform(
        F.slice(F.array_sort(tagged), 1, k),
        lambda s: F.struct((-s["neg"]).alias("value"), s["pos"].alias("pos")),
    )


def names(features: list[str]) -> Column:
    return F.array(*[F.lit(f) for f in features])


def arg_max_name(v: Column, features: list[str]) -> Column:
    """Name of the largest element; the first one wins a tie."""
    return F.element_at(names(features), F.array_position(v, F.array_max(v)).cast("int"))


def error_map(v: Column, features: list[str]) -> Column:
    return F.map_from_arrays(names(features), v)


def combine(weights: Column, sequence: Column, width: int) -> Column:
    """Weighted sum of the vectors of a sequence: one weight per sequence position."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(width - 1)),
        lambda i: F.aggregate(
            F.zip_with(weights, sequence, lambda w, vec: w * vec[i]),
            F.lit(0.0),
            lambda acc, x: acc + x,
        ),
    )
