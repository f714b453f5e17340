"""Exact quantiles and ordered running totals that never gather all values in one task."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from portentia.functions.columns import finite
from portentia.functions.rows import same_keys, with_row
from portentia.runtime import stage

def _usable(c: str) -> Column:
    return finite(F.col(c).cast("double"))


def _value_counts(df: DataFrame, columns: list[str], brackets: DataFrame, by: list[str]) -> DataFrame:
    """Counts per value inside the range of each column and probability, and in one slot (null) below it.

    One pass: the ranges come with every row as one array (of a class, by null-safe equality), what lies above a range
    is left out before rows are made of it, and all that lies below it falls into one slot, so partial aggregation
    leaves about the values in range.
    """
    entry = F.struct(*[F.col(c) for c in ("feature", "prob", "n", "low", "high")])
    ranges = brackets.groupBy(*by).agg(F.collect_list(entry).alias("__ranges"))  # columns * probabilities entries
    values = df.select(*by, F.create_map(*[x for c in columns for x in (F.lit(c), _usable(c))]).alias("__values"))
    ranged = same_keys(values, ranges, by)
    slots = F.filter(
        F.transform(
            "__ranges",
            lambda r: F.struct(
                r["feature"].alias("feature"), r["prob"].alias("prob"), r["n"].alias("n"),
                F.when(F.col("__values")[r["feature"]] >= r["low"], F.col("__values")[r["feature"]]).alias("slot"),
                # an empty column keeps one entry with a count of 0
                F.when(r["n"] == 0, F.lit(0)).when(F.col("__values")[r["feature"]] <= r["high"], F.lit(1)).alias("one"),
            ),
        ),
        lambda e: e["one"].isNotNull(),
    )
    return (
        ranged.select(*by, F.inline(slots))
        .groupBy(*by, "feature", "prob", "slot")
        .agg(F.sum("one").alias("cnt"), F.first("n").alias("n"))
    )


def _brackets(
    df: DataFrame, columns: list[str], probs: list[float], by: list[str], accuracy: int
) -> DataFrame:
    """Per group, column and probability: a value range that surely holds the exact quantile."""
    margin = 4.0 / accuracy
    cuts = [c for p in probs for c in (max(p - margin, 0.0), min(p + margin, 1.0))]
    aggs = []
    for i, c in enumerate(columns):
        aggs.append(F.count(_usable(c)).alias(f"__n{i}"))
        aggs.append(F.percentile_approx(_usable(c), cuts, accuracy).alias(f"__q{i}"))
    grouped = df.groupBy(*by).agg(*aggs)
    entries = []
    for i, c in enumerate(columns):
        n, q = F.col(f"__n{i}"), F.col(f"__q{i}")
        narrow = n * F.lit(margin) >= 4
        for j, p in enumerate(probs):
            low = F.when(narrow & F.lit(p - margin > 0), q[2 * j])
            high = F.when(narrow & F.lit(p + margin < 1), q[2 * j + 1])
            entries.append(
                F.struct(
                    F.lit(c).alias("feature"),
                    F.lit(p).alias("prob"),
                    n.alias("n"),
                    F.coalesce(low, F.lit(float("-inf"))).alias("low"),
                    F.coalesce(high, F.lit(float("inf"))).alias("high"),
                )
            )
    return grouped.select(*by, F.inline(F.array(*entries)))


#: Values of all columns and probabilities that one aggregate may hand to the driver.
HANDED = 1 << 20


def exact_quantiles(
    df: DataFrame,
    columns: Iterable[str],
    probs: Iterable[float],
    by: Iterable[str] = (),
    accuracy: int = 10_000,
    bins: int = 256,
) -> DataFrame:
    """Linear-interpolated quantiles as rows (by…, feature, prob, n, quantile).

    Without groups, a bounded sketch per column gives a range around each quantile; one aggregate then counts what lies
    below and on the ends of the range and hands over the values strictly inside, about ``8 / accuracy`` of the rows,
    whatever value repeats. Where these would be more than HANDED, the range is first narrowed by sketches of what lies
    inside it, each about a thousandth of the one before. A range that turns out not to hold the quantile is widened
    and measured again.

    With groups see :func:`_grouped_quantiles`. The passes run when the function is called. Nulls, NaN and infinities are
    ignored; a column without values gets a null quantile.
    """
    columns, probs, by = list(columns), list(probs), list(by)
    if by:
        return _grouped_quantiles(df, columns, probs, by, accuracy, bins)
    found = _searched(df.select(*[_usable(c).alias(f"__{i}") for i, c in enumerate(columns)]), len(columns), probs, accuracy)
    entries = [
        F.struct(
            F.lit(c).alias("feature"), F.lit(float(p)).alias("prob"), F.lit(n).cast("long").alias("n"),
            F.lit(value).cast("double").alias("quantile"),
        )
        for i, c in enumerate(columns) for p, (n, value) in zip(probs, found[i])
    ]
    return df.sparkSession.range(1).select(F.inline(F.array(*entries)))


def _searched(values: DataFrame, width: int, probs: list[float], accuracy: int) -> list[list[tuple[int, float | None]]]:
    """(rows, quantile) by column __0, __1, … and probability."""
    aggs = []
    for i in range(width):
        aggs += [F.count(f"__{i}").alias(f"n{i}"), F.percentile_approx(f"__{i}", _around(probs, 4.0 / accuracy), accuracy).alias(f"q{i}")]
    row = values.agg(*aggs).first()
    searches = [
        [_Search(f"__{i}", row[f"n{i}"], p, (row[f"q{i}"] or [])[2 * j : 2 * j + 2], 4.0 / accuracy) for j, p in enumerate(probs)]
        for i in range(width)
    ]
    every = [s for of in searches for s in of if s.n]
    while open_ := [s for s in every if s.value is None]:
        if sum(s.inside for s in open_) > HANDED:
            row = values.agg(*[x for k, s in enumerate(open_) for x in s.counts(k)]).first()
            for k, s in enumerate(open_):
                s.counted(row, k)
            narrow = [(k, s) for k, s in enumerate(open_) if s.held and s.inside > HANDED // len(open_)]
            if narrow:
                row = values.agg(*[s.sketch(accuracy).alias(f"q{k}") for k, s in narrow]).first()
                for k, s in narrow:
                    s.narrow(row[f"q{k}"], accuracy)
                continue
        row = values.agg(*[x for k, s in enumerate(open_) for x in (*s.counts(k), s.between().alias(f"v{k}"))]).first()
        for k, s in enumerate(open_):
            s.counted(row, k)
            s.settle(row[f"v{k}"])
    return [[(s.n, s.value) for s in of] for of in searches]


def _around(probs: list[float], margin: float) -> list[float]:
    return [c for p in probs for c in (max(p - margin, 0.0), min(p + margin, 1.0))]


class _Search:
    """The range of values around one quantile of one column."""

    def __init__(self, column: str, n: int, prob: float, ends: list[float], margin: float) -> None:
        self.column, self.n, self.value = column, n, None
        position = prob * (n - 1)
        self.ranks = int(position), int(-(-position // 1))
        self.share = position - self.ranks[0]
        narrow = n * margin >= 4
        self.low = ends[0] if narrow and prob - margin > 0 else float("-inf")
        self.high = ends[1] if narrow and prob + margin < 1 else float("inf")
        self.inside = int(2.5 * margin * n) + 1 if narrow else n
        self.held = True

    def _within(self) -> Column:
        return (F.col(self.column) > self.low) & (F.col(self.column) < self.high)

    def counts(self, k: int) -> list[Column]:
        v = F.col(self.column)
        tests = {"b": v < self.low, "l": v == self.low, "i": self._within(), "h": (v == self.high) & F.lit(self.high > self.low)}
        return [F.count_if(test).alias(f"{name}{k}") for name, test in tests.items()]

    def counted(self, row: Row, k: int) -> None:
        """Take counts; widen the range where the ranks lie outside it."""
        self.below, self.at_low, self.inside, at_high = (row[f"{name}{k}"] for name in "blih")
        self.held = True
        if self.ranks[0] < self.below:
            self.low, self.held = float("-inf"), False
        if self.ranks[1] >= self.below + self.at_low + self.inside + at_high:
            self.high, self.held = float("inf"), False

    def sketch(self, accuracy: int) -> Column:
        first = self.below + self.at_low
        places = [min(max((r - first) / max(self.inside, 1), 0.0), 1.0) for r in self.ranks]
        cuts = [max(places[0] - 4.0 / accuracy, 0.0), min(places[1] + 4.0 / accuracy, 1.0)]
        return F.percentile_approx(F.when(self._within(), F.col(self.column)), cuts, accuracy)

    def narrow(self, ends: list[float], accuracy: int) -> None:
        self.inside = int(self.inside * 10.0 / accuracy) + 1
        # a rank on an end of the present range keeps that end
        if self.ranks[0] >= self.below + self.at_low:
            self.low = ends[0]
        self.high = ends[1]

    def settle(self, between: list[float]) -> None:
        if self.held:
            low, high = (self._at(r, between) for r in self.ranks)
            self.value = low if low == high else (1 - self.share) * low + self.share * high

    def between(self) -> Column:
        return F.sort_array(F.collect_list(F.when(self._within(), F.col(self.column))))

    def _at(self, rank: int, between: list[float]) -> float:
        rank -= self.below
        if rank < self.at_low:
            return self.low
        rank -= self.at_low
        return between[rank] if rank < len(between) else self.high


def _grouped_quantiles(
    df: DataFrame, columns: list[str], probs: list[float], by: list[str], accuracy: int, bins: int
) -> DataFrame:
    """Quantiles of any number of groups.

    The first pass is a bounded sketch per column that yields a value range with the exact quantile inside. The second
    counts what lies below the range and, inside it only, the values, partially aggregated before the shuffle. They are
    written as a table, cut into bins of about equal size, and only the bins that hold the wanted ranks are put in order,
    so no task orders all values of a column. The rank error of the sketch is ``1 / accuracy``, the range four times as
    wide on each side.
    """
    keys = [*by, "feature", "prob"]
    brackets = stage(_brackets(df, columns, probs, by, accuracy), "brackets")
    slots = stage(_value_counts(df, columns, brackets, by), "quantiles")
    position = F.col("prob") * (F.col("n") - 1)
    lower, upper = F.floor(position), F.ceil(position)
    grid = [i / bins for i in range(1, bins)]
    cuts = slots.groupBy(*keys).agg(F.percentile_approx("slot", grid, 10 * bins).alias("__cuts"))
    place = F.size(F.filter("__cuts", lambda c: c < F.col("slot")))
    binned = same_keys(slots, cuts, keys).withColumn("__bin", F.coalesce(place, F.lit(0)))
    earlier = Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    wanted = (
        binned.groupBy(*keys, "__bin")
        .agg(F.sum("cnt").alias("__size"), F.max("n").alias("n"))
        .withColumn("__before", F.coalesce(F.sum("__size").over(earlier), F.lit(0)))
        .filter(
            (F.col("n") == 0)
            | ((F.col("__before") <= upper) & (F.col("__before") + F.col("__size") > lower))
        )
        .select(*keys, "__bin", "__before")
    )
    chosen = same_keys(binned.drop("__cuts"), wanted, [*keys, "__bin"])
    inside = (
        Window.partitionBy(*keys, "__bin")
        .orderBy(F.col("slot").asc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    picked = (
        chosen.withColumn("upto", F.sum("cnt").over(inside) + F.col("__before"))
        .groupBy(*keys)
        .agg(
            F.max("n").alias("n"),
            F.coalesce(F.sum(F.when(F.col("slot").isNull(), F.col("cnt"))), F.lit(0)).alias("below"),
            F.min(F.when(F.col("upto") > lower, F.col("slot"))).alias("lo"),
            F.min(F.when(F.col("upto") > upper, F.col("slot"))).alias("hi"),
        )
    )
    missed = (F.col("below") > lower) | F.col("lo").isNull() | F.col("hi").isNull()
    quantile = F.when(
        missed, F.raise_error(F.lit("quantile bracket missed; raise the accuracy")).cast("double")
    ).otherwise(
        F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(
            (upper - position) * F.col("lo") + (position - lower) * F.col("hi")
        )
    )
    return picked.select(*keys, "n", F.when(F.col("n") > 0, quantile).alias("quantile"))


def approximate_quantiles(
    df: DataFrame, columns: Iterable[str], probs: Iterable[float], accuracy: int = 10_000
) -> DataFrame:
    """One-pass variant of :func:`exact_quantiles` for un-grouped data."""
    columns, probs = list(columns), list(probs)
    row = df.agg(
        *[
            x
            for i, c in enumerate(columns)
            for x in (
                F.count(_usable(c)).alias(f"__n{i}"),
                F.percentile_approx(_usable(c), probs, accuracy).alias(f"__q{i}"),
            )
        ]
    )
    entries = [
        F.struct(
            F.lit(c).alias("feature"),
            F.lit(p).alias("prob"),
            F.col(f"__n{i}").alias("n"),
            F.col(f"__q{i}")[j].alias("quantile"),
        )
        for i, c in enumerate(columns)
        for j, p in enumerate(probs)
    ]
    return row.select(F.inline(F.array(*entries)))


def one_row(long: DataFrame, names: dict[tuple[str, float], str]) -> DataFrame:
    """A (feature, prob, quantile) table as one row with the given column names."""
    return long.agg(
        *[
            F.max(F.when((F.col("feature") == f) & (F.col("prob") == p), F.col("quantile"))).alias(name)
            for (f, p), name in names.items()
        ]
    )


def running_totals(df: DataFrame, order: str, measures: Iterable[str], bins: int = 256) -> DataFrame:
    """Totals of each measure over all rows with a smaller ``order`` value, plus the own row.

    ``order`` must be unique. Rows go to value bins cut at approximate quantiles, each bin is
    summed in order, and the at most ``bins`` bin totals become offsets.
    """
    measures = list(measures)
    grid = [i / bins for i in range(1, bins)]
    cuts = df.agg(F.percentile_approx(order, grid, 10 * bins).alias("__cuts"))
    binned = (
        with_row(df, cuts)
        .withColumn("__bin", F.size(F.filter("__cuts", lambda c: c < F.col(order))))
        .drop("__cuts")
    )
    earlier = Window.partitionBy(F.lit(0)).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = binned.groupBy("__bin").agg(*[F.sum(m).alias(f"__t_{m}") for m in measures]).select(
        "__bin",
        *[F.coalesce(F.sum(f"__t_{m}").over(earlier), F.lit(0)).alias(f"__o_{m}") for m in measures],
    )
    inside = Window.partitionBy("__bin").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        binned.withColumns({f"__r_{m}": F.sum(m).over(inside) for m in measures})
        .join(F.broadcast(offsets), "__bin")  # at most `bins` rows
        .withColumns({f"running_{m}": F.col(f"__r_{m}") + F.col(f"__o_{m}") for m in measures})
        .drop("__bin", *[f"__r_{m}" for m in measures], *[f"__o_{m}" for m in measures])
    )
