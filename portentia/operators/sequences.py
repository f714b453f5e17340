"""Gap checks, state sequences, targets, transitions, islands and splits over a series."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from portentia.functions.rows import same_keys, with_row
from portentia.operators.states import POSITIVE
from portentia.timeline import Timeline, over_blocks, unbroken, with_row_index


def contiguous_states(states: DataFrame, tl: Timeline, length: int = 10) -> DataFrame:
    """Flags: the last ``length`` rows are gap-free; so are they together with the next row."""
    return over_blocks(
        states,
        tl,
        lambda w: {
            "has_history": unbroken(tl, w, back=length - 1).cast("int"),
            "has_target": unbroken(tl, w, back=length - 1, forward=1).cast("int"),
        },
        before=length - 1,
        after=1,
    )


def vector(features: Iterable[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in features])


def sequences(
    states: DataFrame,
    tl: Timeline,
    features: Iterable[str],
    length: int = 10,
    check_gaps: bool = True,
    normal_only: bool = False,
) -> DataFrame:
    """Rows (keys, time, x, y, target_time, target_positive): ``length`` vectors and the next one.

    ``time`` is the last input row. With ``check_gaps=False`` neighbouring rows are taken as they
    come, however far apart.
    """
    features = list(features)

    def build(w: WindowSpec) -> dict[str, Column]:
        inputs = w.rowsBetween(-(length - 1), 0)
        covered = w.rowsBetween(-(length - 1), 1)
        full = (
            unbroken(tl, w, back=length - 1, forward=1)
            if check_gaps
            else (F.count(F.lit(1)).over(covered) == length + 1)
        )
        return {
            "x": F.collect_list(vector(features)).over(inputs),
            "y": F.lead(vector(features), 1).over(w),
            "target_time": F.lead(tl.time, 1).over(w),
            "target_positive": F.lead(POSITIVE, 1).over(w),
            "__positives": F.max(POSITIVE).over(covered),
            "__full": full,
        }

    built = over_blocks(
        states, tl, build, before=length - 1, after=1, rows=not check_gaps
    ).filter("__full")
    if normal_only:
        built = built.filter(F.col("__positives") == 0)
    return built.select(*tl.id, "x", "y", "target_time", "target_positive")


def normal_coverage(states: DataFrame, tl: Timeline, length: int = 10) -> DataFrame:
    """Add ``covered``: 1 for rows inside at least one gap-free, all-normal sequence with target."""

    def qualify(w: WindowSpec) -> dict[str, Column]:
        normal = F.max(POSITIVE).over(w.rowsBetween(-(length - 1), 1)) == 0
        return {
            "__qualifies": (normal & unbroken(tl, w, back=length - 1, forward=1)).cast("int")
        }

    return over_blocks(
        states,
        tl,
        qualify,
        lambda w: {"covered": F.max("__qualifies").over(w.rowsBetween(-1, length - 1))},
        before=length,
        after=length,
    ).drop("__qualifies")


def forecast_targets(
    states: DataFrame, tl: Timeline, horizons: Iterable[int] = (5, 10, 15)
) -> DataFrame:
    """Per horizon ``positive_within_h`` and ``starts_within_h``: 1, 0, or null if not observable.

    A row is observable when the next ``h`` rows exist without a gap. From a normal row, a start
    inside the horizon is the same as any positive inside it; from a positive row it is 0.
    """
    horizons = list(horizons)

    def build(w: WindowSpec) -> dict[str, Column]:
        out = {}
        for h in horizons:
            seen = F.max(POSITIVE).over(w.rowsBetween(1, h))
            observable = unbroken(tl, w, forward=h)
            out[f"positive_within_{h}"] = F.when(observable, seen)
            out[f"starts_within_{h}"] = F.when(
                observable, F.when(F.col(POSITIVE) != 0, F.lit(0)).otherwise(seen)
            )
        return out

    return over_blocks(states, tl, build, after=max(horizons))


def state_transitions(states: DataFrame, tl: Timeline) -> DataFrame:
    """Rows whose flag differs from the row before."""
    return (
        over_blocks(
            states.select(*tl.id, POSITIVE),
            tl,
            lambda w: {"previous": F.lag(POSITIVE, 1).over(w)},
            before=1,
            rows=True,
        )
        .filter(F.col("previous") != F.col(POSITIVE))
        .select(*tl.id, "previous", F.col(POSITIVE).alias("current"))
    )


def attack_periods(states: DataFrame, tl: Timeline, where: Column | None = None) -> DataFrame:
    """Maximal gap-free runs of positive rows: start, end, duration in buckets.

    Along a run the bucket ordinal and the row number rise together, so their difference names
    the run. No running flag has to be carried through the series.
    """
    chosen = states.filter(F.col(POSITIVE) == 1 if where is None else where).select(*tl.id)
    return (
        with_row_index(chosen, tl)
        .groupBy(*tl.keys, (tl.index() - F.col("row_index")).alias("__run"))
        .agg(
            F.min(tl.time).alias("start"),
            F.max(tl.time).alias("end"),
            F.count(F.lit(1)).alias("duration"),
        )
        .drop("__run")
    )


def index_blocks(df: DataFrame, tl: Timeline, where: Column, index: str = "row_index") -> DataFrame:
    """Runs of consecutive row positions that satisfy a condition, whatever their times."""
    positions = df.filter(where)
    return (
        with_row_index(positions, tl, "__nth")
        .groupBy(*tl.keys, (F.col(index) - F.col("__nth")).alias("__run"))
        .agg(
            F.min(index).alias("first_index"),
            F.max(index).alias("last_index"),
            F.count(F.lit(1)).alias("length"),
        )
        .drop("__run")
    )


def chronological_split(df: DataFrame, tl: Timeline, fraction: float = 0.8) -> DataFrame:
    """Add ``split``: the first ``floor(fraction * rows)`` rows of each key are train."""
    keys = list(tl.keys)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
    indexed = with_row_index(df, tl)
    sized = same_keys(indexed, sizes, keys) if keys else with_row(indexed, sizes)
    train = F.col("row_index") < F.floor(F.lit(fraction) * F.col("__rows"))
    return sized.withColumn("split", F.when(train, "train").otherwise("test")).drop("__rows")


def positional_split(
    df: DataFrame, tl: Timeline, start: int, end: int, buffer: int = 10
) -> DataFrame:
    """Rows ``[start, end)`` are test, rows within ``buffer`` of them are left out, the rest train."""
    i = F.col("row_index")
    split = (
        F.when((i >= start) & (i < end), "test")
        .when((i >= start - buffer) & (i < end + buffer), "buffer")
        .otherwise("train")
    )
    return with_row_index(df, tl).withColumn("split", split)


def stratified_split(df: DataFrame, label: str, row_id: Iterable[str], fraction: float = 0.8) -> DataFrame:
    """Split that is random within each class: a hash of class and row id decides.

    Needs no shuffle, and the same row always lands on the same side.
    """
    slot = _slot(_row_text(label, row_id))
    return df.withColumn("split", F.when(slot < int(fraction * 2**32), "train").otherwise("test"))


def _row_text(label: str, row_id: Iterable[str]) -> Column:
    return F.concat_ws("|", F.col(label).cast("string"), *[F.col(c).cast("string") for c in row_id])


def _slot(text: Column) -> Column:
    """32 bits of a hash of the text."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def exact_stratified_split(df: DataFrame, label: str, row_id: Iterable[str], fraction: float = 0.8) -> DataFrame:
    """Split that is random within each class and exact: ``floor(fraction * rows)`` rows of every class are train.

    These are the rows with the smallest hashes of class and row id. The hash that ends them is found by counts, first of
    its high 16 bits, then of its low ones inside one bin, so no class is put in order; only rows that share the last
    hash are numbered, by their ids. A null class is a class.
    """
    rows = df.withColumn("__text", _row_text(label, row_id)).withColumn("__slot", _slot(F.col("__text")))
    if fraction >= 1:
        return df.withColumn("split", F.lit("train"))
    high, low = F.floor(F.col("__slot") / 65536), F.col("__slot")
    counts = rows.groupBy(label, high.alias("__place")).agg(F.count(F.lit(1)).alias("__rows"))
    total = F.sum("__rows").over(Window.partitionBy(label))
    bins = _place_of(counts.withColumn("__wanted", F.floor(F.lit(fraction) * total)), label).withColumnRenamed("__place", "__bin")
    inside = same_keys(rows.select(label, "__slot", high.alias("__bin")), bins, [label, "__bin"])
    counts = inside.groupBy(label, low.alias("__place")).agg(F.count(F.lit(1)).alias("__rows"), F.max("__left").alias("__wanted"))
    ends = _place_of(counts, label).withColumnRenamed("__place", "__end")
    cut = same_keys(rows, ends, [label])
    side = F.when(F.col("__slot") < F.col("__end"), "train").otherwise("test")
    apart = cut.filter(F.col("__slot") != F.col("__end")).withColumn("split", side)
    order = Window.partitionBy(label).orderBy("__text")
    tied = cut.filter(F.col("__slot") == F.col("__end")).withColumn("__nth", F.row_number().over(order))
    tied = tied.withColumn("split", F.when(F.col("__nth") <= F.col("__left"), "train").otherwise("test")).drop("__nth")
    return apart.unionByName(tied).drop("__text", "__slot", "__end", "__left")


def _place_of(counts: DataFrame, label: str) -> DataFrame:
    """Per class, from counts (__rows) by __place: the place of the first row beyond __wanted, and how many of the rows
    of that place are still wanted (__left)."""
    order = Window.partitionBy(label).orderBy("__place").rowsBetween(Window.unboundedPreceding, 0)
    upto = counts.withColumn("__upto", F.sum("__rows").over(order))
    here = (F.col("__upto") > F.col("__wanted")) & (F.col("__upto") - F.col("__rows") <= F.col("__wanted"))
    return upto.filter(here).select(label, "__place", (F.col("__wanted") - F.col("__upto") + F.col("__rows")).alias("__left"))


def is_time_ordered(df: DataFrame, tl: Timeline, row_id: str) -> DataFrame:
    """One row: does the id never fall when rows are put in time order?

    Raw rows are ordered inside one bucket at a time; over the buckets only their first and last ids are compared. Rows
    of one instant may come in any order, so their smallest id counts first.
    """
    bucket = df.select(*tl.keys, F.col(tl.time).alias("__at"), F.col(row_id).alias("__id"), tl.floor(tl.time).alias(tl.time))
    inside = Window.partitionBy(*tl.id).orderBy("__at", "__id")
    falls = bucket.withColumn("__before", F.lag("__id", 1).over(inside)).groupBy(*tl.id).agg(
        F.count_if(F.col("__before") > F.col("__id")).alias("__falls"),
        F.min_by("__id", F.struct("__at", "__id")).alias("__first"),
        F.max_by("__id", F.struct("__at", "__id")).alias("__last"),
    )
    return over_blocks(
        falls, tl, lambda w: {"__before": F.lag("__last", 1).over(w)}, before=1, rows=True
    ).agg(
        (F.coalesce(F.sum("__falls") + F.count_if(F.col("__before") > F.col("__first")), F.lit(0)) == 0).alias("is_monotonic")
    )
