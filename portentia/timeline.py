"""The time axis of a keyed series, and windows over it that never gather a whole key.

A series has at most one row per (keys, bucket). Window functions here look at a bounded number
of neighbouring rows, so the axis is cut into blocks and every block gets copies of the few rows
its edges need ("halo"). A key with a very long history, or a single un-keyed timeline, then
spreads over many tasks and a task holds at most ``block_buckets`` rows plus the halo.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from portentia.functions.rows import same_keys

_HOME = "__home_block"
_BLOCK = "__block"
_ROW = "__row_index"
_CHUNK = "__chunk"

Build = Callable[[WindowSpec], dict[str, Column]]


@dataclass(frozen=True)
class Timeline:
    """Bucket width, partition keys and block size of a series."""

    bucket_seconds: int = 60
    keys: tuple[str, ...] = ()
    time: str = "time_window"
    block_buckets: int = 1440

    @property
    def id(self) -> list[str]:
        """Columns that identify a row."""
        return [*self.keys, self.time]

    def index(self, time: Column | str | None = None) -> Column:
        """Ordinal of the bucket that a timestamp falls into."""
        col = F.col(self.time) if time is None else F.col(time) if isinstance(time, str) else time
        return F.floor(F.unix_timestamp(col) / F.lit(self.bucket_seconds)).cast("long")

    def shift(self, time: Column | str, buckets: Column | int) -> Column:
        """``time`` moved by whole buckets."""
        col = F.col(time) if isinstance(time, str) else time
        steps = F.lit(buckets) if isinstance(buckets, int) else buckets
        return F.timestamp_seconds(F.unix_timestamp(col) + steps * F.lit(self.bucket_seconds))

    def floor(self, time: Column | str) -> Column:
        """Start of the bucket a timestamp falls into."""
        return F.timestamp_seconds(self.index(time) * F.lit(self.bucket_seconds))

    def buckets_between(self, earlier: Column | str, later: Column | str) -> Column:
        """Signed distance in buckets, as a double."""
        a = F.col(earlier) if isinstance(earlier, str) else earlier
        b = F.col(later) if isinstance(later, str) else later
        return (F.unix_timestamp(b) - F.unix_timestamp(a)) / F.lit(float(self.bucket_seconds))


def with_row_index(df: DataFrame, tl: Timeline, name: str = "row_index") -> DataFrame:
    """Number the rows of each key 0, 1, 2, … in time order.

    Rows are numbered inside calendar chunks, and chunk sizes are turned into offsets. The offset
    table has one row per (keys, chunk), so the only per-key ordering is over calendar chunks.
    """
    keys = list(tl.keys)
    chunked = df.withColumn(_CHUNK, F.floor(tl.index() / F.lit(tl.block_buckets)))
    inside = Window.partitionBy(*keys, _CHUNK).orderBy(tl.time)
    numbered = chunked.withColumn("__local", F.row_number().over(inside) - 1)
    before = (
        Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    ).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        chunked.groupBy(*keys, _CHUNK)
        .agg(F.count(F.lit(1)).alias("__size"))
        .select(*keys, _CHUNK, F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__offset"))
    )
    return (
        same_keys(numbered, offsets, [*keys, _CHUNK])
        .withColumn(name, (F.col("__local") + F.col("__offset")).cast("long"))
        .drop(_CHUNK, "__local", "__offset")
    )


def over_blocks(
    df: DataFrame,
    tl: Timeline,
    *builds: Build,
    before: int = 0,
    after: int = 0,
    rows: bool = False,
) -> DataFrame:
    """Add window columns, computed per block of the time axis.

    ``before`` / ``after`` say how far the expressions reach. With ``rows=False`` the reach is in
    buckets: right for expressions that are only used where the neighbouring buckets are gap-free.
    With ``rows=True`` it is in rows, across gaps of any length. Each ``build`` receives the window
    (partitioned by keys and block, ordered by time) and may use the columns of the previous one;
    all of them share one shuffle and one sort.
    """
    block = max(tl.block_buckets, before, after, 1)
    if rows:
        df = with_row_index(df, tl, _ROW)
        position = F.col(_ROW)
    else:
        position = tl.index()
    home = F.floor(position / F.lit(block))
    offset = F.pmod(position, F.lit(block))
    targets = [F.col(_HOME)]
    if before:
        targets.append(F.when(offset >= block - before, F.col(_HOME) + 1))
    if after:
        targets.append(F.when(offset < after, F.col(_HOME) - 1))
    out = df.withColumn(_HOME, home).withColumn(
        _BLOCK, F.explode(F.array_compact(F.array(*targets)))
    )
    window = Window.partitionBy(*tl.keys, _BLOCK).orderBy(tl.time)
    for build in builds:
        out = out.withColumns(build(window))
    return out.filter(F.col(_HOME) == F.col(_BLOCK)).drop(_HOME, _BLOCK, _ROW)


def unbroken(tl: Timeline, window: WindowSpec, back: int = 0, forward: int = 0) -> Column:
    """True where the preceding ``back`` and following ``forward`` rows have no gap.

    Buckets are distinct and aligned, so the row ``n`` steps away lies exactly ``n`` buckets away
    only when nothing is missing in between: one comparison per side replaces a scan of the run.
    """
    checks = []
    if back:
        checks.append(F.lag(tl.time, back).over(window) == tl.shift(tl.time, -back))
    if forward:
        checks.append(F.lead(tl.time, forward).over(window) == tl.shift(tl.time, forward))
    result = F.lit(True)
    for check in checks:
        result = result & F.coalesce(check, F.lit(False))
    return result
