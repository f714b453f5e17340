"""Scalar expressions: cleaning, time parsing, clamping, null-safe arithmetic, text lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted day-first layouts, with and without seconds.
DAY_FIRST_FORMATS = ("d/M/yyyy H:m:s", "d/M/yyyy H:m")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """NaN and ±infinity become null."""
    col = _col(c)
    return F.when(F.isnan(col) | (F.abs(col) == F.lit(float("inf"))), None).otherwise(col)


def to_number(c: Column | str) -> Column:
    """Text to double; anything that is not a number becomes null."""
    return _col(c).try_cast("double")


def to_finite_number(c: Column | str) -> Column:
    return finite(to_number(c))


def parse_day_first(c: Column | str) -> Column:
    """Day-first timestamp text; unparseable text becomes null."""
    text = F.trim(_col(c))
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in DAY_FIRST_FORMATS])


def matches_label(c: Column | str, label: str) -> Column:
    """1 where the trimmed, case-folded text equals ``label``, else 0 (also for null)."""
    return F.coalesce(
        (F.lower(F.trim(_col(c).cast("string"))) == F.lit(label.strip().lower())).cast("int"),
        F.lit(0),
    )


def is_header_text(c: Column | str, header: str) -> Column:
    """True for stray header rows inside the data; a null value is not one."""
    return F.coalesce(F.lower(F.trim(_col(c))) == F.lit(header.strip().lower()), F.lit(False))


def clamp(c: Column | str, low: float = 0.0, high: float = 10.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), _col(c)))


def row_max(*columns: Column | str) -> Column:
    return F.greatest(*[_col(c) for c in columns])


def threshold_ratio(value: Column | str, threshold: Column | str) -> Column:
    """``value / threshold``; 0 when the value is null or the threshold is not positive."""
    v, t = _col(value), _col(threshold)
    return F.when(v.isNull() | t.isNull() | (t <= 0), F.lit(0.0)).otherwise(v / t)


def safe_ratio(value: Column | str, base: Column | str) -> Column:
    """``value / base`` where the base is positive, else null."""
    return F.when(_col(base) > 0, _col(value) / _col(base))


def safe_float(c: Column | str) -> Column:
    """A double; 0 for null or text that is not a number."""
    return F.coalesce(_col(c).cast("string").try_cast("double"), F.lit(0.0))


def points(*ladder: tuple[Column, float]) -> Column:
    """First matching step of a score ladder; 0 when none matches (null conditions do not match)."""
    chain = None
    for condition, value in ladder:
        chain = (
            F.when(condition, F.lit(value)) if chain is None else chain.when(condition, F.lit(value))
        )
    return chain.otherwise(F.lit(0.0))


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def join_reasons(reasons: list[Column], separator: str, default: str) -> Column:
    """Concatenate the non-null reasons, or the default text when there is none."""
    text = F.concat_ws(separator, *reasons)
    return F.when(F.length(text) > 0, text).otherwise(F.lit(default))


def ordinal(c: Column | str, levels: tuple[str, ...] = ("LOW", "MEDIUM", "HIGH")) -> Column:
    """Position of a level name in its scale; null for an unknown level."""
    pairs = [F.lit(x) for i, level in enumerate(levels) for x in (level, i)]
    return F.try_element_at(F.create_map(*pairs), _col(c))


def share(condition: Column) -> Column:
    """Aggregate: fraction of rows that satisfy a condition (null counts as not)."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))


def divide_or_zero(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)
