"""Evaluation against labelled campaigns: interval joins, lead times, false signals, profiles.

Campaigns are rows (campaign, start, end) with a closed interval, optionally with the timeline's
keys. Interval conditions are matched through coarse time chunks, so that they are equi-joins for
any number of campaigns; Spark broadcasts the campaign side when it is small.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from portentia.functions.rows import with_row
from portentia.operators.risk import HORIZONS
from portentia.operators.states import POSITIVE
from portentia.timeline import Timeline

LEVELS = {"MEDIUM/HIGH": ("MEDIUM", "HIGH"), "HIGH": ("HIGH",)}
_CHUNK = "__chunk"


def campaign_table(spark: SparkSession, rows: Iterable[tuple[str, str, str]]) -> DataFrame:
    """Campaigns from literals (name, start, end)."""
    raw = spark.createDataFrame(list(rows), "campaign string, start string, end string")
    return raw.select(
        "campaign", F.col("start").cast("timestamp"), F.col("end").cast("timestamp")
    )


def interval_join(
    df: DataFrame,
    intervals: DataFrame,
    tl: Timeline,
    start: str,
    end: str,
    how: str = "inner",
    chunk_buckets: int = 60,
) -> DataFrame:
    """Join rows with the closed intervals that contain their time (or ``left_anti``)."""
    shared = [k for k in tl.keys if k in intervals.columns]
    left = df.withColumn(_CHUNK, F.floor(tl.index() / F.lit(chunk_buckets)))
    spans = F.sequence(
        F.floor(tl.index(F.col(start)) / F.lit(chunk_buckets)),
        F.floor(tl.index(F.col(end)) / F.lit(chunk_buckets)),
    )
    right = (
        intervals.filter(F.col(start) <= F.col(end))
        .withColumn("__right_chunk", F.explode(spans))
        .withColumnsRenamed({k: f"__right_{k}" for k in shared})
    )
    condition = reduce(
        lambda a, b: a & b,
        [
            F.col(_CHUNK) == F.col("__right_chunk"),
            F.col(tl.time) >= F.col(start),
            F.col(tl.time) <= F.col(end),
            *[F.col(k) == F.col(f"__right_{k}") for k in shared],
        ],
    )
    return left.join(right, condition, how).drop(
        _CHUNK, "__right_chunk", *[f"__right_{k}" for k in shared]
    )


def pre_attack_window(
    df: DataFrame, campaigns: DataFrame, tl: Timeline, before: int = 30
) -> DataFrame:
    """Rows in the ``before`` buckets ahead of each campaign, with ``campaign``, ``start``, ``lead``."""
    windows = campaigns.select(
        *[k for k in tl.keys if k in campaigns.columns],
        "campaign",
        "start",
        tl.shift("start", -before).alias("__from"),
        tl.shift("start", -1).alias("__to"),
    )
    return (
        interval_join(df, windows, tl, "__from", "__to")
        .withColumn("lead", tl.buckets_between(tl.time, "start"))
        .drop("__from", "__to")
    )


def normal_period(df: DataFrame, campaigns: DataFrame, tl: Timeline) -> DataFrame:
    """Normal-labelled rows outside every campaign."""
    spans = campaigns.select(
        *[k for k in tl.keys if k in campaigns.columns], "start", "end"
    )
    return interval_join(df.filter(F.col(POSITIVE) == 0), spans, tl, "start", "end", "left_anti")


def _levels(horizons: Iterable[int]) -> Column:
    """One struct (horizon, signal_level, is_signal) per horizon and level."""
    return F.array(
        *[
            F.struct(
                F.lit(h).alias("horizon"),
                F.lit(name).alias("signal_level"),
                F.col(f"forecast_{h}").isin(*levels).alias("is_signal"),
            )
            for h in horizons
            for name, levels in LEVELS.items()
        ]
    )


def signal_evaluation(
    engine: DataFrame,
    campaigns: DataFrame,
    tl: Timeline,
    before: int = 30,
    horizons: Iterable[int] = HORIZONS,
) -> DataFrame:
    """Per campaign, horizon and level: first and sustained signal, leads, count, rate.

    Sustained means two signals in adjacent buckets. A campaign without data still gets its rows.
    """
    horizons = list(horizons)
    inside = pre_attack_window(engine, campaigns, tl, before).select(
        *tl.keys, "campaign", "start", tl.time, F.inline(_levels(horizons))
    )
    group = [*tl.keys, "campaign", "horizon", "signal_level"]
    # At most `before` rows per group.
    order = Window.partitionBy(*group).orderBy(tl.time)
    following = F.lead(F.struct(F.col(tl.time).alias("t"), F.col("is_signal").alias("s"))).over(order)
    measured = (
        inside.withColumn("__next", following)
        .withColumn(
            "__sustained",
            F.col("is_signal")
            & F.coalesce(F.col("__next.s"), F.lit(False))
            & (F.col("__next.t") == tl.shift(tl.time, 1)),
        )
        .groupBy(*group)
        .agg(
            F.min(F.when(F.col("is_signal"), F.col(tl.time))).alias("first_signal"),
            F.min(F.when(F.col("__sustained"), F.col(tl.time))).alias("sustained_signal"),
            F.count_if("is_signal").alias("signal_count"),
            F.count(F.lit(1)).alias("__rows"),
        )
    )
    grid = campaigns.select(
        *[k for k in tl.keys if k in campaigns.columns],
        "campaign",
        "start",
        F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon"),
    ).withColumn("signal_level", F.explode(F.array(*[F.lit(n) for n in LEVELS])))
    on = [c for c in group if c in grid.columns]
    return grid.join(measured, on, "left").select(
        *tl.keys,
        F.lit("Attack").alias("evaluation"),
        "campaign",
        "horizon",
        "signal_level",
        "first_signal",
        tl.buckets_between("first_signal", "start").cast("long").alias("first_lead"),
        "sustained_signal",
        tl.buckets_between("sustained_signal", "start").cast("long").alias("sustained_lead"),
        F.coalesce("signal_count", F.lit(0)).alias("signal_count"),
        F.when(F.col("signal_count") > 0, F.col("signal_count") / F.col("__rows"))
        .otherwise(F.lit(0.0))
        .alias("signal_rate"),
    )


def false_signals(
    engine: DataFrame, campaigns: DataFrame, tl: Timeline, horizons: Iterable[int] = HORIZONS
) -> DataFrame:
    """Per horizon and level: signals and signal rate in the normal period."""
    horizons = list(horizons)
    return (
        normal_period(engine, campaigns, tl)
        .select(F.inline(_levels(horizons)))
        .groupBy("horizon", "signal_level")
        .agg(
            F.count_if("is_signal").alias("signal_count"),
            F.avg(F.col("is_signal").cast("double")).alias("signal_rate"),
        )
        .select(
            F.lit("Normal").alias("evaluation"),
            F.lit("Normal Period").alias("campaign"),
            "horizon",
            "signal_level",
            "signal_count",
            "signal_rate",
        )
    )


def evaluation_report(
    engine: DataFrame, campaigns: DataFrame, tl: Timeline, before: int = 30
) -> DataFrame:
    """Campaign rows and normal-period rows in one report; fields that do not apply are null."""
    return signal_evaluation(engine, campaigns, tl, before).unionByName(
        false_signals(engine, campaigns, tl), allowMissingColumns=True
    )


def early_warning(
    scores: DataFrame,
    campaigns: DataFrame,
    thresholds: DataFrame,
    tl: Timeline,
    before: int = 30,
    threshold: str = "p95",
) -> DataFrame:
    """Per campaign: crossings, first and sustained (3 of 5) warning, and error statistics."""
    inside = with_row(
        pre_attack_window(scores, campaigns, tl, before),
        thresholds.select(F.col(threshold).alias("__thr")),
    )
    flagged = inside.withColumn("__above", (F.col("mse") > F.col("__thr")).cast("int"))
    group = [*tl.keys, "campaign"]
    # At most `before` rows per group.
    last5 = Window.partitionBy(*group).orderBy(tl.time).rowsBetween(-4, 0)
    flagged = flagged.withColumn(
        "__sustained",
        F.when(F.count("mse").over(last5) >= 5, F.sum("__above").over(last5) >= 3),
    )
    t = F.col(tl.time)
    stats = flagged.groupBy(*group).agg(
        F.count(F.lit(1)).alias("samples"),
        F.sum("__above").alias("crossings"),
        F.min(F.when(F.col("__above") == 1, t)).alias("first_crossing"),
        F.count_if("__sustained").alias("sustained_count"),
        F.min(F.when(F.col("__sustained"), t)).alias("first_sustained"),
        F.min("mse").alias("min_mse"),
        F.percentile("mse", 0.5).alias("median_mse"),
        F.avg("mse").alias("mean_mse"),
        F.max("mse").alias("max_mse"),
    )
    joined = campaigns.join(stats, [c for c in group if c in campaigns.columns], "left")
    return joined.select(
        *tl.keys,
        "campaign",
        F.coalesce("samples", F.lit(0)).alias("samples"),
        F.coalesce("crossings", F.lit(0)).alias("crossings"),
        "first_crossing",
        tl.buckets_between("first_crossing", "start").alias("crossing_lead"),
        F.coalesce("sustained_count", F.lit(0)).alias("sustained_count"),
        "first_sustained",
        tl.buckets_between("first_sustained", "start").alias("sustained_lead"),
        "min_mse",
        "median_mse",
        "mean_mse",
        "max_mse",
    )


def early_warning_timeline(
    scores: DataFrame, campaigns: DataFrame, tl: Timeline, before: int = 30
) -> DataFrame:
    """The pre-attack rows with a 5-row rolling mean that starts inside each window."""
    inside = pre_attack_window(scores, campaigns, tl, before)
    # At most `before` rows per group.
    last5 = Window.partitionBy(*tl.keys, "campaign").orderBy(tl.time).rowsBetween(-4, 0)
    return inside.withColumn("rolling_5", F.avg("mse").over(last5))


def combined_warning(
    scores: DataFrame,
    rollout: DataFrame,
    engine: DataFrame,
    campaigns: DataFrame,
    thresholds: DataFrame,
    tl: Timeline,
    before: int = 30,
    steps: Iterable[int] = (1, 5, 10, 15),
    horizons: Iterable[int] = HORIZONS,
    lookback: int | None = None,
) -> DataFrame:
    """Earliest warning per campaign, signal and horizon; misses stay as rows with nulls.

    The engine warning has no lower time bound unless ``lookback`` is given. Unbounded, the first
    HIGH before a start is the first HIGH of all if that precedes the start, so one minimum per key
    and horizon replaces a join of every row with every later campaign.
    """
    steps, horizons = list(steps), list(horizons)
    shared = [k for k in tl.keys if k in campaigns.columns]
    result = [*tl.keys, "campaign", "signal", "horizon"]
    anomaly = (
        with_row(
            pre_attack_window(scores, campaigns, tl, before),
            thresholds.select(F.col("p99").alias("__thr")),
        )
        .filter(F.col("mse") > F.col("__thr"))
        .groupBy(*tl.keys, "campaign")
        .agg(F.min(tl.time).alias("warning_time"))
        .select(
            *tl.keys, "campaign", F.lit("state anomaly").alias("signal"),
            F.lit(0).alias("horizon"), "warning_time",
        )
    )
    reached = (
        pre_attack_window(
            rollout.filter(F.col("step").isin(*steps) & (F.col("above_99") == 1)),
            campaigns, tl, max(steps),
        )
        .filter(F.col("target_time") >= F.col("start"))
        .groupBy(*tl.keys, "campaign", "step")
        .agg(F.min(tl.time).alias("warning_time"))
        .select(
            *tl.keys, "campaign", F.lit("recursive forecast").alias("signal"),
            F.col("step").cast("int").alias("horizon"), "warning_time",
        )
    )
    high = engine.select(
        *tl.id,
        F.explode(
            F.array_compact(
                F.array(*[F.when(F.col(f"forecast_{h}") == "HIGH", F.lit(h)) for h in horizons])
            )
        ).alias("horizon"),
    )
    if lookback is None:
        first = high.groupBy(*tl.keys, "horizon").agg(F.min(tl.time).alias("warning_time"))
        paired = (
            campaigns.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
            .join(first, [*shared, "horizon"])
            .filter(F.col("warning_time") < F.col("start"))
        )
    else:
        paired = (
            pre_attack_window(high, campaigns, tl, lookback)
            .groupBy(*tl.keys, "campaign", "horizon")
            .agg(F.min(tl.time).alias("warning_time"))
        )
    engine_first = paired.select(
        *tl.keys, "campaign", F.lit("forecast engine").alias("signal"), "horizon", "warning_time"
    )
    found = anomaly.unionByName(reached).unionByName(engine_first)
    entries = [("state anomaly", 0)]
    entries += [("recursive forecast", s) for s in steps]
    entries += [("forecast engine", h) for h in horizons]
    grid = campaigns.select(
        *shared,
        "campaign",
        "start",
        F.inline(
            F.array(
                *[F.struct(F.lit(s).alias("signal"), F.lit(h).alias("horizon")) for s, h in entries]
            )
        ),
    )
    return grid.join(found, [c for c in result if c in grid.columns], "left").select(
        *result,
        "warning_time",
        tl.buckets_between("warning_time", "start").alias("lead"),
    )


def campaign_profile(
    states: DataFrame,
    periods: DataFrame,
    tl: Timeline,
    features: Iterable[str],
    first: str,
    second: str,
    normal: str,
    top: int | None = 20,
) -> DataFrame:
    """Mean of every feature in two campaigns and a normal period, ranked by relative difference.

    ``periods`` has rows (campaign, start, end); several rows may share a name.
    """
    features = list(features)
    tagged = interval_join(states, periods, tl, "start", "end")
    means = tagged.agg(
        *[
            F.avg(F.when(F.col("campaign") == p, F.col(c))).alias(f"__{i}_{c}")
            for i, p in enumerate((first, second, normal))
            for c in features
        ]
    )
    rows = means.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("feature"),
                        F.col(f"__0_{c}").alias("first_mean"),
                        F.col(f"__1_{c}").alias("second_mean"),
                        F.col(f"__2_{c}").alias("normal_mean"),
                    )
                    for c in features
                ]
            )
        )
    )
    a, b = F.col("first_mean"), F.col("second_mean")
    ranked = rows.withColumn(
        "difference_pct", F.abs(a - b) / (F.abs(a) + F.lit(1e-9)) * 100
    ).orderBy(F.col("difference_pct").desc(), "feature")
    return ranked if top is None else ranked.limit(top)


def around(df: DataFrame, at: str, tl: Timeline, before: int, after: int) -> DataFrame:
    """Rows from ``before`` buckets ahead of a moment to ``after`` buckets past it."""
    moment = F.lit(at).cast("timestamp")
    return df.filter(
        (F.col(tl.time) >= tl.shift(moment, -before)) & (F.col(tl.time) <= tl.shift(moment, after))
    )
