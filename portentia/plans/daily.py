"""The batch job day by day: new dates are added, what is there stays untouched.

Parameters (medians, scaler, thresholds) are fitted once and stored. A run adds a range of dates to the tables of states,
scores, anomaly features and forecasts. Windows look back over rows, across gaps of any length, so next to every table
the last rows of each key are kept; a run reads those and its own dates, never the history. A stage that is complete has
a record, written after its table: a run that was killed goes on with the stages that have none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from portentia.operators.anomaly import anomaly_features, baseline_thresholds
from portentia.operators.prediction import score_states
from portentia.operators.risk import forecast_engine
from portentia.operators.scaling import fit_scaler
from portentia.operators.states import FLOW_COUNT, POSITIVE, build_states, feature_medians
from portentia.plans.pipeline import Settings
from portentia.runtime import stage
from portentia.sources.tables import load_parameters, save_parameters, write_table
from portentia.timeline import Timeline

#: Rows before a date that a score, and the rolling features of one, look back to.
SCORE_ROWS, ANOMALY_ROWS = 10, 9
RECORD = "stage string, first date, last date, rows long"


def fit_parameters(flows: DataFrame, out: str, settings: Settings) -> None:
    """Fit and store what the runs share: medians, the scaler and the thresholds of normal errors."""
    tl, vector = settings.tl, [*settings.features, FLOW_COUNT]
    save_parameters(feature_medians(flows, settings.features, settings.exact_medians), f"{out}/medians")
    medians = load_parameters(flows.sparkSession, f"{out}/medians")
    states = stage(_states(flows, settings, medians), "states")
    fit_scaler(states, vector, tl).write.mode("overwrite").parquet(f"{out}/scaler")
    scaler = load_parameters(flows.sparkSession, f"{out}/scaler")
    scores = stage(score_states(states, tl, vector, scaler, settings.method), "scores")
    baseline = F.col(POSITIVE) == 0 if settings.baseline is None else settings.baseline
    save_parameters(baseline_thresholds(scores, baseline), f"{out}/thresholds")


def _states(flows: DataFrame, settings: Settings, medians: DataFrame) -> DataFrame:
    return build_states(
        flows, settings.features, settings.tl, settings.label, settings.positive, settings.time, settings.ratio_threshold, medians
    )


def records(spark: SparkSession, out: str) -> DataFrame:
    """What is complete: one row per stage and range of dates."""
    try:
        return spark.read.schema(RECORD).parquet(f"{out}/records/*")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], RECORD)


def add_dates(flows: DataFrame, out: str, settings: Settings, first: str, last: str) -> dict[str, DataFrame]:
    """Add the dates from ``first`` to ``last`` (inclusive, UTC) to the tables below ``out``; returns the tables.

    Dates are added in order: a range that begins before the end of a complete one is refused, unless it is the same
    range again. Buckets must not cross midnight.
    """
    spark, tl = flows.sparkSession, settings.tl
    if 86_400 % tl.bucket_seconds:
        raise ValueError("a day must hold whole buckets")
    start, end = (F.to_date(F.lit(d)) for d in (first, last))
    known = records(spark, out)
    clash = known.filter((F.col("last") >= start) & ~((F.col("first") == start) & (F.col("last") == end)))
    if not clash.isEmpty():
        raise ValueError(f"dates up to {clash.agg(F.max('last')).first()[0]} are there already")
    done = {r["stage"] for r in known.filter(F.col("first") == start).select("stage").collect()}  # a few stages
    earlier = known.filter(F.col("last") < start).agg(F.max("first").cast("string")).first()[0]
    medians, scaler, thresholds = (load_parameters(spark, f"{out}/{p}") for p in ("medians", "scaler", "thresholds"))
    vector = [*settings.features, FLOW_COUNT]

    def of_range(df: DataFrame, time: str) -> DataFrame:
        return df.filter((F.col(time) >= start.cast("timestamp")) & (F.col(time) < F.date_add(end, 1).cast("timestamp")))

    def own(name: str) -> DataFrame:
        return spark.read.parquet(f"{out}/{name}").filter(F.col("date").between(start, end)).drop("date")

    def with_tail(name: str) -> DataFrame:
        """The rows of the range and the last ones of each key before it."""
        return own(name) if earlier is None else own(name).unionByName(spark.read.parquet(f"{out}/tails/{name}/{earlier}"))

    def keep(name: str, make: Callable[[], DataFrame], tail_rows: int = 0) -> None:
        if name in done:
            return
        write_table(make(), f"{out}/{name}", tl.time, replace="dates")
        if tail_rows:
            _last_rows(with_tail(name), tl, tail_rows).write.mode("overwrite").parquet(f"{out}/tails/{name}/{first}")
        record = own(name).agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("stage"), start.alias("first"), end.alias("last"), "rows"
        )
        record.write.mode("overwrite").parquet(f"{out}/records/{name}-{first}")

    keep("states", lambda: _states(of_range(flows, settings.time), settings, medians), SCORE_ROWS)
    keep("scores", lambda: of_range(score_states(with_tail("states"), tl, vector, scaler, settings.method), tl.time), ANOMALY_ROWS)
    keep("anomaly", lambda: of_range(anomaly_features(with_tail("scores"), tl, thresholds), tl.time))
    keep("engine", lambda: forecast_engine(own("anomaly")))
    return {n: spark.read.parquet(f"{out}/{n}").drop("date") for n in ("states", "scores", "anomaly", "engine")}


def _last_rows(df: DataFrame, tl: Timeline, rows: int) -> DataFrame:
    """The newest rows of every key; tasks drop older ones before the exchange."""
    newest = (Window.partitionBy(*tl.keys) if tl.keys else Window.partitionBy(F.lit(0))).orderBy(F.col(tl.time).desc())
    return df.withColumn("__age", F.row_number().over(newest)).filter(F.col("__age") <= rows).drop("__age")
