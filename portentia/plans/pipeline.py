"""The batch job: flows to dated tables of states, scores, targets, forecasts and snapshots."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portentia.operators.anomaly import anomaly_features, baseline_thresholds, forecast_dataset
from portentia.operators.campaigns import evaluation_report
from portentia.operators.prediction import score_states
from portentia.operators.risk import HORIZONS, forecast_engine
from portentia.operators.scaling import fit_scaler, scaler_table
from portentia.operators.sequences import forecast_targets
from portentia.operators.snapshot import snapshot_table
from portentia.operators.states import FLOW_COUNT, POSITIVE, build_states, feature_medians
from portentia.sources.tables import read_table, save_parameters, write_table
from portentia.timeline import Timeline


@dataclass(frozen=True)
class Settings:
    """What a batch run needs to know about the flows."""

    features: tuple[str, ...]
    label: str
    positive: str
    tl: Timeline = Timeline()
    time: str = "ts"
    ratio_threshold: float = 0.0
    method: str = "window_mean"
    exact_medians: bool = True
    baseline: Column | None = None


def run_batch(
    flows: DataFrame, out: str, settings: Settings, campaigns: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Write every stage below ``out`` and return the tables as read back.

    Each stage reads the table of the one before it: flows are scanned for the medians and once for
    the states, everything after works on rows per bucket. Tables are partitioned by date. A run writes
    every table anew.
    """
    tl = settings.tl
    spark = flows.sparkSession
    features: Iterable[str] = settings.features
    vector = [*settings.features, FLOW_COUNT]
    tables: dict[str, DataFrame] = {}

    def keep(name: str, df: DataFrame) -> DataFrame:
        write_table(df, f"{out}/{name}", tl.time)
        tables[name] = read_table(spark, f"{out}/{name}").drop("date")
        return tables[name]

    save_parameters(feature_medians(flows, features, settings.exact_medians), f"{out}/medians")
    medians = spark.read.parquet(f"{out}/medians")
    states = keep(
        "states",
        build_states(
            flows, features, tl, settings.label, settings.positive, settings.time,
            settings.ratio_threshold, medians,
        ),
    )
    fit_scaler(states, vector, tl).write.mode("overwrite").parquet(f"{out}/scaler")
    scaler = spark.read.parquet(f"{out}/scaler")
    scores = keep("scores", score_states(states, tl, vector, scaler, settings.method))
    baseline = F.col(POSITIVE) == 0 if settings.baseline is None else settings.baseline
    anomalies = keep("anomaly", anomaly_features(scores, tl, baseline_thresholds(scores, baseline)))
    targets = keep("targets", forecast_targets(states, tl))
    target_columns = [f"{k}_within_{h}" for h in HORIZONS for k in ("positive", "starts")]
    keep("dataset", forecast_dataset(anomalies, targets, tl, target_columns))
    engine = keep("engine", forecast_engine(anomalies))
    keep("snapshots", snapshot_table(engine, states, tl, vector))
    if campaigns is not None:
        tables["report"] = evaluation_report(engine, campaigns, tl)
    tables["medians"] = medians
    tables["scaler"] = scaler_table(scaler, vector)
    return tables
