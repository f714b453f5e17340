"""The registered batch queries: every operator on the test tables, flattened to scalar columns."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from portentia.functions.columns import (
    matches_label,
    ordinal,
    parse_day_first,
    threshold_ratio,
)
from portentia.operators import anomaly as A
from portentia.operators import campaigns as C
from portentia.operators import evaluation as E
from portentia.operators import prediction as P
from portentia.operators import quality as Q
from portentia.operators import risk as R
from portentia.operators import rollout as O
from portentia.operators import sequences as S
from portentia.operators import snapshot as N
from portentia.operators.scaling import scale_states, scaler_table
from portentia.operators.states import (
    POSITIVE,
    build_states,
    feature_medians,
    fill_medians,
    fill_normal_medians,
)
from portentia.plans import daily
from portentia.plans import fixture as X
from portentia.plans.pipeline import Settings
from portentia.runtime import run_dir, stage
from portentia.sources.flows import clean_flows as clean
from portentia.sources.flows import first_rows, in_time_range, read_csv
from portentia.timeline import Timeline, with_row_index

Query = Callable[[SparkSession, str], DataFrame]

TL = X.TIMELINE
KEYED = Timeline(bucket_seconds=3600, keys=("sensor",))
FEATURES = X.STATE_FEATURES
T0 = TL.time

ANOMALY_COLUMNS = [
    "rolling_3", "rolling_5", "rolling_10", "max_5", "max_10", "change_1", "change_3",
    "ratio_10", "above_95", "above_99", "above95_count_5", "above95_count_10",
]
RISK_COLUMNS = [
    *[f"risk_{h}" for h in R.HORIZONS], *[f"forecast_{h}" for h in R.HORIZONS],
    "forecast_score", "forecast_state", "forecast_reason", "ground_truth",
]
TARGET_COLUMNS = [f"{kind}_within_{h}" for h in R.HORIZONS for kind in ("positive", "starts")]
SNAPSHOT_TIME = "2024-01-15 12:00:00"


def presentable(df: DataFrame) -> DataFrame:
    """Doubles rounded to six places, times without zone.

    The nudge makes exact half-way values round the same way on engines that differ in the last bit.
    """
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c + F.lit(1e-9), 6)
        elif isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        out.append(c.alias(f.name))
    return df.select(*out)


# Sources, cleaning, imputation


def scan_flows(spark, sf):
    return X.table(spark, sf, "events")


def scan_pruned(spark, sf):
    return X.table(spark, sf, "events").select("ts", X.LABEL)


def scan_limit(spark, sf):
    return first_rows(X.table(spark, sf, "events"), ["ts", "event_id"], 100)


def clean_flows(spark, sf):
    return X.cleaned(spark, sf)


def network_states(spark, sf):
    flows = X.cleaned(spark, sf)
    medians = feature_medians(flows, X.DIRTY_FEATURES)
    return build_states(
        flows, X.DIRTY_FEATURES, TL, "Label", X.POSITIVE_LABEL,
        ratio_threshold=X.RATIO_THRESHOLD, medians=medians,
    )


def csv_states(spark, sf):
    """The same states from header CSV files: written as dirty text, read as text, cleaned."""
    path = run_dir(spark, "csv")
    X.raw_text_flows(spark, sf).drop("event_id").write.option("header", True).csv(path)
    raw = read_csv(spark, path, ["Timestamp", "Label", *X.DIRTY_FEATURES])
    flows = stage(clean(raw, X.DIRTY_FEATURES), "flows")
    return build_states(
        flows, X.DIRTY_FEATURES, TL, "Label", X.POSITIVE_LABEL,
        ratio_threshold=X.RATIO_THRESHOLD, medians=feature_medians(flows, X.DIRTY_FEATURES),
    )


def states_dirty_doubles(spark, sf):
    """States of flows whose double column holds NaN, infinities and nulls, without a cleaning step before."""
    e = F.col("event_id")
    value = (
        F.when(e % 97 == 0, F.lit(float("nan"))).when(e % 89 == 0, F.lit(float("inf")))
        .when(e % 83 == 0, F.lit(float("-inf"))).when(e % 79 != 0, F.col("value"))
    )
    flows = X.flows(spark, sf).withColumn("value", value)
    return build_states(
        flows, ["value"], TL, X.LABEL, X.POSITIVE_LABEL,
        ratio_threshold=X.RATIO_THRESHOLD, medians=feature_medians(flows, ["value"]),
    )


def is_time_ordered(spark, sf):
    events = X.flows(spark, sf).select(F.col("ts").alias(T0), "event_id")
    return S.is_time_ordered(events, TL, "event_id")


# Keyed series: one of four sensors, the rows of one of them without a key


def keyed_states(spark, sf):
    flows = X.flows(spark, sf).withColumn("sensor", F.nullif(F.col("user_id").cast("long") % 4, F.lit(3)))
    return build_states(flows, ["value"], KEYED, X.LABEL, X.POSITIVE_LABEL, ratio_threshold=X.RATIO_THRESHOLD)


def keyed_targets(spark, sf):
    return S.forecast_targets(stage(keyed_states(spark, sf), "states"), KEYED).select(*KEYED.id, *TARGET_COLUMNS)


def keyed_attack_periods(spark, sf):
    return S.attack_periods(stage(keyed_states(spark, sf), "states"), KEYED)


def keyed_row_index(spark, sf):
    return with_row_index(stage(keyed_states(spark, sf), "states").select(*KEYED.id, POSITIVE), KEYED)


def impute_median(spark, sf):
    flows = X.cleaned(spark, sf)
    filled = fill_medians(flows, X.DIRTY_FEATURES, feature_medians(flows, X.DIRTY_FEATURES))
    return filled.select("event_id", *X.DIRTY_FEATURES)


def impute_normal_median(spark, sf):
    states = stage(
        build_states(
            X.cleaned(spark, sf), X.DIRTY_FEATURES, TL, "Label", X.POSITIVE_LABEL,
            ratio_threshold=X.RATIO_THRESHOLD,
        ),
        "states",
    )
    return fill_normal_medians(states, X.DIRTY_FEATURES).select(T0, *X.DIRTY_FEATURES)


def feature_medians_query(spark, sf):
    return feature_medians(X.cleaned(spark, sf), X.DIRTY_FEATURES)


def missing_check(spark, sf):
    return Q.missing_check(X.raw_text_flows(spark, sf), X.DIRTY_FEATURES)


def time_range(spark, sf):
    """The bounds are bucket-aligned, so they are put on the raw column, where the scan can use them."""
    events = in_time_range(
        X.table(spark, sf, "events"), "2024-01-10 00:00:00", "2024-01-12 00:00:00", "ts"
    )
    return build_states(
        X.typed_flows(events), [], TL, X.LABEL, X.POSITIVE_LABEL, ratio_threshold=X.RATIO_THRESHOLD
    )


def label_counts(spark, sf):
    return Q.value_counts(X.table(spark, sf, "events"), X.LABEL)


def flows_per_hour(spark, sf):
    events = X.flows(spark, sf)
    values = [*X.OTHER_TYPES, X.POSITIVE_LABEL]
    return Q.crosstab(
        events.select("ts", X.LABEL), F.date_trunc("hour", "ts"), "hour", X.LABEL, sorted(values)
    )


def distinct_labels(spark, sf):
    return X.table(spark, sf, "events").select(X.LABEL).distinct()


def time_extent(spark, sf):
    raw = X.raw_text_flows(spark, sf)
    return Q.time_extent(raw.select(parse_day_first("Timestamp").alias("ts")), "ts")


def label_extent(spark, sf):
    flows = X.cleaned(spark, sf)
    return Q.label_extent(
        flows, "ts", matches_label("Label", "error") == 1, matches_label("Label", "view") == 1
    )


# Sequences, targets, runs, splits


def contiguous_states(spark, sf):
    return S.contiguous_states(X.states(spark, sf), TL).select(T0, "has_history", "has_target")


def world_sequences(spark, sf):
    seq = S.sequences(X.states(spark, sf), TL, FEATURES)
    return seq.select(
        T0,
        "target_time",
        "target_positive",
        F.size("x").alias("steps"),
        F.col("x")[0][0].alias("first_value"),
        F.col("x")[9][2].alias("last_k"),
        F.aggregate("x", F.lit(0.0), lambda a, v: a + v[len(FEATURES) - 1]).alias("flows_in"),
        F.col("y")[1].alias("target_user_id"),
    )


def label_sequences(spark, sf):
    seq = S.sequences(X.states(spark, sf), TL, FEATURES, check_gaps=False)
    return seq.select(
        T0,
        "target_positive",
        F.col("x")[0][0].alias("first_value"),
        F.aggregate("x", F.lit(0.0), lambda a, v: a + v[len(FEATURES) - 1]).alias("flows_in"),
    )


def normal_sequences(spark, sf):
    seq = S.sequences(X.states(spark, sf), TL, FEATURES, normal_only=True)
    return seq.select(T0, "target_time", F.col("x")[0][0].alias("first_value"))


def scaler_params(spark, sf):
    return scaler_table(X.scaler(X.states(spark, sf)), FEATURES)


def scaled_states(spark, sf):
    states = X.states(spark, sf)
    return scale_states(states, FEATURES, X.scaler(states)).select(T0, *FEATURES)


def forecast_targets(spark, sf):
    return S.forecast_targets(X.states(spark, sf), TL).select(T0, *TARGET_COLUMNS)


def state_transitions(spark, sf):
    return S.state_transitions(X.states(spark, sf), TL)


def attack_periods(spark, sf):
    return S.attack_periods(X.states(spark, sf), TL)


def index_blocks(spark, sf):
    indexed = with_row_index(X.states(spark, sf).select(T0, POSITIVE), TL)
    return S.index_blocks(indexed, TL, F.col(POSITIVE) == 1)


def positional_split(spark, sf):
    return S.positional_split(X.states(spark, sf).select(T0), TL, 400, 700).select(
        T0, "row_index", "split"
    )


def chrono_split(spark, sf):
    return S.chronological_split(X.states(spark, sf).select(T0), TL, 0.8).select(T0, "split")


def stratified_split_exact(spark, sf):
    return S.exact_stratified_split(X.states(spark, sf), POSITIVE, [T0], 0.8).select(T0, POSITIVE, "split")


def stratified_split(spark, sf):
    return S.stratified_split(X.states(spark, sf), POSITIVE, [T0]).select(T0, POSITIVE, "split")


def first_positive_states(spark, sf):
    positives = X.states(spark, sf).filter(F.col(POSITIVE) == 1)
    return first_rows(positives.select(T0, "flow_count", "label_ratio"), [T0], 10)


def class_weights(spark, sf):
    return E.class_weights(X.states(spark, sf), POSITIVE)


# Prediction errors


def prediction_errors(spark, sf):
    scores = P.with_top_feature(X.scores(X.states(spark, sf)), FEATURES)
    return scores.select(
        T0, "source_time", POSITIVE, "mse", "mae", "top_feature", "top_feature_error",
        "predicted_magnitude", "actual_magnitude",
    )


def top_feature_errors(spark, sf):
    return P.top_feature_errors(X.scores(X.states(spark, sf)), TL, FEATURES, 3)


def topk_error_scores(spark, sf):
    scores = P.top_mean_scores(X.scores(X.states(spark, sf)), (3, 5))
    return scores.select(T0, POSITIVE, "mse", "top3_error", "top5_error")


def feature_error_map(spark, sf):
    mapped = P.feature_error_map(X.scores(X.states(spark, sf)), FEATURES)
    return mapped.select(T0, F.explode("feature_errors").alias("feature", "error"))


def baseline_thresholds(spark, sf):
    return X.thresholds(X.scores(X.states(spark, sf)))


def normal_error_baseline(spark, sf):
    return _normal_baseline(X.scores(X.states(spark, sf)))


def _normal_baseline(scores):
    return A.baseline_thresholds(scores, F.col(POSITIVE) == 0, (0.5, 0.95, 0.99)).select(
        F.col("p50").alias("median"), "p95", "p99"
    )


def score_describe(spark, sf):
    return A.describe_scores(X.scores(X.states(spark, sf)), by=POSITIVE)


def detection_rates(spark, sf):
    scores = X.scores(X.states(spark, sf))
    return A.detection_rates(scores, X.thresholds(scores))


def analysis_summary(spark, sf):
    return A.score_summary(X.scores(X.states(spark, sf)), TL)


def anomaly_features(spark, sf):
    return X.anomaly(X.scores(X.states(spark, sf))).select(
        T0, POSITIVE, "mse", "mae", *ANOMALY_COLUMNS
    )


def forecast_dataset(spark, sf):
    states = X.states(spark, sf)
    features = X.anomaly(X.scores(states)).select(T0, POSITIVE, "mse", "mae", *ANOMALY_COLUMNS)
    return A.forecast_dataset(features, S.forecast_targets(states, TL), TL, TARGET_COLUMNS)


# Rules


def _engine(spark, sf):
    return X.engine(X.scores(X.states(spark, sf)))


def daily_engine(spark, sf):
    """The month added in three runs of dates, with stored parameters: the forecasts of one run over all."""
    flows, out = X.flows(spark, sf), run_dir(spark, "daily")
    settings = Settings(
        tuple(X.FLOW_FEATURES), X.LABEL, X.POSITIVE_LABEL, TL, ratio_threshold=X.RATIO_THRESHOLD
    )
    daily.fit_parameters(flows, out, settings)
    for first, last in (("2024-01-01", "2024-01-10"), ("2024-01-11", "2024-01-20"), ("2024-01-21", "2024-12-31")):
        tables = daily.add_dates(flows, out, settings, first, last)
    return tables["engine"].select(T0, POSITIVE, "mse", *RISK_COLUMNS)


def forecast_engine(spark, sf):
    return _engine(spark, sf).select(T0, POSITIVE, "mse", *RISK_COLUMNS)


def forecast_ordinal(spark, sf):
    return _engine(spark, sf).select(
        T0, "forecast_state", *[ordinal(f"forecast_{h}").alias(f"level_{h}") for h in R.HORIZONS]
    )


def high_risk_events(spark, sf):
    return N.risk_events(_engine(spark, sf), "HIGH").select(
        T0, "forecast_score", "forecast_reason"
    )


def forecast_at(spark, sf):
    at = F.lit(SNAPSHOT_TIME).cast("timestamp")
    return _engine(spark, sf).filter(F.col(T0) == at).select(T0, POSITIVE, *RISK_COLUMNS)


def latest_forecast(spark, sf):
    engine = _engine(spark, sf)
    row = F.struct(T0, "forecast_score", "forecast_state", "ground_truth")
    return engine.agg(F.max_by(row, T0).alias("r")).select("r.*")


def forecast_summary(spark, sf):
    return N.forecast_summary(_engine(spark, sf), TL)


def threshold_ratio_query(spark, sf):
    return X.anomaly(X.scores(X.states(spark, sf))).select(
        T0,
        threshold_ratio("mse", "p95").alias("ratio_95"),
        threshold_ratio("change_3", "p99").alias("change_ratio_99"),
    )


def forecast_rules(spark, sf):
    features = X.anomaly(X.scores(X.states(spark, sf)))
    return features.select(T0, POSITIVE, R.rule_state().alias("rule_state"))


def rule_confusion(spark, sf):
    features = X.anomaly(X.scores(X.states(spark, sf))).withColumn(
        "truth", F.when(F.col(POSITIVE) == 1, "attack").otherwise("normal")
    )
    return Q.crosstab(features, R.rule_state(), "rule_state", "truth", ["attack", "normal"])


def live_forecast(spark, sf):
    scores = P.with_top_feature(X.scores(X.states(spark, sf)), FEATURES)
    live = R.live_forecast(scores, TL)
    return live.select(
        T0, "mse", "baseline", "ratio", "current_level",
        "above95_count_5", "above95_count_10", "above99_count_5", "above99_count_10",
        *[f"risk_{h}" for h in R.HORIZONS], *[f"state_{h}" for h in R.HORIZONS],
        "top_feature", "reason",
    )


TERMS = {"reconnaissance_terms": X.RECONNAISSANCE_TERMS, "command_terms": X.COMMAND_TERMS}


def attack_stage(spark, sf):
    return N.staged(_engine(spark, sf), FEATURES, 3, **TERMS).select(
        T0,
        F.col("stage.stage").alias("stage"),
        F.col("stage.confidence").alias("confidence"),
        F.array_join("stage.evidence", " | ").alias("evidence"),
        F.col("stage.explanation").alias("explanation"),
        F.col("stage.mitre_context").alias("mitre_context"),
    )


def snapshot(spark, sf):
    states = X.states(spark, sf)
    table = N.snapshot_table(X.engine(X.scores(states)), states, TL, FEATURES, 3, **TERMS)
    return table.select(
        T0, "mse", "mae", "flow_count", "label_ratio", POSITIVE, *RISK_COLUMNS,
        "top_feature",
        "top_features",
        F.col("stage.stage").alias("stage"),
        F.col("stage.confidence").alias("confidence"),
    )


def timeline_enriched(spark, sf):
    states = X.states(spark, sf)
    scores = X.scores(states)
    return N.enriched_timeline(X.engine(scores), scores, states, TL)


def state_diff(spark, sf):
    """Imputed states of the cleaned text against the states of the typed events."""
    typed = build_states(
        X.flows(spark, sf), X.DIRTY_FEATURES, TL, X.LABEL, X.POSITIVE_LABEL,
        ratio_threshold=X.RATIO_THRESHOLD,
    )
    columns = [*X.DIRTY_FEATURES, "flow_count", "label_ratio"]
    return Q.compare_tables(network_states(spark, sf), typed, [T0], columns)


# Campaigns


def pre_attack_window(spark, sf):
    """Campaigns found in the data: runs of at least two positive states."""
    states = X.states(spark, sf)
    campaigns = (
        S.attack_periods(states, TL)
        .filter(F.col("duration") >= 2)
        .select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("campaign"), "start", "end")
    )
    scores = X.scores(states)
    return C.pre_attack_window(scores, campaigns, TL, 10).select(
        "campaign", T0, "mse", F.col("lead").cast("long").alias("lead")
    )


def normal_period(spark, sf):
    return C.normal_period(X.scores(X.states(spark, sf)), X.campaigns(spark), TL).select(T0, "mse")


def signal_eval(spark, sf):
    engine = stage(_engine(spark, sf).select(T0, POSITIVE, *RISK_COLUMNS), "engine")
    return C.evaluation_report(engine, X.campaigns(spark), TL)


def false_signals(spark, sf):
    return C.false_signals(_engine(spark, sf), X.campaigns(spark), TL)


def early_warning(spark, sf):
    scores = X.scores(X.states(spark, sf))
    return C.early_warning(scores, X.campaigns(spark), X.thresholds(scores), TL)


def combined_warning(spark, sf):
    states = X.states(spark, sf)
    scores = X.scores(states)
    rollout = O.rollout_evaluation(states, TL, FEATURES, X.scaler(states), _normal_baseline(scores))
    return C.combined_warning(
        scores, rollout, X.engine(scores), X.campaigns(spark), X.thresholds(scores), TL
    )


def campaign_profile(spark, sf):
    return C.campaign_profile(
        X.states(spark, sf), X.periods(spark), TL, FEATURES, "first", "second", "normal"
    )


def attack_window(spark, sf):
    scores = X.scores(X.states(spark, sf))
    return C.around(scores, SNAPSHOT_TIME, TL, 30, 10).select(T0, POSITIVE, "mse", "mae")


# Rollouts


def _paths(states, steps=15):
    return O.forecast_paths(states, TL, FEATURES, X.scaler(states), steps)


def rollout(spark, sf):
    return O.rollout_signals(_paths(X.states(spark, sf)), TL)


def rollout_linear(spark, sf):
    """Fifteen steps of a linear model with cross weights."""
    states = X.states(spark, sf)
    paths = O.forecast_paths(states, TL, FEATURES, X.scaler(states), weights=np.array(X.linear_weights()))
    return O.rollout_signals(paths, TL).select(
        T0, "step", "target_time", "transition_shock", "future_state_deviation", "mean_abs_deviation", "max_deviation",
        "future_stability", "simulation_risk",
    )


def rollout_linear_eval(spark, sf):
    """The same model against what was then observed."""
    states = X.states(spark, sf)
    baseline = _normal_baseline(X.scores(states))
    return O.rollout_evaluation(states, TL, FEATURES, X.scaler(states), baseline, weights=np.array(X.linear_weights()))


def rollout_fitted(spark, sf):
    """A fitted model: the first step of its rollout against its own one-step scores of the same minutes."""
    states = X.states(spark, sf)
    scaler = X.scaler(states)
    weights = P.fit_next_state(states, TL, FEATURES, scaler)
    baseline = _normal_baseline(X.scores(states))
    first = O.rollout_evaluation(states, TL, FEATURES, scaler, baseline, steps=1, weights=weights)
    scored = P.score_linear(states, TL, FEATURES, scaler, weights)
    return Q.compare_tables(first.withColumn(T0, F.col("target_time")), scored, [T0], ["mse", "mae"])


def rollout_states(spark, sf):
    states = X.states(spark, sf)
    return O.rollout_states(_paths(states, 5), TL, FEATURES, X.scaler(states))


def rollout_trend(spark, sf):
    return O.rollout_trend(_paths(X.states(spark, sf)), TL)


def rollout_scenarios(spark, sf):
    """Origins before campaigns against origins of two calm days, as two appended scenarios."""
    signals = O.rollout_signals(_paths(X.states(spark, sf)), TL)
    before = C.pre_attack_window(signals, X.campaigns(spark), TL, 10).withColumn(
        "scenario", F.concat(F.lit("pre-attack "), "campaign")
    )
    calm = in_time_range(signals, "2024-01-02 00:00:00", "2024-01-04 00:00:00").withColumn(
        "scenario", F.lit("calm")
    )
    columns = [
        "scenario", T0, "step", "target_time", "transition_shock", "future_state_deviation",
        "simulation_risk",
    ]
    both = before.select(*columns).unionByName(calm.select(*columns))
    return O.rollout_scenarios(both)


def _evaluation(spark, sf):
    states = X.states(spark, sf)
    baseline = _normal_baseline(X.scores(states))
    return O.rollout_evaluation(states, TL, FEATURES, X.scaler(states), baseline)


def rollout_eval(spark, sf):
    return _evaluation(spark, sf)


def rollout_summary(spark, sf):
    return O.rollout_summary(_evaluation(spark, sf))


# Metrics


def _predictions(spark, sf):
    states = X.states(spark, sf)
    engine = X.engine(X.scores(states)).select(
        T0, "mse", (F.col("forecast_score") / 10).alias("probability")
    )
    targets = S.forecast_targets(states, TL).select(T0, "positive_within_10")
    return engine.join(targets, T0).dropna(subset=["positive_within_10"])


def classifier_metrics(spark, sf):
    predicted = _predictions(spark, sf).withColumn("predicted", E.cut("probability"))
    return E.classifier_metrics(predicted, "positive_within_10", "predicted")


def roc_auc(spark, sf):
    scored = stage(_predictions(spark, sf), "predictions")
    by_mse = E.roc_auc(scored, "positive_within_10", "mse").withColumn("score", F.lit("mse"))
    by_risk = E.roc_auc(scored, "positive_within_10", "probability").withColumn(
        "score", F.lit("risk")
    )
    return by_mse.unionByName(by_risk)


# Flagship


def flagship(spark: SparkSession, sf_dir: str, tl: Timeline | None = None) -> DataFrame:
    """Events to scored states with risk levels, end to end. Hourly buckets by default."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    tl = tl or Timeline(bucket_seconds=3600)
    scores = X.scores(X.states(spark, sf_dir, tl), tl)
    columns = [T0, POSITIVE, "mse", "mae", *ANOMALY_COLUMNS, *RISK_COLUMNS]
    return presentable(X.engine(scores, tl).select(*columns))


BATCH: dict[str, Query] = {
    "scan_flows": scan_flows,
    "scan_pruned": scan_pruned,
    "scan_limit": scan_limit,
    "clean_flows": clean_flows,
    "time_range": time_range,
    "network_states": network_states,
    "csv_states": csv_states,
    "states_dirty_doubles": states_dirty_doubles,
    "is_time_ordered": is_time_ordered,
    "keyed_states": keyed_states,
    "keyed_targets": keyed_targets,
    "keyed_attack_periods": keyed_attack_periods,
    "keyed_row_index": keyed_row_index,
    "impute_median": impute_median,
    "impute_normal_median": impute_normal_median,
    "feature_medians": feature_medians_query,
    "missing_check": missing_check,
    "label_counts": label_counts,
    "flows_per_hour": flows_per_hour,
    "distinct_labels": distinct_labels,
    "time_extent": time_extent,
    "label_extent": label_extent,
    "contiguous_states": contiguous_states,
    "world_sequences": world_sequences,
    "label_sequences": label_sequences,
    "normal_sequences": normal_sequences,
    "scaler_params": scaler_params,
    "scaled_states": scaled_states,
    "forecast_targets": forecast_targets,
    "state_transitions": state_transitions,
    "attack_periods": attack_periods,
    "index_blocks": index_blocks,
    "positional_split": positional_split,
    "chrono_split": chrono_split,
    "stratified_split": stratified_split,
    "stratified_split_exact": stratified_split_exact,
    "first_positive_states": first_positive_states,
    "class_weights": class_weights,
    "prediction_errors": prediction_errors,
    "top_feature_errors": top_feature_errors,
    "topk_error_scores": topk_error_scores,
    "feature_error_map": feature_error_map,
    "baseline_thresholds": baseline_thresholds,
    "normal_error_baseline": normal_error_baseline,
    "score_describe": score_describe,
    "detection_rates": detection_rates,
    "analysis_summary": analysis_summary,
    "anomaly_features": anomaly_features,
    "forecast_dataset": forecast_dataset,
    "forecast_engine": forecast_engine,
    "daily_engine": daily_engine,
    "forecast_ordinal": forecast_ordinal,
    "high_risk_events": high_risk_events,
    "forecast_at": forecast_at,
    "latest_forecast": latest_forecast,
    "forecast_summary": forecast_summary,
    "threshold_ratio": threshold_ratio_query,
    "forecast_rules": forecast_rules,
    "rule_confusion": rule_confusion,
    "live_forecast": live_forecast,
    "attack_stage": attack_stage,
    "snapshot": snapshot,
    "timeline_enriched": timeline_enriched,
    "state_diff": state_diff,
    "pre_attack_window": pre_attack_window,
    "normal_period": normal_period,
    "signal_eval": signal_eval,
    "false_signals": false_signals,
    "early_warning": early_warning,
    "combined_warning": combined_warning,
    "campaign_profile": campaign_profile,
    "attack_window": attack_window,
    "rollout": rollout,
    "rollout_linear": rollout_linear,
    "rollout_linear_eval": rollout_linear_eval,
    "rollout_fitted": rollout_fitted,
    "rollout_states": rollout_states,
    "rollout_trend": rollout_trend,
    "rollout_scenarios": rollout_scenarios,
    "rollout_eval": rollout_eval,
    "rollout_summary": rollout_summary,
    "classifier_metrics": classifier_metrics,
    "roc_auc": roc_auc,
}


def registered(query: Query) -> Query:
    """Run a query in UTC and present its result."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return presentable(query(spark, sf_dir))

    return run
