"""The registered model queries, at the library's full size (300 trees, 200 rounds, 2000 steps).

A fitted model is no SQL result. Each query gives what SQL can count (rows and positives on each side of each split) and
``sound``: that the fit and its report pass a check made over all rows. For logistic models the gradient of the penalised
loss at the coefficients is close to zero; for the linear next-state models the normal equations, or the gradient of the
Huber loss, leave no residual; for all classifiers the confusion counts are counted again from the stored predictions, the
AUC is recomputed by rank sums, and on the training rows it must be above that of a constant predictor. This proves that
the optimum was found and that reports add up, not that the trees are the best ones. ``horizon_metrics`` and
``coefficient_ranks`` give the metrics and coefficients themselves; they have no SQL.
"""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from portentia.operators import models as M
from portentia.operators import prediction as P
from portentia.operators import sequences as S
from portentia.operators.anomaly import forecast_dataset
from portentia.functions.rows import with_row
from portentia.operators.campaigns import campaign_table, interval_join
from portentia.operators.scaling import scale_states
from portentia.operators.states import POSITIVE
from portentia.plans import fixture as X
from portentia.plans.catalogue import FEATURES, TARGET_COLUMNS, TL, Query
from portentia.runtime import in_parallel, stage

GRADIENT = 1e-3
HOLDOUT = (
    "train string, horizon int, model string, train_rows long, train_positives long, test_rows long, test_positives long, sound boolean"
)
HALVES = (
    ("first half", "2024-01-01 00:00:00", "2024-01-15 23:45:00"),
    ("second half", "2024-01-16 00:00:00", "2024-01-30 23:45:00"),
)


def _dataset(spark, sf) -> DataFrame:
    states = X.states(spark, sf)
    features = X.anomaly(X.scores(states)).select(*TL.id, POSITIVE, *M.HORIZON_FEATURES)
    return stage(
        forecast_dataset(features, S.forecast_targets(states, TL), TL, TARGET_COLUMNS), "dataset"
    )


def _counts(rows: DataFrame, side: str) -> DataFrame:
    return rows.agg(
        F.count(F.lit(1)).alias(f"{side}_rows"), F.coalesce(F.sum(F.col("label").cast("long")), F.lit(0)).alias(f"{side}_positives")
    )


def _rank_auc(predicted: DataFrame) -> DataFrame:
    """One row (n, pos, hits, alarms, rank_auc): the AUC by the sum of the positives' mid-ranks."""
    ranks = predicted.groupBy("probability").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("pos"))
    order = Window.partitionBy(F.lit(0)).orderBy("probability")  # a check over the distinct scores of a report
    ranks = ranks.withColumn("upto", F.sum("n").over(order))
    hit = F.col("probability") >= 0.5
    pos, n = F.sum("pos"), F.sum("n")
    mid = F.sum(F.col("pos") * (F.col("upto") - (F.col("n") - 1) / 2))
    return ranks.agg(
        F.coalesce(n, F.lit(0)).alias("n"), F.coalesce(pos, F.lit(0)).alias("pos"),
        F.coalesce(F.sum(F.when(hit, F.col("pos"))), F.lit(0)).alias("hits"),
        F.coalesce(F.sum(F.when(hit, F.col("n") - F.col("pos"))), F.lit(0)).alias("alarms"),
        F.when((pos > 0) & (n > pos), (mid - pos * (pos + 1) / 2) / (pos * (n - pos))).alias("rank_auc"),
    )


def _sound(predicted: DataFrame, learned: DataFrame) -> DataFrame:
    """One row: does the report of (label, predicted, probability) follow from the predictions, and do the predictions for
    the training rows rank better than a constant?"""
    predicted = stage(predicted.select("label", "predicted", "probability"), "predicted")
    learned = stage(learned.select("label", "probability"), "predicted")
    own = _rank_auc(learned).select(F.col("rank_auc").alias("own_auc"))
    facts = with_row(with_row(M.evaluate(predicted), _rank_auc(predicted)), own)
    neg = F.col("n") - F.col("pos")
    same = F.coalesce(F.abs(F.col("auc") - F.col("rank_auc")) < 1e-9, F.col("auc").isNull() & F.col("rank_auc").isNull())
    return facts.select(
        ((F.col("tp") == F.col("hits")) & (F.col("fp") == F.col("alarms")) & (F.col("tp") + F.col("fn") == F.col("pos"))
         & (F.col("tn") + F.col("fp") == neg) & same & F.coalesce(F.col("own_auc") > 0.5, F.lit(True))).alias("sound")
    )


def _fitted(train: DataFrame, test: DataFrame, name: str) -> DataFrame:
    """Counts of both sides and whether the fit and its report are sound."""
    model = M.fit_horizon(train, name)
    sound = _sound(model.predict(test), model.predict(train))
    out = with_row(with_row(_counts(train, "train"), _counts(test, "test")), sound)
    if name == "logistic":
        out = out.withColumn("sound", F.col("sound") & F.lit(M.logistic_gradient(model, train) < GRADIENT))
    return stage(out, "report")


def _horizon_sides(spark, sf) -> dict[int, tuple[DataFrame, DataFrame]]:
    """Train and test rows of a chronological 70/30 split per horizon."""
    dataset = _dataset(spark, sf)
    sides = {}
    for h in (5, 10, 15):
        rows = stage(S.chronological_split(M.horizon_rows(dataset, TL, f"starts_within_{h}"), TL, 0.7), "horizon")
        sides[h] = tuple(rows.filter(F.col("split") == s) for s in ("train", "test"))
    return sides


def _horizon_report(spark, sf, name: str) -> DataFrame:
    sides = _horizon_sides(spark, sf)
    reports = in_parallel(spark, [partial(_fitted, *sides[h], name) for h in sides])
    return reduce(DataFrame.unionByName, [r.select(F.lit(h).alias("horizon"), "*") for h, r in zip(sides, reports)])


def horizon_metrics(spark, sf):
    """Confusion counts, rates and AUC of every model and horizon on its test side."""
    sides = _horizon_sides(spark, sf)
    grid = [(h, m) for h in sides for m in M.MODELS]
    reports = in_parallel(spark, [lambda h=h, m=m: M.evaluate(M.fit_horizon(sides[h][0], m).predict(sides[h][1])) for h, m in grid])
    return reduce(
        DataFrame.unionByName, [r.select(F.lit(h).alias("horizon"), F.lit(m).alias("model"), "*") for (h, m), r in zip(grid, reports)]
    )


def coefficient_ranks(spark, sf):
    """Logistic coefficients by size, with their rank."""
    train = stage(M.horizon_rows(_dataset(spark, sf), TL, "starts_within_10"), "horizon")
    table = M.coefficients(M.fit_horizon(train, "logistic"), spark)
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("magnitude"), "feature")  # one row a feature
    return table.withColumn("rank", F.row_number().over(order))


def horizon_logistic(spark, sf):
    return _horizon_report(spark, sf, "logistic")


def horizon_forest(spark, sf):
    return _horizon_report(spark, sf, "forest")


def horizon_gbt(spark, sf):
    return _horizon_report(spark, sf, "boosting")


def model_coefficients(spark, sf):
    """The features in the order of their coefficients is the model's own; SQL knows their names and the rows."""
    train = stage(M.horizon_rows(_dataset(spark, sf), TL, "starts_within_10"), "horizon")
    model = M.fit_horizon(train, "logistic")
    table = M.coefficients(model, spark).where("magnitude = abs(coefficient)")
    sound = M.logistic_gradient(model, train) < GRADIENT
    return with_row(table.select("feature"), _counts(train, "train")).withColumn("sound", F.lit(sound))


def campaign_holdout(spark, sf):
    """Train on one half of the month, test on the other, both ways; sides are written and counted once.

    No rows if no side has both classes."""
    names = [h[0] for h in HALVES]
    sides = M.campaign_sides(_dataset(spark, sf), campaign_table(spark, HALVES), TL, names)
    grid = [
        (train, test, h, m) for train, test in (names, names[::-1]) for h in (5, 10, 15) for m in M.MODELS
        if (train, h) in sides and (test, h) in sides
    ]
    reports = in_parallel(spark, [partial(_fitted, sides[a, h], sides[b, h], m) for a, b, h, m in grid])
    if not reports:
        return spark.createDataFrame([], HOLDOUT)
    return reduce(
        DataFrame.unionByName,
        [r.select(F.lit(a).alias("train"), F.lit(h).alias("horizon"), F.lit(m).alias("model"), "*") for (a, _, h, m), r in zip(grid, reports)],
    )


def next_state_var(spark, sf):
    """Scored states of the fitted linear next-state model per class, and whether its normal equations are solved."""
    states = X.states(spark, sf)
    scaler = stage(X.scaler(states), "scaler")
    weights = P.fit_next_state(states, TL, FEATURES, scaler)
    scores = P.score_linear(states, TL, FEATURES, scaler, weights)
    sound = P.residual(states, TL, FEATURES, scaler, weights) < GRADIENT
    return scores.groupBy(POSITIVE).agg(
        F.count(F.lit(1)).alias("states"), (F.min("mse") >= 0).alias("scored")
    ).withColumn("sound", F.col("scored") & F.lit(sound)).drop("scored")


def next_state_huber(spark, sf):
    """As next_state_var, with the Huber loss: its gradient over all rows vanishes at the weights."""
    states = X.states(spark, sf)
    scaler = stage(X.scaler(states), "scaler")
    weights = P.fit_next_state(states, TL, FEATURES, scaler, loss="huber")
    scores = P.score_linear(states, TL, FEATURES, scaler, weights)
    sound = P.huber_gradient(states, TL, FEATURES, scaler, weights) < GRADIENT
    return scores.groupBy(POSITIVE).agg(
        F.count(F.lit(1)).alias("states"), (F.min("mse") >= 0).alias("scored")
    ).withColumn("sound", F.col("scored") & F.lit(sound)).drop("scored")


def sequence_classifier(spark, sf):
    """Label of the next state from ten scaled states, under three ways to split."""
    states = X.states(spark, sf)
    scaled = scale_states(states, FEATURES, stage(X.scaler(states), "scaler"))
    rows = stage(
        M.sequence_rows(S.sequences(scaled, TL, FEATURES, check_gaps=False), TL), "sequences"
    )
    splits = {
        "stratified": S.stratified_split(rows, "label", TL.id),
        "chronological": S.chronological_split(rows, TL, 0.8),
        "campaign": S.positional_split(rows, TL, 400, 700),
    }
    def report(name: str, split: DataFrame) -> DataFrame:
        split = stage(split.select(*rows.columns, "split"), "split")
        train, test = (split.filter(F.col("split") == s) for s in ("train", "test"))
        model = M.fit_sequence_classifier(train)
        sound = _sound(M.predict_sequences(model, test), M.predict_sequences(model, train))
        made = with_row(with_row(_counts(train, "train"), _counts(test, "test")), sound)
        return stage(made, "report").select(F.lit(name).alias("split"), "*")

    return reduce(DataFrame.unionByName, in_parallel(spark, [partial(report, *s) for s in splits.items()]))


MODELS: dict[str, Query] = {
    "next_state_var": next_state_var,
    "next_state_huber": next_state_huber,
    "sequence_classifier": sequence_classifier,
    "horizon_logistic": horizon_logistic,
    "horizon_forest": horizon_forest,
    "horizon_gbt": horizon_gbt,
    "model_coefficients": model_coefficients,
    "campaign_holdout": campaign_holdout,
    "horizon_metrics": horizon_metrics,
    "coefficient_ranks": coefficient_ranks,
}
