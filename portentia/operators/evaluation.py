"""Classifier metrics, class weights and ROC-AUC as aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portentia.functions.columns import divide_or_zero
from portentia.functions.rows import with_row
from portentia.operators.quantiles import running_totals
from portentia.runtime import stage


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights: rows / (classes * rows of the class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))
    totals = counts.agg(F.sum("rows").alias("__n"), F.count(F.lit(1)).alias("__k"))
    return with_row(counts, totals).select(
        label, "rows", (F.col("__n") / (F.col("__k") * F.col("rows"))).alias("weight")
    )


def cut(probability: str, at: float = 0.5):
    """Predicted class; the cut itself counts as positive."""
    return (F.col(probability) >= at).cast("int")


def classifier_metrics(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """One row: confusion counts, accuracy, precision, recall, F1 and FPR (0 on empty divisors)."""
    y, p = F.col(label), F.col(predicted)
    counts = df.agg(
        F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 1) & (p == 1)).alias("tp"),
    )
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return counts.select(
        "tn",
        "fp",
        "fn",
        "tp",
        divide_or_zero(tp + tn, tn + fp + fn + tp).alias("accuracy"),
        divide_or_zero(tp, tp + fp).alias("precision"),
        divide_or_zero(tp, tp + fn).alias("recall"),
        divide_or_zero(2 * tp, 2 * tp + fp + fn).alias("f1"),
        divide_or_zero(fp, fp + tn).alias("fpr"),
    )


def class_report(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Per class: precision, recall, F1 and support."""
    pairs = df.groupBy(F.col(label).alias("y"), F.col(predicted).alias("p")).agg(
        F.count(F.lit(1)).alias("n")
    )
    per_class = pairs.select(
        "n",
        F.inline(
            F.array(
                F.struct(
                    F.col("y").alias("class"),
                    (F.col("y") == F.col("p")).cast("long").alias("hit"),
                    F.lit(1).cast("long").alias("actual"),
                    F.lit(0).cast("long").alias("claimed"),
                ),
                F.struct(
                    F.col("p").alias("class"),
                    F.lit(0).cast("long").alias("hit"),
                    F.lit(0).cast("long").alias("actual"),
                    F.lit(1).cast("long").alias("claimed"),
                ),
            )
        ),
    )
    sums = per_class.groupBy("class").agg(
        *[F.sum(F.col("n") * F.col(c)).alias(c) for c in ("hit", "actual", "claimed")]
    )
    hit, actual, claimed = F.col("hit"), F.col("actual"), F.col("claimed")
    return sums.select(
        "class",
        divide_or_zero(hit, claimed).alias("precision"),
        divide_or_zero(hit, actual).alias("recall"),
        divide_or_zero(2 * hit, actual + claimed).alias("f1"),
        actual.alias("support"),
    )


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row (positives, negatives, auc): probability that a positive outscores a negative.

    Ties count half. Equal scores are collapsed first and the running totals are built per score
    bin, so neither a frequent score nor the global order ends up in one task. Null for one class.
    """
    by_score = (
        df.filter(F.col(score).isNotNull())
        .groupBy(F.col(score).alias("__score"))
        .agg(
            F.count_if(F.col(label) == 1).alias("pos"),
            F.count_if(F.col(label) == 0).alias("neg"),
        )
    )
    by_score = stage(by_score, "scores")  # read for the bin edges, the bins and their offsets
    ordered = running_totals(by_score, "__score", ["neg"])
    pos, neg = F.col("pos"), F.col("neg")
    below = F.col("running_neg") - neg
    sums = ordered.agg(
        F.sum("pos").alias("positives"),
        F.sum("neg").alias("negatives"),
        F.sum(pos * (below + neg / 2)).alias("__wins"),
    )
    product = F.col("positives") * F.col("negatives")
    return sums.select(
        "positives", "negatives", F.when(product > 0, F.col("__wins") / product).alias("auc")
    )
