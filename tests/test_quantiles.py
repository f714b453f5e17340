import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from portentia.operators.evaluation import (
    class_report,
    class_weights,
    classifier_metrics,
    cut,
    roc_auc,
)
from portentia.operators.quantiles import approximate_quantiles, exact_quantiles

PROBS = [0.0, 0.25, 0.5, 0.9, 0.99, 1.0]


@pytest.mark.parametrize("accuracy, bins", [(100, 256), (10_000, 256), (100, 4), (10_000, 32)])
def test_exact_quantiles_with_a_hot_value(spark, accuracy, bins):
    """A third of the rows share one value; low accuracy narrows the ranges."""
    n = 30_000
    df = spark.createDataFrame(_rows(n), "x double, y double, empty double")
    pdf = df.toPandas()
    got = {
        (r["feature"], r["prob"]): r["quantile"]
        for r in exact_quantiles(df, ["x", "y", "empty"], PROBS, accuracy=accuracy, bins=bins).collect()
    }
    for c in ("x", "y"):
        for p in PROBS:
            assert got[(c, p)] == pytest.approx(np.quantile(pdf[c][np.isfinite(pdf[c])], p), abs=1e-12)
    assert all(got[("empty", p)] is None for p in PROBS)


def _rows(n):
    rng = random.Random(1)
    return [
        (
            7.0 if i % 3 == 0 else rng.random() * 100,
            (float("nan") if i % 10 == 0 else float("inf") if i % 15 == 0 else None) if i % 5 == 0 else rng.gauss(0, 1),
            None,
        )
        for i in range(n)
    ]


@pytest.mark.parametrize("bins", [256, 8])
def test_grouped_quantiles(spark, bins):
    """A null class is a class."""
    rng = random.Random(2)
    rows = [("g%d" % (i % 3) if i % 3 else None, rng.random()) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {
        (r["g"], r["prob"]): r["quantile"]
        for r in exact_quantiles(df, ["v"], [0.25, 0.5], by=["g"], bins=bins).collect()
    }
    for g in (None, "g1", "g2"):
        values = [v for k, v in rows if k == g]
        for p in (0.25, 0.5):
            assert got[(g, p)] == pytest.approx(np.quantile(values, p), abs=1e-12)


def test_approximate_quantiles_are_close(spark):
    df = spark.range(1001).select(F.col("id").cast("double").alias("v"))
    row = approximate_quantiles(df, ["v"], [0.5]).first()
    assert abs(row["quantile"] - 500) <= 1


def test_roc_auc_against_all_pairs(spark):
    rng = random.Random(4)
    rows = [(int(rng.random() < 0.3), round(rng.random(), 2)) for _ in range(600)]
    pos = [s for y, s in rows if y]
    neg = [s for y, s in rows if not y]
    want = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    got = roc_auc(spark.createDataFrame(rows, "y int, s double"), "y", "s").first()
    assert got["auc"] == pytest.approx(want)
    single = roc_auc(spark.createDataFrame([(1, 0.2), (1, 0.4)], "y int, s double"), "y", "s")
    assert single.first()["auc"] is None


def test_classifier_metrics(spark):
    rows = [(1, 0.5), (1, 0.4), (0, 0.9), (0, 0.1), (0, 0.49)]
    df = spark.createDataFrame(rows, "y int, p double").withColumn("yhat", cut("p"))
    m = classifier_metrics(df, "y", "yhat").first()
    assert (m["tn"], m["fp"], m["fn"], m["tp"]) == (2, 1, 1, 1)
    assert m["precision"] == 0.5 and m["recall"] == 0.5 and m["fpr"] == pytest.approx(1 / 3)
    report = {r["class"]: r for r in class_report(df, "y", "yhat").collect()}
    assert report[0]["support"] == 3 and report[0]["recall"] == pytest.approx(2 / 3)
    none = classifier_metrics(df.filter("y = 0").withColumn("yhat", F.lit(0)), "y", "yhat").first()
    assert none["precision"] == 0.0 and none["recall"] == 0.0
    weights = {r["y"]: r["weight"] for r in class_weights(df, "y").collect()}
    assert math.isclose(weights[1], 5 / 4) and math.isclose(weights[0], 5 / 6)
