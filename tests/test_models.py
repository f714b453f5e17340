import random

import pytest
from pyspark.sql import functions as F

from helpers import minute
from portentia import Timeline
from portentia.operators import models as M
from portentia.operators.campaigns import campaign_table

TL = Timeline(60)


@pytest.fixture(scope="module")
def dataset(spark):
    """Errors that rise before a start: an easy target for every model."""
    rng = random.Random(8)
    rows = []
    for i in range(400):
        y = int(rng.random() < 0.4)
        values = [rng.gauss(2.0 * y, 1.0) for _ in M.HORIZON_FEATURES]
        values[9] = None if i % 17 == 0 else values[9]
        rows.append((minute(i), 0, *values, y, y, 1 if i < 200 else y))
    schema = "time_window timestamp, is_positive int, "
    schema += ", ".join(f"{c} double" for c in M.HORIZON_FEATURES)
    schema += ", starts_within_5 int, starts_within_10 int, starts_within_15 int"
    return spark.createDataFrame(rows, schema).cache()


@pytest.mark.parametrize("name", M.MODELS)
def test_models_learn_and_report(spark, dataset, name):
    rows = M.horizon_rows(dataset, TL, "starts_within_5")
    train, test = rows.filter(F.minute("time_window") < 40), rows.filter(F.minute("time_window") >= 40)
    model = M.fit_horizon(train, name, trees=10, iterations=5, max_iter=50)
    r = M.evaluate(model.predict(test)).first()
    assert r["tn"] + r["fp"] + r["fn"] + r["tp"] == test.count()
    assert r["auc"] > 0.9 and r["recall"] > 0.8
    if name == "logistic":
        table = M.coefficients(model, spark).collect()
        assert len(table) == len(M.HORIZON_FEATURES)
        sizes = [x["magnitude"] for x in table]
        assert sizes == sorted(sizes, reverse=True)


def test_balance_weights(dataset):
    rows = M.with_balance(M.horizon_rows(dataset, TL, "starts_within_5"))
    sums = {r[0]: r[1] for r in rows.groupBy("label").agg(F.sum("weight")).collect()}
    assert sums[0.0] == pytest.approx(200.0) and sums[1.0] == pytest.approx(200.0)


def test_holdout_skips_single_class_sides(spark, dataset):
    campaigns = campaign_table(
        spark, [("one", str(minute(0)), str(minute(199))), ("two", str(minute(200)), str(minute(399)))]
    )
    out = M.campaign_holdout(
        dataset, campaigns, TL, ("one", "two"), horizons=(10, 15), models=("logistic",), max_iter=20
    ).collect()
    assert {(r["train"], r["horizon"]) for r in out} == {("one", 10), ("two", 10)}


@pytest.mark.parametrize("name", M.MODELS)
@pytest.mark.parametrize("only", (0.0, 1.0))
def test_one_class_gives_a_constant_predictor(dataset, name, only):
    """Rows of many sources even out: a long table may have no positive state, and training sides of one class."""
    train = M.horizon_rows(dataset, TL, "starts_within_5").withColumn("label", F.lit(only))
    model = M.fit_horizon(train, name, trees=5, iterations=3, max_iter=20)
    r = M.evaluate(model.predict(train)).first()
    assert (r["tn"], r["fp"], r["fn"], r["tp"]) == ((400, 0, 0, 0) if only == 0 else (0, 0, 0, 400))
    assert r["auc"] is None


def test_holdout_without_both_classes_is_empty(spark, dataset):
    campaigns = campaign_table(spark, [("one", str(minute(0)), str(minute(199))), ("two", str(minute(200)), str(minute(399)))])
    some = M.campaign_holdout(dataset, campaigns, TL, ("one", "two"), horizons=(5,), models=("logistic",), max_iter=20)
    none = M.campaign_holdout(dataset, campaigns, TL, ("one", "two"), horizons=(15,), models=("logistic",))
    # one side of horizon 15 has both classes, so it is tested on itself only: nothing is left
    assert none.count() == 0 and none.columns == some.columns


def test_model_queries_without_positive_states(spark, tmp_path, monkeypatch):
    """Every bucket has one error in five: no state is positive, the registered queries still give their rows."""
    from portentia.plans import model_catalogue as Q

    n = 3000
    kinds = F.element_at(F.array(*[F.lit(t) for t in ("error", "click", "purchase", "signup", "view")]), (F.col("id") % 5 + 1).cast("int"))
    spark.range(n).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 180).cast("timestamp_ntz").alias("ts"),
        (F.col("id") % 37).alias("user_id"), kinds.alias("event_type"), (F.col("id") % 101).cast("double").alias("value"),
        F.format_string('{"k": %d}', F.col("id") % 89).alias("props"),
    ).write.parquet(str(tmp_path / "events.parquet"))
    fit = M.fit_horizon
    monkeypatch.setattr(M, "fit_horizon", lambda train, name: fit(train, name, trees=5, iterations=3, max_iter=20))
    rows = Q.horizon_forest(spark, str(tmp_path)).collect()
    assert [r["horizon"] for r in rows] == [5, 10, 15]
    assert all(r["train_positives"] == r["test_positives"] == 0 and r["train_rows"] > r["test_rows"] > 0 and r["sound"] for r in rows)
    assert Q.campaign_holdout(spark, str(tmp_path)).count() == 0
    metrics = Q.horizon_metrics(spark, str(tmp_path)).collect()
    assert len(metrics) == 9 and all(r["tp"] + r["fp"] + r["fn"] == 0 and r["tn"] > 0 for r in metrics)
