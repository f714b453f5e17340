"""Supervised models on Spark ML: horizon models, sequence classifier, campaign hold-out."""

from __future__ import annotations

from collections.abc import Iterable
from functools import partial, reduce

from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portentia.functions.columns import finite
from portentia.functions.rows import with_row
from portentia.operators.campaigns import interval_join
from portentia.operators.evaluation import classifier_metrics, cut, roc_auc
from portentia.operators.scaling import fit_scaler, scale_states
from portentia.operators.states import POSITIVE
from portentia.runtime import in_parallel, stage
from portentia.timeline import Timeline

# Fixed order: the columns the horizon models see.
HORIZON_FEATURES = (
    "mse",
    "mae",
    "rolling_3",
    "rolling_5",
    "rolling_10",
    "max_5",
    "max_10",
    "change_1",
    "change_3",
    "ratio_10",
    "above_95",
    "above_99",
    "above95_count_5",
    "above95_count_10",
)
MODELS = ("logistic", "forest", "boosting")
SEED = 42
# A label has two classes, also where the training rows show only one of them.
TWO_CLASSES = {"ml_attr": {"type": "nominal", "vals": ["0", "1"]}}
REPORT = (
    "tn long, fp long, fn long, tp long, accuracy double, precision double, recall double, f1 double, fpr double, auc double"
)


def horizon_rows(dataset: DataFrame, tl: Timeline, target: str) -> DataFrame:
    """Normal rows with a defined target; missing and infinite features become 0."""
    return dataset.filter((F.col(POSITIVE) == 0) & F.col(target).isNotNull()).select(
        *tl.id,
        *[
            F.coalesce(finite(F.col(c).cast("double")), F.lit(0.0)).alias(c)
            for c in HORIZON_FEATURES
        ],
        F.col(target).cast("double").alias("label"),
    )


def with_balance(df: DataFrame, label: str = "label") -> DataFrame:
    """Add ``weight``: rows / (2 * rows of the class)."""
    counts = df.agg(
        F.count(F.lit(1)).alias("__n"), F.count_if(F.col(label) == 1).alias("__pos")
    )
    n, pos = F.col("__n"), F.col("__pos")
    own = F.when(F.col(label) == 1, pos).otherwise(n - pos)
    return with_row(df, counts).withColumn("weight", n / (2 * own)).drop("__n", "__pos")


def for_estimator(df: DataFrame, name: str) -> DataFrame:
    """Add ``weight``, and for a forest mark the label as one of two classes.

    A forest counts the classes it sees, and rows of one class would give a model with one probability. The logistic fit
    must see the classes: told of two, it takes a constant label for the second.
    """
    rows = with_balance(df)
    return rows.withMetadata("label", TWO_CLASSES) if name == "forest" else rows


def has_both_classes(df: DataFrame, label: str = "label") -> bool:
    row = df.agg(F.min(label).alias("lo"), F.max(label).alias("hi")).first()
    return row["lo"] is not None and row["lo"] != row["hi"]


def estimator(name: str, rows: int, trees: int = 300, iterations: int = 200, max_iter: int = 2000):
    """The three classifier families. The logistic penalty is that of unit inverse strength."""
    common = {"featuresCol": "features", "labelCol": "label"}
    if name == "logistic":
        return LogisticRegression(
            weightCol="weight", standardization=False, regParam=1.0 / max(rows, 1),
            maxIter=max_iter, **common,
        )
    if name == "forest":
        return RandomForestClassifier(
            numTrees=trees, maxDepth=5, minInstancesPerNode=3, weightCol="weight", seed=SEED,
            **common,
        )
    if name == "boosting":
        return GBTClassifier(maxIter=iterations, stepSize=0.05, maxDepth=4, seed=SEED, **common)
    raise ValueError(f"unknown model: {name}")


class HorizonModel:
    """A fitted classifier with the scaler of its training rows (logistic only)."""

    def __init__(self, name: str, model: Model, scaler: DataFrame | None) -> None:
        self.name = name
        self.model = model
        self.scaler = scaler

    def predict(self, rows: DataFrame) -> DataFrame:
        """Add ``probability`` and ``predicted`` (cut at 0.5, inclusive)."""
        scaled = rows if self.scaler is None else scale_states(rows, HORIZON_FEATURES, self.scaler)
        return (
            self.model.transform(scaled)
            .withColumn("__p", vector_to_array("probability")[1])
            .drop("probability", "features", "rawPrediction", "prediction")
            .withColumnRenamed("__p", "probability")
            .withColumn("predicted", cut("probability"))
        )

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/{self.name}")
        if self.scaler is not None:
            self.scaler.write.mode("overwrite").parquet(f"{path}/scaler")

    @classmethod
    def load(cls, spark: SparkSession, path: str, name: str) -> HorizonModel:
        """A saved model, for a scoring job that does not train."""
        scaler = spark.read.parquet(f"{path}/scaler") if name == "logistic" else None
        return cls(name, PipelineModel.load(f"{path}/{name}"), scaler)


def fit_horizon(train: DataFrame, name: str, **parameters: int) -> HorizonModel:
    """Fit one horizon model on rows from :func:`horizon_rows`."""
    scaler = None
    rows = for_estimator(train, name)
    if name == "logistic":
        scaler = stage(fit_scaler(train, HORIZON_FEATURES, fit_rows="all"), "scaler")
        rows = scale_states(rows, HORIZON_FEATURES, scaler)
    assembler = VectorAssembler(inputCols=list(HORIZON_FEATURES), outputCol="features")
    pipeline = Pipeline(stages=[assembler, estimator(name, train.count(), **parameters)])
    return HorizonModel(name, pipeline.fit(rows), scaler)


def coefficients(model: HorizonModel, spark: SparkSession) -> DataFrame:
    """Logistic coefficients by absolute size. One row per feature."""
    values = model.model.stages[-1].coefficients.toArray().tolist()
    rows = [(f, float(v), abs(float(v))) for f, v in zip(HORIZON_FEATURES, values)]
    return spark.createDataFrame(
        rows, "feature string, coefficient double, magnitude double"
    ).orderBy(F.col("magnitude").desc(), "feature")


def logistic_gradient(model: HorizonModel, train: DataFrame) -> float:
    """Largest entry of the gradient of the penalised weighted log loss at the fitted coefficients, over all rows."""
    fitted = model.model.stages[-1]
    rows = scale_states(with_balance(train), HORIZON_FEATURES, model.scaler)
    values = [float(v) for v in fitted.coefficients.toArray()]
    margin = F.lit(float(fitted.intercept))
    for c, v in zip(HORIZON_FEATURES, values):
        margin = margin + F.lit(v) * F.col(c)
    error = F.col("weight") * (1 / (1 + F.exp(-margin)) - F.col("label"))
    sums = rows.agg(
        F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n"), F.sum(error).alias("intercept"),
        *[F.sum(error * F.col(c)).alias(c) for c in HORIZON_FEATURES],
    ).first()
    slopes = [sums[c] / sums["w"] + v / sums["n"] for c, v in zip(HORIZON_FEATURES, values)]
    return max(abs(g) for g in (sums["intercept"] / sums["w"], *slopes))


def evaluate(predicted: DataFrame) -> DataFrame:
    """One row: confusion counts, rates and AUC of (label, predicted, probability)."""
    predicted = stage(predicted.select("label", "predicted", "probability"), "predicted")
    report = with_row(
        classifier_metrics(predicted, "label", "predicted"),
        roc_auc(predicted, "label", "probability").select("auc"),
    )
    return stage(report, "report")


def campaign_holdout(
    dataset: DataFrame,
    campaigns: DataFrame,
    tl: Timeline,
    names: tuple[str, str],
    horizons: Iterable[int] = (5, 10, 15),
    models: Iterable[str] = MODELS,
    **parameters: int,
) -> DataFrame:
    """Train on one campaign's rows, test on the other's, both ways; one row per combination.

    The grid of directions, horizons and models is fitted several at a time. Combinations with a single class on either
    side are skipped.
    """
    spark = dataset.sparkSession
    sides = campaign_sides(dataset, campaigns, tl, names, horizons)
    combinations = [
        (train, test, h, m) for train, test in (names, names[::-1]) for h in sorted({h for _, h in sides}) for m in models
        if (train, h) in sides and (test, h) in sides
    ]

    def run(train: str, test: str, h: int, m: str) -> DataFrame:
        result = evaluate(fit_horizon(sides[train, h], m, **parameters).predict(sides[test, h]))
        return result.select(
            F.lit(train).alias("train"), F.lit(test).alias("test"), F.lit(h).alias("horizon"), F.lit(m).alias("model"), "*"
        )

    parts = in_parallel(spark, [partial(run, *c) for c in combinations])
    if not parts:
        return spark.createDataFrame(
            [], f"train string, test string, horizon int, model string, {REPORT}"
        )
    return reduce(DataFrame.unionByName, parts)


def campaign_sides(
    dataset: DataFrame, campaigns: DataFrame, tl: Timeline, names: Iterable[str], horizons: Iterable[int] = (5, 10, 15)
) -> dict[tuple[str, int], DataFrame]:
    """The rows of every (campaign, horizon) with both classes, each written once for all fits and tests it is used in."""
    tagged = stage(interval_join(dataset, campaigns, tl, "start", "end"), "holdout")
    keys = [(n, h) for n in names for h in horizons]

    def side(name: str, h: int) -> DataFrame:
        return stage(horizon_rows(tagged.filter(F.col("campaign") == name), tl, f"starts_within_{h}"), "side")

    rows = dict(zip(keys, in_parallel(dataset.sparkSession, [partial(side, *k) for k in keys])))
    both = in_parallel(dataset.sparkSession, [partial(has_both_classes, rows[k]) for k in keys])
    return {k: rows[k] for k, use in zip(keys, both) if use}


def sequence_rows(seq: DataFrame, tl: Timeline) -> DataFrame:
    """Sequences as flat vectors with the label of the next row."""
    return seq.select(
        *tl.id,
        array_to_vector(F.flatten("x")).alias("features"),
        F.col("target_positive").cast("double").alias("label"),
    )


def fit_sequence_classifier(train: DataFrame, name: str = "logistic", **parameters: int) -> Model:
    return estimator(name, train.count(), **parameters).fit(for_estimator(train, name))


def predict_sequences(model: Model, rows: DataFrame) -> DataFrame:
    return (
        model.transform(rows)
        .withColumn("__p", vector_to_array("probability")[1])
        .select(*[c for c in rows.columns if c != "features"], F.col("__p").alias("probability"))
        .withColumn("predicted", cut("probability"))
    )
