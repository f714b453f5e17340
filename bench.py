"""Timings of the headline queries. Prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import functions as F

from portentia.operators import campaigns as C
from portentia.operators import risk as R
from portentia.operators import rollout as O
from portentia.operators import sequences as S
from portentia.operators.anomaly import forecast_dataset
from portentia.operators.states import build_states, feature_medians
from portentia.plans import catalogue, live_catalogue
from portentia.plans import fixture as X
from portentia.runtime import session, stage
from portentia.timeline import Timeline

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
MINUTE = Timeline(bucket_seconds=60)
DAY = Timeline(bucket_seconds=86_400, time="time_window")


def lineitem_states(spark):
    """The widest table as flows: one state per day of shipping, returned lines as the label."""
    flows = X.table(spark, SF_DIR, "lineitem").withColumn("ts", F.col("l_shipdate").cast("timestamp"))
    features = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return build_states(flows, features, DAY, "l_returnflag", "R", ratio_threshold=0.4,
                        medians=feature_medians(flows, features))


def queries(spark):
    minute_states = stage(X.states(spark, SF_DIR, MINUTE), "bench")
    minute_scores = stage(X.scores(minute_states, MINUTE), "bench")
    scaler = stage(X.scaler(minute_states, MINUTE), "bench")

    def engine():
        return X.engine(minute_scores, MINUTE)

    def evaluation():
        baseline = catalogue._normal_baseline(minute_scores)
        return O.rollout_evaluation(minute_states, MINUTE, X.STATE_FEATURES, scaler, baseline)

    return {
        "clean_impute_states": lambda: catalogue.network_states(spark, SF_DIR),
        "feature_medians": lambda: catalogue.feature_medians_query(spark, SF_DIR),
        "lineitem_states": lambda: lineitem_states(spark),
        "end_to_end_engine": lambda: catalogue.flagship(spark, SF_DIR, MINUTE),
        "states": lambda: X.states(spark, SF_DIR, MINUTE),
        "sequences": lambda: S.sequences(minute_states, MINUTE, X.STATE_FEATURES),
        "scores": lambda: X.scores(minute_states, MINUTE),
        "targets": lambda: S.forecast_targets(minute_states, MINUTE),
        "anomaly": lambda: X.anomaly(minute_scores, MINUTE),
        "engine": engine,
        "live_forecast": lambda: R.live_forecast(minute_scores, MINUTE),
        "dataset": lambda: forecast_dataset(
            X.anomaly(minute_scores, MINUTE), S.forecast_targets(minute_states, MINUTE), MINUTE,
            catalogue.TARGET_COLUMNS,
        ),
        "attack_periods": lambda: S.attack_periods(minute_states, MINUTE),
        "evaluation_report": lambda: C.evaluation_report(stage(engine(), "bench"), X.campaigns(spark), MINUTE),
        "rollout": lambda: O.rollout_signals(
            O.forecast_paths(minute_states, MINUTE, X.STATE_FEATURES, scaler), MINUTE
        ),
        "rollout_evaluation": evaluation,
        "roc_auc": lambda: catalogue.roc_auc(spark, SF_DIR),
        "stream_states": lambda: live_catalogue.stream_states(spark, SF_DIR),
        "stream_scores": lambda: live_catalogue.stream_scores(spark, SF_DIR),
    }


def main() -> None:
    spark = session(
        "bench",
        f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": CPUS,
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    timings = {}
    for name, query in queries(spark).items():
        start = time.perf_counter()
        query().write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(SF_DIR.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
