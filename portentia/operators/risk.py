"""Rule scores 0..10 per horizon, risk levels and reasons, offline and live variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from portentia.functions.columns import clamp, join_reasons, points, row_max, total
from portentia.functions.rows import with_row
from portentia.operators.states import POSITIVE
from portentia.timeline import Timeline, over_blocks

HORIZONS = (5, 10, 15)

# Level cut-offs, default live thresholds, live baseline length and floor.
OFFLINE_CUTS = {"HIGH": 7.0, "MEDIUM": 4.0}
LIVE_CUTS = {"HIGH": 8.0, "MEDIUM": 4.0}
LIVE_P95 = 0.7582
LIVE_P99 = 1.0296
LIVE_BASELINE_ROWS = 30
LIVE_BASELINE_FLOOR = 1e-6

# Reason texts of the offline engine.
REASON_IMMEDIATE = "strong immediate anomaly"
REASON_SHORT_TERM = "elevated short-term anomaly"
REASON_PERSISTENT = "persistent anomaly over the recent window"
REASON_DEVELOPING = "developing anomaly pattern"
REASON_SUSTAINED = "sustained longer-term anomaly"
REASON_OVER_5X = "error exceeds recent baseline by >5x"
REASON_OVER_3X = "error exceeds recent baseline by >3x"
REASON_REPEATED = "3+ elevated observations in 5 minutes"
REASON_NONE = "no strong temporal anomaly pattern"

# Reason texts of the live engine.
LIVE_ABOVE_99 = "Current prediction error is above the 99th-percentile baseline."
LIVE_ABOVE_95 = "Current prediction error is above the 95th-percentile baseline."
LIVE_COUNT_5 = "%d of the last 5 observations exceed the 95th-percentile threshold."
LIVE_COUNT_10 = "%d of the last 10 observations exceed the 95th-percentile threshold."
LIVE_REPEATED = "Repeated high-magnitude prediction errors detected."
LIVE_RATIO = "Current error is approximately %.1f× the recent baseline."
LIVE_NONE = "No strong persistent anomaly signal detected."


def _over(name: str, high: float, low: float) -> Column:
    """Points for a value above p99, else above p95."""
    c = F.col(name)
    return points((c > F.col("p99"), high), (c > F.col("p95"), low))


def _ratio_points() -> Column:
    r = F.col("ratio_10")
    return points((r > 5, 3.0), (r > 3, 2.0), (r > 2, 1.0))


def risk_scores() -> dict[int, Column]:
    """Score expressions per horizon over anomaly-feature columns plus ``p95`` and ``p99``."""
    n5, n10 = F.col("above95_count_5"), F.col("above95_count_10")
    parts = {
        5: [
            _over("mse", 4.0, 2.0),
            _over("rolling_3", 2.5, 1.5),
            _over("rolling_5", 2.0, 1.0),
            _over("change_1", 2.0, 1.0),
            points((n5 >= 3, 2.0), (n5 >= 2, 1.0)),
        ],
        10: [
            _over("rolling_5", 2.0, 1.0),
            _over("rolling_10", 3.0, 2.0),
            _over("max_10", 2.0, 1.0),
            _ratio_points(),
            points((n10 >= 5, 2.0), (n10 >= 3, 1.0)),
        ],
        15: [
            _over("rolling_10", 3.0, 2.0),
            _over("max_10", 2.0, 1.0),
            _ratio_points(),
            points((n10 >= 5, 3.0), (n10 >= 3, 2.0), (n10 >= 2, 1.0)),
            _over("change_3", 2.0, 1.0),
        ],
    }
    return {h: clamp(total(ps)) for h, ps in parts.items()}


def level(score: Column | str, cuts: dict[str, float] = OFFLINE_CUTS) -> Column:
    s = F.col(score) if isinstance(score, str) else score
    return (
        F.when(s >= cuts["HIGH"], "HIGH").when(s >= cuts["MEDIUM"], "MEDIUM").otherwise("LOW")
    )


def forecast_engine(features: DataFrame) -> DataFrame:
    """Risk per horizon, levels, overall score, reasons and ground-truth text. A pure projection."""
    out = features.withColumns({f"risk_{h}": s for h, s in risk_scores().items()})
    out = out.withColumn("forecast_score", row_max(*[f"risk_{h}" for h in HORIZONS]))
    r5, r10, r15 = (F.col(f"risk_{h}") for h in HORIZONS)
    ratio = F.col("ratio_10")
    reasons = [
        F.when(r5 >= 7, REASON_IMMEDIATE).when(r5 >= 4, REASON_SHORT_TERM),
        F.when(r10 >= 7, REASON_PERSISTENT).when(r10 >= 4, REASON_DEVELOPING),
        F.when(r15 >= 7, REASON_SUSTAINED),
        F.when(ratio > 5, REASON_OVER_5X).when(ratio > 3, REASON_OVER_3X),
        F.when(F.col("above95_count_5") >= 3, REASON_REPEATED),
    ]
    return out.withColumns(
        {
            **{f"forecast_{h}": level(f"risk_{h}") for h in HORIZONS},
            "forecast_state": level("forecast_score"),
            "forecast_reason": join_reasons(reasons, "; ", REASON_NONE),
            "ground_truth": F.when(F.col(POSITIVE) == 1, "ATTACK").otherwise("NORMAL"),
        }
    )


def rule_state() -> Column:
    """Three-level rule over anomaly features: first match wins."""
    mse, ratio = F.col("mse"), F.col("ratio_10")
    return (
        F.when((mse > F.col("p99")) & (ratio > 3), "ELEVATED")
        .when((F.col("above95_count_5") >= 2) | (F.col("above95_count_10") >= 3), "ELEVATED")
        .when((mse > F.col("p95")) & (F.col("change_3") > 0) & (ratio > 2), "WATCH")
        .when(F.col("rolling_5") > F.col("p95"), "WATCH")
        .otherwise("NORMAL")
    )


def live_score(above_95: Column, above_99: Column) -> Column:
    mse, ratio = F.col("mse"), F.col("ratio")
    return F.least(
        F.lit(10.0),
        points((mse > F.col("p99"), 4.0), (mse > F.col("p95"), 2.0))
        + points((above_95 >= 2, 2.0))
        + points((above_95 >= 3, 1.0))
        + points((above_99 >= 2, 1.0))
        + points((ratio >= 3, 2.0), (ratio >= 2, 1.0)),
    )


def live_outputs(df: DataFrame) -> DataFrame:
    """Levels, scores, states and reason from ``mse``, ``p95``, ``p99``, counts and ``baseline``."""
    mse = F.col("mse")
    n5, n10 = F.col("above95_count_5"), F.col("above95_count_10")
    m5, m10 = F.col("above99_count_5"), F.col("above99_count_10")
    out = df.withColumn("ratio", mse / F.col("baseline"))
    out = out.withColumns(
        {
            "current_level": F.when(mse > F.col("p99"), "HIGH")
            .when(mse > F.col("p95"), "ELEVATED")
            .otherwise("NORMAL"),
            "risk_5": live_score(n5, m5),
            "risk_10": live_score(n10, m10),
            "risk_15": live_score(n10, m10),
        }
    )
    reasons = [
        F.when(mse > F.col("p99"), LIVE_ABOVE_99).when(mse > F.col("p95"), LIVE_ABOVE_95),
        F.when(n5 >= 2, F.format_string(LIVE_COUNT_5, n5)),
        F.when(n10 >= 3, F.format_string(LIVE_COUNT_10, n10)),
        F.when(m5 >= 2, LIVE_REPEATED),
        F.when(F.col("ratio") >= 3, F.format_string(LIVE_RATIO, F.col("ratio"))),
    ]
    return out.withColumns(
        {
            **{f"state_{h}": level(f"risk_{h}", LIVE_CUTS) for h in HORIZONS},
            "reason": join_reasons(reasons, " ", LIVE_NONE),
        }
    )


def live_forecast(
    scores: DataFrame, tl: Timeline, thresholds: DataFrame | None = None
) -> DataFrame:
    """Batch twin of the live engine: every error judged by the errors up to it.

    ``thresholds`` is a one-row table with ``p95`` and ``p99``; without it the live defaults apply.
    """
    base = (
        scores.withColumns({"p95": F.lit(LIVE_P95), "p99": F.lit(LIVE_P99)})
        if thresholds is None
        else with_row(scores, thresholds)
    )
    over95 = (F.col("mse") > F.col("p95")).cast("int")
    over99 = (F.col("mse") > F.col("p99")).cast("int")

    def build(w: WindowSpec) -> dict[str, Column]:
        def count(flag: Column, n: int) -> Column:
            return F.sum(flag).over(w.rowsBetween(-(n - 1), 0))

        trailing = F.percentile("mse", 0.5).over(w.rowsBetween(-LIVE_BASELINE_ROWS, -1))
        floored = F.greatest(trailing, F.lit(LIVE_BASELINE_FLOOR))
        return {
            "above95_count_5": count(over95, 5),
            "above95_count_10": count(over95, 10),
            "above99_count_5": count(over99, 5),
            "above99_count_10": count(over99, 10),
            "baseline": F.when(trailing.isNull(), F.col("p95")).otherwise(floored),
        }

    return live_outputs(over_blocks(base, tl, build, before=LIVE_BASELINE_ROWS, rows=True))
