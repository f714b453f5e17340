"""Interpretation of a scored state as an attack stage: ordered rules over column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portentia.functions.columns import safe_float
from portentia.functions import vectors as V

# Feature terms that point to a stage, in order of preference.
RECONNAISSANCE_TERMS = (
    "dst port",
    "destination port",
    "flow pkts/s",
    "fwd pkts/s",
    "pkt size",
    "flow count",
    "syn flag",
    "syn flag cnt",
)
COMMAND_TERMS = ("iat", "flow iat", "fwd iat", "bwd iat", "active", "idle")

# Stage, confidence, explanation and context texts.
INFILTRATION = (
    "Active Infiltration / Exploitation",
    "High",
    "The observed network state contains a substantial infiltration signal.",
    "ATT&CK-oriented interpretation: the observed traffic is consistent with an active compromise or exploitation phase. Specific ATT&CK techniques are not confirmed by this telemetry alone.",
)
PRE_ATTACK = (
    "Suspicious / Pre-Attack Anomaly",
    "Medium",
    "The current network state differs substantially from the dynamics learned from normal traffic, but the available telemetry does not confirm active infiltration.",
    "ATT&CK-oriented interpretation: suspicious pre-attack or anomalous behaviour requiring investigation. No specific ATT&CK technique is confirmed.",
)
RECONNAISSANCE = (
    "Reconnaissance / Discovery",
    "Low",
    "Traffic characteristics are consistent with increased network probing or discovery activity.",
    "ATT&CK-oriented interpretation: potentially related to reconnaissance or discovery behaviour. No specific ATT&CK technique is confirmed.",
)
COMMAND = (
    "Command & Control-Like Behaviour",
    "Low",
    "Temporal flow behaviour is anomalous and may warrant investigation for command-and-control-like activity.",
    "ATT&CK-oriented interpretation: potentially consistent with command-and-control behaviour. No specific ATT&CK technique is confirmed.",
)
SUSPICIOUS = (
    "Suspicious Network Activity",
    "Low",
    "An elevated network anomaly is present, but the available telemetry is insufficient to identify a specific attack stage.",
    "ATT&CK-oriented interpretation: suspicious network behaviour requiring investigation. No technique is confirmed.",
)
NORMAL = (
    "Normal",
    "High",
    "The current network behaviour is close to the dynamics learned from normal traffic.",
    "No ATT&CK-oriented attack-stage signal is currently identified.",
)

# Evidence texts.
EVIDENCE_UNCONFIRMED = "Observed infiltration has not been confirmed in the current state."
EVIDENCE_TRAFFIC = "Elevated traffic-rate or port-related features are contributing to the anomaly."
EVIDENCE_TIMING = "Timing/inter-arrival features contribute strongly to the current anomaly."
EVIDENCE_NONE = "No strong attack-stage signal detected."

# Rule cut-offs.
RATIO_CONFIRMED = 0.50
SCORE_HIGH = 8.0
SCORE_MEDIUM = 4.0
MSE_HIGH = 5.0


def two_decimals(c: Column) -> Column:
    """Two decimals; values exactly half-way (multiples of 1/8) round to the even digit."""
    half_way = c * 8 == F.floor(c * 8)
    return F.format_string("%.2f", F.when(half_way, F.bround(c, 2)).otherwise(c))


def hits(terms: Iterable[str], text: Column) -> Column:
    listed = F.array(*[F.lit(t) for t in terms])
    return V.let(text, lambda known: F.filter(listed, lambda t: F.contains(known, t)))


def top_feature_text(errors: Column, features: list[str], k: int = 10) -> Column:
    """Lower-cased names of the ``k`` most deviating features, joined by blanks."""
    names = V.names([f.lower() for f in features])
    return F.array_join(
        F.transform(V.ranked(errors, k), lambda s: F.element_at(names, s["pos"] + 1)), " "
    )


def attack_stage(
    df: DataFrame,
    feature_text: Column,
    mse: str = "mse",
    score: str = "forecast_score",
    ratio: str = "label_ratio",
    state: str = "forecast_state",
    reconnaissance_terms: Iterable[str] = RECONNAISSANCE_TERMS,
    command_terms: Iterable[str] = COMMAND_TERMS,
) -> DataFrame:
    """Add ``stage``: struct(stage, confidence, evidence, explanation, mitre_context)."""
    out = df.withColumns(
        {
            "__mse": safe_float(mse),
            "__score": safe_float(score),
            "__ratio": safe_float(ratio),
            "__recon": hits(reconnaissance_terms, feature_text),
            "__command": hits(command_terms, feature_text),
        }
    )
    m, s, r = F.col("__mse"), F.col("__score"), F.col("__ratio")
    level = F.coalesce(F.col(state), F.lit("LOW"))
    score_text = F.format_string("%.1f/10", s)
    forecast_score = F.concat(F.lit("Forecast score: "), score_text)
    forecast_state = F.concat(F.lit("Forecast state: "), level)

    def signals(name: str) -> Column:
        return F.concat(F.lit("Signals: "), F.array_join(F.slice(name, 1, 4), ", "))

    def outcome(texts: tuple[str, str, str, str], *evidence: Column) -> Column:
        stage, confidence, explanation, context = texts
        return F.struct(
            F.lit(stage).alias("stage"),
            F.lit(confidence).alias("confidence"),
            F.array(*evidence).alias("evidence"),
            F.lit(explanation).alias("explanation"),
            F.lit(context).alias("mitre_context"),
        )

    rules = (
        F.when(
            r >= RATIO_CONFIRMED,
            outcome(
                INFILTRATION,
                F.concat(F.lit("Observed infiltration ratio: "), two_decimals(r)),
                F.concat(F.lit("World-model prediction error: "), two_decimals(m)),
                forecast_score,
            ),
        )
        .when(
            (s >= SCORE_HIGH) | (m >= MSE_HIGH),
            outcome(
                PRE_ATTACK,
                F.concat(F.lit("Elevated prediction error: "), two_decimals(m)),
                F.concat(F.lit("High forecast score: "), score_text),
                forecast_state,
                F.lit(EVIDENCE_UNCONFIRMED),
            ),
        )
        .when(
            (F.size("__recon") > 0) & (s >= SCORE_MEDIUM),
            outcome(RECONNAISSANCE, F.lit(EVIDENCE_TRAFFIC), signals("__recon"), forecast_score),
        )
        .when(
            (F.size("__command") > 0) & (s >= SCORE_MEDIUM),
            outcome(COMMAND, F.lit(EVIDENCE_TIMING), signals("__command"), forecast_score),
        )
        .when(
            level.isin("HIGH", "MEDIUM") | (s >= SCORE_MEDIUM),
            outcome(
                SUSPICIOUS,
                forecast_state,
                forecast_score,
                F.concat(F.lit("Prediction error: "), two_decimals(m)),
            ),
        )
        .otherwise(outcome(NORMAL, F.lit(EVIDENCE_NONE), forecast_state, forecast_score))
    )
    return out.withColumn("stage", rules).drop("__mse", "__score", "__ratio", "__recon", "__command")
