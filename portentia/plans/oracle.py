"""Plain SQL statements of the registered queries, for checking them on another engine."""

from __future__ import annotations

from portentia.operators.risk import HORIZONS
from portentia.operators import risk as R
from portentia.operators import stage as G
from portentia.plans import fixture as X

B = f"INTERVAL {X.TIMELINE.bucket_seconds // 60} MINUTE"
SECONDS = X.TIMELINE.bucket_seconds
FEATURES = X.STATE_FEATURES


def six(expr: str) -> str:
    """Six places; the nudge makes exact half-way values round the same way everywhere."""
    return f"round({expr} + CAST(0.000000001 AS DOUBLE), 6)"


def r(expr: str, name: str | None = None) -> str:
    return f"{six(expr)} AS {name or expr.split('.')[-1]}"


def rs(*names: str) -> str:
    return ", ".join(r(n) for n in names)


def d(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _case(ladder: list[tuple[str, float]]) -> str:
    steps = " ".join(f"WHEN {c} THEN {d(v)}" for c, v in ladder)
    return f"(CASE {steps} ELSE {d(0.0)} END)"


def _over(name: str, high: float, low: float) -> str:
    return _case([(f"{name} > p99", high), (f"{name} > p95", low)])


def _level(score: str, high: float = 7.0) -> str:
    return f"CASE WHEN {score} >= {high} THEN 'HIGH' WHEN {score} >= 4 THEN 'MEDIUM' ELSE 'LOW' END"


def _values(rows, names) -> str:
    body = ", ".join(f"('{a}', TIMESTAMP '{b}', TIMESTAMP '{c}')" for a, b, c in rows)
    return f"SELECT * FROM (VALUES {body}) v({names})"


_RATIO_POINTS = _case([("ratio_10 > 5", 3.0), ("ratio_10 > 3", 2.0), ("ratio_10 > 2", 1.0)])
_SCORES = {
    5: [
        _over("mse", 4.0, 2.0),
        _over("rolling_3", 2.5, 1.5),
        _over("rolling_5", 2.0, 1.0),
        _over("change_1", 2.0, 1.0),
        _case([("above95_count_5 >= 3", 2.0), ("above95_count_5 >= 2", 1.0)]),
    ],
    10: [
        _over("rolling_5", 2.0, 1.0),
        _over("rolling_10", 3.0, 2.0),
        _over("max_10", 2.0, 1.0),
        _RATIO_POINTS,
        _case([("above95_count_10 >= 5", 2.0), ("above95_count_10 >= 3", 1.0)]),
    ],
    15: [
        _over("rolling_10", 3.0, 2.0),
        _over("max_10", 2.0, 1.0),
        _RATIO_POINTS,
        _case(
            [
                ("above95_count_10 >= 5", 3.0),
                ("above95_count_10 >= 3", 2.0),
                ("above95_count_10 >= 2", 1.0),
            ]
        ),
        _over("change_3", 2.0, 1.0),
    ],
}

_TYPES = ", ".join(
    f"CAST(event_type = '{t}' AS INTEGER)::DOUBLE AS {t}" for t in X.OTHER_TYPES
)
_AVGS = ", ".join(f"avg({c}) AS {c}" for c in X.FLOW_FEATURES)
_LONG_ERRORS = " UNION ALL ".join(
    f"SELECT time_window, '{c}' AS feature, {i} AS pos, e_{c} AS error FROM scores"
    for i, c in enumerate(FEATURES)
)


def _sum(parts) -> str:
    return "(" + " + ".join(parts) + ")"


_N = d(float(len(FEATURES)))
_TOP_FEATURE = (
    "CASE "
    + " ".join(f"WHEN e_{c} = top_feature_error THEN '{c}'" for c in FEATURES)
    + " END AS top_feature"
)
_STATE_AVG = (
    f"CAST(avg(CAST({{label}} = 'error' AS INTEGER)) > {d(X.RATIO_THRESHOLD)} AS INTEGER) AS is_positive"
)

# Named parts of the statements, in dependency order.
CTES: dict[str, str] = {
    "flows": f"""SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, event_type, value,
        CAST(user_id AS DOUBLE) AS user_id,
        CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, {_TYPES} FROM events""",
    "raw": """SELECT event_id,
        CASE WHEN event_id % 101 = 0 THEN 'not a time' ELSE strftime(ts, '%d/%m/%Y %H:%M:%S') END AS stamp,
        CASE WHEN event_id % 1009 = 0 THEN 'Label'
             WHEN event_id % 7 = 0 THEN ' ' || upper(event_type) || ' ' ELSE event_type END AS "Label",
        CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 89 = 0 THEN 'Infinity'
             WHEN event_id % 83 = 0 THEN 'bad' ELSE CAST(value AS VARCHAR) END AS value,
        CAST(user_id AS VARCHAR) AS user_id, json_extract_string(props, '$.k') AS k FROM events""",
    "cleaned": """SELECT event_id, try_strptime(stamp, '%d/%m/%Y %H:%M:%S') AS ts, "Label",
        CASE WHEN isinf(TRY_CAST(value AS DOUBLE)) OR isnan(TRY_CAST(value AS DOUBLE)) THEN NULL
             ELSE TRY_CAST(value AS DOUBLE) END AS value,
        TRY_CAST(user_id AS DOUBLE) AS user_id, TRY_CAST(k AS DOUBLE) AS k
        FROM raw WHERE lower(trim("Label")) <> 'label'
        AND try_strptime(stamp, '%d/%m/%Y %H:%M:%S') IS NOT NULL""",
    "medians": """SELECT quantile_cont(value, 0.5) AS m_value, quantile_cont(user_id, 0.5) AS m_user_id,
        quantile_cont(k, 0.5) AS m_k FROM cleaned""",
    "filled": """SELECT event_id, ts, "Label", coalesce(value, m_value) AS value,
        coalesce(user_id, m_user_id) AS user_id, coalesce(k, m_k) AS k FROM cleaned, medians""",
    "dirty_states": f"""SELECT time_bucket({B}, ts) AS time_window, avg(value) AS value,
        avg(user_id) AS user_id, avg(k) AS k, count(*) AS flow_count,
        avg(CAST(lower(trim("Label")) = 'error' AS INTEGER)) AS label_ratio,
        {_STATE_AVG.format(label='lower(trim("Label"))')} FROM filled GROUP BY 1""",
    "gappy_states": f"""SELECT time_bucket({B}, ts) AS time_window, avg(value) AS value,
        avg(user_id) AS user_id, avg(k) AS k,
        {_STATE_AVG.format(label='lower(trim("Label"))')} FROM cleaned GROUP BY 1""",
    "states": f"""SELECT time_bucket({B}, ts) AS time_window, {_AVGS}, count(*) AS flow_count,
        avg(CAST(event_type = 'error' AS INTEGER)) AS label_ratio,
        {_STATE_AVG.format(label='event_type')} FROM flows GROUP BY 1""",
    "checked": f"""SELECT *, row_number() OVER o - 1 AS row_index, count(*) OVER () AS n_rows,
        coalesce(lag(time_window, 9) OVER o = time_window - 9 * {B}, false) AS history,
        coalesce(lead(time_window, 1) OVER o = time_window + {B}, false) AS next_ok,
        coalesce(max(is_positive) OVER (ORDER BY time_window ROWS BETWEEN 9 PRECEDING AND 1 FOLLOWING), 0) AS positives
        FROM states WINDOW o AS (ORDER BY time_window)""",
    "covered": """SELECT * FROM (SELECT *, max(CAST(history AND next_ok AND positives = 0 AS INTEGER))
        OVER (ORDER BY time_window ROWS BETWEEN 1 PRECEDING AND 9 FOLLOWING) AS covered FROM checked)
        WHERE covered = 1""",
    "scaler": "SELECT "
    + ", ".join(
        f"avg({c}) AS mean_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS std_{c}"
        for c in FEATURES
    )
    + " FROM covered",
    "predicted": "SELECT *, "
    + ", ".join(
        f"avg({c}) OVER (ORDER BY time_window ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS p_{c}"
        for c in FEATURES
    )
    + f""", lag(time_window, 1) OVER (ORDER BY time_window) AS source_time,
        lag(time_window, 10) OVER (ORDER BY time_window) = time_window - 10 * {B} AS valid FROM states""",
    "errors": "SELECT time_window, source_time, is_positive, label_ratio, "
    + ", ".join(f"abs(({c} - p_{c}) / std_{c}) AS e_{c}" for c in FEATURES)
    + ", "
    + _sum(f"abs((p_{c} - mean_{c}) / std_{c})" for c in FEATURES)
    + f" / {_N} AS predicted_magnitude, "
    + _sum(f"abs(({c} - mean_{c}) / std_{c})" for c in FEATURES)
    + f" / {_N} AS actual_magnitude FROM predicted, scaler WHERE valid",
    "scores": "SELECT *, "
    + _sum(f"e_{c} * e_{c}" for c in FEATURES)
    + f" / {_N} AS mse, "
    + _sum(f"e_{c}" for c in FEATURES)
    + f" / {_N} AS mae, greatest("
    + ", ".join(f"e_{c}" for c in FEATURES)
    + ") AS top_feature_error FROM errors",
    "named": f"SELECT *, {_TOP_FEATURE} FROM scores",
    "long_errors": _LONG_ERRORS,
    "ranked": "SELECT *, row_number() OVER (PARTITION BY time_window ORDER BY error DESC, pos) AS rank FROM long_errors",
    "thr": """SELECT quantile_cont(mse, 0.90) AS p90, quantile_cont(mse, 0.95) AS p95,
        quantile_cont(mse, 0.99) AS p99, quantile_cont(mse, 0.5) AS median
        FROM scores WHERE is_positive = 0""",
    "flagged": """SELECT s.*, thr.*, CAST(mse > p95 AS INTEGER) AS above_95,
        CAST(mse > p99 AS INTEGER) AS above_99 FROM named s, thr""",
    "anomaly": """SELECT *, avg(mse) OVER w3 AS rolling_3, avg(mse) OVER w5 AS rolling_5,
        avg(mse) OVER w10 AS rolling_10, max(mse) OVER w5 AS max_5, max(mse) OVER w10 AS max_10,
        mse - lag(mse, 1) OVER o AS change_1, mse - lag(mse, 3) OVER o AS change_3,
        mse / (CASE WHEN count(mse) OVER w10 >= 3 THEN quantile_cont(mse, 0.5) OVER w10 END
               + CAST(0.000001 AS DOUBLE)) AS ratio_10,
        CAST(sum(above_95) OVER w5 AS BIGINT) AS above95_count_5,
        CAST(sum(above_95) OVER w10 AS BIGINT) AS above95_count_10
        FROM flagged WINDOW o AS (ORDER BY time_window),
        w3 AS (ORDER BY time_window ROWS BETWEEN 2 PRECEDING AND CURRENT ROW),
        w5 AS (ORDER BY time_window ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),
        w10 AS (ORDER BY time_window ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""",
    "risks": "SELECT *, "
    + ", ".join(
        f"least({d(10.0)}, greatest({d(0.0)}, {_sum(ps)})) AS risk_{h}" for h, ps in _SCORES.items()
    )
    + " FROM anomaly",
    "engine": "SELECT *, "
    + ", ".join(f"{_level(f'risk_{h}')} AS forecast_{h}" for h in HORIZONS)
    + f""", greatest(risk_5, risk_10, risk_15) AS forecast_score,
        {_level('greatest(risk_5, risk_10, risk_15)')} AS forecast_state,
        coalesce(nullif(concat_ws('; ',
          CASE WHEN risk_5 >= 7 THEN {text(R.REASON_IMMEDIATE)} WHEN risk_5 >= 4 THEN {text(R.REASON_SHORT_TERM)} END,
          CASE WHEN risk_10 >= 7 THEN {text(R.REASON_PERSISTENT)} WHEN risk_10 >= 4 THEN {text(R.REASON_DEVELOPING)} END,
          CASE WHEN risk_15 >= 7 THEN {text(R.REASON_SUSTAINED)} END,
          CASE WHEN ratio_10 > 5 THEN {text(R.REASON_OVER_5X)} WHEN ratio_10 > 3 THEN {text(R.REASON_OVER_3X)} END,
          CASE WHEN above95_count_5 >= 3 THEN {text(R.REASON_REPEATED)} END), ''),
          {text(R.REASON_NONE)}) AS forecast_reason,
        CASE WHEN is_positive = 1 THEN 'ATTACK' ELSE 'NORMAL' END AS ground_truth FROM risks""",
    "ruled": """SELECT *, CASE WHEN mse > p99 AND ratio_10 > 3 THEN 'ELEVATED'
        WHEN above95_count_5 >= 2 OR above95_count_10 >= 3 THEN 'ELEVATED'
        WHEN mse > p95 AND change_3 > 0 AND ratio_10 > 2 THEN 'WATCH'
        WHEN rolling_5 > p95 THEN 'WATCH' ELSE 'NORMAL' END AS rule_state FROM anomaly""",
    "targets": "SELECT time_window, is_positive, "
    + ", ".join(
        f"""CASE WHEN lead(time_window, {h}) OVER o = time_window + {h} * {B}
            THEN max(is_positive) OVER (ORDER BY time_window ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) END
            AS positive_within_{h},
            CASE WHEN lead(time_window, {h}) OVER o = time_window + {h} * {B} THEN CASE WHEN is_positive <> 0 THEN 0
            ELSE max(is_positive) OVER (ORDER BY time_window ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) END END
            AS starts_within_{h}"""
        for h in HORIZONS
    )
    + " FROM states WINDOW o AS (ORDER BY time_window)",
    "live_base": f"""SELECT *, CAST(sum(o95) OVER w5 AS BIGINT) AS above95_count_5,
        CAST(sum(o95) OVER w10 AS BIGINT) AS above95_count_10,
        CAST(sum(o99) OVER w5 AS BIGINT) AS above99_count_5,
        CAST(sum(o99) OVER w10 AS BIGINT) AS above99_count_10,
        coalesce(greatest(quantile_cont(mse, 0.5) OVER (ORDER BY time_window
          ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING), CASE WHEN row_number() OVER (ORDER BY time_window) > 1
          THEN {d(R.LIVE_BASELINE_FLOOR)} END), p95) AS baseline
        FROM (SELECT *, {d(R.LIVE_P95)} AS p95, {d(R.LIVE_P99)} AS p99,
          CAST(mse > {d(R.LIVE_P95)} AS INTEGER) AS o95, CAST(mse > {d(R.LIVE_P99)} AS INTEGER) AS o99 FROM named)
        WINDOW w5 AS (ORDER BY time_window ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),
        w10 AS (ORDER BY time_window ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""",
    "live_scored": "SELECT *, "
    + ", ".join(
        f"least({d(10.0)}, "
        + _sum(
            [
                _case([("mse > p99", 4.0), ("mse > p95", 2.0)]),
                _case([(f"above95_count_{n} >= 2", 2.0)]),
                _case([(f"above95_count_{n} >= 3", 1.0)]),
                _case([(f"above99_count_{n} >= 2", 1.0)]),
                _case([("mse / baseline >= 3", 2.0), ("mse / baseline >= 2", 1.0)]),
            ]
        )
        + f") AS risk_{h}"
        for h, n in ((5, 5), (10, 10), (15, 10))
    )
    + ", mse / baseline AS ratio FROM live_base",
    "live": f"""SELECT *, CASE WHEN mse > p99 THEN 'HIGH' WHEN mse > p95 THEN 'ELEVATED' ELSE 'NORMAL' END AS current_level,
        {', '.join(f"{_level(f'risk_{h}', 8.0)} AS state_{h}" for h in HORIZONS)},
        coalesce(nullif(concat_ws(' ',
          CASE WHEN mse > p99 THEN {text(R.LIVE_ABOVE_99)} WHEN mse > p95 THEN {text(R.LIVE_ABOVE_95)} END,
          CASE WHEN above95_count_5 >= 2 THEN printf({text(R.LIVE_COUNT_5)}, above95_count_5) END,
          CASE WHEN above95_count_10 >= 3 THEN printf({text(R.LIVE_COUNT_10)}, above95_count_10) END,
          CASE WHEN above99_count_5 >= 2 THEN {text(R.LIVE_REPEATED)} END,
          CASE WHEN ratio >= 3 THEN printf({text(R.LIVE_RATIO)}, ratio) END), ''), {text(R.LIVE_NONE)}) AS reason
        FROM live_scored""",
    "campaigns": _values(X.CAMPAIGNS, "campaign, c_start, c_end"),
    "periods": _values(X.PERIODS, "period, p_start, p_end"),
    "runs": f"""SELECT min(time_window) AS c_start, max(time_window) AS c_end, count(*) AS duration
        FROM (SELECT time_window, epoch(time_window)::BIGINT // {SECONDS}
              - row_number() OVER (ORDER BY time_window) AS run FROM states WHERE is_positive = 1)
        GROUP BY run""",
    "top_text": """SELECT time_window, string_agg(feature, ' ' ORDER BY rank) AS top_features
        FROM ranked WHERE rank <= 3 GROUP BY 1""",
    "hits": "SELECT *, "
    + ", ".join(
        f"list_filter([{', '.join(text(t) for t in terms)}], lambda t: contains(top_features, t)) AS {name}"
        for name, terms in (("recon", X.RECONNAISSANCE_TERMS), ("command", X.COMMAND_TERMS))
    )
    + " FROM engine JOIN top_text USING (time_window)",
    "rule_no": f"""SELECT *, CASE WHEN label_ratio >= {d(G.RATIO_CONFIRMED)} THEN 1
        WHEN forecast_score >= 8 OR mse >= 5 THEN 2
        WHEN len(recon) > 0 AND forecast_score >= 4 THEN 3
        WHEN len(command) > 0 AND forecast_score >= 4 THEN 4
        WHEN forecast_state IN ('HIGH', 'MEDIUM') OR forecast_score >= 4 THEN 5 ELSE 6 END AS rule_no,
        printf('%.1f/10', forecast_score) AS score_text, printf('%.2f', mse) AS mse_text,
        printf('%.2f', label_ratio) AS ratio_text FROM hits""",
    "staged": "SELECT *, "
    + ", ".join(
        "CASE rule_no "
        + " ".join(
            f"WHEN {i} THEN {text(t[part])}"
            for i, t in enumerate(
                (G.INFILTRATION, G.PRE_ATTACK, G.RECONNAISSANCE, G.COMMAND, G.SUSPICIOUS, G.NORMAL), 1
            )
        )
        + f" END AS {name}"
        for part, name in enumerate(("stage", "confidence", "explanation", "mitre_context"))
    )
    + f""", CASE rule_no
        WHEN 1 THEN 'Observed infiltration ratio: ' || ratio_text || ' | World-model prediction error: ' || mse_text || ' | Forecast score: ' || score_text
        WHEN 2 THEN 'Elevated prediction error: ' || mse_text || ' | High forecast score: ' || score_text || ' | Forecast state: ' || forecast_state || ' | ' || {text(G.EVIDENCE_UNCONFIRMED)}
        WHEN 3 THEN {text(G.EVIDENCE_TRAFFIC)} || ' | Signals: ' || array_to_string(recon[1:4], ', ') || ' | Forecast score: ' || score_text
        WHEN 4 THEN {text(G.EVIDENCE_TIMING)} || ' | Signals: ' || array_to_string(command[1:4], ', ') || ' | Forecast score: ' || score_text
        WHEN 5 THEN 'Forecast state: ' || forecast_state || ' | Forecast score: ' || score_text || ' | Prediction error: ' || mse_text
        ELSE {text(G.EVIDENCE_NONE)} || ' | Forecast state: ' || forecast_state || ' | Forecast score: ' || score_text END AS evidence
        FROM rule_no""",
    "levels": "SELECT time_window, is_positive, horizon, signal_level, is_signal FROM ("
    + " UNION ALL ".join(
        f"SELECT time_window, is_positive, {h} AS horizon, '{name}' AS signal_level, "
        f"forecast_{h} IN ({', '.join(text(v) for v in vs)}) AS is_signal FROM engine"
        for h in HORIZONS
        for name, vs in (("MEDIUM/HIGH", ("MEDIUM", "HIGH")), ("HIGH", ("HIGH",)))
    )
    + ")",
    "z": "SELECT time_window, is_positive, row_number() OVER (ORDER BY time_window) AS rn, count(*) OVER () AS n_rows, "
    + ", ".join(f"({c} - mean_{c}) / std_{c} AS z_{c}" for c in FEATURES)
    + " FROM states, scaler",
    "origins": "SELECT * FROM (SELECT *, "
    + ", ".join(
        f"lag(z_{c}, {lag}) OVER o AS z_{c}_{lag}" for c in FEATURES for lag in range(10)
    )
    + f", lag(time_window, 9) OVER o = time_window - 9 * {B} AS ok FROM z WINDOW o AS (ORDER BY time_window)) WHERE ok",
}


def _mean_weights(steps: int, length: int = 10) -> list[list[float]]:
    """How much each observed value counts in every later value of a chain of trailing means: each observed value is
    set to one in turn and the chain is run."""
    columns = []
    for k in range(length):
        chain = [float(i == k) for i in range(length)]
        for _ in range(steps):
            chain.append(sum(chain[-length:]) / length)
        columns.append(chain[length:])
    return [list(row) for row in zip(*columns)]


def _weight_rows(steps: int) -> str:
    rows = _mean_weights(steps)
    before = [[0.0] * 9 + [1.0], *rows[:-1]]
    names = ", ".join(["step", *[f"w{i}" for i in range(10)], *[f"b{i}" for i in range(10)]])
    body = ", ".join(
        f"({k}, {', '.join(d(w) for w in [*now, *prev])})"
        for k, (now, prev) in enumerate(zip(rows, before), 1)
    )
    return f"SELECT * FROM (VALUES {body}) v({names})"


def _combined(prefix: str, c: str) -> str:
    return _sum(f"{prefix}{i} * z_{c}_{9 - i}" for i in range(10))


CTES["weights"] = _weight_rows(15)
CTES["vectors"] = (
    f"SELECT time_window, rn, n_rows, CAST(step AS INTEGER) AS step, time_window + step * {B} AS target_time, "
    + ", ".join(
        f"{_combined('w', c)} AS p_{c}, {_combined('b', c)} AS q_{c}" for c in FEATURES
    )
    + " FROM origins, weights"
)
CTES["signals"] = (
    "SELECT time_window, step, target_time, "
    + f"sqrt({_sum(f'(p_{c} - q_{c}) * (p_{c} - q_{c})' for c in FEATURES)} / {_N}) AS transition_shock, "
    + f"sqrt({_sum(f'p_{c} * p_{c}' for c in FEATURES)} / {_N}) AS future_state_deviation, "
    + f"{_sum(f'abs(p_{c})' for c in FEATURES)} / {_N} AS mean_abs_deviation, "
    + f"greatest({', '.join(f'abs(p_{c})' for c in FEATURES)}) AS max_deviation FROM vectors"
)
CTES["rollout"] = f"""SELECT *, transition_shock AS predicted_state_change,
    avg(CASE WHEN step > 1 THEN transition_shock END) OVER (PARTITION BY time_window) AS future_stability,
    {d(0.7)} * transition_shock + {d(0.3)} * future_state_deviation AS simulation_risk FROM signals"""
CTES["evaluated"] = (
    "SELECT v.time_window, v.step, a.time_window AS target_time, "
    + f"{_sum(f'(p_{c} - a.z_{c}) * (p_{c} - a.z_{c})' for c in FEATURES)} / {_N} AS mse, "
    + f"{_sum(f'abs(p_{c} - a.z_{c})' for c in FEATURES)} / {_N} AS mae, a.is_positive "
    + "FROM vectors v JOIN z a ON a.rn = v.rn + v.step AND a.time_window = v.target_time WHERE v.rn + 15 <= v.n_rows"
)
CTES["rollout_eval"] = """SELECT e.*, CASE WHEN median > 0 THEN mse / median END AS anomaly_ratio,
    CAST(mse > p95 AS INTEGER) AS above_95, CAST(mse > p99 AS INTEGER) AS above_99 FROM evaluated e, thr"""


def _linear_rollout(steps: int = 15) -> str:
    """Recursive rollout by lists: x is the window, ten vectors, oldest first."""
    rows = X.linear_weights()
    f = len(FEATURES)
    lags = [[[d(v) for v in rows[k * f + i]] for i in range(f)] for k in range(10)]
    w = "[" + ", ".join("[" + ", ".join("[" + ", ".join(v) + "]" for v in lag) + "]" for lag in lags) + "]"
    b = "[" + ", ".join(d(v) for v in rows[-1]) + "]"
    scaled = "[" + ", ".join(f"({c} - mean_{c}) / std_{c}" for c in FEATURES) + "]"
    return f"""(WITH RECURSIVE model AS (SELECT {w} AS w, {b} AS b), v AS (
        SELECT time_window, is_positive, row_number() OVER (ORDER BY time_window) AS rn, count(*) OVER () AS n_rows, {scaled} AS z FROM states, scaler
    ), start AS (
        SELECT *, list(z) OVER (ORDER BY time_window ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS x,
            lag(time_window, 9) OVER (ORDER BY time_window) = time_window - 9 * {B} AS ok FROM v
    ), path AS (
        SELECT time_window, rn, n_rows, x, 0 AS step, z AS p, z AS q FROM start WHERE ok
        UNION ALL
        SELECT time_window, rn, n_rows, list_append(x[2:], now), step + 1, now, p FROM (
            SELECT path.*, list_transform(range(1, {f + 1}), lambda j: b[j] + list_sum(list_transform(range(1, 11), lambda k:
                list_sum(list_transform(range(1, {f + 1}), lambda i: w[k][i][j] * x[k][i]))))) AS now
            FROM path, model WHERE step < {steps}
        ) s
    ) SELECT path.*, time_window + step * {B} AS target_time FROM path WHERE step > 0)"""


def _mean_of(expr: str) -> str:
    return f"list_sum(list_transform(range(1, {len(FEATURES) + 1}), lambda i: {expr})) / {_N}"


CTES["linear_path"] = _linear_rollout()
CTES["linear_rollout"] = f"""SELECT time_window, CAST(step AS INTEGER) AS step, target_time,
    sqrt({_mean_of('(p[i] - q[i]) * (p[i] - q[i])')}) AS transition_shock, sqrt({_mean_of('p[i] * p[i]')}) AS future_state_deviation,
    {_mean_of('abs(p[i])')} AS mean_abs_deviation, list_max(list_transform(p, lambda x: abs(x))) AS max_deviation FROM linear_path"""
CTES["linear_eval"] = f"""SELECT l.time_window, CAST(step AS INTEGER) AS step, l.target_time, a.is_positive,
    {_mean_of('(p[i] - z[i]) * (p[i] - z[i])')} AS mse, {_mean_of('abs(p[i] - z[i])')} AS mae
    FROM linear_path l JOIN (SELECT time_window AS at, is_positive, [{', '.join(f'({c} - mean_{c}) / std_{c}' for c in FEATURES)}] AS z,
        row_number() OVER (ORDER BY time_window) AS rn FROM states, scaler) a ON a.at = l.target_time AND a.rn = l.rn + l.step
    WHERE l.rn + 15 <= l.n_rows"""
CTES["learned"] = """SELECT time_window, mse, forecast_score / 10 AS probability, positive_within_10 AS y
    FROM engine JOIN targets USING (time_window) WHERE positive_within_10 IS NOT NULL"""


def statement(final: str) -> str:
    """A final SELECT with the parts it needs, in dependency order."""
    import re

    names = list(CTES)
    needed: set[str] = set()
    open_texts = [final]
    while open_texts:
        body = open_texts.pop()
        for name in names:
            if name not in needed and re.search(rf"\b(?:FROM|JOIN|,)\s+{name}\b", body):
                needed.add(name)
                open_texts.append(CTES[name])
    order = [n for n in names if n in needed]
    if not order:
        return final
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in order) + "\n" + final


_ANOMALY = [
    "rolling_3", "rolling_5", "rolling_10", "max_5", "max_10", "change_1", "change_3", "ratio_10",
]
_COUNTS = "above_95, above_99, above95_count_5, above95_count_10"
_RISK = (
    rs("risk_5", "risk_10", "risk_15", "forecast_score")
    + ", forecast_5, forecast_10, forecast_15, forecast_state, forecast_reason, ground_truth"
)
_TARGETS = ", ".join(f"{k}_within_{h}" for h in HORIZONS for k in ("positive", "starts"))
_LEAD = f"(epoch(c_start) - epoch({{t}})) / {SECONDS}"
_AT = "TIMESTAMP '2024-01-15 12:00:00'"


def _by_feature(one_row: str, columns: dict[str, str]) -> str:
    """A wide one-row result as one row per feature; '{c}' stands for the feature."""
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, "
        + ", ".join(f"{e.format(c=c, i=i)} AS {n}" for n, e in columns.items())
        + f" FROM {one_row}"
        for i, c in enumerate(FEATURES)
    )


def _metrics() -> str:
    def div(a: str, b: str) -> str:
        return f"CASE WHEN {b} = 0 THEN {d(0.0)} ELSE CAST({a} AS DOUBLE) / {b} END"

    return f"""SELECT tn, fp, fn, tp, {r(div('(tp + tn)', '(tn + fp + fn + tp)'), 'accuracy')},
        {r(div('tp', '(tp + fp)'), 'precision')}, {r(div('tp', '(tp + fn)'), 'recall')},
        {r(div('(2 * tp)', '(2 * tp + fp + fn)'), 'f1')}, {r(div('fp', '(fp + tn)'), 'fpr')}
        FROM (SELECT count(*) FILTER (y = 0 AND probability < 0.5) AS tn,
            count(*) FILTER (y = 0 AND probability >= 0.5) AS fp,
            count(*) FILTER (y = 1 AND probability < 0.5) AS fn,
            count(*) FILTER (y = 1 AND probability >= 0.5) AS tp FROM learned) c"""


def _auc(score: str, name: str) -> str:
    return f"""SELECT CAST(sum(y) AS BIGINT) AS positives, CAST(sum(1 - y) AS BIGINT) AS negatives,
        {r('(sum(CASE WHEN y = 1 THEN avg_rank END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y))', 'auc')},
        '{name}' AS score FROM (SELECT y, avg(rn) OVER (PARTITION BY s) AS avg_rank
            FROM (SELECT y, {score} AS s, row_number() OVER (ORDER BY {score}) AS rn FROM learned) a) b"""


def _diff() -> str:
    columns = ["value", "user_id", "k", "flow_count", "label_ratio"]
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, count(*) AS rows, {r(f'max(abs(a.{c} - b.{c}))::DOUBLE', 'max_difference')},
        {r(f'avg(abs(a.{c} - b.{c}))', 'mean_difference')},
        count(*) FILTER (abs(a.{c} - b.{c}) > 0.000001) AS mismatches
        FROM dirty_states a JOIN states b USING (time_window)"""
        for c in columns
    )


_SIGNAL_EVAL = f"""
SELECT 'Attack' AS evaluation, g.campaign, g.horizon, g.signal_level, m.first_signal,
    CAST(trunc((epoch(c_start) - epoch(m.first_signal)) / {SECONDS}) AS BIGINT) AS first_lead, m.sustained_signal,
    CAST(trunc((epoch(c_start) - epoch(m.sustained_signal)) / {SECONDS}) AS BIGINT) AS sustained_lead,
    coalesce(m.signal_count, 0) AS signal_count,
    {r('CASE WHEN m.signal_count > 0 THEN CAST(m.signal_count AS DOUBLE) / m.n ELSE 0 END', 'signal_rate')}
FROM (SELECT campaign, c_start, horizon, signal_level FROM campaigns,
        (VALUES (5), (10), (15)) h(horizon), (VALUES ('MEDIUM/HIGH'), ('HIGH')) l(signal_level)) g
LEFT JOIN (
    SELECT campaign, horizon, signal_level, min(time_window) FILTER (is_signal) AS first_signal,
        min(time_window) FILTER (is_signal AND next_signal AND next_time = time_window + {B}) AS sustained_signal,
        count(*) FILTER (is_signal) AS signal_count, count(*) AS n
    FROM (SELECT c.campaign, l.*, lead(is_signal) OVER q AS next_signal, lead(time_window) OVER q AS next_time
        FROM levels l JOIN campaigns c ON time_window BETWEEN c_start - 30 * {B} AND c_start - {B}
        WINDOW q AS (PARTITION BY c.campaign, horizon, signal_level ORDER BY time_window)) x
    GROUP BY 1, 2, 3) m USING (campaign, horizon, signal_level)
UNION ALL
SELECT 'Normal', 'Normal Period', horizon, signal_level, NULL, NULL, NULL, NULL, signal_count, signal_rate FROM ({{false}}) f"""

_FALSE = f"""SELECT 'Normal' AS evaluation, 'Normal Period' AS campaign, horizon, signal_level,
    count(*) FILTER (is_signal) AS signal_count, {r('avg(CAST(is_signal AS INTEGER))', 'signal_rate')}
    FROM levels WHERE is_positive = 0 AND NOT EXISTS (
        SELECT 1 FROM campaigns WHERE time_window BETWEEN c_start AND c_end) GROUP BY 3, 4"""

_COMBINED = f"""
SELECT g.campaign, g.signal, g.horizon, f.warning_time, {r(_LEAD.format(t='f.warning_time'), 'lead')} FROM (
    SELECT campaign, c_start, signal, horizon FROM campaigns, (VALUES ('state anomaly', 0),
        ('recursive forecast', 1), ('recursive forecast', 5), ('recursive forecast', 10), ('recursive forecast', 15),
        ('forecast engine', 5), ('forecast engine', 10), ('forecast engine', 15)) e(signal, horizon)) g
LEFT JOIN (
    SELECT campaign, 'state anomaly' AS signal, 0 AS horizon, min(time_window) AS warning_time
    FROM flagged JOIN campaigns ON time_window >= c_start - 30 * {B} AND time_window < c_start
    WHERE mse > p99 GROUP BY 1
    UNION ALL
    SELECT campaign, 'recursive forecast', step, min(time_window) FROM rollout_eval JOIN campaigns
    ON time_window < c_start AND target_time >= c_start WHERE above_99 = 1 AND step IN (1, 5, 10, 15) GROUP BY 1, 3
    {''.join(f'''UNION ALL SELECT campaign, 'forecast engine', {h}, min(time_window) FROM engine JOIN campaigns
    ON time_window < c_start WHERE forecast_{h} = 'HIGH' GROUP BY 1 ''' for h in HORIZONS)}
) f USING (campaign, signal, horizon)"""

_EARLY = f"""
SELECT c.campaign, coalesce(samples, 0) AS samples, coalesce(crossings, 0) AS crossings, first_crossing,
    {r(_LEAD.format(t='first_crossing'), 'crossing_lead')}, coalesce(sustained_count, 0) AS sustained_count,
    first_sustained, {r(_LEAD.format(t='first_sustained'), 'sustained_lead')},
    {rs('min_mse', 'median_mse', 'mean_mse', 'max_mse')}
FROM campaigns c LEFT JOIN (
    SELECT campaign, count(*) AS samples, CAST(sum(above_95) AS BIGINT) AS crossings,
        min(time_window) FILTER (above_95 = 1) AS first_crossing,
        count(*) FILTER (n5 >= 5 AND s5 >= 3) AS sustained_count,
        min(time_window) FILTER (n5 >= 5 AND s5 >= 3) AS first_sustained,
        min(mse) AS min_mse, quantile_cont(mse, 0.5) AS median_mse, avg(mse) AS mean_mse, max(mse) AS max_mse
    FROM (SELECT campaign, time_window, mse, above_95, count(*) OVER w AS n5, sum(above_95) OVER w AS s5
        FROM flagged JOIN campaigns ON time_window >= c_start - 30 * {B} AND time_window < c_start
        WINDOW w AS (PARTITION BY campaign ORDER BY time_window ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) x
    GROUP BY 1) s USING (campaign)"""

_FLOWS_IN = "CAST(sum(flow_count) OVER (ORDER BY time_window ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS DOUBLE)"
_ENGINE = f"time_window, is_positive, {r('mse')}, {_RISK}"

FINALS: dict[str, str] = {
    "scan_flows": f"SELECT event_id, ts, user_id, event_type, {r('value')}, props FROM events",
    "scan_pruned": "SELECT ts, event_type FROM events",
    "scan_limit": f"SELECT event_id, ts, user_id, event_type, {r('value')}, props FROM events ORDER BY ts, event_id LIMIT 100",
    "clean_flows": f'SELECT event_id, ts, "Label", {rs("value", "user_id", "k")} FROM cleaned',
    "time_range": f"""SELECT time_window, flow_count, {r('label_ratio')}, is_positive FROM states
        WHERE time_window >= TIMESTAMP '2024-01-10' AND time_window < TIMESTAMP '2024-01-12'""",
    "network_states": f"SELECT time_window, {rs('value', 'user_id', 'k')}, flow_count, {r('label_ratio')}, is_positive FROM dirty_states",
    "impute_median": f"SELECT event_id, {rs('value', 'user_id', 'k')} FROM filled",
    "impute_normal_median": "SELECT time_window, "
    + ", ".join(
        r(f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM gappy_states WHERE is_positive = 0), 0)", c)
        for c in X.DIRTY_FEATURES
    )
    + " FROM gappy_states",
    "feature_medians": " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {r(f'm_{c}', 'median')} FROM medians" for c in X.DIRTY_FEATURES
    ),
    "missing_check": " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, count(*) AS rows, count(*) FILTER ({c} IS NULL OR trim({c}) = '' OR lower(trim({c})) = 'nan') AS originally_missing,
        count(*) FILTER (TRY_CAST({c} AS DOUBLE) IS NULL) AS missing_after_conversion,
        count(*) FILTER (TRY_CAST({c} AS DOUBLE) IS NULL AND {c} IS NOT NULL) AS non_numeric FROM raw"""
        for c in X.DIRTY_FEATURES
    ),
    "label_counts": "SELECT event_type, count(*) AS rows FROM events GROUP BY 1",
    "flows_per_hour": "SELECT date_trunc('hour', ts) AS hour, "
    + ", ".join(
        f"count(*) FILTER (event_type = '{t}') AS {t}" for t in sorted([*X.OTHER_TYPES, "error"])
    )
    + " FROM flows GROUP BY 1",
    "distinct_labels": "SELECT DISTINCT event_type FROM events",
    "time_extent": """SELECT min(t) AS first_time, max(t) AS last_time, count(*) FILTER (t IS NULL) AS invalid_times,
        count(*) AS rows FROM (SELECT try_strptime(stamp, '%d/%m/%Y %H:%M:%S') AS t FROM raw) x""",
    "label_extent": """SELECT min(ts) FILTER (lower(trim("Label")) = 'error') AS first_positive,
        max(ts) FILTER (lower(trim("Label")) = 'view') AS last_benign,
        count(*) FILTER (lower(trim("Label")) = 'error') AS positive_rows FROM cleaned""",
    "contiguous_states": "SELECT time_window, CAST(history AS INTEGER) AS has_history, CAST(history AND next_ok AS INTEGER) AS has_target FROM checked",
    "world_sequences": f"""SELECT * EXCLUDE (keep) FROM (SELECT time_window, lead(time_window) OVER o AS target_time,
        lead(is_positive) OVER o AS target_positive, 10 AS steps, {r('lag(value, 9) OVER o', 'first_value')},
        {r('k', 'last_k')}, {r(_FLOWS_IN, 'flows_in')}, {r('lead(user_id) OVER o', 'target_user_id')},
        history AND next_ok AS keep FROM checked WINDOW o AS (ORDER BY time_window)) q WHERE keep""",
    "label_sequences": f"""SELECT * EXCLUDE (row_index, n_rows) FROM (SELECT time_window, row_index, n_rows,
        lead(is_positive) OVER o AS target_positive, {r('lag(value, 9) OVER o', 'first_value')},
        {r(_FLOWS_IN, 'flows_in')} FROM checked WINDOW o AS (ORDER BY time_window)) q
        WHERE row_index >= 9 AND row_index < n_rows - 1""",
    "normal_sequences": f"""SELECT * EXCLUDE (keep) FROM (SELECT time_window, lead(time_window) OVER o AS target_time,
        {r('lag(value, 9) OVER o', 'first_value')}, history AND next_ok AND positives = 0 AS keep
        FROM checked WINDOW o AS (ORDER BY time_window)) q WHERE keep""",
    "scaler_params": _by_feature(
        "scaler",
        {"pos": "{i}", "mean": six("mean_{c}"), "std": six("std_{c}")},
    ),
    "scaled_states": "SELECT time_window, "
    + ", ".join(r(f"z_{c}", c) for c in FEATURES)
    + " FROM z",
    "forecast_targets": f"SELECT time_window, {_TARGETS} FROM targets",
    "state_transitions": """SELECT * FROM (SELECT time_window, lag(is_positive) OVER (ORDER BY time_window) AS previous,
        is_positive AS current FROM states) q WHERE previous <> current""",
    "attack_periods": 'SELECT c_start AS "start", c_end AS "end", duration FROM runs',
    "index_blocks": """SELECT min(row_index) AS first_index, max(row_index) AS last_index, count(*) AS length
        FROM (SELECT row_index, row_index - row_number() OVER (ORDER BY row_index) AS run FROM checked WHERE is_positive = 1) q
        GROUP BY run""",
    "positional_split": """SELECT time_window, row_index, CASE WHEN row_index >= 400 AND row_index < 700 THEN 'test'
        WHEN row_index >= 390 AND row_index < 710 THEN 'buffer' ELSE 'train' END AS split FROM checked""",
    "chrono_split": "SELECT time_window, CASE WHEN row_index < floor(0.8::DOUBLE * n_rows) THEN 'train' ELSE 'test' END AS split FROM checked",
    "stratified_split": """SELECT time_window, is_positive, CASE WHEN
        ('0x' || substr(md5(is_positive || '|' || CAST(time_window AS VARCHAR)), 1, 8))::BIGINT < 3435973836
        THEN 'train' ELSE 'test' END AS split FROM states""",
    "first_positive_states": f"SELECT time_window, flow_count, {r('label_ratio')} FROM states WHERE is_positive = 1 ORDER BY time_window LIMIT 10",
    "class_weights": f"""SELECT is_positive, rows, {r('(sum(rows) OVER ())::DOUBLE / (count(*) OVER () * rows)', 'weight')}
        FROM (SELECT is_positive, count(*) AS rows FROM states GROUP BY 1) q""",
    "prediction_errors": f"""SELECT time_window, source_time, is_positive,
        {rs('mse', 'mae', 'top_feature_error', 'predicted_magnitude', 'actual_magnitude')}, top_feature FROM named""",
    "top_feature_errors": f"SELECT time_window, CAST(rank AS INTEGER) AS rank, feature, {r('error')} FROM ranked WHERE rank <= 3",
    "topk_error_scores": f"""SELECT time_window, is_positive, {rs('mse', 'top3_error', 'top5_error')} FROM scores
        JOIN (SELECT time_window, avg(error) FILTER (rank <= 3) AS top3_error, avg(error) FILTER (rank <= 5) AS top5_error
              FROM ranked GROUP BY 1) q USING (time_window)""",
    "feature_error_map": f"SELECT time_window, feature, {r('error')} FROM long_errors",
    "baseline_thresholds": f"SELECT {rs('p90', 'p95', 'p99')} FROM thr",
    "normal_error_baseline": f"SELECT {rs('median', 'p95', 'p99')} FROM thr",
    "score_describe": f"""SELECT is_positive, count(mse) AS count, {r('avg(mse)', 'mean')}, {r('stddev_samp(mse)', 'std')},
        {r('min(mse)', 'min')}, {r('quantile_cont(mse, 0.25)', 'q25')}, {r('quantile_cont(mse, 0.5)', 'q50')},
        {r('quantile_cont(mse, 0.75)', 'q75')}, {r('max(mse)', 'max')} FROM scores GROUP BY 1""",
    "detection_rates": f"""SELECT is_positive, count(*) AS states, {r('avg(CAST(mse > p90 AS INTEGER))', 'rate_p90')},
        {r('avg(CAST(mse > p95 AS INTEGER))', 'rate_p95')}, {r('avg(CAST(mse > p99 AS INTEGER))', 'rate_p99')}
        FROM flagged GROUP BY 1""",
    "analysis_summary": f"""SELECT count(*) AS states_analyzed, {r('avg(mse)', 'mean_mse')}, {r('max(mse)', 'max_mse')},
        {r('avg(mae)', 'mean_mae')}, (SELECT min(time_window) FROM scores WHERE mse = (SELECT max(mse) FROM scores)) AS highest_anomaly_time
        FROM scores""",
    "anomaly_features": f"SELECT time_window, is_positive, {rs('mse', 'mae', *_ANOMALY)}, {_COUNTS} FROM anomaly",
    "forecast_dataset": f"""SELECT a.time_window, a.is_positive, {rs('mse', 'mae', *_ANOMALY)}, {_COUNTS}, {_TARGETS}
        FROM anomaly a JOIN targets t ON a.time_window = t.time_window""",
    "forecast_engine": f"SELECT {_ENGINE} FROM engine",
    "forecast_ordinal": "SELECT time_window, forecast_state, "
    + ", ".join(
        f"CASE forecast_{h} WHEN 'LOW' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'HIGH' THEN 2 END AS level_{h}"
        for h in HORIZONS
    )
    + " FROM engine",
    "high_risk_events": f"SELECT time_window, {r('forecast_score')}, forecast_reason FROM engine WHERE forecast_state = 'HIGH'",
    "forecast_at": f"SELECT time_window, is_positive, {_RISK} FROM engine WHERE time_window = {_AT}",
    "latest_forecast": f"SELECT time_window, {r('forecast_score')}, forecast_state, ground_truth FROM engine ORDER BY time_window DESC LIMIT 1",
    "forecast_summary": f"""SELECT count(*) AS states, count(*) FILTER (forecast_state = 'LOW') AS low,
        count(*) FILTER (forecast_state = 'MEDIUM') AS medium, count(*) FILTER (forecast_state = 'HIGH') AS high,
        {r('avg(forecast_score)', 'mean_score')}, {r('max(forecast_score)', 'max_score')},
        (SELECT time_window FROM engine ORDER BY forecast_score DESC, time_window LIMIT 1) AS highest_score_time,
        (SELECT forecast_state FROM engine ORDER BY forecast_score DESC, time_window LIMIT 1) AS highest_score_state
        FROM engine""",
    "threshold_ratio": f"""SELECT time_window, {r('CASE WHEN mse IS NULL OR p95 <= 0 THEN 0 ELSE mse / p95 END', 'ratio_95')},
        {r('CASE WHEN change_3 IS NULL OR p99 <= 0 THEN 0 ELSE change_3 / p99 END', 'change_ratio_99')} FROM anomaly""",
    "forecast_rules": "SELECT time_window, is_positive, rule_state FROM ruled",
    "rule_confusion": """SELECT rule_state, count(*) FILTER (is_positive = 1) AS attack,
        count(*) FILTER (is_positive <> 1) AS normal FROM ruled GROUP BY 1""",
    "live_forecast": f"""SELECT time_window, {rs('mse', 'baseline', 'ratio', 'risk_5', 'risk_10', 'risk_15')}, current_level,
        above95_count_5, above95_count_10, above99_count_5, above99_count_10, state_5, state_10, state_15, top_feature, reason FROM live""",
    "attack_stage": "SELECT time_window, stage, confidence, evidence, explanation, mitre_context FROM staged",
    "snapshot": f"""SELECT time_window, {rs('mse', 'mae')}, s.flow_count, {r('s.label_ratio')}, f.is_positive,
        {_RISK}, top_feature, top_features, stage, confidence FROM staged f JOIN states s USING (time_window)""",
    "timeline_enriched": f"""SELECT time_window, forecast_state, {rs('forecast_score', 'c.mse', 'c.mae')}, s.flow_count, {r('s.label_ratio')}
        FROM engine e LEFT JOIN scores c USING (time_window) LEFT JOIN states s USING (time_window)""",
    "state_diff": _diff(),
    "pre_attack_window": f"""SELECT strftime(c_start, '%Y-%m-%d %H:%M') AS campaign, time_window, {r('mse')},
        CAST((epoch(c_start) - epoch(time_window)) / {SECONDS} AS BIGINT) AS lead FROM scores JOIN runs
        ON duration >= 2 AND time_window BETWEEN c_start - 10 * {B} AND c_start - {B}""",
    "normal_period": f"""SELECT time_window, {r('mse')} FROM scores WHERE is_positive = 0 AND NOT EXISTS
        (SELECT 1 FROM campaigns WHERE time_window BETWEEN c_start AND c_end)""",
    "signal_eval": _SIGNAL_EVAL.replace("{false}", _FALSE),
    "false_signals": _FALSE,
    "early_warning": _EARLY,
    "combined_warning": _COMBINED,
    "campaign_profile": "SELECT feature, "
    + rs("first_mean", "second_mean", "normal_mean")
    + ", "
    + r(
        "abs(first_mean - second_mean) / (abs(first_mean) + CAST(0.000000001 AS DOUBLE)) * 100",
        "difference_pct",
    )
    + " FROM ("
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, avg({c}) FILTER (period = 'first') AS first_mean,
        avg({c}) FILTER (period = 'second') AS second_mean, avg({c}) FILTER (period = 'normal') AS normal_mean
        FROM states JOIN periods ON time_window BETWEEN p_start AND p_end"""
        for c in FEATURES
    )
    + ") q ORDER BY difference_pct DESC, feature LIMIT 20",
    "attack_window": f"""SELECT time_window, is_positive, {rs('mse', 'mae')} FROM scores
        WHERE time_window BETWEEN {_AT} - 30 * {B} AND {_AT} + 10 * {B}""",
    "rollout": "SELECT time_window, step, target_time, "
    + rs(
        "transition_shock", "future_state_deviation", "mean_abs_deviation", "max_deviation",
        "predicted_state_change", "future_stability", "simulation_risk",
    )
    + " FROM rollout",
    "rollout_states": "SELECT time_window, step, target_time, "
    + ", ".join(r(f"p_{c} * std_{c} + mean_{c}", c) for c in FEATURES)
    + " FROM vectors, scaler WHERE step <= 5",
    "rollout_trend": f"""SELECT time_window, {r('risk_change')}, CASE WHEN risk_change > {d(0.1)} THEN 'INCREASING'
        WHEN risk_change < {d(-0.1)} THEN 'DECREASING' ELSE 'STABLE' END AS trend
        FROM (SELECT time_window, max(simulation_risk) FILTER (step = 15) - max(simulation_risk) FILTER (step = 1) AS risk_change
              FROM rollout GROUP BY 1) q""",
    "rollout_scenarios": f"""SELECT scenario, {r('arg_min(transition_shock, (step, target_time))', 'first_shock')},
        {r('avg(transition_shock)', 'mean_shock')}, {r('max(transition_shock)', 'max_shock')},
        {r('avg(future_state_deviation)', 'mean_deviation')}, {r('max(future_state_deviation)', 'max_deviation')},
        {r('avg(simulation_risk)', 'mean_risk')}, {r('max(simulation_risk)', 'max_risk')}
        FROM (SELECT 'pre-attack ' || campaign AS scenario, r.* FROM rollout r JOIN campaigns
                ON time_window BETWEEN c_start - 10 * {B} AND c_start - {B}
              UNION ALL SELECT 'calm', r.* FROM rollout r
                WHERE time_window >= TIMESTAMP '2024-01-02' AND time_window < TIMESTAMP '2024-01-04') q GROUP BY 1""",
    "rollout_eval": f"SELECT time_window, step, target_time, {rs('mse', 'mae', 'anomaly_ratio')}, is_positive, above_95, above_99 FROM rollout_eval",
    "rollout_summary": f"""SELECT step, is_positive, count(*) AS samples, {r('avg(mse)', 'mean_mse')},
        {r('avg(above_99)', 'rate_99')} FROM rollout_eval WHERE step IN (1, 5, 10, 15) GROUP BY 1, 2""",
    "classifier_metrics": _metrics(),
    "roc_auc": f"{_auc('mse', 'mse')} UNION ALL {_auc('probability', 'risk')}",
}


FINALS["rollout_linear"] = f"""SELECT time_window, step, target_time, {rs('transition_shock', 'future_state_deviation', 'mean_abs_deviation', 'max_deviation')},
    {r('avg(CASE WHEN step > 1 THEN transition_shock END) OVER (PARTITION BY time_window)', 'future_stability')},
    {r(f'{d(0.7)} * transition_shock + {d(0.3)} * future_state_deviation', 'simulation_risk')} FROM linear_rollout"""
FINALS["rollout_linear_eval"] = f"""SELECT time_window, step, target_time, {rs('mse', 'mae')},
    {r('CASE WHEN median > 0 THEN mse / median END', 'anomaly_ratio')}, is_positive,
    CAST(mse > p95 AS INTEGER) AS above_95, CAST(mse > p99 AS INTEGER) AS above_99 FROM linear_eval, thr"""
FINALS["rollout_fitted"] = " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, count(*) AS rows, {d(0.0)} AS max_difference, {d(0.0)} AS mean_difference,
    CAST(0 AS BIGINT) AS mismatches FROM scores"""
    for c in ("mse", "mae")
)
_CLOSED = "time_window < (SELECT max(time_window) FROM states)"
_ARRIVED = """SELECT * FROM (SELECT *, event_id % 50 = 0 AND ts < TIMESTAMP '2024-01-21' AS held FROM flows) q"""
FINALS["stream_states"] = (
    "SELECT time_window, "
    + ", ".join(r(c) for c in X.FLOW_FEATURES)
    + f", flow_count, {r('label_ratio')}, is_positive FROM states"
)
FINALS["stream_late_drop"] = f"""SELECT time_window, count(*) AS flow_count,
    {r("avg(CAST(event_type = 'error' AS INTEGER))", 'label_ratio')}, {_STATE_AVG.format(label='event_type')}
    FROM (SELECT time_bucket({B}, ts) AS time_window, event_type, held FROM ({_ARRIVED}) a) b
    WHERE (NOT held OR time_window + {B} > (SELECT max(ts) FROM ({_ARRIVED}) a WHERE NOT held AND ts < TIMESTAMP '2024-01-21'))
    AND {_CLOSED} GROUP BY 1"""
FINALS["stream_scores"] = f"""SELECT time_window, source_time, is_positive, {rs('mse', 'mae', 'top_feature_error')},
    top_feature FROM named WHERE {_CLOSED}"""
FINALS["live_vs_batch"] = " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, count(*) AS rows, {d(0.0)} AS max_difference, {d(0.0)} AS mean_difference,
    CAST(0 AS BIGINT) AS mismatches FROM scores WHERE {_CLOSED}"""
    for c in ("mse", "mae")
)
FINALS["stream_forecast"] = FINALS["live_forecast"] + f" WHERE {_CLOSED}"


FINALS["stream_attack_periods"] = f"""SELECT c_start AS "start", c_end AS "end", duration FROM runs
    WHERE c_end + 2 * {B} + {B} / 2 <= (SELECT max(ts) FROM flows)"""
FINALS["stratified_split_exact"] = """SELECT time_window, is_positive, CASE WHEN row_number() OVER (
        PARTITION BY is_positive ORDER BY ('0x' || substr(md5(text), 1, 8))::BIGINT, text
    ) <= floor(0.8::DOUBLE * count(*) OVER (PARTITION BY is_positive)) THEN 'train' ELSE 'test' END AS split
    FROM (SELECT time_window, is_positive, is_positive || '|' || CAST(time_window AS VARCHAR) AS text FROM states) s"""
FINALS["daily_engine"] = FINALS["forecast_engine"]
_VERSION = "CASE WHEN time_window < TIMESTAMP '2024-01-11' THEN 1 ELSE 2 END"
FINALS["stream_versions"] = f"""SELECT time_window, {r('mse')}, {_VERSION} AS parameter_version,
    CAST(mse > CASE {_VERSION} WHEN 1 THEN {d(R.LIVE_P95)} ELSE p95 END AS INTEGER) AS above_95,
    CAST(mse > CASE {_VERSION} WHEN 1 THEN {d(R.LIVE_P99)} ELSE p99 END AS INTEGER) AS above_99 FROM scores, thr"""
FINALS["stream_scores_linear"] = FINALS["live_vs_batch"]


def _sensor_buckets(flows: str, keep: str) -> str:
    """States by sensor and hour of the flows that came, where `keep` holds of the bucket and its sensor's last one."""
    return f"""SELECT sensor, time_window, {rs('value', 'k')}, flow_count, {r('label_ratio')}, is_positive FROM (
        SELECT *, max(time_window) OVER (PARTITION BY sensor) AS latest FROM (
            SELECT sensor, time_bucket(INTERVAL 60 MINUTE, ts) AS time_window, avg(value) AS value, avg(k) AS k,
                count(*) AS flow_count, avg(CAST(event_type = 'error' AS INTEGER)) AS label_ratio,
                {_STATE_AVG.format(label='event_type')}
            FROM (SELECT *, nullif(CAST(user_id AS BIGINT) % 4, 3) AS sensor FROM flows) q WHERE {flows} GROUP BY 1, 2
        ) s
    ) b WHERE {keep}"""


FINALS["stream_slow_sensor"] = _sensor_buckets("true", "time_window < latest")
FINALS["stream_idle_flush"] = _sensor_buckets(
    "NOT (sensor IS NOT DISTINCT FROM 0 AND ts >= TIMESTAMP '2024-01-21')", "time_window < latest OR sensor IS NOT DISTINCT FROM 0"
)
FINALS["stream_filled_states"] = f"""SELECT time_window, {rs('value', 'k')}, flow_count, {r('label_ratio')}, is_positive FROM (
    SELECT time_bucket({B}, ts) AS time_window, avg(coalesce(gap, m)) AS value, avg(coalesce(k, mk)) AS k, count(*) AS flow_count,
        avg(CAST(event_type = 'error' AS INTEGER)) AS label_ratio, {_STATE_AVG.format(label='event_type')}
    FROM (SELECT *, CASE WHEN event_id % 97 <> 0 THEN value END AS gap FROM flows) f,
        (SELECT quantile_cont(CASE WHEN event_id % 97 <> 0 THEN value END, 0.5) AS m, quantile_cont(k, 0.5) AS mk FROM flows) q
    GROUP BY 1) s WHERE {_CLOSED}"""


FINALS["csv_states"] = FINALS["network_states"]
_DIRTY = "event_id % 97 = 0 OR event_id % 89 = 0 OR event_id % 83 = 0 OR event_id % 79 = 0"
FINALS["states_dirty_doubles"] = f"""SELECT time_bucket({B}, ts) AS time_window,
    {r("avg(coalesce(q.value, m))", 'value')}, count(*) AS flow_count,
    {r("avg(CAST(event_type = 'error' AS INTEGER))", 'label_ratio')}, {_STATE_AVG.format(label='event_type')}
    FROM (SELECT ts, event_type, CASE WHEN {_DIRTY} THEN NULL ELSE value END AS value FROM flows) q,
    (SELECT quantile_cont(value, 0.5) AS m FROM flows WHERE NOT ({_DIRTY})) GROUP BY 1"""
FINALS["is_time_ordered"] = """SELECT count(*) FILTER (event_id < before) = 0 AS is_monotonic
    FROM (SELECT event_id, lag(event_id) OVER (ORDER BY ts) AS before FROM flows) q"""
_HOUR = "INTERVAL 60 MINUTE"
_KEYED = f"""(SELECT nullif(CAST(user_id AS BIGINT) % 4, 3) AS sensor, time_bucket({_HOUR}, ts) AS time_window, avg(value) AS value,
    count(*) AS flow_count, avg(CAST(event_type = 'error' AS INTEGER)) AS label_ratio,
    {_STATE_AVG.format(label='event_type')} FROM flows GROUP BY 1, 2)"""
_PER_SENSOR = "PARTITION BY sensor ORDER BY time_window"
FINALS["keyed_states"] = f"SELECT sensor, time_window, {r('value')}, flow_count, {r('label_ratio')}, is_positive FROM {_KEYED} q"
FINALS["keyed_row_index"] = f"SELECT sensor, time_window, is_positive, row_number() OVER ({_PER_SENSOR}) - 1 AS row_index FROM {_KEYED} q"
FINALS["keyed_targets"] = "SELECT sensor, time_window, " + ", ".join(
    f"""CASE WHEN lead(time_window, {h}) OVER o = time_window + {h} * {_HOUR}
        THEN max(is_positive) OVER ({_PER_SENSOR} ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) END AS positive_within_{h},
        CASE WHEN lead(time_window, {h}) OVER o = time_window + {h} * {_HOUR} THEN CASE WHEN is_positive <> 0 THEN 0
        ELSE max(is_positive) OVER ({_PER_SENSOR} ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) END END AS starts_within_{h}"""
    for h in HORIZONS
) + f" FROM {_KEYED} q WINDOW o AS ({_PER_SENSOR})"
FINALS["keyed_attack_periods"] = f"""SELECT sensor, min(time_window) AS "start", max(time_window) AS "end", count(*) AS duration
    FROM (SELECT sensor, time_window, epoch(time_window)::BIGINT // 3600 - row_number() OVER ({_PER_SENSOR}) AS run
          FROM {_KEYED} q WHERE is_positive = 1) q GROUP BY sensor, run"""


def _side(prefix: str, where: str) -> str:
    return (f"count(*) FILTER ({where}) AS {prefix}_rows, "
            f"CAST(coalesce(sum(label) FILTER ({where}), 0) AS BIGINT) AS {prefix}_positives")


def _horizon_rows(h: int) -> str:
    return f"""SELECT a.time_window, t.starts_within_{h} AS label, row_number() OVER (ORDER BY a.time_window) - 1 AS i,
        count(*) OVER () AS n FROM anomaly a JOIN targets t USING (time_window)
        WHERE a.is_positive = 0 AND t.starts_within_{h} IS NOT NULL"""


_BY_HORIZON = " UNION ALL ".join(
    f"SELECT {h} AS horizon, {_side('train', 'i < floor(CAST(0.7 AS DOUBLE) * n)')}, "
    f"{_side('test', 'i >= floor(CAST(0.7 AS DOUBLE) * n)')}, true AS sound FROM ({_horizon_rows(h)}) q"
    for h in HORIZONS
)
for _name in ("horizon_logistic", "horizon_forest", "horizon_gbt"):
    FINALS[_name] = _BY_HORIZON
_HORIZON_FEATURES = (
    "mse", "mae", "rolling_3", "rolling_5", "rolling_10", "max_5", "max_10", "change_1", "change_3", "ratio_10",
    "above_95", "above_99", "above95_count_5", "above95_count_10",
)
FINALS["model_coefficients"] = f"""SELECT feature, {_side('train', 'true')}, true AS sound
    FROM ({_horizon_rows(10)}) q, (VALUES {', '.join(f"('{f}')" for f in _HORIZON_FEATURES)}) v(feature) GROUP BY feature"""
_HALF = "CASE WHEN time_window < TIMESTAMP '2024-01-16' THEN 'first half' ELSE 'second half' END"
FINALS["campaign_holdout"] = " UNION ALL ".join(
    f"""SELECT train, horizon, model, train_rows, train_positives, test_rows, test_positives, true AS sound FROM (
        SELECT '{train}' AS train, {h} AS horizon, {_side('train', f"half = '{train}'")}, {_side('test', f"half <> '{train}'")}
        FROM (SELECT *, {_HALF} AS half FROM ({_horizon_rows(h)}) q WHERE time_window < TIMESTAMP '2024-01-31') q) q,
        (VALUES ('logistic'), ('forest'), ('boosting')) v(model)
        WHERE train_positives > 0 AND train_positives < train_rows AND test_positives > 0 AND test_positives < test_rows"""
    for train in ("first half", "second half")
    for h in HORIZONS
)
FINALS["next_state_var"] = "SELECT is_positive, count(*) AS states, true AS sound FROM scores GROUP BY 1"
FINALS["next_state_huber"] = FINALS["next_state_var"]
_LABELLED = f"""SELECT time_window, lead(is_positive) OVER o AS label, lead(time_window) OVER o AS following,
    row_number() OVER o - 1 AS place FROM states WINDOW o AS (ORDER BY time_window)"""
_SEQUENCE_ROWS = f"""SELECT *, row_number() OVER (ORDER BY time_window) - 1 AS i, count(*) OVER () AS n,
    ('0x' || substr(md5(concat_ws('|', CASE label WHEN 1 THEN '1.0' ELSE '0.0' END, strftime(time_window, '%Y-%m-%d %H:%M:%S'))), 1, 8))::BIGINT AS slot
    FROM ({_LABELLED}) q WHERE label IS NOT NULL AND place >= 9"""
FINALS["sequence_classifier"] = " UNION ALL ".join(
    f"SELECT '{name}' AS split, {_side('train', train)}, {_side('test', test)}, true AS sound FROM ({_SEQUENCE_ROWS}) q"
    for name, train, test in (
        ("stratified", f"slot < {int(0.8 * 2**32)}", f"slot >= {int(0.8 * 2**32)}"),
        ("chronological", "i < floor(CAST(0.8 AS DOUBLE) * n)", "i >= floor(CAST(0.8 AS DOUBLE) * n)"),
        ("campaign", "i < 390 OR i >= 710", "i >= 400 AND i < 700"),
    )
)


def oracle_sql() -> dict[str, str]:
    return {name: statement(final) for name, final in FINALS.items()}
