"""DuckDB twins of the shared frames, as named CTEs.

Constants that meet doubles are written as ``CAST(n AS DOUBLE)`` so both
engines see doubles (a decimal literal is DECIMAL in Spark). ``with_(...)``
emits a WITH clause holding the requested CTEs and their dependencies.
"""

from __future__ import annotations

D0 = "CAST(0 AS DOUBLE)"
D1 = "CAST(1 AS DOUBLE)"
D100 = "CAST(100 AS DOUBLE)"

CTES: dict[str, tuple[list[str], str]] = {}


def cte(name: str, deps: list[str], sql: str) -> None:
    CTES[name] = (deps, sql)


def with_(*names: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTES[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS (\n{CTES[n][1]}\n)" for n in order) + "\n"


cte("tx0", [], f"""
SELECT o.o_orderkey AS tx_id,
       o.o_orderdate AS created_at,
       CAST(1 + date_diff('day', DATE '1992-01-01', CAST(o.o_orderdate AS DATE)) % 743 AS INTEGER) AS step,
       CASE o.o_orderpriority WHEN '1-URGENT' THEN 'TRANSFER' WHEN '2-HIGH' THEN 'CASH_OUT'
            WHEN '3-MEDIUM' THEN 'DEBIT' WHEN '4-NOT SPECIFIED' THEN 'CASH_IN'
            WHEN '5-LOW' THEN 'PAYMENT' END AS type,
       o.o_totalprice AS amount,
       'C' || CAST(o.o_custkey AS VARCHAR) AS nameOrig,
       CASE WHEN o.o_orderkey % 6 = 0 THEN {D0}
            ELSE greatest(c.c_acctbal, {D0}) * {D100} END AS oldbalanceOrg,
       'M' || CAST(o.o_orderkey % (SELECT count(*) FROM supplier) AS VARCHAR) AS nameDest,
       CASE WHEN o.o_orderkey % 3 = 0 THEN {D0}
            ELSE greatest(s.s_acctbal, {D0}) * {D100} END AS oldbalanceDest,
       (o.o_orderkey * 37) % 1009 AS _h,
       o.o_orderkey AS _k
FROM orders o
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN supplier s ON s.s_suppkey = o.o_orderkey % (SELECT count(*) FROM supplier)""")

cte("tx", ["tx0"], f"""
SELECT tx_id, created_at, step, type, amount, nameOrig, oldbalanceOrg,
       CASE WHEN _k % 4 = 0 THEN oldbalanceOrg
            ELSE greatest(oldbalanceOrg - amount, {D0}) END AS newbalanceOrig,
       nameDest, oldbalanceDest,
       CASE WHEN _k % 5 = 0 THEN oldbalanceDest ELSE oldbalanceDest + amount END AS newbalanceDest,
       CASE WHEN (type IN ('TRANSFER', 'CASH_OUT') AND _h > 900) OR _k % 97 = 0
            THEN 1 ELSE 0 END AS isFraud,
       CASE WHEN type = 'TRANSFER' AND amount > CAST(400000 AS DOUBLE) THEN 1 ELSE 0 END AS isFlaggedFraud,
       CAST(_h AS DOUBLE) / CAST(1008 AS DOUBLE) AS prob
FROM tx0""")

# requests with faults and repeated rows
cte("req", ["tx"], """
SELECT tx_id, created_at,
       CASE WHEN tx_id % 50 = 6 THEN -5 WHEN tx_id % 50 = 7 THEN NULL WHEN tx_id % 50 = 8 THEN 5000
            ELSE step END AS step,
       CASE WHEN tx_id % 50 = 4 THEN NULL WHEN tx_id % 50 = 5 THEN 'XYZ' ELSE type END AS type,
       CASE WHEN tx_id % 50 = 1 THEN NULL WHEN tx_id % 50 = 9 THEN -amount ELSE amount END AS amount,
       nameOrig,
       CASE WHEN tx_id % 50 = 3 THEN CAST(-1 AS DOUBLE) ELSE oldbalanceOrg END AS oldbalanceOrg,
       CASE WHEN tx_id % 50 = 2 THEN CAST('nan' AS DOUBLE) ELSE newbalanceOrig END AS newbalanceOrig,
       nameDest, oldbalanceDest,
       CASE WHEN tx_id % 50 = 10 THEN NULL ELSE newbalanceDest END AS newbalanceDest,
       isFraud, isFlaggedFraud, prob
FROM tx JOIN range(2) c(i) ON i = 0 OR tx_id % 20 = 0""")

cte("step_counts", ["tx"], "SELECT step, count(*) AS n FROM tx GROUP BY step")

cte("cfg", ["tx", "step_counts"], f"""
SELECT a.p95, a.median_dest, a.max_step,
       CAST(1 AS DOUBLE) * (a.max_step / CAST(6 AS DOUBLE)) AS e1,
       CAST(2 AS DOUBLE) * (a.max_step / CAST(6 AS DOUBLE)) AS e2,
       CAST(3 AS DOUBLE) * (a.max_step / CAST(6 AS DOUBLE)) AS e3,
       CAST(4 AS DOUBLE) * (a.max_step / CAST(6 AS DOUBLE)) AS e4,
       CAST(5 AS DOUBLE) * (a.max_step / CAST(6 AS DOUBLE)) AS e5,
       a.max_step AS e6,
       b.median_steps
FROM (SELECT quantile_cont(amount, 0.95) AS p95,
             quantile_cont(oldbalanceDest, 0.5) AS median_dest,
             CAST(max(step) AS DOUBLE) AS max_step FROM tx) a,
     (SELECT quantile_cont(CAST(n AS DOUBLE), 0.5) AS median_steps FROM step_counts) b""")

cte("feat0", ["tx", "cfg", "step_counts"], f"""
SELECT t.*,
       CASE upper(t.type) WHEN 'CASH_IN' THEN 0 WHEN 'CASH_OUT' THEN 1 WHEN 'DEBIT' THEN 2
            WHEN 'PAYMENT' THEN 3 WHEN 'TRANSFER' THEN 4 ELSE -1 END AS type_encoded,
       CASE upper(t.type) WHEN 'CASH_OUT' THEN 3 WHEN 'TRANSFER' THEN 3 WHEN 'DEBIT' THEN 2
            WHEN 'CASH_IN' THEN 1 WHEN 'PAYMENT' THEN 1 ELSE 0 END AS type_risk_score,
       CAST(t.oldbalanceOrg = 0 AS INTEGER) AS is_oldbalanceOrg_zero,
       CAST(t.newbalanceOrig = 0 AS INTEGER) AS is_newbalanceOrig_zero,
       CAST(t.oldbalanceDest = 0 AS INTEGER) AS is_oldbalanceDest_zero,
       CAST(t.newbalanceDest = 0 AS INTEGER) AS is_newbalanceDest_zero,
       ln({D1} + t.amount) AS log_amount,
       t.newbalanceOrig - t.oldbalanceOrg AS balance_change_orig,
       t.oldbalanceOrg - t.amount AS expected_balance_change_orig,
       t.newbalanceOrig - (t.oldbalanceOrg - t.amount) AS balance_error_orig,
       t.newbalanceDest - t.oldbalanceDest AS balance_change_dest,
       t.oldbalanceDest + t.amount AS expected_balance_change_dest,
       t.newbalanceDest - (t.oldbalanceDest + t.amount) AS balance_error_dest,
       CASE WHEN t.oldbalanceOrg > 0 THEN t.amount / t.oldbalanceOrg ELSE {D0} END
            AS amount_to_oldbalance_orig_ratio,
       CASE WHEN t.oldbalanceDest > 0 THEN t.amount / t.oldbalanceDest ELSE {D0} END
            AS amount_to_oldbalance_dest_ratio,
       CAST(t.oldbalanceOrg > 0 AND t.newbalanceOrig = 0 AS INTEGER) AS sender_account_emptied,
       CAST(t.oldbalanceDest = 0 AND t.newbalanceDest > 0 AS INTEGER) AS dest_received_large_amount,
       CAST(t.amount > cfg.p95 AS INTEGER) AS is_large_transaction,
       CASE WHEN t.step >= 0 AND t.step <= cfg.e1 THEN 0
            WHEN t.step > cfg.e1 AND t.step <= cfg.e2 THEN 1
            WHEN t.step > cfg.e2 AND t.step <= cfg.e3 THEN 2
            WHEN t.step > cfg.e3 AND t.step <= cfg.e4 THEN 3
            WHEN t.step > cfg.e4 AND t.step <= cfg.e5 THEN 4
            WHEN t.step > cfg.e5 AND t.step <= cfg.e6 THEN 5 END AS step_bucket,
       coalesce(sc.n, 0) AS transactions_in_step,
       CAST(coalesce(sc.n, 0) > cfg.median_steps AS INTEGER) AS is_high_velocity_step,
       CAST(t.oldbalanceDest > cfg.median_dest AS INTEGER) AS is_dest_high_balance
FROM tx t CROSS JOIN cfg LEFT JOIN step_counts sc ON sc.step = t.step""")

cte("feat", ["feat0"], """
SELECT *,
       sender_account_emptied + is_large_transaction + dest_received_large_amount
       + CAST(abs(balance_error_orig) > 0 AS INTEGER) + CAST(abs(balance_error_dest) > 0 AS INTEGER)
       + CAST(amount_to_oldbalance_orig_ratio > 1 AS INTEGER) AS suspicious_signal_count
FROM feat0""")

LEVEL_OF_SCORE = ("CASE WHEN {s} >= 85 THEN 'CRITICAL' WHEN {s} >= 70 THEN 'HIGH' "
                  "WHEN {s} >= 40 THEN 'MEDIUM' ELSE 'LOW' END")
RANK_OF_LEVEL = ("CASE upper({l}) WHEN 'LOW' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'HIGH' THEN 2 "
                 "WHEN 'CRITICAL' THEN 3 END")
LEVEL_OF_RANK = ("CASE {r} WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'HIGH' "
                 "WHEN 3 THEN 'CRITICAL' END")
MIN_SCORE_OF_LEVEL = ("CASE {l} WHEN 'LOW' THEN 0 WHEN 'MEDIUM' THEN 40 WHEN 'HIGH' THEN 70 "
                      "WHEN 'CRITICAL' THEN 85 END")
ACTION_OF_LEVEL = ("CASE upper({l}) WHEN 'CRITICAL' THEN 'HOLD transaction + immediate manual review' "
                   "WHEN 'HIGH' THEN 'Manual review required' "
                   "WHEN 'MEDIUM' THEN 'Allow but monitor / step-up verification' ELSE 'Allow' END")
RISK_SCORE = (f"CAST(round_even(least(greatest(CAST({{p}} AS DOUBLE), {D0}), {D1}) * {D100}, 0) "
              f"AS INTEGER)")

cte("scored0", ["feat"], f"""
SELECT *, prob AS ml_probability, {RISK_SCORE.format(p='prob')} AS ml_risk_score
FROM feat""")

# The policy rules (written out again, independent of the engine).
R1 = "(amount_to_oldbalance_orig_ratio > 1 AND sender_account_emptied = 1)"
R2 = "(suspicious_signal_count >= 3)"
R3 = "(suspicious_signal_count >= 5)"
R4 = "(is_large_transaction = 1 AND dest_received_large_amount = 1)"

cte("scored1", ["scored0"], f"""
SELECT *,
       {LEVEL_OF_SCORE.format(s='ml_risk_score')} AS ml_risk_level,
       greatest(0, CASE WHEN {R1} THEN 2 ELSE 0 END, CASE WHEN {R2} THEN 1 ELSE 0 END,
                CASE WHEN {R3} THEN 3 ELSE 0 END, CASE WHEN {R4} THEN 2 ELSE 0 END) AS policy_rank,
       list_filter([
         CASE WHEN {R1} THEN 'Policy: Amount > sender balance + sender account emptied' END,
         CASE WHEN {R2} THEN 'Policy: Multiple suspicious signals detected (>=3)' END,
         CASE WHEN {R3} THEN 'Policy: Very high suspicious signal count (>=5)' END,
         CASE WHEN {R4} THEN 'Policy: Large transaction + destination started from zero balance' END
       ], lambda x: x IS NOT NULL) AS policy_reasons
FROM scored0""")

cte("scored2", ["scored1"], f"""
SELECT *, {LEVEL_OF_RANK.format(r='greatest(' + RANK_OF_LEVEL.format(l='ml_risk_level') + ', policy_rank)')}
          AS final_risk_level
FROM scored1""")

cte("scored", ["scored2"], f"""
SELECT *,
       {ACTION_OF_LEVEL.format(l='ml_risk_level')} AS ml_action,
       greatest(ml_risk_score, {MIN_SCORE_OF_LEVEL.format(l='final_risk_level')}) AS final_risk_score,
       {ACTION_OF_LEVEL.format(l='final_risk_level')} AS final_action,
       CAST(final_risk_level <> ml_risk_level AS INTEGER) AS policy_override_applied
FROM scored2""")

cte("logs", ["scored"], f"""
SELECT tx_id AS id, created_at,
       step, type, amount, oldbalanceOrg, newbalanceOrig, oldbalanceDest, newbalanceDest,
       ml_probability, ml_risk_level, ml_risk_score, final_risk_level, final_risk_score,
       policy_override_applied, policy_reasons, suspicious_signal_count,
       CASE WHEN {RANK_OF_LEVEL.format(l='final_risk_level')} >= 1 THEN
            'ALT-' || strftime(created_at, '%Y%m%d%H%M%S') || '-' || CAST(tx_id AS VARCHAR) END AS alert_id,
       CASE WHEN {RANK_OF_LEVEL.format(l='final_risk_level')} >= 1 THEN final_action END AS alert_action
FROM scored""")

# simulator-shaped events
cte("sim_events", [], """
SELECT event_id AS id, ts AS created_at, value * CAST(200 AS DOUBLE) AS amount,
       CASE event_type WHEN 'error' THEN 'Crypto Exchange' WHEN 'purchase' THEN 'E-Commerce'
            WHEN 'click' THEN 'Wire Transfer' WHEN 'view' THEN 'POS Retail'
            WHEN 'signup' THEN 'Gambling' END AS merchant_type,
       (['India', 'USA', 'Nigeria', 'Russia', 'UK', 'UAE', 'Brazil', 'Germany', 'China',
         'Anonymous VPN'])[CAST(user_id % 10 AS INTEGER) + 1] AS country,
       CAST(hour(ts) AS INTEGER) AS hour,
       CAST(event_id % 6 AS INTEGER) AS suspicious_signals,
       event_id % 7 = 0 AS is_new_device,
       event_id % 5 = 0 AS velocity_flag
FROM events""")

# The simulator's weights, thresholds and reason texts (written out again,
# independent of the engine).
cte("sim_scored", ["sim_events"], """
SELECT * FROM (SELECT *,
        CASE WHEN final_risk_score >= 85 THEN 'CRITICAL' WHEN final_risk_score >= 60 THEN 'HIGH'
             WHEN final_risk_score >= 35 THEN 'MEDIUM' ELSE 'LOW' END AS final_risk_level
      FROM (SELECT *,
              CASE WHEN base >= 85 THEN 'CRITICAL' WHEN base >= 60 THEN 'HIGH'
                   WHEN base >= 35 THEN 'MEDIUM' ELSE 'LOW' END AS ml_risk_level,
              CASE WHEN len(policy_reasons) > 0 THEN least(100, base + len(policy_reasons) * 5)
                   ELSE base END AS final_risk_score,
              CAST(len(policy_reasons) > 0 AS INTEGER) AS policy_override_applied
            FROM (SELECT *, CAST(trunc(ml_probability * CAST(100 AS DOUBLE)) AS INTEGER) AS base
                  FROM (SELECT *,
                    round(least(greatest(
                      CASE merchant_type WHEN 'E-Commerce' THEN 0.15 WHEN 'Crypto Exchange' THEN 0.72
                           WHEN 'ATM Withdrawal' THEN 0.45 WHEN 'POS Retail' THEN 0.08
                           WHEN 'Wire Transfer' THEN 0.55 WHEN 'Gambling' THEN 0.68
                           WHEN 'Utility Bill' THEN 0.04 WHEN 'Travel Agency' THEN 0.22
                           ELSE 0.20 END::DOUBLE * 0.25::DOUBLE
                    + CASE country WHEN 'India' THEN 0.10 WHEN 'USA' THEN 0.12 WHEN 'Nigeria' THEN 0.78
                           WHEN 'Russia' THEN 0.70 WHEN 'UK' THEN 0.14 WHEN 'UAE' THEN 0.35
                           WHEN 'Brazil' THEN 0.42 WHEN 'Germany' THEN 0.09 WHEN 'China' THEN 0.38
                           WHEN 'Anonymous VPN' THEN 0.90 ELSE 0.30 END::DOUBLE * 0.20::DOUBLE
                    + CASE WHEN hour BETWEEN 0 AND 3 THEN 0.70 WHEN hour BETWEEN 4 AND 7 THEN 0.20
                           WHEN hour BETWEEN 8 AND 17 THEN 0.05 WHEN hour BETWEEN 18 AND 20 THEN 0.15
                           WHEN hour BETWEEN 21 AND 23 THEN 0.45 ELSE 0.10 END::DOUBLE * 0.15::DOUBLE
                    + least(amount / 100000::DOUBLE, 1::DOUBLE) * 0.20::DOUBLE
                    + least(suspicious_signals::DOUBLE / 5::DOUBLE, 1::DOUBLE) * 0.12::DOUBLE
                    + CASE WHEN is_new_device THEN 0.05::DOUBLE ELSE 0::DOUBLE END
                    + CASE WHEN velocity_flag THEN 0.03::DOUBLE ELSE 0::DOUBLE END,
                    0::DOUBLE), 1::DOUBLE), 4) AS ml_probability,
                    list_filter([
                      CASE WHEN suspicious_signals >= 3 THEN
                           'Policy: Multiple suspicious signals detected (>=' || CAST(suspicious_signals AS VARCHAR) || ')' END,
                      CASE WHEN amount > 50000::DOUBLE THEN 'Policy: Amount > sender balance + sender account emptied' END,
                      CASE WHEN velocity_flag THEN 'Policy: High velocity flag triggered' END,
                      CASE WHEN country IN ('Nigeria', 'Russia', 'Anonymous VPN') THEN 'Policy: High-risk country — ' || country END,
                      CASE WHEN hour BETWEEN 0 AND 3 THEN 'Policy: Transaction in high-risk night window (00-04)' END
                    ], lambda x: x IS NOT NULL) AS policy_reasons
                  FROM sim_events) a) b) c) d""")
