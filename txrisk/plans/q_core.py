"""Sources, projections, validation, features, config and scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from txrisk.functions.features import type_decode, type_encoded
from txrisk.functions.numeric import py_round
from txrisk.functions import scoring as S
from txrisk.functions.policy import policy_min_rank, policy_reasons
from txrisk.operators import config as CF
from txrisk.operators import quality as QL
from txrisk.operators.config_store import ConfigStore
from txrisk.operators.enrich import align_to_model_columns, velocity_join
from txrisk.operators.quantiles import quantile_row
from txrisk.operators.scoring import score_heuristic
from txrisk.plans import context as C
from txrisk.plans.oracle_base import (ACTION_OF_LEVEL, LEVEL_OF_RANK, LEVEL_OF_SCORE, RISK_SCORE,
                                      with_)
from txrisk.plans.registry import query
from txrisk.schema import DEBUG_FEATURES, MODEL_COLUMNS, RAW_NUMERIC, TRANSACTION_SCHEMA
from txrisk.session import scratch_path
from txrisk.sources import fixtures
from txrisk.sources import io as IO

ORACLE_FEATURE_CONFIG = with_("cfg", "step_counts") + """
SELECT p95 AS large_threshold_p95, median_dest AS median_oldbalanceDest,
       median_steps AS median_transactions_in_step, max_step,
       (SELECT count(*) FROM step_counts) AS n_steps,
       (SELECT CAST(sum(n) AS BIGINT) FROM step_counts) AS n_rows
FROM cfg"""
TX_COLS = ["tx_id", "created_at", "step", "type", "amount", "nameOrig", "oldbalanceOrg",
           "newbalanceOrig", "nameDest", "oldbalanceDest", "newbalanceDest", "isFraud",
           "isFlaggedFraud", "prob"]


# --------------------------------------------------------------------------- entry

@query("level_summary", with_("scored") + """
SELECT final_risk_level, count(*) AS n,
       CAST(sum(policy_override_applied) AS BIGINT) AS n_overridden,
       round(avg(final_risk_score), 6) AS avg_final_score
FROM scored GROUP BY final_risk_level""")
def level_summary(spark, sf):
    """How many transactions at each final level, how many the policy raised,
    and the average final score."""
    return (C.scored(spark, sf).groupBy("final_risk_level")
            .agg(F.count("*").alias("n"),
                 F.sum("policy_override_applied").cast("long").alias("n_overridden"),
                 py_round(F.avg("final_risk_score"), 6).alias("avg_final_score")))


# --------------------------------------------------------------------------- sources

@query("scan_transactions", with_("tx") + f"SELECT {', '.join(TX_COLS)} FROM tx")
def scan_transactions(spark, sf):
    return C.tx(spark, sf).select(*TX_COLS)


@query("scan_pruned", with_("tx") + "SELECT step, CAST(amount AS FLOAT) AS amount, type FROM tx")
def scan_pruned(spark, sf):
    """Typed three-column read (int step, float32 amount)."""
    return C.tx(spark, sf).select(F.col("step").cast("int"), F.col("amount").cast("float"), "type")


# --------------------------------------------------------------------------- projections

_DROP = ["nameOrig", "nameDest"]


@query("project_drop", with_("tx") + "SELECT " + ", ".join(c for c in TX_COLS if c not in _DROP)
       + " FROM tx")
def project_drop(spark, sf):
    return C.tx(spark, sf).drop(*_DROP)


@query("debug_features", with_("feat") + """
SELECT tx_id, amount, oldbalanceOrg, newbalanceOrig, oldbalanceDest, newbalanceDest,
       round(log_amount, 9) AS log_amount, amount_to_oldbalance_orig_ratio,
       CAST(sender_account_emptied AS DOUBLE) AS sender_account_emptied,
       CAST(dest_received_large_amount AS DOUBLE) AS dest_received_large_amount,
       CAST(is_large_transaction AS DOUBLE) AS is_large_transaction,
       balance_error_orig, balance_error_dest,
       CAST(transactions_in_step AS DOUBLE) AS transactions_in_step,
       CAST(is_high_velocity_step AS DOUBLE) AS is_high_velocity_step,
       CAST(type_encoded AS DOUBLE) AS type_encoded, CAST(type_risk_score AS DOUBLE) AS type_risk_score,
       CAST(suspicious_signal_count AS DOUBLE) AS suspicious_signal_count FROM feat""")
def debug_features(spark, sf):
    d = QL.debug_projection(C.features(spark, sf), DEBUG_FEATURES, keep=["tx_id"])
    return d.withColumn("log_amount", py_round(F.col("log_amount"), 9))


_ALIGN_PRESENT = {"step", "amount", "oldbalanceOrg", "newbalanceOrig", "oldbalanceDest",
                  "newbalanceDest"}


@query("align_columns", with_("tx") + "SELECT tx_id, " + ", ".join(
    c if c in _ALIGN_PRESENT else f"0 AS {c}" for c in MODEL_COLUMNS) + " FROM tx")
def align_columns(spark, sf):
    """Raw rows aligned to the model's columns: missing -> 0, extras dropped."""
    return align_to_model_columns(C.tx(spark, sf), keep=["tx_id"])


_VALIDATE_SQL = with_("req") + """
SELECT tx_id, len(v) = 0 AS is_valid, array_to_string(v, '; ') AS violations
FROM (SELECT tx_id, list_filter([
  CASE WHEN step IS NULL THEN 'step missing' WHEN step < 0 THEN 'step < 0' END,
  CASE WHEN type IS NULL THEN 'type missing' END,
  CASE WHEN amount IS NULL THEN 'amount missing' WHEN isnan(amount) THEN 'amount NaN'
       WHEN amount < 0 THEN 'amount < 0' END,
  CASE WHEN oldbalanceOrg IS NULL THEN 'oldbalanceOrg missing' WHEN isnan(oldbalanceOrg) THEN 'oldbalanceOrg NaN'
       WHEN oldbalanceOrg < 0 THEN 'oldbalanceOrg < 0' END,
  CASE WHEN newbalanceOrig IS NULL THEN 'newbalanceOrig missing' WHEN isnan(newbalanceOrig) THEN 'newbalanceOrig NaN'
       WHEN newbalanceOrig < 0 THEN 'newbalanceOrig < 0' END,
  CASE WHEN oldbalanceDest IS NULL THEN 'oldbalanceDest missing' WHEN isnan(oldbalanceDest) THEN 'oldbalanceDest NaN'
       WHEN oldbalanceDest < 0 THEN 'oldbalanceDest < 0' END,
  CASE WHEN newbalanceDest IS NULL THEN 'newbalanceDest missing' WHEN isnan(newbalanceDest) THEN 'newbalanceDest NaN'
       WHEN newbalanceDest < 0 THEN 'newbalanceDest < 0' END,
  CASE WHEN step > (SELECT max(step) FROM tx) THEN 'step beyond last bin edge' END
], lambda x: x IS NOT NULL) AS v FROM req) q"""


@query("validate_tx", _VALIDATE_SQL)
def validate_tx(spark, sf):
    """Every request with its violations (quarantine = not is_valid)."""
    v = QL.with_violations(C.requests(spark, sf), float(C.config(spark, sf).step_bins[-1]))
    return v.select("tx_id", (F.size("violations") == 0).alias("is_valid"),
                    F.concat_ws("; ", "violations").alias("violations"))


@query("quarantine", _VALIDATE_SQL.replace(
    "SELECT tx_id, len(v) = 0 AS is_valid, array_to_string(v, '; ') AS violations",
    "SELECT violation, count(*) AS n, min(tx_id) AS first_tx FROM (SELECT tx_id, unnest(v) AS violation",
    1) + """) u GROUP BY violation""")
def quarantine(spark, sf):
    """Quarantined requests per violation."""
    _, bad = QL.split_valid(C.requests(spark, sf), float(C.config(spark, sf).step_bins[-1]))
    return (bad.select("tx_id", F.explode("violations").alias("violation")).groupBy("violation")
            .agg(F.count("*").alias("n"), F.min("tx_id").alias("first_tx")))


@query("csv_roundtrip", with_("tx") + "SELECT " + ", ".join(f.name for f in TRANSACTION_SCHEMA.fields)
       + " FROM tx")
def csv_roundtrip(spark, sf):
    """All transactions through the CSV sink and back with the declared schema."""
    path = scratch_path(spark, "csv")
    IO.write_table(C.tx(spark, sf).select(*[f.name for f in TRANSACTION_SCHEMA.fields]), path, fmt="csv")
    return IO.read_transactions_csv(spark, path)


@query("config_roundtrip", ORACLE_FEATURE_CONFIG)
def config_roundtrip(spark, sf):
    """The fitted configuration saved (JSON scalars, step table) and loaded."""
    path = scratch_path(spark, "config")
    C.config(spark, sf).save(path)
    return _config_row(CF.FeatureConfig.load(spark, path))


@query("csv_rejects", with_("tx") + """
, f AS (SELECT tx_id, tx_id % 97 = 0 AS bad_amount, tx_id % 101 = 0 AS bad_step, tx_id % 103 = 0 AS no_balance
        FROM tx)
SELECT violation, count(*) AS n, min(tx_id) AS first_tx FROM (
  SELECT tx_id, 'malformed record' AS violation FROM f WHERE bad_amount OR bad_step
  UNION ALL SELECT tx_id, 'amount missing' FROM f WHERE bad_amount
  UNION ALL SELECT tx_id, 'step missing' FROM f WHERE bad_step
  UNION ALL SELECT tx_id, 'oldbalanceOrg missing' FROM f WHERE no_balance
  UNION ALL SELECT tx_id, 'accepted' FROM f WHERE NOT (bad_amount OR bad_step OR no_balance)) u
GROUP BY violation""")
def csv_rejects(spark, sf):
    """A CSV file of all transactions, some with fields that do not parse, read and
    split: rows per fault, and the rows accepted."""
    tx = C.tx(spark, sf)
    raw = tx.select(*[F.col(f.name) for f in TRANSACTION_SCHEMA.fields]).withColumns({
        "amount": F.when(F.col("tx_id") % 97 == 0, "n/a").otherwise(F.col("amount").cast("string")),
        "step": F.when(F.col("tx_id") % 101 == 0, "x1").otherwise(F.col("step").cast("string")),
        "oldbalanceOrg": F.when(F.col("tx_id") % 103 != 0, F.col("oldbalanceOrg").cast("string"))})
    path = scratch_path(spark, "csv")
    IO.write_table(raw, path, fmt="csv")
    good, bad = QL.split_valid(IO.read_transactions_csv(spark, path, corrupt=QL.CORRUPT))
    rows = bad.select("tx_id", F.explode("violations").alias("violation")).unionByName(
        good.select("tx_id", F.lit("accepted").alias("violation")))
    return rows.groupBy("violation").agg(F.count("*").alias("n"), F.min("tx_id").alias("first_tx"))


@query("fill_missing_raw", with_("req") + """
SELECT tx_id, CASE WHEN upper(type) IN ('CASH_IN', 'CASH_OUT', 'DEBIT', 'PAYMENT', 'TRANSFER')
                   THEN upper(type) ELSE 'TRANSFER' END AS type,
       coalesce(amount, CAST(0 AS DOUBLE)) AS amount,
       coalesce(oldbalanceOrg, CAST(0 AS DOUBLE)) AS oldbalanceOrg,
       coalesce(newbalanceOrig, CAST(0 AS DOUBLE)) AS newbalanceOrig,
       coalesce(oldbalanceDest, CAST(0 AS DOUBLE)) AS oldbalanceDest,
       coalesce(newbalanceDest, CAST(0 AS DOUBLE)) AS newbalanceDest
FROM req""")
def fill_missing_raw(spark, sf):
    """Requests made complete: type decoded from its code, missing raw -> 0.0."""
    r = C.requests(spark, sf).withColumn("type_encoded", type_encoded())
    return QL.fill_missing(r.select("tx_id", type_decode().alias("type"), *RAW_NUMERIC),
                           RAW_NUMERIC, 0.0)


@query("fraud_subset", with_("tx") + f"SELECT {', '.join(TX_COLS)} FROM tx WHERE isFraud = 1")
def fraud_subset(spark, sf):
    return C.tx(spark, sf).where(F.col("isFraud") == 1).select(*TX_COLS)


# --------------------------------------------------------------------------- features

_FEATURE_SQL_COLS = ", ".join(
    "round(log_amount, 9) AS log_amount" if c == "log_amount" else c for c in MODEL_COLUMNS)


@query("features", with_("feat") + f"SELECT tx_id, {_FEATURE_SQL_COLS} FROM feat")
def features(spark, sf):
    """The 29 model columns in training order (log_amount at 9 places: log1p
    and ln(1+x) may differ in the last bit between engines)."""
    f = align_to_model_columns(C.features(spark, sf), keep=["tx_id"])
    return f.withColumn("log_amount", py_round(F.col("log_amount"), 9))


@query("velocity_join", with_("tx", "step_counts") + """
SELECT t.tx_id, t.step, coalesce(s.n, 0) AS transactions_in_step
FROM tx t LEFT JOIN step_counts s ON s.step = t.step""")
def velocity_join_q(spark, sf):
    t = C.tx(spark, sf)
    return velocity_join(t, CF.step_counts(t)).select("tx_id", "step", "transactions_in_step")


# --------------------------------------------------------------------------- config

@query("cfg_p95", with_("tx") + "SELECT quantile_cont(amount, 0.95) AS large_threshold_p95 FROM tx")
def cfg_p95(spark, sf):
    return quantile_row(C.tx(spark, sf), {"large_threshold_p95": ("amount", 0.95)})


@query("cfg_median_dest", with_("tx")
       + "SELECT quantile_cont(oldbalanceDest, 0.5) AS median_oldbalanceDest FROM tx")
def cfg_median_dest(spark, sf):
    return quantile_row(C.tx(spark, sf), {"median_oldbalanceDest": ("oldbalanceDest", 0.5)})


@query("cfg_step_counts", with_("step_counts") + "SELECT step, n FROM step_counts")
def cfg_step_counts(spark, sf):
    return CF.step_counts(C.tx(spark, sf))


@query("cfg_median_steps", with_("step_counts")
       + "SELECT quantile_cont(CAST(n AS DOUBLE), 0.5) AS median_transactions_in_step FROM step_counts")
def cfg_median_steps(spark, sf):
    return CF.median_rows_per_step(CF.step_counts(C.tx(spark, sf)))


@query("cfg_median_rows", with_("tx", "step_counts") + """
SELECT quantile_cont(CAST(s.n AS DOUBLE), 0.5) AS median_transactions_in_step_rows
FROM tx t JOIN step_counts s ON s.step = t.step""")
def cfg_median_rows(spark, sf):
    return CF.median_rows_weighted(CF.step_counts(C.tx(spark, sf)))


@query("cfg_step_bins", with_("tx") + """
SELECT CAST(i AS INTEGER) AS i,
       CASE WHEN i = 6 THEN m ELSE CAST(i AS DOUBLE) * (m / CAST(6 AS DOUBLE)) END AS edge
FROM range(7) r(i), (SELECT CAST(max(step) AS DOUBLE) AS m FROM tx) s""")
def cfg_step_bins(spark, sf):
    return CF.step_bins_df(C.tx(spark, sf))


@query("feature_config", ORACLE_FEATURE_CONFIG)
def feature_config(spark, sf):
    return _config_row(C.config(spark, sf))


@query("feature_config_incremental", ORACLE_FEATURE_CONFIG)
def feature_config_incremental(spark, sf):
    """The configuration from parts: three are put and fitted, a fourth comes and one is
    put again; the refit reads zones, step counts and the blocks at the wanted ranks."""
    tx, store = C.tx(spark, sf), ConfigStore(spark, scratch_path(spark, "config-parts"))
    for part in (0, 1, 2):
        store.put(tx.where(F.col("tx_id") % 4 == part), f"p{part}")
    store.fit()
    for part in (3, 1):
        store.put(tx.where(F.col("tx_id") % 4 == part), f"p{part}")
    return _config_row(store.fit())


def _config_row(cfg):
    agg = cfg.step_counts.agg(F.count("*").alias("n_steps"), F.sum("n").cast("long").alias("n_rows"))
    return agg.select(F.lit(float(cfg.large_threshold_p95)).alias("large_threshold_p95"),
                      F.lit(float(cfg.median_oldbalanceDest)).alias("median_oldbalanceDest"),
                      F.lit(float(cfg.median_transactions_in_step)).alias("median_transactions_in_step"),
                      F.lit(float(cfg.step_bins[-1])).alias("max_step"),
                      "n_steps", "n_rows")


# --------------------------------------------------------------------------- scoring

@query("risk_score", with_("tx") + f"SELECT tx_id, {RISK_SCORE.format(p='prob')} AS risk_score FROM tx")
def risk_score(spark, sf):
    return C.tx(spark, sf).select("tx_id", S.risk_score(F.col("prob")).alias("risk_score"))


@query("risk_score_trunc", with_("tx")
       + "SELECT tx_id, CAST(trunc(prob * CAST(100 AS DOUBLE)) AS INTEGER) AS risk_score FROM tx")
def risk_score_trunc(spark, sf):
    return C.tx(spark, sf).select("tx_id", S.risk_score_trunc(F.col("prob")).alias("risk_score"))


@query("risk_level", with_("tx") + f"""
SELECT tx_id, risk_level, {ACTION_OF_LEVEL.format(l='risk_level')} AS recommended_action
FROM (SELECT tx_id, {LEVEL_OF_SCORE.format(s=RISK_SCORE.format(p='prob'))} AS risk_level FROM tx) q""")
def risk_level(spark, sf):
    lvl = S.risk_level(S.risk_score(F.col("prob")))
    return (C.tx(spark, sf).select("tx_id", lvl.alias("risk_level"))
            .withColumn("recommended_action", S.recommended_action(F.col("risk_level"))))


@query("score_probability", with_("scored") + """
SELECT tx_id, ml_probability AS probability, ml_risk_score AS risk_score,
       ml_risk_level AS risk_level, ml_action AS recommended_action FROM scored""")
def score_probability(spark, sf):
    r = C.tx(spark, sf).select("tx_id", S.score_probability(F.col("prob")).alias("r"))
    return r.select("tx_id", "r.*")


@query("policy_rules", with_("scored") + f"""
SELECT tx_id, {LEVEL_OF_RANK.format(r='policy_rank')} AS policy_min_level,
       array_to_string(policy_reasons, '|') AS policy_reasons, len(policy_reasons) AS n_reasons
FROM scored""")
def policy_rules(spark, sf):
    from txrisk.functions.scoring import level_from_rank
    f = C.features(spark, sf)
    return f.select("tx_id", level_from_rank(policy_min_rank()).alias("policy_min_level"),
                    policy_reasons().alias("r")).select(
        "tx_id", "policy_min_level", F.concat_ws("|", "r").alias("policy_reasons"),
        F.size("r").alias("n_reasons"))


@query("policy_override", with_("scored") + """
SELECT tx_id, ml_risk_level, ml_risk_score, final_risk_level, final_risk_score, final_action,
       policy_override_applied FROM scored""")
def policy_override(spark, sf):
    return C.scored(spark, sf).select("tx_id", "ml_risk_level", "ml_risk_score", "final_risk_level",
                                      "final_risk_score", "final_action", "policy_override_applied")


@query("alerts", with_("scored") + f"""
SELECT 'ALT-' || strftime(created_at, '%Y%m%d%H%M%S') || '-' || CAST(tx_id AS VARCHAR) AS alert_id,
       strftime(created_at, '%Y-%m-%dT%H:%M:%S+00:00') AS created_at,
       CAST(tx_id AS VARCHAR) AS transaction_ref, final_risk_level AS risk_level,
       final_risk_score AS risk_score, ml_probability AS probability,
       final_action AS recommended_action,
       CAST(to_json([{{'reason': x}} for x in policy_reasons]) AS VARCHAR) AS reasons,
       'PENDING_REVIEW' AS status
FROM scored WHERE final_risk_level <> 'LOW'""")
def alerts(spark, sf):
    lg = C.log_table(spark, sf)
    return (lg.where(F.col("alert").isNotNull()).select("alert.*")
            .withColumn("reasons", F.to_json("reasons")))


_HEUR_SQL = with_("sim_scored") + """
SELECT id, ml_probability, ml_risk_level, final_risk_score, final_risk_level,
       policy_override_applied, array_to_string(policy_reasons, '|') AS policy_reasons
FROM sim_scored"""


@query("heuristic_score", _HEUR_SQL)
def heuristic_score(spark, sf):
    h = score_heuristic(fixtures.sim_events(spark, sf))
    return h.select("id", "ml_probability", "ml_risk_level", "final_risk_score", "final_risk_level",
                    "policy_override_applied",
                    F.concat_ws("|", "policy_reasons").alias("policy_reasons"))


@query("score_batch", with_("scored") + """
SELECT tx_id, ml_probability, ml_risk_score, ml_risk_level, final_risk_level, final_risk_score,
       final_action, policy_override_applied, suspicious_signal_count FROM scored""")
def score_batch(spark, sf):
    return C.scored(spark, sf).select("tx_id", "ml_probability", "ml_risk_score", "ml_risk_level",
                                      "final_risk_level", "final_risk_score", "final_action",
                                      "policy_override_applied", "suspicious_signal_count")


@query("audit_records", with_("logs") + """
SELECT id, created_at, step, type, amount, oldbalanceOrg, newbalanceOrig, oldbalanceDest,
       newbalanceDest, ml_probability, ml_risk_level, ml_risk_score, final_risk_level,
       final_risk_score, policy_override_applied, array_to_string(policy_reasons, '|') AS policy_reasons,
       suspicious_signal_count, alert_id
FROM logs""")
def audit_records(spark, sf):
    lg = C.logs(spark, sf)
    return lg.select("id", "created_at", "transaction.*", "ml_probability", "ml_risk_level",
                     "ml_risk_score", "final_risk_level", "final_risk_score",
                     "policy_override_applied", F.concat_ws("|", "policy_reasons").alias("policy_reasons"),
                     "suspicious_signal_count", F.col("alert.alert_id").alias("alert_id"))
