"""Log, monitoring, top-k and union queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from txrisk.functions.numeric import py_round
from txrisk.functions.scoring import risk_level, risk_score
from txrisk.operators import monitor as M
from txrisk.operators import rollup as RU
from txrisk.operators.scoring import score_heuristic
from txrisk.plans import context as C
from txrisk.plans.oracle_base import LEVEL_OF_SCORE, RISK_SCORE, with_
from txrisk.plans.registry import ORACLE, query
from txrisk.session import scratch_path
from txrisk.sources import fixtures
from txrisk.sources import io as IO
from txrisk.schema import MODEL_COLUMNS

EXPLAIN_LOG_ID = 367
TOP_N = 300


def _sim(spark, sf):
    """Simulator-scored events shaped like log rows."""
    h = score_heuristic(fixtures.sim_events(spark, sf))
    return h.select(F.format_string("SIM-%04d", F.col("id")).alias("id"), "created_at",
                    "ml_probability", "ml_risk_level", "final_risk_level", "final_risk_score",
                    "policy_override_applied", "policy_reasons")


def _stored(spark, sf):
    return C.log_table(spark, sf).select(
        F.col("id").cast("string").alias("id"), "created_at", "ml_probability", "ml_risk_level",
        "ml_risk_score", "final_risk_level", "final_risk_score", "policy_override_applied",
        "policy_reasons", "suspicious_signal_count")


def _union(spark, sf):
    return M.union_logs(_stored(spark, sf), _sim(spark, sf))


_UNION_CTE = """
, u AS (
  SELECT printf('SIM-%04d', id) AS id, created_at, ml_probability, ml_risk_level,
         CAST(NULL AS INTEGER) AS ml_risk_score, final_risk_level, final_risk_score,
         policy_override_applied, policy_reasons, CAST(NULL AS INTEGER) AS suspicious_signal_count,
         TRUE AS _is_simulated
  FROM sim_scored
  UNION ALL
  SELECT CAST(id AS VARCHAR), created_at, ml_probability, ml_risk_level, ml_risk_score,
         final_risk_level, final_risk_score, policy_override_applied, policy_reasons,
         suspicious_signal_count, FALSE FROM logs)
"""


# --------------------------------------------------------------------------- log IO

@query("log_decode", with_("logs") + """
SELECT id, created_at, type AS tx_type, amount AS tx_amount, ml_probability, final_risk_level,
       len(policy_reasons) AS n_reasons, alert_id,
       CASE WHEN alert_id IS NOT NULL THEN len(policy_reasons) END AS n_alert_reasons
FROM logs""")
def log_decode(spark, sf):
    """Log rows through the JSON text layout and back (NULL-safe decode)."""
    d = IO.decode_log(IO.encode_log(C.log_table(spark, sf)))
    d = d.withColumn("n_alert_reasons", F.when(F.col("alert").isNotNull(), F.size("alert.reasons")))
    return d.select("id", "created_at", F.col("transaction.type").alias("tx_type"),
                    F.col("transaction.amount").alias("tx_amount"), "ml_probability",
                    "final_risk_level", F.size("policy_reasons").alias("n_reasons"),
                    F.col("alert.alert_id").alias("alert_id"), "n_alert_reasons")


_TX_FIELDS = ["step", "type", "amount", "oldbalanceOrg", "newbalanceOrig", "oldbalanceDest",
              "newbalanceDest"]


@query("log_flatten", with_("logs") + "SELECT id, " + ", ".join(
    f'{c} AS "transaction.{c}"' for c in _TX_FIELDS) + ", final_risk_level FROM logs")
def log_flatten(spark, sf):
    """Nested log records flattened to dotted column names."""
    flat = IO.flatten(C.log_table(spark, sf).select("id", "transaction", "final_risk_level"),
                      ["transaction"])
    return flat


@query("log_append", with_("logs") + """
SELECT id, CAST(date_trunc('month', created_at) AS DATE) AS created_date, w.writer, w.batch_id,
       final_risk_level
FROM logs JOIN (VALUES ('a', 0, 2, 0), ('a', 1, 2, 1), ('b', 0, 3, 0)) w(writer, batch_id, m, r)
  ON id % w.m = w.r""")
def log_append(spark, sf):
    """Bulk appends of two writers, one batch of them replayed, to the partitioned
    log table (monthly partitions: the fixture spreads few rows over thousands of
    days). Writer b's batch 0 replaces nothing of writer a's."""
    path = scratch_path(spark, "prediction_logs")
    logs = C.logs(spark, sf)
    half = [logs.where(F.col("id") % 2 == i) for i in (0, 1)]
    IO.append_logs(half[0], path, writer="a", batch_id=0, grain="month")
    IO.append_logs(half[1], path, writer="a", batch_id=1, grain="month")
    IO.append_logs(logs.where(F.col("id") % 3 == 0), path, writer="b", batch_id=0, grain="month")
    IO.append_logs(half[0], path, writer="a", batch_id=0, grain="month")
    return IO.read_logs(spark, path).select("id", "created_date", "writer",
                                            F.col("batch_id").cast("int").alias("batch_id"),
                                            "final_risk_level")


@query("log_table_declared", with_("logs") + """
SELECT id, CAST(date_trunc('month', created_at) AS DATE) AS created_date, 'a' AS writer, final_risk_score
FROM logs""")
def log_table_declared(spark, sf):
    """The log as a declared table whose partitions are registered with the append."""
    path = scratch_path(spark, "declared_logs")
    name = f"prediction_logs_{path.rsplit('-', 1)[1]}"
    IO.create_log_table(spark, name, path)
    IO.append_logs(C.log_table(spark, sf), path, writer="a", batch_id=0, grain="month", table=name)
    return spark.table(name).select("id", "created_date", "writer", "final_risk_score")


@query("report_json")
def report_json(spark, sf):
    """Final-metrics record written as one JSON document and read back."""
    from txrisk.plans.q_eval import final_metrics
    return IO.write_report(final_metrics(spark, sf), scratch_path(spark, "report"))


# --------------------------------------------------------------------------- monitoring

@query("stats", with_("logs") + """
SELECT count(*) AS total_scored,
       coalesce(round(avg(policy_override_applied) * CAST(100 AS DOUBLE), 2), 0) AS override_rate_pct,
       coalesce(round(avg(final_risk_score), 2), 0) AS avg_risk_score
FROM logs""")
def stats(spark, sf):
    return M.stats(C.log_table(spark, sf))


@query("risk_distribution", with_("logs") + """
SELECT final_risk_level, count(*) AS count FROM logs GROUP BY final_risk_level""")
def risk_distribution(spark, sf):
    return M.risk_distribution(C.log_table(spark, sf))


_PCT = "round(CASE WHEN {d} > 0 THEN CAST({n} AS DOUBLE) / CAST({d} AS DOUBLE) ELSE 0 END * CAST(100 AS DOUBLE), {p})"


@query("kpis", with_("logs") + f"""
SELECT total, n_critical, n_high,
       {_PCT.format(n='n_critical', d='total', p=2)} AS pct_critical,
       {_PCT.format(n='n_high', d='total', p=2)} AS pct_high,
       round(coalesce(ov, 0) * CAST(100 AS DOUBLE), 1) AS override_rate_pct,
       n_overrides, round(coalesce(av, 0), 2) AS avg_risk_score
FROM (SELECT count(*) AS total, count(*) FILTER (WHERE final_risk_level = 'CRITICAL') AS n_critical,
             count(*) FILTER (WHERE final_risk_level = 'HIGH') AS n_high,
             CAST(coalesce(sum(policy_override_applied), 0) AS BIGINT) AS n_overrides,
             avg(policy_override_applied) AS ov, avg(final_risk_score) AS av FROM logs) a""")
def kpis(spark, sf):
    return M.kpis(C.log_table(spark, sf))


@query("risk_distribution_filled", with_("logs") + f"""
SELECT l.level_rank, l.level, coalesce(c.n, 0) AS n,
       {_PCT.format(n='coalesce(c.n, 0)', d='t.total', p=1)} AS pct
FROM (SELECT CAST(i AS INTEGER) AS level_rank,
             ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][CAST(i AS INTEGER) + 1] AS level
      FROM range(4) r(i)) l
CROSS JOIN (SELECT count(*) AS total FROM logs) t
LEFT JOIN (SELECT final_risk_level AS level, count(*) AS n FROM logs GROUP BY 1) c ON c.level = l.level""")
def risk_distribution_filled(spark, sf):
    return M.distribution_filled(C.log_table(spark, sf))


@query("alert_trend", with_("logs", "sim_scored") + _UNION_CTE + """
SELECT CAST(created_at AS DATE) AS date, count(*) AS count FROM u
WHERE created_at IS NOT NULL AND final_risk_level IN ('HIGH', 'CRITICAL')
GROUP BY 1 ORDER BY 1 DESC LIMIT 14""")
def alert_trend(spark, sf):
    """HIGH/CRITICAL per day over stored + simulated rows, last 14 observed days,
    ascending."""
    return M.alert_trend(_union(spark, sf))


@query("alert_trend_simulated", with_("logs", "sim_scored") + _UNION_CTE + """
SELECT CAST(created_at AS DATE) AS date, count(*) AS count FROM u
WHERE created_at IS NOT NULL AND final_risk_level IN ('HIGH', 'CRITICAL') AND _is_simulated
GROUP BY 1 ORDER BY 1 DESC LIMIT 14""")
def alert_trend_simulated(spark, sf):
    return M.alert_trend(_union(spark, sf), simulated_only=True)


@query("top_reasons_overall", with_("logs") + """
, ov AS (SELECT * FROM logs WHERE policy_override_applied = 1)
, c AS (SELECT reason, count(*) AS count FROM (SELECT unnest(policy_reasons) AS reason FROM ov) x
        GROUP BY reason ORDER BY count DESC, reason ASC LIMIT 5)
SELECT reason, count,
       round(CAST(count AS DOUBLE) / CAST((SELECT count(*) FROM ov) AS DOUBLE) * CAST(100 AS DOUBLE), 6) AS pct_of_overrides,
       round(CAST(count AS DOUBLE) / CAST(max(count) OVER () AS DOUBLE) * CAST(100 AS DOUBLE), 6) AS bar_pct
FROM c""")
def top_reasons_overall(spark, sf):
    return M.top_override_reasons(C.log_table(spark, sf), 5)


@query("sim_stats", with_("sim_scored") + """
SELECT count(*) AS injected,
       count(*) FILTER (WHERE final_risk_level IN ('HIGH', 'CRITICAL')) AS high_or_critical,
       count(*) FILTER (WHERE final_risk_level = 'CRITICAL') AS critical FROM sim_scored""")
def sim_stats(spark, sf):
    return M.sim_stats(score_heuristic(fixtures.sim_events(spark, sf)))


@query("union_logs", with_("logs", "sim_scored") + _UNION_CTE + """
SELECT id, created_at, ml_probability, ml_risk_level, ml_risk_score, final_risk_level,
       final_risk_score, policy_override_applied, array_to_string(policy_reasons, '|') AS policy_reasons,
       suspicious_signal_count, _is_simulated FROM u""")
def union_logs(spark, sf):
    """Simulated + stored rows, stored columns, missing -> null, flag."""
    return _union(spark, sf).withColumn("policy_reasons", F.concat_ws("|", "policy_reasons"))


# --------------------------------------------------------------------------- from partials

def _replayed(spark, sf):
    """Partials of a log in two batches, the first of them appended twice."""
    return RU.read_partials(spark, C.replayed_log(spark, sf))


@query("stats_partials", ORACLE["stats"])
def stats_partials(spark, sf):
    """``stats`` from partial aggregates, after appends and a replay; reads no log file."""
    return RU.stats(_replayed(spark, sf))


@query("risk_distribution_partials", ORACLE["risk_distribution"])
def risk_distribution_partials(spark, sf):
    return RU.risk_distribution(_replayed(spark, sf))


@query("kpis_partials", ORACLE["kpis"])
def kpis_partials(spark, sf):
    return RU.kpis(_replayed(spark, sf))


@query("risk_distribution_filled_partials", ORACLE["risk_distribution_filled"])
def risk_distribution_filled_partials(spark, sf):
    return RU.distribution_filled(_replayed(spark, sf))


@query("alert_trend_partials", with_("logs") + """
SELECT CAST(created_at AS DATE) AS date, count(*) AS count FROM logs
WHERE created_at IS NOT NULL AND final_risk_level IN ('HIGH', 'CRITICAL')
GROUP BY 1 ORDER BY 1 DESC LIMIT 14""")
def alert_trend_partials(spark, sf):
    """HIGH/CRITICAL per day over stored rows, last 14 observed days, from partials."""
    return RU.alert_trend(_replayed(spark, sf))


@query("top_reasons_partials", ORACLE["top_reasons_overall"])
def top_reasons_partials(spark, sf):
    return RU.top_override_reasons(_replayed(spark, sf), 5)


# --------------------------------------------------------------------------- top-k / lookups

@query("recent_logs", with_("logs") + """
SELECT l.id, l.created_at,
       l.step AS tx_step, l.type AS tx_type, l.amount AS tx_amount, l.oldbalanceOrg AS tx_oldbalanceOrg,
       l.newbalanceOrig AS tx_newbalanceOrig, l.oldbalanceDest AS tx_oldbalanceDest,
       l.newbalanceDest AS tx_newbalanceDest,
       l.ml_probability, l.ml_risk_level, l.ml_risk_score, l.final_risk_level, l.final_risk_score,
       l.policy_override_applied = 1 AS policy_override_applied,
       CAST(to_json(l.policy_reasons) AS VARCHAR) AS policy_reasons, l.suspicious_signal_count,
       l.alert_id, CASE WHEN l.alert_id IS NOT NULL
         THEN CAST(to_json([{'reason': x} for x in l.policy_reasons]) AS VARCHAR) END AS alert_reasons,
       CASE WHEN l.alert_id IS NOT NULL THEN 'PENDING_REVIEW' END AS alert_status
FROM logs l ORDER BY l.id DESC LIMIT 50""")
def recent_logs(spark, sf):
    """The latest 50 log records, all twelve fields decoded (the nested
    transaction and alert are shown flat)."""
    return _flat_records(M.recent_records(C.log_table(spark, sf), 50))


@query("recent_logs_zones", ORACLE["recent_logs"])
def recent_logs_zones(spark, sf):
    """``recent_logs`` with the zone rows read first: an id bound and the few partitions
    that reach it."""
    return _flat_records(RU.recent_records(spark, C.replayed_log(spark, sf), 50))


def _flat_records(r):
    return r.select("id", "created_at", *[F.col(f"transaction.{c}").alias(f"tx_{c}") for c in _TX_FIELDS],
                    "ml_probability", "ml_risk_level", "ml_risk_score", "final_risk_level",
                    "final_risk_score", "policy_override_applied",
                    F.to_json("policy_reasons").alias("policy_reasons"), "suspicious_signal_count",
                    F.col("alert.alert_id").alias("alert_id"),
                    F.to_json("alert.reasons").alias("alert_reasons"),
                    F.col("alert.status").alias("alert_status"))


@query("recent_table", with_("logs") + """
SELECT id, strftime(created_at, '%Y-%m-%d %H:%M') AS created_at, round(ml_probability, 4) AS ml_probability,
       ml_risk_level, final_risk_level, final_risk_score, policy_override_applied
FROM logs ORDER BY id DESC LIMIT 40""")
def recent_table(spark, sf):
    r = M.recent(C.log_table(spark, sf), 40)
    return r.select("id", F.date_format("created_at", "yyyy-MM-dd HH:mm").alias("created_at"),
                    py_round(F.col("ml_probability"), 4).alias("ml_probability"), "ml_risk_level",
                    "final_risk_level", "final_risk_score", "policy_override_applied")


_Q_COLS = ["id", "created_at", "final_risk_level", "final_risk_score", "ml_probability",
           "policy_override_applied", "suspicious_signal_count"]


@query("alert_queue", with_("logs") + f"""
SELECT {', '.join(_Q_COLS)} FROM logs
WHERE final_risk_level IN ('HIGH', 'CRITICAL') AND final_risk_score >= 70
ORDER BY id DESC LIMIT 200""")
def alert_queue(spark, sf):
    return M.alert_queue(C.log_table(spark, sf)).select(*_Q_COLS)


@query("log_explain", with_("logs") + f"""
SELECT id AS log_id, step, type, amount, ml_probability, ml_risk_level, ml_risk_score,
       final_risk_level, final_risk_score, policy_override_applied = 1 AS override_applied,
       array_to_string(policy_reasons, '|') AS override_reasons,
       '{M.EXPLANATION}' AS explanation
FROM logs WHERE id = {EXPLAIN_LOG_ID}""")
def log_explain(spark, sf):
    """Point lookup of one log entry with its nested explanation."""
    e = M.explain_log(C.log_table(spark, sf), EXPLAIN_LOG_ID)
    return e.select("log_id", "transaction.step", "transaction.type", "transaction.amount",
                    F.col("ml.probability").alias("ml_probability"),
                    F.col("ml.level").alias("ml_risk_level"), F.col("ml.score").alias("ml_risk_score"),
                    F.col("final.level").alias("final_risk_level"),
                    F.col("final.score").alias("final_risk_score"), "override_applied",
                    F.concat_ws("|", "override_reasons").alias("override_reasons"), "explanation")


_TOP_FEATS = ", ".join(c if c != "log_amount" else "round(log_amount, 9) AS log_amount"
                       for c in MODEL_COLUMNS)


@query("top_risky", with_("feat") + f"""
SELECT tx_id, {_TOP_FEATS}, prob AS fraud_probability, {RISK_SCORE.format(p='prob')} AS risk_score,
       {LEVEL_OF_SCORE.format(s=RISK_SCORE.format(p='prob'))} AS risk_level, isFraud AS actual_isFraud
FROM feat ORDER BY prob DESC, tx_id ASC LIMIT {TOP_N}""")
def top_risky(spark, sf):
    """Top 300 by probability (ties by id) with score, level and the label."""
    f = C.features(spark, sf)
    s = risk_score(F.col("prob"))
    top = f.orderBy(F.desc("prob"), F.asc("tx_id")).limit(TOP_N)
    return top.select("tx_id", *[py_round(F.col(c), 9).alias(c) if c == "log_amount" else c
                                 for c in MODEL_COLUMNS],
                      F.col("prob").alias("fraud_probability"), s.alias("risk_score"),
                      risk_level(s).alias("risk_level"), F.col("isFraud").alias("actual_isFraud"))


@query("top_fraud_probs", with_("tx") + """
SELECT row_number() OVER (ORDER BY prob DESC, tx_id) AS rank, prob
FROM (SELECT tx_id, prob FROM tx WHERE isFraud = 1 ORDER BY prob DESC, tx_id LIMIT 10) t""")
def top_fraud_probs(spark, sf):
    from pyspark.sql import Window
    t = (C.tx(spark, sf).where(F.col("isFraud") == 1).select("tx_id", "prob")
         .orderBy(F.desc("prob"), "tx_id").limit(10))
    return t.select(F.row_number().over(Window.orderBy(F.desc("prob"), "tx_id")).alias("rank"), "prob")


@query("argmax_case", with_("tx") + f"""
SELECT tx_id, prob, {RISK_SCORE.format(p='prob')} AS risk_score,
       {LEVEL_OF_SCORE.format(s=RISK_SCORE.format(p='prob'))} AS risk_level, isFraud
FROM tx ORDER BY isFraud DESC, prob DESC, tx_id ASC LIMIT 1""")
def argmax_case(spark, sf):
    """Highest-probability actual fraud, else the highest overall."""
    t = C.tx(spark, sf).orderBy(F.desc("isFraud"), F.desc("prob"), F.asc("tx_id")).limit(1)
    s = risk_score(F.col("prob"))
    return t.select("tx_id", "prob", s.alias("risk_score"), risk_level(s).alias("risk_level"), "isFraud")
