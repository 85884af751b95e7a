"""Profiling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from txrisk.functions.numeric import py_round
from txrisk.functions.scoring import risk_score_trunc
from txrisk.operators import profile as P
from txrisk.operators import quality as QL
from txrisk.plans import context as C
from txrisk.plans.oracle_base import with_
from txrisk.plans.q_core import TX_COLS
from txrisk.plans.registry import query

# The columns of each report.
DESCRIBE_COLS = ["step", "amount", "oldbalanceOrg", "newbalanceOrig", "oldbalanceDest",
                 "newbalanceDest", "isFraud", "isFlaggedFraud"]
BOX_COLS = ["amount", "oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest"]
DUP_COLS = [c for c in TX_COLS if c not in ("tx_id", "created_at", "prob")]
CORR_FEATURES = ["step", "amount", "oldbalanceOrg", "newbalanceOrig", "oldbalanceDest",
                 "newbalanceDest", "type_encoded", "log_amount", "balance_change_orig",
                 "balance_error_orig", "balance_change_dest", "balance_error_dest",
                 "amount_to_oldbalance_orig_ratio", "amount_to_oldbalance_dest_ratio",
                 "sender_account_emptied", "dest_received_large_amount", "is_large_transaction",
                 "step_bucket", "transactions_in_step", "is_high_velocity_step",
                 "is_dest_high_balance", "type_risk_score", "suspicious_signal_count"]
MATRIX_COLS = ["step", "amount", "oldbalanceOrg", "newbalanceOrig", "oldbalanceDest",
               "newbalanceDest", "isFraud", "isFlaggedFraud", "log_amount"]


def _union(parts):
    return "\nUNION ALL\n".join(parts)


@query("row_count", with_("tx") + f"SELECT count(*) AS n_rows, {len(TX_COLS)} AS n_columns FROM tx")
def row_count(spark, sf):
    return P.row_count(C.tx(spark, sf).select(*TX_COLS))


_KINDS = {"tx_id": "numeric", "created_at": "other", "step": "numeric", "type": "string",
          "amount": "numeric", "nameOrig": "string", "oldbalanceOrg": "numeric",
          "newbalanceOrig": "numeric", "nameDest": "string", "oldbalanceDest": "numeric",
          "newbalanceDest": "numeric", "isFraud": "numeric", "isFlaggedFraud": "numeric",
          "prob": "numeric"}


@query("profile_columns", with_("req") + _union(
    [f"SELECT CAST({i} AS INTEGER) AS position, '{c}' AS column_name, '{_KINDS[c]}' AS kind, "
     f"count({c}) AS non_null FROM req" for i, c in enumerate(TX_COLS)]))
def profile_columns(spark, sf):
    """Column kinds (numeric / string / other) and non-null values of the requests."""
    p = QL.columns_by_kind(C.requests(spark, sf).select(*TX_COLS))
    return p.select("position", F.col("column").alias("column_name"), "kind", "non_null")


@query("null_counts", with_("req") + _union(
    [f"SELECT '{c}' AS column_name, count(*) - count({c}) AS nulls FROM req" for c in TX_COLS]))
def null_counts(spark, sf):
    """Nulls per column of the requests."""
    r = C.requests(spark, sf).select(*TX_COLS)
    return QL.null_counts(r).withColumnRenamed("column", "column_name")


@query("duplicate_count", with_("req") + f"""
SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_rows
FROM (SELECT count(*) AS n FROM req GROUP BY {', '.join(DUP_COLS)}) g""")
def duplicate_count(spark, sf):
    """Requests that repeat another one."""
    return QL.duplicate_count(C.requests(spark, sf), DUP_COLS)


_HEAD_COLS = ["tx_id", "step", "type", "amount", "isFraud"]


@query("head_rows", with_("tx") + f"SELECT {', '.join(_HEAD_COLS)} FROM tx ORDER BY tx_id LIMIT 5")
def head_rows(spark, sf):
    """The first five rows by id (top-k, no global sort)."""
    return P.head(C.tx(spark, sf).select(*_HEAD_COLS), "tx_id", 5)


@query("tail_rows", with_("tx") + f"SELECT {', '.join(_HEAD_COLS)} FROM tx ORDER BY tx_id DESC LIMIT 5")
def tail_rows(spark, sf):
    """The last five rows by id."""
    return P.tail(C.tx(spark, sf).select(*_HEAD_COLS), "tx_id", 5)


def _describe_sql(src: str, group: str | None):
    parts = []
    for c in DESCRIBE_COLS:
        x = f"CAST({c} AS DOUBLE)"
        g = f"{group}, " if group else ""
        parts.append(
            f"SELECT {g}'{c}' AS column_name, count({x}) AS count, round(avg({x}), 6) AS mean, "
            f"round(stddev_samp({x}), 6) AS std, min({x}) AS min, "
            f"quantile_cont({x}, 0.25) AS p25, quantile_cont({x}, 0.5) AS p50, "
            f"quantile_cont({x}, 0.75) AS p75, max({x}) AS max FROM {src}"
            + (f" GROUP BY {group}" if group else ""))
    return _union(parts)


def _round_moments(df):
    return (df.withColumn("mean", py_round(F.col("mean"), 6))
            .withColumn("std", py_round(F.col("std"), 6)))


@query("describe_amount", with_("tx") + _describe_sql("tx", None))
def describe_amount(spark, sf):
    """describe(): count, mean, std, min, quartiles, max of the raw numerics."""
    return _round_moments(P.describe(C.tx(spark, sf), DESCRIBE_COLS))


@query("describe_by_class", with_("tx") + _describe_sql("tx", "isFraud"))
def describe_by_class(spark, sf):
    return _round_moments(P.describe(C.tx(spark, sf), DESCRIBE_COLS, group="isFraud"))


@query("type_counts", with_("tx") + "SELECT type, count(*) AS n FROM tx GROUP BY type")
def type_counts(spark, sf):
    return P.value_counts(C.tx(spark, sf), "type")


@query("class_pct", with_("tx") + """
SELECT isFraud, n, CAST(n AS DOUBLE) * CAST(100 AS DOUBLE) / CAST(sum(n) OVER () AS DOUBLE) AS pct
FROM (SELECT isFraud, count(*) AS n FROM tx GROUP BY isFraud) g""")
def class_pct(spark, sf):
    return P.value_shares(C.tx(spark, sf), "isFraud")


_CT_NAMES = ["n_not_fraud", "n_fraud"]


@query("crosstab_type_fraud", with_("tx") + """
SELECT type, count(*) FILTER (WHERE isFraud = 0) AS n_not_fraud,
       count(*) FILTER (WHERE isFraud = 1) AS n_fraud FROM tx GROUP BY type""")
def crosstab_type_fraud(spark, sf):
    return P.crosstab(C.tx(spark, sf), "type", "isFraud", [0, 1], _CT_NAMES)


@query("crosstab_flagged_fraud", with_("tx") + """
SELECT isFlaggedFraud, count(*) FILTER (WHERE isFraud = 0) AS n_not_fraud,
       count(*) FILTER (WHERE isFraud = 1) AS n_fraud FROM tx GROUP BY isFlaggedFraud""")
def crosstab_flagged_fraud(spark, sf):
    return P.crosstab(C.tx(spark, sf), "isFlaggedFraud", "isFraud", [0, 1], _CT_NAMES)


@query("crosstab_pct", with_("tx") + """
SELECT type,
       CAST(n_not_fraud AS DOUBLE) * CAST(100 AS DOUBLE) / CAST(n_not_fraud + n_fraud AS DOUBLE) AS pct_n_not_fraud,
       CAST(n_fraud AS DOUBLE) * CAST(100 AS DOUBLE) / CAST(n_not_fraud + n_fraud AS DOUBLE) AS pct_n_fraud
FROM (SELECT type, count(*) FILTER (WHERE isFraud = 0) AS n_not_fraud,
             count(*) FILTER (WHERE isFraud = 1) AS n_fraud FROM tx GROUP BY type) g""")
def crosstab_pct(spark, sf):
    ct = P.crosstab(C.tx(spark, sf), "type", "isFraud", [0, 1], _CT_NAMES)
    return P.crosstab_row_pct(ct, "type", _CT_NAMES)


@query("fraud_rate_by_type", with_("tx") + """
SELECT type, round(avg(isFraud) * CAST(100 AS DOUBLE), 9) AS fraud_rate_pct FROM tx GROUP BY type""")
def fraud_rate_by_type(spark, sf):
    r = P.rate_by(C.tx(spark, sf), "type")
    return r.withColumn("fraud_rate_pct", py_round(F.col("fraud_rate_pct"), 9))


@query("step_series", with_("tx") + """
SELECT step, count(*) AS n_tx, CAST(sum(isFraud) AS BIGINT) AS n_fraud FROM tx GROUP BY step""")
def step_series(spark, sf):
    return P.per_key_series(C.tx(spark, sf), "step")


_HIST_SQL = """
SELECT {g}b.bin, r.lo + (r.hi - r.lo) * CAST(b.bin AS DOUBLE) / CAST(50 AS DOUBLE) AS bin_start,
       coalesce(c.n, 0) AS n
FROM r JOIN (SELECT CAST(range AS INTEGER) AS bin FROM range(50)) b ON TRUE
LEFT JOIN c ON c.bin = b.bin {jg}"""


@query("histogram_amount", with_("tx") + """
, r AS (SELECT min(amount) AS lo, max(amount) AS hi FROM tx),
c AS (SELECT CAST(CASE WHEN r.hi = r.lo THEN 0
                  ELSE least(floor((t.amount - r.lo) * (CAST(50 AS DOUBLE) / (r.hi - r.lo))), 49) END
             AS INTEGER) AS bin, count(*) AS n
      FROM tx t, r GROUP BY 1)""" + _HIST_SQL.format(g="", jg=""))
def histogram_amount(spark, sf):
    """50 equal-width bins of amount over [min, max], zero-filled."""
    return P.histogram(C.tx(spark, sf), "amount", 50)


@query("histogram_log_amount", with_("tx") + """
, x AS (SELECT round(ln(1 + amount), 9) AS x FROM tx),
r AS (SELECT min(x) AS lo, max(x) AS hi FROM x),
c AS (SELECT CAST(CASE WHEN r.hi = r.lo THEN 0
                  ELSE least(floor((x.x - r.lo) * (CAST(50 AS DOUBLE) / (r.hi - r.lo))), 49) END
             AS INTEGER) AS bin, count(*) AS n
      FROM x, r GROUP BY 1)""" + _HIST_SQL.format(g="", jg=""))
def histogram_log_amount(spark, sf):
    """50 equal-width bins of log(1 + amount)."""
    t = C.tx(spark, sf).select(py_round(F.log1p("amount"), 9).alias("log_amount"))
    return P.histogram(t, "log_amount", 50)


@query("histogram_step", with_("tx") + """
, r AS (SELECT CAST(min(step) AS DOUBLE) AS lo, CAST(max(step) AS DOUBLE) AS hi FROM tx),
c AS (SELECT CAST(CASE WHEN r.hi = r.lo THEN 0
                  ELSE least(floor((t.step - r.lo) * (CAST(50 AS DOUBLE) / (r.hi - r.lo))), 49) END
             AS INTEGER) AS bin, count(*) AS n
      FROM tx t, r GROUP BY 1)""" + _HIST_SQL.format(g="", jg=""))
def histogram_step(spark, sf):
    """50 equal-width bins of the time step."""
    return P.histogram(C.tx(spark, sf).select("step"), "step", 50)


@query("histogram_score_by_class", with_("tx") + """
, s AS (SELECT isFraud, CAST(CAST(trunc(prob * CAST(100 AS DOUBLE)) AS INTEGER) AS DOUBLE) AS x FROM tx),
r AS (SELECT isFraud, min(x) AS lo, max(x) AS hi FROM s GROUP BY isFraud),
c AS (SELECT s.isFraud, CAST(CASE WHEN r.hi = r.lo THEN 0
                  ELSE least(floor((s.x - r.lo) * (CAST(50 AS DOUBLE) / (r.hi - r.lo))), 49) END
             AS INTEGER) AS bin, count(*) AS n
      FROM s JOIN r ON r.isFraud = s.isFraud GROUP BY 1, 2)""" + _HIST_SQL.format(
    g="r.isFraud, ", jg="AND c.isFraud = r.isFraud"))
def histogram_score_by_class(spark, sf):
    """50 bins of the truncated 0-100 risk score per class (own range per class)."""
    s = C.tx(spark, sf).select("isFraud", risk_score_trunc(F.col("prob")).alias("risk_score"))
    return P.histogram(s, "risk_score", 50, group="isFraud")


def _box_sql():
    parts = []
    for c in BOX_COLS:
        parts.append(f"""
SELECT q.isFraud, '{c}' AS column_name, q.q1, q.median, q.q3, q.q3 - q.q1 AS iqr,
       min(t.{c}) FILTER (WHERE t.{c} >= q.q1 - CAST(1.5 AS DOUBLE) * (q.q3 - q.q1)
                           AND t.{c} <= q.q3 + CAST(1.5 AS DOUBLE) * (q.q3 - q.q1)) AS whisker_low,
       max(t.{c}) FILTER (WHERE t.{c} >= q.q1 - CAST(1.5 AS DOUBLE) * (q.q3 - q.q1)
                           AND t.{c} <= q.q3 + CAST(1.5 AS DOUBLE) * (q.q3 - q.q1)) AS whisker_high,
       count(*) FILTER (WHERE NOT (t.{c} >= q.q1 - CAST(1.5 AS DOUBLE) * (q.q3 - q.q1)
                           AND t.{c} <= q.q3 + CAST(1.5 AS DOUBLE) * (q.q3 - q.q1))) AS n_outliers
FROM tx t JOIN (SELECT isFraud, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS median,
                       quantile_cont({c}, 0.75) AS q3 FROM tx GROUP BY isFraud) q
  ON q.isFraud = t.isFraud
GROUP BY q.isFraud, q.q1, q.median, q.q3""")
    return _union(parts)


@query("boxplot_by_class", with_("tx") + _box_sql())
def boxplot_by_class(spark, sf):
    return P.boxplot_stats(C.tx(spark, sf), BOX_COLS, "isFraud")


def _corr_sql(pairs, src):
    return _union([
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, "
        f"round(covar_samp(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) / "
        f"(stddev_samp(CAST({a} AS DOUBLE)) * stddev_samp(CAST({b} AS DOUBLE))), 6) AS corr FROM {src}"
        for a, b in pairs])


_LABEL_PAIRS = [(c, "isFraud") for c in CORR_FEATURES]
_MATRIX_PAIRS = [(a, b) for i, a in enumerate(MATRIX_COLS) for b in MATRIX_COLS[i + 1:]]


@query("corr_with_label", with_("feat") + _corr_sql(_LABEL_PAIRS, "feat"))
def corr_with_label(spark, sf):
    """Pearson correlation of each feature with the label (6 places)."""
    r = P.correlations(C.features(spark, sf), _LABEL_PAIRS)
    return r.withColumn("corr", py_round(F.col("corr"), 6))


@query("corr_matrix", with_("tx") + ", txl AS (SELECT *, ln(1 + amount) AS log_amount FROM tx)\n"
       + _corr_sql(_MATRIX_PAIRS, "txl"))
def corr_matrix(spark, sf):
    """Upper triangle (36 pairs) of the correlation matrix, one aggregation pass."""
    r = P.correlations(C.tx(spark, sf).withColumn("log_amount", F.log1p("amount")), _MATRIX_PAIRS)
    return r.withColumn("corr", py_round(F.col("corr"), 6))


@query("imbalance_ratio", with_("tx") + """
SELECT n_neg, n_pos, CAST(round_even(CAST(n_neg AS DOUBLE) / CAST(n_pos AS DOUBLE), 0) AS BIGINT) AS ratio
FROM (SELECT count(*) FILTER (WHERE isFraud = 0) AS n_neg,
             count(*) FILTER (WHERE isFraud = 1) AS n_pos FROM tx) c""")
def imbalance_ratio(spark, sf):
    return P.imbalance(C.tx(spark, sf))


@query("avg_prob_by_class", with_("tx") + """
SELECT isFraud, round(avg(prob), 9) AS avg_prob FROM tx GROUP BY isFraud""")
def avg_prob_by_class(spark, sf):
    r = P.mean_by(C.tx(spark, sf), "prob", "isFraud")
    return r.withColumn("avg_prob", py_round(F.col("avg_prob"), 9))
