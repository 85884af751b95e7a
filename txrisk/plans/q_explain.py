"""Explanation queries (X1, X3-X7) on a standardized correlation-weighted
linear scorer, so both engines can compute the same coefficients; the same
operators take a fitted model's coefficient table (see q_models)."""

from __future__ import annotations

from pyspark.sql import functions as F

from txrisk.functions.numeric import py_round
from txrisk.operators import explain as X
from txrisk.plans import context as C
from txrisk.plans.oracle_base import with_
from txrisk.plans.registry import query
from txrisk.schema import MODEL_COLUMNS

TOP_K = 8  # the example alert used 8 reasons

_D = "CAST({} AS DOUBLE)".format

_COEFS = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, CASE WHEN stddev_samp({_D(f)}) * stddev_samp({_D('isFraud')}) > 0 "
    f"THEN covar_samp({_D(f)}, {_D('isFraud')}) / (stddev_samp({_D(f)}) * stddev_samp({_D('isFraud')})) "
    f"ELSE CAST(0 AS DOUBLE) END AS coef, avg({_D(f)}) AS mean, stddev_samp({_D(f)}) AS scale FROM featr"
    for f in MODEL_COLUMNS)
_LONG = " UNION ALL ".join(f"SELECT tx_id, '{f}' AS feature, {_D(f)} AS value FROM featr"
                           for f in MODEL_COLUMNS)

# log_amount at 9 places in both engines (log1p and ln(1+x) may differ in the last bit)
_CONTRIB = with_("feat") + f"""
, featr AS (SELECT * REPLACE (round(log_amount, 9) AS log_amount) FROM feat)
, coefs AS ({_COEFS})
, contrib AS (
  SELECT l.tx_id, l.feature, l.value,
         floor(c.coef * CASE WHEN c.scale > 0 THEN (l.value - c.mean) / c.scale ELSE CAST(0 AS DOUBLE) END
               * CAST(1000000 AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(1000000 AS DOUBLE) AS contribution
  FROM ({_LONG}) l JOIN coefs c ON c.feature = l.feature)
, imp AS (
  SELECT feature, floor(avg(abs(contribution)) * CAST(1000000 AS DOUBLE) + CAST(0.5 AS DOUBLE))
                  / CAST(1000000 AS DOUBLE) AS mean_abs_contribution FROM contrib GROUP BY feature)
, ranked AS (
  SELECT * FROM (
    SELECT tx_id, feature, value, contribution, 'fraud' AS direction,
           row_number() OVER (PARTITION BY tx_id ORDER BY contribution DESC, feature ASC) AS rank
    FROM contrib WHERE contribution > 0) p WHERE rank <= {TOP_K}
  UNION ALL
  SELECT tx_id, feature, value, contribution, 'not_fraud',
         row_number() OVER (PARTITION BY tx_id ORDER BY contribution DESC, feature ASC)
  FROM (SELECT *, row_number() OVER (PARTITION BY tx_id ORDER BY contribution ASC, feature DESC) AS tail
        FROM contrib WHERE contribution < 0) n WHERE tail <= {TOP_K})
"""

_STRF = ("CASE WHEN value = floor(value) AND abs(value) < 1e16 "
         "THEN CAST(CAST(value AS BIGINT) AS VARCHAR) || '.0' ELSE CAST(value AS VARCHAR) END")
_TEXT = ("CASE feature "
         + " ".join(
             f"WHEN '{f}' THEN " + (
                 "'" + t.split("{2f}")[0].replace("'", "''") + "' || printf('%.2f', round(value, 2)) || '"
                 + t.split("{2f}")[1].replace("'", "''") + "'" if "{2f}" in t else
                 "'" + t.split("{str}")[0].replace("'", "''") + "' || " + _STRF + " || '"
                 + t.split("{str}")[1].replace("'", "''") + "'" if "{str}" in t else
                 "'" + t.replace("'", "''") + "'")
             for f, t in X.REASON_TEMPLATES.items())
         + " ELSE feature || ' contributed to fraud risk.' END")


_KEY = "tx_id"


_COEFS_MEMO: dict = {}
C.MEMOS.append(_COEFS_MEMO)


def _rounded_features(spark, sf):
    return C.features(spark, sf).withColumn("log_amount", F.round(F.col("log_amount"), 9))


def coefficients(spark, sf):
    """The scorer's coefficients, fitted once per session and input."""
    k = C._key(spark, sf)
    if k not in _COEFS_MEMO:
        _COEFS_MEMO[k] = X.correlation_coefficients(_rounded_features(spark, sf), MODEL_COLUMNS,
                                                    "isFraud")
    return _COEFS_MEMO[k]


def _contrib(spark, sf):
    return X.linear_contributions(_rounded_features(spark, sf), coefficients(spark, sf),
                                  MODEL_COLUMNS, _KEY, digits=6)


def _reasons(spark, sf):
    return X.top_reasons_rows(_rounded_features(spark, sf), coefficients(spark, sf), MODEL_COLUMNS,
                              TOP_K, _KEY, digits=6)


def _importance(spark, sf):
    g = X.global_importance(_rounded_features(spark, sf), coefficients(spark, sf), MODEL_COLUMNS,
                            _KEY, digits=6)
    from txrisk.functions.numeric import round_half_up_fast
    return g.withColumn("mean_abs_contribution", round_half_up_fast(F.col("mean_abs_contribution"), 6))


@query("contrib_linear", _CONTRIB + "SELECT tx_id, feature, value, contribution FROM contrib")
def contrib_linear(spark, sf):
    """Per-row, per-feature contributions (long table, 6 places)."""
    return _contrib(spark, sf)


@query("global_importance", _CONTRIB + """
SELECT feature, mean_abs_contribution,
       row_number() OVER (ORDER BY mean_abs_contribution DESC, feature) AS rank FROM imp""")
def global_importance(spark, sf):
    """Mean |contribution| per feature, ranked."""
    from pyspark.sql import Window
    # ranks over one row per feature (29 rows)
    return _importance(spark, sf).withColumn("rank", F.row_number().over(
        Window.orderBy(F.desc("mean_abs_contribution"), "feature")))


@query("dependence", _CONTRIB + """
SELECT c.tx_id, c.feature, c.value, c.contribution FROM contrib c
JOIN (SELECT feature FROM imp ORDER BY mean_abs_contribution DESC, feature LIMIT 2) t
  ON t.feature = c.feature""")
def dependence(spark, sf):
    """(value, contribution) pairs of the two most important features."""
    top = _importance(spark, sf).orderBy(F.desc("mean_abs_contribution"), "feature").limit(2)
    return _contrib(spark, sf).join(top.select("feature"), "feature", "left_semi").select(
        _KEY, "feature", "value", "contribution")


@query("top_reasons", _CONTRIB + "SELECT tx_id, direction, rank, feature, value, contribution FROM ranked")
def top_reasons(spark, sf):
    """Top 8 contributions toward fraud and the 8 most negative, per row (sorted
    inside each row: no shuffle)."""
    return _reasons(spark, sf)


@query("reason_text", _CONTRIB + f"""
SELECT tx_id, rank, feature, {_TEXT} AS reason_text FROM ranked WHERE direction = 'fraud'""")
def reason_text_q(spark, sf):
    """Readable text of every reason toward fraud."""
    r = _reasons(spark, sf).where(F.col("direction") == "fraud")
    return r.select("tx_id", "rank", "feature",
                    X.reason_text(F.col("feature"), F.col("value")).alias("reason_text"))


def _model_scored_sql():
    """The scoring chain on the probability of the explained scorer itself."""
    from txrisk.plans.oracle_base import CTES
    chain = []
    for name, source in (("scored0", "feat"), ("scored1", "scored0"), ("scored2", "scored1"),
                         ("scored", "scored2")):
        chain.append(f"m{name} AS (" + CTES[name][1].replace(f"FROM {source}", f"FROM m{source}") + ")")
    return """
, msum AS (SELECT tx_id, sum(contribution) AS margin FROM contrib GROUP BY tx_id)
, mfeat AS (SELECT f.* REPLACE (round(CAST(1 AS DOUBLE) / (CAST(1 AS DOUBLE) + exp(-m.margin)), 6) AS prob)
            FROM feat f JOIN msum m ON m.tx_id = f.tx_id)
, """ + "\n, ".join(chain)


@query("explained_alerts", _CONTRIB + _model_scored_sql() + f"""
, lists AS (
  SELECT tx_id, string_agg(feature, '|' ORDER BY rank) AS top_features,
         string_agg({_TEXT}, '|' ORDER BY rank) AS top_texts, count(*) AS n_reasons
  FROM ranked WHERE direction = 'fraud' GROUP BY tx_id)
SELECT 'ALT-' || strftime(s.created_at, '%Y%m%d%H%M%S') || '-' || CAST(s.tx_id AS VARCHAR) AS alert_id,
       CAST(s.tx_id AS VARCHAR) AS transaction_ref, s.ml_probability AS fraud_probability,
       s.ml_risk_score AS risk_score, s.ml_risk_level AS risk_level,
       s.ml_action AS recommended_action, coalesce(l.n_reasons, 0) AS n_reasons,
       coalesce(l.top_features, '') AS top_features, coalesce(l.top_texts, '') AS top_texts
FROM mscored s LEFT JOIN lists l ON l.tx_id = s.tx_id
WHERE s.final_risk_level <> 'LOW'""")
def explained_alerts(spark, sf):
    """Each alert with its ranked reasons toward fraud and their texts. Probability,
    score, level and reasons all come from the same scorer: the probability is
    the logistic function of the sum of the contributions."""
    from txrisk.operators.scoring import score, with_alerts
    f = _rounded_features(spark, sf).withColumn(
        "reasons", X.reasons(coefficients(spark, sf), MODEL_COLUMNS, TOP_K, digits=6))
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("reasons.margin")))
    scored = with_alerts(score(f.withColumn("model_prob", py_round(p, 6)), prob_col="model_prob"))
    e = X.explained_alerts(scored, _KEY)
    return e.select("alert_id", "transaction_ref", "fraud_probability", "risk_score", "risk_level",
                    "recommended_action", F.size("top_reasons").cast("long").alias("n_reasons"),
                    F.concat_ws("|", F.transform("top_reasons", lambda r: r["feature"])).alias("top_features"),
                    F.concat_ws("|", F.transform("top_reasons", lambda r: r["reason_text"])).alias("top_texts"))
