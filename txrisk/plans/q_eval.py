"""Evaluation (E1-E9), sampling (T6-T8) and alignment-join (J3, J4) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from txrisk.functions.numeric import py_round
from txrisk.functions.scoring import risk_level, risk_score
from txrisk.operators import evaluate as EV
from txrisk.operators import sampling as SM
from txrisk.operators.joins import align_by_key
from txrisk.plans import context as C
from txrisk.plans.oracle_base import RISK_SCORE, LEVEL_OF_SCORE, with_
from txrisk.plans.registry import query

THRESHOLD = 0.5
SAMPLE_N = 5000
UNDERSAMPLE_RATIO = 30  # of the training split
FIXTURE_RATIO = 5       # the fixture has about 18 negatives a positive

_CUM = with_("tx") + """
, cum AS (
  SELECT s, pos, neg,
         CAST(sum(pos) OVER (ORDER BY s DESC) AS BIGINT) AS tp,
         CAST(sum(neg) OVER (ORDER BY s DESC) AS BIGINT) AS fp,
         CAST(sum(pos) OVER () AS BIGINT) AS P, CAST(sum(neg) OVER () AS BIGINT) AS N
  FROM (SELECT prob AS s, CAST(sum(isFraud) AS BIGINT) AS pos,
               CAST(count(*) - sum(isFraud) AS BIGINT) AS neg FROM tx GROUP BY prob) g)
, auc AS (
  SELECT CAST(sum(CAST(neg AS HUGEINT) * (2 * tp - pos)) AS DOUBLE)
         / (CAST(2 AS DOUBLE) * CAST(max(P) AS DOUBLE) * CAST(max(N) AS DOUBLE)) AS roc_auc,
         sum(CAST(pos AS DOUBLE) * CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE))
         / CAST(max(P) AS DOUBLE) AS ap
  FROM cum)
"""

_CM = with_("tx") + f"""
, cm AS (
  SELECT count(*) FILTER (WHERE prob < {THRESHOLD} AND isFraud = 0) AS tn,
         count(*) FILTER (WHERE prob >= {THRESHOLD} AND isFraud = 0) AS fp,
         count(*) FILTER (WHERE prob < {THRESHOLD} AND isFraud = 1) AS fn,
         count(*) FILTER (WHERE prob >= {THRESHOLD} AND isFraud = 1) AS tp FROM tx)
"""

_D = "CAST({} AS DOUBLE)".format
_SWEEP = with_("tx") + f"""
, th AS (SELECT CAST(0.1 AS DOUBLE) + CAST(i AS DOUBLE)
                * ((CAST(0.1 AS DOUBLE) + CAST(0.05 AS DOUBLE)) - CAST(0.1 AS DOUBLE)) AS t
         FROM range(16) r(i))
, sw0 AS (
  SELECT th.t, count(*) FILTER (WHERE tx.prob >= th.t AND tx.isFraud = 1) AS tp,
         count(*) FILTER (WHERE tx.prob >= th.t AND tx.isFraud = 0) AS fp,
         count(*) FILTER (WHERE tx.isFraud = 1) AS P
  FROM th, tx GROUP BY th.t)
, sw AS (
  SELECT round(t, 2) AS threshold,
         round({_D('tp')} / {_D('tp + fp')}, 4) AS precision,
         round(CASE WHEN P > 0 THEN {_D('tp')} / {_D('P')} ELSE 0 END, 4) AS recall,
         round({_D('2 * tp')} / {_D('2 * tp + fp + (P - tp)')}, 4) AS f1, tp, fp
  FROM sw0 WHERE tp + fp > 0)
, best AS (SELECT * FROM sw ORDER BY f1 DESC, threshold ASC LIMIT 1)
"""


def _cum(spark, sf):
    return EV.cumulative_by_score(C.tx(spark, sf), "prob", "isFraud")


def _cm(spark, sf, thr=THRESHOLD):
    return EV.confusion_counts(C.tx(spark, sf), "prob", "isFraud", thr)


def _sweep(spark, sf):
    return EV.sweep_report(EV.threshold_sweep(C.tx(spark, sf), EV.sweep_thresholds()))


@query("confusion_matrix", _CM + f"""
SELECT tn, fp, fn, tp,
       round(CASE WHEN tp + fn > 0 THEN {_D('tp')} / {_D('tp + fn')} ELSE 0 END * CAST(100 AS DOUBLE), 2) AS recall_pct,
       round(CASE WHEN fp + tn > 0 THEN {_D('fp')} / {_D('fp + tn')} ELSE 0 END * CAST(100 AS DOUBLE), 2) AS false_alarm_pct
FROM cm""")
def confusion_matrix(spark, sf):
    cm = EV.with_rates(_cm(spark, sf))
    return cm.select("tn", "fp", "fn", "tp",
                     py_round(F.col("recall") * F.lit(100.0), 2).alias("recall_pct"),
                     py_round(F.col("false_positive_rate") * F.lit(100.0), 2).alias("false_alarm_pct"))


@query("roc_curve", _CUM + f"""
SELECT s AS threshold, {_D('fp')} / {_D('N')} AS fpr, {_D('tp')} / {_D('P')} AS tpr FROM cum""")
def roc_curve(spark, sf):
    return EV.roc_curve(_cum(spark, sf))


@query("pr_curve", _CUM + f"""
SELECT s AS threshold, {_D('tp')} / {_D('tp + fp')} AS precision, {_D('tp')} / {_D('P')} AS recall
FROM cum""")
def pr_curve(spark, sf):
    return EV.pr_curve(_cum(spark, sf))


@query("roc_points", _CUM + f"""
, st AS (SELECT *, lead(pos) OVER (ORDER BY s DESC) AS np, lead(neg) OVER (ORDER BY s DESC) AS nn,
                row_number() OVER (ORDER BY s DESC) AS k FROM cum)
SELECT CAST('Infinity' AS DOUBLE) AS threshold, CAST(0 AS DOUBLE) AS fpr, CAST(0 AS DOUBLE) AS tpr
UNION ALL
SELECT s, {_D('fp')} / {_D('N')}, {_D('tp')} / {_D('P')} FROM st
WHERE k = 1 OR np IS NULL OR np <> pos OR nn <> neg""")
def roc_points(spark, sf):
    """ROC curve from (0, 0), collinear points left out."""
    return EV.roc_points(C.tx(spark, sf), "prob", "isFraud")


@query("pr_points", _CUM + f"""
SELECT s AS threshold, {_D('tp')} / {_D('tp + fp')} AS precision, {_D('tp')} / {_D('P')} AS recall
FROM cum UNION ALL SELECT NULL, CAST(1 AS DOUBLE), CAST(0 AS DOUBLE)""")
def pr_points(spark, sf):
    """Precision-recall curve with its closing point."""
    return EV.pr_points(_cum(spark, sf))


@query("roc_auc", _CUM + "SELECT round(roc_auc, 12) AS roc_auc FROM auc")
def roc_auc(spark, sf):
    return EV.roc_auc(_cum(spark, sf)).select(py_round(F.col("roc_auc"), 12).alias("roc_auc"))


@query("average_precision", _CUM + "SELECT round(ap, 6) AS average_precision FROM auc")
def average_precision(spark, sf):
    return EV.average_precision(_cum(spark, sf)).select(
        py_round(F.col("average_precision"), 6).alias("average_precision"))


@query("metrics_at_threshold", _CUM.replace("WITH ", "WITH ", 1) + _CM.split("\n", 1)[1].replace(
    with_("tx").split("\n", 1)[1], "", 1) + f"""
SELECT {THRESHOLD} AS threshold,
       CASE WHEN tp + fp > 0 THEN {_D('tp')} / {_D('tp + fp')} ELSE 0 END AS precision,
       CASE WHEN tp + fn > 0 THEN {_D('tp')} / {_D('tp + fn')} ELSE 0 END AS recall,
       CASE WHEN 2 * tp + fp + fn > 0 THEN {_D('2 * tp')} / {_D('2 * tp + fp + fn')} ELSE 0 END AS f1,
       {_D('tp + tn')} / {_D('tp + tn + fp + fn')} AS accuracy,
       tp, fp, tn, fn,
       CASE WHEN fp + tn > 0 THEN {_D('fp')} / {_D('fp + tn')} ELSE 0 END AS false_positive_rate,
       round(auc.roc_auc, 12) AS roc_auc, round(auc.ap, 6) AS pr_auc
FROM cm, auc""")
def metrics_at_threshold(spark, sf):
    cm = EV.with_areas(EV.with_rates(_cm(spark, sf)), _cum(spark, sf))
    return cm.select(F.lit(THRESHOLD).alias("threshold"), "precision", "recall", "f1", "accuracy",
                     "tp", "fp", "tn", "fn", "false_positive_rate",
                     py_round(F.col("roc_auc"), 12).alias("roc_auc"),
                     py_round(F.col("pr_auc"), 6).alias("pr_auc"))


@query("threshold_sweep", _SWEEP + "SELECT * FROM sw")
def threshold_sweep(spark, sf):
    return _sweep(spark, sf)


@query("best_threshold", _SWEEP + "SELECT * FROM best")
def best_threshold(spark, sf):
    return EV.best_by_f1(_sweep(spark, sf))


_R6 = "round({}, 6)".format


_REPORT = f"""
, r AS (SELECT
   CASE WHEN tn + fn > 0 THEN {_D('tn')} / {_D('tn + fn')} ELSE 0 END AS p0,
   CASE WHEN tn + fp > 0 THEN {_D('tn')} / {_D('tn + fp')} ELSE 0 END AS r0,
   CASE WHEN 2 * tn + fn + fp > 0 THEN {_D('2 * tn')} / {_D('2 * tn + fn + fp')} ELSE 0 END AS f0,
   tn + fp AS s0,
   CASE WHEN tp + fp > 0 THEN {_D('tp')} / {_D('tp + fp')} ELSE 0 END AS p1,
   CASE WHEN tp + fn > 0 THEN {_D('tp')} / {_D('tp + fn')} ELSE 0 END AS r1,
   CASE WHEN 2 * tp + fp + fn > 0 THEN {_D('2 * tp')} / {_D('2 * tp + fp + fn')} ELSE 0 END AS f1,
   tp + fn AS s1,
   {_D('tp + tn')} / {_D('tp + tn + fp + fn')} AS acc FROM cm)
SELECT '0' AS label, {_R6('p0')} AS precision, {_R6('r0')} AS recall, {_R6('f0')} AS f1, s0 AS support FROM r
UNION ALL SELECT '1', {_R6('p1')}, {_R6('r1')}, {_R6('f1')}, s1 FROM r
UNION ALL SELECT 'accuracy', NULL, NULL, {_R6('acc')}, s0 + s1 FROM r
UNION ALL SELECT 'macro avg', {_R6('(p0 + p1) / CAST(2 AS DOUBLE)')}, {_R6('(r0 + r1) / CAST(2 AS DOUBLE)')},
                 {_R6('(f0 + f1) / CAST(2 AS DOUBLE)')}, s0 + s1 FROM r
UNION ALL SELECT 'weighted avg',
  {_R6(f"(p0 * {_D('s0')} + p1 * {_D('s1')}) / {_D('s0 + s1')}")},
  {_R6(f"(r0 * {_D('s0')} + r1 * {_D('s1')}) / {_D('s0 + s1')}")},
  {_R6(f"(f0 * {_D('s0')} + f1 * {_D('s1')}) / {_D('s0 + s1')}")}, s0 + s1 FROM r"""


def _report(cm):
    rep = EV.classification_report(cm)
    return rep.select("label", *[py_round(F.col(c), 6).alias(c) for c in ("precision", "recall", "f1")],
                      "support")


@query("classification_report", _CM + _REPORT)
def classification_report(spark, sf):
    return _report(_cm(spark, sf))


@query("classification_report_best", _SWEEP + """
, cm AS (
  SELECT count(*) FILTER (WHERE prob < best.threshold AND isFraud = 0) AS tn,
         count(*) FILTER (WHERE prob >= best.threshold AND isFraud = 0) AS fp,
         count(*) FILTER (WHERE prob < best.threshold AND isFraud = 1) AS fn,
         count(*) FILTER (WHERE prob >= best.threshold AND isFraud = 1) AS tp FROM tx, best)
""" + _REPORT)
def classification_report_best(spark, sf):
    """The report at the best threshold (as reported, two places)."""
    best = EV.best_by_f1(_sweep(spark, sf)).select("threshold").scalar()
    return _report(EV.confusion_counts(C.tx(spark, sf), "prob", "isFraud", best))


@query("final_metrics", _CUM.replace("WITH ", "WITH ", 1) + _SWEEP.split("\n", 1)[1].replace(
    with_("tx").split("\n", 1)[1], "", 1) + """
SELECT round(auc.roc_auc, 4) AS roc_auc, round(auc.ap, 4) AS pr_auc,
       best.threshold AS best_threshold, best.precision AS precision_at_best_threshold,
       best.recall AS recall_at_best_threshold, best.f1 AS f1_at_best_threshold
FROM auc, best""")
def final_metrics(spark, sf):
    best = EV.with_areas(EV.best_by_f1(_sweep(spark, sf)), _cum(spark, sf))
    return best.select(py_round(F.col("roc_auc"), 4).alias("roc_auc"),
                       py_round(F.col("pr_auc"), 4).alias("pr_auc"),
                       F.col("threshold").alias("best_threshold"),
                       F.col("precision").alias("precision_at_best_threshold"),
                       F.col("recall").alias("recall_at_best_threshold"),
                       F.col("f1").alias("f1_at_best_threshold"))


@query("risk_bucket_counts", with_("tx") + f"""
SELECT {LEVEL_OF_SCORE.format(s=RISK_SCORE.format(p='prob'))} AS risk_level, count(*) AS n
FROM tx GROUP BY 1""")
def risk_bucket_counts(spark, sf):
    return (C.tx(spark, sf).groupBy(risk_level(risk_score(F.col("prob"))).alias("risk_level"))
            .agg(F.count("*").alias("n")))


# --------------------------------------------------------------------------- sampling / joins

_MD5 = "md5('42|' || CAST(tx_id AS VARCHAR))"


@query("sample_n", with_("tx") + f"""
SELECT tx_id, type, amount, isFraud FROM tx ORDER BY {_MD5}, tx_id LIMIT {SAMPLE_N}""")
def sample_n(spark, sf):
    """Exactly 5000 rows, uniform by hash order (the batch scorer's sample)."""
    return SM.sample_n(C.tx(spark, sf).select("tx_id", "type", "amount", "isFraud"), SAMPLE_N)


@query("undersample", with_("tx") + f"""
SELECT tx_id, isFraud FROM (
  SELECT tx_id, isFraud, row_number() OVER (PARTITION BY isFraud ORDER BY {_MD5}, tx_id) AS rn,
         count(*) FILTER (WHERE isFraud = 1) OVER () AS n_pos
  FROM tx) q
WHERE isFraud = 1 OR rn <= {FIXTURE_RATIO} * n_pos""")
def undersample(spark, sf):
    """All positives + min(n_neg, 5 * n_pos) negatives, chosen by hash order."""
    return SM.undersample(C.tx(spark, sf).select("tx_id", "isFraud"), "isFraud", FIXTURE_RATIO)


def _strat_sql():
    return with_("tx") + f"""
, c AS (SELECT isFraud, count(*) AS n FROM tx GROUP BY isFraud)
, t AS (SELECT CAST(ceil(CAST(0.2 AS DOUBLE) * CAST(sum(n) AS DOUBLE)) AS BIGINT) AS n_test,
               sum(n) AS total FROM c)
, a AS (SELECT c.isFraud, CAST(t.n_test AS DOUBLE) * CAST(c.n AS DOUBLE) / CAST(t.total AS DOUBLE) AS ideal,
               t.n_test FROM c, t)
, b AS (SELECT isFraud, ideal, CAST(floor(ideal) AS BIGINT) AS base, n_test,
               row_number() OVER (ORDER BY ideal - floor(ideal) DESC, CAST(isFraud AS VARCHAR)) AS pr
        FROM a)
, k AS (SELECT isFraud, base + CASE WHEN pr <= n_test - (SELECT sum(base) FROM b) THEN 1 ELSE 0 END AS k
        FROM b)
SELECT tx.tx_id, tx.isFraud,
       CASE WHEN row_number() OVER (PARTITION BY tx.isFraud ORDER BY {_MD5}, tx.tx_id) <= k.k
            THEN 'test' ELSE 'train' END AS split
FROM tx JOIN k ON k.isFraud = tx.isFraud"""


@query("stratified_split", _strat_sql())
def stratified_split(spark, sf):
    """80/20 split with exact per-class test sizes, by hash order."""
    return SM.stratified_split(C.tx(spark, sf).select("tx_id", "isFraud"), "isFraud", 0.2)


@query("score_label_join", with_("feat", "tx") + """
SELECT f.tx_id, f.amount, f.type_encoded, f.suspicious_signal_count, t.prob, t.isFraud
FROM feat f JOIN tx t ON t.tx_id = f.tx_id""")
def score_label_join(spark, sf):
    """Features, probabilities and labels aligned by key (never by position)."""
    x = C.features(spark, sf).select("tx_id", "amount", "type_encoded", "suspicious_signal_count")
    y = C.tx(spark, sf).select("tx_id", "prob", "isFraud")
    return align_by_key(x, y, "tx_id")
