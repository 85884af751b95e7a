"""Hand rows from FIXTURES.md section 3."""
import math

from pyspark.sql import functions as F

from txrisk.functions import scoring as S
from txrisk.operators.config import FeatureConfig, step_bins
from txrisk.operators.enrich import build_features
from txrisk.operators.quality import split_valid
from txrisk.operators.scoring import audit_records, score, with_alerts
from txrisk.schema import REQUEST_SCHEMA, ACTIONS

# Fixed values of the shipped configuration that the hand rows use (the
# per-step table is cut to the steps the rows touch).
SHIPPED = {"large_threshold_p95": 518634.19375, "median_oldbalanceDest": 132705.65625,
           "median_transactions_in_step": 529.0, "step_counts": {"10": 35991, "1": 2708}}


def shipped_config(spark):
    cfg = dict(SHIPPED, step_bins=step_bins(743))
    return FeatureConfig.from_dict(spark, cfg)


def rows(spark, data):
    return spark.createDataFrame(data, REQUEST_SCHEMA)


def test_step_bins_linspace():
    assert step_bins(743) == [0.0, 123.83333333333333, 247.66666666666666, 371.5,
                              495.3333333333333, 619.1666666666666, 743.0]


def test_hand_row_transfer(spark):
    df = rows(spark, [(1, None, 10, "TRANSFER", 900000.0, 10000.0, 0.0, 0.0, 900000.0)])
    f = build_features(df, shipped_config(spark)).first()
    assert f.type_encoded == 4 and f.type_risk_score == 3
    assert f.balance_error_orig == 890000.0 and f.balance_error_dest == 0.0
    assert f.amount_to_oldbalance_orig_ratio == 90.0
    assert f.sender_account_emptied == 1 and f.dest_received_large_amount == 1
    assert f.is_large_transaction == 1 and f.step_bucket == 0
    assert f.transactions_in_step == 35991 and f.is_high_velocity_step == 1
    assert f.is_dest_high_balance == 0 and f.suspicious_signal_count == 5
    s = score(build_features(df, shipped_config(spark)).withColumn("prob", F.lit(0.1))).first()
    assert s.final_risk_level == "CRITICAL" and s.final_risk_score == 85
    assert s.policy_reasons == [
        "Policy: Amount > sender balance + sender account emptied",
        "Policy: Multiple suspicious signals detected (>=3)",
        "Policy: Very high suspicious signal count (>=5)",
        "Policy: Large transaction + destination started from zero balance"]
    assert s.policy_override_applied == 1


def test_type_lookup_and_zero_balance(spark):
    df = rows(spark, [(1, None, 1, "transfer", 10.0, 0.0, 0.0, 5.0, 15.0),
                      (2, None, 1, "XYZ", 10.0, 0.0, 0.0, 5.0, 15.0)])
    f = build_features(df, shipped_config(spark)).orderBy("tx_id").collect()
    assert (f[0].type_encoded, f[0].type_risk_score) == (4, 3)
    assert (f[1].type_encoded, f[1].type_risk_score) == (-1, 0)
    assert f[0].amount_to_oldbalance_orig_ratio == 0.0


def test_bucket_edges(spark):
    cfg = FeatureConfig(1e9, 1e9, [0.0, 10.0, 20.0], 1.0,
                        spark.createDataFrame([], "step int, n long"))
    df = rows(spark, [(i, None, s, "DEBIT", 1.0, 1.0, 0.0, 0.0, 1.0)
                      for i, s in enumerate([0, 10, 11, 20, 21])])
    got = [r.step_bucket for r in build_features(df, cfg).orderBy("tx_id").collect()]
    assert got == [0, 0, 1, 1, None]


def test_shipped_edges_and_unknown_step(spark):
    df = rows(spark, [(1, None, 0, "DEBIT", 1.0, 1.0, 0.0, 0.0, 1.0),
                      (2, None, 744, "DEBIT", 1.0, 1.0, 0.0, 0.0, 1.0)])
    f = build_features(df, shipped_config(spark)).orderBy("tx_id").collect()
    assert (f[0].step_bucket, f[0].transactions_in_step) == (0, 0)
    assert f[1].step_bucket is None
    _, bad = split_valid(df, 743.0)
    assert [r.violations for r in bad.collect()] == [["step beyond last bin edge"]]


def test_quarantine_reasons(spark):
    df = rows(spark, [(1, None, 1, "DEBIT", None, 1.0, 0.0, 0.0, 1.0),
                      (2, None, 1, "DEBIT", float("nan"), 1.0, 0.0, 0.0, 1.0),
                      (3, None, 1, "DEBIT", 1.0, -5.0, 0.0, 0.0, 1.0),
                      (4, None, 1, None, 1.0, 1.0, 0.0, 0.0, 1.0),
                      (5, None, 1, "DEBIT", 1.0, 1.0, 0.0, 0.0, 1.0)])
    ok, bad = split_valid(df)
    assert [r.tx_id for r in ok.collect()] == [5]
    got = {r.tx_id: r.violations for r in bad.collect()}
    assert got == {1: ["amount missing"], 2: ["amount NaN"], 3: ["oldbalanceOrg < 0"],
                   4: ["type missing"]}


def test_large_is_strict(spark):
    df = rows(spark, [(1, None, 1, "DEBIT", SHIPPED["large_threshold_p95"], 1.0, 0.0, 0.0, 1.0)])
    assert build_features(df, shipped_config(spark)).first().is_large_transaction == 0


def test_levels_and_actions(spark):
    df = spark.createDataFrame([(s,) for s in (39, 40, 69, 70, 84, 85)], "s int")
    got = [r[0] for r in df.select(S.risk_level(F.col("s"))).collect()]
    assert got == ["LOW", "MEDIUM", "MEDIUM", "HIGH", "HIGH", "CRITICAL"]
    r = spark.createDataFrame([(1.0,)], "p double").select(S.score_probability(F.col("p")).alias("r")).first().r
    assert (r.risk_score, r.risk_level, r.recommended_action) == (100, "CRITICAL", ACTIONS["CRITICAL"])
    low = spark.createDataFrame([("low",), ("weird",)], "l string").select(S.recommended_action(F.col("l")))
    assert [x[0] for x in low.collect()] == ["Allow", "Allow"]


def test_signals_six_rules_one_and_four(spark):
    # emptied, large, dest-from-zero, both balance errors, ratio > 1 -> 6 signals
    df = rows(spark, [(1, None, 10, "TRANSFER", 900000.0, 10000.0, 0.0, 0.0, 5.0)])
    f = build_features(df, shipped_config(spark))
    assert f.first().suspicious_signal_count == 6
    s = score(f.withColumn("prob", F.lit(0.0))).first()
    assert s.final_risk_level == "CRITICAL" and len(s.policy_reasons) == 4


def test_invariants_and_alerts(spark):
    from txrisk.plans import context as C
    s = with_alerts(C.scored(spark, "/root/testdata/sf0.001"))
    bad = s.where(
        (S.level_rank(F.col("final_risk_level")) < S.level_rank(F.col("ml_risk_level")))
        | (F.col("final_risk_score") < S.level_min_score(F.col("final_risk_level")))
        | ((F.col("policy_override_applied") == 1)
           != (F.col("final_risk_level") != F.col("ml_risk_level")))
        | (F.col("alert").isNotNull() != (F.col("final_risk_level") != "LOW")))
    assert bad.count() == 0
    ids = s.where(F.col("alert").isNotNull()).select("alert.alert_id")
    assert ids.count() == ids.distinct().count()
    logs = audit_records(C.scored(spark, "/root/testdata/sf0.001"))
    assert logs.count() == 1500
