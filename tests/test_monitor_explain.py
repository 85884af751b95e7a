"""Monitoring on empty input, explanation invariants, entry contract."""
import math

from pyspark.sql import functions as F

from txrisk.operators import explain as X
from txrisk.operators import monitor as M
from txrisk.schema import LOG_SCHEMA

SF = "/root/testdata/sf0.001"


def test_empty_log_stats(spark):
    empty = spark.createDataFrame([], LOG_SCHEMA)
    r = M.stats(empty).first()
    assert (r.total_scored, r.override_rate_pct, r.avg_risk_score) == (0, 0.0, 0.0)
    k = M.kpis(empty).first()
    assert k.total == 0 and k.pct_critical == 0.0
    d = M.distribution_filled(empty).collect()
    assert [r.level for r in sorted(d, key=lambda r: r.level_rank)] == ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
    assert all(r.n == 0 for r in d)


def test_reason_text_templates(spark):
    df = spark.createDataFrame([("amount_to_oldbalance_orig_ratio", 1.0),
                                ("amount_to_oldbalance_orig_ratio", 0.125),
                                ("transactions_in_step", 16.0), ("type_risk_score", 3.0),
                                ("balance_change_orig", -759701.0)], "feature string, value double")
    got = [r[0] for r in df.select(X.reason_text(F.col("feature"), F.col("value"))).collect()]
    assert got == ["Amount is high relative to sender's old balance (ratio=1.00).",
                   "Amount is high relative to sender's old balance (ratio=0.12).",
                   "High activity at this time step (transactions_in_step=16.0).",
                   "Transaction type has higher fraud risk weight (risk score=3.0).",
                   "balance_change_orig contributed to fraud risk."]


def test_top_reasons_order(spark):
    c = spark.createDataFrame([(1, "a", 1.0, 0.5), (1, "b", 1.0, 0.7), (1, "c", 1.0, -0.1),
                               (1, "d", 1.0, -0.9), (1, "e", 1.0, -0.4)],
                              "tx_id long, feature string, value double, contribution double")
    r = X.top_reasons(c, k=2).collect()
    pos = [x.feature for x in sorted([x for x in r if x.direction == "fraud"], key=lambda x: x.rank)]
    neg = [x.feature for x in sorted([x for x in r if x.direction == "not_fraud"], key=lambda x: x.rank)]
    assert pos == ["b", "a"]
    assert neg == ["e", "d"]  # last two of the descending order


def test_forest_attribution_adds_up(spark):
    from txrisk.operators import models as ML
    from txrisk.plans import context as C
    from txrisk.schema import MODEL_COLUMNS
    f = C.features(spark, SF).select("tx_id", *MODEL_COLUMNS, "isFraud")
    m = ML.fit(f, MODEL_COLUMNS, ML.Preset("t", "rf", {"numTrees": 5, "maxDepth": 4, "seed": 1}))
    trees = X.tree_tables(ML.classifier(m), spark)
    contrib = X.forest_contributions(f.limit(200), trees, MODEL_COLUMNS)
    tot = contrib.groupBy("tx_id").agg((F.sum("contribution") + F.first("bias")).alias("p"))
    pred = ML.predict_proba(m, f.limit(200)).select("tx_id", F.col("prob"))
    worst = tot.join(pred, "tx_id").select(F.max(F.abs(F.col("p") - F.col("prob")))).first()[0]
    assert worst < 1e-9


def test_boosted_attribution_adds_up_to_the_margin(spark):
    from txrisk.operators import models as ML
    from txrisk.plans import context as C
    from txrisk.schema import MODEL_COLUMNS
    f = C.features(spark, SF).select("tx_id", *MODEL_COLUMNS, "isFraud")
    m = ML.fit(f, MODEL_COLUMNS, ML.Preset("t", "gbt", {"maxIter": 4, "maxDepth": 4, "seed": 1}))
    trees = X.tree_tables(ML.classifier(m), spark)
    contrib = X.forest_contributions(f.limit(200), trees, MODEL_COLUMNS)
    tot = contrib.groupBy("tx_id").agg((F.sum("contribution") + F.first("bias")).alias("margin"))
    pred = ML.predict_proba(m, f.limit(200)).select("tx_id", F.col("prob"))
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * F.col("margin")))
    worst = tot.join(pred, "tx_id").select(F.max(F.abs(p - F.col("prob")))).first()[0]
    assert worst < 1e-9


def test_linear_reasons_explain_the_model_they_come_from(spark):
    """Sum of the contributions and the intercept is the fitted model's margin, and
    the reasons are its largest contributions."""
    from txrisk.operators import models as ML
    from txrisk.plans import context as C
    from txrisk.schema import MODEL_COLUMNS
    f = C.features(spark, SF).select("tx_id", *MODEL_COLUMNS, "isFraud")
    m = ML.fit(f, MODEL_COLUMNS, "logreg")
    coefs = X.model_coefficients(MODEL_COLUMNS, *ML.linear_coefficients(m, MODEL_COLUMNS))
    few = f.limit(100)
    r = few.select("tx_id", X.reasons(coefs, MODEL_COLUMNS, 3).alias("r"))
    pred = ML.predict_proba(m, few).select("tx_id", "prob")
    b = float(ML.classifier(m).intercept)
    long = X.linear_contributions(few, coefs, MODEL_COLUMNS)
    top = {}
    for x in X.top_reasons(long, k=3).collect():
        top.setdefault((x.tx_id, x.direction), []).append((x.rank, x.feature, x.contribution))
    for x in r.join(pred, "tx_id").collect():
        assert abs(1 / (1 + math.exp(-(x.r.margin + b))) - x.prob) < 1e-9
        for got, d in ((x.r.toward, "fraud"), (x.r.against, "not_fraud")):
            want = [(f_, c) for _, f_, c in sorted(top.get((x.tx_id, d), []))]
            assert [(y.feature, y.contribution) for y in got] == want


def test_entry_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    rows = df.collect()
    assert sum(r.n for r in rows) == 1500
    assert set(E.oracle_sql()) <= set(E.queries())
