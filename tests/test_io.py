"""Sources and sinks: config save/load, CSV scan, log table, JSON codec, drift, models."""
import json
import os
import tempfile

from pyspark.sql import functions as F

from txrisk.operators.config import FeatureConfig, fit_feature_config
from txrisk.operators.quality import schema_drift
from txrisk.plans import context as C
from txrisk.schema import MODEL_COLUMNS, TRANSACTION_SCHEMA
from txrisk.sources import io as IO

SF = "/root/testdata/sf0.001"


def _tmp():
    return tempfile.mkdtemp(prefix="txrisk-io-", dir="/tmp")


def test_config_roundtrip_and_json_layout(spark):
    cfg = fit_feature_config(C.tx(spark, SF))
    d = _tmp()
    cfg.save(f"{d}/cfg")
    back = FeatureConfig.load(spark, f"{d}/cfg")
    assert back.large_threshold_p95 == cfg.large_threshold_p95
    assert back.step_bins == cfg.step_bins
    assert back.step_counts.count() == cfg.step_counts.count()
    doc = {"large_threshold_p95": 1.5, "median_oldbalanceDest": 2.0, "step_bins": [0.0, 1.0, 2.0],
           "step_counts": {"1": 3, "2": 4}, "median_transactions_in_step": 3.5}
    with open(f"{d}/config.json", "w") as fh:
        json.dump(doc, fh, indent=2)
    j = FeatureConfig.from_json_file(spark, f"{d}/config.json")
    assert j.median_transactions_in_step == 3.5
    assert sorted(tuple(r) for r in j.step_counts.collect()) == [(1, 3), (2, 4)]


def test_csv_scan_with_schema(spark):
    d = _tmp()
    tx = C.tx(spark, SF).select(*[f.name for f in TRANSACTION_SCHEMA.fields])
    IO.write_table(tx, f"{d}/tx_csv", fmt="csv")
    back = IO.read_transactions_csv(spark, f"{d}/tx_csv")
    assert back.schema == TRANSACTION_SCHEMA
    assert back.count() == 1500
    pruned = IO.read_pruned(spark, SF + "/orders.parquet", {"o_orderkey": "int", "o_totalprice": "float"})
    assert pruned.columns == ["o_orderkey", "o_totalprice"]


def test_log_table_idempotent_append_and_codec(spark):
    d = _tmp()
    spark.sql("DROP TABLE IF EXISTS txrisk_test_logs")
    IO.create_log_table(spark, "txrisk_test_logs", f"{d}/logs")
    logs = C.logs(spark, SF)
    a = dict(writer="a", grain="month", table="txrisk_test_logs")
    IO.append_logs(logs, f"{d}/logs", batch_id=7, **a)
    IO.append_logs(logs, f"{d}/logs", batch_id=7, **a)  # replay of the same batch
    back = IO.read_logs(spark, f"{d}/logs")
    assert back.count() == 1500
    assert back.select("id").distinct().count() == 1500
    assert spark.table("txrisk_test_logs").count() == 1500
    # another writer's batch of the same number replaces nothing
    few = logs.where(F.col("id") < 5)
    IO.append_logs(few, f"{d}/logs", writer="b", batch_id=7, grain="month", table="txrisk_test_logs")
    assert spark.table("txrisk_test_logs").count() == IO.read_logs(spark, f"{d}/logs").count() == 1505
    alert = spark.table("txrisk_test_logs").where("alert is not null").select("alert.reasons").first()
    assert all(r.reason.startswith("Policy: ") for r in alert.reasons)
    dec = IO.decode_log(IO.encode_log(logs))
    a = logs.select("id", "transaction", "policy_reasons", "alert")
    b = dec.select("id", "transaction", "policy_reasons", "alert")
    assert a.exceptAll(b).count() == 0
    # NULL-safe decode: missing JSON -> empty reasons, unparseable time -> null
    raw = spark.createDataFrame([(1, "not a time", None, 0.1, "LOW", 10, "LOW", 10, 0, None, 0, None)],
                                "id long, created_at string, transaction_json string, ml_probability double,"
                                " ml_risk_level string, ml_risk_score int, final_risk_level string,"
                                " final_risk_score int, policy_override_applied int,"
                                " policy_reasons_json string, suspicious_signal_count int, alert_json string")
    r = IO.decode_log(raw).first()
    assert r.created_at is None and r.policy_reasons == [] and r.alert is None
    flat = IO.flatten(logs.select("id", "transaction"), ["transaction"])
    assert "transaction.amount" in flat.columns


def test_schema_drift(spark):
    df = spark.createDataFrame([(1, 2.0)], "step int, extra double")
    assert schema_drift(df, ["step", "amount"]) == {"missing": ["amount"], "extra": ["extra"]}


def test_model_save_load(spark):
    from pyspark.ml import PipelineModel
    from txrisk.operators import models as ML
    f = C.features(spark, SF).select(*MODEL_COLUMNS, "isFraud")
    m = ML.fit(f, MODEL_COLUMNS, "logreg")
    d = _tmp()
    m.write().overwrite().save(f"{d}/model")
    back = PipelineModel.load(f"{d}/model")
    p1 = ML.predict_proba(m, f).select("prob").collect()
    p2 = ML.predict_proba(back, f).select("prob").collect()
    assert p1 == p2
    coef, mean, scale = ML.linear_coefficients(m, MODEL_COLUMNS)
    assert len(coef) == len(mean) == len(scale) == len(MODEL_COLUMNS)


def test_one_date_is_not_one_task(spark):
    """The write is dealt by date and piece, and rebalanced."""
    logs = C.logs(spark, SF)
    plan = IO.dated_logs(logs)._jdf.queryExecution().optimizedPlan().toString()
    dealt = [x for x in plan.splitlines() if "RebalancePartitions" in x]
    assert len(dealt) == 1 and "created_date" in dealt[0] and "_piece" in dealt[0]
    assert IO.dated_logs(logs).count() == 1500


def test_hand_log_in_the_stored_layout(spark):
    """Reasons of an alert are objects with a reason."""
    alert = {"alert_id": "ALT-20260412060046", "created_at": "2026-04-12T06:00:46.783950+00:00",
             "transaction_ref": "api_input", "risk_level": "HIGH", "risk_score": 70, "probability": 0.4,
             "recommended_action": "Manual review required",
             "reasons": [{"reason": "one"}, {"reason": "two"}], "status": "PENDING_REVIEW"}
    tx = {"step": 10, "type": "TRANSFER", "amount": 9.5, "oldbalanceOrg": 1.0, "newbalanceOrig": 0.0,
          "oldbalanceDest": 0.0, "newbalanceDest": 9.5}
    raw = spark.createDataFrame(
        [(1, "2026-04-12T06:00:46.783950+00:00", json.dumps(tx), 0.4, "MEDIUM", 40, "HIGH", 70, 1,
          json.dumps(["one", "two"]), 3, json.dumps(alert))],
        "id long, created_at string, transaction_json string, ml_probability double,"
        " ml_risk_level string, ml_risk_score int, final_risk_level string,"
        " final_risk_score int, policy_override_applied int,"
        " policy_reasons_json string, suspicious_signal_count int, alert_json string")
    r = IO.decode_log(raw).first()
    assert [x.reason for x in r.alert.reasons] == ["one", "two"] == r.policy_reasons
    assert r.transaction.type == "TRANSFER" and r.created_at is not None
    again = IO.encode_log(IO.decode_log(raw)).first()
    assert json.loads(again.alert_json) == alert


def test_reuse_or_compute_only_when_absent(spark):
    import pytest
    d = _tmp()
    calls = []

    def compute():
        calls.append(1)
        return spark.range(3)

    assert IO.reuse_or_compute(spark, f"{d}/t", compute).count() == 3
    assert IO.reuse_or_compute(spark, f"{d}/t", compute).count() == 3
    assert len(calls) == 1
    os.makedirs(f"{d}/bad")
    with open(f"{d}/bad/part-0.parquet", "w") as fh:
        fh.write("not parquet")
    with pytest.raises(Exception, match="(?i)parquet"):
        IO.reuse_or_compute(spark, f"{d}/bad", compute).count()
    assert os.listdir(f"{d}/bad") == ["part-0.parquet"] and len(calls) == 1


def test_model_columns_roundtrip(spark):
    d = _tmp()
    df = spark.createDataFrame([(1, 2.0, 0, 0)], "step int, amount double, isFraud int, isFlaggedFraud int")
    IO.save_model_columns(df, f"{d}/columns")
    assert IO.load_model_columns(spark, f"{d}/columns") == ["step", "amount"]
    with open(f"{d}/shipped.json", "w") as fh:
        json.dump(["a", "b"], fh, indent=2)
    assert IO.load_model_columns(spark, f"{d}/shipped.json") == ["a", "b"]


def test_float32_training(spark):
    from txrisk.operators import models as ML
    f = C.features(spark, SF).select(*MODEL_COLUMNS, "isFraud")
    m = ML.fit(f, MODEL_COLUMNS, "logreg", float32=True)
    assert 0 <= ML.predict_proba(m, f).agg(F.avg("prob")).first()[0] <= 1


def test_checkpoint_folder_is_required_on_a_cluster(spark, monkeypatch):
    import pytest
    from txrisk import session

    class Context:
        master = "spark://host:7077"
        _jsc = spark.sparkContext._jsc

        def setCheckpointDir(self, d):
            raise AssertionError

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda *_: None)

    before = spark.sparkContext._jsc.sc().getCheckpointDir()
    if before.isDefined():
        class NoDir:
            isDefined = staticmethod(lambda: False)

        class Sc:
            getCheckpointDir = staticmethod(NoDir)

        class Jsc:
            sc = staticmethod(Sc)
        Context._jsc = Jsc()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Session())
