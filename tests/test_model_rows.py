"""Rows of the model queries: joined once, stored raw, features derived on reading."""

import pytest
from pyspark.sql import functions as F

from txrisk.operators.config import fit_feature_config
from txrisk.operators.enrich import build_features
from txrisk.plans import context, q_models
from txrisk.schema import MODEL_COLUMNS


@pytest.fixture
def tables(spark, tmp_path):
    """Orders with repeated and null keys, a customer that comes twice."""
    n = spark.range(600).select((F.col("id") % 590).alias("k"))
    orders = n.select(
        F.when(F.col("k") % 89 != 0, F.col("k")).alias("o_orderkey"), (F.col("k") % 41).alias("o_custkey"),
        (F.col("k") * 37 % 1000 * 300).cast("double").alias("o_totalprice"),
        F.expr("timestamp '1992-01-01' + make_interval(0, 0, 0, cast(k % 400 as int))").alias("o_orderdate"),
        F.element_at(F.array(*[F.lit(x) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")]),
                     (F.col("k") % 4 + 1).cast("int")).alias("o_orderpriority"))
    customer = spark.range(41).select((F.col("id") % 40).alias("c_custkey"), (F.col("id") * 91.5 - 300).alias("c_acctbal"))
    supplier = spark.range(10).select(F.col("id").alias("s_suppkey"), (F.col("id") * 800.25 - 900).alias("s_acctbal"))
    for name, df in (("orders", orders), ("customer", customer), ("supplier", supplier)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    context.reset()
    yield str(tmp_path)
    context.reset()


def test_rows_of_models_are_joined_once_and_stored_raw(spark, tables, monkeypatch):
    fitted = []
    monkeypatch.setattr(context, "fit_feature_config", lambda tx: (fitted.append(tx), fit_feature_config(tx))[1])
    kept = {}
    store = q_models.stored
    monkeypatch.setattr(q_models, "stored", lambda df, name: kept.setdefault(name, store(df, name)))
    train, test = q_models.split(spark, tables)
    assert len(fitted) == 1 and "Join" not in fitted[0]._jdf.queryExecution().optimizedPlan().toString()
    # stored without what is derived from it
    assert all("log_amount" not in kept[n].columns and len(kept[n].columns) < 12 for n in ("features", "train"))
    tx = context.tx(spark, tables)
    want = build_features(tx, fit_feature_config(tx)).select("tx_id", *MODEL_COLUMNS, "isFraud")
    got = q_models.rows(spark, tables)
    assert got.columns == want.columns and got.count() == want.count() > 500
    assert got.exceptAll(want).count() == 0 and train.columns == test.columns == want.columns
    assert train.unionByName(test).exceptAll(want).count() == 0


def test_configuration_is_fitted_on_rows_joined_once(spark, tables, monkeypatch):
    fitted = []
    monkeypatch.setattr(context, "fit_feature_config", lambda tx: (fitted.append(tx), fit_feature_config(tx))[1])
    got = context.config(spark, tables)
    assert "Join" not in fitted[0]._jdf.queryExecution().optimizedPlan().toString()
    want = fit_feature_config(context.tx(spark, tables))
    assert (got.large_threshold_p95, got.median_oldbalanceDest, got.step_bins, got.median_transactions_in_step) == (
        want.large_threshold_p95, want.median_oldbalanceDest, want.step_bins, want.median_transactions_in_step)
    assert sorted(map(tuple, got.step_counts.collect())) == sorted(map(tuple, want.step_counts.collect()))


def test_models_of_the_board_score_the_held_out_rows_in_one_pass(spark, tables, monkeypatch):
    from txrisk.operators import models as ML
    from txrisk.operators.boosting import Growth
    from txrisk.operators.forest import Forest

    small = {"random_forest": Forest(3, 3, least_rows=2, balanced=True), "gbt_400": Growth(3, 0.3, max_depth=3, lam=1.0),
             "gbt_600": Growth(3, 0.3, max_leaves=6, least_rows=5)}
    for name, growth in small.items():
        monkeypatch.setitem(ML.PRESETS, name, ML.Preset(name, ML.PRESETS[name].kind, {"growth": growth}))
    for memo in (q_models._MODELS, q_models._SPLITS):
        memo.clear()
    # one row per id: a split of repeated rows may take either
    spark.read.parquet(f"{tables}/orders.parquet").dropna().dropDuplicates(["o_orderkey"]).write.parquet(f"{tables}/one/orders.parquet")
    for name in ("customer", "supplier"):
        spark.read.parquet(f"{tables}/{name}.parquet").dropDuplicates(["c_custkey" if name == "customer" else "s_suppkey"]).write.parquet(
            f"{tables}/one/{name}.parquet")
    names, store = [], q_models.stored
    monkeypatch.setattr(q_models, "stored", lambda df, name: (names.append(name), store(df, name))[1])
    board = {r["model"]: r.asDict() for r in q_models.model_leaderboard(spark, f"{tables}/one").collect()}
    assert names.count("model-scores") == 1 and sorted(r["rank"] for r in board.values()) == [1, 2, 3, 4]
    for preset, row in board.items():
        alone = q_models._evaluate(spark, f"{tables}/one", preset).first().asDict()
        assert all(row[k] == (round(v, 4) if k in ("roc_auc", "pr_auc") else v) for k, v in alone.items())
