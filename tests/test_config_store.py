import random
import tempfile

from pyspark.sql import functions as F

from txrisk.operators.config import fit_feature_config
from txrisk.operators.config_store import ConfigStore

SCHEMA = "tx_id long, step int, amount double, oldbalanceDest double"


def _tx(spark, rng, n, scale=1.0):
    rows = [(i, rng.randint(0, 30), None if rng.random() < 0.02 else round(scale * rng.lognormvariate(3, 1), 2),
             rng.choice([0.0, 0.0, float("nan"), 5.0, rng.random() * 100])) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def _same(a, b):
    assert (a.large_threshold_p95, a.median_oldbalanceDest, a.step_bins, a.median_transactions_in_step) == \
        (b.large_threshold_p95, b.median_oldbalanceDest, b.step_bins, b.median_transactions_in_step)
    assert sorted(map(tuple, a.step_counts.collect())) == sorted(map(tuple, b.step_counts.collect()))


def _store(spark, **kw):
    return ConfigStore(spark, tempfile.mkdtemp(prefix="txrisk-config-", dir="/tmp"), **kw)


def test_parts_equal_the_whole(spark):
    rng = random.Random(9)
    store = _store(spark, block=16)
    parts = {f"d{i}": _tx(spark, rng, n, s) for i, (n, s) in enumerate([(400, 1), (300, 1), (7, 50), (1, 1)])}
    whole = None
    for name, tx in parts.items():
        store.put(tx, name)
        whole = tx if whole is None else whole.unionByName(tx)
        _same(store.fit(), fit_feature_config(whole))
    parts["d1"] = _tx(spark, rng, 350, 3.0)                # a part comes again, changed
    store.put(parts["d1"], "d1")
    whole = parts["d0"].unionByName(parts["d1"]).unionByName(parts["d2"]).unionByName(parts["d3"])
    _same(store.fit(), fit_feature_config(whole))


def test_a_refit_reads_few_values(spark):
    store = _store(spark, block=64)
    for day in range(3):
        tx = spark.range(20_000).select(
            F.col("id").alias("tx_id"), (F.col("id") % 50).cast("int").alias("step"),
            (F.pmod(F.xxhash64("id", F.lit(day)), F.lit(10**9)) / 7).alias("amount"),
            (F.pmod(F.xxhash64("id", F.lit(day + 10)), F.lit(10**9)) / 3).alias("oldbalanceDest"))
        store.put(tx, f"d{day}")
    b = store.brackets()
    # of 120,000 values, a few blocks of each day at either rank
    assert store.bracket_values(b).count() <= 3 * 2 * 4 * 64
    for r in b.collect():
        assert r["below"] <= r["k"] and r["lo"] <= r["hi"]


def test_one_value_and_empty_part(spark):
    store = _store(spark)
    tx = spark.createDataFrame([(1, 3, 7.0, 2.0)] * 9, SCHEMA)
    store.put(tx, "a")
    store.put(tx.limit(0), "b")
    _same(store.fit(), fit_feature_config(tx))
