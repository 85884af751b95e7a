"""Exact quantiles and hash-order sampling against brute force on small fixtures."""
import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from txrisk.operators import quantiles as Q
from txrisk.operators import sampling as SM


PROBS = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]


def _close(got, want):
    return all(a == b or math.isclose(a, b, rel_tol=1e-12) for a, b in zip(got, want, strict=True))


def _by(df, cols, probs, group=None):
    keys = [*([group] if group else []), "column_name"]
    q = Q.quantiles_by(Q.long_values(df, cols, group), keys, probs)
    return {tuple(r[k] for k in keys): (r["n"], r["q"]) for r in q.collect()}


def test_quantiles_match_numpy_with_skew(spark):
    """Populations above and below the size that is its own bracket; one value
    holds a third of the rows."""
    rnd = random.Random(3)
    for size in (7, 3999, 4001, 30_000):
        vals = [42.0] * (size // 3) + [rnd.lognormvariate(8, 2) for _ in range(size - size // 3)]
        rnd.shuffle(vals)
        df = spark.createDataFrame([(v, -v) for v in vals], "x double, y double")
        got = _by(df, ["x", "y"], PROBS)
        assert got[("x",)][0] == size
        assert _close(got[("x",)][1], list(np.quantile(np.array(vals), PROBS)))
        assert _close(got[("y",)][1], list(np.quantile(-np.array(vals), PROBS)))


def test_quantiles_of_many_groups(spark):
    rnd = random.Random(5)
    rows = [(g, rnd.gauss(0, 10 ** (g % 7))) for g in range(300) for _ in range(1 + g % 40)]
    rows += [(1000, rnd.random()) for _ in range(6000)]
    got = _by(spark.createDataFrame(rows, "g int, x double"), ["x"], [0.1, 0.5, 0.9], "g")
    assert len(got) == 301
    for (g, _), (n, q) in got.items():
        sub = np.array([v for h, v in rows if h == g])
        assert n == len(sub) and _close(q, list(np.quantile(sub, [0.1, 0.5, 0.9])))


def test_quantiles_with_infinities_and_huge_ranges(spark):
    inf = float("inf")
    vals = [-inf, -1e308, 1e-300, 0.0, 1e300, inf, inf]
    got = _by(spark.createDataFrame([(v,) for v in vals], "x double"), ["x"], [0.0, 0.5, 1.0])
    assert got[("x",)][1] == [-inf, 1e-300, inf]
    wide = [2.0 ** k for k in range(-1000, 1000)] * 3 + [inf] * 50
    got = _by(spark.createDataFrame([(v,) for v in wide], "x double"), ["x"], [0.25, 0.5])
    assert _close(got[("x",)][1], list(np.quantile(np.array(wide), [0.25, 0.5])))


def test_quantiles_ignore_null_and_nan(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (float("nan"), None), (3.0, None)],
                               "x double, y double")
    r = Q.quantile_row(df, {"mid": ("x", 0.5), "top": ("x", 1.0), "none": ("y", 0.5)}).first()
    assert (r.mid, r.top, r.none) == (2.0, 3.0, None)


def test_weighted_quantile_repeats_values_by_weight(spark):
    rnd = random.Random(1)
    counts = [(rnd.randint(1, 30),) for _ in range(101)]
    rows = [n for (n,) in counts for _ in range(n)]
    got = Q.weighted_quantile(spark.createDataFrame(counts, "n long"), "n", "n", 0.5, "m").first()[0]
    assert got == np.quantile(rows, 0.5)


def test_no_value_reaches_the_driver(spark, monkeypatch):
    """Building the plans collects nothing."""
    from pyspark.sql.classic.dataframe import DataFrame as Classic

    def refuse(*_a, **_k):
        raise AssertionError("collected")

    df = spark.range(9000).select(F.col("id").alias("tx_id"), (F.col("id") % 7).cast("int").alias("isFraud"))
    for name in ("collect", "first", "toPandas", "take", "head"):
        monkeypatch.setattr(Classic, name, refuse)
    plans = [Q.quantile_row(df, {"m": ("tx_id", 0.5)}), SM.sample_n(df, 50),
             SM.stratified_split(df, "isFraud", 0.2)]
    monkeypatch.undo()
    assert plans[0].first()[0] == 4499.5 and plans[1].count() == 50 and plans[2].count() == 9000


def _md5_order(ids, seed=42):
    return sorted(ids, key=lambda i: (hashlib.md5(f"{seed}|{i}".encode()).hexdigest(), i))


def test_sample_n_is_first_n_by_hash(spark):
    df = spark.range(5000).withColumnRenamed("id", "tx_id")
    got = sorted(r[0] for r in SM.sample_n(df, 700).collect())
    assert got == sorted(_md5_order(range(5000))[:700])
    assert SM.sample_n(df, 10_000).count() == 5000


def test_undersample_exact(spark):
    df = spark.range(4000).select(F.col("id").alias("tx_id"),
                                  (F.col("id") % 40 == 0).cast("int").alias("isFraud"))
    got = SM.undersample(df, "isFraud", ratio=5)
    rows = got.collect()
    pos = [r.tx_id for r in rows if r.isFraud == 1]
    neg = sorted(r.tx_id for r in rows if r.isFraud == 0)
    assert len(pos) == 100
    all_neg = [i for i in range(4000) if i % 40 != 0]
    assert neg == sorted(_md5_order(all_neg)[:500])


def test_stratified_split_sizes(spark):
    df = spark.range(1003).select(F.col("id").alias("tx_id"),
                                  (F.col("id") % 10 == 0).cast("int").alias("isFraud"))
    s = SM.stratified_split(df, "isFraud", 0.2)
    c = {(r.isFraud, r.split): r["count"] for r in s.groupBy("isFraud", "split").count().collect()}
    sizes = spark.createDataFrame([("0", 902), ("1", 101)], "_g string, n long")
    k = {r["_g"]: r["k"] for r in SM.class_test_sizes(sizes, 0.2).collect()}
    assert sum(k.values()) == math.ceil(0.2 * 1003)
    assert c[(0, "test")] == k["0"] and c[(1, "test")] == k["1"]
    test1 = sorted(r.tx_id for r in s.where("split = 'test' AND isFraud = 1").collect())
    assert test1 == sorted(_md5_order([i for i in range(1003) if i % 10 == 0])[:k["1"]])


def test_undersample_keeps_rows_of_an_id_together_and_joins_no_wide_rows(spark):
    one = spark.range(400).select((F.col("id") % 200).alias("tx_id"), F.lit("x").alias("wide"),
                                  (F.col("id") % 200 % 40 == 0).cast("int").alias("isFraud"))
    df = one.unionByName(one.limit(1).select(F.lit(None).cast("long").alias("tx_id"), "wide", "isFraud"))
    got = SM.undersample(df, "isFraud", ratio=5)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan
    rows = got.collect()
    neg = [r.tx_id for r in rows if r.isFraud == 0]
    first = _md5_order(i for i in range(200) if i % 40)[:28]       # 5 x 11 rows, the last id whole
    assert sorted(neg) == sorted(2 * first) and len(rows) == 66    # a null id counts, but is not chosen


def test_held_out_rows_are_not_written_again(spark, monkeypatch):
    from txrisk.operators import sampling
    from txrisk.plans import context, q_models

    names = []

    def noted(module):
        kept = module.stored
        monkeypatch.setattr(module, "stored", lambda df, name: (names.append(name), kept(df, name))[1])

    noted(q_models)
    noted(sampling)
    context.reset()
    sf = "/root/testdata/sf0.001"
    train, test = q_models.halves(spark, sf)
    assert names == ["features", "sample-cuts"]
    every = q_models.rows(spark, sf)
    assert train.unionByName(test).exceptAll(every).count() == 0 and train.count() + test.count() == every.count()
    q_models.split(spark, sf)
    assert names == ["features", "sample-cuts", "sample-cuts", "train"]
    context.reset()
