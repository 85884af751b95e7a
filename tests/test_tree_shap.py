import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from txrisk.operators import boosting as B
from txrisk.operators import explain as X
from txrisk.operators import models as ML
from txrisk.operators import tree_shap as T

SF = "/root/testdata/sf0.001"


def _random_tree(rng, n_features, depth, boosted=True):
    t = {k: [] for k in ("left", "right", "feat", "thr", "val", "cover")}

    def add(cover, level):
        at = len(t["left"])
        for k, v in (("left", -1), ("right", -1), ("feat", -1), ("thr", 0.0), ("val", rng.normal()),
                     ("cover", cover)):
            t[k].append(v)
        if level < depth and cover > 1 and rng.random() < 0.85:
            t["feat"][at], t["thr"][at] = int(rng.integers(n_features)), float(rng.normal())
            left = float(rng.integers(0, int(cover) + 1))      # shares of 0 and 1 occur
            t["left"][at] = add(left, level + 1)
            t["right"][at] = add(cover - left, level + 1)
        return at

    add(200.0, 0)
    return {**{k: np.array(v) for k, v in t.items()}, "w": float(rng.uniform(0.5, 2)), "boosted": boosted}


def _value(t, x, known, node=0):
    """Expected value with some features known: others by the share of training rows."""
    if t["left"][node] < 0:
        return t["val"][node]
    f, sides = t["feat"][node], (t["left"][node], t["right"][node])
    if f in known:
        return _value(t, x, known, sides[0] if x[f] <= t["thr"][node] else sides[1])
    c = t["cover"]
    return sum(c[s] / c[node] * _value(t, x, known, s) for s in sides if c[s]) if c[node] else 0.0


def _coalitions(t, x, n):
    out = np.zeros(n)
    for i in range(n):
        rest = [j for j in range(n) if j != i]
        for k in range(n):
            w = math.factorial(k) * math.factorial(n - 1 - k) / math.factorial(n)
            for s in itertools.combinations(rest, k):
                out[i] += w * (_value(t, x, {*s, i}) - _value(t, x, set(s)))
    return out


@pytest.mark.parametrize("bits", [0, 3, 8])
def test_against_all_coalitions(monkeypatch, bits):
    monkeypatch.setattr(T, "TABLE_BITS", bits)
    rng = np.random.default_rng(bits)
    n = 6
    for boosted in (True, False):
        trees = [_random_tree(rng, n, d, boosted) for d in (1, 3, 5, 7)]
        x = rng.normal(size=(12, n))
        shap = T.TreeShap(trees, n)
        got = shap.contributions(x)
        scale = 1.0 if boosted else 1 / sum(t["w"] for t in trees)
        want = np.array([sum(scale * t["w"] * _coalitions(t, row, n) for t in trees) for row in x])
        assert got == pytest.approx(want, abs=1e-9)
        full = [sum(scale * t["w"] * _value(t, row, set(range(n))) for t in trees) for row in x]
        assert shap.bias + got.sum(axis=1) == pytest.approx(full, abs=1e-9)


def _frame(spark):
    from txrisk.plans import context as C
    from txrisk.schema import MODEL_COLUMNS
    return C.features(spark, SF).select("tx_id", *MODEL_COLUMNS, "isFraud"), MODEL_COLUMNS


def _total(contrib):
    return contrib.groupBy("tx_id").agg((F.sum("contribution") + F.first("bias")).alias("t"))


def test_forest_adds_up_to_the_probability(spark):
    f, columns = _frame(spark)
    m = ML.fit(f, columns, ML.Preset("t", "rf", {"numTrees": 5, "maxDepth": 9, "seed": 1}))
    contrib = X.tree_contributions(f.limit(150), X.tree_tables(ML.classifier(m), spark), columns)
    both = _total(contrib).join(ML.predict_proba(m, f.limit(150)), "tx_id")
    assert both.select(F.max(F.abs(F.col("t") - F.col("prob")))).first()[0] < 1e-9
    bias = contrib.first()["bias"]
    assert 0 < bias < 0.5


def test_boosted_adds_up_to_the_margin_and_ranks(spark):
    f, columns = _frame(spark)
    m = B.fit(f, columns, B.Growth(5, 0.3, max_leaves=12, least_rows=5, bins=64))
    trees = X.tree_tables(m, spark)
    few = f.limit(80)
    contrib = X.tree_contributions(few, trees, columns)
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("t")))
    both = _total(contrib).join(ML.predict_proba(m, few), "tx_id")
    assert both.select(F.max(F.abs(p - F.col("prob")))).first()[0] < 1e-9
    paths = _total(X.forest_contributions(few, trees, columns)).join(ML.predict_proba(m, few), "tx_id")
    assert paths.select(F.max(F.abs(p - F.col("prob")))).first()[0] < 1e-9
    # the row-local ranking is the ranking of the long table
    want = {(r["tx_id"], r["direction"], r["feature"]): r["contribution"]
            for r in X.top_reasons(contrib, 3).collect()}
    got = X.reason_rows(few.select("tx_id", X.tree_reasons(spark, trees, columns, 3).alias("reasons")))
    assert {(r["tx_id"], r["direction"], r["feature"]): r["contribution"]
            for r in got.collect()} == pytest.approx(want, abs=1e-12)
