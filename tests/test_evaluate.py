"""Curves, AUC, AP and the sweep against brute force (ties included)."""
import math
import random

import pytest
from pyspark.sql import functions as F

from txrisk.operators import evaluate as EV


def _data(n=600, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        y = 1 if rnd.random() < 0.2 else 0
        s = round(min(1.0, max(0.0, rnd.gauss(0.6 if y else 0.4, 0.2))), 2)  # many ties
        rows.append((i, s, y))
    return rows


def _auc_brute(rows):
    pos = [s for _, s, y in rows if y == 1]
    neg = [s for _, s, y in rows if y == 0]
    num = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg)
    return num / (len(pos) * len(neg))


def _ap_brute(rows):
    P = sum(y for _, _, y in rows)
    ap = 0.0
    for t in sorted({s for _, s, _ in rows}, reverse=True):
        tp = sum(1 for _, s, y in rows if s >= t and y == 1)
        fp = sum(1 for _, s, y in rows if s >= t and y == 0)
        pos_here = sum(1 for _, s, y in rows if s == t and y == 1)
        ap += pos_here / P * tp / (tp + fp)
    return ap


def test_auc_ap_against_brute_force(spark):
    rows = _data()
    df = spark.createDataFrame(rows, "tx_id long, prob double, isFraud int")
    cum = EV.cumulative_by_score(df, ranges=7)  # several ranges: exercise the two levels
    assert abs(EV.roc_auc(cum).first()[0] - _auc_brute(rows)) < 1e-12
    assert abs(EV.average_precision(cum).first()[0] - _ap_brute(rows)) < 1e-12
    got = {r.threshold: (r.fpr, r.tpr) for r in EV.roc_curve(cum).collect()}
    P = sum(y for *_, y in rows)
    N = len(rows) - P
    for t in list(got)[:20]:
        tp = sum(1 for _, s, y in rows if s >= t and y == 1)
        fp = sum(1 for _, s, y in rows if s >= t and y == 0)
        assert got[t] == (fp / N, tp / P)


def test_sweep_against_brute_force(spark):
    rows = _data(seed=5)
    df = spark.createDataFrame(rows, "tx_id long, prob double, isFraud int")
    ths = EV.sweep_thresholds()
    assert len(ths) == 16
    got = {round(r.threshold, 2): (r.tp, r.fp) for r in EV.threshold_sweep(df, ths).collect()}
    for t in ths:
        tp = sum(1 for _, s, y in rows if s >= t and y == 1)
        fp = sum(1 for _, s, y in rows if s >= t and y == 0)
        if tp + fp:
            assert got[round(t, 2)] == (tp, fp)
        else:
            assert round(t, 2) not in got


def test_sweep_omits_empty_and_point_precision_zero(spark):
    df = spark.createDataFrame([(1, 0.2, 1), (2, 0.3, 0)], "tx_id long, prob double, isFraud int")
    got = [round(r.threshold, 2) for r in EV.threshold_sweep(df, EV.sweep_thresholds()).collect()]
    assert max(got) < 0.35
    cm = EV.with_rates(EV.confusion_counts(df, threshold=0.9)).first()
    assert (cm.precision, cm.recall, cm.f1) == (0.0, 0.0, 0.0)


def test_classification_report_shape(spark):
    df = spark.createDataFrame(_data(), "tx_id long, prob double, isFraud int")
    rep = EV.classification_report(EV.confusion_counts(df)).collect()
    assert [r.label for r in rep] == ["0", "1", "accuracy", "macro avg", "weighted avg"]


def test_curve_ranges_stay_even_when_scores_crowd(spark):
    """99 % of the distinct scores below 1e-4."""
    rnd = random.Random(2)
    scores = [rnd.random() * 1e-4 for _ in range(9900)] + [rnd.random() for _ in range(100)]
    rows = [(i, s, int(rnd.random() < 0.1 + s / 2)) for i, s in enumerate(scores)]
    df = spark.createDataFrame(rows, "tx_id long, prob double, isFraud int")
    sizes = [r["count"] for r in EV.ranged_scores(df, ranges=8).groupBy("b").count().collect()]
    assert len(sizes) > 4 and max(sizes) <= 2 * sum(sizes) / len(sizes)
    cum = EV.cumulative_by_score(df, ranges=8)
    pos = sum(y for *_, y in rows)
    by = sorted(rows, key=lambda r: r[1])
    num = seen_neg = 0
    for _, _, y in by:                     # distinct scores: no ties
        if y:
            num += seen_neg
        else:
            seen_neg += 1
    assert abs(EV.roc_auc(cum).first()[0] - num / (pos * (len(rows) - pos))) < 1e-12


def test_report_at_a_threshold_column(spark):
    df = spark.createDataFrame([(1, 0.2, 0), (2, 0.6, 1), (3, 0.7, 0)], "tx_id long, prob double, isFraud int")
    best = df.agg(F.max("prob").alias("t")).scalar()
    cm = EV.confusion_counts(df, threshold=best).first()
    assert (cm.tn, cm.fp, cm.fn, cm.tp) == (1, 1, 1, 0)


def test_roc_points_leave_out_straight_lines(spark):
    rng = random.Random(4)
    rows = [(rng.randint(0, 60) / 60, int(rng.random() < 0.4)) for _ in range(400)]
    rows += [(2.0 + i, 0) for i in range(6)] + [(-1.0 - i, 1) for i in range(6)]    # straight runs
    df = spark.createDataFrame(rows, "prob double, isFraud int")
    P = sum(y for _, y in rows)
    N = len(rows) - P
    at = []
    for s in sorted({s for s, _ in rows}, reverse=True):
        at.append((s, sum(1 for t, y in rows if t >= s and not y), sum(1 for t, y in rows if t >= s and y)))
    keep = [at[0]] + [b for a, b, c in zip(at, at[1:], at[2:])
                      if b[1] - a[1] != c[1] - b[1] or b[2] - a[2] != c[2] - b[2]] + [at[-1]]
    want = [(math.inf, 0.0, 0.0)] + [(s, f / N, t / P) for s, f, t in keep]
    for ranges in (1, 3, 9):
        got = sorted(((r["threshold"], r["fpr"], r["tpr"]) for r in EV.roc_points(df, ranges=ranges).collect()),
                     reverse=True)
        assert len(got) == len(want)
        assert all(g == pytest.approx(w) for g, w in zip(got, want)), ranges
    assert len(want) < len(at) - 8
    closed = EV.pr_points(EV.cumulative_by_score(df)).collect()
    assert len(closed) == len(at) + 1
    assert [(r["precision"], r["recall"]) for r in closed if r["threshold"] is None] == [(1.0, 0.0)]


def test_correlations_merge_and_skip_missing(spark):
    import numpy as np
    import pandas as pd

    from txrisk.operators import profile as P
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 4))
    t = pd.DataFrame({"a": x[:, 0] + 1e6, "b": x[:, 0] * 2 + x[:, 1], "c": x[:, 2], "d": 1.0})
    t.loc[::7, "b"] = np.nan
    t.loc[3:40, "c"] = np.nan
    pairs = [("a", "b"), ("b", "a"), ("a", "c"), ("b", "c"), ("a", "d"), ("a", "a")]
    want = t.corr()
    df = spark.createDataFrame(t).repartition(5)
    df = df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in t.columns])
    for frame in (df, df.coalesce(1)):
        for r in P.correlations(frame, pairs).collect():
            if "d" in (r["col_a"], r["col_b"]):
                assert r["corr"] is None
            else:
                assert r["corr"] == pytest.approx(want.loc[r["col_a"], r["col_b"]], abs=1e-9)
    assert [r["corr"] for r in P.correlations(df.limit(0), pairs[:2]).collect()] == [None, None]
