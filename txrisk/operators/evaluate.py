"""Model evaluation on a scored frame.

Curves need cumulative counts over distinct scores in descending order. A
single un-partitioned window over all distinct scores would run in one task, so the
prefix sums are two-level: distinct scores are range-partitioned and stored with
their range number, range totals are prefix-summed (one row per range), and running
sums use a window per range. Threshold sweeps bucket each row once by sweep interval
and suffix-sum a table of #thresholds + 1 rows instead of rescanning per threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txrisk.functions.numeric import guarded_ratio, py_round
from txrisk.session import stored


def sweep_thresholds(start: float = 0.1, stop: float = 0.9, step: float = 0.05) -> list[float]:
    """numpy.arange(start, stop, step): value i = start + i * ((start + step) - start)."""
    import math
    n = math.ceil((stop - start) / step)
    delta = (start + step) - start
    return [start + i * delta for i in range(n)]


def confusion_counts(df: DataFrame, score: str = "prob", label: str = "isFraud",
                     threshold: float | Column = 0.5) -> DataFrame:
    """Tn, fp, fn, tp at score >= threshold (a number or a scalar column)."""
    pred = F.col(score) >= (threshold if isinstance(threshold, Column) else F.lit(threshold))
    y = F.col(label) == 1
    return df.agg(
        F.count(F.when(~pred & ~y, 1)).alias("tn"), F.count(F.when(pred & ~y, 1)).alias("fp"),
        F.count(F.when(~pred & y, 1)).alias("fn"), F.count(F.when(pred & y, 1)).alias("tp"))


def with_rates(cm: DataFrame) -> DataFrame:
    """precision, recall, f1, accuracy, fpr with 0 on an empty denominator."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return cm.withColumns({
        "precision": guarded_ratio(tp, tp + fp),
        "recall": guarded_ratio(tp, tp + fn),
        "f1": guarded_ratio(F.lit(2) * tp, F.lit(2) * tp + fp + fn),
        "accuracy": guarded_ratio(tp + tn, tp + tn + fp + fn),
        "false_positive_rate": guarded_ratio(fp, fp + tn),
    })


def ranged_scores(df: DataFrame, score: str = "prob", label: str = "isFraud",
                  ranges: int | None = None) -> DataFrame:
    """Stored table of the distinct scores: s, pos, neg and b, the number of the
    score range, descending. Ranges hold about as many distinct scores each."""
    g = df.groupBy(F.col(score).cast("double").alias("s")).agg(
        F.sum(F.col(label)).cast("long").alias("pos"),
        (F.count("*") - F.sum(F.col(label))).cast("long").alias("neg"))
    order = F.desc("s")
    g = g.repartitionByRange(ranges, order) if ranges else g.repartitionByRange(order)
    return stored(g.withColumn("b", F.spark_partition_id()), "scores")


def cumulative_by_score(df: DataFrame, score: str = "prob", label: str = "isFraud",
                        ranges: int | None = None) -> DataFrame:
    """One row per distinct score s: pos, neg at s; tp, fp = positives and
    negatives with score >= s; P, N totals."""
    return _cumulative(ranged_scores(df, score, label, ranges))


def _cumulative(g: DataFrame) -> DataFrame:
    bt = g.groupBy("b").agg(F.sum("pos").alias("bpos"), F.sum("neg").alias("bneg"))
    before = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    off = bt.select(
        "b",
        F.coalesce(F.sum("bpos").over(before), F.lit(0)).alias("off_pos"),
        F.coalesce(F.sum("bneg").over(before), F.lit(0)).alias("off_neg"),
        F.sum("bpos").over(everything).alias("P"),
        F.sum("bneg").over(everything).alias("N"))
    run = Window.partitionBy("b").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    inside = g.select("b", "s", "pos", "neg", F.sum("pos").over(run).alias("rpos"),
                      F.sum("neg").over(run).alias("rneg"))
    return (inside.join(off, "b")
            .select("s", "pos", "neg", (F.col("off_pos") + F.col("rpos")).cast("long").alias("tp"),
                    (F.col("off_neg") + F.col("rneg")).cast("long").alias("fp"),
                    F.col("P").cast("long").alias("P"), F.col("N").cast("long").alias("N")))


def roc_curve(cum: DataFrame) -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score."""
    return cum.select(F.col("s").alias("threshold"),
                      guarded_ratio(F.col("fp"), F.col("N")).alias("fpr"),
                      guarded_ratio(F.col("tp"), F.col("P")).alias("tpr"))


def pr_curve(cum: DataFrame) -> DataFrame:
    """(threshold, precision, recall) at every distinct score."""
    return cum.select(F.col("s").alias("threshold"),
                      guarded_ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
                      guarded_ratio(F.col("tp"), F.col("P")).alias("recall"))


def _next_steps(g: DataFrame) -> DataFrame:
    """``ranged_scores`` with next_pos and next_neg, the counts at the next lower score
    (null at the lowest). The next score of a range's last one is the first of the next
    range, from a table of one row per range."""
    step = F.struct("pos", "neg")
    firsts = g.groupBy("b").agg(F.max_by(step, "s").alias("first"))
    border = stored(firsts.select("b", F.lead("first").over(Window.orderBy("b")).alias("border")), "score-borders")
    inside = g.withColumn("_next", F.lead(step).over(Window.partitionBy("b").orderBy(F.desc("s"))))
    n = F.coalesce(F.col("_next"), F.col("border"))
    return inside.join(border, "b").select("s", n["pos"].alias("next_pos"), n["neg"].alias("next_neg"))


def roc_points(df: DataFrame, score: str = "prob", label: str = "isFraud",
               ranges: int | None = None) -> DataFrame:
    """E2 as plotted: (threshold, fpr, tpr) from (infinity, 0, 0) on, without the points
    between which the line goes straight on. A point is left out if the next one is
    as many positives and negatives away as it is from the last; the highest and the
    lowest score stay."""
    g = ranged_scores(df, score, label, ranges)
    cum = _cumulative(g).join(_next_steps(g), "s")
    first = (F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))
    turn = F.coalesce((F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg")), F.lit(True))
    start = df.sparkSession.range(1).select(F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"),
                                            F.lit(0.0).alias("tpr"))
    return start.unionByName(roc_curve(cum.where(first | turn)))


def pr_points(cum: DataFrame) -> DataFrame:
    """E3 as plotted: ``pr_curve`` closed by (no threshold, precision 1, recall 0)."""
    end = cum.sparkSession.range(1).select(F.lit(None).cast("double").alias("threshold"),
                                           F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return pr_curve(cum).unionByName(end)


def roc_auc(cum: DataFrame) -> DataFrame:
    """Trapezoidal area, ties counted half. The numerator is an exact
    integer sum: neg_s * (tp_s + tp_(s-)) = neg_s * (2 tp_s - pos_s)."""
    num = F.sum((F.col("neg").cast("decimal(38,0)")
                 * (F.lit(2) * F.col("tp") - F.col("pos")).cast("decimal(38,0)")))
    return cum.agg(num.cast("double").alias("num"), F.max("P").alias("P"), F.max("N").alias("N")) \
        .select(guarded_ratio(F.col("num"), F.lit(2.0) * F.col("P").cast("double")
                              * F.col("N").cast("double")).alias("roc_auc"))


def average_precision(cum: DataFrame) -> DataFrame:
    """Sum over thresholds of (R_n - R_(n-1)) * P_n (step-wise, not the
    trapezoid MLlib's areaUnderPR uses)."""
    term = F.col("pos").cast("double") * F.col("tp").cast("double") \
        / (F.col("tp") + F.col("fp")).cast("double")
    return cum.agg(F.sum(term).alias("t"), F.max("P").alias("P")) \
        .select(guarded_ratio(F.col("t"), F.col("P")).alias("average_precision"))


def with_areas(one_row: DataFrame, cum: DataFrame) -> DataFrame:
    """Adds roc_auc and pr_auc (scalar subqueries, one aggregation over the curve)
    to a one-row frame."""
    return one_row.withColumns({"roc_auc": roc_auc(cum).scalar(),
                                "pr_auc": average_precision(cum).scalar()})


def threshold_sweep(df: DataFrame, thresholds: list[float], score: str = "prob",
                    label: str = "isFraud") -> DataFrame:
    """Counts and metrics at each threshold; thresholds with no predicted
    positive are omitted. One scan: each row is tagged with how many
    thresholds it reaches; suffix sums over that tiny table give the counts."""
    s = F.col(score)
    reach = sum((s >= F.lit(t)).cast("int") for t in thresholds)
    g = df.groupBy(reach.alias("idx")).agg(
        F.sum(F.col(label)).cast("long").alias("pos"),
        (F.count("*") - F.sum(F.col(label))).cast("long").alias("neg"))
    m = len(thresholds)
    grid = g.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")).select(
        "P", "N", F.explode(F.sequence(F.lit(1), F.lit(m))).alias("idx"))
    suffix = Window.orderBy(F.desc("idx")).rowsBetween(Window.unboundedPreceding, 0)
    t_of = F.element_at(F.array(*[F.lit(t) for t in thresholds]), F.col("idx"))
    full = grid.join(g, "idx", "left").select(
        "idx", "P", "N",
        F.coalesce(F.col("pos"), F.lit(0)).alias("pos"), F.coalesce(F.col("neg"), F.lit(0)).alias("neg"))
    cum = full.select(
        t_of.alias("threshold"),
        F.sum("pos").over(suffix).cast("long").alias("tp"),
        F.sum("neg").over(suffix).cast("long").alias("fp"), "P", "N")
    cum = cum.withColumns({"fn": F.col("P") - F.col("tp"), "tn": F.col("N") - F.col("fp")})
    return with_rates(cum.where((F.col("tp") + F.col("fp")) > 0)).drop("P", "N")


def sweep_report(sweep: DataFrame) -> DataFrame:
    """Rounded as reported: threshold 2 places, metrics 4 places."""
    return sweep.select(py_round(F.col("threshold"), 2).alias("threshold"),
                        py_round(F.col("precision"), 4).alias("precision"),
                        py_round(F.col("recall"), 4).alias("recall"),
                        py_round(F.col("f1"), 4).alias("f1"), "tp", "fp")


def best_by_f1(report: DataFrame) -> DataFrame:
    """First threshold with the highest (rounded) F1."""
    return report.orderBy(F.desc("f1"), F.asc("threshold")).limit(1)


def classification_report(cm: DataFrame) -> DataFrame:
    """Per class precision/recall/f1/support, accuracy, macro and weighted avg."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    r = cm.select(
        guarded_ratio(tn, tn + fn).alias("p0"), guarded_ratio(tn, tn + fp).alias("r0"),
        guarded_ratio(F.lit(2) * tn, F.lit(2) * tn + fn + fp).alias("f0"), (tn + fp).alias("s0"),
        guarded_ratio(tp, tp + fp).alias("p1"), guarded_ratio(tp, tp + fn).alias("r1"),
        guarded_ratio(F.lit(2) * tp, F.lit(2) * tp + fp + fn).alias("f1"), (tp + fn).alias("s1"),
        guarded_ratio(tp + tn, tp + tn + fp + fn).alias("acc"))
    n = F.col("s0") + F.col("s1")

    def wavg(a, b):
        return (F.col(a) * F.col("s0").cast("double") + F.col(b) * F.col("s1").cast("double")) \
            / n.cast("double")

    def row(label, p, rc, f, sup):
        return F.struct(F.lit(label).alias("label"), p.cast("double").alias("precision"),
                        rc.cast("double").alias("recall"), f.cast("double").alias("f1"),
                        sup.cast("long").alias("support"))

    none = F.lit(None)
    rows = [
        row("0", F.col("p0"), F.col("r0"), F.col("f0"), F.col("s0")),
        row("1", F.col("p1"), F.col("r1"), F.col("f1"), F.col("s1")),
        row("accuracy", none, none, F.col("acc"), n),
        row("macro avg", (F.col("p0") + F.col("p1")) / F.lit(2.0),
            (F.col("r0") + F.col("r1")) / F.lit(2.0), (F.col("f0") + F.col("f1")) / F.lit(2.0), n),
        row("weighted avg", wavg("p0", "p1"), wavg("r0", "r1"), wavg("f0", "f1"), n),
    ]
    return r.select(F.explode(F.array(*rows)).alias("x")).select("x.*")
