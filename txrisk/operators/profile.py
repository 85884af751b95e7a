"""Profiling aggregates (A1-A17). Every operator is one or two aggregation
passes with map-side partial aggregation; results are small by construction
(bounded by #columns, #classes, #bins or #distinct keys of the grouping)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txrisk.functions.numeric import guarded_ratio
from txrisk.operators.quantiles import long_values, quantiles_by
from txrisk.session import stored


def row_count(df: DataFrame) -> DataFrame:
    """A1: rows and columns."""
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def describe(df: DataFrame, cols: list[str], group: str | None = None) -> DataFrame:
    """A4/A5: count, mean, sample std, min, quartiles (exact, linear), max per
    column (and group). Long form: one row per (group,) column."""
    keys = [*([group] if group else []), "column_name"]
    lv = long_values(df, cols, group)
    moments = lv.groupBy(*keys).agg(
        F.count("*").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"), F.max("v").alias("max"))
    q = quantiles_by(lv, keys, [0.25, 0.5, 0.75]).select(
        *keys, *[F.col("q")[i].alias(n) for i, n in enumerate(("p25", "p50", "p75"))])
    return moments.join(q, keys)


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Counts per value (sort by count desc, value for display)."""
    return df.groupBy(col).agg(F.count("*").alias("n"))


def value_shares(df: DataFrame, col: str) -> DataFrame:
    """Counts and percent of total (the total is a scalar subquery, so any
    number of distinct values stays distributed)."""
    vc = value_counts(df, col)
    vc = vc.withColumn("_tot", vc.agg(F.sum("n").cast("double").alias("t")).scalar())
    return vc.withColumn("pct", F.when(F.col("_tot") > 0, F.col("n").cast("double") * F.lit(100.0)
                                       / F.col("_tot")).otherwise(F.lit(0.0))).drop("_tot")


def crosstab(df: DataFrame, row: str, col: str, values: list, names: list[str]) -> DataFrame:
    """Counts of row x col with an explicit value list (no pivot discovery
    pass), zero-filled."""
    return df.groupBy(row).agg(*[
        F.count(F.when(F.col(col) == F.lit(v), F.lit(1))).alias(n) for v, n in zip(values, names)])


def crosstab_row_pct(ct: DataFrame, row: str, names: list[str]) -> DataFrame:
    """Each cell as percent of its row."""
    tot = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    return ct.select(row, *[(F.col(n).cast("double") * F.lit(100.0) / tot.cast("double"))
                            .alias(f"pct_{n}") for n in names])


def rate_by(df: DataFrame, key: str, label: str = "isFraud") -> DataFrame:
    """A10: label rate in percent per key."""
    return df.groupBy(key).agg((F.avg(label) * F.lit(100.0)).alias("fraud_rate_pct"))


def per_key_series(df: DataFrame, key: str = "step", label: str = "isFraud") -> DataFrame:
    """Rows and positives per key."""
    return df.groupBy(key).agg(F.count("*").alias("n_tx"), F.sum(label).cast("long").alias("n_fraud"))


def histogram(df: DataFrame, col: str, bins: int = 50, group: str | None = None) -> DataFrame:
    """Fixed equal-width bins over [min, max] (per group when given);
    the last bin is closed; empty bins are kept (zero-filled)."""
    keys = [group] if group else []
    x = F.col(col).cast("double")
    base = df.select(*keys, x.alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    rng = base.groupBy(*keys).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    if keys:
        rng = stored(rng, "ranges")  # one row per group, of known size
        j = base.join(rng, keys)
    else:
        j = base.withColumns({"lo": rng.select("lo").scalar(), "hi": rng.select("hi").scalar()})
    lo, hi = F.col("lo"), F.col("hi")
    width = hi - lo
    idx = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("x") - lo) * (F.lit(float(bins)) / width)), F.lit(bins - 1))
    ).cast("int")
    counts = j.groupBy(*keys, idx.alias("bin")).agg(F.count("*").alias("n"))
    grid = rng.select(*keys, "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    edges = grid.select(*keys, "bin",
                        (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("bin").cast("double")
                         / F.lit(float(bins))).alias("bin_start"))
    return (edges.join(counts, [*keys, "bin"], "left")
            .withColumn("n", F.coalesce(F.col("n"), F.lit(0).cast("long"))))


def boxplot_stats(df: DataFrame, cols: list[str], group: str) -> DataFrame:
    """Per (group, column): quartiles, IQR, whiskers (most extreme datum
    within 1.5 IQR of the box) and outlier count."""
    keys = [group, "column_name"]
    lv = long_values(df, cols, group)
    q = stored(quantiles_by(lv, keys, [0.25, 0.5, 0.75]).select(
        *keys, *[F.col("q")[i].alias(n) for i, n in enumerate(("q1", "median", "q3"))]), "boxes")
    j = lv.join(q, keys)
    iqr = F.col("q3") - F.col("q1")
    lo_f = F.col("q1") - F.lit(1.5) * iqr
    hi_f = F.col("q3") + F.lit(1.5) * iqr
    inside = (F.col("v") >= lo_f) & (F.col("v") <= hi_f)
    return j.groupBy(group, "column_name", "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("v"))).alias("whisker_high"),
        F.count(F.when(~inside, F.lit(1))).alias("n_outliers"),
    ).withColumn("iqr", F.col("q3") - F.col("q1"))


def co_moments(columns: list):
    """(n, mean, m2, co) of a batch's columns as k x k matrices over the rows that hold
    both columns: [i, j] is of column i (mean, m2), or of both (n, co)."""
    import numpy as np
    x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in columns]).astype(float)
    has = ~np.isnan(x)
    m = has.astype(float)
    shift = np.where(has, x, 0.0).sum(axis=0) / np.maximum(m.sum(axis=0), 1.0)
    y = np.where(has, x - shift, 0.0)            # about the mean, so that sums lose little
    n = m.T @ m
    below = np.maximum(n, 1.0)
    mean = (y.T @ m) / below
    m2 = np.maximum((y * y).T @ m - n * mean * mean, 0.0)
    return n, mean + shift[:, None], m2, y.T @ y - n * mean * mean.T


def merge_moments(a, b):
    """Moments of two disjoint sets of rows together."""
    import numpy as np
    n = a[0] + b[0]
    below = np.maximum(n, 1.0)
    d, share = b[1] - a[1], a[0] * b[0] / below
    mean = np.where(a[0] > 0, a[1], 0.0) * a[0] / below + np.where(b[0] > 0, b[1], 0.0) * b[0] / below
    return n, mean, a[2] + b[2] + d * d * share, a[3] + b[3] + d * d.T * share


def correlations(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Pearson correlation of many pairs in one pass, each over the rows that hold
    both (nulls and NaN are missing). A task merges the moments of its Arrow batches
    into one k x k table and sends that; the tables of all tasks meet and are merged
    one by one. A constant or empty column has no correlation (null)."""
    import numpy as np
    import pyarrow as pa
    names = sorted({c for p in pairs for c in p})
    k = len(names)
    schema = "moments array<double>"

    def task(batches):
        total = None
        for b in batches:
            if b.num_rows:
                now = co_moments(b.columns)
                total = now if total is None else merge_moments(total, now)
        if total is not None:
            yield pa.RecordBatch.from_pydict({"moments": [np.concatenate([t.ravel() for t in total])]})

    def all_tasks(batches):
        total = None
        for b in batches:
            for row in b.column(0):
                now = tuple(np.asarray(row.values, float).reshape(4, k, k))
                total = now if total is None else merge_moments(total, now)
        n, _, m2, co = total if total is not None else np.zeros((4, k, k))
        out = {"col_a": [], "col_b": [], "corr": []}
        for a, b in pairs:
            i, j = names.index(a), names.index(b)
            den = float(np.sqrt(m2[i, j]) * np.sqrt(m2[j, i]))
            out["col_a"].append(a)
            out["col_b"].append(b)
            out["corr"].append(float(co[i, j]) / den if n[i, j] > 1 and den > 0 else None)
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema(
            [("col_a", pa.string()), ("col_b", pa.string()), ("corr", pa.float64())]))

    parts = df.select(*[F.col(c).cast("double").alias(c) for c in names]).mapInArrow(task, schema)
    return parts.repartition(1).mapInArrow(all_tasks, "col_a string, col_b string, corr double")


def imbalance(df: DataFrame, label: str = "isFraud") -> DataFrame:
    """Negatives, positives and their rounded ratio (half to even)."""
    c = df.agg(F.count(F.when(F.col(label) == 0, 1)).alias("n_neg"),
               F.count(F.when(F.col(label) == 1, 1)).alias("n_pos"))
    return c.withColumn("ratio", F.rint(guarded_ratio(F.col("n_neg"), F.col("n_pos"))).cast("long"))


def mean_by(df: DataFrame, value: str, key: str) -> DataFrame:
    """Mean of value per key."""
    return df.groupBy(key).agg(F.avg(value).alias(f"avg_{value}"))


def head(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """The first n rows by ``key`` (top-k, no global sort)."""
    return df.orderBy(F.asc(key)).limit(n)


def tail(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """The last n rows by ``key``, in ascending order."""
    return df.orderBy(F.desc(key)).limit(n).orderBy(F.asc(key))
