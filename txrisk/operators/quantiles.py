"""Exact quantiles as one DataFrame plan, the same at every size.

Spark's exact ``percentile`` keeps every distinct value of a group in one
buffer. Here each quantile takes two scans with map-side aggregation:

1. ``percentile_approx`` gives, per population, two values that certainly
   enclose the wanted order statistics (its rank error is n / ACCURACY, the
   bracket is MARGIN * n ranks wide on both sides). A population of at most
   ``OWN_BRACKET`` values, where so narrow a margin is less than a few ranks, is
   enclosed by its minimum and maximum.
2. Values below the bracket are only counted; those inside are counted per
   distinct value, so a value that a third of all rows hold is one row. A
   running count over the distinct values of the bracket (a share of 2 * MARGIN
   of the population) picks the order statistics.

No value reaches the driver. The brackets, one row per population, are stored,
so the planner knows their size when it joins them. The definition is the
linear one (``quantile_cont`` / numpy's default): position p * (n - 1) between two
neighbouring order statistics. Nulls and NaN are ignored; infinities count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txrisk.session import stored

ACCURACY = 10_000
MARGIN = 1e-3
OWN_BRACKET = 4_000


def long_values(df: DataFrame, cols: list[str], group: str | None = None) -> DataFrame:
    """Unpivot to (group,) column_name, v without nulls and NaN."""
    items = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in cols]
    keys = [group] if group else []
    return (df.select(*keys, F.explode(F.array(*items)).alias("x")).select(*keys, "x.*")
            .where(F.col("v").isNotNull() & ~F.isnan("v")))


def _between(a: Column, b: Column, d: Column) -> Column:
    return F.when((d == 0) | (a == b), a).otherwise(a + (b - a) * d)


def quantiles_by(values: DataFrame, keys: list[str], probs: list[float]) -> DataFrame:
    """``keys``, n and q (array of the quantiles ``probs``) per population of a
    frame with a non-null, non-NaN double column v."""
    m = len(probs)
    marks = [max(0.0, p - MARGIN) for p in probs] + [min(1.0, p + MARGIN) for p in probs]
    found = values.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"),
        F.percentile_approx("v", marks, ACCURACY).alias("marks"))
    own = F.col("n") <= OWN_BRACKET
    brackets = stored(found.select(*keys, "n", F.explode(F.array(*[F.struct(
        F.lit(i).alias("i"), F.lit(p).alias("p"),
        F.when(own, F.col("least")).otherwise(F.col("marks")[i]).alias("lo"),
        F.when(own, F.col("most")).otherwise(F.col("marks")[m + i]).alias("hi"))
        for i, p in enumerate(probs)])).alias("b")).select(*keys, "n", "b.*"), "brackets")
    # a null v stands for all values below the bracket
    counts = (values.join(brackets, keys).where(F.col("v") <= F.col("hi"))
              .groupBy(*keys, "i", "p", "n", F.when(F.col("v") >= F.col("lo"), F.col("v")).alias("v"))
              .agg(F.count("*").alias("c")))
    running = F.sum("c").over(Window.partitionBy(*keys, "i").orderBy(F.col("v").asc_nulls_first()))
    pos = F.col("p") * (F.col("n") - 1)
    rank = F.floor(pos)
    picked = (counts.withColumn("upto", running).groupBy(*keys, "i", "p", "n").agg(
        F.max(F.when(F.col("v").isNull(), F.col("upto"))).alias("below"),
        F.min(F.when(F.col("upto") > rank, F.col("v"))).alias("a"),
        F.min(F.when(F.col("upto") > rank + 1, F.col("v"))).alias("b")))
    # below > rank cannot happen; checked because an answer would be wrong without notice
    value = F.when(F.coalesce(F.col("below"), F.lit(0)) <= rank, _between(
        F.col("a"), F.coalesce("b", "a"), pos - rank)).otherwise(
        F.raise_error(F.lit("quantile outside its bracket")).cast("double"))
    return (picked.select(*keys, "n", "i", value.alias("value")).groupBy(*keys, "n")
            .agg(*[F.max(F.when(F.col("i") == i, F.col("value"))).alias(f"q{i}") for i in range(m)])
            .select(*keys, "n", F.array(*[F.col(f"q{i}") for i in range(m)]).alias("q")))


def quantile_row(df: DataFrame, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """One row of quantiles: {name: (column, p)}; null for a column without values."""
    probs = sorted({p for _, p in wanted.values()})
    q = quantiles_by(long_values(df, sorted({c for c, _ in wanted.values()})), ["column_name"], probs)
    return q.agg(*[F.max(F.when(F.col("column_name") == c, F.col("q")[probs.index(p)])).alias(name)
                   for name, (c, p) in wanted.items()])


def weighted_quantile(counts: DataFrame, value: str, weight: str, p: float, name: str) -> DataFrame:
    """One row: the quantile of ``value`` where each row stands for ``weight`` rows.

    For per-key row counts: the distinct values number at most the square root of
    twice the rows, so their running count is small.
    """
    g = counts.groupBy(F.col(value).cast("double").alias("v")).agg(F.sum(weight).alias("c"))
    run = g.select("v", F.sum("c").over(Window.orderBy("v")).alias("upto"),
                   F.sum("c").over(Window.partitionBy()).alias("n"))
    rank = F.floor(F.lit(p) * (F.col("n") - 1))
    r = run.groupBy("n").agg(F.min(F.when(F.col("upto") > rank, F.col("v"))).alias("a"),
                             F.min(F.when(F.col("upto") > rank + 1, F.col("v"))).alias("b"))
    d = F.lit(p) * (F.col("n") - 1) - rank
    return r.select(_between(F.col("a"), F.coalesce("b", "a"), d).alias(name))
