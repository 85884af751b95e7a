"""Feature configuration that is refitted without rescanning.

Each part of the transactions (a day, a batch) is put once: its distinct values of the
two columns that have quantiles, sorted and counted, in blocks of ``BLOCK``; one zone
row per block (smallest, largest, rows); and its rows per step. Putting a part again
replaces it.

A refit takes the exact order statistics from that. The zones of all parts enclose the
wanted rank: at most k values lie below the largest block start that at most k rows
can precede, and at least k + 2 up to the smallest block end that as many rows reach.
Blocks below the bracket are counted by their zones; only those that meet it are read.
Sketches would leave a small chance that the rank lies outside; zones leave none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from txrisk.operators.config import (FeatureConfig, median_rows_per_step, step_bins, step_counts)
from txrisk.operators.quantiles import _between, long_values
from txrisk.session import stored

#: Distinct values of a block.
BLOCK = 8192
VALUES = "column_name string, v double, n long, block long, part string"
ZONES = "column_name string, block long, lo double, hi double, n long, part string"
STEPS = "step int, n long, part string"


class ConfigStore:
    """Parts of the transactions under one folder."""

    def __init__(self, spark: SparkSession, path: str, p: float = 0.95, block: int = BLOCK):
        self.spark, self.path, self.block = spark, path.rstrip("/"), block
        self.wanted = {"amount": p, "oldbalanceDest": 0.5}

    def put(self, tx: DataFrame, part: str) -> None:
        """(Re)place one part. Zones come last: a part counts from then on."""
        counts = long_values(tx, list(self.wanted)).groupBy("column_name", "v").agg(F.count("*").alias("n"))
        at = F.monotonically_increasing_id()            # partition << 33 | row of it
        block = F.shiftright(at, 33) * (1 << 33) + F.floor(at.bitwiseAND((1 << 33) - 1) / self.block)
        values = (counts.repartitionByRange("column_name", "v").sortWithinPartitions("column_name", "v")
                  .withColumn("block", block.cast("long")))
        where = f"{self.path}/{{}}/part={part}"
        # small row groups, sorted: a range of values is few of them
        values.write.mode("overwrite").option("parquet.block.size", 1 << 20).parquet(where.format("values"))
        step_counts(tx).select(F.col("step").cast("int").alias("step"), "n").write.mode("overwrite").parquet(
            where.format("steps"))
        written = self.spark.read.schema("column_name string, v double, n long, block long").parquet(
            where.format("values"))
        written.groupBy("column_name", "block").agg(
            F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("n").alias("n")).coalesce(1).write.mode(
            "overwrite").parquet(where.format("zones"))

    def _table(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def zones(self) -> DataFrame:
        return self._table("zones", ZONES)

    def brackets(self) -> DataFrame:
        """column_name, n, k (rank of the lower order statistic), d (share of the next),
        lo, hi (the bracket) and below (rows of the blocks under it); a row a column."""
        z, by = self.zones(), Window.partitionBy("column_name")
        total = z.groupBy("column_name").agg(F.sum("n").alias("n"))
        share = F.lit(None).cast("double")
        for c, p in self.wanted.items():
            share = F.when(F.col("column_name") == c, F.lit(p)).otherwise(share)
        total = total.withColumn("_pos", share * (F.col("n") - 1)).select(
            "column_name", "n", F.floor("_pos").alias("k"), (F.col("_pos") - F.floor("_pos")).alias("d"))
        up = z.groupBy("column_name", "hi").agg(F.sum("n").alias("c")).withColumn(
            "upto", F.sum("c").over(by.orderBy("hi"))).join(total, "column_name")
        hi = up.where(F.col("upto") >= F.least(F.col("k") + 2, F.col("n"))).groupBy("column_name").agg(
            F.min("hi").alias("hi"))
        down = z.groupBy("column_name", "lo").agg(F.sum("n").alias("c")).withColumn(
            "before", F.sum("c").over(by.orderBy("lo")) - F.col("c")).join(total, "column_name")
        lo = down.where(F.col("before") <= F.col("k")).groupBy("column_name").agg(F.max("lo").alias("lo"))
        b = total.join(lo, "column_name").join(hi, "column_name")
        under = z.select("column_name", F.col("hi").alias("_end"), F.col("n").alias("_n")).join(
            b.select("column_name", "lo"), "column_name").where(F.col("_end") < F.col("lo"))
        return b.join(under.groupBy("column_name").agg(F.sum("_n").alias("below")), "column_name", "left").select(
            "column_name", "n", "k", "d", "lo", "hi", F.coalesce("below", F.lit(0)).alias("below"))

    def bracket_values(self, brackets: DataFrame) -> DataFrame:
        """Distinct values and counts of the blocks that meet a column's bracket."""
        rows = brackets.collect()                       # one per column
        z, v = self.zones(), self._table("values", VALUES)
        meets = F.lit(False)
        for r in rows:
            meets = meets | ((F.col("column_name") == r["column_name"]) & (F.col("hi") >= r["lo"])
                             & (F.col("lo") <= r["hi"]))
        blocks = stored(z.where(meets).select("part", "column_name", "block", "lo", "hi"), "bracket-blocks")
        ends = {r["column_name"]: r for r in blocks.groupBy("column_name").agg(
            F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()}
        near = F.lit(False)                             # reaches the scan: row groups outside are skipped
        for c, r in ends.items():
            near = near | ((F.col("column_name") == c) & (F.col("v") >= r["lo"]) & (F.col("v") <= r["hi"]))
        return v.where(near).join(blocks.drop("lo", "hi"), ["part", "column_name", "block"], "left_semi")

    def quantiles(self) -> dict:
        """{column: exact quantile}; none for a column without values."""
        b = stored(self.brackets(), "brackets")
        inside = self.bracket_values(b).groupBy("column_name", "v").agg(F.sum("n").alias("c"))
        upto = F.sum("c").over(Window.partitionBy("column_name").orderBy("v"))
        run = inside.withColumn("upto", upto).join(b, "column_name").withColumn(
            "upto", F.col("upto") + F.col("below"))
        got = run.groupBy("column_name", "d").agg(
            F.min(F.when(F.col("upto") > F.col("k"), F.col("v"))).alias("a"),
            F.min(F.when(F.col("upto") > F.col("k") + 1, F.col("v"))).alias("b"))
        return {r["column_name"]: r["q"] for r in got.select(
            "column_name", _between(F.col("a"), F.coalesce("b", "a"), F.col("d")).alias("q")).collect()}

    def fit(self) -> FeatureConfig:
        """C6, equal to ``fit_feature_config`` of all parts together."""
        counts = stored(self._table("steps", STEPS).groupBy("step").agg(F.sum("n").alias("n")), "step-counts")
        q = self.quantiles()
        s = counts.agg(F.max("step").alias("last")).select(
            "last", median_rows_per_step(counts).scalar().alias("median")).first()
        return FeatureConfig(q.get("amount"), q.get("oldbalanceDest"), step_bins(s["last"]), s["median"], counts)
