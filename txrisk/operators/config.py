"""Feature configuration: fit (C1-C6), save/load, and its table forms."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txrisk.operators.quantiles import quantile_row, weighted_quantile
from txrisk.session import stored

N_STEP_BINS = 6


@dataclass
class FeatureConfig:
    large_threshold_p95: float
    median_oldbalanceDest: float
    step_bins: list
    median_transactions_in_step: float
    step_counts: DataFrame  # step int, n long (one row per observed step)

    def to_row_df(self, spark: SparkSession) -> DataFrame:
        """One-row table of the scalar parts."""
        schema = T.StructType([
            T.StructField("large_threshold_p95", T.DoubleType()),
            T.StructField("median_oldbalanceDest", T.DoubleType()),
            T.StructField("step_bins", T.ArrayType(T.DoubleType())),
            T.StructField("median_transactions_in_step", T.DoubleType()),
        ])
        return spark.createDataFrame(
            [(float(self.large_threshold_p95), float(self.median_oldbalanceDest),
              [float(e) for e in self.step_bins], float(self.median_transactions_in_step))],
            schema)

    def save(self, path: str) -> None:
        """Scalars as a one-row JSON table, step counts as Parquet."""
        spark = self.step_counts.sparkSession
        self.to_row_df(spark).coalesce(1).write.mode("overwrite").json(f"{path}/scalars")
        self.step_counts.write.mode("overwrite").parquet(f"{path}/step_counts")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "FeatureConfig":
        row = spark.read.json(f"{path}/scalars").first()
        counts = spark.read.parquet(f"{path}/step_counts")
        return cls(row["large_threshold_p95"], row["median_oldbalanceDest"],
                   list(row["step_bins"]), row["median_transactions_in_step"], counts)

    @classmethod
    def from_json_file(cls, spark: SparkSession, path: str) -> "FeatureConfig":
        """Read a single JSON document in the original's config layout
        (``step_counts`` as an object of step -> count)."""
        doc = spark.read.option("multiLine", True).text(path, wholetext=True).first()[0]
        cfg = json.loads(doc)
        return cls.from_dict(spark, cfg)

    @classmethod
    def from_dict(cls, spark: SparkSession, cfg: dict) -> "FeatureConfig":
        counts = spark.createDataFrame(
            [(int(k), int(v)) for k, v in cfg["step_counts"].items()],
            "step int, n long")
        return cls(float(cfg["large_threshold_p95"]), float(cfg["median_oldbalanceDest"]),
                   [float(e) for e in cfg["step_bins"]],
                   float(cfg["median_transactions_in_step"]), counts)


def step_counts(tx: DataFrame) -> DataFrame:
    """Rows per step (partial aggregation; a hot step costs nothing extra)."""
    return tx.groupBy("step").agg(F.count("*").alias("n"))


def step_bins(max_step: float, n_bins: int = N_STEP_BINS) -> list[float]:
    """linspace(0, max, n_bins + 1): edge i = i * (max / n_bins), last = max."""
    width = float(max_step) / n_bins
    return [float(i) * width for i in range(n_bins)] + [float(max_step)]


def step_bins_df(tx: DataFrame, n_bins: int = N_STEP_BINS) -> DataFrame:
    """C5 as a query: one row per edge (i, edge) computed in Spark."""
    mx = tx.agg(F.max("step").cast("double").alias("m"))
    return (mx.select(F.explode(F.sequence(F.lit(0), F.lit(n_bins))).alias("i"), "m")
            .select("i", F.when(F.col("i") == n_bins, F.col("m"))
                    .otherwise(F.col("i").cast("double") * (F.col("m") / F.lit(float(n_bins))))
                    .alias("edge")))


def median_rows_per_step(counts: DataFrame) -> DataFrame:
    """C4: median of the per-step counts, unweighted over steps (one row)."""
    return weighted_quantile(counts.select("n", F.lit(1).alias("one")), "n", "one", 0.5,
                             "median_transactions_in_step")


def median_rows_weighted(counts: DataFrame) -> DataFrame:
    """C4': median of transactions_in_step over rows (training variant). A step of
    n rows holds the value n in n rows, so the per-step counts suffice."""
    return weighted_quantile(counts, "n", "n", 0.5, "median_transactions_in_step_rows")


def fit_feature_config(tx: DataFrame, p: float = 0.95) -> FeatureConfig:
    """All of the config from one transactions frame. The per-step counts are
    stored, so scoring never recomputes them; the driver reads one row of scalars."""
    counts = stored(step_counts(tx), "step-counts")
    q = quantile_row(tx, {"p95": ("amount", p), "dest": ("oldbalanceDest", 0.5)}).first()
    s = counts.agg(F.max("step").alias("last")).select(
        "last", median_rows_per_step(counts).scalar().alias("median")).first()
    return FeatureConfig(q["p95"], q["dest"], step_bins(s["last"]), s["median"], counts)
