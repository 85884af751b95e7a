"""Feature enrichment: raw transactions -> 29 model columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk.functions.features import feature_columns
from txrisk.operators.config import FeatureConfig
from txrisk.schema import MODEL_COLUMNS, RAW_NUMERIC


def velocity_join(tx: DataFrame, counts: DataFrame, out: str = "transactions_in_step") -> DataFrame:
    """Per-step count joined back to every row, 0 for unseen steps."""
    c = counts.select("step", F.col("n").alias(out))
    return tx.join(c, "step", "left").withColumn(out, F.coalesce(F.col(out), F.lit(0).cast("long")))


def build_features(tx: DataFrame, cfg: FeatureConfig, keep: list[str] | None = None) -> DataFrame:
    """Raw pass-through + derived features. ``keep`` lists extra columns to carry."""
    keep = keep if keep is not None else [c for c in tx.columns if c not in
                                          ("step", *RAW_NUMERIC)]
    c = cfg.step_counts.select("step", F.col("n").alias("_n_step"))
    joined = tx.join(c, "step", "left")
    feats = feature_columns(cfg.large_threshold_p95, cfg.median_oldbalanceDest,
                            cfg.step_bins, cfg.median_transactions_in_step)
    return joined.select(*keep, "step", *RAW_NUMERIC, *feats)


def align_to_model_columns(df: DataFrame, columns: list[str] = MODEL_COLUMNS,
                           keep: list[str] | None = None) -> DataFrame:
    """Same columns and order as training; missing -> 0, extras dropped."""
    have = set(df.columns)
    cols = [F.col(c) if c in have else F.lit(0).alias(c) for c in columns]
    return df.select(*(keep or []), *cols)
