"""Join helpers. No broadcast hints: the planner and AQE choose from sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame


def align_by_key(left: DataFrame, right: DataFrame, key: str = "tx_id") -> DataFrame:
    """Row alignment by an explicit key (the original aligned by position)."""
    return left.join(right, key, "inner")


def semi_select(df: DataFrame, ids: DataFrame, key: str = "tx_id") -> DataFrame:
    """Keep the rows of df whose key is in ids."""
    return df.join(ids.select(key), key, "left_semi")
