"""Shared lazily-built frames for the registered queries.

The fitted configuration is a handful of scalars plus a per-step table; it
is fitted once per (session, input folder) and reused, the way a served
model reuses its fitted config.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk.operators.config import FeatureConfig, fit_feature_config
from txrisk.operators.enrich import build_features
from txrisk.operators.scoring import audit_records, score
from txrisk.session import stored
from txrisk.sources import fixtures

_CONFIGS: dict = {}
_TX: dict = {}
_LOG_TABLES: dict = {}
_REPLAYED: dict = {}
MEMOS: list[dict] = [_CONFIGS, _TX, _LOG_TABLES, _REPLAYED]


def _key(spark: SparkSession, sf_dir: str):
    return (id(spark), spark.sparkContext.applicationId, sf_dir.rstrip("/"))


def tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _key(spark, sf_dir)
    if k not in _TX:
        _TX[k] = fixtures.transactions(spark, sf_dir)
    return _TX[k]


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with faults and repeated rows."""
    return fixtures.requests(spark, sf_dir, tx(spark, sf_dir))


def reset() -> None:
    """Forget everything fitted or stored so far (files changed, fair timings)."""
    for memo in MEMOS:
        memo.clear()


def config(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> FeatureConfig:
    """The fitted configuration. The fit reads its rows several times, so they are joined
    once and stored, or read from ``rows``, a stored table of all transactions."""
    k = _key(spark, sf_dir)
    if k not in _CONFIGS:
        if rows is None:
            rows = stored(tx(spark, sf_dir).select("step", "amount", "oldbalanceDest"), "config-rows")
        _CONFIGS[k] = fit_feature_config(rows)
    return _CONFIGS[k]


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tx_id, created_at, type, labels, prob, raw numerics and all features."""
    return build_features(tx(spark, sf_dir), config(spark, sf_dir))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(features(spark, sf_dir))


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_records(scored(spark, sf_dir))


def log_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prediction log as a stored table: scored once per session and input,
    appended to a Parquet table in the shared folder and read back. Monitoring
    queries read this table (as the dashboards read the log), so their
    filters and projections reach the Parquet scan instead of re-running the
    scoring chain."""
    from txrisk.schema import LOG_SCHEMA
    from txrisk.session import scratch_path
    from txrisk.sources import io as IO

    k = _key(spark, sf_dir)
    if k not in _LOG_TABLES:
        path = scratch_path(spark, "prediction_logs")
        IO.append_logs(logs(spark, sf_dir), path, writer="batch", batch_id=0, grain="month")
        _LOG_TABLES[k] = path
    return IO.read_logs(spark, _LOG_TABLES[k]).select(*[f.name for f in LOG_SCHEMA.fields])


def replayed_log(spark: SparkSession, sf_dir: str) -> str:
    """Path of the prediction log appended in two batches, the first one twice."""
    from txrisk.session import scratch_path
    from txrisk.sources import io as IO

    k = _key(spark, sf_dir)
    if k not in _REPLAYED:
        path, rows = scratch_path(spark, "replayed_logs"), log_table(spark, sf_dir)
        for batch in (0, 1, 0):
            IO.append_logs(rows.where(F.col("id") % 2 == batch), path, writer="batch", batch_id=batch,
                           grain="month")
        _REPLAYED[k] = path
    return _REPLAYED[k]
