"""Query registry: name -> Spark builder, and name -> DuckDB oracle SQL."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a Spark query (spark, sf_dir) -> DataFrame and its oracle SQL.

    ``sql=None`` marks an operator with no SQL twin (models, streaming,
    sinks); the driver then checks rows only.
    """
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def prepare(spark: SparkSession) -> None:
    """Session settings the queries rely on: UTC session time (timestamps are
    compared with a zone-less engine) and a checkpoint folder (the cluster's
    ``spark.checkpoint.dir``; a scratch folder only when it is unset)."""
    from txrisk.session import checkpoint_dir
    if spark.conf.get("spark.sql.session.timeZone", "UTC") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    checkpoint_dir(spark)


def load_all() -> None:
    # importing the modules registers their queries
    from txrisk.plans import (q_core, q_eval, q_explain, q_models, q_monitor,  # noqa: F401
                              q_profile, q_stream)
