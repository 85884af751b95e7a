"""Shared helpers: table access, stored intermediates, per-process caches."""

from __future__ import annotations

import functools
import sys
import types

from pyspark.sql import DataFrame, SparkSession

from txrisk.plans import registry
from txrisk.session import scratch_path

#: Bytes of a batch that goes to or comes from Python. Long texts and matrices make
#: batches of the default size (64 MB) large for workers that share a machine.
ARROW_BYTES = 4 << 20


def prepare(spark: SparkSession) -> None:
    """Session settings that the operators' queries rely on."""
    registry.prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    The stored copy cuts the lineage and is computed once; it lives where every
    executor can read it, so a lost executor costs only its running tasks.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def process_cache() -> dict:
    """A dictionary that lives as long as the Python worker process.

    Functions shipped by value get fresh globals in every task, so loaded
    tokenizers and lookup tables are kept here and shared by a worker's tasks.
    """
    mod = sys.modules.setdefault("_txrisk_llm_process_cache",
                                 types.ModuleType("_txrisk_llm_process_cache"))
    return mod.__dict__.setdefault("items", {})


def frees_memory(run, cached: bool = False):
    """A function over Arrow batches that gives freed memory back to the machine when
    its task ends: workers are reused, and others need the room meanwhile. Unless
    ``cached``, what other operators left in the process cache goes first."""
    @functools.wraps(run)
    def wrapped(batches):
        import ctypes

        import pyarrow as pa
        if not cached:
            process_cache().clear()
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)   # glibc only
            if trim is not None:
                trim(0)

    return wrapped
