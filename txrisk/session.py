"""Session construction and shared-folder helpers."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings every session of ours wants. AQE re-plans joins from runtime sizes,
# splits skewed join partitions and coalesces small shuffle partitions.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "txrisk") -> SparkSession:
    """Local/test session. On a cluster the launcher supplies master and sizes."""
    master = master or os.environ.get("TXRISK_MASTER", "local[8]")
    b = SparkSession.builder.master(master).appName(app_name)
    for k, v in SESSION_DEFAULTS.items():
        b = b.config(k, v)
    b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
    b = b.config("spark.driver.memory", os.environ.get("TXRISK_DRIVER_MEMORY", "8g"))
    # Wide projections generate methods above the JVM's 8 KB JIT limit, which
    # then run interpreted. At scale, set TXRISK_JAVA_OPTS=-XX:-DontCompileHugeMethods
    # here and in spark.executor.extraJavaOptions; on small inputs the extra
    # compile time costs more than it saves, so it is off by default.
    extra = os.environ.get("TXRISK_JAVA_OPTS")
    if extra:
        b = b.config("spark.driver.extraJavaOptions", extra)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and written intermediate tables.

    Uses the cluster's ``spark.checkpoint.dir`` when set. Only in local mode
    (one machine) an unset folder is replaced by a fresh scratch folder; on a
    cluster, executors would not share it, so an unset one is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext._jsc.sc().getCheckpointDir()
        d = d.get() if d.isDefined() else None
    if not d:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="txrisk-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for a written table."""
    import uuid
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared scratch folder and read it back: computed
    once, with a known size, and safe against lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
