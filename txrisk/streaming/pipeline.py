"""Structured Streaming versions of the scoring and monitoring operators.

The per-row chain (validate -> features -> score -> policy -> alert -> log)
is the same code as in batch; a stream only adds the source, the sink and,
for windowed aggregates, a watermark. Sinks are idempotent per micro-batch:
``foreachBatch`` writes batch ``n`` into its own folder with overwrite, so a
batch replayed after a failure replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk.operators.config import FeatureConfig
from txrisk.operators.enrich import build_features
from txrisk.operators.quality import split_valid
from txrisk.operators.scoring import audit_records, score
from txrisk.sources import io as IO


# --------------------------------------------------------------------------- windows

def _event_time(df: DataFrame, ts_col: str) -> DataFrame:
    """Watermarks need TIMESTAMP; sources written without a zone read as
    TIMESTAMP_NTZ and are taken as UTC wall time (session zone is UTC)."""
    return df.withColumn(ts_col, F.col(ts_col).cast("timestamp"))


def hourly_counts(df: DataFrame, ts_col: str = "created_at", watermark: str | None = None,
                  size: str = "1 hour") -> DataFrame:
    """G3 (batch twin: velocity_window): rows per tumbling window. With a
    watermark (streams), rows later than it are dropped and each window is
    final once the watermark passes its end."""
    d = _event_time(df, ts_col)
    d = d.withWatermark(ts_col, watermark) if watermark else d
    return (d.groupBy(F.window(ts_col, size).alias("w")).agg(F.count("*").alias("n"))
            .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                    F.col("w.end").cast("timestamp_ntz").alias("window_end"), "n"))


def live_velocity(df: DataFrame, watermark: str, ts_col: str = "created_at", step: str = "1 hour",
                  median: float | None = None) -> DataFrame:
    """G3 in scoring: every row with ``transactions_in_step``, the rows of its own time
    step, and with ``median`` also ``is_high_velocity_step``, from the stream itself
    instead of a frozen table.

    The stream is joined with its running counts per step. A row comes out (append
    mode) once the watermark passes the end of its step, when the count is final;
    rows that arrive after their step came out are neither counted nor returned. State holds the rows of the
    steps that are still open.
    """
    d = _event_time(df, ts_col).withWatermark(ts_col, watermark)
    counts = d.groupBy(F.window(ts_col, step).alias("_step")).agg(F.count("*").alias("transactions_in_step"))
    # one event time per side: the step's window carries the watermark
    rows = d.withColumn("_step", F.window(ts_col, step)).withColumn(ts_col, F.col(ts_col).cast("timestamp_ntz"))
    out = rows.join(counts, "_step").select(*df.columns, "transactions_in_step")
    if median is not None:
        out = out.withColumn("is_high_velocity_step",
                             (F.col("transactions_in_step") > F.lit(median)).cast("int"))
    return out


def daily_level_counts(logs: DataFrame, watermark: str | None = None) -> DataFrame:
    """G4 (batch twin: daily_alerts): rows per day and final level."""
    d = _event_time(logs, "created_at")
    d = d.withWatermark("created_at", watermark) if watermark else d
    return (d.groupBy(F.window("created_at", "1 day").alias("w"), "final_risk_level")
            .agg(F.count("*").alias("n"))
            .select(F.to_date(F.col("w.start")).alias("date"), "final_risk_level", "n"))


def dedupe(df: DataFrame, key: str, ts_col: str, watermark: str) -> DataFrame:
    """Drop repeated keys arriving within the watermark delay."""
    return _event_time(df, ts_col).withWatermark(ts_col, watermark).dropDuplicatesWithinWatermark([key])


# --------------------------------------------------------------------------- sinks

def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Idempotent per-batch write (overwrite of the batch's own folder)."""
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_id={int(batch_id)}")


def latest_per_key(path_df: DataFrame, keys: list[str]) -> DataFrame:
    """Read back an update-mode sink: the row of the highest batch per key."""
    from pyspark.sql import Window
    w = Window.partitionBy(*keys).orderBy(F.desc("batch_id"))
    return (path_df.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") == 1)
            .drop("_rk", "batch_id"))


def start_score_stream(tx_stream: DataFrame, cfg: FeatureConfig, log_path: str,
                       quarantine_path: str, checkpoint: str, prob_col: str = "prob",
                       available_now: bool = True):
    """G1 + G2: score every micro-batch and append it to the log table;
    invalid rows go to the quarantine table with their violations. A batch is
    computed once for both; its writer is the query's id."""
    step_max = float(cfg.step_bins[-1])

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        writer = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        batch.persist()
        try:
            valid, bad = split_valid(batch, step_max)
            logs = audit_records(score(build_features(valid, cfg), prob_col=prob_col))
            IO.append_logs(logs, log_path, writer, batch_id, grain="month")
            write_batch(bad, quarantine_path, batch_id)
        finally:
            batch.unpersist()

    w = tx_stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def start_window_stream(agg: DataFrame, path: str, checkpoint: str, available_now: bool = True,
                        state_partitions: int | None = None, mode: str = "update"):
    """Stateful stream (a windowed aggregate in update mode, or deduplicated rows in
    append mode) through an idempotent batch sink.
    The state store keeps the shuffle partition count the query starts with
    (AQE does not resize streaming state), so it is set to the cluster's
    parallelism unless given."""
    spark = agg.sparkSession
    n = state_partitions or spark.sparkContext.defaultParallelism
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    try:
        w = (agg.writeStream.outputMode(mode)
             .foreachBatch(lambda df, bid: write_batch(df, path, bid))
             .option("checkpointLocation", checkpoint))
        w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
        return w.start()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
