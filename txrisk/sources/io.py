"""Table sources and sinks: transactions, prediction logs, reports.

The original kept its audit log in a single-file SQL database with JSON text
columns and one commit per row. Here the log is a Parquet table partitioned
by ``created_date`` with native nested columns; JSON text exists only at the
edge (``encode_log`` / ``decode_log``). Appends are bulk and idempotent per
writer and batch: each batch writes its own ``writer=/batch_id=`` folder with
overwrite, so a replayed batch replaces itself instead of duplicating rows, and
no writer can replace another's.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txrisk.schema import (ALERT_SCHEMA, LOG_SCHEMA, TRANSACTION_JSON_SCHEMA,
                           TRANSACTION_SCHEMA)


# --------------------------------------------------------------------------- transactions

def read_transactions_csv(spark: SparkSession, path: str,
                          schema: T.StructType = TRANSACTION_SCHEMA,
                          corrupt: str | None = None) -> DataFrame:
    """CSV with header and a declared schema (no inference pass). A field that does
    not parse is null; with ``corrupt``, that column holds the whole line of such rows
    (else null), and ``quality.split_valid`` counts them as malformed."""
    r = spark.read.option("header", True)
    if corrupt is None:
        return r.schema(schema).csv(path)
    return (r.schema(T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())]))
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", corrupt).csv(path))


def read_pruned(spark: SparkSession, path: str, columns: dict[str, str],
                fmt: str = "parquet") -> DataFrame:
    """Only the named columns, cast to the given types (pruned at the scan)."""
    df = spark.read.format(fmt).load(path)
    return df.select(*[F.col(c).cast(t).alias(c) for c, t in columns.items()])


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    """Processed tables and reports. Never the input's own path."""
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def reuse_or_compute(spark: SparkSession, path: str, compute, fmt: str = "parquet") -> DataFrame:
    """Read a persisted table if present, else compute, persist and read it.
    Only a path that does not exist counts as absent; any other failure to read
    (permissions, damaged files) is raised and nothing is overwritten."""
    try:
        return spark.read.format(fmt).load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    compute().write.mode("errorifexists").format(fmt).save(path)
    return spark.read.format(fmt).load(path)


def save_model_columns(df: DataFrame, path: str, labels: tuple = ("isFraud", "isFlaggedFraud")) -> None:
    """The training column list (all columns but the labels) as a JSON array."""
    names = [c for c in df.columns if c not in labels]
    row = df.sparkSession.createDataFrame([(names,)], "columns array<string>")
    row.select(F.to_json("columns")).coalesce(1).write.mode("overwrite").text(path)


def load_model_columns(spark: SparkSession, path: str) -> list[str]:
    """The column list as saved, or as any file holding one JSON array."""
    text = F.from_json("value", T.ArrayType(T.StringType()))
    return spark.read.text(path, wholetext=True).select(text.alias("c")).first()["c"]


# --------------------------------------------------------------------------- prediction log

LOG_TABLE_DDL = """
CREATE TABLE IF NOT EXISTS {name} (
  id BIGINT, created_at TIMESTAMP,
  transaction STRUCT<step: INT, type: STRING, amount: DOUBLE, oldbalanceOrg: DOUBLE,
                     newbalanceOrig: DOUBLE, oldbalanceDest: DOUBLE, newbalanceDest: DOUBLE>,
  ml_probability DOUBLE, ml_risk_level STRING, ml_risk_score INT,
  final_risk_level STRING, final_risk_score INT, policy_override_applied INT,
  policy_reasons ARRAY<STRING>, suspicious_signal_count INT,
  alert STRUCT<alert_id: STRING, created_at: STRING, transaction_ref: STRING, risk_level: STRING,
               risk_score: INT, probability: DOUBLE, recommended_action: STRING,
               reasons: ARRAY<STRUCT<reason: STRING>>, status: STRING>,
  writer STRING, batch_id BIGINT, created_date DATE)
USING parquet PARTITIONED BY (writer, batch_id, created_date) LOCATION '{path}'"""


def create_log_table(spark: SparkSession, name: str, path: str) -> None:
    """Declare the log table if absent."""
    spark.sql(LOG_TABLE_DDL.format(name=name, path=path))


#: Pieces that the rows of one date are dealt to before the write.
DATE_PIECES = 16


def dated_logs(logs: DataFrame, grain: str = "day") -> DataFrame:
    """Log rows with their date partition, dealt so that no date is one task:
    rows of a date go to DATE_PIECES pieces, and the rebalance splits pieces
    that are large and joins those that are small (bounded file sizes)."""
    day = F.to_date("created_at")
    part = day if grain == "day" else F.trunc(day, "month")
    return (logs.select(*[f.name for f in LOG_SCHEMA.fields])
            .withColumns({"created_date": part, "_piece": F.pmod(F.xxhash64("id"), F.lit(DATE_PIECES))})
            .hint("rebalance", "created_date", "_piece").drop("_piece"))


def append_logs(logs: DataFrame, path: str, writer: str, batch_id: int, grain: str = "day",
                table: str | None = None) -> None:
    """Bulk, idempotent append of one batch of one writer.

    Each (writer, batch) owns a folder and overwrites it, so a replayed batch
    replaces itself and nothing else; readers see ``writer``, ``batch_id`` and
    ``created_date`` as partition columns. A stream's writer is its query id, which
    lives in its checkpoint: a stream that lost it is a new writer. ``grain`` =
    "day" or "month" sets the date partition size. ``table``: the declared table
    over ``path``, whose new partitions are registered. Files carry a Bloom filter on
    ``id`` (pieces of a date span all its ids, so their bounds exclude nothing), and
    the batch's monitoring partials are written after it.
    """
    from txrisk.operators import rollup
    (dated_logs(logs, grain).write.mode("overwrite").partitionBy("created_date")
     .option("parquet.bloom.filter.enabled#id", "true")
     .option("parquet.bloom.filter.adaptive.enabled", "true")
     .parquet(f"{path.rstrip('/')}/writer={writer}/batch_id={int(batch_id)}"))
    rollup.write_partials(logs.sparkSession, path, writer, batch_id)
    if table is not None:
        logs.sparkSession.catalog.recoverPartitions(table)


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def encode_log(logs: DataFrame) -> DataFrame:
    """Native log -> the original's text layout (JSON strings, ISO time)."""
    return logs.select(
        "id",
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias("created_at"),
        F.to_json("transaction").alias("transaction_json"),
        "ml_probability", "ml_risk_level", "ml_risk_score", "final_risk_level", "final_risk_score",
        "policy_override_applied", F.to_json("policy_reasons").alias("policy_reasons_json"),
        "suspicious_signal_count",
        F.when(F.col("alert").isNotNull(), F.to_json("alert")).alias("alert_json"))


def decode_log(text_logs: DataFrame) -> DataFrame:
    """JSON text columns -> typed nested columns; NULL-safe (missing
    transaction -> empty struct fields, missing reasons -> empty array); an
    unparseable timestamp becomes null (coerce), not an error."""
    reasons = F.from_json("policy_reasons_json", T.ArrayType(T.StringType()))
    return text_logs.select(
        "id",
        F.try_to_timestamp(F.regexp_replace("created_at", r"\+00:00$", "")).alias("created_at"),
        F.from_json("transaction_json", TRANSACTION_JSON_SCHEMA).alias("transaction"),
        "ml_probability", "ml_risk_level", "ml_risk_score", "final_risk_level", "final_risk_score",
        "policy_override_applied",
        F.coalesce(reasons, F.array().cast("array<string>")).alias("policy_reasons"),
        "suspicious_signal_count",
        F.from_json("alert_json", ALERT_SCHEMA).alias("alert"))


def flatten(df: DataFrame, struct_cols: list[str]) -> DataFrame:
    """Nested records -> dotted flat columns (``transaction.amount``)."""
    out = []
    for f in df.schema.fields:
        if f.name in struct_cols and isinstance(f.dataType, T.StructType):
            out += [F.col(f"{f.name}.{s.name}").alias(f"{f.name}.{s.name}") for s in f.dataType.fields]
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def report_json(df: DataFrame) -> DataFrame:
    """Each row as one JSON document."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def write_report(df: DataFrame, path: str) -> DataFrame:
    """Write each row as one JSON document and read the text back."""
    report_json(df).coalesce(1).write.mode("overwrite").text(path)
    return df.sparkSession.read.text(path).withColumnRenamed("value", "json")
