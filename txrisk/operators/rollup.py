"""Monitoring from mergeable partial aggregates instead of the log.

Every appended batch has its partials beside it: counts and sums per day and final
level, override reasons per day, and one zone row per date partition (smallest and
largest id, rows). They are written from the batch's own files after them, into a
folder of the same (writer, batch), so a replayed batch replaces its partials with its
rows. A report adds up partials: a row per day, level and batch, however long the log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txrisk.operators import monitor as M
from txrisk.schema import LOG_SCHEMA

PARTIALS = ("kind string, day date, key string, n long, overrides long, override_rows long, "
            "score_sum long, score_rows long, min_id long, max_id long, writer string, batch_id long")
#: Partitions that a query names at most.
LISTED = 200


def partials(batch: DataFrame) -> DataFrame:
    """Partials of log rows with ``created_date``. kind "level": per day of created_at
    (null: no time) and final level; "reason": per day and reason, overridden rows
    only; "zone": per date partition."""
    day = F.to_date("created_at").alias("day")
    levels = batch.groupBy(F.lit("level").alias("kind"), day, F.col("final_risk_level").alias("key")).agg(
        F.count("*").alias("n"), F.sum("policy_override_applied").cast("long").alias("overrides"),
        F.count("policy_override_applied").alias("override_rows"),
        F.sum("final_risk_score").cast("long").alias("score_sum"),
        F.count("final_risk_score").alias("score_rows"))
    over = batch.where(F.col("policy_override_applied") == 1)
    reasons = over.select(day, F.explode("policy_reasons").alias("key")).groupBy(
        F.lit("reason").alias("kind"), "day", "key").agg(F.count("*").alias("n"))
    zones = batch.groupBy(F.lit("zone").alias("kind"), F.col("created_date").alias("day")).agg(
        F.count("id").alias("n"), F.min("id").alias("min_id"), F.max("id").alias("max_id"))
    return levels.unionByName(reasons, allowMissingColumns=True).unionByName(
        zones, allowMissingColumns=True)


def folder(log_path: str) -> str:
    return f"{log_path.rstrip('/')}_partials"


def write_partials(spark: SparkSession, log_path: str, writer: str, batch_id: int) -> None:
    """(Re)write the partials of one batch from its files."""
    part = f"writer={writer}/batch_id={int(batch_id)}"
    schema = T.StructType([*LOG_SCHEMA.fields, T.StructField("created_date", T.DateType())])
    batch = spark.read.schema(schema).parquet(f"{log_path.rstrip('/')}/{part}")     # may be empty
    partials(batch).coalesce(1).write.mode("overwrite").parquet(f"{folder(log_path)}/{part}")


def read_partials(spark: SparkSession, log_path: str) -> DataFrame:
    return spark.read.schema(PARTIALS).parquet(folder(log_path))


def _levels(p: DataFrame) -> DataFrame:
    return p.where(F.col("kind") == "level")


def _ratio(top: str, below: str):
    """sum / sum, null where nothing counted."""
    n = F.sum(below)
    return F.when(n > 0, F.sum(top).cast("double") / n.cast("double"))


def _total():
    return F.coalesce(F.sum("n"), F.lit(0)).cast("long")


def stats(p: DataFrame) -> DataFrame:
    """M1 from partials."""
    return M.stats_of(_levels(p).agg(_total().alias("total_scored"),
                                     _ratio("overrides", "override_rows").alias("_ov"),
                                     _ratio("score_sum", "score_rows").alias("_avg")))


def risk_distribution(p: DataFrame) -> DataFrame:
    """M1 levels from partials."""
    return _levels(p).groupBy(F.col("key").alias("final_risk_level")).agg(F.sum("n").alias("count"))


def kpis(p: DataFrame) -> DataFrame:
    """M2 from partials."""
    def of(level):
        return F.coalesce(F.sum(F.when(F.col("key") == level, F.col("n"))), F.lit(0)).cast("long")

    return M.kpis_of(_levels(p).agg(
        _total().alias("total"), of("CRITICAL").alias("n_critical"), of("HIGH").alias("n_high"),
        F.coalesce(F.sum("overrides"), F.lit(0)).cast("long").alias("n_overrides"),
        _ratio("overrides", "override_rows").alias("_ov"), _ratio("score_sum", "score_rows").alias("_avg")))


def distribution_filled(p: DataFrame) -> DataFrame:
    """M3 from partials."""
    return M.filled(_levels(p).groupBy(F.col("key").alias("level")).agg(F.sum("n").alias("n")))


def alert_trend(p: DataFrame, days: int = 14) -> DataFrame:
    """M4 from partials: the last ``days`` observed days."""
    f = _levels(p).where(F.col("day").isNotNull() & F.col("key").isin(*M.HIGH_LEVELS))
    daily = f.groupBy(F.col("day").alias("date")).agg(F.sum("n").alias("count"))
    return daily.orderBy(F.desc("date")).limit(days).orderBy("date")


def top_override_reasons(p: DataFrame, k: int = 5) -> DataFrame:
    """M6 from partials."""
    counts = p.where(F.col("kind") == "reason").groupBy(F.col("key").alias("reason")).agg(
        F.sum("n").alias("count"))
    return M.top_of(counts, _levels(p).agg(F.sum("overrides").alias("n")).scalar(), k)


def newest_bound(p: DataFrame, n: int) -> int | None:
    """An id that at least the ``n`` newest rows reach (null: take all rows). Zones by
    smallest id, descending, until they hold n rows: all of theirs are at or above."""
    zones = (p.where(F.col("kind") == "zone").groupBy(F.col("min_id")).agg(F.sum("n").alias("n"))
             .where(F.col("min_id").isNotNull()).orderBy(F.desc("min_id")).limit(n))  # >= 1 row each
    seen = 0
    for z in zones.collect():                    # at most n rows of two numbers
        seen += z["n"]
        if seen >= n:
            return z["min_id"]
    return None


def recent_records(spark: SparkSession, log_path: str, n: int = 50) -> DataFrame:
    """T1 with the zones read first: only partitions that reach the bound are listed, and
    inside them only row groups that do."""
    from txrisk.sources import io as IO
    p = read_partials(spark, log_path)
    logs, bound = IO.read_logs(spark, log_path), newest_bound(p, n)
    if bound is not None:
        logs = logs.where(F.col("id") >= bound)
        zones = p.where((F.col("kind") == "zone") & (F.col("max_id") >= bound)).select(
            "writer", "batch_id", "day").limit(LISTED + 1).collect()
        if len(zones) <= LISTED:                 # else the bound alone
            keep = F.lit(False)
            for z in zones:
                keep = keep | ((F.col("writer") == z["writer"]) & (F.col("batch_id") == z["batch_id"])
                               & F.col("created_date").eqNullSafe(F.lit(z["day"])))
            logs = logs.where(keep)
    return M.recent_records(logs, n)
