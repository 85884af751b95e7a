"""Monitoring aggregates over the prediction log.

All of these are single aggregations (partial + final) or ordered limits
(TakeOrderedAndProject); nothing is capped: the original read only the
latest 10,000 log rows, here every row counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txrisk.functions.numeric import guarded_ratio, py_round
from txrisk.schema import LEVELS

HIGH_LEVELS = ["HIGH", "CRITICAL"]


def stats(logs: DataFrame) -> DataFrame:
    """M1: total, override rate (% , 2 places), average final score (2 places);
    0 when empty."""
    return stats_of(logs.agg(F.count("*").alias("total_scored"),
                             F.avg("policy_override_applied").alias("_ov"),
                             F.avg("final_risk_score").alias("_avg")))


def stats_of(a: DataFrame) -> DataFrame:
    """M1 from total_scored, _ov (override share) and _avg (score)."""
    return a.select(
        "total_scored",
        F.coalesce(py_round(F.col("_ov") * F.lit(100.0), 2), F.lit(0.0)).alias("override_rate_pct"),
        F.coalesce(py_round(F.col("_avg"), 2), F.lit(0.0)).alias("avg_risk_score"))


def risk_distribution(logs: DataFrame) -> DataFrame:
    """M1: rows per final level (observed levels only)."""
    return logs.groupBy("final_risk_level").agg(F.count("*").alias("count"))


def kpis(logs: DataFrame) -> DataFrame:
    """M2: cards over one population (the original mixed two denominators)."""
    lvl = F.col("final_risk_level")
    a = logs.agg(F.count("*").alias("total"),
                 F.count(F.when(lvl == "CRITICAL", 1)).alias("n_critical"),
                 F.count(F.when(lvl == "HIGH", 1)).alias("n_high"),
                 F.coalesce(F.sum("policy_override_applied"), F.lit(0)).cast("long").alias("n_overrides"),
                 F.avg("policy_override_applied").alias("_ov"),
                 F.avg("final_risk_score").alias("_avg"))
    return kpis_of(a)


def kpis_of(a: DataFrame) -> DataFrame:
    """M2 from the counts, _ov (override share) and _avg (score)."""
    return a.select(
        "total", "n_critical", "n_high",
        py_round(guarded_ratio(F.col("n_critical"), F.col("total")) * F.lit(100.0), 2).alias("pct_critical"),
        py_round(guarded_ratio(F.col("n_high"), F.col("total")) * F.lit(100.0), 2).alias("pct_high"),
        py_round(F.coalesce(F.col("_ov"), F.lit(0.0)) * F.lit(100.0), 1).alias("override_rate_pct"),
        "n_overrides",
        py_round(F.coalesce(F.col("_avg"), F.lit(0.0)), 2).alias("avg_risk_score"))


def distribution_filled(logs: DataFrame) -> DataFrame:
    """M3: all four levels, zero-filled, with their share (1 place)."""
    return filled(logs.groupBy(F.col("final_risk_level").alias("level")).agg(F.count("*").alias("n")))


def filled(counts: DataFrame) -> DataFrame:
    """M3 from (level, n)."""
    levels = counts.agg(F.sum("n").alias("total")).select(
        "total", F.posexplode(F.array(*[F.lit(x) for x in LEVELS])).alias("level_rank", "level"))
    j = levels.join(counts, "level", "left")  # 4 rows on each side
    n = F.coalesce(F.col("n"), F.lit(0)).cast("long")
    return j.select("level_rank", "level", n.alias("n"),
                    py_round(guarded_ratio(n, F.col("total")) * F.lit(100.0), 1).alias("pct"))


def alert_trend(logs: DataFrame, days: int = 14, simulated_only: bool = False) -> DataFrame:
    """HIGH/CRITICAL rows per day, last ``days`` observed days, ascending."""
    f = logs.where(F.col("created_at").isNotNull() & F.col("final_risk_level").isin(*HIGH_LEVELS))
    if simulated_only:
        f = f.where(F.col("_is_simulated"))
    daily = f.groupBy(F.to_date("created_at").alias("date")).agg(F.count("*").alias("count"))
    return daily.orderBy(F.desc("date")).limit(days).orderBy("date")


def top_override_reasons(logs: DataFrame, k: int = 5) -> DataFrame:
    """M6: most frequent reasons among overridden rows: count, % of overrides,
    bar share of the top count. Ties broken by reason text."""
    ov = logs.where(F.col("policy_override_applied") == 1)
    n_ov = ov.agg(F.count("*").alias("n")).scalar()
    counts = (ov.select(F.explode("policy_reasons").alias("reason"))
              .groupBy("reason").agg(F.count("*").alias("count")))
    return top_of(counts, n_ov, k)


def top_of(counts: DataFrame, n_ov, k: int) -> DataFrame:
    """M6 from (reason, count) and the number of overridden rows."""
    top = counts.orderBy(F.desc("count"), F.asc("reason")).limit(k)
    mx = F.max("count").over(Window.partitionBy())  # over <= k rows
    top = top.withColumn("_n", n_ov)
    return top.select(
        "reason", "count",
        py_round(guarded_ratio(F.col("count"), F.col("_n")) * F.lit(100.0), 6).alias("pct_of_overrides"),
        py_round(guarded_ratio(F.col("count"), mx) * F.lit(100.0), 6).alias("bar_pct"))


def sim_stats(sim: DataFrame) -> DataFrame:
    """M7: injected rows, HIGH or CRITICAL, CRITICAL."""
    lvl = F.col("final_risk_level")
    return sim.agg(F.count("*").alias("injected"),
                   F.count(F.when(lvl.isin(*HIGH_LEVELS), 1)).alias("high_or_critical"),
                   F.count(F.when(lvl == "CRITICAL", 1)).alias("critical"))


def recent(logs: DataFrame, n: int = 50, cols: list[str] | None = None) -> DataFrame:
    """Latest n by id (top-k, no global sort)."""
    out = logs.orderBy(F.desc("id")).limit(n)
    return out.select(*cols) if cols else out


def recent_records(logs: DataFrame, n: int = 50) -> DataFrame:
    """The latest n log records with their twelve fields: the override flag as
    a boolean, transaction, reasons and alert as nested values."""
    return logs.orderBy(F.desc("id")).limit(n).select(
        "id", "created_at", "transaction", "ml_probability", "ml_risk_level", "ml_risk_score",
        "final_risk_level", "final_risk_score",
        (F.col("policy_override_applied") == 1).alias("policy_override_applied"),
        F.coalesce("policy_reasons", F.array().cast("array<string>")).alias("policy_reasons"),
        "suspicious_signal_count", "alert")


def alert_queue(logs: DataFrame, levels=("HIGH", "CRITICAL"), min_score: int = 70,
                only_override: bool = False, n: int = 200) -> DataFrame:
    """Filtered queue, newest first, first n."""
    f = logs.where(F.col("final_risk_level").isin(*levels) & (F.col("final_risk_score") >= min_score))
    if only_override:
        f = f.where(F.col("policy_override_applied") == 1)
    return f.orderBy(F.desc("id")).limit(n)


# Fixed value: the explanation text.
EXPLANATION = ("ML model assessed base risk. Policy engine may have elevated it based on "
               "business rules.")


def explain_log(logs: DataFrame, log_id: int) -> DataFrame:
    """P10: one log entry as a nested record; an empty frame means not found."""
    return logs.where(F.col("id") == F.lit(log_id)).select(
        F.col("id").alias("log_id"), "transaction",
        F.struct(F.col("ml_probability").alias("probability"), F.col("ml_risk_level").alias("level"),
                 F.col("ml_risk_score").alias("score")).alias("ml"),
        F.struct(F.col("final_risk_level").alias("level"),
                 F.col("final_risk_score").alias("score")).alias("final"),
        (F.col("policy_override_applied") == 1).alias("override_applied"),
        F.coalesce(F.col("policy_reasons"), F.array().cast("array<string>")).alias("override_reasons"),
        F.lit(EXPLANATION).alias("explanation"))


def union_logs(stored: DataFrame, simulated: DataFrame) -> DataFrame:
    """Simulated rows on top of stored rows; missing columns null, then
    projected to the stored columns + ``_is_simulated`` (null -> false)."""
    sim = simulated.withColumn("_is_simulated", F.lit(True))
    u = sim.unionByName(stored, allowMissingColumns=True)
    return u.select(*stored.columns,
                    F.coalesce(F.col("_is_simulated"), F.lit(False)).alias("_is_simulated"))
