"""Streaming queries and their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from txrisk.plans import context as C
from txrisk.plans.oracle_base import with_
from txrisk.plans import q_core  # noqa: F401 - registers the batch twin of the quarantine stream
from txrisk.plans.registry import ORACLE, query
from txrisk.session import scratch_path
from txrisk.sources import fixtures
from txrisk.sources import io as IO
from txrisk.streaming import pipeline as G

_HOURLY_SQL = """
SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end,
       count(*) AS n
FROM events GROUP BY 1, 2"""


@query("velocity_window", _HOURLY_SQL)
def velocity_window(spark, sf):
    """Events per tumbling hour (batch twin of the live velocity stream)."""
    e = fixtures.read_table(spark, sf, "events").withColumnRenamed("ts", "created_at")
    return G.hourly_counts(e)


@query("daily_alerts", with_("logs") + """
SELECT CAST(created_at AS DATE) AS date, final_risk_level, count(*) AS n
FROM logs GROUP BY 1, 2""")
def daily_alerts(spark, sf):
    """Log rows per day and final level (batch twin of the live trend)."""
    return G.daily_level_counts(C.log_table(spark, sf))


@query("stream_velocity", _HOURLY_SQL)
def stream_velocity(spark, sf):
    """The events file replayed as a stream; watermarked hourly counts in
    update mode through an idempotent sink, read back as final counts."""
    path, ckpt = scratch_path(spark, "velocity"), scratch_path(spark, "velocity-ckpt")
    ev = fixtures.events_stream(spark, sf).withColumnRenamed("ts", "created_at")
    q = G.start_window_stream(G.hourly_counts(ev, watermark="1 hour"), path, ckpt)
    q.awaitTermination()
    return G.latest_per_key(spark.read.parquet(path), ["window_start"])


#: Events an hour above which a step counts as busy.
BUSY_HOUR = 2.0


@query("stream_live_velocity", f"""
WITH h AS (SELECT event_id, date_trunc('hour', ts) AS hour FROM events),
c AS (SELECT hour, count(*) AS n FROM h GROUP BY hour)
SELECT event_id, n AS transactions_in_step, CAST(n > {BUSY_HOUR} AS INTEGER) AS is_high_velocity_step
FROM h JOIN c USING (hour)
WHERE hour + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def stream_live_velocity(spark, sf):
    """Every event of a closed hour with the hour's count, from a stream joined with its
    own running counts."""
    base = scratch_path(spark, "live-velocity")
    ev = fixtures.events_stream(spark, sf).withColumnRenamed("ts", "created_at").select("event_id", "created_at")
    q = G.start_window_stream(G.live_velocity(ev, "1 hour", median=BUSY_HOUR), f"{base}/out",
                              f"{base}/ckpt", mode="append")
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out").select("event_id", "transactions_in_step", "is_high_velocity_step")


@query("stream_score", with_("scored") + """
SELECT tx_id AS id, ml_probability, ml_risk_level, ml_risk_score, final_risk_level,
       final_risk_score, policy_override_applied, suspicious_signal_count FROM scored""")
def stream_score(spark, sf):
    """Orders replayed as a stream of four micro-batches, joined stream-static to
    customers and suppliers, scored per micro-batch and appended to the log table."""
    base = scratch_path(spark, "stream-score")
    tx_stream = fixtures.transactions(spark, sf, orders=fixtures.orders_stream(spark, sf, f"{base}/in"))
    q = G.start_score_stream(tx_stream, C.config(spark, sf), f"{base}/logs", f"{base}/quarantine",
                             f"{base}/ckpt")
    q.awaitTermination()
    return IO.read_logs(spark, f"{base}/logs").select(
        "id", "ml_probability", "ml_risk_level", "ml_risk_score", "final_risk_level",
        "final_risk_score", "policy_override_applied", "suspicious_signal_count")


@query("stream_quarantine", ORACLE["quarantine"])
def stream_quarantine(spark, sf):
    """Requests with faults as a stream: the quarantine table per violation."""
    base = scratch_path(spark, "stream-quarantine")
    tx = fixtures.transactions(spark, sf, orders=fixtures.orders_stream(spark, sf, f"{base}/in"))
    q = G.start_score_stream(fixtures.requests(spark, sf, tx), C.config(spark, sf), f"{base}/logs",
                             f"{base}/quarantine", f"{base}/ckpt")
    q.awaitTermination()
    bad = spark.read.parquet(f"{base}/quarantine")
    return (bad.select("tx_id", F.explode("violations").alias("violation")).groupBy("violation")
            .agg(F.count("*").alias("n"), F.min("tx_id").alias("first_tx")))


#: Longer than the fixture's time span, so that no row is late.
ALL_TIME = "36500 days"


@query("stream_daily", ORACLE["daily_alerts"])
def stream_daily(spark, sf):
    """Daily level counts of the log as a stream of several micro-batches (update
    mode, read back as final counts)."""
    base = scratch_path(spark, "stream-daily")
    logs = C.log_table(spark, sf).select("id", "created_at", "final_risk_level")
    agg = G.daily_level_counts(fixtures.file_stream(logs, f"{base}/in"), watermark=ALL_TIME)
    q = G.start_window_stream(agg, f"{base}/out", f"{base}/ckpt")
    q.awaitTermination()
    return G.latest_per_key(spark.read.parquet(f"{base}/out"), ["date", "final_risk_level"])


@query("stream_dedupe", with_("tx") + "SELECT tx_id, created_at FROM tx")
def stream_dedupe(spark, sf):
    """Requests sent twice, as a stream, kept once by id."""
    base = scratch_path(spark, "stream-dedupe")
    r = C.requests(spark, sf).select("tx_id", "created_at")
    once = G.dedupe(fixtures.file_stream(r, f"{base}/in"), "tx_id", "created_at", ALL_TIME)
    q = G.start_window_stream(once, f"{base}/out", f"{base}/ckpt", mode="append")
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out").select(
        "tx_id", F.col("created_at").cast(r.schema["created_at"].dataType).alias("created_at"))
