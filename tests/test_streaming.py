"""Streaming equals batch on the smallest fixture."""
from txrisk.plans import q_core, q_stream


def test_stream_score_equals_batch(spark):
    sf = "/root/testdata/sf0.001"
    s = q_stream.stream_score(spark, sf)
    b = q_core.score_batch(spark, sf).withColumnRenamed("tx_id", "id").select(*s.columns)
    assert s.count() == b.count() == 1500
    assert s.exceptAll(b).count() == 0 and b.exceptAll(s).count() == 0


def test_stream_velocity_equals_batch(spark):
    sf = "/root/testdata/sf0.001"
    s = q_stream.stream_velocity(spark, sf)
    b = q_stream.velocity_window(spark, sf)
    assert s.exceptAll(b).count() == 0 and b.exceptAll(s).count() == 0


def test_stream_quarantine_split(spark):
    """Invalid requests in a stream go to quarantine with their reasons."""
    import tempfile
    from pyspark.sql import functions as F
    from txrisk.operators.config import FeatureConfig, step_bins
    from txrisk.schema import REQUEST_SCHEMA
    from txrisk.sources import io as IO
    from txrisk.streaming import pipeline as G

    d = tempfile.mkdtemp(prefix="txrisk-qstream-", dir="/tmp")
    rows = [(1, None, 5, "TRANSFER", 10.0, 20.0, 10.0, 0.0, 10.0),
            (2, None, 5, "DEBIT", -1.0, 20.0, 10.0, 0.0, 10.0),
            (3, None, 900, "DEBIT", 1.0, 20.0, 19.0, 0.0, 1.0),
            (4, None, 5, None, 1.0, 20.0, 19.0, 0.0, 1.0)]
    spark.createDataFrame(rows, REQUEST_SCHEMA).withColumn("prob", F.lit(0.5)) \
        .withColumn("created_at", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")) \
        .write.parquet(f"{d}/in")
    schema = spark.read.parquet(f"{d}/in").schema
    cfg = FeatureConfig(1e9, 1e9, step_bins(743), 1.0,
                        spark.createDataFrame([(5, 10)], "step int, n long"))
    q = G.start_score_stream(spark.readStream.schema(schema).parquet(f"{d}/in"), cfg,
                             f"{d}/logs", f"{d}/quarantine", f"{d}/ckpt")
    q.awaitTermination()
    assert [r.id for r in IO.read_logs(spark, f"{d}/logs").collect()] == [1]
    bad = {r.tx_id: r.violations for r in spark.read.parquet(f"{d}/quarantine").collect()}
    assert bad == {2: ["amount < 0"], 3: ["step beyond last bin edge"], 4: ["type missing"]}


def _events(spark, path, *batches):
    """One file per batch of (id, 'HH:MM') events."""
    schema = "id long, created_at timestamp"
    for k, rows in enumerate(batches):
        df = spark.createDataFrame([(i, f"2024-01-01 {t}:00") for i, t in rows], "id long, t string")
        df.selectExpr("id", "to_timestamp(t) AS created_at").coalesce(1).write.mode("append").parquet(
            f"{path}/b={k}")
    return schema


def _replayed(spark, path, schema):
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
            .option("recursiveFileLookup", True).parquet(path))


def test_rows_later_than_the_watermark_are_dropped(spark):
    """Micro-batches in order; late rows inside the watermark count, later ones do not."""
    import tempfile
    import time
    from txrisk.streaming import pipeline as G
    d = tempfile.mkdtemp(prefix="txrisk-late-", dir="/tmp")
    schema = _events(spark, f"{d}/in", [(1, "10:10"), (2, "12:30")])
    time.sleep(1.1)                              # files are taken in order of their time
    _events(spark, f"{d}/in/2", [(3, "11:40"), (5, "12:50")])
    time.sleep(1.1)
    _events(spark, f"{d}/in/3", [(4, "09:05"), (6, "08:00"), (7, "15:00")])
    agg = G.hourly_counts(_replayed(spark, f"{d}/in", schema), watermark="1 hour")
    G.start_window_stream(agg, f"{d}/out", f"{d}/ckpt", state_partitions=2).awaitTermination()
    got = {r.window_start.hour: r.n for r in
           G.latest_per_key(spark.read.parquet(f"{d}/out"), ["window_start"]).collect()}
    # 11:40 is behind 12:30 by less than an hour; 09:05 and 08:00 come too late
    assert got == {10: 1, 11: 1, 12: 2, 15: 1}


def test_live_velocity_counts_a_step_once_it_is_closed(spark):
    """G3 in scoring: rows come with their step's final count; late rows do neither."""
    import tempfile
    import time
    from txrisk.streaming import pipeline as G
    d = tempfile.mkdtemp(prefix="txrisk-live-", dir="/tmp")
    schema = _events(spark, f"{d}/in", [(1, "10:10"), (2, "10:40"), (3, "11:30")])
    time.sleep(1.1)
    _events(spark, f"{d}/in/2", [(4, "10:50"), (5, "13:20")])       # 10:50 is within the hour
    time.sleep(1.1)
    _events(spark, f"{d}/in/3", [(7, "13:40")])                     # 10:00 and 11:00 are closed now
    time.sleep(1.1)
    _events(spark, f"{d}/in/4", [(6, "10:05"), (8, "16:00")])       # 10:05 is too late
    live = G.live_velocity(_replayed(spark, f"{d}/in", schema), "1 hour", median=1.5)
    G.start_window_stream(live, f"{d}/out", f"{d}/ckpt", state_partitions=2, mode="append").awaitTermination()
    got = {r.id: (r.transactions_in_step, r.is_high_velocity_step)
           for r in spark.read.parquet(f"{d}/out").collect()}
    assert got == {1: (3, 1), 2: (3, 1), 4: (3, 1), 3: (1, 0), 5: (2, 1), 7: (2, 1)}


def test_replayed_rows_count_once(spark):
    """Rows sent again in a later file."""
    import tempfile
    import time
    from txrisk.streaming import pipeline as G
    d = tempfile.mkdtemp(prefix="txrisk-dedupe-", dir="/tmp")
    schema = _events(spark, f"{d}/in", [(1, "10:10"), (2, "10:20"), (2, "10:20")])
    time.sleep(1.1)
    _events(spark, f"{d}/in/2", [(1, "10:10"), (3, "10:30")])
    once = G.dedupe(_replayed(spark, f"{d}/in", schema), "id", "created_at", "2 hours")
    G.start_window_stream(once, f"{d}/out", f"{d}/ckpt", state_partitions=2, mode="append").awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(f"{d}/out").collect()) == [1, 2, 3]


def test_streams_equal_their_batch_twins(spark):
    sf = "/root/testdata/sf0.001"
    for stream, batch in ((q_stream.stream_quarantine, q_core.quarantine),
                          (q_stream.stream_daily, q_stream.daily_alerts)):
        s, b = stream(spark, sf), batch(spark, sf)
        assert s.count() > 0
        assert s.exceptAll(b).count() == 0 and b.exceptAll(s).count() == 0


def test_a_restarted_stream_replaces_no_other_writer(spark):
    """A second stream over the same table, whose batches start at 0 again."""
    import tempfile
    from txrisk.plans import context as C
    from txrisk.sources import fixtures
    from txrisk.sources import io as IO
    from txrisk.streaming import pipeline as G
    sf = "/root/testdata/sf0.001"
    d = tempfile.mkdtemp(prefix="txrisk-restart-", dir="/tmp")
    for k in (0, 1):
        tx = C.tx(spark, sf).where(f"tx_id % 2 = {k}")
        q = G.start_score_stream(fixtures.file_stream(tx, f"{d}/in{k}", 2), C.config(spark, sf),
                                 f"{d}/logs", f"{d}/quarantine{k}", f"{d}/ckpt{k}")
        q.awaitTermination()
    logs = IO.read_logs(spark, f"{d}/logs")
    assert logs.count() == 1500 and logs.select("writer").distinct().count() == 2
