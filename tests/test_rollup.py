import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from txrisk.operators import monitor as M
from txrisk.operators import rollup as RU
from txrisk.schema import LOG_SCHEMA
from txrisk.sources import io as IO


def _logs(spark, ids, level=None):
    levels = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
    rows = []
    for i in ids:
        day = dt.datetime(2024, 1, 1) + dt.timedelta(days=i // 40, seconds=i)
        rows.append((i, None if i % 29 == 0 else day, None, 0.1, "LOW", 10, level or levels[i % 4],
                     None if i % 31 == 0 else i % 100, int(i % 3 == 0),
                     [f"r{k}" for k in range(i % 4)], 1, None))
    return spark.createDataFrame(rows, LOG_SCHEMA)


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def _metric(df, name):
    """A metric of the file scans of an executed frame, added up."""
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply(name).value() for i in range(leaves.size()))


@pytest.fixture(scope="module")
def log(spark):
    path = tempfile.mkdtemp(prefix="txrisk-rollup-", dir="/tmp") + "/log"
    IO.append_logs(_logs(spark, range(0, 600), "HIGH"), path, "a", 0)     # replaced below
    IO.append_logs(_logs(spark, range(600, 900)), path, "a", 1)
    IO.append_logs(_logs(spark, range(0, 500)), path, "a", 0)
    IO.append_logs(_logs(spark, range(2000, 2100)), path, "b", 0)
    return path


def test_reports_equal_those_of_the_log(spark, log):
    p, logs = RU.read_partials(spark, log), IO.read_logs(spark, log)
    assert logs.count() == 900
    for name in ("stats", "risk_distribution", "kpis", "distribution_filled", "alert_trend",
                 "top_override_reasons"):
        got = getattr(RU, name)(p)
        assert _rows(got) == _rows(getattr(M, name)(logs)), name
        assert got.columns == getattr(M, name)(logs).columns
        assert log + "/" not in got._jdf.queryExecution().executedPlan().toString()


def test_empty_batch(spark):
    path = tempfile.mkdtemp(prefix="txrisk-rollup-", dir="/tmp") + "/log"
    IO.append_logs(_logs(spark, range(3)), path, "a", 0)
    IO.append_logs(_logs(spark, range(3, 6)).limit(0), path, "a", 1)
    p, logs = RU.read_partials(spark, path), IO.read_logs(spark, path)
    assert _rows(RU.kpis(p)) == _rows(M.kpis(logs))
    assert RU.newest_bound(p, 3) == 0 and RU.newest_bound(p, 4) is None
    none = p.limit(0)
    assert _rows(RU.stats(none)) == _rows(M.stats(logs.limit(0)))
    assert _rows(RU.kpis(none)) == _rows(M.kpis(logs.limit(0)))


@pytest.mark.parametrize("n", [1, 30, 100, 250, 5000])
def test_newest_records_read_few_partitions(spark, log, n):
    logs = IO.read_logs(spark, log)
    got = RU.recent_records(spark, log, n)
    assert [r["id"] for r in got.collect()] == [r["id"] for r in M.recent_records(logs, n).collect()]
    if n <= 100:
        all_files = logs.where(F.col("id") >= 0)
        all_files.collect()
        assert _metric(got, "numPartitions") <= 2 + n // 15 < 24
        assert _metric(got, "numOutputRows") < _metric(all_files, "numOutputRows") / 4


def test_point_lookup_reads_the_file_that_holds_the_id(spark):
    path = tempfile.mkdtemp(prefix="txrisk-rollup-", dir="/tmp") + "/log"
    rows = spark.range(0, 40_000, 2, 8).select(
        "id", F.lit(dt.datetime(2024, 1, 1)).alias("created_at"),
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in LOG_SCHEMA.fields[2:]])
    for batch in range(6):
        IO.append_logs(rows.where(F.pmod(F.xxhash64("id"), F.lit(6)) == batch), path, "a", batch)
    logs = IO.read_logs(spark, path)
    hit, miss = logs.where("id = 1234"), logs.where("id = 1235")
    assert len(hit.collect()) == 1 and miss.collect() == []
    # bounds exclude nothing here; the Bloom filters leave the one file
    assert _metric(hit, "numOutputRows") < 20_000 / 4
    assert _metric(miss, "numOutputRows") < 20_000 / 4
