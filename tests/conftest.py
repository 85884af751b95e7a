import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMOKE = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    from txrisk.session import SESSION_DEFAULTS, checkpoint_dir
    b = SparkSession.builder.master("local[4]").appName("txrisk-tests")
    for k, v in SESSION_DEFAULTS.items():
        b = b.config(k, v)
    s = (b.config("spark.sql.shuffle.partitions", "4")
         .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="txrisk-test-ckpt-", dir="/tmp"))
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(s)
    yield s
