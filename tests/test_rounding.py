"""py_round must equal Python's round() on floats, ties included."""
import random

from pyspark.sql import functions as F

from txrisk.functions.numeric import py_round


def test_py_round_matches_python(spark):
    rnd = random.Random(7)
    vals = [0.125, 0.375, 2.675, 0.00015, 0.12345, 1.005, 2.5, -2.5, 0.5, 1e-7, 123456.78945,
            0.30000000000000004, 0.1 + 0.2, 1 / 3, -0.0005, 0.9999500000000001]
    vals += [rnd.uniform(-1000, 1000) for _ in range(300)]
    vals += [round(rnd.uniform(0, 1), 5) for _ in range(300)]  # many decimal ties
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    for d in (1, 2, 4, 6):
        got = [r[0] for r in df.select(py_round(F.col("x"), d)).collect()]
        assert got == [round(v, d) for v in vals], d


def test_rint_half_even(spark):
    from txrisk.functions.scoring import risk_score
    df = spark.createDataFrame([(0.125,), (0.375,), (0.625,), (-0.1,), (1.2,), (1.0,)], "p double")
    assert [r[0] for r in df.select(risk_score(F.col("p"))).collect()] == [12, 38, 62, 0, 100, 100]
