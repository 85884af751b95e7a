"""txrisk: transaction-risk analytics as Spark DataFrame operators.

Layout
------
sources/    table access: driver fixtures, transaction/log scans and sinks, config IO
functions/  Column-expression builders (features, scoring, policy, text, rounding)
operators/  DataFrame -> DataFrame operators (config fit, profiling, sampling,
            evaluation, explanation, monitoring, models)
plans/      the registered query catalogue built from the operators, plus the
            equivalent DuckDB SQL used as a correctness oracle
streaming/  Structured Streaming variants of the scoring and windowed operators
"""

from txrisk.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
