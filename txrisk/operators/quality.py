"""Projections, validation/quarantine and data-quality aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txrisk.schema import RAW_NUMERIC

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)


def columns_by_kind(df: DataFrame) -> DataFrame:
    """Position, column, dtype, kind (numeric / string / other) and, from the
    table, the number of non-null values (one pass)."""
    info, aggs = [], []
    for i, f in enumerate(df.schema.fields):
        kind = ("numeric" if isinstance(f.dataType, NUMERIC_TYPES)
                else "string" if isinstance(f.dataType, T.StringType) else "other")
        info.append((i, f.name, f.dataType.simpleString(), kind))
        aggs.append(F.count(F.col(f.name)).alias(f"n{i}"))
    rows = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(n).alias("column"),
                              F.lit(t).alias("dtype"), F.lit(k).alias("kind"),
                              F.col(f"n{i}").alias("non_null")) for i, n, t, k in info])
    return df.agg(*aggs).select(F.explode(rows).alias("x")).select("x.*")


def debug_projection(df: DataFrame, names: list[str], keep: list[str] | None = None) -> DataFrame:
    """Named features as doubles; a missing feature becomes null."""
    have = set(df.columns)
    return df.select(*(keep or []), *[
        (F.col(n).cast("double") if n in have else F.lit(None).cast("double")).alias(n)
        for n in names])


def fill_missing(df: DataFrame, cols: list[str], value=0.0) -> DataFrame:
    """Missing raw fields -> value (added when the column is absent)."""
    have = set(df.columns)
    out = df
    for c in cols:
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(value)) if c in have else F.lit(value))
    return out


#: Column of ``io.read_transactions_csv`` with the lines that do not parse.
CORRUPT = "_corrupt_record"


def violations(step_max: float | None = None, corrupt: bool = False) -> F.Column:
    """Array of violation texts per row (empty = valid). ``corrupt``: a line in
    the column CORRUPT is one."""
    checks = [F.when(F.col(CORRUPT).isNotNull(), F.lit("malformed record"))] if corrupt else []
    checks += [F.when(F.col("step").isNull(), F.lit("step missing"))
              .when(F.col("step") < 0, F.lit("step < 0")),
              F.when(F.col("type").isNull(), F.lit("type missing"))]
    for c in RAW_NUMERIC:
        x = F.col(c)
        checks.append(F.when(x.isNull(), F.lit(f"{c} missing"))
                      .when(F.isnan(x), F.lit(f"{c} NaN"))
                      .when(x < 0, F.lit(f"{c} < 0")))
    if step_max is not None:
        checks.append(F.when(F.col("step") > F.lit(step_max), F.lit("step beyond last bin edge")))
    return F.array_compact(F.array(*checks))


def with_violations(df: DataFrame, step_max: float | None = None) -> DataFrame:
    return df.withColumn("violations", violations(step_max, CORRUPT in df.columns))


def split_valid(df: DataFrame, step_max: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with their violations). One expression,
    two filters: no try/except per row."""
    v = with_violations(df, step_max)
    ok = F.size("violations") == 0
    return v.where(ok).drop("violations"), v.where(~ok)


def schema_drift(df: DataFrame, expected: list[str]) -> dict:
    """Missing / extra columns against an expected list (schema only)."""
    have = df.columns
    return {"missing": [c for c in expected if c not in have],
            "extra": [c for c in have if c not in expected]}


def null_counts(df: DataFrame) -> DataFrame:
    """A2: nulls per column in one pass, long form (column, nulls)."""
    cols = df.columns
    wide = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(f"c{i}") for i, c in enumerate(cols)])
    stack = ", ".join(f"'{c}', c{i}" for i, c in enumerate(cols))
    return wide.selectExpr(f"stack({len(cols)}, {stack}) AS (column, nulls)")


def duplicate_count(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """A3: rows that repeat an earlier identical row."""
    cols = cols or df.columns
    g = df.groupBy(*cols).agg(F.count("*").alias("_n"))
    return g.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("duplicate_rows"))

