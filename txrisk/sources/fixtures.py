"""Transaction-shaped views over the driver's TPC-H-like tables.

``transactions`` maps orders/customer/supplier to the payment-transaction
schema (one row per order). ``sim_events`` maps ``events`` to the simulator's
event schema. The same mapping is written in DuckDB SQL in
``txrisk.plans.oracle`` so both engines can be compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STEP_ORIGIN = "1992-01-01"
STEP_PERIOD = 743

PRIORITY_TO_TYPE = {
    "1-URGENT": "TRANSFER",
    "2-HIGH": "CASH_OUT",
    "3-MEDIUM": "DEBIT",
    "4-NOT SPECIFIED": "CASH_IN",
    "5-LOW": "PAYMENT",
}
EVENT_TO_MERCHANT = {
    "error": "Crypto Exchange",
    "purchase": "E-Commerce",
    "click": "Wire Transfer",
    "view": "POS Retail",
    "signup": "Gambling",
}
COUNTRIES = ["India", "USA", "Nigeria", "Russia", "UK", "UAE", "Brazil", "Germany",
             "China", "Anonymous VPN"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _case(col: F.Column, mapping: dict) -> F.Column:
    expr = None
    for k, v in mapping.items():
        expr = F.when(col == k, F.lit(v)) if expr is None else expr.when(col == k, F.lit(v))
    return expr


#: Rows of a file of a replayed table, once it has more than a few files of them.
ROWS_PER_FILE = 500_000


def file_stream(table: DataFrame, path: str, batches: int = 4) -> DataFrame:
    """A table replayed as a stream of about ``batches`` micro-batches. Files are bounded
    in rows, so their number, and the tasks of a micro-batch, grow with the table."""
    files = max(batches, -(-table.count() // ROWS_PER_FILE))
    table.repartition(files).write.parquet(path)
    return (table.sparkSession.readStream.schema(table.schema)
            .option("maxFilesPerTrigger", -(-files // batches)).parquet(path))


def orders_stream(spark: SparkSession, sf_dir: str, path: str, batches: int = 4) -> DataFrame:
    """The orders replayed as a stream of several micro-batches."""
    return file_stream(read_table(spark, sf_dir, "orders"), path, batches)


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = read_table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def transactions(spark: SparkSession, sf_dir: str, with_prob: bool = True,
                 orders: DataFrame | None = None) -> DataFrame:
    """tx_id, created_at, step, type, amount, nameOrig, balances, nameDest, labels
    (+ prob, a fixed stand-in model probability). ``orders`` may be a
    streaming frame: the customer and supplier joins are then stream-static."""
    o = (orders if orders is not None else read_table(spark, sf_dir, "orders")).select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    s = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    # destination accounts: all suppliers, whose keys are 0 .. count - 1
    n_dest = s.agg(F.count("*").alias("n")).scalar()
    zero = F.lit(0.0)
    k = F.col("o_orderkey")
    df = (o.join(c, o.o_custkey == c.c_custkey)
          .withColumn("_dest", k % n_dest)
          .join(s, F.col("_dest") == F.col("s_suppkey")))
    old_o = F.when(k % 6 == 0, zero).otherwise(F.greatest(F.col("c_acctbal"), zero) * F.lit(100.0))
    old_d = F.when(k % 3 == 0, zero).otherwise(F.greatest(F.col("s_acctbal"), zero) * F.lit(100.0))
    ttype = _case(F.col("o_orderpriority"), PRIORITY_TO_TYPE)
    hashed = (k * 37) % 1009
    df = df.select(
        k.alias("tx_id"),
        F.col("o_orderdate").alias("created_at"),
        (F.lit(1) + F.datediff(F.col("o_orderdate").cast("date"), F.lit(STEP_ORIGIN).cast("date"))
         % STEP_PERIOD).cast("int").alias("step"),
        ttype.alias("type"),
        F.col("o_totalprice").alias("amount"),
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("nameOrig"),
        old_o.alias("oldbalanceOrg"),
        old_d.alias("oldbalanceDest"),
        F.concat(F.lit("M"), F.col("_dest").cast("string")).alias("nameDest"),
        hashed.alias("_h"),
        k.alias("_k"),
    )
    df = df.select(
        "tx_id", "created_at", "step", "type", "amount", "nameOrig", "oldbalanceOrg",
        F.when(F.col("_k") % 4 == 0, F.col("oldbalanceOrg"))
         .otherwise(F.greatest(F.col("oldbalanceOrg") - F.col("amount"), zero)).alias("newbalanceOrig"),
        "nameDest", "oldbalanceDest",
        F.when(F.col("_k") % 5 == 0, F.col("oldbalanceDest"))
         .otherwise(F.col("oldbalanceDest") + F.col("amount")).alias("newbalanceDest"),
        F.when((F.col("type").isin("TRANSFER", "CASH_OUT") & (F.col("_h") > 900))
               | (F.col("_k") % 97 == 0), F.lit(1)).otherwise(F.lit(0)).alias("isFraud"),
        F.when((F.col("type") == "TRANSFER") & (F.col("amount") > F.lit(400000.0)), F.lit(1))
         .otherwise(F.lit(0)).alias("isFlaggedFraud"),
        (F.col("_h").cast("double") / F.lit(1008.0)).alias("prob"),
    )
    return df if with_prob else df.drop("prob")


def requests(spark: SparkSession, sf_dir: str, tx: DataFrame | None = None) -> DataFrame:
    """Transactions as callers might send them: one in fifty of each fault (null,
    NaN and negative numbers, missing and unknown types, negative, missing and
    late steps), and one row in twenty sent twice."""
    t = tx if tx is not None else transactions(spark, sf_dir)
    r = F.col("tx_id") % 50
    null = F.lit(None)
    t = t.withColumns({
        "amount": F.when(r == 1, null).when(r == 9, -F.col("amount")).otherwise(F.col("amount")),
        "oldbalanceOrg": F.when(r == 3, F.lit(-1.0)).otherwise(F.col("oldbalanceOrg")),
        "newbalanceOrig": F.when(r == 2, F.lit(float("nan"))).otherwise(F.col("newbalanceOrig")),
        "newbalanceDest": F.when(r == 10, null).otherwise(F.col("newbalanceDest")),
        "type": F.when(r == 4, null).when(r == 5, F.lit("XYZ")).otherwise(F.col("type")),
        "step": F.when(r == 6, F.lit(-5)).when(r == 7, null).when(r == 8, F.lit(5000))
        .otherwise(F.col("step"))})
    copies = F.when(F.col("tx_id") % 20 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return t.withColumn("_copy", F.explode(copies)).drop("_copy")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tx_id, prob, isFraud: the evaluation input."""
    return transactions(spark, sf_dir).select("tx_id", "prob", "isFraud")


def sim_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> simulator-shaped events."""
    e = read_table(spark, sf_dir, "events")
    country = F.element_at(F.array(*[F.lit(c) for c in COUNTRIES]),
                           (F.col("user_id") % len(COUNTRIES) + 1).cast("int"))
    return e.select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("created_at"),
        (F.col("value") * F.lit(200.0)).alias("amount"),
        _case(F.col("event_type"), EVENT_TO_MERCHANT).alias("merchant_type"),
        country.alias("country"),
        F.hour("ts").alias("hour"),
        (F.col("event_id") % 6).cast("int").alias("suspicious_signals"),
        (F.col("event_id") % 7 == 0).alias("is_new_device"),
        (F.col("event_id") % 5 == 0).alias("velocity_flag"),
    )
