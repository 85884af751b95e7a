"""Mixing sources to target weights.

Each document gets a hash-random key. Within a source the keys are range-sorted
(the key is uniform, so equal ranges of its leading digits are balanced
buckets), running token counts come from bucket totals plus a running sum inside
the bucket, and the source is cut at its exact budget: whole epochs first, then
the prefix of the last epoch, cutting the one document on the boundary. No task
ever holds a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txrisk.llm.common import store

WORD = r"[^\x20\x09-\x0D]+"
SEED = 42
ROWS_PER_BUCKET = 2048
MAX_EPOCHS = 3


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def fill_targets(sources: DataFrame, weights: tuple = (1, 2, 3),
                 max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Adds ``target`` to (source, source_size), one row per source.

    Weights repeat over the sources in code-point order, null last. All sizes
    together are shared by weight; a target stops at ``max_epochs`` times its
    source and the excess is reshared by weight. The fixed point is a water
    level: in order of cap per weight, the first source whose cap is not below
    the level that the rest would get ends the capped prefix.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]),
                        ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sources.withColumn("_w", pick.cast("long")).withColumn(
        "_cap", F.col("source_size") * F.lit(max_epochs).cast("long"))
    s = s.withColumn("_ratio", F.col("_cap").cast("double") / F.col("_w"))
    order = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    s = s.withColumns({
        "_pos": F.row_number().over(order),
        "_left": F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0)),
        "_wleft": F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0))})
    s = s.withColumn("_level", F.col("_left").cast("double") / F.col("_wleft"))
    first = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.col("_pos"))).over(every)
    s = s.withColumn("_first", first)
    level = F.max(F.when(F.col("_pos") == F.col("_first"), F.col("_level"))).over(every)
    s = s.withColumn("_lam", level)
    return s.withColumn("target", F.when(
        F.col("_first").isNotNull() & (F.col("_pos") >= F.col("_first")),
        F.least(F.col("_lam") * F.col("_w"), F.col("_cap").cast("double")))
        .otherwise(F.col("_cap").cast("double"))).select("source", "source_size", "target")


def with_taken(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source",
               text_col: str = "text", seed: int = SEED, rows_per_bucket: int = ROWS_PER_BUCKET,
               weights: tuple = (1, 2, 3), max_epochs: int = MAX_EPOCHS,
               keep: list[str] | None = None) -> DataFrame:
    """(row, size, source_size, target, taken): the input row as a struct (its
    columns ``keep``, default all), its words, its source's words and target, and the words that the mix takes of it,
    repeats counted.

    Null text has size 0, a null source is a source of its own (last in order),
    a null doc_id is keyed by its text. Equal keys are ordered by doc_id and
    size; rows equal in all three are interchangeable. Sources of size 0 take
    nothing. Reruns agree: keys depend on the seed, the id and the text only.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), F.md5(text))))
    n = docs.select(F.count(F.lit(1)).alias("n")).first()["n"]
    n_buckets = max(1, n // rows_per_bucket)
    source = F.col(source_col).cast("string")
    keyed = docs.select(
        F.struct(*(keep or ["*"])).alias("row"), word_count(F.col(text_col)).alias("size"), key.alias("key"),
        F.col(id_col).alias("id"), source.alias("source"),
        F.coalesce(F.concat(F.lit("s"), source), F.lit("n")).alias("src"))
    u = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    keyed = keyed.withColumn("bucket", F.shiftright(u * F.lit(n_buckets).cast("long"), 32))
    # bucket totals: one row per source and key range, stored as both uses need them
    parts = store(keyed.groupBy("src", "bucket")
                  .agg(F.sum("size").alias("words"), F.first("source").alias("source")),
                  "mix-buckets")
    sources = parts.groupBy("src").agg(F.sum("words").alias("source_size"),
                                       F.first("source").alias("source"))
    targets = fill_targets(sources.select("source", "source_size"), weights, max_epochs).select(
        F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("src"),
        "source_size", "target")
    before = (Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("src").orderBy("bucket").rowsBetween(*before)
    plan = (parts.select("src", "bucket",
                         F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("ahead"))
            .join(targets, "src"))
    inside = Window.partitionBy("src", "bucket").orderBy("key", "id", "size").rowsBetween(*before)
    out = (keyed.select("row", "size", "src", "bucket",
                        F.coalesce(F.sum("size").over(inside), F.lit(0)).alias("inside"))
           .join(plan, ["src", "bucket"]))
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0,
                    F.floor(budget / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("long")
    rest = budget - F.col("epochs") * F.col("source_size")
    last = F.greatest(F.lit(0).cast("long"),
                      F.least(F.col("size"), rest - F.col("ahead") - F.col("inside")))
    return out.withColumn("epochs", epochs).select(
        "row", "size", "source_size", "target",
        (F.col("epochs") * F.col("size") + last).cast("long").alias("taken"))


def mix(docs: DataFrame, **kw) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of ``docs``."""
    out = with_taken(docs, keep=["doc_id"], **kw)
    return out.select("row.doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, **kw) -> DataFrame:
    """The mix itself: the columns of ``docs``, one row per epoch of a document.

    Whole epochs repeat the row. The document on a source's boundary also gives
    its leading words (with the white space before each) up to the exact
    budget. Documents without words take nothing and leave the mix.
    """
    out = with_taken(docs, **kw).where("taken > 0")
    out = out.withColumn("copy", F.explode(F.sequence(
        F.lit(1).cast("long"), F.ceil(F.col("taken") / F.col("size")).cast("long"))))
    words = (F.col("taken") - (F.col("copy") - 1) * F.col("size")).cast("int")
    text = F.col("row.text")
    head = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(
        r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), words), "")
    cut = F.when(words >= F.col("size"), text).otherwise(head)
    return out.select(*[cut.alias(c) if c == "text" else F.col("row").getField(c).alias(c)
                        for c in docs.columns])
