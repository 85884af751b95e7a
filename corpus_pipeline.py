"""The corpus pipeline: language ID, line dedup, SimHash near-dedup, mixing of
sources, packing. Every stage works on all that its predecessor kept; its result
is written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk.llm import langid, line_dedup, mixing, packing, simhash
from txrisk.llm.common import prepare, store, table

#: Share of a text's n-grams that the learned languages must know.
MIN_COVERAGE = 0.5


def _counted(df: DataFrame) -> DataFrame:
    """n_chars, where there is such a column, follows the text."""
    if "n_chars" not in df.columns:
        return df
    kind = df.schema["n_chars"].dataType
    return df.withColumn("n_chars", F.length("text").cast(kind))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language stay. Rejected: null texts, texts without a
    letter, and texts most of whose n-grams no learned language has. If nothing
    could be learned (no labels), documents with a letter stay."""
    prepare(spark)
    names = ("_lang_pred", "_lang_score", "_lang_coverage")
    train = docs.select("doc_id", "text", "lang").where(~langid.held_out())
    model = langid.fit(train)
    if model is None:
        return docs.where(langid.has_letter(F.col("text")))
    out = langid.predict(docs, model, "text", names)
    return out.where((F.col(names[0]) != langid.UNKNOWN)
                     & (F.col(names[2]) >= MIN_COVERAGE)).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go, of any length; so do documents that consisted
    of them."""
    prepare(spark)
    out = line_dedup.drop_recurring_lines(docs, min_tokens=1, long_docs=2, tree=True)
    blank = F.coalesce(F.col("text").rlike(r"^[\x20\x09-\x0D]*$"), F.lit(False))
    return _counted(out.where(~((F.col("_dropped") > 0) & blank)).select(*docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash class stays."""
    prepare(spark)
    return simhash.keep_one_per_class(docs, shingle=3, max_bits=2, seed=42)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; documents repeat by epoch."""
    prepare(spark)
    return _counted(mixing.mixed_documents(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    prepare(spark)
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("line_dedup", drop_lines), ("simhash", near_dedup),
          ("mix", mix_sources), ("pack", pack_sequences)]

#: The kernel classifier has no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
