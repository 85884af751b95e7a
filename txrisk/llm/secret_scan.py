"""Secret scans with an incremental blob ledger, in DataFrame functions only.

Every version of every path is content-addressed: its *blob* is the SHA-256 of its
whole text. The ledger is a folder of written tables:

- ``paths``: which path and version holds which blob;
- ``pairs``: which blobs have been scanned under which rules (a rule is known by kind and
  version, so a changed rule is a new one);
- ``findings``: one row per match: blob, kind, version, start, stop (code points, end
  exclusive).

A scan takes the distinct blobs of the given texts, looks up which (blob, rule) pairs
are new and evaluates those alone; findings are joined back to all paths. A blob is
scanned once however many paths and versions hold it. Texts meet once in a shuffle,
combined per task first, so the copies of one text are a row per task. Each scan adds
its own part of ``findings``, then of ``pairs``; findings count only if their scan's
pairs are there, so a scan that is lost half-way leaves nothing and may be repeated.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from txrisk.llm.common import store


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern``; those whose group ``group`` has
    fewer than ``least`` code points are dropped (after matching). ``kind`` names it in
    findings; a change of pattern or length needs a new ``version``."""

    kind: str
    version: int
    pattern: str
    least: int = 0
    group: int = 0

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The base rules (pattern, smallest length). A run of at least 24 hex
# digits is matched at once: shorter runs would be dropped, and runs cannot overlap.
BASE = [
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
                      r"""([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 20),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
]
# Public formats of tokens and keys.
ADDED = [
    Rule("pem", 1, r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{20,}"),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", 1, r"xox[abprs]-[A-Za-z0-9-]{20,}"),
]
RULES = BASE + ADDED

FINDINGS = "blob string, kind string, version int, start long, stop long, scan string"
PAIRS = "blob string, rules array<string>, scan string"


def blob(text: Column) -> Column:
    """Content address of a text; null counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _add(df: DataFrame, ledger: str, name: str, scan: str) -> None:
    df.write.parquet(f"{ledger.rstrip('/')}/{name}/scan={scan}")


def _table(spark: SparkSession, ledger: str, name: str, schema: str) -> DataFrame:
    """A table of the ledger; without rows before its first part is written."""
    path = f"{ledger.rstrip('/')}/{name}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def findings(spark: SparkSession, ledger: str) -> DataFrame:
    """All findings of finished scans."""
    over = _table(spark, ledger, "pairs", PAIRS).select("scan").distinct()
    return _table(spark, ledger, "findings", FINDINGS).join(over, "scan", "left_semi")


def record(versions: DataFrame, ledger: str, text: str = "text") -> None:
    """Enter versions into the ledger: all columns but the text are the path (clashing
    names are no matter, they are kept in a struct). Rows entered twice stay twice."""
    keep = [F.col(f"`{c}`") for c in versions.columns if c != text]
    _add(versions.select(F.struct(*keep).alias("path"), blob(F.col(text)).alias("blob")),
         ledger, "paths", f"s{uuid.uuid4().hex}")


def unscanned(texts: DataFrame, ledger: str, rules: list[Rule], text: str = "text") -> DataFrame:
    """(blob, text, todo): distinct texts with rules they have not met, and those rules."""
    keys = F.array(*[F.lit(r.key) for r in rules])
    blobs = texts.select(F.coalesce(F.col(text), F.lit("")).alias("text")).select(
        blob(F.col("text")).alias("blob"), "text").groupBy("blob").agg(F.first("text").alias("text"))
    seen = _table(texts.sparkSession, ledger, "pairs", PAIRS).groupBy("blob").agg(
        F.flatten(F.collect_list("rules")).alias("seen"))
    todo = F.coalesce(F.array_except(keys, F.col("seen")), keys)
    return (blobs.join(seen, "blob", "left").select("blob", "text", todo.alias("todo"))
            .where(F.size("todo") > 0))


def matches(blobs: DataFrame, rules: list[Rule]) -> DataFrame:
    """(blob, kind, version, start, stop) for (blob, text, todo): every rule in ``todo``
    over the whole text.

    Splitting a text at a rule's matches gives the lengths between them, and a running
    sum over a blob's matches gives their places; the texts themselves stay behind.
    """
    text, found = F.col("text"), []
    for r in rules:
        on = F.array_contains("todo", r.key) & text.rlike(r.pattern)
        found.append(F.when(on, F.struct(
            F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"),
            F.arrays_zip(F.regexp_extract_all(text, F.lit(r.pattern), F.lit(0)).alias("hit"),
                         F.transform(F.split(text, r.pattern, -1), F.length).alias("gap")).alias("hits"))))
    one = blobs.select("blob", F.explode(F.array(*found)).alias("f")).where(F.col("f").isNotNull())
    one = one.select("blob", "f.kind", "f.version", "f.hits")
    hit = one.select("blob", "kind", "version", F.posexplode("hits").alias("at", "m"))
    # there is one length more than matches: what follows the last one
    hit = hit.where(F.col("m.hit").isNotNull())
    upto = Window.partitionBy("blob", "kind", "version").orderBy("at").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    size = F.length("m.hit").cast("long")
    hit = hit.select("blob", "kind", "version", F.col("m.hit").alias("hit"), size.alias("size"),
                     F.sum(size + F.col("m.gap")).over(upto).alias("stop"))
    kept = F.lit(True)
    for r in rules:
        if r.least:
            mine = (F.col("kind") == r.kind) & (F.col("version") == r.version)
            kept = F.when(mine, F.length(F.regexp_extract("hit", r.pattern, r.group)) >= r.least).otherwise(kept)
    return hit.where(kept).select(
        "blob", "kind", "version", (F.col("stop") - F.col("size")).alias("start"), "stop")


def scan(texts: DataFrame, ledger: str, rules: list[Rule] = RULES, text: str = "text") -> None:
    """Scan the texts' blobs under the rules that they have not met, and enter the result.

    Null texts are empty blobs; copies, in this call or in earlier ones, are scanned
    once; of an empty table nothing is entered. Other columns are ignored.
    """
    me, spark = f"s{uuid.uuid4().hex}", texts.sparkSession
    _add(matches(unscanned(texts, ledger, rules, text), rules), ledger, "findings", me)
    keys = F.array(*[F.lit(r.key) for r in rules])
    seen = _table(spark, ledger, "pairs", PAIRS).select("blob", F.explode("rules").alias("rule")).groupBy(
        "blob").agg(F.collect_set("rule").alias("seen"))
    todo = F.coalesce(F.array_except(keys, F.col("seen")), keys)
    new = texts.select(blob(F.col(text)).alias("blob")).distinct().join(seen, "blob", "left").select(
        "blob", todo.alias("rules")).where(F.size("rules") > 0)
    _add(new, ledger, "pairs", me)


def by_path(spark: SparkSession, ledger: str, rules: list[Rule] = RULES) -> DataFrame:
    """(path, blob, spans) of every version recorded: spans are (start, stop, kind) of
    all findings under ``rules``, by start, then the rules' order; empty for clean texts.

    The spans of a blob are one row, written before the join: copies of one text are
    then rows of the other side only, which Spark may split.
    """
    now = F.array(*[F.lit(r.key) for r in rules])
    key = F.concat("kind", F.lit("@"), F.col("version").cast("string"))
    place = F.array_position(now, key)
    per_blob = findings(spark, ledger).where(place > 0).groupBy("blob").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("start", place.alias("place"), "stop", "kind"))),
        lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))
    ).alias("spans"))
    per_blob = store(per_blob, "secret-spans")
    paths = spark.read.parquet(f"{ledger.rstrip('/')}/paths")
    none = F.array().cast(per_blob.schema["spans"].dataType)
    return paths.join(per_blob, "blob", "left").select(
        "path", "blob", F.coalesce("spans", none).alias("spans"))


def summarise(found: DataFrame) -> DataFrame:
    """doc_id, matches per base kind, and digests of the spans of ``by_path``."""
    def of(*kinds: str) -> Column:
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    def text(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")

    base = [r.kind for r in BASE]
    return found.select(F.col("path.doc_id").alias("doc_id"),
                        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in base],
                        F.sha2(text(of(*base)), 256).alias("base_sha256"),
                        text(F.col("spans")).alias("spans"))
