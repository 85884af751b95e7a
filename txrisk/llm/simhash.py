"""SimHash near-dedup with pigeonring candidate filtering.

A 64-bit fingerprint is cut into m = d + 1 segments on a ring. If two
fingerprints differ in at most d bits, some segment starts a chain of
consecutive segments in which every prefix of l segments differs in at most
l * d / m bits. Chains are checked in order of cost:

* the first segment may not differ at all: an equality key;
* the first two may differ in b2 = floor(2d/m) bits: the second segment is cut
  into b2 + 1 pieces, one of which must be equal, which joins the key;
* the join condition checks every prefix of the chain, then the full distance.

Only distinct fingerprints are joined. A group of identical fingerprints, however
large, is one row, so copies are never expanded into pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txrisk.llm.common import frees_memory, store
from txrisk.llm.components import connected_components

BITS = 64
CHUNK = 1 << 15  # shingles hashed at a time, so long texts need little memory


def fingerprint(text: bytes | None, shingle: int, seed: int) -> int:
    """Unsigned 64-bit majority fingerprint of a UTF-8 text (null: no words)."""
    import xxhash
    if not text:
        return 0
    words = text.lower().split()  # bytes: A-Z only; splits at 0x20 and 0x09-0x0D
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - shingle + 1
    counts = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        to = min(n, at + CHUNK)
        hashes = np.fromiter(
            (digest(joined[s:e], seed) for s, e in
             zip(starts[at:to].tolist(), ends[at + shingle - 1:to + shingle - 1].tolist())),
            np.uint64, to - at)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1,
                                bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(counts * 2 > n, bitorder="little")
    return int.from_bytes(bits.tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = 3,
                 seed: int = 42, *others: str) -> DataFrame:
    """(doc_id, fp) for every row, and ``others``, long columns of ``docs``; fp is the
    fingerprint as a signed long."""

    def run(batches):
        for b in batches:
            fps = np.fromiter((fingerprint(x.as_py(), shingle, seed) for x in b.column(1)),
                              np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(fps.view(np.int64)), *b.columns[2:]],
                ["doc_id", "fp", *others])

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                    F.col(text_col).cast("binary").alias("text"), *others)
    schema = ", ".join(f"{c} long" for c in ("doc_id", "fp", *others))
    return d.mapInArrow(frees_memory(run), schema)


def _segments(max_bits: int) -> list[tuple[int, int]]:
    """(offset, width) of the d + 1 ring segments."""
    m = max_bits + 1
    cuts = [BITS * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _long(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >= 1 << 63 else x).cast("long")


def _mask(offset: int, width: int) -> int:
    return ((1 << width) - 1) << offset


def linked_fingerprints(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """Pairs (a, b), a < b, of the distinct values of ``fp`` at most ``max_bits``
    apart. Complete: every such pair has a chain that meets its budgets."""
    if max_bits == 0:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where(F.lit(False))
    seg = _segments(max_bits)
    m = len(seg)
    budget = [(length * max_bits) // m for length in range(1, m + 1)]  # budget[0] = 0
    keys = []
    for i, (off, width) in enumerate(seg):
        off2, width2 = seg[(i + 1) % m]
        pieces = budget[1] + 1
        cuts = [width2 * p // pieces for p in range(pieces + 1)]
        for p in range(pieces):
            part = _mask(off2 + cuts[p], cuts[p + 1] - cuts[p])
            keys.append(F.struct(F.lit(i).alias("start"), F.lit(p).alias("piece"),
                                 F.col("fp").bitwiseAND(_long(_mask(off, width) | part))
                                 .alias("key")))
    probe = fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.*")
    a, b = probe.alias("a"), probe.alias("b")
    diff = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    chain = None
    for i in range(m):
        ok, mask = F.lit(True), 0
        for length in range(1, m + 1):
            mask |= _mask(*seg[(i + length - 1) % m])
            ok = ok & (F.bit_count(diff.bitwiseAND(_long(mask))) <= budget[length - 1])
        case = (F.col("a.start") == i) & ok
        chain = case if chain is None else chain | case
    cond = ((F.col("a.start") == F.col("b.start")) & (F.col("a.piece") == F.col("b.piece"))
            & (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp"))
            & chain & (F.bit_count(diff) <= max_bits))
    return a.join(b, cond).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b")).distinct()


def simhash_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = 3, max_bits: int = 2, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id) per row; component_id is the smallest doc_id
    reachable by links, the document itself included.

    Null and wordless texts have fingerprint 0 and link like any other; texts
    with fewer words than a shingle hash the whole sequence. A null doc_id is
    never a component_id (unless no row of the class has an id). Repeated rows
    share their class. Empty tables give an empty result.
    """
    d = store(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    return d.join(_classes(d, max_bits), "fp").select("doc_id", "fp", "component_id")


def _classes(d: DataFrame, max_bits: int) -> DataFrame:
    """(fp, label, component_id) of the fingerprints of stored rows (doc_id, fp)."""
    distinct = store(d.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct-fingerprints")
    labels = connected_components(linked_fingerprints(distinct.select("fp"), max_bits), "a", "b")
    # class of a fingerprint = smallest fingerprint reachable; its id = smallest doc_id inside
    named = store(distinct.join(labels, distinct["fp"] == labels["node"], "left")
                  .select("fp", "rep", F.coalesce("label", "fp").alias("label")), "labels")
    smallest = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    return named.join(smallest, "label").select("fp", "label", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one_per_class(docs: DataFrame, shingle: int = 3, max_bits: int = 2,
                       seed: int = 42) -> DataFrame:
    """One row of ``docs`` per class: one whose doc_id is the component_id.

    Rows are told apart by doc_id and text, so an id that repeats with texts of
    several classes keeps each class's row. Rows without a doc_id cannot be told
    apart and always stay. Columns of ``docs`` are returned.
    """
    cols = docs.columns
    named = docs.where(F.col("doc_id").isNotNull())
    key = [F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_hash")]
    d = store(fingerprints(docs.select("doc_id", "text", key[1]), "doc_id", "text", shingle, seed,
                           "_hash"), "fingerprints")
    # one (doc_id, text) of each class
    keep = (d.join(_classes(d, max_bits), "fp").where(F.col("doc_id") == F.col("component_id"))
            .groupBy("label").agg(F.min(F.struct("doc_id", "_hash")).alias("row"))
            .select(F.col("row.doc_id").alias("_id"), F.col("row._hash").alias("_hash")))
    rows = named.select(F.struct(*cols).alias("row"), *key)
    kept = rows.join(keep, ["_id", "_hash"], "left_semi").dropDuplicates(["_id", "_hash"])
    return (kept.select(*[F.col("row").getField(c).alias(c) for c in cols])
            .unionByName(docs.where(F.col("doc_id").isNull())))
