"""Exact dedup against a minimal perfect hash over historical digests.

History (rows seen before) is reduced to distinct SHA-256 digests. Digests are
dealt to buckets of about ``bucket_size`` by a uniform hash; each bucket gets a
minimal perfect hash (hash and displace: one pilot per small group of digests
sends them to free slots, n digests to exactly n slots). A slot holds the full
32-byte digest, the winner's locator (its doc_id) and the group size. Arriving
rows are first combined per digest, then looked up: one pilot read, one slot
read, one comparison of all digest bytes. Members are repeats and update their
slot's winner; nonmembers form groups of their own.

A text that a third of all rows share is one row after the map-side combine,
so no lookup group is hot; giving rows their group back is an equi-join with
one row per digest, whose large partitions AQE splits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txrisk.llm.common import store

INDEX_SCHEMA = ("bucket long, n int, pilots binary, digests binary, winners array<long>, "
                "sizes array<long>")
GROUP_SCHEMA = "digest binary, keep_id long, group_size long"
GROUPED = 3  # mean digests per pilot


def _words(raw: bytes) -> np.ndarray:
    """Digests as rows of four little-endian 64-bit words."""
    return np.frombuffer(raw, "<u8").reshape(-1, 4)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _slots(words: np.ndarray, pilots: np.ndarray, n: int) -> np.ndarray:
    return (_mix(words[:, 1] ^ _mix(words[:, 2] + pilots)) % np.uint64(n)).astype(np.int64)


def build_pilots(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pilots (uint64 per group) and the slot of every digest: a bijection onto
    range(n). Digests must be distinct."""
    n = len(words)
    groups = max(1, -(-n // GROUPED))
    group = (words[:, 0] % np.uint64(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    bounds = np.searchsorted(group[order], np.arange(groups + 1))
    pilots = np.zeros(groups, np.uint64)
    slot = np.full(n, -1, np.int64)
    free = np.ones(n, bool)
    sizes = np.diff(bounds)
    for g in np.argsort(-sizes, kind="stable"):
        if not sizes[g]:
            break
        rows = order[bounds[g]:bounds[g + 1]]
        first = 0
        while True:
            tries = np.arange(first, first + 256, dtype=np.uint64)
            at = (_mix(words[rows, 1][None, :] ^ _mix(words[rows, 2][None, :] + tries[:, None]))
                  % np.uint64(n)).astype(np.int64)
            good = free[at].all(1)
            if len(rows) > 1:
                s = np.sort(at, 1)
                good &= (s[:, 1:] != s[:, :-1]).all(1)
            hit = np.flatnonzero(good)
            if len(hit):
                pilots[g] = tries[hit[0]]
                slot[rows] = at[hit[0]]
                free[at[hit[0]]] = False
                break
            first += 256
    return pilots, slot


def lookup(words: np.ndarray, pilots: np.ndarray, slots_digests: np.ndarray) -> np.ndarray:
    """Slot of each queried digest, -1 for nonmembers (all 32 bytes compared)."""
    n = len(slots_digests)
    if not n or not len(words):
        return np.full(len(words), -1, np.int64)
    at = _slots(words, pilots[(words[:, 0] % np.uint64(len(pilots))).astype(np.int64)], n)
    return np.where((slots_digests[at] == words).all(1), at, -1)


def _joined(col) -> bytes:
    return b"".join(col.to_pylist())


def _long_list(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([a.tolist() for a in arrays], pa.list_(pa.int64()))


def _object_longs(col) -> np.ndarray:
    return np.array(col.to_pylist(), dtype=object)


def digests(docs: DataFrame, id_col: str, text_col: str, *extra: Column) -> DataFrame:
    """(doc_id, digest) with the SHA-256 of the unchanged text, null as empty."""
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit("").cast("binary"))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.unhex(F.sha2(text, 256)).alias("digest"), *extra)


def _combine(d: DataFrame, n_buckets: int) -> DataFrame:
    return (d.groupBy("digest").agg(F.max("doc_id").alias("winner"), F.count("*").alias("size"))
            .withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(n_buckets))))


def build_index(history: DataFrame, n_buckets: int) -> DataFrame:
    """The stored index: one row per bucket, from (doc_id, digest) rows."""

    def build(key, t):
        words = _words(_joined(t.column("digest")))
        pilots, slot = build_pilots(words)
        back = np.empty(len(words), np.int64)
        back[slot] = np.arange(len(words))
        winners = _object_longs(t.column("winner"))[back]
        sizes = _object_longs(t.column("size"))[back]
        return pa.table({
            "bucket": [key[0].as_py()], "n": pa.array([len(words)], pa.int32()),
            "pilots": [pilots.tobytes()], "digests": [words[back].tobytes()],
            "winners": _long_list([winners]), "sizes": _long_list([sizes])})

    built = _combine(history, n_buckets).groupBy("bucket").applyInArrow(build, INDEX_SCHEMA)
    return store(built, "digest-index")


def resolve(index: DataFrame, arrivals: DataFrame, n_buckets: int) -> DataFrame:
    """(digest, keep_id, group_size) over history and arrivals together.

    Members of the index update their slot, nonmembers are grouped separately.
    """

    def match(_key, idx, new):
        words = _words(_joined(new.column("digest")))
        winner = _object_longs(new.column("winner"))
        size = _object_longs(new.column("size"))
        if idx.num_rows:
            row = idx.to_pylist()[0]
            held = _words(row["digests"])
            pilots = np.frombuffer(row["pilots"], np.uint64)
            keep, total = list(row["winners"]), list(row["sizes"])
            at = lookup(words, pilots, held)
            for i in np.flatnonzero(at >= 0):
                s = at[i]
                total[s] += size[i]
                if winner[i] is not None and (keep[s] is None or winner[i] > keep[s]):
                    keep[s] = winner[i]
            rest = np.flatnonzero(at < 0)
        else:
            held, keep, total, rest = np.empty((0, 4), "<u8"), [], [], np.arange(len(words))
        out = [held[i].tobytes() for i in range(len(held))]
        out += [words[i].tobytes() for i in rest]
        return pa.table({"digest": pa.array(out, pa.binary()),
                         "keep_id": pa.array(keep + [winner[i] for i in rest], pa.int64()),
                         "group_size": pa.array(total + [size[i] for i in rest], pa.int64())})

    new = _combine(arrivals, n_buckets)
    return (index.groupBy("bucket").cogroup(new.groupBy("bucket"))
            .applyInArrow(match, GROUP_SCHEMA))


def exact_dedup(docs: DataFrame, historical: Column, id_col: str = "doc_id",
                text_col: str = "text", bucket_size: int = 1024) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    ``historical`` is a boolean column: rows that are already in the index when
    the others arrive (null counts as false). Texts are equal when identical;
    the largest doc_id of a group stays. Null text counts as empty. A null
    doc_id never wins: such a row is kept=false, and a group of only such rows
    has a null keep_id. A repeated row of the winning doc_id is the winner, too.
    Empty tables give an empty result; other columns are ignored.
    """
    d = store(digests(docs, id_col, text_col,
                      F.coalesce(historical, F.lit(False)).alias("old")), "digests")
    old, new = d.where("old"), d.where(~F.col("old"))
    n_buckets = max(1, -(-max(old.count(), new.count()) // bucket_size))
    groups = resolve(build_index(old, n_buckets), new, n_buckets)
    return (d.join(groups, "digest")
            .select("doc_id", "keep_id", "group_size",
                    F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"),
                    F.lower(F.hex("digest")).alias("text_sha256")))
