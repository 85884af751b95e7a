"""Hierarchical multi-length packing.

Documents are dealt to shards of bounded size by a uniform hash. In a shard
every document is cut into full windows of the longest tier; its remainder is
routed to the smallest context size (tier) that holds it. Tiers are packed from
the longest to the shortest: each window takes its own document, then the gap
is filled best-fit with remainders of shorter tiers, and what is left of the
gap is closed by cutting one more document. So every sequence is exactly as
long as its tier, a power of two that needs no padding, except at most one
per shard, which is padded to the longest tier. Sequences of a shard are dealt
to step groups of nearly equal attention cost, most costly first.
"""

from __future__ import annotations

import bisect
import heapq
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk.llm.common import frees_memory
from txrisk.llm.tokens import WORD_BPE, vocabulary_path, word_tokenizer

TIERS = (512, 1024, 2048, 4096)
SHARD_BYTES = 12 << 20   # bytes of text per shard; token ids take about as many
STEP_TOKENS = 1 << 16
END_ID = 2
ENCODE_CHARS = 1 << 20   # characters tokenised at a time
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long, window int, step_group long")


def pack_lengths(lengths: list[int], tiers: tuple = TIERS) -> list[tuple[int, list]]:
    """Sequences (tier, [(document, start, length, offset), ...]) of a shard.

    ``lengths`` are token counts by document. Every token lies in one piece.
    """
    top = tiers[-1]
    out: list[tuple[int, list]] = []
    pool: list[tuple[int, int, int]] = []   # (length, document, start), ascending
    for d, n in enumerate(lengths):
        full = n - n % top
        out += [(top, [(d, s, top, 0)]) for s in range(0, full, top)]
        if n > full:
            pool.append((n - full, d, full))
    pool.sort()
    left = sum(x[0] for x in pool)
    for tier, below in zip(reversed(tiers), [*reversed(tiers[:-1]), 0]):
        # documents of this tier, then (last tier) anything while a window can be filled
        while pool and left >= tier and pool[-1][0] > below:
            n, d, s = pool.pop()
            if n > tier:                         # too few tokens left for its own tier
                bisect.insort(pool, (n - tier, d, s + tier))
                n = tier
            pieces, used = [(d, s, n, 0)], n
            while used < tier:
                gap = tier - used
                i = bisect.bisect_right(pool, (gap, len(lengths), 0)) - 1
                if i >= 0:                       # best fit: the longest that fits
                    n, d, s = pool.pop(i)
                else:                            # none fits: cut the shortest
                    whole, d, s = pool.pop(0)
                    n = gap
                    bisect.insort(pool, (whole - gap, d, s + gap))
                pieces.append((d, s, n, used))
                used += n
            left -= tier
            out.append((tier, pieces))
    if pool:                                     # less than one window is left
        for tier in (*reversed(tiers), 0):
            while pool and (left >= tier > 0 or not tier):
                size, pieces, used = tier or left, [], 0
                while used < size:
                    n, d, s = pool.pop()
                    take = min(n, size - used)
                    if take < n:
                        bisect.insort(pool, (n - take, d, s + take))
                    pieces.append((d, s, take, used))
                    used += take
                left -= size
                out.append((tier or top, pieces))
    return out


def step_groups(sequences: list[tuple[int, list]], step_tokens: int) -> list[int]:
    """Group of every sequence: most costly first into the lightest group, where
    cost is the attention cost (sum of squared piece lengths)."""
    n = max(1, round(sum(t for t, _ in sequences) / step_tokens))
    heap = [(0, g) for g in range(n)]
    out = [0] * len(sequences)
    cost = [sum(p[2] * p[2] for p in pieces) for _, pieces in sequences]
    for i in sorted(range(len(sequences)), key=lambda i: (-cost[i], i)):
        load, g = heapq.heappop(heap)
        out[i] = g
        heapq.heappush(heap, (load + cost[i], g))
    return out


def token_rows(docs: DataFrame, id_col: str, text_col: str, path: str) -> DataFrame:
    """(doc_id, ids): ids of the whole text and the end id, 32-bit little-endian."""
    end = END_ID.to_bytes(4, "little")

    def run(batches):
        tok = word_tokenizer(path)
        for b in batches:
            at = 0
            while at < b.num_rows:               # bounded pieces of a batch
                texts, size, first = [], 0, at
                while at < b.num_rows and size < ENCODE_CHARS:
                    texts.append(b.column(1)[at].as_py() or "")
                    size += len(texts[-1])
                    at += 1
                ids = [x + end for x in tok.encode_many(texts)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, at - first), pa.array(ids, pa.binary())],
                    ["doc_id", "ids"])

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return d.mapInArrow(frees_memory(run, cached=True), "doc_id long, ids binary")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         tiers: tuple = TIERS, shard_bytes: int = SHARD_BYTES, step_tokens: int = STEP_TOKENS,
         folder: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, and the sequence's window (tier) and step_group.

    Null and empty texts are the end id alone. A null doc_id is kept as null.
    Repeated rows are packed as often as they occur. Very long texts are cut
    into windows of the longest tier. Empty tables give an empty result; other
    columns are ignored.
    """
    path = vocabulary_path(WORD_BPE, folder)
    total = docs.select(F.sum(F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) + 4)
                        .alias("b")).first()["b"] or 0
    shards = max(1, -(-total // shard_bytes))
    rows = token_rows(docs, id_col, text_col, path).withColumn(
        "shard", F.pmod(F.xxhash64("doc_id", "ids"), F.lit(shards)))

    def run(key, t):
        shard = key[0].as_py()
        ids = t.column("ids").to_pylist()
        doc = t.column("doc_id").to_pylist()
        order = sorted(range(len(doc)), key=lambda i: (doc[i] is None, doc[i] or 0, ids[i]))
        ids, doc = [ids[i] for i in order], [doc[i] for i in order]
        sequences = pack_lengths([len(x) // 4 for x in ids], tiers)
        groups = step_groups(sequences, step_tokens)
        cols: list[list] = [[] for _ in range(9)]
        for k, (tier, pieces) in enumerate(sequences):
            for d, s, n, at in pieces:
                crc = zlib.crc32(memoryview(ids[d])[4 * s:4 * (s + n)])
                for c, v in zip(cols, (doc[d], s, n, crc, len(ids[d]) // 4, (shard << 32) + k,
                                       at, tier, (shard << 32) + groups[k])):
                    c.append(v)
        types = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        return pa.table([pa.array(c, ty) for c, ty in zip(cols, types)], names=names)

    # as many partitions as shards, whatever the session's shuffle setting is
    return rows.repartition(shards, "shard").groupBy("shard").applyInArrow(run, SCHEMA)
