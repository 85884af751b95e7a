"""Token-id output: best-fit-decreasing packing into fixed-width id matrices.

Texts are encoded with a byte-level vocabulary (ids decode to the exact bytes),
each document ends with an end id. Documents longer than the window are split
losslessly into full windows and a remainder. Documents are dealt to shards of
bounded size by a uniform hash; in a shard, pieces go in decreasing order to the
sequence with the least remaining room that still fits, found by a search over a
segment tree of room sizes. A sequence becomes one row: its padded ids, cumulative
segment lengths and the positions where position ids restart.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk.llm.common import frees_memory
from txrisk.llm.tokens import BYTE_BPE, byte_encoding, vocabulary_path

WINDOW = 2048
END_ID = 50256           # free in the vocabulary
PAD_ID = 50256
SHARD_BYTES = 12 << 20
SCHEMA = ("sequence_id long, ids binary, n_tokens int, cu_seqlens array<int>, "
          "position_resets array<int>, doc_ids array<long>, doc_starts array<long>")


class RoomTree:
    """Open sequences by remaining room: a segment tree over room sizes 0..cap
    whose nodes say whether any sequence below has such room."""

    def __init__(self, cap: int):
        self.size = 1 << cap.bit_length()
        self.count = [0] * (2 * self.size)
        self.at: list[list[int]] = [[] for _ in range(cap + 1)]

    def add(self, room: int, seq: int) -> None:
        self.at[room].append(seq)
        i = room + self.size
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The sequence with the least room >= need, removed; None if none."""
        i = need + self.size
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):   # up to a right sibling with some
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        room = i - self.size
        seq = self.at[room].pop()
        while i:
            self.count[i] -= 1
            i >>= 1
        return room, seq


def best_fit_decreasing(sizes: list[int], window: int) -> list[list[int]]:
    """Pieces (indexes into ``sizes``, each at most ``window``) of every sequence."""
    tree, out = RoomTree(window), []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = tree.take(sizes[i])
        if found is None:
            room, seq = window, len(out)
            out.append([])
        else:
            room, seq = found
        out[seq].append(i)
        tree.add(room - sizes[i], seq)
    return out


def packed_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               window: int = WINDOW, shard_bytes: int = SHARD_BYTES,
               folder: str | None = None) -> DataFrame:
    """One row per packed sequence.

    ids: ``window`` little-endian unsigned 16-bit ids, padded at the end;
    cu_seqlens: 0 and the running ends of the segments; position_resets: where
    each segment starts; doc_ids and doc_starts: the document of each segment and
    the number of its ids before it. Null and empty texts are the end id alone;
    null doc_ids stay null; repeated rows are packed as often as they occur;
    empty tables give an empty result; other columns are ignored.
    """
    import public_tokenizers
    path, pattern = vocabulary_path(BYTE_BPE, folder), public_tokenizers.PATTERN
    total = docs.select(F.sum(F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) + 2)
                        .alias("b")).first()["b"] or 0
    shards = max(1, -(-total // shard_bytes))

    def encode(batches):
        enc = byte_encoding(path, pattern)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids = [np.array(enc.encode_ordinary(x.as_py() or "") + [END_ID], "<u2").tobytes()
                       for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())],
                                                 ["doc_id", "ids"])

    def build(key, t):
        shard = key[0].as_py()
        ids, doc = t.column("ids").to_pylist(), t.column("doc_id").to_pylist()
        order = sorted(range(len(doc)), key=lambda i: (doc[i] is None, doc[i] or 0, ids[i]))
        pieces = []                               # (document, first id, ids)
        for d in order:
            n = len(ids[d]) // 2
            pieces += [(d, s, min(window, n - s)) for s in range(0, n, window)]
        rows: list[list] = [[] for _ in range(7)]
        pad = np.array([PAD_ID], "<u2").tobytes()
        for k, members in enumerate(best_fit_decreasing([p[2] for p in pieces], window)):
            segs = [pieces[i] for i in members]
            ends = np.cumsum([n for _, _, n in segs]).tolist()
            raw = b"".join([ids[d][2 * s:2 * (s + n)] for d, s, n in segs])
            for c, v in zip(rows, ((shard << 32) + k, raw + pad * (window - ends[-1]), ends[-1],
                                   [0, *ends], [0, *ends[:-1]], [doc[d] for d, _, _ in segs],
                                   [s for _, s, _ in segs])):
                c.append(v)
        i32, i64 = pa.int32(), pa.int64()
        types = [i64, pa.binary(), i32, pa.list_(i32), pa.list_(i32), pa.list_(i64), pa.list_(i64)]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        return pa.table([pa.array(c, ty) for c, ty in zip(rows, types)], names=names)

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = d.mapInArrow(frees_memory(encode, cached=True), "doc_id long, ids binary").withColumn(
        "shard", F.pmod(F.xxhash64("doc_id", "ids"), F.lit(shards)))
    # as many partitions as shards, whatever the session's shuffle setting is
    return rows.repartition(shards, "shard").groupBy("shard").applyInArrow(build, SCHEMA)


def write_matrices(packed: DataFrame, path: str) -> None:
    """Write packed sequences as Parquet files, one matrix row per record."""
    packed.write.mode("overwrite").parquet(path)
