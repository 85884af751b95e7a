import random

import numpy as np
import pytest

from tests.llm.helpers import clashing, documents, words
from txrisk.llm.token_output import (END_ID, PAD_ID, RoomTree, best_fit_decreasing, packed_ids,
                                     write_matrices)


def _slow_best_fit(sizes, window):
    room, out = [], []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [r for r in room if r >= sizes[i]]
        if not fits:
            room.append(window - sizes[i])
        else:
            room[room.index(min(fits))] -= sizes[i]
    return sorted(window - r for r in room)


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_decreasing_fills_like_a_linear_search(seed):
    rng = random.Random(seed)
    window = rng.choice([7, 64, 100])
    sizes = [rng.randint(1, window) for _ in range(200)]
    got = best_fit_decreasing(sizes, window)
    assert sorted(i for s in got for i in s) == list(range(200))
    assert sorted(sum(sizes[i] for i in s) for s in got) == _slow_best_fit(sizes, window)


def test_room_tree_finds_the_least_room():
    t = RoomTree(10)
    assert t.take(1) is None
    for room, seq in ((3, 0), (9, 1), (5, 2)):
        t.add(room, seq)
    assert t.take(4) == (5, 2)
    assert t.take(4) == (9, 1)
    assert t.take(4) is None and t.take(3) == (3, 0)


def test_matrices_decode_to_the_texts(spark):
    import public_tokenizers
    from txrisk.llm.tokens import BYTE_BPE, byte_encoding
    rng = random.Random(2)
    rows = [(i, words(rng, rng.randint(1, 80)), "en", "s") for i in range(60)]
    rows += [(100, None, "en", "s"), (101, "", "en", "s"), (102, words(rng, 30_000), "en", "s"),
             (103, "Ünï \U0001F600\n\n  <|endoftext|> x", "en", "s"), (104, "same", "en", "s"),
             (104, "same", "en", "s"), (None, "no id", "en", "s")]
    df = packed_ids(clashing(documents(spark, rows)), window=256, shard_bytes=20_000)
    enc = byte_encoding(public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN)
    parts = {}
    seen = df.collect()
    assert len({r["sequence_id"] for r in seen}) == len(seen)
    for r in seen:
        ids = np.frombuffer(r["ids"], "<u2")
        assert len(ids) == 256 and (ids[r["n_tokens"]:] == PAD_ID).all()
        assert r["cu_seqlens"][0] == 0 and r["cu_seqlens"][-1] == r["n_tokens"]
        assert r["position_resets"] == r["cu_seqlens"][:-1]
        for d, s, a, b in zip(r["doc_ids"], r["doc_starts"], r["cu_seqlens"], r["cu_seqlens"][1:]):
            parts.setdefault(d, []).append((s, ids[a:b].tolist()))
    got = []
    for d, ps in parts.items():
        ids = [x for _, p in sorted(ps) for x in p]
        text, at = [], 0
        for k, x in enumerate(ids):
            if x == END_ID:
                got.append((d, enc.decode(ids[at:k])))
                at = k + 1
        assert at == len(ids)
    assert sorted(got, key=str) == sorted(((i, t or "") for i, t, *_ in rows), key=str)


def test_empty_table(spark):
    assert packed_ids(documents(spark, [])).count() == 0


def test_written_matrices_read_back(spark, tmp_path):
    packed = packed_ids(documents(spark, [(1, "one two three", "en", "s"), (2, "four", "en", "s")]))
    write_matrices(packed, str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(got.collect(), key=str) == sorted(packed.collect(), key=str)
