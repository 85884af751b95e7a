import random
import zlib

import numpy as np
import pytest

from tests.llm.helpers import clashing, documents, words
from txrisk.llm.packing import END_ID, TIERS, pack, pack_lengths, step_groups
from txrisk.llm.tokens import WORD_BPE, vocabulary_path, word_tokenizer


@pytest.mark.parametrize("seed", range(6))
def test_every_token_is_packed_once_and_only_one_sequence_is_padded(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([1, 2, 7, 300, 511, 512, 513, 1500, 2049, 4095, 4096, 4097, 9000, 50_001])
               for _ in range(rng.choice([0, 1, 3, 200]))]
    seqs = pack_lengths(lengths)
    seen = {}
    odd = 0
    for tier, pieces in seqs:
        at = 0
        for d, s, n, offset in pieces:
            assert n > 0 and offset == at
            at += n
            seen.setdefault(d, []).append((s, n))
        assert at <= tier
        odd += at != tier
    assert odd <= 1
    assert len(seen) == len(lengths)
    for d, ps in seen.items():
        at = 0
        for s, n in sorted(ps):
            assert s == at
            at += n
        assert at == lengths[d]
    groups = step_groups(seqs, 8192)
    assert len(groups) == len(seqs)


def test_short_documents_fill_gaps_whole_before_any_is_cut():
    seqs = pack_lengths([3000, 1000, 96, 4096])
    assert sorted(seqs, key=str) == sorted([(4096, [(3, 0, 4096, 0)]),
                                            (4096, [(0, 0, 3000, 0), (1, 0, 1000, 3000),
                                                    (2, 0, 96, 4000)])], key=str)


def test_step_groups_are_balanced():
    rng = random.Random(0)
    seqs = pack_lengths([rng.randint(1, 3000) for _ in range(2000)])
    groups = step_groups(seqs, 1 << 16)
    cost = {}
    for g, (_, ps) in zip(groups, seqs):
        cost[g] = cost.get(g, 0) + sum(p[2] ** 2 for p in ps)
    assert max(cost.values()) < 1.1 * min(cost.values())


TEXTS = ["The quick brown fox, it's 42 don't stop.", "", "  \n\t ", "Ünïcödé ﬁn İstanbul ΣΑΣ",
         "<|endoftext|> and <|startoftext|>", "a b c", "A" * 300, "é combining",
         "x.y,z 'll 've", "日本語 text \U0001F600", "don't, can't. won't", "İI ıi ß STRASSE", "1,000.50,",
         ", . ,. word. word, WORD. .word"]


def test_chunked_ids_equal_the_tokenizer():
    from tokenizers import Tokenizer
    path = vocabulary_path(WORD_BPE)
    whole = Tokenizer.from_file(path)
    rng = random.Random(3)
    alphabet = "abcXYZéß .,'0\n\t -<|>İΣ́"
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
                     for _ in range(500)]
    tok = word_tokenizer(path)
    for part in (texts, texts[::-1]):
        for t, ids in zip(part, tok.encode_many(part)):
            assert np.frombuffer(ids, "<u4").tolist() == whole.encode(
                t, add_special_tokens=False).ids, t


def test_table_pieces(spark):
    rng = random.Random(4)
    rows = [(i, words(rng, rng.randint(0, 400)), "en", "s") for i in range(80)]
    rows += [(100 + i, t, None, None) for i, t in enumerate(TEXTS)]
    rows += [(200, None, "en", "s"), (201, words(rng, 20_000), "en", "s"), (None, "no id", "en", "s"),
             (202, "repeated row", "en", "s"), (202, "repeated row", "en", "s")]
    out = [r.asDict() for r in pack(clashing(documents(spark, rows)), shard_bytes=40_000).collect()]
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(vocabulary_path(WORD_BPE))
    ids = {i: whole.encode(t or "", add_special_tokens=False).ids + [END_ID] for i, t, *_ in rows}
    copies = {i: sum(x[0] == i for x in rows) for i in ids}
    by_doc, by_seq = {}, {}
    for r in out:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
        want = np.array(ids[r["doc_id"]][r["start"]:r["start"] + r["length"]], "<u4")
        assert r["ids_crc32"] == zlib.crc32(want.tobytes())
        assert r["doc_tokens"] == len(ids[r["doc_id"]])
    assert by_doc.keys() == ids.keys()
    for i, ps in by_doc.items():
        cover = np.zeros(len(ids[i]), int)
        for p in ps:
            cover[p["start"]:p["start"] + p["length"]] += 1
        assert (cover == copies[i]).all()
    short = 0
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= TIERS[-1] and len({p["step_group"] for p in ps}) == 1
        short += at not in TIERS
    shards = len({s >> 32 for s in by_seq})
    assert shards > 2 and short <= shards


def test_empty_table(spark):
    assert pack(documents(spark, [])).count() == 0
