import itertools
import random

import pytest
import xxhash

from tests.llm.helpers import clashing, components, documents, words
from txrisk.llm.simhash import (fingerprint, hex_fingerprint, keep_one_per_class, linked_fingerprints,
                                simhash_classes)


def _slow(text, shingle=3):
    import re
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not ws:
        return 0
    sh = [" ".join(ws[i:i + shingle]) for i in range(len(ws) - shingle + 1)] or [" ".join(ws)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprints():
    rng = random.Random(0)
    texts = [None, "", " \t\n", "One", "one two", "A b  C\x0bd", "É x É\x85y z", "a a a a a a",
             words(rng, 200, 20), "x\x1fy z w", words(rng, 40_000, 50)]
    for t in texts:
        assert fingerprint(None if t is None else t.encode(), 3, 42) == _slow(t)


@pytest.mark.parametrize("bits", [1, 2, 3, 5])
def test_links_are_complete(spark, bits):
    rng = random.Random(bits)
    base = [rng.getrandbits(64) for _ in range(12)] + [0, (1 << 64) - 1]
    fps = set(base)
    for x in base:
        for k in range(1, bits + 2):
            for _ in range(6):
                y = x
                for b in rng.sample(range(64), k):
                    y ^= 1 << b
                fps.add(y)
    # a crowded bucket: all share the upper two segments
    fps |= {base[0] ^ low for low in range(64)}
    want = {(a, b) for a, b in itertools.combinations(sorted(
        x - (1 << 64) if x >= 1 << 63 else x for x in fps), 2)
        if bin((a ^ b) & (1 << 64) - 1).count("1") <= bits}
    df = spark.createDataFrame([(x - (1 << 64) if x >= 1 << 63 else x,) for x in fps], "fp long")
    got = [(r["a"], r["b"]) for r in linked_fingerprints(df, bits).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def _rows():
    rng = random.Random(9)
    rows = []
    for i in range(60):
        t = words(rng, 120)
        rows.append((3 * i, t, "en", "s"))
        if i % 4 == 0:
            ws = t.split()
            ws[rng.randrange(120)] = "changed"
            rows.append((3 * i + 1, " ".join(ws), "en", "s"))
    rows += [(1000 + i, "the same text many times over and over", None, None) for i in range(70)]
    rows += [(2000, None, "en", "s"), (2001, "", "en", "s"), (2002, "\n", "en", "s"),
             (2003, "short", "en", "s"), (2004, "Short", "en", "s"), (2005, words(rng, 30_000), "en", "s"),
             (2006, "a repeated row here", "en", "s"), (2006, "a repeated row here", "en", "s"),
             (None, "the same text many times over and over", "en", "s"), (None, "alone without id", "en", "s")]
    return rows


def _expected(rows):
    fps = [_slow(t) for _, t, *_ in rows]
    links = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2)
             if bin(fps[a] ^ fps[b]).count("1") <= 2]
    comp = components(range(len(rows)), links)
    smallest = {}
    for k, c in comp.items():
        if rows[k][0] is not None:
            smallest[c] = min(smallest.get(c, rows[k][0]), rows[k][0])
    return [(rows[k][0], f"{fps[k]:016x}", smallest.get(comp[k])) for k in range(len(rows))]


def test_classes_against_brute_force(spark):
    rows = _rows()
    for docs in (documents(spark, rows), clashing(documents(spark, rows))):
        c = simhash_classes(docs)
        got = [tuple(r) for r in c.select("doc_id", hex_fingerprint(c["fp"]), "component_id").collect()]
        assert sorted(got, key=str) == sorted(_expected(rows), key=str)


def test_one_document_of_each_class_stays(spark):
    rows = _rows()
    docs = documents(spark, rows)
    out = keep_one_per_class(docs)
    assert out.columns == docs.columns
    got = [r["doc_id"] for r in out.collect()]
    want = {c for _, _, c in _expected(rows) if c is not None}
    assert sorted(x for x in got if x is not None) == sorted(want)
    assert got.count(None) == 2
    assert simhash_classes(documents(spark, [])).count() == 0
    assert keep_one_per_class(documents(spark, [])).count() == 0


def test_an_id_with_texts_of_two_classes_keeps_both(spark):
    rng = random.Random(9)
    a, b = words(rng, 80), words(rng, 80)
    rows = [(2, b, "en", "s"), (5, a, "en", "s"), (5, b, "en", "s"), (5, a, "en", "s")]
    got = sorted((r["doc_id"], r["text"]) for r in keep_one_per_class(documents(spark, rows)).collect())
    assert got == [(2, b), (5, a)]
    # two unrelated texts under one id are two classes
    got = keep_one_per_class(documents(spark, [(5, a, "en", "s"), (5, b, "en", "s")])).collect()
    assert sorted(r["text"] for r in got) == sorted([a, b])
