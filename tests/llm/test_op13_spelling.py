import random
import re
import zlib
from collections import Counter

import numpy as np

from tests.llm.helpers import clashing
from txrisk.llm import spelling as S


def _near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def _groups(vocab, ratio=10):
    """word -> (form, root, n, n_near, form_n)."""
    best = {}
    for w, n in vocab.items():
        near = sorted((-vocab[x], x) for x in vocab if _near(w, x))
        ok = near and -near[0][0] >= ratio * n
        best[w] = (near[0][1] if ok else None, len(near), -near[0][0] if ok else None)
    out = {}
    for w, n in vocab.items():
        root = w
        while best[root][0]:
            root = best[root][0]
        out[w] = (best[w][0], root, n, best[w][1], best[w][2])
    return out


def _random_vocabulary(rng, size, alphabet="abcé"):
    words = set()
    while len(words) < size:
        base = "".join(rng.choice(alphabet) for _ in range(rng.randint(7, 10)))
        words.add(base)
        for _ in range(rng.randint(0, 4)):
            i = rng.randrange(len(base))
            other = rng.choice([base[:i] + base[i + 1:], base[:i] + rng.choice(alphabet) + base[i + 1:],
                                base[:i] + rng.choice(alphabet) + base[i:]])
            if len(other) >= 7:
                words.add(other)
    return {w: rng.choice([2, 3, 20, 35, 300, 4000, 41000]) for w in words}


def _run(spark, vocab, **kw):
    df = spark.createDataFrame(sorted(vocab.items()), "word string, n long")
    return {r["word"]: tuple(r[c] for c in ("form", "root", "n", "n_near", "form_n"))
            for r in S.variant_groups(df, **kw).collect()}


def test_scan_of_one_range_against_all_pairs():
    rng = random.Random(2)
    for _ in range(20):
        words = sorted({"abc" + "".join(rng.choice("abÿ") for _ in range(rng.randint(4, 9)))
                        for _ in range(150)})
        q, end = np.arange(len(words)), np.full(len(words), len(words))
        a, b = S.near_pairs(words, q, q + 1, end, S.SHARED)
        want = [(i, j) for i in range(len(words)) for j in range(i + 1, len(words))
                if _near(words[i], words[j])]
        assert sorted(zip(a.tolist(), b.tolist())) == want


def test_groups_against_all_pairs(spark):
    vocab = _random_vocabulary(random.Random(4), 700)
    want = _groups(vocab)
    assert _run(spark, vocab) == want
    # ranges of many pieces: pairs of pieces find the same
    assert _run(spark, vocab, piece=20) == want


def test_one_range_with_a_third_of_all_words(spark):
    rng = random.Random(6)
    vocab = _random_vocabulary(rng, 300)
    vocab |= {"pre" + w: rng.choice([2, 30, 500]) for w in list(vocab)[:200]}
    vocab |= {w + "end": rng.choice([2, 30, 500]) for w in list(vocab)[:200]}
    assert _run(spark, vocab, piece=16) == _groups(vocab)


def test_chain_of_forms_and_ties(spark):
    vocab = {"aaaaaaa": 2, "aaaaaaab": 20, "aaaaaabb": 20, "aaaaabab": 200, "aaaaabac": 2000,
             "aaaazbac": 20_000, "aaaazbad": 200_000, "zzzzzzzz": 7}
    got = _run(spark, vocab)
    assert got == _groups(vocab)
    assert got["aaaaaaa"][1] == "aaaazbad" and got["zzzzzzzz"] == (None, "zzzzzzzz", 7, 0, None)


def test_long_words(spark):
    long = "abcdefg" * 300
    vocab = {long: 50, long[:-1]: 2, long[1:]: 3, long[:900] + "x" + long[901:]: 4, long + "é": 5}
    assert _run(spark, vocab) == _groups(vocab)


def _vocabulary(docs):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def test_vocabulary_against_plain_counting(spark):
    rng = random.Random(8)
    letters = "abcdeÉéß×ÿXYZ"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 12))) for _ in range(60)]
    docs = [(i, " ".join(rng.choice(words) + rng.choice(["", ",", "7", "ā"]) for _ in range(80)))
            for i in range(120)]
    docs += [(3, docs[3][1]), (None, docs[4][1]), (9, None), (10, ""), (11, "short no 12345678")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = _vocabulary(docs)
    for frame in (df, clashing(df).withColumn("word", S.F.lit(1))):
        got = S.vocabulary(frame, every=31).collect()
        assert {r["word"]: r["n"] for r in got} == want and len(got) == len(want)
    assert any(len(w) >= 7 for w in want)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.variant_groups(S.vocabulary(docs)).count() == 0
