import random

import numpy as np

from tests.llm.helpers import clashing, documents
from txrisk.llm.langid import GramIndex, code_points, fit, gram_codes, held_out, identify

SYLLABLES = {"aa": ["ka", "to", "mi", "ru"], "bb": ["sch", "ung", "ein", "ver"],
             "cc": ["ción", "dad", "que", "los"]}


def _rows(n=240, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = ("aa", "aa", "aa", "bb", "bb", "cc")[i % 6]
        text = " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4)))
                        for _ in range(rng.randint(1, 40)))
        rows.append((i, text.capitalize() + ".", lang, "s"))
    return rows


def _run(df, **kw):
    return {(r["doc_id"], r["text"]): (r["lang_pred"], r["score"], r["coverage"])
            for r in identify(df, **kw).collect()}


def test_held_out_accuracy_and_special_texts(spark):
    rows = _rows()
    rows += [(1000, None, "aa", "s"), (1001, "", "bb", "s"), (1002, "123 !? \n", "aa", "s"),
             (1003, "kato miru", None, None), (None, "schung einver", "bb", "s"),
             (1004, "ciónque " * 50_000, "cc", "s"), (1005, "漢字", None, "s"), (0, rows[0][1], "aa", "s")]
    got = _run(documents(spark, rows))
    from pyspark.sql import functions as F
    held = {r["doc_id"]: r["h"] for r in documents(spark, rows).select(
        "doc_id", held_out().alias("h")).collect()}
    assert held[None] is True
    for i, t, lang, _ in rows:
        pred, score, coverage = got[(i, t)]
        assert 0 <= score <= 1 and 0 <= coverage <= 1
        if t is None or not any(c.isalpha() for c in t):
            assert (pred, score, coverage) == ("und", 0.0, 0.0)
        else:
            assert pred in SYLLABLES
    test = [(i, t, lang) for i, t, lang, _ in rows[:240] if held[i]]
    assert len(test) > 20
    assert np.mean([got[(i, t)][0] == lang for i, t, lang in test]) >= 0.95
    assert got[(1005, "漢字")][2] == 0.0
    # labels, sources and ids are no inputs of a prediction, and reruns agree
    again = _run(documents(spark, [(i, t, lang if not held[i] else None, None)
                                   for i, t, lang, _ in rows]).repartition(5))
    assert again == got
    assert F is not None


def test_clashing_columns_and_no_labels(spark):
    plain = documents(spark, _rows(60))
    docs = clashing(plain)                       # has lang_pred and score
    out = identify(docs)
    results = ["lang_pred", "score", "coverage"]
    assert out.columns == [c for c in docs.columns if c not in results] + results
    assert _run(docs) == _run(plain) and out.count() == 60
    blank = documents(spark, [(1, "abc", None, None), (2, "def", None, None)])
    assert {r["lang_pred"] for r in identify(blank).collect()} == {"und"}
    assert identify(documents(spark, [])).count() == 0
    assert fit(documents(spark, [])) is None


def test_one_row_of_one_language(spark):
    docs = documents(spark, [(i, "only text", "zz", None) for i in (1, 2, 3, 4, 5)])
    assert {r["lang_pred"] for r in identify(docs).collect()} == {"zz"}


def test_direct_tables_and_search_agree():
    texts = ["Abc déf ghi", "ab", "z", "\x00a\x00", "\U0010ffff\U0001F600x", "abcabc ddd"]
    vocabulary = np.unique(np.concatenate([gram_codes(code_points(t)) for t in texts[:5]]))
    dense = GramIndex(vocabulary)
    assert dense.dense
    search = GramIndex(vocabulary)
    search.dense = False
    known = set(vocabulary.tolist())
    for t in texts + ["unknown ĸ text", "q"]:
        a, b = np.zeros(len(vocabulary)), np.zeros(len(vocabulary))
        assert dense.presence(t, a) == search.presence(t, b)
        assert (a == b).all()
        want = known & set(gram_codes(code_points(t)).tolist())
        assert set(vocabulary[a > 0].tolist()) == want
