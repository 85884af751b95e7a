import random
import re

import pytest

from tests.llm.helpers import clashing, documents, words
from txrisk.llm.mixing import fill_targets, mix, mixed_documents


def _targets(sizes, weights=(1, 2, 3), cap=3):
    """Reshare by weight, round by round, until no target is above its cap."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_ = dict.fromkeys(names, 0.0), list(names)
    left = float(sum(sizes.values()))
    while open_ and left > 1e-9:
        share = left / sum(w[s] for s in open_)
        left = 0.0
        for s in list(open_):
            target[s] += share * w[s]
            if target[s] >= cap * sizes[s]:
                left += target[s] - cap * sizes[s]
                target[s] = float(cap * sizes[s])
                open_.remove(s)
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets_equal_repeated_resharing(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}é" if i % 3 else f"S{i}": rng.choice([0, 1, 5, 40, 1000, 30000])
             for i in range(rng.randint(1, 9))}
    if seed % 2:
        sizes[None] = 77
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in fill_targets(df).collect()}
    want = _targets(sizes)
    assert got.keys() == want.keys()
    for s in got:
        assert got[s] == pytest.approx(want[s], abs=1e-6)


def _rows():
    rng = random.Random(5)
    rows = [(i, words(rng, rng.randint(0, 60)), "en", rng.choice(["a", "b", "b", "b", "b", "c", None]))
            for i in range(300)]
    return rows + [(1000, None, "en", "a"), (1001, "", "en", "only-empty"), (1002, " \t\n ", "en", "a"),
                   (1003, words(rng, 20_000), "en", "c"), (None, "no id here", "en", "b"),
                   (1004, "x y z", "en", "tiny"), (1005, "same row", "en", "b"),
                   (1005, "same row", "en", "b")]


def test_mix_meets_its_targets_and_reruns_agree(spark):
    rows = _rows()
    docs = documents(spark, rows)
    small = sorted((tuple(r) for r in mix(docs, rows_per_bucket=7).collect()), key=str)
    assert small == sorted((tuple(r) for r in mix(clashing(docs).repartition(7)).collect()), key=str)
    src = {i: s for i, _, _, s in rows}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in rows}
    total, taken, target = {}, {}, {}
    for i, n, ss, tg, tk in small:
        assert n == size[i]
        assert 0 <= tk <= 3 * n
        s = src[i]
        total[s] = total.get(s, 0) + n
        taken[s] = taken.get(s, 0) + tk
        target[s] = (ss, tg)
    want = _targets(total)
    for s in total:
        assert target[s][0] == total[s]
        assert target[s][1] == pytest.approx(want[s], abs=1e-6)
        assert abs(taken[s] - target[s][1]) <= 0.5 + 1e-6
    assert size[1004] == 2


def test_mixed_documents_hold_the_taken_words(spark):
    rows = _rows()
    docs = clashing(documents(spark, rows))
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    word = re.compile(r"[^\x20\x09-\x0D]+")
    got = {}
    for r in out.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(word.findall(r["text"]))
    want = {}
    for r in mix(documents(spark, rows)).collect():
        want[r["doc_id"]] = want.get(r["doc_id"], 0) + r["taken"]
    assert got == {i: n for i, n in want.items() if n}
    texts = {i: t for i, t, *_ in rows}
    assert all(texts[r["doc_id"]].startswith(r["text"]) for r in out.collect())


def test_empty_and_wordless_tables(spark):
    assert mix(documents(spark, [])).count() == 0
    assert mixed_documents(documents(spark, [])).count() == 0
    (r,) = mix(documents(spark, [(1, None, None, None)])).collect()
    assert tuple(r) == (1, 0, 0, 0.0, 0)
