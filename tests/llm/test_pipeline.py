"""The pipeline, stage by stage, against what each operator gives on the stage's input."""

import random
import re

import pytest

import corpus_pipeline as P
from tests.llm.helpers import made_up_text as text_of
from tests.llm.helpers import clashing, documents
from txrisk.llm.common import store
from txrisk.llm.mixing import mix
from txrisk.llm.simhash import fingerprint


def _rows():
    rng = random.Random(11)
    rows = []
    for i in range(120):
        lines = [text_of(rng, "de" if i % 3 else "fr", rng.randint(8, 40)) for _ in range(4)]
        if i % 2:
            lines.insert(2, "subscribe to our weekly letter and read more stories every day")
        rows.append((i, "\n".join(lines), "de" if i % 3 else "fr", f"src{i % 5 % 3}"))
    copied = rows[4][1]
    rows += [(500 + k, copied, "de", "src0") for k in range(30)]
    rows += [(600, copied.replace(" ", "  ", 1), "de", "src1"), (700, None, "de", "src1"),
             (701, "", None, None), (702, "12345 !!", "fr", "src2"), (703, "漢字" * 40, None, "src2"),
             (704, text_of(rng, "fr", 6000), "fr", None)]
    return rows


def _stages(spark, docs):
    out = [docs]
    for name, f in P.STAGES:
        out.append(store(f(spark, out[-1], "unused"), f"test-{name}"))
    return out


def test_stages(spark):
    rows = _rows()
    docs = documents(spark, rows)
    steps = _stages(spark, docs)
    assert [n for n, _ in P.STAGES] == ["language_id", "line_dedup", "simhash", "mix", "pack"]
    for df in steps[:-1]:
        assert df.columns == docs.columns
    ids = [sorted(r["doc_id"] for r in df.select("doc_id").collect()) for df in steps]
    # language ID: only null, letterless and foreign texts go
    assert set(ids[0]) - set(ids[1]) == {700, 701, 702, 703}
    # lines: boilerplate stays once, copies of a document lose all their lines and go
    lines = {r["doc_id"]: r["text"] for r in steps[2].collect()}
    assert sum("subscribe to our" in t for t in lines.values()) == 1
    assert not any(500 <= i < 600 for i in lines) and 4 in lines
    for i in range(120):
        own = [x for x in rows[i][1].split("\n") if "subscribe" not in x]
        assert [x for x in lines[i].split("\n") if "subscribe" not in x] == own
    # near-dedup: one document of each class, judged on the stage's own input
    seen = [fingerprint(t.encode(), 3, 42) for i, t in sorted(lines.items()) if i in set(ids[3])]
    assert all(bin(a ^ b).count("1") > 2 for k, a in enumerate(seen) for b in seen[:k])
    # mix: words taken as planned
    want = {r["doc_id"]: r["taken"] for r in mix(steps[3]).collect() if r["taken"]}
    got = {}
    for r in steps[4].collect():
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
        assert r["n_chars"] == len(r["text"])
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + n
    assert got == want
    # packing: every document of the mix, as often as it is there
    pieces = steps[5].collect()
    starts = [r["doc_id"] for r in pieces if r["start"] == 0]
    assert sorted(starts) == ids[4]


def test_extra_columns_and_empty_table(spark):
    docs = clashing(documents(spark, _rows()[:40]))
    for df in _stages(spark, docs)[:-1]:
        assert df.columns == docs.columns
    empty = documents(spark, [])
    assert all(df.count() == 0 for df in _stages(spark, empty))


def test_unlabelled_documents_pass_language_id(spark):
    docs = documents(spark, [(1, "abc def", None, None), (2, None, None, None), (3, "12", None, None)])
    assert [r["doc_id"] for r in P.language_id(spark, docs, "unused").collect()] == [1]


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_run_over_the_documents_table(spark, sf):
    out = P.run(spark, sf)
    assert out.columns[:3] == ["doc_id", "start", "length"] and out.count() > 100


def test_short_and_unspaced_lines_recur(spark):
    rng = random.Random(5)
    notice = "本網站所有內容均受版權保護" * 20
    rows = [(i, "\n".join(["Les.", text_of(rng, "fr", 12), "", "And ornd.", notice, f"{i}", ""]), "fr", "s")
            for i in range(9)]
    got = {r["doc_id"]: r["text"] for r in P.drop_lines(spark, documents(spark, rows), "unused").collect()}
    assert got[0] == rows[0][1]
    # blank lines and numbers of their own stay
    assert all(got[i] == "\n".join([rows[i][1].split("\n")[1], "", f"{i}", ""]) for i in range(1, 9))


def test_a_long_passage_recurs_from_two_documents_on(spark):
    rng = random.Random(6)
    passage = text_of(rng, "de", 60)
    own = [[text_of(rng, "de", 30) for _ in range(3)] for _ in range(6)]
    rows = [(i, "\n".join([*own[i], "kurze Zeile"] if i > 1 else [own[i][0], passage, *own[i][1:], "kurze Zeile"]),
             "de", "s") for i in range(4)]
    rows += [(4, "\n".join([passage.replace("e", "a"), *own[4]]), "de", "s"),
             (5, "\n".join([passage.replace("e", "a"), *own[4]]), "de", "s")]   # a copy, short lines too
    got = {r["doc_id"]: r["text"] for r in P.drop_lines(spark, documents(spark, rows), "unused").collect()}
    assert got[0] == rows[0][1] and got[4] == rows[4][1] and 5 not in got
    assert got[1] == "\n".join(own[1])         # what is shared with document 0 goes
    assert [got[i] for i in (2, 3)] == [rows[i][1] for i in (2, 3)]   # four documents: short line stays


def test_lines_with_variable_fields_recur(spark):
    rng = random.Random(8)

    def name():
        return text_of(rng, "de", 1) + "abcdefghij"[rng.randrange(10)]

    notice = [w + "n" for w in text_of(rng, "de", 40).split()]
    rows, own = [], []
    for i in range(40):
        own.append([text_of(rng, "de", 12), f"Und die {text_of(rng, 'de', 3)}"])
        far = notice[:3] + [name()] + notice[4:33] + [name()] + notice[34:]
        rows.append((i, "\n".join([own[i][0], f"Posted by {name()} in {name()}", own[i][1],
                                   f"{name()} wrote this for us", " ".join(far)]), "de", "s"))
    got = {r["doc_id"]: r["text"] for r in P.drop_lines(spark, documents(spark, rows), "unused").collect()}
    assert got[0] == rows[0][1]
    assert all(got[i] == "\n".join(own[i]) for i in range(1, 40))
