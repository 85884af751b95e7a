import random

import numpy as np

from tests.llm.helpers import clashing, documents, words
from txrisk.llm.license_scan import BAND, TemplateIndex, banded_alignment, scan_licenses, scan_text
from txrisk.llm.license_templates import TEMPLATES


def _lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_banded_alignment_equals_lcs_inside_the_band():
    rng = np.random.default_rng(0)
    for _ in range(30):
        a = rng.integers(1, 6, 12)
        b = rng.integers(1, 6, 12)
        m, first, last = banded_alignment(a, b, 0, band=12)
        assert m == _lcs(a.tolist(), b.tolist())
        assert m == 0 or _lcs(a.tolist(), b[first:last + 1].tolist()) == m


def test_every_template_is_found_with_its_span():
    index = TemplateIndex(TEMPLATES)
    rng = random.Random(1)
    for name, text in TEMPLATES.items():
        before, after = words(rng, 50), words(rng, 50)
        doc = f"{before}\n{text.upper()}\n{after}"
        found = {f[0]: f for f in scan_text(doc, index)}
        assert name in found, name
        _, coverage, matched, size, start, end = found[name]
        assert coverage == 1 and matched == size
        assert start == len(before) + 1 and doc[start:end] == text.upper().strip(".\n")[:end - start]


def test_edited_texts_report_their_coverage():
    index = TemplateIndex(TEMPLATES)
    ws = TEMPLATES["MIT-text"].split()
    edited = ws[:40] + ["inserted", "words"] + ws[40:60] + ws[65:]
    (name, coverage, *_), = scan_text(" ".join(edited), index)
    assert name == "MIT-text" and 0.9 < coverage < 1
    assert scan_text(" ".join(ws[:30]), index) == []
    twice = scan_text("Released under the MIT License.\nabc\nReleased under the MIT License.", index)
    assert [t[0] for t in twice] == ["MIT", "MIT"]
    # a near template gives way to the better one over the same words
    (only,) = scan_text(TEMPLATES["LGPL-3.0"], index)
    assert only[0] == "LGPL-3.0"
    assert BAND >= 2


def test_spans_are_places_of_the_text():
    index = TemplateIndex(TEMPLATES)
    for before in ("", "\u0130" * 50 + " ", "x\u0130Y \U0001F600 "):     # U+0130 lowers to two code points
        text = before + "Released under the MIT License. Bye"
        (found,) = scan_text(text, index)
        assert text[found[4]:found[5]] == "Released under the MIT License"


def test_table_cases(spark):
    rows = [(1, TEMPLATES["GPL-3.0"], None, None), (2, None, "en", "s"), (3, "", "en", "s"),
            (4, "plain words only", "en", "s"), (None, TEMPLATES["MIT"], "en", "s"),
            (5, "x " * 200_000 + TEMPLATES["Apache-2.0"], "en", "s"),
            (6, TEMPLATES["MIT"], "en", "s"), (6, TEMPLATES["MIT"], "en", "s")]
    got = sorted(((r["doc_id"], r["license"]) for r in
                  scan_licenses(clashing(documents(spark, rows))).collect()), key=str)
    assert got == sorted([(1, "GPL-3.0"), (None, "MIT"), (5, "Apache-2.0"), (6, "MIT"), (6, "MIT")],
                         key=str)
    assert scan_licenses(documents(spark, [])).count() == 0


def test_versions_and_variants_are_told_apart(spark):
    index = TemplateIndex(TEMPLATES)

    def names(text):
        return [f[0] for f in scan_text(text, index)]

    for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
        for version in ("3.0", "4.0"):
            assert names(f"Text. Licensed under CC {kind} {version}. More.") == [f"CC-{kind}-{version}"]
    assert names("Licensed under CC BY-ND 7.0.") == []
    gnu = "This work is licensed under the GNU {}General Public License, version {}."
    for kind, version, want in (("", 2, "GPL-2.0"), ("", 3, "GPL-3.0"), ("Lesser ", "2.1", "LGPL-2.1"),
                                ("Lesser ", 3, "LGPL-3.0"), ("Affero ", 3, "AGPL-3.0")):
        assert names(gnu.format(kind, version)) == [want]
    assert names(gnu.format("", 9)) == []
    assert names(TEMPLATES["BSD-2-Clause-text"]) == ["BSD-2-Clause-text"]
    # a table of the caller's, with a long body
    rng = random.Random(4)
    body = words(rng, 3000)
    table = spark.createDataFrame([("Own-1.0", body)], "license string, text string")
    docs = documents(spark, [(1, "before " + body + " after", "en", "s"), (2, "none of it", "en", "s")])
    assert [(r["doc_id"], r["license"], r["coverage"]) for r in
            scan_licenses(docs, templates=table).collect()] == [(1, "Own-1.0", 1.0)]
