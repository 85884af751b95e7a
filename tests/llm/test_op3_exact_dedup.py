import hashlib

import numpy as np
from pyspark.sql import functions as F

from tests.llm.helpers import clashing, documents
from txrisk.llm.exact_dedup import build_pilots, exact_dedup, lookup


def _words(n, salt=b""):
    return np.frombuffer(b"".join(hashlib.sha256(salt + b"%d" % i).digest() for i in range(n)),
                         "<u8").reshape(-1, 4)


def test_pilots_make_a_minimal_perfect_hash():
    for n in (1, 2, 3, 10, 777, 3000):
        w = _words(n)
        pilots, slot = build_pilots(w)
        assert sorted(slot) == list(range(n))
        held = np.empty_like(w)
        held[slot] = w
        assert (lookup(w, pilots, held) == slot).all()
        assert (lookup(_words(500, b"x"), pilots, held) == -1).all()


def _expected(rows):
    by = {}
    for i, t, *_ in rows:
        by.setdefault(t or "", []).append(i)
    out = []
    for i, t, *_ in rows:
        ids = [x for x in by[t or ""] if x is not None]
        keep = max(ids) if ids else None
        out.append((i, keep, len(by[t or ""]), i is not None and i == keep,
                    hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def _run(docs, history):
    return sorted((tuple(r) for r in exact_dedup(docs, history, bucket_size=16).collect()), key=str)


ROWS = ([(i, f"text {i % 40}", "en", "s") for i in range(100)]
        + [(200 + i, "hot", None, None) for i in range(90)]
        + [(300, None, "en", "s"), (301, "", "en", "s"), (302, "Text 1", "en", "s"),
           (303, "text 1 ", "en", "s"), (None, "text 2", "en", "s"), (None, "only here", "en", "s"),
           (304, "é" * 300_000, "en", "s"), (305, "é" * 300_000, "en", "s"),
           (306, "twice", "en", "s"), (306, "twice", "en", "s")])


def test_every_split_of_history_gives_the_same_groups(spark):
    docs = documents(spark, ROWS)
    for history in (F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0, F.lit(True), F.lit(False),
                    F.col("doc_id") < 150, F.lit(None).cast("boolean")):
        assert _run(docs, history) == _expected(ROWS)
    assert _run(clashing(docs), F.col("doc_id") % 3 == 0) == _expected(ROWS)


def test_empty_table(spark):
    assert _run(documents(spark, []), F.lit(True)) == []


def test_a_first_load_is_dealt_over_buckets(spark, monkeypatch):
    from pyspark.sql import functions as F
    from txrisk.llm import exact_dedup as E
    seen, resolve = [], E.resolve
    monkeypatch.setattr(E, "resolve", lambda i, a, n: seen.append(n) or resolve(i, a, n))
    docs = documents(spark, [(i, f"text {i % 90}", "en", "s") for i in range(100)])
    got = E.exact_dedup(docs, F.lit(False), bucket_size=10).collect()
    assert seen == [10] and len(got) == 100 and sum(r["kept"] for r in got) == 90
