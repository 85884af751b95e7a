import hashlib
import random
import re
import tempfile

from pyspark.sql import functions as F

from tests.llm.helpers import clashing, documents
from txrisk.llm import secret_scan as S

KEYWORD = "password|passwd|secret|token|api_?key"
KEYWORD = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in KEYWORD)
PLAIN = {"assign": (rf"""({KEYWORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
         "access": ("AKIA[A-Z0-9]+", 0, 20), "hex": ("[0-9a-f]+", 0, 24),
         "pem": ("-----BEGIN ([A-Z0-9]+ ){0,3}PRIVATE KEY-----", 0, 0),
         "jwt": (r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{20,}", 0, 0),
         "github": ("gh[pousr]_[A-Za-z0-9]{36,}", 0, 0), "slack": ("xox[abprs]-[A-Za-z0-9-]{20,}", 0, 0)}


def _spans(text, kinds=tuple(PLAIN)):
    found = []
    for k, kind in enumerate(kinds):
        pattern, group, least = PLAIN[kind]
        found += [(m.start(), k, m.end(), kind) for m in re.finditer(pattern, text or "")
                  if len(m[group]) >= least]
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found)]


def _row(doc_id, text):
    base = _spans(text, ("assign", "access", "hex"))
    return (doc_id, *[sum(s.startswith(k) for s in base) for k in ("assign", "access", "hex")],
            hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(_spans(text)))


def _texts(rng, n):
    bits = ["password", "Secret", "TOKEN", "api_key", "apikey", "passwd", "=", ":", " ", "  ", '"', "'",
            "abc", "abcdef", "x.y/z+w=1-2_3", "AKIA", "AKIA" + "Q" * 16, "AKIAAKIA" + "7" * 11, "0f" * 11,
            "0f" * 12, "0f" * 30, "A0f", "é", "😀", "\n", "ſecret=abcdefgh", "toKen=abcdefgh",
            "-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----", "xoxb-" + "1a" * 12,
            "ghp_" + "aB3" * 13, "eyJ" + "a" * 12 + ".eyJ" + "b" * 12 + "." + "c" * 24, "token:token:abcdefgh"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def _scanned(spark, df, *scans):
    ledger = tempfile.mkdtemp(prefix="ledger-", dir="/tmp")
    S.record(df, ledger)
    for rows, rules in scans or ((df, S.RULES),):
        S.scan(rows, ledger, rules)
    return ledger


def _summary(spark, ledger):
    return sorted((tuple(r) for r in S.summarise(S.by_path(spark, ledger)).collect()), key=str)


def test_spans_against_plain_search(spark):
    rng = random.Random(11)
    texts = _texts(rng, 300)
    rows = [(i, t, None, "s") for i, t in enumerate(texts)]
    rows += [(900, None, None, None), (901, "", None, None), (902, texts[0], None, None), (902, texts[0], None, None),
             (None, texts[1], None, None)]
    df = documents(spark, rows)
    want = sorted((_row(r[0], r[1]) for r in rows), key=str)
    assert any(w[1] for w in want) and any(w[2] for w in want) and any(w[3] for w in want)
    assert _summary(spark, _scanned(spark, df)) == want
    # earlier scans of a part of it, under fewer rules, change nothing
    part = df.where("doc_id % 2 = 0")
    assert _summary(spark, _scanned(spark, df, (part, S.BASE), (part, S.BASE[:2]), (df, S.RULES))) == want
    assert _summary(spark, _scanned(spark, clashing(df).withColumn("blob", F.lit("x")).withColumn(
        "path", F.lit("y")).withColumn("spans", F.lit(1)))) == want


def test_only_new_blobs_and_rules_are_scanned(spark):
    texts = ["token = abcdefgh", "token = abcdefgh", "plain", "AKIA" + "Z" * 20]
    df = documents(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    ledger = _scanned(spark, df, (df.where("doc_id < 3"), S.BASE[:1]))
    new = {r["text"]: r["todo"] for r in S.unscanned(df, ledger, S.BASE).collect()}
    assert new == {texts[0]: ["access@1", "hex@1"], "plain": ["access@1", "hex@1"],
                   texts[3]: ["assign@1", "access@1", "hex@1"]}
    S.scan(df, ledger, S.BASE)
    assert S.unscanned(df, ledger, S.BASE).count() == 0
    assert S.findings(spark, ledger).count() == 2       # the copies share one
    # a changed rule is new for every blob, and its old findings are not reported
    changed = [S.Rule("assign", 2, S.BASE[0].pattern, 20, 2), *S.BASE[1:]]
    assert {tuple(r["todo"]) for r in S.unscanned(df, ledger, changed).collect()} == {("assign@2",)}
    S.scan(df, ledger, changed)
    assert {r["path"]["doc_id"]: [s["kind"] for s in r["spans"]]
            for r in S.by_path(spark, ledger, changed).collect()} == {0: [], 1: [], 2: [], 3: ["access"]}


def test_versions_of_a_path_and_a_lost_scan(spark):
    versions = spark.createDataFrame(
        [("a.py", 1, "secret: 'abcdef1'"), ("a.py", 2, "clean"), ("b.py", 1, "secret: 'abcdef1'")],
        "file string, commit int, text string")
    ledger = tempfile.mkdtemp(prefix="ledger-", dir="/tmp")
    S.record(versions, ledger)
    # findings whose pairs were never entered do not count, and the scan is repeated
    lost = S.matches(S.unscanned(versions, ledger, S.RULES), S.RULES)
    S._add(lost, ledger, "findings", "slost")
    S.scan(versions.limit(0), ledger)
    assert S.findings(spark, ledger).count() == 0
    S.scan(versions, ledger)
    got = {(r["path"]["file"], r["path"]["commit"]): [tuple(s) for s in r["spans"]]
           for r in S.by_path(spark, ledger).collect()}
    assert got == {("a.py", 1): [(0, 16, "assign")], ("a.py", 2): [], ("b.py", 1): [(0, 16, "assign")]}


def test_many_matches_in_one_text_and_empty_table(spark):
    text = "token=abcdef " * 30_000
    ledger = _scanned(spark, documents(spark, [(1, text, None, None)]))
    row = _summary(spark, ledger)[0]
    assert row == _row(1, text) and row[1] == 30_000
    assert _summary(spark, _scanned(spark, documents(spark, []))) == []


def test_main_path_has_no_python(spark):
    df = documents(spark, [(1, "token=abcdef", None, None)])
    ledger = _scanned(spark, df)
    for d in (S.matches(S.unscanned(df, "/tmp/none", S.RULES), S.RULES), S.summarise(S.by_path(spark, ledger))):
        plan = d._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas", plan)
