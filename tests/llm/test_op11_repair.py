import hashlib
import itertools
import random
import re
import zlib

import pytest

from tests.llm.helpers import clashing
from txrisk.llm import turn_repair as R

ROWS = "conv_id long, turn long, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?")


def _faults(rows):
    """(turn, role, text) in order -> fault per row."""
    seen, out = set(), []
    for _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not last else "duplicate" if (role, text) in seen
                   else "" if last[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def _cheapest(rows, gap=("", "u", "a", "ua", "au")):
    """All edit sequences with up to two inserts a gap: least (cost, audit), repaired rows."""
    faults, best = _faults(rows), None
    choices = []
    for (_, role, text), f in zip(rows, faults):
        extra, options = f == "truncated", [("D", 3, None)]
        if f not in ("blank", "duplicate"):
            options += [("K", extra, (role, text)), ("R", 2 + extra, ("user", text)),
                        ("R", 2 + extra, ("assistant", text))]
        choices.append(options)
    names = {"u": "user", "a": "assistant"}
    for inserts in itertools.product(gap, repeat=len(rows) + 1):
        for picked in itertools.product(*choices):
            out, audit, cost = [], "", 0
            for k, new in enumerate(inserts):
                out += [(names[x], "") for x in new]
                audit += "I" * len(new)
                cost += 2 * len(new)
                if k < len(rows):
                    audit += picked[k][0]
                    cost += picked[k][1]
                    out += [picked[k][2]] if picked[k][2] else []
            if all(r for r, _ in out) and LEGAL.fullmatch("".join(r[0] for r, _ in out)):
                best = min(best or (cost, audit, out), (cost, audit, out), key=lambda b: b[:2])
    return best


def _expected(rows):
    faults = _faults(rows)
    cost, audit, out = _cheapest(rows) if rows else (0, "", [])
    turns = [t for t, _, _ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return {"gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            "illegal": sum(p not in ("su", "ua", "au") for p in pairs), "cost": int(cost),
            "audit": audit, **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
            "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()}


def _order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1],
                                       hashlib.sha256(r[2].encode()).digest()))


def _report(spark, conversations, damaged):
    df = R.report(spark.createDataFrame(conversations, ROWS), spark.createDataFrame(damaged, ROWS))
    return {r["conv_id"]: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in df.collect()}


def test_cheapest_edits_against_all_edit_sequences(spark):
    rng, rows = random.Random(3), []
    for conv in range(60):
        for turn in range(rng.randint(1, 3 if conv % 3 else 4)):
            rows.append((conv, rng.choice([turn, turn, turn + 2, None, 1]),
                         rng.choice(["user", "user", "assistant", "assistant", "system", "tool", ""]),
                         rng.choice(["ok.", "ok", " ", "yes! \t", "no? x", "a.", "b."])))
    got = _report(spark, rows + [(77, 1, "user", "gone.")], rows)
    for conv in range(60):
        mine = _order([r[1:] for r in rows if r[0] == conv])
        assert got[conv] == _expected(mine), (conv, mine)
    assert got[77] == _expected([])


def test_ties_take_the_least_audit():
    def audit(signature):
        nodes = [R._END]
        for s in reversed(signature):
            nodes.append(R.node(s, nodes[-1]))
        return nodes[-1][0][0], R._audit(nodes)

    assert audit("") == (0, "")
    assert audit("ua") == (0, "KK")
    assert audit("s") == (3, "D")
    assert audit("u") == (2, "KI")
    assert audit("a") == (2, "IK")
    assert audit("UA") == (2, "KK")
    assert audit("xx") == (6, "DD")
    assert audit("uu") == (2, "KR")
    assert audit("uaa") == (2, "KKIK")


def test_suffixes_are_shared_across_conversations(spark):
    rng = random.Random(5)
    signatures = ["".join(rng.choice("suaoUAx") for _ in range(rng.randint(0, 9))) for _ in range(400)]
    got = {r["signature"]: (r["cost"], r["audit"]) for r in R.plan(
        spark.createDataFrame([(s,) for s in signatures], "signature string")).collect()}
    assert set(got) == set(signatures)
    for s in signatures:
        nodes = [R._END]
        for x in reversed(s):
            nodes.append(R.node(x, nodes[-1]))
        assert got[s] == (nodes[-1][0][0], R._audit(nodes))


def test_damage_by_key(spark):
    rows = [(c, t, "assistant", f"one. two! {c}?") for c in range(40) for t in range(8)]
    rows += [(None, 3, None, None), (5, None, "system", "x.")]
    got = sorted((tuple(r) for r in R.damage(spark.createDataFrame(rows, ROWS)).collect()), key=str)
    want = []
    for c, t, role, text in rows:
        role, text = role or " ", text or " "
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if k:
            want += [(c, t, "user" if k == 4 else role, "" if k == 1 else
                      re.sub("[.!?]", "", text) if k == 2 else text)] * (1 + (k == 3))
    assert got == sorted(want, key=str)


def test_nulls_clashing_names_and_empty_table(spark):
    rows = [(None, None, "user", "Hi."), (None, None, "user", "Hi."), (None, 2, None, None),
            (1, 1, "user", None), (1, 2, "assistant", "yes")]
    df = clashing(spark.createDataFrame(rows, ROWS)).withColumn("digest", R.F.lit("x"))
    got = {r["conv_id"]: r for r in R.report(df, df).collect()}
    assert (got[None]["audit"], got[None]["cost"]) == ("KDDI", 8)
    assert (got[None]["duplicate"], got[None]["blank"], got[None]["gaps"]) == (1, 1, 0)
    assert (got[1]["blank"], got[1]["truncated"], got[1]["audit"], got[1]["cost"]) == (1, 1, "DD", 6)
    empty = spark.createDataFrame([], ROWS)
    assert R.report(empty, empty).count() == 0
    assert R.repair(empty, R.plan_repairs(empty)).count() == 0


@pytest.mark.parametrize("n", [3000])
def test_long_conversation_streams(spark, n):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"text {t}.") for t in range(n)]
    rows += [(2, 0, "user", "a."), (2, 1, "assistant", "b.")]
    df = spark.createDataFrame(rows, ROWS)
    plans = R.plan_repairs(df)
    out = [tuple(r) for r in R.repair(df, plans).where("conv_id = 1").collect()]
    assert out == [(1, t, "K", t, r, x) for _, t, r, x in rows[:n]]
