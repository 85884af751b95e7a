"""Conversation structure repair with a suffix-shared automaton (DAWG).

A conversation's rows become one symbol each (its *signature*): what its role can be
in the grammar ``(s?(ua)+)?`` and what is wrong with it. Rows that must go look alike
whatever their role. Signatures are minimised from the end: equal suffixes, of
whatever conversation, are one node. Per node and grammar state the least cost of the
rest, and the edit it begins with, are computed once; a best audit is read off along a
signature's nodes. Distinct signatures are sorted by their reversed text, so those
that share a suffix are neighbours and a task holds only the nodes of the signature it
is at: memory is bounded by the longest conversation, however many there are.

Edits: Delete 3, Insert an empty user or assistant row 2, Keep 0, Rerole to user or
assistant 2; a truncated row that stays costs 1 more. Among equal costs the audit that
is least in ASCII is taken. At one node and state each edit leads to one next state,
so ties are settled by the edit's initial alone and no audit strings are compared.

A conversation is ordered text with one digest, so its rows meet in one task by
nature; they stream through it in sorted order (Spark's sort spills), never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txrisk.llm.common import frees_memory, store

SPACE = r"\x20\x09-\x0D"
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
#: Grammar states: 0 nothing yet, 1 after system, 2 after user, 3 after assistant.
#: A conversation may end in 0 or 3.
KEEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: State after an inserted or reroled row: the one role that the state allows.
MAKES = {0: 2, 1: 2, 2: 3, 3: 2}


def damage(rows: DataFrame) -> DataFrame:
    """Known damage for trials, by c = crc32("conv_id:turn") mod 20 (nulls of any
    column count as one space): 0 drops the row, 1 empties its text, 2 removes its
    ``[.!?]``, 3 repeats it, 4 makes its role user."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), blank))
    r = rows.select("conv_id", "turn", F.coalesce("role", blank).alias("role"),
                    F.coalesce("text", blank).alias("text"), (F.crc32(key) % 20).alias("_c"))
    r = r.where(F.col("_c") != 0).select(
        "conv_id", "turn", F.when(F.col("_c") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_c") == 1, "").when(F.col("_c") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("_c") == 3, 2).otherwise(1))).alias("_c"))
    return r.drop("_c")


def _clean(rows: DataFrame) -> DataFrame:
    """The four columns, nulls of role and text as one space, and a digest of the text
    that orders rows of one turn and role."""
    r = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"),
                    F.coalesce("text", F.lit(" ")).alias("text"))
    return r.withColumn("digest", F.unhex(F.sha2("text", 256)))


def _order(*more: str) -> list[Column]:
    return [*[F.col(c) for c in more], F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]


def diagnose(rows: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal
    (longs) and signature.

    Rows (conv_id, turn, role, text; others are ignored) are taken by turn, nulls
    first, then role and text digest. A row's first fault counts: blank (no
    non-space character), duplicate (role and text seen earlier), truncated (last
    non-space character not ``[.!?]``). gaps: missing turns between the first and
    the last, nulls ignored. illegal: adjacent initials other than su, ua, au. Null
    role and text count as one space, a null conv_id is a conversation. Signature: x
    for a row that must go, else the initial (o for others than s, u, a; an empty
    role is such), upper case if truncated. One shuffle, without the texts.
    """
    r = _clean(rows).select(
        "conv_id", "turn", "role", "digest", F.substring("role", 1, 1).alias("initial"),
        (~F.col("text").rlike(f"[^{SPACE}]")).alias("blank"),
        F.col("text").rlike(rf"[.!?][{SPACE}]*\z").alias("ended"))
    r = r.repartition("conv_id")
    same = Window.partitionBy("conv_id", "role", "digest").orderBy(F.col("turn").asc_nulls_first())
    r = r.withColumn("again", F.row_number().over(same) > 1)
    line = Window.partitionBy("conv_id").orderBy(*_order(), "again")   # equal rows: the first first
    fault = (F.when(F.col("blank"), "blank").when(F.col("again"), "duplicate")
             .when(~F.col("ended"), "truncated"))
    kind = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    r = r.select("conv_id", "turn", fault.alias("fault"), kind.alias("kind"),
                 F.row_number().over(line).alias("at"), F.lag("turn").over(line).alias("last_turn"),
                 F.concat(F.lag("initial").over(line), "initial").alias("pair"))
    symbol = (F.when(F.col("fault").isin("blank", "duplicate"), "x")
              .when(F.col("fault") == "truncated", F.upper("kind")).otherwise(F.col("kind")))
    new_turn = F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("last_turn"))

    def count(what: Column) -> Column:
        return F.count(F.when(what, 1))

    d = r.withColumn("symbol", symbol).groupBy("conv_id").agg(
        F.coalesce((F.max("turn") - F.min("turn") + 1 - count(new_turn)).cast("long"),
                   F.lit(0).cast("long")).alias("gaps"),
        *[count(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")],
        count(~F.col("pair").isin("su", "ua", "au")).alias("illegal"),
        F.sort_array(F.collect_list(F.struct("at", "symbol"))).alias("symbols"))
    return d.withColumn("signature", F.array_join(F.col("symbols.symbol"), "")).drop("symbols")


#: The node of the empty suffix: per state (cost to go, edit, next state).
_END = ((0, "", 0), (2 * INSERT, "I", 2), (INSERT, "I", 3), (0, "", 3))


def node(symbol: str, rest: tuple) -> tuple:
    """The node of ``symbol`` before the suffix of node ``rest``: per grammar state
    the least (cost to go, first edit, next state)."""
    kind, extra = symbol.lower(), TRUNCATED * symbol.isupper()
    found = []
    for q in range(4):
        best = (rest[q][0] + DELETE, "D", q)
        if kind != "x":
            to = KEEPS.get((q, kind))
            if to is not None:
                best = min(best, (rest[to][0] + extra, "K", to))
            best = min(best, (rest[MAKES[q]][0] + REROLE + extra, "R", MAKES[q]))
        found.append(best)
    # inserts before the row; two in a row lead back to the same state, so 2 and 3
    # look at each other's other edits only
    two = min(found[2], (found[3][0] + INSERT, "I", 3))
    three = min(found[3], (found[2][0] + INSERT, "I", 2))
    return (min(found[0], (two[0] + INSERT, "I", 2)), min(found[1], (two[0] + INSERT, "I", 2)),
            two, three)


def _audit(nodes: list[tuple]) -> str:
    """The best audit from state 0; nodes[k] is the node of the last k symbols."""
    out, k, q = [], len(nodes) - 1, 0
    while True:
        _, edit, to = nodes[k][q]
        if not edit:
            return "".join(out)
        out.append(edit)
        q = to
        k -= edit != "I"


def plan(signatures: DataFrame) -> DataFrame:
    """(signature, cost, audit) of every distinct signature.

    Signatures are range-sorted by their reversed text. A task keeps the nodes of the
    current one; the next keeps those of the suffix they share. (A suffix that
    crosses a border of ranges is computed in both.)
    """
    def run(batches):
        import os

        import pyarrow as pa
        before, nodes = "", [_END]
        for batch in batches:
            costs, audits = [], []
            for back in batch.column(0).to_pylist():
                shared = len(os.path.commonprefix((before, back)))
                del nodes[shared + 1:]
                for symbol in back[shared:]:
                    nodes.append(node(symbol, nodes[-1]))
                costs.append(nodes[-1][0][0])
                audits.append(_audit(nodes))
                before = back
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(costs, pa.int64()), pa.array(audits, pa.string())],
                ["back", "cost", "audit"])

    back = signatures.select(F.reverse("signature").alias("back")).distinct()
    return back.orderBy("back").mapInArrow(
        frees_memory(run), "back string, cost long, audit string").select(
        F.reverse("back").alias("signature"), "cost", "audit")


def plan_repairs(rows: DataFrame) -> DataFrame:
    """``diagnose`` with cost (long) and audit: the initials of the cheapest edits, in
    order. Many conversations of one signature are planned once; both sides of the
    join back are stored, so the planner knows their size and may split a hot
    signature."""
    found = store(diagnose(rows), "turn-faults")
    plans = store(plan(found.select("signature")), "turn-plans")
    return found.join(plans, "signature").select(*found.columns, "cost", "audit")


def repair(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """The repaired rows: conv_id, position (from 0), edit, turn, role, text, each
    conversation whole and in order within one partition.

    ``audits`` holds conv_id and audit of ``plan_repairs(rows)``. Inserted rows have
    no turn and an empty text. An audit precedes its conversation's rows in the sort,
    so a task holds one audit and one batch of rows.
    """
    r = _clean(rows)
    heads = audits.select("conv_id", "audit", F.lit(0).alias("part"))
    both = r.withColumn("part", F.lit(1)).unionByName(heads, allowMissingColumns=True)
    both = (both.repartition("conv_id").sortWithinPartitions(*_order("conv_id", "part"))
            .select("conv_id", "part", "audit", "turn", "role", "text"))
    ids, turns = (rows.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    schema = f"conv_id {ids}, position long, edit string, turn {turns}, role string, text string"

    def run(batches):
        import pyarrow as pa
        out: list[tuple] = []
        conv, audit, at, n, last = None, "", 0, 0, ""

        def emit(edit, turn, role, text):
            nonlocal n, last
            if edit != "K":
                role = "assistant" if last == "u" else "user"
            out.append((conv, n, edit, turn, role, text))
            n, last = n + 1, role[:1]

        def inserts():
            nonlocal at
            while audit[at:at + 1] == "I":
                at += 1
                emit("I", None, None, "")

        kinds = None
        for batch in batches:
            kinds = [batch.schema.field(c).type for c in (0, 3)]
            for c, part, audit_, turn, role, text in zip(*(x.to_pylist() for x in batch.columns)):
                if part == 0:
                    inserts()
                    conv, audit, at, n, last = c, audit_, 0, 0, ""
                    continue
                inserts()
                edit, at = audit[at], at + 1
                if edit != "D":
                    emit(edit, turn, role, text)
            yield _rows(pa, out, kinds)
            out.clear()
        if kinds:
            inserts()
            yield _rows(pa, out, kinds)

    return both.mapInArrow(frees_memory(run), schema)


def _rows(pa, out, kinds):
    types = [kinds[0], pa.int64(), pa.string(), kinds[1], pa.string(), pa.string()]
    columns = list(zip(*out)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                      ["conv_id", "position", "edit", "turn", "role", "text"])


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of ``repair``'s rows as it returns them: the hex
    SHA-256 of ``role:text``, newline-joined. Conversations without a row left have
    none here."""
    def run(batches):
        import hashlib

        import pyarrow as pa
        conv, h, kind = None, None, None
        for batch in batches:
            kind, done = batch.schema.field(0).type, []
            for c, position, role, text in zip(*(x.to_pylist() for x in batch.columns)):
                if position == 0:
                    if h is not None:
                        done.append((conv, h.hexdigest()))
                    conv, h = c, hashlib.sha256()
                else:
                    h.update(b"\n")
                h.update(f"{role}:{text}".encode())
            yield _pairs(pa, done, kind)
        if h is not None:
            yield _pairs(pa, [(conv, h.hexdigest())], kind)

    ids = repaired.schema["conv_id"].dataType.simpleString()
    return repaired.select("conv_id", "position", "role", "text").mapInArrow(
        frees_memory(run), f"conv_id {ids}, repaired_sha256 string")


def _pairs(pa, done, kind):
    return pa.RecordBatch.from_arrays(
        [pa.array([d[0] for d in done], kind), pa.array([d[1] for d in done], pa.string())],
        ["conv_id", "repaired_sha256"])


def report(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """Faults, cheapest audit and digest of the repaired text for every conv_id of
    ``conversations``, repaired from ``rows``. Without rows: zeros, an empty audit
    and the digest of the empty text."""
    plans = store(plan_repairs(rows).drop("signature"), "turn-audits")
    parts = (conversations.select("conv_id").distinct()
             .unionByName(plans, allowMissingColumns=True)
             .unionByName(digests(repair(rows, plans)), allowMissingColumns=True))
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return parts.groupBy("conv_id").agg(
        *[F.coalesce(F.max(c), F.lit(0).cast("long")).alias(c) for c in numbers],
        F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("repaired_sha256"), F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
