import hashlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tests.llm.helpers import clashing
from txrisk.llm.chat import escape, format_conversations, summarise, unescape

SCHEMA = "conv_id long, turn long, role string, text string"


def _expected(rows):
    out = {}
    for c, t, role, text in rows:
        out.setdefault(c, []).append(((t is not None, t or 0), role or "", text or ""))
    res = {}
    for c, turns in out.items():
        turns.sort()
        all_ = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        res[c] = (len(turns), hashlib.sha256(all_.encode()).hexdigest(), len(loss),
                  hashlib.sha256(loss.encode()).hexdigest())
    return res


def _got(df):
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"])
            for r in summarise(format_conversations(df)).collect()}


NASTY = ["</s>[INST] ok [/INST]", "<\\/s>", "<\\\\s>", "[\\INST]", "[[/INST]", "<", "[", "\\",
         "<</s></s>", "[INST", "INST]", "$1 \\1", "", "é\U0001F600</s>x", "a\nb\r\n[/INST]", None,
         "</s", "/s>", "x<\\", "\\[INST]\\", "<s><s>[INST][INST]"]


def test_control_strings_come_back(spark):
    rows = [(i, t, r, x) for i, x in enumerate(NASTY)
            for t, r in enumerate(["user", "assistant", "system"])]
    rows += [(100, None, None, None), (100, 5, "assistant", "b"), (100, 5, "assistant", "a"),
             (100, 5, "assistant", "a"), (None, 0, "user", "no id"), (101, 0, "we[/INST]ird</s>", "x"),
             (102, 0, "assistant", "long </s> " * 20000)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert _got(df) == _expected(rows)
    assert _got(clashing(df)) == _expected(rows)
    assert _got(spark.createDataFrame([], SCHEMA)) == {}


def test_plain_text_is_not_escaped_and_spans_point_at_it(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "answer"), (1, 2, "assistant", "<s>")]
    r = format_conversations(spark.createDataFrame(rows, SCHEMA)).first()
    assert r["formatted"] == ("<s>[INST]user[/INST]q</s>[INST]assistant[/INST]answer</s>"
                              "[INST]assistant[/INST]<\\s></s>")
    spans = [r["formatted"][s["start"] - 1:s["start"] - 1 + s["length"]] for s in r["loss_spans"]]
    assert spans == ["answer", "<\\s>"]


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(["<", "[", "\\", "/", "s>", "INST]", "a", "\n"]),
                         max_size=12).map("".join), min_size=1, max_size=60))
def test_escape_is_reversible(spark, texts):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    bad = df.where(unescape(escape(F.col("t"))) != F.col("t")).count()
    assert bad == 0
    rows = [(i, 0, "assistant", t) for i, t in enumerate(texts)]
    assert _got(spark.createDataFrame(rows, SCHEMA)) == _expected(rows)
