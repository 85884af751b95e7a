"""Chat formatting with a grammar round trip, in DataFrame functions only.

Grammar of a formatted conversation::

    conversation := "<s>" turn*
    turn         := "[INST]" role "[/INST]" text "</s>"

Control strings are ``<s>``, ``</s>``, ``[INST]`` and ``[/INST]``. The parser is
deterministic: a turn ends at the first ``</s>``, its role at the first
``[/INST]``; then one backslash is taken from every control string written with
backslashes after its first character. Texts are first rendered as they are and
reparsed; those that do not come back identical are escaped by adding one
backslash to each control string in them (however many it has), which the parser
undoes exactly, and are compared again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, OPEN, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
_TURN = r"(?s)\[INST\](.*?)\[/INST\](.*?)</s>"
TRAINED = "assistant"


def escape(text: Column) -> Column:
    """One more backslash in every control string, plain or escaped."""
    t = F.regexp_replace(text, r"<(\\*)(/?s>)", r"<\\$1$2")
    return F.regexp_replace(t, r"\[(\\*)(/?INST\])", r"[\\$1$2")


def unescape(text: Column) -> Column:
    """One backslash less in every escaped control string."""
    t = F.regexp_replace(text, r"<\\(\\*)(/?s>)", r"<$1$2")
    return F.regexp_replace(t, r"\[\\(\\*)(/?INST\])", r"[$1$2")


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(CLOSE), text, F.lit(END))


def parse_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted text, unescaped."""
    pairs = F.arrays_zip(F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(1)).alias("role"),
                         F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(2)).alias("text"))
    return F.transform(pairs, lambda t: F.struct(unescape(t["role"]).alias("role"),
                                                 unescape(t["text"]).alias("text")))


def _round_trips(rendered: Column, role: Column, text: Column) -> Column:
    """The rendered turn parses to exactly this one turn, all of it consumed,
    and holds no control string but its own three."""
    turns = parse_turns(rendered)
    whole = F.regexp_replace(rendered, _TURN, "") == ""
    marks = F.regexp_count(rendered, F.lit(r"</?s>|\[/?INST\]")) == 3
    return (whole & marks & (F.size(turns) == 1) & (turns[0]["role"] == role)
            & (turns[0]["text"] == text))


def format_conversations(rows: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, turns (parsed back from it) and
    loss_spans (array<struct<start, length>>: 1-based code points of the formatted
    text under the loss mask, the bodies of assistant turns).

    Rows are ordered by turn, then role and text (repeated rows all stay, a null
    turn comes first); null role and text count as empty; a null conv_id is one
    conversation. A conversation is one text, so its rows meet in one task by
    nature; rows are grouped by conversation only. Raises if a text still does
    not come back after escaping. Other columns are ignored.
    """
    r = rows.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                    F.coalesce("text", F.lit("")).alias("text"))
    plain = render_turn(F.col("role"), F.col("text"))
    r = r.withColumn("_ok", _round_trips(plain, F.col("role"), F.col("text")))
    r = r.withColumn("_r", F.when(F.col("_ok"), F.col("role")).otherwise(escape(F.col("role"))))
    r = r.withColumn("_t", F.when(F.col("_ok"), F.col("text")).otherwise(escape(F.col("text"))))
    again = F.col("_ok") | _round_trips(render_turn(F.col("_r"), F.col("_t")), F.col("role"),
                                        F.col("text"))
    r = r.withColumn("_out", F.when(again, render_turn(F.col("_r"), F.col("_t"))).otherwise(
        F.raise_error(F.lit("a turn does not survive the round trip")).cast("string")))
    conv = r.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(
        "turn", "role", "text", "_out"))).alias("_rows"))
    formatted = F.concat(F.lit(START), F.array_join(F.transform("_rows", lambda t: t["_out"]), ""))
    conv = conv.withColumn("formatted", formatted)
    body = F.substring("formatted", len(START) + 1, 2_000_000_000)
    conv = conv.withColumn("_raw", F.arrays_zip(
        F.regexp_extract_all(body, F.lit(_TURN), F.lit(1)).alias("r"),
        F.regexp_extract_all(body, F.lit(_TURN), F.lit(2)).alias("t")))
    conv = conv.withColumn("turns", parse_turns(body))
    same = F.col("turns") == F.transform("_rows", lambda t: F.struct(
        t["role"].alias("role"), t["text"].alias("text")))
    conv = conv.withColumn("turns", F.when(same, F.col("turns")).otherwise(F.raise_error(F.lit(
        "a conversation does not survive the round trip")).cast("array<struct<role:string,text:string>>")))
    marks = len(OPEN) + len(CLOSE)
    spans = F.aggregate(
        "_raw",
        F.struct(F.lit(len(START) + 1).alias("at"),
                 F.array().cast("array<struct<trained:boolean,start:int,length:int>>").alias("s")),
        lambda acc, t: F.struct(
            (acc["at"] + F.length(t["r"]) + F.length(t["t"]) + marks + len(END)).alias("at"),
            F.concat(acc["s"], F.array(F.struct(
                (t["r"] == TRAINED).alias("trained"),
                (acc["at"] + F.length(t["r"]) + marks).alias("start"),
                F.length(t["t"]).alias("length")))).alias("s")),
        lambda acc: F.filter(acc["s"], lambda s: s["trained"]))
    return conv.select("conv_id", "formatted", "turns", F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), s["length"].alias("length"))).alias("loss_spans"))


def summarise(formatted: DataFrame) -> DataFrame:
    """Digests read back from formatted conversations."""
    turns = F.array_join(F.transform("turns", lambda t: F.concat(
        t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = F.array_join(F.transform("loss_spans", lambda s: unescape(
        F.substr(F.col("formatted"), s["start"], s["length"]))), "")
    return (formatted.withColumn("_loss", masked)
            .select("conv_id", F.size("turns").cast("long").alias("n_turns"),
                    F.sha2(turns, 256).alias("turns_sha256"),
                    F.length("_loss").cast("long").alias("loss_chars"),
                    F.sha2("_loss", 256).alias("loss_sha256"),
                    F.length("formatted").cast("long").alias("formatted_chars")))
