"""Chat formatting by a grammar round trip (DataFrame functions only).

A conversation is rendered as its turns, one after the other:

    <s>LEVEL ROLE[INST]TEXT[/INST]</s>

LEVEL is one digit, how the turn's role and text are escaped:

    0  as they are
    1  "&" -> "&amp;", then the control strings <s> </s> [INST] [/INST] lose their
       first character to "&lt;" or "&#91;"
    2  "&", "<" and "[" everywhere

A turn is rendered at the least level at which the parser gives its role and text
back: the parser cuts the whole output after every "</s>", and a turn into what is
before and after its first "[INST]" and up to its last "[/INST]".  Level 2 leaves no
character that a control string begins with, so it always parses.

The loss mask marks the texts of assistant turns in the rendered string as (start,
length) in code points, without template or neighbours.

Cases: null text or role: as empty; null turn: before all others; turns with equal
numbers come in the order of role, then text; repeated rows are repeated turns; null
conv_id: a conversation of its own; an empty table gives an empty result; other
columns are not read.  A conversation is one row, so it must fit a task, as its
rendered text must.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from answer_eval.llm.common import prepare

OPEN, BODY, END_BODY, CLOSE = "<s>", "[INST]", "[/INST]", "</s>"
ASSISTANT = "assistant"
CONTROLS = (OPEN, CLOSE, BODY, END_BODY)
_SAFE = {"<": "&lt;", "[": "&#91;"}


def escape(x: Column, level: int) -> Column:
    if level == 0:
        return x
    x = F.replace(x, F.lit("&"), F.lit("&amp;"))
    for mark in CONTROLS if level == 1 else _SAFE:
        x = F.replace(x, F.lit(mark), F.lit(_SAFE[mark[0]] + mark[1:]))
    return x


def unescape(x: Column, level: Column) -> Column:
    plain = x
    for sign, safe in _SAFE.items():
        plain = F.replace(plain, F.lit(safe), F.lit(sign))
    plain = F.replace(plain, F.lit("&amp;"), F.lit("&"))
    return F.when(level == "0", x).otherwise(plain)


def render(role: Column, text: Column, level: int) -> Column:
    return F.concat(F.lit(f"{OPEN}{level}"), escape(role, level), F.lit(BODY), escape(text, level),
                    F.lit(END_BODY + CLOSE))


def split_turns(formatted: Column) -> Column:
    """The rendered turns of a whole output, each with its "</s>"; what follows the last is no turn."""
    cut = F.split(formatted, "</s>", -1)
    return F.transform(F.slice(cut, 1, F.size(cut) - 1), lambda t: F.concat(t, F.lit(CLOSE)))


def parse_turn(turn: Column) -> Column:
    """struct(level, role, text, at, size) of a rendered turn, or null if it isn't one; at and
    size are the escaped text's place in it."""
    body = F.instr(turn, F.lit(BODY))
    level = F.substring(turn, len(OPEN) + 1, 1)
    head = len(OPEN) + 1
    at = body + len(BODY) - 1                                  # code points before the text
    size = F.char_length(turn) - len(END_BODY + CLOSE) - at
    ok = F.startswith(turn, F.lit(OPEN)) & F.endswith(turn, F.lit(END_BODY + CLOSE)) \
        & (body > head) & (size >= 0) & level.isin("0", "1", "2")
    role = F.substr(turn, F.lit(head + 1), body - head - 1)
    text = F.substr(turn, at + 1, size)
    return F.when(ok, F.struct(level.alias("level"), unescape(role, level).alias("role"),
                               unescape(text, level).alias("text"), at.alias("at"), size.alias("size")))


def format_turn(role: Column, text: Column) -> Column:
    """The turn at the least level whose output is cut into this one turn and parses back."""
    out = render(role, text, 2)
    for level in (1, 0):
        r = render(role, text, level)
        turns = split_turns(r)
        p = parse_turn(F.get(turns, 0))
        back = (F.size(turns) == 1) & (p["role"] == role) & (p["text"] == text)
        out = F.when(F.coalesce(back, F.lit(False)), r).otherwise(out)
    return out


def format_conversations(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """One row per conversation of turns (conv_id, turn, role, text): conv_id, formatted, and
    loss_spans, array<struct<start, length>> over formatted."""
    prepare(spark)
    c = F.col
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    order = ("turn", "role", "text")
    by = W.partitionBy("conv_id").orderBy(*order)
    rendered = turns.select("conv_id", "turn", role.alias("role"), text.alias("text")) \
        .withColumn("out", format_turn(c("role"), c("text"))) \
        .withColumn("k", F.row_number().over(by)) \
        .withColumn("start", F.sum(F.char_length("out")).over(by.rowsBetween(W.unboundedPreceding, 0))
                    - F.char_length("out"))
    p = parse_turn(c("out"))
    span = F.when(c("role") == ASSISTANT, F.struct((c("start") + p["at"]).alias("start"),
                                                   p["size"].cast("long").alias("length")))
    conv = rendered.withColumn("span", span).groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("k", "out"))).alias("outs"),
        F.array_sort(F.collect_list("span")).alias("loss_spans"))
    return conv.select("conv_id", F.array_join(F.transform("outs", lambda x: x["out"]), "").alias("formatted"),
                       "loss_spans")


def read_back(formatted: DataFrame) -> DataFrame:
    """The parse of whole outputs (conv_id, formatted), a row per turn: conv_id, k (from 0), p, null
    where the output isn't one of this template."""
    return formatted.select("conv_id", F.posexplode_outer(split_turns(F.col("formatted"))).alias("k", "out")) \
        .select("conv_id", "k", parse_turn(F.col("out")).alias("p"))


def digest_conversations(formatted: DataFrame) -> DataFrame:
    """What an output says when it is read again: conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars.  The text under the mask is that of the assistant turns."""
    def digest(turns):
        lines = F.transform(turns, lambda p: F.concat(p["role"], F.lit("\n"), p["text"], F.lit("\n")))
        loss = F.array_join(F.transform(F.filter(turns, lambda p: p["role"] == ASSISTANT), lambda p: p["text"]), "")
        return F.struct(
            F.size(F.filter(turns, lambda p: p.isNotNull())).cast("long").alias("n_turns"),
            F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
            F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"))

    # a conversation is one row and stays one: its turns are parsed once, as the argument of a lambda
    turns = F.transform(split_turns(F.col("formatted")), parse_turn)
    return formatted.select("conv_id", F.transform(F.array(turns), digest)[0].alias("d"),
                            F.char_length("formatted").cast("long").alias("formatted_chars")) \
        .select("conv_id", "d.*", "formatted_chars")
