"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and its text alone is trainable.
Turns after the last reply, and conversations without one, end in an example that holds all turns and trains nothing,
so that no turn is lost. Each turn is an opening mark, the escaped text and a closing mark; the marks' own strings inside
a text get a backslash after their first character, and so does a string that already looks like that, so that
``unescape`` gives the text back and no text can end a turn or begin another.

An example is one string with all turns before its reply, so the turns of one conversation meet in one row, and the
examples of a conversation grow with the square of its length: that is what the method asks for.

Edge cases: null text and null role are empty; rows of one turn go by role, then text; a null turn comes first; rows
with a null conversation are one conversation; an empty table gives no examples; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Opening and closing marks by role; any other role is written out.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("[ROLE]", "[/ROLE]", "</s>")
#: What is escaped, cut after its first character.
CONTROL = r"(<)(\\*)(<SYS>>|</SYS>>|s>|/s>)|(\[)(\\*)(INST\]|/INST\]|ROLE\]|/ROLE\])"
ESCAPED = r"(<)\\(\\*<SYS>>|\\*</SYS>>|\\*s>|\\*/s>)|(\[)\\(\\*INST\]|\\*/INST\]|\\*ROLE\]|\\*/ROLE\])"
#: A turn: text of system, user or assistant, or role and text of another one.
TURN = r"(?s)<<SYS>>(.*?)<</SYS>>|\[INST\](.*?)\[/INST\]|<s>(.*?)</s>|\[ROLE\](.*?)\[/ROLE\](.*?)</s>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(CONTROL), F.lit(r"$1$4\\$2$3$5$6"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(ESCAPED), F.lit("$1$2$3$4"))


def _by_role(role: Column, side: int, other: Column) -> Column:
    known = F
    for name, marks in MARKS.items():
        known = known.when(role == name, marks[side])
    return known.otherwise(other)


def examples(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, example, n_turns, formatted, loss_start, loss_chars): examples of a conversation are numbered from 1; the trainable part of
    ``formatted`` begins after ``loss_start`` characters (code points) and has ``loss_chars`` of them."""
    who, said = F.coalesce(F.col(role), F.lit("")), escape(F.coalesce(F.col(text), F.lit("")))
    opening = _by_role(who, 0, F.concat(F.lit(OTHER[0]), escape(who), F.lit(OTHER[1])))
    turns = rows.select(
        F.col(conversation).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"), who.alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
            F.concat(opening, said, _by_role(who, 1, F.lit(OTHER[2]))).alias("shown"), F.length(said).alias("chars"),
        ).alias("t"),
    )
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    ends = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda k: (k == F.size("turns")) | (F.element_at("turns", k)["role"] == "assistant"))
    each = whole.select("conv_id", "turns", F.posexplode(ends).alias("example", "upto"))
    shown = F.array_join(F.transform(F.slice("turns", F.lit(1), F.col("upto")), lambda t: t["shown"]), "")
    last = F.element_at("turns", F.col("upto"))
    each = each.select("conv_id", (F.col("example") + 1).alias("example"), F.col("upto").alias("n_turns"), shown.alias("formatted"), last["chars"].alias("chars"), (last["role"] == "assistant").alias("reply"))
    return each.select(
        "conv_id", "example", "n_turns", "formatted", F.when(F.col("reply"), F.length("formatted") - F.col("chars") - len(MARKS["assistant"][1])).otherwise(0).alias("loss_start"),
        F.when(F.col("reply"), F.col("chars")).otherwise(0).alias("loss_chars"),
    )


def trained_text(formatted: Column, start: Column, chars: Column) -> Column:
    """The text under the loss mask of an example, read from the formatted string."""
    return unescape(F.substring(formatted, start + 1, chars))


def read_turns(formatted: Column) -> Column:
    """The (role, text) turns of a formatted string."""
    parse = lambda group: F.regexp_extract_all(formatted, F.lit(TURN), F.lit(group))
    shown, parts = parse(0), F.arrays_zip(parse(0).alias("shown"), parse(1).alias("system"), parse(2).alias("user"), parse(3).alias("assistant"), parse(4).alias("role"), parse(5).alias("other"))

    def turn(p: Column) -> Column:
        role, text = F, F
        for name, (opening, _) in MARKS.items():
            role, text = role.when(p["shown"].startswith(opening), name), text.when(p["shown"].startswith(opening), p[name])
        return F.struct(role.otherwise(unescape(p["role"])).alias("role"), unescape(text.otherwise(p["other"])).alias("text"))

    return F.when(F.size(shown) > 0, F.transform(parts, turn)).otherwise(F.array().cast("array<struct<role:string,text:string>>"))
