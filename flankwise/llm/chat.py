"""Chat formatting: every assistant turn becomes an example with all earlier turns as context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: Control strings of the template; texts never hold one unescaped.
BEGIN, END, HEAD, HEAD_END = "<s>", "</s>", "[INST] ", " [/INST]"
CONTROL = r"<(?=/?s>)|\[(?=/?INST\])"


def escape(text: Column) -> Column:
    """`\\` becomes `\\-`, and `\\.` goes behind the first character of every control string, so none is left."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\-")), CONTROL, r"$0\\.")


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\."), F.lit("")), F.lit("\\-"), F.lit("\\"))


def prefix_target_examples(
    turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    target: str = "assistant",
) -> DataFrame:
    """(conversation, example, formatted, loss_start, loss_length), one row per assistant turn.

    `formatted` is `<s>` and then `[INST] role [/INST]text</s>` per turn; only the characters
    from loss_start (0-based code points) on, loss_length of them, are trained: the reply of
    the last turn. Turns after the last reply would be lost, so a conversation that ends
    otherwise closes with one more example of all its turns that trains nothing.

    Rows are ordered by turn (null first), equal turns by role and text, repeated rows are
    repeated turns. Null text and role are empty, a null conversation is one of its own, an
    empty table gives no examples; columns beside the four are not read. A conversation is formatted in
    one row per example, as large as its text.
    """
    rows = turns.select(
        F.col(conversation).alias("conversation"), F.col(turn).alias("turn"),
        text_or_empty(role).alias("role"), text_or_empty(text).alias("text"))
    whole = rows.groupBy("conversation").agg(F.array_sort(F.collect_list(F.struct(
        F.col("turn").isNotNull().alias("known"), "turn", "role", "text"))).alias("turns"))
    marked = F.transform("turns", lambda t: F.concat(F.lit(HEAD), escape(t["role"]), F.lit(HEAD_END)))
    bodies = F.transform("turns", lambda t: escape(t["text"]))
    last = F.size("turns")
    ends = F.filter(F.sequence(F.lit(1), last), lambda i: (F.element_at("turns", i)["role"] == target) | (i == last))
    examples = whole.select("conversation", "turns", marked.alias("heads"), bodies.alias("bodies"), F.posexplode(ends).alias("example", "end"))
    shown = F.array_join(F.transform(
        F.sequence(F.lit(1), F.col("end")),
        lambda i: F.concat(F.element_at("heads", i), F.element_at("bodies", i), F.lit(END))), "")
    trained = F.element_at("turns", F.col("end"))["role"] == target
    length = F.length(F.element_at("bodies", F.col("end")))
    return examples.select(
        "conversation", "example", F.concat(F.lit(BEGIN), shown).alias("formatted"), trained.alias("trained"), length.alias("reply_length")
    ).select(
        "conversation", "example", "formatted",
        F.when(F.col("trained"), F.length("formatted") - len(END) - F.col("reply_length")).alias("loss_start"),
        F.when(F.col("trained"), F.col("reply_length")).otherwise(0).alias("loss_length"))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted example."""
    parts = F.split(F.substr(formatted, F.lit(len(BEGIN) + 1)), F.lit(END), F.lit(-1))
    turns = F.slice(parts, F.lit(1), F.size(parts) - 1)
    body = lambda t: F.substr(t, F.lit(len(HEAD) + 1))
    at = lambda t: F.instr(body(t), HEAD_END)
    return F.transform(turns, lambda t: F.struct(
        unescape(F.substr(body(t), F.lit(1), at(t) - 1)).alias("role"),
        unescape(F.substr(body(t), at(t) + len(HEAD_END))).alias("text")))


def read_loss(formatted: Column, start: Column, length: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return F.when(length > 0, unescape(F.substr(formatted, start + 1, length))).otherwise(F.lit(""))
