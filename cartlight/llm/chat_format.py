"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs and sorted; adjacent turns of
one role become one block; blocks are concatenated under a template:

    <|im_start|>role<|im_sep|>text[<|im_next|>text ...]<|im_end|>\\n

Control strings inside roles and texts are escaped by one more backslash after
their first character (``<|`` becomes ``<\\|``, ``[INST]`` becomes
``[\\INST]``, ``[\\INST]`` becomes ``[\\\\INST]``), so that one backslash less
gives the original back and no text can end or open a block. Every control
string starts with ``<`` or ``[`` and has that character nowhere else, so none
can arise across the border of text and template.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, NEXT, END = "<|im_start|>", "<|im_sep|>", "<|im_next|>", "<|im_end|>\n"
#: First character, backslashes, rest of a control string.
CONTROL = r"([<\[])(\\*)(\||/?s>|/?INST\])"
ESCAPED = r"([<\[])\\(\\*)(\||/?s>|/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def _pairs(turns: Column, make) -> Column:
    """``make(turn, previous, next)`` of each turn; the outer neighbours are null."""
    return F.transform(turns, lambda t, i: make(t, F.get(turns, i - 1), F.get(turns, i + 1)))


def format_chats(
    df: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    loss_roles: tuple[str, ...] = ("assistant",),
) -> DataFrame:
    """One row a conversation: ``segments`` (array of text and loss flag) and ``formatted``, their concatenation.

    The segments whose flag is true are the text under the loss mask: texts of
    ``loss_roles`` only, never the template. A null text or role is an empty
    string, a null turn sorts first, equal turns sort by role, then text;
    repeated rows are turns of their own. Rows with a null conversation form
    one conversation. An empty table gives an empty one. A conversation is one
    row of the result, so its turns meet in one task; other columns are not
    read.
    """
    turn = F.struct(
        F.col(f"`{turn_col}`").alias("turn"),
        F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
    )
    chats = df.groupBy(F.col(f"`{conv_col}`").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def parts(t: Column, before: Column, after: Column) -> Column:
        joined = F.coalesce(before["role"] == t["role"], F.lit(False))
        last = ~F.coalesce(after["role"] == t["role"], F.lit(False))
        head = F.when(joined, F.lit(NEXT)).otherwise(F.concat(F.lit(START), escape(t["role"]), F.lit(SEP)))
        piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(
            piece(head, F.lit(False)),
            piece(escape(t["text"]), t["role"].isin(*loss_roles)),
            piece(F.when(last, F.lit(END)).otherwise(F.lit("")), F.lit(False)),
        )

    segments = F.filter(F.flatten(_pairs(F.col("turns"), parts)), lambda s: s["text"] != "")
    return chats.select("conv_id", segments.alias("segments")).select(
        "conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted")
    )


def read_chats(df: DataFrame) -> DataFrame:
    """The turns and the loss texts, read back from ``formatted`` and ``segments`` alone."""
    blocks = F.filter(F.split("formatted", F.lit(r"<\|im_start\|>")), lambda b: b != "")
    role = lambda b: F.substring_index(b, SEP, 1)
    body = lambda b: F.substring_index(F.substring(b, F.length(role(b)) + len(SEP) + 1, F.length(b)), END, 1)
    turns = F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(body(b), F.lit(r"<\|im_next\|>")),
                lambda text: F.struct(unescape(role(b)).alias("role"), unescape(text).alias("text")),
            ),
        )
    )
    loss = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"]))
    return df.select("conv_id", "formatted", turns.alias("turns"), F.array_join(loss, "").alias("loss_text"))
