"""Chat formatting in Spark expressions only.

The turns of a conversation are collected as structs and sorted; adjacent turns of one role are merged
into one block, in which a separator stands between the texts, so the turns can be read back::

    <|im_start|>user\\ntext<|im_end|>\\n<|im_start|>assistant\\ntext<|im_sep|>text<|im_end|>\\n

Inside texts and roles every ``<``, backslashes and ``|`` in a row gets one more backslash before the
bar, so ``<|`` never occurs there; taking one away restores the text. A role's line breaks and
backslashes are escaped too, as the role ends with its line. The loss mask is a list of (start, length) in code points
that covers each text of the trained role, as escaped, and nothing else.

Defined cases: a null text or role is empty; very long texts are kept whole, and a conversation is one row; turns are ordered by turn, null first, then role and
text, and repeated rows are kept; a null conv_id is a conversation of its own; an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, STOP, JOINT = "<|im_start|>", "<|im_end|>\n", "<|im_sep|>"
TRAINED = "assistant"
#: Pieces whose lengths are added up for one start: bounds the work of a turn, however long the conversation.
BLOCK = 64


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    # A pair of backslashes is set aside first, so that "\\n" isn't taken for a line break.
    aside = F.replace(role, F.lit("\\\\"), F.lit("<|"))
    return unescape(F.replace(F.replace(aside, F.lit("\\n"), F.lit("\n")), F.lit("<|"), F.lit("\\")))


def format_chats(turns: DataFrame, trained: str = TRAINED) -> DataFrame:
    """conv_id, formatted, loss_spans (array of start, from 0, and length), n_blocks."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    first = lambda i: (i == 0) | (F.get("turns", i - 1)["role"] != F.get("turns", i)["role"])
    lead = lambda t, i: F.when(
        first(i), F.concat(F.when(i > 0, STOP).otherwise(""), F.lit(START), escape_role(t["role"]), F.lit("\n"))
    ).otherwise(JOINT)
    pieces = F.transform("turns", lambda t, i: F.struct(lead(t, i).alias("lead"), escape(t["text"]).alias("text"), (t["role"] == trained).alias("trained")))
    chats = chats.withColumn("pieces", pieces)
    # Where a piece starts: the code points of the blocks of pieces before its own, and of the pieces before it in its block.
    lengths = F.transform("pieces", lambda p: F.char_length(p["lead"]) + F.char_length(p["text"]))
    chats = chats.withColumn("lengths", lengths)
    total = lambda values: F.aggregate(values, F.lit(0), lambda a, n: a + n)
    sums = F.transform(F.expr(f"sequence(0, (size(lengths) - 1) div {BLOCK})"), lambda b: total(F.slice("lengths", b * BLOCK + 1, F.lit(BLOCK))))
    chats = chats.withColumn("sums", sums)
    chats = chats.withColumn("before", F.transform("sums", lambda _, b: total(F.slice("sums", F.lit(1), b))))
    start = lambda i: F.get("before", F.floor(i / BLOCK).cast("int")) + total(F.slice("lengths", F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK))
    every = F.transform("pieces", lambda p, i: F.struct(p["trained"].alias("trained"), (start(i) + F.char_length(p["lead"])).alias("start"), F.char_length(p["text"]).alias("length")))
    spans = F.transform(F.filter(every, lambda s: s["trained"]), lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length")))
    formatted = F.concat(F.array_join(F.transform("pieces", lambda p: F.concat(p["lead"], p["text"])), ""), F.lit(STOP))
    return chats.select(
        "conv_id", formatted.alias("formatted"), spans.alias("loss_spans"),
        F.size(F.filter("pieces", lambda p: p["lead"] != JOINT)).alias("n_blocks"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    blocks = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda _, i: i > 0)  # nothing stands before the first
    body = lambda b: F.substr(b, F.lit(1), F.char_length(b) - len(STOP))
    at = lambda b: F.locate("\n", b)
    parts = F.transform(
        blocks,
        lambda b: F.transform(
            F.split(F.substr(body(b), at(b) + 1), r"<\|im_sep\|>"),
            lambda t: F.struct(unescape_role(F.substr(b, F.lit(1), at(b) - 1)).alias("role"), unescape(t).alias("text")),
        ),
    )
    return F.flatten(parts)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"]))), "")
