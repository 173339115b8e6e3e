"""Chat formatting by prefix-target expansion, in DataFrame built-ins only.

Every assistant turn becomes an example of its own: all turns before it are context and its text alone is trainable.
A turn is written as

    <|im_start|>ROLE\\nTEXT<|im_end|>\\n

ROLE is URL-encoded. In TEXT a backslash goes before each backslash and before a bar that follows "<", so no escaped
text holds "<|" and each one is restored by dropping the backslash of every backslash pair.

Scale: one shuffle by conversation. The examples of a conversation grow with the square of its turns; that is the
method's own output. A conversation is one string in the output, so it must fit in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\|(?<=<)\|", r"\\$0")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def chat_examples(turns: DataFrame, target: str = "assistant") -> DataFrame:
    """One row per target turn: conv_id, target_index (from 0), formatted, loss_start, loss_chars, trainable, last.

    The loss mask is the code points [loss_start, loss_start + loss_chars) of `formatted`: the escaped text of the reply,
    without any mark. A conversation that doesn't end with a target turn gives one more example with an empty mask and
    trainable = false, so that every turn is in the output; `last` marks the example that holds the whole conversation.
    Turns go by `turn`; ties and repeated rows all stay, in the order of role and text. Null turn: first. Null text or
    role: empty. Null conv_id: a conversation of its own. Empty table: empty result. Other columns are ignored.
    """
    one = turns.select("conv_id", F.struct(F.col("turn").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")).alias("t"))
    grouped = one.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    parts = grouped.select(
        "conv_id",
        F.transform("ts", lambda t: F.concat(F.lit(START), F.url_encode(t["role"]), F.lit("\n"))).alias("heads"),
        F.transform("ts", lambda t: escape(t["text"])).alias("bodies"),
        F.transform("ts", lambda t: t["role"] == F.lit(target)).alias("wanted"),
    )
    parts = parts.withColumn("segments", F.zip_with("heads", "bodies", lambda h, b: F.concat(h, b, F.lit(END))))
    each = parts.select("*", F.posexplode("wanted").alias("target_index", "trainable")).where(F.col("trainable") | (F.col("target_index") == F.size("wanted") - 1))
    i = F.col("target_index")
    prefix = F.array_join(F.slice("segments", F.lit(1), i), "")
    each = each.select("conv_id", "target_index", "trainable", (i == F.size("wanted") - 1).alias("last"), F.concat(prefix, F.element_at("heads", i + 1)).alias("prefix"), F.element_at("bodies", i + 1).alias("body"))
    return each.select(
        "conv_id", "target_index", F.concat("prefix", "body", F.lit(END)).alias("formatted"),
        F.char_length("prefix").cast("long").alias("loss_start"), F.when(F.col("trainable"), F.char_length("body")).otherwise(0).cast("long").alias("loss_chars"), "trainable", "last",
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted text: array of struct(role, text)."""
    pieces = F.split(formatted, r"<\|im_end\|>\n")
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    body = lambda x: F.substring(x, F.lit(len(START) + 1), F.char_length(x))
    return F.transform(pieces, lambda x: F.struct(F.url_decode(F.substring_index(body(x), "\n", 1)).alias("role"), unescape(F.substring(body(x), F.instr(body(x), "\n") + 1, F.char_length(x))).alias("text")))


def loss_text(formatted: Column, start: Column, chars: Column) -> Column:
    """The trainable text of an example, unescaped."""
    return unescape(F.substring(formatted, (start + 1).cast("int"), chars.cast("int")))
