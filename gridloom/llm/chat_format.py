"""Chat formatting: conversations as one training string each, with a loss mask, by Spark expressions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Marks of the template. All begin with "<|" and a letter; in texts "<|" becomes "<||".
TURN, TEXT, NEXT, END = "<|turn|>", "<|text|>", "<|next|>", "<|end|>\n"


def escaped(c):
    return F.replace(c, F.lit("<|"), F.lit("<||"))


def unescaped(c):
    return F.replace(c, F.lit("<||"), F.lit("<|"))


def format_chats(turns: DataFrame) -> DataFrame:
    """``(conv_id, pieces, loss, formatted)``: pieces in order, whether each is trained on, and all of them joined.

    A block holds adjacent turns of one role: TURN role TEXT text NEXT text ... END. Texts of the role
    ``assistant`` are under the loss mask, marks never are. Turns are ordered by turn, then role and text.
    Null text or role: empty; rows without turn come first, rows without conv_id form one conversation;
    repeated rows are turns of their own. Other columns are not read. A conversation is one output row and
    so must fit in memory; work on it is linear in its length.
    """
    rows = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    role = lambda i: F.get("turns", i)["role"]

    def piece(t, i):
        opens = F.when((i == 0) | (role(i - 1) != t["role"]), F.concat(F.lit(TURN), escaped(t["role"]), F.lit(TEXT))).otherwise(F.lit(NEXT))
        closes = F.when((i + 1 == F.size("turns")) | (role(i + 1) != t["role"]), F.lit(END)).otherwise(F.lit(""))
        part = lambda s, on: F.struct(s.alias("s"), on.alias("loss"))
        return F.array(part(opens, F.lit(False)), part(escaped(t["text"]), t["role"] == "assistant"), part(closes, F.lit(False)))

    made = chats.select("conv_id", F.flatten(F.transform("turns", piece)).alias("made"))
    return made.select("conv_id", F.col("made.s").alias("pieces"), F.col("made.loss").alias("loss"), F.array_join("made.s", "").alias("formatted"))


def read_chats(chats: DataFrame) -> DataFrame:
    """``(conv_id, formatted, turns, trained)`` back from formatted strings and masks: array of (role, text), and the text under the mask."""
    blocks = F.filter(F.split("formatted", r"<\|end\|>\n"), lambda b: b != "")

    def block(b):
        head = F.split(b, r"<\|text\|>")
        role = F.substring(F.get(head, F.lit(0)), len(TURN) + 1, 1 << 30)
        return F.transform(F.split(F.get(head, F.lit(1)), r"<\|next\|>"), lambda x: F.struct(unescaped(role).alias("role"), unescaped(x).alias("text")))

    trained = F.transform(F.filter(F.arrays_zip("pieces", "loss"), lambda p: p["loss"]), lambda p: unescaped(p["pieces"]))
    return chats.select("conv_id", "formatted", F.flatten(F.transform(blocks, block)).alias("turns"), F.array_join(trained, "").alias("trained"))
