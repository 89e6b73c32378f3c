"""Chat formatting in relational expressions only, and its exact inverse.

Turn structs of a conversation are collected and sorted; adjacent turns of one
role merge (each array element is compared with its neighbours, so the work is linear in the
turns); each message becomes

    <|im_start|>ROLE\\n TEXT <|im_sep|> TEXT ... <|im_end|>\\n

with ``<|im_sep|>`` at the seam of merged turns, so the turns can be read back.
Control strings in a text are escaped reversibly: a backslash doubles, and
``<|`` becomes ``<\\|``, so no text can hold ``<|``.  A line end in a role becomes
``<\\r>``.

Null texts and roles count as empty.  Turns sort by ``turn`` (nulls first), then role, then
text, as they are before escaping; repeated rows are turns of their own.  A null ``conv_id`` is a
conversation.  Extra columns are ignored.  A conversation is one row of the
output, so it is the one thing here that must fit a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fixed values: the template's control strings
START, END, SEAM = "<|im_start|>", "<|im_end|>\n", "<|im_sep|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\r>"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\r>"), F.lit("\n")))


def format_chats(turns: DataFrame) -> DataFrame:
    """``conv_id, formatted`` from rows ``conv_id, turn, role, text``."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = turns.select("conv_id", turn.alias("turn")).groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    other = lambda t, i: F.coalesce(F.get("turns", i)["role"] != t["role"], F.lit(True))  # noqa: E731  no neighbour there, or one of another role
    open_ = lambda t, i: F.when(other(t, i - 1), F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"))).otherwise(F.lit(SEAM))
    close = lambda t, i: F.when(other(t, i + 1), F.lit(END)).otherwise(F.lit(""))
    pieces = F.transform("turns", lambda t, i: F.concat(open_(t, i), escape(t["text"]), close(t, i)))
    return chats.select("conv_id", F.array_join(pieces, "").alias("formatted"))


def starts_of(lengths: str, piece: int = 256) -> Column:
    """Running sums before each element of an array column, in runs of ``piece`` so that no long array is copied per element."""
    zero = lambda at: F.struct(at.alias("at"), F.array().cast("array<int>").alias("before"))
    step = lambda a, n: F.struct((a["at"] + n).alias("at"), F.array_append(a["before"], a["at"]).alias("before"))
    numbers = F.sequence(F.lit(0), (F.size(lengths) / piece).cast("int"))
    cut = lambda k: F.slice(lengths, k * piece + 1, piece)
    totals = F.transform(numbers, lambda k: F.struct(k.alias("k"), F.aggregate(cut(k), F.lit(0), lambda a, n: a + n).alias("n")))
    bases = F.aggregate(totals, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<k:int,at:int>>").alias("runs")), lambda a, t: F.struct((a["at"] + t["n"]).alias("at"), F.array_append(a["runs"], F.struct(t["k"].alias("k"), a["at"].alias("at"))).alias("runs")), lambda a: a["runs"])
    return F.flatten(F.transform(bases, lambda b: F.aggregate(cut(b["k"]), zero(b["at"]), step, lambda a: a["before"])))


def read_chats(formatted: DataFrame, key: str = "conv_id") -> DataFrame:
    """The turns back, and the loss mask, from ``formatted`` alone.

    ``turns``: array of (role, text), unescaped, one per original turn.
    ``loss``: array of (start, length) in code points of ``formatted``: every
    assistant text, without the template around it.  ``learnt``: the texts under that mask, unescaped, one after another.
    """
    blocks = F.transform(
        F.filter(F.split("formatted", r"<\|im_end\|>\n"), lambda b: b != ""),
        lambda b: F.struct(
            F.substring_index(F.substring(b, len(START) + 1, 1 << 30), "\n", 1).alias("role"),
            F.split(F.regexp_replace(b, r"\A[^\n]*\n", ""), r"<\|im_sep\|>").alias("texts"),
        ),
    )
    read = formatted.select(key, "formatted", blocks.alias("messages"))
    turns = F.flatten(F.transform("messages", lambda m: F.transform(m["texts"], lambda t: F.struct(unescape_role(m["role"]).alias("role"), unescape(t).alias("text")))))
    # lengths of what stands before each text in the output, then running sums
    pieces = F.flatten(
        F.transform(
            "messages",
            lambda m: F.transform(
                m["texts"],
                lambda t, i: F.struct(
                    F.when(i == 0, F.length(m["role"]) + len(START) + 1).otherwise(len(SEAM)).alias("before"),
                    F.length(t).alias("n"),
                    F.when(i == F.size(m["texts"]) - 1, len(END)).otherwise(0).alias("after"),
                    (m["role"] == "assistant").alias("learnt"),
                ),
            ),
        )
    )
    rows = read.select(key, "formatted", "messages", turns.alias("turns"), pieces.alias("pieces"))
    rows = rows.select("*", F.transform("pieces", lambda p: p["before"] + p["n"] + p["after"]).alias("lengths"))
    rows = rows.select("*", F.arrays_zip(F.col("pieces").alias("p"), starts_of("lengths").alias("at")).alias("placed"))
    loss = F.transform(F.filter("placed", lambda x: x["p"]["learnt"]), lambda x: F.struct((x["at"] + x["p"]["before"]).alias("start"), x["p"]["n"].alias("length")))
    learnt = F.flatten(F.transform(F.filter("messages", lambda m: m["role"] == "assistant"), lambda m: F.transform(m["texts"], unescape)))
    return rows.select(key, "formatted", "turns", loss.alias("loss"), F.array_join(learnt, "").alias("learnt"))


def chat_digests(turns: DataFrame) -> DataFrame:
    """Digests of what is read back from the formatted output."""
    back = read_chats(format_chats(turns))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), "UTF-8"), 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2(F.encode("learnt", "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
