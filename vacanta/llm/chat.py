"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted, neighbours of one role are merged by
an array aggregation, and every merged block becomes

    ### role: first text</turn>second text</turn>

with a line break between blocks. Texts are escaped (backslash, ``<`` and ``#``; in roles also ``:``),
so neither mark can occur inside a text and ``parse_turns`` reads back what went in.

Defined results: a null text or role counts as empty; a null turn number sorts first; turns with the
same number sort by role, then text; repeated rows stay; a null conversation id is a conversation of
its own; an empty table gives an empty table. Other columns of the input are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, MIDDLE, CLOSE, BREAK = "### ", ": ", "</turn>", "\n"
#: Character and what stands for it. The backslash comes first here and last when reading back.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))


def escape(text: Column, pairs: tuple[tuple[str, str], ...] = ESCAPES) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)


def unescape(text: Column, pairs: tuple[tuple[str, str], ...] = ESCAPES) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[1]), F.lit(p[0])), reversed(pairs), text)


def merged_blocks(turns: Column) -> Column:
    """Sorted turn structs to array<struct<role, texts>>, one element per run of a role."""
    start = F.array().cast("array<struct<role:string,texts:array<string>>>")

    def add(done: Column, turn: Column) -> Column:
        last = F.element_at(done, -1)
        joins = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["role"] == turn["role"])
        grown = F.concat(
            F.slice(done, F.lit(1), F.size(done) - 1),
            F.array(F.struct(last["role"].alias("role"), F.concat(last["texts"], F.array(turn["text"])).alias("texts"))),
        )
        fresh = F.concat(done, F.array(F.struct(turn["role"].alias("role"), F.array(turn["text"]).alias("texts"))))
        return F.when(joins, grown).otherwise(fresh)

    return F.aggregate(turns, start, add)


def block_text(block: Column) -> Column:
    body = F.transform(block["texts"], lambda t: F.concat(escape(t), F.lit(CLOSE)))
    return F.concat(F.lit(HEAD), escape(block["role"], ROLE_ESCAPES), F.lit(MIDDLE), F.array_join(body, ""))


def loss_spans(blocks: Column, role: str) -> Column:
    """Where the texts of ``role`` lie in the formatted string: array<struct<start, length>>, code points from 0."""
    pieces = F.flatten(
        F.transform(
            blocks,
            lambda b, i: F.transform(
                b["texts"],
                lambda t, k: F.struct(
                    F.when(k == 0, F.length(escape(b["role"], ROLE_ESCAPES)) + len(HEAD + MIDDLE) + F.when(i > 0, len(BREAK)).otherwise(0))
                    .otherwise(0)
                    .cast("long")
                    .alias("before"),
                    F.length(escape(t)).cast("long").alias("length"),
                    (b["role"] == role).alias("in_loss"),
                ),
            ),
        )
    )
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def add(done: Column, piece: Column) -> Column:
        at = done["at"] + piece["before"]
        span = F.array(F.struct(at.alias("start"), piece["length"].alias("length")))
        return F.struct(
            (at + piece["length"] + len(CLOSE)).alias("at"),
            F.when(piece["in_loss"], F.concat(done["spans"], span)).otherwise(done["spans"]).alias("spans"),
        )

    return F.aggregate(pieces, start, add, lambda done: done["spans"])


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans) per conversation of (conv_id, turn, role, text)."""
    clean = turns.select(
        "conv_id",
        F.struct("turn", F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")).alias("_t"),
    )
    return (
        clean.groupBy("conv_id")
        .agg(F.array_sort(F.collect_list("_t")).alias("_turns"))
        .select("conv_id", merged_blocks(F.col("_turns")).alias("_blocks"))
        .select(
            "conv_id",
            F.array_join(F.transform("_blocks", block_text), BREAK).alias("formatted"),
            loss_spans(F.col("_blocks"), loss_role).alias("loss_spans"),
        )
    )


def parse_turns(formatted: Column) -> Column:
    """The turns of a formatted string, unmerged and unescaped: array<struct<role, text>>."""
    blocks = F.slice(F.split(formatted, HEAD, -1), F.lit(2), F.greatest(F.size(F.split(formatted, HEAD, -1)) - 1, F.lit(0)))

    def turns(block: Column) -> Column:
        role = unescape(F.substring_index(block, MIDDLE, 1), ROLE_ESCAPES)
        body = F.substr(block, F.length(F.substring_index(block, MIDDLE, 1)) + len(MIDDLE) + 1)
        texts = F.split(body, CLOSE, -1)
        return F.transform(
            F.slice(texts, F.lit(1), F.size(texts) - 1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text"))
        )

    return F.flatten(F.transform(blocks, turns))


def masked_texts(formatted: Column, spans: Column) -> Column:
    """What lies under the loss mask, unescaped: one string per span."""
    return F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))))
