"""Preference formatting: the common turn prefix of two conversations as prompt, the rest as masked completions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """A turn is ``before`` + role + ``after`` + text + ``end``. Text and ``end`` of a completion's turns by ``trained`` count in the loss."""

    before: str = "<|"
    after: str = "|>\n"
    end: str = "<|end|>\n"
    trained: str = "assistant"


def _turns(rows: DataFrame, side: int, pair: str) -> DataFrame:
    return rows.select(
        F.col(pair).alias("pair_id"),
        F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        F.lit(side).alias("side"),
    )


def first_difference(turns: DataFrame) -> DataFrame:
    """(pair_id, cut): the first turn at which the sides differ in role, text or number of rows; null if none does.

    Turns are compared as multisets: each (role, text) of a turn must be there as often on either side. Rows are
    counted by (pair, turn, role, text), so that a long conversation, or a long turn, is spread over tasks; texts
    meet as two 64-bit hashes.
    """
    marks = [F.xxhash64(F.lit(i), "text").alias(f"h{i}") for i in range(2)]
    more = F.sum(F.when(F.col("side") == 0, 1).otherwise(-1)).alias("more")
    seen = turns.select("pair_id", "turn", "side", "role", *marks).groupBy("pair_id", "turn", "role", "h0", "h1").agg(more)
    return seen.groupBy("pair_id").agg(F.min(F.when(F.col("more") != 0, F.col("turn"))).alias("cut"))


def preference_segments(chosen: DataFrame, rejected: DataFrame, pair: str = "pair_id", template: Template = Template()) -> DataFrame:
    """A row per rendered turn: pair_id, part (prompt, chosen, rejected), turn, role, segment, n_masked, n_trained.

    Both inputs have the pair's id, turn, role and text. The longest common prefix of turns is rendered
    once, from the chosen side; the segments of a part, in the order of turns, are its text. The first
    ``n_masked`` characters of a segment are left out of the loss, the other ``n_trained`` count; nothing of
    a prompt counts. Segments stay rows, as one conversation may be too long for one task.

    Null roles and texts are empty, a null turn comes before all others, a null pair is a pair of its own.
    Equal conversations give a prompt alone. A pair that is in one input only has no prompt. Rows of
    one turn are kept each, and compared without their order. No rows: no rows.
    """
    turns = _turns(chosen, 0, pair).union(_turns(rejected, 1, pair))
    cuts = first_difference(turns).withColumnRenamed("pair_id", "cut_pair")
    shared = F.coalesce(F.col("turn") < F.col("cut"), F.lit(True))
    rows = turns.join(cuts, turns["pair_id"].eqNullSafe(cuts["cut_pair"])).where(~shared | (F.col("side") == 0))
    part = F.when(shared, "prompt").when(F.col("side") == 0, "chosen").otherwise("rejected")
    head = F.concat(F.lit(template.before), "role", F.lit(template.after))
    segment = F.concat(head, "text", F.lit(template.end))
    trained = F.when(~shared & (F.col("role") == template.trained), F.length(segment) - F.length(head)).otherwise(0)
    return rows.select(
        "pair_id", part.alias("part"), "turn", "role", segment.alias("segment"),
        (F.length(segment) - trained).cast("long").alias("n_masked"), trained.cast("long").alias("n_trained"),
    )


def replies(conversations: DataFrame, by: str = "assistant") -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected sides from conversations alone (conv_id, turn, role, text).

    Chosen is a conversation up to its last reply. Rejected is the same with the first reply's text in place
    of the last one's, a reply that does not answer; without an earlier reply its text is empty. Conversations
    without a reply, and turns after the last one, stay as they are on both sides.
    """
    turn = F.coalesce(F.col("turn").cast("long"), F.lit(-1))
    reply = F.col("role") == by
    ends = conversations.groupBy(F.col("conv_id").alias("end_id")).agg(
        F.max(F.when(reply, turn)).alias("last"),
        F.min(F.when(reply, turn)).alias("first"),
        F.min(F.when(reply, F.struct(turn.alias("t"), F.coalesce("text", F.lit("")).alias("text")))).alias("early"),
    )
    rows = conversations.join(ends, conversations["conv_id"].eqNullSafe(ends["end_id"]))
    rows = rows.where(F.col("last").isNull() | (turn <= F.col("last")))
    poor: Column = F.when(F.col("last") > F.col("first"), F.col("early.text")).otherwise("")
    swapped = F.when(reply & (turn == F.col("last")), poor).otherwise(F.col("text"))
    columns = [F.col("conv_id").alias("pair_id"), "turn", "role"]
    return rows.select(*columns, "text"), rows.select(*columns, swapped.alias("text"))
