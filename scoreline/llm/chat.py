"""Preference formatting of conversations, with DataFrame functions only.

``preference_pairs`` takes two tables of turns, chosen and rejected, that share a pair id; ``answer_pairs`` makes
both sides from one table of conversations. The longest common prefix of turns (same role and text) is rendered
once as the prompt; what is left on either side is its completion, with the spans of the completion's characters
that a model should learn: the text and end mark of assistant turns.

In ``answer_pairs`` the chosen side is a conversation, and the rejected side is that conversation up to its last
assistant turn, which the last assistant turn of another conversation replaces: a real answer, but to another
question. Conversations are dealt by a hash of their id to rings of about RING with an answer; the other one is the next of
these in the ring by id, whatever ids there are, and after the last the first. One that is alone in its ring is paired with
itself. A conversation without an assistant turn is rejected whole, with another one's answer after it, if its ring has any.

If one side is a prefix of the other, its completion is empty; the prompt is then the whole of it. Turns are
ordered by turn, role and text, so repeated turns keep a fixed order, and are all kept.

Defined results: null roles and texts count as empty; null turns come first; rows with a null pair id are left
out; a pair with one side only has no common turns, and null as the other side's completion and spans; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreline.llm.common import written

#: Conversations of a ring, about.
RING = 1000

START, BETWEEN, END = "<|im_start|>", "\n", "<|im_end|>\n"


def turns_of(side: DataFrame, pair: Column, name: str) -> DataFrame:
    """One row for each pair: its turns in order as array<struct<turn, role, text>>."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return side.filter(pair.isNotNull()).groupBy(pair.alias("pair_id")).agg(F.sort_array(F.collect_list(turn)).alias(name))


def rendered(turns: Column) -> Column:
    """The turns in the chat template, as text."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), t.role, F.lit(BETWEEN), t.text, F.lit(END))), "")


def learned_spans(turns: Column) -> Column:
    """array<struct<start, end>>: characters of the rendered turns that assistant texts and their end marks fill."""
    before = lambda t: F.length(t.role) + len(START) + len(BETWEEN)
    size = lambda t: before(t) + F.length(t.text) + len(END)
    step = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def walk(state: Column, t: Column) -> Column:
        span = F.struct((state.at + before(t)).alias("start"), (state.at + size(t)).alias("end"))
        return F.struct((state.at + size(t)).alias("at"), F.when(t.role == "assistant", F.concat(state.spans, F.array(span))).otherwise(state.spans).alias("spans"))

    return F.aggregate(turns, step, walk, lambda state: state.spans)


def preference_pairs(chosen: DataFrame, rejected: DataFrame, pair: Column) -> DataFrame:
    """(pair_id, common_turns, prompt, chosen, chosen_spans, rejected, rejected_spans) of every pair id."""
    return formatted(turns_of(chosen, pair, "c").join(turns_of(rejected, pair, "r"), "pair_id", "full"))


def answer_pairs(turns: DataFrame) -> DataFrame:
    """The columns of preference_pairs, one row for each conversation of turns (conv_id, turn, role, text)."""
    sides = turns_of(turns, F.col("conv_id").cast("long"), "c")
    # The place of the last assistant turn, from 1; 0 where there is none.
    last = F.array_max(F.transform("c", lambda t, i: F.when(t.role == "assistant", i + 1).otherwise(0)))
    placed = written(sides.withColumn("last", last), "conversations")
    rings = max(1, -(-placed.filter("last > 0").count() // RING))
    ring = F.pmod(F.conv(F.substring(F.md5(F.col("pair_id").cast("string")), 1, 8), 16, 10).cast("long"), F.lit(rings))
    dealt = placed.withColumns({"ring": ring, "own": F.when(F.col("last") > 0, F.element_at("c", F.col("last")))})
    # Going down by id, the last answer before a conversation is that of the next id; the last of all is that of the first.
    down, before = Window.partitionBy("ring").orderBy(F.col("pair_id").desc()), Window.unboundedPreceding
    answer = lambda upto: F.last("own", ignorenulls=True).over(down.rowsBetween(before, upto))
    given = dealt.withColumn("other", F.coalesce(answer(-1), answer(Window.unboundedFollowing)))
    kept = F.when(F.col("last") > 0, F.slice("c", F.lit(1), F.greatest(F.col("last") - 1, F.lit(0)))).otherwise(F.col("c"))
    return formatted(given.select("pair_id", "c", F.concat(kept, F.filter(F.array("other"), lambda t: t.isNotNull())).alias("r")))


def formatted(both: DataFrame) -> DataFrame:
    """Pairs (pair_id, c, r) of turns in order, cut after their common prefix and rendered."""
    same = F.zip_with("c", "r", lambda a, b: (a.role == b.role) & (a.text == b.text))
    # zip_with pads the shorter side with nulls, which end the common prefix too.
    differs = F.array_position(F.transform(same, lambda s: F.coalesce(s, F.lit(False))), F.lit(False))
    common = F.when(F.col("c").isNull() | F.col("r").isNull(), 0).otherwise(F.when(differs == 0, F.size("c")).otherwise(differs - 1)).cast("int")
    cut = both.withColumn("common_turns", common)
    rest = lambda side: F.slice(side, F.col("common_turns") + 1, F.greatest(F.size(side) - F.col("common_turns"), F.lit(0)))
    prompt = F.coalesce(rendered(F.slice("c", F.lit(1), F.col("common_turns"))), F.lit(""))
    return cut.select(
        "pair_id",
        "common_turns",
        prompt.alias("prompt"),
        rendered(rest("c")).alias("chosen"),
        learned_spans(rest("c")).alias("chosen_spans"),
        rendered(rest("r")).alias("rejected"),
        learned_spans(rest("r")).alias("rejected_spans"),
    )
