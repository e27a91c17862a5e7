"""Preference formatting of chosen and rejected conversations, with DataFrame functions only.

The turns of both conversations of a pair are ordered; their longest common prefix of turns (equal role and text)
is rendered once as the prompt, and what follows on either side as two completions. Every turn is rendered as
``<|role|>``, a line feed, its text, ``<|end|>`` and a line feed. In the completions only what the assistant
says is to be learned: ``*_spans`` lists the half-open code point ranges of assistant texts with their end mark; turn
headers and all turns of other roles are masked. Inside roles and texts a backslash is doubled and ``<|`` becomes
``<\\|``, so no text can pass for a mark and the rendering can be undone.

Turns are gathered per conversation, so a task holds single conversations, never a group of them.

Defined cases: null texts and roles count as empty; rows without a pair id belong to no pair; repeated rows count
once; different rows of one turn number are ordered by role and text, null turn numbers come first; a pair that is
missing on one side has no turns there; equal conversations give two empty completions (``differs`` is false); an
empty table gives an empty result. Only the named columns are read, so other input columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refrain.session import staged

END = "<|end|>\n"
LEARNED = "assistant"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def _gathered(turns: DataFrame, pair: str, turn: str, role: str, text: str, name: str) -> DataFrame:
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.filter(F.col(pair).isNotNull()).select(F.col(pair).alias("pair"), F.struct(F.col(turn).alias("turn"), said(role).alias("role"), said(text).alias("text")).alias("t"))
    return rows.groupBy("pair").agg(F.transform(F.array_sort(F.collect_set("t")), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias(name))


def _head(t: Column) -> Column:
    return F.concat(F.lit("<|"), escaped(t["role"]), F.lit("|>\n"))


def _body(t: Column) -> Column:
    return F.concat(escaped(t["text"]), F.lit(END))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def learned_spans(turns: Column) -> Column:
    """``array<struct<from, to>>`` of the code points that count for the loss."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<from: int, to: int>>").alias("spans"))

    def step(s: Column, t: Column) -> Column:
        first = s["at"] + F.length(_head(t))
        last = first + F.length(_body(t))
        more = F.concat(s["spans"], F.array(F.struct(first.alias("from"), last.alias("to"))))
        return F.struct(last.alias("at"), F.when(t["role"] == LEARNED, more).otherwise(s["spans"]).alias("spans"))

    return F.aggregate(turns, start, step)["spans"]


def preference_pairs(chosen: DataFrame, rejected: DataFrame, *, pair: str = "pair_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``pair, n_prompt_turns, prompt, chosen, rejected, chosen_spans, rejected_spans, differs`` of every pair."""
    both = _gathered(chosen, pair, turn, role, text, "c").join(_gathered(rejected, pair, turn, role, text, "r"), "pair", "full")
    none = F.array().cast("array<struct<role: string, text: string>>")
    both = both.select("pair", F.coalesce("c", none).alias("c"), F.coalesce("r", none).alias("r"))
    shorter = F.least(F.size("c"), F.size("r"))
    same = F.when(shorter > 0, F.transform(F.sequence(F.lit(0), shorter - 1), lambda i: F.get("c", i) == F.get("r", i))).otherwise(F.array().cast("array<boolean>"))
    first_other = F.array_position(same, False).cast("int")
    both = both.withColumn("n", F.when(first_other > 0, first_other - 1).otherwise(shorter))
    rest = lambda c: F.slice(c, F.col("n") + 1, F.greatest(F.size(c) - F.col("n"), F.lit(0)))
    both = both.withColumns({"prefix": F.slice("c", F.lit(1), F.col("n")), "c": rest("c"), "r": rest("r")})
    return both.select(
        F.col("pair").alias(pair), F.col("n").alias("n_prompt_turns"), rendered(F.col("prefix")).alias("prompt"),
        rendered(F.col("c")).alias("chosen"), rendered(F.col("r")).alias("rejected"),
        learned_spans(F.col("c")).alias("chosen_spans"), learned_spans(F.col("r")).alias("rejected_spans"),
        ((F.size("c") > 0) | (F.size("r") > 0)).alias("differs"),
    )


def following(ids: DataFrame) -> DataFrame:
    """``id, next``: the next of the distinct ids in ascending order (after the last: the first).

    Ids are ordered in ranges, each of them in one task; only the first id of every range meets the others'.
    """
    ranged = staged(ids.repartitionByRange("id").select("id", F.spark_partition_id().alias("range")), "ids")
    inside = F.lead("id").over(Window.partitionBy("range").orderBy("id"))
    ring = Window.orderBy("range")  # one row per range
    heads = ranged.groupBy("range").agg(F.min("id").alias("head"))
    heads = heads.select("range", F.lead("head").over(ring).alias("after"), F.first("head").over(ring).alias("first"))
    return ranged.select("id", "range", inside.alias("inside")).join(heads, "range").select("id", F.coalesce("inside", "after", "first").alias("next"))


def with_swapped_replies(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs from plain conversations (``conv_id`` integer, ``turn, role, text``).

    Chosen is every conversation as it is. In rejected the replies from some point on are another conversation's: of ``n``
    assistant turns those beyond the first ``conv_id mod n`` take the texts of the assistant turns, in turn, of the next
    conversation by ascending id (after the last: the first) that has any. So prompts end at different turns, completions hold
    several, and a conversation without a reply is the same on both sides. Repeated rows count once; rows without an id
    belong to no conversation.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    turns = conversations.filter("conv_id is not null").select("conv_id", "turn", text("role"), text("text")).distinct()
    replies = turns.filter(F.col("role") == LEARNED)
    replies = replies.withColumn("j", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "text")) - 1)
    replies = staged(replies, "replies")  # read as both sides of the exchange
    counts = replies.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    to = following(counts.select(F.col("conv_id").alias("id")))
    to = to.join(counts.select(F.col("conv_id").alias("id"), "n"), "id").join(counts.select(F.col("conv_id").alias("next"), F.col("n").alias("n_next")), "next")
    told = replies.join(to.withColumnRenamed("id", "conv_id"), "conv_id")
    kept = told.filter(F.col("j") < F.pmod("conv_id", "n")).select("conv_id", "turn", "role", "text")
    asked = told.filter(F.col("j") >= F.pmod("conv_id", "n")).select("conv_id", "turn", "role", "next", (F.col("j") % F.col("n_next")).alias("k"))
    theirs = replies.select(F.col("conv_id").alias("next"), F.col("j").alias("k"), "text")
    swapped = asked.join(theirs, ["next", "k"]).select("conv_id", "turn", "role", "text")
    return turns, turns.filter(F.col("role") != LEARNED).unionByName(kept).unionByName(swapped)
