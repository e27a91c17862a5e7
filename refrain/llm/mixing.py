"""Temperature mixing of sources, with DataFrame functions only.

A source holding the share ``p`` of all tokens gets the weight ``p^a / sum(p^a)``. The exponent ``a`` lies in
[0, 1]: 1 keeps the shares, 0 makes all sources equal. It is found by bisection twice: the largest ``a`` whose
weights reach the target entropy, and the smallest ``a`` at which no source is read more than ``max_repeats``
times; the repetition limit wins where the two disagree. The weights times the token budget are then realised
per source as block permutations: every epoch orders the source's documents by a new pseudo-random key and
deals them to blocks of about ``block_docs`` documents; whole epochs are emitted in full and the last one up to
the key at which its part of the budget is spent. To find that key, block totals are accumulated first and only
the one block in which the budget ends is accumulated document by document, so a source with a third of all
rows is never ordered in one task. The copies of a document are then decided from its id and its source's plan
alone: texts are not shuffled.

Defined cases: a null source is a source of its own; null or empty texts have no tokens; a source without any
token keeps each document once and counts in no weight; documents without tokens follow their key; rows with
equal keys (repeated rows) are taken or left together, within the budget; an empty table gives an empty mix.
``mix`` keeps all columns of its input and adds ``mix_epoch``, ``mix_block`` and ``mix_key``; input columns of
those names are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refrain.llm.common import WORD
from refrain.operators.components import salted_join
from refrain.session import staged

SEED = 20240
TARGET_ENTROPY = 0.995  # of the largest possible, ln(number of sources)
MAX_REPEATS = 4.0
BLOCK_DOCS = 4096
STEPS = 60  # of each bisection
SMALL_PLAN = 50_000  # sources whose plan may be broadcast
KEY_SPACE = 16**13


def word_count(column: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")


def source_key(column: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("null"))


def permutation_key(epoch: Column, doc_id: Column, seed: int) -> Column:
    """52 pseudo-random bits from seed, epoch and id."""
    name = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("long")


def block_of(key: Column, n_blocks: Column) -> Column:
    return F.floor(key.cast("double") / F.lit(float(KEY_SPACE)) * n_blocks).cast("long")


def _bisect(go_up) -> Column:
    """Fold STEPS halvings of [0, 1]; ``go_up(middle)`` says whether the answer lies above."""
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

    def step(s, _):
        mid = (s["lo"] + s["hi"]) / 2
        up = go_up(mid)
        return F.struct(F.when(up, mid).otherwise(s["lo"]).alias("lo"), F.when(up, s["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step)


def exponent(totals: DataFrame, budget: int | None, target_entropy: float, max_repeats: float) -> DataFrame:
    """At most one row ``alpha, total, budget, norm`` from ``totals (src, n_docs, tokens)``: sources are a small dimension."""
    some = totals.agg(
        F.collect_list(F.when(F.col("tokens") > 0, F.col("tokens"))).alias("each"), F.sum("tokens").alias("total")
    )
    some = some.withColumn("p", F.transform(F.array_sort("each"), lambda t: t / F.col("total")))
    some = some.withColumn("budget", F.col("total").cast("long") if budget is None else F.lit(budget).cast("long"))

    def total(f) -> Column:
        return F.aggregate(F.transform("p", f), F.lit(0.0), lambda a, x: a + x)

    def entropy(a: Column) -> Column:
        z = total(lambda p: F.pow(p, a))
        return F.log(z) - total(lambda p: F.pow(p, a) * a * F.log(p)) / z

    def repeats(a: Column) -> Column:  # the source read most often is the smallest one, as a <= 1
        least = F.col("p")[0]
        return F.pow(least, a) / total(lambda p: F.pow(p, a)) * F.col("budget") / (least * F.col("total"))

    goal = F.lit(target_entropy) * F.log(F.size("p").cast("double"))
    by_entropy = F.when(entropy(F.lit(1.0)) >= goal, 1.0).otherwise(_bisect(lambda a: entropy(a) >= goal)["lo"])
    by_repeats = F.when(repeats(F.lit(0.0)) <= max_repeats, 0.0).otherwise(_bisect(lambda a: repeats(a) > max_repeats)["hi"])
    out = some.filter(F.size("p") > 0).select("p", "total", "budget", F.round(F.greatest(by_entropy, by_repeats), 9).alias("alpha"))
    return out.select("alpha", "total", "budget", total(lambda p: F.pow(p, F.col("alpha"))).alias("norm"))


def mixing_plan(
    docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", tokens: Column | None = None, budget: int | None = None,
    target_entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS, block_docs: int = BLOCK_DOCS, seed: int = SEED,
) -> DataFrame:
    """One row per source: ``src, n_docs, tokens, alpha, weight, budget, full_epochs, rest, n_blocks, last_key``."""
    count = word_count("text") if tokens is None else tokens
    narrow = staged(docs.select(F.col(id_col).alias("id"), source_key(source_col).alias("src"), F.coalesce(count, F.lit(0)).cast("long").alias("tokens")), "mix-docs")
    totals = staged(narrow.groupBy("src").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("tokens").alias("tokens")), "mix-totals")
    one = exponent(totals, budget, target_entropy, max_repeats).first() or {"total": None, "alpha": None, "norm": None, "budget": None}  # no tokens at all
    share = F.col("tokens") / F.lit(one["total"])
    weight = F.when(F.col("tokens") > 0, F.pow(share, F.lit(one["alpha"])) / F.lit(one["norm"])).otherwise(0.0)
    plan = totals.withColumn("alpha", F.lit(one["alpha"]).cast("double")).withColumn("weight", weight)
    plan = plan.withColumn("budget", F.floor(F.col("weight") * F.lit(one["budget"])).cast("long"))
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(1).cast("long")
    plan = plan.withColumn("full_epochs", whole).withColumn("rest", F.when(F.col("tokens") > 0, F.col("budget") - F.col("full_epochs") * F.col("tokens")).otherwise(0).cast("long"))
    plan = staged(plan.withColumn("n_blocks", F.ceil(F.col("n_docs") / F.lit(block_docs))), "mix-plan")

    # the last, partial epoch
    part = _with_plan(narrow, plan.filter("rest > 0").select("src", "full_epochs", "rest", "n_blocks"))
    part = part.withColumn("key", permutation_key(F.col("full_epochs"), F.col("id"), seed)).withColumn("block", block_of(F.col("key"), F.col("n_blocks")))
    blocks = part.groupBy("src", "block").agg(F.sum("tokens").alias("t"), F.max("key").alias("top"), F.first("rest").alias("rest"))
    upto = Window.partitionBy("src").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    blocks = staged(blocks.withColumn("cum", F.sum("t").over(upto)), "mix-blocks")
    ends = blocks.filter("cum > rest and cum - t <= rest").groupBy("src").agg(F.min_by(F.struct("block", (F.col("cum") - F.col("t")).alias("before")), "block").alias("e"))
    ends = ends.select("src", F.col("e.block").alias("block"), F.col("e.before").alias("before"))
    inside = Window.partitionBy("src", "block").orderBy("key")  # rows with equal keys count together
    tail = _with_plan(part, ends, ["src", "block"]).withColumn("cum", F.col("before") + F.sum("tokens").over(inside)).filter("cum <= rest")
    tail = tail.groupBy("src").agg(F.max("key").alias("k"))
    whole_blocks = blocks.filter("cum <= rest").groupBy("src").agg(F.max("top").alias("k"))
    last = tail.unionByName(whole_blocks).groupBy("src").agg(F.max("k").alias("last_key"))
    return staged(plan.join(last, "src", "left").withColumn("last_key", F.coalesce("last_key", F.lit(-1))), "mix-plan")


def _with_plan(rows: DataFrame, plan: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Join the plan to the rows: broadcast while it is known to be small, else salted, as sources can be hot."""
    keys = keys or ["src"]
    if plan.count() <= SMALL_PLAN:
        return rows.join(F.broadcast(plan), keys)
    return salted_join(rows, plan, keys)


def mix(docs: DataFrame, plan: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """The documents as often as the plan says, one row per copy."""
    own = [c for c in docs.columns if c not in ("mix_epoch", "mix_block", "mix_key")]
    short = plan.select(
        F.col("src").alias("_mix_src"), F.col("full_epochs").alias("_mix_full"), F.col("last_key").alias("_mix_last"), F.col("n_blocks").alias("_mix_blocks")
    )
    rows = _with_plan(docs.select(*own, source_key(source_col).alias("_mix_src")), short, ["_mix_src"])
    rows = rows.withColumn("mix_epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_mix_full"))))
    rows = rows.withColumn("mix_key", permutation_key(F.col("mix_epoch"), F.col(id_col), seed))
    rows = rows.filter((F.col("mix_epoch") < F.col("_mix_full")) | (F.col("mix_key") <= F.col("_mix_last")))
    rows = rows.withColumn("mix_block", block_of(F.col("mix_key"), F.col("_mix_blocks")))
    return rows.select(*own, "mix_epoch", "mix_block", "mix_key")
