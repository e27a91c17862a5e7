"""Cluster summaries (A6-A9, W3-W5, C9, C13, C14, F13): clusters -> ``patterns`` rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from refrain.functions.text import first_line, is_representative_quality
from refrain.functions.topk import top_k
from refrain.session import staged

REPRESENTATIVE_CHARS = 100  # fixed value: representative text is cut to 100 characters
LABEL_CHARS = 80  # fixed value: labels are cut to 80 characters
SAMPLES = 5  # fixed value: representative + up to 4 further member texts
DATES = 10  # fixed value: persisted dates per pattern
PICKED = 500_000  # samples whose keys are sent to every task: about 30 MB
DIST_DECIMALS = 10  # distances are compared after rounding, so engines agree on ties

# Output tokens per occurrence by category, and the fallback cap.
OUTPUT_TOKENS = {"boilerplate-request": 700, "repeatable-workflow": 400, "context-re-explanation": 0}
FALLBACK_OUTPUT_CAP = 300
CHARS_PER_TOKEN = 4


def centroids(clustered_points: DataFrame) -> DataFrame:
    """Mean member vector per cluster (not re-normalised): ``cluster, idx, c``.

    ``clustered_points``: ``pid, cluster, mult, idx, val``.
    """
    e = clustered_points.select("cluster", "mult", F.explode(F.arrays_zip("idx", "val")).alias("e"))
    sums = e.groupBy("cluster", F.col("e.idx").alias("idx")).agg(F.sum(F.col("mult") * F.col("e.val")).alias("s"))
    sizes = clustered_points.groupBy("cluster").agg(F.sum("mult").alias("size"))
    return sums.join(sizes, "cluster").select("cluster", "idx", (F.col("s") / F.col("size")).alias("c"))


def centroid_distances(clustered_points: DataFrame, cents: DataFrame) -> DataFrame:
    """Squared Euclidean distance of each point to its cluster centroid: ``pid, d2``."""
    e = clustered_points.select("pid", "cluster", F.explode(F.arrays_zip("idx", "val")).alias("e")).select(
        "pid", "cluster", F.col("e.idx").alias("idx"), F.col("e.val").alias("val")
    )
    dots = e.join(cents, ["cluster", "idx"]).groupBy("pid").agg(F.sum(F.col("val") * F.col("c")).alias("dot"))
    cnorm = cents.groupBy("cluster").agg(F.sum(F.col("c") * F.col("c")).alias("cn2"))
    pnorm = F.aggregate(F.col("val"), F.lit(0.0), lambda a, x: a + x * x)
    base = clustered_points.select("pid", "cluster", pnorm.alias("pn2"))
    return (
        base.join(cnorm, "cluster")
        .join(dots, "pid", "left")
        .select("pid", F.round(F.col("pn2") + F.col("cn2") - 2.0 * F.coalesce("dot", F.lit(0.0)), DIST_DECIMALS).alias("d2"))
    )


def _hash60(c, at: int):
    """60 bits of the MD5 digest, from hex digit ``at`` on."""
    return F.conv(F.substring(F.md5(c), at, 15), 16, 10).cast("bigint")


def narrowed(messages: DataFrame) -> DataFrame:
    """What a summary needs of every message: all columns but ``text``, and ``bad, n_chars, head, short`` for it."""
    text = F.col("text")
    return messages.select(
        *[c for c in messages.columns if c != "text"], (~is_representative_quality(text)).alias("bad"), F.length(text).alias("n_chars"),
        first_line(text, REPRESENTATIVE_CHARS).alias("head"), F.when(F.length(text) <= REPRESENTATIVE_CHARS, text).alias("short"),
    )


def summarise(members: DataFrame, dists: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """A6-A8 (without category), W3, W4, A7 per cluster.

    ``members``: one row per message: ``cluster, pid, ord, uuid, ts, text``; or, with the ``texts`` of all messages by a unique ``ord``,
    the same ``narrowed``. Texts are read for the samples only.
    """
    where = ["cluster", "ord"] if texts is None else ["ord"]
    if texts is None:
        texts, members = members.select("cluster", "ord", "text"), narrowed(members)
    m = staged(members.join(dists, "pid"), "measured")
    rep_key = F.struct("bad", "d2", "ord")
    stats = m.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("size"),
        F.min_by("head", rep_key).alias("representative_text"),
        F.min_by("pid", rep_key).alias("rep_pid"),
        F.avg("n_chars").alias("avg_chars"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
        F.bit_xor(_hash60(F.col("uuid"), 1)).alias("_xor"),
        F.sum(F.shiftright(_hash60(F.col("uuid"), 16), 30)).alias("_sum"),
    )
    stats = stats.withColumn(
        "pattern_key",
        F.substring(F.md5(F.concat_ws("|", F.col("size").cast("string"), F.col("_xor").cast("string"), F.col("_sum").cast("string"))), 1, 8),
    ).checkpoint(eager=True)  # one row per cluster, read by the sample filter and the output
    # Further samples in member order, skipping texts equal to the representative (which is short).
    # Ranking runs on narrow (cluster, ord) rows; texts join back for the winners only.
    others = m.join(stats.select("cluster", "representative_text"), "cluster").filter(
        F.col("n_chars").isNotNull() & F.col("representative_text").isNotNull() & (F.col("short").isNull() | (F.col("short") != F.col("representative_text")))
    )
    picked = staged(top_k(others.select("cluster", "ord"), ["cluster"], [F.col("ord")], SAMPLES - 1, ["ord"]).select("cluster", "ord"), "picked")
    # up to PICKED samples (a checked bound of narrow rows) go to where the texts are; for more the texts move once
    picked = texts.join(F.broadcast(picked) if picked.count() <= PICKED else picked, where)
    samples = picked.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("ord", "text"))).alias("_s"))
    # First ten timestamps
    early = top_k(m.select("cluster", "ord", "ts"), ["cluster"], [F.col("ts"), F.col("ord")], DATES, ["ord"])
    dates = early.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("ts", "ord"))).alias("_d"))
    out = stats.join(samples, "cluster", "left").join(dates, "cluster", "left")
    return out.select(
        "cluster",
        "size",
        "rep_pid",
        "representative_text",
        F.concat(F.array("representative_text"), F.coalesce(F.col("_s.text"), F.array().cast("array<string>"))).alias("sample_texts"),
        F.coalesce(F.col("_d.ts"), F.array().cast("array<timestamp>")).alias("dates"),
        "first_seen",
        "last_seen",
        "avg_chars",
        "pattern_key",
    )


def global_row_number(df: DataFrame, order: list, name: str = "rn") -> DataFrame:
    """1-based position of every row in a total order, without a single-partition window.

    A distributed range sort tags each row with its partition and its place in
    that partition; the tagged rows are checkpointed (so every later read sees
    the same partition boundaries), and each partition's offset comes from the
    row counts per partition (one row per partition, broadcast).
    """
    tagged = (
        df.orderBy(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_mid", F.monotonically_increasing_id())
        .checkpoint(eager=True)
    )
    counts = tagged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = counts.select("_part", "_first", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    return tagged.join(F.broadcast(offsets), "_part").select(
        *df.columns, (F.col("_off") + F.col("_mid") - F.col("_first") + 1).alias(name)
    )


def rank_patterns(summary: DataFrame) -> DataFrame:
    """``pat-NNN`` by size descending, ties in discovery order (cluster root).

    The rank is a global row number over narrow (cluster, size) rows, computed
    with a range-partitioned sort rather than one task holding every cluster.
    """
    ranked = global_row_number(summary.select("cluster", "size"), [F.desc("size"), F.asc("cluster")])
    ranks = ranked.select("cluster", F.format_string("pat-%03d", F.col("rn")).alias("id"))
    return summary.join(ranks, "cluster")


def infer_label(text_col) -> "F.Column":
    """First line of the representative, <= 80 characters, else 'Unknown pattern'."""
    lab = first_line(text_col, LABEL_CHARS)
    return F.coalesce(F.nullif(lab, F.lit("")), F.lit("Unknown pattern"))


def wasted_tokens(size, avg_chars, category) -> tuple:
    """(input, output) tokens spent on a repeated request."""
    per = F.greatest(F.lit(1), F.floor(avg_chars / CHARS_PER_TOKEN).cast("bigint"))
    out_per = F.least(F.lit(FALLBACK_OUTPUT_CAP), per * 3)
    for cat, tokens in OUTPUT_TOKENS.items():
        out_per = F.when(category == cat, F.lit(tokens)).otherwise(out_per)
    return (per * size).cast("bigint"), (out_per * size).cast("bigint")
