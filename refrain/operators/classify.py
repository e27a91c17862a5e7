"""Pattern classification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refrain.functions.contains import contains_join
ONE_OFF = "one-off-task"
MIN_CONFIDENCE = 0.25  # fixed value: centroid similarity below this is a one-off
MAX_BROADCAST_CENTROID_ROWS = 1_000_000

# Fixed values that must equal the reference: keyword lists per category, in
# declared order (earlier category wins a tie). Trailing spaces are part of the keyword.
KEYWORD_RULES = [
    ("boilerplate-request", ["generate", "create", "scaffold", "setup", "bootstrap",
                             "template", "boilerplate", "starter", "dockerfile", "initialize"]),
    ("repeatable-workflow", ["run ", "deploy", "commit", "push", "lint", "build", "release",
                             "then ", "after that", "workflow", "and then"]),
    ("context-re-explanation", ["this is a ", "we use ", "our stack", "the project uses",
                                "framework is", "i am using", "we are using", "tech stack",
                                "this project", "our backend", "our frontend"]),
]


def keyword_table(spark: SparkSession, rules=KEYWORD_RULES) -> DataFrame:
    """``priority, category, keyword`` rows (caller may pass other rules)."""
    rows = [(p, cat, kw) for p, (cat, kws) in enumerate(rules) for kw in kws]
    return spark.createDataFrame(rows, "priority int, category string, keyword string")


def keyword_scores(items: DataFrame, key: str, text: str, keywords: DataFrame) -> DataFrame:
    """J2 + C10: ``key, priority, category, score`` = distinct keywords contained, per category.

    """
    low = items.select(F.col(key).alias("_k"), F.lower(F.col(text)).alias("_t"))
    hits = contains_join(low, "_t", keywords, "keyword")
    return hits.groupBy("_k", "priority", "category").agg(F.count_distinct("keyword").alias("score")).withColumnRenamed("_k", key)


def classify_by_keywords(items: DataFrame, key: str, text: str, keywords: DataFrame) -> DataFrame:
    """Best category by keyword count, ties to the first declared; none -> one-off."""
    scores = keyword_scores(items, key, text, keywords)
    best = scores.groupBy(key).agg(F.max_by("category", F.struct(F.col("score"), -F.col("priority"))).alias("_cat"))
    return items.join(best, key, "left").withColumn(
        "category", F.when(F.col(text).isNull() | (F.length(text) == 0), F.lit(ONE_OFF)).otherwise(F.coalesce("_cat", F.lit(ONE_OFF)))
    ).drop("_cat")


def category_centroids(exemplars: DataFrame) -> DataFrame:
    """A10: ``priority, category, idx, c``: mean exemplar vector, re-normalised (zero left as is).

    ``exemplars``: ``priority, category, idx, val`` (sparse layout).
    """
    e = exemplars.select("priority", "category", F.explode(F.arrays_zip("idx", "val")).alias("e"))
    n = exemplars.groupBy("priority", "category").agg(F.count(F.lit(1)).alias("n"))
    mean = e.groupBy("priority", "category", F.col("e.idx").alias("idx")).agg(F.sum("e.val").alias("s")).join(
        n, ["priority", "category"]
    ).select("priority", "category", "idx", (F.col("s") / F.col("n")).alias("m"))
    norm = mean.groupBy("category").agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("norm"))
    return mean.join(norm, "category").select(
        "priority", "category", "idx", F.when(F.col("norm") > 0, F.col("m") / F.col("norm")).otherwise(F.col("m")).alias("c")
    )


def classify_by_centroid(items: DataFrame, key: str, cents: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Nearest category centroid by dot product; must exceed 0 and reach 0.25.

    ``items``: ``key, idx, val``. The equi-join on ``idx`` against the broadcast
    centroid entries (categories x dims rows) computes every dot product.
    """
    e = items.select(F.col(key).alias("_k"), F.explode(F.arrays_zip("idx", "val")).alias("e")).select(
        "_k", F.col("e.idx").alias("idx"), F.col("e.val").alias("val")
    )
    # categories x dimensions rows: broadcast only under a checked bound
    if cents.count() <= MAX_BROADCAST_CENTROID_ROWS:
        cents = F.broadcast(cents)
    sims = e.join(cents, "idx").groupBy("_k", "priority", "category").agg(F.sum(F.col("val") * F.col("c")).alias("sim"))
    sims = sims.filter(F.col("sim") > 0)
    best = sims.groupBy("_k").agg(
        F.max_by("category", F.struct(F.col("sim"), -F.col("priority"))).alias("_cat"), F.max("sim").alias("_sim")
    )
    return items.join(best.withColumnRenamed("_k", key), key, "left").select(
        *[c for c in items.columns],
        F.when(F.col("_sim") >= min_confidence, F.col("_cat")).otherwise(F.lit(ONE_OFF)).alias("category"),
    )


def drop_one_offs(patterns: DataFrame) -> DataFrame:
    """remove one-off clusters; unclassified (null) patterns stay. IDs are not renumbered."""
    return patterns.filter(F.col("category").isNull() | (F.col("category") != ONE_OFF))


def category_counts(patterns: DataFrame) -> DataFrame:
    """Patterns per category (null = unclassified)."""
    return patterns.groupBy("category").agg(F.count(F.lit(1)).alias("n_patterns"))
