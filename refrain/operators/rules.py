"""Regex rules over raw messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from refrain.session import spread_if_few

# Fixed values that must equal the reference: (name, description, suggestion, regex).
RULES = [
    (
        "no-context-preamble",
        "You start many conversations by re-explaining the same project context.",
        "Add your stack, architecture, and conventions to CLAUDE.md so Claude always has this context.",
        r"(?i)(this project (uses|is|has)|we (use|are using)|our (stack|setup|project) (is|uses)|i('m| am) working on)",
    ),
    (
        "do-it-same-as-before",
        'You frequently ask Claude to "do it the same way as last time" — but Claude has no memory.',
        "Create a skill or add recurring patterns to CLAUDE.md so Claude has the context without you re-stating it.",
        r"(?i)(same (way|approach|style|format) (as|like) (before|last time|previously)|like you did (before|last time))",
    ),
    (
        "version-specification",
        "You repeatedly specify version numbers for the same tools/frameworks.",
        "Document your pinned versions in CLAUDE.md so you don't need to repeat them.",
        r"(?i)(python 3\.\d+|node (v?\d+)|react \d+|fastapi \d+|next\.?js \d+)",
    ),
    (
        "auth-setup-repeat",
        "You frequently describe your auth setup to Claude.",
        "Document your auth architecture in CLAUDE.md — it's clearly a core system Claude needs to know about.",
        r"(?i)(jwt|oauth|auth(entication|orization)|session (token|cookie)|api key|bearer token)",
    ),
    (
        "test-framework-clarify",
        "You keep telling Claude which test framework to use.",
        'Add "Use pytest (not unittest)" or equivalent to your CLAUDE.md.',
        r"(?i)(use pytest|don('t| not) use unittest|use jest (not|instead)|use vitest)",
    ),
]
MIN_MATCHES = 2  # fixed value: a rule is reported from two matching messages on


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """``pos, name, description, suggestion, regex`` (caller may pass other rows)."""
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rules)], "pos int, name string, description string, suggestion string, regex string")


def rule_matches(messages: DataFrame, rules=RULES) -> DataFrame:
    """``pos, uuid`` for every (rule, message) whose regex finds a match.

    With the rules known up front each regex is a literal, compiled once per
    task; one array column per message is exploded, so there is no nested-loop
    join. ``(?u)`` makes Java's case folding Unicode-aware, like the original.
    Texts are only moved where a scan of few splits would leave cores idle.
    """
    messages = spread_if_few(messages.select("uuid", "text"))
    hits = F.array(*[F.when(F.regexp_like(F.col("text"), F.lit("(?u)" + r[3])), F.lit(i)) for i, r in enumerate(rules)])
    return messages.select("uuid", F.explode(F.array_compact(hits)).alias("pos"))


def rule_counts(messages: DataFrame, rules=RULES, min_matches: int = MIN_MATCHES) -> DataFrame:
    """Matches per rule over all messages, kept from ``min_matches``, ranked by count then rule order."""
    spark = messages.sparkSession
    counts = rule_matches(messages, rules).groupBy("pos").agg(F.count(F.lit(1)).alias("n_matches"))
    kept = counts.filter(F.col("n_matches") >= min_matches).join(F.broadcast(rules_table(spark, rules)), "pos")
    w = Window.orderBy(F.desc("n_matches"), F.asc("pos"))  # at most len(rules) rows
    return kept.select("name", "description", "suggestion", "n_matches", F.row_number().over(w).alias("rank"))
