"""S1-F11 and J1 on a directory of session logs that keeps growing.

Everything up to the substantial-message filter and the rule matches is
stateless per line, so the same expressions run on ``readStream``. Clustering
needs the whole corpus and stays a batch job over the landed messages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refrain.functions.text import is_substantial
from refrain.operators.rules import RULES, rule_matches
from refrain.sources.logs import LOG_GLOB, parse_lines, to_messages


def stream_messages(spark: SparkSession, root: str, max_files_per_trigger: int = 1000) -> DataFrame:
    """Streaming canonical messages from new ``*.jsonl`` files one level below ``root``."""
    lines = (
        spark.readStream.format("text")
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .load(f"{root.rstrip('/')}/{LOG_GLOB}")
        .select("value", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_name").alias("file_name"))
    )
    return to_messages(parse_lines(lines), None).withColumn("substantial", is_substantial(F.col("text")))


def stream_rule_matches(messages: DataFrame, rules=RULES) -> DataFrame:
    """J1 on a stream: ``name, uuid`` per match (append mode, no state)."""
    names = F.array(*[F.lit(r[0]) for r in rules])
    return rule_matches(messages, rules).select(F.element_at(names, F.col("pos") + 1).alias("name"), "uuid")
