"""Assistant session logs (JSON lines) -> canonical messages.

Layout: ``<root>/<project-dir>/<session-id>.jsonl``. Only files exactly one
directory below the root are read (``subagents/`` files one level deeper are
not). Each line is parsed into a VARIANT; a malformed line is skipped, the
rest of its file kept.
"""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refrain.functions.text import strip
from refrain.operators.messages import filter_project, filter_since

LOG_GLOB = "*/*.jsonl"
# ISO-8601 date or date-time with optional fraction and zone ("Z" or +hh:mm).
ISO_TS = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?)?(Z|[+-]\d{2}(:?\d{2})?)?$"

RAW_SCHEMA = (
    "uuid string, session_id string, project_dir string, file_name string, cwd string, "
    "ts timestamp, text string, parent_uuid string, is_user boolean, is_sidechain boolean"
)
MESSAGE_SCHEMA = (
    "uuid string, session_id string, project_path string, ts timestamp, text string, parent_uuid string, "
    "ord struct<project_dir:string,file_name:string,block:bigint,line:bigint>"
)


def _get(v: Column, path: str, t: str) -> Column:
    return F.try_variant_get(v, path, t)


def extract_text(v: Column) -> Column:
    """string -> stripped; array -> stripped non-empty ``text`` blocks joined by a space; else ''.

    The type is read from the variant itself, so a string that merely starts
    with '[' stays a string.
    """
    content = F.try_variant_get(v, "$.message.content", "variant")
    kind = F.schema_of_variant(content)
    as_str = strip(_get(v, "$.message.content", "string"))
    blocks = _get(v, "$.message.content", "array<variant>")
    texts = F.transform(
        F.filter(blocks, lambda b: F.coalesce(_get(b, "$.type", "string") == "text", F.lit(False))),
        lambda b: strip(F.coalesce(_get(b, "$.text", "string"), F.lit(""))),
    )
    joined = strip(F.array_join(F.filter(texts, lambda t: F.length(t) > 0), " "))
    return (
        F.when(kind == "STRING", as_str)
        .when(kind.startswith("ARRAY"), joined)
        .otherwise(F.lit(""))
    )


def parse_timestamp(s: Column) -> Column:
    """F8: ISO-8601 (``Z`` or offset) -> UTC timestamp; empty or invalid -> null."""
    return F.when(s.rlike(ISO_TS), F.try_to_timestamp(s))


def _decoded(c: str) -> Column:
    """File names in ``_metadata`` are URL-encoded; a plus sign stands for itself there."""
    return F.try_url_decode(F.replace(F.col(c), F.lit("+"), F.lit("%2B")))


#: Why a line is rejected, in the order in which the reasons are looked for.
REASONS = ["blank", "not json", "not an object", "no message"]


def classified(lines: DataFrame) -> DataFrame:
    """``value, v, reason, session_id, project_dir, file_name`` and the place of every line; ``reason`` is null for a line that is read."""
    place = [c for c in ("block", "line") if c in lines.columns]
    parsed = lines.select(
        "value",
        F.try_parse_json(F.col("value")).alias("v"),
        F.regexp_replace(_decoded("file_name"), r"\.jsonl(\.gz)?$", "").alias("session_id"),
        F.regexp_extract(_decoded("file_path"), r"/([^/]+)/[^/]+$", 1).alias("project_dir"),
        _decoded("file_name").alias("file_name"),
        *place,
    )
    message = F.schema_of_variant(F.try_variant_get("v", "$.message", "variant"))
    reason = (
        F.when(F.length(strip(F.col("value"))) == 0, REASONS[0])
        .when(F.col("v").isNull(), REASONS[1])
        .when(~F.schema_of_variant("v").startswith("OBJECT"), REASONS[2])
        .when(~F.coalesce(message.startswith("OBJECT"), F.lit(False)), REASONS[3])
    )
    return parsed.withColumn("reason", reason)


def parse_lines(lines: DataFrame) -> DataFrame:
    """S2, S3, F1-F4, F8, F10 on ``value, file_path, file_name`` rows (batch or stream).

    ``block`` and ``line`` (place in the file), where the rows have them, are kept. S3: rejected lines are skipped.
    """
    return messages_of(classified(lines))


def messages_of(found: DataFrame) -> DataFrame:
    """The human turns among classified lines."""
    place = [c for c in ("block", "line") if c in found.columns]
    obj = found.filter(F.col("reason").isNull())
    rows = obj.select(
        F.coalesce(_get(F.col("v"), "$.uuid", "string"), F.lit("")).alias("uuid"),
        "session_id",
        "project_dir",
        "file_name",
        *place,
        F.coalesce(_get(F.col("v"), "$.cwd", "string"), F.lit(".")).alias("cwd"),
        parse_timestamp(_get(F.col("v"), "$.timestamp", "string")).alias("ts"),
        extract_text(F.col("v")).alias("text"),
        _get(F.col("v"), "$.parentUuid", "string").alias("parent_uuid"),
        (_get(F.col("v"), "$.type", "string") == "user").alias("is_user"),
        F.coalesce(_get(F.col("v"), "$.isSidechain", "boolean"), F.lit(False)).alias("is_sidechain"),
    )
    # F1, F2, F4
    return rows.filter(F.col("is_user") & ~F.col("is_sidechain") & (F.length("text") > 0))


def rejected_lines(lines: DataFrame) -> DataFrame:
    """S3: the lines that no message is read from, with their file, place and reason (blank lines aside)."""
    found = classified(lines).filter(F.col("reason").isNotNull() & (F.col("reason") != REASONS[0]))
    return found.select("project_dir", "file_name", *[c for c in ("block", "line") if c in found.columns], "reason", "value")


def line_report(lines: DataFrame) -> DataFrame:
    """Per file: its lines, those rejected by reason, and its human turns; one scan, one row per file."""
    found = classified(lines)
    turns = F.col("reason").isNull() & (_get(F.col("v"), "$.type", "string") == "user")
    turns &= ~F.coalesce(_get(F.col("v"), "$.isSidechain", "boolean"), F.lit(False)) & (F.length(extract_text(F.col("v"))) > 0)
    counts = [F.count_if(F.col("reason") == r).alias("n_" + r.replace(" ", "_")) for r in REASONS]
    return found.groupBy("project_dir", "file_name").agg(F.count(F.lit(1)).alias("n_lines"), *counts, F.count_if(turns).alias("n_messages"))


def file_report(spark: SparkSession, root: str, glob: str = LOG_GLOB) -> DataFrame:
    """``line_report`` of every session file with content, also of those that can't be read.

    ``unreadable`` marks a file of which no line came out (a broken archive, say). Files are listed without being opened.
    """
    schema = "project_dir string, file_name string, bytes bigint, n_lines bigint, " + ", ".join(f"n_{r.replace(' ', '_')} bigint" for r in REASONS) + ", n_messages bigint, unreadable boolean"
    lines = read_lines(spark, root, glob)
    if lines is None:
        return spark.createDataFrame([], schema)
    listed = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/{glob}").select(
        F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1).alias("project_dir"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"), F.col("length").alias("bytes")
    )
    report = line_report(lines)
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in report.columns[2:]]
    both = listed.join(report, ["project_dir", "file_name"], "left")
    return both.select("project_dir", "file_name", "bytes", *counts, F.col("n_lines").isNull().alias("unreadable"))


def read_lines(spark: SparkSession, root: str, glob: str = LOG_GLOB) -> DataFrame | None:
    """Raw lines with their file and place in it; ``None`` when the root has no session files.

    ``block`` is where the line's split of the file begins and ``line`` grows within a split, so together they
    order the lines of a file and are different for all lines of a scan.
    """
    reader = spark.read.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    try:
        lines = reader.text(f"{root.rstrip('/')}/{glob}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return lines.select(
        "value",
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )


def order_key(rows: DataFrame) -> Column:
    """File order; streams know no place in a file and use time and uuid instead."""
    last = ("block", "line") if "line" in rows.columns else ("ts", "uuid")
    return F.struct("project_dir", "file_name", *last)


def to_messages(rows: DataFrame, as_of: dt.datetime | None) -> DataFrame:
    """Canonical message columns; F9 fills a missing timestamp with the scan time."""
    ts = F.col("ts") if as_of is None else F.coalesce(F.col("ts"), F.lit(as_of).cast("timestamp"))
    return rows.select(
        "uuid",
        "session_id",
        F.col("cwd").alias("project_path"),
        ts.alias("ts"),
        "text",
        "parent_uuid",
        order_key(rows).alias("ord"),
    )


def read_session_logs(
    spark: SparkSession,
    root: str,
    project: str | None = None,
    since: dt.datetime | None = None,
    as_of: dt.datetime | None = None,
) -> DataFrame:
    """Messages from every session log under ``root`` (missing or empty root -> no rows).

    Project (F5) and lookback (F6) filters run before the timestamp default (F9).
    """
    lines = read_lines(spark, root)
    if lines is None:
        return spark.createDataFrame([], MESSAGE_SCHEMA)
    rows = filter_since(filter_project(parse_lines(lines), project, "cwd"), since)
    return to_messages(rows, as_of)


def session_table(
    spark: SparkSession,
    root: str,
    project: str | None = None,
    since: dt.datetime | None = None,
    as_of: dt.datetime | None = None,
) -> DataFrame:
    """A1/A2 for logs: per session the message count, first/last time and working dir.

    Count and times are those of the messages that pass the project and lookback filters, with missing times
    filled (F9); the working dir is the last ``cwd`` over all human turns with text, as in the original.
    """
    lines = read_lines(spark, root)
    if lines is None:
        return spark.createDataFrame([], "session_id string, project_dir string, n_messages bigint, start_time timestamp, end_time timestamp, session_cwd string")
    rows = parse_lines(lines)
    rows = rows.withColumn("ord", order_key(rows))
    kept = filter_since(filter_project(rows, project, "cwd"), since)
    ts = F.col("ts") if as_of is None else F.coalesce(F.col("ts"), F.lit(as_of).cast("timestamp"))
    counted = kept.groupBy("session_id", "project_dir").agg(
        F.count(F.lit(1)).alias("n_messages"), F.min_by(ts, "ord").alias("start_time"), F.max_by(ts, "ord").alias("end_time")
    )
    return counted.join(rows.groupBy("session_id", "project_dir").agg(F.max_by("cwd", "ord").alias("session_cwd")), ["session_id", "project_dir"])
