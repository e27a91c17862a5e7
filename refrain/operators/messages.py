"""Filters, projections and counters over canonical messages."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refrain.functions.text import is_substantial


def parse_lookback(last: str) -> int:
    """``"30d"`` or ``"30"`` -> 30 days; anything else is an error."""
    m = re.fullmatch(r"\s*(\d+)d?\s*", str(last))
    if not m:
        raise ValueError(f"cannot parse lookback {last!r}; use e.g. '30d'")
    return int(m.group(1))


def since_from(last: str, as_of: dt.datetime) -> dt.datetime:
    """the lookback start, relative to an explicit ``as_of`` (never now() inside a query)."""
    return as_of - dt.timedelta(days=parse_lookback(last))


def path_under(path_col: Column, project: str) -> Column:
    """``path`` equals ``project`` or lies under it by path component."""
    p = project.rstrip("/") or "/"
    if p == "/":
        return path_col.startswith("/")
    return (path_col == p) | path_col.startswith(p + "/")


def filter_project(messages: DataFrame, project: str | None, col: str = "project_path") -> DataFrame:
    if project is None:
        return messages
    return messages.filter(path_under(F.col(col), project))


def filter_since(messages: DataFrame, since: dt.datetime | None, col: str = "ts") -> DataFrame:
    """keep ``ts >= since``; rows without a valid timestamp pass."""
    if since is None:
        return messages
    return messages.filter(F.col(col).isNull() | (F.col(col) >= F.lit(since)))


def default_ts(messages: DataFrame, as_of: dt.datetime, col: str = "ts") -> DataFrame:
    """a missing timestamp becomes the scan time (applied after F6)."""
    return messages.withColumn(col, F.coalesce(F.col(col), F.lit(as_of).cast("timestamp")))


def substantial(messages: DataFrame) -> DataFrame:
    """messages worth clustering."""
    return messages.filter(is_substantial(F.col("text")))


def session_rollup(messages: DataFrame) -> DataFrame:
    """A1: messages per session, start/end by message order (not min/max of time)."""
    return messages.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n_messages"),
        F.min_by("ts", "ord").alias("start_time"),
        F.max_by("ts", "ord").alias("end_time"),
    )


def session_cwd(messages: DataFrame, col: str = "project_path") -> DataFrame:
    """A2: last working directory per session over human turns with text."""
    return messages.groupBy("session_id").agg(F.max_by(col, "ord").alias("session_cwd"))


def distinct_projects(messages: DataFrame, col: str = "project_path") -> DataFrame:
    """A3: unique project paths with the order they are first seen in."""
    return messages.groupBy(F.col(col).alias("project_path")).agg(F.min("ord").alias("first_ord"))


def scan_counters(messages: DataFrame) -> DataFrame:
    """A4: messages, substantial messages and distinct sessions in one aggregate."""
    return messages.agg(
        F.count(F.lit(1)).alias("n_messages"),
        F.count_if(is_substantial(F.col("text"))).alias("n_substantial"),
        F.count_distinct("session_id").alias("n_sessions"),
    )
