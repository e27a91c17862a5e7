"""Table adapters producing canonical ``messages`` rows.

Canonical message columns::

    uuid STRING, session_id STRING, project_path STRING, ts TIMESTAMP,
    text STRING, parent_uuid STRING, ord <orderable>

``ord`` replaces the reference's list position: every order-dependent rule
(representative ties, sample order, cluster discovery order) reads it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refrain.functions.text import strip_long

MESSAGE_COLUMNS = ["uuid", "session_id", "project_path", "ts", "text", "parent_uuid", "ord"]

# Fixed values of the synthetic mapping from `documents` to messages.
DOC_SESSIONS = 40
DOC_EPOCH = "2024-01-01 00:00:00"
DOC_STEP_MINUTES = 37
DOC_PROJECT_ROOT = "/home/dev/"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def messages_from_documents(docs: DataFrame) -> DataFrame:
    """`documents` -> messages: one project per source, 40 sessions, 37-minute steps."""
    text = strip_long("text")
    return docs.select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("uuid"),
        F.concat(F.lit("s"), F.pmod(F.col("doc_id"), F.lit(DOC_SESSIONS)).cast("string")).alias("session_id"),
        F.concat(F.lit(DOC_PROJECT_ROOT), F.col("source")).alias("project_path"),
        (F.to_timestamp(F.lit(DOC_EPOCH)) + F.make_dt_interval(mins=F.col("doc_id") * DOC_STEP_MINUTES)).alias("ts"),
        text.alias("text"),
        F.lit(None).cast("string").alias("parent_uuid"),
        F.col("doc_id").alias("ord"),
    ).filter(F.length("text") > 0)


def messages_from_conversations(conv: DataFrame) -> DataFrame:
    """`conversations` -> messages (F1 on `role`): no time or path, ord = (conv_id, turn)."""
    return (
        conv.filter(F.col("role") == "user")
        .select(
            F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string")).alias("uuid"),
            F.col("conv_id").cast("string").alias("session_id"),
            F.lit(None).cast("string").alias("project_path"),
            F.lit(None).cast("timestamp").alias("ts"),
            strip_long("text").alias("text"),
            F.lit(None).cast("string").alias("parent_uuid"),
            F.struct(F.col("conv_id").alias("conv_id"), F.col("turn").alias("turn")).alias("ord"),
        )
        .filter(F.length("text") > 0)
    )


def documents_scan_filter(project: str | None = None, since=None) -> Column | None:
    """F5/F6 restated on the raw ``documents`` columns, so the parquet reader can skip row groups.

    ``project_path`` and ``ts`` are derived (root + ``source``; epoch + ``doc_id`` steps),
    so Catalyst cannot push the canonical filters into the scan by itself. The
    predicate returned here keeps every row the canonical filter keeps; callers
    still apply the canonical filter (F5 ``path_under``, F6 ``filter_since``) on top.
    """
    conds = []
    if project is not None:
        p = project.rstrip("/") or "/"
        if p.startswith(DOC_PROJECT_ROOT):  # under the root: one source or its sub-paths
            s = p[len(DOC_PROJECT_ROOT):]
            conds.append((F.col("source") == s) | F.col("source").startswith(s + "/"))
        elif p == "/" or DOC_PROJECT_ROOT.startswith(p + "/"):  # an ancestor of the root: every source
            conds.append(F.col("source").isNotNull())
        else:  # no document path can equal or lie under it
            conds.append(F.lit(False))
    if since is not None:
        # ts >= since  <=>  doc_id >= ceil((since - epoch) / step); folded to a literal by Catalyst
        step_us = DOC_STEP_MINUTES * 60 * 1_000_000
        first = F.ceil((F.unix_micros(F.lit(since)) - F.unix_micros(F.to_timestamp(F.lit(DOC_EPOCH)))) / F.lit(step_us))
        conds.append(F.col("doc_id").isNull() | (F.col("doc_id") >= first))
    if not conds:
        return None
    out = conds[0]
    for c in conds[1:]:
        out = out & c
    return out


def documents_messages(spark: SparkSession, sf_dir: str, project: str | None = None, since=None) -> DataFrame:
    """Messages of ``documents``; ``project`` / ``since`` add a scan-level pre-filter (see above)."""
    docs = read_table(spark, sf_dir, "documents")
    pushed = documents_scan_filter(project, since)
    return messages_from_documents(docs if pushed is None else docs.filter(pushed))


def conversation_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages_from_conversations(read_table(spark, sf_dir, "conversations"))
