"""The scan pipeline: messages -> substantial -> vectors -> DBSCAN -> patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refrain.operators import classify as C
from refrain.operators import neighbours as N
from refrain.operators import patterns as P
from refrain.operators.messages import substantial
from refrain.operators.vectors import idf_of, spread_by_doc, tfidf_counts, weighed
from refrain.session import staged

PATTERN_COLUMNS = [
    "id", "pattern_key", "label", "category", "size", "representative_text", "sample_texts",
    "dates", "first_seen", "last_seen", "wasted_input_tokens", "wasted_output_tokens",
]


def cluster_messages(corpus: DataFrame, similarity: float = 0.75, min_samples: int = 3, block: int = N.DEFAULT_BLOCK, vectors: DataFrame | None = None):
    """TF-IDF (or given vectors) + exact DBSCAN.

    ``corpus``: messages with a unique ``ord``. ``vectors`` (optional):
    ``doc, idx, val`` keyed by ``ord`` (C4, e.g. a model's embeddings).
    Returns ``(members, clustered_points)``; members are messages with ``cluster, pid``.
    """
    corpus, placed, clustered = place_messages(corpus, similarity, min_samples, block, vectors)
    return corpus.join(placed, "ord"), clustered


def place_messages(corpus: DataFrame, similarity: float, min_samples: int, block: int, vectors: DataFrame | None):
    """``(corpus, placed, clustered_points)``: the messages as written, and the narrow ``ord, pid, cluster`` of those in a cluster."""
    # read twice (tokens, then member texts): write it once instead of re-reading the source
    corpus = staged(corpus, "corpus")
    if not corpus.groupBy("ord").count().filter("count > 1").isEmpty():
        raise ValueError("messages need a unique ord: equal ones would be taken for one document")
    if vectors is None:  # tfidf_vectors returns written vectors
        counts, vocab = tfidf_counts(corpus.select(F.col("ord").alias("doc"), "text"), spread=False)
        idf = idf_of(vocab)
        points, membership = N.collapse_counts(counts, None)
    else:  # reused by the collapse, the membership map and the centroids: cut lineage once
        vectors, idf = staged(vectors, "vectors"), None
        vectors = vectors.select("doc", "idx", *(["tf"] if "tf" in vectors.columns else []), "val")
        points, membership = N.collapse(vectors, vectors.select("doc", F.col("doc").alias("ord")))
        points = staged(points, "points")
    labelled = staged(N.dbscan(points, similarity, min_samples, block, idf=idf, written=True), "labelled")
    # of the vectors made here only counts are written and moved; their weights come from them where they are read
    clustered = staged(points.join(labelled.select("pid", "cluster"), "pid"), "clustered")
    clustered = (clustered if idf is None else weighed(clustered, idf)).select("pid", "mult", "idx", "val", "cluster")
    placed = membership.withColumnRenamed("doc", "ord").join(labelled.select("pid", "cluster"), "pid")
    return corpus, placed, clustered


def find_patterns(
    corpus: DataFrame,
    similarity: float = 0.75,
    min_samples: int = 3,
    classify: bool = True,
    keywords: DataFrame | None = None,
    block: int = N.DEFAULT_BLOCK,
    vectors: DataFrame | None = None,
    method: str = "keyword",
    exemplars: DataFrame | None = None,
    one_offs: bool = False,
) -> DataFrame:
    """Substantial messages -> ``patterns`` (one row per cluster, ranked ``pat-NNN``).

    With ``classify`` the local classifier sets ``category`` and one-off
    clusters are dropped (their IDs stay unused) unless ``one_offs``; without it categories are null.
    C12: ``method="keyword"`` counts keywords in the representative text;
    ``method="centroid"`` compares the representative's vector with the
    category centroids of ``exemplars`` (``priority, category, idx, val``, same
    vector space as ``vectors``).
    """
    corpus, placed, clustered = place_messages(corpus, similarity, min_samples, block, vectors)
    cents = P.centroids(clustered)
    dists = P.centroid_distances(clustered, cents).checkpoint(eager=True)  # one narrow row per point, read three times
    members = P.narrowed(corpus.select("ord", "uuid", "ts", "text")).join(placed, "ord")  # no text moves with them
    summary = staged(P.summarise(members, dists, corpus.select("ord", "text")), "summary")
    summary = P.rank_patterns(summary)
    drop = (lambda s: s) if one_offs else C.drop_one_offs
    summary = summary.withColumn("label", P.infer_label(F.col("representative_text")))
    if classify and method == "centroid":
        if exemplars is None:
            raise ValueError("method='centroid' needs exemplar vectors")
        rep_vec = clustered.select(F.col("pid").alias("rep_pid"), "idx", "val")
        items = summary.select("cluster", "rep_pid").join(rep_vec, "rep_pid").select("cluster", "idx", "val")
        cats = C.classify_by_centroid(items, "cluster", C.category_centroids(exemplars)).select("cluster", "category")
        summary = drop(summary.join(cats, "cluster", "left").withColumn(
            "category", F.coalesce("category", F.lit(C.ONE_OFF))))
    elif classify:
        kw = keywords if keywords is not None else C.keyword_table(corpus.sparkSession)
        summary = drop(C.classify_by_keywords(summary, "cluster", "representative_text", kw))
    else:
        summary = summary.withColumn("category", F.lit(None).cast("string"))
    w_in, w_out = P.wasted_tokens(F.col("size"), F.col("avg_chars"), F.col("category"))
    return summary.select(
        *[c for c in PATTERN_COLUMNS if c not in ("wasted_input_tokens", "wasted_output_tokens")],
        w_in.alias("wasted_input_tokens"),
        w_out.alias("wasted_output_tokens"),
    )


def scan(messages: DataFrame, similarity: float = 0.75, min_samples: int = 3, classify: bool = True, **kw) -> DataFrame:
    """Entry 1 of the reference: F11 then clustering and summaries.

    The messages are hash-partitioned by ``ord`` once, before the filter, so
    the per-message steps run on every core and tf needs no other exchange.
    """
    return find_patterns(substantial(spread_by_doc(messages, "ord")), similarity, min_samples, classify, **kw)
