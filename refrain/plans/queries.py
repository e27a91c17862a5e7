"""Registry: one Spark query and one DuckDB oracle per operator of the inventory.

Keys are ``<inventory row>_<name>``. Every query reads the given tables (or
data Spark derives from them) in full; small constant tables (rules,
keywords, catalogues, curated rows) are joined to them, never used alone.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refrain.operators import cells as metric
from refrain.operators import messages as M
from refrain.operators import neighbours as N
from refrain.operators import vectors as V
from refrain.operators.embed import embed
from refrain.plans import oracle as O
from refrain.plans.scan import find_patterns
from refrain.session import ensure_checkpoint_dir, staged
from refrain.sources.results import load_latest_scan, save_scan
from refrain.sources.tables import conversation_messages, documents_messages, read_table

AS_OF = dt.datetime(2024, 2, 10)  # fixed scan time for the registered queries
SIMILARITY = 0.75
MIN_SAMPLES = 3

QUERIES: dict = {}
ORACLE: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def doc_corpus(spark: SparkSession, sf: str) -> DataFrame:
    return M.substantial(V.spread_if_uneven(documents_messages(spark, sf), read_table(spark, sf, "documents"), "ord"))


DOC_CORPUS_SQL = O.substantial_corpus(O.documents_messages())


# ---------------------------------------------------------------- 2.1 / 2.2 messages
@register("s5_documents_messages", f"SELECT uuid, session_id, project_path, ts, text, ord FROM ({O.documents_messages()})")
def s5_documents_messages(spark, sf):
    return documents_messages(spark, sf).select("uuid", "session_id", "project_path", "ts", "text", "ord")


@register("f1_conversation_user_turns", f"SELECT uuid, session_id, text, ord.conv_id AS conv_id, ord.turn AS turn FROM ({O.conversation_messages()})")
def f1_conversation_user_turns(spark, sf):
    return conversation_messages(spark, sf).select("uuid", "session_id", "text", F.col("ord.conv_id").alias("conv_id"), F.col("ord.turn").alias("turn"))


@register("f5_project_filter", f"SELECT uuid FROM ({O.documents_messages()}) WHERE project_path = '/home/dev/src1' OR starts_with(project_path, '/home/dev/src1/')")
def f5_project_filter(spark, sf):
    return M.filter_project(documents_messages(spark, sf, project="/home/dev/src1/"), "/home/dev/src1/").select("uuid")


_SINCE = M.since_from("30d", AS_OF)


@register(
    "f6_lookback_filter",
    f"SELECT uuid, ts FROM ({O.documents_messages()}) WHERE ts IS NULL OR ts >= TIMESTAMP '{_SINCE:%Y-%m-%d %H:%M:%S}'",
)
def f6_lookback_filter(spark, sf):
    return M.filter_since(documents_messages(spark, sf, since=_SINCE), _SINCE).select("uuid", "ts")


@register(
    "f6_event_lookback",
    "SELECT event_id, ts FROM events WHERE ts IS NULL OR ts >= TIMESTAMP '2024-01-16 00:00:00'",
)
def f6_event_lookback(spark, sf):
    ev = read_table(spark, sf, "events")
    return M.filter_since(ev, M.since_from("15", dt.datetime(2024, 1, 31))).select("event_id", "ts")


@register(
    "f9_default_timestamp",
    f"""SELECT uuid, coalesce(ts, TIMESTAMP '2024-02-10 00:00:00') AS ts FROM (
        SELECT uuid, ts FROM ({O.conversation_messages()}) UNION ALL SELECT uuid, ts FROM ({O.documents_messages()}))""",
)
def f9_default_timestamp(spark, sf):
    """Conversations have no times, documents do."""
    both = conversation_messages(spark, sf).select("uuid", "ts").unionByName(documents_messages(spark, sf).select("uuid", "ts"))
    return M.default_ts(both, AS_OF).select("uuid", "ts")


@register("f11_substantial_messages", f"SELECT uuid, length(text) AS n_chars FROM ({DOC_CORPUS_SQL})")
def f11_substantial_messages(spark, sf):
    return M.substantial(documents_messages(spark, sf)).select("uuid", F.length("text").alias("n_chars"))


@register(
    "f11_substantial_conversations",
    f"SELECT uuid FROM ({O.substantial_corpus(O.conversation_messages())})",
)
def f11_substantial_conversations(spark, sf):
    return M.substantial(conversation_messages(spark, sf)).select("uuid")


@register(
    "a1_session_rollup",
    f"""SELECT session_id, count(*) AS n_messages, arg_min(ts, ord) AS start_time, arg_max(ts, ord) AS end_time
        FROM ({O.documents_messages()}) GROUP BY session_id""",
)
def a1_session_rollup(spark, sf):
    return M.session_rollup(documents_messages(spark, sf))


@register(
    "a2_session_cwd",
    f"SELECT session_id, arg_max(project_path, ord) AS session_cwd FROM ({O.documents_messages()}) GROUP BY session_id",
)
def a2_session_cwd(spark, sf):
    return M.session_cwd(documents_messages(spark, sf))


@register(
    "a3_distinct_projects",
    f"SELECT project_path, min(ord) AS first_ord FROM ({O.documents_messages()}) GROUP BY project_path",
)
def a3_distinct_projects(spark, sf):
    return M.distinct_projects(documents_messages(spark, sf))


@register(
    "a4_scan_counters",
    f"""SELECT count(*) AS n_messages, count(*) FILTER (WHERE {O.substantial('text')}) AS n_substantial,
               count(DISTINCT session_id) AS n_sessions FROM ({O.conversation_messages()})""",
)
def a4_scan_counters(spark, sf):
    return M.scan_counters(conversation_messages(spark, sf))


# ---------------------------------------------------------------- 2.6 vectors
_TFIDF = O.tfidf_ctes("corpus")
_VOCAB = O.vocabulary_ctes("corpus")


def _doc_texts(spark, sf):
    return doc_corpus(spark, sf).select(F.col("ord").alias("doc"), "text")


@register("w2_vocabulary", f"WITH corpus AS ({DOC_CORPUS_SQL}), {_VOCAB} SELECT term, cf, df, idx, round(idf, 6) AS idf FROM vocab")
def w2_vocabulary(spark, sf):
    _, vocab = V.tfidf_vectors(_doc_texts(spark, sf), spread=False)
    return vocab.select("term", "cf", "df", "idx", F.round("idf", 6).alias("idf"))


@register("c3_tfidf_weights", f"WITH corpus AS ({DOC_CORPUS_SQL}), {_TFIDF} SELECT doc, idx, tf, round(val, 6) AS val FROM vec")
def c3_tfidf_weights(spark, sf):
    vecs, _ = V.tfidf_vectors(_doc_texts(spark, sf), spread=False)
    e = vecs.select("doc", F.explode(F.arrays_zip("idx", "tf", "val")).alias("e"))
    return e.select("doc", F.col("e.idx").alias("idx"), F.col("e.tf").alias("tf"), F.round("e.val", 6).alias("val"))


@register("c3_zero_vectors", f"WITH corpus AS ({DOC_CORPUS_SQL}), {_TFIDF} SELECT doc FROM vkey WHERE key = ''")
def c3_zero_vectors(spark, sf):
    vecs, _ = V.tfidf_vectors(_doc_texts(spark, sf), spread=False)
    return vecs.filter(F.size("idx") == 0).select("doc")


# ---------------------------------------------------------------- J3, A15, C5-C8
def _doc_points(spark, sf):
    """Points, as a written table, and the weights of their terms."""
    counts, vocab = V.tfidf_counts(_doc_texts(spark, sf), spread=False)
    return N.collapse_counts(counts, counts.select("doc", F.col("doc").alias("ord")))[0], V.idf_of(vocab)


_DB = O.dbscan_ctes(SIMILARITY, MIN_SAMPLES)


@register("a15_neighbour_counts", f"WITH corpus AS ({DOC_CORPUS_SQL}), {_TFIDF}, {_DB} SELECT pid, n AS n_neighbours FROM cnt")
def a15_neighbour_counts(spark, sf):
    points, idf = _doc_points(spark, sf)
    n_points, width = N.mean_width(points)
    nb = N.pair_blocks(points, n_points, N.DEFAULT_BLOCK, width)
    return N.neighbour_weights(points, SIMILARITY, nb, idf)


@register("j3_neighbour_pairs", f"WITH corpus AS ({DOC_CORPUS_SQL}), {_TFIDF}, {_DB} SELECT count(*) AS n_pairs FROM adj")
def j3_neighbour_pairs(spark, sf):
    """Ordered neighbour pairs between distinct points (the epsilon join's size)."""
    points, idf = _doc_points(spark, sf)
    n_points, width = N.mean_width(points)
    nb = N.pair_blocks(points, n_points, N.DEFAULT_BLOCK, width)
    w = N.neighbour_weights(points.withColumn("mult", F.lit(1).cast("bigint")), SIMILARITY, nb, idf)
    return w.agg(F.sum(F.col("n_neighbours") - 1).alias("n_pairs"))


@register("c7_cluster_labels", f"WITH corpus AS ({DOC_CORPUS_SQL}), {_TFIDF}, {_DB} SELECT pid, cluster, pid IN (SELECT pid FROM cores) AS core FROM lab")
def c7_cluster_labels(spark, sf):
    points, idf = _doc_points(spark, sf)
    return N.dbscan(points, SIMILARITY, MIN_SAMPLES, idf=idf, written=True)


@register(
    "c7_contested_borders",
    f"WITH corpus AS ({DOC_CORPUS_SQL}), {_TFIDF}, {O.dbscan_ctes(SIMILARITY, 5)} SELECT pid, cluster, pid IN (SELECT pid FROM cores) AS core FROM lab",
)
def c7_contested_borders(spark, sf):
    """From four members on, a border point can lie between clusters; it joins the one that is discovered first."""
    points, idf = _doc_points(spark, sf)
    return N.dbscan(points, SIMILARITY, 5, idf=idf, written=True)


# ---------------------------------------------------------------- patterns
def iso_dates(patterns: DataFrame) -> DataFrame:
    """The dates as text."""
    return patterns.withColumn("dates", F.transform("dates", lambda d: F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss")))


def iso_dates_sql(sql: str) -> str:
    return f"SELECT * REPLACE (list_transform(dates, lambda d: strftime(d, '%Y-%m-%dT%H:%M:%S')) AS dates) FROM ({sql})"


@register("c8_patterns_unclassified", iso_dates_sql(O.patterns_sql(DOC_CORPUS_SQL, SIMILARITY, MIN_SAMPLES)))
def c8_patterns_unclassified(spark, sf):
    return iso_dates(find_patterns(doc_corpus(spark, sf), SIMILARITY, MIN_SAMPLES, classify=False))


# ---------------------------------------------------------------- rules
from refrain.operators import classify as C  # noqa: E402
from refrain.operators import rules as R  # noqa: E402
from refrain.sources.curated import curated_messages, curated_sql  # noqa: E402


def all_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Documents, user turns and curated rows as (uuid, text); what follows is per row, so nothing is shuffled."""
    return (
        documents_messages(spark, sf).select("uuid", "text")
        .unionByName(conversation_messages(spark, sf).select("uuid", "text"))
        .unionByName(curated_messages(spark).select("uuid", "text"))
    )


ALL_MESSAGES_SQL = f"""
    SELECT uuid, text FROM ({O.documents_messages()})
    UNION ALL SELECT uuid, text FROM ({O.conversation_messages()})
    UNION ALL SELECT uuid, text FROM ({curated_sql()})"""


@register(
    "j1_rule_matches",
    f"SELECT r.name, m.uuid FROM ({ALL_MESSAGES_SQL}) m JOIN ({O.rules_values()}) r ON regexp_matches(m.text, r.regex)",
)
def j1_rule_matches(spark, sf):
    rt = R.rules_table(spark)
    return R.rule_matches(all_messages(spark, sf)).join(F.broadcast(rt.select("pos", "name")), "pos").select("name", "uuid")


@register(
    "a5_rule_counts",
    f"""SELECT name, description, suggestion, n_matches, row_number() OVER (ORDER BY n_matches DESC, pos) AS rank FROM (
        SELECT r.pos, r.name, r.description, r.suggestion, count(*) AS n_matches
        FROM ({ALL_MESSAGES_SQL}) m JOIN ({O.rules_values()}) r ON regexp_matches(m.text, r.regex)
        GROUP BY ALL HAVING count(*) >= {R.MIN_MATCHES})""",
)
def a5_rule_counts(spark, sf):
    return R.rule_counts(all_messages(spark, sf))


# ---------------------------------------------------------------- rules and keywords as large tables
from refrain.functions.contains import contains_join  # noqa: E402
from refrain.operators import rules_index as RI  # noqa: E402


def benchmark_words(spark: SparkSession, sf: str) -> DataFrame:
    """``item_id, at, word``: the lower-case ASCII words of every benchmark item, in order."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    return read_table(spark, sf, "benchmark").select("item_id", F.posexplode(words).alias("at", "word"))


BENCHMARK_WORDS_SQL = """
    SELECT item_id, unnest(range(0, len(w))) AS at, unnest(w) AS word
    FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark)"""


RULE_WORD = 4  # shorter words make no rule


def derived_rules(spark: SparkSession, sf: str) -> DataFrame:
    """The five fixed rules, and one per pair of neighbouring benchmark words, in three forms by the length of the first."""
    w = benchmark_words(spark, sf)
    pairs = w.join(w.select("item_id", (F.col("at") - 1).alias("at"), F.col("word").alias("next")), ["item_id", "at"]).select("word", "next").distinct()
    pairs = pairs.filter((F.length("word") >= RULE_WORD) & (F.length("next") >= RULE_WORD))
    made = pairs.select(
        F.concat_ws(" ", "word", "next").alias("name"),
        F.when(F.length("word") % 3 == 0, F.concat(F.lit("(?i)"), "word", F.lit(r"\s+"), "next"))
        .when(F.length("word") % 3 == 1, F.concat(F.lit("(?i)[ (]("), "word", F.lit("|"), "next", F.lit("ing) [a-z]{5,6} ?"), F.substring("next", 1, 2)))
        .otherwise(F.concat("word", F.lit(r"[,.]? (x{0}|the )"), "next")).alias("regex"),
    )
    return R.rules_table(spark).select("name", "regex").unionByName(made)


# ``needle`` and ``other``: a text without both has no match, which spares the twin most of its regex calls
DERIVED_RULES_SQL = rf"""
    SELECT name, regex, '' AS needle, '' AS other FROM ({O.rules_values()}) UNION ALL
    SELECT word || ' ' || next, CASE length(word) % 3 WHEN 0 THEN '(?i)' || word || '\s+' || next
        WHEN 1 THEN '(?i)[ (](' || word || '|' || next || 'ing) [a-z]{{5,6}} ?' || left(next, 2)
        ELSE word || '[,.]? (x{{0}}|the )' || next END, word, CASE length(word) % 3 WHEN 1 THEN next || 'ing' ELSE word END
    FROM (SELECT DISTINCT a.word, b.word AS next FROM ({BENCHMARK_WORDS_SQL}) a JOIN ({BENCHMARK_WORDS_SQL}) b ON a.item_id = b.item_id AND b.at = a.at + 1)
    WHERE length(word) >= {RULE_WORD} AND length(next) >= {RULE_WORD}"""


@register(
    "j1_rules_as_table",
    f"""SELECT r.name, count(*) AS n_matches, min(m.uuid) AS first_uuid
        FROM (SELECT *, lower(text) AS low FROM ({ALL_MESSAGES_SQL})) m JOIN ({DERIVED_RULES_SQL}) r
        ON (contains(m.low, r.needle) OR contains(m.low, r.other)) AND regexp_matches(m.text, r.regex) GROUP BY r.name""",
)
def j1_rules_as_table(spark, sf):
    """Rules made from a table, found through their required strings."""
    messages = V.spread_if_uneven(all_messages(spark, sf), read_table(spark, sf, "documents"), "uuid")
    hits = RI.rule_hits(messages, derived_rules(spark, sf), rule="name")
    return hits.groupBy("name").agg(F.count(F.lit(1)).alias("n_matches"), F.min("uuid").alias("first_uuid"))


@register(
    "j2_keyword_automaton",
    f"""SELECT k.word, count(*) AS n_texts, min(m.ord) AS first_ord
        FROM (SELECT ord, lower(text) AS t FROM ({O.documents_messages()})) m JOIN (SELECT DISTINCT word FROM ({BENCHMARK_WORDS_SQL})) k ON contains(m.t, k.word)
        GROUP BY k.word""",
)
def j2_keyword_automaton(spark, sf):
    """Which benchmark words occur in which documents, read once through an automaton."""
    texts = documents_messages(spark, sf).select("ord", F.lower("text").alias("t"))
    hits = contains_join(texts, "t", benchmark_words(spark, sf).select("word").distinct(), "word", nested=0)
    return hits.groupBy("word").agg(F.count(F.lit(1)).alias("n_texts"), F.min("ord").alias("first_ord"))


# ---------------------------------------------------------------- classification
DOCS_AND_CURATED_SQL = f"SELECT * FROM ({O.documents_messages()}) UNION ALL SELECT * FROM ({curated_sql()})"


def docs_and_curated(spark: SparkSession, sf: str) -> DataFrame:
    both = documents_messages(spark, sf).unionByName(curated_messages(spark))
    return V.spread_if_uneven(both, read_table(spark, sf, "documents"), "ord")


@register("c10_keyword_categories", O.keyword_category(f"({DOCS_AND_CURATED_SQL})", "uuid", "text"))
def c10_keyword_categories(spark, sf):
    m = documents_messages(spark, sf).unionByName(curated_messages(spark)).select("uuid", "text")
    return C.classify_by_keywords(m, "uuid", "text", C.keyword_table(spark)).select("uuid", "category")


_CLASSIFY_SUMM = f"summ2 AS (SELECT s.*, kc.category FROM summ s JOIN ({O.keyword_category('summ', 'cluster', 'representative_text')}) kc USING (cluster))"


@register("f13_patterns_classified", iso_dates_sql(O.patterns_sql(O.substantial_corpus(DOCS_AND_CURATED_SQL), SIMILARITY, MIN_SAMPLES, _CLASSIFY_SUMM)))
def f13_patterns_classified(spark, sf):
    corpus = M.substantial(docs_and_curated(spark, sf))
    return iso_dates(find_patterns(corpus, SIMILARITY, MIN_SAMPLES, classify=True))


# ---------------------------------------------------------------- dense vectors
DENSE_SIMILARITY = 0.35
_EMB_DB = O.dense_point_ctes("embeddings", "vec_id", "embedding")


def _embedding_vectors(spark, sf):
    emb = V.normalise_dense(read_table(spark, sf, "embeddings"), "embedding")
    return V.dense_vectors(emb, "vec_id", "embedding"), emb


@register(
    "c4_dense_dbscan_labels",
    f"WITH {_EMB_DB}, {O.dbscan_ctes(DENSE_SIMILARITY, MIN_SAMPLES)} SELECT pid, cluster, pid IN (SELECT pid FROM cores) AS core FROM lab",
)
def c4_dense_dbscan_labels(spark, sf):
    vecs, _ = _embedding_vectors(spark, sf)
    points, _ = N.collapse(vecs, vecs.select("doc", F.col("doc").alias("ord")))
    return N.dbscan(points, DENSE_SIMILARITY, MIN_SAMPLES)


CLOSE_SIMILARITY = 0.95


@register(
    "j3_metric_cells",
    f"""WITH {_EMB_DB}, {O.dbscan_ctes(CLOSE_SIMILARITY, 2)}
    SELECT cnt.pid, cnt.n AS n_neighbours, lab.cluster FROM cnt LEFT JOIN lab USING (pid)""",
)
def j3_metric_cells(spark, sf):
    """Neighbour counts and clusters of close vectors, by metric partitioning."""
    vecs, _ = _embedding_vectors(spark, sf)
    points, _ = N.collapse(vecs, vecs.select("doc", F.col("doc").alias("ord")))
    points = staged(points, "points")
    rows, sizes = metric.partition(points, CLOSE_SIMILARITY, points.count(), N.DEFAULT_BLOCK, force=True)
    hits = staged(metric.cell_hits(rows, sizes, CLOSE_SIMILARITY), "hits")  # the points move once for the counts and for the clusters' cores
    found = N.dbscan(points, CLOSE_SIMILARITY, 2, cells=True, written=True, parted=(rows, sizes, hits)).select("pid", "cluster")
    return metric.cell_weights(rows, sizes, CLOSE_SIMILARITY, hits=hits).join(found, "pid", "left")


LETTERS = "abcdefghijklmnopqrstuvwxyz"
LETTER_SIMILARITY = 0.995


def letter_model():
    """A stand-in for a model, as a caller would supply it: how often each letter occurs."""
    import numpy as np

    return lambda texts: np.array([[t.lower().count(c) for c in LETTERS] for t in texts], float)


_LETTER_POINTS = O.dense_point_ctes(
    "(SELECT ord, list_transform(string_split('" + ",".join(LETTERS) + "', ','), lambda c: length(lower(text)) - length(replace(lower(text), c, ''))) AS v FROM corpus)", "ord", "v"
) + ", vec AS (SELECT doc, unnest(range(0, len(v))) AS idx, unnest(v) AS val FROM unit)"


@register("p3_model_patterns", iso_dates_sql(O.patterns_sql(DOC_CORPUS_SQL, LETTER_SIMILARITY, MIN_SAMPLES, points=_LETTER_POINTS)))
def p3_model_patterns(spark, sf):
    """Patterns over vectors of a model that the caller supplies."""
    corpus = doc_corpus(spark, sf)
    vectors = embed(corpus, "ord", "text", letter_model, len(LETTERS))
    return iso_dates(find_patterns(corpus, LETTER_SIMILARITY, MIN_SAMPLES, classify=False, vectors=vectors))


# the representative's vector against the mean vector of each language's documents
_LANGUAGE_SUMM = f"""
    ex AS (SELECT d.lang, v.doc, v.idx, v.val FROM vec v JOIN documents d ON d.doc_id = v.doc WHERE d.lang IS NOT NULL),
    lang_n AS (SELECT lang, count(DISTINCT doc) AS n FROM ex GROUP BY lang),
    lang_mean AS (SELECT ex.lang, idx, sum(val) / any_value(lang_n.n) AS m FROM ex JOIN lang_n USING (lang) GROUP BY ALL),
    lang_norm AS (SELECT lang, sqrt(sum(m * m)) AS norm FROM lang_mean GROUP BY lang),
    rep_sims AS (SELECT r.cluster, m.lang, sum(v.val * m.m / n.norm) AS sim FROM ranked r JOIN pvec v ON v.pid = r.pid
                 JOIN lang_mean m ON m.idx = v.idx JOIN lang_norm n ON n.lang = m.lang WHERE r.rr = 1 AND n.norm > 0 GROUP BY ALL),
    rep_best AS (SELECT cluster, arg_max(lang, sim) AS lang, max(sim) AS sim FROM rep_sims WHERE sim > 0 GROUP BY cluster),
    summ2 AS (SELECT s.*, CASE WHEN b.sim >= {{least}} THEN b.lang ELSE 'one-off-task' END AS category FROM summ s LEFT JOIN rep_best b USING (cluster))"""


@register("c12_centroid_patterns", iso_dates_sql(O.patterns_sql(DOC_CORPUS_SQL, LETTER_SIMILARITY, MIN_SAMPLES, _LANGUAGE_SUMM.format(least=C.MIN_CONFIDENCE), points=_LETTER_POINTS)))
def c12_centroid_patterns(spark, sf):
    """Patterns whose category is the nearest centroid of exemplars (here: the documents of each language)."""
    corpus = doc_corpus(spark, sf)
    vectors = staged(embed(corpus, "ord", "text", letter_model, len(LETTERS)), "vectors")
    languages = read_table(spark, sf, "documents").filter("lang is not null").select(F.col("doc_id").alias("doc"), F.col("lang").alias("category"))
    exemplars = vectors.join(languages, "doc").select(F.lit(0).alias("priority"), "category", "idx", "val")
    return iso_dates(find_patterns(corpus, LETTER_SIMILARITY, MIN_SAMPLES, vectors=vectors, method="centroid", exemplars=exemplars))


@register("s10_latest_scan", iso_dates_sql(f"SELECT 'second' AS scan_id, * FROM ({O.patterns_sql(DOC_CORPUS_SQL, LETTER_SIMILARITY, MIN_SAMPLES, points=_LETTER_POINTS)})"))
def s10_latest_scan(spark, sf):
    """Two scans saved, the newer one read back."""
    folder = f"{ensure_checkpoint_dir(spark)}/scans-{uuid.uuid4().hex}"
    corpus = doc_corpus(spark, sf)
    found = find_patterns(corpus, LETTER_SIMILARITY, MIN_SAMPLES, classify=False, vectors=embed(corpus, "ord", "text", letter_model, len(LETTERS)))
    found = staged(found, "patterns")
    save_scan(found, folder, "second", AS_OF)
    save_scan(found.withColumn("size", F.col("size") + 1), folder, "first", AS_OF - dt.timedelta(days=1))
    return iso_dates(load_latest_scan(spark, folder).drop("saved_at"))


@register(
    "c11_centroid_classifier",
    f"""WITH {_EMB_DB},
    ex AS (SELECT p.pid, e.label AS priority, 'label_' || e.label AS category, p.idx, p.val
           FROM pvec p JOIN embeddings e ON e.vec_id = p.pid),
    n AS (SELECT category, count(DISTINCT pid) AS n FROM ex GROUP BY category),
    mean AS (SELECT ex.priority, ex.category, idx, sum(val) / any_value(n.n) AS m FROM ex JOIN n USING (category) GROUP BY ALL),
    nrm AS (SELECT category, sqrt(sum(m * m)) AS norm FROM mean GROUP BY category),
    cent AS (SELECT priority, category, idx, CASE WHEN norm > 0 THEN m / norm ELSE m END AS c FROM mean JOIN nrm USING (category)),
    item AS (SELECT k.doc AS vec_id, u.idx, u.val FROM vkey k JOIN (
        SELECT doc, unnest(range(0, len(v))) AS idx, unnest(v) AS val FROM unit) u USING (doc)),
    sims AS (SELECT vec_id, priority, category, round(sum(val * c), 9) AS sim FROM item JOIN cent USING (idx) GROUP BY ALL),
    best AS (SELECT vec_id, arg_max(category, sim) AS cat, max(sim) AS s FROM sims WHERE sim > 0 GROUP BY vec_id)
    SELECT r.doc AS vec_id, CASE WHEN b.s >= {C.MIN_CONFIDENCE} THEN b.cat ELSE 'one-off-task' END AS category
    FROM raw r LEFT JOIN best b ON b.vec_id = r.doc""",
)
def c11_centroid_classifier(spark, sf):
    vecs, emb = _embedding_vectors(spark, sf)
    labels = emb.select(F.col("vec_id").alias("doc"), "label")
    ex = vecs.join(labels, "doc").select(
        F.col("label").alias("priority"), F.concat(F.lit("label_"), F.col("label").cast("string")).alias("category"), "idx", "val"
    )
    cents = C.category_centroids(ex)
    return C.classify_by_centroid(vecs.select(F.col("doc").alias("vec_id"), "idx", "val"), "vec_id", cents).select("vec_id", "category")


@register(
    "a14_category_counts",
    f"""SELECT category, count(*) AS n_patterns FROM (
        {O.patterns_sql(O.substantial_corpus(DOCS_AND_CURATED_SQL), SIMILARITY, MIN_SAMPLES, _CLASSIFY_SUMM, one_offs=True)}) GROUP BY category""",
)
def a14_category_counts(spark, sf):
    """Patterns by category, before one-offs are removed."""
    corpus = M.substantial(docs_and_curated(spark, sf))
    return C.category_counts(find_patterns(corpus, SIMILARITY, MIN_SAMPLES, classify=True, one_offs=True))


# ---------------------------------------------------------------- catalogues
from refrain.operators import catalog as K  # noqa: E402
from refrain.sources import catalogs as CS  # noqa: E402

_TOOL_CAT, _TOOL_KW = O.catalog_values(CS.TOOL_CATALOG, True)
_SKILL_CAT, _SKILL_KW = O.catalog_values(CS.SKILL_CATALOG, False)


def _lower_texts(spark, sf):
    return all_messages(spark, sf).select(F.lower("text").alias("text"))


@register(
    "a11_tool_matches",
    f"""WITH {O.catalog_hits(ALL_MESSAGES_SQL, _TOOL_KW)},
    best AS (SELECT h.*, c.name, c.install FROM hits h JOIN ({_TOOL_CAT}) c USING (id, pos)
             QUALIFY row_number() OVER (PARTITION BY install ORDER BY hit_count DESC, pos) = 1)
    SELECT id, name, install, hit_count, matched_keywords, row_number() OVER (ORDER BY hit_count DESC, pos) AS rank FROM best""",
)
def a11_tool_matches(spark, sf):
    m = K.tool_matches(_lower_texts(spark, sf), CS.tool_catalog(spark))
    return m.select("id", "name", "install", "hit_count", "matched_keywords", "rank")


@register(
    "w7_skill_matches",
    f"""WITH {O.catalog_hits(ALL_MESSAGES_SQL, _SKILL_KW)},
    r AS (SELECT h.*, c.name, row_number() OVER (ORDER BY hit_count DESC, h.pos) AS rank FROM hits h JOIN ({_SKILL_CAT}) c USING (id, pos))
    SELECT id, name, hit_count, matched_keywords, rank FROM r WHERE rank <= {K.TOP_SKILLS}""",
)
def w7_skill_matches(spark, sf):
    m = K.skill_matches(_lower_texts(spark, sf), CS.skill_catalog(spark))
    return m.select("id", "name", "hit_count", "matched_keywords", "rank")


@register(
    "a12_tool_summary",
    f"""WITH {O.catalog_hits(ALL_MESSAGES_SQL, _TOOL_KW)},
    best AS (SELECT h.*, c.name, c.install FROM hits h JOIN ({_TOOL_CAT}) c USING (id, pos)
             QUALIFY row_number() OVER (PARTITION BY install ORDER BY hit_count DESC, pos) = 1),
    r AS (SELECT *, row_number() OVER (ORDER BY hit_count DESC, pos) AS rank FROM best),
    l AS (SELECT count(*) AS n_matches, CAST(coalesce(sum(hit_count), 0) AS BIGINT) AS total_hits,
                 arg_min(name, rank) AS top_name, list(name ORDER BY rank) AS nm FROM r)
    SELECT n_matches, total_hits, top_name,
           array_to_string(nm[1:3], ', ') || CASE WHEN len(nm) > 3 THEN ' +' || (len(nm) - 3) || ' more' ELSE '' END AS names
    FROM l""",
)
def a12_tool_summary(spark, sf):
    return K.match_summary(K.tool_matches(_lower_texts(spark, sf), CS.tool_catalog(spark)))


def _sample_texts(spark, sf):
    """the saved samples of all patterns, which is what the catalogues are matched against."""
    corpus = M.substantial(docs_and_curated(spark, sf))
    return K.pattern_texts(find_patterns(corpus, SIMILARITY, MIN_SAMPLES, classify=False))


_SAMPLES_SQL = f"SELECT unnest(sample_texts) AS text FROM ({O.patterns_sql(O.substantial_corpus(DOCS_AND_CURATED_SQL), SIMILARITY, MIN_SAMPLES)})"


@register(
    "a11_sample_tool_matches",
    f"""WITH {O.catalog_hits(_SAMPLES_SQL, _TOOL_KW)},
    best AS (SELECT h.*, c.name, c.install FROM hits h JOIN ({_TOOL_CAT}) c USING (id, pos)
             QUALIFY row_number() OVER (PARTITION BY install ORDER BY hit_count DESC, pos) = 1)
    SELECT id, name, install, hit_count, matched_keywords, row_number() OVER (ORDER BY hit_count DESC, pos) AS rank FROM best""",
)
def a11_sample_tool_matches(spark, sf):
    m = K.tool_matches(_sample_texts(spark, sf), CS.tool_catalog(spark))
    return m.select("id", "name", "install", "hit_count", "matched_keywords", "rank")


@register(
    "w7_sample_skill_matches",
    f"""WITH {O.catalog_hits(_SAMPLES_SQL, _SKILL_KW)},
    r AS (SELECT h.*, c.name, row_number() OVER (ORDER BY hit_count DESC, h.pos) AS rank FROM hits h JOIN ({_SKILL_CAT}) c USING (id, pos))
    SELECT id, name, hit_count, matched_keywords, rank FROM r WHERE rank <= 6""",
)
def w7_sample_skill_matches(spark, sf):
    m = K.skill_matches(_sample_texts(spark, sf), CS.skill_catalog(spark))
    return m.select("id", "name", "hit_count", "matched_keywords", "rank")


@register(
    "f18_pattern_texts",
    f"WITH p AS ({O.patterns_sql(DOC_CORPUS_SQL, SIMILARITY, MIN_SAMPLES)}) SELECT lower(unnest(sample_texts)) AS text FROM p",
)
def f18_pattern_texts(spark, sf):
    return K.pattern_texts(find_patterns(doc_corpus(spark, sf), SIMILARITY, MIN_SAMPLES, classify=False))


# ---------------------------------------------------------------- report rows and recommendations
from refrain.operators import recommend as RC  # noqa: E402
from refrain.operators import inference as I  # noqa: E402
from refrain.sources.curated import inventory, inventory_sql, responses, responses_sql  # noqa: E402

_C8_SQL = O.patterns_sql(DOC_CORPUS_SQL, SIMILARITY, MIN_SAMPLES)
_F13_SQL = O.patterns_sql(O.substantial_corpus(DOCS_AND_CURATED_SQL), SIMILARITY, MIN_SAMPLES, _CLASSIFY_SUMM)
_PROJECTS_SQL = f"SELECT DISTINCT project_path FROM ({DOCS_AND_CURATED_SQL})"
GAP_PROJECT = "/work/api"


def _c8(spark, sf):
    return find_patterns(doc_corpus(spark, sf), SIMILARITY, MIN_SAMPLES, classify=False)


def _f13(spark, sf):
    corpus = M.substantial(docs_and_curated(spark, sf))
    return find_patterns(corpus, SIMILARITY, MIN_SAMPLES, classify=True)


_REPLIED_SQL = f"""SELECT p.* REPLACE (CASE WHEN r.reply IN ('repeatable-workflow', 'boilerplate-request', 'context-re-explanation', 'one-off-task')
        THEN r.reply ELSE p.category END AS category)
    FROM ({_F13_SQL}) p LEFT JOIN (SELECT regexp_replace(request_id, '^cat:', '') AS id, lower(trim(reply)) AS reply
        FROM ({responses_sql()}) WHERE kind = 'category') r USING (id)"""


def _replied(spark, sf):
    """Classified patterns with the model's replies applied (J9): all categories but one-offs."""
    return I.apply_categories(_f13(spark, sf), responses(spark))


def _projects(spark, sf):
    return docs_and_curated(spark, sf).select("project_path").distinct()


_SKILL_CAND = f"(category IS NULL OR category IN ('repeatable-workflow', 'boilerplate-request')) AND size >= 3"


@register(
    "f21_report_rows",
    f"""WITH p AS ({_C8_SQL}) SELECT id, coalesce(label, id) AS title,
        size || ' occurrence' || CASE WHEN size <> 1 THEN 's' ELSE '' END AS occurrences,
        coalesce(category, 'unclassified') AS type,
        CASE WHEN len(dates) > 0 THEN array_to_string(list_transform(dates[1:6], lambda d: strftime(d, '%b %-d')), ', ')
             || CASE WHEN size > 6 THEN ' +' || (size - 6) || ' more' ELSE '' END END AS dates_text,
        CASE WHEN wasted_input_tokens > 0 OR wasted_output_tokens > 0 THEN
             array_to_string(list_filter([CASE WHEN wasted_input_tokens > 0 THEN '~' || format('{{:,}}', wasted_input_tokens) || ' input' END,
                                          CASE WHEN wasted_output_tokens > 0 THEN '~' || format('{{:,}}', wasted_output_tokens) || ' output' END],
                                         lambda x: x IS NOT NULL), ' + ') || ' tokens' END AS waste_text,
        replace(left(sample_texts[1], 80), chr(10), ' ') AS sample,
        CASE WHEN category IS NULL OR category IN ('repeatable-workflow', 'boilerplate-request') THEN 'skill candidate: generate skill ' || id
             WHEN category = 'context-re-explanation' THEN 'context candidate: generate patch ' || id
             WHEN category = 'one-off-task' THEN NULL ELSE 'skill candidate: generate skill ' || id END AS hint
    FROM p""",
)
def f21_report_rows(spark, sf):
    return RC.report_rows(_c8(spark, sf))


@register(
    "f20_explain_rows",
    f"""WITH p AS ({_REPLIED_SQL}) SELECT id, list_transform(sample_texts[1:5], lambda x: left(x, 100)) AS samples,
        CASE WHEN category IN ('repeatable-workflow', 'boilerplate-request') THEN 'skill'
             WHEN category = 'context-re-explanation' THEN 'patch' END AS action FROM p""",
)
def f20_explain_rows(spark, sf):
    return RC.explain_rows(_replied(spark, sf))


def _lookup_sql(pid: str) -> str:
    return f"""WITH p AS ({_C8_SQL})
        SELECT id, label, size, true AS found FROM p WHERE id = {O.q(pid)}
        UNION ALL SELECT id, label, size, false AS found FROM p WHERE (SELECT count(*) FROM p WHERE id = {O.q(pid)}) = 0"""


@register("f16_pattern_lookup", _lookup_sql("pat-002"))
def f16_pattern_lookup(spark, sf):
    return RC.lookup(_c8(spark, sf), "pat-002")


@register("f16_pattern_lookup_missing", _lookup_sql("pat-999"))
def f16_pattern_lookup_missing(spark, sf):
    return RC.lookup(_c8(spark, sf), "pat-999")


def _slug_sql(e: str, n: int, default: str) -> str:
    space = "".join(f"\\x{{{ord(c):x}}}" for c in map(chr, range(0x3001)) if c.isspace())
    s = f"regexp_replace({O.strip(f'lower({e})')}, '[^a-z0-9{space}-]', '', 'g')"
    s = f"regexp_replace({s}, '[{space}]+', '-', 'g')"
    s = f"regexp_replace({s}, '-+', '-', 'g')"
    return f"coalesce(nullif(trim(left({s}, {n}), '-'), ''), {O.q(default)})"


@register(
    "d1_skill_gaps",
    f"""WITH p AS ({_F13_SQL}),
    c AS (SELECT id, size, category, {_slug_sql("coalesce(label, 'pattern-' || id)", 50, 'pattern')} AS suggested_name FROM p WHERE {_SKILL_CAND}),
    g AS (SELECT *, '.claude/skills/' || suggested_name || '/SKILL.md' AS suggested_path FROM c)
    SELECT {O.q(GAP_PROJECT)} AS project_path, id, suggested_name, suggested_path,
           size || ' requests of one kind (' || coalesce(category, 'unclassified') || '); a skill would answer them.' AS reason
    FROM g WHERE suggested_path NOT IN (SELECT rel_path FROM ({inventory_sql()}) WHERE project_path = {O.q(GAP_PROJECT)})""",
)
def d1_skill_gaps(spark, sf):
    return RC.skill_gaps(_f13(spark, sf), inventory(spark), GAP_PROJECT)


_FEATURES_SQL = f"""
    SELECT pr.project_path,
           coalesce(bool_or(i.rel_path = 'CLAUDE.md'), false) AS has_context_file,
           coalesce(bool_or(starts_with(i.rel_path, '.claude/skills/') AND ends_with(i.rel_path, '/SKILL.md')), false) AS has_skills,
           coalesce(bool_or(starts_with(i.rel_path, '.claude/') AND ends_with(i.rel_path, '.md')), false) AS has_local_md
    FROM ({_PROJECTS_SQL}) pr LEFT JOIN ({inventory_sql()}) i ON i.project_path = pr.project_path GROUP BY pr.project_path"""


@register("j8_project_features", _FEATURES_SQL)
def j8_project_features(spark, sf):
    return RC.project_features(_projects(spark, sf), inventory(spark))


@register(
    "d3_context_findings",
    f"""SELECT project_path, 'missing' AS kind, 'CLAUDE.md' AS section, 'No project instructions file found.' AS description,
        'Create CLAUDE.md with the stack, conventions and commands.' AS suggestion FROM ({_FEATURES_SQL}) WHERE NOT has_context_file""",
)
def d3_context_findings(spark, sf):
    return RC.context_findings(_projects(spark, sf), inventory(spark))


@register(
    "d4_skill_drafts",
    f"""WITH p AS ({_C8_SQL}) SELECT id,
        '.claude/skills/' || {_slug_sql('coalesce(label, id)', 40, 'skill')} || '/SKILL.md' AS path,
        concat_ws(chr(10), '# ' || coalesce(label, id), '',
                  'Seen ' || size || ' times between ' || strftime(first_seen, '%Y-%m-%d') || ' and ' || strftime(last_seen, '%Y-%m-%d') || '.',
                  '', 'Example requests:', array_to_string(list_transform(sample_texts[1:3], lambda x: '- ' || x), chr(10))) AS body
        FROM p WHERE {_SKILL_CAND}""",
)
def d4_skill_drafts(spark, sf):
    return RC.skill_drafts(_c8(spark, sf))


@register(
    "d4_context_patch",
    f"""WITH p AS ({_REPLIED_SQL}),
    ctx AS (SELECT id, '- ' || left(sample_texts[1], 100) AS line FROM p WHERE category = 'context-re-explanation'),
    has AS (SELECT count(*) AS n FROM ({inventory_sql()}) WHERE project_path = {O.q(GAP_PROJECT)} AND rel_path = 'CLAUDE.md')
    SELECT {O.q(GAP_PROJECT)} AS project_path, 'CLAUDE.md' AS path, 0 AS line_no,
           CASE WHEN (SELECT count(*) FROM ctx) > 0 THEN '## What requests keep repeating' ELSE 'No repeated context found.' END AS line
    WHERE (SELECT n FROM has) > 0
    UNION ALL
    SELECT {O.q(GAP_PROJECT)}, 'CLAUDE.md', CAST(regexp_extract(id, '(\\d+)$', 1) AS INTEGER), line FROM ctx WHERE (SELECT n FROM has) > 0""",
)
def d4_context_patch(spark, sf):
    return RC.context_patch(_replied(spark, sf), inventory(spark), GAP_PROJECT)


@register(
    "d4_script_drafts",
    f"""WITH p AS ({_F13_SQL}) SELECT id,
        'scripts/' || {_slug_sql('coalesce(label, id)', 40, 'workflow')} || '.sh' AS path,
        concat_ws(chr(10), '#!/usr/bin/env bash', '# Draft for ' || id || ', asked for ' || size || ' times, for example:',
                  array_to_string(list_transform(sample_texts[1:3], lambda x: '#   ' || regexp_replace(x, '\\s*\\n\\s*', ' ', 'g')), chr(10)),
                  'set -euo pipefail', '# put the commands here') AS body
        FROM p WHERE category = 'repeatable-workflow'""",
)
def d4_script_drafts(spark, sf):
    return RC.script_drafts(_f13(spark, sf))


@register(
    "d7_template_rows",
    f"""WITH {O.catalog_hits(ALL_MESSAGES_SQL, _SKILL_KW)},
    r AS (SELECT id, row_number() OVER (ORDER BY hit_count DESC, pos) AS rank FROM hits)
    SELECT r.id, '.claude/skills/' || r.id || '/SKILL.md' AS path, c.skill_md AS body
    FROM r JOIN read_json({O.q(CS.SKILL_CATALOG)}, format = 'array') c
    ON c.id = r.id WHERE r.rank <= {K.TOP_SKILLS}""",
)
def d7_template_rows(spark, sf):
    top = K.skill_matches(_lower_texts(spark, sf), CS.skill_catalog(spark)).select("id")
    return RC.template_rows(top, CS.skill_catalog(spark))


@register(
    "f22_match_rows",
    f"""WITH {O.catalog_hits(ALL_MESSAGES_SQL, _TOOL_KW)},
    cat AS (SELECT * FROM read_json({O.q(CS.TOOL_CATALOG)}, format = 'array')),
    best AS (SELECT h.id, h.pos, h.hit_count, c.install FROM hits h JOIN ({_TOOL_CAT}) c USING (id, pos)
             QUALIFY row_number() OVER (PARTITION BY c.install ORDER BY hit_count DESC, pos) = 1)
    SELECT b.id, CASE WHEN length(cat.replaces) > 55 THEN left(cat.replaces, 55) || '…' ELSE cat.replaces END AS replaces_short,
           array_to_string(coalesce(cat.requires_env, [])[1:2], ', ') AS env_short
    FROM best b JOIN cat ON cat.id = b.id""",
)
def f22_match_rows(spark, sf):
    return RC.match_rows(K.tool_matches(_lower_texts(spark, sf), CS.tool_catalog(spark)))


# ---------------------------------------------------------------- model requests / responses


@register(
    "j9_category_override",
    f"""WITH p AS ({_F13_SQL}),
    r AS (SELECT regexp_replace(request_id, '^cat:', '') AS id, lower(trim(reply)) AS reply FROM ({responses_sql()}) WHERE kind = 'category')
    SELECT p.id, CASE WHEN r.reply IN ({', '.join(O.q(c) for c in I.VALID_CATEGORIES)}) THEN r.reply ELSE p.category END AS category
    FROM p LEFT JOIN r USING (id)""",
)
def j9_category_override(spark, sf):
    return _replied(spark, sf).select("id", "category")


@register(
    "d5_category_requests",
    f"""WITH p AS ({_C8_SQL}) SELECT 'cat:' || id AS request_id, 'category' AS kind,
        'Classify these repeated requests as one of: {", ".join(I.VALID_CATEGORIES)}.' || chr(10) || 'Requests:' || chr(10)
        || array_to_string(list_transform(sample_texts[1:{I.SAMPLES_PER_REQUEST}], lambda x: '- ' || x), chr(10)) AS prompt FROM p""",
)
def d5_category_requests(spark, sf):
    return I.category_requests(_c8(spark, sf))


_NAMED_TOOLS_SQL = f"SELECT *, row_number() OVER () - 1 AS pos FROM read_json({O.q(CS.TOOL_CATALOG)}, format = 'array')"


@register(
    "d5_match_requests",
    f"""WITH p AS ({_F13_SQL}),
    s AS (SELECT string_agg('- ' || sample_texts[1], chr(10) ORDER BY n) AS asked FROM (
        SELECT *, CAST(regexp_extract(id, '(\\d+)$', 1) AS INTEGER) AS n FROM p) WHERE n <= 15),
    c AS (SELECT string_agg(id || ': ' || name || ', ' || description, chr(10) ORDER BY pos) AS offered FROM ({_NAMED_TOOLS_SQL}) WHERE pos < 40)
    SELECT 'match:tools' AS request_id, 'match' AS kind, 'These requests come again and again:' || chr(10) || asked || chr(10)
        || 'Which of these tools would answer them? Reply with a JSON array of at most 6 ids, best first.' || chr(10) || offered AS prompt FROM s, c""",
)
def d5_match_requests(spark, sf):
    return I.match_requests(_f13(spark, sf), CS.tool_catalog(spark), "tools")


@register(
    "j10_catalog_matches",
    f"""WITH {O.catalog_hits(ALL_MESSAGES_SQL, _SKILL_KW)},
    k AS (SELECT id, CAST(row_number() OVER (ORDER BY hit_count DESC, pos) AS INTEGER) AS rank FROM hits),
    m AS (SELECT request_id, regexp_replace(trim(reply), '^```(?:json)?\\s*|\\s*```$', '', 'g') AS body FROM ({responses_sql()}) WHERE kind = 'match'),
    a AS (SELECT request_id, CASE WHEN json_valid(body) THEN from_json(body, '["VARCHAR"]') END AS ids FROM m),
    u AS (SELECT request_id, unnest(ids) AS id, generate_subscripts(ids, 1) - 1 AS rank FROM a),
    v AS (SELECT request_id, id, min(rank) AS rank FROM u WHERE id IN (SELECT id FROM ({_SKILL_CAT})) GROUP BY ALL),
    t AS (SELECT request_id, id, CAST(rank AS INTEGER) AS rank FROM v QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY rank) <= 6)
    SELECT request_id, id, rank, 'reply' AS source FROM t
    UNION ALL
    SELECT request_id, k.id, k.rank, 'keywords' FROM m, k WHERE k.rank <= 6 AND request_id NOT IN (SELECT request_id FROM t)""",
)
def j10_catalog_matches(spark, sf):
    found = K.skill_matches(_lower_texts(spark, sf), CS.skill_catalog(spark)).select("id", "rank")
    return I.catalog_matches(responses(spark), CS.skill_catalog(spark), found)


# ---------------------------------------------------------------- more inventory rows
from refrain.operators import patterns as PT  # noqa: E402
from refrain.sources.curated import labels, labels_sql  # noqa: E402
from refrain.plans.scan import cluster_messages  # noqa: E402


@register(
    "a9_centroids",
    f"""WITH corpus AS ({DOC_CORPUS_SQL}), {_TFIDF}, {_DB},
    mem AS (SELECT c.ord, lab.cluster FROM corpus c JOIN vkey k ON k.doc = c.ord JOIN pt ON pt.key = k.key JOIN lab ON lab.pid = pt.pid),
    csize AS (SELECT cluster, count(*) AS size FROM mem GROUP BY cluster)
    SELECT m.cluster, v.idx, round(sum(v.val) / any_value(s.size), 6) AS c
    FROM mem m JOIN vec v ON v.doc = m.ord JOIN csize s ON s.cluster = m.cluster GROUP BY m.cluster, v.idx""",
)
def a9_centroids(spark, sf):
    _, clustered = cluster_messages(doc_corpus(spark, sf), SIMILARITY, MIN_SAMPLES)
    return PT.centroids(clustered).select("cluster", "idx", F.round("c", 6).alias("c"))


@register("a13_term_statistics", f"WITH corpus AS ({DOC_CORPUS_SQL}), {_TFIDF} SELECT term, cf, df FROM stats")
def a13_term_statistics(spark, sf):
    c = doc_corpus(spark, sf).select(F.col("ord").alias("doc"), "text")
    return V.corpus_statistics(c)


@register(
    "j11_label_override",
    f"""WITH p AS ({_C8_SQL}) SELECT p.id, coalesce(nullif(trim(l.label), ''), p.label) AS label
        FROM p LEFT JOIN ({labels_sql()}) l USING (id)""",
)
def j11_label_override(spark, sf):
    return I.apply_labels(_c8(spark, sf), labels(spark)).select("id", "label")


@register(
    "d5_label_requests",
    f"""WITH p AS ({_C8_SQL}) SELECT 'label:' || CAST(floor((CAST(regexp_extract(id, '(\\d+)$', 1) AS INTEGER) - 1) / {I.PATTERNS_PER_LABEL_BATCH}) AS BIGINT) AS request_id,
        list(id || ': ' || label ORDER BY CAST(regexp_extract(id, '(\\d+)$', 1) AS INTEGER)) AS items FROM p GROUP BY 1""",
)
def d5_label_requests(spark, sf):
    return I.label_requests(_c8(spark, sf))


def _feature_inputs(spark, sf):
    pats = _c8(spark, sf)
    n_cand = pats.filter(RC.is_skill_candidate(F.col("category"), F.col("size"))).agg(F.count(F.lit(1)).alias("n"))
    texts = _lower_texts(spark, sf)
    n_skill = K.skill_matches(texts, CS.skill_catalog(spark)).agg(F.count(F.lit(1)).alias("n"))
    n_tool = K.tool_matches(texts, CS.tool_catalog(spark)).agg(F.count(F.lit(1)).alias("n"))
    return n_cand, n_skill, n_tool


_GAPS_SQL = f"""WITH p AS ({_C8_SQL}),
    {O.catalog_hits(ALL_MESSAGES_SQL, _SKILL_KW)},
    sk AS (SELECT count(*) AS n FROM (SELECT id FROM hits ORDER BY hit_count DESC, pos LIMIT {K.TOP_SKILLS})),
    {O.catalog_hits(ALL_MESSAGES_SQL, _TOOL_KW, "t_")},
    th AS (SELECT h.id, h.hit_count, c.install, h.pos FROM t_hits h JOIN ({_TOOL_CAT}) c USING (id, pos)),
    tl AS (SELECT count(DISTINCT install) AS n FROM th),
    nc AS (SELECT count(*) AS n FROM p WHERE {_SKILL_CAND}),
    f AS ({_FEATURES_SQL}),
    g AS (
        SELECT project_path, 'instructions file' AS feature, has_context_file AS present, 'high' AS severity FROM f
        UNION ALL SELECT project_path, 'skills', has_skills, CASE WHEN (SELECT n FROM nc) > 0 AND NOT has_skills THEN 'high' ELSE 'medium' END FROM f
        UNION ALL SELECT project_path, 'community skills', (SELECT n FROM sk) = 0, CASE WHEN (SELECT n FROM sk) > 0 THEN 'medium' ELSE 'low' END FROM f
        UNION ALL SELECT project_path, 'tool servers', false, CASE WHEN (SELECT n FROM tl) > 0 THEN 'high' ELSE 'low' END FROM f
        UNION ALL SELECT project_path, 'local config directory', has_local_md, 'low' FROM f)"""


@register("d2_feature_gaps", f"{_GAPS_SQL} SELECT * FROM g")
def d2_feature_gaps(spark, sf):
    n_cand, n_skill, n_tool = _feature_inputs(spark, sf)
    return RC.feature_gaps(_projects(spark, sf), inventory(spark), n_cand, n_skill, n_tool, tools_configured=False)


@register(
    "d2_gaps_with_tools",
    f"""{_GAPS_SQL} SELECT project_path, feature, CASE WHEN feature = 'tool servers' THEN TRUE ELSE present END AS present,
        CASE WHEN feature = 'tool servers' AND severity = 'high' THEN 'medium' ELSE severity END AS severity FROM g""",
)
def d2_gaps_with_tools(spark, sf):
    """The same with tool servers configured: present, and of medium severity where the patterns name some."""
    n_cand, n_skill, n_tool = _feature_inputs(spark, sf)
    return RC.feature_gaps(_projects(spark, sf), inventory(spark), n_cand, n_skill, n_tool, tools_configured=True)


@register("f17_missing_features", f"{_GAPS_SQL} SELECT * FROM g WHERE NOT present")
def f17_missing_features(spark, sf):
    n_cand, n_skill, n_tool = _feature_inputs(spark, sf)
    gaps = RC.feature_gaps(_projects(spark, sf), inventory(spark), n_cand, n_skill, n_tool, tools_configured=False)
    return RC.missing_features(gaps)


CONV_SIMILARITY = 0.5  # conversations only cluster at <= 0.6; 0.5 also makes zero vectors neighbour every point


@register(
    "c8_conversation_patterns",
    f"""WITH p AS ({O.patterns_sql(O.substantial_corpus(O.conversation_messages()), CONV_SIMILARITY, MIN_SAMPLES)})
        SELECT id, pattern_key, label, size, representative_text, sample_texts, wasted_input_tokens, wasted_output_tokens FROM p""",
)
def c8_conversation_patterns(spark, sf):
    corpus = M.substantial(V.spread_if_uneven(conversation_messages(spark, sf), read_table(spark, sf, "conversations"), "ord"))
    p = find_patterns(corpus, CONV_SIMILARITY, MIN_SAMPLES, classify=False)
    return p.select("id", "pattern_key", "label", "size", "representative_text", "sample_texts", "wasted_input_tokens", "wasted_output_tokens")


# ---------------------------------------------------------------- session logs
from refrain.sources import logs as L  # noqa: E402

#: Lines that no reader may turn into a message.
BAD_LINES = ['{"type": "user"', "[1, 2]", '"text"', "7", "", '{"type": "user", "message": null}', '{"type": "user", "message": "plain"}']


def rendered_log_lines(spark: SparkSession, sf: str) -> DataFrame:
    """``conversations`` as log lines (string and block contents, missing and broken fields), with bad lines among them."""
    c = read_table(spark, sf, "conversations")
    i = F.col("conv_id")
    fields = [
        F.col("role").alias("type"),
        F.when(i % 6 != 0, F.concat(F.lit("c"), i, F.lit("-"), F.col("turn"))).alias("uuid"),
        F.when(i % 4 != 0, F.concat(F.lit("/w/"), i % 4)).alias("cwd"),
        F.when(i % 3 == 0, F.lit("2024-01-02T03:04:05Z")).when(i % 3 == 1, F.lit("yesterday")).alias("timestamp"),
        F.when(i % 5 == 0, F.lit(True)).when(i % 5 == 1, F.lit(False)).alias("isSidechain"),
    ]
    block = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    blocks = F.array(block("tool_result", F.lit("not this")), block("text", F.col("text")), block("text", F.lit("  ")))
    plain = F.to_json(F.struct(*fields, F.struct("role", F.col("text").alias("content")).alias("message")))
    listed = F.to_json(F.struct(*fields, F.struct("role", blocks.alias("content")).alias("message")))
    name = F.concat(F.lit("s%20"), i, F.lit("+x.jsonl"))
    lines = c.select(F.when(i % 2 == 0, plain).otherwise(listed).alias("value"), F.concat(F.lit("file:/logs/proj%25"), i % 3, F.lit("/"), name).alias("file_path"), name.alias("file_name"))
    bad = spark.createDataFrame([(b, "file:/logs/p/bad.jsonl", "bad.jsonl") for b in BAD_LINES], "value string, file_path string, file_name string")
    return lines.unionByName(bad)


@register(
    "s3_parsed_log_messages",
    f"""SELECT CASE WHEN conv_id % 6 <> 0 THEN 'c' || conv_id || '-' || turn ELSE '' END AS uuid,
               's ' || conv_id || '+x' AS session_id, 'proj%' || conv_id % 3 AS project_dir,
               CASE WHEN conv_id % 4 <> 0 THEN '/w/' || conv_id % 4 ELSE '.' END AS cwd,
               CASE WHEN conv_id % 3 = 0 THEN TIMESTAMP '2024-01-02 03:04:05' END AS ts, {O.strip('text')} AS text
        FROM conversations WHERE role = 'user' AND conv_id % 5 <> 0 AND length({O.strip('text')}) > 0""",
)
def s3_parsed_log_messages(spark, sf):
    return L.parse_lines(rendered_log_lines(spark, sf)).select("uuid", "session_id", "project_dir", "cwd", "ts", "text")


def damaged_log_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The rendered lines, some of them cut off, put into a list, without a message, or blank."""
    lines = rendered_log_lines(spark, sf)
    conv = F.regexp_extract("file_name", r"%20(\d+)\+", 1)
    turn = F.regexp_extract("value", r'"uuid":"c\d+-(\d+)"', 1)
    k = F.when((conv != "") & (turn != ""), (F.expr("try_cast(regexp_extract(file_name, '%20([0-9]+)', 1) AS BIGINT)") * 3 + turn.try_cast("bigint")) % 13)
    value = F.col("value")
    damaged = (
        F.when(k == 2, F.substring(value, F.lit(1), F.length(value) - 1)).when(k == 5, F.concat(F.lit("["), value, F.lit("]")))
        .when(k == 7, F.replace(value, F.lit('"message":'), F.lit('"massage":'))).when(k == 11, F.lit(" \t")).otherwise(value)
    )
    return lines.withColumn("value", damaged)


@register(
    "s4_line_report",
    f"""WITH l AS (SELECT *, CASE WHEN conv_id % 6 <> 0 THEN (conv_id * 3 + turn) % 13 ELSE 0 END AS k FROM conversations)
        SELECT 'proj%' || conv_id % 3 AS project_dir, 's ' || conv_id || '+x.jsonl' AS file_name, count(*) AS n_lines,
               count(*) FILTER (k = 11) AS n_blank, count(*) FILTER (k = 2) AS n_not_json, count(*) FILTER (k = 5) AS n_not_an_object, count(*) FILTER (k = 7) AS n_no_message,
               count(*) FILTER (k NOT IN (2, 5, 7, 11) AND role = 'user' AND conv_id % 5 <> 0 AND length({O.strip('text')}) > 0) AS n_messages
        FROM l GROUP BY conv_id UNION ALL SELECT 'p', 'bad.jsonl', 7, 1, 1, 3, 2, 0""",
)
def s4_line_report(spark, sf):
    """Lines, rejected lines by reason and human turns of every file."""
    return L.line_report(damaged_log_lines(spark, sf))
