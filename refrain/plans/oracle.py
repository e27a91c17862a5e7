"""DuckDB twins of the Spark queries, for ``oracle_sql()``.

Written independently of the Spark code path (joins and recursive SQL instead
of block Gram products), sharing only the fixed values.
"""

from __future__ import annotations

from refrain.functions.text import MIN_SUBSTANTIAL_LEN, MIN_REPRESENTATIVE_LEN, NOISE_REGEX, WHITESPACE
from refrain.operators.neighbours import eps2
from refrain.operators.vectors import VOCAB_SIZE
from refrain.sources.tables import DOC_EPOCH, DOC_PROJECT_ROOT, DOC_SESSIONS, DOC_STEP_MINUTES

WS_SQL = "(" + " || ".join(f"chr({ord(c)})" for c in WHITESPACE) + ")"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def strip(e: str) -> str:
    return f"trim({e}, {WS_SQL})"


def noise(e: str) -> str:
    return f"regexp_matches(lower({e}), {q(NOISE_REGEX)})"


def substantial(e: str) -> str:
    return f"(length({strip(e)}) >= {MIN_SUBSTANTIAL_LEN} AND NOT {noise(strip(e))})"


def quality(e: str) -> str:
    return f"(length({strip(e)}) >= {MIN_REPRESENTATIVE_LEN} AND NOT {noise(strip(e))})"


def first_line(e: str, n: int) -> str:
    return strip(f"left(split_part({e}, chr(10), 1), {n})")


def documents_messages() -> str:
    return f"""
    SELECT 'd' || doc_id AS uuid,
           's' || (doc_id % {DOC_SESSIONS}) AS session_id,
           {q(DOC_PROJECT_ROOT)} || source AS project_path,
           TIMESTAMP {q(DOC_EPOCH)} + to_minutes(CAST(doc_id * {DOC_STEP_MINUTES} AS BIGINT)) AS ts,
           {strip('text')} AS text,
           CAST(NULL AS VARCHAR) AS parent_uuid,
           doc_id AS ord
    FROM documents WHERE length({strip('text')}) > 0"""


def conversation_messages() -> str:
    return f"""
    SELECT 'c' || conv_id || '.' || turn AS uuid, CAST(conv_id AS VARCHAR) AS session_id,
           CAST(NULL AS VARCHAR) AS project_path, CAST(NULL AS TIMESTAMP) AS ts,
           {strip('text')} AS text, CAST(NULL AS VARCHAR) AS parent_uuid,
           {{'conv_id': conv_id, 'turn': turn}} AS ord
    FROM conversations WHERE role = 'user' AND length({strip('text')}) > 0"""


def tfidf_ctes(corpus: str) -> str:
    """CTEs ``tf, vocab, vec`` (sparse entries) and ``pt`` (points) over CTE ``corpus(ord, text)``."""
    return f"""
    toks AS (
        SELECT ord AS doc, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS t FROM {corpus}),
    terms AS (
        SELECT doc, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM toks),
    tf AS MATERIALIZED (SELECT doc, term, count(*) AS tf FROM terms GROUP BY doc, term),
    ndocs AS (SELECT count(*) AS n FROM {corpus}),
    top AS MATERIALIZED (SELECT term, CAST(sum(tf) AS BIGINT) AS cf, count(*) AS df FROM tf GROUP BY term ORDER BY cf DESC, term ASC LIMIT {VOCAB_SIZE}),
    vocab AS (
        SELECT term, cf, df, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS idx,
               ln((1.0 + (SELECT n FROM ndocs)) / (1.0 + df)) + 1.0 AS idf FROM top),
    w AS (SELECT doc, idx, tf.tf, (1.0 + ln(tf.tf)) * idf AS w FROM tf JOIN vocab USING (term)),
    nrm AS (SELECT doc, sqrt(sum(w * w)) AS norm FROM w GROUP BY doc),
    vec AS (SELECT doc, idx, tf, w / norm AS val FROM w JOIN nrm USING (doc)),
    vkey AS (
        SELECT c.ord AS doc, coalesce(k.key, '') AS key
        FROM {corpus} c LEFT JOIN (
            SELECT doc, string_agg(idx || ':' || tf, ',' ORDER BY idx) AS key FROM vec GROUP BY doc) k ON k.doc = c.ord),
    pt AS (SELECT key, min(doc) AS pid, count(*) AS mult FROM vkey GROUP BY key),
    pvec AS (SELECT pt.pid, v.idx, v.val FROM pt JOIN vkey k ON k.doc = pt.pid JOIN vec v ON v.doc = k.doc),
    pnorm AS (SELECT pt.pid, coalesce(sum(v.val * v.val), 0.0) AS n2 FROM pt LEFT JOIN pvec v USING (pid) GROUP BY pt.pid)"""


def vocabulary_ctes(corpus: str) -> str:
    """Only the CTEs up to ``vocab``."""
    every = tfidf_ctes(corpus)
    return every[: every.index("    w AS (")].rstrip().rstrip(",")


def dbscan_ctes(similarity: float, min_samples: int) -> str:
    """CTEs ``adj`` (ordered neighbour pairs), ``cores``, ``root``, ``lab(pid, cluster)`` over ``pt``/``pvec``/``pnorm``."""
    e2 = eps2(similarity)
    zero_unit = "TRUE" if 1.0 <= e2 else "FALSE"
    return f"""
    dots AS (
        SELECT a.pid AS p, b.pid AS q, sum(a.val * b.val) AS dot
        FROM pvec a JOIN pvec b ON a.idx = b.idx AND a.pid <> b.pid GROUP BY a.pid, b.pid),
    adj AS (
        SELECT p, q FROM dots JOIN pnorm x ON x.pid = p JOIN pnorm y ON y.pid = q
        WHERE x.n2 + y.n2 - 2 * dot <= {e2!r}
        UNION
        SELECT x.pid AS p, y.pid AS q FROM pnorm x JOIN pnorm y ON x.pid <> y.pid AND (x.n2 = 0 OR y.n2 = 0)
        WHERE {zero_unit} AND x.n2 + y.n2 <= {e2!r}),
    cnt AS (
        SELECT pt.pid, pt.mult + coalesce(sum(o.mult), 0) AS n FROM pt
        LEFT JOIN adj ON adj.p = pt.pid LEFT JOIN pt o ON o.pid = adj.q GROUP BY pt.pid, pt.mult),
    cores AS (SELECT pid FROM cnt WHERE n >= {min_samples}),
    cedge AS (SELECT p, q FROM adj WHERE p IN (SELECT pid FROM cores) AND q IN (SELECT pid FROM cores)),
    reach AS (SELECT r, min(s) AS root FROM (
        WITH RECURSIVE walk(r, s) AS (
            SELECT pid, pid FROM cores
            UNION
            SELECT cedge.q, walk.s FROM walk JOIN cedge ON cedge.p = walk.r)
        SELECT * FROM walk) GROUP BY r),
    lab AS (
        SELECT r AS pid, root AS cluster FROM reach
        UNION ALL
        SELECT adj.p AS pid, min(reach.root) AS cluster FROM adj JOIN reach ON reach.r = adj.q
        WHERE adj.p NOT IN (SELECT pid FROM cores) GROUP BY adj.p)"""


def patterns_sql(corpus_sql: str, similarity: float = 0.75, min_samples: int = 3, classify_sql: str | None = None, one_offs: bool = False, points: str | None = None) -> str:
    """Whole pattern pipeline; ``classify_sql`` maps CTE ``summ`` to ``summ2`` with a ``category``.

    ``points``: CTEs ``vkey, pt, pvec, pnorm, vec`` over ``corpus`` instead of the TF-IDF ones.
    """
    cat = classify_sql or "summ2 AS (SELECT *, CAST(NULL AS VARCHAR) AS category FROM summ)"
    where = "" if classify_sql is None or one_offs else "WHERE category IS NULL OR category <> 'one-off-task'"
    return f"""
    WITH corpus AS ({corpus_sql}),
    {points or tfidf_ctes('corpus')},
    {dbscan_ctes(similarity, min_samples)},
    mem AS (
        SELECT c.*, k.key, pt.pid, lab.cluster FROM corpus c JOIN vkey k ON k.doc = c.ord
        JOIN pt ON pt.key = k.key JOIN lab ON lab.pid = pt.pid),
    csize AS (SELECT cluster, count(*) AS size FROM mem GROUP BY cluster),
    cent AS (
        SELECT m.cluster, v.idx, sum(v.val) / any_value(s.size) AS c
        FROM mem m JOIN vec v ON v.doc = m.ord JOIN csize s ON s.cluster = m.cluster GROUP BY m.cluster, v.idx),
    cn AS (SELECT cluster, sum(c * c) AS cn2 FROM cent GROUP BY cluster),
    pc AS (SELECT DISTINCT pid, cluster FROM mem),
    pd AS (
        SELECT pc.pid, round(pn.n2 + cn.cn2 - 2 * coalesce((
            SELECT sum(v.val * ce.c) FROM pvec v JOIN cent ce ON ce.idx = v.idx AND ce.cluster = pc.cluster
            WHERE v.pid = pc.pid), 0.0), 10) AS d2
        FROM pc JOIN pnorm pn ON pn.pid = pc.pid JOIN cn ON cn.cluster = pc.cluster),
    ranked AS (
        SELECT m.*, pd.d2, row_number() OVER (
            PARTITION BY m.cluster ORDER BY (NOT {quality('m.text')}), pd.d2, m.ord) AS rr
        FROM mem m JOIN pd ON pd.pid = m.pid),
    rep AS (SELECT cluster, {first_line('text', 100)} AS representative_text FROM ranked WHERE rr = 1),
    oth AS (
        SELECT m.cluster, m.text, row_number() OVER (PARTITION BY m.cluster ORDER BY m.ord) AS k
        FROM mem m JOIN rep ON rep.cluster = m.cluster WHERE m.text <> rep.representative_text),
    smp AS (SELECT cluster, list(text ORDER BY k) AS s FROM oth WHERE k <= 4 GROUP BY cluster),
    dts AS (SELECT cluster, list(ts ORDER BY ts, ord) AS d FROM (
        SELECT cluster, ts, ord, row_number() OVER (PARTITION BY cluster ORDER BY ts, ord) AS k FROM mem) WHERE k <= 10 GROUP BY cluster),
    agg AS (
        SELECT cluster, count(*) AS size, avg(length(text)) AS avg_chars, min(ts) AS first_seen, max(ts) AS last_seen,
               bit_xor(('0x' || substr(md5(uuid), 1, 15))::BIGINT) AS hx, sum(('0x' || substr(md5(uuid), 16, 15))::BIGINT >> 30)::BIGINT AS hs
        FROM mem GROUP BY cluster),
    summ AS (
        SELECT a.cluster, printf('pat-%03d', row_number() OVER (ORDER BY a.size DESC, a.cluster)) AS id,
               substr(md5(concat_ws('|', CAST(a.size AS VARCHAR), CAST(hx AS VARCHAR), CAST(hs AS VARCHAR))), 1, 8) AS pattern_key,
               coalesce(nullif({first_line('rep.representative_text', 80)}, ''), 'Unknown pattern') AS label,
               a.size, rep.representative_text,
               list_concat([rep.representative_text], coalesce(smp.s, [])) AS sample_texts,
               coalesce(dts.d, []) AS dates, a.first_seen, a.last_seen, a.avg_chars
        FROM agg a JOIN rep USING (cluster) LEFT JOIN smp USING (cluster) LEFT JOIN dts USING (cluster)),
    {cat},
    fin AS (
        SELECT *, greatest(1, CAST(floor(avg_chars / 4) AS BIGINT)) AS per FROM summ2 {where})
    SELECT id, pattern_key, label, category, size, representative_text, sample_texts, dates, first_seen, last_seen,
           CAST(per * size AS BIGINT) AS wasted_input_tokens,
           CAST(CASE WHEN category = 'boilerplate-request' THEN 700
                     WHEN category = 'repeatable-workflow' THEN 400
                     WHEN category = 'context-re-explanation' THEN 0
                     ELSE least(300, per * 3) END * size AS BIGINT) AS wasted_output_tokens
    FROM fin"""


def substantial_corpus(messages_sql: str) -> str:
    return f"SELECT * FROM ({messages_sql}) m WHERE {substantial('text')}"


def rules_values() -> str:
    from refrain.operators.rules import RULES

    vals = ", ".join(f"({i}, {q(n)}, {q(d)}, {q(s)}, {q(r)})" for i, (n, d, s, r) in enumerate(RULES))
    return f"SELECT * FROM (VALUES {vals}) AS r(pos, name, description, suggestion, regex)"


def keywords_values() -> str:
    from refrain.operators.classify import KEYWORD_RULES

    vals = ", ".join(f"({p}, {q(c)}, {q(k)})" for p, (c, ks) in enumerate(KEYWORD_RULES) for k in ks)
    return f"SELECT * FROM (VALUES {vals}) AS k(priority, category, keyword)"


def keyword_category(items: str, key: str, text: str) -> str:
    """Keyword classifier over relation ``items``: ``key, category``."""
    return f"""
    SELECT i.{key}, CASE WHEN i.{text} IS NULL OR length(i.{text}) = 0 THEN 'one-off-task'
                         ELSE coalesce(b.cat, 'one-off-task') END AS category
    FROM {items} i LEFT JOIN (
        SELECT {key}, arg_max(category, score * 1000 - priority) AS cat FROM (
            SELECT i2.{key}, k.priority, k.category, count(DISTINCT k.keyword) AS score
            FROM {items} i2 JOIN ({keywords_values()}) k ON contains(lower(i2.{text}), k.keyword)
            GROUP BY i2.{key}, k.priority, k.category) GROUP BY {key}) b ON b.{key} = i.{key}"""


def dense_point_ctes(source: str, key: str, vec: str) -> str:
    """``pt, pvec, pnorm`` for a dense vector column, normalised (zero stays zero)."""
    return f"""
    raw AS (SELECT {key} AS doc, CAST({vec} AS DOUBLE[]) AS v FROM {source}),
    unit AS (SELECT doc, CASE WHEN list_sum(list_transform(v, lambda x: x * x)) > 0
                 THEN list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) ELSE v END AS v FROM raw),
    vkey AS (SELECT doc, CAST(v AS VARCHAR) AS key, v FROM unit),
    pt AS (SELECT key, min(doc) AS pid, count(*) AS mult FROM vkey GROUP BY key),
    pvec AS (SELECT pt.pid, unnest(range(0, len(k.v))) AS idx, unnest(k.v) AS val FROM pt JOIN vkey k ON k.doc = pt.pid),
    pnorm AS (SELECT pt.pid, coalesce(sum(v.val * v.val), 0.0) AS n2 FROM pt LEFT JOIN pvec v USING (pid) GROUP BY pt.pid)"""


def catalog_values(path: str, tool: bool) -> tuple[str, str]:
    """(catalogue rows, keyword rows) as VALUES from the same JSON file the engine reads."""
    import json

    with open(path, encoding="utf-8") as f:
        entries = json.load(f)
    if tool:
        rows = ", ".join(f"({i}, {q(e['id'])}, {q(e['name'])}, {q(e['install'])})" for i, e in enumerate(entries))
        cat = f"SELECT * FROM (VALUES {rows}) AS c(pos, id, name, install)"
    else:
        rows = ", ".join(f"({i}, {q(e['id'])}, {q(e['name'])})" for i, e in enumerate(entries))
        cat = f"SELECT * FROM (VALUES {rows}) AS c(pos, id, name)"
    kws = ", ".join(
        f"({i}, {q(e['id'])}, {j}, {q(k)})" for i, e in enumerate(entries) for j, k in enumerate(e["keywords"])
    )
    return cat, f"SELECT * FROM (VALUES {kws}) AS k(pos, id, kw_pos, keyword)"


def catalog_hits(texts_sql: str, kw_sql: str, prefix: str = "") -> str:
    return f"""
    {prefix}per AS (SELECT k.id, k.pos, k.kw_pos, k.keyword, count(*) AS hits
            FROM (SELECT lower(text) AS t FROM ({texts_sql})) tx JOIN ({kw_sql}) k ON contains(tx.t, lower(k.keyword))
            GROUP BY ALL),
    {prefix}hits AS (SELECT id, pos, CAST(sum(hits) AS BIGINT) AS hit_count, list(keyword ORDER BY kw_pos) AS matched_keywords
             FROM {prefix}per GROUP BY id, pos)"""
