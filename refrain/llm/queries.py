"""The registered queries of the ten corpus operators and their DuckDB twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refrain.llm import byte_bpe, chat_format, hard_negatives, html_extract, lsh_forest, mixing, multi_index, quality, secret_scan, token_align, toxicity, warc, winnowing
from refrain.llm.common import table


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings with equal labels and a cosine of at least 0.98."""
    return multi_index.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learned outside the held-out fold."""
    found = toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted", F.size("passages").alias("n_passages"))


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    return winnowing.compare_neighbours(table(spark, sf_dir, "documents"))


BPE_RANKS = "byte_bpe_50k.tiktoken"


def bpe_digests(docs: DataFrame, ids_col: str = "ids", decoded_col: str = "decoded") -> list:
    return [
        F.size(ids_col).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col(ids_col).cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col(decoded_col), 256).alias("decoded_sha256"),
    ]


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and of their decoding, for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranks = byte_bpe.load_ranks(public_tokenizers.path(BPE_RANKS))
    coded = byte_bpe.encode_decode(docs, ranks, public_tokenizers.PATTERN)
    return coded.select("doc_id", *bpe_digests(coded))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned outside the held-out fold."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives of all pages say, read back from the files."""
    folder = warc.new_folder(spark)
    warc.write_archives(table(spark, sf_dir, "pages"), folder)
    back = warc.read_archives(spark, folder)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def spans_text(column: str):
    return F.array_join(F.transform(column, lambda s: F.concat(s["from"].cast("string"), F.lit("-"), s["to"].cast("string"))), " ").alias(column)


def op8_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt and masked completions of every conversation, against the same with another's replies from some point on."""
    chosen, rejected = chat_format.with_swapped_replies(table(spark, sf_dir, "conversations"))
    pairs = chat_format.preference_pairs(chosen, rejected, pair="conv_id")
    return pairs.select("conv_id", "n_prompt_turns", "prompt", "chosen", "rejected", spans_text("chosen_spans"), spans_text("rejected_spans"), "differs")


OP8_SQL = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
a AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, text) - 1 AS j, count(*) OVER (PARTITION BY conv_id) AS n FROM t WHERE role = 'assistant'),
ids AS (SELECT conv_id, n, ((conv_id % n) + n) % n AS since, coalesce(lead(conv_id) OVER (ORDER BY conv_id), first(conv_id) OVER (ORDER BY conv_id)) AS nxt
        FROM (SELECT DISTINCT conv_id, n FROM a)),
swapped AS (SELECT a.conv_id, a.turn, a.role, CASE WHEN a.j < ids.since THEN a.text ELSE o.text END AS text
            FROM a JOIN ids USING (conv_id) JOIN ids x ON x.conv_id = ids.nxt JOIN a o ON o.conv_id = ids.nxt AND o.j = a.j % x.n),
both_sides AS (
  SELECT 'c' AS side, conv_id, turn, role, text FROM t UNION ALL
  SELECT 'r', conv_id, turn, role, text FROM (SELECT * FROM t WHERE role <> 'assistant' UNION SELECT * FROM swapped)),
n AS (SELECT *, row_number() OVER (PARTITION BY side, conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
        '<|' || replace(replace(role, '\', '\\'), '<|', '<\|') || '|>' || chr(10) AS head,
        replace(replace(text, '\', '\\'), '<|', '<\|') || '<|end|>' || chr(10) AS body FROM both_sides),
p AS (SELECT conv_id, least(count(*) FILTER (side = 'c'), count(*) FILTER (side = 'r')) AS shorter FROM n GROUP BY conv_id),
d AS (SELECT p.conv_id, coalesce(min(c.i) FILTER (c.role <> r.role OR c.text <> r.text) - 1, any_value(shorter)) AS k
      FROM p LEFT JOIN n c ON c.conv_id = p.conv_id AND c.side = 'c'
      LEFT JOIN n r ON r.conv_id = c.conv_id AND r.i = c.i AND r.side = 'r' GROUP BY p.conv_id),
s AS (SELECT n.*, k, sum(CASE WHEN i > k THEN length(head) + length(body) ELSE 0 END) OVER (PARTITION BY side, conv_id ORDER BY i) AS upto
      FROM n JOIN d USING (conv_id))
SELECT conv_id, any_value(k)::INT AS n_prompt_turns,
       coalesce(string_agg(head || body, '' ORDER BY i) FILTER (side = 'c' AND i <= k), '') AS prompt,
       coalesce(string_agg(head || body, '' ORDER BY i) FILTER (side = 'c' AND i > k), '') AS chosen,
       coalesce(string_agg(head || body, '' ORDER BY i) FILTER (side = 'r' AND i > k), '') AS rejected,
       coalesce(string_agg((upto - length(body))::BIGINT || '-' || upto::BIGINT, ' ' ORDER BY i) FILTER (side = 'c' AND i > k AND role = 'assistant'), '') AS chosen_spans,
       coalesce(string_agg((upto - length(body))::BIGINT || '-' || upto::BIGINT, ' ' ORDER BY i) FILTER (side = 'r' AND i > k AND role = 'assistant'), '') AS rejected_spans,
       count(*) FILTER (i > k) > 0 AS differs
FROM s GROUP BY conv_id
"""


OP7_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS b FROM pages),
m AS (SELECT h, max(page_id) AS top FROM p WHERE b >= {warc.REVISIT_BYTES} GROUP BY h)
SELECT p.page_id, p.b AS payload_bytes, sha1(p.h) AS payload_digest,
       CASE WHEN m.top <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN m.top <> p.page_id THEN m.top END AS refers_to
FROM p LEFT JOIN m ON p.h = m.h
"""


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy of every document in the temperature mix of ``documents`` by source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    plan = mixing.mixing_plan(docs)
    rows = mixing.mix(docs.select("doc_id", "source"), plan)
    shown = plan.select("src", F.round("alpha", 6).alias("alpha"), F.round("weight", 6).alias("weight"))
    return (
        mixing._with_plan(rows.withColumn("src", mixing.source_key("source")), shown)
        .select("doc_id", "source", F.col("mix_epoch").alias("epoch"), F.col("mix_block").alias("block"), F.col("mix_key").alias("perm_key"), "alpha", "weight")
    )


def op10_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: three-word shingles, similarity 0.85."""
    return lsh_forest.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


ALIGN_A, ALIGN_B = "byte_bpe_50k.json", "piece_bpe_32k.model"


def op11_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups, links and link counts of two tokenizers' tokens, for every document."""
    vocabularies = token_align.Vocabularies(public_tokenizers.path(ALIGN_A), public_tokenizers.path(ALIGN_B))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    return token_align.align(table(spark, sf_dir, "documents"), vocabularies, keep={"groups_sha256": digest})


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor and positive among all embeddings."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.quantised(table(spark, sf_dir, "embeddings"), id_col="vec_id", vector_col="embedding", label=moved)
    return hard_negatives.mine(rows, F.col("id") % 50 == 0)


OP12_SQL = """
WITH v AS (SELECT row_number() OVER () AS n, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(256 * x::DOUBLE))) = 0),
a AS (SELECT vec_id, label, q, min(n) AS n FROM v WHERE vec_id % 50 = 0 GROUP BY ALL),
s AS (SELECT a.n AS a_n, a.vec_id AS anchor_id, v.n, v.vec_id, a.label = v.label AS same,
        CASE WHEN len(a.q) = 0 THEN 0 ELSE list_inner_product(a.q, v.q)::BIGINT END AS score
      FROM a JOIN v ON len(a.q) = len(v.q) AND a.vec_id <> v.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a_n ORDER BY score DESC, vec_id, n) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, (row_number() OVER w)::INT AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a_n = p.a_n AND NOT s.same AND 100 * s.score BETWEEN 50 * p.score AND 95 * p.score
WINDOW w AS (PARTITION BY p.a_n, p.n ORDER BY s.score DESC, s.vec_id, s.n)
QUALIFY row_number() OVER w <= 3
"""


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and added secret spans of every document."""
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{secret_scan.KINDS[k]}")
    return found.select("doc_id", *map(number, range(3)), F.sha2(secret_scan.written("base"), 256).alias("base_sha256"), secret_scan.written("spans").alias("spans"))


OP9_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce('=' || source, 'null') AS src,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS tokens FROM documents),
totals AS (SELECT src, count(*) AS n_docs, sum(tokens)::BIGINT AS tokens FROM d GROUP BY src),
sh AS (SELECT tokens::DOUBLE / (SELECT sum(tokens) FROM totals)::DOUBLE AS p FROM totals WHERE tokens > 0 ORDER BY p),
g AS (SELECT {mixing.TARGET_ENTROPY} * ln(count(*)::DOUBLE) AS goal, (SELECT sum(tokens) FROM totals)::BIGINT AS total, min(p) AS least,
        -sum(p * ln(p)) AS h1, 1 / count(*) / min(p) AS r0 FROM sh),
e(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN h >= goal THEN mid ELSE lo END, CASE WHEN h >= goal THEN hi ELSE mid END
  FROM (SELECT i, lo, hi, mid, ln(sum(pow(p, mid))) - sum(pow(p, mid) * mid * ln(p)) / sum(pow(p, mid)) AS h
        FROM (SELECT *, (lo + hi) / 2 AS mid FROM e WHERE i < {mixing.STEPS}), sh GROUP BY i, lo, hi, mid), g),
r(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN x > {mixing.MAX_REPEATS} THEN mid ELSE lo END, CASE WHEN x > {mixing.MAX_REPEATS} THEN hi ELSE mid END
  FROM (SELECT i, lo, hi, mid, pow(min(p), mid) / sum(pow(p, mid)) / min(p) AS x
        FROM (SELECT *, (lo + hi) / 2 AS mid FROM r WHERE i < {mixing.STEPS}), sh GROUP BY i, lo, hi, mid)),
a AS (SELECT round(greatest(CASE WHEN h1 >= goal THEN 1.0 ELSE (SELECT lo FROM e WHERE i = {mixing.STEPS}) END,
                            CASE WHEN r0 <= {mixing.MAX_REPEATS} THEN 0.0 ELSE (SELECT hi FROM r WHERE i = {mixing.STEPS}) END), 9) AS alpha, total FROM g),
w AS (SELECT src, n_docs, tokens, alpha, total,
        CASE WHEN tokens > 0 THEN pow(tokens::DOUBLE / total, alpha) / (SELECT sum(pow(p, alpha)) FROM sh) ELSE 0 END AS weight FROM totals, a),
b AS (SELECT *, floor(weight * total)::BIGINT AS budget FROM w),
pl AS (SELECT *, CASE WHEN tokens > 0 THEN budget // tokens ELSE 1 END AS fe, ceil(n_docs / {mixing.BLOCK_DOCS}.0) AS nb FROM b),
pl2 AS (SELECT *, CASE WHEN tokens > 0 THEN budget - fe * tokens ELSE 0 END AS rest FROM pl),
c AS (SELECT d.*, fe, rest, nb, alpha, weight, unnest(range(0, fe + 1)) AS epoch FROM d JOIN pl2 USING (src)),
k AS (SELECT *, ('0x' || substr(md5('{mixing.SEED}:' || epoch || ':' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT AS perm_key FROM c),
s AS (SELECT *, sum(tokens) OVER (PARTITION BY src, epoch ORDER BY perm_key) AS cum FROM k)
SELECT doc_id, source, epoch, floor(perm_key::DOUBLE / {float(mixing.KEY_SPACE)!r} * nb)::BIGINT AS block, perm_key,
       round(alpha, 6) AS alpha, round(weight, 6) AS weight
FROM s WHERE epoch < fe OR (rest > 0 AND cum <= rest)
"""

QUERIES = {
    "op1_html_text": op1_html_text,
    "op2_multi_index": op2_multi_index,
    "op3_toxicity": op3_toxicity,
    "op4_winnowing": op4_winnowing,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_quality": op6_quality,
    "op7_warc": op7_warc,
    "op8_preference_format": op8_preference_format,
    "op9_source_mix": op9_source_mix,
    "op10_lsh_forest": op10_lsh_forest,
    "op11_token_align": op11_token_align,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_secret_scan": op13_secret_scan,
}

ORACLE = {
    "op7_warc": OP7_SQL,
    "op8_preference_format": OP8_SQL,
    "op9_source_mix": OP9_SQL,
    "op12_hard_negatives": OP12_SQL,
}
