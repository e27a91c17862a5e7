"""Text vectors.

TF-IDF fitted on the corpus itself, the same weighting as a sublinear-tf,
smoothed-idf vectoriser with unigrams + bigrams and a 512-term vocabulary:

    w(d, t) = (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1),  then L2 per document.

Vectors are kept sparse: one row per document with sorted ``idx`` / ``val``
arrays (a document with no vocabulary term is the zero vector, empty arrays).
Dense inputs (``ARRAY<FLOAT>``) use the same shape with ``idx = 0..d-1``.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from refrain.operators.memory import released
from refrain.session import staged

# Fixed values of the vectoriser: runs of >= 2 word characters, 512 terms.
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"
VOCAB_SIZE = 512
PLAIN = 0x180  # Latin letters up to here have lower cases of the same width, except one
RARE = r"[^\x{00}-\x{12F}\x{131}-\x{17F}]"  # a character that is not plain
TRACKED = 200_000  # terms in a summary
SPARE = 4  # candidates per term of the vocabulary
CANDIDATES = 200_000  # tokens that every task is sent to count them
KEYS = 1 << 22  # numbers that are counted in an array
SPLIT_ROWS = 256  # texts that are split at once
CODED_TOKENS = 1 << 20  # tokens of a coded row, unless one document has more
COUNTED_TOKENS = 1 << 18  # tokens whose terms are counted at once
CODED_BYTES = 6 << 20  # text that is coded at once: nearly so many tokens
BUCKET_TERMS = 1 << 21  # counts of terms that one group sums, on average at most


def tokens(text) -> "F.Column":
    """Lower-case, runs of two or more letters/digits/underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), 0)


def with_ngrams(toks) -> "F.Column":
    """Unigrams followed by adjacent pairs joined by one space (no shuffle)."""
    n = F.size(toks)
    bigrams = F.when(
        n > 1,
        F.zip_with(F.slice(toks, 1, n - 1), F.slice(toks, 2, n - 1), lambda a, b: F.concat(a, F.lit(" "), b)),
    ).otherwise(F.array().cast("array<string>"))
    return F.concat(toks, bigrams)


def term_frequencies(docs: DataFrame, key: str = "doc", text: str = "text") -> DataFrame:
    """A13 (tf): one row per (document, term) with its count.

    A document without any token keeps one row with a NULL term, so the
    document list and count can be read from this table alone. The map-side partial aggregate collapses repeats inside a document before
    the shuffle, so the exchange carries distinct (doc, term) pairs only.
    """
    # tokens are projected once, then unigrams+bigrams are generated from the column
    # (inlined into the generator, the regex would run once per reference)
    toks = docs.select(F.col(key).alias("doc"), tokens(F.col(text)).alias("toks"))
    return (
        toks.select("doc", F.explode_outer(with_ngrams(F.col("toks"))).alias("term"))
        .groupBy("doc", "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def term_statistics(tf: DataFrame) -> DataFrame:
    """Corpus frequency and document frequency per term."""
    return tf.filter(F.col("term").isNotNull()).groupBy("term").agg(F.sum("tf").alias("cf"), F.count(F.lit(1)).alias("df"))


def vocabulary(stats: DataFrame, n_docs, size: int = VOCAB_SIZE) -> DataFrame:
    """Top ``size`` terms by corpus frequency (ties: term ascending), with idf and index.

    ``n_docs`` is a Column (a scalar subquery) or a number. The result has at
    most ``size`` rows, so it is safe to broadcast.
    """
    top = stats.orderBy(F.desc("cf"), F.asc("term")).limit(size)
    w = Window.orderBy("term")  # <= size rows: a single small partition
    return top.select(
        "term",
        "cf",
        "df",
        (F.row_number().over(w) - 1).cast("int").alias("idx"),
        (F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)).alias("idf"),
    )


def frequent_candidates(terms: DataFrame, size: int, tracked: int = TRACKED) -> tuple[DataFrame, float]:
    """``term`` of the candidates for the ``size`` most frequent ones, and a number that no other term's count exceeds.

    A summary that tracks ``m`` items misjudges a count by at most ``n / slots * 3.5`` of ``n`` in all, with ``slots`` the power of two
    from ``m / 0.75`` on; terms it doesn't return may have twice that, or as much as the last one that it returns.
    """
    k = SPARE * size
    found = terms.agg(F.expr(f"approx_top_k(term, {k}, {max(tracked, k)})").alias("top"), F.count("term").alias("n")).first()
    top = found["top"] or []
    slots = 1 << math.ceil(math.log2(max(tracked, k) / 0.75))
    unseen = 2 * 3.5 * found["n"] / slots
    if len(top) >= k:
        unseen = max(unseen, float(min(t["count"] for t in top)))
    return terms.sparkSession.createDataFrame([(t["item"],) for t in top], "term string"), unseen


def spread_by_doc(docs: DataFrame, key: str = "doc") -> DataFrame:
    """Hash-partition the corpus by document.

    Every later per-document step (tf count, weighting, packing) then needs no
    further exchange: HashPartitioning(doc) already clusters (doc, term). It
    also spreads a corpus stored in few row groups over all cores.
    """
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return docs.repartition(parts, key)


def spread_if_uneven(docs: DataFrame, table: DataFrame, key: str = "doc") -> DataFrame:
    """``spread_by_doc``, unless the scan of ``table``, which ``docs`` come from, deals its rows to half of the cores at least.

    The rows of each split are counted without reading a column. Where they are even no text crosses the network.
    """
    sizes = [r["count"] for r in table.groupBy(F.spark_partition_id().alias("split")).count().collect()]
    cores = table.sparkSession.sparkContext.defaultParallelism
    return docs if 2 * sum(sizes) >= cores * max(sizes, default=1) else spread_by_doc(docs, key)


def _lists(**columns: pa.Array) -> pa.RecordBatch:
    """One row whose columns are lists of the given values."""
    return pa.RecordBatch.from_pydict({k: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for k, v in columns.items()})


def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    """C1 for the characters of PLAIN by code point: which are letters, digits or underscores, and their lower case."""
    chars = [chr(i) for i in range(PLAIN)]
    word = np.array([c == "_" or unicodedata.category(c)[0] in "LN" for c in chars])
    lower = np.array([ord(c.lower()[0]) for c in chars], np.uint16)
    return word, lower


def plain_tokens(text: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """C1 of texts whose characters are all below PLAIN: the number of tokens of each text, and all tokens in order.

    Such characters have one or two bytes in UTF-8, and as many in lower case.
    """
    word_of, lower_of = _byte_tables()
    text = pa.concat_arrays([text.cast(pa.large_string())])
    at = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    raw = np.frombuffer(text.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    at = at - at[0]
    ascii_word, ascii_lower = np.zeros(256, bool), np.arange(256, dtype=np.uint8)
    ascii_word[:0x80], ascii_lower[:0x80] = word_of[:0x80], lower_of[:0x80]
    word, low = ascii_word[raw], ascii_lower[raw]  # by byte; those of two bytes follow
    two = np.nonzero(raw >= 0xC0)[0]
    char = (raw[two].astype(np.uint16) & 0x1F) << 6 | raw[two + 1] & 0x3F
    word[two] = word[two + 1] = word_of[char]
    char = lower_of[char]
    low[two], low[two + 1] = 0xC0 | char >> 6, 0x80 | char & 0x3F
    starts = at[:-1][np.diff(at) > 0]
    beside = np.zeros(len(raw), bool)  # whether the byte before, then after, is of the same text and a word's
    beside[1:] = word[:-1]
    beside[starts] = False
    begin = np.nonzero(word > beside)[0]
    beside[:-1], beside[-1:] = word[1:], False
    beside[starts[1:] - 1] = False
    end = np.nonzero(word > beside)[0] + 1
    long = (end - begin > 2) | (end - begin == 2) & (raw[begin] < 0x80)
    word[begin[~long]] = word[end[~long] - 1] = False
    begin, end = begin[long], end[long]
    offsets = np.append(0, np.cumsum(end - begin)).astype(np.int64)
    toks = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(low[word]))
    return np.diff(np.searchsorted(begin, at)), toks


def _tokens_of(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, pa.Array]:
    """``doc``, the number of tokens of each, and all tokens: first of the plain texts, then of those that Spark has split."""
    plain = pc.is_valid(batch.column("plain"))
    one, two = batch.filter(plain), batch.filter(pc.invert(plain))
    texts = one.column("plain")
    parts = [plain_tokens(texts.slice(a, SPLIT_ROWS)) for a in range(0, max(1, len(texts)), SPLIT_ROWS)]
    lens, toks = np.concatenate([p[0] for p in parts]), pa.concat_arrays([p[1] for p in parts])
    others = pc.fill_null(pc.list_value_length(two.column("toks")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    docs = pa.concat_arrays([one.column("doc"), two.column("doc")])
    return docs, np.append(lens, others), pa.concat_arrays([toks, two.column("toks").flatten().cast(pa.large_string())])


def _cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Pieces of the batch with CODED_BYTES of plain text at most, unless one document has more."""
    ends, a = np.cumsum(pc.fill_null(pc.binary_length(batch.column("plain")), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + CODED_BYTES, "right")))
        yield batch.slice(a, b - a)
        a = b


@released
def _code(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (piece for whole in parts for piece in _cut(whole)):
        docs, lens, toks = _tokens_of(batch)
        ends, a = np.cumsum(lens), 0
        while a < len(lens):
            before = ends[a] - lens[a]
            b = max(a + 1, int(np.searchsorted(ends, before + CODED_TOKENS, "right")))
            coded = toks.slice(before, ends[b - 1] - before).dictionary_encode()
            codes = coded.indices.to_numpy(zero_copy_only=False)
            counts = pa.array(np.bincount(codes, minlength=len(coded.dictionary)).astype(np.int64))
            row = _lists(docs=docs.slice(a, b - a), lens=pa.array(lens[a:b]), terms=coded.dictionary.cast(pa.string()), counts=counts)
            small = codes.astype("<u2" if len(coded.dictionary) <= 1 << 16 else "<u4")
            planes = small.view(np.uint8).reshape(-1, small.itemsize).T  # all first bytes, all second ones: they compress better so
            yield row.append_column("codes", pa.array([planes.tobytes()], pa.binary()))
            a = b


def coded(docs: DataFrame) -> DataFrame:
    """``doc, text`` -> rows of many documents: ``docs, lens`` (tokens of each), ``terms, counts`` (their different tokens) and ``codes``,
    the places in ``terms`` of all tokens in order, by planes of their bytes. The texts are read and split once; all later passes read these rows."""
    kind = docs.schema["doc"].dataType.simpleString()
    # the task splits texts of common characters itself; others (and what is no UTF-8) go through Spark's regex
    rare = F.regexp_like("text", F.lit(RARE))
    toks = docs.select("doc", F.when(~rare, F.col("text")).alias("plain"), F.when(rare, tokens(F.col("text"))).alias("toks"))
    rows = toks.mapInArrow(_code, f"docs array<{kind}>, lens array<bigint>, terms array<string>, counts array<bigint>, codes binary")
    return staged(rows, "coded")


def _decoded(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """``(docs, document of each token, terms, codes)`` of every coded row."""
    for batch in parts:
        for i in range(batch.num_rows):
            one = batch.slice(i, 1)
            raw, terms = one.column("codes")[0].as_buffer(), one.column("terms").flatten()
            lens = one.column("lens").flatten().to_numpy(zero_copy_only=False)
            kind = np.dtype("<u2" if len(terms) <= 1 << 16 else "<u4")
            planes = np.frombuffer(raw, np.uint8).reshape(kind.itemsize, -1)
            codes = np.ascontiguousarray(planes.T).view(kind).ravel().astype(np.int64)
            yield one.column("docs").flatten(), np.repeat(np.arange(len(lens)), lens), terms, codes


def _places(terms: pa.Array, known: list[str]) -> np.ndarray:
    """The place of every term in ``known``, or -1."""
    found = pc.index_in(terms, value_set=pa.array(known, pa.string()))
    return pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64)


def distinct_docs(rows: DataFrame) -> bool:
    """Whether every document has a key, and one of its own."""
    keys = rows.select(F.explode("docs").alias("doc")).groupBy("doc").agg(F.count(F.lit(1)).alias("n"))
    return keys.filter((F.col("n") > 1) | F.col("doc").isNull()).isEmpty()


def _hashes(terms: pa.Array) -> np.ndarray:
    """The same 64 bits for a term in every task."""
    return pd.util.hash_array(terms.to_numpy(zero_copy_only=False), categorize=False) if len(terms) else np.zeros(0, np.uint64)


def _batch_statistics(buckets: int):
    """Counts of each coded row's terms: one row of lists per bucket of terms."""

    @released
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, doc, terms, codes in _decoded(parts):
            n = len(terms)
            if not n:
                continue
            hashed = _hashes(terms)
            same = doc[:-1] == doc[1:]
            n_docs = int(doc[-1]) + 1
            for paired, term, of in ((False, codes, doc), (True, (codes[:-1] * n + codes[1:])[same], doc[:-1][same])):
                key = np.sort(term * n_docs + of)  # all occurrences by term, and by document among them
                if not len(key):
                    continue
                start = np.nonzero(np.diff(key // n_docs, prepend=-1))[0]
                cf = np.diff(start, append=len(key)).astype(np.int64)
                df = np.add.reduceat(np.diff(key, prepend=-1) != 0, start, dtype=np.int64)
                term = key[start] // n_docs
                mixed = hashed[term] if not paired else (hashed[term // n] * np.uint64(0x9E3779B97F4A7C15) ^ hashed[term % n]) * np.uint64(0xC2B2AE3D27D4EB4F)
                bucket = ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                term = term[order]
                text = terms.take(pa.array(term)) if not paired else pc.binary_join_element_wise(terms.take(pa.array(term // n)), terms.take(pa.array(term % n)), " ")
                first = np.nonzero(np.diff(bucket[order], prepend=-1))[0]
                ends = pa.array(np.append(first, len(order)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, v) for v in (text, pa.array(cf[order]), pa.array(df[order]))]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[order][first]), *lists], ["bucket", "terms", "cf", "df"])

    return run


def _bucket_totals(table: pa.Table) -> pa.Table:
    """Sums by term over the lists of a bucket."""
    flat = pa.table({"term": pc.list_flatten(table["terms"]), "cf": pc.list_flatten(table["cf"]), "df": pc.list_flatten(table["df"])})
    return flat.group_by("term", use_threads=False).aggregate([("cf", "sum"), ("df", "sum")]).rename_columns(["term", "cf", "df"])


def corpus_statistics(docs: DataFrame) -> DataFrame:
    """A13 of all terms: ``term, cf, df``. Each task counts its coded rows, so that a term crosses the network once per row that holds it.

    What crosses are lists, one per coded row and bucket of terms. There are as many buckets as keep one at BUCKET_TERMS counts on average.
    """
    rows = coded(docs)
    if not distinct_docs(rows):  # the counts of one document's rows belong together
        return term_statistics(term_frequencies(docs))
    tokens_in = rows.agg(F.sum(F.aggregate("lens", F.lit(0).cast("bigint"), lambda a, x: a + x))).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(2 * tokens_in / BUCKET_TERMS))
    lists = rows.mapInArrow(_batch_statistics(buckets), "bucket int, terms array<string>, cf array<bigint>, df array<bigint>")
    return lists.groupBy("bucket").applyInArrow(_bucket_totals, "term string, cf bigint, df bigint")


def _pair_counts(known: list[str]):
    """Counts of neighbouring tokens that are both ``known``, per task."""

    @released
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(known)
        total = np.zeros(n * n, np.int64)
        for _, doc, terms, codes in _decoded(parts):
            at = _places(terms, known)[codes]
            both = (doc[:-1] == doc[1:]) & (at[:-1] >= 0) & (at[1:] >= 0)
            total += np.bincount(at[:-1][both] * n + at[1:][both], minlength=n * n)
        some = np.nonzero(total)[0]
        yield pa.RecordBatch.from_pydict({"a": some // n, "b": some % n, "cf": total[some]})

    return run


def _most_frequent(size: int):
    """The ``size`` most frequent tokens of each coded row, with their counts."""

    @released
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for i in range(batch.num_rows):
                terms, counts = (batch.column(c).slice(i, 1).flatten() for c in ("terms", "counts"))
                some = np.argsort(-counts.to_numpy(zero_copy_only=False), kind="stable")[:size]
                yield pa.RecordBatch.from_arrays([terms.take(pa.array(some)), counts.take(pa.array(some))], ["term", "cf"])

    return run


def _frequent_somewhere(share: float):
    """The tokens that make at least ``share`` of a coded row's tokens."""

    @released
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for i in range(batch.num_rows):
                terms, counts = (batch.column(c).slice(i, 1).flatten() for c in ("terms", "counts"))
                n = counts.to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([terms.filter(pa.array(n >= share * n.sum()))], ["term"])

    return run


def _token_counts(known: list[str]):
    """Counts of the ``known`` tokens, per task."""

    @released
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(known) + 1, np.int64)  # the last is of all others
        for batch in parts:
            for i in range(batch.num_rows):
                terms, counts = (batch.column(c).slice(i, 1).flatten() for c in ("terms", "counts"))
                np.add.at(total, _places(terms, known), counts.to_numpy(zero_copy_only=False))
        some = np.nonzero(total[:-1])[0]
        yield pa.RecordBatch.from_arrays([pa.array(known, pa.string()).take(pa.array(some)), pa.array(total[some])], ["term", "cf"])

    return run


def frequent_tokens(rows: DataFrame, size: int) -> DataFrame:
    """``term, cf`` of the tokens of the coded rows: of all that are as frequent as the ``size``-th at least, and some others.

    The counts of the ``size`` most frequent tokens of each row give a number that the ``size``-th reaches. A token that reaches
    it makes the same share of some row as it does of all tokens, so only tokens of such a share are counted.
    """
    counts = rows.select("terms", "counts")
    by_row = counts.mapInArrow(_most_frequent(size), "term string, cf bigint").groupBy("term").agg(F.sum("cf").alias("cf"))
    top = by_row.orderBy(F.desc("cf")).limit(size).agg(F.count(F.lit(1)).alias("n"), F.min("cf").alias("least")).first()
    if top["n"] == size:
        n_tokens = counts.agg(F.sum(F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x))).first()[0]
        share = top["least"] / n_tokens * (1 - 1e-9)
        some = counts.mapInArrow(_frequent_somewhere(share), "term string").distinct().limit(CANDIDATES + 1).collect()
        if len(some) <= CANDIDATES:
            known = sorted(r["term"] for r in some)
            return counts.mapInArrow(_token_counts(known), "term string, cf bigint").groupBy("term").agg(F.sum("cf").alias("cf"))
    return counts.select(F.explode(F.arrays_zip("terms", "counts")).alias("e")).groupBy(F.col("e.terms").alias("term")).agg(F.sum("e.counts").alias("cf"))


def frequent_terms(rows: DataFrame, docs: DataFrame, size: int) -> list[str]:
    """The ``size`` most frequent terms of the coded rows (ties: term ascending), in order of term.

    A pair of tokens is never more frequent than either of them, so one of the vocabulary has its tokens among those that are as frequent
    as the ``size``-th. Only these pairs are counted; where too many tokens tie there (tiny corpora), all terms are.
    """
    most = SPARE * size
    best = frequent_tokens(rows, size).orderBy(F.desc("cf"), F.asc("term")).limit(most + 1).collect()
    least = best[size - 1]["cf"] if len(best) >= size else 0
    if len(best) > most and best[-1]["cf"] >= least:
        toks = docs.select("doc", tokens(F.col("text")).alias("toks"))  # projected once, so that the generator does not repeat the regex
        terms = toks.select(F.explode(with_ngrams(F.col("toks"))).alias("term"))
        top = terms.groupBy("term").agg(F.count(F.lit(1)).alias("cf")).orderBy(F.desc("cf"), F.asc("term")).limit(size).collect()
        return sorted(r["term"] for r in top)
    known = sorted(r["term"] for r in best if r["cf"] >= least)
    pairs = rows.mapInArrow(_pair_counts(known), "a bigint, b bigint, cf bigint").groupBy("a", "b").agg(F.sum("cf").alias("cf"))
    # a space sorts before every character of a token, so the order of the pairs is that of their terms
    top = pairs.orderBy(F.desc("cf"), F.asc("a"), F.asc("b")).limit(size).collect() if known else []
    terms = [(-r["cf"], r["term"]) for r in best] + [(-r["cf"], f"{known[r['a']]} {known[r['b']]}") for r in top]
    return sorted(t for _, t in sorted(terms)[:size])


def _counted(key: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The different numbers (from 0 to ``end``) in order, and how often each comes; without a sort where ``end`` allows it."""
    if end > KEYS:
        return np.unique(key, return_counts=True)
    n = np.bincount(key, minlength=end)
    key = np.nonzero(n)[0]
    return key, n[key]


def _term_counts(vocab: list[str]):
    """``doc, idx, tf`` of every document; ``idx`` are places in ``vocab``."""
    known = sorted({w for t in vocab for w in t.split(" ")})
    place = {w: i for i, w in enumerate(known)}
    single, double = np.full(len(known) + 1, -1), np.full((len(known) + 1, len(known) + 1), -1, np.int32)  # -1 is no token's place
    for i, t in enumerate(vocab):
        at = [place[w] for w in t.split(" ")]
        if len(at) == 1:
            single[at[0]] = i
        else:
            double[at[0], at[1]] = i

    def _by_docs(docs: pa.Array, doc: np.ndarray, terms: pa.Array, codes: np.ndarray) -> Iterator[tuple]:
        """Pieces of a coded row with COUNTED_TOKENS at most, unless one document has more; ``terms`` as their places."""
        terms, ends, a = _places(terms, known), np.searchsorted(doc, np.arange(len(docs)), "right"), 0
        while a < len(docs):
            before = ends[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(ends, before + COUNTED_TOKENS, "right")))
            yield docs.slice(a, b - a), doc[before : ends[b - 1]] - a, terms, codes[before : ends[b - 1]]
            a = b

    @released
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, doc, terms, codes in (piece for row in _decoded(parts) for piece in _by_docs(*row)):
            at = terms[codes]
            one, two = single[at], double[at[:-1], at[1:]]
            two[doc[:-1] != doc[1:]] = -1
            key = np.concatenate([(doc * len(vocab) + one)[one >= 0], (doc[:-1] * len(vocab) + two)[two >= 0]])
            key, tf = _counted(key, len(docs) * len(vocab))
            lens = np.bincount(key // max(1, len(vocab)), minlength=len(docs))
            ends = pa.array(np.concatenate([[0], np.cumsum(lens)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in ((key % max(1, len(vocab))).astype(np.int32), tf.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([docs, *lists], ["doc", "idx", "tf"])

    return run


def weights(idx: np.ndarray, tf: np.ndarray, lens: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The components of unit vectors from flat lists of terms and their counts; ``lens`` are the terms of each document."""
    row = np.repeat(np.arange(len(lens)), lens)
    w = (1.0 + np.log(tf.astype(np.int64, copy=False))) * idf[idx]
    return w / np.sqrt(np.bincount(row, weights=w * w, minlength=len(lens)))[row]


def _weigh(idf: np.ndarray):
    @released
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            lists = batch.column("idx")
            lens = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            val = weights(lists.flatten().to_numpy(), batch.column("tf").flatten().to_numpy(), lens, idf)
            ends = pa.array(np.concatenate([[0], np.cumsum(lens)]).astype(np.int32))
            yield batch.append_column("val", pa.ListArray.from_arrays(ends, pa.array(val)))

    return run


def weighed(counted: DataFrame, idf: np.ndarray) -> DataFrame:
    """Rows with ``idx`` and ``tf`` get their ``val``."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in counted.schema.fields)
    return counted.mapInArrow(_weigh(idf), f"{kinds}, val array<double>")


def idf_of(vocab: DataFrame) -> np.ndarray:
    """The weights of the vocabulary's terms (``vocabulary``: a bounded number) by index."""
    return np.array([r["idf"] for r in vocab.select("idf", "idx").orderBy("idx").collect()], np.float64)


def tfidf_vectors(
    docs: DataFrame, key: str = "doc", text: str = "text", size: int = VOCAB_SIZE, spread: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Sparse L2-normalised TF-IDF vectors, one row per document.

    Returns ``(vectors, vocab)``; ``vectors`` has ``doc, idx ARRAY<INT>,
    tf ARRAY<BIGINT>, val ARRAY<DOUBLE>`` with ``idx`` ascending. The counts are written; the weights are made from them where they are read.
    """
    counts, vocab = tfidf_counts(docs, key, text, size, spread)
    return weighed(counts, idf_of(vocab)), vocab


def tfidf_counts(
    docs: DataFrame, key: str = "doc", text: str = "text", size: int = VOCAB_SIZE, spread: bool = True
) -> tuple[DataFrame, DataFrame]:
    """The vectors without their weights (``doc, idx, tf``), and the vocabulary; both are written tables.

    The texts are read once and kept as codes of their tokens (``coded``). From these come the frequent tokens, the frequent pairs
    of such tokens, and then, per document and without a shuffle, the counts of the vocabulary (<= ``size`` terms).
    """
    docs = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"))
    if spread:  # callers whose corpus lies in enough partitions skip this exchange
        docs = spread_by_doc(docs)
    kind = docs.schema["doc"].dataType.simpleString()
    rows = coded(docs)
    counted = f"doc {kind}, idx array<int>, tf array<bigint>"
    tf = staged(rows.mapInArrow(_term_counts(terms := frequent_terms(rows, docs, size)), counted), "tf")
    n_docs = tf.count()
    if not distinct_docs(rows):  # rows with the same key are one document, repeated; those without a key count as one and have no vector
        e = tf.select("doc", F.explode(F.arrays_zip("idx", "tf")).alias("e")).groupBy("doc", F.col("e.idx").alias("idx")).agg(F.sum("e.tf").alias("tf"))
        whole = staged(e.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("idx", "tf"))).alias("e")).select("doc", F.col("e.idx").alias("idx"), F.col("e.tf").alias("tf")), "tf")
        empty = [F.coalesce(c, F.array().cast(t)).alias(c) for c, t in (("idx", "array<int>"), ("tf", "array<bigint>"))]
        tf = staged(tf.select("doc").join(whole, "doc", "left").select("doc", *empty), "tf")
    else:
        whole = tf
    e = whole.select(F.explode(F.arrays_zip("idx", "tf")).alias("e"))
    stats = e.groupBy(F.col("e.idx").alias("idx")).agg(F.sum("e.tf").alias("cf"), F.count(F.lit(1)).alias("df"))
    names = docs.sparkSession.createDataFrame(list(enumerate(terms)), "idx int, term string")
    vocab = staged(vocabulary(stats.join(names, "idx"), F.lit(float(n_docs)), size), "vocabulary")
    return tf.select("doc", "idx", "tf"), vocab


def dense_vectors(df: DataFrame, key: str, vec: str) -> DataFrame:
    """C4: a dense ``ARRAY<FLOAT>`` column in the sparse layout (``idx = 0..d-1``)."""
    v = F.col(vec).cast("array<double>")
    return df.select(
        F.col(key).alias("doc"),
        F.when(F.size(v) > 0, F.sequence(F.lit(0), F.size(v) - 1)).otherwise(F.array().cast("array<int>")).alias("idx"),
        v.alias("val"),
    )


def normalise_dense(df: DataFrame, vec: str) -> DataFrame:
    """C3 for dense input: divide by the L2 norm, zero stays zero."""
    v = F.col(vec).cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    # the norm is repeated once per row and zipped in, so it is not re-evaluated per element
    return df.withColumn("_norm", norm).withColumn(
        vec, F.when(F.col("_norm") > 0, F.zip_with(v, F.array_repeat(F.col("_norm"), F.size(v)), lambda x, n: x / n)).otherwise(v)
    ).drop("_norm")
