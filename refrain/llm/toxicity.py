"""Toxic passages by maximum-scoring segments over token log-odds.

*Model.* A white-space word is reduced to its letters and digits in lower case; its stem is the first STEM letters.
For words and stems the number of toxic and of clean training documents that contain them is counted in Spark, over
at most about MAX_ROWS training rows (a documented bound: by a hash of the id, so that texts need no shuffle to meet
their labels); copies of a toxic document must not vouch for its words, so a token counts for no more toxic
documents than it has different pairs of neighbours in them. The score of a token is its log-odds ratio under a Dirichlet prior that adds up to PRIOR documents (fewer
for few labels) with the pooled rate of the token, less DRIFT; it is kept where it is positive and the ratio is at least Z_LEAST standard
deviations above zero; the model is bounded by the vocabulary of the MAX_ROWS training rows. A word
without a score of its own takes its stem's; any other word costs DRIFT.

*Scan.* The maximal scoring segments of a text (all of them, in linear time: a stack of candidates whose links skip
those that cannot be extended) are its toxic passages. Under clean text the best segment of ``m`` words follows an
extreme-value law, ``P(S >= s) = 1 - exp(-K m exp(-lambda s))``: lambda solves ``sum(p(s) exp(lambda s)) = 1`` for the
clean token distribution and K is read off clean documents that the token counts have not seen. All segments of a text
are summed on that scale, and a logistic curve fitted on the same unseen documents turns the resulting p-value into
the probability of the label.

Defined cases: a null or empty text has no words and gets the score of a text without any segment; null ids, null
labels and labels other than 0 and 1 are not used; without labels of both kinds every score is the share of toxic labels
(0 without labels); repeated rows get equal scores; an empty table gives an empty table. The result holds the id and
the operator's own columns only, so other input columns cannot clash.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refrain.llm.common import WordTable, id_fold, released, slices, text_or_empty
from refrain.session import staged

STEM = 4
PRIOR = 100.0
Z_LEAST = 1.96
DRIFT = 2.0
CALIBRATION = 5  # one in so many training rows calibrates, the others count tokens
SIGNIFICANT = 0.05
STRONG = 12.0  # powers of ten
THRESHOLD = 0.7
FOLDS, HELD_OUT = 3, 1
MAX_ROWS = 50_000  # labelled rows that train the model
FLUSH_TOKENS = 300_000

_LETTERS = re.compile(r"[^\W_]+")


def core(word: bytes) -> str:
    return "".join(_LETTERS.findall(word.decode("utf-8", "replace").lower()))


def tokens_of(word: bytes) -> tuple[str, str | None]:
    """The word's token and its stem's token, if it is longer than a stem."""
    letters = core(word)
    return "=" + letters, ("~" + letters[:STEM] if len(letters) > STEM else None)


@dataclass
class Model:
    scores: dict[str, float] = field(default_factory=dict)
    lam: float = 1.0
    log_k: float = 0.0
    slope: float = 0.0
    intercept: float = -35.0

    def word_score(self, word: bytes) -> tuple[float]:
        own, stem = tokens_of(word)
        return (self.scores.get(own, self.scores.get(stem, -DRIFT) if stem else -DRIFT),)

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Of the label, for ``x = log(sum(exp(lambda s)) / m)``; ``x`` is -inf where there is no segment."""
        return 1.0 / (1.0 + np.exp(-np.clip(self.intercept + self.slope * surprise(x, self.log_k), -35, 35)))


def surprise(x, log_k: float):
    """-log10 of the extreme-value p-value, on a logarithmic scale beyond STRONG."""
    below = log_k - np.asarray(x, float)
    value = np.where(below < -30, -below / np.log(10), -np.log10(np.maximum(-np.expm1(-np.exp(np.clip(below, -30, 60))), 1e-300)))
    return np.where(value > STRONG, STRONG + np.log1p(np.maximum(value - STRONG, 0)), value)


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments: ``(first, last, score)`` in order of place."""
    up = np.nonzero(scores > 0)[0]
    if not len(up):
        return []
    total = np.cumsum(scores)
    stack: list[tuple[int, int, float, float, int]] = []  # first, last, total before, total after, link
    for i, before, after in zip(up.tolist(), (total[up] - scores[up]).tolist(), total[up].tolist()):
        first, j = i, len(stack) - 1
        while True:
            while j >= 0 and stack[j][2] >= before:
                j = stack[j][4]  # everything in between starts at least as high
            if j < 0 or stack[j][3] >= after:
                stack.append((first, i, before, after, j))
                break
            first, _, before, _, link = stack[j]
            del stack[j:]
            j = link
    return [(first, last, after - before) for first, last, before, after, _ in stack]


def statistic(found: list[tuple[int, int, float]], n_words: int, lam: float) -> float:
    if not found:
        return -np.inf
    s = lam * np.array([x[2] for x in found])
    return float(s.max() + np.log(np.exp(s - s.max()).sum()) - np.log(n_words))


@released
def _count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``token, toxic, clean, clean_uses`` of a part of the training documents; the rows of a token are added up later."""
    ids: dict[str, int] = {}

    def numbers(word: bytes) -> tuple[int, int]:
        own, stem = tokens_of(word)
        return ids.setdefault(own, len(ids)), -1 if stem is None else ids.setdefault(stem, len(ids))

    words, counts = WordTable(numbers, [np.int64, np.int64], FLUSH_TOKENS), np.zeros((3, 0), np.int64)

    def flush() -> pa.RecordBatch:
        names = pa.array(ids, pa.string())
        grown = np.pad(counts, ((0, 0), (0, len(ids) - counts.shape[1])))
        return pa.RecordBatch.from_arrays([names, *map(pa.array, grown)], ["token", "toxic", "clean", "clean_uses"])

    for batch in batches:
        for text, y in zip(chain.from_iterable(slices(batch.column("text"))), batch.column("y").to_pylist()):
            codes = words.codes(text.encode())
            own, stem = (c[codes] for c in words.columns)
            both = np.concatenate([own, stem[stem >= 0]])
            at, uses = np.unique(both, return_counts=True)
            if counts.shape[1] < len(ids):
                counts = np.pad(counts, ((0, 0), (0, 2 * len(ids) - counts.shape[1])))
            counts[0 if y else 1, at] += 1
            if not y:
                counts[2, at] += uses
            if len(ids) > FLUSH_TOKENS:
                counts = counts[:, : len(ids)]
                yield flush()
                ids.clear(), words.clear()
                counts = np.zeros((3, 0), np.int64)
    counts = counts[:, : len(ids)]
    yield flush()


def _contexts(chosen: set[str]):
    """Every use of a chosen token with a hash of the words beside it."""

    @released
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = {token: i for i, token in enumerate(sorted(chosen))}
        names = pa.array(ids, pa.string())

        def numbers(word: bytes) -> tuple[int, int, int]:
            own, stem = tokens_of(word)
            return ids.get(own, -1), ids.get(stem, -1), zlib.crc32(own.encode())

        words = WordTable(numbers, [np.int64] * 3)
        for batch in batches:
            tokens, near = [], []
            for text in chain.from_iterable(slices(batch.column("text"))):
                words.trim()
                codes = words.codes(text.encode())
                if not len(codes):
                    continue
                own, stem, h = (c[codes] for c in words.columns)
                beside = (np.concatenate([[0], h[:-1]]) << 31) ^ np.concatenate([h[1:], [0]])
                for kind in (own, stem):
                    at = np.nonzero(kind >= 0)[0]
                    tokens.append(kind[at]), near.append(beside[at])
            both = np.unique(np.stack([np.concatenate(tokens), np.concatenate(near)]), axis=1) if tokens else np.zeros((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(both[0])), pa.array(both[1])], ["token", "near"])

    return look


def log_odds(counts: DataFrame, n_toxic: int, n_clean: int) -> DataFrame:
    """``token, score, z`` of the tokens that are surely more frequent in toxic documents."""
    y1, y0 = F.col("toxic"), F.col("clean")
    rows = n_toxic + n_clean
    added = PRIOR * rows / (rows + 50 * PRIOR)
    prior = F.lit(added) * (y1 + y0) / F.lit(float(rows))
    odds = lambda y, n: F.log((y + prior) / (F.lit(n + added) - y - prior))
    scored = counts.filter("toxic > 0").withColumn("score", odds(y1, n_toxic) - odds(y0, n_clean))
    scored = scored.withColumn("z", F.col("score") / F.sqrt(1 / (y1 + prior) + 1 / (y0 + prior)))
    kept = scored.filter((F.col("z") >= Z_LEAST) & (F.col("score") > DRIFT)).withColumn("prior", prior)
    return kept.withColumn("score", F.col("score") - F.lit(DRIFT))


def solve_lambda(scores: np.ndarray, weights: np.ndarray) -> float:
    """Positive root of ``sum(weights exp(lambda scores)) = 1``; the mean score must be negative."""
    low, high = 0.0, 1.0
    value = lambda lam: float((weights * np.exp(np.minimum(lam * scores, 700))).sum())
    while value(high) < 1 and high < 64:
        low, high = high, 2 * high
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 1 else (low, mid)
    return high


def fit_curve(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Logistic curve through counted points, by Newton steps; the slope isn't negative."""
    a, b = 0.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -35, 35)))
        g = np.array([(n * (p - y)).sum(), (n * (p - y) * x).sum() + ridge * b])
        w = n * p * (1 - p)
        h = np.array([[w.sum() + 1e-6, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + ridge]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -2, 2), max(0.0, b - np.clip(step[1], -2, 2))
    return a, b


def train(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    folds: int = FOLDS, held_out: int | None = HELD_OUT, max_rows: int = MAX_ROWS,
) -> Model:
    """Model from labelled rows whose fold isn't ``held_out`` (all folds if it is None)."""
    fold = id_fold(id_col, folds)
    usable = labels.filter(F.col(label_col).isin(0, 1) & (fold >= 0) & (fold != (-2 if held_out is None else held_out)))
    usable = usable.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    share = max_rows / max(usable.count(), 1)
    if share < 1:
        usable = usable.filter(F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    part = F.pmod(F.xxhash64(F.lit("calibrate"), "id"), F.lit(CALIBRATION)) == 0
    rows = texts.join(F.broadcast(usable), "id").withColumn("part", part)
    n = {(r["part"], r["y"]): r["count"] for r in rows.groupBy("part", "y").count().collect()}  # labels with a text only
    n_toxic, n_clean = n.get((False, 1), 0), n.get((False, 0), 0)
    every = sum(n.values())
    share = sum(v for (_, y), v in n.items() if y) / every if every else 0.0
    base = float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
    if not n_toxic or not n_clean:
        return Model(intercept=base)
    counted = rows.filter(~F.col("part")).select("text", "y").mapInArrow(_count_tokens, "token string, toxic long, clean long, clean_uses long")
    counted = staged(counted.groupBy("token").agg(*[F.sum(c).alias(c) for c in ("toxic", "clean", "clean_uses")]), "toxic-counts")
    words = counted.filter(F.col("token").startswith("=")).agg(F.sum("clean_uses")).first()[0] or 1
    first = {r["token"] for r in log_odds(counted, n_toxic, n_clean).select("token").collect()}  # tokens of at most MAX_ROWS texts
    uses = rows.filter(~F.col("part") & (F.col("y") == 1)).select("text").mapInArrow(_contexts(first), "token string, near long")
    uses = uses.distinct().groupBy("token").agg(F.count(F.lit(1)).alias("uses"))
    counted = counted.join(uses, "token").withColumn("toxic", F.least("toxic", "uses")).drop("uses")
    best = log_odds(counted, n_toxic, n_clean).orderBy("token").collect()
    if not best:
        return Model(intercept=base)
    model = Model({r["token"]: r["score"] for r in best})
    own = [r for r in best if r["token"].startswith("=")] or best
    s, p = np.array([r["score"] for r in own]), np.array([(r["clean_uses"] + r["prior"]) / words for r in own])
    rest = max(1 - p.sum(), 1e-9)
    model.lam = solve_lambda(np.append(s, -DRIFT), np.append(p, rest)) if (s * p).sum() < rest * DRIFT else 1.0
    # what clean and toxic documents reach that have not been counted
    seen = scan(rows.filter("part").select("id", "text", "y"), model, id_col="id", text_col="text", keep=["y"])
    bins = seen.groupBy("y", F.round("x", 1).alias("x")).count().collect()  # the bins of a short range
    y, x, c = (np.array(v, float) for v in zip(*[(r["y"], -np.inf if r["x"] is None else r["x"], r["count"]) for r in bins])) if bins else (np.zeros(0),) * 3
    reached = [v for v, t in zip(x, y) if t and np.isfinite(v)]
    if not reached:
        model.intercept = base
        return model
    at = float(np.median(reached)) - 1.0
    rate = (c[(y == 0) & (x >= at)].sum() + 0.5) / (c[y == 0].sum() + 1.0)
    model.log_k = float(np.log(-np.log1p(-min(rate, 0.99))) + at)
    model.intercept, model.slope = fit_curve(surprise(x, model.log_k), y, c)
    return model


def scan(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``id, x, n_words, passages``: the significant passages by word position, and the text's statistic (null: no segment)."""
    kind = pa.struct([("x", pa.float64()), ("n_words", pa.int32()), ("passages", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64())])))])

    @F.arrow_udf("struct<x: double, n_words: int, passages: array<struct<first: int, last: int, score: double>>>")
    @released
    def look(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = WordTable(model.word_score, [np.float64])
        for texts in batches:
            out = []
            for text in chain.from_iterable(slices(texts)):
                words.trim()
                codes = words.codes(text.encode())
                found = segments(words.columns[0][codes])
                x = statistic(found, len(codes), model.lam)
                least = (model.log_k + np.log(max(len(codes), 1)) - np.log(SIGNIFICANT)) / model.lam
                passages = [{"first": a, "last": b, "score": s} for a, b, s in found if s >= least]
                out.append({"x": x if np.isfinite(x) else None, "n_words": len(codes), "passages": passages})
            yield pa.array(out, kind)

    return docs.select(id_col, *(keep or []), look(text_or_empty(text_col)).alias("_s")).select(id_col, *(keep or []), "_s.x", "_s.n_words", "_s.passages")


def probability(model: Model, x: Column) -> Column:
    """``Model.probability`` as a Spark expression."""
    below = F.lit(model.log_k) - x
    e = F.exp(F.least(F.greatest(below, F.lit(-30.0)), F.lit(60.0)))
    p = F.greatest(-F.expm1(-e), F.lit(1e-300))
    value = F.when(below < -30, -below / F.lit(float(np.log(10)))).otherwise(-F.log10(p))
    value = F.when(value > STRONG, STRONG + F.log1p(value - STRONG)).otherwise(value)
    value = F.when(x.isNull(), F.lit(float(surprise(-np.inf, model.log_k)))).otherwise(value)
    z = F.least(F.greatest(F.lit(model.intercept) + F.lit(model.slope) * value, F.lit(-35.0)), F.lit(35.0))
    return 1 / (1 + F.exp(-z))


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """``id, held_out, score, predicted, passages`` of every document."""
    model = train(docs, labels, id_col=id_col, text_col=text_col, folds=folds, held_out=held_out)
    found = scan(docs, model, id_col=id_col, text_col=text_col).withColumn("score", probability(model, F.col("x")))
    return found.select(id_col, (id_fold(id_col, folds) == held_out).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "passages")
