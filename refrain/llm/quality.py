"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader.

A white-space word is read as two tokens: its *core* (letters and digits, lower case) and its *form* (case pattern
and the punctuation around the core, marked when the core repeats the word before). Unigrams and bigrams of both
streams are hashed to 2^BITS coordinates; a row is the sparse vector of their relative frequencies times SCALE.

Training follows the FTRL-proximal update (per-coordinate rates, L1 and L2) on labelled rows, at most about
``max_rows`` of them, taken by a hash of the id. The rows are dealt to ``shards`` by another hash; each shard is one
sequential pass sequence over a bounded number of sparse rows, and the shards' weights are averaged. Scoring is one
sparse dot product per text, over the whole text, without any shuffle; the weights (2^BITS doubles) are the only
thing sent to the tasks.

Defined cases: a null or empty text has no n-grams, so its score is the bias alone; a null id is neither used for
training nor held out; labels that are null or other than 0 and 1, or that belong to no text, are not used; with no
usable label every score is 0.5; repeated rows get equal scores; an empty table gives an empty table. The result
has the id and the columns ``held_out, score, predicted`` only, so other input columns cannot clash.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refrain.llm.common import WordTable, id_fold, released, slices, text_or_empty

BITS = 18
SCALE = 16.0
MAX_ROWS = 20_000
SHARDS = 8
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.1
THRESHOLD = 0.7
FOLDS, HELD_OUT = 4, 2
STEP = 256  # texts whose features are made at a time

_MIX, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_CORE = re.compile(r"[^\W_]+")


def _h(token: str) -> int:
    raw = token.encode()
    return zlib.crc32(raw) << 32 | zlib.crc32(raw, 0x5BD1E995)


def word_forms(word: bytes) -> tuple[int, int]:
    """Hashes of a word's core and form."""
    text = word.decode("utf-8", "replace")
    core = "".join(_CORE.findall(text))
    case = "U" if core.isupper() and len(core) > 1 else "T" if core[:1].isupper() else "l" if core.islower() else "d" if core.isdigit() else "m" if core else ""
    around = _CORE.sub("w", text)
    if len(around) > 12:  # a long run of one sign counts as one form
        around = re.sub(r"(.)\1+", r"\1+", around)
    return _h("c" + core.lower()), _h("f" + case + around)


def WordForms() -> WordTable:
    return WordTable(word_forms, [np.uint64, np.uint64])


def hashed_ngrams(raw: bytes, memo: WordTable) -> np.ndarray:
    """Coordinates of all n-grams of a text, with repeats."""
    memo.trim()
    words = memo.codes(raw)
    if not len(words):
        return np.zeros(0, np.int64)
    core, form = (column[words] for column in memo.columns)
    again = np.concatenate([[False], core[1:] == core[:-1]])
    form = np.where(again, form ^ _SECOND, form)
    pairs = [core[:-1] * _SECOND + core[1:], form[:-1] * _SECOND + form[1:]]
    marked = np.concatenate([core, form, *pairs, again[again].astype(np.uint64)])
    return ((marked * _MIX) >> np.uint64(64 - BITS)).astype(np.int64)


def sparse_row(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, n = np.unique(grams, return_counts=True)
    return at, SCALE * n / max(len(grams), 1)


class SparseRows:
    """Rows of a shard, ``(coordinates, values, label)`` each, over the flat columns ``at`` and ``n`` (uses of a coordinate)."""

    def __init__(self, shard: pa.Table):
        shard = shard.sort_by("id")  # the same order whatever the shuffle delivered
        at, n = (shard.column(c).combine_chunks() for c in ("at", "n"))
        self.at, self.n, self.y = at.flatten().to_numpy(), n.flatten().to_numpy(), shard.column("y").to_numpy()
        self.upto = np.concatenate([[0], np.cumsum(at.value_lengths().to_numpy(zero_copy_only=False))])

    def __len__(self) -> int:
        return len(self.y)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray, int]:
        own = slice(self.upto[i], self.upto[i + 1])
        return self.at[own], SCALE * self.n[own] / max(self.n[own].sum(), 1), int(self.y[i])


def train_ftrl(rows: Sequence[tuple[np.ndarray, np.ndarray, int]], seed: int = 0, epochs: int = EPOCHS) -> np.ndarray:
    """Weights after ``epochs`` passes over ``(coordinates, values, label)``; the last weight is the bias."""
    z, n = np.zeros(2**BITS + 1), np.zeros(2**BITS + 1)
    order = np.random.default_rng(seed)
    bias = 2**BITS

    def weights(at):
        zi = z[at]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x, y = rows[i]
            at, x = np.append(at, bias), np.append(x, 1.0)
            w = weights(at)
            g = (1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            s = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - s * w
            n[at] += g * g
    return weights(np.arange(2**BITS + 1))


def score_of(grams: np.ndarray, weights: np.ndarray) -> float:
    dot = weights[-1] + (SCALE * weights[grams].sum() / len(grams) if len(grams) else 0.0)
    return float(1.0 / (1.0 + np.exp(-np.clip(dot, -35, 35))))


def _usable(labels: DataFrame, id_col: str, label_col: str, folds: int, held_out: int) -> DataFrame:
    fold = id_fold(id_col, folds)
    ok = F.col(label_col).isin(0, 1) & (fold >= 0) & (fold != held_out)
    return labels.filter(ok).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))


def train(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    folds: int = FOLDS, held_out: int = HELD_OUT, max_rows: int = MAX_ROWS, shards: int = SHARDS,
) -> np.ndarray:
    """Averaged weights from labelled rows whose fold is not ``held_out`` (all folds if ``held_out`` is None)."""
    usable = _usable(labels, id_col, label_col, folds, -2 if held_out is None else held_out)
    pick = F.xxhash64(F.lit("sample"), F.col("id"))
    share = max_rows / max(usable.count(), 1)
    if share < 1:
        usable = usable.filter(F.pmod(pick, F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).join(F.broadcast(usable), "id")
    rows = rows.select(F.col("id").cast("string").alias("id"), "y", "text", F.pmod(F.xxhash64(F.lit("shard"), "id"), F.lit(shards)).cast("int").alias("shard"))

    @released
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordForms()
        for batch in batches:
            for i, texts in enumerate(slices(batch.column("text"), STEP)):
                got = [np.unique(hashed_ngrams(t.encode(), memo), return_counts=True) for t in texts]
                lists = [pa.array([g[k].astype(np.int32) for g in got], pa.list_(pa.int32())) for k in (0, 1)]
                own = [batch.column(c).slice(i * STEP, STEP) for c in ("shard", "id", "y")]
                yield pa.RecordBatch.from_arrays([*own, *lists], ["shard", "id", "y", "at", "n"])

    def learn(key: tuple, shard: pa.Table) -> pa.Table:
        w = train_ftrl(SparseRows(shard), seed=key[0].as_py())
        at = np.nonzero(w)[0]
        # coordinate -1 counts the shards
        return pa.table({"at": np.append(at, -1), "w": np.append(w[at], 1.0)})

    sparse = rows.mapInArrow(features, "shard int, id string, y int, at array<int>, n array<int>")
    parts = sparse.groupBy("shard").applyInArrow(learn, "at bigint, w double")
    sums = dict(parts.groupBy("at").agg(F.sum("w").alias("w")).collect())  # at most 2^BITS + 2 rows
    learned = sums.pop(-1, 1.0)
    weights = np.zeros(2**BITS + 1)
    for at, w in sums.items():
        weights[at] = w / learned
    return weights


def score(docs: DataFrame, weights: np.ndarray, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``id``, the columns in ``keep``, ``score`` of every row."""

    @F.arrow_udf("double")
    @released
    def dot(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memo = WordForms()
        for texts in batches:
            yield pa.array([score_of(hashed_ngrams(t.encode(), memo), weights) for some in slices(texts) for t in some], pa.float64())

    return docs.select(id_col, *(keep or []), dot(text_or_empty(text_col)).alias("score"))


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", folds: int = FOLDS, held_out: int = HELD_OUT, **options) -> DataFrame:
    """``id, held_out, score, predicted`` of every document, learned from the labels outside the held-out fold."""
    weights = train(docs, labels, id_col=id_col, folds=folds, held_out=held_out, **options)
    scored = score(docs, weights, id_col=id_col)
    return scored.select(id_col, (id_fold(id_col, folds) == held_out).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
