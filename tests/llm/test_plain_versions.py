"""The learners against plain versions: one number at a time, no arrays, no shards of work."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from refrain.llm import quality, toxicity


# ---------------------------------------------------------------- 6
def plain_ftrl(rows, seed, epochs):
    """Follow the regularised leader, coordinate by coordinate."""
    z, n = defaultdict(float), defaultdict(float)
    bias = 2**quality.BITS

    def weight(i):
        if abs(z[i]) <= quality.L1:
            return 0.0
        return -(z[i] - math.copysign(quality.L1, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            at, x, y = rows[k]
            row = {int(i): float(v) for i, v in zip(at, x)} | {bias: 1.0}
            w = {i: weight(i) for i in row}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in row.items())))
            for i, v in row.items():
                g = (p - y) * v
                s = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality.ALPHA
                z[i] += g - s * w[i]
                n[i] += g * g
    return {i: weight(i) for i in z}


def test_sparse_learner_equals_the_plain_one():
    draw = random.Random(3)
    rows = []
    for _ in range(80):
        at = np.array(sorted(draw.sample(range(300), draw.randint(0, 25))), np.int32)
        uses = np.array([draw.randint(1, 4) for _ in at], np.int32)
        rows.append((at, quality.SCALE * uses / max(uses.sum(), 1), int(draw.random() < 0.4)))
    w = quality.train_ftrl(rows, seed=5, epochs=3)
    want = plain_ftrl(rows, 5, 3)
    assert {int(i) for i in np.nonzero(w)[0]} == {i for i, v in want.items() if v}
    assert all(w[i] == pytest.approx(v, abs=1e-12) for i, v in want.items())


def test_rows_of_a_shard_come_in_order_of_id_with_relative_frequencies():
    shard = pa.table({"id": ["b", "a", "c"], "y": pa.array([1, 0, 1], pa.int32()), "at": pa.array([[5, 9], [2], []], pa.list_(pa.int32())), "n": pa.array([[1, 3], [7], []], pa.list_(pa.int32()))})
    rows = quality.SparseRows(shard)
    assert [(a.tolist(), x.tolist(), y) for a, x, y in (rows[i] for i in range(len(rows)))] == [([2], [16.0], 0), ([5, 9], [4.0, 12.0], 1), ([], [], 1)]


def plain_grams(text):
    """Coordinates of a text's n-grams, from the words' hashes one by one."""
    words = [quality.word_forms(w) for w in text.encode().split()]
    mask = 2**64 - 1
    second, mix = int(quality._SECOND), int(quality._MIX)
    core = [c for c, _ in words]
    form = [f ^ second if i and core[i] == core[i - 1] else f for i, (_, f) in enumerate(words)]
    marked = core + form + [(a * second + b) & mask for some in (core, form) for a, b in zip(some, some[1:])] + [1 for a, b in zip(core, core[1:]) if a == b]
    return sorted(((m * mix) & mask) >> (64 - quality.BITS) for m in marked)


def test_ngrams_equal_the_plain_ones():
    memo = quality.WordForms()
    for text in ("", "one", "The the THE cat, cat! sat", "a b a b a b", "ÄÖ 漢字 x-y " * 5, "!!!! " * 9):
        assert sorted(quality.hashed_ngrams(text.encode(), memo).tolist()) == plain_grams(text)


def test_long_forms_keep_their_shape():
    assert quality.word_forms(b"!?" * 20) != quality.word_forms(b"!?" * 30)
    assert quality.word_forms(b"-" * 20) == quality.word_forms(b"-" * 30)


# ---------------------------------------------------------------- 3
def plain_tokens(text):
    for word in text.split():
        letters = "".join(re.findall(r"[^\W_]+", word.lower()))
        yield "=" + letters, ("~" + letters[: toxicity.STEM] if len(letters) > toxicity.STEM else None)


def batches(rows, *names):
    for at in range(0, len(rows), 7):
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[at : at + 7])], list(names))


@pytest.fixture(scope="module")
def labelled():
    draw = random.Random(6)
    words = [f"word{i}" if i % 3 else f"w{i}!" for i in range(60)] + ["Über", "a", "--"]
    return [(" ".join(draw.choice(words) for _ in range(draw.randint(0, 30))), int(draw.random() < 0.3)) for _ in range(50)]


@pytest.mark.parametrize("flush", [300_000, 20])
def test_token_counts_equal_plain_ones(labelled, monkeypatch, flush):
    monkeypatch.setattr(toxicity, "FLUSH_TOKENS", flush)
    got = defaultdict(lambda: [0, 0, 0])
    for batch in toxicity._count_tokens(batches(labelled, "text", "y")):
        for r in batch.to_pylist():
            for k, c in enumerate(("toxic", "clean", "clean_uses")):
                got[r["token"]][k] += r[c]
    want = defaultdict(lambda: [0, 0, 0])
    for text, y in labelled:
        uses = Counter(t for pair in plain_tokens(text) for t in pair if t)
        for token, n in uses.items():
            want[token][0 if y else 1] += 1
            want[token][2] += 0 if y else n
    assert {k: v for k, v in got.items() if any(v)} == dict(want)


def test_contexts_equal_plain_ones(labelled):
    chosen = {"=word1", "~word", "=w3", "=a", "="}
    got = defaultdict(set)
    for batch in toxicity._contexts(chosen)(batches(labelled, "text", "y")):
        for r in batch.to_pylist():
            got[r["token"]].add(r["near"])
    want = defaultdict(set)
    for text, _ in labelled:
        pairs = list(plain_tokens(text))
        for i, pair in enumerate(pairs):
            beside = (pairs[i - 1][0] if i else None, pairs[i + 1][0] if i + 1 < len(pairs) else None)
            for t in pair:
                if t in chosen:
                    want[t].add(beside)
    assert {k: len(v) for k, v in got.items()} == {k: len(v) for k, v in want.items()}


def test_log_odds_equal_the_plain_ones(spark):
    rows = [(f"=t{i}", i % 9, (i * 7) % 40, i) for i in range(60)]
    n1, n0 = 40, 200
    added = toxicity.PRIOR * (n1 + n0) / (n1 + n0 + 50 * toxicity.PRIOR)
    want = {}
    for token, y1, y0, _ in rows:
        a = added * (y1 + y0) / (n1 + n0)
        if y1:
            score = math.log((y1 + a) / (n1 + added - y1 - a)) - math.log((y0 + a) / (n0 + added - y0 - a))
            if score > toxicity.DRIFT and score / math.sqrt(1 / (y1 + a) + 1 / (y0 + a)) >= toxicity.Z_LEAST:
                want[token] = score - toxicity.DRIFT
    got = {r["token"]: r["score"] for r in toxicity.log_odds(spark.createDataFrame(rows, "token string, toxic long, clean long, clean_uses long"), n1, n0).collect()}
    assert got.keys() == want.keys() and want and all(got[k] == pytest.approx(v) for k, v in want.items())


def test_strong_passages_dont_tie(spark):
    model = toxicity.Model(log_k=-3.0, slope=0.5, intercept=-4.0)
    x = [-50.0, -3.0, 5.0, 24.0, 30.0, 60.0, 200.0]
    df = spark.createDataFrame([(v,) for v in x] + [(None,)], "x double")
    got = [r["p"] for r in df.select(toxicity.probability(model, df["x"]).alias("p")).collect()]
    assert np.allclose(got[:-1], model.probability(np.array(x)), atol=1e-12)
    assert got[-1] == pytest.approx(float(model.probability(np.array([-np.inf]))[0]))
    assert all(a < b for a, b in zip(got[1:-1], got[2:-1])) and all(a < b for a, b in zip(x, x[1:]))
