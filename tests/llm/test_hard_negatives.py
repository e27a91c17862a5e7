"""Hard negatives against a plain search over all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from refrain.llm import hard_negatives as hn


def plain(rows, is_anchor, positives=5, negatives=3, low=50, high=95):
    """``rows``: (id, label, list of integers)."""
    out = []
    for a_id, a_label, a in {(i, lab, tuple(q)) for i, lab, q in rows if is_anchor(i)}:
        scored = [(-sum(x * y for x, y in zip(a, q)), i, lab == a_label) for i, lab, q in rows if i != a_id and len(q) == len(a)]
        for s, i, _ in sorted(x for x in scored if x[2])[:positives]:
            band = sorted(x[:2] for x in scored if not x[2] and low * -s <= 100 * -x[0] <= high * -s)
            out += [(a_id, i, k + 1, n, -s, -t) for k, (t, n) in enumerate(band[:negatives])]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, lab, [float(v) for v in q], len(q)) for i, lab, q in rows], "id long, label int, q array<double>, dim int")


def mined(spark, rows, **options):
    return sorted(tuple(r) for r in hn.mine(frame(spark, rows), F.col("id") % 5 == 0, **options).collect())


@pytest.fixture(scope="module")
def clustered():
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(12, 24))
    x = centres[draw.integers(0, 12, 400)] + draw.normal(size=(400, 24)) * 0.4
    x *= draw.choice([0.1, 1, 3], 400)[:, None]  # several length buckets
    x[50:90] = x[50]  # one common vector
    x[91] = 0
    return [(int(i), int(lab), np.floor(256 * v).astype(int).tolist()) for i, lab, v in zip(draw.permutation(400), draw.integers(0, 4, 400), x)]


@pytest.mark.parametrize("block, slice_, bucket", [(8192, 1024, 1024), (64, 16, 10)])
def test_equals_plain_search(spark, clustered, monkeypatch, block, slice_, bucket):
    for name, value in (("BLOCK", block), ("SLICE", slice_), ("BUCKET", bucket)):
        monkeypatch.setattr(hn, name, value)
    assert mined(spark, clustered) == plain(clustered, lambda i: i % 5 == 0)


def test_other_counts_and_band(spark, clustered):
    assert mined(spark, clustered[:120], positives=2, negatives=7, low=20, high=100) == plain(clustered[:120], lambda i: i % 5 == 0, 2, 7, 20, 100)


def test_odd_rows(spark):
    big = [2**40, 3, -(2**41)]
    rows = [
        (0, 1, [3, 4]), (0, 1, [3, 4]), (0, 2, [4, 3]),  # an id three times, two different rows
        (1, 1, [3, 4]), (1, 1, [3, 4]), (2, 2, [2, 3]), (3, 2, [2, 3]), (4, 2, [0, 0]), (5, 1, [0, 0]), (6, 1, [-3, -4]),
        (10, 3, []), (11, 3, []), (12, 4, []), (13, 5, [7]), (15, 5, [7]), (16, 6, [5]),
        (20, 7, big), (21, 7, big), (22, 8, [2**39, 1, -(2**40)]), (23, 8, [2**40, 3, -(2**41) + 2**37]),
    ]
    want = plain(rows, lambda i: i % 5 == 0)
    limit = 2**63 - 1
    assert mined(spark, rows) == [(*r[:4], min(r[4], limit), min(r[5], limit)) for r in want]


def test_quantised_leaves_out_what_cannot_take_part(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [[0.5, -0.001], None, [0.1, None], [nan, 0.0], [inf, 0.0], [1e308, 0.0], [], [1.0, 2.0], [0.004, 1e30], [0.1, 0.2]]
    rows = [(i if i != 7 else None, v, 1 if i != 9 else None, "x", [1.0]) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, place string, q array<double>")
    got = hn.quantised(df, id_col="vec_id", vector_col="embedding", label=F.col("label")).orderBy("id").collect()
    assert [(r["id"], r["label"], r["q"], r["dim"]) for r in got] == [(0, 1, [128.0, -1.0], 2), (6, 1, [], 0), (8, 1, [1.0, 256e30], 2)]


def test_empty_and_lonely(spark):
    assert mined(spark, [(0, 1, [1, 2])]) == []
    assert hn.mine(frame(spark, [(0, 1, [1])]).filter("false"), F.col("id") % 5 == 0).collect() == []


def test_feasible_ranges_hold_every_close_vector():
    draw = np.random.default_rng(1)
    q, p = (v / np.linalg.norm(v, axis=1)[:, None] for v in draw.normal(size=(2, 3000, 3)))
    t = (q * p).sum(axis=1)
    low, high = hn.feasible(q, t)
    assert ((p >= low) & (p <= high)).all()
    assert (high - low).mean() < 1.9


def test_pruning_reads_few_rows():
    """With a close neighbour in the first bucket, most later rows are never scored."""
    draw = np.random.default_rng(2)
    rows = draw.normal(size=(6000, 8))
    rows *= (1000 / np.linalg.norm(rows, axis=1))[:, None]
    rows = np.floor(rows)
    anchors = rows[:20].copy()
    rows[:20] *= 1.05  # the longest rows come first
    seen = []
    best = hn.Best(np.full(20, -np.inf), np.full(20, np.inf), 1)
    hn.search(anchors, lambda a, r: seen.append(len(a) * len(r)) or np.ones((len(a), len(r)), bool), rows, np.arange(6000), best, [np.array([i]) for i in range(20)])
    assert best.id.tolist() == (anchors @ rows.T).argmax(axis=1).tolist()
    assert sum(seen) < 0.4 * 20 * 6000
