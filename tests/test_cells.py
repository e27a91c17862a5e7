"""Metric cells against the block pairs, and what they save."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from refrain.operators import cells, neighbours
from refrain.session import staged


def frame(spark, x, mult=1):
    rows = [(int(i * 7 + 3), mult, [int(k) for k in np.nonzero(v)[0]], [float(t) for t in v[np.nonzero(v)[0]]]) for i, v in enumerate(x)]
    return staged(spark.createDataFrame(rows, "pid bigint, mult bigint, idx array<int>, val array<double>"), "points")


def unit(x):
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


@pytest.fixture(scope="module")
def clustered():
    draw = np.random.default_rng(0)
    centres = draw.normal(size=(40, 16))
    x = centres[draw.integers(0, 40, 900)] + 0.15 * draw.normal(size=(900, 16))
    x[300:600] = centres[0] + 0.1 * draw.normal(size=(300, 16))  # a third of the points in one place
    x[5] = 0
    return unit(x)


def brute(x, similarity):
    d2 = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    return d2 <= neighbours.eps2(similarity)


@pytest.mark.parametrize("similarity, block", [(0.98, 2048), (0.9, 64)])
def test_counts_and_clusters_equal_the_block_form(spark, clustered, similarity, block):
    points = frame(spark, clustered, 2)
    rows, sizes = cells.partition(points, similarity, 900, block, force=True, pivots=12)
    counts = {r["pid"]: r["n_neighbours"] for r in cells.cell_weights(rows, sizes, similarity, block).collect()}
    near = brute(clustered, similarity)
    assert counts == {i * 7 + 3: 2 * int(n) for i, n in enumerate(near.sum(axis=1))}
    for min_samples in (3, 5):  # from 4 on, a border point can lie between clusters
        got = neighbours.dbscan(points, similarity, min_samples, block, cells=True)
        want = neighbours.dbscan(points, similarity, min_samples, block, cells=False)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_close_points_stay_in_few_cells(spark, clustered, monkeypatch):
    monkeypatch.setattr(cells, "CELL", 32)
    assert cells.partition(frame(spark, clustered), 0.98, 900, 2048) is None  # a single block: nothing to save
    rows, sizes = cells.partition(frame(spark, clustered), 0.995, 900, 64)
    total = sizes.agg(F.sum("members").alias("copies"), F.sum(F.col("own") * F.col("members")).alias("pairs")).first()
    assert total["copies"] < 0.25 * 900 * neighbours.block_count(900, 64)
    # a wide radius in many dimensions sends everything everywhere, so the block pairs are kept
    spread = unit(np.random.default_rng(1).normal(size=(600, 60)))
    assert cells.partition(frame(spark, spread), 0.4, 600, 200) is None


def test_few_and_equal_points(spark):
    for x in (np.zeros((1, 3)), unit(np.eye(3)), np.zeros((0, 3))):
        points = frame(spark, x)
        assert neighbours.dbscan(points, 0.9, 1, cells=True).count() == len(x)


@pytest.mark.parametrize("finish", [10**6, 0])
def test_components_in_one_task_or_in_rounds(spark, monkeypatch, finish):
    monkeypatch.setattr(neighbours, "FINISH", finish)
    draw = np.random.default_rng(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(200, int(k)) for k in range(201, 230)] + [tuple(map(int, draw.integers(300, 400, 2))) for _ in range(60)] + [(7, 7)]
    want = {i: i for i in range(420)}
    for _ in range(420):
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    nodes = spark.range(420).select(F.col("id").alias("pid"))
    got = neighbours.connected_components(nodes, spark.createDataFrame(edges, "a bigint, b bigint"))
    assert {r["pid"]: r["root"] for r in got.collect()} == want


def test_two_cells_meet_in_one_of_them(spark):
    draw = np.random.default_rng(9)
    x = draw.normal(size=(700, 6)) + 2
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    data = [(i, 1 + i % 3, list(range(6)), v.tolist()) for i, v in enumerate(x)]
    points = spark.createDataFrame(data, "pid bigint, mult bigint, idx array<int>, val array<double>")
    rows, sizes = cells.partition(points, 0.98, 700, 64, force=True, pivots=9)
    ways = {(r["home"], v) for r in rows.select("home", "visits").collect() for v in r["visits"]}
    assert ways and not ways & {(b, a) for a, b in ways}
    near = (x * x).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * x @ x.T <= neighbours.eps2(0.98)
    got = {r["pid"]: r["n_neighbours"] for r in cells.cell_weights(rows, sizes, 0.98, 64).collect()}
    assert got == dict(enumerate((near @ (1 + np.arange(700) % 3)).tolist()))
