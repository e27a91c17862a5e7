"""The comparison of a group's points, the blocks, and the counts of terms from coded rows, against plain versions."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from refrain.operators import neighbours, tiles
from refrain.operators import vectors as V


def rows_of(x):
    parts = [np.nonzero(v != 0)[0] for v in x]
    lists = pa.array([p.tolist() for p in parts], pa.list_(pa.int32())), pa.array([v[p].tolist() for v, p in zip(x, parts)], pa.list_(pa.float64()))
    return tiles.Rows.of(pa.table({"idx": lists[0], "val": lists[1]}))


def points(draw, n, dim):
    x = draw.normal(size=(n, dim)) * (draw.random((n, dim)) < 0.4)
    x[n // 2 : n // 2 + 40] = x[0] + 0.05 * draw.normal(size=(40, dim))
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
    x[7] = 0
    return x


@pytest.mark.parametrize("similarity", [0.3, 0.5, 0.75, 0.99])
def test_tiles_hold_exactly_the_neighbours(monkeypatch, similarity):
    monkeypatch.setattr(tiles, "TILE", 64)
    draw = np.random.default_rng(5)
    x = points(draw, 300, 20)
    x[20], x[21] = 0, 0
    x[20, 0], x[21, :2] = 1, (similarity, np.sqrt(1 - similarity**2))  # a pair at the threshold itself
    thr = neighbours.eps2(similarity)
    want = (x**2).sum(1)[:, None] + (x**2).sum(1)[None, :] - 2 * x @ x.T <= thr
    assert want[20, 21]
    for one, two, symmetric in ((np.arange(300), np.arange(300), True), (np.arange(0, 170), np.arange(100, 300), False)):
        got = np.zeros((300, 300), bool)
        for r, c, near in tiles.near_tiles(rows_of(x), one, two, thr, symmetric=symmetric):
            got[np.ix_(one[r], two[c])] |= near
        if symmetric:
            got |= got.T
        assert (got[np.ix_(one, two)] == want[np.ix_(one, two)]).all()


def test_rows_with_a_component_that_is_no_number_have_no_neighbours():
    x = np.eye(3)
    x[1, 1] = np.nan
    near = [t[2] for t in tiles.near_tiles(rows_of(x), np.arange(3), np.arange(3), 2.5, symmetric=True)]
    assert near[0].tolist() == [[True, False, True], [False, False, False], [True, False, True]]


def test_blocks_grow_with_the_points():
    assert neighbours.block_count(9_214, 2048, 65) == 5
    assert neighbours.block_count(460_000, 2048, 65) == 16  # 225 blocks moved every point 225 times
    assert neighbours.block_count(460_000, 2048, 1536) > 100  # wide points: blocks stay bounded in bytes
    assert neighbours.block_count(0, 2048, 0) == 1


def test_the_second_pass_moves_only_points_with_neighbours(spark):
    x = points(np.random.default_rng(6), 300, 20)
    data = [(i, 1, np.nonzero(v)[0].tolist(), v[np.nonzero(v)[0]].tolist()) for i, v in enumerate(x)]
    pts = spark.createDataFrame(data, "pid bigint, mult bigint, idx array<int>, val array<double>")
    hits = neighbours.neighbour_hits(pts, 0.9, 6).cache()
    near = (x**2).sum(1)[:, None] + (x**2).sum(1)[None, :] - 2 * x @ x.T <= neighbours.eps2(0.9)
    moved = hits.filter("other").select("pid", "bi", "bj").distinct()
    assert {r["pid"] for r in moved.collect()} == set(np.nonzero(near.sum(1) > 1)[0].tolist())
    assert moved.count() < 300 * 6 / 4
    flagged = pts.withColumn("core", F.col("pid").isin([int(i) for i in np.nonzero(near.sum(1) >= 3)[0]]))
    joined = lambda links: sorted(map(tuple, neighbours.connected_components(flagged.select("pid"), links.filter("kind = 'e'").select("a", "b")).collect()))
    assert joined(neighbours.core_links(flagged, 0.9, 6, hits)) == joined(neighbours.core_links(flagged, 0.9, 6))


def test_cells_use_few_pivots_where_points_visit_most_cells(spark, monkeypatch):
    from refrain.operators import cells

    monkeypatch.setattr(cells, "CELL", 4)
    x = np.random.default_rng(7).normal(size=(600, 40))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    data = [(i, 1, list(range(40)), v.tolist()) for i, v in enumerate(x)]
    pts = spark.createDataFrame(data, "pid bigint, mult bigint, idx array<int>, val array<double>")
    _, sizes = cells.partition(pts, 0.9, 600, 2048, force=True)
    assert sizes.agg(F.sum("members")).first()[0] <= 16 * 600  # 150 pivots made over 60,000 copies


def plain_counts(texts):
    import re
    from collections import Counter

    out = []
    for t in texts:
        w = re.findall(r"[^\W]{2,}", t.lower())
        out.append(Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])]))
    return out


@pytest.mark.parametrize("tokens", [1 << 20, 50])
def test_terms_from_coded_rows(spark, monkeypatch, tokens):
    monkeypatch.setattr(V, "CODED_TOKENS", tokens)
    draw = np.random.default_rng(8)
    words = [f"w{i}" for i in range(120)]
    weight = 1 / np.arange(1, 121) ** 1.1
    texts = [" ".join(draw.choice(words, int(n), p=weight / weight.sum())) for n in draw.integers(0, 60, 90)] + ["", "a b c", "w1"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc long, text string").repartition(3, "doc")
    counts = plain_counts(texts)
    cf, n_in = sum(counts[1:], counts[0].copy()), {}
    for c in counts:
        for t in c:
            n_in[t] = n_in.get(t, 0) + 1
    got = {r["term"]: (r["cf"], r["df"]) for r in V.corpus_statistics(df).collect()}
    assert got == {t: (n, n_in[t]) for t, n in cf.items()}
    vectors, vocab = V.tfidf_vectors(df, size=20)
    best = sorted(sorted(cf, key=lambda t: (-cf[t], t))[:20])
    assert [tuple(r) for r in vocab.select("term", "cf", "df", "idx").orderBy("idx").collect()] == [(t, cf[t], n_in[t], i) for i, t in enumerate(best)]
    for r in vectors.collect():
        tf = [(i, counts[r["doc"]][t]) for i, t in enumerate(best) if counts[r["doc"]][t]]
        assert list(zip(r["idx"], r["tf"])) == tf
        w = np.array([(1 + np.log(n)) * (np.log((1 + len(texts)) / (1 + n_in[best[i]])) + 1) for i, n in tf])
        assert np.allclose(r["val"], w / np.linalg.norm(w) if len(w) else [])


def test_rows_of_one_document_are_counted_together(spark):
    df = spark.createDataFrame([(1, "red fox red"), (1, "red sky"), (2, "red fox"), (None, "fox sky"), (None, "fox")], "doc long, text string")
    want = {("red", 4, 2), ("fox", 4, 3), ("sky", 2, 2), ("red fox", 2, 2), ("fox red", 1, 1), ("red sky", 1, 1), ("fox sky", 1, 1)}
    assert {tuple(r) for r in V.corpus_statistics(df).collect()} == want
    vectors, vocab = V.tfidf_vectors(df, size=10)
    assert {(r["term"], r["cf"], r["df"]) for r in vocab.collect()} == want
    idx = {r["idx"]: r["term"] for r in vocab.collect()}
    got = sorted([(r["doc"] or 0, sorted((idx[i], n) for i, n in zip(r["idx"], r["tf"]))) for r in vectors.collect()])
    one = sorted([("red", 3), ("fox", 1), ("sky", 1), ("red fox", 1), ("fox red", 1), ("red sky", 1)])
    assert got == [(0, []), (0, []), (1, one), (1, one), (2, sorted([("red", 1), ("fox", 1), ("red fox", 1)]))]
