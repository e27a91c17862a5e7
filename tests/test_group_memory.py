"""Groups of the epsilon join hold a few tiles besides their rows (F3 to F6, F8 to F11, F14 to F19, F21 to F25), and cores that are joined are not compared again."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from refrain.operators import tiles
from refrain.operators import vectors as V


def rows_of(x):
    parts = [np.nonzero(v != 0)[0] for v in x]
    lists = pa.array([p.tolist() for p in parts], pa.list_(pa.int32())), pa.array([v[p].tolist() for v, p in zip(x, parts)], pa.list_(pa.float64()))
    return tiles.Rows.of(pa.table({"idx": lists[0], "val": lists[1]}))


def unit(draw, n, dim, signed=False):
    """Sparse rows of four kinds, each with components of its own, and close copies."""
    kind = draw.integers(0, 4, n)
    x = (draw.random((n, dim)) < 0.4) * draw.random((n, dim)) * (np.arange(dim) % 4 == kind[:, None]) + 0.01 * (draw.random((n, dim)) < 0.05)
    x[n // 2 :: 3] = x[: len(x[n // 2 :: 3])] * (1 + 0.2 * draw.random((len(x[n // 2 :: 3]), dim)))
    x = x * np.where(draw.random(dim) < 0.5, -1, 1) if signed else x
    x[5], x[7] = 0, x[6]
    return np.divide(x, norm := np.linalg.norm(x, axis=1, keepdims=True), out=np.zeros_like(x), where=norm > 0)


@pytest.mark.parametrize("signed", [False, True])
@pytest.mark.parametrize("thr", [0.5, 0.1])
def test_a_first_screen_leaves_out_no_neighbour(monkeypatch, signed, thr):
    for name, value in (("TILE", 64), ("STRIP", 16), ("WIDE", 64), ("SHOWN", 200), ("HELD", 2)):
        monkeypatch.setattr(tiles, name, value)
    x = unit(np.random.default_rng(1), 700, 80, signed)
    rows, n2 = rows_of(x), (x * x).sum(1)
    assert tiles.Parts.of(rows, thr) is not None
    want = n2[:, None] + n2[None, :] - 2 * x @ x.T <= thr
    for one, two, symmetric in ((np.arange(700), np.arange(700), True), (np.arange(0, 400), np.arange(200, 700), False)):
        got = np.zeros((700, 700), int)
        for r, c, near in tiles.near_tiles(rows, one, two, thr, symmetric=symmetric):
            got[np.ix_(one[r], two[c])] += near
        assert got.max() == 1  # each pair is told of once
        got = got.astype(bool)
        if symmetric:
            got |= got.T
        assert (got[np.ix_(one, two)] == want[np.ix_(one, two)]).all()


def test_memory_does_not_grow_with_the_group(monkeypatch):
    for name, value in (("TILE", 128), ("HELD", 2)):
        monkeypatch.setattr(tiles, name, value)
    x = unit(np.random.default_rng(2), 6000, 300)

    def peak(n):
        rows, places = rows_of(x[:n]), np.arange(n)
        tracemalloc.start()
        for _ in zip(range(30), tiles.near_tiles(rows, places, places, 0.2)):
            pass
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    assert peak(6000) - peak(3000) < 3000 * 300 * 4 / 4  # the rows as a matrix would be four times as much


def test_joined_cores_are_not_compared_again(monkeypatch):
    for name, value in (("TILE", 64), ("STRIP", 16)):
        monkeypatch.setattr(tiles, name, value)
    draw = np.random.default_rng(3)
    x = unit(draw, 600, 30)
    rows, n2 = rows_of(x), (x * x).sum(1)
    core = ((n2[:, None] + n2[None, :] - 2 * x @ x.T <= 0.3).sum(1) >= 4) & (draw.random(600) < 0.9)
    pid, told = pa.array(draw.permutation(600)), {}
    for one, two, symmetric in ((np.arange(600), np.arange(600), True), (np.arange(350), np.arange(250, 600), False)):
        for skip in (False, True):
            links, n = tiles.Links(core), 0
            for r, c, near in tiles.near_tiles(rows, one, two, 0.3, symmetric=symmetric, needed=links.needed if skip else None):
                links.add(one[r], two[c], near)
                n += near.size
            told[skip] = links.frame(pid).to_pylist(), n
        key = lambda rows: sorted(tuple(r.values()) for r in rows)
        assert key(told[True][0]) == key(told[False][0]) and told[True][1] < told[False][1]
        assert {r["kind"] for r in told[True][0]} == {"e", "b"}


def test_terms_are_counted_by_pieces_of_a_coded_row(monkeypatch):
    draw = np.random.default_rng(4)
    texts = [" ".join(f"w{i}" for i in draw.integers(0, 9, n)) for n in (0, 1, 30, 2, 0, 7, 100, 5, 0)]
    batch = pa.record_batch({"doc": pa.array(range(len(texts))), "plain": pa.array(texts), "toks": pa.array([None] * len(texts), pa.list_(pa.string()))})
    coded = list(V._code(iter([batch])))
    vocab = sorted(["w1", "w2", "w3", "w1 w2", "w2 w2"])
    whole = pa.Table.from_batches(V._term_counts(vocab)(iter(coded))).to_pylist()
    monkeypatch.setattr(V, "COUNTED_TOKENS", 10)
    parts = list(V._term_counts(vocab)(iter(coded)))
    assert len(parts) > 3 and pa.Table.from_batches(parts).to_pylist() == whole
    assert [r["doc"] for r in whole] == list(range(len(texts)))
