"""The comparison inside a group of the epsilon join: which rows of one set are near which rows of another, a tile at a time.

A tile is screened by a product in single precision whose rounding error is allowed for; only the pairs that the screen leaves open
are decided, in double precision, by the test that ``neighbours.py`` states. Wide rows are screened in two steps: first by the lengths of
their parts (``Parts``: a product of rows is never more than that of these lengths), which are a quarter as many, then, where that leaves
pairs open, by the components. What a group holds besides its rows is some tiles, whatever the group's size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from refrain.operators.vectors import weights

TILE = 2048  # rows and columns compared at once
PIECE = 8192  # rows weighed at once
STRIP = 256  # rows of a tile whose pairs are listed at once
HELD = 8  # tiles of the first set that are ready for the product at once
PART = 4  # components whose length stands for them
WIDE = 256  # components from which on a first screen pays
SHOWN = 512  # rows from which the parts are chosen
EVERY = [(slice(None), slice(None))]
AXES = 8  # directions by which rows are put in order
MOST_OPEN = 0.25  # pairs that a first screen may leave open


class Rows:
    """Sparse vectors as flat arrays: ``idx`` and ``val`` of row ``i`` lie from ``at[i]`` to ``at[i + 1]``; ``n2`` are the squared lengths.

    With ``idf`` the values are the counts of terms, and each use of a row weighs them (to the same bits): weights are eight times as wide."""

    def __init__(self, idx: np.ndarray, val: np.ndarray, lens: np.ndarray, idf: np.ndarray | None = None):
        self.idx, self.kept, self.idf, self.n = idx, val, idf, len(lens)
        self.at = np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)
        self.dim = int(idx.max()) + 1 if len(idx) else 1
        self.n2 = np.zeros(self.n)
        for a, b, rows in _pieces(lens):
            part = self._values(slice(a, b), lens[rows])
            self.n2[rows] = np.bincount(np.repeat(np.arange(len(lens[rows])), lens[rows]), weights=part * part, minlength=len(lens[rows]))

    @classmethod
    def of(cls, table: pa.Table, idf: np.ndarray | None = None) -> Rows:
        """With ``idf``, the table has the counts of terms (``tf``)."""
        idx, val = (pa.chunked_array(table.column(c)).combine_chunks() for c in ("idx", "val" if idf is None else "tf"))
        lens = pc.fill_null(pc.list_value_length(idx), 0).to_numpy(zero_copy_only=False)
        idx, val = (f.flatten().to_numpy(zero_copy_only=False) for f in (idx, val))
        return cls(idx, val.astype(np.float64, copy=False) if idf is None else val, lens, idf)

    @property
    def val(self) -> np.ndarray:
        return self._values(slice(None), np.diff(self.at))

    def _values(self, take: slice | np.ndarray, lens: np.ndarray) -> np.ndarray:
        """The values at ``take``, which are those of whole rows of ``lens``."""
        return self.kept[take] if self.idf is None else weights(self.idx[take], self.kept[take], lens, self.idf)

    def dense(self, which: np.ndarray, dim: int) -> np.ndarray:
        """Rows ``which`` as a matrix of ``dim`` columns."""
        lens = self.at[which + 1] - self.at[which]
        before = np.cumsum(lens) - lens
        take = np.repeat(self.at[which] - before, lens) + np.arange(lens.sum())
        x = np.zeros((len(which), dim))
        x[np.repeat(np.arange(len(which)), lens), self.idx[take]] = self._values(take, lens)
        return x


def _pieces(lens: np.ndarray) -> Iterator[tuple[int, int, slice]]:
    """``(first, end, rows)`` of PIECE rows each in flat lists."""
    at = np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)
    for a in range(0, len(lens), PIECE):
        yield int(at[a]), int(at[min(a + PIECE, len(lens))]), slice(a, a + PIECE)


class Parts:
    """The components of wide rows in parts that seldom have more than one value, and an order of rows that keeps like ones together."""

    def __init__(self, part: np.ndarray, axes: np.ndarray):
        self.part, self.axes = part, axes  # as matrices, by component

    @classmethod
    def of(cls, rows: Rows, thr: float) -> Parts | None:
        """None where the lengths of parts would tell too little."""
        if rows.dim < WIDE or rows.n < 4 * TILE:
            return None
        x = rows.dense(np.linspace(0, rows.n - 1, SHOWN).astype(np.int64), rows.dim)
        if not np.isfinite(x).all():
            return None
        common = np.abs(x).T @ np.abs(x)
        order = np.argsort(-np.diagonal(common), kind="stable")
        n = -(-rows.dim // PART)
        where, size, cost = np.empty(rows.dim, np.int64), np.ones(n, np.int64), common[order[:n]].copy()
        where[order[:n]] = np.arange(n)
        for c in order[n:]:  # each goes where it meets the least
            best = int(np.argmin(np.where(size < PART, cost[:, c], np.inf)))
            where[c], size[best] = best, size[best] + 1
            cost[best] += common[c]
        part = np.zeros((rows.dim, n), np.float32)
        part[np.arange(rows.dim), where] = 1
        found = cls(part, np.linalg.eigh(x.T @ x)[1][:, -AXES:])
        lengths, n2 = found.lengths(x.astype(np.float32)), (x * x).sum(axis=1)
        left_open = n2[:, None] + n2[None, :] - 2 * lengths @ lengths.T <= thr
        return found if left_open.mean() <= MOST_OPEN else None

    def lengths(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt((x * x) @ self.part)

    def ordered(self, rows: Rows, which: np.ndarray) -> np.ndarray:
        """The places in ``which`` by the direction that a row follows most, and by how much."""
        along = np.concatenate([np.zeros((0, self.axes.shape[1])), *(np.abs(rows.dense(which[a : a + TILE], rows.dim) @ self.axes) for a in range(0, len(which), TILE))])
        return np.lexsort((-along.max(axis=1, initial=0), along.argmax(axis=1)))


def _screened(rows: Rows, which: np.ndarray, dim: int, parts: Parts | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Operands of the screens: a row's product with another's, whose last two columns are exchanged, is ``a.b - |a|^2/2 - |b|^2/2``."""
    out = np.empty((len(which), dim + 2), np.float32)
    for a in range(0, len(which), TILE):
        out[a : a + TILE, :-2] = rows.dense(which[a : a + TILE], dim)
    out[:, -2], out[:, -1] = -rows.n2[which] / 2, 1
    if parts is None:
        return out, None
    first = np.empty((len(which), parts.part.shape[1] + 2), np.float32)
    for a in range(0, len(which), TILE):
        first[a : a + TILE, :-2] = parts.lengths(out[a : a + TILE, :-2])
    first[:, -2:] = out[:, -2:]
    return out, first


def near_tiles(rows: Rows, one: np.ndarray, two: np.ndarray, thr: float, symmetric: bool = False, needed: Callable | None = None) -> Iterator[tuple]:
    """``(places in one, places in two, near)`` of every tile that holds neighbours; ``near`` is a matrix of truth values.

    ``one`` and ``two`` are places in ``rows``. With ``symmetric`` they are the same, and a tile stands for its mirror image too; one
    that is its own mirror image has the same places twice. ``needed`` gets the rows of a tile on both sides and tells which of
    them are to be compared, as pairs of masks; each of these then comes as a tile of its own.
    """
    dim = rows.dim
    scale = max(1.0, float(rows.n2[np.isfinite(rows.n2)].max(initial=0.0)))
    slack = 1.2e-7 * (dim + 10) * scale
    maybe, sure = np.float32(-thr / 2 - slack), np.float32(-thr / 2 + slack)
    parts = Parts.of(rows, thr)
    places = [np.arange(len(one)), np.arange(len(two))] if parts is None else [parts.ordered(rows, x) for x in (one, two)]
    for held in range(0, len(one), HELD * TILE):
        left, left_parts = _screened(rows, one[places[0][held : held + HELD * TILE]], dim, parts)
        for b in range(held if symmetric else 0, len(two), TILE):
            at = places[1][b : b + TILE]
            cols = two[at]
            right, right_parts = _screened(rows, cols, dim, parts)
            for x in (right, right_parts):
                if x is not None:
                    x[:, -2:] = x[:, [-1, -2]]
            for a in range(held, min(b + 1 if symmetric else len(one), len(one), held + HELD * TILE), TILE):
                mine = slice(a - held, a - held + TILE)
                part_at = places[0][a : min(a + TILE, held + HELD * TILE)]
                part = one[part_at]
                for some, others in EVERY if needed is None else needed(part, cols):
                    left_open = None if parts is None else left_parts[mine][some] @ right_parts[others].T >= maybe - np.float32(1e-6 * scale)
                    near = _near(rows, part[some], cols[others], left[mine][some], right[others], thr, maybe, sure, left_open)
                    if near is not None:
                        yield part_at[some], at[others], near


def _near(rows: Rows, part: np.ndarray, cols: np.ndarray, left: np.ndarray, right: np.ndarray, thr: float, maybe: np.float32, sure: np.float32, left_open: np.ndarray | None) -> np.ndarray | None:
    """Which of the rows ``part`` are near which of ``cols``, or None where none is; ``left_open``: the pairs that a first screen leaves open."""
    if left_open is None:
        product = left @ right.T
        near = product >= maybe
        if not near.any():
            return None
        for a in range(0, len(part), STRIP):
            strip = slice(a, a + STRIP)
            _decide(rows, part[strip], cols, product[strip], near[strip], thr, sure)
        return near if near.any() else None
    near, some = None, left_open.any(axis=1)
    for a in range(0, len(part), STRIP):
        if not some[a : a + STRIP].any():
            continue
        mine = a + np.nonzero(some[a : a + STRIP])[0]
        yours = np.nonzero(left_open[a : a + STRIP].any(axis=0))[0]
        product = left[mine] @ right[yours].T
        found = product >= maybe
        if found.any():
            _decide(rows, part[mine], cols[yours], product, found, thr, sure)
            near = np.zeros(left_open.shape, bool) if near is None else near
            near[np.ix_(mine, yours)] = found
    return near if near is not None and near.any() else None


def _decide(rows: Rows, part: np.ndarray, cols: np.ndarray, product: np.ndarray, near: np.ndarray, thr: float, sure: np.float32) -> None:
    """Sets ``near`` right where single precision leaves it open."""
    left_open, dim = near & (product < sure), rows.dim
    count = np.count_nonzero(left_open)
    if count * 32 > near.size:
        near[:] = rows.n2[part][:, None] + rows.n2[cols][None, :] - 2 * rows.dense(part, dim) @ rows.dense(cols, dim).T <= thr
    elif count:
        i, j = pairs(left_open)
        near[i, j] = decided(rows, part[i], cols[j], dim, thr)


def pairs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``np.nonzero`` of a matrix, several times as fast."""
    return np.divmod(np.flatnonzero(mask), max(1, mask.shape[1]))


def decided(rows: Rows, i: np.ndarray, j: np.ndarray, dim: int, thr: float) -> np.ndarray:
    """Whether row ``i[k]`` is near row ``j[k]``, in double precision."""
    out = np.empty(len(i), bool)
    step = max(1, (1 << 21) // dim)
    for a in range(0, len(i), step):
        p, q = i[a : a + step], j[a : a + step]
        dot = np.einsum("ij,ij->i", rows.dense(p, dim), rows.dense(q, dim))
        out[a : a + step] = rows.n2[p] + rows.n2[q] - 2 * dot <= thr
    return out


def weighed(near: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For every row of ``near``, the sum of the weights of its neighbours."""
    if np.count_nonzero(near) * 16 > near.size:
        kind = np.float32 if weight.sum() < 1 << 24 else np.float64  # whole numbers, so the sums are exact
        weight = weight.astype(kind)
        return np.concatenate([np.rint(near[a : a + STRIP].astype(kind) @ weight).astype(np.int64) for a in range(0, len(near), STRIP)])
    i, j = pairs(near)
    return np.rint(np.bincount(i, weights=weight[j], minlength=len(near))).astype(np.int64)


def weighed_columns(near: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For every column of ``near``, the sum of the weights of its neighbours."""
    if np.count_nonzero(near) * 16 > near.size:
        kind = np.float32 if weight.sum() < 1 << 24 else np.float64
        weight = weight.astype(kind)
        return sum(np.rint(weight[a : a + STRIP] @ near[a : a + STRIP].astype(kind)).astype(np.int64) for a in range(0, len(near), STRIP))
    i, j = pairs(near)
    return np.rint(np.bincount(j, weights=weight[i], minlength=near.shape[1])).astype(np.int64)


class Links:
    """Collects the neighbours among a group's points: local components of the cores, and which of them a border point touches."""

    def __init__(self, core: np.ndarray):
        self.core, self.label, self.border = core, np.arange(len(core)), []

    def needed(self, rows: np.ndarray, cols: np.ndarray) -> list[tuple]:
        """Masks of what is to be compared of a tile: cores that are known to belong together need not be."""
        mine, yours = self.core[rows], self.core[cols]
        labels = self.label[rows[mine]]
        if not len(labels):
            return [(slice(None), yours)] if yours.any() else []
        found, count = np.unique(labels, return_counts=True)
        main = found[count.argmax()]
        odd, others = ~mine | (self.label[rows] != main), ~yours | (self.label[cols] != main)
        return [(a, b) for a, b in ((odd, slice(None)), (~odd, others)) if a.any() and (b is others and b.any() or b is not others)]

    def add(self, rows: np.ndarray, cols: np.ndarray, near: np.ndarray) -> None:
        """``rows`` and ``cols``: places in the group."""
        mine, yours = self.core[rows], self.core[cols]
        for one, two, some in ((rows[~mine], cols[yours], near[~mine][:, yours]), (cols[~yours], rows[mine], near[mine][:, ~yours].T)):
            i, j = pairs(some)
            if len(i):
                self.border.append(np.unique(np.stack([one[i], self.label[two[j]]], 1), axis=0))
        rows, cols, near = (rows, cols, near) if mine.all() and yours.all() else (rows[mine], cols[yours], near[mine][:, yours])
        for a in range(0, len(rows), STRIP):
            u, v = self.label[rows[a : a + STRIP]], self.label[cols]
            i, j = pairs(near[a : a + STRIP] & (u[:, None] != v[None, :]))
            if len(i):
                self._join(u[i], v[j])

    def _join(self, u: np.ndarray, v: np.ndarray) -> None:
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        to = np.arange(len(self.label))
        to[nodes] = nodes[local_components(len(nodes), at[: len(u)], at[len(u) :])]
        self.label = to[self.label]

    def frame(self, pid: pa.Array) -> pa.Table:
        """``kind, a, b``: a star per local component around its lowest ``pid``, and one link of a border point to each centre."""
        n = len(self.core)
        keys = pid.to_numpy(zero_copy_only=False) if pa.types.is_integer(pid.type) else np.arange(n)
        rank = np.empty(n, np.int64)
        rank[np.argsort(keys, kind="stable")] = np.arange(n)
        best = np.full(n, n, np.int64)
        np.minimum.at(best, self.label, rank)
        centre = np.argsort(rank)[best[self.label]]
        star = np.nonzero(self.core & (centre != np.arange(n)))[0]
        pairs = np.concatenate([np.zeros((0, 2), np.int64), *self.border])
        pairs = np.unique(np.stack([pairs[:, 0], centre[pairs[:, 1]]], 1), axis=0)
        a, b = np.concatenate([centre[star], pairs[:, 0]]), np.concatenate([star, pairs[:, 1]])
        kind = pa.array(["e"] * len(star) + ["b"] * len(pairs), pa.string())
        return pa.table({"kind": kind, "a": pid.take(pa.array(a)), "b": pid.take(pa.array(b))})


def local_components(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Min-index labels of the graph (u, v) on n nodes (numpy label propagation)."""
    lab = np.arange(n)
    if len(u) == 0:
        return lab
    while True:
        m = lab.copy()
        np.minimum.at(m, u, lab[v])
        np.minimum.at(m, v, lab[u])
        m = m[m]
        m = m[m]
        if np.array_equal(m, lab):
            return lab
        lab = m


