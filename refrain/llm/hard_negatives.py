"""Hard negatives for anchors by inner product, with coordinate pruning over length buckets.

Two exact searches run for every anchor: its ``positives`` best other rows of the same label, then, for each positive, the
``negatives`` best rows of other labels whose score lies in a band below the positive's. Higher scores come first, ties by
smaller id. Both searches are one routine: the ``k`` best scores inside ``[lo, hi]`` for each *slot* of an anchor (one slot without
limits for the positives, one per distinct positive score for the negatives).

*Index.* A block of rows is sorted by length and cut into buckets of similar length. A bucket holds its rows scaled to length
one and, per coordinate, a list of its rows sorted by that coordinate. The first bucket (the longest rows) is read whole;
from then on every slot has a least score ``s`` (the k-th best so far, or the band's lower end). A bucket whose longest row can't
reach ``s`` ends the search of its block. Otherwise a useful row must have a cosine of at least ``t = s / (|anchor| * longest)``, and
on the unit sphere that confines each of its coordinates: an anchor at angle ``a`` from axis ``f`` admits values from
``cos(a + arccos t)`` to ``cos(a - arccos t)``. For the FOCUS largest coordinates of the anchor these ranges are looked up in the
sorted lists; the shortest list gives the candidates, the other focus coordinates thin them out, and what is left is
verified with exact integer scores. Anchors whose ranges leave most of a bucket share one matrix product instead.

*On Spark.* Rows are dealt to blocks of about BLOCK rows and anchors to slices of about SLICE anchors; a grid cell (slice, block)
is one bounded group, for positives per label, for negatives over all labels. Cells return at most ``k`` rows per slot, which are merged
by a salted top-k. A label, vector or id that holds a third of all rows is dealt to many cells like any other. The anchors
are the stated query set, so the work is (anchors x rows) in blocks, less what pruning saves.

Defined cases: rows with a null id or label, a null vector, or a null or non-finite component take no part; components are
multiplied by ``scale`` and rounded down, scores are exact whatever their size (and reported within the range of a long); vectors of
different lengths are never compared; rows with the anchor's id are never its positives or negatives, other repeated rows count one by one;
equal anchor rows are one anchor; anchors without positives, and positives with an empty band (a negative score, say) give no row; an
empty table gives an empty table. Ids are integers. The result holds its own columns only, so other input columns cannot
clash.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refrain.functions.topk import top_k
from refrain.operators.components import salted_join
from refrain.session import staged

SCALE = 256
BLOCK = 8192  # rows of a block, about
SLICE = 1024  # anchors of a slice, about
BUCKET = 1024  # rows of a bucket, at most
RATIO = 0.9  # of a bucket's shortest to its longest row, at least
FOCUS = 4
DENSE = 0.25  # share of a bucket from which it is scored by one matrix product
SCORES = 1 << 20  # scores held at a time
EXACT = float(1 << 53)
_SLACK = 1e-9


class Bucket:
    """Rows of similar length with their sorted coordinate lists, which are made when first asked for."""

    def __init__(self, rows: np.ndarray, length: np.ndarray, at: np.ndarray):
        self.rows, self.at = rows, at
        self.longest, self.shortest = float(length.max()), float(length.min())
        self.unit = rows / np.where(length > 0, length, 1)[:, None]
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def sorted_by(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self.lists:
            order = np.argsort(self.unit[:, f], kind="stable")
            self.lists[f] = order, self.unit[order, f]
        return self.lists[f]


def buckets(rows: np.ndarray) -> list[Bucket]:
    """Longest rows first."""
    length = np.sqrt((rows * rows).sum(axis=1))
    order = np.argsort(-length, kind="stable")
    out, start = [], 0
    for i in range(1, len(order) + 1):
        if i == len(order) or i - start == BUCKET or length[order[i]] < RATIO * length[order[start]]:
            at = order[start:i]
            out.append(Bucket(rows[at], length[at], at))
            start = i
    return out


def feasible(unit: np.ndarray, least_cos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Range of each coordinate for unit vectors whose cosine with ``unit`` is at least ``least_cos`` (one per row)."""
    angle = np.arccos(np.clip(unit, -1, 1))
    wide = np.arccos(np.clip(least_cos, -1, 1))[:, None]
    return np.cos(np.minimum(angle + wide, math.pi)) - _SLACK, np.cos(np.maximum(angle - wide, 0)) + _SLACK


class Best:
    """The ``k`` best (score, id) of every slot so far; slots are numbered over all anchors."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray, k: int):
        self.lo, self.hi, self.k = lo, hi, k
        self.slot, self.score, self.id = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.least = lo.copy()

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(slot):
            return
        slot, score, ids = np.concatenate([self.slot, slot]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        first = np.concatenate([[True], slot[1:] != slot[:-1]])
        rank = np.arange(len(slot)) - np.maximum.accumulate(np.where(first, np.arange(len(slot)), 0))
        some = rank < self.k
        self.slot, self.score, self.id = slot[some], score[some], ids[some]
        full = rank[some] == self.k - 1
        self.least[self.slot[full]] = self.score[full]

    def offer(self, slots: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores[i, j]`` of row ``j`` for slot ``slots[i]``; NaN where they don't meet."""
        ok = (scores >= self.least[slots][:, None]) & (scores <= self.hi[slots][:, None])
        seen = np.where(ok, scores, -np.inf)
        if seen.shape[1] > self.k:  # nothing below the block's own k-th best is needed
            ok &= seen >= np.partition(seen, seen.shape[1] - self.k, axis=1)[:, -self.k][:, None]
        i, j = np.nonzero(ok)
        self.add(slots[i], scores[i, j], ids[j])


def search(anchors: np.ndarray, meets, rows: np.ndarray, ids: np.ndarray, best: Best, slots: list[np.ndarray]) -> None:
    """Fill ``best`` for all anchors; ``slots[i]`` are anchor ``i``'s, ``meets(anchors, rows)`` masks the pairs that count."""
    size = np.sqrt((anchors * anchors).sum(axis=1))
    unit = anchors / np.where(size > 0, size, 1)[:, None]
    focus = np.argsort(-np.abs(unit), axis=1, kind="stable")[:, : min(FOCUS, anchors.shape[1])]
    live = np.array([i for i in range(len(anchors)) if len(slots[i])], np.int64)
    n_slots = np.array([len(s) for s in slots], np.int64)
    every = np.concatenate([*slots, np.zeros(0, np.int64)]).astype(np.int64)
    first = np.cumsum(n_slots) - n_slots

    def score(some: np.ndarray, bucket: Bucket, of: np.ndarray | None = None) -> None:
        r = bucket.rows if of is None else bucket.rows[of]
        at = bucket.at if of is None else bucket.at[of]
        step = max(1, SCORES // (len(at) * int(n_slots[some].max())))
        for i in range(0, len(some), step):
            own = some[i : i + step]
            s = np.where(meets(own, at), anchors[own] @ r.T, np.nan)
            per = n_slots[own]
            best.offer(every[np.repeat(first[own] - (np.cumsum(per) - per), per) + np.arange(per.sum())], np.repeat(s, per, axis=0), ids[at])

    for bucket in buckets(rows):
        if not len(live):
            break
        least = np.array([best.least[slots[i]].min() for i in live])
        reach = least <= size[live] * bucket.longest * (1 + _SLACK)
        live, least = live[reach], least[reach]  # later buckets are shorter; scores up to zero never end a search
        if not len(live):
            break
        with np.errstate(divide="ignore", invalid="ignore"):
            t = least / (size[live] * np.where(least > 0, bucket.longest, bucket.shortest))
        t = np.where(np.isfinite(t), t, -1.0) - _SLACK
        free = t <= -1
        f = focus[live]
        low, high = feasible(np.take_along_axis(unit[live], f, axis=1), t)
        start, stop = np.zeros(f.shape, np.int64), np.full(f.shape, len(bucket.at))
        for c in np.unique(f[~free]):
            values = bucket.sorted_by(int(c))[1]
            i, j = np.nonzero((f == c) & ~free[:, None])
            start[i, j], stop[i, j] = np.searchsorted(values, low[i, j], "left"), np.searchsorted(values, high[i, j], "right")
        n = stop - start
        short = n.argmin(axis=1) if f.shape[1] else np.zeros(len(live), np.int64)
        fewest = n.min(axis=1) if f.shape[1] else np.full(len(live), len(bucket.at))
        dense = free | (fewest > DENSE * len(bucket.at))
        if dense.any():
            score(live[dense], bucket)
        for x in np.nonzero(~dense & (fewest > 0))[0]:
            c = int(f[x, short[x]])
            found = bucket.sorted_by(c)[0][start[x, short[x]] : stop[x, short[x]]]
            near = bucket.unit[found[:, None], f[x][None, :]]
            found = found[((near >= low[x]) & (near <= high[x])).all(axis=1)]
            if len(found):
                score(live[x : x + 1], bucket, found)


def _brute(a: pd.DataFrame, r: pd.DataFrame, lo: list[list], hi: list[list], k: int, meets) -> list[tuple[int, int, int, int]]:
    """The same in Python integers, for components whose scores doubles can't hold."""
    out = []
    rows = [[int(v) for v in q] for q in r["q"]]
    ids = r["id"].tolist()
    for i, q in enumerate(a["q"]):
        q = [int(v) for v in q]
        ok = meets(np.array([i]), np.arange(len(rows)))[0]
        scored = [(-sum(x * y for x, y in zip(q, row)), ids[j]) for j, row in enumerate(rows) if ok[j]]
        for j, (low, high) in enumerate(zip(lo[i], hi[i])):
            out += [(i, j, -s, x) for s, x in heapq.nsmallest(k, [p for p in scored if low <= -p[0] <= high])]
    return out


def _cell(k: int, same_label: bool, low: int, high: int):
    """``anchor, p, id, score`` of a grid cell; ``p`` is the positive's score (0 in the search for positives). Rows have ``anchor`` -1."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        a, r = part[part["anchor"] >= 0].reset_index(drop=True), part[part["anchor"] < 0].reset_index(drop=True)
        none = pd.DataFrame({c: np.zeros(0, np.int64) for c in ("anchor", "p", "id", "score")})
        if not len(a) or not len(r):
            return none
        a_id, r_id = a["id"].to_numpy(np.int64), r["id"].to_numpy(np.int64)
        codes = pd.factorize(pd.concat([a["label"], r["label"]], ignore_index=True))[0]
        a_label, r_label = codes[: len(a)], codes[len(a) :]

        def meets(some: np.ndarray, at: np.ndarray) -> np.ndarray:
            equal = a_label[some][:, None] == r_label[at][None, :]
            return (equal if same_label else ~equal) & (a_id[some][:, None] != r_id[at][None, :])

        x, y = np.stack(a["q"].to_numpy()).astype(float), np.stack(r["q"].to_numpy()).astype(float)
        most = max(np.abs(x).max(initial=0), 1) * max(np.abs(y).max(initial=0), 1) * max(x.shape[1], 1)
        scores = [[None] if same_label else list(p) for p in a["ps"]]
        # 100 * score is compared with low * p and high * p, in integers
        bands = [[(-math.inf, math.inf) if p is None else (-(-low * int(p) // 100), high * int(p) // 100) for p in ps] for ps in scores]
        if most * 100 >= EXACT or not np.isfinite(most):
            found = _brute(a, r, [[b[0] for b in s] for s in bands], [[b[1] for b in s] for s in bands], k, meets)
            which = [(i, scores[i][j], s, n) for i, j, s, n in found]
        else:
            flat = [b for s in bands for b in s]
            best = Best(np.array([b[0] for b in flat], float), np.array([b[1] for b in flat], float), k)
            upto = np.cumsum([0, *map(len, bands)])
            search(x, meets, y, r_id, best, [np.arange(i, j) for i, j in zip(upto, upto[1:])])
            owner = np.searchsorted(upto, best.slot, "right") - 1
            which = [(i, scores[i][j - upto[i]], int(s), n) for i, j, s, n in zip(owner.tolist(), best.slot.tolist(), best.score.tolist(), best.id.tolist())]
        if not which:
            return none
        limit = (1 << 63) - 1
        return pd.DataFrame({
            "anchor": a["anchor"].to_numpy(np.int64)[[w[0] for w in which]], "p": np.array([w[1] or 0 for w in which], np.int64),
            "id": np.array([w[3] for w in which], np.int64), "score": np.array([max(-limit, min(limit, w[2])) for w in which], np.int64),
        })

    return run


def _grid(rows: DataFrame, anchors: DataFrame, keys: list[str], cell) -> DataFrame:
    """Run ``cell`` on every (slice of anchors, block of rows) with equal ``keys``."""
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    sizes = sizes.join(anchors.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_anchors")), keys)  # keys without anchors have no cells
    sizes = staged(sizes.select(*keys, F.ceil(F.col("n_rows") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("n_anchors") / SLICE).cast("int").alias("slices")), "sizes")
    mine = lambda n: F.pmod(F.xxhash64("place"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    base = [c for c in ("dim", "label", "id", "q")]
    r = salted_join(rows.select("place", *base), sizes, keys).select(*base, F.lit(-1).cast("long").alias("anchor"), F.lit(None).cast("array<long>").alias("ps"), mine("blocks").alias("block"), every("slices").alias("slice"))
    a = salted_join(anchors.select("place", *base, "ps"), sizes, keys).select(*base, F.col("place").alias("anchor"), "ps", mine("slices").alias("slice"), every("blocks").alias("block"))
    both = r.unionByName(a)
    return both.groupBy(*keys, "slice", "block").applyInPandas(cell, "anchor long, p long, id long, score long")


def quantised(vectors: DataFrame, *, id_col: str, vector_col: str, label: Column, scale: int = SCALE) -> DataFrame:
    """``id, label, q, dim`` of the rows that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), F.transform(vector_col, lambda v: v.cast("double") * F.lit(float(scale))).alias("x"))
    finite = ~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    whole = F.transform("x", lambda v: F.when(F.abs(v) < EXACT, F.floor(v).cast("double")).otherwise(v))
    return rows.filter("id is not null and label is not null and x is not null").filter(finite).select("id", "label", whole.alias("q"), F.size("x").alias("dim"))


def mine(rows: DataFrame, is_anchor: Column, *, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """Hard negatives for the anchors among ``rows`` (``id, label, q, dim``).

    ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``; a negative's score is between ``low`` and ``high``
    percent of its positive's.
    """
    rows = staged(rows.select("id", "label", "q", "dim", F.monotonically_increasing_id().alias("place")), "rows")
    anchors = rows.filter(is_anchor).groupBy("id", "label", "q", "dim").agg(F.min("place").alias("place"))
    anchors = staged(anchors.withColumn("ps", F.array().cast("array<long>")), "anchors")
    near = _grid(rows, anchors, ["dim", "label"], _cell(positives, True, low, high))
    near = top_k(near, ["anchor"], [F.desc("score"), F.asc("id")], positives, ["id"])
    near = staged(near.select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("_rank").alias("turn")), "positives")
    slots = near.filter("positive_score >= 0").groupBy("anchor").agg(F.array_sort(F.collect_set("positive_score")).alias("ps"))  # at most ``positives`` of an anchor
    asked = staged(anchors.drop("ps").join(slots, F.col("place") == F.col("anchor")).select("id", "label", "q", "dim", "place", "ps"), "asked")
    found = _grid(rows, asked, ["dim"], _cell(negatives, False, low, high))
    found = top_k(found, ["anchor", "p"], [F.desc("score"), F.asc("id")], negatives, ["id"])
    found = found.select("anchor", F.col("p").alias("positive_score"), F.col("_rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    whose = anchors.select(F.col("place").alias("anchor"), F.col("id").alias("anchor_id"))
    return (
        near.join(found, ["anchor", "positive_score"]).join(whose, "anchor")
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
