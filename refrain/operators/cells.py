"""J3, A15, C5-C7 by metric partitioning: only points whose cells can hold neighbours of each other meet.

Some points, taken by a hash, are pivots; a point's *home* is the cell of its nearest pivot. A neighbour ``q`` of ``p`` lies on the
side of its own home's pivot, so ``p`` is at most epsilon away from the plane between the two pivots:

    (d(p, other)^2 - d(p, home)^2) / (2 d(home, other)) <= epsilon

Two neighbours of different homes may each visit the other's; one of the two cells, by the parity of their numbers, stands for the pair, so ``p`` is
copied to those cells only that stand for it and for which that holds. A pair of neighbours then meets once, where one is at home, and both are counted. Cells are dealt to grids of blocks, so one that holds a third of all points is spread over
many bounded groups. The number of pivots is what costs least on a sample: where points visit most cells anyway, more cells only
mean more copies.

Whether this saves anything depends on the data: with a small epsilon few points visit other cells, with a large one in many
dimensions nearly all points visit nearly all cells. So the copies and the comparisons are counted (after the distances to the
pivots, before any pair is formed) and ``partition`` answers None where the block pairs of ``neighbours`` are cheaper.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refrain.operators import neighbours as N
from refrain.operators import tiles as T
from refrain.operators.vectors import weighed, weights
from refrain.session import staged

PIVOTS = 256  # at most: they are sent to every task
CELL = 512  # points of a cell on average, while there are fewer pivots
SAMPLE = 2048  # points on which the copies are estimated
SLACK = 1e-9
FEW = 16  # pivots from which on more of them are used only where that costs less
MOVE_NS, COMPARE_NS = 20000.0, 5.0  # per copy of a point (which is also written and read) and per comparison


def pivots_of(points: DataFrame, n_points: int, most: int = PIVOTS, idf: np.ndarray | None = None) -> tuple[pd.DataFrame, pd.DataFrame]:
    """``pid, idx, val`` of the pivots and of SAMPLE other points: those with the lowest hashes."""
    count = max(2, min(most, math.ceil(n_points / CELL)))
    some = points.select("pid", "idx", "val" if idf is None else "tf").orderBy(F.xxhash64(F.lit("pivot"), "pid"), "pid").limit(count + SAMPLE).toPandas()
    if idf is not None:  # only the points taken are weighed
        some["val"] = [weights(np.asarray(i, np.int64), np.asarray(t, np.int64), np.array([len(i)]), idf) for i, t in zip(some["idx"], some.pop("tf"))]
    return some.iloc[:count].reset_index(drop=True), some.iloc[count:]


def _assign(pivots: pd.DataFrame, epsilon: float):
    width = N._dim(pivots)
    c, c2 = N._densify(pivots, width)
    apart = np.sqrt(np.maximum(c2[:, None] + c2[None, :] - 2 * c @ c.T, 0))
    number = np.arange(len(c))
    stands = ((number[:, None] + number[None, :]) % 2 == 0) == (number[None, :] < number[:, None])  # by home and other cell

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in parts:
            for at in range(0, len(whole), 2048):
                part = whole.iloc[at : at + 2048].reset_index(drop=True)
                dim = max(width, N._dim(part))
                x, x2 = N._densify(part, dim)
                d2 = x2[:, None] + c2[None, :] - 2 * x[:, :width] @ c.T
                home = d2.argmin(axis=1)
                beyond = d2 - d2[np.arange(len(x)), home][:, None]
                near = beyond <= 2 * apart[home] * (epsilon + SLACK) + SLACK
                near &= stands[home]
                near[np.arange(len(x)), home] = False
                yield part.assign(home=home.astype(np.int32), visits=[np.nonzero(v)[0].astype(np.int32) for v in near])

    return run


def assigned(points: DataFrame, similarity: float, chosen: pd.DataFrame) -> DataFrame:
    """The points with ``home`` and ``visits``, the other cells that may hold neighbours and stand for the pair."""
    schema = f"pid {N._pid_type(points)}, mult bigint, idx array<int>, val array<double>, home int, visits array<int>"
    rows = points.select("pid", F.col("mult").cast("bigint").alias("mult"), F.col("idx").cast("array<int>").alias("idx"), F.col("val").cast("array<double>").alias("val"))
    return staged(rows.mapInPandas(_assign(chosen, math.sqrt(N.eps2(similarity))), schema), "cells")


def cell_sizes(rows: DataFrame) -> DataFrame:
    """``cell, own, members``: one row per pivot at most."""
    own = rows.groupBy(F.col("home").alias("cell")).agg(F.count(F.lit(1)).alias("own"))
    visitors = rows.select(F.explode("visits").alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("visitors"))
    return staged(own.join(visitors, "cell", "left").select("cell", "own", (F.col("own") + F.coalesce("visitors", F.lit(0))).alias("members")), "cell-sizes")


def _counts(most: int) -> list[int]:
    """Numbers of pivots to choose from."""
    return sorted({min(most, c) for c in (FEW, 4 * FEW, 16 * FEW)} | {most})


def _sample_visits(chosen: pd.DataFrame, sample: pd.DataFrame, similarity: float) -> float:
    """Other cells that a point of the sample visits, on average."""
    return pd.concat(_assign(chosen, math.sqrt(N.eps2(similarity)))([sample]))["visits"].map(len).mean()


def partition(points: DataFrame, similarity: float, n_points: int, block: int, pivots: int = PIVOTS, force: bool = False, idf: np.ndarray | None = None) -> tuple[DataFrame, DataFrame] | None:
    """``(assigned points, cell sizes)``, or None where the block pairs move or compare less."""
    blocks = N.block_count(n_points, block)
    if blocks == 1 and not force:
        return None
    chosen, sample = pivots_of(points, n_points, pivots, idf)
    if len(sample):
        tried = {count: _sample_visits(chosen.iloc[:count], sample, similarity) for count in _counts(len(chosen))}
        count = min(tried, key=lambda c: (1 + tried[c]) * (MOVE_NS + COMPARE_NS * n_points / c))
        if not force and (1 + tried[count] >= blocks or (1 + tried[count]) / count >= 0.5):
            return None
        chosen = chosen.iloc[:count]
    rows = assigned(points if idf is None else weighed(points, idf), similarity, chosen)
    sizes = cell_sizes(rows)
    total = sizes.agg(F.sum("members").alias("copies"), F.sum(F.col("own") * F.col("members")).alias("pairs")).first()
    copies, pairs = total["copies"] or 0, total["pairs"] or 0
    N.LAST_RUN.update(points=n_points, cell_copies=copies, cell_pairs=pairs, block_copies=n_points * blocks, block_pairs=n_points * n_points // 2)
    return (rows, sizes) if force or copies < n_points * blocks and pairs < n_points * n_points // 2 else None


def _dealt(rows: DataFrame, sizes: DataFrame, block: int) -> DataFrame:
    """Rows of a grid of blocks per cell: ``asks`` points look for neighbours among the ``has`` points of their group, whose ``guest`` points don't ask them elsewhere."""
    block = N.block_rows(block, N.mean_width(rows)[1])
    blocks = sizes.select("cell", F.ceil(F.col("own") / block).cast("int").alias("qs"), F.ceil(F.col("members") / block).cast("int").alias("ms"))
    mine = lambda n: F.pmod(F.xxhash64("pid"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    base = [c for c in rows.columns if c not in ("home", "visits")]
    own = rows.withColumn("cell", F.col("home")).join(F.broadcast(blocks), "cell")  # one row per pivot
    asks = own.select(*base, "cell", mine("qs").alias("q"), every("ms").alias("m"), F.lit(True).alias("asks"), mine("ms").alias("_m"))
    asks = asks.select(*base, "cell", "q", "m", "asks", (F.col("m") == F.col("_m")).alias("has"), F.lit(False).alias("guest"))
    homes = own.select(*base, "cell", every("qs").alias("q"), mine("ms").alias("m"), mine("qs").alias("_q")).filter("q <> _q").drop("_q").withColumn("guest", F.lit(False))
    guests = rows.withColumn("cell", F.explode("visits")).join(F.broadcast(blocks), "cell").select(*base, "cell", every("qs").alias("q"), mine("ms").alias("m"), F.lit(True).alias("guest"))
    has = homes.unionByName(guests).select(*base, "cell", "q", "m", F.lit(False).alias("asks"), F.lit(True).alias("has"), "guest")
    return asks.unionByName(has)


def _spread(dealt: DataFrame) -> DataFrame:
    """A fixed number of tasks: the groups are bound by CPU, and adaptive execution would merge them by size."""
    spark = dealt.sparkSession
    return dealt.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), "cell", "q", "m")


def cell_hits(rows: DataFrame, sizes: DataFrame, similarity: float, block: int = N.DEFAULT_BLOCK) -> DataFrame:
    """Pass 1, where a point has neighbours: ``cnt`` of their copies for those that ask and for guests, ``other`` if one is another point."""
    thr = N.eps2(similarity)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        asks, has, guest = (table.column(c).to_numpy() for c in ("asks", "has", "guest"))
        one, rows = np.nonzero(asks)[0], T.Rows.of(table)
        mult = table.column("mult").to_numpy().astype(np.float64)
        cnt, other = np.zeros(len(asks), np.int64), np.zeros(len(asks), bool)
        for two in (np.nonzero(has & ~guest)[0], np.nonzero(has & guest)[0]):
            for r, c, near in T.near_tiles(rows, one, two, thr):
                r, c = one[r], two[c]
                cnt[r] += T.weighed(near, mult[c])
                if guest[c[0]]:
                    cnt[c] += T.weighed_columns(near, mult[r])
                else:
                    near[np.intersect1d(r, c, return_indices=True)[1:]] = False
                other[r] |= near.any(axis=1)
                other[c] |= near.any(axis=0)
        told = np.nonzero(cnt.astype(bool) | other | (asks & has))[0]  # every point asks in one group among its own block
        place = {c: pa.array(np.full(len(told), k.as_py(), np.int32)) for c, k in zip(("cell", "q", "m"), key)}
        return pa.table({"pid": N._column(table, "pid").take(pa.array(told)), **place, "asks": asks[told], "has": has[told], "cnt": cnt[told], "other": other[told]})

    found = _spread(_dealt(rows.select("pid", "mult", "idx", "val", "home", "visits"), sizes, block)).groupBy("cell", "q", "m")
    return found.applyInArrow(run, f"pid {N._pid_type(rows)}, cell int, q int, m int, asks boolean, has boolean, cnt bigint, other boolean")


def cell_weights(rows: DataFrame, sizes: DataFrame, similarity: float, block: int = N.DEFAULT_BLOCK, hits: DataFrame | None = None) -> DataFrame:
    """``pid, n_neighbours``, the point itself included; ``hits``: those of pass 1, where they are known."""
    hits = cell_hits(rows, sizes, similarity, block) if hits is None else hits
    return hits.groupBy("pid").agg(F.sum("cnt").alias("n_neighbours"))


def cell_links(rows: DataFrame, sizes: DataFrame, similarity: float, block: int = N.DEFAULT_BLOCK, hits: DataFrame | None = None) -> DataFrame:
    """``kind, a, b`` as ``neighbours.core_links`` gives them, from rows with ``core``; with ``hits``, from the groups of pass 1 that hold neighbours."""
    thr = N.eps2(similarity)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        one, two = (np.nonzero(table.column(c).to_numpy())[0] for c in ("asks", "has"))
        links = T.Links(table.column("core").to_numpy().astype(bool))
        if links.core.any():
            for r, c, near in T.near_tiles(T.Rows.of(table), one, two, thr, needed=links.needed):
                links.add(one[r], two[c], near)
        return links.frame(N._column(table, "pid"))

    t = N._pid_type(rows)
    if hits is None:
        dealt = _dealt(rows.select("pid", "idx", "val", "core", "home", "visits"), sizes, block)
    else:
        where = hits.filter("other").groupBy("pid", "cell", "q", "m").agg(F.bool_or("asks").alias("asks"), F.bool_or("has").alias("has"))
        dealt = rows.select("pid", "idx", "val", "core").join(where, "pid")
    return _spread(dealt).groupBy("cell", "q", "m").applyInArrow(run, f"kind string, a {t}, b {t}").distinct()
