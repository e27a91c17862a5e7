"""Embedding near-duplicates through an inverted multi-index.

Vectors are scaled to length one and cut into two halves. Each half has its own codebook (k-means on a bounded
sample, trained in two tasks), and the product of the codebooks forms a grid of cells. Every vector is listed in
the cell of its nearest codewords. As a query it visits cells in the order of multi-sequence traversal: the codewords
of both halves are ranked by the distance from the query's half to their Voronoi region, and a heap yields
pairs in ascending sum of squares. Traversal stops at the radius at which the target recall is met: by bisectors, the
region of a vector at distance ``r`` lies within ``r`` in each half, so ``radius = r`` can't lose a link; for a target
below 1 the radius is the target quantile of what sampled vectors moved by exactly ``r`` in random directions need.
A pair in two cells is looked for once, by the vector of the cell that comes first.

Cells are verified exactly in double precision. The owners and visitors of a cell are dealt to a grid of blocks, so a
cell that holds a third of all vectors is spread over many tasks of bounded size. Tasks emit one count per vector and a
chain of links per component of the block, never the pairs. Equal vectors are one point with a multiplicity.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite component, and vectors without a
label or id, link with nothing (``n_links`` 0, themselves as component, kept); vectors of different length are
never compared; rows with one id are the same vector: they never link to each other, and their links add up; an
empty table gives an empty table. The result holds the id and the operator's own columns only.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refrain.operators.components import connected_components, salted_join
from refrain.session import staged

SIMILARITY = 0.98
SAMPLE = 20_000  # vectors that train a codebook
CODEWORDS = 256  # of a half, at most
CELL = 200  # vectors of an average cell, over all labels
BLOCK = 1024
TARGET_RECALL = 0.9999
ROUNDS = 12  # of k-means


def kmeans(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    draw = np.random.default_rng(seed)
    centres = x[draw.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(ROUNDS):
        near = _squared(x, centres).argmin(axis=1)
        n = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
    return centres


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * x @ c.T, 0)


class Half:
    """A codebook and, for halves of vectors, their codeword and squared distances to all Voronoi regions."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.apart = np.sqrt(_squared(words, words))

    def look(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = _squared(x, self.words)
        own = d.argmin(axis=1)
        gap = d - d[np.arange(len(x)), own][:, None]
        apart = self.apart[own]
        to = np.where(apart > 0, gap / np.where(apart > 0, 2 * apart, 1), 0.0)
        return own, to * to


def traverse(first: np.ndarray, second: np.ndarray, limit: float) -> list[tuple[int, int]]:
    """Cells in ascending ``first[i] + second[j]``, up to ``limit`` (multi-sequence traversal)."""
    one, two = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    a, b = first[one].tolist(), second[two].tolist()
    heap, seen, out = [(a[0] + b[0], 0, 0)], {(0, 0)}, []
    while heap and heap[0][0] <= limit:
        _, i, j = heapq.heappop(heap)
        out.append((int(one[i]), int(two[j])))
        for step in ((i + 1, j), (i, j + 1)):
            if step[0] < len(a) and step[1] < len(b) and step not in seen:
                seen.add(step)
                heapq.heappush(heap, (a[step[0]] + b[step[1]], *step))
    return out


def radius_for(sample: np.ndarray, halves: list[Half], distance: float, recall: float, seed: int = 7) -> float:
    """Squared radius of the traversal; ``distance`` itself for full recall."""
    if recall >= 1:
        return distance * distance + 1e-9
    draw = np.random.default_rng(seed)
    x = sample[draw.integers(0, len(sample), 4000)]
    # a unit vector at the given distance: turn x by the angle towards a random orthogonal direction
    turn = draw.normal(size=x.shape)
    turn -= (turn * x).sum(1)[:, None] * x
    turn /= np.maximum(np.linalg.norm(turn, axis=1)[:, None], 1e-300)
    cos = 1 - distance * distance / 2
    y = cos * x + math.sqrt(max(1 - cos * cos, 0)) * turn
    cut = x.shape[1] // 2
    needed = np.zeros(len(x))
    for half, part in zip(halves, (slice(0, cut), slice(cut, None))):
        needed += half.look(x[:, part])[1][np.arange(len(x)), half.look(y[:, part])[0]]
    return float(min(np.quantile(needed, recall) * 1.05 + 1e-9, distance * distance + 1e-9))


def _train(k: int):
    def run(key, part: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(part.sort_values("id")["unit"].to_numpy())
        cut = x.shape[1] // 2
        words = kmeans(x[:, :cut] if key[0] == 0 else x[:, cut:], k, seed=int(key[0]))
        return pd.DataFrame({"half": key[0], "word": list(words)})

    return run


def _visit(halves: list[Half], limit: float, cut: int):
    """``id, label, cell, unit, owner``: a row for the own cell and one for every later cell in reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_second = len(halves[1].words)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                some = batch.slice(at, 2048)
                x = np.stack(some.column("unit").to_numpy(zero_copy_only=False))
                (own1, to1), (own2, to2) = halves[0].look(x[:, :cut]), halves[1].look(x[:, cut:])
                row, cell, owner = [], [], []
                for i in range(len(x)):
                    home = int(own1[i]) * n_second + int(own2[i])
                    reach = [c for a, b in traverse(to1[i], to2[i], limit) if (c := a * n_second + b) > home]
                    row += [i] * (1 + len(reach))
                    cell += [home, *reach]
                    owner += [True] + [False] * len(reach)
                out = some.take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(cell, pa.int64()), pa.array(owner, pa.bool_())], [*out.schema.names, "cell", "owner"])

    return run


def _verify(similarity: float):
    """Counts and a chain per linked component of queries against owners."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        asks, owns = part[part["asks"]], part[part["owner"]]
        if not len(asks) or not len(owns):
            return pd.DataFrame({"a": part["id"].iloc[:0], "b": part["id"].iloc[:0], "n": np.zeros(0, np.int64)})
        x, y = np.stack(asks["unit"].to_numpy()), np.stack(owns["unit"].to_numpy())
        linked = x @ y.T >= similarity
        # of two owners only the later one asks; a visitor asks every owner of the cell
        same_cell = asks["home"].to_numpy(bool)[:, None]
        linked &= ~same_cell | (asks["id"].to_numpy()[:, None] > owns["id"].to_numpy()[None, :])
        linked &= asks["id"].to_numpy()[:, None] != owns["id"].to_numpy()[None, :]
        ii, jj = np.nonzero(linked)
        up = pd.DataFrame({"a": asks["id"].to_numpy(), "n": linked @ owns["mult"].to_numpy(np.int64)})
        down = pd.DataFrame({"a": owns["id"].to_numpy(), "n": linked.T @ asks["mult"].to_numpy(np.int64)})
        counts = pd.concat([up[up["n"] > 0], down[down["n"] > 0]], ignore_index=True)
        ids = np.concatenate([asks["id"].to_numpy(), owns["id"].to_numpy()])
        chain = _chain(ids, ii, jj + len(asks))
        return pd.concat([counts.assign(b=None), pd.DataFrame(chain, columns=["a", "b"]).assign(n=0)], ignore_index=True)[["a", "b", "n"]]

    return run


def _chain(ids: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Consecutive members of each component of the links ``u, v``: few edges and low degrees."""
    if not len(u):
        return np.zeros((0, 2), ids.dtype)
    label = np.arange(len(ids))
    while True:
        low = label.copy()
        np.minimum.at(low, u, label[v])
        np.minimum.at(low, v, label[u])
        low = low[low]
        if np.array_equal(low, label):
            break
        label = low
    used = np.unique(np.concatenate([u, v]))
    order = used[np.lexsort((ids[used], label[used]))]
    next_to = label[order[1:]] == label[order[:-1]]
    pairs = np.stack([ids[order[:-1]], ids[order[1:]]], axis=1)[next_to]
    return pairs[pairs[:, 0] != pairs[:, 1]]


def units(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``id, label, unit`` of the vectors that can link."""
    x = F.transform(vector_col, lambda v: v.cast("double"))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), x.alias("x"))
    big = F.array_max(F.transform("x", F.abs))  # scaled first, so that squares stay finite
    rows = rows.filter("id is not null and label is not null and size(x) > 0").filter(
        ~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & (big > 0)
    )
    rows = rows.withColumn("x", F.transform("x", lambda v: v / big))
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
    return rows.withColumn("norm", norm).select("id", "label", F.transform("x", lambda v: v / F.col("norm")).alias("unit"))


def near_duplicates(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", similarity: float = SIMILARITY, target_recall: float = TARGET_RECALL,
) -> DataFrame:
    """``id, n_links, component_id, kept`` of every vector."""
    kind = vectors.schema[id_col].dataType.simpleString()
    points = staged(units(vectors, id_col, vector_col, label_col).withColumn("label", F.col("label").cast("string")), "units")
    mark = [F.xxhash64("unit").alias("h1"), F.hash("unit").alias("h2")]
    marked = points.select("id", "label", "unit", *mark)
    groups = marked.groupBy("label", "h1", "h2", "unit").agg(F.min("id").alias("rep"), F.countDistinct("id").alias("mult"))
    groups = staged(groups, "points")
    members = salted_join(marked.select("id", "label", "h1", "h2", "unit"), groups.filter("mult > 1").select("label", "h1", "h2", F.col("unit").alias("same"), "rep", "mult"), ["label", "h1", "h2"])
    members = staged(members.filter(F.col("unit") == F.col("same")).select("id", "rep", "mult").distinct(), "copies")
    found = staged(_links(groups.select(F.col("rep").alias("id"), "label", "unit", "mult"), similarity, target_recall, kind), "found")
    counts = found.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    edges = found.filter(F.col("b").isNotNull()).select("a", "b").unionByName(members.filter("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b")))
    parts = staged(connected_components(edges), "components")
    # links of a copy: its representative's, and the other copies
    copied = salted_join(members, counts, ["rep"], "left").select("id", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n"))
    single = counts.join(members.select(F.col("id").alias("rep")).distinct(), "rep", "left_anti").select(F.col("rep").alias("id"), "n")
    links = copied.unionByName(single).groupBy("id").agg(F.sum("n").alias("n"))
    out = vectors.select(F.col(id_col).alias("id")).join(links, "id", "left").join(parts.select(F.col("node").alias("id"), "component"), "id", "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept")
    )


def build_index(points: DataFrame, similarity: float, target_recall: float) -> tuple[list[Half], float, int] | None:
    """Codebooks, squared radius and the place of the cut, for vectors of one length."""
    n = points.count()
    if not n:
        return None
    share = min(1.0, SAMPLE / n)
    sample = points.filter(F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("id", "unit")
    k = int(min(CODEWORDS, max(2, round(math.sqrt(n / CELL)))))
    both = sample.withColumn("half", F.explode(F.array(F.lit(0), F.lit(1))))
    words = both.groupBy("half").applyInPandas(_train(k), "half int, word array<double>").collect()  # 2 * CODEWORDS rows at most
    if not words:
        return None
    halves = [Half(np.array([w["word"] for w in words if w["half"] == h], float)) for h in (0, 1)]
    cut = halves[0].words.shape[1]
    some = np.array([r["unit"] for r in sample.orderBy(F.xxhash64(F.lit("radius"), "id"), "id").limit(2000).collect()], float)
    return halves, radius_for(some, halves, math.sqrt(2 - 2 * similarity), target_recall), cut


def _links(points: DataFrame, similarity: float, target_recall: float, kind: str) -> DataFrame:
    """``a, b, n`` over all lengths of vectors: ``n`` links of ``a`` (b null), or a link between a and b (n 0)."""
    out = points.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0).cast("long").alias("n")).filter(F.lit(False))
    lengths = [r[0] for r in points.select(F.size("unit")).distinct().collect()]  # a column of vectors has a few lengths
    for length in sorted(lengths):
        own = points.filter(F.size("unit") == length)
        if length < 2:  # a single component: the sign decides, and it is the whole vector
            own = own.withColumn("unit", F.concat("unit", F.array(F.lit(0.0))))
        index = build_index(own, similarity, target_recall)
        if index:
            out = out.unionByName(_search(own, index, similarity, kind))
    return out


def _search(points: DataFrame, index: tuple[list[Half], float, int], similarity: float, kind: str) -> DataFrame:
    halves, limit, cut = index
    listed = points.select("id", "label", "mult", "unit").mapInArrow(_visit(halves, limit, cut), f"id {kind}, label string, mult long, unit array<double>, cell long, owner boolean")
    listed = staged(listed, "cells")
    sizes = listed.groupBy("label", "cell").agg(F.count(F.lit(1)).alias("n_asks"), F.count_if("owner").alias("n_owners")).filter("n_owners > 0 and n_asks > 1")
    blocks = sizes.select("label", "cell", F.ceil(F.col("n_asks") / BLOCK).cast("int").alias("qs"), F.ceil(F.col("n_owners") / BLOCK).cast("int").alias("os"))
    rows = salted_join(listed, blocks, ["label", "cell"])
    mine = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    base = ["id", "label", "cell", "mult", "unit"]
    asks = rows.select(*base, mine("qs").alias("q"), every("os").alias("o"), F.col("owner").alias("home"), F.lit(True).alias("asks"), mine("os").alias("_o"))
    # in the block where an owner also asks, one row has both parts
    asks = asks.select(*base, "q", "o", "home", "asks", (F.col("home") & (F.col("o") == F.col("_o"))).alias("owner"))
    owns = rows.filter("owner").select(*base, every("qs").alias("q"), mine("os").alias("o"), F.lit(True).alias("home"), F.lit(False).alias("asks"), F.lit(True).alias("owner"), mine("qs").alias("_q"))
    owns = owns.filter("q <> _q").drop("_q")
    return asks.unionByName(owns).groupBy("label", "cell", "q", "o").applyInPandas(_verify(similarity), f"a {kind}, b {kind}, n long")
