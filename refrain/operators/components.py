"""Connected components by randomised contraction, and the salted join it relies on.

Every round replaces each node by the member of its closed neighbourhood with the lowest hash (a new
hash each round) and drops the loops, so the number of nodes shrinks by a constant factor in expectation
whatever the shape of the graph: long chains, stars and cliques all end after O(log n) rounds. The loop
stops when no edge is left; there is no round limit. Every round is written to the session's shared
folder, so a lost executor repeats one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refrain.session import staged

FILES_PER_CORE = 4
SALTS = 8  # pieces into which the rows of one key are dealt


def salted_join(probe: DataFrame, build: DataFrame, keys: list[str], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Equi-join whose ``probe`` rows of one key go to ``salts`` tasks; ``build`` (narrow, one row per key) is repeated.

    ``how`` is ``inner`` or ``left``. Rows with a null key match nothing, as in any equi-join.
    """
    p = probe.withColumn("_salt", F.pmod(F.xxhash64(*probe.columns), F.lit(salts)).cast("int"))
    b = build.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return p.join(b, [*keys, "_salt"], how).drop("_salt")


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges (a, b)`` -> ``(node, component)``; ``component`` is the smallest node that can be reached.

    Only nodes with an edge to another node are returned; loops, repeated edges and edges with a null end
    are ignored. Node values may be of any type that has an order and a hash.
    """
    live = _kept(_plain(edges.select("a", "b")), "edges")
    images = []
    while not live.isEmpty():
        images.append(_kept(_images(live, len(images)), "images"))
        to = images[-1]
        moved = salted_join(live, to.select(F.col("node").alias("a"), F.col("image").alias("na")), ["a"])
        moved = salted_join(moved, to.select(F.col("node").alias("b"), F.col("image").alias("nb")), ["b"])
        live = _kept(_plain(moved.select(F.col("na").alias("a"), F.col("nb").alias("b"))), "edges")
    if not images:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("component")).filter(F.lit(False))
    found = images[-1]
    for to in reversed(images[:-1]):
        later = found.select(F.col("node").alias("image"), F.col("image").alias("last"))
        found = salted_join(to, later, ["image"], "left").select("node", F.coalesce("last", "image").alias("image"))
    found = _kept(found, "roots")
    least = found.groupBy("image").agg(F.min("node").alias("component"))
    return salted_join(found, least, ["image"]).select("node", "component")


def _kept(rows: DataFrame, label: str) -> DataFrame:
    """Narrow rows in a few files per core: the rounds shrink fast, and small tables should be seen as such."""
    return staged(rows.coalesce(FILES_PER_CORE * rows.sparkSession.sparkContext.defaultParallelism), label)


def _plain(edges: DataFrame) -> DataFrame:
    low, high = F.least("a", "b"), F.greatest("a", "b")
    return edges.filter((F.col("a") != F.col("b"))).select(low.alias("a"), high.alias("b")).distinct()


def _images(live: DataFrame, turn: int) -> DataFrame:
    both = live.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(
        live.select(F.col("b").alias("node"), F.col("a").alias("near"))
    )
    mark = lambda c: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("h"), F.col(c).alias("v"))
    best = both.groupBy("node").agg(F.min(mark("near")).alias("m"))
    return best.select("node", F.least(F.col("m"), mark("node"))["v"].alias("image"))
