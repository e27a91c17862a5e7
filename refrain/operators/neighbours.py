"""Exact epsilon-neighbourhoods and DBSCAN on Spark.

Points are unit (or zero) vectors in the sparse layout ``idx``/``val``.
Two vectors are neighbours when ``|a|^2 + |b|^2 - 2 a.b <= 2 (1 - s) + 1e-9``;
this is the Euclidean test on normalised vectors and also treats zero vectors
right (zero-zero distance 0, zero-unit distance 1).

Plan (all shuffles keyed by generated block ids, so no content key can be hot; where epsilon is small against
the spread of the points, ``cells.py`` replaces steps 2 to 4):

1. *Collapse*: equal vectors become one point with a ``mult`` (copies) and the
   lowest ``ord`` as its id. Same labels, far fewer pairs.
2. *Blocks*: each point gets ``blk = hash(pid) mod B`` (``pair_blocks``: as few as keep all cores busy, of bounded size),
   and is replicated to the block pairs ``(min(blk, j), max(blk, j))``, in packets of compressed columns.
   Every group then holds at most two blocks: bounded memory per task.
3. *Pass 1* (``applyInArrow``): the rows of a block pair are compared a tile at a time (``tiles.py``); the task
   emits only per-point neighbour weights, summed in Spark -> core flags.
4. *Pass 2*: the same block pairs with core flags, but a point goes only to those in which pass 1 found
   it another neighbour; each task reduces its core-core edges to a star forest (one edge per core,
   never all pairs) and its border links to one core per local component.
5. *Components*: of at most FINISH edges in one task; of more by randomised contraction of the forest
   (``components.py``), whose rounds are written to the session's checkpoint folder.
6. Borders join the adjacent cluster discovered first (lowest root ``ord``);
   points with no core neighbour are noise and dropped.
"""

from __future__ import annotations

import hashlib
import math
import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refrain.operators import components
from refrain.operators import tiles as T
from refrain.operators.memory import give_back, released
from refrain.operators.vectors import weighed
from refrain.session import ensure_checkpoint_dir, staged

DEFAULT_BLOCK = 2048
BLOCKS = 16  # of more, blocks grow instead
BLOCK_ROWS, BLOCK_BYTES = 65536, 64_000_000  # the largest block
PACKED = 65536  # rows that are dealt to packets at once
LARGE = 16384  # points of a group whose memory is worth giving back at once
PAIRS_PER_CORE = 3  # block pairs that keep the cores even; of more, a point only moves more often
FINISH = 1_000_000  # edges that one task joins: about 100 MB
EPS_SLACK = 1e-9
LAST_RUN = {}  # timing of the latest component search, for bench.py


def eps2(similarity: float) -> float:
    """Squared Euclidean radius for a cosine threshold on unit vectors."""
    return 2.0 * (1.0 - similarity) + EPS_SLACK


def collapse(vectors: DataFrame, ords: DataFrame | None, idf: np.ndarray | None = None) -> tuple[DataFrame, DataFrame]:
    """Equal vectors -> one point. Returns ``(points, membership)``.

    ``vectors``: ``doc, idx, val`` and optionally ``tf`` (term counts); ``ords``: ``doc, ord``.
    With ``tf`` the key is the exact (term, count) list, so copies collapse even
    when their weights differ in the last bit; otherwise the values themselves. Without ``ords`` each ``doc`` is its own, and comes once.
    ``points``: ``pid, mult, idx, val`` (pid = lowest ord of the copies);
    ``membership``: ``doc, pid``. With ``idf`` (the weights of the terms) only the counts are moved, the
    weights are made again from them, and ``points`` have ``tf`` too.
    """
    if idf is not None:
        points, membership = collapse_counts(vectors, ords)
        return weighed(points, idf), membership
    key = ["idx", "tf"] if "tf" in vectors.columns else ["idx", "val"]
    v = _ordered(vectors, ords)
    extra = [F.min("val").alias("val")] if "tf" in key else []
    points = v.groupBy(*key).agg(F.min("ord").alias("pid"), F.count(F.lit(1)).alias("mult"), *extra)
    membership = v.join(points.select(*key, "pid"), key).select("doc", "pid")
    return points.select("pid", "mult", "idx", "val"), membership


def _ordered(vectors: DataFrame, ords: DataFrame | None) -> DataFrame:
    return vectors.join(ords, "doc") if ords is not None else vectors.filter(F.col("doc").isNotNull()).withColumn("ord", F.col("doc"))


def collapse_counts(counts: DataFrame, ords: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """``collapse`` of ``doc, idx, tf`` to points without weights (``pid, mult, idx, tf``), a written table.

    The lists cross the network once, in the narrowest types; who belongs to a point is found by the SHA-256 of its lists.
    """
    v = _ordered(counts.select("doc", "idx", "tf"), ords)
    kinds = {f.name: f.dataType for f in v.schema.fields}
    most = counts.agg(F.max(F.array_max("idx")).alias("idx"), F.max(F.array_max("tf")).alias("tf")).first()
    key = ("idx", "tf")
    slim = v.withColumns({c: F.col(c).cast(f"array<{_narrowest(most[c] or 0)}>") for c in key})
    points = slim.groupBy(*key).agg(F.min("ord").alias("pid"), F.count(F.lit(1)).alias("mult"))
    points = staged(points.select("pid", "mult", *[F.col(c).cast(kinds[c]).alias(c) for c in key]), "points")
    return points, _signed(v, "doc").join(_signed(points, "pid"), "lists").select("doc", "pid")


@released
def _sign(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts:
        batch = batch.filter(pc.and_(pc.is_valid(batch.column("idx")), pc.is_valid(batch.column("tf"))))
        lists = [batch.column(c) for c in ("idx", "tf")]
        ends = [np.append(0, np.cumsum(pc.list_value_length(x).to_numpy(zero_copy_only=False))) for x in lists]
        flat = [x.flatten().to_numpy(zero_copy_only=False).astype("<i8") for x in lists]
        signs = [hashlib.sha256(b"".join(f[e[i] : e[i + 1]].tobytes() for f, e in zip(flat, ends))).digest() for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signs, pa.binary())], [batch.schema.names[0], "lists"])


def _signed(rows: DataFrame, key: str) -> DataFrame:
    """``key, lists``: the SHA-256 of ``idx`` and ``tf``, which have equal lengths."""
    return rows.select(key, "idx", "tf").mapInArrow(_sign, f"{key} {rows.schema[key].dataType.simpleString()}, lists binary")


def _narrowest(most: int) -> str:
    """The narrowest type of whole numbers up to ``most``."""
    return "tinyint" if most < 1 << 7 else "smallint" if most < 1 << 15 else "int" if most < 1 << 31 else "bigint"


def _densify(pdf: pd.DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(pdf)
    x = np.zeros((n, dim), dtype=np.float64)
    lens = pdf["idx"].map(len).to_numpy()
    if lens.sum() > 0:
        rows = np.repeat(np.arange(n), lens)
        cols = np.concatenate([np.asarray(a, dtype=np.int64) for a in pdf["idx"].to_numpy() if len(a)])
        vals = np.concatenate([np.asarray(a, dtype=np.float64) for a in pdf["val"].to_numpy() if len(a)])
        x[rows, cols] = vals
    return x, np.einsum("ij,ij->i", x, x)


def _dim(pdf: pd.DataFrame) -> int:
    m = [int(np.max(a)) for a in pdf["idx"].to_numpy() if len(a)]
    return (max(m) + 1) if m else 1


def _sides(key: tuple, table: pa.Table) -> tuple[int, int, np.ndarray, np.ndarray]:
    bi, bj = key[0].as_py(), key[1].as_py()  # and the task, which comes of them
    blk = table.column("blk").to_numpy()
    one = np.nonzero(blk == bi)[0]
    return bi, bj, one, one if bi == bj else np.nonzero(blk == bj)[0]


def _pack(by: list[str]):
    """Rows with the same ``by``, of up to PACKED at once, as one packet: compressed Arrow columns, about a third of the rows' bytes."""

    def packets(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches).combine_chunks()
        keys = [table.column(c).to_numpy() for c in by]
        order = np.lexsort(keys)
        first = np.nonzero(np.any([np.diff(k[order], prepend=-1) for k in keys], axis=0))[0]
        table = table.take(pa.array(order))
        for a, b in zip(first, np.append(first[1:], len(order))):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(table.slice(a, b - a))
            key = [pa.array(k[order[a : a + 1]].astype(np.int32)) for k in keys]
            yield pa.RecordBatch.from_arrays([*key, pa.array([sink.getvalue().to_pybytes()], pa.binary())], [*by, "packet"])

    @released
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in parts:
            held, n = [*held, batch], n + batch.num_rows
            if n >= PACKED:
                yield from packets(held)
                held, n = [], 0
        if n:
            yield from packets(held)

    return run


def _packets(rows: DataFrame, by: list[str]) -> DataFrame:
    """``by`` (numbers from 0 on) and ``packet``: what crosses the network for ``rows``."""
    return rows.mapInArrow(_pack(by), ", ".join(f"{c} int" for c in by) + ", packet binary")


def _unpacked(table: pa.Table) -> pa.Table:
    return pa.concat_tables(pa.ipc.open_stream(p.as_buffer()).read_all() for p in table.column("packet"))


def _hits_fn(thr: float, idf: np.ndarray | None = None):
    def fn(key, table):
        table = _unpacked(table)
        bi, bj, one, two = _sides(key, table)
        rows = T.Rows.of(table, idf)
        mult = table.column("mult").to_numpy().astype(np.float64)
        table = table.select(["pid"])  # the lists are in the rows
        large = rows.n > LARGE
        cnt, other = np.zeros(rows.n, np.int64), np.zeros(rows.n, bool)
        for r, c, near in T.near_tiles(rows, one, two, thr, symmetric=bi == bj):
            left, right = one[r], two[c]
            cnt[left] += T.weighed(near, mult[right])
            if bi == bj and r[0] == c[0]:  # the diagonal tile holds its mirror image, and each point itself
                other[left] |= np.count_nonzero(near, axis=1) > near.diagonal()
            else:
                cnt[right] += T.weighed_columns(near, mult[left])
                other[left] |= near.any(axis=1)
                other[right] |= near.any(axis=0)
        told = np.arange(len(cnt)) if bi == bj else np.nonzero(cnt)[0]  # every point is told of once at least
        pair = {c: pa.array(np.full(len(told), v, np.int32)) for c, v in (("bi", bi), ("bj", bj))}
        del rows
        if large:
            give_back()
        return pa.table({"pid": _column(table, "pid").take(pa.array(told)), **pair, "cnt": cnt[told], "other": other[told]})

    return fn


def _column(table: pa.Table, name: str) -> pa.Array:
    return pa.chunked_array(table.column(name)).combine_chunks()


def _links_fn(thr: float, idf: np.ndarray | None = None):
    def fn(key, table):
        table = _unpacked(table)
        bi, bj, one, two = _sides(key, table)
        links = T.Links(table.column("core").to_numpy().astype(bool))
        if links.core.any():
            rows, table = T.Rows.of(table, idf), table.select(["pid"])
            for r, c, near in T.near_tiles(rows, one, two, thr, symmetric=bi == bj, needed=links.needed):
                links.add(one[r], two[c], near)
            rows = None
            if table.num_rows > LARGE:
                give_back()
        return links.frame(_column(table, "pid"))

    return fn


def _block(n_blocks: int):
    return F.pmod(F.xxhash64("pid"), F.lit(n_blocks)).cast("int")


def _dealt(pairs: DataFrame, n_blocks: int) -> DataFrame:
    """Rows of ``bi <= bj`` by ``task``: the pairs are numbered, the halves (``bi = bj``) last, and dealt in turn, so that none waits behind another
    by the chance of a hash. The groups are bound by CPU, so their number of tasks is fixed: adaptive execution would merge them by size."""
    spark = pairs.sparkSession
    n_pairs = n_blocks * (n_blocks + 1) // 2
    cap = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    tasks = min(n_pairs, cap)
    number = F.when(F.col("bi") < F.col("bj"), F.expr("bj * (bj - 1) div 2") + F.col("bi")).otherwise(F.lit(n_blocks * (n_blocks - 1) // 2) + F.col("bi"))
    return pairs.withColumn("task", F.pmod(number, F.lit(tasks)).cast("int")).repartitionById(tasks, "task")


def _replicate(points: DataFrame, n_blocks: int) -> DataFrame:
    p = _packets(points.withColumn("blk", _block(n_blocks)), ["blk"])
    j = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("j")
    pairs = p.select("*", j).select("*", F.least("blk", "j").alias("bi"), F.greatest("blk", "j").alias("bj")).drop("blk", "j")
    return _dealt(pairs, n_blocks)


def _pid_type(points: DataFrame) -> str:
    return points.schema["pid"].dataType.simpleString()


def block_count(n_points: int, block: int, width: float = 64.0) -> int:
    """Blocks of ``block`` points; of more where that would make over BLOCKS of them, as every point moves once per block.

    ``width`` is the mean number of terms of a point: no block grows beyond BLOCK_BYTES.
    """
    return max(1, min(math.ceil(n_points / block), max(BLOCKS, math.ceil(n_points / block_rows(block, width)))))


def block_rows(block: int, width: float) -> int:
    """The most rows of a block."""
    return max(block, min(BLOCK_ROWS, int(BLOCK_BYTES / (12 * width + 64))))


def pair_blocks(points: DataFrame, n_points: int, block: int, width: float = 64.0) -> int:
    """``block_count``, or fewer that still make PAIRS_PER_CORE pairs for every core: a point moves once per block. No block outgrows ``block_rows``."""
    pairs = PAIRS_PER_CORE * points.sparkSession.sparkContext.defaultParallelism
    enough = math.ceil((math.sqrt(8 * pairs + 1) - 1) / 2)
    return max(1, math.ceil(n_points / block_rows(block, width)), min(block_count(n_points, block, width), enough))


def mean_width(points: DataFrame) -> tuple[int, float]:
    """The number of points and the mean number of their terms."""
    got = points.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("idx")).alias("w")).first()
    return got["n"], got["w"] or 0.0


def counted(points: DataFrame, idf: np.ndarray) -> DataFrame:
    """The points with the counts of their terms (``tf``) for ``val``, in the narrowest types that hold them: about 3 bytes a term, not 12."""
    most = points.agg(F.max(F.array_max("tf"))).first()[0] or 0
    slim = {"idx": F.col("idx").cast(f"array<{_narrowest(len(idf))}>"), "tf": F.col("tf").cast(f"array<{_narrowest(most)}>")}
    return points.drop("val").withColumns(slim)


def neighbour_hits(points: DataFrame, similarity: float, n_blocks: int, idf: np.ndarray | None = None) -> DataFrame:
    """Pass 1: ``pid, bi, bj, cnt, other`` where a point has neighbours; ``cnt`` of their copies, ``other`` if one is another point.

    With ``idf`` the points are ``counted``, and each task weighs them.
    """
    rep = _replicate(points.select("pid", "mult", "idx", "val" if idf is None else "tf"), n_blocks)
    schema = f"pid {_pid_type(points)}, bi int, bj int, cnt bigint, other boolean"
    return rep.groupBy("bi", "bj", "task").applyInArrow(_hits_fn(eps2(similarity), idf), schema)


def neighbour_weights(points: DataFrame, similarity: float, n_blocks: int, idf: np.ndarray | None = None) -> DataFrame:
    """``pid, n_neighbours`` = copies within epsilon, the point itself included."""
    points = points if idf is None else counted(points, idf)
    return neighbour_hits(points, similarity, n_blocks, idf).groupBy("pid").agg(F.sum("cnt").alias("n_neighbours"))


def core_links(points: DataFrame, similarity: float, n_blocks: int, hits: DataFrame | None = None, idf: np.ndarray | None = None) -> DataFrame:
    """Pass 2: ``kind, a, b``; kind 'e' = core-core forest edge, 'b' = border -> core.

    With the ``hits`` of pass 1 a point goes only to the block pairs in which it has another point as a neighbour.
    """
    points = points.select("pid", "idx", "val" if idf is None else "tf", "core")
    if hits is None:
        rep = _replicate(points, n_blocks)
    else:
        where = hits.filter("other").select("pid", "bi", "bj").distinct()
        rep = _dealt(_packets(points.withColumn("blk", _block(n_blocks)).join(where, "pid"), ["bi", "bj"]), n_blocks)
    t = _pid_type(points)
    return rep.groupBy("bi", "bj", "task").applyInArrow(_links_fn(eps2(similarity), idf), f"kind string, a {t}, b {t}")


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``pid, root`` of every node, root = lowest pid of its component (nodes without an edge are their own).

    Up to FINISH edges (a checked bound) are joined by one task; more go through rounds of contraction.
    """
    started = time.time()
    small = _pid_type(nodes) == "bigint" and edges.count() <= FINISH
    found = edges.coalesce(1).mapInPandas(_joined, "node bigint, component bigint") if small else components.connected_components(edges)
    LAST_RUN.update(component_seconds=round(time.time() - started, 3))
    return nodes.join(found, nodes["pid"] == found["node"], "left").select("pid", F.coalesce("component", "pid").alias("root"))


def _joined(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lowest member of every node's component."""
    edges = pd.concat([*parts, pd.DataFrame({"a": [], "b": []}, dtype="int64")])
    nodes, at = np.unique(edges[["a", "b"]].to_numpy(np.int64), return_inverse=True)
    up = list(range(len(nodes)))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    at = at.reshape(-1, 2)
    for a, b in (edge for first in range(0, len(at), PACKED) for edge in at[first : first + PACKED].tolist()):  # some as lists at a time
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    yield pd.DataFrame({"node": nodes, "component": nodes[[top(i) for i in range(len(nodes))]] if len(nodes) else nodes})


def dbscan(points: DataFrame, similarity: float = 0.75, min_samples: int = 3, block: int = DEFAULT_BLOCK, cells: bool | None = None, idf: np.ndarray | None = None, written: bool = False, parted: tuple | None = None) -> DataFrame:
    """C5-C8 on collapsed points (``pid, mult, idx, val``; with ``idf`` ``tf`` for ``val``) -> ``pid, cluster, core``.

    ``cells``: neighbours by metric cells (True), by block pairs (False), or by what costs less (None).
    ``idf``: the weights of the terms, where points have ``tf``; the block pairs then move the counts only. ``written``: the points are a
    written table. ``parted``: rows, sizes and hits of the metric cells, where the caller has them (of points with a BIGINT ``pid``).

    ``cluster`` is the root: the lowest pid among the cluster's core points,
    i.e. the order in which a sequential scan would discover the cluster.
    Noise points are not returned. ``pid`` may be any orderable type (e.g. a
    struct order key); the Gram tasks then work on a surrogate BIGINT that is
    materialised by a checkpoint, so retries see the same numbers.
    """
    ensure_checkpoint_dir(points.sparkSession)
    integral = points.schema["pid"].dataType.typeName() in ("long", "integer", "short", "byte")
    if not integral:
        points = points.withColumn("nid", F.monotonically_increasing_id())
    if not written or not integral:
        points = staged(points if idf is None else points.drop("val"), "dbscan-points")
    if not integral:
        idmap = points.select(F.col("nid").alias("pid"), F.col("pid").alias("opid"))
        points = points.drop("pid").withColumnRenamed("nid", "pid")
    from refrain.operators import cells as metric  # it builds on this module

    n_points, width = mean_width(points)
    n_blocks = pair_blocks(points, n_points, block, width)
    known = parted[2] if parted else None
    if not parted:
        parted = metric.partition(points, similarity, n_points, block, force=bool(cells), idf=idf) if cells is not False and n_points else None
    if parted:
        points = parted[0]
    elif idf is not None:
        points = counted(points, idf)
    hits = known or staged(metric.cell_hits(*parted, similarity, block) if parted else neighbour_hits(points, similarity, n_blocks, idf), "hits")
    weights = hits.groupBy("pid").agg(F.sum("cnt").alias("n_neighbours"))
    flagged = staged(points.join(weights, "pid").withColumn("core", F.col("n_neighbours") >= F.lit(min_samples)), "flagged")
    found = metric.cell_links(flagged, parted[1], similarity, block, hits) if parted else core_links(flagged, similarity, n_blocks, hits, idf)
    links = staged(found, "links")
    cores = flagged.filter("core").select("pid")
    roots = connected_components(cores, links.filter(F.col("kind") == "e").select("a", "b"))
    if integral:
        roots = roots.select("pid", F.col("root").alias("cluster"))
    else:  # components are label-independent: name each by its lowest original id
        named = roots.join(idmap, "pid")
        first = named.groupBy("root").agg(F.min("opid").alias("cluster"))
        roots = named.join(first, "root").select("pid", "cluster").checkpoint(eager=True)
    border = (
        links.filter(F.col("kind") == "b")
        .join(roots.select(F.col("pid").alias("b"), "cluster"), "b")
        .groupBy(F.col("a").alias("pid"))
        .agg(F.min("cluster").alias("cluster"))
    )
    out = roots.select("pid", "cluster", F.lit(True).alias("core")).unionByName(
        border.select("pid", "cluster", F.lit(False).alias("core"))
    )
    if not integral:
        out = out.join(idmap, "pid").select(F.col("opid").alias("pid"), "cluster", "core")
    return out
