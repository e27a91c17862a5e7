"""MinHash near-duplicates by an LSH forest, confirmed on full shingle sets.

Documents with equal shingle sets are one node from the start (128-bit digests of the sets). Every other node gets
TREES x DEPTH minimum hashes. Tree ``t`` orders the nodes by its own DEPTH values; nodes that share the longest
prefixes are neighbours in that order.

1. *Neighbours.* In the first LEAD trees, adjacent nodes of the order that share a prefix of at least the base depth
   are candidates. Their similarity is computed on the full sets, and confirmed links are contracted to components.
   This merges nearly all copies with one comparison per node and tree.
2. *Regions.* In every tree, nodes with a common prefix form a region. Its depth adapts: a region of more than
   REGION nodes is divided at the next depth, down to the last one. Its nodes, also those that end up alone, are
   ordered by as many further trees as the last depth needs. Regions that still hold several components are
   searched exactly: every node outside the region's largest component is compared with all nodes of the
   region that aren't in its own component. Regions of any size are dealt to tasks as a grid of blocks, so none is
   cut off; equal regions of several trees are searched once.
3. All confirmed links together give the components; ``component_id`` is the smallest id reachable.

A pair is thus found if it shares a region in some tree, or if its nodes meet through others. For a pair at the
threshold ``s`` a region of base depth ``d`` is missed in all trees with probability ``(1 - s^d)^TREES``; the base
depth is the largest for which this stays below MISS. A pair that meets in divided regions only is in the further trees
with both nodes; their number is such that the last depth ``e`` is missed in all trees with a probability
``(1 - s^e)^trees`` of at most what the base depth leaves of MISS. So MISS holds whatever the regions' sizes; regions
of the last depth are searched at any size. Similarity decisions use the exact test
``100 * |A & B| >= percent * |A | B|`` on 64-bit shingle hashes of the whole texts.

What is shuffled: narrow signature rows, and the texts and sets of those nodes that have a candidate (a bitmap of
bounded size keeps the other texts where they are). Sets are written once to the session's shared folder. No task holds more than two blocks of sets, and no pair lists are emitted: tasks return
links that connect components (fewer than the nodes they hold).

Defined cases: a null or empty text, or one without words, has the empty set and links with nothing; a text with
fewer words than a shingle is one shingle; rows with one id are one node (their links are united) and all are
returned; a row without id links with nothing, gets a null ``component_id`` and is kept; an empty table gives an empty
table. The result holds the id and the operator's own columns only, so other input columns cannot clash.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refrain.llm.common import WordTable, partitions, released, slices, text_or_empty
from refrain.operators.components import connected_components, salted_join
from refrain.session import staged

SHINGLE, PERCENT = 5, 80
TREES, DEPTH, LEAD = 16, 8, 2
MOST_TREES = 64  # that the last depth may need
MISS = 3e-4
REGION = 256  # nodes of a region (or block) that one task compares
MAP_BITS = 25  # log2 of the bits of the map that sorts rows out
SLICE = 4096  # shingles whose hashes are taken at once
STEP = 256  # rows whose sets are held at a time

_RNG = np.random.default_rng(2024)
_FACTORS = _RNG.integers(1, 2**63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MORE = np.random.default_rng(2025).integers(1, 2**63, MOST_TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def base_depth(percent: int, trees: int = TREES, depth: int = DEPTH, miss: float = MISS) -> int:
    """Largest prefix that a pair at the threshold still shares in some tree, but for the probability ``miss``."""
    fit = [d for d in range(1, depth + 1) if (1 - (percent / 100) ** d) ** trees <= miss]
    return max(fit, default=1)


def last_depth(percent: int, trees: int = TREES, depth: int = DEPTH, miss: float = MISS, most: int = MOST_TREES) -> tuple[int, int]:
    """Depth down to which large regions are divided, and the trees that keep the whole miss below ``miss`` there."""
    s, base = percent / 100, base_depth(percent, trees, depth, miss)
    left = miss - (1 - s**base) ** trees  # what a pair that shares no base prefix leaves
    if left <= 0 or s >= 1:
        return base, trees
    need = {d: max(trees, math.ceil(math.log(left) / math.log1p(-(s**d)))) for d in range(base + 1, depth + 1)}
    last = max((d for d, n in need.items() if n <= most), default=base)
    return last, need.get(last, trees)


def word_hash(word: bytes) -> tuple[int]:
    return (int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little"),)


def Words() -> WordTable:
    return WordTable(word_hash, [np.uint64])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, size: int, memo: WordTable) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text (A-Z lowered, words split at ASCII white space)."""
    memo.trim()
    codes = memo.codes(text.encode().lower())  # bytes.lower and bytes.split know ASCII only
    if not len(codes):
        return np.zeros(0, np.uint64)
    words = memo.columns[0][codes]
    size = min(size, len(words))
    count = len(words) - size + 1
    h = np.full(count, np.uint64(size))
    for i in range(size):
        h = _mixed(h * _STEP + words[i : i + count])
    return np.unique(h)


def signature(found: np.ndarray, factors: np.ndarray = _FACTORS) -> bytes:
    """Minimum of every hash function over the set; big-endian, so that bytes sort like the values."""
    least = np.full(len(factors), 0xFFFFFFFF, np.uint64)
    for at in range(0, len(found), SLICE):
        some = found[at : at + SLICE]
        np.minimum(least, ((some[:, None] * factors[None, :]) >> np.uint64(32)).min(axis=0), out=least)
    return least.astype(">u4").tobytes()


def _sign(size: int):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Words()
        for batch in batches:
            n, digests, signs = [], [], []
            for text in chain.from_iterable(slices(batch.column("text"))):
                found = shingles(text, size, memo)
                n.append(len(found))
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                signs.append(signature(found) if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(signs, pa.binary())], ["id", "n", "digest", "sign"])

    return run


def _sets(size: int):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Words()
        for batch in batches:
            for i, texts in enumerate(slices(batch.column("text"), STEP)):
                found = [shingles(t, size, memo).tobytes() for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(i * STEP, STEP), pa.array(found, pa.binary())], ["id", "grams"])

    return run


def _sign_sets(count: int):
    """Minima of ``count`` further hash functions over sets that are known."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signs = [signature(np.frombuffer(g, np.uint64), _MORE[:count]) for g in batch.column("grams").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(signs, pa.binary())], ["id", "sign"])

    return run


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    both = len(np.intersect1d(small, large, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _confirm(percent: int):
    """Keep the candidate pairs whose full sets are similar enough."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = zip(*(chain.from_iterable(slices(batch.column(c), STEP)) for c in ("ga", "gb")))
            ok = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in sides]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _search(percent: int):
    """Links between the components of a block of a region: for queries against all nodes of the block."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        ids, query = part["id"].to_numpy(), part["query"].to_numpy(bool)
        _, comp = np.unique(part["comp"].to_numpy(), return_inverse=True)
        grams = [np.frombuffer(g, np.uint64) for g in part["grams"]]
        size = np.array([len(g) for g in grams])
        owner = np.repeat(np.arange(len(ids)), size)
        flat = np.concatenate(grams) if len(grams) else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        values, owner = flat[order], owner[order]
        links = []
        for i in np.nonzero(query)[0]:
            if (comp == comp[i]).all():
                continue
            lo, hi = np.searchsorted(values, grams[i], "left"), np.searchsorted(values, grams[i], "right")
            n = hi - lo
            at = np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)
            both = np.bincount(owner[at], minlength=len(ids))
            for j in np.nonzero(100 * both >= percent * (size + size[i] - both))[0]:
                if comp[j] != comp[i]:  # a link within a component adds nothing
                    links.append((ids[i], ids[j]))
                    comp = np.where(comp == comp[j], comp[i], comp)
        return pd.DataFrame(links, columns=["a", "b"])

    return run


def _near(depth: int):
    """Adjacent rows of an ordered partition that share tree and prefix."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            rows = list(zip(batch.column("tree").to_pylist(), batch.column("sign").to_pylist(), batch.column("id").to_pylist()))
            pairs = [(x[2], y[2]) for x, y in zip([last, *rows], rows) if x and x[0] == y[0] and x[1][: 4 * depth] == y[1][: 4 * depth]]
            last = rows[-1] if rows else last
            kind = batch.schema.field("id").type
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], kind) for i in (0, 1)], ["a", "b"])

    return run


def forest(nodes: DataFrame, trees: int = TREES) -> DataFrame:
    """``tree, sign, id``: every node once per tree with that tree's values."""
    wide = F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")
    return nodes.select("id", "sign", wide).select("tree", _values(DEPTH).alias("sign"), "id")


def _values(depth: int) -> Column:
    """The first ``depth`` values of tree ``tree``."""
    return F.expr(f"substring(sign, tree * {4 * DEPTH} + 1, {4 * depth})")


def among(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Semi-join on ``id`` that leaves most rows where they are: a bitmap of bounded size sorts out those surely not wanted."""
    n = wanted.count()
    bits = 1 << min(MAP_BITS, max(10, (32 * n).bit_length()))
    slot = F.pmod(F.xxhash64("id"), F.lit(bits))
    parts = wanted.select(slot.alias("s")).groupBy((F.col("s") / 64).cast("long").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("m"))
    marks = np.zeros(bits // 64, np.int64)
    for w, m in parts.collect():  # at most 2^MAP_BITS / 64 rows
        marks[w] = m
    marks = marks.view(np.uint8)

    @F.arrow_udf("boolean")
    def may_be(slots: pa.Array) -> pa.Array:
        at = slots.to_numpy(zero_copy_only=False)
        return pa.array((marks[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))

    return rows.filter(may_be(slot)).join(wanted, "id", "left_semi")


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, region: int = REGION,
) -> DataFrame:
    """``id, n_shingles, component_id, kept`` of every row."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    depth = base_depth(percent)

    signed = staged(texts.mapInArrow(_sign(shingle), f"id {kind}, n long, digest binary, sign binary"), "signed")
    usable = signed.filter(F.col("digest").isNotNull() & F.col("id").isNotNull())
    groups = staged(usable.groupBy("digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("size"), F.first("sign").alias("sign")), "groups")
    nodes = groups.select(F.col("rep").alias("id"), "sign")
    # one id may have rows with several sets: those sets are then linked by it
    copies = salted_join(usable.select("id", "digest"), groups.filter("size > 1").select("digest", "rep"), ["digest"])
    same = copies.select(F.col("rep").alias("a"), F.col("id").alias("b")).filter("a <> b")

    lead = forest(nodes, LEAD).repartitionByRange(partitions(spark), "tree", "sign", "id").sortWithinPartitions("tree", "sign", "id")
    first = staged(lead.mapInArrow(_near(depth), f"a {kind}, b {kind}").filter("a <> b").distinct(), "candidates")
    last, trees = last_depth(percent)
    regions, divided = _region_members(nodes, depth, last, region)
    wanted = staged(first.select(F.col("a").alias("id")).union(first.select("b")).union(regions.select("id")).union(divided).distinct(), "wanted")
    sets = among(texts.filter(F.col("id").isNotNull()), wanted).mapInArrow(_sets(shingle), f"id {kind}, grams binary")
    sets = staged(sets.filter(F.length("grams") > 0).dropDuplicates(), "sets")

    if not divided.isEmpty():
        regions = regions.unionByName(_further_members(sets, divided, last, trees - TREES, kind))

    side = lambda c, g: sets.select(F.col("id").alias(c), F.col("grams").alias(g))
    links = staged(first.join(side("a", "ga"), "a").join(side("b", "gb"), "b").mapInArrow(_confirm(percent), f"a {kind}, b {kind}"), "links")
    found = links.unionByName(_search_regions(regions, connected_components(links), sets, percent, region, kind))
    parts = staged(connected_components(found.unionByName(same)), "components")

    labelled = signed.select("id", "n").join(parts.select(F.col("node").alias("id"), "component"), "id", "left")
    component = F.coalesce("component", "id")
    return labelled.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept")
    )


def _region_members(nodes: DataFrame, depth: int, last: int, region: int) -> tuple[DataFrame, DataFrame]:
    """``key, id, size`` of the regions with at least two nodes, divided while they're too large and can be; ``id`` of the nodes of divided ones.

    A key is a hash of tree and prefix, so only narrow rows move; should two keys ever be equal, their regions are
    searched as one.
    """
    named = lambda rows, d: rows.select(F.xxhash64("tree", _values(d)).alias("key"), "tree", "id")
    live, done = named(nodes.select("id", "sign", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")), depth), []
    divided = nodes.select("id").limit(0)
    for d in range(depth, last + 1):
        sized = _sized(live)
        fits = F.lit(True) if d == last else F.col("size") <= region
        done.append(sized.filter(fits).select("key", "id", "size"))
        large = sized.filter(~fits).select("tree", "id")
        if large.isEmpty():
            break
        if d == depth:
            divided = staged(large.select("id").distinct(), "divided")
        live = named(large.join(nodes, "id"), d + 1)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out, divided


def _sized(live: DataFrame) -> DataFrame:
    """Rows of the keys with at least two rows, with their number."""
    sizes = live.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    return staged(salted_join(live, sizes, ["key"]), "regions")


def _further_members(sets: DataFrame, divided: DataFrame, depth: int, trees: int, kind: str) -> DataFrame:
    """``key, id, size`` of the regions of ``trees`` further trees, which hold the nodes of divided regions only."""
    signed = sets.join(divided, "id", "left_semi").mapInArrow(_sign_sets(trees * depth), f"id {kind}, sign binary")
    rows = signed.select("id", "sign", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    prefix = F.expr(f"substring(sign, tree * {4 * depth} + 1, {4 * depth})")
    return _sized(rows.select(F.xxhash64(F.col("tree") + TREES, prefix).alias("key"), "id").distinct()).select("key", "id", "size")


def _search_regions(regions: DataFrame, parts: DataFrame, sets: DataFrame, percent: int, region: int, kind: str) -> DataFrame:
    """Links that the regions' members still lack."""
    near = parts.select(F.col("node").alias("id"), "component")
    rows = regions.join(near, "id", "left").select("key", "id", "size", F.coalesce("component", "id").alias("comp"))
    rows = staged(rows, "members")
    stats = rows.groupBy("key").agg(
        F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("size"),
        F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("x"),
    ).filter("low <> high")
    once = stats.groupBy("size", "s", "x").agg(F.min("key").alias("key"))
    rows = staged(salted_join(rows.drop("size"), once, ["key"]), "open")
    by_comp = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    largest = by_comp.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("all"))
    blocks = largest.select(
        "key", F.col("top.comp").alias("top"),
        F.ceil(F.col("all") / region).cast("int").alias("n_all"), F.ceil((F.col("all") - F.col("top.n")) / region).cast("int").alias("n_query"),
    )
    rows = salted_join(rows, blocks, ["key"]).withColumn("query", F.col("comp") != F.col("top"))
    mine = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    base = ["key", "id", "comp"]
    asked = rows.select(*base, every("n_query").alias("q"), mine("n_all").alias("a"), F.lit(False).alias("query"), F.col("query").alias("own"), mine("n_query").alias("home"))
    answers = asked.select(*base, "q", "a", (F.col("own") & (F.col("q") == F.col("home"))).alias("query"))
    asks = rows.filter("query").select(*base, mine("n_query").alias("q"), every("n_all").alias("a"), F.lit(True).alias("query"), mine("n_all").alias("home"))
    asks = asks.filter("a <> home").drop("home")  # where it is an answer of the block, that row asks too
    dealt = answers.unionByName(asks).join(sets, "id")
    return dealt.groupBy("key", "q", "a").applyInPandas(_search(percent), f"a {kind}, b {kind}")
