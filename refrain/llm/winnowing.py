"""Document fingerprints by winnowing.

A text's k-grams of code points are hashed by a rolling polynomial (mod 2^64, then mixed); in every window of
``window`` consecutive hashes the least one is chosen, the rightmost of equal ones, and recorded once with its position.
Any passage of at least ``window + k - 1`` code points that two texts share thus contributes an equal hash to both, and
no passage shorter than ``k`` does. A text of fewer k-grams than a window is one window; one shorter than ``k`` has the
single hash of its whole text at position 0. The likeness of two fingerprints is the Jaccard index of their
hashes, each as often as it was chosen (a text that repeats itself has few different ones); two empty ones are alike (1.0).

``neighbours`` puts every document beside the next one by ascending id (after the last: the first), without ordering
the table in one task: ids alone give quantile boundaries; each document then goes to its range, the first one of the
following range goes there too, and ranges are read in order as streams. A text crosses the network once (a few,
one per range, twice).

Ids are numbers (their quantiles are asked for); there are as many ranges as shuffle partitions, or one per RANGE_ROWS
rows if that is more, so a task's share doesn't grow with the table.

Defined cases: null text counts as empty; an empty text has an empty fingerprint; rows with equal ids are
ordered by their text; null ids come first; a table of one row is its own neighbour; very long texts are hashed in
slices, with the same result; an empty table gives an empty table. The results hold the id and the operator's own columns
only.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refrain.llm.common import partitions, released, text_or_empty

K, WINDOW = 10, 12
RANGE_ROWS = 20_000  # of a range, about
SLICE = 1 << 18  # k-grams hashed at once
_BASE = 0x9E3779B97F4A7C15
_LOW = np.uint64((1 << 24) - 1)  # bits that order equal hashes within a slice


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def gram_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k-gram, from hashes of grams of doubling length."""
    x = points.astype(np.uint64) + np.uint64(1)
    out, done, power, size = None, 0, _BASE, 1  # x holds grams of length size
    while True:
        if k & size:
            if out is None:
                out = x
            else:
                n = min(len(out), len(x) - done)
                out = out[:n] * np.uint64(power) + x[done : done + n]
            done += size
        size *= 2
        if size > k:
            return _mixed(out[: len(points) - k + 1]) & ~_LOW
        x = x[: len(x) - size // 2] * np.uint64(power) + x[size // 2 :]
        power = power * power % 2**64


def winnow(text: str, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Chosen hashes and their positions, in order of place."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(points) < k:
        whole = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest()
        return np.frombuffer(whole, np.uint64) & ~_LOW, np.zeros(1, np.int64)
    n = len(points) - k + 1
    hashes, places = [], []
    for at in range(0, max(n - window + 1, 1), SLICE):
        end = min(n, at + SLICE + window - 1)  # all windows that start in this slice
        h = gram_hashes(points[at : end + k - 1], k)
        key = h | (_LOW - np.arange(len(h), dtype=np.uint64))  # the rightmost of equal hashes is the least
        least, size = key, 1
        width = min(window, len(h))
        while 2 * size <= width:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        rest = width - size
        if rest:
            least = np.minimum(least[:-rest], least[rest:])
        place = at + (_LOW - (least & _LOW)).astype(np.int64)
        new = np.concatenate([[True], place[1:] != place[:-1]])
        place, chosen = place[new], (least & ~_LOW)[new]
        if places and len(places[-1]) and place[0] == places[-1][-1]:
            place, chosen = place[1:], chosen[1:]
        hashes.append(chosen), places.append(place)
    return np.concatenate(hashes), np.concatenate(places)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard index of two bags of hashes."""
    if not len(a) and not len(b):
        return 1.0
    (x, nx), (y, ny) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = int(np.minimum(nx[i], ny[j]).sum())
    return both / (len(a) + len(b) - both)


def digest(found: tuple[np.ndarray, np.ndarray]) -> str:
    """Hex digest of hashes and positions; empty for the empty fingerprint."""
    hashes, places = found
    return hashlib.sha256(hashes.tobytes() + places.astype(np.int64).tobytes()).hexdigest() if len(hashes) else ""


def edited(text: str, following: str) -> str:
    """The last quarter of the code points gives way to as many first ones of the following text."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """``id, fingerprint array<struct<hash, position>>`` of every text."""

    @F.arrow_udf("array<struct<hash: bigint, position: bigint>>")
    def run(texts: pa.Array) -> pa.Array:
        kind = pa.struct([("hash", pa.int64()), ("position", pa.int64())])
        found = [winnow(t, k, window) for t in texts.to_pylist()]
        ends = np.concatenate([[0], np.cumsum([len(h) for h, _ in found], dtype=np.int64)])
        flat = [np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in (0, 1)]
        rows = pa.StructArray.from_arrays([pa.array(flat[0].view(np.int64)), pa.array(flat[1])], fields=list(kind))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)

    return docs.select(id_col, run(text_or_empty(text_col)).alias("fingerprint"))


def in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows ``range, borrowed, id, text`` sorted by range and id; ``borrowed`` rows are only there as the next of the last."""
    spark = docs.sparkSession
    n = max(partitions(spark), math.ceil(docs.count() / RANGE_ROWS))
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    ids = docs.select(F.col(id_col).alias("id")).distinct()
    cuts = ids.filter("id is not null").select(F.approx_percentile("id", [i / n for i in range(1, n)], 10_000).alias("p")).first()["p"] if n > 1 else None
    bounds = np.array(sorted(set(cuts or [])))

    @F.arrow_udf("int")
    def range_of(keys: pa.Array) -> pa.Array:
        known = keys.is_valid().to_numpy(zero_copy_only=False)
        values = keys.fill_null(0).to_numpy(zero_copy_only=False)
        return pa.array(np.where(known, np.searchsorted(bounds, values, side="right"), 0).astype(np.int32))

    place = range_of("id") if len(bounds) else F.lit(0)
    # the first id of every range belongs to the range before it too; the very first one to the last range
    firsts = sorted(ids.select(place.alias("range"), "id").groupBy("range").agg(F.min(F.struct(F.col("id").isNotNull().alias("some"), "id")).alias("m")).collect(), key=lambda r: r["range"])
    lend = spark.createDataFrame(
        [(firsts[i - 1]["range"], r["m"]["some"], r["m"]["id"]) for i, r in enumerate(firsts)], f"range int, some boolean, id {docs.schema[id_col].dataType.simpleString()}"
    )
    lent = rows.join(F.broadcast(lend), (F.col("some") == rows["id"].isNotNull()) & rows["id"].eqNullSafe(lend["id"])).select("range", F.lit(True).alias("borrowed"), rows["id"], "text")
    # several rows may have that id: the first text is the next one
    lent = lent.groupBy("range", "borrowed", "id").agg(F.min("text").alias("text"))
    dealt = rows.select(place.alias("range"), F.lit(False).alias("borrowed"), "id", "text").unionByName(lent)
    return dealt.repartitionByRange(n, "range").sortWithinPartitions("range", "borrowed", "id", "text")


def compare_neighbours(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """Digests of every text, of its edited text, and the likeness of both and of the next text's fingerprint."""
    rows = in_order(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        last = None  # range, id, text and fingerprint of the row before
        for batch in batches:
            out = []
            for place, borrowed, key, text in zip(*(batch.column(c).to_pylist() for c in ("range", "borrowed", "id", "text"))):
                own = winnow(text, k, window)
                if last is not None and last[0] == place:
                    changed = edited(last[2], text)
                    other = winnow(changed, k, window)
                    sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((last[1], len(last[2]), sha, digest(last[3]), digest(other), likeness(last[3][0], other[0]), likeness(last[3][0], own[0])))
                last = None if borrowed else (place, key, text, own)
            columns = list(zip(*out)) if out else [()] * len(names)
            types = [batch.schema.field("id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    out = rows.mapInArrow(run, f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumnRenamed("id", id_col)
