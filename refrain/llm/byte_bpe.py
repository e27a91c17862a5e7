"""Byte-level BPE by ranked merges: encoding and decoding.

A text is split by the vocabulary's pattern (in the JVM, Unicode classes on); each distinct word is then merged
once: starting from its bytes, the adjacent pair with the lowest rank is joined, leftmost first, until no pair is
in the rank map; the ids are the ranks of the remaining pieces. Occurrences take the ids of their distinct word by
index, so the merges of a word are not repeated for its copies in a batch, and a bounded memo carries words over
to later batches of the same task. Decoding looks every id's byte piece up and concatenates the pieces; the
result is binary because ids need not end on a character boundary.

Two forms share these rules:

* ``fold_merges`` is the purely native one: Spark higher-order functions fold the merges over the byte array of a
  word, with the ranks as a literal (an array of small maps, since looking a key up in a Spark map is a scan).
  ``encode_words_native`` applies it to a table of distinct words.
* ``encode_decode`` is the one used on whole corpora: the same fold in an Arrow kernel (the README has the figures
  that rule the native form out for whole tables).

Nothing is shuffled: each row's result depends on its text alone. Defined cases: null or empty text has no ids and
decodes to an empty binary; texts and words may have any length (long words merge through a heap in
O(n log n)); repeated rows give equal results; an empty table gives an empty table; all input columns are kept and
the result columns are named by the caller (an input column of that name is replaced).
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refrain.llm.common import released, text_or_empty

MEMO_WORDS = 150_000  # distinct words kept in a task; the memo is emptied when full
SLICE_ROWS = 512  # rows taken at a time within an Arrow batch
LONG_WORD = 256  # bytes from which the heap is used
NO_RANK = 1 << 60


def load_ranks(path: str) -> dict[bytes, int]:
    """Rank file: a line holds a base64 piece and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in lines if line.strip())}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    bounds = _merge_long(word, ranks) if len(word) > LONG_WORD else _merge_short(word, ranks)
    return [ranks[word[i:j]] for i, j in zip(bounds, bounds[1:])]


def _merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    bounds = list(range(len(word) + 1))
    pair = [ranks.get(word[i : i + 2], NO_RANK) for i in range(len(word) - 1)]
    while pair:
        least = min(pair)
        if least == NO_RANK:
            break
        i = pair.index(least)
        del bounds[i + 1], pair[i]
        if i < len(pair):
            pair[i] = ranks.get(word[bounds[i] : bounds[i + 2]], NO_RANK)
        if i:
            pair[i - 1] = ranks.get(word[bounds[i - 1] : bounds[i + 1]], NO_RANK)
    return bounds


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    n = len(word)
    end, start = list(range(1, n + 1)), list(range(-1, n))  # of the piece at i; of the piece that ends at i
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2], NO_RANK)) != NO_RANK]
    heapq.heapify(heap)
    while heap:
        _, i, j, k = heapq.heappop(heap)
        if end[i] != j or j >= n or end[j] != k:
            continue  # one of the pieces is gone
        end[i], end[j] = k, -1
        if k < n:
            start[k] = i
            if (r := ranks.get(word[i : end[k]], NO_RANK)) != NO_RANK:
                heapq.heappush(heap, (r, i, k, end[k]))
        if i and (r := ranks.get(word[start[i] : k], NO_RANK)) != NO_RANK:
            heapq.heappush(heap, (r, start[i], i, k))
    bounds = [0]
    while bounds[-1] < n:
        bounds.append(end[bounds[-1]])
    return bounds


def encode_batch(words: pa.ListArray, ranks: dict[bytes, int], memo: dict[str, tuple[int, ...]]) -> pa.ListArray:
    """Ids of each row's words, concatenated."""
    coded = words.flatten().dictionary_encode()
    if len(memo) > MEMO_WORDS:
        memo.clear()
    each = []
    for word in coded.dictionary.to_pylist():
        ids = memo.get(word)
        if ids is None:
            ids = memo[word] = tuple(merge_word(word.encode(), ranks))
        each.append(ids)
    n_ids = np.fromiter(map(len, each), np.int64, len(each))
    flat = np.fromiter((i for ids in each for i in ids), np.int32, int(n_ids.sum()))
    first = np.cumsum(n_ids) - n_ids
    of = coded.indices.to_numpy(zero_copy_only=False)
    n = n_ids[of]
    upto = np.concatenate([[0], np.cumsum(n)])
    at = np.arange(upto[-1], dtype=np.int64) + np.repeat(first[of] - upto[:-1], n)
    offsets = words.offsets.to_numpy()
    return pa.ListArray.from_arrays(pa.array(upto[offsets - offsets[0]], pa.int32()), pa.array(flat[at], pa.int32()))


def decode_batch(ids: pa.ListArray, pieces: pa.Array) -> pa.Array:
    """Concatenated byte pieces of each row's ids."""
    got = pieces.take(ids.flatten())
    _, ends, data = got.buffers()
    ends = np.frombuffer(ends, np.int64, len(got) + 1, got.offset * 8) if len(got) else np.zeros(1, np.int64)
    offsets = ids.offsets.to_numpy()
    rows = ends[offsets - offsets[0]]
    return pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(np.ascontiguousarray(rows)), data or pa.py_buffer(b"")]).cast(pa.binary())


def pieces_of(ranks: dict[bytes, int]) -> pa.Array:
    """Byte piece by id; ids that the vocabulary leaves out are empty."""
    pieces = [b""] * (max(ranks.values(), default=-1) + 1)
    for piece, i in ranks.items():
        pieces[i] = piece
    return pa.array(pieces, pa.large_binary())


def encode_decode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, *, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """Add ``ids array<int>`` and ``decoded binary`` (from the ids) to every row."""
    kind = pa.struct([("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])

    @F.arrow_udf("struct<ids: array<int>, decoded: binary>")
    @released
    def code(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memo, pieces = {}, pieces_of(ranks)  # of this task
        for words in batches:
            done = []
            for at in range(0, len(words), SLICE_ROWS):
                ids = encode_batch(words.slice(at, SLICE_ROWS), ranks, memo)
                done.append(pa.StructArray.from_arrays([ids, decode_batch(ids, pieces)], fields=list(kind)))
            yield pa.concat_arrays(done) if done else pa.array([], kind)

    words = F.regexp_extract_all(text_or_empty(text_col), F.lit("(?U)" + pattern), F.lit(0))
    others = [c for c in docs.columns if c not in (ids_col, decoded_col)]
    # one column for the input's, so that none of theirs can clash
    coded = docs.select(F.struct(F.lit(0).alias("_"), *others).alias("own"), code(words).alias("coded"))
    return coded.select(*[F.col(f"own.`{c}`").alias(c) for c in others], F.col("coded.ids").alias(ids_col), F.col("coded.decoded").alias(decoded_col))


# The native form.

BUCKETS = 4096


def rank_literal(ranks: dict[bytes, int]) -> Column:
    """The rank map as a foldable literal: ``array<map<hex piece, rank>>`` by the piece's CRC-32."""
    import json
    import zlib

    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for piece, rank in ranks.items():
        key = piece.hex().upper()
        buckets[zlib.crc32(key.encode()) % BUCKETS][key] = rank
    return F.from_json(F.lit(json.dumps(buckets)), "array<map<string,int>>")


def fold_merges(word: Column, ranks: Column) -> Column:
    """Ids of a word by folding ranked merges over its bytes."""

    def rank(piece: Column) -> Column:
        return F.try_element_at(F.get(ranks, F.pmod(F.crc32(piece.cast("binary")), F.lit(BUCKETS)).cast("int")), piece)

    def let(value: Column, body) -> Column:
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def up_to(n: Column) -> Column:  # 0 .. n - 1
        return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def merged(parts: Column, at: Column) -> Column:  # at counts from 1
        joined = F.concat(F.get(parts, at - 1), F.get(parts, at))
        return F.concat(F.slice(parts, F.lit(1), at - 1), F.array(joined), F.slice(parts, at + 2, F.greatest(F.size(parts) - at - 1, F.lit(0))))

    def step(parts: Column, _) -> Column:
        pairs = F.transform(up_to(F.size(parts) - 1), lambda i: rank(F.concat(F.get(parts, i), F.get(parts, i + 1))))
        place = let(pairs, lambda r: F.array_position(r, F.array_min(r)).cast("int"))
        return let(place, lambda at: F.when(at > 0, merged(parts, at)).otherwise(parts))

    digits = F.hex(F.encode(word, "UTF-8"))
    n_bytes = (F.length(digits) / 2).cast("int")
    parts = F.transform(up_to(n_bytes), lambda i: F.substring(digits, i * 2 + 1, F.lit(2)))
    return F.transform(F.aggregate(up_to(n_bytes - 1), parts, step), rank)


def encode_words_native(words: DataFrame, ranks: dict[bytes, int], *, word_col: str = "word", ids_col: str = "ids") -> DataFrame:
    """Distinct words and their ids, with DataFrame functions only; the empty word has no ids."""
    distinct = words.select(F.col(word_col).cast("string").alias(word_col)).filter(F.col(word_col).isNotNull()).distinct()
    return distinct.withColumn(ids_col, fold_merges(F.col(word_col), rank_literal(ranks)))
