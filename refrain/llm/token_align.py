"""Alignment of two tokenizers' tokens by the bytes they cover, as an Arrow pipeline.

Side A is a byte-level BPE (a ``tokenizers`` JSON file) over ``space + text``; side B is a SentencePiece BPE model with
byte fallback over ``text``, which puts the space in front itself. Every token covers bytes: A's entry decoded from
the byte-level alphabet, B's piece in UTF-8 with U+2581 as space and ``<0xHH>`` as that byte.

Inside a task a slice of texts is a pair of Arrow lists. Flattening gives tokens, parent indices give their
documents, and a cumulative sum of token lengths less its value at the document's start gives the byte at
which each token ends. An Acero hash join of both sides on the (document, end) key finds the tokens that end together:
these pairs are the *links*, and their ends cut both token lists into the *groups* that cover equal bytes.

How often a pair of ids is linked is counted over all documents: the same task makes partial counts by ``Table.group_by``, one
per pair, and Spark adds them up. Tokens that end together have one's bytes as a suffix of the other's, so the
number of different pairs is bounded by the vocabularies alone (``pair_bound``), however large the corpus; that is why the
counts may be broadcast to the links.

Texts are read by Python once and never shuffled; what is shuffled later is a few numbers per document. Defined cases: texts that are null, empty, or whose
tokens on one side don't join to the bytes of ``space + text`` (a U+2581 in the text, say) have no tokens and no
links, and count nowhere; names of special tokens inside a text are plain text; texts may have any length (a slice
holds at least one whole text); repeated rows and null ids are rows like any other; an empty table gives an empty
table. The results hold the id and the operator's own columns only, so other input columns cannot clash.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refrain.llm.common import released
from refrain.session import staged

SLICE_BYTES = 1 << 19  # of text, taken at a time
MEMO_WORDS = 200_000  # distinct words a task keeps at a time, and their ids
MEMO_IDS = 1 << 22
FLUSH_PAIRS = 1 << 19  # partial counts that wait to be merged
COUNTS_ROW = 1 << 14  # partial counts in a row
SPACE = "▁"
_ODD_BLANK = re.compile(r" (?:\s|\Z)")
# Fixed value: the split that the byte-level pre-tokenizer of ``tokenizers`` applies.
STANDARD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of the byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _by_id(pieces: dict[int, bytes]) -> list[bytes]:
    out = [b""] * (max(pieces, default=-1) + 1)
    for i, piece in pieces.items():
        out[i] = piece
    return out


class ByteLevelSide:
    """Ids of ``space + text``.

    Where the file is plain byte-level BPE (merge ``i`` makes the ``i``-th id after the 256 bytes, standard split) its merges are
    ranks, which tiktoken applies several times faster with equal ids; any other file is applied by ``tokenizers``.
    """

    def __init__(self, spec: str):
        self.spec = spec
        read = json.loads(spec)
        alphabet = byte_alphabet()
        special = {t["id"] for t in read["added_tokens"]}
        vocab = {word: i for word, i in read["model"]["vocab"].items() if i not in special}
        self.ranks = {bytes(alphabet[c] for c in word): i for word, i in vocab.items()}
        self.pieces = _by_id({i: piece for piece, i in self.ranks.items()})
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in read["model"]["merges"]]
        split, model = read["pre_tokenizer"] or {}, read["model"]
        #: A blank before a visible character then always begins a new match of the split.
        self.by_word = (
            read["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
            and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
            and len(vocab) == 256 + len(merges) and all(vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(merges))
        )

    def encoder(self):
        """Function from texts to their ids."""
        made = []

        def one(text: str) -> list[int]:
            if not made:
                from tokenizers import Tokenizer

                made.append(Tokenizer.from_str(self.spec))
                made[0].encode_special_tokens = True
            return made[0].encode(" " + text, add_special_tokens=False).ids

        if not self.by_word:
            return lambda texts: map(one, texts)
        import tiktoken

        code = tiktoken.Encoding("plain", pat_str=STANDARD_SPLIT, mergeable_ranks=self.ranks, special_tokens={})

        def fast(text: str) -> list[int]:
            try:
                return code.encode_ordinary(" " + text)
            except BaseException as error:  # its regular expressions give up on runs of about a million blanks
                if type(error).__name__ != "PanicException":
                    raise
                return one(text)

        return lambda texts: map(fast, texts)


class PieceSide:
    """Ids of ``text`` by a SentencePiece model, which puts a space in front of it."""

    def __init__(self, spec: bytes):
        import sentencepiece

        self.spec = spec
        model = sentencepiece.SentencePieceProcessor(model_proto=spec)
        names = {i: model.id_to_piece(i) for i in range(model.get_piece_size())}
        real = {i for i in names if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
        self.pieces = _by_id({i: self._bytes(names[i], model.is_byte(i)) if i in real else b"" for i in names})
        #: No piece has a space behind another character, so merges never cross from a word into the space before the next.
        self.by_word = not any(SPACE in names[i].lstrip(SPACE) for i in real) and model.encode("a b  c") == [*model.encode("a"), *model.encode("b"), *model.encode(" c")]

    @staticmethod
    def _bytes(name: str, is_byte: bool) -> bytes:
        return bytes([int(name[3:5], 16)]) if is_byte else name.replace(SPACE, " ").encode()

    def encoder(self):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=self.spec)
        return lambda texts: model.encode(texts, num_threads=1)


class Words:
    """Ids of both sides for texts, word by word where both sides allow it.

    Where every blank is followed by a visible character, both sides cut there, and each distinct word is encoded once per
    task (the memo is emptied when full). Texts with other blanks are encoded whole.
    """

    def __init__(self, a: ByteLevelSide, b: PieceSide):
        self.encoders, self.by_word = (a.encoder(), b.encoder()), a.by_word and b.by_word
        self.clear()

    def clear(self) -> None:
        self.memo: dict[str, int] = {}
        self.flat, self.start = (array("i"), array("i")), (array("q", [0]), array("q", [0]))

    def add(self, words: list[str]) -> None:
        for encode, flat, start in zip(self.encoders, self.flat, self.start):
            for ids in encode(words):
                flat.extend(ids)
                start.append(len(flat))

    def __call__(self, texts: list[str]) -> list[pa.ListArray]:
        """The list arrays of both sides."""
        if len(self.memo) > MEMO_WORDS or max(map(len, self.flat)) > MEMO_IDS:
            self.clear()
        found = [None if not self.by_word or _ODD_BLANK.search(" " + t) else t.split(" ") for t in texts]
        new = list(set(chain.from_iterable(f for f in found if f)).difference(self.memo))
        self.memo.update(zip(new, range(len(self.start[0]) - 1, len(self.start[0]) - 1 + len(new))))
        whole = len(self.start[0]) - 1 + len(new)
        self.add(new + [t for t, f in zip(texts, found) if f is None])
        counts, codes = np.ones(len(texts), np.int64), []
        for i, f in enumerate(found):
            if f is None:
                codes.append(whole)
                whole += 1
            else:
                counts[i] = len(f)
                codes.extend(map(self.memo.__getitem__, f))
        return [self._expand(side, np.array(codes, np.int64), counts) for side in (0, 1)]

    def _expand(self, side: int, codes: np.ndarray, counts: np.ndarray) -> pa.ListArray:
        start = np.frombuffer(self.start[side], np.int64)
        flat = np.frombuffer(self.flat[side], np.int32) if len(self.flat[side]) else np.zeros(0, np.int32)
        n = start[codes + 1] - start[codes]
        upto = np.concatenate([[0], np.cumsum(n)])
        at = np.arange(upto[-1]) + np.repeat(start[codes] - upto[:-1], n)
        rows = upto[np.concatenate([[0], np.cumsum(counts)])]
        return pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.array(flat[at]))


class Vocabularies:
    """Both sides, read on the driver; what is sent to tasks is the content of the two files."""

    def __init__(self, a_path: str, b_path: str):
        with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
            self.a, self.b = ByteLevelSide(a.read()), PieceSide(b.read())

    def pair_bound(self) -> int:
        """Number of id pairs that can end together at all: one's bytes must be a suffix of the other's."""
        return suffix_pairs(self.a.pieces, self.b.pieces)


def suffix_pairs(a: list[bytes], b: list[bytes]) -> int:
    def count(pieces: list[bytes]) -> dict[bytes, int]:
        out: dict[bytes, int] = {}
        for p in pieces:
            if p:
                out[p] = out.get(p, 0) + 1
        return out

    n_a, n_b = count(a), count(b)
    return sum(n * n_b.get(p[i:], 0) for p, n in n_a.items() for i in range(len(p))) + sum(n * n_a.get(p[i:], 0) for p, n in n_b.items() for i in range(1, len(p)))


class Side:
    """Token lengths, bytes and decimal names of a vocabulary as Arrow arrays."""

    def __init__(self, pieces: list[bytes]):
        self.bytes = pa.array(pieces, pa.large_binary())
        self.length = pa.array([len(p) for p in pieces], pa.int64())
        self.name = pa.array([str(i) for i in range(len(pieces))], pa.string())

    def joined(self, ids: pa.ListArray) -> pa.Array:
        """Bytes of each row's tokens."""
        got = self.bytes.take(pc.list_flatten(ids))
        _, ends, data = got.buffers()
        ends = np.frombuffer(ends, np.int64, len(got) + 1, got.offset * 8) if len(got) else np.zeros(1, np.int64)
        rows = ends[ids.offsets.to_numpy() - ids.offsets[0].as_py()]
        return pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(np.ascontiguousarray(rows)), data or pa.py_buffer(b"")])

    def tokens(self, ids: pa.ListArray, name: str) -> pa.Table:
        """``key, name``: the document-end key and the place of every token of the slice."""
        flat, parent = pc.list_flatten(ids), pc.list_parent_indices(ids)
        upto = pc.cumulative_sum(self.length.take(flat))
        before = pa.array(np.concatenate([[0], upto.to_numpy(zero_copy_only=False)]).astype(np.int64)).take(ids.offsets[:-1])
        end = pc.subtract(upto, before.take(parent))
        key = pc.add(pc.shift_left(parent.cast(pa.int64()), pa.scalar(40, pa.int64())), end)
        return pa.table({"key": key, name: pa.array(np.arange(len(flat)))})


def _lists(of: np.ndarray, n: int, values: pa.Array) -> pa.ListArray:
    """Values of ascending owners ``of`` as one list per owner."""
    upto = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))])
    return pa.ListArray.from_arrays(pa.array(upto, pa.int32()), values)


def _plain(ids: pa.ListArray) -> pa.ListArray:
    """The same lists with offsets from zero."""
    return pa.ListArray.from_arrays(pc.subtract(ids.offsets, ids.offsets[0]), pc.list_flatten(ids))


COLUMNS = {"n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "groups": pa.string(), "links": pa.list_(pa.int64())}


def align_lists(a: pa.ListArray, b: pa.ListArray, side_a: Side, side_b: Side) -> dict[str, pa.Array]:
    """``COLUMNS`` of documents whose tokens cover equal bytes on both sides; a token covers at least one byte, so an end has one link."""
    n = len(a)
    one, two = side_a.tokens(a, "at_a"), side_b.tokens(b, "at_b")
    links = one.join(two, keys="key", join_type="inner", use_threads=False)
    key, at_a, at_b = (links.column(c).to_numpy() for c in ("key", "at_a", "at_b"))
    order = np.argsort(at_a, kind="stable")  # the join keeps no order
    doc, at_a, at_b = key[order] >> 40, at_a[order], at_b[order]
    names, ends = [], []
    for ids, side, at in ((a, side_a, at_a), (b, side_b, at_b)):
        cuts, flat = pa.array(np.concatenate([[0], at + 1]), pa.int32()), pc.list_flatten(ids)
        names.append(pc.binary_join(pa.ListArray.from_arrays(cuts, side.name.take(flat)), ","))
        ends.append(flat.take(pa.array(at)).cast(pa.int64()))
    group = pc.binary_join_element_wise(*names, "|")
    return {
        "n_a": pc.list_value_length(a).cast(pa.int64()), "n_b": pc.list_value_length(b).cast(pa.int64()),
        "n_groups": pa.array(np.bincount(doc, minlength=n).astype(np.int64)), "groups": pc.binary_join(_lists(doc, n, group), ";"),
        "links": _lists(doc, n, pc.add(pc.shift_left(ends[0], pa.scalar(32, pa.int64())), ends[1])),
    }


def align_texts(texts: list[str], words: Words, side_a: Side, side_b: Side) -> list[pa.Array]:
    """``COLUMNS`` of a slice of texts."""
    a, b = words(texts)
    want = pa.array([(" " + t).encode() for t in texts], pa.large_binary())
    same = pc.and_(pc.equal(side_a.joined(a), want), pc.equal(side_b.joined(b), want)).to_numpy(zero_copy_only=False) & np.array([bool(t) for t in texts])
    use = np.nonzero(same)[0]
    if len(use) < len(texts):
        a, b = (_plain(x.take(pa.array(use))) for x in (a, b))
    found = align_lists(a, b, side_a, side_b)
    if len(use) == len(texts):
        return [found[c] for c in COLUMNS]
    place = np.full(len(texts), len(use))
    place[use] = np.arange(len(use))
    none = {"n_a": 0, "n_b": 0, "n_groups": 0, "groups": "", "links": []}
    return [pa.concat_arrays([found[c], pa.array([none[c]], kind)]).take(pa.array(place)) for c, kind in COLUMNS.items()]


class PairCounts:
    """Partial counts of links, merged whenever FLUSH_PAIRS wait: never more than that and the vocabularies' pairs."""

    def __init__(self):
        self.waiting: list[pa.Table] = []

    def add(self, links: pa.Array) -> None:
        counted = pa.table({"key": links}).group_by("key", use_threads=False).aggregate([([], "count_all")])
        self.waiting.append(counted.rename_columns(["key", "n"]))
        if sum(t.num_rows for t in self.waiting) > FLUSH_PAIRS:
            self.waiting = [self.merged()]

    def merged(self) -> pa.Table:
        summed = pa.concat_tables(self.waiting).group_by("key", use_threads=False).aggregate([("n", "sum")])
        return summed.rename_columns(["key", "n"]).combine_chunks()


def _slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive rows of at most ``most`` in sum, or a single larger one."""
    start, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and total + size > most:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def _kernel(vocabularies: Vocabularies):
    """Rows ``place, id, COLUMNS`` of the documents, then rows of partial counts: keys in ``links``, numbers in ``counts``."""
    a, b = vocabularies.a, vocabularies.b

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, side_a, side_b, counts = Words(a, b), Side(a.pieces), Side(b.pieces), PairCounts()
        names, kind = ["place", "id", *COLUMNS, "counts"], None
        for batch in batches:
            kind, text = batch.schema.field("id").type, batch.column("text")
            sizes = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
            for i, j in _slices(sizes, SLICE_BYTES):
                found = align_texts([t or "" for t in text.slice(i, j - i).to_pylist()], words, side_a, side_b)
                counts.add(pc.list_flatten(found[-1]))
                own = [batch.column(c).slice(i, j - i) for c in ("place", "id")]
                yield pa.RecordBatch.from_arrays([*own, *found, pa.nulls(j - i, pa.list_(pa.int64()))], names)
        if kind is None:
            return
        table = counts.merged()
        for at in range(0, table.num_rows, COUNTS_ROW):
            key, n = (pa.array([table.column(c).slice(at, COUNTS_ROW).to_numpy()], pa.list_(pa.int64())) for c in ("key", "n"))
            empty = [pa.nulls(1, t) for t in (pa.int64(), kind, *list(COLUMNS.values())[:-1])]
            yield pa.RecordBatch.from_arrays([*empty, key, n], names)

    return run


def pair_counts(partial: DataFrame) -> DataFrame:
    """``key, n, best`` of every linked id pair (A's id times 2^32 plus B's): its links, and whether no pair of its B id has more."""
    pairs = partial.select(F.explode(F.arrays_zip("links", "counts")).alias("p")).groupBy(F.col("p.links").alias("key")).agg(F.sum("p.counts").alias("n"))
    of_b = Window.partitionBy(F.expr("key & 4294967295"))  # the pairs of one B id: a part of pair_bound()
    return pairs.withColumn("best", (F.col("n") == F.max("n").over(of_b)).cast("long"))


def align(docs: DataFrame, vocabularies: Vocabularies, *, id_col: str = "doc_id", text_col: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """``id, n_a, n_b, n_groups, n_links, n_best, count_sum`` and the columns in ``keep`` of every row.

    ``keep`` names expressions over ``n_a, n_b, n_groups, groups``; by default it is ``groups`` itself, the ids of all groups as
    ``a1,a2|b1;a3|b2,b3``.
    """
    keep = {"groups": F.col("groups")} if keep is None else keep
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("place"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = rows.mapInArrow(_kernel(vocabularies), f"place long, id {kind}, n_a long, n_b long, n_groups long, groups string, links array<long>, counts array<long>")
    kept = F.struct(F.lit(0).alias("_"), *[c.alias(name) for name, c in keep.items()]).alias("kept")
    found = staged(found.select("place", "id", "n_a", "n_b", "n_groups", kept, "links", "counts"), "aligned")
    pairs = staged(pair_counts(found.filter("place is null")), "pairs")
    own = found.filter("place is not null")
    # at most vocabularies.pair_bound() pairs are broadcast; the rows of a document are together, so few numbers are shuffled
    met = own.select("place", F.explode("links").alias("key")).join(F.broadcast(pairs), "key")
    sums = met.groupBy("place").agg(F.count(F.lit(1)).alias("n_links"), F.sum("best").alias("n_best"), F.sum("n").alias("count_sum"))
    out = own.select("place", "id", "n_a", "n_b", "n_groups", "kept").join(sums, "place", "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_links", "n_best", "count_sum")]
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", *numbers, *[F.col(f"kept.`{name}`").alias(name) for name in keep])
