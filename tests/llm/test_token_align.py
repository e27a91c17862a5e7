"""Token alignment against a plain version that walks over the bytes."""

import hashlib
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from refrain.llm import queries, token_align
from refrain.llm.common import table
from tests.conftest import SF

A, B = (public_tokenizers.path(name) for name in (queries.ALIGN_A, queries.ALIGN_B))


@pytest.fixture(scope="module")
def vocabularies():
    return token_align.Vocabularies(A, B)


@pytest.fixture(scope="module")
def plain():
    """Function from texts to the contract's rows, by the two libraries alone."""
    own = Tokenizer.from_file(A)
    own.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=B)
    alphabet = token_align.byte_alphabet()
    a_bytes = {i: bytes(alphabet[c] for c in word) for word, i in own.get_vocab(with_added_tokens=False).items() if i != 50256}

    def b_bytes(i):
        return bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode()

    def ends(parts):
        out, at = {}, 0
        for k, part in enumerate(parts):
            at += len(part)
            out[at] = k
        return out

    def run(texts):
        rows, links = [], []
        for text in texts:
            a = own.encode(" " + (text or ""), add_special_tokens=False).ids
            b = pieces.encode(text or "")
            parts = [a_bytes[i] for i in a], [b_bytes(i) for i in b]
            want = (" " + (text or "")).encode()
            if not text or any(b"".join(p) != want for p in parts):
                rows.append((0, 0, 0, ""))
                links.append([])
                continue
            one, two = map(ends, parts)
            groups, i, j = [], 0, 0
            for end in sorted(set(one) & set(two)):
                groups.append(",".join(map(str, a[i : one[end] + 1])) + "|" + ",".join(map(str, b[j : two[end] + 1])))
                i, j = one[end] + 1, two[end] + 1
            rows.append((len(a), len(b), len(groups), ";".join(groups)))
            links.append([(a[one[e]], b[two[e]]) for e in sorted(set(one) & set(two))])
        counts = Counter(x for some in links for x in some)
        best = {}
        for (_, y), n in counts.items():
            best[y] = max(n, best.get(y, 0))
        return [
            (n_a, n_b, n_g, len(own_links), sum(counts[x] == best[x[1]] for x in own_links), sum(counts[x] for x in own_links), hashlib.sha256(g.encode()).hexdigest() if n_a else "")
            for (n_a, n_b, n_g, g), own_links in zip(rows, links)
        ]

    return run


def digests(rows):
    return sorted(
        ((r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in rows),
        key=lambda r: (r[0] is None, r),
    )


def test_query_equals_plain_version(spark, plain):
    docs = table(spark, SF, "documents").select("doc_id", "text").collect()
    want = sorted((r["doc_id"], *x) for r, x in zip(docs, plain([r["text"] for r in docs])))
    assert digests(queries.op11_token_align(spark, SF).collect()) == want


ODD = [
    None, "", " ", "  ", "x", "x ", "  x  y", "a \n b", "a\n  b", "\t\tx\n", "tab\tand\r\nline", "▁word", "a▁b", "a b", "café 日本語",
    "<|endoftext|> </s> <s> <unk> <0x41>", "don't we'll I'M", "emoji \U0001f600\U0001f468‍\U0001f469", "\x00 \x01", "9" * 50, "word " * 3000, "a" * 20_000, " " * 3000, "word " * 10 + "\n", "x", "x",
]


def test_odd_texts(spark, plain, vocabularies, tmp_path):
    clash = "id n_a groups link_a key row".split()
    rows = [(None if i == 3 else i, t, *(["z"] * len(clash))) for i, t in enumerate(ODD)] + [(4, "x", *(["z"] * len(clash)))]
    docs = spark.createDataFrame(rows, ["doc_id", "text", *clash])
    got = token_align.align(docs, vocabularies)
    got = got.withColumn("groups_sha256", F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise(""))
    want = sorted(((r[0], *x) for r, x in zip(rows, plain([r[1] for r in rows]))), key=lambda r: (r[0] is None, r))
    assert digests(got.collect()) == want
    assert token_align.align(docs.filter("false"), vocabularies, keep={"place": F.col("groups")}).collect() == []
    assert token_align.align(docs.filter("doc_id = 1"), vocabularies, keep={}).collect() == [(1, 0, 0, 0, 0, 0, 0)]


def test_counts_merge_within_a_task(monkeypatch):
    monkeypatch.setattr(token_align, "FLUSH_PAIRS", 3)
    counts = token_align.PairCounts()
    for part in ([1, 2, 2], [5, 1], [7], [], [2, 9, 9, 9]):
        counts.add(pa.array(part, pa.int64()))
    merged = counts.merged()
    assert dict(zip(*(merged.column(c).to_pylist() for c in ("key", "n")))) == {1: 2, 2: 3, 5: 1, 7: 1, 9: 3}


def test_word_wise_encoding_equals_whole_texts(vocabularies):
    texts = [t or "" for t in ODD] + ["one two  three", "one\ntwo three", "\nleading", "trailing\n"]
    words = token_align.Words(vocabularies.a, vocabularies.b)
    assert words.by_word
    whole = token_align.Words(vocabularies.a, vocabularies.b)
    whole.by_word = False
    for _ in range(2):  # from the memo the second time
        assert [x.to_pylist() for x in words(texts)] == [x.to_pylist() for x in whole(texts)]


def test_blanks_beyond_the_fast_library(vocabularies):
    text = "a" + " " * 1_100_000
    a, b = token_align.Words(vocabularies.a, vocabularies.b)([text])
    side_a, side_b = token_align.Side(vocabularies.a.pieces), token_align.Side(vocabularies.b.pieces)
    assert [s.joined(x)[0].as_py() for s, x in ((side_a, a), (side_b, b))] == [(" " + text).encode()] * 2


def test_slices_and_pair_bound():
    import numpy as np

    assert list(token_align._slices(np.array([5, 1, 9, 20, 1]), 10)) == [(0, 2), (2, 3), (3, 4), (4, 5)]
    assert list(token_align._slices(np.array([], int), 10)) == []
    a, b = [b"a", b"ba", b""], [b"a", b"cba", b"a"]
    ends = sum(x.endswith(y) or y.endswith(x) for x in a if x for y in b if y)
    assert token_align.suffix_pairs(a, b) == ends
    assert pa.types.is_list(token_align.COLUMNS["links"])
