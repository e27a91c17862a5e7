"""Operators and pipeline stages on small tables: defined cases, and results against brute force."""

import hashlib
import itertools
import math
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from refrain.llm import byte_bpe, chat_format, html_extract, lsh_forest, mixing, multi_index, quality, toxicity, warc, winnowing
from refrain.llm.queries import ORACLE, QUERIES
from refrain.operators.components import connected_components
from tests.conftest import SF
from tests.test_parity import _norm

LARGER = SF.replace("sf0.001", "sf0.01")  # the smallest one with enough labels of both kinds
TABLES = "documents embeddings pages benchmark labels conversations".split()
RANKS = byte_bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
ENC = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, id string, y int, sign string"


def words(n, seed=0, step=1):
    return " ".join(f"w{(i * step + seed) % 997}" for i in range(n))


ROWS = [
    (0, words(60), "en", "a"),
    (1, words(60), "en", "a"),
    (2, words(60) + " tail", None, None),
    (3, None, "en", "b"),
    (4, "", "en", "b"),
    (5, " \n\t", "de", "b"),
    (6, "one two", "en", "b"),
    (7, "One  TWO", "en", "b"),
    (8, words(3000, 5, 3), "en", "b"),
    (9, "äöü ß 漢字 🙂 " * 30, "en", None),
    (None, words(60), "en", "a"),
    (11, words(40, 300), "en", "c"),
    (11, words(40, 300), "en", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, lang, s, len(t) if t is not None else None, 0.5, "x", 7, "z") for i, t, lang, s in ROWS], DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = con.sql(ORACLE[name])
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted((tuple(_norm(r[i]) for i in at) for r in rel.fetchall()), key=repr)


# components


def test_components_of_chains_stars_and_loops(spark):
    n = 700
    edges = [(i, i + 1) for i in range(1, n)] + [(5000, 5000 + i) for i in range(1, 300)] + [(8000, 8000), (None, 3), (9000, 9001), (9001, 9000)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, n + 1)} | {5000 + i: 5000 for i in range(300)} | {9000: 9000, 9001: 9000}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1


def test_pages_with_nulls_repeats_and_no_rows(spark):
    schema = "page_id long, url string, html string, text string"
    rows = [(1, None, None, "x"), (None, "u", "<p>a &amp; b", "x"), (3, "u", "", "x"), (3, "u", "", "x")]
    got = html_extract.extract(spark.createDataFrame(rows, schema)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, None, "", 0), (None, "u", "a & b", 5), (3, "u", "", 0), (3, "u", "", 0)], key=repr)
    assert html_extract.extract(spark.createDataFrame([], schema)).count() == 0


# 2


def brute_links(rows, similarity=0.98):
    ok = [(i, lab, np.array(v, float)) for i, v, lab in rows if i is not None and lab is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    linked = {i: set() for i, *_ in ok}
    for (i, a, x), (j, b, y) in itertools.combinations(ok, 2):
        if i != j and a == b and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= similarity:
            linked[i].add(j), linked[j].add(i)
    return linked


def test_embedding_links_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "BLOCK", 16)
    draw = np.random.default_rng(6)
    base = draw.normal(size=(30, 8))
    rows = []
    for i in range(240):
        v = base[i % 30 if i % 3 else 0] + draw.normal(scale=0.06, size=8)
        rows.append((i, [float(x) for x in np.float32(v * draw.uniform(0.5, 2))], int(i % 2)))
    rows += [(300 + i, [float(x) for x in np.float32(base[0])], 0) for i in range(50)]  # equal vectors
    rows += [(400, None, 0), (401, [0.0] * 8, 0), (402, [1.0] + [None] * 7, 0), (403, [float("nan")] * 8, 0), (404, [float("inf")] + [1.0] * 7, 0)]
    rows += [(405, rows[0][1], None), (None, rows[0][1], 0), (406, [1.0], 0), (407, [2.0], 0), (408, [-1.0], 0), (409, [1e30] * 8, 5), (410, [1e-30] * 8, 5)]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "vec_id long, embedding array<double>, label int, id string, n int")
    got = {r["vec_id"]: r for r in multi_index.near_duplicates(df, target_recall=1.0).collect()}
    linked = brute_links(rows)
    assert len(got) == len(rows) and linked[406] == {407} and linked[409] == {410}
    for i, r in got.items():
        assert r["n_links"] == len(linked.get(i, ()))
        seen, todo = {i}, [i]
        while todo:
            todo += [k for k in linked.get(todo.pop(), ()) if k not in seen and not seen.add(k)]
        least = None if i is None else min(seen)
        assert (r["component_id"], r["kept"]) == (least, i is None or least == i)
    assert multi_index.near_duplicates(df.limit(0)).count() == 0
    probable = multi_index.near_duplicates(df).agg(F.sum("n_links")).first()[0]
    assert probable >= 0.99 * sum(map(len, linked.values()))


# 3 and 6


def labelled(spark):
    toxic = [(i, f"{words(20, i)} vileword {words(20, 3 * i)}" if i % 4 == 0 else words(40, i)) for i in range(400)]
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t in toxic], "doc_id long, text string, lang string, score double")
    labels = [(i, int(i % 2), int(i % 4 == 0)) for i in range(300)] + [(None, 1, 1), (5, None, None), (999, 1, 1), (7, 3, 3)]
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxic_words_are_learned_and_found(spark):
    docs, labels = labelled(spark)
    rows = {r["doc_id"]: r for r in toxicity.classify(docs, labels).collect()}
    assert len(rows) == 400
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert r["predicted"] == int(r["score"] >= 0.7) == int(i % 4 == 0)
    first = rows[0]["passages"][0]
    assert (first["first"], first["last"]) == (20, 20)


def test_scores_do_not_see_held_out_labels(spark):
    docs, labels = labelled(spark)
    wrong = labels.withColumn("toxic", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (toxicity.train(docs, x) for x in (labels, wrong))
    assert one == two


@pytest.mark.parametrize("module, columns", [(toxicity, 5), (quality, 4)])
def test_classifiers_on_odd_rows(spark, docs, no_docs, module, columns):
    _, labels = labelled(spark)
    known, _ = labelled(spark)
    both = known.select("doc_id", "text").unionByName(docs.select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    rows = module.classify(both, labels).collect()
    assert len(rows) == 400 + len(ROWS) and all(len(r) == columns and 0 <= r["score"] <= 1 for r in rows)
    assert module.classify(no_docs, labels).count() == 0
    empty = labels.filter("false")
    scores = {r["score"] for r in module.classify(docs, empty).collect()}
    assert len(scores) == 1 and (module is toxicity or scores == {0.5})
    module.classify(docs, labels.filter("toxic = 0 and quality = 1")).collect()  # labels of one kind


def test_quality_is_learned_and_the_same_every_time(spark):
    docs = spark.createDataFrame([(i, (words(30, i) if i % 3 else words(30, i).upper().replace(" ", "!! "))) for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)], "doc_id long, quality int")
    rows = quality.classify(docs, labels).collect()
    assert np.mean([(r["score"] >= 0.5) == (r["doc_id"] % 3 > 0) for r in rows if r["held_out"] and r["doc_id"] < 300]) > 0.98
    again = quality.classify(docs.repartition(7), labels).collect()
    assert {r["doc_id"]: r["score"] for r in rows} == {r["doc_id"]: r["score"] for r in again}


# 4


def test_fingerprints_beside_the_next_document(spark, docs, no_docs):
    got = winnowing.compare_neighbours(docs).collect()
    order = sorted(((i is not None, i or 0, t or "") for i, t, *_ in ROWS))
    # the next of a row before a repeated id is that id's first text
    want = []
    for at, (some, i, text) in enumerate(order):
        follows = order[(at + 1) % len(order)][2]
        new = text[: len(text) - len(text) // 4] + follows[: len(text) // 4]
        a, b, c = (winnowing.winnow(t) for t in (text, new, follows))
        want.append((i if some else None, len(text), hashlib.sha256(new.encode()).hexdigest(), winnowing.digest(a), winnowing.digest(b), winnowing.likeness(a[0], b[0]), winnowing.likeness(a[0], c[0])))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert winnowing.compare_neighbours(no_docs).count() == 0
    one = winnowing.compare_neighbours(docs.filter("doc_id = 0")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    spans = {r["doc_id"]: r["fingerprint"] for r in winnowing.fingerprints(docs).collect()}
    assert spans[3] == [] and [(x["hash"] % 2**64, x["position"]) for x in spans[0]] == [(int(h), int(p)) for h, p in zip(*winnowing.winnow(words(60)))]


def test_likeness_is_that_of_the_returned_fingerprints(spark):
    draw = np.random.default_rng(6)
    text = "".join(draw.choice(list("abcdefgh "), 110))
    texts = [text[:n] for n in (102, 101, 100, 99, 98, 110, 0, 9, 10, 21)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r["doc_id"]: np.array([x["hash"] for x in r["fingerprint"]], np.int64).view(np.uint64) for r in winnowing.fingerprints(df).collect()}
    for r in winnowing.compare_neighbours(df).collect():
        assert r["near_next"] == winnowing.likeness(spans[r["doc_id"]], spans[(r["doc_id"] + 1) % len(texts)])
    near = {r["doc_id"]: r["near_next"] for r in winnowing.compare_neighbours(df).collect()}
    assert min(near[i] for i in range(4)) > 0.7


# 5


def test_ids_equal_the_library_and_decode_to_the_text(spark, docs, no_docs):
    odd = ["a  b \x1c\x85 c", "  x\n\n y\t", "can't we'll I'D 12½³", "́é", "x" * 3000, "\x00\x1f", "🙂🙂 漢字かな"]
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    rows = byte_bpe.encode_decode(docs.select("doc_id", "text").unionByName(more), RANKS, P.PATTERN).collect()
    assert len(rows) == len(ROWS) + len(odd)
    for r in rows:
        assert r["ids"] == ENC.encode_ordinary(r["text"] or "") and bytes(r["decoded"]) == (r["text"] or "").encode()
    kept = byte_bpe.encode_decode(docs.withColumnRenamed("y", "ids"), RANKS, P.PATTERN)
    assert kept.columns.count("ids") == 1 and set(docs.columns) - {"y"} <= set(kept.columns)
    assert byte_bpe.encode_decode(no_docs, RANKS, P.PATTERN).count() == 0


def test_the_native_fold_gives_the_same_ids(spark):
    some = [" hello", "thntblere", "äöü", "a", "", None, "漢字", " supercalifragilistic"]
    got = {r["word"]: r["ids"] for r in byte_bpe.encode_words_native(spark.createDataFrame([(w,) for w in some], "word string"), RANKS).collect()}
    assert got == {w: byte_bpe.merge_word(w.encode(), RANKS) if w else [] for w in some if w is not None}


# 7


def test_archives_hold_every_page_once(spark):
    big, other = "<p>" + "same page " * 200, "ä" * 600
    rows = [(1, "u", big), (9, None, big), (4, "http://x.example/ä b\r\n", big), (2, "u", "small"), (3, "u", "small"), (5, "u", None), (6, "u", other), (None, "u", big), (7, "u", "y" * 999), (8, "u", "y" * 999), (9, "u", big)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, record_type string")
    folder = warc.new_folder(spark)
    assert warc.write_archives(pages, folder).agg(F.sum("records")).first()[0] == len(rows)
    back = warc.read_archives(spark, folder, with_payload=True).collect()
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in back), key=repr)
    raw = [(i, (h or "").encode()) for i, _, h in rows]
    revisit = lambda i, p: p == big.encode() and i in (1, 4)
    assert got == sorted(((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if revisit(i, p) else "response", 9 if revisit(i, p) else None) for i, p in raw), key=repr)
    assert all((r["payload"] is None) == (r["record_type"] == "revisit") for r in back)
    folder = warc.new_folder(spark)
    assert warc.write_archives(pages.limit(0), folder).count() == 0 and warc.read_archives(spark, folder).count() == 0


def test_archives_begin_with_their_dictionary(spark):
    pages = spark.range(400).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("<html><body>some words that repeat "), F.col("id"), F.repeat(F.lit(" and more"), 40)).alias("html"))
    folder = warc.new_folder(spark)
    paths = [r["path"] for r in warc.write_archives(pages.coalesce(1), folder).collect()]
    heads = []
    for path in paths:
        files, name = warc.file_system(path)
        heads.append(files.open_input_stream(name, compression=None).read(4))
    assert heads and (0x184D2A5D).to_bytes(4, "little") in heads


# 8


def test_swapped_replies_on_odd_rows(spark):
    schema = "conv_id long, turn int, role string, text string, range string, n string"
    talk = lambda i, *turns: [(i, t, r, x, "z", "z") for t, (r, x) in enumerate(turns)]
    u, a = (lambda x: ("user", x)), (lambda x: ("assistant", x))
    rows = talk(5, u("q"), a("A"), u("r"), a("B"), u("end")) + talk(7, u("only")) + talk(10**12, a("C"), u("s")) + talk(12, u("x"), a("D"), a("E"), a("F"), u(None))
    rows += talk(None, u("lost"), a("lost")) + [rows[1], (-3, None, "assistant", None, "z", "z"), (7, 1, None, "odd", "z", "z")]
    df = spark.createDataFrame(rows, schema).repartition(5)
    chosen, rejected = chat_format.with_swapped_replies(df)
    got = {r["conv_id"]: r for r in chat_format.preference_pairs(chosen, rejected, pair="conv_id").collect()}
    assert sorted(got) == [-3, 5, 7, 12, 10**12]
    said = lambda r, side: [r[side][s["from"] : s["to"]].removesuffix("<|end|>\n") for s in r[f"{side}_spans"]]
    # 5 % 2 = 1: the second reply on; 12 % 3 = 0: all of them
    assert got[5]["n_prompt_turns"] == 3 and said(got[5], "chosen") == ["B"] and said(got[5], "rejected") == ["E"]
    assert got[5]["chosen"].endswith("<|user|>\nend<|end|>\n") and got[5]["rejected"].endswith("<|user|>\nend<|end|>\n")
    assert got[12]["n_prompt_turns"] == 1 and said(got[12], "chosen") == ["D", "E", "F"] and said(got[12], "rejected") == ["C"] * 3
    assert said(got[10**12], "rejected") == [""] and said(got[-3], "rejected") == ["A"]
    assert not got[7]["differs"] and got[7]["n_prompt_turns"] == 2 and got[7]["chosen"] == got[7]["rejected"] == ""
    one = chat_format.preference_pairs(*chat_format.with_swapped_replies(df.filter("conv_id = 5")), pair="conv_id").collect()
    assert len(one) == 1 and one[0]["n_prompt_turns"] == 3 and said(one[0], "rejected") == ["B"] or said(one[0], "chosen") == []
    assert chat_format.preference_pairs(*chat_format.with_swapped_replies(df.filter("false")), pair="conv_id").count() == 0


def test_preference_pairs_share_one_prompt(spark):
    schema = "pair_id long, turn int, role string, text string, prompt string"
    chosen = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "bye"), (2, 0, "user", "x"), (3, 0, None, None), (4, 0, "user", "<|end|> \\"), (None, 0, "user", "x"), (1, 0, "user", "hi")]
    rejected = [(1, 0, "user", "hi"), (1, 1, "assistant", "no"), (2, 0, "user", "x"), (3, 0, "", ""), (5, 0, "assistant", "alone")]
    frames = [spark.createDataFrame([(*r, "c") for r in rows], schema) for rows in (chosen, rejected)]
    got = {r["pair_id"]: r for r in chat_format.preference_pairs(*frames).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5]
    one = got[1]
    assert one["prompt"] == "<|user|>\nhi<|end|>\n" and one["n_prompt_turns"] == 1 and one["differs"]
    assert one["chosen"] == "<|assistant|>\nyes<|end|>\n<|user|>\nbye<|end|>\n" and one["rejected"] == "<|assistant|>\nno<|end|>\n"
    assert [one["chosen"][s["from"] : s["to"]] for s in one["chosen_spans"]] == ["yes<|end|>\n"]
    assert not got[2]["differs"] and got[2]["chosen"] == "" and not got[3]["differs"]
    assert got[4]["chosen"] == "<|user|>\n<\\|end|> \\\\<|end|>\n" and got[4]["rejected"] == "" and got[4]["chosen_spans"] == []
    assert got[5]["prompt"] == "" and len(got[5]["rejected_spans"]) == 1
    assert chat_format.preference_pairs(*[f.limit(0) for f in frames]).count() == 0


# 9


def test_mixing_meets_its_budget_without_breaking_documents(spark):
    rows = [(i, "big" if i % 10 else f"small{i % 3}", 10 + i % 7) for i in range(3000)]
    docs = spark.createDataFrame([(*r, "old", 1) for r in rows], "doc_id long, source string, n long, mix_epoch string, src int")
    plan = mixing.mixing_plan(docs, tokens=F.col("n"), block_docs=64, target_entropy=0.9, max_repeats=3.0)
    plans = {r["src"]: r for r in plan.collect()}
    mixed = mixing.mix(docs, plan)
    assert mixed.columns == ["doc_id", "source", "n", "src", "mix_epoch", "mix_block", "mix_key"]
    copies = mixed.toPandas()
    share = np.array([r["tokens"] for r in plans.values()], float) / sum(r[2] for r in rows)
    weights = np.array([r["weight"] for r in plans.values()])
    assert abs(weights.sum() - 1) < 1e-9 and 0 < plans["=big"]["alpha"] < 1 and np.all(np.argsort(weights) == np.argsort(share))
    entropy = -(weights * np.log(weights)).sum() / math.log(len(weights))
    assert abs(entropy - 0.9) < 1e-6 or max(r["budget"] / r["tokens"] for r in plans.values()) <= 3.0 + 1e-6
    for src, part in copies.groupby(copies["source"].map(lambda s: "=" + s)):
        p = plans[src]
        used = part["n"].sum()
        assert used <= p["budget"] < used + 17  # the next document would not fit
        times = part.groupby("doc_id").size()
        assert set(times) <= {p["full_epochs"], p["full_epochs"] + 1}


def test_mixing_on_odd_rows(docs, no_docs):
    plan = mixing.mixing_plan(docs, target_entropy=0.9)
    mixed = mixing.mix(docs, plan)
    assert {r["src"] for r in plan.collect()} == {"=a", "=b", "=c", "null"} and set(docs.columns) <= set(mixed.columns)
    assert mixing.mix(no_docs, mixing.mixing_plan(no_docs)).count() == 0
    silent = docs.filter("doc_id in (3, 4, 5)")
    assert mixing.mix(silent, mixing.mixing_plan(silent)).count() == 3


# 10


def brute_components(rows, size, percent):
    memo = lsh_forest.Words()
    sets = [(i, set(lsh_forest.shingles(t or "", size, memo).tolist())) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = find(i), find(j)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}


@pytest.mark.parametrize("size, percent, region", [(3, 85, 256), (5, 80, 4)])
def test_near_duplicates_equal_brute_force(spark, size, percent, region):
    draw = np.random.default_rng(8)
    rows = []
    for g in range(12):
        base = [f"g{g}x{i}" for i in range(80)]
        for _ in range(1 + 3 * g):
            copy = list(base)
            for at in draw.integers(0, 80, draw.integers(0, 5)):
                copy[at] = f"e{draw.integers(0, 9999)}"
            rows.append((len(rows), " ".join(copy)))
    rows += [(900, None), (901, ""), (902, "a b"), (903, "A  b"), (904, "a b c"), (None, rows[0][1]), (rows[3][0], rows[3][1])]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, id string, n int")
    got = lsh_forest.near_duplicates(df, shingle=size, percent=percent, region=region).collect()
    want = brute_components(rows, size, percent)
    assert len(got) == len(rows)
    assert all((r["component_id"], r["kept"]) == (want.get(r["doc_id"]), r["doc_id"] is None or want[r["doc_id"]] == r["doc_id"]) for r in got)
    assert len(set(want.values())) > 12


def test_near_duplicates_on_odd_rows(docs, no_docs):
    got = {r["doc_id"]: r for r in lsh_forest.near_duplicates(docs, shingle=3, percent=85).collect()}
    assert got[0]["component_id"] == got[1]["component_id"] == got[2]["component_id"] == 0
    assert got[7]["component_id"] == 6 and not got[7]["kept"] and got[3]["n_shingles"] == got[5]["n_shingles"] == 0
    assert got[None]["component_id"] is None and got[None]["kept"]
    assert lsh_forest.near_duplicates(no_docs).count() == 0


def test_isolated_pairs_at_the_threshold_in_a_large_region_are_found(spark):
    # a template shared by all (similarity 0.78 at most) and pairs of documents at just 0.80 in it
    rows = []
    for pair in range(300):
        for side in "ab":
            own = [f"p{pair}x{i}" for i in range(6)] + [f"d{pair}{side}{i}" for i in range(49)]
            rows.append((2 * pair + (side == "b"), " ".join([f"t{i}" for i in range(390)] + own)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = lsh_forest.near_duplicates(df, shingle=1, percent=80, region=64).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: i - i % 2 for i, _ in rows}


@pytest.mark.parametrize("percent", [50, 70, 80, 85, 95])
def test_large_regions_keep_the_miss_bound(percent):
    s, base = percent / 100, lsh_forest.base_depth(percent)
    last, trees = lsh_forest.last_depth(percent)
    assert last == base or (1 - s**base) ** lsh_forest.TREES + (1 - s**last) ** trees <= lsh_forest.MISS


# the pipeline


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, docs, no_docs, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs, SF)
    ids = [r["doc_id"] for r in out.collect()]
    if name != "byte_bpe":
        assert out.columns == docs.columns
    if name == "minhash":
        assert sorted(i for i in ids if i is not None) == [0, 3, 4, 5, 6, 7, 8, 9, 11] or sorted(i for i in ids if i is not None) == [0, 3, 4, 5, 6, 8, 9, 11]
        assert ids.count(None) == 1
    if name == "byte_bpe":
        assert len(ids) == len(ROWS)
    assert stage(spark, no_docs, SF).count() == 0


def test_pipeline_equals_a_plain_version(spark):
    rows = {r["doc_id"]: r for r in spark.read.parquet(f"{LARGER}/documents.parquet").collect()}
    labels = spark.read.parquet(f"{LARGER}/labels.parquet")
    table = lambda ids: spark.createDataFrame([rows[i] for i in ids], "doc_id long, text string, lang string, source string, n_chars long")

    model = toxicity.train(table(rows), labels)
    memo = toxicity.WordTable(model.word_score, [np.float64])
    left = []
    for i, r in rows.items():
        codes = memo.codes(r["text"].encode())
        x = toxicity.statistic(toxicity.segments(memo.columns[0][codes]), len(codes), model.lam)
        if model.probability(np.array(x)) < toxicity.THRESHOLD:
            left.append(i)
    assert 0 < len(left) < len(rows)
    weights, forms = quality.train(table(left), labels), quality.WordForms()
    left = [i for i in left if quality.score_of(quality.hashed_ngrams(rows[i]["text"].encode(), forms), weights) >= corpus_pipeline.GOOD_FROM]
    parts = brute_components([(i, rows[i]["text"]) for i in left], lsh_forest.SHINGLE, lsh_forest.PERCENT)
    left = [i for i in left if parts[i] == i]
    mixed = duckdb.connect()
    mixed.register("documents", pd.DataFrame([{"doc_id": i, "text": rows[i]["text"], "source": rows[i]["source"]} for i in left]))
    sql = ORACLE["op9_source_mix"].replace(str(mixing.TARGET_ENTROPY), str(corpus_pipeline.TARGET_ENTROPY))
    want = [(i, ENC.encode_ordinary(rows[i]["text"])) for (i,) in mixed.sql(f"SELECT doc_id FROM ({sql})").fetchall()]
    got = [(r["doc_id"], r["ids"]) for r in corpus_pipeline.run(spark, LARGER).collect()]
    assert sorted(got) == sorted(want)
