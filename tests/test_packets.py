"""Few blocks, packets of columns, signs for lists and counts of candidates: less is moved, with the same results."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from refrain.functions import text as X
from refrain.operators import neighbours as N
from refrain.operators import vectors as V


def points_of(spark, n=400, dim=300):
    draw = np.random.default_rng(7)
    rows = []
    for i in range(n):
        idx = np.sort(draw.choice(dim, int(draw.integers(0, 40)), replace=False))
        rows.append((i, idx.astype(int).tolist(), draw.integers(1, 4, len(idx)).astype(int).tolist()))
    rows += [(n + i, *rows[i][1:]) for i in range(50)]
    return spark.createDataFrame(rows, "doc bigint, idx array<int>, tf array<bigint>").repartition(4).cache(), 1 + draw.random(dim)


def test_a_point_moves_as_often_as_the_cores_need(spark):
    cores = spark.sparkContext.defaultParallelism
    few = N.pair_blocks(spark.range(1), 460_000, 2048, 65)
    assert few * (few + 1) // 2 >= min(136, 3 * cores) and (few < 16 or cores > 40)
    assert N.pair_blocks(spark.range(1), 460_000, 2048, 1536) == N.block_count(460_000, 2048, 1536)  # wide points: blocks stay bounded
    assert N.pair_blocks(spark.range(1), 9_000_000, 2048, 65) >= 9_000_000 / N.block_rows(2048, 65)
    assert N.pair_blocks(spark.range(1), 0, 2048, 0) == N.pair_blocks(spark.range(1), 100, 2048, 65) == 1


def test_each_pair_is_one_task_and_its_points_are_packets(spark):
    counts, idf = points_of(spark)
    points = N.counted(N.collapse_counts(counts, None)[0], idf)
    rep = N._replicate(points, 6)
    assert rep.columns == ["packet", "bi", "bj", "task"]
    places = rep.select("bi", "bj", F.spark_partition_id().alias("p")).distinct().collect()
    assert len(places) == len({r["p"] for r in places}) == 21
    packets = rep.filter("bi = bj").select("packet").toArrow()
    back = N._unpacked(packets).to_pydict()
    got = sorted(zip(back["pid"], map(tuple, back["idx"]), map(tuple, back["tf"])))
    assert got == sorted((r["pid"], tuple(r["idx"]), tuple(r["tf"])) for r in points.collect())
    whole = points.toArrow().get_total_buffer_size()
    assert sum(len(p) for p in packets["packet"].to_pylist()) < 0.8 * whole


def test_packets_are_cut_where_many_rows_come(spark, monkeypatch):
    batches = [pa.RecordBatch.from_pydict({"pid": list(range(a, a + 10)), "blk": pa.array([i % 3 for i in range(10)], pa.int32())}) for a in (0, 10, 20)]
    monkeypatch.setattr(N, "PACKED", 20)
    out = list(N._pack(["blk"])(iter(batches)))
    assert [b.column("blk")[0].as_py() for b in out] == [0, 1, 2, 0, 1, 2]
    table = N._unpacked(pa.Table.from_batches(out))
    assert sorted(table["pid"].to_pylist()) == list(range(30))
    assert list(N._pack(["blk"])(iter([]))) == []


def test_members_are_found_by_signs(spark):
    counts, _ = points_of(spark)
    more = counts.unionByName(spark.createDataFrame([(900, [], []), (901, [], []), (902, [1], [70000]), (903, [1], [70000]), (None, [1], [2])], counts.schema))
    points, members = N.collapse_counts(more, None)
    assert points.dtypes == [("pid", "bigint"), ("mult", "bigint"), ("idx", "array<int>"), ("tf", "array<bigint>")]
    seen = {}
    for r in more.filter("doc IS NOT NULL").orderBy("doc").collect():
        seen.setdefault((tuple(r["idx"]), tuple(r["tf"])), []).append(r["doc"])
    assert sorted((r["pid"], r["mult"], tuple(r["idx"]), tuple(r["tf"])) for r in points.collect()) == sorted((d[0], len(d), *k) for k, d in seen.items())
    assert sorted(map(tuple, members.collect())) == sorted((d, docs[0]) for docs in seen.values() for d in docs)
    plan = members._jdf.queryExecution().toString().split("Physical Plan")[-1]
    assert "lists" in plan and "hashpartitioning(idx" not in plan  # the lists of terms do not cross the network again


def coded_rows(spark, groups):
    rows = []
    for docs in groups:
        toks = pa.array([t for d in docs for t in d], pa.string()).dictionary_encode()
        rows.append((toks.dictionary.to_pylist(), np.bincount(toks.indices.to_numpy(), minlength=len(toks.dictionary)).tolist()))
    return spark.createDataFrame(rows, "terms array<string>, counts array<bigint>")


@pytest.mark.parametrize("size", [1, 3, 8, 40, 500])
def test_frequent_tokens_are_counted_whole(spark, size):
    draw = np.random.default_rng(size)
    # rows of unequal size; some tokens are spread thin over all rows, others fill a single one
    groups = [[[f"w{min(int(z), 90)}" for z in draw.zipf(1.3, int(n))] + [f"own{g}"] * 9] for g, n in enumerate(draw.integers(1, 400, 12))]
    rows = coded_rows(spark, groups)
    whole = {}
    for docs in groups:
        for t in docs[0]:
            whole[t] = whole.get(t, 0) + 1
    got = {r["term"]: r["cf"] for r in V.frequent_tokens(rows, size).collect()}
    least = sorted(whole.values(), reverse=True)[min(size, len(whole)) - 1]
    assert all(got[t] == whole[t] for t in got)
    assert {t for t, n in whole.items() if n >= least} <= set(got)
    if size <= 3:
        assert len(got) < len(whole)  # the rest is not counted
    if size == 500:
        assert len(got) == len(whole)


def test_more_candidates_than_a_task_is_sent(spark, monkeypatch):
    rows = coded_rows(spark, [[["aa", "aa", "bb"]], [["bb", "bb", "cc"]]])
    want = sorted(map(tuple, V.frequent_tokens(rows, 1).collect()))
    monkeypatch.setattr(V, "CANDIDATES", 0)
    assert set(want) <= set(map(tuple, V.frequent_tokens(rows, 1).collect())) == {("aa", 2), ("bb", 3), ("cc", 1)}


def test_codes_by_planes_come_back(spark):
    docs = spark.createDataFrame([(1, "aa bb aa"), (2, ""), (3, " ".join(f"t{i}" for i in range(70_000)))], "doc bigint, text string").coalesce(1)
    got = {}
    for batch in V.coded(docs).toArrow().to_batches():
        for keys, doc, terms, codes in V._decoded([batch]):
            for i, d in enumerate(keys.to_pylist()):
                got[d] = [terms[int(c)].as_py() for c in codes[doc == i]]
    assert got == {1: ["aa", "bb", "aa"], 2: [], 3: [f"t{i}" for i in range(70_000)]}


def test_texts_that_touch_are_apart():
    texts = pa.array(["ab", "cd", "", "e", "f", "é", "éa", "xy é", "é zz"])
    lens, toks = V.plain_tokens(texts)
    assert lens.tolist() == [1, 1, 0, 0, 0, 0, 1, 1, 1] and toks.to_pylist() == ["ab", "cd", "éa", "xy", "zz"]
    assert V.plain_tokens(pa.array([], pa.string()))[1].to_pylist() == []


def test_long_strip_is_strip(spark):
    ends = [w for w in X.WHITESPACE] + ["", "\u200b", "\u0105", "\u00c5", "x", "é", "\u4f60", "\U0001f600"]
    rows = [(a + body + b,) for a in ("", " ", "\u3000") for body in ("", "a b", "\u00a0y\u2003z") for b in ends] + [(None,)]
    df = spark.createDataFrame(rows, "t string")
    got = df.select("t", X.strip_long("t").alias("a"), X.strip("t").alias("b")).collect()
    assert all(r["a"] == r["b"] for r in got) and all(r["a"] == r["t"].strip() for r in got if r["t"] is not None)
    plan = df.select(X.strip_long("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert "ltrim" in plan.lower() or "trim(leading" in plan.lower()


def test_texts_are_split_in_pieces(spark, monkeypatch):
    texts = [f"t{i} é{i} " * (i % 4) for i in range(23)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(23)), pa.array(texts), pa.nulls(23, pa.list_(pa.string()))], ["doc", "plain", "toks"])
    whole = V._tokens_of(batch)
    monkeypatch.setattr(V, "SPLIT_ROWS", 5)
    parts = V._tokens_of(batch)
    assert whole[0].equals(parts[0]) and whole[1].tolist() == parts[1].tolist() and whole[2].equals(parts[2])


def test_numbers_are_counted_alike_with_and_without_a_sort(monkeypatch):
    key = np.random.default_rng(2).integers(0, 50, 300)
    one = V._counted(key, 60)
    monkeypatch.setattr(V, "KEYS", 10)
    two = V._counted(key, 60)
    assert one[0].tolist() == two[0].tolist() and one[1].tolist() == two[1].tolist()
    assert V._counted(np.zeros(0, np.int64), 0)[0].tolist() == []


def test_batches_are_cut_by_bytes(monkeypatch):
    texts = ["ab cd", None, "x" * 40, "ef", "", "gh ij kl", None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts), pa.array([["zz"] if t is None else None for t in texts], pa.list_(pa.string()))], ["doc", "plain", "toks"])
    monkeypatch.setattr(V, "CODED_BYTES", 10)
    pieces = list(V._cut(batch))
    assert [d for p in pieces for d in p.column("doc").to_pylist()] == list(range(7)) and [p.num_rows for p in pieces] == [2, 1, 4]
    assert list(V._cut(batch.slice(0, 0))) == []
    got = {}
    for keys, doc, terms, codes in V._decoded(V._code(iter([batch]))):
        for i, d in enumerate(keys.to_pylist()):
            got[d] = [terms[int(c)].as_py() for c in codes[doc == i]]
    assert got == {0: ["ab", "cd"], 1: ["zz"], 2: ["x" * 40], 3: ["ef"], 4: [], 5: ["gh", "ij", "kl"], 6: ["zz"]}
