"""What crosses the network: counts instead of weights, narrow rows instead of texts; with the same results."""

import datetime as dt

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from refrain.operators import neighbours, patterns
from refrain.operators import vectors as V


def counted_points(spark, n=240, dim=30, most=300):
    draw = np.random.default_rng(3)
    data = []
    for i in range(n):
        idx = np.sort(draw.choice(dim, int(draw.integers(0, 9)), replace=False))
        tf = draw.integers(1, 5, len(idx))
        if i % 7 == 0 and len(idx):
            tf[0] = most
        data.append((i, idx.tolist(), tf.tolist()))
    idf = 1 + draw.random(dim)
    docs = spark.createDataFrame(data + [(n + i, *data[i][1:]) for i in range(20)], "doc bigint, idx array<int>, tf array<bigint>")
    return V.weighed(docs, idf).cache(), idf


def test_counts_move_and_give_the_same_neighbours(spark):
    vectors, idf = counted_points(spark)
    ords = vectors.select("doc", F.col("doc").alias("ord"))
    plain, of = neighbours.collapse(vectors, ords)
    points, of_counts = neighbours.collapse(vectors, ords, idf)
    rows = lambda df, *c: sorted(map(tuple, df.select(*c).collect()), key=repr)
    assert rows(points, "pid", "mult", "idx", "val") == rows(plain, "pid", "mult", "idx", "val")
    assert rows(of, "doc", "pid") == rows(of_counts, "doc", "pid")
    slim = neighbours.counted(points, idf)
    kinds = {f.name: f.dataType.simpleString() for f in slim.schema.fields}
    assert "val" not in kinds and kinds["idx"] == "array<tinyint>" and kinds["tf"] == "array<smallint>"
    for similarity in (0.4, 0.75):
        assert rows(neighbours.neighbour_weights(points, similarity, 4, idf), "pid", "n_neighbours") == rows(neighbours.neighbour_weights(plain, similarity, 4), "pid", "n_neighbours")
        got = neighbours.dbscan(points, similarity, 4, block=64, cells=False, idf=idf)
        assert rows(got, "pid", "cluster", "core") == rows(neighbours.dbscan(plain, similarity, 4, block=64, cells=False), "pid", "cluster", "core")
        assert got.count()


def test_weights_in_tasks_equal_the_written_ones_in_every_bit(spark):
    vectors, idf = counted_points(spark)
    from refrain.operators.tiles import Rows

    table = neighbours.counted(vectors.withColumn("pid", F.col("doc")).orderBy("doc"), idf).toArrow()
    val = np.concatenate([np.array(r["val"]) for r in vectors.orderBy("doc").collect()])
    assert Rows.of(table, idf).val.tobytes() == val.tobytes()
    assert Rows.of(pa.table({"idx": pa.array([[]], pa.list_(pa.int8())), "tf": pa.array([[]], pa.list_(pa.int8()))}), idf).n2.tolist() == [0.0]


def test_samples_skip_the_representative_and_texts_move_once(spark, monkeypatch):
    seen = {}
    stage = patterns.staged
    monkeypatch.setattr(patterns, "staged", lambda df, label: seen.setdefault(label, stage(df, label)))
    rep, long = "run all the tests again", "please lint " + "x" * 120
    texts = [rep, rep, rep + "\nand then stop", long, long + "y", rep + " "]
    rows = [(0, 0, i, f"u{i}", dt.datetime(2024, 1, 1 + i), t) for i, t in enumerate(texts)] + [(1, 1, 9, "v", dt.datetime(2024, 2, 1), long)]
    members = spark.createDataFrame(rows, "cluster long, pid long, ord long, uuid string, ts timestamp, text string")
    got = {r["cluster"]: r for r in patterns.summarise(members, spark.createDataFrame([(0, 0.5), (1, 0.0)], "pid long, d2 double")).collect()}
    assert got[0]["representative_text"] == rep and got[0]["size"] == 6
    assert got[0]["sample_texts"] == [rep, rep + "\nand then stop", long, long + "y", rep + " "]
    assert got[1]["representative_text"] == long[:100] and got[1]["sample_texts"] == [long[:100], long]
    assert "text" not in seen["measured"].columns
