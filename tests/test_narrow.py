"""Texts are neither shuffled nor written again, and vectors are written as counts."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from refrain.functions import text as X
from refrain.operators import cells as metric
from refrain.operators import neighbours as N
from refrain.operators import vectors as V
from refrain.plans import scan

TEXTS = ["Ab c_d 12 é Éa", "", None, "x", "ab", "cd ef", "ÀÉÎ×õœ ŸŸ a", "_ __ ª² ²", "\n", "İi ıı ŉx ſs", "ΑΣ Σα", "日本 語", "Ǆa ab", "a" * 40 + " oḱ ok", "ab"]


def test_tokens_made_in_tasks_equal_the_regex(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc long, text string").repartition(2)
    got = {}
    for row in V.coded(df).toArrow().to_batches():
        for docs, doc, terms, codes in V._decoded([row]):
            for i, d in enumerate(docs.to_pylist()):
                got[d] = [terms[int(c)].as_py() for c in codes[doc == i]]
    want = {r["doc"]: r["toks"] or [] for r in df.select("doc", V.tokens(F.col("text")).alias("toks")).collect()}
    assert got == want and sum(map(len, want.values())) > 15
    lens, toks = V.plain_tokens(pa.array(["zz yy", *TEXTS[:9]]).slice(1))  # a slice begins inside the buffers
    assert lens.tolist() == [len(want[i]) for i in range(9)] and toks.to_pylist() == sum((want[i] for i in range(9)), [])


def test_noise_prefix_is_found_at_the_start_only(spark):
    rows = [("   Conversation SO far: x" + "y" * 99,), ("x [request interrupted",), ("[Request Interrupted" + " z" * 50,), ("K" * 30,), (" " * 90 + "<task-notification and more text here",), ("This session is being continued",)]
    df = spark.createDataFrame(rows, "t string")
    whole = F.regexp_like(F.lower(X.strip("t")), F.lit(X.NOISE_REGEX))
    got = df.select(X.is_substantial(F.col("t")).alias("a"), ((F.length(X.strip("t")) >= X.MIN_SUBSTANTIAL_LEN) & ~whole).alias("b")).collect()
    assert [r["a"] for r in got] == [r["b"] for r in got] == [False, False, False, True, False, False]


def test_an_even_scan_is_not_shuffled(spark, tmp_path):
    one, many = f"{tmp_path}/one", f"{tmp_path}/many"
    df = spark.range(400).select(F.col("id").alias("doc"), F.lit("text").alias("text"))
    df.coalesce(1).write.parquet(one)
    df.repartition(3 * spark.sparkContext.defaultParallelism).write.option("maxRecordsPerFile", 10).parquet(many)
    plan = lambda p: V.spread_if_uneven(spark.read.parquet(p), spark.read.parquet(p))._jdf.queryExecution().toString()
    assert "Exchange" in plan(one)
    if spark.read.parquet(many).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism:
        assert "Exchange" not in plan(many)


def test_patterns_write_texts_once_and_vectors_as_counts(spark, monkeypatch):
    seen = {}
    for module in (scan, N, V, scan.P):
        monkeypatch.setattr(module, "staged", lambda df, label, stage=module.staged: seen.setdefault(label, stage(df, label)))
    texts = [f"please run the {w} tests again and report back" for w in ("unit", "unit", "unit", "slow", "slow", "slow", "slow")] + ["nothing like any other message in here"]
    rows = [(f"u{i}", t, i) for i, t in enumerate(texts)]
    corpus = spark.createDataFrame(rows, "uuid string, text string, ord long").withColumn("ts", F.timestamp_seconds("ord"))
    found = scan.find_patterns(corpus, 0.75, 3, classify=False).collect()
    assert sum(r["size"] for r in found) == 7
    assert [t for t, df in seen.items() if "text" in df.columns] == ["corpus"]
    assert [t for t, df in seen.items() if "val" in df.columns] == []


def test_samples_join_alike_by_broadcast_and_by_shuffle(spark, monkeypatch):
    texts = [f"please run the unit tests again and report back{' !' * (i % 3)}" for i in range(9)]
    corpus = spark.createDataFrame([(f"u{i}", t, i) for i, t in enumerate(texts)], "uuid string, text string, ord long").withColumn("ts", F.timestamp_seconds("ord"))
    one = scan.find_patterns(corpus, 0.75, 3, classify=False).collect()
    monkeypatch.setattr(scan.P, "PICKED", 0)
    assert scan.find_patterns(corpus, 0.75, 3, classify=False).collect() == one
    assert [len(r["sample_texts"]) for r in one] == [5]


def test_points_of_cells_move_once_for_counts_and_clusters(spark):
    draw = np.random.default_rng(5)
    x = draw.normal(size=(300, 6)) + 4 * draw.integers(0, 2, (300, 6))
    x /= np.linalg.norm(x, axis=1)[:, None]
    points = spark.createDataFrame([(i, 1, list(range(6)), v.tolist()) for i, v in enumerate(x)], "pid long, mult long, idx array<int>, val array<double>").cache()
    rows, sizes = metric.partition(points, 0.95, 300, 64, force=True)
    hits = metric.cell_hits(rows, sizes, 0.95, 64).cache()
    weights = lambda df: sorted(map(tuple, df.collect()))
    assert weights(metric.cell_weights(rows, sizes, 0.95, 64, hits)) == weights(metric.cell_weights(rows, sizes, 0.95, 64)) == weights(N.neighbour_weights(points, 0.95, 3))
    got = N.dbscan(points, 0.95, 3, 64, cells=True, parted=(rows, sizes, hits))
    assert weights(got) == weights(N.dbscan(points, 0.95, 3, 64, cells=False)) and got.count()
