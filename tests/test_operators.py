"""Operator tests on small inputs checked against brute force or hand results."""

import datetime as dt
import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from refrain.functions.text import slug, strip
from refrain.operators import inference as I
from refrain.operators import neighbours as N
from refrain.operators.messages import parse_lookback
from refrain.sources.catalogs import skill_catalog
from refrain.sources.curated import responses
from refrain.sources.results import load_latest_scan, save_scan


def _brute_dbscan(x, mult, sim, min_samples):
    """Sequential DBSCAN over points with multiplicities (labels = root index or -1)."""
    d2 = (x * x).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * x @ x.T
    adj = d2 <= 2 * (1 - sim) + 1e-9
    core = adj.astype(int) @ mult >= min_samples
    lab = np.full(len(x), -1)
    for i in range(len(x)):
        if lab[i] != -1 or not core[i]:
            continue
        lab[i] = i
        stack = [i]
        while stack:
            j = stack.pop()
            for k in np.nonzero(adj[j])[0]:
                if lab[k] == -1:
                    lab[k] = i
                    if core[k]:
                        stack.append(k)
    return lab, core


def test_dbscan_matches_sequential_scan(spark):
    rng = np.random.default_rng(7)
    for trial in range(3):
        n, d = 120, 6
        x = rng.normal(size=(n, d))
        x[:5] = 0.0  # zero vectors
        x[5:10] = x[10]  # exact copies are collapsed by the caller; here keep them distinct points
        norms = np.linalg.norm(x, axis=1)
        x = np.where(norms[:, None] > 0, x / np.where(norms > 0, norms, 1)[:, None], 0)
        mult = rng.integers(1, 3, size=n)
        sim, ms = 0.6, 4
        rows = [(i, int(mult[i]), list(range(d)) if norms[i] > 0 else [], [float(v) for v in x[i]] if norms[i] > 0 else []) for i in range(n)]
        pts = spark.createDataFrame(rows, "pid bigint, mult bigint, idx array<int>, val array<double>")
        got = {r.pid: r.cluster for r in N.dbscan(pts, sim, ms, block=32).collect()}
        lab, _ = _brute_dbscan(x, mult, sim, ms)
        want = {i: int(lab[i]) for i in range(n) if lab[i] != -1}
        assert got == want, trial


def test_strip_and_slug(spark):
    df = spark.createDataFrame([("  Hello World! 　",), ("---",)], "t string")
    got = df.select(strip("t").alias("s"), slug(F.col("t"), 50, "pattern").alias("g")).collect()
    assert got[0].s == "Hello World!" and got[0].g == "hello-world"
    assert got[1].g == "pattern"


def test_parse_lookback():
    assert parse_lookback("30d") == 30 and parse_lookback("7") == 7
    try:
        parse_lookback("week")
        assert False
    except ValueError:
        pass


def test_fenced_json_and_catalog_ids(spark):
    got = I.matched_catalog_ids(responses(spark), skill_catalog(spark)).orderBy("request_id", "rank").collect()
    by = {}
    for r in got:
        by.setdefault(r.request_id, []).append(r.id)
    assert by["m1"] == ["ship-it", "notes"]
    assert by["m2"] == ["explain-failure", "gke-ops", "ship-it", "containerise", "notes", "auth-check"]
    assert "m3" not in by


def test_scan_results_round_trip(spark):
    path = tempfile.mkdtemp(prefix="refrain-results-") + "/scans"
    assert load_latest_scan(spark, path).count() == 0
    p1 = spark.createDataFrame([("pat-001", 3)], "id string, size bigint")
    p2 = spark.createDataFrame([("pat-001", 5), ("pat-002", 4)], "id string, size bigint")
    assert save_scan(p1, path, "a", dt.datetime(2024, 1, 1))
    assert save_scan(p2, path, "b", dt.datetime(2024, 2, 1))
    assert not save_scan(p2.limit(0), path, "c", dt.datetime(2024, 3, 1))
    got = load_latest_scan(spark, path)
    assert sorted((r.id, r.size) for r in got.collect()) == [("pat-001", 5), ("pat-002", 4)]
    assert save_scan(p1, path, "20240101", dt.datetime(2024, 4, 1))
    assert [r.scan_id for r in load_latest_scan(spark, path).collect()] == ["20240101"]
    with pytest.raises(ValueError):
        save_scan(p2, path, "20240101", dt.datetime(2024, 5, 1))


def test_only_committed_scans_are_read(spark, monkeypatch):
    from refrain.sources import results

    path = tempfile.mkdtemp(prefix="refrain-results-") + "/scans"
    row = dict(id="pat-001", pattern_key="k", label="l", category=None, size=3, representative_text="t", sample_texts=["t"], dates=[], first_seen=None, last_seen=None, wasted_input_tokens=1, wasted_output_tokens=2)
    schema = results.PATTERN_SCHEMA.split("saved_at timestamp, ")[1]
    scan = lambda n: spark.createDataFrame([dict(row, size=n)], schema)
    for i in range(3):
        assert save_scan(scan(i), path, f"s{i}", dt.datetime(2024, 1, 1 + i))
    monkeypatch.setattr(results, "ENTRY_SCHEMA", "broken")  # the save breaks off after the rows, before its entry
    with pytest.raises(Exception):
        save_scan(scan(9), path, "s9", dt.datetime(2024, 5, 1))
    monkeypatch.undo()
    assert len(os.listdir(path + "/scans")) == 4 or len(os.listdir(path + "/scans")) == 3
    got = load_latest_scan(spark, path)
    assert [(r.scan_id, r.size) for r in got.collect()] == [("s2", 2)]
    assert len(got.inputFiles()) == 1
    assert save_scan(scan(9), path, "s9", dt.datetime(2024, 5, 1))
    assert [r.scan_id for r in load_latest_scan(spark, path).collect()] == ["s9"]


def test_centroid_classifier_selection(spark):
    """The centroid method labels each pattern by its representative's vector."""
    from refrain.plans.scan import find_patterns

    rows, vecs = [], []
    dirs = {"repeatable-workflow": [1.0, 0.0, 0.0], "boilerplate-request": [0.0, 1.0, 0.0]}
    i = 0
    for cat, d in dirs.items():
        for k in range(4):
            i += 1
            rows.append((f"m{i}", "s", "/p", dt.datetime(2024, 1, i), f"{cat} request number {k} with enough text", None, i))
            v = [x + 0.01 * k for x in d]
            n = sum(x * x for x in v) ** 0.5
            vecs.append((i, [0, 1, 2], [x / n for x in v]))
    msgs = spark.createDataFrame(rows, "uuid string, session_id string, project_path string, ts timestamp, text string, parent_uuid string, ord bigint")
    vectors = spark.createDataFrame(vecs, "doc bigint, idx array<int>, val array<double>")
    ex = spark.createDataFrame(
        [(0, "repeatable-workflow", [0, 1, 2], [1.0, 0.0, 0.0]), (1, "boilerplate-request", [0, 1, 2], [0.0, 1.0, 0.0])],
        "priority int, category string, idx array<int>, val array<double>",
    )
    got = {r.id: r.category for r in find_patterns(msgs, 0.9, 3, vectors=vectors, method="centroid", exemplars=ex).collect()}
    assert sorted(got.values()) == ["boilerplate-request", "repeatable-workflow"]


def test_dbscan_without_any_neighbours(spark):
    """Orthogonal points: no links at all, so every point is noise (empty block outputs)."""
    rows = [(i, 1, [i], [1.0]) for i in range(6)]
    pts = spark.createDataFrame(rows, "pid bigint, mult bigint, idx array<int>, val array<double>")
    assert N.dbscan(pts, 0.75, 2, block=2).count() == 0


def test_dbscan_struct_ids(spark):
    """Struct order keys go through a surrogate id; clusters are named by the lowest key."""
    rows = [({"c": 1, "t": i}, 1, [0, 1], [1.0, 0.0]) for i in range(3)] + [({"c": 0, "t": 9}, 1, [0, 1], [0.0, 1.0])]
    pts = spark.createDataFrame(rows, "pid struct<c:bigint,t:bigint>, mult bigint, idx array<int>, val array<double>")
    got = {(r.pid.c, r.pid.t): (r.cluster.c, r.cluster.t) for r in N.dbscan(pts, 0.9, 3, block=2).collect()}
    assert got == {(1, 0): (1, 0), (1, 1): (1, 0), (1, 2): (1, 0)}


def test_global_row_number_matches_window(spark):
    from pyspark.sql import Window

    from refrain.operators.patterns import global_row_number

    df = spark.range(0, 5000).select((F.col("id") % 37).alias("size"), F.col("id").alias("cluster")).repartition(7)
    got = {r.cluster: r.rn for r in global_row_number(df, [F.desc("size"), F.asc("cluster")]).collect()}
    w = Window.orderBy(F.desc("size"), F.asc("cluster"))
    want = {r.cluster: r.rn for r in df.select("cluster", F.row_number().over(w).alias("rn")).collect()}
    assert got == want


def test_export_scan_json_iso_dates(spark):
    import glob
    import json

    from refrain.sources.results import export_scan_json

    path = tempfile.mkdtemp(prefix="refrain-export-") + "/scan"
    p = spark.createDataFrame(
        [("pat-001", "x", None, 3, ["a"], [dt.datetime(2024, 1, 3, 4, 5, 6)], 10, 20)],
        "id string, label string, category string, size bigint, sample_texts array<string>, dates array<timestamp>, "
        "wasted_input_tokens bigint, wasted_output_tokens bigint",
    )
    export_scan_json(p, path, dt.datetime(2024, 2, 1))
    rows = [json.loads(line) for f in glob.glob(path + "/*.json") for line in open(f)]
    assert rows[0]["dates"] == ["2024-01-03T04:05:06.000000"] and rows[0]["saved_at"].startswith("2024-02-01T00:00:00")


def test_salted_top_k_on_a_hot_group(spark):
    """One group holds most rows: the two-round salted top-k equals a plain window."""
    from pyspark.sql import Window

    from refrain.functions.topk import top_k

    df = spark.range(0, 20000).select(
        F.when(F.col("id") % 10 < 8, F.lit(0)).otherwise(F.col("id") % 7).alias("g"), F.col("id").alias("ord")
    )
    got = {(r.g, r.ord) for r in top_k(df, ["g"], [F.desc("ord")], 4, ["ord"], buckets=16).collect()}
    w = Window.partitionBy("g").orderBy(F.desc("ord"))
    want = {(r.g, r.ord) for r in df.withColumn("r", F.row_number().over(w)).filter("r <= 4").collect()}
    assert got == want


def test_scan_filters_keep_exactly_the_canonical_rows(spark):
    """F5/F6 restated on raw columns (pushed into the scan) never change the result."""
    from tests.conftest import SF
    from refrain.operators import messages as M
    from refrain.sources.tables import documents_messages

    base = documents_messages(spark, SF)
    projects = ["/home/dev/src1/", "/home/dev/src1", "/home/dev/src", "/home/dev/", "/home/dev", "/home", "/", "/home/de", "/other"]
    for p in projects:
        want = sorted(r.uuid for r in M.filter_project(base, p).select("uuid").collect())
        got = sorted(r.uuid for r in M.filter_project(documents_messages(spark, SF, project=p), p).select("uuid").collect())
        assert got == want, p
    t0 = dt.datetime(2024, 1, 1)
    for since in [t0 - dt.timedelta(days=3), t0, t0 + dt.timedelta(minutes=37 * 5), t0 + dt.timedelta(minutes=37 * 5, seconds=1), t0 + dt.timedelta(days=3)]:
        want = sorted(r.uuid for r in M.filter_since(base, since).select("uuid").collect())
        got = sorted(r.uuid for r in M.filter_since(documents_messages(spark, SF, since=since), since).select("uuid").collect())
        assert got == want, since


def test_components_of_a_long_chain(spark):
    """More nodes in a row than any fixed number of rounds would reach."""
    n = 400
    edges = spark.createDataFrame([(i, i + 1) for i in range(n - 1)] + [(1000, 1000)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in [*range(n), 1000, 2000]], "pid long")
    got = {r.pid: r.root for r in N.connected_components(nodes, edges).collect()}
    assert got == {i: 0 for i in range(n)} | {1000: 1000, 2000: 2000}


def test_slug_takes_unicode_space(spark):
    rows = spark.createDataFrame([("foo\u00a0bar",), ("  a" + "b" * 60,), ("\u2003",)], "t string")
    got = [r[0] for r in rows.select(slug("t", 40, "none")).collect()]
    assert got == ["foo-bar", "a" + "b" * 39, "none"]


def test_pattern_key_changes_with_an_inner_member(spark):
    from refrain.operators.patterns import summarise

    def key(uuids):
        rows = [(0, 0, i, u, dt.datetime(2024, 1, 1), f"message number {i} of them all") for i, u in enumerate(uuids)]
        members = spark.createDataFrame(rows, "cluster long, pid long, ord long, uuid string, ts timestamp, text string")
        return summarise(members, spark.createDataFrame([(0, 0.0)], "pid long, d2 double")).first()["pattern_key"]

    assert key("abcde") == key("edcba") != key("abxde")


def test_large_keyword_tables_match_like_small_ones(spark, monkeypatch):
    from refrain.functions import contains

    texts = spark.createDataFrame([("lint and test",), ("tes",), ("",), ("a b",)], "t string")
    words = spark.createDataFrame([("lint",), ("test",), ("es",), (" ",), ("",), ("zzz",)], "k string")
    pairs = lambda: sorted(map(tuple, contains.contains_join(texts, "t", words, "k").collect()))
    small = pairs()
    monkeypatch.setattr(contains, "MAX_BROADCAST_KEYWORDS", 0)
    assert pairs() == small and ("tes", "es") in small


def test_vocabulary_of_the_summary_is_exact(spark, monkeypatch):
    from refrain.operators import vectors as V

    draw = np.random.default_rng(4)
    words = [f"w{i}" for i in range(3000)]
    weight = 1 / np.arange(1, 3001) ** 1.2
    texts = [" ".join(draw.choice(words, 40, p=weight / weight.sum())) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc long, text string").repartition(5)
    terms = df.select("doc", F.explode(V.with_ngrams(V.tokens(F.col("text")))).alias("term"))
    exact = terms.groupBy("term").count().collect()
    for tracked in (50_000, 700):
        candidates, unseen = V.frequent_candidates(terms, 50, tracked)
        known = {r["term"] for r in candidates.collect()}
        assert all(r["count"] <= unseen for r in exact if r["term"] not in known)
    want = {r["term"]: r["count"] for r in sorted(exact, key=lambda r: (-r["count"], r["term"]))[:50]}
    for tracked in (50_000, 250):  # the smaller summary settles nothing, so all terms are counted
        monkeypatch.setattr(V.frequent_candidates, "__defaults__", (tracked,))
        _, vocab = V.tfidf_vectors(df, size=50)
        assert {r["term"]: r["cf"] for r in vocab.collect()} == want
    few = terms.filter("doc < 2").select("term").distinct().count()
    assert V.tfidf_vectors(df.filter("doc < 2"), size=5000)[1].count() == few
    assert V.tfidf_vectors(df.filter("false"), size=5)[1].count() == 0
