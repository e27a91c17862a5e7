"""A13 of all terms, counted by bucket."""

import numpy as np

from refrain.operators import vectors as V


def test_terms_cross_as_lists(spark, monkeypatch):
    draw = np.random.default_rng(4)
    texts = [" ".join(f"é{w}x" for w in draw.integers(0, 300, int(n))) for n in draw.integers(0, 40, 120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc long, text string").repartition(2, "doc")
    rows = V.coded(df)
    lists = rows.mapInArrow(V._batch_statistics(3), "bucket int, terms array<string>, cf array<bigint>, df array<bigint>").collect()
    assert len(lists) <= rows.count() * 3 * 2
    where = {}
    for r in lists:
        for t in r["terms"]:
            where.setdefault(t, set()).add(r["bucket"])
    assert all(len(b) == 1 for b in where.values()) and {0, 1, 2} == set.union(*where.values())
    monkeypatch.setattr(V, "BUCKET_TERMS", 100)
    got = V.corpus_statistics(df)
    want = V.term_statistics(V.term_frequencies(df))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert V.corpus_statistics(df.limit(0)).count() == 0
