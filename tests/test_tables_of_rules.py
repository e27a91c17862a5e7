"""Rules, keywords and models that come as data: the indexed paths against plain ones."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from refrain.functions import contains
from refrain.operators import embed, rules_index
from refrain.operators.rules import RULES


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# ---------------------------------------------------------------- keywords
def texts_of(spark, draw, n=60, alphabet="abcdé 🙂"):
    texts = ["".join(draw.choice(alphabet) for _ in range(draw.randint(0, 60))) for _ in range(n)]
    return spark.createDataFrame(list(enumerate([*texts, None, "", texts[3]])), "i long, t string").repartition(3)


@pytest.mark.parametrize("chars", [10**6, 300])
def test_automaton_equals_the_nested_join(spark, chars):
    draw = random.Random(4)
    texts = texts_of(spark, draw)
    words = ["".join(draw.choice("abcdé 🙂") for _ in range(draw.randint(1, 4))) for _ in range(400)] + ["", None, "aa", "aa", "never there", "a" * 30]
    words += ["b" + "".join(draw.choice("abcd") for _ in range(3)) for _ in range(200)]  # a third share their first symbol
    keywords = spark.createDataFrame(list(enumerate(words)), "k long, word string")
    got = contains.contains_join(texts, "t", keywords, "word", nested=0, automaton_chars=chars)
    assert got.columns == ["i", "t", "k", "word"]
    want = contains.contains_join(texts, "t", keywords, "word", nested=10**6)
    assert rows(got) == rows(want)
    if chars == 300:
        sizes = contains.in_ranges(keywords.filter("word is not null").select("word").distinct(), chars).groupBy("part").agg(F.sum(F.length("word"))).collect()
        assert len(sizes) > 3 and max(n for _, n in sizes) <= chars + 30


def test_a_quarter_of_a_million_keywords(spark):
    keywords = spark.range(250_000).select(F.concat(F.lit("w"), F.conv(F.col("id").cast("string"), 10, 36)).alias("word"))
    texts = spark.createDataFrame([(1, "W5XS w5xs wa"), (2, "zzz"), (3, "w1w2w3 w4")], "i long, t string").withColumn("t", F.upper("t"))
    upper = keywords.select(F.upper("word").alias("word"))
    got = contains.contains_join(texts, "t", upper, "word")
    assert rows(got) == rows(contains.contains_join(texts, "t", upper, "word", nested=10**6))
    assert contains.contains_join(texts.filter("false"), "t", upper, "word").count() == 0
    assert contains.contains_join(texts, "t", upper.filter("false"), "word", nested=-1).count() == 0


# ---------------------------------------------------------------- rules
@pytest.mark.parametrize("regex, strings", [
    ("(?i)use pytest|don('t| not) use unittest", [" use unittest", "use pytest"]),
    (r"python 3\.\d+", ["python 3."]),
    (r"(abc|def)+x?ghij\b", ["ghij"]),
    (r"ab?c", None), (r"\d+", None), (r"(abc|de)", None), (r"(abcd)*efg", ["efg"]), (r"(abcd){0,2}", None), (r"(?:foo|bar)baz", ["baz"]), (r"(?:fooo|barr)baz", ["barr", "fooo"]),
    (r"\p{L}abc", None), (r"[abc]def", ["def"]), ("Straße weg", ["e weg"]), (r"^abc$", ["abc"]), ("(?i)ABC", ["abc"]), ("(?x) a b c d", None), ("", None),
])
def test_required_strings(regex, strings):
    assert rules_index.required(regex) == strings


def test_every_match_holds_a_required_string():
    draw = random.Random(8)
    texts = ["".join(draw.choice(["use ", "pytest", "jest ", "not", "same way ", "as before", "python 3.1", "node v1", "we are using", "jwt", "auth"]) for _ in range(6)) for _ in range(400)]
    for _, _, _, regex in RULES:
        strings = rules_index.required(regex)
        for text in texts:
            if re.search(regex, text):
                assert any(s in rules_index.fold(text) for s in strings), (regex, text)


@pytest.mark.parametrize("max_index", [10**6, 0])
def test_rules_as_a_table_equal_the_nested_loop(spark, max_index):
    draw = random.Random(2)
    words = ["".join(draw.choice("abcde") for _ in range(draw.randint(2, 6))) for _ in range(150)]
    forms = ["{a} {b}", "(?i){a}|{b}", "{a}[a-c]+{b}", r"\b{a}\s", "({a}|{b}x){{2}}", "(?i:{a}).*{b}", "{a}?"]
    made = [(i, draw.choice(forms).format(a=draw.choice(words), b=draw.choice(words))) for i in range(1000)]
    made += [(1000, "(?i)sik task"), (1001, None), (1002, r"\p{Lu}\p{Lu}"), (1003, "a+")]
    rules = spark.createDataFrame(made, "pos int, regex string")
    texts = [" ".join(draw.choice(words) for _ in range(30)) for _ in range(120)] + [None, "", "x", "ſIK TAſk", "sık task", "SİK TASK", "ÉÉ"]
    messages = spark.createDataFrame([(f"u{i}", t, "z") for i, t in enumerate(texts)], "uuid string, text string, gram string").repartition(3)
    got = rules_index.rule_hits(messages, rules, max_index=max_index)
    want = messages.join(F.broadcast(rules), F.regexp_like("text", F.concat(F.lit("(?u)"), "regex"))).select("pos", "uuid")
    assert rows(got) == rows(want)
    assert {r["uuid"] for r in got.filter("pos = 1000").collect()} == {"u123", "u124", "u125"}
    assert rules_index.rule_hits(messages.filter("false"), rules).count() == 0
    assert rules_index.rule_hits(messages, rules.filter("false")).count() == 0


def test_indexed_rules_need_no_nested_loop(spark):
    rules = spark.createDataFrame([(i, f"rule number {i} [a-z]") for i in range(500)], "pos int, regex string")
    plan = rules_index.rule_hits(spark.createDataFrame([("u", "rule number 7 x")], "uuid string, text string"), rules)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


# ---------------------------------------------------------------- models
def test_vectors_of_a_model(spark):
    most = embed.BATCH

    def load():  # sent to the tasks by value
        import numpy as np

        def model(texts):
            assert 0 < len(texts) <= most
            return np.array([[len(t), t.count("a"), 1.0] for t in texts])

        return model

    texts = [None, "", "a", "banana", "x" * 1000] * 40
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "ord long, text string, val int").repartition(2)
    got = {r["doc"]: (r["idx"], r["val"]) for r in embed.embed(df, "ord", "text", load, 3).collect()}
    assert set(got) == set(range(len(texts)))
    for i, t in enumerate(texts):
        v = np.array([len(t or ""), (t or "").count("a"), 1.0])
        assert got[i][0] == [0, 1, 2] and np.allclose(got[i][1], v / np.linalg.norm(v))
    assert embed.embed(df.filter("false"), "ord", "text", load, 3).collect() == []


def test_what_a_model_returns_is_checked():
    assert embed.checked([[3, 4], [0, 0]], 2, 2).tolist() == [[0.6, 0.8], [0.0, 0.0]]
    assert np.allclose(embed.checked([[3e300, 4e300], [3e-300, 4e-300]], 2, 2), [[0.6, 0.8]] * 2)
    for bad in ([[1.0]], [[1.0, 2.0]] * 3, [[1.0, float("nan")], [0, 1]], [[float("inf"), 1.0], [0, 1]]):
        with pytest.raises(ValueError):
            embed.checked(bad, 2, 2)


def test_a_failing_model_fails_the_job(spark):
    df = spark.createDataFrame([(1, "x")], "ord long, text string")
    with pytest.raises(Exception, match="shape"):
        embed.embed(df, "ord", "text", lambda: lambda texts: np.zeros((1, 5)), 3).collect()
