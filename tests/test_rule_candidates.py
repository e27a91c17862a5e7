"""Rules as a table: which rules are tried on a text at all (F1), and that none which matches is left out."""

import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from refrain.operators import rules_index as RI


def index_of(regexes):
    wide = [RI.wider(r) for r in regexes]
    return RI.Index(pa.table({
        "_rule": list(range(len(regexes))), "_regex": regexes, "clauses": pa.array([RI.clauses(r) for r in regexes], pa.list_(pa.list_(pa.string()))),
        "wider": pa.array([w and w[0] for w in wide], pa.string()), "width": pa.array([w and w[1] for w in wide], pa.int32()), "free": [False] * len(regexes),
    }))


def test_clauses():
    assert RI.clauses(r"(?i)word\s+next") == [["word  ", "word next"]]
    assert RI.clauses("word[,.]? (x{0}|the )next") == [sorted(f"word{p} {t}next" for p in ("", ",", ".") for t in ("", "the "))]
    assert RI.clauses("[ (](that|thing) [a-z]{5,6} ?no") == [[" that ", " thing ", "(that ", "(thing "]]
    assert RI.clauses(r"abcd.*efgh") in ([["abcd"], ["efgh"]], [["efgh"], ["abcd"]])
    for none in (r"\d+", "ab", r"\p{L}abc", "[abc&&[b]]def", r"abc\vdef", "(?x:abc d)", "(abc|d)"):
        assert RI.clauses(none) == [] and (none not in ("[abc&&[b]]def", r"abc\vdef", "(?x:abc d)") or RI.wider(none) is None)


def test_words_that_stand_apart_are_no_candidates():
    regexes = [rf"(?i){a}\s+{b}" for a in ("alpha", "beta", "gamma") for b in ("delta", "omega")] + ["[ (](alpha|beta) [a-z]{5,6} ?om"]
    texts = ["alpha beta gamma, delta omega", "Alpha\n\tDELTA", "é (beta number omega", "é (beta x omega", ""]
    text, rule = index_of(regexes).candidates(texts)
    assert list(zip(text, rule)) == [(1, 0), (2, 6)]


def test_every_match_is_a_candidate():
    draw = random.Random(3)
    words = ["".join(draw.choice("abcé") for _ in range(draw.randint(1, 9))) for _ in range(40)]
    forms = [r"{a}\s+{b}", "(?i){a}|{b}", "{a}[a-c]+{b}", r"\b{a}\s*{b}", "({a}|{b}x){{2}}", "(?i:{a}).*{b}", "{a}?", r"({a}\s+)+{b}", "{a} {{2,}}{b}", r"[^\s]{a}.{{0,5}}{b}", "{a}(?={b})", "^{a}[ ,]{b}", r"({a}){{2,3}}\W{b}"]
    regexes = [draw.choice(forms).format(a=draw.choice(words), b=draw.choice(words)) for _ in range(1500)]
    texts = ["".join(draw.choice(words) + draw.choice(["", " ", "  ", "\n", "\t ", ", ", "  ", "\x0b"]) for _ in range(30)) for _ in range(60)]
    texts = [t.upper() if i % 5 == 0 else t for i, t in enumerate(texts)]
    found = set(zip(*(x.tolist() for x in index_of(regexes).candidates(texts))))
    hits = {(i, j) for j, r in enumerate(regexes) for i, t in enumerate(texts) if re.search(r, t, re.IGNORECASE)}
    missed = {(i, j) for i, j in hits - found if r"\s" not in regexes[j]}  # Python's \s is more than Java's
    assert len(hits) > 1000 and not missed and len(found) < len(regexes) * len(texts) / 2


def test_repeated_and_null_keys(spark):
    rules = spark.createDataFrame([("two", r"alpha\s+beta"), ("any", "b{1}")], "name string, regex string")
    messages = spark.createDataFrame([("u", "alpha beta"), ("u", "alpha  beta"), (None, "b"), (None, "b"), ("v", None)], "uuid string, text string")
    got = RI.rule_hits(messages, rules, rule="name").groupBy("name", "uuid").agg(F.count(F.lit(1))).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([("two", "u", 1), ("any", "u", 2), ("any", None, 2)], key=repr)
