"""Secret scans against a plain version in Python."""

import base64
import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from refrain.llm import queries, secret_scan
from refrain.llm.common import table
from tests.conftest import SF as SMALLEST

SF = SMALLEST.replace("sf0.001", "sf0.01")  # the smallest one with secrets
KINDS = ["assign", "access", "hex", "random"]


def base_of(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    for kind, pattern, least in ((1, "AKIA[A-Z0-9]+", 20), (2, "[0-9a-f]+", 24)):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return sorted(out)


def tail(z):
    return math.erfc(z / math.sqrt(2)) / 2


def battery_of(value):
    body = value.rstrip("=")
    if len(body) < 16:
        return None
    for name, pattern, alphabet in secret_scan.ENCODINGS:
        if re.fullmatch(pattern.strip("^$"), body):
            break
    else:
        return None
    v, n, k = [alphabet.index(c) for c in body], len(body), len(alphabet)
    square = sum(v.count(x) ** 2 for x in set(v))
    chi2 = k / n * square - n
    ps = [tail((chi2 - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n))]
    half = [x >= k / 2 for x in v]
    high, turns = sum(half), 1 + sum(a != b for a, b in zip(half, half[1:]))
    mu = 2 * high * (n - high) / n + 1
    var = (mu - 1) * (mu - 2) / (n - 1)
    ps.append(min(1, 2 * tail(abs(turns - mu) / math.sqrt(var))) if var > 1e-12 else 2.0 ** (1 - n))
    m = sum(v) / n
    around = sum((x - m) ** 2 for x in v)
    along = sum((a - m) * (b - m) for a, b in zip(v, v[1:]))
    ps.append(min(1, 2 * tail(abs((along / around + 1 / n) * math.sqrt(n)))) if around > 1e-9 else float(k) ** (1 - n))
    h = -sum(math.log(max(p, 1e-300)) for p in ps)
    return name, k, n, square - n, chi2, math.exp(-h) * (1 + h + h * h / 2)


def plain(texts):
    """``(base, spans)`` of every text."""
    base = [base_of(t or "") for t in texts]
    runs = []
    for i, t in enumerate(texts):
        for m in re.finditer("[A-Za-z0-9+/_=-]+", t or ""):
            if len(m[0]) >= 16 and not any(a < m.end() and b > m.start() for a, _, b in base[i]) and (x := battery_of(m[0])):
                runs.append((i, m.start(), m.end(), *x))
    rate = {}
    for name in {r[3] for r in runs}:
        some = [r for r in runs if r[3] == name and r[8] < secret_scan.ALPHA]
        rate[name] = (sum(r[6] for r in some), sum(r[5] * (r[5] - 1) for r in some))
    p0 = []
    for _, _, _, name, k, n, _, chi2, p in runs:
        equal, pairs = rate[name]
        away = (n - 1) * (max((equal * k + max(k / 15, 2.0) * 1000) / (pairs + 1000), 1.0) - 1)
        low = max(tail(-(chi2 - (k - 1 + away)) / math.sqrt(2 * (k - 1) + 4 * away)), 1e-300) if p >= secret_scan.ALPHA else 1.0
        p0.append(math.ceil(math.log10(low) * 100))
    spans = [list(b) for b in base]
    for c in range(6):
        own = [(b, r) for b, r in zip(p0, runs) if sum(r[5] >= x for x in secret_scan.LENGTH_CLASSES) == c]
        limit = max((b for b, _ in own if 10 ** (b / 100) * len(own) <= 0.05 * sum(x <= b for x, _ in own)), default=None)
        for b, r in own:
            if limit is not None and b <= limit and r[8] >= secret_scan.ALPHA:
                spans[r[0]].append((r[1], 3, r[2]))
    return [(b, sorted(s)) for b, s in zip(base, spans)]


def written(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def tuples(spans):
    return [(s["from"], s["kind"], s["to"]) for s in spans]


def test_query_equals_plain_version(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text").collect()
    want = {}
    for r, (base, spans) in zip(docs, plain([r["text"] for r in docs])):
        want[r["doc_id"]] = (*[sum(s[1] == k for s in base) for k in range(3)], hashlib.sha256(written(base).encode()).hexdigest(), written(spans))
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op13_secret_scan(spark, SF).collect()}
    assert got == want
    assert any(v[0] for v in want.values())


def prose(draw, n):
    return " ".join("".join(draw.choice("etaoinshrdlucmfwygp") for _ in range(draw.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def planted():
    """Texts with random strings of several encodings, and with long strings of ordinary words."""
    draw = random.Random(5)
    words = "configuration connection internationalization representation message handler factory service request response".split()
    texts, secrets = [], []
    for i in range(300):
        parts = [prose(draw, 40)]
        raw = bytes(draw.randrange(256) for _ in range(36))
        secret = {0: base64.b64encode(raw).decode(), 1: base64.urlsafe_b64encode(raw).decode(), 2: base64.b32encode(raw).decode(), 3: raw.hex().upper()}.get(i % 6)
        if secret:
            parts.insert(0, secret)
        parts += ["".join(w.capitalize() for w in draw.sample(words, 3)), "-".join(draw.sample(words, 3)), "_".join(draw.sample(words, 4)), "".join(draw.sample(words, 2))]
        texts.append(" ".join(parts))
        secrets.append(secret)
    return texts, secrets


def test_random_strings_are_added_and_ordinary_ones_not(spark, planted):
    texts, secrets = planted
    docs = spark.createDataFrame(list(enumerate(texts)), ["doc_id", "text"]).repartition(4)
    got = {r["doc_id"]: tuples(r["spans"]) for r in secret_scan.scan(docs).collect()}
    want = plain(texts)
    assert [got[i] for i in range(len(texts))] == [s for _, s in want]
    caught = sum((0, 3, len(s)) in got[i] for i, s in enumerate(secrets) if s)
    false = sum(x[1] == 3 and not (secrets[i] and x[0] == 0) for i in got for x in got[i])
    assert caught >= 0.9 * sum(s is not None for s in secrets)
    assert false <= 0.1 * caught


ODD = [
    None, "", " ", "x", "token=abcdef", "token=abcde", "secret: token : abcdefgh", "TOKEN = 'AbC123' api_key:\"zzzzzz\" APIKEY=q.q_q-", "passwd==a/b+c",
    "AKIA" + "A" * 16, "AKIA" + "B" * 15, "AKIAAKIA" + "C" * 15, "xAKIA" + "0" * 40, "a" * 24, "a" * 23, "g" + "0123456789abcdef" * 2 + "g", "🙂é token=abcdef 🙂 " + "f" * 30,
    "password:" + " " * 50 + "hunter22", "password\n=abcdef", "ſecret=abcdef toKen=abcdef", "secret=" + "a1" * 12 + " x", "tokentoken=abcdef", "=" * 40, "token=" * 5 + "x", "-" * 20, "1" * 30,
]


def test_odd_texts(spark):
    clash = "id place base runs value from kind enc bin class added".split()
    rows = [(i if i != 2 else None, t, *["z"] * len(clash)) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", *clash]).repartition(3)
    got = secret_scan.scan(docs.unionByName(docs))
    assert got.columns == ["doc_id", "base", "spans"]
    rows = got.collect()
    assert len(rows) == 2 * len(ODD)
    want = plain(ODD + ODD)
    for r in rows:
        at = 2 if r["doc_id"] is None else r["doc_id"]
        assert (tuples(r["base"]), tuples(r["spans"])) == (want[at][0], want[at][1]), ODD[at]
    assert secret_scan.scan(docs.filter("false")).collect() == []


def test_very_many_matches(spark):
    text = "token=abcdef " * 20_000
    got = secret_scan.scan(spark.createDataFrame([(1, text), (2, "é" + text)], ["doc_id", "text"])).orderBy("doc_id").collect()
    assert tuples(got[0]["base"]) == base_of(text)
    assert tuples(got[1]["base"]) == base_of("é" + text)


def test_cumulative(spark):
    rows = spark.createDataFrame([(i, list(range(n))) for i, n in enumerate((0, 1, 2, 127, 128, 129, 1000))], "i int, v array<long>")
    for r in rows.select("v", secret_scan.cumulative(F.col("v")).alias("c")).collect():
        assert r["c"] == [sum(r["v"][: j + 1]) for j in range(len(r["v"]))]


def test_battery_numbers(spark):
    draw = random.Random(1)
    values = ["".join(draw.choice("0123456789abcdef") for _ in range(20)), "internationalization", "a" * 20, "ab" * 30, "A7" * 9 + "==", "x" * 700 + "Q", "z" * 15 + "=====", "z" * 20 + "=z"]
    tested = {r["value"]: r for r in secret_scan.battery(spark.createDataFrame([(v,) for v in values], ["value"])).collect()}
    assert set(tested) == set(values[:-2])
    for v, r in tested.items():
        name, k, n, pairs, chi2, p = battery_of(v)
        assert (r["enc"], r["k"], r["n"], r["pairs"]) == (name, k, n, pairs)
        assert r["chi2"] == pytest.approx(chi2) and r["p"] == pytest.approx(p, rel=1e-5, abs=1e-280), v
