"""Secrets in texts: three base patterns, and a battery of randomness tests for everything else. DataFrame functions only.

*Base spans* are the leftmost non-overlapping matches of each kind: ``assign`` (a credential's name, a sign, a value), ``access`` (access key
ids) and ``hex`` (long hexadecimal strings). Their places come from the pieces between the matches: a match starts after the
lengths of all earlier pieces and matches, added up in two levels, so that a text with very many matches costs
little more than one with few.

*Added spans* (kind ``random``) are runs of LEAST_RUN or more characters of the usual encodings that look drawn at random. Each run's
encoding is inferred from its characters (decimal, hexadecimal, base 32, lower case, base 36, base 62, base 64 plain or URL-safe;
other mixtures aren't tested), its characters become the numbers 0..K-1 of that alphabet, and three tests ask whether
they are uniform and independent:

* chi-squared of the K frequencies (large values count against it);
* Wald-Wolfowitz runs of the two halves of the alphabet (either way);
* serial correlation at lag 1 (either way).

Fisher's method joins the three; a run whose joint probability is below ALPHA isn't random.

*False discoveries.* A short string of ordinary words can pass by chance. So the chi-squared value is also held against its law for
ordinary strings: for a coincidence rate ``c`` (chance that two characters of a string are equal) it has the mean
``K - 1 + (n - 1)(K c - 1)``, which moves away from the random mean ``K - 1`` with the length ``n``. The rate of each alphabet is measured on all
runs of the corpus that failed the battery (with a weak prior). The lower tail under that law is the run's p-value as
a discovery, and Benjamini-Hochberg at FDR is applied to all runs of one length class, so each length pays for its own chance
findings. The steps of the procedure are counted over a histogram of p-values of bounded size.

A run that overlaps a base span adds nothing and is left out. Only spans and numbers are shuffled, never texts.

Defined cases: null and empty texts have no spans; ids may be null or repeated (every row is its own document); spans are code
points, end exclusive; texts may have any length; an empty table gives an empty table. The result has the id and the
operator's own columns only, so other input columns cannot clash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refrain.llm.common import text_or_empty
from refrain.session import staged

ALPHA = 0.01  # of the joint test
FDR = 0.05
LEAST_RUN = 16
LENGTH_CLASSES = (24, 32, 48, 64, 128)  # lower ends, after the first
LANGUAGE_RATE, LEAST_RATE = 1 / 15, 2.0  # prior coincidence rate of ordinary strings: that of written language, and twice 1/K at least
PRIOR_PAIRS = 1000.0  # weight of the prior
CHUNK = 128
BINS = 100  # of a power of ten of the p-value
LEAST_P = 1e-300

KINDS = ["assign", "access", "hex", "random"]


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# The patterns of the base spans. Runs of a class are taken whole, so a least length may be part of the pattern
# where a shorter match could not have begun a longer one.
NAMES = "|".join([*map(_either_case, ("password", "passwd", "secret", "token")), _either_case("api") + "_?" + _either_case("key")])
ASSIGN = rf"""({NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 6
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
RUN = f"[A-Za-z0-9+/_=-]{{{LEAST_RUN},}}"

DIGITS, LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
UPPER = LOWER.upper()
#: Encoding: what its strings match (the first that fits), and its alphabet in order.
ENCODINGS = [
    ("decimal", "^[0-9]+$", DIGITS),
    ("hex", "^[0-9a-f]+$", DIGITS + "abcdef"),
    ("HEX", "^[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("base32", "^[A-Z2-7]+$", UPPER + "234567"),
    ("lower", "^[a-z]+$", LOWER),
    ("base36", "^[0-9a-z]+$", DIGITS + LOWER),
    ("base62", "^[0-9A-Za-z]+$", DIGITS + UPPER + LOWER),
    ("base64", "^[0-9A-Za-z+/]+$", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", "^[0-9A-Za-z_-]+$", UPPER + LOWER + DIGITS + "-_"),
]
# Chebyshev coefficients of the complementary error function (relative error below 1.2e-7), lowest power first.
ERFC = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, also where the body uses it in another lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def cumulative(values: Column) -> Column:
    """Running sums of an array of longs, over chunks of CHUNK and then over the chunks."""
    none = F.array().cast("array<long>")
    last = lambda xs: F.get(xs, F.size(xs) - 1)
    running = lambda xs: F.aggregate(xs, none, lambda acc, v: F.concat(acc, F.array(F.coalesce(last(acc), F.lit(0)) + v)))

    def chunked(xs: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / CHUNK).cast("int")), lambda i: F.slice(xs, i * CHUNK + 1, CHUNK))
        return F.transform(chunks, running)

    def joined(inner: Column) -> Column:
        return let(running(F.transform(inner, last)), lambda upto: F.flatten(F.transform(inner, lambda c, i: let(F.coalesce(F.get(upto, i - 1), F.lit(0)), lambda b: F.transform(c, lambda v: v + b)))))

    return F.when(F.size(values) > 0, let(values, lambda xs: let(chunked(xs), joined))).otherwise(none)


def with_matches(rows: DataFrame, pattern: str, name: str) -> DataFrame:
    """Add ``name array<struct<from: long, to: long, value: string>>``: all matches of ``pattern`` in ``text``."""
    rows = rows.withColumn("_found", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    pieces = F.when(F.size("_found") > 0, F.split("text", pattern, -1)).otherwise(F.array().cast("array<string>"))
    # piece and match together, so that a running sum gives the ends of the matches
    rows = rows.withColumn("_ends", F.zip_with("_found", F.slice(pieces, F.lit(1), F.size("_found")), lambda m, p: (F.length(p) + F.length(m)).cast("long")))
    rows = rows.withColumn("_ends", cumulative(F.col("_ends")))
    spans = F.zip_with("_found", "_ends", lambda m, end: F.struct((end - F.length(m)).alias("from"), end.alias("to"), m.alias("value")))
    return rows.withColumn(name, spans).drop("_found", "_ends")


def base_spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``place, id, base, runs``: base spans with their kind's number, and the runs to be tested; ``place`` tells rows apart."""
    rows = docs.select(F.monotonically_increasing_id().alias("place"), F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    for name, pattern in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("runs", RUN)):
        rows = with_matches(rows, pattern, name)
    rows = rows.withColumn("assign", F.filter("assign", lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= ASSIGN_VALUE))
    plain = lambda kind: F.transform(KINDS[kind], lambda s: F.struct(s["from"].alias("from"), F.lit(kind).alias("kind"), s["to"].alias("to")))
    return rows.select("place", "id", F.array_sort(F.concat(*map(plain, range(3)))).alias("base"), "runs")


def upper_tail(z: Column) -> Column:
    """P(Z >= z) of a standard normal."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + x / 2)
    erfc = t * F.exp(-x * x + reduce(lambda acc, c: acc * t + F.lit(c), reversed(ERFC[:-1]), F.lit(ERFC[-1])))
    return F.when(z >= 0, erfc / 2).otherwise(1 - erfc / 2)


def two_sided(z: Column) -> Column:
    return F.least(F.lit(1.0), 2 * upper_tail(F.abs(z)))


def _log(p: Column) -> Column:
    return F.log(F.greatest(p, F.lit(LEAST_P)))


def battery(runs: DataFrame) -> DataFrame:
    """Add the alphabet ``enc``, its size ``k``, the length ``n``, equal ``pairs``, ``chi2`` and the joint probability ``p`` to rows with ``value``.

    Rows of no known encoding, or of fewer than LEAST_RUN characters before the padding, are left out.
    """
    rows = runs.withColumn("body", F.regexp_replace("value", "=+$", ""))
    enc = reduce(lambda rest, e: F.when(F.col("body").rlike(e[1]), F.lit(e[0])).otherwise(rest), reversed(ENCODINGS), F.lit(None))
    rows = rows.withColumn("enc", enc).filter(F.col("enc").isNotNull() & (F.length("body") >= LEAST_RUN))
    alphabet = reduce(lambda rest, e: F.when(F.col("enc") == e[0], F.lit(e[2])).otherwise(rest), ENCODINGS, F.lit(""))
    rows = rows.withColumns({"alphabet": alphabet, "k": F.length(alphabet).cast("double")})
    rows = rows.withColumn("v", F.transform(F.regexp_extract_all("body", F.lit("."), F.lit(0)), lambda c: F.instr(F.col("alphabet"), c) - 1))
    square = F.aggregate(F.array_distinct("v"), F.lit(0.0), lambda acc, d: acc + F.pow(F.size(F.filter("v", lambda x: x == d)), F.lit(2)))
    start = F.struct(F.lit(-1).alias("last"), *[F.lit(0.0).alias(c) for c in ("turns", "high", "sum", "squares", "products")])

    def step(acc: Column, v: Column) -> Column:
        half = lambda x: (x * 2 >= F.col("k")).cast("int")
        follows = acc["last"] >= 0
        turned = F.when(follows & (half(acc["last"]) == half(v)), 0.0).otherwise(1.0)
        return F.struct(
            v.alias("last"), (acc["turns"] + turned).alias("turns"), (acc["high"] + half(v)).alias("high"), (acc["sum"] + v).alias("sum"),
            (acc["squares"] + v * v).alias("squares"), (acc["products"] + F.when(follows, acc["last"] * v).otherwise(0)).alias("products"),
        )

    rows = rows.withColumns({"n": F.size("v").cast("double"), "square": square, "f": F.aggregate("v", start, step), "first": F.get("v", F.lit(0))})
    n, k, f = F.col("n"), F.col("k"), F.col("f")
    chi2 = k / n * F.col("square") - n
    p1 = upper_tail((chi2 - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n))
    expected = 2 * f["high"] * (n - f["high"]) / n + 1
    spread = (expected - 1) * (expected - 2) / (n - 1)
    p2 = F.when(spread > 1e-12, two_sided((f["turns"] - expected) / F.sqrt(F.greatest(spread, F.lit(1e-12))))).otherwise(F.pow(F.lit(2.0), 1 - n))
    mean = f["sum"] / n
    around = f["squares"] - n * mean * mean
    along = f["products"] - mean * (2 * f["sum"] - F.col("first") - f["last"]) + (n - 1) * mean * mean
    p3 = F.when(around > 1e-9, two_sided((along / F.greatest(around, F.lit(1e-9)) + 1 / n) * F.sqrt(n))).otherwise(F.pow(k, 1 - n))
    half = -(_log(p1) + _log(p2) + _log(p3))  # half of Fisher's statistic, which has 6 degrees of freedom
    joint = F.exp(-half) * (1 + half + half * half / 2)
    return rows.withColumns({"chi2": chi2, "p": joint, "pairs": F.col("square") - n}).drop("body", "alphabet", "v", "square", "f", "first")


def discoveries(tested: DataFrame, *, alpha: float = ALPHA, fdr: float = FDR) -> DataFrame:
    """The rows of ``battery`` that are random and hold against ordinary strings of their length."""
    tested = tested.withColumn("class", reduce(lambda c, least: c + (F.col("n") >= least).cast("int"), LENGTH_CLASSES, F.lit(0)))
    failed = F.when(F.col("p") < alpha, 1).otherwise(0)
    rates = tested.groupBy("enc").agg(F.sum(failed * F.col("pairs")).alias("equal"), F.sum(failed * F.col("n") * (F.col("n") - 1)).alias("all"))
    tested = tested.join(F.broadcast(rates), "enc")  # one row per encoding
    n, k = F.col("n"), F.col("k")
    prior = F.greatest(k * LANGUAGE_RATE, F.lit(LEAST_RATE))
    rate = F.greatest((F.col("equal") * k + prior * PRIOR_PAIRS) / (F.col("all") + PRIOR_PAIRS), F.lit(1.0))  # times k
    away = (n - 1) * (rate - 1)
    lower = upper_tail(-(F.col("chi2") - (k - 1 + away)) / F.sqrt(2 * (k - 1) + 4 * away))
    tested = tested.withColumn("p0", F.when(F.col("p") >= alpha, F.greatest(lower, F.lit(LEAST_P))).otherwise(1.0))
    # p-values are rounded up to a bin, so the procedure is at most stricter
    tested = tested.withColumn("bin", F.ceil(F.log10("p0") * BINS).cast("int"))
    bins = tested.groupBy("class", "bin").agg(F.count(F.lit(1)).alias("c"))  # at most classes x 300 x BINS rows
    up_to = F.sum("c").over(Window.partitionBy("class").orderBy("bin"))
    every = F.sum("c").over(Window.partitionBy("class"))
    passed = bins.withColumns({"up_to": up_to, "every": every}).filter(F.pow(F.lit(10.0), F.col("bin") / BINS) * F.col("every") <= fdr * F.col("up_to"))
    limits = passed.groupBy("class").agg(F.max("bin").alias("limit"))
    return tested.filter(F.col("p") >= alpha).join(F.broadcast(limits), "class").filter("bin <= limit")  # one row per class


def apart_from_base(runs: DataFrame, base: DataFrame) -> DataFrame:
    """The runs (``place, from, to, ...``) that overlap no base span (``place, from, to``) of their document."""
    own = [c for c in runs.columns]
    both = runs.withColumn("is_base", F.lit(False)).unionByName(base.withColumn("is_base", F.lit(True)), allowMissingColumns=True)
    ahead = Window.partitionBy("place").orderBy("from", "to").rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy("place").orderBy(F.desc("from"), F.desc("to")).rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("ended", F.max(F.when(F.col("is_base"), F.col("to"))).over(ahead))
    both = both.withColumn("begins", F.min(F.when(F.col("is_base"), F.col("from"))).over(behind))
    free = (F.coalesce("ended", F.lit(0)) <= F.col("from")) & (F.col("begins").isNull() | (F.col("begins") >= F.col("to")))
    return both.filter(~F.col("is_base") & free).select(*own)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA, fdr: float = FDR) -> DataFrame:
    """``id, base, spans`` of every row: arrays of ``from, kind, to`` in order, ``kind`` a place in KINDS; ``spans`` holds all kinds."""
    found = staged(base_spans(docs, id_col, text_col), "spans")
    runs = found.select("place", F.explode("runs").alias("r")).select("place", "r.from", "r.to", "r.value")
    base = found.filter(F.size("runs") > 0).select("place", F.explode("base").alias("b")).select("place", "b.from", "b.to")
    tested = staged(battery(apart_from_base(runs, base)).drop("value"), "tested")
    added = discoveries(tested, alpha=alpha, fdr=fdr)
    span = F.struct(F.col("from").cast("long").alias("from"), F.lit(KINDS.index("random")).alias("kind"), F.col("to").cast("long").alias("to"))
    added = added.groupBy("place").agg(F.collect_list(span).alias("added"))  # the spans of one text, as in the result
    out = found.select("place", "id", "base").join(added, "place", "left")
    spans = F.array_sort(F.concat("base", F.coalesce("added", F.slice("base", F.lit(1), F.lit(0)))))
    return out.select(F.col("id").alias(id_col), "base", spans.alias("spans"))


def written(spans: str) -> Column:
    """``kind:from:to``, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["from"].cast("string"), s["to"].cast("string"))), ",")
