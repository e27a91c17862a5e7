"""Scalar text expressions (X1-X10), all built-in Spark functions.

Each helper has a DuckDB twin in ``refrain.plans.oracle`` so the oracle and the
engine apply the same rule.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters Python's ``str.strip()`` removes: every code point that
# ``str.isspace()`` accepts (derived by rule, not listed by hand).
WHITESPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())

# The bytes that they end in, as hex digits.
WHITESPACE_ENDS = sorted({f"{w.encode()[-1]:02X}" for w in WHITESPACE})

# The same characters inside a regex class, for Java and RE2.
WHITESPACE_CLASS = "".join(f"\\x{{{ord(c):x}}}" for c in WHITESPACE)

# Fixed values that must equal the reference: system-injected message openings
# treated as noise (compared against the lower-cased, stripped text).
NOISE_PREFIXES = (
    "base directory for this skill",
    "[request interrupted",
    "<local-command",
    "<task-notification",
    "this session is being continued",
    "conversation so far:",
)

MIN_SUBSTANTIAL_LEN = 25  # fixed value: shorter messages are acknowledgements
MIN_REPRESENTATIVE_LEN = 12  # fixed value: shorter texts are never representative


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Remove Unicode whitespace at both ends (Python ``str.strip``)."""
    return F.btrim(_col(c), F.lit(WHITESPACE))


def strip_long(c) -> Column:
    """X1 for long texts in plain columns (it names ``c`` several times).

    A trim of the right end goes through the whole text, so it is left out where the last byte ends no whitespace.
    """
    last = F.hex(F.substring(_col(c).cast("binary"), -1, 1))
    return F.when(last.isin(WHITESPACE_ENDS), strip(c)).otherwise(_lstrip(c))


def _lstrip(c) -> Column:
    """The left side of X1, which does not read the whole text; enough for prefixes, as none ends in whitespace."""
    return F.ltrim(_col(c), F.lit(WHITESPACE))


def first_line(c, n: int) -> Column:
    """Text up to the first newline, cut to ``n`` characters, stripped."""
    return strip(F.substring(F.substring_index(_col(c), "\n", 1), 1, n))


def _noise_regex() -> str:
    alts = "|".join(re.sub(r"([\[\]().*+?^$|{}\\])", r"\\\1", p) for p in NOISE_PREFIXES)
    return f"^(?:{alts})"


NOISE_REGEX = _noise_regex()


def has_noise_prefix(c) -> Column:
    """Lower-cased text starts with one of the noise prefixes.

    One anchored regex: a single small expression (cheap to compile) instead of
    one ``startswith`` per prefix. Only the part that can hold a prefix is lower-cased and searched.
    """
    return F.regexp_like(F.lower(F.substring(_col(c), 1, max(map(len, NOISE_PREFIXES)))), F.lit(NOISE_REGEX))


def is_substantial(text) -> Column:
    """stripped length >= 25 and no noise prefix."""
    return (F.length(strip_long(text)) >= MIN_SUBSTANTIAL_LEN) & ~has_noise_prefix(_lstrip(text))


def is_representative_quality(text) -> Column:
    """stripped length >= 12 and no noise prefix."""
    return (F.length(strip_long(text)) >= MIN_REPRESENTATIVE_LEN) & ~has_noise_prefix(_lstrip(text))


def slug(c, max_len: int, default: str) -> Column:
    """Lower, strip, keep [a-z0-9 whitespace -], whitespace runs (any Unicode one) -> '-', squeeze, cut, trim '-'."""
    s = strip(F.lower(_col(c)))
    s = F.regexp_replace(s, f"[^a-z0-9{WHITESPACE_CLASS}-]", "")
    s = F.regexp_replace(s, f"[{WHITESPACE_CLASS}]+", "-")
    s = F.regexp_replace(s, r"-+", "-")
    s = F.substring(s, 1, max_len)
    s = F.btrim(s, F.lit("-"))
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(default))


def cut_with_ellipsis(c, n: int) -> Column:
    """text cut at ``n`` characters with a trailing ellipsis when longer."""
    c = _col(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def plus_more(arr, shown: int) -> Column:
    """First ``shown`` names joined by ', ' and '+N more' when longer."""
    arr = _col(arr)
    head = F.array_join(F.slice(arr, 1, shown), ", ")
    return F.when(
        F.size(arr) > shown,
        F.concat(head, F.lit(" +"), (F.size(arr) - shown).cast("string"), F.lit(" more")),
    ).otherwise(head)
