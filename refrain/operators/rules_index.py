"""J1/P2 with the rules as a table: any number of regex rules, found through the strings that they require.

A match of a regex usually needs certain literal strings; ``clauses`` reads them off its syntax tree: every match holds a string of
each clause (``don('t| not) use [a-z]+ing now`` has the clauses ``don't use `` or ``don not use ``, and ``ing now``). One pass over the
bytes of many texts finds which strings occur where; rules with a string of every clause are tried with a wider regex
(``wider``: what Python can tell of it, all else taken for granted), and what is left is decided by the rule's own regex, in the JVM.
Rules without a clause go to these two at once.

Only ASCII characters of a regex count for its strings; texts and strings are folded as ``(?iu)`` compares them. Texts aren't shuffled, and
no row is made for a rule that is no candidate. An index of over MAX_INDEX strings is not sent to the tasks: ``required`` gives one
clause per rule, whose strings are listed under one of their trigrams and joined with those of the texts, ``contains`` confirms
them, and the rule's own regex decides.
"""

from __future__ import annotations

import math
import re
import warnings
from collections.abc import Iterator
from re import _constants as sre
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refrain.session import staged

GRAM = 3
MAX_INDEX = 500_000  # strings whose index is sent to the tasks; beyond, it is joined by trigram
MOST = 32  # strings that a part of a regex can stand for, to be listed
WAYS = 256  # ways through a wider regex from one place, to be tried
FAR = 1000  # characters of a match that is looked for around a string
WIDTHS = (3, 4, 6, 8)  # bytes of a string by which it is looked up
BITS = 20  # of the table of such bytes
AT_ONCE = 1 << 20  # characters of text that are searched at once
SPACES = "\t\n\v\f\r "  # fixed value: what ``\\s`` is in Java
COMPILED = 50_000  # wider regexes that a worker keeps

# The letters outside ASCII that ``(?iu)`` holds for i, s and k, and what they count as.
FOLDED_FROM, FOLDED_TO = "\u0130\u0131\u017f\u212a", "iisk"


def folded(text: Column) -> Column:
    return F.lower(F.translate(text, FOLDED_FROM, FOLDED_TO))


def fold(text: str) -> str:
    return text.translate(str.maketrans(FOLDED_FROM, FOLDED_TO)).lower()


def required(regex: str) -> list[str] | None:
    """Folded strings of GRAM characters or more, one of which is in every match (folded); None if there are none to be had."""
    try:
        tree = _parser.parse(regex)
    except Exception:  # syntax that only Java knows: the rule is tried on every text
        return None
    if tree.state.flags & sre.SRE_FLAG_VERBOSE:
        return None
    return _alternatives(tree)


def _alternatives(tree) -> list[str] | None:
    """The best requirement among the parts of a sequence: the one whose shortest string is longest."""
    options, run = [], ""

    def end_run() -> None:
        nonlocal run
        if len(run) >= GRAM:
            options.append([run])
        run = ""

    for kind, value in tree:
        if kind is sre.LITERAL and value < 128:
            run += fold(chr(value))
            continue
        if kind is sre.AT:  # takes no characters, so what is around it still stands together
            continue
        end_run()
        found = None
        if kind is sre.SUBPATTERN:
            found = _alternatives(value[3])
        elif kind is sre.BRANCH:
            each = [_alternatives(branch) for branch in value[1]]
            found = None if any(e is None for e in each) else sorted({s for e in each for s in e})
        elif kind in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and value[0] > 0:
            found = _alternatives(value[2])
        elif kind is sre.ATOMIC_GROUP:
            found = _alternatives(value)
        if found:
            options.append(found)
    end_run()
    return max(options, key=lambda o: (min(map(len, o)), -len(o)), default=None)


def _safe(regex: str):
    """The syntax tree, or None where Python may read the regex otherwise than Java."""
    if "\\v" in regex:  # a class in Java
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")  # nested classes, which only Java knows
            tree = _parser.parse(regex)
    except Exception:
        return None
    return None if tree.state.flags & sre.SRE_FLAG_VERBOSE or _verbose(tree) else tree


def _blank(text: str) -> str:
    return " " if text in SPACES else text


def _verbose(tree) -> bool:
    return any(kind is sre.SUBPATTERN and value[1] & sre.SRE_FLAG_VERBOSE or any(map(_verbose, _inner(kind, value))) for kind, value in tree)


def _inner(kind, value) -> list:
    if kind is sre.SUBPATTERN:
        return [value[3]]
    if kind is sre.BRANCH:
        return value[1]
    if kind in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
        return [value[2]]
    return [value] if kind is sre.ATOMIC_GROUP else []


def _class(items) -> set[str] | None:
    """The folded ASCII characters of a class, or None if it has others."""
    chars = set()
    for kind, value in items:
        if kind is sre.LITERAL and value < 128:
            chars.add(fold(chr(value)))
        elif kind is sre.RANGE and value[1] < 128:
            chars |= {fold(chr(c)) for c in range(value[0], value[1] + 1)}
        elif kind is sre.CATEGORY and value is sre.CATEGORY_SPACE:
            chars |= set(SPACES)
        else:
            return None
    return chars


def clauses(regex: str) -> list[list[str]]:
    """Folded strings of GRAM characters or more, all SPACES as blanks: of each list, one is in every match (so written)."""
    tree = _safe(regex)
    if tree is None:
        return []
    exact, found = _parts(tree)
    found = found + ([exact] if exact is not None else [])
    return [sorted(c) for c in {frozenset(c) for c in found if min(map(len, c), default=0) >= GRAM}]


def _parts(tree) -> tuple[set[str] | None, list[set[str]]]:
    """All strings that a sequence can match, if they are few, and otherwise its clauses (of any length)."""
    whole, run, begun, found = True, {""}, set(), []  # begun: strings with which a match may go on in other ways
    for kind, value in tree:
        if kind is sre.AT:  # takes no characters, so what is around it still stands together
            continue
        exact, inner = _part(kind, value)
        if exact is not None and len(begun) + len(run) * len(exact) <= MOST:
            run = {a + b for a in run for b in exact}
            continue
        again = _repeats(kind, value)
        if again and len(begun) + len(run) * (1 + len(again) + len(again) ** 2) <= MOST:
            once = {a + b for a in run for b in again}
            begun |= {a + b for a in once for b in again}
            run, whole = (run if value[0] == 0 else set()) | once, False
            continue
        found += [run | begun, *([exact] if exact is not None else inner)]
        whole, run, begun = False, {""}, set()
    return (run, []) if whole else (None, [*found, run | begun])


def _repeats(kind, value) -> set[str] | None:
    """The strings that are repeated from none or once on, if they are few."""
    if kind not in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) or value[0] > 1 or value[1] < 2:
        return None
    return _parts(value[2])[0]


def _part(kind, value) -> tuple[set[str] | None, list[set[str]]]:
    if kind is sre.LITERAL:
        return ({_blank(fold(chr(value)))}, []) if value < 128 else (None, [])
    if kind is sre.IN:
        chars = {_blank(c) for c in _class(value) or ()}
        return (chars, []) if chars and len(chars) <= 4 else (None, [])
    if kind is sre.SUBPATTERN:
        return _parts(value[3])
    if kind is sre.ATOMIC_GROUP:
        return _parts(value)
    if kind is sre.BRANCH:
        each = [_parts(branch) for branch in value[1]]
        if all(exact is not None for exact, _ in each):
            union = {s for exact, _ in each for s in exact}
            return (union, []) if len(union) <= MOST else (None, [union])
        best = [max(([exact] if exact is not None else inner), key=lambda c: (min(map(len, c)), -len(c)), default={""}) for exact, inner in each]
        return None, [set().union(*best)]
    if kind in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
        least, most, inner = value
        if most == 0:
            return {""}, []
        exact, found = _parts(inner)
        if exact is not None and most == 1:
            return exact | ({""} if least == 0 else set()), []
        if least == 0:
            return None, []
        return None, [exact] if exact is not None else found
    return None, []


def wider(regex: str) -> tuple[str, int] | None:
    """A regex for Python that is found in a folded text wherever Java finds ``regex`` in the text, and the most characters that it takes
    (-1: any number); None if there is none that is cheap to try."""
    tree = _safe(regex)
    got = None if tree is None else _wider(tree)
    return None if got is None or got[1] > WAYS else (got[0], -1 if got[2] > FAR else int(got[2]))


def _wider(tree) -> tuple[str, float, float] | None:
    """The regex, in how many ways it can go on from one place (roughly), and the most characters that it takes."""
    out, ways, width = [], 1.0, 0.0
    for kind, value in tree:
        if kind in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
            continue
        if kind is sre.LITERAL and value < 128:
            got = re.escape(fold(chr(value))), 1.0, 1.0
        elif kind in (sre.LITERAL, sre.NOT_LITERAL, sre.ANY, sre.IN):
            got = _one(kind, value), 1.0, 1.0
        elif kind is sre.SUBPATTERN:
            got = _wider(value[3])
        elif kind is sre.ATOMIC_GROUP:
            got = _wider(value)
        elif kind is sre.BRANCH:
            each = [_wider(branch) for branch in value[1]]
            got = None if None in each else ("|".join(p for p, _, _ in each), sum(n for _, n, _ in each), max(w for _, _, w in each))
        elif kind in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            got = _repeated(*value)
        else:
            got = None
        if got is None:
            return None
        out.append(f"(?:{got[0]})" if kind not in (sre.LITERAL, sre.IN) else got[0])
        ways, width = ways * got[1], width + got[2]
    return "".join(out), ways, width


def _one(kind, value) -> str:
    """One character of a class that holds the given one, for folded texts."""
    chars = _class(value) if kind is sre.IN else None
    return "[" + "".join(map(re.escape, sorted(chars))) + "]" if chars else "."


def _repeated(least: int, most: int, inner) -> tuple[str, float, float] | None:
    if most == 0:
        return "", 1.0, 0.0
    got = _wider(inner)
    if got is None:
        return None
    few = most if most is not sre.MAXREPEAT and most <= WAYS else None
    if few is None and (len(inner) != 1 or inner[0] != (sre.IN, [(sre.CATEGORY, sre.CATEGORY_SPACE)]) and inner[0][0] is not sre.LITERAL):
        return None  # a long stretch that many characters can fill
    times = few - least + 1 if few is not None else 4
    return f"(?:{got[0]}){{{least},{'' if few is None else few}}}", times * got[1] ** min(few or 1, 16), got[2] * (few or math.inf)


BLANKS = bytes(32 if chr(i) in SPACES else i for i in range(256))


class Index:
    """The strings of the rules' clauses, looked up by their first bytes; tells which rules may match a text."""

    def __init__(self, rules: pa.Table):
        """``rules``: ``_rule, _regex, clauses, wider, width, free``."""
        self.found = rules.select(["_rule", "_regex", "free"]).combine_chunks()
        self.wider, self.width = rules.column("wider").to_pylist(), rules.column("width").to_pylist()
        each = rules.column("clauses").to_pylist()
        self.needs = np.array([len(c) for c in each], np.int64)
        strings = sorted({s for c in each for one in c for s in one})
        place = {s: i for i, s in enumerate(strings)}
        pairs = [(place[s], n) for n, one in enumerate(c for rule in each for c in rule) for s in one]
        pairs = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        self.clause, self.clause_at = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(strings) + 1))
        self.rule = np.repeat(np.arange(len(each)), self.needs)
        self.first = np.diff(self.rule, prepend=-1) > 0  # the clause around whose strings a rule is looked for
        self.length = np.array([len(s) for s in strings], np.int64)
        self.tables = []
        widths = np.array([max(w for w in WIDTHS if w <= len(s)) for s in strings], np.int64)
        for width in WIDTHS:
            some = np.nonzero(widths == width)[0]
            if not len(some):
                continue
            heads = np.array([int.from_bytes(strings[i][:width].encode(), "little") for i in some], np.uint64)
            tails = np.array([int.from_bytes(strings[i][-width:].encode(), "little") for i in some], np.uint64)
            skip = np.array([len(strings[i]) - width for i in some], np.int64)
            order = np.argsort(heads, kind="stable")
            keys, at = np.unique(heads[order], return_index=True)
            bits = np.zeros(1 << BITS, bool)
            bits[self._mixed(keys)] = True
            self.tables.append((width, bits, keys, np.append(at, len(some)), some[order], tails[order], skip[order]))

    @staticmethod
    def _mixed(keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.int64)

    def holding(self, low: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(text, string, character)``: where which strings occur, and some that only begin and end as one that occurs."""
        each = [t.encode() for t in low]
        starts = np.cumsum([0, *(len(b) + 1 for b in each)])
        raw = np.frombuffer(b"\xff".join([*each, bytes(16)]).translate(BLANKS), np.uint8)  # 255 is no byte of a text
        n, made, text, string, place = len(raw) - 8, {}, [], [], []
        key, have = np.zeros(n, np.uint64), 0
        for width, *_ in self.tables:
            for at in range(have, width):
                key = key | raw[at : at + n].astype(np.uint64) << np.uint64(8 * at)
            have, made[width] = width, key
        for width, bits, keys, ends, which, tails, skip in self.tables:
            at = np.nonzero(bits[self._mixed(made[width])])[0]
            found = np.minimum(np.searchsorted(keys, made[width][at]), len(keys) - 1)
            same = keys[found] == made[width][at]
            at, found = at[same], found[same]
            several = ends[found + 1] - ends[found]
            item = _spans(ends[found], several)
            at = np.repeat(at, several)
            last = np.minimum(at + skip[item], n - 1)
            item, at = (x[made[width][last] == tails[item]] for x in (item, at))
            text.append(np.searchsorted(starts, at, "right") - 1)
            string.append(which[item])
            place.append(at)
        text, string, place = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (text, string, place))
        chars = np.cumsum((raw & 0xC0) != 0x80)  # up to each byte
        return text, string, chars[place] - chars[starts[text]]

    def candidates(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``(text, rule)`` in order of the texts: where a rule may match."""
        low = [fold_text(t) for t in texts]
        text, string, place = self.holding(low)
        several = self.clause_at[string + 1] - self.clause_at[string]
        clause = self.clause[_spans(self.clause_at[string], several)]
        text, place, end = (np.repeat(x, several) for x in (text, place, place + self.length[string]))
        n, n_rules = max(1, len(self.rule)), max(1, len(self.needs))
        met = np.unique(text * n + clause)
        pair, count = np.unique(met // n * n_rules + self.rule[met % n] if len(met) else met, return_counts=True)
        pair = pair[count == self.needs[pair % n_rules]] if len(pair) else pair
        around = np.nonzero(self.first[clause])[0] if len(clause) else clause
        where = text[around] * n_rules + self.rule[clause[around]] if len(clause) else clause
        order = np.argsort(where, kind="stable")
        place, end = place[around][order].tolist(), end[around][order].tolist()
        span = [np.searchsorted(where[order], pair, side).tolist() for side in ("left", "right")]
        kept = [self._may(low[p // n_rules], p % n_rules, place[a:b], end[a:b]) for p, a, b in zip(pair.tolist(), *span)]
        pair = pair[np.array(kept, bool)]
        free = np.nonzero(self.needs == 0)[0].tolist()  # rules without a clause
        more = [t * n_rules + r for t in range(len(low)) for r in free if self.wider[r] is None or _searched(self.wider[r])(low[t])]
        pair = np.sort(np.concatenate([pair, np.array(more, np.int64)]))
        return pair // n_rules, pair % n_rules

    def _may(self, low: str, rule: int, place: list[int], end: list[int]) -> bool:
        """Whether the wider regex is found in the text, where strings of the rule's first clause stand."""
        if self.wider[rule] is None:
            return True
        search, width = _searched(self.wider[rule]), self.width[rule]
        if width < 0 or len(place) * (2 * width + 16) > len(low):
            return search(low) is not None
        return any(search(low, max(0, b - width), a + width) for a, b in zip(place, end))


def _spans(first: np.ndarray, several: np.ndarray) -> np.ndarray:
    """The numbers from ``first`` on, ``several`` of each."""
    return np.repeat(first - (np.cumsum(several) - several), several) + np.arange(several.sum())


_SEARCHES: dict = {}


def _searched(regex: str):
    found = _SEARCHES.get(regex)
    if found is None:
        if len(_SEARCHES) >= COMPILED:
            _SEARCHES.clear()
        found = _SEARCHES[regex] = _compiled(regex)
    return found


def _compiled(regex: str):
    return re.compile(regex, re.DOTALL).search


def fold_text(text: str) -> str:
    """``fold``, faster for long texts."""
    if not text.isascii():
        for a, b in zip(FOLDED_FROM, FOLDED_TO):
            text = text.replace(a, b)
    return text.lower()


def _tried(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            ends, a = np.cumsum([len(t) for t in texts]), 0
            while a < len(texts):
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + AT_ONCE, "right")))
                text, rule = index.candidates(texts[a:b])
                some, first = np.unique(text, return_index=True)
                found = index.found.take(pa.array(rule))
                items = pa.StructArray.from_arrays([pa.chunked_array(c).combine_chunks() for c in found.columns], found.column_names)
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(text)).astype(np.int32)), items)
                kept = batch.slice(a, b - a).take(pa.array(some))
                yield pa.RecordBatch.from_arrays([kept.column("_key"), kept.column("_text"), lists], ["_key", "_text", "_found"])
                a = b

    return run


def _read_rules(rules: DataFrame, flags: str) -> DataFrame:
    """The rules with their ``clauses``, the ``wider`` regex with its ``width``, and whether ``required`` has nothing for them (``free``); a written table."""
    plain = set(flags) <= set("(?iu)")  # others change what classes mean

    def told(regex: str) -> dict:
        need, wide = required(regex), wider(regex) if plain else None
        listed = clauses(regex) if plain else [need] if need else []
        return {"clauses": listed, "wider": wide and wide[0], "width": wide and wide[1], "free": need is None}

    @F.arrow_udf("struct<clauses:array<array<string>>,wider:string,width:int,free:boolean>")
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([("clauses", pa.list_(pa.list_(pa.string()))), ("wider", pa.string()), ("width", pa.int32()), ("free", pa.bool_())])
        for batch in batches:
            yield pa.array([told(r) for r in batch.to_pylist()], kind)

    rows = rules.filter("_regex is not null").withColumn("_read", read("_regex"))
    return staged(rows.select("_rule", "_regex", "_read.*"), "rules")


def index_rules(rules: DataFrame, regex: str = "regex") -> DataFrame:
    """The rules with ``literal`` and ``gram``, a row per alternative; both are null for a rule that must always be tried.

    An alternative is listed under its trigram with the fewest listings, so that common ones pick few candidates.
    """

    @F.arrow_udf("array<string>")
    def strings(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if r is None else required(r) for r in batch.to_pylist()], pa.list_(pa.string()))

    rows = rules.filter(F.col(regex).isNotNull()).withColumn("literal", F.explode_outer(strings(F.col(regex))))
    rows = staged(rows, "literals")
    grams = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("literal") - (GRAM - 1)), lambda i: F.substring("literal", i, F.lit(GRAM)))))
    listed = rows.filter("literal is not null").select("literal").distinct().withColumn("gram", grams)
    uses = listed.groupBy("gram").agg(F.count(F.lit(1)).alias("uses"))
    rarest = listed.join(uses, "gram").groupBy("literal").agg(F.min(F.struct("uses", "gram"))["gram"].alias("gram"))
    return staged(rows.join(rarest, "literal", "left").select(*rules.columns, "literal", "gram"), "rule-index")


def rule_hits(texts: DataFrame, rules: DataFrame, *, key: str = "uuid", text: str = "text", rule: str = "pos", regex: str = "regex", flags: str = "(?u)", max_index: int = MAX_INDEX) -> DataFrame:
    """``rule, key`` for every (rule, text) whose regex finds a match in the text; ``rules`` has one row per rule.

    Null texts and null regexes match nothing. Texts with the same key count as one, but for rules of which ``required`` says nothing.
    """
    rules = rules.select(F.col(rule).alias("_rule"), F.col(regex).alias("_regex"))
    rows = texts.filter(F.col(text).isNotNull()).select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    known = _read_rules(rules, flags)
    size = known.agg(F.sum(F.size(F.flatten("clauses")) + 1).alias("n")).first()["n"] or 0
    if size <= max_index:
        index = Index(known.toArrow())
        kind = f"struct<_rule:{known.schema['_rule'].dataType.simpleString()},_regex:string,free:boolean>"
        tried = rows.mapInArrow(_tried(index), f"_key {rows.schema['_key'].dataType.simpleString()}, _text string, _found array<{kind}>")
        decided = F.filter("_found", lambda r: F.regexp_like(F.col("_text"), F.concat(F.lit(flags), r["_regex"])))
        found = tried.select("_key", F.explode(decided).alias("r")).select("r._rule", "_key", F.when(F.col("r.free"), F.monotonically_increasing_id()).alias("_row"))
        return found.distinct().select(F.col("_rule").alias(rule), F.col("_key").alias(key))
    listed = index_rules(rules, "_regex")
    decides = F.regexp_like("_text", F.concat(F.lit(flags), F.col("_regex")))
    by_gram = listed.filter("gram is not null")
    low = rows.withColumn("_low", folded(F.col("_text")))
    starts = F.sequence(F.lit(1), F.greatest(F.length("_low") - (GRAM - 1), F.lit(1)))
    grams = F.array_distinct(F.transform(starts, lambda i: F.substring("_low", i, F.lit(GRAM))))
    # places go through the shuffle, texts meet their candidates by place
    low = staged(low.withColumn("_place", F.monotonically_increasing_id()), "texts")
    near = low.select("_place", F.explode(grams).alias("gram")).join(by_gram, "gram").drop("gram").distinct()
    met = low.join(near, "_place")
    hits = met.filter(F.col("_low").contains(F.col("literal"))).filter(decides).select("_rule", "_key").distinct()
    always = listed.filter("gram is null").select("_rule", "_regex")
    tried = rows.join(F.broadcast(always), decides).select("_rule", "_key") if not always.isEmpty() else None
    found = hits.unionByName(tried) if tried is not None else hits
    return found.select(F.col("_rule").alias(rule), F.col("_key").alias(key))
