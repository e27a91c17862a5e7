"""Substring joins: which texts contain which keywords.

Three ways, by the checked size of the keyword table:

* up to MAX_BROADCAST_KEYWORDS keywords: a broadcast join on ``contains``, inside the JVM;
* up to AUTOMATON_CHARS characters of distinct keywords: an Aho-Corasick automaton of all of them is sent to the tasks and
  reads every text once, whatever the number of keywords;
* beyond that: the sorted keywords are cut into ranges of that size (so a first symbol that a third of the keywords
  share is cut too), each range has its own automaton, and every text is read once per range.

The automaton adds the distinct keywords of a text to its row. Texts are never shuffled or repeated per candidate: rows
multiply only into real hits, which then meet the rows of their keyword by an equi-join.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from refrain.session import staged

MAX_BROADCAST_KEYWORDS = 256  # met by a nested loop; larger tables go through an automaton
AUTOMATON_CHARS = 8_000_000  # about 250 MB as an automaton
STEP = 256  # texts read at a time


def contains_join(texts: DataFrame, text: str, keywords: DataFrame, keyword: str, *, nested: int | None = None, automaton_chars: int = AUTOMATON_CHARS) -> DataFrame:
    """Rows of both sides wherever ``text`` contains ``keyword``.

    Null texts and null keywords match nothing; the empty keyword is in every text; every row of a repeated keyword matches;
    a keyword meets a text once, however often it occurs there.
    """
    size = keywords.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.length(keyword)), F.lit(0)).alias("chars")).first()
    if size["rows"] <= (MAX_BROADCAST_KEYWORDS if nested is None else nested):
        return texts.join(F.broadcast(keywords), F.col(text).contains(F.col(keyword)))
    words = keywords.filter(F.col(keyword).isNotNull()).select(F.col(keyword).alias("word")).distinct()
    if size["chars"] <= automaton_chars:
        parts = [words]
    else:
        ranged = staged(in_ranges(words, automaton_chars), "keywords")
        parts = [ranged.filter(F.col("part") == p).select("word") for (p,) in sorted(ranged.select("part").distinct().collect())]  # few ranges
    found = [_scanned(texts, text, part) for part in parts]
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    return hits.join(keywords, F.col("_hit") == F.col(keyword)).drop("_hit")


def in_ranges(words: DataFrame, chars: int) -> DataFrame:
    """``part, word``: consecutive sorted words of about ``chars`` characters to a part.

    The words are sorted in parallel; only the sizes of the sorted pieces are added up in one task.
    """
    pieces = words.repartitionByRange("word").select("word", F.spark_partition_id().alias("_piece"))
    pieces = staged(pieces, "pieces")
    within = Window.partitionBy("_piece").orderBy("word")
    sizes = pieces.groupBy("_piece").agg(F.sum(F.length("word")).alias("_n"))  # one row per piece
    before = sizes.select("_piece", (F.sum("_n").over(Window.orderBy("_piece")) - F.col("_n")).alias("_before"))
    upto = F.sum(F.length("word")).over(within) + F.col("_before")
    placed = pieces.join(F.broadcast(before), "_piece").select("word", F.floor((upto - 1) / chars).cast("int").alias("part"))
    return placed.select(F.greatest("part", F.lit(0)).alias("part"), "word")


def _scanned(texts: DataFrame, text: str, words: DataFrame) -> DataFrame:
    """Every text row once per distinct word that it contains, as ``_hit``."""
    sent = texts.sparkSession.sparkContext.broadcast(sorted(r["word"] for r in words.collect()))  # at most automaton_chars

    @F.arrow_udf("array<string>")
    def hits(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        find = finder(sent.value)
        for batch in batches:
            out: list[list[str] | None] = []
            for at in range(0, len(batch), STEP):
                out += [None if t is None else find(t) for t in batch.slice(at, STEP).to_pylist()]
            yield pa.array(out, pa.list_(pa.string()))

    return texts.withColumn("_hits", hits(F.col(text).cast("string"))).withColumn("_hit", F.explode("_hits")).drop("_hits")


def finder(words: list[str]):
    """Function from a text to the distinct ones of ``words`` that it contains."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for word in words:
        if word:
            automaton.add_word(word, word)
    always = {""} if "" in words[:1] else set()  # sorted: the empty one comes first
    if not len(automaton):
        return lambda text: list(always)
    automaton.make_automaton()
    return lambda text: list(always.union(word for _, word in automaton.iter(text)))
