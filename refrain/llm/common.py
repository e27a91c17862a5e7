"""Shared helpers of the corpus operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def id_fold(column: str, folds: int) -> Column:
    """CRC-32 of the id written as text, modulo ``folds``; null ids get fold -1."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(folds)), F.lit(-1)).cast("int")


def partitions(spark: SparkSession, at_least: int = 1) -> int:
    """Number of shuffle partitions of the session."""
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def slices(column: pa.Array, rows: int = 512) -> Iterator[list]:
    """The values of a batch, a few rows at a time."""
    for at in range(0, len(column), rows):
        yield column.slice(at, rows).to_pylist()


def released(kernel):
    """Decorate a generator over batches so that a finished task gives its memory back to the machine.

    Workers are reused: without this, what one task has freed stays with its process through all later stages.
    """

    @wraps(kernel)
    def run(batches):
        try:
            yield from kernel(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
            if trim:
                trim(0)

    return run


class WordTable(dict):
    """Memo of a task: word (bytes) -> code, with one NumPy column per value that ``make`` derives from a word.

    ``trim`` is called between texts and empties the memo when it holds more than ``limit`` words. Make one in the
    generator of a task, so that it goes when the task ends; a worker lives longer.
    """

    def __init__(self, make: Callable[[bytes], tuple], dtypes: list, limit: int = 150_000):
        super().__init__()
        self.make, self.limit = make, limit
        self.columns = [np.zeros(1024, kind) for kind in dtypes]

    def __missing__(self, word: bytes) -> int:
        code = len(self)
        if code == len(self.columns[0]):
            self.columns = [np.concatenate([c, np.zeros_like(c)]) for c in self.columns]
        for column, value in zip(self.columns, self.make(word)):
            column[code] = value
        self[word] = code
        return code

    def codes(self, raw: bytes) -> np.ndarray:
        """Codes of the white-space words of a text."""
        words = raw.split()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def trim(self) -> None:
        if len(self) > self.limit:
            self.clear()
