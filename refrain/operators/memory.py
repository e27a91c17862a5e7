"""Memory of reused Python workers."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa


def give_back() -> None:
    """Memory that has been freed goes back to the machine; otherwise it stays with the worker through all later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def released(kernel: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A generator over batches that gives memory back when its task ends."""

    @wraps(kernel)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from kernel(batches)
        finally:
            give_back()

    return run
