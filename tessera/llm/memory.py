"""Gives back memory that a Python worker has freed.

Workers are used again by the next task, stage and query. What the C library and Arrow keep for themselves after large
temporary arrays would count against the executor for as long as its workers live.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa


def settle() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # absent from other C libraries
    if trim:
        trim(0)


def settled(f: Callable) -> Callable:
    """The same function of groups, giving back memory when it has returned. The number of parameters stays: Spark looks at it."""

    def done(out: pa.Table) -> pa.Table:
        settle()
        return out

    if f.__code__.co_argcount == 1:
        return lambda group: done(f(group))
    if f.__code__.co_argcount == 2:
        return lambda a, b: done(f(a, b))
    return lambda a, b, c: done(f(a, b, c))
