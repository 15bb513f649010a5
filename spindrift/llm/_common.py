"""Helpers shared by the corpus operators: positional columns, slices, caches.

Texts go to Python in Arrow batches that Spark bounds by bytes (``spark.sql.execution.arrow.maxBytesPerBatch``, 64 MB unless
set), so that long texts don't add up; no operator changes a setting of the session for it.
"""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.operators.graph import components  # noqa: F401
from spindrift.session import discard, materialize, release, shared_path, stored  # noqa: F401

def pick(df: DataFrame, **names: str) -> DataFrame:
    """Select columns by exact name under new names, by position.

    Other columns never matter, even where their names differ from a wanted one only in case.
    """
    plain = df.toDF(*[f"__c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"__c{_index(df, old)}").alias(new) for new, old in names.items()])


def _index(df: DataFrame, name: str) -> int:
    if name in df.columns:
        return df.columns.index(name)
    lowered = [c.lower() for c in df.columns]
    if name.lower() in lowered:
        return lowered.index(name.lower())
    raise ValueError(f"no column {name!r} among {df.columns}")


class Positional:
    """All columns of a frame under positional names, so that clashes can't arise; ``restore`` gives them back."""

    def __init__(self, df: DataFrame):
        self.names = df.columns
        self.source = df
        self.df = df.toDF(*[f"__c{i}" for i in range(len(df.columns))])

    def name(self, column: str) -> str:
        return f"__c{_index(self.source, column)}"

    def col(self, column: str) -> Column:
        return F.col(self.name(column))

    def restore(self, df: DataFrame, extra: Iterable[str] = ()) -> DataFrame:
        """Original columns, then ``extra``; an original column of the same name gives way to an extra one."""
        extra = list(extra)
        taken = {e.lower() for e in extra}
        kept = [(i, n) for i, n in enumerate(self.names) if n.lower() not in taken]
        return df.select(*[f"__c{i}" for i, _ in kept], *extra).toDF(*[n for _, n in kept], *extra)


def slices(sizes, limit: int):
    """(start, end) runs of rows whose sizes add up to about ``limit`` at most; a larger row stands alone."""
    start, total = 0, 0
    for i, s in enumerate(sizes):
        if total and total + s > limit:
            yield start, i
            start, total = i, 0
        total += s
    if start < len(sizes):
        yield start, len(sizes)


_CACHES: dict[str, Callable[[], object]] = {}


def _nothing() -> None:
    pass


def alone(name: str, clear: Callable[[], object] = _nothing) -> None:
    """Say that an operator's cache is in use in this worker, or that one without a cache runs; those of operators that ran here
    before, and those of the same operator's former model, are emptied, and their memory goes back to the system, as workers
    outlive stages."""
    stale = [o for o, c in _CACHES.items() if o != name or c != clear]
    for other in stale:
        _CACHES.pop(other)()
    _CACHES[name] = clear
    if stale:
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
        if trim:
            trim(0)
