"""Small helpers shared by the operators."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlatlas.session import discard, materialize, scratch

__all__ = ["discard", "materialize", "scratch", "with_row", "sha256_hex", "text_or_empty", "portions", "tidy", "Bounded"]

# Documents that one yielded Arrow batch holds at most; bounds the memory of a task.
CHUNK = 512
# Bytes of text that a task works on at once, unless one text is longer.
PORTION = 1 << 20


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def with_row(df: DataFrame, name: str = "_row") -> DataFrame:
    """Number rows uniquely. Write the result before it is read twice, as numbers follow the splits."""
    return df.withColumn(name, F.monotonically_increasing_id())


def portions(texts: pa.Array, most: int = PORTION) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of rows whose texts have at most ``most`` bytes together, or of one longer text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield at, to
        at = to


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for ``mapInArrow`` that gives freed memory back to the system when its task ends.

    Python workers live on for the tasks of later stages, next to which they would still hold it.
    """

    @wraps(run)
    def each(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return each


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


class Bounded(dict):
    """A memo that computes missing entries and starts anew when full, so its memory is bounded."""

    def __init__(self, compute, most: int = 200_000):
        super().__init__()
        self.compute, self.most = compute, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        self[key] = value = self.compute(key)
        return value
