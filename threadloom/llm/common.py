"""Helpers the operators of this package share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A word is a run of characters other than space and tab to carriage return.
BLANK = r"[\x20\x09-\x0D]+"


def remainder(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus


def held_out(key: Column, modulus: int) -> Column:
    return remainder(key, modulus) == 0


def utf8(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each text, without decoding; null is empty."""
    for value in column.cast(pa.binary()):
        yield value.as_py() or b""


def slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Cuts consecutive items into runs of at most ``most`` in total; a larger item stands alone."""
    start, held = 0, 0
    for at, size in enumerate(sizes):
        if held and held + size > most:
            yield start, at
            start, held = at, 0
        held += int(size)
    if start < len(sizes):
        yield start, len(sizes)


def byte_lengths(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)


class Memo(dict):
    """Computes missing values for many keys at once. Emptied when it holds half of ``most`` entries; those are kept
    aside until the next time, so that its size is bounded while frequent keys are not computed again."""

    def __init__(self, compute: Callable[[list], list], most: int = 300_000):
        super().__init__()
        self.compute, self.most, self.aside = compute, most, {}

    def learn(self, keys: set) -> None:
        missing = [key for key in keys if key not in self]
        if len(self) + len(missing) > self.most // 2:
            self.aside = dict(self)
            self.clear()
            missing = list(keys)
        if self.aside:
            self.update((key, self.aside[key]) for key in missing if key in self.aside)
            missing = [key for key in missing if key not in self]
        if missing:
            self.update(zip(missing, self.compute(missing)))


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over a task's batches that hands memory back to the system when they end. Workers wait for other
    tasks after it; several of them stand beside one executor."""
    @wraps(run)
    def handed_back(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return handed_back


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
