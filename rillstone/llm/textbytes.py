"""Whole-column kernels over the UTF-8 bytes of an Arrow text column.

Words are maximal runs of the bytes that a 256-entry table marks; A-Z count as a-z.  A word is known by a 64-bit
hash of its lower-cased bytes, so that no Python string is made for it.  Texts are taken in groups of whole texts
of about CHUNK bytes, which bounds the memory of a task whatever a batch holds; one longer text is a group alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = 1 << 20
U64 = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = _BYTE[_LOWER]
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}

#: bytes of words between ASCII white space
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, *range(9, 14)]] = False
#: bytes of words of ASCII letters and digits and of all characters beyond ASCII
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, 2 * CHUNK)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            x = np.full(size, base, U64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["up"], _powers["down"]


class Words(NamedTuple):
    """The words of some texts in order: hash, index of the text, first byte and byte after the last in ``data``."""

    hash: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def bounds(self, n_docs: int) -> np.ndarray:
        """Where the words of each text begin, and the end."""
        return np.searchsorted(self.doc, np.arange(n_docs + 1))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n, bufs = len(column), column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(bufs[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.empty(0, np.uint8)
    return data, offs


def groups(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of groups of whole texts."""
    data, offs = buffers(column)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + size, side="right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def words(data: np.ndarray, offs: np.ndarray, table: np.ndarray) -> Words:
    """Words never span two texts."""
    n = len(data)
    if n == 0:
        z = np.empty(0, np.int64)
        return Words(np.empty(0, U64), z, z, z)
    inside = table[data]
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    firsts = offs[:-1][offs[:-1] < n]
    before[firsts] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    lasts = offs[1:-1] - 1
    after[lasts[lasts >= 0]] = False
    end = np.flatnonzero(inside & ~after) + 1
    up, down = _power(n + 1)
    total = np.empty(n + 1, U64)
    total[0] = 0
    np.cumsum(_BYTE[data] * up[:n], out=total[1:])
    code = mix((total[end] - total[start]) * down[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))
    return Words(code, np.searchsorted(offs[1:], start, side="right"), start, end)


def shingles(w: Words, n_docs: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of runs of ``size`` words, text by text and sorted, and where each text's begin.

    A text of fewer words has one: its whole sequence; without words it has none."""
    bounds = w.bounds(n_docs)
    count = np.diff(bounds)
    acc = np.zeros(max(0, len(w.hash) - size + 1), U64)
    for i in range(size):
        acc = acc * U64(0xFF51AFD7ED558CCD) + w.hash[i : i + len(acc)] if len(acc) else acc
    acc = mix(acc + U64(size))
    out, sizes = [], np.zeros(n_docs, np.int64)
    for d in range(n_docs):
        lo, c = bounds[d], count[d]
        if c >= size:
            x = np.sort(acc[lo : lo + c - size + 1])
            if len(x) > 1:
                x = x[np.concatenate(([True], x[1:] != x[:-1]))]
        elif c:
            h = U64(0)
            with np.errstate(over="ignore"):
                for y in w.hash[lo : lo + c]:
                    h = h * U64(0xFF51AFD7ED558CCD) + y
                x = mix(np.array([h + U64(c)], U64))
        else:
            continue
        out.append(x)
        sizes[d] = len(x)
    return (np.concatenate(out) if out else np.empty(0, U64)), np.concatenate(([0], np.cumsum(sizes)))


def append(df: DataFrame, text: str, fields: list[tuple[str, T.DataType]], make: Callable[[pa.Array], list[pa.Array]]) -> DataFrame:
    """All columns of df as they are, and those that ``make`` gives for the text column, row by row: a map without a shuffle."""
    given = df.select("*", F.col(text).cast("string").alias("__text"))
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, t) for n, t in fields]])
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *own, column = batch.columns
            yield pa.RecordBatch.from_arrays([*own, *make(column)], names)

    return given.mapInArrow(run, schema)
