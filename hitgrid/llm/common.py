"""What the operators of this subpackage share: stable row keys, written tables, packed text helpers."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import discard, written  # noqa: F401 - the operators take both from here

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The ASCII white space of the contracts: space and \x09-\x0D.
SPACES = " \t\n\x0b\x0c\r"


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python in batches of about 8 MB where the session has left the default of 64: long texts would need several times that in a task."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":
        spark.conf.set(name, "8m")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def keyed(docs: DataFrame, id_col: str, *keep: str | Column, key_col: str | None = None) -> tuple[DataFrame, bool]:
    """(id_col, *keep, row_key) with a row_key that is unique and never null, and whether it is the id itself.

    The keys have the order of the ids: nulls first, then ascending, rows of one id in any order. The id serves
    as key when it is a unique, non-null integer. Else the rows are dealt out by ranges of the id (a frequent one
    over several), ordered, numbered and written once, so that a recomputed task can't number them anew; or keep
    the numbers of key_col, a row_key that this function gave.
    """
    small_batches(docs.sparkSession)
    plain = docs.select(F.col(id_col), *keep, *([F.col(key_col).alias("row_key")] if key_col else []))
    if dict(plain.dtypes)[id_col] in ("tinyint", "smallint", "int", "bigint"):
        n, ids = plain.agg(F.count(F.lit(1)), F.countDistinct(id_col)).first()
        if n == ids:
            return plain.withColumn("row_key", F.col(id_col).cast("long")), True
    if key_col:
        return plain, False
    order = [F.asc_nulls_first(id_col), F.asc("row_key")]
    ranged = plain.withColumn("row_key", F.rand(7)).repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    return written(ranged.withColumn("row_key", F.monotonically_increasing_id()), "keyed"), False


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only. Plain ASCII takes the fast built-in, which then does the same."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


# ---- helpers inside tasks -------------------------------------------------------------------


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets of its values; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    big = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if big else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def _lean(start: bool) -> None:
    """Keeps a reused Python worker small: large blocks go back to the system when they are freed, and the rest at the end of a task."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        if start:
            libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD, fixed from here on
        else:
            pa.default_memory_pool().release_unused()
            libc.malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose values of one column hold about `limit` bytes each, one row at least."""
    _lean(True)
    yield from _slices(batches, column, limit)
    _lean(False)


def _slices(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offs = text_bytes(batch.column(column))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offs, offs[start] + limit, side="right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def binary_array(raw: np.ndarray, offsets: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """A binary (or string) array over one byte buffer, without copies per value."""
    kind = kind or pa.binary()
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(raw))])


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every range, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_CODES = mix64(np.arange(1, 257, dtype=np.uint64))
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out) if n else out


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end) of one buffer, from prefix sums of a polynomial."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    low, n = int(starts.min()), int(ends.max())
    sums = np.zeros(n - low + 1, np.uint64)
    np.cumsum(_BYTE_CODES[raw[low:n]] * powers(_BASE, n - low), out=sums[1:])
    inverse = powers(_INVERSE, n - low + 1)
    h = (sums[ends - low] - sums[starts - low]) * inverse[starts - low]
    return mix64(h ^ ((ends - starts).astype(np.uint64) << np.uint64(40)))


def lower_bytes(raw: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, all other bytes as they are."""
    return raw + (((raw >= 65) & (raw <= 90)).astype(np.uint8) << 5)


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_spans(raw: np.ndarray, offsets: np.ndarray, outside: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, runs of bytes that are not `outside` (`[^\\x20\\x09-\\x0D]+` by default), and each text's first word (n + 1 values)."""
    inside = ~outside[raw]
    first = inside.copy()
    if len(raw):
        first[1:] &= ~inside[:-1]
        at = offsets[:-1][offsets[:-1] < len(raw)]
        first[at] = inside[at]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        at = offsets[1:][offsets[1:] > 0] - 1
        last[at] = inside[at]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    else:
        starts = ends = np.zeros(0, np.int64)
    return starts, ends, np.searchsorted(starts, offsets)
