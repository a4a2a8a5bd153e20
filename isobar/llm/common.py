"""Helpers shared by the training-data operators: column expressions, text buffers and rolling hashes.

Text is handled in tasks as one byte buffer with document offsets (the layout Arrow delivers), so words,
shingles and windows are found by array operations and never by a loop over words.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Separators of alphanumeric words: every other ASCII character than digits and letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of a batch that one round of array operations handles; a longer document is a round of its own.
PIECE_BYTES = 1 << 20

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)


#: Bytes of an Arrow batch. Spark cuts batches by rows, ten thousand by default; texts make such rows heavy.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of documents or pages; from here on batches for Python are cut by bytes as well."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def split_words(text: Column) -> Column:
    """Array of the alphanumeric words; ASCII punctuation separates, other characters do not."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def alnum_words(text: Column) -> Column:
    """The words of :func:`split_words` with A-Z lower-cased."""
    return split_words(lower_ascii(text))


def input_bytes(df: DataFrame, *columns: str) -> int:
    """Bytes of the given text columns; one aggregation."""
    total = F.lit(0)
    for name in columns:
        total = total + F.coalesce(F.octet_length(F.col(name)), F.lit(0))
    return int(df.agg(F.sum(total)).first()[0] or 0)


def partitions_for(spark: SparkSession, size: float, per_partition: float) -> int:
    """Partitions that keep each below ``per_partition``, and no fewer than the session's setting."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(size / per_partition) + 1)


# --- arrays -----------------------------------------------------------------------------------------------


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def pieces(offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of documents with at most ``limit`` bytes; a longer document stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def lower_bytes() -> np.ndarray:
    lut = np.arange(256, dtype=np.uint8)
    lut[65:91] += 32
    return lut


LOWER_LUT = lower_bytes()
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
IS_ALNUM = np.zeros(256, bool)
IS_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def word_bounds(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every maximal run of bytes with ``inside``; runs end with the document."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    mask = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = mask[:-1]
    starts = np.flatnonzero(mask & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = mask[1:]
    ends = np.flatnonzero(mask & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse modulo 2^64."""
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(n, PIECE_BYTES + 1)
        for key, base in (("up", BASE), ("down", BASE_INVERSE)):
            out = np.empty(size, U64)
            out[0] = 1
            done, step = 1, base
            while done < size:  # doubling: the next block is this one times base^done
                more = min(done, size - done)
                out[done : done + more] = out[:more] * U64(step)
                done, step = done + more, step * step % (1 << 64)
            _powers[key] = out
    return _powers["up"][:n], _powers["down"][:n]


class Rolling:
    """Hash of any substring of a buffer in constant time (a polynomial over all bytes, modulo 2^64)."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, U64)
        np.cumsum((data.astype(U64) + U64(1)) * up[:-1], out=self.sums[1:])

    def raw(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.down[starts]

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        lengths = np.asarray(ends - starts).astype(U64)
        return mix(self.raw(starts, ends) + lengths * U64(0xD6E8FEB86659FD93))


def runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First positions and lengths of the runs of equal values."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))
    return first, np.diff(np.append(first, len(sorted_keys)))


def release() -> None:
    """Give freed memory back to the system; workers live on after a task, and the next stage needs the room."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def as_signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def as_unsigned(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(U64)
