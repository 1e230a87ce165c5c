"""Texts of an Arrow batch as one flat byte array, for numpy work inside tasks.

Every text stands behind ``pad`` line breaks, so a word or window never runs
from one text into the next.  Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

from evigraph.session import share_package

CHUNK_BYTES = 1 << 20
BATCH_ROWS, BATCH_BYTES = 1024, 4 << 20
ROOT = np.uint64(0x9E3779B97F4A7C15)  # odd, so its powers are invertible modulo 2**64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers = np.ones(1, np.uint64)


def small_batches(spark: SparkSession) -> None:
    """Hand texts to Python workers in small batches: their memory then follows a batch, not a partition."""
    share_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", min(BATCH_ROWS, int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def _powers_to(n: int) -> np.ndarray:
    """ROOT**0 .. ROOT**n, grown by doubling and kept for the worker's life."""
    global _powers
    if len(_powers) <= n:
        size = max(n + 1, 2 * len(_powers), 1 << 16)
        steps = np.full(size, ROOT)
        steps[0] = 1
        _powers = np.cumprod(steps)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Runs of whole texts of about ``limit`` bytes; a longer text stands alone."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, first = np.cumsum(sizes), 0
    while first < len(texts):
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield first, texts.slice(first, last - first)
        first = last


def flat(texts: pa.Array, pad: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, and the n + 1 offsets of the padded texts."""
    large = pc.fill_null(texts.cast(pa.large_string()), "")
    joined = pc.binary_join_element_wise(pa.scalar("\n" * pad, pa.large_string()), large, pa.scalar("", pa.large_string()))
    _, offsets, data = joined.buffers()
    at = np.frombuffer(offsets, np.int64, len(joined) + 1, joined.offset * 8)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[at[0] : at[-1]], at - at[0]


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def range_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of every range, the same wherever they stand."""
    power = _powers_to(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[: len(buf)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * power[len(buf) - starts] * _unshift(len(buf)) + (ends - starts).astype(np.uint64))


def _unshift(n: int) -> np.uint64:
    """ROOT**-n, so that hashes do not depend on the length of the buffer."""
    return np.uint64(pow(int(ROOT), -n, 1 << 64))


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` and the first word of each text (n + 1)."""
    starts, ends = runs(~SPACE[buf])
    return starts, ends, np.searchsorted(starts, offsets)


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive hashes."""
    n = max(0, len(hashes) - size + 1)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out = out * ROOT + hashes[j : j + n]
    return mix(out)
