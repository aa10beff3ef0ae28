"""Shared helpers of the text-corpus operators: Arrow batches, id hashes, byte offsets and rolling hashes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyspark.sources.scratch import drop_scratch, materialize, scratch_path

__all__ = ["BASE", "bounded_batches", "char_offsets", "crc_remainder", "drop_scratch", "encode", "materialize", "mix", "prefix_hash", "range_hash", "scratch_path", "spread_join"]

#: Keys of ``spread_join`` that are broadcast, at most.
HOT = 20_000


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of a bounded number of rows and bytes, since single texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def crc_remainder(column: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id counts as remainder 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % divisor, F.lit(0))


def spread_join(rows: DataFrame, table: DataFrame, key: str | list[str], total: int) -> DataFrame:
    """``rows`` joined to ``table``, which has one row a key and in ``__n`` the key's number of rows, ``total`` over all keys.

    Keys with more than total / HOT rows are at most HOT: they are broadcast, so that no task gathers a hot key. All others
    meet in an ordinary join. ``__n`` goes.
    """
    cut = max(100, total // HOT)
    hot, rest = table.filter(F.col("__n") > cut), table.filter(F.col("__n") <= cut)
    spread = rows.join(F.broadcast(hot), key)
    plain = rows.join(F.broadcast(hot.select(*([key] if isinstance(key, str) else key))), key, "left_anti").join(rest, key)
    return spread.unionByName(plain).drop("__n")


def encode(text: str | None) -> bytes:
    return text.encode("utf-8", "replace") if text else b""


def char_offsets(raw: bytes) -> np.ndarray:
    """Code point index of each byte offset of UTF-8 ``raw``, its end included."""
    lead = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
    return np.concatenate(([0], np.cumsum(lead)))


# Multiplier of all polynomial hashes, its inverse modulo 2**64, and the odd constants of the final mix.
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
MIX_A, MIX_B = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (wrapping arithmetic)."""
    h = h ^ (h >> np.uint64(33))
    h = h * MIX_A
    h ^= h >> np.uint64(29)
    h *= MIX_B
    return h ^ (h >> np.uint64(32))


class Powers:
    """Powers of BASE and INVERSE, grown when a longer buffer comes."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def need(self, n: int) -> None:
        if len(self.up) < n + 1:
            size = max(n + 1, 1 << 16)
            up, down = np.full(size, BASE), np.full(size, INVERSE)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


POWERS = Powers()


def prefix_hash(raw: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``range_hash`` gets the hash of any slice of ``raw``."""
    POWERS.need(len(raw))
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * POWERS.up[: len(raw)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the slices ``start:end``; equal slices have equal hashes wherever they stand."""
    h = (prefix[end] - prefix[start]) * POWERS.down[start]
    return mix(h + (end - start).astype(np.uint64) * MIX_B)
