"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


ROWS_AT_ONCE = 1000  # rows of an Arrow batch at most: texts are long, and a batch lies in the JVM and in Python
BYTES_AT_ONCE = 8 << 20  # bytes from which a batch ends


def few_rows(spark: SparkSession) -> None:
    """Lowers the rows and bytes of an Arrow batch for the session, if they are more.

    Plans read these settings when they run, so they stay as they are set here; only queries and pipeline stages call
    this, operators leave a session's settings alone.
    """
    for setting, most in (("maxRecordsPerBatch", ROWS_AT_ONCE), ("maxBytesPerBatch", BYTES_AT_ONCE)):
        setting = f"spark.sql.execution.arrow.{setting}"
        now = spark.conf.get(setting).lower().removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(setting, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    few_rows(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder of spark.checkpoint.dir. Only a local session may lack that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="graphlane-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/graphlane-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows of df, written as Parquet to the shared folder and read again: survives lost executors, cuts lineage."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of jobs that have ended."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the Python worker, which waits for other tasks, gives the memory that it no longer uses back."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return tidied


def id_type(df: DataFrame, name: str = "doc_id") -> str:
    return df.schema[name].dataType.simpleString()


def held_out(column: str, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text has this remainder; a null id never is held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def size_of(df: DataFrame) -> int:
    """Bytes that Catalyst expects df to have: decides only the layout, never a result."""
    n = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if n >= 1 << 50:
        n = df.select(F.sum(F.octet_length("text"))).first()[0] or 0
    return n


def parts(df: DataFrame, each: int = 6 << 20, least: int = 0) -> int:
    """How many blocks of about `each` stored bytes df makes."""
    floor = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "8")))
    return max(least or floor, -(-size_of(df) // each))


def block_of(blocks: int) -> Column:
    """A block for each row. The text takes part, so that rows without an id don't all meet in one block."""
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def member(h: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(h), bool)
    at = np.searchsorted(keys, h)
    at[at == len(keys)] = 0
    return keys[at] == h


class Powers:
    """Powers of an odd multiplier modulo 2**64 and their inverses, for prefix sums as rolling hashes.

    Sequences exist that collide for every odd multiplier, so these hashes only choose candidates.
    """

    BASE = 0x9E3779B97F4A7C15

    def __init__(self) -> None:
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n += n >> 2
            self.up, self.down = (self._powers(b, n) for b in (self.BASE, pow(self.BASE, -1, 1 << 64)))
        return self.up, self.down

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)


POWERS = Powers()
BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)

PRIME = (1 << 31) - 1
BASES = (0x2F3A91C5, 0x5B8D06E7)  # two multipliers modulo PRIME
LONG_SPAN = 1 << 24  # bytes from which a span is hashed by itself


def folded_prime(x: np.ndarray) -> np.ndarray:
    """64-bit numbers modulo PRIME."""
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(31))
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(31))
    return np.where(x >= PRIME, x - np.uint64(PRIME), x)


class PrimePowers:
    """Powers of BASES modulo PRIME and their inverses."""

    def __init__(self) -> None:
        self.tables = [(np.ones(1, np.uint64), np.ones(1, np.uint64)) for _ in BASES]

    def get(self, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        if len(self.tables[0][0]) < n:
            n += n >> 2
            self.tables = [(self._powers(b, n), self._powers(pow(b, -1, PRIME), n)) for b in BASES]
        return self.tables

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out, have = np.ones(n, np.uint64), 1
        while have < n:
            more = min(have, n - have)
            out[have : have + more] = folded_prime(out[:more] * np.uint64(pow(base, have, PRIME)))
            have += more
        return out


PRIME_POWERS = PrimePowers()


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans of raw bytes: two polynomials modulo a prime (62 bits), with the length mixed in."""
    n = len(raw)
    out = np.zeros(len(start), np.uint64)
    if not len(start):
        return out
    value = raw.astype(np.uint64)
    value += np.uint64(1)
    sums = np.zeros(n + 1, np.uint64)
    for up, down in PRIME_POWERS.get(n + 1):
        np.cumsum(value * up[:n], out=sums[1:])
        h = folded_prime(folded_prime(sums[end] - sums[start]) * down[start])
        out = out << np.uint64(31) | h
    size = (end - start).astype(np.uint64)
    out = mix(out ^ (size * np.uint64(Powers.BASE)))
    for k in np.flatnonzero(size >= LONG_SPAN).tolist():
        out[k] = np.frombuffer(hashlib.blake2b(raw[start[k] : end[k]].tobytes(), digest_size=8).digest(), np.uint64)[0]
    return out


class Words:
    """Words of many texts at once: byte offsets and 64-bit hashes of maximal runs of word bytes.

    texts: bytes; is_word: 256 booleans. doc: index of each word's text.
    """

    AT_ONCE = 1 << 22  # bytes that are hashed at once

    def __init__(self, texts: list[bytes], is_word: np.ndarray) -> None:
        self.buffer = b"\n".join(texts) + b"\n"
        raw = np.frombuffer(self.buffer, np.uint8)
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        inside = np.zeros(len(raw) + 1, np.int8)
        inside[1:] = is_word[raw]
        inside[ends] = 0  # the join byte is no word byte
        edge = np.diff(inside)
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(self.end) < len(self.start):
            self.end = np.append(self.end, len(raw))
        self.doc = np.searchsorted(ends, self.start, side="right")
        hashes, at = [np.zeros(0, np.uint64)], 0
        while at < len(self.start):
            low = self.start[at]
            to = max(at + 1, int(np.searchsorted(self.end, low + self.AT_ONCE, side="right")))
            hashes.append(span_hashes(raw[low : self.end[to - 1]], self.start[at:to] - low, self.end[at:to] - low))
            at = to
        self.hash = np.concatenate(hashes)
        self.counts = np.bincount(self.doc, minlength=len(texts))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of n consecutive words, and whether they are words of one text."""
        m = len(self.hash) - n + 1
        if m <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        h = np.zeros(m, np.uint64)
        for j in range(n):
            h *= np.uint64(Powers.BASE)
            h += self.hash[j : j + m]
        return mix(h + np.uint64(n)), self.doc[:m] == self.doc[n - 1 :]
