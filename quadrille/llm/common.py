"""Shared parts: the shared folder, checkpoints, and vectorised word tables over Arrow batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but space, tab, line feed, vertical tab, form feed and carriage return.
SPACE_BYTES = (9, 10, 11, 12, 13, 32)
SPACE_CLASS = r"\x20\x09-\x0D"
WORD_RE = rf"[^{SPACE_CLASS}]+"
#: Bytes of text that a vectorised step looks at at once (a longer text is taken alone); it holds some 50 times as much.
CHUNK_BYTES = 1 << 18


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's spark.checkpoint.dir, else, with a local master (tests), a temporary one."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir()
    if found is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or f"file://{tempfile.mkdtemp(prefix='quadrille-')}")
        found = sc.getCheckpointDir()
    return found


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder and forget the lineage, so a lost executor costs a re-read only."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_small(df: DataFrame) -> DataFrame:
    """``cut`` of a few rows, as many files as tasks run at once: the executor starts a process for each file it makes."""
    return cut(df.coalesce(df.sparkSession.sparkContext.defaultParallelism))


def stored(df: DataFrame) -> DataFrame:
    """Write to a table in the shared folder and read it: like ``cut``, and Spark knows its size, so that it
    broadcasts a side of a join only where that is small."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_column(text: Column) -> Column:
    """The array of a text's words (null text: empty array), in the JVM."""
    split = F.split(F.coalesce(text, F.lit("")), rf"[{SPACE_CLASS}]+")
    return F.filter(split, lambda w: w != "")


# -- Arrow batches as byte buffers -------------------------------------------------------------

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACE_BYTES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SAME = np.arange(256, dtype=np.uint8)
_BYTE_VALUE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        step = np.full(max(n, CHUNK_BYTES + 64), base, dtype=np.uint64)
        step[0] = 1
        have = np.cumprod(step, dtype=np.uint64)
        if n <= CHUNK_BYTES + 64:
            _POWERS[int(base)] = have
    return have[:n]


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array and its row offsets from 0; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def row_chunks(offs: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each, or of one row."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def lean(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function, after whose partition the worker, which lives on, gives unused memory back to the system."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return run


class Words:
    """Word table of some texts: start, end (byte offsets), row, and a 64-bit hash of each word."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, lower: bool = False):
        n = len(buf)
        self.rows = len(offs) - 1
        space = _IS_SPACE[buf]
        first = ~space
        last = first.copy()
        first[1:] &= space[:-1]
        last[:-1] &= space[1:]
        heads = offs[:-1][offs[:-1] < n]
        first[heads] = ~space[heads]
        tails = offs[1:][offs[1:] > 0] - 1
        last[tails] = ~space[tails]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.row = np.searchsorted(offs, self.start, side="right") - 1
        self.space = space
        value = _BYTE_VALUE[(_LOWER if lower else _SAME)[buf]]
        value *= _powers(_BASE, n)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
        h = (total[self.end] - total[self.start]) * _powers(_INVERSE, n + 1)[self.start]
        self.hash = mix64(h + (self.end - self.start).astype(np.uint64))
        self.count = np.bincount(self.row, minlength=self.rows)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word, and hash, of each run of k words inside one row."""
        m = len(self.hash) - k + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = self.hash[:m].copy()
        for j in range(1, k):
            h = mix64(h * np.uint64(0xD6E8FEB86659FD93) + self.hash[j : j + m])
        at = np.flatnonzero(self.row[:m] == self.row[k - 1 : k - 1 + m])
        return at, h[at]

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Row and hash of each distinct k-word shingle; a row of 1 to k-1 words has one, of all its words."""
        at, h = self.windows(k)
        row = self.row[at]
        short = np.flatnonzero((self.count > 0) & (self.count < k))
        if len(short):
            begin = np.searchsorted(self.row, short)
            whole = np.zeros(len(short), np.uint64)
            for j in range(k - 1):
                some = self.count[short] > j
                whole[some] = mix64(whole[some] * np.uint64(0xA24BAED4963EE407) + self.hash[begin[some] + j])
            row, h = np.concatenate([row, short]), np.concatenate([h, whole])
        order = np.lexsort((h, row))
        row, h = row[order], h[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
        return row[new], h[new]
