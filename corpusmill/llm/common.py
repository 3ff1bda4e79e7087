"""Helpers shared by the training-data operators.

Texts are handled as Arrow buffers: a batch of documents is one byte array plus
offsets, and words, hashes and windows are computed for the whole batch with numpy.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.shipping import ship

#: Bytes that separate words: space and 0x09-0x0D.
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, 9, 10, 11, 12, 13]] = True
#: A-Z to a-z, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_RNG = np.random.default_rng(20240607)
#: Two tables of random 64-bit values by byte, and odd multipliers, for two independent hashes.
_BYTE = _RNG.integers(1, 2**63, size=(2, 256), dtype=np.uint64)
_BASE = [0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1]
_POWERS: dict[tuple[int, bool], np.ndarray] = {}
#: Bytes or words that are hashed at a time.
STEP = 1 << 16


def _libc():
    """The C library's allocator set to give large blocks back when they are freed; None where there is no such library."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD: fixed, rather than grown by each large block that is freed
        libc.mallopt(-1, 8 << 20)  # M_TRIM_THRESHOLD
        libc.mallopt(-8, 2)  # M_ARENA_MAX
        return libc
    except (OSError, AttributeError):
        return None


_LIBC = _libc()


def give_back() -> None:
    """Return unused memory to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def lean(scan):
    """A map over Arrow batches whose worker gives unused memory back when a task ends; workers are reused and share an executor's memory."""

    def run(batches):
        try:
            yield from scan(batches)
        finally:
            give_back()

    return run


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Columns by exact name; others go, also those that differ only in case. Workers can import this package from here on."""
    ship(df.sparkSession)
    columns = df.columns
    missing = [n for n in names if n not in columns]
    if missing:
        raise ValueError(f"missing columns {missing} in {columns}")
    plain = df.toDF(*[f"c{i}" for i in range(len(columns))])
    return plain.select(*[F.col(f"c{columns.index(n)}").alias(n) for n in names])


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a temporary one only where none is set and all runs on one machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="corpusmill-checkpoint-"))
    return context.getCheckpointDir()


def materialize(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Write df as Parquet in the shared checkpoint folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._corpusmill_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete a table that materialize() wrote and nobody reads any more."""
    path = getattr(df, "_corpusmill_path", None)
    if path:
        spark = df.sparkSession
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = column.type in (pa.large_string(), pa.large_binary())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Consecutive rows with up to about limit bytes of text: (rows, bytes, offsets)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, off = text_buffers(batch.column(batch.schema.get_field_index(text)))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(off, off[start] + limit, side="right")) - 1)
            end = min(end, batch.num_rows)
            yield batch.slice(start, end - start), data[off[start] : off[end]], off[start : end + 1] - off[start]
            start = end


def spans(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of True that don't cross documents: (start, end, first run of each document and the total)."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    starts, ends = off[:-1][off[:-1] < off[1:]], off[1:][off[:-1] < off[1:]] - 1
    first[starts] = inside[starts]
    last[ends] = inside[ends]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return s, e, np.searchsorted(s, off)


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words: runs of bytes other than space and 0x09-0x0D."""
    return spans(~SEPARATOR[data], off)


def powers(which: int, n: int, inverse: bool = False) -> np.ndarray:
    """base**i (or its inverse) modulo 2**64 for i < n, which is STEP + 1 at most."""
    have = _POWERS.get((which, inverse))
    if have is None:
        base = pow(_BASE[which], -1, 1 << 64) if inverse else _BASE[which]
        have = np.empty(2 * STEP, np.uint64)
        have[0] = 1
        filled = 1
        while filled < len(have):
            have[filled : 2 * filled] = have[:filled] * np.uint64(pow(base, filled, 1 << 64))
            filled *= 2
        _POWERS[which, inverse] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads all bits (the one of MurmurHash3)."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _steps(s: np.ndarray, e: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of spans in order, from and to, that lie within STEP bytes; a longer span is a run by itself."""
    i = 0
    while i < len(s):
        j = max(i + 1, int(np.searchsorted(e, s[i] + STEP, side="right")))
        yield i, j
        i = j


def _long_hash(data: np.ndarray, which: int) -> np.uint64:
    total = 0
    for at in range(0, len(data), STEP):
        part = _BYTE[which][data[at : at + STEP]] * powers(which, min(STEP, len(data) - at))
        total += int(part.sum(dtype=np.uint64)) * pow(_BASE[which], at, 1 << 64)
    return np.uint64(total & (1 << 64) - 1)


def span_hash(data: np.ndarray, s: np.ndarray, e: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hash of the bytes in each span; spans are in order and don't overlap. Memory beside the result is bounded."""
    out = np.empty(len(s), np.uint64)
    for i, j in _steps(s, e):
        base, n = int(s[i]), int(e[j - 1] - s[i])
        if n > STEP:
            out[i] = _long_hash(data[base : base + n], which)
            continue
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[which][data[base : base + n]] * powers(which, n), out=total[1:])
        a, b = s[i:j] - base, e[i:j] - base
        out[i:j] = (total[b] - total[a]) * powers(which, n + 1, inverse=True)[a]
    return mix(out + (e - s).astype(np.uint64))


def window_hash(words: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """Hash of each width consecutive word hashes; len(words) - width + 1 of them."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    if width > STEP:
        raise ValueError(f"windows have at most {STEP} words")
    for at in range(0, n, STEP - width + 1):
        part = words[at : at + STEP]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * powers(which, len(part)), out=total[1:])
        m = len(part) - width + 1
        out[at : at + m] = (total[width:] - total[:m]) * powers(which, m, inverse=True)
    return mix(out)


def window_starts(firsts: np.ndarray, width: int) -> np.ndarray:
    """Indexes of the words at which a window within one document starts."""
    counts = np.maximum(np.diff(firsts) - width + 1, 0)
    return ranges(firsts[:-1], counts)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... counts[i] of them, for every i in turn."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)


def joined(data: np.ndarray, off: np.ndarray, s: np.ndarray, e: np.ndarray, firsts: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The kept words of each document joined by one space: (bytes, offsets, start and end of each kept word)."""
    kept = np.arange(len(s)) if keep is None else np.flatnonzero(keep)
    counts = np.diff(np.searchsorted(kept, firsts))
    if not len(kept):
        return np.zeros(0, np.uint8), np.zeros(len(off), np.int64), kept, kept
    mark = np.zeros(len(data) + 1, np.int8)
    mark[s[kept]] += 1
    mark[e[kept]] -= 1
    mask = np.cumsum(mark[:-1], dtype=np.int8).astype(bool)
    gaps = np.ones(len(kept), bool)
    gaps[np.cumsum(counts)[counts > 0] - 1] = False
    after = e[kept][gaps]
    out = data.copy()
    out[after] = 0x20
    mask[after] = True
    sizes = e[kept] - s[kept]
    begin = np.cumsum(sizes + gaps) - (sizes + gaps)
    lengths = np.concatenate([[0], np.cumsum(sizes + gaps)])
    edges = np.concatenate([[0], np.cumsum(counts)])
    return out[mask], lengths[edges], begin, begin + sizes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
