"""Shared plumbing: scratch tables, Arrow buffers, vectorised token hashing, packed key blobs."""

from __future__ import annotations

import ctypes
import inspect
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from glyphward.plans.scratch import scratch_dir

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
#: Bytes of text that one grouped Python call handles, on average.
CHUNK_BYTES = 8 << 20


#: Whether Spark deletes a query's shuffle files as it ends; else they stay until the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage_table(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """Write df to the shared scratch folder and read it back: lineage ends at files every executor can read.  ``free``: its
    shuffle files go at once."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    if free:
        spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if free:
            spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Delete a staged table's files.  Only once all that was made of it is written itself, as nothing can be computed again."""
    spark = df.sparkSession
    for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_bytes(df: DataFrame, column: str = "text") -> int:
    return df.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0


def settled(df: DataFrame) -> DataFrame:
    """df, or a staged copy where its rows could come in another order when a lost task runs again (after an exchange)."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return stage_table(df, "settled") if "Exchange" in plan else df


def with_chunk(docs: DataFrame, n_chunks: int) -> DataFrame:
    """Adds ``__chunk``: rows of a ``settled`` table spread evenly by their place in it, so equal rows are spread as well."""
    return docs.withColumn("__chunk", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_chunks)).cast("int"))


# ---------------------------------------------------------------- Arrow


def string_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.cast(pa.large_string()).combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], pa.large_string())
    else:
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, off, data = column.buffers()
    n = len(column)
    if n == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int):
    """Row ranges of about ``limit`` bytes, at least a row each."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


try:
    _TRIM = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # not every C library has it
    _TRIM = None


#: What modules keep in a worker from task to task, by name: how to drop it.
KEPT: dict[str, Callable[[], None]] = {}


def give_back() -> None:
    """Freed memory goes back to the system: a Python worker lives on and its executor's memory is counted with it."""
    if any(len(x) > 1 << 19 for x in _POW.values()):
        _POW.clear()
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def tidy(run, keep: str | None = None):
    """``run`` (of a group, of two groups, or of batches), giving back memory at its end; before it begins, what other modules
    KEPT in this worker goes, all but ``keep``."""

    def begin() -> None:
        for name, drop in KEPT.items():
            if name != keep:
                drop()

    if inspect.isgeneratorfunction(run):

        def batches(some):
            begin()
            yield from run(some)
            give_back()

        return batches

    def one(table: pa.Table) -> pa.Table:
        begin()
        out = run(table)
        give_back()
        return out

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        begin()
        out = run(left, right)
        give_back()
        return out

    return one if len(inspect.signature(run).parameters) == 1 else two


# ---------------------------------------------------------------- hashing


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = np.array(x, dtype=U64)
    x ^= x >> U64(33)
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


_POW: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE**0 .. BASE**(n-1) modulo 2**64, or of BASE's inverse."""
    key = "inv" if inverse else "pow"
    have = _POW.get(key)
    if have is None or len(have) < n:
        base = pow(_BASE, -1, 1 << 64) if inverse else _BASE
        size = 1 << max(10, int(n - 1).bit_length())
        out = np.ones(size, U64)
        filled = 1
        while filled < size:
            out[filled : 2 * filled] = out[:filled] * U64(pow(base, filled, 1 << 64))
            filled *= 2
        _POW[key] = have = out
    return have[:n]


def byte_table(kind: str) -> np.ndarray:
    """Byte classes: 0 separates tokens.  ``space``: tokens are runs of anything but ASCII white space.
    ``word``: runs of ASCII letters (lower-cased), digits and non-ASCII bytes.  ``blank``: runs of anything but blanks and line
    feeds, every byte told apart (UTF-8 has no byte 255)."""
    table = np.zeros(256, np.uint8)
    if kind == "blank":
        table[:] = np.arange(256)
        table[0] = 255
        table[[10, 32]] = 0
        return table
    if kind == "space":
        table[:] = np.arange(256)
        table[0] = 1
        table[[9, 10, 11, 12, 13, 32]] = 0
    else:
        table[128:] = np.arange(128, 256)
        for c in b"0123456789abcdefghijklmnopqrstuvwxyz":
            table[c] = c
        table[65:91] = np.arange(97, 123)
    return table


TABLES = {k: byte_table(k) for k in ("space", "word", "blank")}


def hash_tokens(data: np.ndarray, offsets: np.ndarray, kind: str, ends: bool = False, block: int = 1 << 20):
    """Tokens of all rows: (hashes, start bytes, end bytes or None, token offsets of the rows).

    Works through blocks that end at separators, so one very long text needs no more memory than many short ones.
    """
    table = TABLES[kind]
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    hs, ss, es = [], [], []
    a = 0
    while a < n:
        b = min(n, a + block)
        while b < n:  # move the cut forward to a place where no token is open
            back = np.flatnonzero((table[data[a:b]] == 0) | edge[a:b])
            if len(back) and back[-1] > 0:
                b = a + int(back[-1])
                break
            b = min(n, b + block)
        m = table[data[a:b]]
        nz = m != 0
        before = np.empty(len(m), bool)
        before[0] = False
        before[1:] = nz[:-1]
        before[edge[a:b]] = False
        starts = np.flatnonzero(nz & ~before)
        if len(starts):
            first = int(starts[0])
            gaps = np.diff(np.append(starts, len(m)))
            rel = np.arange(first, len(m), dtype=np.int64) - np.repeat(starts, gaps)
            h = np.add.reduceat(m[first:].astype(U64) * powers(int(gaps.max()))[rel], starts - first)
            hs.append(mix(h))
            ss.append(starts + a)
            if ends:
                after = np.empty(len(m), bool)
                after[-1] = b < n and not edge[b] and table[data[b]] != 0
                after[:-1] = nz[1:]
                after[:-1][edge[a + 1 : b]] = False
                es.append(np.flatnonzero(nz & ~after) + a + 1)
        a = b
    h = np.concatenate(hs) if hs else np.zeros(0, U64)
    s = np.concatenate(ss) if ss else np.zeros(0, np.int64)
    e = (np.concatenate(es) if es else np.zeros(0, np.int64)) if ends else None
    return h, s, e, np.searchsorted(s, offsets)


def ngram_hashes(h: np.ndarray, tok: np.ndarray, n: int, short: bool = False):
    """Hash of every n-token window inside its row: (hashes, owning row).  ``short``: a row of 1..n-1 tokens has one
    window of all its tokens."""
    counts = np.diff(tok)
    rows = np.repeat(np.arange(len(counts)), np.maximum(counts - n + 1, 0))
    if len(h) >= n:
        first = np.repeat(tok[:-1], np.maximum(counts - n + 1, 0)) + (
            np.arange(len(rows)) - np.repeat(np.cumsum(np.maximum(counts - n + 1, 0)) - np.maximum(counts - n + 1, 0), np.maximum(counts - n + 1, 0))
        )
        g = np.zeros(len(first), U64)
        for k in range(n):
            g = mix(g * U64(_BASE) + h[first + k])
    else:
        g = np.zeros(0, U64)
        rows = rows[:0]
    if short:
        some = np.flatnonzero((counts > 0) & (counts < n))
        if len(some):
            extra = np.zeros(len(some), U64)
            for k in range(n - 1):
                has = counts[some] > k
                extra[has] = mix(extra[has] * U64(_BASE) + h[tok[some[has]] + k])
            g, rows = np.concatenate([g, mix(extra ^ U64(0xABCDEF))]), np.concatenate([rows, some])
    return g, rows


# ---------------------------------------------------------------- packed key exchange


def planes(values: np.ndarray) -> bytes:
    """Fixed-width values as byte planes; the shuffle's compressor then drops planes that are mostly zero."""
    v = np.ascontiguousarray(values)
    return v.view(np.uint8).reshape(-1, v.dtype.itemsize).T.tobytes()


def unplanes(blob: bytes, dtype) -> np.ndarray:
    dt = np.dtype(dtype)
    raw = np.frombuffer(blob, np.uint8).reshape(dt.itemsize, -1)
    return np.ascontiguousarray(raw.T).view(dt).ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending uint64 keys as byte planes of their differences."""
    d = keys.copy()
    d[1:] -= keys[:-1]
    return planes(d)


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unplanes(blob, U64), dtype=U64)


def bucket_cuts(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    """Where each of n_buckets equal ranges of the 64-bit space begins in ascending keys."""
    step = (1 << 64) // n_buckets + 1
    bounds = np.array([min(i * step, (1 << 64) - 1) for i in range(n_buckets + 1)], dtype=U64)
    cuts = np.searchsorted(keys, bounds)
    cuts[-1] = len(keys)
    return cuts
