"""Helpers shared by the training-data operators.

Text work happens inside tasks on Arrow batches: a batch is cut into slices of bounded bytes, the
words of a slice are found and hashed with numpy over the Arrow data buffer, and ragged results are
packed as list columns (one row per bucket) so that a shuffle moves arrays instead of single rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SLICE_BYTES = 2 << 20  # text handled at once in a task
_MULT = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INV = pow(_MULT, -1, 1 << 64)
# word separators: space and the control characters 9 to 13
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


_shipped: set[str] = set()


BATCH_CONF, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20), "8m"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once a session, so that tasks can import it (and keep what
    they remember between tasks of a worker).  Arrow batches are cut to 8 MB unless the session says otherwise:
    ten thousand long texts at once are held several times over by the executor and the worker."""
    import os
    import shutil
    import tempfile

    import roomtrace

    if spark.conf.get(BATCH_CONF, BATCH_DEFAULT).rstrip("b") == BATCH_DEFAULT:
        spark.conf.set(BATCH_CONF, BATCH_BYTES)
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        top = os.path.dirname(os.path.dirname(os.path.abspath(roomtrace.__file__)))
        sc.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="roomtrace-code-"), "roomtrace_code"), "zip", top, "roomtrace"))
        _shipped.add(sc.applicationId)


_lean = False
_held: dict[str, Callable[[], None]] = {}


def remembered(owner: str, forget: Callable[[], None]) -> None:
    """Name what ``owner`` keeps in a Python worker between tasks; it goes when the worker serves another operator."""
    _held[owner] = forget


def begin(owner: str) -> None:
    """Prepare a Python worker for a function of ``owner``: large arrays go back to the system when they are
    freed, and what other operators remember is forgotten."""
    global _lean
    if not _lean:
        import ctypes

        pa.set_memory_pool(pa.system_memory_pool())
        try:
            ctypes.CDLL(None).mallopt(-3, 8 << 20)  # M_MMAP_THRESHOLD
        except (AttributeError, OSError):  # another C library
            pass
        _lean = True
    for other in [x for x in _held if x != owner]:
        _held.pop(other)()


def tidy() -> None:
    """Give freed memory back to the system."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow`` with the package sent along, in a worker whose memory is kept small."""
    ship(df.sparkSession)
    owner = run.__module__

    def task(batches):
        begin(owner)
        try:
            yield from run(batches)
        finally:
            tidy()

    return df.mapInArrow(task, schema)


def group_arrow(grouped, run, schema) -> DataFrame:
    """``grouped.applyInArrow`` in a worker whose memory is kept small."""
    owner = run.__module__

    def task(table):
        begin(owner)
        large = table.nbytes > 1 << 20
        try:
            return run(table)
        finally:
            if large:
                tidy()

    return grouped.applyInArrow(task, schema)


def n_buckets(df: DataFrame, per_bytes: int = 8 << 20) -> int:
    """Buckets for a shuffle of ``df``: grows with the optimizer's estimate of its bytes (it decides
    how the work is cut, never what comes out)."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return int(min(max(4, -(-size // per_bytes)), 1 << 22))


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """``df.checkpoint()`` in the shared folder named by ``spark.checkpoint.dir`` (eager)."""
    from roomtrace.session import checkpoint_dir

    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches evenly, so that ``column`` holds at most ``limit`` bytes a slice (a longer text comes alone)."""
    import pyarrow.compute as pc

    for b in batches:
        if not b.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        even = size[-1] / max(1, -(-int(size[-1]) // limit))
        at = 0
        while at < b.num_rows:
            before = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, before + even, side="right")))
            yield b.slice(at, end - at)
            at = end


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column (null: empty) and the offsets of its rows."""
    col = col.cast(pa.large_binary()).fill_null(b"")
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
    return (data[off[0]:off[-1]] if len(off) else data[:0]), off - (off[0] if len(off) else 0)


_pow: np.ndarray = np.ones(1, np.uint64)
_inv: np.ndarray = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd multiplier and of its inverse modulo 2**64."""
    global _pow, _inv
    if len(_pow) < n:
        n = max(n, SLICE_BYTES + (SLICE_BYTES >> 2))
        for name, base in (("_pow", _MULT), ("_inv", _INV)):
            out = np.full(n, base, np.uint64)
            out[0] = 1
            globals()[name] = np.multiply.accumulate(out)
    return _pow, _inv


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span (in ascending order), equal for equal bytes wherever they stand."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):  # bytes are summed up in parts of bounded size
        low = starts[at]
        end = max(at + 1, int(np.searchsorted(ends, low + SLICE_BYTES, side="right")))
        s, e = starts[at:end] - low, ends[at:end] - low
        part = data[low:low + e[-1]]
        pow_, inv = _powers(len(part) + 1)
        h = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * pow_[:len(part)], out=h[1:])
        out[at:end] = mix((h[e] - h[s]) * inv[s] + (e - s).astype(np.uint64))
        at = end
    return out


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the index of the first word of each row (with the total last)."""
    solid = np.zeros(len(data) + 2, np.int8)
    solid[1:-1] = ~_IS_SPACE[data]
    step = np.diff(solid)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    inner = off[1:-1]
    inner = np.unique(inner[(inner > 0) & (inner < len(data))])
    glued = inner[(solid[inner] == 1) & (solid[inner + 1] == 1)]  # a row ends and the next begins without a space
    if len(glued):
        starts, ends = np.sort(np.append(starts, glued)), np.sort(np.append(ends, glued))
    return starts, ends, np.searchsorted(starts, off)


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive values (``len(h) - n + 1`` of them)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for j in range(n):
        out = out * np.uint64(_MULT) + h[j:len(h) - n + 1 + j]
    return mix(out)


def window_min_at(x: np.ndarray, w: int) -> np.ndarray:
    """Index of the leftmost minimum of each run of ``w`` consecutive values."""
    if len(x) < w:
        return np.zeros(0, np.int64)
    return np.lib.stride_tricks.sliding_window_view(x, w).argmin(axis=1) + np.arange(len(x) - w + 1)


def pack(bucket: np.ndarray, cols: dict[str, np.ndarray]) -> dict[str, pa.Array]:
    """One row per bucket present: ``bucket`` and each column as a list, input order kept."""
    order = np.argsort(bucket, kind="stable")
    ids, first = np.unique(bucket[order], return_index=True)
    off = pa.array(np.append(first, len(bucket)).astype(np.int32))
    return {"bucket": pa.array(ids.astype(np.int32))} | {
        k: pa.ListArray.from_arrays(off, v.take(pa.array(order)) if isinstance(v, pa.Array) else pa.array(v[order]))
        for k, v in cols.items()}


def unpack(table: pa.Table, name: str) -> np.ndarray:
    """All values of a packed list column."""
    col = table.column(name).combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False)


def u64(x: np.ndarray) -> np.ndarray:
    return x.view(np.uint64)


def i64(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def batch(schema: pa.Schema, cols: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for f, c in ((f, cols[f.name]) for f in schema)], schema=schema)
