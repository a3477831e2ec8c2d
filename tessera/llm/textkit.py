"""Vectorised kernels over Arrow batches of text, and the helpers that all text operators share.

Every kernel works on the UTF-8 buffer of a whole batch with numpy, so a batch costs a few
array passes and no Python loop over characters or words. Nulls count as empty texts.
"""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Odd multiplier of the rolling polynomial; one random 64-bit value stands for each byte.
_BASE = U64(0x9E3779B97F4A7C15)
_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, U64), np.ones(1, U64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i in 0..n, kept between calls."""
    global _powers
    if len(_powers[0]) <= n:
        size = max(n + 1, 1 << 16)
        up, down = np.full(size, _BASE, U64), np.full(size, U64(pow(int(_BASE), -1, 1 << 64)), U64)
        up[0] = down[0] = 1
        _powers = (np.cumprod(up), np.cumprod(down))
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads the polynomial's low entropy over all bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A text column without nulls."""
    at = batch.schema.get_field_index(name)
    col = batch.column(at)
    if not pa.types.is_string(col.type):
        col = col.cast(pa.string())
    return pc.fill_null(col, "") if col.null_count else col


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and, for n rows, the n + 1 offsets into them."""
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def pieces_of(batch: pa.RecordBatch, name: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch cut into runs of rows of at most `most` bytes of text (a longer row stands alone)."""
    if not batch.num_rows:
        return
    _, off = buffers(column(batch, name))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi
    trim()


def trim() -> None:
    """Gives freed memory back: a Python worker lives on and would keep its peak between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def ascii_lower(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, every other byte as it is."""
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def spans_of(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True; a run never crosses a document's edge."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends


def prefix(data: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] the weighted sum of bytes i..j, so that any substring hashes in O(1)."""
    up, _ = powers(len(data))
    h = np.zeros(len(data) + 1, U64)
    np.cumsum(_TABLE[data] * up[: len(data)], out=h[1:])
    return h


def substring_hash(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the substrings; equal bytes give equal hashes wherever they stand."""
    _, down = powers(len(h))
    return mix((h[ends] - h[starts]) * down[starts] + (ends - starts).astype(U64))


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the words: maximal runs outside space and 0x09-0x0D."""
    starts, ends = spans_of(~((data == 32) | ((data >= 9) & (data <= 13))), off)
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def combine(hashes: list[np.ndarray]) -> np.ndarray:
    """An order-dependent hash of aligned hash columns."""
    out = np.zeros(len(hashes[0]), U64)
    for x in hashes:
        out = mix(out * U64(0xD6E8FEB86659FD93) + x)
    return out


def sorted_unique(group: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (group, value) pairs in order; group must be sorted already."""
    if not len(group):
        return group, value
    order = np.lexsort((value, group))
    group, value = group[order], value[order]
    keep = np.empty(len(group), bool)
    keep[0] = True
    keep[1:] = (group[1:] != group[:-1]) | (value[1:] != value[:-1])
    return group[keep], value[keep]


def binaries(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary column whose row i holds values[bounds[i]:bounds[i + 1]] as raw bytes."""
    width = values.dtype.itemsize
    off = (np.asarray(bounds, np.int64) * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(off.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def packed(blob: bytes, level: int = 1) -> bytes:
    """Compressed for the way through the JVM and the shuffle."""
    return zstandard.ZstdCompressor(level=level).compress(blob)


def unpacked(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the cluster's spark.checkpoint.dir; only where that is unset, as in tests on a
    local master, a temporary folder is taken and set.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = sc._jsc.sc().getCheckpointDir()
        found = found.get() if found.isDefined() else None
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


#: Tables that stored() wrote within the innermost settled(), if there is one.
_made: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("made", default=None)


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df written once as a table in the shared folder and read back: lineage ends here.

    A lost executor costs later stages a re-read of this table, never its recomputation.
    """
    small_batches(spark)
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if (made := _made.get()) is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, build: Callable[[], DataFrame], name: str) -> DataFrame:
    """build() as a stored table; the tables that it stored on the way go once it is written."""
    own: list[str] = []
    outer = _made.set(own)
    try:
        out = stored(spark, build(), name)
    finally:
        _made.reset(outer)
    if (made := _made.get()) is not None:
        made.append(own[-1])
    for path in own[:-1]:
        deleted(spark, path)
    return out


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that stored() writes within go at the end."""
    own: list[str] = []
    outer = _made.set(own)
    try:
        yield
    finally:
        _made.reset(outer)
        for path in own:
            deleted(spark, path)


def deleted(spark: SparkSession, path: str) -> None:
    """Deletes a table of stored() that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def unused(name: str, columns: list[str]) -> str:
    """name, with as many underscores as keep it from clashing with a column (case aside)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> None:
    """Rows of text are long: Spark's default of 10,000 would make Arrow batches of tens of MB each way."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(name).rstrip("bB")  # sizes in other units are the caller's own
        if now.lstrip("-").isdigit() and not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Bits of a sieve for each id (about 1 in 16 other ids passes), and the ids beyond which there is none.
SIEVE, SIEVE_IDS = 16, 1 << 24


def sieve(df: DataFrame, name: str) -> Callable[[str | Column], Column]:
    """A predicate on ids (long) that holds for all ids in df's column, and for few others.

    The ids are counted, then set bits of a map of that size in a distributed aggregate; the map
    reaches all tasks, 32 MB of it at most. More than SIEVE_IDS ids have no map: the predicate
    then holds always, and the join behind it sorts out every row. Use it to keep rows that
    cannot match out of a shuffle.
    """
    count = df.count()
    if count > SIEVE_IDS:
        return lambda c: F.lit(True)
    size = 1 << max(16, (SIEVE * count - 1).bit_length())
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(size))
    bits = df.select(slot(F.col(name).cast("long")).alias("s")).groupBy(F.expr("s div 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(s % 64 as int)))").alias("b"))
    words_ = np.zeros(size // 64, np.uint64)
    got = bits.toArrow()
    words_[np.asarray(got["w"], np.int64)] = np.asarray(got["b"], np.int64).view(np.uint64)
    table = df.sparkSession.createDataFrame([(bytearray(words_.tobytes()),)], "bits binary")

    def holds(c: str | Column) -> Column:
        s = slot((F.col(c) if isinstance(c, str) else c).cast("long"))
        byte = F.conv(F.hex(F.substring(table.scalar(), (F.floor(s / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return F.floor(byte / F.pow(F.lit(2), s % 8)) % 2 == 1

    return holds
