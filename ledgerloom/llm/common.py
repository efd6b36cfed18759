"""What the training-data operators share: tables, the shared folder, and text as flat byte arrays.

Words are the runs ``[^\\x20\\x09-\\x0D]+`` of a text whose A-Z are lower-cased. All separators are ASCII, so the
work is done on UTF-8 bytes, a slice of a quarter of a megabyte at a time, with numpy.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import ship

#: Bytes of text that are worked on at once (a longer text is one slice of its own).
SLICE_BYTES = 1 << 18
#: Rows of an Arrow batch: long texts make a batch heavy, not many rows.
ARROW_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Arrow batches bounded in rows and, where Spark can, in bytes, so that a Python worker's memory is bounded; executors get the package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a folder of this machine only where that is unset, as in tests."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if not getattr(shared_dir, "own", None):
        shared_dir.own = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
    return shared_dir.own


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/ledgerloom/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame, what: str, partition_by: list[str] | None = None, few: bool = False) -> DataFrame:
    """Cuts the lineage: writes ``df`` to the shared folder and reads it back, so a lost executor costs no recomputing.

    ``few``: the table is light for its number of partitions, so it is written by two tasks a core at most; every file
    costs several calls to the file system.
    """
    spark, path = df.sparkSession, new_folder(df.sparkSession, what)
    if few:
        df = df.coalesce(max(2, 2 * spark.sparkContext.defaultParallelism))
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def discard(table: DataFrame, part: str = "") -> None:
    """Deletes a table that ``cut`` wrote, or a folder in it, once what is made of it has been written in its turn."""
    jvm, conf = table.sparkSession.sparkContext._jvm, table.sparkSession.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{table.cut_path}/{part}" if part else table.cut_path)
    path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of finished steps that nothing refers to any more."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fold(column: str, modulus: int) -> F.Column:
    """crc32 of the column as text, modulo ``modulus`` (null stays null)."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))


def settle() -> None:
    """Gives memory that a task has freed back to the system: Spark keeps idle Python workers, sometimes several a core."""
    import ctypes

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only where the C library can
        ctypes.CDLL(None).malloc_trim(0)


# --- text as bytes --------------------------------------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of a span beyond which its hash is a keyed digest.
LONG = 64
_KEY = b"ledgerloom span"
_SEED, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and len(column) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0] if len(column) else np.zeros(1, np.int64)


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, one row at least."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of every word of the rows, and the words before each row (one entry more than rows)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    low = _LOWER[data]
    space = _SPACE[data]
    before = np.empty(n, bool)
    before[0], before[1:] = True, space[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, space[1:]
    inner = offsets[:-1][(offsets[:-1] < n)]
    before[inner] = True
    ends = offsets[1:]
    after[ends[ends > 0] - 1] = True
    start = np.flatnonzero(~space & before)
    end = np.flatnonzero(~space & after) + 1
    return start, end, hash_spans(low, start, end), np.searchsorted(start, offsets)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as one number; zeros follow the last byte."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def lane(eight: np.ndarray, start: np.ndarray, size: np.ndarray, at: int) -> np.ndarray:
    """Bytes ``at`` to ``at`` + 7 of spans, zeros after a span's end; every span is longer than ``at``."""
    return eight[start + at] & _LOW[np.minimum(size - at, 8)]


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, eight: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of spans of bytes: eight bytes after the other go through a bijective mix; long spans by a keyed digest.

    Spans of one length of up to eight bytes never collide; no repeated pattern makes others collide, as it does with
    polynomials modulo a power of two.
    """
    size = end - start
    out = mix(size.astype(np.uint64) * _STEP + _SEED)
    eight, live = eights(data) if eight is None else eight, np.arange(len(start))
    for at in range(0, LONG, 8):
        live = live[size[live] > at]
        if not len(live):
            break
        out[live] = mix(out[live] * _STEP ^ lane(eight, start[live], size[live], at))
    far = np.flatnonzero(size > LONG)
    if len(far):
        from hashlib import blake2b

        raw = data.tobytes()
        out[far] = [int.from_bytes(blake2b(raw[a:b], digest_size=8, key=_KEY).digest(), "little") for a, b in zip(start[far].tolist(), end[far].tolist(), strict=True)]
    return out


_K = [np.uint64(x) for x in (0x9FB21C651E98DF25, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Per row, its sorted distinct hashed shingles of ``size`` words; a shorter row's whole sequence is one shingle."""
    _, _, hashed, at = words(data, offsets)
    n = len(hashed)
    whole = np.zeros(0, np.uint64)
    if n >= size:
        whole = hashed[: n - size + 1] * _K[0]
        for j in range(1, size):
            whole = mix(whole) + hashed[j : n - size + 1 + j] * _K[j % 5]
        whole = mix(whole)
    out = []
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if hi - lo >= size:
            out.append(np.unique(whole[lo : hi - size + 1]))
        elif hi > lo:
            short = np.uint64(hi - lo)
            for j in range(lo, hi):
                short = mix(np.array([short], np.uint64))[0] ^ hashed[j]
            out.append(np.array([short], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


# --- packed numbers -------------------------------------------------------------------------------------------------


def pack(sorted_ids: np.ndarray) -> bytes:
    """Sorted uint64 numbers as zstd-compressed byte planes of their gaps."""
    import zstandard

    gaps = np.empty(len(sorted_ids), "<u8")
    if len(gaps):
        gaps[0], gaps[1:] = sorted_ids[0], sorted_ids[1:] - sorted_ids[:-1]
    return zstandard.compress(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpack(blob: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    """Non-negative counts as zstd-compressed byte planes."""
    import zstandard

    width = 8 if len(counts) and int(counts.max()) >= 1 << 32 else 4
    planes = np.ascontiguousarray(counts.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T)
    return bytes([width]) + zstandard.compress(planes.tobytes(), 1)


def unpack_counts(blob: bytes) -> np.ndarray:
    import zstandard

    width = blob[0]
    planes = np.frombuffer(zstandard.decompress(blob[1:]), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.int64)
