"""Shared pieces: shared storage, byte chunks of Arrow text columns, hashing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_dir, trim

U = np.uint64
MIX = [U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
#: Bytes of text that one numpy pass works on; a longer document is a pass of its own.
CHUNK_BYTES = 1 << 20


#: Shuffle files go as soon as what read them is written.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def save(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it again: the lineage is cut, the files
    outlive any executor, and shuffle files and freed driver memory before it go."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/tabloom/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(at)
    finally:
        spark.conf.set(_CLEAN, before) if before is not None else spark.conf.unset(_CLEAN)
    trim(spark)
    out = spark.read.schema(df.schema).parquet(at)
    out.saved_at = at
    return out


def forget(*saved: DataFrame) -> None:
    """Delete tables that ``save`` wrote, once all that was made of them is written."""
    for df in saved:
        folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.saved_at)
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, per_task: int = 20_000) -> int:
    """Partitions so that each holds about per_task rows, never fewer than the session's."""
    conf = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(conf, -(-df.count() // per_task))


def lower_ascii(col):
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def splitmix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Texts:
    """Consecutive texts as one byte array; text i is data[off[i]:off[i + 1]]."""

    __slots__ = ("first", "data", "off")

    def __init__(self, first: int, data: np.ndarray, off: np.ndarray):
        self.first, self.data, self.off = first, data, off

    def __len__(self) -> int:
        return len(self.off) - 1


def chunks(column, limit: int = CHUNK_BYTES) -> Iterator[Texts]:
    """Split an Arrow string column (nulls: empty) into Texts of about limit bytes."""
    import pyarrow as pa

    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = int(np.searchsorted(off, off[at] + limit, "right")) - 1
        to = min(max(to, at + 1), len(column))
        yield Texts(at, data[off[at] : off[to]], off[at : to + 1] - off[at])
        at = to


_powers: dict[int, np.ndarray] = {}
_R = 0x9E3779B97F4A7C15
_TABLE = splitmix(np.arange(1, 257, dtype=np.uint64) * U(_R)) | U(1)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        have = np.ones(size, np.uint64)
        done = 1
        while done < size:
            more = min(done, size - done)
            have[done : done + more] = have[:more] * U(pow(base, done, 1 << 64))
            done += more
        if n <= 4 * CHUNK_BYTES:
            _powers[base] = have
    return have[:n]


def runs(member: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of True that stay within one text."""
    n = len(member)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = member[:-1]
    before &= ~edge[:n]
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = member[1:]
    after &= ~edge[1:]
    return np.flatnonzero(member & ~before), np.flatnonzero(member & ~after) + 1


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end] by one prefix sum."""
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[data] * powers(_R, n), out=total[1:])
    h = (total[ends] - total[starts]) * powers(pow(_R, -1, 1 << 64), n + 1)[starts]
    return splitmix(h + (ends - starts).astype(np.uint64) * MIX[1])


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: [^\x20\x09-\x0D]
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
