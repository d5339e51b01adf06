"""What several operators of this subpackage share: the shared folder, text blocks, word hashes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised block holds (a single longer text makes a longer block).
BLOCK_BYTES = 2 << 20

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_TAIL = np.array([(1 << (8 * k)) - 1 if k < 8 else (1 << 64) - 1 for k in range(9)], dtype=np.uint64)


def bounded_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker gets at a time, so that long texts do not add up."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2048")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(columns: list[str], *wanted: str) -> list[str]:
    """The wanted names, with underscores behind those that a column has, in whatever case."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def columns_of(df: DataFrame) -> list[Column]:
    """All columns, whatever signs their names hold."""
    return [quoted(c) for c in df.columns]


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """mapInArrow of a table whose columns may have names that Spark's own cannot look up."""
    return df.toDF(*(f"c{k}" for k in range(len(df.columns)))).mapInArrow(run, schema)


def freeing(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, at whose end the Python worker, which stays for later tasks, gives freed memory back to the system."""

    def freed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
            trim(0)

    return freed


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or, on a local master only, one of our own (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


class Scratch:
    """Tables written to the shared folder to cut lineage; `drop` frees those that nothing reads any more, and the
    session's end what is left."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/quillon-{name}-{uuid.uuid4().hex}", 0
        at = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        store = at.getFileSystem(spark._jsc.hadoopConfiguration())
        store.mkdirs(at)
        store.deleteOnExit(at)

    def table(self, df: DataFrame) -> DataFrame:
        self.n += 1
        at = f"{self.root}/{self.n}"
        df.write.parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._quillon_path = at
        return out

    def recurring(self, rows: DataFrame, key: str, hot: int = 10_000) -> tuple[DataFrame, DataFrame]:
        """Of a table's rows those whose key stands in others too, and the counted keys.

        Keys of more than a thousandth of all rows, and of `hot` at least, are fewer than a thousand: these are
        broadcast, so that their rows stay where they are. The others are joined.
        """
        counts = self.table(rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1"))
        least = max(hot, (counts.agg(F.sum("n")).first()[0] or 0) // 1000)
        most = F.broadcast(counts.filter(F.col("n") > least).select(key))
        rest = rows.join(most, key, "left_anti").join(counts.filter(F.col("n") <= least).select(key), key, "left_semi")
        return rows.join(most, key, "left_semi").unionByName(rest), counts

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark._jvm
        for t in tables:
            p = jvm.org.apache.hadoop.fs.Path(t._quillon_path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each text; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def blocks(texts: list[bytes], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts that together have about `limit` bytes."""
    lo = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = (h ^ (h >> np.uint64(32))) * _M1
    h = (h ^ (h >> np.uint64(29))) * _M2
    return h ^ (h >> np.uint64(32))


def words_at(buf: bytes) -> np.ndarray:
    """The little-endian 64-bit word at each byte of buf, which must end in 8 spare bytes."""
    return np.ndarray((len(buf) - 7,), dtype="<u8", buffer=buf, strides=(1,))


def hash_slices(buf: bytes, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each slice; buf must end in 8 spare bytes."""
    at, n = words_at(buf), lengths.astype(np.int64)
    h = mix(n.astype(np.uint64) * _M3 ^ (at[starts] & _TAIL[np.minimum(n, 8)]))
    more, k = np.flatnonzero(n > 8), 8
    while more.size:
        rest = n[more] - k
        h[more] = mix(h[more] * _M3 + (at[starts[more] + k] & _TAIL[np.minimum(rest, 8)]))
        more, k = more[rest > 8], k + 8
    return h


def same_slices(one: np.ndarray, starts: np.ndarray, lengths: np.ndarray, other: np.ndarray, others: np.ndarray, other_lengths: np.ndarray) -> np.ndarray:
    """Whether slices of two buffers, given as words_at has them, are the same bytes."""
    same = lengths == other_lengths
    left, k = np.flatnonzero(same), 0
    while left.size:
        rest = _TAIL[np.minimum(lengths[left] - k, 8)]
        equal = ((one[starts[left] + k] ^ other[others[left] + k]) & rest) == 0
        same[left[~equal]] = False
        left, k = left[equal & (lengths[left] > k + 8)], k + 8
    return same
