"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text that one numpy step works on; a longer text is a step by itself.
STEP_BYTES = 1 << 20

#: Bytes that separate words, as a lookup table over UTF-8 bytes.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: ASCII capitals to small letters, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def tune(spark: SparkSession) -> None:
    """Keep the Arrow batches that Python workers get small in rows and bytes: two settings of the session, which stay set since plans are run later."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or, where the session names none, a folder of its warehouse."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (where or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_intermediate").rstrip("/")


#: Paths of the tables that this process has written to the shared folder; those that are in the catalog, with their names.
_written: list[str] = []
_named: dict[str, str] = {}


def table_path(spark: SparkSession, name: str, in_catalog: bool = False) -> str:
    """A path for a table in the shared folder, noted for :func:`drop_tables`."""
    _written.append(f"{shared_dir(spark)}/tables/{name}")
    if in_catalog:
        _named[_written[-1]] = name
    return _written[-1]


def drop_tables(spark: SparkSession, since: int = 0, keep: int = 0) -> int:
    """Delete the tables that this process has written to the shared folder, from number ``since`` on and but for the last ``keep``, once nothing reads them any more."""
    end = max(since, len(_written) - keep)
    done, _written[since:end] = _written[since:end], []
    for where in done:
        if where in _named:
            spark.sql(f"DROP TABLE IF EXISTS `{_named.pop(where)}`")
        path = spark._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(done)


def written() -> int:
    """How many tables are noted for :func:`drop_tables`."""
    return len(_written)


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` as a Parquet table in the shared folder and read it again.

    A lost executor then costs no more than the tasks it was running.
    """
    spark = df.sparkSession
    path = table_path(spark, uuid.uuid4().hex)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let go of what finished steps have left: garbage of the driver, and with it the shuffle files and broadcasts that nothing refers to any more."""
    gc.collect()
    spark._jvm.java.lang.System.gc()


def kind(df: DataFrame, column: str) -> str:
    """The DDL type of a column."""
    return df.schema[column].dataType.simpleString()


def wider(df: DataFrame, **more: str) -> StructType:
    """The schema of ``df`` with more columns: name and type."""
    return StructType([*df.schema.fields, *StructType.fromDDL(", ".join(f"`{k}` {v}" for k, v in more.items())).fields])


def train_fold(doc_id: Column) -> Column:
    """True for rows to learn from: crc32 of the id as text, modulo 4, is not 2 (a null id counts as '')."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) != 2


def steps(batches: Iterator[pa.RecordBatch], column: str, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``most`` bytes of ``column`` each, at least one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = (np.cumsum(sizes, dtype=np.int64) - sizes) // most
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            yield batch.slice(a, b - a)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column (null: none) and the offset of each row, and the end."""
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None or not len(texts):
        return np.empty(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(in_word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every run of ``in_word`` that stays within a row, and the first run of each row, and the end."""
    n = len(in_word)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = in_word[:-1], in_word[1:]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    before[cuts] = False
    after[cuts - 1] = False
    starts = np.flatnonzero(in_word & ~before)
    ends = np.flatnonzero(in_word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_P, _PINV = 0x9E3779B97F4A7C15 | 1, pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64)
_powers: list[np.ndarray] = []


def mix64(x: np.ndarray) -> np.ndarray:
    """A finalizer with full avalanche over uint64 values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each pair, from prefix sums of a polynomial."""
    n = len(values)
    if not _powers or len(_powers[0]) < n + 1:
        size = max(n + 1, STEP_BYTES * 2)
        _powers[:] = [np.cumprod(np.r_[np.uint64(1), np.full(size - 1, p, np.uint64)]) for p in (_P, _PINV)]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * _powers[0][:n], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * _powers[1][starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    return range_hashes(data, starts, ends)


def kgram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of every k consecutive word hashes (rows are not looked at)."""
    n = max(0, len(words) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += words[j : j + n]
    return mix64(out)


def merge_intervals(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals [a, b) that are sorted by a."""
    if not len(a):
        return a, b
    top = np.maximum.accumulate(b)
    new = np.r_[True, a[1:] > top[:-1]]
    last = np.r_[np.flatnonzero(new)[1:] - 1, len(a) - 1]
    return a[new], top[last]
