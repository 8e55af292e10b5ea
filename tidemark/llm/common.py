"""Pieces that the training-data operators share."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: list[str] = []
#: Where ``materialize`` has put a table.
_STORED: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
#: What ``fold_others`` calls the columns that an operator does not read.
OTHERS = "others"

#: What a word is in every operator: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset a local session, whose executors see the driver's disk, gets one of our own; a cluster gets an error.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="spark-shared-"))
    return _OWN[0]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends there, and a lost executor takes nothing along."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _STORED[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of materialized tables that nothing reads any more, and let Spark drop the shuffles behind them.

    What still lies in the shared folder and in shuffles counts as disk until a session ends; long operators call this
    between their steps. Tables that ``materialize`` did not make are left alone.
    """
    spark = None
    for df in tables:
        if path := _STORED.pop(df, None):
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    if spark is not None:
        release(spark)


def release(spark: SparkSession) -> None:
    """Let go of finished jobs: the driver's handles on them, then the JVM's, whose cleaner drops their shuffles from disk."""
    gc.collect()
    spark._jvm.System.gc()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def name_of(c: str) -> Column:
    """A column by its whole name, whatever characters that holds."""
    return F.col("`" + c.replace("`", "``") + "`")


def fold_others(docs: DataFrame, *core: str) -> DataFrame:
    """The core columns, and all others in one struct, so that no name of an operator's own can meet theirs."""
    others = [name_of(c).alias(f"f{i}") for i, c in enumerate(docs.columns) if c not in core]
    return docs.select(*core, (F.struct(*others) if others else F.lit(0)).alias(OTHERS))


def unfold_others(docs: DataFrame, *core: str, **own: Column) -> list[Column]:
    """What to select from a table made by ``fold_others(docs, *core)`` for docs' columns again; ``own`` replaces some."""
    at = lambda i, c: F.col(c) if c in core else F.col(OTHERS)[f"f{i}"]
    return [own.get(c, at(i, c)).alias(c) for i, c in enumerate(docs.columns)]


def fold_of(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of doc_id as text, modulo 5; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % 5


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z and leave every other letter."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a text column holds about ``limit`` bytes in each (a longer text stands alone)."""
    for batch in batches:
        size = pc.binary_length(batch.column(batch.schema.get_field_index(column))).fill_null(0).to_numpy(zero_copy_only=False)
        total, start = np.cumsum(size, dtype=np.int64), 0
        while start < len(size):
            before = total[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(total, before + limit, side="right")))
            yield batch.slice(start, end - start)
            start = end


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def text_bytes(batch: pa.RecordBatch, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column end to end, and where each text starts (null: empty)."""
    arr = pc.fill_null(column(batch, name), "").cast(pa.large_string())
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = np.frombuffer(arr.buffers()[2] or b"", np.uint8)[off[0] : off[-1]] if len(arr) else np.zeros(0, np.uint8)
    return data, off - off[0] if len(arr) else np.zeros(1, np.int64)


def as_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    return pc.fill_null(column(batch, name), "").cast(pa.binary()).to_pylist()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint64)


def word_codes(batch: pa.RecordBatch, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of a text column end to end, A-Z lower-cased, and how many words each text has."""
    data, off = text_bytes(batch, name)
    code, start, _ = run_codes(data, off, ~_SPACE[data])
    return code, np.diff(np.searchsorted(start, off))


def run_codes(data: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each run of ``inside`` bytes, which ends where a text ends: a 64-bit hash (A-Z lower-cased), its start and size.

    A run's hash scrambles the sum of its scrambled (place, byte) pairs, so that no word becomes an object of its own.
    """
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = off[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    edge = edge[inside[edge] & inside[edge - 1]]  # two texts that touch
    first[edge], last[edge - 1] = True, True
    start = np.flatnonzero(first)
    size = np.flatnonzero(last) + 1 - start
    ends = np.cumsum(size)
    place = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size)
    each = mix64((place.astype(np.uint64) << np.uint64(8)) + _LOWER[data[inside]] + np.uint64(0x9E3779B97F4A7C15))
    run = np.zeros(len(each) + 1, np.uint64)
    np.cumsum(each, out=run[1:])
    return mix64(run[ends] - run[ends - size] + size.astype(np.uint64)), start, size


def span_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values over [offsets[i], offsets[i+1])."""
    run = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=run[1:])
    return run[offsets[1:]] - run[offsets[:-1]]


def list_column(flat: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    off = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), pa.array(flat, type=kind))
