"""What the operators share: reading tables, cutting lineage, checked broadcasts and runs of equal keys in Arrow batches."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast only if its rows take at most this many bytes; beyond it, Spark joins by shuffling.
BROADCAST_BYTES = 24 << 20

WORDS = "coalesce(regexp_count({}, '[^ \\\\t\\\\n\\\\r]+'), 0)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see; one is made only on a local master that names none, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes df in the shared folder and reads it again: lineage is cut, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Removes stored tables that nothing which is still to run reads."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fits(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether a stored table's rows, counted from Parquet footers, stay within what may be broadcast."""
    return df.count() * row_bytes <= limit


def bounded_broadcast(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it fits; else df as it is."""
    return F.broadcast(df) if fits(df, row_bytes, limit) else df


def packed(df: DataFrame) -> DataFrame:
    """df's rows as one struct ``row``, so that no column that is added later can clash with theirs."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def sliced(batches: Iterable[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of whole rows with about ``limit`` bytes in a string column, so that memory stays bounded."""
    for batch in batches:
        sizes = np.cumsum(np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.float64)))
        start = 0
        while start < batch.num_rows:
            base = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, base + limit, "right")))
            yield batch.slice(start, end - start)
            start = end


def runs(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole runs of equal keys, many runs each, from batches sorted by key (never null)."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(key)
        cut = _first_of_last(column)
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        elif held and held[-1].column(key)[-1] != column[0]:
            yield pa.Table.from_batches(held)
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _first_of_last(column: pa.Array) -> int:
    """Index at which the last run of equal values begins."""
    low, high, last = 0, len(column) - 1, column[-1]
    while low < high:
        mid = (low + high) // 2
        if column[mid] == last:
            high = mid
        else:
            low = mid + 1
    return low


def bounds(keys: np.ndarray) -> np.ndarray:
    """Offsets at which runs of equal values begin, and the length."""
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]).astype(np.int64)


def binary_matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Rows of equal-length binary values as a matrix of bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.cast(pa.large_binary()).buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]].reshape(len(column), width) if len(column) else np.zeros((0, width), np.uint8)


def binary_column(matrix: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    matrix = np.ascontiguousarray(matrix)
    n, width = len(matrix), matrix.shape[1] * matrix.itemsize if matrix.ndim > 1 else matrix.itemsize
    offsets = np.arange(n + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(matrix.tobytes())])
