"""What the operators share: table access, bounded text chunks, the shared folder."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from passagemill.session import input_bytes, shared_dir
from passagemill.sources.hadoop import Files

# Executors need not have this package installed: its functions travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__package__.partition(".")[0]])

CHUNK_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """The two columns most operators need; a null text becomes an empty one."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"))


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """Rows kept away from training: crc32 of the id as text leaves 1 modulo 3."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string")) % 3 == 1, F.lit(False))


def chunks(
    batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES,
) -> Iterator[pa.RecordBatch]:
    """Slices of at most `limit` text bytes (or one row), whatever the batch size."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(
            batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, n in enumerate(sizes):
            if i > start and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        if len(sizes) > start:
            yield batch.slice(start)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def worker_state(name: str, make: Callable[[], Any]) -> Any:
    """One object per Python worker, kept from task to task."""
    holder = sys.modules.setdefault("_passagemill_worker", types.ModuleType("_passagemill_worker"))
    if not hasattr(holder, name):
        setattr(holder, name, make())
    return getattr(holder, name)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of SplitMix64: a bijective scrambling of unsigned 64-bit values."""
    x = np.array(x, np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indexes of all ranges start..start+length, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the texts in one array, and the length of each text."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    joined = "".join(texts).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(joined, np.uint32), lengths


def row_of(lengths: np.ndarray) -> np.ndarray:
    """For each element of the concatenation, the number of the text it came from."""
    return np.repeat(np.arange(len(lengths)), lengths)


def sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sum of each text's elements; empty texts give zero."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    ends = np.cumsum(lengths)
    return total[ends] - total[ends - lengths]


def parts_for(df: DataFrame, bytes_each: int = 16 << 20, least: int = 8) -> int:
    return max(least, -(-input_bytes(df) // bytes_each))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, for files that tasks write; a URI that names
    its file system, as Spark resolves the setting."""
    return str(Files(spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"))


# file systems that Spark and Arrow name differently
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss", "gcs": "gs"}


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI as Hadoop writes it, and the path in it: local, HDFS (viewfs
    too), S3, Google or Azure storage."""
    scheme, _, rest = path.partition(":")
    if scheme == "dbfs":  # mounted on every machine
        return fs.LocalFileSystem(), f"/dbfs{rest}"
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    if "://" not in path:
        raise ValueError(f"{path} does not name its file system")
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{rest}")


def write_once(folder: str, name: str, write: Callable[[Any], None]) -> str:
    """Write a file under a name of this attempt alone; the caller passes the path on.

    A repeated task writes another file, and only paths that reach the driver are read.
    """
    files, root = filesystem(folder)
    files.create_dir(root, recursive=True)
    own = f"{name}-{uuid.uuid4().hex}.arrow"
    with files.open_output_stream(f"{root}/{own}") as out:
        write(out)
    return f"{folder}/{own}"
