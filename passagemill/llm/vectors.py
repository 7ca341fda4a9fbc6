"""Integer vectors out of arrays of floats, and componentwise sums by group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from passagemill.llm.common import column

LIMIT = 1 << 27  # components beyond it could overflow a 64-bit sum of products; they are refused
ELEMENTS = 1 << 20  # components in a chunk


def integer_rows(lists: pa.Array, factor: int, dims: int, pad: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the rows whose `dims` components are all finite, and their floor(factor * x).

    Null vectors, null or non-finite components and other lengths leave a row out; with `pad`
    shorter vectors end in zeros.
    """
    sizes = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
    right = np.flatnonzero((sizes >= 0) & (sizes <= dims) if pad else sizes == dims)
    values = lists.take(pa.array(right)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = np.zeros((len(right), dims))
    x[np.arange(dims) < sizes[right, None]] = values  # nulls have become NaN
    finite = np.isfinite(x).all(axis=1)
    x = np.floor(x[finite] * factor)
    if x.size and max(x.max(), -x.min()) > LIMIT:
        raise ValueError(f"a vector component beyond {LIMIT} after scaling by {factor}")
    return right[finite], x.astype(np.int64)


def integer_batches(
    batches: Iterator[pa.RecordBatch], factor: int, dims: int, name: str = "embedding", pad: bool = False,
) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Bounded slices of the batches without the rows left out, each with its integer vectors."""
    step = max(1, ELEMENTS // max(dims, 1))
    for batch in batches:
        for start in range(0, batch.num_rows, step):
            part = batch.slice(start, step)
            rows, x = integer_rows(column(part, name), factor, dims, pad)
            yield part.take(pa.array(rows)), x


def integer_vectors(rows: DataFrame, factor: int, dims: int, name: str = "embedding", pad: bool = False) -> DataFrame:
    """The kept rows: all columns but `name`, and `v`, an array of longs."""
    others = [c for c in rows.columns if c != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in integer_batches(batches, factor, dims, name, pad):
            yield pa.RecordBatch.from_arrays(
                [*(column(part, c) for c in others), as_lists(x)], [*others, "v"])

    kinds = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in others)
    return rows.mapInArrow(run, f"{kinds}v ARRAY<BIGINT>")


def as_lists(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as Arrow lists."""
    return pa.ListArray.from_arrays(
        pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1)))


def as_matrix(lists: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """Arrow lists of equal length as the rows of a matrix."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), dims)


class GroupSums:
    """Number and componentwise sum of the vectors of each group, added up within a task."""

    def __init__(self, groups: int, dims: int) -> None:
        self.sums = np.zeros((groups, 1 + dims), np.int64)

    def add(self, group: np.ndarray, x: np.ndarray) -> None:
        if len(group):
            order = np.argsort(group, kind="stable")
            names, starts = np.unique(group[order], return_index=True)
            self.sums[names, 0] += np.diff([*starts, len(group)])
            self.sums[names, 1:] += np.add.reduceat(x[order], starts, axis=0)

    def batch(self) -> pa.RecordBatch:
        """One row for each group that has vectors; the schema is SUMS."""
        used = np.flatnonzero(self.sums[:, 0])
        return pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), as_lists(self.sums[used])], ["grp", "sums"])


SUMS = "grp INT, sums ARRAY<BIGINT>"


def floor_means(sums: DataFrame, old: np.ndarray) -> np.ndarray:
    """The componentwise floor(sum / count) of each group; groups without vectors stay.

    Sums are added up on the executors; groups x (components + 1) numbers reach the driver.
    """
    new = old.copy()
    whole = sums.select("grp", F.posexplode("sums").alias("pos", "x")).groupBy("grp", "pos").agg(F.sum("x").alias("x"))
    table = whole.toArrow()
    total = np.zeros((len(old), old.shape[1] + 1), np.int64)
    total[table["grp"].to_numpy(), table["pos"].to_numpy()] = table["x"].to_numpy()
    used = total[:, 0] > 0
    new[used] = total[used, 1:] // total[used, :1]
    return new
