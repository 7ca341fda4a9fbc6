"""Vector codes: parts of vectors replaced by codebook entries that Orchard's search finds.

A vector is cut into equal consecutive parts, each with a codebook of its own. For every
entry of a codebook the others are listed by their distance to it. The search for the entry
nearest to x walks the list of the best entry so far: an entry that is nearer (or as near,
with a lower index) becomes the best, and the walk goes on at the start of its list; entries
already compared are marked and passed over. Once the list has come to entries beyond twice
the current distance, the triangle inequality leaves none that could be as near, and the
best is exact. All distances are squared integers. The walks of a chunk's parts go in step,
one list place a time, as array operations; those that have ended drop out.

Codebooks start as the parts of the vectors with the smallest ids; each round assigns all
parts where they are, and a task sends one row of sums for each entry in use.

Nulls: vectors that are null or hold null or non-finite components are dropped, and so are
those that cannot be cut like the rest: the length coded is the most frequent one (the
smaller of two) that is a multiple of `parts`, and others have no code. Rows without vec_id
are coded and come last as starting entries; vectors with equal ids stand in the order of
their components. With fewer vectors than entries each vector starts one. Rows with a null
label are one label. Repeated rows count each; no vectors give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from passagemill.llm.common import column
from passagemill.llm.vectors import SUMS, GroupSums, floor_means, integer_batches, integer_vectors
from passagemill.operators.joins import lookup
from passagemill.session import stored

SEARCHES = 1 << 16  # walks that go in step


class Codebooks:
    """The entries of all parts, one after the other, and their neighbour lists."""

    def __init__(self, entries: np.ndarray, parts: int) -> None:
        self.entries, self.parts = entries, parts  # (parts x size) x width
        self.size = size = len(entries) // parts
        self.lists, self.reach, self.start = [], [], []
        for part, book in enumerate(entries.reshape(parts, size, -1)):
            gap = ((book[:, None] - book[None]) ** 2).sum(axis=2)
            order = np.argsort(gap, axis=1, kind="stable")
            self.lists.append(order + part * size)
            # an entry ends the walk if its gap exceeds twice the distance, squared: d <= (gap - 1) // 4
            self.reach.append(np.concatenate(
                [(np.take_along_axis(gap, order, axis=1) - 1) >> 2, np.full((size, 1), np.iinfo(np.int64).max)], axis=1))
            self.start.append(part * size + int(gap.max(axis=1).argmin()))  # the most central entry
        self.lists, self.reach = np.concatenate(self.lists), np.concatenate(self.reach)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry (its place among all) and squared distance of each part of each vector."""
        code, away = (np.empty((len(x), self.parts), np.int64) for _ in range(2))
        step = max(1, SEARCHES // self.parts)
        for a in range(0, len(x), step):
            cut = x[a:a + step].reshape(-1, self.entries.shape[1])
            found = self._walks(cut, np.tile(np.array(self.start), len(cut) // self.parts))
            code[a:a + step], away[a:a + step] = (f.reshape(-1, self.parts) for f in found)
        return code, away

    def _walks(self, x: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def squared(rows: np.ndarray, entries: np.ndarray) -> np.ndarray:
            between = x[rows] - self.entries[entries]
            return np.einsum("ij,ij->i", between, between)

        going = np.arange(len(x))
        distance = squared(going, best)
        seen = np.zeros((len(x), self.size), bool)
        seen[going, best % self.size] = True
        place = np.zeros(len(x), np.int64)
        while len(going):
            going = going[distance[going] > self.reach[best[going], place[going]]]
            entry = self.lists[best[going], place[going]]
            place[going] += 1
            fresh = ~seen[going, entry % self.size]
            rows, entry = going[fresh], entry[fresh]
            seen[rows, entry % self.size] = True
            found = squared(rows, entry)
            better = (found < distance[rows]) | (found == distance[rows]) & (entry < best[rows])
            rows = rows[better]
            best[rows], distance[rows], place[rows] = entry[better], found[better], 0
        return best, distance

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def coded_length(vectors: DataFrame, parts: int) -> int:
    """The most frequent length of a vector that `parts` divides; 0 if there is none."""
    sizes = vectors.select(F.size("embedding").alias("n")).where((F.col("n") > 0) & (F.col("n") % parts == 0))
    first = sizes.groupBy("n").count().orderBy(F.desc("count"), "n").first()
    return first.n if first else 0


def fit(vectors: DataFrame, dims: int, parts: int = 16, size: int = 64, rounds: int = 2, factor: int = 256,
        ) -> Codebooks | None:
    """Codebooks of `size` entries for each part, refined in `rounds` rounds over all vectors."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    first = integer_vectors(rows, factor, dims).orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(size).collect()
    if not first:
        return None
    starts = np.array([r.v for r in first], np.int64).reshape(len(first), parts, dims // parts)
    books = Codebooks(np.ascontiguousarray(starts.transpose(1, 0, 2)).reshape(-1, dims // parts), parts)
    for _ in range(rounds):

        def added(batches: Iterator[pa.RecordBatch], books: Codebooks = books) -> Iterator[pa.RecordBatch]:
            sums = GroupSums(*books.entries.shape)
            for _, x in integer_batches(batches, factor, dims):
                code, _ = books.nearest(x)
                sums.add(code.reshape(-1), x.reshape(code.size, -1))
            yield sums.batch()

        books = Codebooks(floor_means(rows.mapInArrow(added, SUMS), books.entries), parts)
    return books


def encode(vectors: DataFrame, books: Codebooks, dims: int, factor: int = 256) -> DataFrame:
    """The rows with a code: all columns but the vector, `code` in hex and `error`.

    Codebooks of more than 256 entries take more hex digits a part.
    """
    others = [c for c in vectors.columns if c not in ("embedding", "code", "error")]
    digits = max(2, len(f"{max(books.size - 1, 0):x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in integer_batches(batches, factor, dims):
            if len(x):
                code, away = books.nearest(x)
                told = ["".join([f"{c:0{digits}x}" for c in row]) for row in (code % books.size).tolist()]
                yield pa.RecordBatch.from_arrays(
                    [*(column(part, c) for c in others), pa.array(told), pa.array(away.sum(axis=1))],
                    [*others, "code", "error"])

    kinds = "".join(f"`{c}` {vectors.schema[c].dataType.simpleString()}, " for c in others)
    return vectors.select(*others, "embedding").mapInArrow(run, f"{kinds}code STRING, error LONG")


def compress(vectors: DataFrame, parts: int = 16, size: int = 64, rounds: int = 2, factor: int = 256) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every coded vector."""
    result = "vec_id LONG, code STRING, error LONG, label_error LONG, codebooks_sha256 STRING"
    dims = coded_length(vectors, parts)
    books = fit(vectors, dims, parts, size, rounds, factor) if dims else None
    if books is None:
        return vectors.sparkSession.createDataFrame([], result)
    # null labels are one label, apart from every text
    label = F.concat(F.lit("="), F.col("label").cast("string"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.coalesce(label, F.lit("")).alias("label"), "embedding")
    coded = stored(encode(rows, books, dims, factor), "codes")
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    return lookup(coded, by_label, "label", is_stored=True).select(
        "vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
