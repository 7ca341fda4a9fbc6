"""Token ids in Arrow files of equal-length sequences.

Documents are sorted by doc_id into ranges. Each task writes the ids of its range, an end
id after every document, as one Arrow IPC file of record batches with two columns:
`input_ids`, a fixed-size list of `length` ids (16 bits each where the vocabulary allows),
and `mask`, a fixed-size list of booleans that is false on the padding of a file's last
sequence. Every sequence but the last of a file is full, so place n of the id stream sits
at row n // length of a known batch and a memory map reads it without copying. The
documents' places are in a second Arrow file beside it. A global start is the place in the
file plus the ids of all files before it.

Nulls: a null text is empty and is written as its end id. Rows without doc_id come first.
Rows with equal ids follow each other in the order of a hash of their text. An empty table
gives an empty manifest and no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from passagemill.llm.common import (
    CHUNK_BYTES, chunks, column, filesystem, id_and_text, parts_for, shared_folder, write_once,
)
from passagemill.llm.tokens import default_tokenizer, encoder

ROWS_PER_BATCH = 64  # sequences of one record batch


def _fixed(values: np.ndarray, length: int) -> pa.FixedSizeListArray:
    return pa.FixedSizeListArray.from_arrays(pa.array(values), length)


class SequenceWriter:
    """Cuts a stream of ids into fixed-size lists and writes them as record batches."""

    def __init__(self, out, length: int, dtype: np.dtype) -> None:
        self.length, self.dtype = length, dtype
        item = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([
            ("input_ids", pa.list_(pa.field("item", item), length)),
            ("mask", pa.list_(pa.field("item", pa.bool_()), length))])
        self.sink = pa.ipc.new_file(out, self.schema)
        self.rest = np.empty(0, dtype)

    def _write(self, ids: np.ndarray, n: int) -> None:
        self.sink.write_batch(pa.RecordBatch.from_arrays(
            [_fixed(ids, self.length), _fixed(np.arange(len(ids)) < n, self.length)], schema=self.schema))

    def add(self, ids: np.ndarray) -> None:
        ids = np.concatenate([self.rest, ids.astype(self.dtype)])
        step = self.length * ROWS_PER_BATCH
        whole = len(ids) // step * step
        for a in range(0, whole, step):
            self._write(ids[a:a + step], step)
        self.rest = ids[whole:]

    def close(self) -> None:
        n = len(self.rest)
        if n:
            padded = np.zeros(-(-n // self.length) * self.length, self.dtype)
            padded[:n] = self.rest
            self._write(padded, n)
        self.sink.close()


def write_sequences(docs: DataFrame, length: int = 2048, tokenizer: str | None = None, end_id: int = 2,
                    parts: int | None = None) -> DataFrame:
    """Write all documents; the manifest: part, path, index_path, n_docs, n_ids.

    Files have names of their task attempt, so a repeated task does no harm: the manifest
    names only the files of attempts that counted.
    """
    spark = docs.sparkSession
    path, folder = tokenizer or default_tokenizer(), shared_folder(spark, "sequences")
    ranges = parts or parts_for(docs, 24 << 20)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        dtype = np.dtype(np.uint16 if own.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)
        ids_of, sizes = [], []

        def write(out) -> None:
            writer = SequenceWriter(out, length, dtype)
            for batch in chunks(batches, limit=CHUNK_BYTES // 2):
                ids, counts = own.encode(column(batch, "text"))
                writer.add(np.insert(ids, np.cumsum(counts), end_id))
                ids_of.append(column(batch, "doc_id"))
                sizes.append(counts + 1)
            writer.close()

        part = TaskContext.get().partitionId()
        data = write_once(folder, f"ids-{part}", write)
        if not sizes:
            return
        n = np.concatenate(sizes)
        index = pa.record_batch({
            "doc_id": pa.concat_arrays(ids_of), "start": pa.array(np.cumsum(n) - n), "n_tokens": pa.array(n)})

        def write_index(out) -> None:
            with pa.ipc.new_file(out, index.schema) as sink:
                sink.write_batch(index)

        yield pa.record_batch({
            "part": pa.array([part], pa.int32()), "path": [data],
            "index_path": [write_once(folder, f"docs-{part}", write_index)],
            "n_docs": [len(n)], "n_ids": [int(n.sum())]})

    ordered = id_and_text(docs).withColumn("_tie", F.xxhash64("text")) \
        .repartitionByRange(ranges, "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").drop("_tie")
    rows = ordered.mapInArrow(
        run, "part INT, path STRING, index_path STRING, n_docs LONG, n_ids LONG").collect()
    return spark.createDataFrame(
        sorted(rows), "part INT, path STRING, index_path STRING, n_docs LONG, n_ids LONG")


class SequenceFile:
    """Random access to one file: the ids of any stretch of its stream, without copying
    where the file is local and the stretch lies in one record batch."""

    def __init__(self, path: str) -> None:
        files, local = filesystem(path)
        self.source = pa.memory_map(local) if files.type_name == "local" else files.open_input_file(local)
        self.reader = pa.ipc.open_file(self.source)
        self.length = self.reader.schema.field("input_ids").type.list_size
        self.step = self.length * ROWS_PER_BATCH
        self.kept: tuple[int, np.ndarray] = (-1, np.empty(0))

    def _batch(self, k: int) -> np.ndarray:
        if self.kept[0] != k:
            column_ = self.reader.get_batch(k).column(0)
            self.kept = (k, column_.flatten().to_numpy())
        return self.kept[1]

    def ids(self, start: int, n: int) -> np.ndarray:
        """`n` ids from place `start` on."""
        parts = []
        while n:
            k, at = divmod(start, self.step)
            taken = self._batch(k)[at:at + n]
            parts.append(taken)
            start, n = start + len(taken), n - len(taken)
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    def sequence(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of one equal-length sequence."""
        k, at = divmod(row, ROWS_PER_BATCH)
        batch = self.reader.get_batch(k)
        return tuple(batch.column(c)[at].values.to_numpy(zero_copy_only=False) for c in (0, 1))

    def close(self) -> None:
        self.source.close()


def read_documents(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read from the files.

    One task reads one file; its base is the sum of the manifest's files before it, which
    has one row per file.
    """
    rows = manifest.orderBy("part").collect()
    bases = np.cumsum([0, *[r.n_ids for r in rows]]).tolist()
    files = spark.createDataFrame(
        [(r.path, r.index_path, b) for r, b in zip(rows, bases)], "path STRING, index_path STRING, base LONG")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                place, local = filesystem(row["index_path"])
                with place.open_input_file(local) as source:
                    index = pa.ipc.open_file(source).get_batch(0)
                data = SequenceFile(row["path"])
                crc = [
                    zlib.crc32(np.ascontiguousarray(data.ids(s, n), "<u4"))
                    for s, n in zip(index["start"].to_pylist(), index["n_tokens"].to_pylist())]
                data.close()
                yield pa.RecordBatch.from_arrays([
                    index["doc_id"], pa.array(index["start"].to_numpy() + row["base"]), index["n_tokens"],
                    pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.repartition(max(1, len(rows))).mapInArrow(
        run, "doc_id LONG, start LONG, n_tokens LONG, ids_crc32 LONG")
