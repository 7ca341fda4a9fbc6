"""Line dedup by sharded minimal perfect hashes.

Lines that occur in two documents or more stay only in the document with the smallest id.
One aggregation over line hashes finds the repeated ones. They are cut into shards by
hash; each shard becomes a minimal perfect hash (levels of bit arrays; a key sits on the
first level where it hits a bit alone) that indexes flat arrays: a 64-bit fingerprint, the
number of documents and the id that keeps the line. Shards are files in the shared folder.
Documents then probe the arrays, chunk by chunk and shard by shard, so lines are never
joined with documents and a task holds one shard at a time.

A line's key is the line without ASCII white space at its ends, ASCII letters lower-cased.
Keys shorter than `min_chars` code points are never dropped.

Nulls: a null text is one empty line; a null doc_id counts as larger than any other, and
all rows without an id count as one document. Rows that share a doc_id count as one
document too. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from passagemill.llm.common import (
    chunks, column, filesystem, mix64, shared_folder, worker_state, write_once,
)
from passagemill.session import stored

KEYS_PER_SHARD = 250_000
NO_ID = np.iinfo(np.int64).max
SPACES = b" \t\n\x0b\x0c\r"
HELD_SHARDS = 4  # shards a worker keeps open


def line_keys(line: bytes, min_chars: int) -> bytes | None:
    """The key of a line, or None if it is too short to be dropped."""
    key = line.strip(SPACES).lower()
    if len(key) < min_chars:
        return None
    if len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return key


def text_lines(texts: list[str | None], min_chars: int) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """The lines of each text; two 64-bit hashes per line, (0, 0) for keys that are too short."""
    lines = [(t or "").encode("utf-8", "surrogatepass").split(b"\n") for t in texts]
    hashed = bytearray()
    digest = xxhash.xxh3_128_digest
    for text in lines:
        for line in text:
            key = line_keys(line, min_chars)
            hashed += digest(key) if key is not None else bytes(16)
    both = np.frombuffer(bytes(hashed), np.uint64).reshape(-1, 2)
    return lines, both[:, 0].copy(), both[:, 1].copy()


@dataclass
class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys, and lookups into 0..n-1."""

    levels: list[np.ndarray]  # packed bits

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], np.array(keys, np.uint64)
        while len(left):
            size = -(-max(8, len(left) * 3 // 2) // 8) * 8
            at = cls._places(left, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone))
            left = left[~alone[at]]
        return cls(levels)

    @staticmethod
    def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix64(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)) % np.uint64(size)).astype(np.int64)

    def opened(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each level its bits and the index that each set bit stands for."""
        out, base = [], 0
        for packed in self.levels:
            bits = np.unpackbits(packed).astype(bool)
            out.append((bits, np.cumsum(bits) - 1 + base))
            base += int(bits.sum())
        return out

    @classmethod
    def find(cls, opened: list[tuple[np.ndarray, np.ndarray]], keys: np.ndarray) -> np.ndarray:
        """The index of each key; -1 where no level has a bit (never for a built key)."""
        found = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (bits, index) in enumerate(opened):
            at = cls._places(keys[left], level, len(bits))
            hit = bits[at]
            found[left[hit]] = index[at[hit]]
            left = left[~hit]
        return found


def write_shard(folder: str, shard: int, key: np.ndarray, check: np.ndarray, count: np.ndarray, keeper: np.ndarray) -> str:
    """Write one shard: an Arrow file with the levels and the three arrays."""
    table = PerfectHash.build(key)
    at = PerfectHash.find(table.opened(), key)
    order = np.empty(len(key), np.int64)
    order[at] = np.arange(len(key))
    parts = pa.record_batch({
        "levels": pa.array([[x.tobytes() for x in table.levels]], pa.list_(pa.binary())),
        "check": pa.array([check[order].tobytes()], pa.large_binary()),
        "count": pa.array([np.minimum(count[order], 2**32 - 1).astype(np.uint32).tobytes()], pa.large_binary()),
        "keeper": pa.array([keeper[order].tobytes()], pa.large_binary()),
    })

    def write(out) -> None:
        with pa.ipc.new_file(out, parts.schema) as sink:
            sink.write_batch(parts)

    return write_once(folder, f"shard-{shard}", write)


def read_shard(path: str) -> tuple[list, np.ndarray, np.ndarray]:
    files, local = filesystem(path)
    with files.open_input_file(local) as source:
        row = pa.ipc.open_file(source).get_batch(0).to_pylist()[0]
    levels = PerfectHash([np.frombuffer(x, np.uint8) for x in row["levels"]])
    return levels.opened(), np.frombuffer(row["check"], np.uint64), np.frombuffer(row["keeper"], np.int64)


class Shards:
    """Shard files, a few of them open at a time."""

    def __init__(self) -> None:
        self.open: OrderedDict[str, tuple] = OrderedDict()

    def get(self, path: str) -> tuple:
        if path in self.open:
            self.open.move_to_end(path)
        else:
            while len(self.open) >= HELD_SHARDS:
                self.open.popitem(last=False)
            self.open[path] = read_shard(path)
        return self.open[path]


def keepers(shards: Shards, paths: list[str | None], key: np.ndarray, check: np.ndarray) -> np.ndarray:
    """For each line the doc_id that keeps it, or -1 - NO_ID where the line is not repeated."""
    out = np.full(len(key), -1 - NO_ID, np.int64)
    if not paths:
        return out
    shard = (mix64(key) % np.uint64(len(paths))).astype(np.int64)
    asked = (key != 0) | (check != 0)
    for s in np.unique(shard[asked]):
        if paths[s] is None:
            continue
        rows = np.flatnonzero(asked & (shard == s))
        opened, known, keeper = shards.get(paths[s])
        at = PerfectHash.find(opened, key[rows])
        hit = at >= 0
        hit[hit] = known[at[hit]] == check[rows[hit]]
        out[rows[hit]] = keeper[at[hit]]
    return out


def repeated_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """key, check, count (documents), keeper (smallest id) of lines of two documents or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            ids = np.array([NO_ID if i is None else i for i in column(batch, "doc_id").to_pylist()], np.int64)
            lines, key, check = text_lines(column(batch, "text").to_pylist(), min_chars)
            doc = np.repeat(ids, [len(x) for x in lines])
            asked = np.flatnonzero((key != 0) | (check != 0))
            # a line that one document has twice counts once for it
            once = np.unique(mix64(key[asked] ^ mix64(doc[asked].view(np.uint64))), return_index=True)[1]
            seen = asked[np.sort(once)]
            out = [key[seen].view(np.int64), check[seen].view(np.int64), doc[seen]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["key", "check", "doc"])

    pairs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text") \
        .mapInArrow(run, "key LONG, check LONG, doc LONG")
    return pairs.groupBy("key", "check").agg(
        F.count("*").alias("count"), F.min("doc").alias("keeper"), F.max("doc").alias("_last"),
    ).where("keeper < _last").drop("_last")


def build_shards(docs: DataFrame, min_chars: int = 10, keys_per_shard: int = KEYS_PER_SHARD) -> list[str | None]:
    """Write the shards of all repeated lines; the path of each shard (None: no key)."""
    spark = docs.sparkSession
    lines = stored(repeated_lines(docs, min_chars), "repeated-lines")
    total = lines.count()
    if not total:
        return []
    shards = -(-total // keys_per_shard)
    folder = shared_folder(spark, "line-shards")

    def shard_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = column(batch, "key").to_numpy().view(np.uint64)
            number = (mix64(key) % np.uint64(shards)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(number)], [*batch.schema.names, "shard"])

    def build(group: pa.Table) -> pa.Table:
        key = group["key"].to_numpy().view(np.uint64)
        # of two lines whose 64-bit keys are equal (the check values then differ) one is
        # indexed and the other stays in its documents: n * n / 2**65 such pairs are expected
        first = np.sort(np.unique(key, return_index=True)[1])
        shard = group["shard"][0].as_py()
        path = write_shard(folder, shard, key[first], group["check"].to_numpy().view(np.uint64)[first],
                           group["count"].to_numpy()[first], group["keeper"].to_numpy()[first])
        return pa.table({"shard": pa.array([shard], pa.int32()), "path": [path]})

    written = lines.mapInArrow(shard_of, "key LONG, check LONG, count LONG, keeper LONG, shard INT") \
        .groupBy("shard").applyInArrow(build, "shard INT, path STRING").collect()
    path_of = {r.shard: r.path for r in written}
    return [path_of.get(s) for s in range(shards)]


def _probe(batch: pa.RecordBatch, paths: list[str | None], min_chars: int):
    """The lines of each text, and for each line whether it is dropped."""
    ids = np.array([NO_ID if i is None else i for i in column(batch, "doc_id").to_pylist()], np.int64)
    lines, key, check = text_lines(column(batch, "text").to_pylist(), min_chars)
    sizes = np.array([len(x) for x in lines], np.int64)
    keeper = keepers(worker_state("line_shards", Shards), paths, key, check)
    return lines, np.split((keeper >= 0 - NO_ID) & (keeper != np.repeat(ids, sizes)), np.cumsum(sizes)[:-1])


def drop_report(docs: DataFrame, paths: list[str | None], min_chars: int = 10) -> DataFrame:
    """doc_id, n_lines, n_dropped and the hash of what stays, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            lines, dropped = _probe(batch, paths, min_chars)
            kept = [b"\n".join(x for x, d in zip(text, gone) if not d) for text, gone in zip(lines, dropped)]
            yield pa.RecordBatch.from_arrays([
                column(batch, "doc_id"),
                pa.array([len(x) for x in lines], pa.int64()),
                pa.array([int(d.sum()) for d in dropped], pa.int64()),
                pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
            ], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id LONG, n_lines LONG, n_dropped LONG, kept_sha256 STRING")


def drop_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """`docs` without repeated lines; n_chars, if there, follows the new text.

    All other columns stay as they are; a null text stays null.
    """
    paths = build_shards(docs, min_chars)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            lines, dropped = _probe(batch, paths, min_chars)
            old = column(batch, "text").to_pylist()
            new = [
                o if o is None or not gone.any() else
                b"\n".join(x for x, d in zip(text, gone) if not d).decode("utf-8", "surrogatepass")
                for o, text, gone in zip(old, lines, dropped)]
            columns = list(batch.columns)
            names = batch.schema.names
            columns[names.index("text")] = pa.array(new, column(batch, "text").type)
            if "n_chars" in names:
                old_n = column(batch, "n_chars")
                columns[names.index("n_chars")] = pa.array(
                    [n if o is None else len(t) for n, o, t in zip(old_n.to_pylist(), old, new)], old_n.type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, schema)
