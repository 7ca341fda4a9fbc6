"""One JSON array in one file, read and written by many tasks.

Reading: Spark cuts the file into splits and hands out text between closing braces, but a
task that begins in the middle cannot know whether it stands inside a string or how deep.
So it scans its split under both assumptions, and what comes out is a transition: whether
the string state flips, and for each assumption the change in depth and the number of
closing braces at each relative depth. Composing the transitions of the splits before it
gives every split its true state, depth and number of finished elements. In a second pass a
split emits its elements with their positions; one that crosses borders leaves a fragment
in each split, and fragments of a position are put together.

Writing: elements are sorted by position and written in parallel parts, whose sizes added up
give each part's place; the parts are then joined by the file system, so neither a task nor
the driver holds the list.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from passagemill.session import input_bytes, scratch_path, stored
from passagemill.sources.hadoop import Files

_SCAN = "block LONG, odd INT, depth ARRAY<LONG>, ends ARRAY<MAP<LONG, LONG>>"
_BLANK = b" \t\r\n"


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """The text between closing braces, in order within each split (named by its first byte)."""
    rows = spark.read.option("lineSep", "}").text(path)
    if len(rows.inputFiles()) != 1:
        raise ValueError("one array file at a time: positions count from the start of a file")
    return rows.select("value", F.col("_metadata.file_block_start").alias("block"))


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, bytes]]:
    """(split, whether it begins here, bytes); the brace before a piece comes with it."""
    last = None
    for batch in batches:
        blocks = batch.column(1).to_numpy(zero_copy_only=False)
        for run in np.split(np.arange(len(blocks)), np.flatnonzero(np.diff(blocks)) + 1):
            if len(run):
                block = int(blocks[run[0]])
                text = "}".join(batch.column(0).slice(int(run[0]), len(run)).to_pylist()).encode()
                new, last = block != last, block
                if block or not new:  # only the file's first piece has no brace before it
                    text = b"}" + text
                yield block, new, text


def _structure(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Braces and brackets: their places, +1 or -1, and whether the quotes before are odd in
    number. The last value of the third array is for the end of the data.

    Data begins at the start of the file or behind a brace, so no escape reaches into it.
    """
    a = np.frombuffer(data, np.uint8)
    quotes = np.flatnonzero(a == 34)
    if b"\\" in data and len(quotes):
        other = np.maximum.accumulate(np.where(a != 92, np.arange(len(a)), -1))
        before = np.concatenate([[-1], other])[quotes]
        quotes = quotes[(quotes - 1 - before) % 2 == 0]  # escaped behind an odd run of backslashes
    places = np.flatnonzero((a == 123) | (a == 125) | (a == 91) | (a == 93))
    odd = np.searchsorted(quotes, np.append(places, len(a))) & 1
    return places, np.where((a[places] == 123) | (a[places] == 91), 1, -1), odd


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The transition of each split, for a start outside (0) and inside (1) of a string."""
    found: dict[int, tuple[list[int], list[int], list[dict[int, int]]]] = {}
    for block, _, data in _by_block(batches):
        inside, depth, ends = found.setdefault(block, ([0], [0, 0], [{}, {}]))
        places, steps, odd = _structure(data)
        closing = np.frombuffer(data, np.uint8)[places] == 125
        for start in (0, 1):
            outside = odd[:-1] ^ inside[0] ^ start == 0
            levels = depth[start] + np.cumsum(steps[outside])
            for level, n in zip(*np.unique(levels[closing[outside]], return_counts=True)):
                ends[start][int(level)] = ends[start].get(int(level), 0) + int(n)
            if len(levels):
                depth[start] = int(levels[-1])
        inside[0] ^= int(odd[-1])
    yield pa.RecordBatch.from_arrays([
        pa.array(list(found), pa.int64()), pa.array([v[0][0] for v in found.values()], pa.int32()),
        pa.array([v[1] for v in found.values()], pa.list_(pa.int64())),
        pa.array([[list(m.items()) for m in v[2]] for v in found.values()], pa.list_(pa.map_(pa.int64(), pa.int64()))),
    ], ["block", "odd", "depth", "ends"])


def starts_of(transitions: list) -> dict[int, tuple[int, int, int]]:
    """Composition over the splits: string state, depth and finished elements where each begins."""
    out, state, depth, done = {}, 0, 0, 0
    for t in sorted(transitions, key=lambda t: t.block):
        out[t.block] = state, depth, done
        done += t.ends[state].get(1 - depth, 0)
        depth, state = depth + t.depth[state], state ^ t.odd
    if state or depth or not out:
        raise ValueError("the file does not hold one whole JSON array")
    return out


def _element(text: bytes, first: bool) -> bytes:
    """An element without what separates it from the one before."""
    text = text.strip(_BLANK)
    mark, rest = text[:1], text[1:].lstrip(_BLANK)
    if mark != (b"[" if first else b",") or rest[:1] != b"{":
        raise ValueError(f"no array of objects: {text[:40]!r}")
    return rest


def read_json_array(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """(position, element) of every object of the array in one file; malformed text is an error.

    The first pass runs at once; splits, and with them tasks, follow the session's
    maxPartitionBytes. Of each split the driver keeps three numbers. Elements may nest; an
    array with anything but objects is refused. An object is held whole by one task, and so
    is text between two closing braces.
    """
    pieces = _pieces(spark, path)
    starts = starts_of(pieces.mapInArrow(_scan, _SCAN).collect())
    last = max(starts, default=0)

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """position, split and text; whole elements and, beside them, fragments."""
        def sent(rows: list[tuple[int, bytes]], block: int, whole: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([
                pa.array([p for p, _ in rows], pa.int64()), pa.array([block] * len(rows), pa.int64()),
                pa.array([t.decode() for _, t in rows], pa.string()), pa.array([whole] * len(rows), pa.bool_())],
                ["position", "block", "text", "whole"])

        block, open_, cut, state, depth, done = None, [], False, 0, 0, 0
        for now, new, data in _by_block(batches):
            if new:
                if block is not None and (rest := b"".join(open_)).strip(_BLANK):
                    yield from _rest(rest, block, done, sent, last, depth)
                if now not in starts:
                    raise RuntimeError("the file or the size of splits has changed since the first pass")
                block, open_ = now, []
                state, depth, done = starts[now]
                cut = depth > 1  # the first element to end here began in an earlier split
            places, steps, odd = _structure(data)
            outside = odd[:-1] ^ state == 0
            levels = depth + np.cumsum(steps[outside])
            places = places[outside]
            ends = places[(levels == 1) & (steps[outside] == -1)] + 1
            at, whole, fragment = 0, [], []
            for end in ends.tolist():
                text = b"".join([*open_, data[at:end]])
                open_ = []
                if cut:
                    fragment.append((done, text))
                else:
                    whole.append((done, _element(text, done == 0)))
                cut, at, done = False, end, done + 1
            open_.append(data[at:])
            if whole:
                yield sent(whole, block, True)
            if fragment:
                yield sent(fragment, block, False)
            state ^= int(odd[-1])
            depth = int(levels[-1]) if len(levels) else depth
        if block is not None:
            yield from _rest(b"".join(open_), block, done, sent, last, depth)

    found = pieces.mapInArrow(elements, "position LONG, block LONG, text STRING, whole BOOLEAN")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_element("".join(t["text"] for t in parts).encode(), position == 0).decode()
                     for position, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["position", "text"])

    parts = found.where("NOT whole").groupBy("position").agg(
        F.array_sort(F.collect_list(F.struct("block", "text"))).alias("parts"))
    texts = found.where("whole").select("position", "text").unionAll(
        parts.mapInArrow(joined, "position LONG, text STRING"))
    return texts.select("position", F.from_json("text", schema, {"mode": "FAILFAST"}).alias("element"))


def _rest(rest: bytes, block: int, done: int, sent, last: int, depth: int) -> Iterator[pa.RecordBatch]:
    """What a split holds behind its last whole element: a fragment, or the end of the array."""
    if block == last:
        if rest.strip(_BLANK).lstrip(b"[" if done == 0 else b"").strip(_BLANK) != b"]":
            raise ValueError(f"no array of objects: it ends in {rest[-40:]!r}")
    elif rest.strip(_BLANK):
        yield sent([(done, rest)], block, False)


def write_json_list(
    df: DataFrame, path: str, position: str, overwrite: bool = False, part_bytes: int = 256 << 20,
) -> list[tuple[int, int]]:
    """All columns but `position` as one JSON list in one file, by ascending position.

    Positions must differ and not be null. Returns (first byte, bytes) of every part, where
    readers may begin. An existing file is an error unless `overwrite`, which replaces it at
    once when the new one is whole. The file system joins the parts: HDFS by renaming their
    blocks, the local one by copying; one that can do neither is an error.
    """
    spark = df.sparkSession
    files = Files(spark, path)
    if files.exists() and not overwrite:
        raise FileExistsError(path)
    text = F.to_json(F.struct(*[F.col(c) for c in df.columns if c != position]), {"ignoreNullFields": "false"})
    lines = stored(df.select(F.col(position).alias("position"), text.alias("text")), "json-lines")
    n, first, placed = lines.agg(F.count("*"), F.min("position"), F.count("position")).first()
    if placed < n or n and lines.where(F.col("position") == F.lit(first)).count() > 1:
        raise ValueError(f"{position} has nulls or repeated values")
    folder = scratch_path(spark, "json-list")
    mark = F.when(F.col("position") == F.lit(first), F.lit("[")).otherwise(F.lit(","))
    lines.repartitionByRange(max(1, -(-input_bytes(lines) // part_bytes)), "position").sortWithinPartitions(
        "position").select(F.concat(mark, "text")).write.text(folder)
    parts = [p for p in Files(spark, folder).listed() if p[0].startswith("part-")]
    end = "]\n" if n else "[]\n"
    Files(spark, f"{folder}/part-end").write(end)
    sizes = [size for _, size in parts] + [len(end)]
    files.joined_from([f"{folder}/{name}" for name, _ in parts] + [f"{folder}/part-end"])
    return list(zip(accumulate([0, *sizes[:-1]]), sizes))
