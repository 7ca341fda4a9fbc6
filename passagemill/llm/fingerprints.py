"""Document fingerprints by locally consistent parsing.

A text is a string of symbols, at first its code points. Each level collapses runs of one
symbol, tosses deterministic coins (a symbol's label is the place and value of the lowest
bit in which it differs from its left neighbour; four rounds leave labels 0 to 5), opens a
phrase at each local maximum of the labels and names a phrase by a hash of its symbols.
The names are the next level's symbols. Where a phrase begins depends only on a few
symbols around it, so equal substrings have the same phrases inside, at any offset.

A fingerprint samples the names of the upper levels: for each level the least hash in each
of its bins. Likeness is the share of equal bins among those filled in either fingerprint.

Nulls: a null text counts as empty. An empty text has no phrases and an all-zero
fingerprint; two such have likeness 1. Texts too short for a level give the name of their
whole parse instead. Ties: rows with equal doc_id follow each other by a hash of their
text. With one row the next document is the row itself. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from passagemill.llm.common import (
    CHUNK_BYTES, chunks, code_points, column, id_and_text, mix64, parts_for,
)
from passagemill.session import stored

LEVELS = 4  # parsing levels
BINS = ((1, 16), (2, 24), (3, 24))  # sampled levels (from 0) and the bins of each
N_BINS = sum(n for _, n in BINS)


def _next_label_table(bits: int) -> np.ndarray:
    """Label of (own label, left neighbour's label), for labels of `bits` bits."""
    own, left = np.meshgrid(np.arange(1 << bits), np.arange(1 << bits), indexing="ij")
    differ = own ^ left
    place = np.zeros_like(differ)
    for b in reversed(range(bits)):
        place[differ >> b & 1 == 1] = b
    return (2 * place + (own >> place & 1)).astype(np.uint8).reshape(-1)


TABLES = [(7, _next_label_table(7)), (4, _next_label_table(4)), (3, _next_label_table(3))]


# what a symbol's place in its phrase adds; a phrase has fewer symbols than this
PLACES = np.arange(64, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25)


def _labels(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels 0 to 5; neighbours within a text differ. `first`: where texts begin."""
    differ = np.empty_like(symbols)
    differ[1:] = symbols[1:] ^ symbols[:-1]
    differ[first] = 1  # as if the left neighbour differed in the lowest bit
    lowest = differ & (~differ + np.uint64(1))
    place = (lowest.astype(np.float64).view(np.uint64) >> np.uint64(52)) - np.uint64(1023)
    label = ((place << np.uint64(1)) | (symbols >> place & np.uint64(1))).astype(np.uint8)
    for bits, table in TABLES:
        key = np.empty(len(label), np.uint16)
        key[1:] = label[:-1]
        key[first] = label[first] ^ 1
        key |= label.astype(np.uint16) << np.uint16(bits)
        label = np.take(table, key)
    return label


def _runs(symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of one symbol within a text become one symbol that names symbol and length."""
    fresh = np.ones(len(symbols), bool)
    fresh[1:] = symbols[1:] != symbols[:-1]
    fresh[first] = True
    starts = np.flatnonzero(fresh)
    if len(starts) == len(symbols):
        return symbols, first
    length = np.diff(np.append(starts, len(symbols)))
    kept = symbols[starts]
    long = np.flatnonzero(length > 1)
    kept[long] = mix64(kept[long] + length[long].astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    return kept, np.searchsorted(starts, first)


def parse(symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: the names of the phrases, and where the phrases of each text begin."""
    symbols, first = _runs(symbols, first)
    label = _labels(symbols, first)
    opens = np.zeros(len(symbols), bool)
    opens[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
    opens[first[1:] - 1] = False  # what follows a text's last symbol is another text
    opens[first] = True
    starts = np.flatnonzero(opens)
    place = np.arange(len(symbols)) - np.repeat(starts, np.diff(np.append(starts, len(symbols))))
    parts = mix64(symbols + PLACES[np.minimum(place, len(PLACES) - 1)])
    return mix64(np.add.reduceat(parts, starts)), np.searchsorted(starts, first)


def prints(texts: list[str]) -> np.ndarray:
    """The fingerprint of each text: one row of N_BINS 16-bit values, 0 for an empty bin."""
    points, lengths = code_points(texts)
    out = np.zeros((len(texts), N_BINS), np.uint16)
    filled = np.flatnonzero(lengths)
    symbols, first = points.astype(np.uint64) + np.uint64(1), (np.cumsum(lengths) - lengths)[filled]
    at, bins_of = 0, dict(BINS)
    for level in range(LEVELS):
        if not len(symbols):
            break
        symbols, first = parse(symbols, first)
        if level in bins_of:
            n = bins_of[level]
            key = mix64(symbols + np.uint64(level))
            row = np.repeat(filled, np.diff(np.append(first, len(symbols))))
            slot = row * n + ((key >> np.uint64(40)) % np.uint64(n)).astype(np.int64)
            both = np.sort((slot << 16) | (key & np.uint64(0xFFFF)).astype(np.int64))
            least = np.ones(len(both), bool)
            least[1:] = both[1:] >> 16 != both[:-1] >> 16
            slot = both[least] >> 16
            out[slot // n, at + slot % n] = np.maximum(both[least] & 0xFFFF, 1)
            at += n
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bins among those filled in either, row by row; 1 where none is."""
    filled = (a != 0) | (b != 0)
    n = filled.sum(axis=1)
    return np.where(n == 0, 1.0, ((a == b) & filled).sum(axis=1) / np.maximum(n, 1))


def _hex(rows: np.ndarray) -> list[str]:
    return [r.astype(">u2").tobytes().hex() for r in rows]


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id and the fingerprint of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            yield pa.RecordBatch.from_arrays([
                column(batch, "doc_id"), pa.array(_hex(prints(column(batch, "text").to_pylist())))],
                ["doc_id", "fingerprint"])

    return id_and_text(docs).mapInArrow(run, "doc_id LONG, fingerprint STRING")


def edited(text: str, following: str) -> str:
    """The last half of the text replaced by the beginning of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


OUT = ("doc_id LONG, n_chars LONG, edited_sha256 STRING, fingerprint STRING, "
       "edited_fingerprint STRING, near_edited DOUBLE, near_next DOUBLE")
NAMES = [c.split()[0] for c in OUT.split(", ")]


def _compared(ids: list, texts: list[str], following: list[str], own: np.ndarray, later: np.ndarray) -> dict:
    changed = [edited(t, f) for t, f in zip(texts, following)]
    changed_prints = prints(changed)
    return {
        "doc_id": pa.array(ids, pa.int64()),
        "n_chars": pa.array([len(t) for t in texts], pa.int64()),
        "edited_sha256": pa.array([
            hashlib.sha256(c.encode("utf-8", "surrogatepass")).hexdigest() for c in changed], pa.string()),
        "fingerprint": pa.array(_hex(own), pa.string()),
        "edited_fingerprint": pa.array(_hex(changed_prints), pa.string()),
        "near_edited": pa.array(likeness(own, changed_prints)),
        "near_next": pa.array(likeness(own, later)),
    }


def compare_neighbours(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Each document against its edited text and against the next document by doc_id.

    Documents are sorted into ranges once. A range's last document lacks its successor, so
    each range also hands on its first and last text, one row each, and these few rows are
    matched by the number of their range afterwards.
    """
    ordered = id_and_text(docs).withColumn("_tie", F.xxhash64("text"))
    ordered = ordered.repartitionByRange(parts or parts_for(docs), "doc_id", "_tie") \
        .sortWithinPartitions("doc_id", "_tie").drop("_tie")
    schema = OUT + ", part INT, first_text STRING, last_text STRING"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        first = last = last_id = last_print = None
        for batch in chunks(batches, limit=CHUNK_BYTES // 4):
            ids, texts = column(batch, "doc_id").to_pylist(), column(batch, "text").to_pylist()
            own = prints(texts)
            if first is None:
                first = texts[0]
            else:
                ids, texts, own = [last_id, *ids], [last, *texts], np.concatenate([last_print, own])
            last_id, last, last_print = ids[-1], texts[-1], own[-1:]
            rows = _compared(ids[:-1], texts[:-1], texts[1:], own[:-1], own[1:])
            n = len(texts) - 1
            rows |= {"part": pa.array([part] * n, pa.int32()), "first_text": pa.nulls(n, pa.string()),
                     "last_text": pa.nulls(n, pa.string())}
            yield pa.RecordBatch.from_arrays(list(rows.values()), list(rows))
        if first is not None:
            edge = dict.fromkeys(NAMES) | {
                "doc_id": last_id, "part": part, "first_text": first, "last_text": last}
            yield pa.RecordBatch.from_pylist([edge], pa.schema([
                *((n, {"LONG": pa.int64(), "STRING": pa.string(), "DOUBLE": pa.float64()}[k])
                  for n, k in (c.split() for c in OUT.split(", "))),
                ("part", pa.int32()), ("first_text", pa.string()), ("last_text", pa.string())]))

    rows = stored(ordered.mapInArrow(run, schema), "fingerprints")
    edges = rows.where("last_text IS NOT NULL")
    # one narrow row per range: its number and that of the next range that has rows
    order = Window.orderBy("part")
    follows = edges.select("part").select("part", F.coalesce(
        F.lead("part").over(order), F.min("part").over(Window.partitionBy())).alias("next_part"))
    pairs = edges.select("doc_id", "part", "last_text").join(follows, "part").join(
        edges.select(F.col("part").alias("next_part"), "first_text"), "next_part") \
        .select("doc_id", F.col("last_text").alias("text"), F.col("first_text").alias("following"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            ids, texts, following = (column(batch, c).to_pylist() for c in ("doc_id", "text", "following"))
            found = _compared(ids, texts, following, prints(texts), prints(following))
            yield pa.RecordBatch.from_arrays(list(found.values()), list(found))

    return rows.where("last_text IS NULL").select(*NAMES).unionAll(pairs.mapInArrow(finish, OUT))
