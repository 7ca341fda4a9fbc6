"""Benchmark decontamination: windows of documents within a small edit distance of an item.

Text is compared as lower-case ASCII letters, other bytes as they are, with each run of
ASCII white space as one space. The CGK random walk embeds a string so that edit distance
becomes Hamming distance: step j writes the byte under the pointer and moves the pointer
on by a random bit that depends on j and on that byte. All windows that start at a word,
in items and in documents, are embedded with the same walk, and those that start at any
character beyond ASCII or right behind one, since many scripts put no space between words.
Each of `repeats` LSH tables samples positions of the embedding and compares the sampled bytes. A hit lines an item up
with its place in the document, where the item-sized window is verified with the exact
edit distance (bit-parallel, the best end within reach). A copy without edits hits on
every table; one with edits needs one stretch of the item that a table samples unharmed.

The query set (the benchmark) goes to the tasks in blocks of `block_items` items, each a
scan over all documents, so no block grows with either table.

Nulls: rows of the benchmark with a null or blank text match nothing; a null document text
is empty. Rows without doc_id are searched and reported with a null id. Repeated items are
reported one by one, repeated rows too; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from passagemill.llm.common import chunks, column, id_and_text, mix64, spans

SCALES = (56, 14, 4, 1)  # steps of the walk; a window needs as many bytes
GATE_BITS = 20
RESULT = "doc_id LONG, item_id LONG, start LONG, length LONG, edits INT"


def normal_bytes(text: str) -> bytes:
    return b" ".join(text.encode("utf-8", "surrogatepass").lower().split())


def window_starts(data: np.ndarray) -> np.ndarray:
    """Where windows begin in bytes whose only ASCII white space is single spaces.

    At words, at every character that is not ASCII, and at an ASCII one right behind such.
    """
    before = np.concatenate([np.full(1, 32, np.uint8), data[:-1]])[:len(data)]
    return np.flatnonzero((before == 32) | (data >= 0xC0) | (before >= 0x80) & (data < 0x80) & (data != 32))


def edit_window(item: bytes, text: bytes) -> tuple[int, int]:
    """Least edit distance of the item to any part of the text, and where that part ends.

    Myers' bit-vector recurrence on whole Python integers; the first best end counts.
    """
    m = len(item)
    at: dict[int, int] = {}
    for i, c in enumerate(item):
        at[c] = at.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text, 1):
        eq = at.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | (~(xh | plus) & full)
        mh = plus & xh
        score += 1 if ph & top else -1 if mh & top else 0
        ph, mh = (ph << 1) & full, (mh << 1) & full  # a match may begin anywhere
        plus = mh | (~(xv | ph) & full)
        minus = ph & xv
        if score < best:
            best, end = score, j
    return best, end


@dataclass
class Index:
    """Sampled embeddings of a block of items."""

    items: list[tuple[int | None, bytes]]
    repeats: int
    samples: int
    max_share: float
    seed: int = 7

    def __post_init__(self) -> None:
        rng = np.random.default_rng(self.seed)
        moves = rng.integers(0, 2, (max(SCALES), 256)).astype(np.uint64)
        # a byte together with its move at every step
        self.coded = np.arange(256, dtype=np.uint64)
        for j, row in enumerate(moves):
            self.coded |= row << np.uint64(8 + j)
        self.scales = []
        for k, steps in enumerate(SCALES):
            longer = SCALES[k - 1] if k else 1 << 60
            own = [i for i, (_, b) in enumerate(self.items) if steps <= len(b) < longer]
            if not own:
                continue
            anchors = [(i, int(s)) for i in own for s in window_starts(np.frombuffer(self.items[i][1], np.uint8))
                       if s + steps <= len(self.items[i][1])]
            walked = self._walk(
                np.frombuffer(b"".join(self.items[i][1][s:s + steps] for i, s in anchors), np.uint8),
                np.arange(len(anchors)) * steps, steps)
            tables = []
            for _ in range(self.repeats if steps > 4 else 1):
                chosen = np.sort(rng.choice(steps, min(steps, self.samples), replace=False))
                first = rng.permutation(chosen)[:8]
                gate = np.zeros(1 << GATE_BITS, bool)
                gate[self._gate(walked, first)] = True
                keys = self._key(walked, chosen, np.arange(len(anchors)))
                order = np.argsort(keys, kind="stable")
                tables.append((chosen, first, gate, keys[order], order))
            self.scales.append((steps, np.array(anchors, np.int64), tables))

    def _walk(self, data: np.ndarray, at: np.ndarray, steps: int) -> np.ndarray:
        """The embedding of the window at each place: one row of bytes for each step."""
        out = np.empty((steps, len(at)), np.uint8)
        coded, at = np.take(self.coded, data), at.astype(np.int64)
        for j in range(steps):
            here = np.take(coded, at, mode="clip")
            out[j] = here.astype(np.uint8)
            here >>= np.uint64(8 + j)
            here &= np.uint64(1)
            at += here.view(np.int64)
        return out

    @staticmethod
    def _gate(walked: np.ndarray, first: np.ndarray) -> np.ndarray:
        """A short hash of the first sampled positions: most windows go no further."""
        h = np.zeros(walked.shape[1], np.uint32)
        for row in first:
            h *= np.uint32(0x01000193)
            h += walked[row]
        h *= np.uint32(0x9E3779B1)
        return h >> np.uint32(32 - GATE_BITS)

    @staticmethod
    def _key(walked: np.ndarray, chosen: np.ndarray, windows: np.ndarray) -> np.ndarray:
        h = np.zeros(len(windows), np.uint64)
        for row in chosen:
            h *= np.uint64(0x100000001B3)
            h += walked[row][windows]
        return mix64(h)

    def candidates(self, data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Sorted distinct (text, item, where the item would begin) of all hits.

        `data` holds the normalized texts one after the other, each with one space behind
        it; places are counted in the text.
        """
        ends = np.cumsum(lengths + 1) - 1
        begins = ends - lengths
        starts = window_starts(data)
        text = np.searchsorted(ends, starts, "left")
        found = [np.empty((0, 3), np.int64)]
        for steps, anchors, tables in self.scales:
            fits = np.flatnonzero(starts + steps <= ends[text])
            for a in range(0, len(fits), 1 << 15):
                rows = fits[a:a + (1 << 15)]
                low, high = starts[rows[0]], starts[rows[-1]] + steps
                walked = self._walk(data[low:high], starts[rows] - low, steps)
                for chosen, first, gate, keys, order in tables:
                    open_ = np.flatnonzero(np.take(gate, self._gate(walked, first)))
                    asked = self._key(walked, chosen, open_)
                    left = np.searchsorted(keys, asked, "left")
                    right = np.searchsorted(keys, asked, "right")
                    hit = right > left
                    if not hit.any():
                        continue
                    times = (right - left)[hit]
                    row = np.repeat(rows[open_[hit]], times)
                    anchor = anchors[order[spans(left[hit], times)]]
                    found.append(np.stack(
                        [text[row], anchor[:, 0], starts[row] - begins[text[row]] - anchor[:, 1]], axis=1))
        return np.unique(np.concatenate(found), axis=0)

    def search(self, texts: list[str]) -> list[list[tuple[int, int, int, int]]]:
        """The matches (item, start, length, edits) of each text, normalized first."""
        normal = [normal_bytes(t) for t in texts]
        data = np.frombuffer(b"".join(x + b" " for x in normal), np.uint8)
        found: list[list[tuple[int, int]]] = [[] for _ in texts]
        for text, item, at in self.candidates(data, np.array([len(x) for x in normal], np.int64)).tolist():
            found[text].append((item, at))
        return [self._verified(x, f) if f else [] for x, f in zip(normal, found)]

    def _verified(self, data: bytes, hits: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
        """The best verified window of each item that a text's hits (item, place) name."""
        best: dict[int, tuple[int, int, int]] = {}
        done: dict[int, int] = {}
        for item, at in hits:
            text = self.items[item][1]
            reach = int(len(text) * self.max_share)
            if item in best and best[item][0] == 0 or item in done and done[item] >= at:
                continue
            low = max(0, at - 2 * reach)
            window = data[low:max(0, at) + len(text) + 2 * reach]
            done[item] = at + reach  # the next places lie in the same window
            edits, end = edit_window(text, window)
            if edits <= reach and (item not in best or edits < best[item][0]):
                # the start: the same search from the back
                _, back = edit_window(text[::-1], window[:end][::-1])
                best[item] = (edits, low + end - back, back)
        return [(i, s, n, e) for i, (e, s, n) in sorted(best.items())]


def _blocks(benchmark: DataFrame, block_items: int) -> Iterator[list[tuple[int | None, bytes]]]:
    block = []
    for row in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text") \
            .where("text IS NOT NULL").orderBy("item_id", "text").toLocalIterator():
        if data := normal_bytes(row.text):
            block.append((row.item_id, data))
        if len(block) == block_items:
            yield block
            block = []
    if block:
        yield block


def find(docs: DataFrame, benchmark: DataFrame, max_share: float = 0.1, repeats: int = 4,
         samples: int = 14, block_items: int = 5000) -> DataFrame:
    """One row per document and item found in it: the best window, in normalized bytes.

    `max_share` is the largest edit distance as a share of the item's length. `repeats`
    tables of `samples` positions each; more of them raise the recall of edited copies.
    """
    texts, out = id_and_text(docs), None
    for block in _blocks(benchmark, block_items):
        index = Index(block, repeats, samples, max_share)

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in chunks(batches):
                rows = [
                    (doc, index.items[i][0], s, n, e)
                    for doc, found in zip(
                        column(batch, "doc_id").to_pylist(), index.search(column(batch, "text").to_pylist()))
                    for i, s, n, e in found]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)],
                    ["doc_id", "item_id", "start", "length", "edits"])

        part = texts.mapInArrow(run, RESULT)
        out = part if out is None else out.unionAll(part)
    return docs.sparkSession.createDataFrame([], RESULT) if out is None else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, max_share: float = 0.1, repeats: int = 4,
                      samples: int = 14, block_items: int = 5000) -> DataFrame:
    """The rows of `docs`, all columns as they are, in which no item was found."""
    schema = docs.schema
    for block in _blocks(benchmark, block_items):
        index = Index(block, repeats, samples, max_share)

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in chunks(batches):
                found = index.search([t or "" for t in column(batch, "text").to_pylist()])
                yield batch.filter(pa.array([not f for f in found], pa.bool_()))

        docs = docs.mapInArrow(run, schema)
    return docs
