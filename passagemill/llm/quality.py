"""Quality classifier: supervised subword embeddings (the fastText model), numpy SGD.

A text is the average of the vectors of its hashed features; a softmax layer over the two
classes sits on that average. Features are the words, their shapes (runs of upper case,
lower case, digit and mark), pairs of neighbouring shapes, a mark for a word equal to the
one before, and all character trigrams. As the softmax sees the vectors only through one
difference of its two rows, a fitted model is one number per hash slot, which is what
scoring looks up; the vectors themselves are kept in the model.

Nulls: a null text counts as empty. An empty text has no features; its score is the
model's bias. Rows whose doc_id is null are never trained on and are not held out.
Without labels of both classes every score is the share of label 1 (0.5 without labels).
Repeated labels of one id count once, by their mean; repeated rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from passagemill.llm.common import (
    chunks, code_points, column, held_out, id_and_text, mix64, row_of, sums,
)

SLOTS = 1 << 17
SCORE_BYTES = 1 << 20  # text scored at a time: a feature takes some 50 bytes of arrays
PIECE = 1 << 20  # characters of one text that are features at a time
SHAPES = np.full(1 << 16, 4, np.uint8)
for _first, _last, _kind in ((65, 90, 1), (97, 122, 2), (48, 57, 3), (0xC0, 0xDE, 1),
                             (0xDF, 0x24F, 2), (0x370, 0xFFFF, 2)):
    SHAPES[_first:_last + 1] = _kind
SHAPES[[9, 10, 11, 12, 13, 32]] = 0


@dataclass(frozen=True)
class Model:
    vectors: np.ndarray  # slots x dim
    output: np.ndarray  # 2 x dim
    bias: float

    def slot_scores(self) -> np.ndarray:
        """What each slot adds to the log odds of class 1."""
        return (self.vectors @ (self.output[1] - self.output[0])).astype(np.float32)


def _word_features(points: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word features of all texts, and the text each belongs to."""
    kinds = SHAPES[np.minimum(points, 0xFFFF)]
    rows = row_of(lengths).astype(np.int32)
    inside = kinds > 0
    fresh = np.ones(len(points), bool)
    fresh[1:] = rows[1:] != rows[:-1]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | fresh[1:]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.empty(0, np.uint64), np.empty(0, np.int32)
    at = np.arange(len(points))
    place = at - np.maximum.accumulate(np.where(begins, at, 0))
    mixed = mix64(points.astype(np.uint64) + (place.astype(np.uint64) << np.uint64(32)))
    mixed[~inside] = 0
    word = np.add.reduceat(mixed, starts)
    # a shape is the sequence of kinds without repeats
    turn = inside.copy()
    turn[1:] &= (kinds[1:] != kinds[:-1]) | begins[1:]
    steps = np.cumsum(turn)
    depth = steps - np.maximum.accumulate(np.where(begins, steps - 1, 0))
    shape_part = mix64(kinds.astype(np.uint64) + (depth.astype(np.uint64) << np.uint64(8)) + np.uint64(1 << 60))
    shape_part[~turn] = 0
    shape = np.add.reduceat(shape_part, starts)
    owner = rows[starts]
    same_text = np.zeros(len(starts), bool)
    same_text[1:] = owner[1:] == owner[:-1]
    pair = mix64(shape[1:] * np.uint64(3) + shape[:-1])
    repeat = np.where(word[1:] == word[:-1], np.uint64(11), np.uint64(13))
    follows = same_text[1:]
    return (
        np.concatenate([word, shape + np.uint64(7), pair[follows], repeat[follows]]),
        np.concatenate([owner, owner, owner[1:][follows], owner[1:][follows]]),
    )


def _trigrams(points: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all character trigrams, and how many each text has."""
    if len(points) < 3:
        return np.empty(0, np.uint64), np.zeros(len(lengths), np.int64)
    low = points.astype(np.uint64)
    grams = low[:-2] | (low[1:-1] << np.uint64(21)) | (low[2:] << np.uint64(42))
    ends = np.cumsum(lengths)
    inside = np.ones(len(points), bool)
    for back in (1, 2):
        cut = ends - back
        inside[cut[(cut >= 0) & (cut >= ends - lengths)]] = False
    return grams[inside[:-2]], np.maximum(lengths - 2, 0)


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(47)).astype(np.int32)


def _pieces(text: str) -> Iterator[np.ndarray]:
    """The slots of all features of one text, in pieces of about PIECE characters.

    A piece ends behind a word (a longer word makes a longer piece), and the next one looks
    back two characters for its trigrams and one word for its pairs.
    """
    points, _ = code_points([text])
    a, word = 0, None  # where the piece begins, and the last word before it
    while a < len(points):
        b = min(a + PIECE, len(points))
        while b < len(points) and SHAPES[min(int(points[b]), 0xFFFF)]:
            b += 1
        back = points[max(a - 2, 0):b]
        yield _slots(_trigrams(back, np.array([len(back)]))[0])
        part = points[a if word is None else word:b]
        hashes, _ = _word_features(part, np.array([len(part)]))
        if word is not None:  # its own features are known; they stand first among words and shapes
            hashes = np.delete(hashes, [0, (len(hashes) + 2) // 4])
        yield _slots(hashes)
        inside = np.flatnonzero(SHAPES[np.minimum(points[a:b], 0xFFFF)] > 0)
        if len(inside):
            gaps = np.flatnonzero(np.diff(inside) > 1)
            word = a + int(inside[gaps[-1] + 1] if len(gaps) else inside[0])
        a = b


def log_odds(texts: list[str], slot_scores: np.ndarray, bias: float) -> np.ndarray:
    """Average of the slots' scores over all features of each whole text, plus the bias.

    A text longer than PIECE is read piece by piece, to the same result.
    """
    points, lengths = code_points([t if len(t) <= PIECE else "" for t in texts])
    grams, n_grams = _trigrams(points, lengths)
    total = sums(slot_scores[_slots(grams)], n_grams)
    words, owner = _word_features(points, lengths)
    total += np.bincount(owner, slot_scores[_slots(words)], len(texts))
    n = n_grams + np.bincount(owner, minlength=len(texts))
    for i in (i for i, t in enumerate(texts) if len(t) > PIECE):
        for slots in _pieces(texts[i]):
            total[i] += slot_scores[slots].sum(dtype=np.float64)
            n[i] += len(slots)
    return total / np.maximum(n, 1) + bias


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct slots of a text and the share of its features in each."""
    if len(text) <= PIECE:
        points, lengths = code_points([text])
        slots = _slots(np.concatenate([_trigrams(points, lengths)[0], _word_features(points, lengths)[0]]))
        found, counts = np.unique(slots, return_counts=True)
    else:
        every = np.zeros(SLOTS, np.int64)
        for slots in _pieces(text):
            every += np.bincount(slots, minlength=SLOTS)
        found = np.flatnonzero(every).astype(np.int32)
        counts = every[found]
    return found, (counts / max(1, counts.sum())).astype(np.float32)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], dim: int = 8, epochs: int = 6,
        rate: float = 2.0, seed: int = 1) -> Model:
    """Stochastic gradient descent over (slots, shares, label) rows, in a seeded order."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (SLOTS, dim)).astype(np.float32)
    output = rng.uniform(-1 / dim, 1 / dim, (2, dim)).astype(np.float32)
    labels = np.array([r[2] for r in rows], np.float64)
    if not len(rows) or labels.min() == labels.max():
        share = labels.mean() if len(rows) else 0.5
        return Model(np.zeros_like(vectors), output, float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    bias, steps, done = 0.0, epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            slots, shares, label = rows[i]
            lr = rate * (1 - done / steps)
            done += 1
            mean = shares @ vectors[slots]
            way = output[1] - output[0]
            error = label - 1 / (1 + np.exp(-float(mean @ way) - bias))
            # one step on the average moves each vector by its share; the norm of the shares
            # keeps steps alike for texts of few and of many features
            scale = lr * error / max(float(shares @ shares), 1e-4) * 0.02
            vectors[slots] += scale * shares[:, None] * way
            output[1] += 0.5 * lr * error * mean
            output[0] -= 0.5 * lr * error * mean
            bias += 0.05 * lr * error
    return Model(vectors, output, bias)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 4000, label: str = "quality", **options) -> Model:
    """Fit on at most `max_rows` labelled rows that are not held out (by hash of their id).

    The bound keeps the sample's features small enough for one machine; each sampled
    document is used whole. The ids are chosen from the labels alone, so only their texts
    are read into features, and texts never leave the executors.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("_y"))
        .where(F.col("doc_id").isNotNull() & F.col("_y").isNotNull() & ~held_out())
        .groupBy("doc_id").agg((F.avg("_y") >= 0.5).cast("int").alias("_y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    wanted = {r.doc_id: r._y for r in chosen.collect()}

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            ids, texts = column(batch, "doc_id").to_pylist(), column(batch, "text")
            out = [(i, *features(texts[k].as_py())) for k, i in enumerate(ids) if i in wanted]
            yield pa.RecordBatch.from_arrays([
                pa.array([o[0] for o in out], pa.int64()),
                pa.array([o[1].tobytes() for o in out], pa.binary()),
                pa.array([o[2].tobytes() for o in out], pa.binary()),
            ], ["doc_id", "slots", "shares"])

    # a repeated id counts once: its first features in byte order; max_rows rows at most arrive
    found = id_and_text(docs).where(~held_out() & F.col("doc_id").isNotNull()) \
        .mapInArrow(extract, "doc_id LONG, slots BINARY, shares BINARY") \
        .groupBy("doc_id").agg(F.min(F.struct("slots", "shares")).alias("f")).select("doc_id", "f.*").collect()
    return fit([
        (np.frombuffer(r.slots, np.int32), np.frombuffer(r.shares, np.float32), wanted[r.doc_id])
        for r in sorted(found, key=lambda r: r.doc_id)], **options)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score (probability of label 1), predicted, for every row."""
    slot_scores, bias = model.slot_scores(), model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=SCORE_BYTES):
            p = 1 / (1 + np.exp(-log_odds(column(batch, "text").to_pylist(), slot_scores, bias)))
            yield pa.RecordBatch.from_arrays([
                column(batch, "doc_id"), column(batch, "held_out"),
                pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"])

    return id_and_text(docs).withColumn("held_out", held_out()).mapInArrow(
        run, "doc_id LONG, held_out BOOLEAN, score DOUBLE, predicted INT")


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of `docs`, all columns as they are, whose score reaches the threshold."""
    slot_scores, bias = model.slot_scores(), model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=SCORE_BYTES):
            texts = [t or "" for t in column(batch, "text").to_pylist()]
            p = 1 / (1 + np.exp(-log_odds(texts, slot_scores, bias)))
            yield batch.filter(pa.array(p >= threshold))

    return docs.mapInArrow(run, docs.schema)
