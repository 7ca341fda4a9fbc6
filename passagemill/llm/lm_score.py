"""Cross-entropy difference: documents scored by a target and a background language model.

Both are interpolated bigram models over one shared vocabulary of 64-bit hashes of lower-case
words and of pairs of them, the same for both models. The background is counted over all
documents, the target over those that are marked, each whole. A task adds up its keys and
sends one packed part for every range of keys it has; the task that receives a range adds
the parts, sorts and writes them: one shuffle, and its partitions are the shards. Documents
probe the sorted blocks of the shards, some million distinct keys at a time, and a worker
keeps a few open. Each time reads every block that it asks, so reading grows with documents
times vocabulary.

A document's score is the mean over its tokens of target loss minus background loss: below
zero, it reads more like the target. Where the scored documents are those that the models
have counted, each one's own counts are taken out first, else its rare words would speak for
the model that it belongs to.

Nulls: a null text counts as empty; a null mark as false, and so does a row without doc_id
where marks are ids. A text without words has no tokens, losses 0 and difference 0. Rows
without doc_id count and are scored; repeated rows count each. With an empty target its model
is uniform.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from passagemill.llm.common import (
    chunks, column, filesystem, input_bytes, mix64, row_of, shared_folder, sums, worker_state, write_once,
)

KEYS_PER_BLOCK = 1 << 19
HELD_BLOCKS = 4  # blocks a worker keeps open
ASKED_KEYS = 3_000_000  # keys of several chunks that are looked up together
HELD_KEYS = 1 << 20  # distinct keys a task adds up before it sends them
SHARD_BYTES = 2 << 20  # of input to a shard
MOST_SHARD_BITS = 20
NO_ESTIMATE = 1 << 60  # Catalyst's size of a table that has no files
BEGIN = 0x5851F42D4C957F2D & ~1  # stands before the first word of a text
PAIR_SHARE, WORD_SHARE = 0.6, 0.35  # the rest is uniform
LEAST_VOCABULARY = 1 << 20


def word_keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each word of the texts its key, its left neighbour's and their pair's; words per text.

    The lowest bit of a key tells pairs (1) from words.
    """
    lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    words = lists.flatten()
    full = pc.not_equal(words, "").to_numpy(zero_copy_only=False)  # an edge of white space gives ""
    ends = np.concatenate([[0], np.cumsum(full)])[np.concatenate(
        [[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])]
    coded = words.dictionary_encode()
    distinct = np.array([  # bytes.lower touches ASCII letters only
        xxhash.xxh3_64_intdigest(w.encode().lower()) for w in coded.dictionary.to_pylist()], np.uint64) & ~np.uint64(1)
    keys = distinct[coded.indices.to_numpy()[full]] if len(distinct) else np.empty(0, np.uint64)
    before = np.empty_like(keys)
    before[1:] = keys[:-1]
    lengths = np.diff(ends)
    before[ends[:-1][lengths > 0]] = BEGIN
    return keys, before, mix64(before * np.uint64(0x9E3779B97F4A7C15) + keys) | np.uint64(1), lengths


def added(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys of (keys, n, n_target) parts, sorted, and the sums of their counts."""
    keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, *(np.bincount(at, np.concatenate([p[k] for p in parts]), len(keys)).astype(np.int64) for k in (1, 2))


def packed(keys: np.ndarray, *counts: np.ndarray) -> bytes:
    """Sorted keys as the bytes of their differences, place by place, and counts likewise."""
    steps = keys.copy()
    steps[1:] -= keys[:-1]
    planes = [np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes() for x in (
        steps, *(c.astype(np.uint64) for c in counts))]
    return len(keys).to_bytes(8, "little") + pa.compress(b"".join(planes), "zstd", asbytes=True)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], 24 * n, "zstd"), np.uint8).reshape(3, 8, n)
    keys, *counts = (np.ascontiguousarray(p.T).view(np.uint64).reshape(-1) for p in planes)
    return np.cumsum(keys, dtype=np.uint64), *(c.astype(np.int64) for c in counts)


@dataclass(frozen=True)
class KeyBlocks:
    """Sorted keys and their counts in the shared folder, in blocks by ascending keys."""

    firsts: np.ndarray  # the first key of each block
    places: tuple[tuple[str, int], ...]  # file and number of its batch

    def counts(self, asked: np.ndarray) -> np.ndarray:
        """n and n_target of sorted keys, 0 where there is none."""
        held: OrderedDict = worker_state("lm_blocks", OrderedDict)
        found = np.zeros((2, len(asked)), np.int64)
        edges = np.append(np.searchsorted(asked, self.firsts), len(asked))
        for place, a, b in zip(self.places, edges[:-1], edges[1:]):
            if a == b:
                continue
            if place in held:
                held.move_to_end(place)
            else:
                while len(held) >= HELD_BLOCKS:
                    held.popitem(last=False)
                files, local = filesystem(place[0])
                with files.open_input_file(local) as source:
                    part = pa.ipc.open_file(source).get_batch(place[1])
                held[place] = tuple(column(part, x).to_numpy() for x in ("key", "n", "n_target"))
            known, *n = held[place]
            at = np.minimum(np.searchsorted(known, asked[a:b]), len(known) - 1)
            hit = known[at] == asked[a:b]
            for k in (0, 1):
                found[k, a:b] = np.where(hit, n[k][at], 0)
        return found

    def holds(self, ids: pa.Array) -> np.ndarray:
        """For marks made of ids: whether each id is among them."""
        known = pc.is_valid(ids).to_numpy(zero_copy_only=False)
        keys, at = np.unique(mix64(pc.fill_null(ids, 0).to_numpy().view(np.uint64)), return_inverse=True)
        return known & (self.counts(keys)[0] > 0)[at]


def _sent(parts: list[tuple[np.ndarray, ...]], bits: int) -> pa.RecordBatch:
    """The packed part of each shard that has keys, a shard being equal leading bits."""
    keys, *counts = added(parts)
    shard = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    starts = np.flatnonzero(np.diff(shard, prepend=-1))
    cuts = [slice(a, b) for a, b in zip(starts, [*starts[1:], len(keys)])]
    return pa.RecordBatch.from_arrays([
        pa.array(shard[starts].astype(np.int32)),
        pa.array([packed(keys[c], *(x[c] for x in counts)) for c in cuts], pa.binary())], ["shard", "part"])


def _shard_bits(rows: DataFrame, size: Column) -> int:
    """Leading bits that tell shards apart; `size` adds up to the bytes where Catalyst knows none."""
    n = input_bytes(rows)
    if n >= NO_ESTIMATE:
        n = rows.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    return min(MOST_SHARD_BITS, max(3, (-(-n // SHARD_BYTES) - 1).bit_length()))


def write_blocks(parts: DataFrame, name: str, keys_per_block: int = KEYS_PER_BLOCK) -> tuple[KeyBlocks, list]:
    """Add up the parts of each shard and write it; the blocks, and a row for each of them."""
    folder = shared_folder(parts.sparkSession, name)

    def write(group: pa.Table) -> pa.Table:
        keys, n, n_target = added([unpacked(p.as_buffer().to_pybytes()) for p in group["part"]])
        cuts = [slice(a, a + keys_per_block) for a in range(0, len(keys), keys_per_block)]
        batches = [pa.record_batch({"key": keys[c], "n": n[c], "n_target": n_target[c]}) for c in cuts]

        def put(out) -> None:
            with pa.ipc.new_file(out, batches[0].schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as sink:
                for batch in batches:
                    sink.write_batch(batch)

        path = write_once(folder, f"shard-{group['shard'][0].as_py()}", put)
        word = (keys & np.uint64(1) == 0) & (keys != BEGIN)
        return pa.table({
            "first": np.array([keys[c.start] for c in cuts], np.uint64).view(np.int64), "path": [path] * len(cuts),
            "block": pa.array(range(len(cuts)), pa.int32()),
            **{c: [int(x[s][word[s]].sum()) for s in cuts] for c, x in (("words", n), ("words_target", n_target))},
            "distinct": [int(word[s].sum()) for s in cuts]})

    rows = parts.groupBy("shard").applyInArrow(
        write, "first LONG, path STRING, block INT, words LONG, words_target LONG, distinct LONG").collect()
    rows.sort(key=lambda r: r.first % 2**64)
    return KeyBlocks(np.array([r.first for r in rows], np.int64).view(np.uint64), tuple((r.path, r.block) for r in rows)), rows


def mark_ids(ids: DataFrame) -> KeyBlocks:
    """The ids (doc_id) of the documents to mark, as sorted blocks that documents probe.

    Neither ids nor texts are joined: mixing is one to one, so a key stands for one id.
    """
    bits = _shard_bits(ids, F.lit(8))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.unique(mix64(pc.drop_null(batch.column(0)).to_numpy().view(np.uint64)))
            yield _sent([(keys, np.ones(len(keys), np.int64), np.zeros(len(keys), np.int64))], bits)

    return write_blocks(ids.select(F.col("doc_id").cast("long")).mapInArrow(run, "shard INT, part BINARY"), "lm-marks")[0]


@dataclass(frozen=True)
class Model:
    """Where the counts of both models are."""

    keys: KeyBlocks
    totals: tuple[float, float]  # words of the background and of the target
    vocabulary: int  # what the uniform share is spread over


def losses(word: np.ndarray, context: np.ndarray, pair: np.ndarray, total: np.ndarray | float, vocabulary: int) -> np.ndarray:
    """Nats of each token from one model's counts of it, of its left neighbour and of both."""
    by_pair = np.minimum(pair, context) / np.maximum(context, 1)
    by_word = word / np.maximum(total, 1)
    share = np.where(context > 0, PAIR_SHARE, 0.0)
    p = share * by_pair + (PAIR_SHARE + WORD_SHARE - share) * by_word \
        + (1 - PAIR_SHARE - WORD_SHARE) / vocabulary
    return -np.log(p)


Target = Column | str | KeyBlocks


def _with_marks(docs: DataFrame, target: Target | None) -> DataFrame:
    """doc_id, text and `target`; ids that are marks are probed where the texts are."""
    mark = F.lit(None).cast("boolean") if target is None or isinstance(target, KeyBlocks) else (
        F.col(target) if isinstance(target, str) else target)
    doc_id = F.col("doc_id").cast("long") if "doc_id" in docs.columns else F.lit(None).cast("long")
    return docs.select(doc_id.alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), mark.alias("target"))


def _marks(batch: pa.RecordBatch, target: Target | None) -> np.ndarray:
    if isinstance(target, KeyBlocks):
        return target.holds(column(batch, "doc_id"))
    return pc.fill_null(column(batch, "target"), False).to_numpy(zero_copy_only=False).astype(bool)


def train(docs: DataFrame, target: Target = "target", keys_per_block: int = KEYS_PER_BLOCK) -> Model:
    """Count both models over all rows.

    `target` marks the documents of the target: a boolean column, its name, or `mark_ids`.
    """
    bits = _shard_bits(docs, F.octet_length("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in chunks(batches):
            word, left, pair, lengths = word_keys(column(batch, "text"))
            marked = np.repeat(_marks(batch, target), lengths)
            first = (np.cumsum(lengths) - lengths)[lengths > 0]
            keys = np.concatenate([word, pair, left[first]])
            held.append(added([(keys, np.ones(len(keys), np.int64), np.concatenate([marked, marked, marked[first]]))]))
            if sum(len(p[0]) for p in held) > 2 * HELD_KEYS:
                held = [added(held)]
                if len(held[0][0]) > HELD_KEYS:
                    yield _sent([held.pop()], bits)
        if held:
            yield _sent(held, bits)

    keys, rows = write_blocks(
        _with_marks(docs, target).mapInArrow(count, "shard INT, part BINARY"), "lm-shards", keys_per_block)
    return Model(keys, (sum(r.words for r in rows), sum(r.words_target for r in rows)),
                 max(LEAST_VOCABULARY, sum(r.distinct for r in rows)))


def _own(row: np.ndarray, at: np.ndarray, asked: np.ndarray | None = None) -> np.ndarray:
    """How often each (row, key number) occurs among them; with `asked`, of those pairs instead."""
    code = row.astype(np.uint64) << np.uint64(32) | at.astype(np.uint64)
    known, where, n = np.unique(code, return_inverse=True, return_counts=True)
    return n[where] if asked is None else n[np.searchsorted(known, asked)]


def score(docs: DataFrame, model: Model, counted: Target | None = None) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss and their difference, per token.

    `counted` says that `docs` are the rows that `train` has counted and is its `target`:
    each document's own counts are then taken out, of the target only where it is marked.
    """
    def prepared(batch: pa.RecordBatch) -> tuple:
        """What a chunk asks, and where its tokens stand in it; the text is no longer needed."""
        word, left, pair, lengths = word_keys(column(batch, "text"))
        asked, at = np.unique(np.concatenate([word, left, pair]), return_inverse=True)
        w, l, p = np.split(at.astype(np.uint32), 3)
        own, marks = None, None
        if counted is not None:
            row, begins = row_of(lengths), lengths > 0
            first = (np.cumsum(lengths) - lengths)[begins]
            words, rows = np.concatenate([w, l[first]]), np.concatenate([row, row[first]])
            code = row.astype(np.uint64) << np.uint64(32) | l.astype(np.uint64)
            own = [x.astype(np.uint32) for x in (_own(rows, words)[:len(w)], _own(rows, words, code), _own(row, p))]
            marks = _marks(batch, counted)
        return column(batch, "doc_id"), lengths, asked, (w, l, p), own, marks

    def scored(chunk: tuple, known: np.ndarray, found: np.ndarray) -> pa.RecordBatch:
        ids, lengths, asked, places, own, marks = chunk
        mine, n = found[:, np.searchsorted(known, asked)], np.maximum(lengths, 1)
        loss = []
        for k in (0, 1):
            counts, total = [mine[k][x] for x in places], float(model.totals[k])
            if own is not None:
                out = np.repeat(marks if k else np.ones(len(lengths), bool), lengths)
                counts = [c - np.where(out, o, 0) for c, o in zip(counts, own)]
                total = total - np.where(out, np.repeat(lengths, lengths), 0)
            loss.append(sums(losses(*counts, total, model.vocabulary), lengths) / n)
        return pa.RecordBatch.from_arrays([
            ids, pa.array(lengths), pa.array(loss[1]), pa.array(loss[0]), pa.array(loss[1] - loss[0])],
            ["doc_id", "n_tokens", "target_loss", "background_loss", "difference"])

    def looked_up(waiting: list[tuple]) -> Iterator[pa.RecordBatch]:
        known = np.unique(np.concatenate([c[2] for c in waiting]))
        found = model.keys.counts(known)
        while waiting:
            yield scored(waiting.pop(0), known, found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        for batch in chunks(batches):
            waiting.append(prepared(batch))
            if sum(len(c[2]) for c in waiting) > ASKED_KEYS:
                yield from looked_up(waiting)
        if waiting:
            yield from looked_up(waiting)

    return _with_marks(docs, counted).mapInArrow(
        run, "doc_id LONG, n_tokens LONG, target_loss DOUBLE, background_loss DOUBLE, difference DOUBLE")
