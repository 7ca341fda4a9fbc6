"""Language ID by interpolated Kneser-Ney character models.

Each language has a character model of order 4 with absolute discounting: the highest
order from counts, lower ones from the number of distinct characters before an n-gram,
all orders interpolated. The models are kept as sorted hash arrays: a context of three
characters and the next one are one 64-bit hash, and beside it stand the finished log
probabilities for every language. A position whose full n-gram no language has seen falls
back to the arrays of shorter contexts. A text gets the language of the lowest cross
entropy per character; its score is the calibrated posterior, and a text whose cross
entropy lies above what its language shows on texts kept back for calibration is marked
`rejected`.

Text is lower-cased; everything but letters counts as one space. Nulls: a text that is
null or has no letters is `und` with score 0 and is rejected. Rows without doc_id are
trained on if their lang is known and are never held out. Ties between languages go to
the first in alphabetical order. If no row is labelled, every text is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from passagemill.llm.common import (
    chunks, code_points, column, held_out, id_and_text, mix64, sums,
)

ORDER = 4
SPACE = 32
PIECE = 1 << 20  # characters of one text scored at a time


def _fold_table() -> np.ndarray:
    """Lower-case letters for the code points of the first plane, space for all others."""
    out = np.full(1 << 16, SPACE, np.uint16)
    for c in range(1 << 16):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


FOLD = _fold_table()


def folded(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters and single spaces of all texts, each text behind one space; their lengths
    (with that space) and the number of letters. Letters outside the first plane are one symbol."""
    points, lengths = code_points([" " + t for t in texts])
    symbols = FOLD[np.minimum(points, 0xFFFF)]
    if len(high := np.flatnonzero(points >= 1 << 16)):
        distinct, at = np.unique(points[high], return_inverse=True)
        symbols[high] = np.array([0xFFFF if chr(c).isalpha() else SPACE for c in distinct.tolist()], np.uint16)[at]
    letter = symbols != SPACE
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    starts = np.cumsum(lengths) - lengths
    keep[starts] = True
    kept, letters = (sums(x, lengths).astype(np.int64) for x in (keep, letter))
    return symbols[keep], kept, letters


def grams(symbols: np.ndarray, lengths: np.ndarray, order: int) -> np.ndarray:
    """The hash of the n-gram that ends at each place; contexts are cut at the text's start."""
    place = np.arange(len(symbols)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    packed = symbols.astype(np.uint64)
    for back in range(1, order):
        before = np.zeros(len(symbols), np.uint64)
        before[back:] = symbols[:-back]
        before[place < back] = SPACE
        packed |= before << np.uint64(16 * back)
    return packed


def _counted(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(packed, return_counts=True)


@dataclass(frozen=True)
class Models:
    """Sorted hashes of the n-grams of each order, and log probabilities by language."""

    languages: list[str]
    hashes: list[np.ndarray]  # by order, from ORDER down to 1
    log_p: list[np.ndarray]  # n-grams x languages
    unseen: float
    sharpness: float = 1.0
    limits: tuple[float, ...] = ()

    def _log_probabilities(self, packed: np.ndarray) -> np.ndarray:
        """Log probability of each packed n-gram's last symbol by language."""
        total = np.empty((len(packed), len(self.languages)), np.float32)
        left = np.arange(len(packed))
        for order, hashes, log_p in zip(range(ORDER, 0, -1), self.hashes, self.log_p):
            asked = mix64(packed[left] & np.uint64(2 ** (16 * order) - 1))
            at = np.minimum(np.searchsorted(hashes, asked), len(hashes) - 1)
            hit = hashes[at] == asked
            total[left[hit]] = log_p[at[hit]]
            left = left[~hit]
        total[left] = self.unseen
        return total

    def cross_entropy(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Nats per character by text and language; the number of letters.

        A text longer than PIECE is read piece by piece, to the same result.
        """
        symbols, lengths, letters = folded([t if len(t) <= PIECE else "" for t in texts])
        total = self._log_probabilities(grams(symbols, lengths, ORDER))
        first = np.cumsum(lengths) - lengths
        total[first] = 0  # the space put before a text
        n = np.maximum(lengths - 1, 1)
        loss = -np.stack([sums(total[:, k], lengths) / n for k in range(len(self.languages))], axis=1)
        for i in (i for i, t in enumerate(texts) if len(t) > PIECE):
            loss[i], letters[i] = self._long_cross_entropy(texts[i])
        return loss, letters

    def _long_cross_entropy(self, text: str) -> tuple[np.ndarray, int]:
        carry, total, n, letters = np.empty(0, np.uint16), np.zeros(len(self.languages)), 0, 0
        for start in range(0, len(text), PIECE):
            piece, _, found = folded([text[start:start + PIECE]])
            if start:  # no space stands before it, but one may end the word before
                ends_word = carry[-1] != SPACE and not folded([text[start]])[2][0]
                piece = piece[0 if ends_word else 1:]
            symbols = np.concatenate([carry, piece])
            packed = grams(symbols, np.array([len(symbols)]), ORDER)[len(carry) or 1:]
            total += self._log_probabilities(packed).sum(axis=0, dtype=np.float64)
            n, letters, carry = n + len(packed), letters + int(found[0]), symbols[1 - ORDER:]
        return -total / max(n, 1), letters

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether it is rejected, for each text."""
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        loss, letters = self.cross_entropy(texts)
        best = loss.argmin(axis=1)
        low = loss[np.arange(len(texts)), best]
        score = 1 / np.exp(-self.sharpness * (loss - low[:, None])).sum(axis=1)
        none = letters == 0
        limit = np.array(self.limits or [np.inf] * len(self.languages))
        return (["und" if n else self.languages[b] for n, b in zip(none, best)],
                np.where(none, 0.0, score), none | (low > limit[best]))


def estimate(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Models:
    """Interpolated Kneser-Ney models from the order-4 counts (packed n-grams) of each language."""
    languages = sorted(counts)
    vocabulary = len(np.unique(np.concatenate(
        [k & np.uint64(0xFFFF) for k, _ in counts.values()]))) + 1 if counts else 1
    tables = {}  # language -> order -> (sorted n-grams, p, back-off of contexts)
    for lang in languages:
        keys, n = counts[lang]
        order = np.argsort(keys)
        keys, n = keys[order], n[order].astype(np.float64)
        by_order = {ORDER: (keys, n)}
        for k in range(ORDER - 1, 0, -1):
            # distinct longer n-grams that end in this one
            by_order[k] = tuple(x.astype(t) for x, t in zip(
                _counted(by_order[k + 1][0] & np.uint64(2 ** (16 * k) - 1)), (np.uint64, np.float64)))
        tables[lang] = by_order

    def probability(lang: str, asked: np.ndarray, order: int) -> np.ndarray:
        if order == 0:
            return np.full(len(asked), 1 / vocabulary)
        keys, n = tables[lang][order]
        once, twice = (n == 1).sum(), (n == 2).sum()
        discount = min(0.95, max(0.1, once / max(1, once + 2 * twice)))
        context, where = np.unique(keys >> np.uint64(16), return_inverse=True)
        mass = np.bincount(where, n)
        kinds = np.bincount(where)
        mine = np.minimum(np.searchsorted(context, asked >> np.uint64(16)), len(context) - 1)
        known = context[mine] == asked >> np.uint64(16)
        at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        count = np.where(keys[at] == asked, n[at], 0)
        lower = probability(lang, asked & np.uint64(2 ** (16 * (order - 1)) - 1), order - 1)
        total = mass[mine]
        return np.where(known, np.maximum(count - discount, 0) / total
                        + discount * kinds[mine] / total * lower, lower)

    hashes, log_p = [], []
    for order in range(ORDER, 0, -1):
        union = np.unique(np.concatenate([tables[x][order][0] for x in languages])) if languages else np.empty(0, np.uint64)
        values = np.stack([np.log(probability(x, union, order)) for x in languages], axis=1) if languages \
            else np.empty((0, 0))
        hashed = mix64(union)
        by_hash = np.argsort(hashed)
        hashes.append(hashed[by_hash])
        log_p.append(values[by_hash].astype(np.float32))
    return Models(languages, hashes, log_p, float(np.log(1 / vocabulary)) - 4.0)


LEAST_TO_SPARE = 20  # labelled rows of a language from which some are kept back


def train(docs: DataFrame, max_docs_per_language: int = 1500) -> Models:
    """Models from labelled rows that are not held out.

    A bounded sample fits the models: of each language about `max_docs_per_language` rows,
    by the hash of their id, with their whole texts. A tenth of the sample calibrates
    sharpness and rejection, but no row of a language with too few to spare. N-grams are counted where the rows are and added up by language.
    """
    known = docs.where(F.col("lang").isNotNull() & ~held_out())
    rank = F.xxhash64("doc_id")
    # the threshold on the hash that leaves about the wanted number, from counts alone
    n = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not n:
        return estimate({})
    share = F.create_map(*[F.lit(x) for lang, k in n.items() for x in (lang, min(1.0, max_docs_per_language / k))])
    spare = F.create_map(*[F.lit(x) for lang, k in n.items() for x in (lang, k >= LEAST_TO_SPARE)])
    part = F.pmod(rank, F.lit(1 << 30)) / float(1 << 30)  # even in 0..1
    rows = known.where(part < share[F.col("lang")]).select(
        "lang", F.coalesce("text", F.lit("")).alias("text"),
        (spare[F.col("lang")] & (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(10)) == 0)).alias("calibrate"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            langs, texts = np.array(column(batch, "lang").to_pylist()), column(batch, "text").to_pylist()
            fit = ~np.array(column(batch, "calibrate").to_pylist(), bool)
            for lang in np.unique(langs[fit]).tolist():
                symbols, lengths, _ = folded([texts[i] for i in np.flatnonzero(fit & (langs == lang))])
                place = np.arange(len(symbols)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                keys, k = _counted(grams(symbols, lengths, ORDER)[place > 0])
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(keys)), pa.array(keys.view(np.int64)), pa.array(k)], ["lang", "gram", "n"])

    counted = rows.mapInArrow(count, "lang STRING, gram LONG, n LONG").groupBy("lang", "gram") \
        .agg(F.sum("n").alias("n")).toArrow()
    langs = np.array(counted["lang"].to_pylist())
    keys, k = counted["gram"].to_numpy().view(np.uint64), counted["n"].to_numpy()
    models = estimate({x: (keys[langs == x], k[langs == x]) for x in np.unique(langs).tolist()})
    check = rows.where("calibrate").select("lang", "text")

    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            loss, letters = models.cross_entropy(column(batch, "text").to_pylist())
            kept = np.flatnonzero(letters)
            yield pa.RecordBatch.from_arrays([
                column(batch, "lang").take(pa.array(kept)), pa.array(loss[kept].tolist(), pa.list_(pa.float64()))],
                ["lang", "loss"])

    seen = [r for r in check.mapInArrow(losses, "lang STRING, loss ARRAY<DOUBLE>").collect() if r.lang in models.languages]
    return calibrated(models, [r.lang for r in seen], np.array([r.loss for r in seen]))


def calibrated(models: Models, langs: list[str], loss: np.ndarray) -> Models:
    """Sharpness of the least mean log loss, and for each language the 99.5th percentile of
    its texts' cross entropy, a tenth added, beyond which a text is rejected."""
    if not langs:
        return models
    right = np.array([models.languages.index(x) for x in langs])

    def log_loss(s: float) -> float:
        z = -s * loss
        z -= z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(right)), right]).mean())

    sharpness = min((0.5 * 2 ** (k / 2) for k in range(14)), key=log_loss)
    limits = tuple(
        float(np.quantile(loss[right == k, k], 0.995)) * 1.1 if (right == k).any() else float("inf")
        for k in range(len(models.languages)))
    return Models(models.languages, models.hashes, models.log_p, models.unseen, sharpness, limits)


def identify(docs: DataFrame, models: Models) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=1 << 20):
            langs, score, rejected = models.predict(column(batch, "text").to_pylist())
            yield pa.RecordBatch.from_arrays([
                column(batch, "doc_id"), column(batch, "held_out"), pa.array(langs, pa.string()),
                pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return id_and_text(docs).withColumn("held_out", held_out()).mapInArrow(
        run, "doc_id LONG, held_out BOOLEAN, lang_pred STRING, score DOUBLE, rejected BOOLEAN")
