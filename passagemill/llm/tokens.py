"""Token ids of whole texts through the tokenizers library, each distinct word encoded once.

The tokenizer's patterns never match across white space and its normalizer composes
nothing across it, so the ids of a text are those of its white-space separated words in
order. Words recur, so each Python worker keeps the ids of the words it has met.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from passagemill.llm.common import spans, worker_state

LAST_LATIN = "\u024f"
# The byte-level alphabet: a printable byte stands for itself, the others for 256, 257, ...
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_LETTERS = {b: 256 + n for n, b in enumerate(sorted(set(range(256)) - _PRINTABLE))}
# The memo is emptied beyond so many words or characters of them, and they are encoded again:
# in text without spaces a word may be a paragraph.
MEMO_WORDS = 550_000
MEMO_CHARS = 32 << 20


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids for arrays of texts, by a memo from words to slots of one growing array."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self._clear()

    def _clear(self) -> None:
        self.slot_of: dict[str, int] = {}
        self.letters: dict[str, tuple[int, ...]] = {}
        self.ids = np.empty(1 << 16, np.uint32)
        self.used = self.chars = 0
        self.starts = np.empty(1 << 16, np.int64)
        self.lengths = np.empty(1 << 16, np.int64)

    def _encode(self, word: str) -> tuple[int, ...]:
        """Ids of a word; the letters of a plain word with end marks are looked up alone.

        Letters are one pattern match whatever follows, and so are the marks after them,
        so both parts may be encoded apart. Latin letters need no more than lower case and
        the byte alphabet before the merges.
        """
        core = word.rstrip(".,")
        if not core.isalpha():
            return self._known(word)
        low = core.lower()
        if low.isascii() and core.isascii():
            core_ids = self._known(low, plain=True)
        elif max(core) <= LAST_LATIN and low.isalpha():
            in_bytes = low.encode().decode("latin-1").translate(BYTE_LETTERS)
            core_ids = tuple([t.id for t in self.tokenizer.model.tokenize(in_bytes)])
        else:
            return self._known(word)
        return core_ids if len(core) == len(word) else core_ids + self._known(word[len(core):])

    def _known(self, part: str, plain: bool = False) -> tuple[int, ...]:
        ids = self.letters.get(part)
        if ids is None:
            ids = tuple([t.id for t in self.tokenizer.model.tokenize(part)] if plain
                        else self.tokenizer.encode(part, add_special_tokens=False).ids)
            if plain or len(part) < 4:
                self.letters[part] = ids
        return ids

    def _add(self, words: list[str]) -> None:
        """Put the ids of new words, in their order, behind those already held."""
        found = [self._encode(word) for word in words]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        slots, total = len(self.slot_of) - len(words), int(sizes.sum())
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while slots + len(words) > len(self.starts):
            self.starts = np.concatenate([self.starts, np.empty_like(self.starts)])
            self.lengths = np.concatenate([self.lengths, np.empty_like(self.lengths)])
        self.ids[self.used:self.used + total] = np.fromiter(chain.from_iterable(found), np.uint32, total)
        self.starts[slots:slots + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.lengths[slots:slots + len(words)] = sizes
        self.used += total
        self.chars += sum(map(len, words))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the number of ids of each text."""
        if len(self.slot_of) > MEMO_WORDS or self.chars > MEMO_CHARS:
            self._clear()
        words = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        slot_of = self.slot_of
        fresh = [word for word in distinct if word not in slot_of]
        slot_of.update(zip(fresh, range(len(slot_of), len(slot_of) + len(fresh))))
        self._add(fresh)
        found = np.fromiter(map(slot_of.__getitem__, distinct), np.int64, len(distinct))
        slots = found[coded.indices.to_numpy(zero_copy_only=False)]
        sizes = self.lengths[slots]
        ids = self.ids[spans(self.starts[slots], sizes)]
        per_text = words.offsets.to_numpy()
        ends = np.concatenate([[0], np.cumsum(sizes)])
        bounds = ends[per_text - per_text[0]]
        return ids, np.diff(bounds)


def encoder(path: str) -> WordEncoder:
    """This worker's encoder for a tokenizer file."""
    known = worker_state("encoders", dict)
    if path not in known:
        known[path] = WordEncoder(path)
    return known[path]
