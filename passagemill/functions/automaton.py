"""Many answers searched for in many texts: one walk over each text for all of them.

Looking for every answer of a row in each of its documents costs answers x text. Here the
distinct answers of an Arrow batch make one Aho-Corasick automaton, which walks over each
distinct text of the batch once and names all answers in it. The automaton is bounded by the
batch, so nothing grows with the number of questions.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F

# Executors need not have this package installed: its functions travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__package__.partition(".")[0]])


def found_in(texts: list[str], wanted: list[str]) -> list[set[int]]:
    """For each text the numbers of the wanted strings (distinct, none empty) that it contains."""
    import ahocorasick
    automaton = ahocorasick.Automaton()
    for n, word in enumerate(wanted):
        automaton.add_word(word, n)
    if not wanted:
        return [set() for _ in texts]
    automaton.make_automaton()
    return [{n for _, n in automaton.iter(text)} for text in texts]


SLICE_BYTES = 8 << 20  # of text that is held as Python strings at a time


def _matches(texts: pa.Array, answers: pa.Array) -> pa.Array:
    """The matches of an Arrow batch, a slice of rows at a time: a batch has a fixed number of
    rows, whose texts may be of any length."""
    held = pc.fill_null(pc.binary_length(texts.flatten()), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate(([0], np.cumsum(held)))[np.concatenate(
        ([0], np.cumsum(pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False))))]
    parts, start = [], 0
    while start < len(texts):
        # as many rows as stay within the limit, one at least
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + SLICE_BYTES, "right")) - 1)
        parts.append(_slice_matches(texts[start:stop], answers[start:stop]))
        start = stop
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.list_(pa.int32())))


def _slice_matches(texts: pa.Array, answers: pa.Array) -> pa.Array:
    texts, answers = texts.to_pylist(), answers.to_pylist()
    asked = {a: None for row in answers for a in row or () if a}
    number = {a: n for n, a in enumerate(asked)}
    whole = {t: None for row in texts for t in row or () if t is not None}
    found = dict(zip(whole, found_in(list(whole), list(asked))))

    def hits(text: str | None, wanted: list[str | None]) -> list[int]:
        if text is None:
            return []
        inside = found[text]
        return [k for k, a in enumerate(wanted) if a == "" or a is not None and number[a] in inside]

    return pa.array(
        [None if row is None else [hits(t, wanted or []) for t in row] for row, wanted in zip(texts, answers)],
        pa.list_(pa.list_(pa.int32())))


def answers_in_texts(texts: Column, answers: Column) -> Column:
    """For each text of an array the positions, from 0, of the answers that it contains.

    Exact substrings: lower-case both before. An empty answer is in every text, a null one in
    none, and a null text has none.
    """
    return F.arrow_udf(_matches, "array<array<int>>")(texts, answers)
