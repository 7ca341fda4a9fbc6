"""Answer matching, abstention and proof predicates."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from passagemill import fixed_values as fv
from passagemill.functions.text import (
    col, first_line, let, norm_answer, squash, strip,
)


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def answer_match(prediction: Column | str, answers: Column | str) -> Column:
    """Some normalized answer is a substring of the normalized prediction.

    An answer that normalizes to "" matches everything; null or empty lists match nothing.
    """
    return _true(let(
        norm_answer(prediction),
        lambda p: F.exists(col(answers), lambda a: F.contains(p, norm_answer(a))),
    ))


def answer_in_text(text: Column | str, answers: Column | str) -> Column:
    """Raw answer in raw text, or normalized answer in text without punctuation.

    The text is deliberately neither lower-cased nor stripped of articles. Its form without
    punctuation is made only where no raw answer is found.
    """
    text = col(text)

    def hit(squashed: Column, a: Column) -> Column:
        return F.contains(squashed, norm_answer(a)) | F.contains(squashed, norm_answer(a, lowercase=False))

    raw = _true(F.exists(col(answers), lambda a: F.contains(text, a)))
    return raw | _true(let(squash(text), lambda t: F.exists(col(answers), lambda a: hit(t, a))))


def abstains(c: Column | str) -> Column:
    """Any of the fixed abstention phrases, ignoring case."""
    pattern = "|".join(r"\Q" + p.lower() + r"\E" for p in fv.ABSTENTION_PHRASES)
    return _true(F.lower(col(c)).rlike(pattern))


def abstains_strict(c: Column | str) -> Column:
    """Narrow form: only the one marker, only on the first line."""
    return answer_in_text(first_line(c), F.array(F.lit(fv.STRICT_ABSTENTION)))


def proof_of(c: Column | str) -> Column:
    """First line after the first proof marker, or the no-proof token."""
    c = col(c)
    at = F.instr(c, fv.PROOF_MARKER)
    tail = F.substring(c, at + len(fv.PROOF_MARKER), F.length(c))
    return F.when(at > 0, first_line(strip(tail))).otherwise(F.lit(fv.NO_PROOF))


def answer_in_proof(proof: Column | str, generated: Column | str) -> Column:
    return answer_in_text(proof, F.array(col(generated)))


def answer_after_marker(prompt: Column | str, answers: Column | str) -> Column:
    """Any lower-cased answer in the lower-cased text after the first documents marker."""
    low = F.lower(col(prompt))
    at = F.instr(low, fv.DOCUMENTS_MARKER)
    tail = F.when(at > 0, F.substring(low, at + len(fv.DOCUMENTS_MARKER), F.length(low)))
    return _true(let(
        tail,
        lambda t: (t != "") & F.exists(col(answers), lambda a: F.contains(t, F.lower(a))),
    ))


def extract_answer(
    generated: Column | str, prefix: str = fv.ANSWER_MARKER, occurrence: int = 1
) -> Column:
    """Trimmed text after the n-th prefix; null when there are fewer occurrences."""
    parts = F.split(col(generated), re.escape(prefix), occurrence + 1)
    return strip(F.get(parts, F.lit(occurrence)))


def cut_at_stop(c: Column | str, stops: tuple[str, ...] = fv.STOP_STRINGS) -> Column:
    """Text before the earliest stop string."""
    pattern = "|".join(r"\Q" + s + r"\E" for s in stops)
    return F.split(col(c), pattern, 2)[0]


def is_correct(in_documents: Column, matches: Column, abstained: Column) -> Column:
    """Right answer when the context holds it, abstention when it does not."""
    return (in_documents & matches) | (~in_documents & abstained)
