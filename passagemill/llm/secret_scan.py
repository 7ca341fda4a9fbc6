"""Secret scans through a trigram index.

Each rule's regular expression is turned into a Boolean query over the trigrams that any
match must contain: a literal stretch asks for all its trigrams, a choice for those of one
branch. A segment of documents (one chunk of text) is indexed: postings of the trigrams
that some rule asks for, in ASCII lower case. A rule's query intersects and unites postings;
only the documents left are verified with the expression. A rule without mandatory
trigrams scans every document of the segment. Segments are as large as a chunk, so the
index never outgrows a task and nothing is shuffled.

Nulls: a null text counts as empty. Every row gives a row, repeated ones too; a row
without doc_id keeps its null id. An empty table gives no rows. Rules find leftmost
matches that do not overlap within the rule; matches of different rules may overlap.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from re import _parser as regex_parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from passagemill.llm.common import chunks, column, id_and_text

ALL = frozenset({frozenset()})  # a query in disjunctive form that every document meets
MOST_BRANCHES = 64


def _both(a: frozenset, b: frozenset) -> frozenset:
    """Documents that meet both queries; a query may be weakened, never narrowed."""
    if len(a) * len(b) > MOST_BRANCHES:
        return a if len(a) <= len(b) else b
    return frozenset(x | y for x in a for y in b)


def _trigrams(text: str) -> frozenset:
    low = text.lower()
    return frozenset(low[i:i + 3].encode() for i in range(len(low) - 2)) if low.isascii() else frozenset()


def _pieces(parsed) -> Iterator[tuple[list[str] | None, frozenset]]:
    """For each element of a sequence: the texts it can be (None: any), and its own query."""
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            yield [chr(arg)], ALL
        elif name == "SUBPATTERN":
            yield from _pieces(arg[3])
        elif name == "BRANCH":
            found = [(_texts(p), query(p)) for p in arg[1]]
            texts = [t for ts, _ in found for t in ts or ()] if all(ts for ts, _ in found) else None
            yield texts if texts and len(texts) <= MOST_BRANCHES else None, frozenset().union(*(q for _, q in found))
        elif name == "IN" and len(arg) <= 8 and all(str(o) == "LITERAL" for o, _ in arg):
            yield [chr(a) for _, a in arg], ALL
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            least, most, inner = arg
            texts = _texts(inner)
            if texts and most == 1:
                yield ["", *texts], ALL
            elif texts and least == most and len(texts) == 1:
                yield [texts[0] * least], ALL
            else:
                yield None, query(inner) if least else ALL
        elif name == "AT":
            yield [""], ALL
        else:
            yield None, ALL


def _texts(parsed) -> list[str] | None:
    """All texts of a pattern, if they are few."""
    out = [""]
    for texts, _ in _pieces(parsed):
        if texts is None or len(out) * len(texts) > MOST_BRANCHES:
            return None
        out = [a + b for a in out for b in texts]
    return out


def query(parsed) -> frozenset:
    """Trigrams that a match must contain: a set of choices, each a set of trigrams."""
    found, stretch = ALL, [""]

    def close() -> frozenset:
        return _both(found, frozenset(_trigrams(t) for t in stretch))

    for texts, own in _pieces(parsed):
        found = _both(found, own)
        if texts is None or len(stretch) * len(texts) > MOST_BRANCHES:
            found, stretch = close(), [""] if texts is None else texts
        else:
            stretch = [a + b for a in stretch for b in texts]
    return close()


@dataclass(frozen=True)
class Rule:
    """`group` must have at least `least` characters; shorter matches are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0

    @cached_property
    def regex(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII)

    @cached_property
    def query(self) -> frozenset:
        """Choices without a choice that another one implies; ALL if nothing is mandatory."""
        found = query(regex_parser.parse(self.pattern, re.ASCII))
        return frozenset(q for q in found if not any(p < q for p in found))

    def find(self, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in self.regex.finditer(text) if len(m[self.group]) >= self.least]


# fixed values: the base rules, in the order in which kinds are listed
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
# fixed values: public formats of further credentials
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[baprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"[a-z][a-z0-9+]{1,20}://[^\s/:@]{1,64}:[^\s/:@]{1,64}@"),
)
RULES = BASE + MORE


class Segment:
    """Postings of the wanted trigrams over a list of texts."""

    def __init__(self, texts: list[str], wanted: set[bytes]) -> None:
        self.n = len(texts)
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        data = np.frombuffer(b"".join(raw).lower(), np.uint8).astype(np.uint32)
        codes = sorted({g[0] << 16 | g[1] << 8 | g[2]: g for g in wanted}.items())
        self.postings = {g: np.empty(0, np.int64) for g in wanted}
        if len(data) < 3 or not codes:
            return
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        grams = data[:-2] << np.uint32(16) | data[1:-1] << np.uint32(8) | data[2:]
        asked = np.zeros(1 << 24, bool)
        asked[[c for c, _ in codes]] = True
        at = np.flatnonzero(asked[grams])
        ends = np.cumsum(lengths)
        doc = np.searchsorted(ends, at, "right")
        inside = at + 3 <= ends[doc]  # a gram over the border of two texts is none
        pairs = np.unique(grams[at[inside]].astype(np.int64) << 32 | doc[inside])
        for code, gram in codes:
            low, high = np.searchsorted(pairs, [code << 32, (code + 1) << 32])
            self.postings[gram] = pairs[low:high] & 0xFFFFFFFF

    def candidates(self, choices: frozenset) -> np.ndarray:
        """Texts that meet a query: any choice whose trigrams are all there."""
        if frozenset() in choices:
            return np.arange(self.n)
        out = np.empty(0, np.int64)
        for grams in choices:
            lists = sorted((self.postings[g] for g in grams), key=len)
            met = lists[0]
            for other in lists[1:]:
                met = np.intersect1d(met, other, assume_unique=True)
            out = np.union1d(out, met)
        return out


def scan_texts(texts: list[str], rules: tuple[Rule, ...] = RULES) -> list[list[tuple[int, int, int]]]:
    """(start, number of the rule, end) of all matches in each text, sorted."""
    segment = Segment(texts, {g for r in rules for q in r.query for g in q})
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for k, rule in enumerate(rules):
        for i in segment.candidates(rule.query).tolist():
            found[i] += [(a, k, b) for a, b in rule.find(texts[i])]
    return [sorted(f) for f in found]


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and all spans (kind, start, end) of every text, in code points."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            found = scan_texts(column(batch, "text").to_pylist(), rules)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array([
                [{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in f] for f in found], kind)],
                ["doc_id", "spans"])

    return id_and_text(docs).mapInArrow(
        run, "doc_id LONG, spans ARRAY<STRUCT<kind: STRING, start: LONG, end: LONG>>")
