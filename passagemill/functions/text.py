"""Text normalization as plain Catalyst expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from passagemill import fixed_values as fv


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind `value` once and use it several times inside `body`.

    Without it Catalyst may repeat a costly expression for every use in a lambda.
    """
    return F.transform(F.array(value), body)[0]


# (characters, replacement) pairs; no replacement is itself a listed character,
# so one `translate` call does them all at once.
_ONE_TO_ONE = (
    (fv.SPACE_LIKE, " "),
    (fv.HYPHENS + fv.MINUSES, "-"),
    (fv.DOUBLE_QUOTES, '"'),
    (fv.SINGLE_QUOTES + fv.APOSTROPHES + fv.ACCENTS + fv.SINGLE_PRIMES, "'"),
    (fv.SLASHES, "/"),
    (fv.TILDES, "~"),
)
_ONE_TO_MANY = (
    (fv.DOUBLE_PRIMES, "''"),
    (fv.TRIPLE_PRIMES, "'''"),
    (fv.QUADRUPLE_PRIMES, "''''"),
    (fv.ELLIPSIS, "..."),
)


def norm_table() -> tuple[str, str]:
    """The two arguments of `translate`; trailing sources without target are deleted."""
    source = "".join(chars for chars, _ in _ONE_TO_ONE)
    target = "".join(new * len(chars) for chars, new in _ONE_TO_ONE)
    return source + fv.DELETED_CONTROLS + fv.SOFT_HYPHEN, target


def norm_replacements() -> list[tuple[str, str]]:
    pairs = [(ch, new) for chars, new in _ONE_TO_MANY for ch in chars]
    return pairs + [(fv.SPACED_DOTS, fv.CLOSED_DOTS)]


def norm_text(c: Column | str) -> Column:
    """Unify dashes, quotes, primes, slashes, tildes and ellipses; drop controls."""
    out = F.translate(col(c), *norm_table())
    for old, new in norm_replacements():
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def _spaces_to_one(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "  +", " "))


def _runs_to_space(c: Column | str, also: str = "") -> Column:
    """Runs of whitespace and the ASCII characters `also` become one space; ends are trimmed.

    One regular expression over the text: `translate` looks every character up in a hash map.
    Single characters below 256 share one bit set in a Java class, and the property stands for
    the whitespace beyond, where ranges would each be tried for every character.
    """
    low = "".join(f"\\x{{{ord(ch):x}}}" for ch in fv.WHITESPACE + also if ord(ch) < 256)
    return F.trim(F.regexp_replace(col(c), f"[{low}\\p{{IsWhite_Space}}]+", " "))


def squeeze(c: Column | str) -> Column:
    """Whitespace runs become one space; ends are trimmed."""
    return _runs_to_space(c)


def strip_punct(c: Column | str) -> Column:
    """Each ASCII punctuation character becomes a space."""
    return F.translate(col(c), fv.PUNCTUATION, " " * len(fv.PUNCTUATION))


def strip_articles(c: Column | str) -> Column:
    """Whole words a/an/the (case-sensitive) become a space."""
    return F.regexp_replace(col(c), r"(?U)\b(?:" + "|".join(fv.ARTICLES) + r")\b", " ")


def squash(c: Column | str) -> Column:
    """Punctuation to spaces plus whitespace squeeze, in one pass."""
    return _runs_to_space(c, fv.PUNCTUATION)


def _answer_table() -> tuple[str, str]:
    """One `translate` for clean-up, punctuation and whitespace together.

    Everything the clean-up turns into punctuation would become a space right after, and
    runs of spaces are joined at the end, so those steps can be one pass over the text.
    """
    to_space = fv.WHITESPACE + fv.PUNCTUATION
    to_space += "".join(chars for chars, _ in _ONE_TO_ONE + _ONE_TO_MANY)
    deleted = fv.DELETED_CONTROLS + fv.SOFT_HYPHEN
    return to_space + deleted, " " * len(to_space)


def norm_answer(c: Column | str, lowercase: bool = True) -> Column:
    """Answer form used by every comparison: unicode clean-up, no punctuation, no articles."""
    base = F.lower(col(c)) if lowercase else col(c)
    return _spaces_to_one(strip_articles(F.translate(base, *_answer_table())))


def strip(c: Column | str) -> Column:
    """Trim all unicode whitespace from both ends."""
    return F.btrim(col(c), F.lit(fv.WHITESPACE))


def first_line(c: Column | str) -> Column:
    return F.substring_index(col(c), "\n", 1)


def stable_hash(c: Column, seed: int) -> Column:
    """Seeded 60-bit hash that any SQL engine with md5 can reproduce."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), c.cast("string")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def words_at(c: Column, start: int, count: int) -> Column:
    """Words start..start+count-1 (1-based) of single-spaced text, '' when there are fewer."""
    skip = f"(?:[^ ]+ ){{{start - 1}}}" if start > 1 else ""
    return F.regexp_extract(c, f"^{skip}([^ ]+(?: [^ ]+){{0,{count - 1}}})", 1)


def raw_words_at(c: Column, start: int, count: int) -> Column:
    """`words_at` of text that is not single-spaced yet; only the words found are cleaned."""
    spaces = fv.WHITESPACE.replace(" ", r"\x20")
    skip = f"(?:[^{spaces}]+[{spaces}]+){{{start - 1}}}" if start > 1 else ""
    more = f"(?:[{spaces}]+[^{spaces}]+){{0,{count - 1}}}"
    return squeeze(F.regexp_extract(c, f"^[{spaces}]*{skip}([^{spaces}]+{more})", 1))


def words_from(c: Column, start: Column | int, count: Column | int) -> Column:
    """`count` words of short single-spaced text, from word number `start`."""
    return F.array_join(F.slice(F.split(c, " "), start, count), " ")
