"""Smoothed sentence BLEU with higher-order functions.

Papineni et al. 2002, orders 1-4 with equal weights; smoothing method 1 of
Chen & Cherry 2014 (a zero count becomes 0.1). The n-grams that two texts share are counted
in one walk over both lists, sorted together, so the cost of a pair grows with the sum of
the two lengths (times the logarithm for sorting).
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from passagemill.functions.text import col, let, squeeze

EPSILON = 0.1
MAX_ORDER = 4


def tokens(c: Column | str) -> Column:
    """Whitespace tokens; an empty text has none."""
    return F.filter(F.split(squeeze(c), " "), lambda t: t != "")


def _ngrams(words: Column, n: Column) -> Column:
    last = F.size(words) - n + 1
    grams = F.transform(
        F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(last >= 1, grams).otherwise(F.array().cast("array<string>"))


def _clipped(hyp: Column, ref: Column) -> Column:
    """Size of the shared part of two n-gram lists, each counted as often as both have it.

    Equal n-grams lie side by side in the sorted list of both; the walk holds the counts of
    the n-gram it is at, and what the ones before it share.
    """
    def step(at: Column, x: Column) -> Column:
        same = at["gram"] == x["gram"]
        return F.struct(
            x["gram"].alias("gram"),
            (F.when(same, at["hyp"]).otherwise(0) + 1 - x["side"]).alias("hyp"),
            (F.when(same, at["ref"]).otherwise(0) + x["side"]).alias("ref"),
            F.when(same, at["shared"]).otherwise(at["shared"] + F.least(at["hyp"], at["ref"])).alias("shared"))

    # sort_array and plain fields keep the expression shallow: it stands deep inside searches
    both = F.sort_array(F.transform(F.concat(hyp, ref), lambda g, i: F.struct(
        g.alias("gram"), F.when(i < F.size(hyp), 0).otherwise(1).alias("side"))))
    start = F.struct(F.lit("").alias("gram"), F.lit(0).alias("hyp"), F.lit(0).alias("ref"), F.lit(0).alias("shared"))
    # most pairs share nothing, which a hash table of the shorter list shows at once
    return F.when(F.arrays_overlap(hyp, ref), F.aggregate(
        both, start, step, lambda at: at["shared"] + F.least(at["hyp"], at["ref"]))).otherwise(F.lit(0))


def _score(hyp: Column, ref: Column) -> Column:
    """Without a shared word the score is 0, and no longer n-grams are built."""
    hyp_len, ref_len = F.size(hyp), F.size(ref)

    def log_precision(count: Column, n: int) -> Column:
        # a count is 0, for which EPSILON stands, or at least 1
        return F.ln(F.greatest(count.cast("double"), F.lit(EPSILON)) / F.greatest(hyp_len - (n - 1), F.lit(1)))

    def longer(n: int) -> Column:
        return let(
            F.struct(_ngrams(hyp, F.lit(n)).alias("h"), _ngrams(ref, F.lit(n)).alias("r")),
            lambda g: log_precision(_clipped(g["h"], g["r"]), n))

    penalty = F.when(hyp_len > ref_len, F.lit(0.0)).otherwise(
        1.0 - ref_len / F.greatest(hyp_len, F.lit(1)))
    return let(_clipped(hyp, ref), lambda words: F.when(words == 0, F.lit(0.0)).otherwise(F.exp(
        penalty + (log_precision(words, 1) + longer(2) + longer(3) + longer(4)) / MAX_ORDER)))


def bleu_max(hypothesis: Column | str, references: Column | str) -> Column:
    """Best score over the references; null when there is none."""
    return let(tokens(hypothesis), lambda h: F.array_max(F.transform(
        col(references), lambda r: let(tokens(r), lambda words: _score(h, words)))))
