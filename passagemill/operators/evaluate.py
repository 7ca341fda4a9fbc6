"""Scoring of generated answers and the metrics over scored runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from passagemill import fixed_values as fv
from passagemill.functions import match as M, selection as S
from passagemill.functions.automaton import answers_in_texts
from passagemill.functions.text import first_line
from passagemill.operators.joins import first_per_key, lookup


def attach_gold(results: DataFrame, gold: DataFrame, is_stored: bool = False) -> DataFrame:
    """Left join of gold `answers` by example id; the first gold row of an id wins.

    `gold` has example_pos, example_id, answers. Rows without gold keep null answers.
    Run it on narrow rows, before prompts are built, when you can; `is_stored` spares a run
    that is a stored table from being written once more.
    """
    single = first_per_key(
        gold.select("example_id", "example_pos", "answers"), "example_id", "example_pos")
    answers = single.select("example_id", "answers")
    return lookup(results.drop("answers"), answers, "example_id", is_stored=is_stored)


def score(results: DataFrame, with_proof: bool = False) -> DataFrame:
    """Per-row flags; needs prompt, answers, generated_answer, document_indices, gold."""
    flagged = (
        results.withColumn("generated_answer", first_line("generated_answer"))
        .withColumn("ans_match_after_norm", M.answer_match("generated_answer", "answers"))
        .withColumn("gold_in_retrieved", gold_recall("document_indices", "gold_document_idx"))
        .withColumn("ans_in_documents", M.answer_in_text("prompt", "answers"))
        .withColumn("is_no_res", M.abstains("generated_answer"))
        .withColumn("is_correct", M.is_correct(
            F.col("ans_in_documents"), F.col("ans_match_after_norm"), F.col("is_no_res")))
    )
    if with_proof:
        flagged = flagged.withColumn("proof", M.proof_of("generated_answer")).withColumn(
            "ans_in_proof", M.answer_in_proof("proof", "generated_answer"))
    return flagged


def score_query_only(results: DataFrame) -> DataFrame:
    """The two flags of runs without documents; a row without gold answers is an error."""
    answers = F.when(
        F.col("answers").isNull(), F.raise_error(F.lit("no gold answers for example"))
        .cast("array<string>")).otherwise(F.col("answers"))
    return (
        results.withColumn("answers", answers)
        .withColumn("generated_answer", first_line("generated_answer"))
        .withColumn("ans_match_after_norm", M.answer_match("generated_answer", "answers"))
        .withColumn("ans_in_documents", M.answer_in_text("prompt", "answers"))
    )


def evaluate_run(results: DataFrame, gold: DataFrame, with_proof: bool = False) -> DataFrame:
    return score(attach_gold(results, gold), with_proof)


def gold_recall(ids: Column | str, gold: Column | str) -> Column:
    return F.array_contains(ids, F.col(gold) if isinstance(gold, str) else gold)


# --- metrics; each is an aggregate expression, so any grouping can use it -------
def _percent(hits: Column, total: Column) -> Column:
    """Share in percent, rounded at four digits of the fraction; 0 for an empty base."""
    return F.coalesce(
        F.round(F.round(F.try_divide(hits, total), 4) * 100, 6), F.lit(0.0))


def accuracy(flag: str) -> Column:
    return _percent(F.count_if(F.col(flag)), F.count("*"))


def context_aware_accuracy() -> Column:
    right = M.is_correct(
        F.col("ans_in_documents"), F.col("ans_match_after_norm"), M.abstains("generated_answer"))
    return _percent(F.count_if(right), F.count("*"))


def negative_rejection_rate() -> Column:
    outside = ~F.col("ans_in_documents")
    return _percent(
        F.count_if(outside & M.abstains_strict("generated_answer")), F.count_if(outside))


def correct_without_context_rate() -> Column:
    outside = ~F.col("ans_in_documents")
    return _percent(F.count_if(outside & F.col("ans_match_after_norm")), F.count_if(outside))


def missing_proof_rate() -> Column:
    return _percent(F.count_if(F.col("proof") == fv.NO_PROOF), F.count("*"))


def context_breakdown(scored: DataFrame) -> DataFrame:
    inside, match = F.col("ans_in_documents"), F.col("ans_match_after_norm")
    counts = scored.agg(
        F.count("*").alias("total_examples"),
        F.count_if(inside).alias("examples_with_answer_in_context"),
        F.count_if(~inside).alias("examples_without_answer_in_context"),
        F.count_if(inside & match).alias("correct_with_context"),
        F.count_if(~inside & match).alias("correct_without_context"),
        F.count_if(match).alias("total_correct"),
    )

    def ratio(hits: str, total: str) -> Column:
        return F.coalesce(F.try_divide(F.col(hits), F.col(total)), F.lit(0.0))

    return counts.select(
        "total_examples", "examples_with_answer_in_context",
        "examples_without_answer_in_context", "correct_with_context", "correct_without_context",
        ratio("correct_with_context", "examples_with_answer_in_context")
        .alias("average_correct_with_context"),
        ratio("correct_without_context", "examples_without_answer_in_context")
        .alias("average_correct_without_context"),
        ratio("total_correct", "total_examples").alias("overall_accuracy"),
    )


def metrics_by(scored: DataFrame, *keys: str) -> DataFrame:
    """All run metrics for each run in one aggregate."""
    return scored.groupBy(*keys).agg(
        F.count("*").alias("examples"),
        accuracy("ans_match_after_norm").alias("match_accuracy"),
        context_aware_accuracy().alias("context_aware_accuracy"),
        negative_rejection_rate().alias("negative_rejection_rate"),
        correct_without_context_rate().alias("correct_without_context_rate"),
    )


TOTAL = -1


def _histogram(sized: DataFrame) -> DataFrame:
    """One row per size 0..5, empty ones included, and the total over all sizes, in one pass."""
    rolled = sized.rollup("n_docs").agg(
        F.grouping("n_docs").alias("_all"), F.count("*").alias("examples"),
        F.count_if("hit").alias("with_answer"))
    size = F.when(F.col("_all") == 1, F.lit(TOTAL)).otherwise(F.col("n_docs"))
    counted = rolled.select(size.alias("n_docs"), "examples", "with_answer")
    sizes = sized.sparkSession.range(TOTAL, 6).select(F.col("id").cast("int").alias("n_docs"))
    return sizes.join(counted, "n_docs", "left").na.fill(0, ["examples", "with_answer"])


def selection_histogram(selected: DataFrame) -> DataFrame:
    """Strict sizes 0..5 with answer-present counts, and the total (n_docs = -1).

    Larger selections appear only in the total.
    """
    return _histogram(selected.select(
        S.valid_id_count("selected_ids_raw").alias("n_docs"),
        M.answer_after_marker("prompt", "answers").alias("hit")))


def selection_histogram_loose(scored: DataFrame) -> DataFrame:
    """Loose sizes 0..5; the total row counts relevant rows of every size."""
    return _histogram(scored.select(
        S.valid_id_count_loose("selected_ids_raw").alias("n_docs"),
        F.col("ans_in_documents").alias("hit")))


def selection_audit(selected: DataFrame) -> DataFrame:
    """Answer hits among the documents before and after a selection.

    Needs parsed docs (doc_id, block, body), document_indices, selected_ids_raw, answers.
    Each body is walked once for all answers; both sides of the audit use what it found.
    """
    bodies = F.transform("docs", lambda d: F.lower(d["body"]))
    lowered = F.transform("answers", F.lower)
    found = selected.withColumn("_found", answers_in_texts(bodies, lowered))
    hits = found.withColumn(
        "_before", S.ids_found("docs", "document_indices", "_found")
    ).withColumn("_after", S.hits_found("docs", "selected_ids_raw", "answers", "_found"))
    named = F.filter("_after", lambda h: h["answer"] != "")
    return (
        hits.withColumn("has_answer_before", F.size("_before") > 0)
        .withColumn("ids_before", F.col("_before"))
        .withColumn("has_answer_after", F.size("_after") > 0)
        .withColumn("first_answer", F.coalesce(
            F.get(named, F.lit(0))["answer"], F.when(F.size("_after") > 0, F.lit(""))))
        .withColumn("ids_after", F.transform("_after", lambda h: h["doc_id"]))
        .withColumn("ids_selected", S.split_ids("selected_ids_raw"))
        .drop("_before", "_after", "_found")
    )


def selection_audit_rollup(audit: DataFrame) -> DataFrame:
    before, after = F.col("has_answer_before"), F.col("has_answer_after")
    return audit.agg(
        F.count("*").alias("examples"),
        F.round(F.avg(before.cast("int")), 4).alias("answer_before_rate"),
        F.round(F.avg(after.cast("int")), 4).alias("answer_after_rate"),
        F.count_if(before & after).alias("kept"), F.count_if(before & ~after).alias("lost"),
    )
