"""Joins between scored runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from passagemill import fixed_values as fv
from passagemill.functions.selection import order_changed
from passagemill.operators.joins import last_per_key, lookup, semi_lookup
from passagemill.session import stored


def common_answerable(run_a: DataFrame, run_b: DataFrame) -> DataFrame:
    """Whole rows of A, and B's `match_b`, where both have the answer in the context.

    Both need example_id, row_pos, ans_in_documents, ans_match_after_norm; the last row of
    an example counts.
    """
    flags = ["example_id", "row_pos", "ans_in_documents", "ans_match_after_norm"]
    a = last_per_key(run_a, "example_id", "row_pos").where("ans_in_documents")
    b = last_per_key(run_b.select(*flags), "example_id", "row_pos").where("ans_in_documents")
    return a.join(b.select("example_id", F.col("ans_match_after_norm").alias("match_b")), "example_id")


def compare_common(run_a: DataFrame, run_b: DataFrame) -> DataFrame:
    def share(flag: str):
        return F.coalesce(F.avg(F.col(flag).cast("int")), F.lit(0.0))

    flags = ["example_id", "row_pos", "ans_in_documents", "ans_match_after_norm"]
    return common_answerable(run_a.select(*flags), run_b).agg(
        F.count("*").alias("common_examples"),
        F.round(share("ans_match_after_norm"), 6).alias("accuracy_a"),
        F.round(share("match_b"), 6).alias("accuracy_b"))


def common_ids(run_a: DataFrame, run_b: DataFrame) -> DataFrame:
    """Ids of both runs; each side is made distinct map-side before it is shuffled."""
    return run_a.select("example_id").distinct().intersect(run_b.select("example_id").distinct())


def value_by_text(
    rows: DataFrame, other: DataFrame, text: str, value: Column, out: str,
    digest: Callable[[Column], Column] = F.md5,
) -> DataFrame:
    """The rows with `out`, the value of the last row of `other` (by example_pos) whose text is equal.

    Rows meet by a 128-bit digest, and a value counts only where the texts themselves are
    equal. So what is shuffled, grouped and counted as a key is short however long the texts
    are; a text travels once, as a value. Of digests that stand for more than one text, which
    hardly happens, all texts are kept with their own values.
    """
    given = other.select(
        digest(F.col(text)).alias("_text_digest"), F.struct(F.col(text).alias("text"), value.alias("value")).alias("_option"),
        "example_pos")
    latest = stored(given.groupBy("_text_digest").agg(
        F.max_by("_option", "example_pos").alias("_option"), F.min("_option.text").alias("_first"),
        F.max("_option.text").alias("_last")), "by-text")
    shared = latest.where("_first <> _last").select("_text_digest")
    several = given.join(shared, "_text_digest", "left_semi").groupBy("_text_digest", "_option.text").agg(
        F.max_by("_option", "example_pos").alias("_option")).groupBy("_text_digest").agg(
        F.collect_list("_option").alias("_options"))
    one = latest.where("_first = _last").select("_text_digest", F.array("_option").alias("_options"))
    found = lookup(rows.withColumn("_text_digest", digest(F.col(text))), one.unionByName(several), "_text_digest")
    mine = F.filter("_options", lambda o: o["text"] == F.col(text))
    return found.withColumn(out, F.get(mine, F.lit(0))["value"]).drop("_text_digest", "_options")


def attach_example_id(
    rows: DataFrame, questions: DataFrame, digest: Callable[[Column], Column] = F.md5,
) -> DataFrame:
    """Set example_id where the query equals a question; the last duplicate question wins."""
    asked = questions.withColumnRenamed("question", "query") if "query" not in questions.columns else \
        questions.drop("query").withColumnRenamed("question", "query")
    found = value_by_text(rows, asked, "query", F.col("example_id"), "_new_id", digest)
    return found.withColumn("example_id", F.coalesce("_new_id", "example_id")).drop("_new_id")


def attach_doc_indices(
    rows: DataFrame, other: DataFrame, digest: Callable[[Column], Column] = F.md5,
) -> DataFrame:
    """Set document_indices from the last row of `other` with the same query.

    A match without a list gives an empty list; no match keeps what was there.
    """
    ids = F.coalesce("document_indices", F.array().cast("array<bigint>"))
    found = value_by_text(rows, other, "query", ids, "_ids", digest)
    return found.withColumn("document_indices", F.coalesce("_ids", "document_indices")).drop("_ids")


def _last_of(run: DataFrame) -> DataFrame:
    return last_per_key(
        run.select("example_id", "row_pos", "is_correct", "generated_answer"),
        "example_id", "row_pos")


def wins_a_over_b(run_a: DataFrame, run_b: DataFrame) -> DataFrame:
    """Rows A answers correctly from its documents while B has the example and is wrong."""
    wrong_b = _last_of(run_b).where(~F.col("is_correct"))
    won = run_a.where(
        F.col("is_correct") & F.col("ans_in_documents")
        & (F.col("generated_answer") != fv.ABSTAIN_TOKEN))
    return semi_lookup(won, wrong_b, "example_id")


def wins_reordered(wins: DataFrame) -> DataFrame:
    return wins.where(order_changed("selected_ids_raw", "document_indices"))


def useful_abstentions(run_a: DataFrame, run_b: DataFrame) -> DataFrame:
    """A abstains rightly without a retrieved document; B answers and is wrong.

    Selected and retrieved ids are compared as text.
    """
    selected = F.filter(
        F.split("selected_ids_raw", ","), lambda p: ~F.contains(p, F.lit("Unknown")))
    retrieved = F.transform("document_indices", lambda i: i.cast("string"))
    quiet = run_a.where(
        F.col("is_correct") & F.col("is_no_res")
        & (F.col("generated_answer") == fv.ABSTAIN_TOKEN)
        & ~F.arrays_overlap(selected, retrieved))
    wrong_b = _last_of(run_b).where(
        ~F.col("is_correct") & (F.col("generated_answer") != fv.ABSTAIN_TOKEN))
    return semi_lookup(quiet, wrong_b, "example_id")
