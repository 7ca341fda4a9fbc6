"""Training sets for the document selector."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from passagemill import fixed_values as fv
from passagemill.functions import prompts as P
from passagemill.functions.selection import alias_map
from passagemill.functions.text import stable_hash
from passagemill.operators.ranking import kth_keys, up_to
from passagemill.session import stored

_NO_MAP = "map<string,bigint>"


def _shuffled(items: Column, key: Column, seed: int) -> Column:
    """Seeded permutation of a short list, the same on every retry."""
    keyed = F.transform(items, lambda x: F.struct(
        stable_hash(F.concat_ws("/", key, x.cast("string")), seed).alias("h"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda s: s["x"])


def instruction_rows(
    silver: DataFrame, max_tokens: int, shuffle_seed: int | None = None, count_tokens=P.token_len,
) -> DataFrame:
    """Answerable silver rows as prompt, id map and target.

    Needs example_id, query, docs, selected_documents, are_answer. The id map belongs
    to its row; it is empty when nothing is selected, though the prompt lists documents.
    """
    selected = F.col("selected_documents")
    ids = F.transform("docs", lambda d: d["doc_id"])
    aliases = F.transform("docs", lambda d, i: F.when(
        F.array_contains(selected, d["doc_id"]),
        F.concat(F.lit(fv.ALIAS_PREFIX), (i + 1).cast("string"))))
    chosen = F.filter(aliases, lambda a: a.isNotNull())
    if shuffle_seed is not None:
        chosen = _shuffled(chosen, F.col("example_id"), shuffle_seed)
    rows = silver.where("are_answer").withColumn("prompt", F.concat(
        F.lit(fv.TRAINING_QUESTION), "query", F.lit(fv.TRAINING_DOCUMENTS), P.render_context_aliased("docs")))
    rows = rows.where(count_tokens(F.col("prompt")) < max_tokens)
    return rows.select(
        "example_id", "prompt", "selected_documents",
        F.when(F.size(selected) == 0, F.create_map().cast(_NO_MAP))
        .otherwise(alias_map(ids)).alias("id_map"),
        F.array_join(chosen, ", ").alias("output"),
    ).withColumn("output", F.when(F.col("output") == "", fv.NO_DOCS).otherwise(F.col("output")))


def chat_rows(
    rows: DataFrame, instruction: str = fv.INSTRUCTION_SELECT_ALIASES, training: bool = True
) -> DataFrame:
    """Adds `chat` turns and `formatted_chat`; the test form has no assistant turn."""
    reply = F.col("output") if training else None
    return rows.withColumn("chat", P.messages(instruction, F.col("prompt"), reply)).withColumn(
        "formatted_chat", P.render_chat(F.col("chat")))


def _query_text() -> Column:
    return F.concat(
        F.lit(fv.SAMPLE_OPENING), F.col("query"))


def _reordered(ids: Column, key: Column, seed: int) -> Column:
    """A seeded order that differs from the given one."""
    mixed = _shuffled(ids, key, seed)
    turned = F.concat(F.slice(ids, 2, F.size(ids)), F.slice(ids, 1, 1))
    return F.when(mixed == ids, turned).otherwise(mixed)


def _sampled(cased: DataFrame, reranked: Column) -> DataFrame:
    """Input and output lists of each case; rows without a case are over quota."""
    case = F.col("sample_case")
    selected = F.col("selected_documents")
    retrieved = (
        F.when(case.isin("case_1_single_doc", "case_2_multiple_docs"), F.col("document_indices"))
        .when(case == "case_3_no_docs", F.array().cast("array<bigint>"))
        .when(case == "case_5_reranking", reranked)
        .otherwise(selected))
    return cased.where(case.isNotNull()).select(
        "example_pos", "example_id", "sample_case", _query_text().alias("query"),
        retrieved.alias("retrieved_docs"), selected.alias("output"))


def _cut_cases(
    rows: DataFrame, group: str, order: str, quotas: dict[int, list[tuple[str, int]]], tie: str | None = None,
) -> tuple[Column, dict]:
    """The case of each row where the rows of a group fill its cases one after another in
    key order, and the keys of the cuts. Rows beyond the last quota have none."""
    ends = {g: [sum(n for _, n in cases[:i + 1]) for i in range(len(cases))] for g, cases in quotas.items()}
    cuts = kth_keys(rows, group, order, {g: set(e) - {0} for g, e in ends.items()}, tie)
    case = F.when(F.lit(False), F.lit(None).cast("string"))
    for g, cases in quotas.items():
        for (name, n), end in zip(cases, ends[g]):
            if n:
                case = case.when((F.col(group) == g) & up_to(cuts[g, end], order, tie), F.lit(name))
    return case, {(g, name): cuts.get((g, end)) for g in quotas for (name, _), end in zip(quotas[g], ends[g])}


def quota_sample(
    silver: DataFrame, seed: int = 10, shares: dict[str, float] | None = None
) -> DataFrame:
    """Quota sample by selection size; each group fills its cases in input order.

    Quotas are floors of shares of the answerable rows with 0, 1 or several documents.
    Needs example_pos (which tells rows apart), example_id, query, document_indices,
    selected_documents, are_answer. `silver` is evaluated once; the cuts between the cases
    are found by counting, so rows are filtered and never sorted.
    """
    shares = shares or fv.GROUP_SHARES
    valid = stored(silver.where("are_answer").withColumn(
        "_group", F.least(F.size("selected_documents"), F.lit(2))), "answerable")
    sizes = {r["_group"]: r["count"] for r in valid.groupBy("_group").count().collect()}

    def quotas(group: int, *cases: str) -> list[tuple[str, int]]:
        return [(c, math.floor(sizes.get(group, 0) * shares[c])) for c in cases]

    case, _ = _cut_cases(valid, "_group", "example_pos", {
        0: quotas(0, "case_3_no_docs"),
        1: quotas(1, "case_1_single_doc", "case_6_single_doc_unchanged"),
        2: quotas(2, "case_2_multiple_docs", "case_4_multi_doc_unchanged", "case_5_reranking")})
    return _sampled(valid.withColumn("sample_case", case), _reordered(
        F.col("selected_documents"), F.col("example_id"), seed))


def quota_sample_global(
    silver: DataFrame, seed: int = 10, shares: dict[str, float] | None = None
) -> DataFrame:
    """Quota sample with quotas on the whole input, taken in a seeded shuffled order.

    Rows with several documents fill case 2; what is left over and has more than two
    documents fills case 4 and then case 5. Like the other sample it reads `silver` once
    and filters its rows by cut keys.
    """
    shares = shares or fv.GLOBAL_SHARES
    size = F.size("selected_documents")
    rows = stored(silver.withColumn("_group", F.when(F.col("are_answer"), F.least(size, F.lit(2)))).withColumn(
        "_order", stable_hash(F.concat_ws("/", "example_id", "example_pos"), seed)), "silver")
    total = rows.count()

    def quota(case: str) -> tuple[str, int]:
        return case, math.floor(total * shares[case])

    early, cuts = _cut_cases(rows, "_group", "_order", {
        0: [quota("case_3_no_docs")], 1: [quota("case_1_single_doc")], 2: [quota("case_2_multiple_docs")],
    }, "example_pos")
    several = (F.col("_group") == 2) & (size > 2)
    if quota("case_2_multiple_docs")[1]:
        several &= ~up_to(cuts[2, "case_2_multiple_docs"], "_order", "example_pos")
    left = rows.withColumn("_left", F.when(several, F.lit(3)))
    late, _ = _cut_cases(left, "_left", "_order", {3: [quota("case_4_less_docs"), quota("case_5_reranking")]}, "example_pos")
    mixed = _shuffled(F.col("selected_documents"), F.col("example_id"), seed)
    return _sampled(left.withColumn("sample_case", F.coalesce(early, late)), mixed)
