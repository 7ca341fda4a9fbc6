"""Silver labels: greedy search for the documents that make the generator answer best.

Every step of the search for one example needs only that example's few retrieved
documents, so the search is row-local: no shuffle, and no per-example loop on the
driver. With a column generator the whole search is one expression over a row; with a
model each round is one batch job over the candidates of all active examples.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from passagemill import fixed_values as fv
from passagemill.functions import prompts as P
from passagemill.functions.bleu import bleu_max
from passagemill.functions.match import answer_match
from passagemill.functions.text import col, first_line, let
from passagemill.operators.generate import Model, replies
from passagemill.schemas import TRACE
from passagemill.session import stored, stored_by

Generator = Callable[[Column], Column]
_IDS = "array<bigint>"
_STATE = (
    f"struct<silver:{_IDS}, silver_ok:boolean, silver_score:double, best_doc:bigint, "
    f"best_ok:boolean, best_score:double, active:boolean, trace:{TRACE}>"
)


_CONTENT = "_content"


def _with_content(docs: Column) -> Column:
    """The documents with a hash of their content, made once for all candidates."""
    return F.transform(docs, lambda d: d.withField(
        _CONTENT, P.content_hash(*(F.coalesce(d[c], F.lit("")) for c in ("title", "text")))))


def _first_of_content(docs: Column) -> Column:
    """The first document of each content, without the hash."""
    first = let(F.transform(docs, lambda d: d[_CONTENT]), lambda texts: F.filter(
        docs, lambda d, i: F.array_position(texts, d[_CONTENT]) == i + 1))
    return F.transform(first, lambda d: d.dropFields(_CONTENT))


def _distinct_content(docs: Column) -> Column:
    return let(_with_content(docs), _first_of_content)


def _candidate(base: Column, doc_id: Column, ids: Column, docs: Column) -> Column:
    """Struct (doc_id, ids, docs, prompt) the generator gets for one set of documents."""

    def build(kept: Column) -> Column:
        text = F.concat(base, P.render_context(kept))
        cue = F.when(F.contains(text, F.lit(fv.ANSWER_CUE)), F.lit("")).otherwise(
            F.lit(fv.ANSWER_CUE))
        return F.struct(
            doc_id.alias("doc_id"), ids.alias("ids"), kept.alias("docs"),
            F.concat(text, cue).alias("prompt"))

    return let(_first_of_content(docs), build)


def _no_documents(base: Column, docs: Column) -> Column:
    return F.array(_candidate(
        base, F.lit(None).cast("bigint"), F.array().cast(_IDS), F.slice(docs, 1, 0)))


def _one_more_document(base: Column, docs: Column, state: Column) -> Column:
    """Every unselected document appended to the current selection, in list order."""
    silver = state["silver"]
    rest = F.filter(docs, lambda d: state["active"] & ~F.array_contains(silver, d["doc_id"]))
    chosen = F.transform(
        silver, lambda i: F.get(F.filter(docs, lambda d: d["doc_id"] == i), F.lit(0)))
    return let(chosen, lambda picked: F.transform(rest, lambda d: _candidate(
        base, d["doc_id"], F.concat(silver, F.array(d["doc_id"])),
        F.concat(picked, F.array(d)))))


def _result(candidate: Column, reply: Column, answers: Column, extract) -> Column:
    """Judged reply to one candidate (doc_id, ids)."""
    return let(extract(reply), lambda answer: F.struct(
        candidate["doc_id"].alias("doc_id"),
        candidate["ids"].alias("candidate_documents"),
        answer.alias("generated_answer"),
        answer_match(answer, answers).alias("is_correct"),
        bleu_max(answer, answers).alias("bleu_score")))


def _results(candidates: Column, replied: Column, answers: Column, extract) -> Column:
    """Judged replies, one per candidate, in order."""
    return F.zip_with(
        candidates, replied, lambda candidate, reply: _result(candidate, reply, answers, extract))


def _trace_of(results: Column) -> Column:
    fields = ("candidate_documents", "generated_answer", "is_correct", "bleu_score")
    return F.transform(results, lambda r: F.struct(*[r[f].alias(f) for f in fields]))


def _first_state(results: Column) -> Column:
    """State after the evaluation without documents."""
    right = results[0]["is_correct"]
    score = F.when(right, results[0]["bleu_score"]).otherwise(F.lit(0.0))
    return F.struct(
        F.array().cast(_IDS).alias("silver"), right.alias("silver_ok"),
        score.alias("silver_score"), F.lit(None).cast("bigint").alias("best_doc"),
        right.alias("best_ok"), score.alias("best_score"), F.lit(True).alias("active"),
        _trace_of(results).alias("trace")).cast(_STATE)


def _next_state(state: Column, results: Column) -> Column:
    """Keep the best right candidate so far; append it if it beats the selection."""
    top = F.array_max(F.transform(
        F.filter(results, lambda r: r["is_correct"]),
        lambda r, i: F.struct(
            r["bleu_score"].alias("score"), (-i).alias("order"), r["doc_id"].alias("doc_id"))))

    def best(t: Column) -> Column:
        better = t.isNotNull() & (~state["best_ok"] | (t["score"] > state["best_score"]))
        return F.struct(
            F.when(better, t["doc_id"]).otherwise(state["best_doc"]).alias("doc"),
            F.when(better, t["score"]).otherwise(state["best_score"]).alias("score"),
            (state["best_ok"] | F.coalesce(better, F.lit(False))).alias("ok"))

    def grown(b: Column) -> Column:
        grows = F.coalesce(
            state["active"] & b["ok"] & b["doc"].isNotNull()
            & ~F.array_contains(state["silver"], b["doc"])
            & (~state["silver_ok"] | (b["score"] > state["silver_score"])), F.lit(False))
        return let(grows, lambda g: F.struct(
            F.when(g, F.concat(state["silver"], F.array(b["doc"])))
            .otherwise(state["silver"]).alias("silver"),
            (state["silver_ok"] | g).alias("silver_ok"),
            F.when(g, b["score"]).otherwise(state["silver_score"]).alias("silver_score"),
            b["doc"].alias("best_doc"), b["ok"].alias("best_ok"), b["score"].alias("best_score"),
            g.alias("active"),
            F.concat(state["trace"], _trace_of(results)).alias("trace")).cast(_STATE))

    return let(let(top, best), grown)


def _base_prompt(base_prompt: Column | None) -> Column:
    return base_prompt if base_prompt is not None else P.fill(
        P.TEMPLATES["answer_training"], "query")


def _unpacked(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in df.columns if c not in ("base_prompt", "state", "_searched")], "state.*")


def mine_silver(
    contexts: DataFrame, generate: Generator, extract=first_line,
    base_prompt: Column | None = None,
) -> DataFrame:
    """Greedy selection with a column generator, until nothing improves; adds `silver`,
    `silver_score`, `trace` and the search state.

    `contexts` needs query, answers and docs (doc_id, title, text). `generate` maps an
    array of candidates (doc_id, ids, docs, prompt) to their replies. Each round but the
    last adds a document, so an example has at most one round more than documents.
    """
    every = F.sequence(F.lit(0), F.coalesce(F.size("docs"), F.lit(0)))
    return _mined(contexts, generate, every, extract, base_prompt)


def silver_round(
    contexts: DataFrame, generate: Generator, extract=first_line,
    base_prompt: Column | None = None,
) -> DataFrame:
    """The evaluation without documents and one round of the search."""
    return _mined(contexts, generate, F.array(F.lit(0)), extract, base_prompt)


def _mined(
    contexts: DataFrame, generate: Generator, rounds: Column, extract, base_prompt: Column | None,
) -> DataFrame:
    docs, answers = F.col("_searched"), F.col("answers")
    prepared = contexts.withColumn("base_prompt", _base_prompt(base_prompt)).withColumn(
        "_searched", _with_content(F.col("docs")))
    base = F.col("base_prompt")

    def judged(candidates: Column, then: Callable[[Column], Column]) -> Column:
        return let(candidates, lambda c: let(_results(c, generate(c), answers, extract), then))

    search = F.aggregate(
        rounds,
        judged(_no_documents(base, docs), _first_state),
        lambda state, _: F.when(state["active"], judged(
            _one_more_document(base, docs, state), lambda r: _next_state(state, r)))
        .otherwise(state))
    return _unpacked(prepared.withColumn("state", search))


def mine_silver_with_model(
    contexts: DataFrame, model: Model, extract=first_line, base_prompt: Column | None = None,
    batch_size: int | None = None, token_budget: int | None = None, store=None,
) -> DataFrame:
    """The same search with a model, which gets the prompts of a round in batches.

    The contexts are written once. A round flattens the candidates of the active examples
    to one row each, sends row number, candidate ids and prompt to the model, and writes
    its replies and the new states to the shared folder, so that a lost executor never
    calls the model again for a finished round. Finished examples leave the search; it
    ends when none is active. With a `store` (replies.ReplyStore) a prompt is asked once
    across rounds, runs and restarts.
    """
    rows = stored(
        contexts.withColumn("base_prompt", _base_prompt(base_prompt))
        .withColumn("_row", F.monotonically_increasing_id()), "silver-contexts")
    # what a round needs lies bucketed by row, so that no round shuffles the documents
    searched = stored_by(rows.select(
        "_row", "answers", "base_prompt", _with_content(F.col("docs")).alias("docs")), "_row", "silver-searched")
    answers = searched.select("_row", "answers")
    base, docs, state = F.col("base_prompt"), F.col("docs"), F.col("state")

    def judged(asked: DataFrame) -> DataFrame:
        """(_row, _results) of rows that have candidates; as many results as candidates."""
        flat = asked.select("_row", F.posexplode("_candidates").alias("_n", "_c")).select(
            "_row", "_n", "_c.doc_id", "_c.ids", "_c.prompt")
        if store is not None:
            flat = stored(flat, "silver-candidates")
            store.ask(flat, model, batch_size=batch_size, token_budget=token_budget)
            replied = store.attach(flat, "prompt", "_reply").drop("prompt")
        else:
            replied = stored(replies(flat, model, "prompt", "_reply", batch_size, token_budget), "silver-replies")
        result = _result(F.struct("doc_id", "ids"), F.col("_reply"), F.col("answers"), extract)
        return replied.join(answers, "_row").groupBy("_row").agg(F.transform(
            F.array_sort(F.collect_list(F.struct("_n", result.alias("_result")))),
            lambda r: r["_result"]).alias("_results"))

    found = judged(searched.select("_row", _no_documents(base, docs).alias("_candidates")))
    nothing = F.array().cast(found.schema["_results"].dataType)
    states = [stored(found.select(
        "_row", _first_state(F.col("_results")).alias("state")), "silver-state")]
    while not (active := states[-1].where("state.active")).isEmpty():
        found = judged(searched.join(active, "_row").select(
            "_row", _one_more_document(base, docs, state).alias("_candidates")))
        grown = active.join(found, "_row", "left").select("_row", _next_state(
            state, F.coalesce("_results", nothing)).alias("state"))
        states.append(stored(grown, "silver-state"))
    finished = [s.where("NOT state.active") for s in states]
    return _unpacked(rows.join(reduce(DataFrame.unionByName, finished), "_row").drop("_row"))


def best_answer(trace: Column | str, selected: Column | str) -> Column:
    """Recorded answer to keep: with nothing selected the first right one, else the right
    one with the highest positive score, the earliest on ties."""
    right = F.filter(col(trace), lambda r: r["is_correct"])
    by_score = F.array_max(F.transform(
        F.filter(right, lambda r: r["bleu_score"] > 0),
        lambda r, i: F.struct(
            r["bleu_score"].alias("score"), (-i).alias("order"),
            r["generated_answer"].alias("answer"))))["answer"]
    return F.when(
        (F.size(col(selected)) == 0) & (F.size(right) > 0),
        F.get(right, F.lit(0))["generated_answer"]).otherwise(by_score)


def summarize(mined: DataFrame) -> DataFrame:
    """Adds are_answer, the best recorded answer and the number of selected documents."""
    return (
        mined.withColumn("are_answer", F.exists("trace", lambda r: r["is_correct"]))
        .withColumn("generated_answer", best_answer("trace", "silver"))
        .withColumn("number_documents_selected", F.size("silver"))
        .withColumnRenamed("silver", "selected_documents")
    )


def silver_counts(summary: DataFrame) -> DataFrame:
    n = F.col("number_documents_selected")
    return summary.agg(
        F.count("*").alias("examples"), F.count_if("are_answer").alias("answered"),
        F.count_if(n > 1).alias("several_documents"),
        F.count_if((n == 0) & F.col("are_answer")).alias("answered_without_documents"))


def doc_count_distribution(rows: DataFrame, selected: str = "selected_documents") -> DataFrame:
    return rows.groupBy(F.size(col(selected)).alias("n_docs")).agg(
        F.count("*").alias("examples")).orderBy("n_docs")
