"""Question, retrieval and run tables derived from the given parquet tables.

Every document asks one question (its own opening words), so all derived tables grow
with `documents`. Ranked lists come from id arithmetic plus the first copy of a
document, and cost one aggregation by content hash; no pair of documents is compared.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from passagemill import fixed_values as fv
from passagemill.functions import prompts as P
from passagemill.functions.match import extract_answer
from passagemill.functions.text import let, raw_words_at, squeeze, words_at, words_from
from passagemill.operators import context as C, evaluate as E, generate as G, silver as V
from passagemill.operators.joins import lookup
from passagemill.session import stored
from passagemill.sources import tables

K = 5
# Id distances of the neighbours in a ranked list; 0 is the asking document itself.
NEIGHBOURS = (1, 3, 2, 0, 6, 7, 5, 4)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with raw text and single-spaced text `sq`."""
    return load(spark, sf_dir, "documents").select(
        "doc_id", F.coalesce("lang", F.lit("")).alias("title"),
        F.coalesce("text", F.lit("")).alias("text"), "source",
    ).withColumn("sq", squeeze("text"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("full_corpus_idx"), "title", F.col("sq").alias("text"))


def corpus_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full index of subset row i; the subset holds the labelled documents."""
    return load(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("full_corpus_idx"), (F.col("doc_id") * 2 + 1).alias("subset_idx"))


def raw_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question rows in both key styles: even positions use query, odd ones question."""
    docs = documents(spark, sf_dir)
    opening = raw_words_at(F.col("text"), 1, 8)
    answers = F.array(raw_words_at(F.col("text"), 9, 3), raw_words_at(F.col("text"), 12, 2))
    even = F.col("doc_id") % 2 == 0
    return docs.select(
        F.col("doc_id").alias("example_pos"),
        F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("example_id"),
        F.when(even, opening).alias("query"), F.when(~even, opening).alias("question"),
        F.filter(answers, lambda a: a != "").alias("answers"),
        F.when(F.col("doc_id") % 5 != 0, F.col("doc_id").cast("string"))
        .alias("idx_gold_in_corpus"))


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read_examples(raw_examples(spark, sf_dir))


def search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight neighbours by id, rotated per block; a later copy finds its first copy best."""
    hashed = stored(documents(spark, sf_dir).select(
        F.col("doc_id").alias("example_pos"), P.content_hash("title", "text").alias("doc_hash")),
        "hashed")
    firsts = hashed.groupBy("doc_hash").agg(F.min("example_pos").alias("first_copy"))
    own = F.col("example_pos")
    base = F.array(*[F.lit(n).cast("bigint") for n in NEIGHBOURS])
    turn = (F.floor(own / 8) % 8).cast("int")
    rotated = F.concat(F.slice(base, turn + 1, F.lit(8)), F.slice(base, F.lit(1), turn))
    block = F.transform(rotated, lambda n: own.bitwiseXOR(n))
    ids = F.when(F.col("first_copy") == own, block).otherwise(F.concat(
        F.array("first_copy"), F.filter(block, lambda i: i != F.col("first_copy"))))
    found = lookup(hashed, firsts, "doc_hash", is_stored=True)
    return found.select(
        "example_pos", ids.alias("doc_ids")).withColumn(
        "scores", F.transform("doc_ids", lambda _, i: F.lit(1.0) / (i + 1)))


# --- column generators: pure stand-ins for a model ------------------------------
def toy_answer(docs: Column, pos="example_pos", query="query", answers="answers") -> Column:
    """Reply text of a fixed rule over the question and its documents."""
    pos, query = F.col(pos), F.col(query)
    first = F.get(F.col(answers), F.lit(0))

    def reply(given: Column) -> Column:
        n = F.size(given)
        abstain = F.lit(fv.ABSTAIN_TOKEN)
        last = words_at(F.element_at(given, -1)["text"], 1, 6)
        holders = F.filter(given, lambda d: F.contains(d["text"], query))
        count = F.when(pos % 2 == 0, F.greatest(F.lit(3), 9 - 2 * n)).otherwise(F.lit(5))
        # one search through the documents: Catalyst would repeat it for every use of a hit
        told = F.transform(holders, lambda d: words_from(words_at(F.trim(F.substring(
            d["text"], F.instr(d["text"], query) + F.length(query), F.length(d["text"]))), 1, 7), F.lit(1), count))
        return (
            F.when(n == 0, F.when(pos % 7 == 3, F.concat(first, F.lit(" indeed")))
                   .otherwise(abstain))
            .when(pos % 11 == 4, last)
            .otherwise(F.coalesce(
                F.get(told, F.lit(0)),
                F.when(pos % 5 == 0, abstain)
                .when(pos % 7 == 3, F.concat(first, F.lit(" perhaps")))
                .otherwise(last))))

    return F.coalesce(let(docs, reply), F.lit(fv.ABSTAIN_TOKEN))


def toy_candidates(candidates: Column) -> Column:
    return F.transform(candidates, lambda c: toy_answer(c["docs"]))


def toy_selector_reply(ids: str = "document_indices", pos: str = "example_pos") -> Column:
    """Aliases of the documents whose id is no multiple of 3, last first."""
    named = F.transform(F.col(ids), lambda d, i: F.when(
        d % 3 != 0, F.concat(F.lit(fv.ALIAS_PREFIX), (i + 1).cast("string"))))
    kept = F.array_join(F.reverse(F.filter(named, lambda a: a.isNotNull())), ", ")
    extra = F.when(F.col(pos) % 6 == 0, F.lit(" Id_9")).otherwise(F.lit(""))
    text = F.concat(kept, extra)
    return F.when(text == "", F.lit(fv.NO_DOCS)).otherwise(text)


def toy_selector(prompt: Column) -> Column:
    """Chat prompt plus the selector's turn; every 13th example has no such turn."""
    turn = F.concat(
        F.lit(fv.ASSISTANT_MARKER + "\n"), toy_selector_reply(), F.lit(fv.END_MARKER))
    return F.concat(prompt, F.when(F.col("example_pos") % 13 == 5, F.lit("")).otherwise(turn))


# --- the same stand-ins as models, which see nothing but the prompt ----------------
_DOCUMENT_LINE = r"^Document \[\d+\]\(Title: [^)]*\) ?(.*)$"


def task_line() -> Column:
    """First prompt line that tells a stand-in model what the column form reads from the row."""
    return F.concat(F.to_json(F.struct(
        F.col("example_pos").alias("pos"), "query", F.get("answers", F.lit(0)).alias("first"))),
        F.lit("\n"))


def _toy_reply(prompt: str) -> str:
    lines = prompt.split("\n")
    task = json.loads(lines[0])
    pos, query, first = task["pos"], task["query"], task.get("first")
    texts = [m[1] for m in (re.match(_DOCUMENT_LINE, line) for line in lines[1:]) if m]
    hit = next((t for t in texts if query in t), None)
    if not texts:
        guess = f"{first} indeed" if pos % 7 == 3 and first is not None else None
        return guess or fv.ABSTAIN_TOKEN
    last = " ".join(texts[-1].split(" ")[:6])
    if pos % 11 == 4:
        return last
    if hit is not None:
        after = hit[hit.find(query) + len(query):].strip(" ").split(" ")[:7]
        return " ".join(after[:max(3, 9 - 2 * len(texts)) if pos % 2 == 0 else 5])
    if pos % 5 == 0:
        return fv.ABSTAIN_TOKEN
    if pos % 7 == 3:
        return f"{first} perhaps" if first is not None else fv.ABSTAIN_TOKEN
    return last


def load_toy_answer_model():
    """`toy_answer` read from prompts that begin with `task_line`."""
    return lambda prompts: [_toy_reply(p) for p in prompts]


def with_selector_task(contexts: DataFrame) -> DataFrame:
    """Puts position and ids before the prompt, where a stand-in selector finds them."""
    task = F.concat(
        F.lit("<task "), F.col("example_pos").cast("string"), F.lit(" "),
        F.array_join(F.transform("document_indices", lambda i: i.cast("string")), "+"),
        F.lit(">\n"))
    return contexts.withColumn("prompt", F.concat(task, "prompt"))


def _toy_selection(prompt: str) -> str:
    found = re.search(r"<task (\d+) ([\d+]*)>", prompt)
    pos, ids = int(found[1]), [i for i in found[2].split("+") if i]
    named = [f"{fv.ALIAS_PREFIX}{n}" for n, i in enumerate(ids, 1) if int(i) % 3]
    text = ", ".join(reversed(named)) + (" Id_9" if pos % 6 == 0 else "")
    if pos % 13 == 5:
        return prompt
    return f"{prompt}{fv.ASSISTANT_MARKER}\n{text or fv.NO_DOCS}{fv.END_MARKER}"


def load_toy_selector_model():
    """`toy_selector` for prompts made by `with_selector_task`."""
    return lambda prompts: [_toy_selection(p) for p in prompts]


def load_last_words_model():
    """Prompt without turn marks, then the first six words of its last document."""
    def reply(prompt: str) -> str:
        texts = re.findall(_DOCUMENT_LINE, prompt, re.MULTILINE)
        told = " ".join(texts[-1].split(" ")[:6]) if texts else fv.ABSTAIN_TOKEN
        return re.sub("<start_of_turn>|<end_of_turn>", "", prompt) + "\n" + told

    return lambda prompts: [reply(p) for p in prompts]


# --- runs ------------------------------------------------------------------------
def assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples with their documents, before any template."""
    return C.assemble_documents(
        examples(spark, sf_dir), search_results(spark, sf_dir), corpus(spark, sf_dir), K)


def stored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assembled documents as a table, for several runs over the same contexts."""
    return stored(assembled(spark, sf_dir), "assembled")


def contexts(
    spark: SparkSession, sf_dir: str, template: str = "answer", docs: DataFrame | None = None,
) -> DataFrame:
    docs = assembled(spark, sf_dir) if docs is None else docs
    return C.with_prompt(docs, P.TEMPLATES[template])


def retrieved_run(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """Answers from the retrieved documents; text after the first line is noise."""
    asked = contexts(spark, sf_dir, docs=docs)
    replied = G.batch_generate(asked, lambda prompt: F.concat(
        prompt, F.lit(" "), toy_answer(F.col("docs")), F.lit("\nQuestion: next")))
    return replied.withColumn("generated_answer", extract_answer("generated_text"))


def only_query_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompts = C.query_only_prompts(examples(spark, sf_dir))
    replied = G.batch_generate(prompts, lambda prompt: F.concat(
        prompt, F.lit(" "), toy_answer(F.array().cast(
            "array<struct<doc_id:bigint,title:string,text:string>>"))))
    return replied.withColumn("generated_answer", extract_answer("generated_text"))


def toy_selected_answer(prompt: Column) -> Column:
    return F.concat(
        G.without_special_tokens(prompt), F.lit("\n"), toy_answer(G.selected_docs()))


def selected_run(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """Selector, rebuilt prompt, answer."""
    asked = contexts(spark, sf_dir, template="answer_always", docs=docs)
    return G.selection_then_answer(asked, toy_selector, toy_selected_answer)


def scored_retrieved(spark, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    return E.score(retrieved_run(spark, sf_dir, docs)).withColumn(
        "row_pos", F.col("example_pos"))


def scored_selected(spark, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    return E.score(selected_run(spark, sf_dir, docs)).withColumn(
        "row_pos", F.col("example_pos"))


def mined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.mine_silver(contexts(spark, sf_dir), toy_candidates)


def silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silver summary with example ids and document lists attached."""
    return V.summarize(mined(spark, sf_dir))
