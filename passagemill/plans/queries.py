"""Registered queries: one per operator, each with the SQL that checks it.

Arrays leave as joined text and ratios are rounded, so that both engines print alike.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from passagemill import fixed_values as fv
from passagemill.functions import match as M, prompts as P, selection as S, text as T
from passagemill.functions.bleu import bleu_max
from passagemill.operators import (
    compare as J, context as C, evaluate as E, generate as G, silver as V, trainset as R,
)
from passagemill.operators.replies import ReplyStore
from passagemill.plans import fixtures as X, oracles as O
from passagemill.session import scratch_path, stored
from passagemill.sources import sink, tables
from passagemill.sources.json_array import read_json_array, write_json_list
from passagemill.sources.pickled import decode_shards

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None, *needs: str) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = O.query(sql, *needs)
        return fn

    return add


def joined(c, sep: str = ","):
    return F.array_join(F.transform(c, lambda i: i.cast("string")), sep)


def cases(*options):
    """The option numbered doc_id modulo their count."""
    key = F.col("doc_id") % len(options)
    out = F
    for i, option in enumerate(options[:-1]):
        out = out.when(key == i, option)
    return out.otherwise(options[-1])


def sql_cases(*options: str) -> str:
    whens = " ".join(
        f"WHEN doc_id % {len(options)} = {i} THEN {o}" for i, o in enumerate(options[:-1]))
    return f"CASE {whens} ELSE {options[-1]} END"


# ============================ sources and sinks ============================
@register("corpus_scan", "SELECT full_corpus_idx, title, text FROM corpus", "corpus")
def corpus_scan(spark, sf):
    return X.corpus(spark, sf)


_HARD = '"[', '}\\"{'  # quotes, braces and a backslash around a title


@register("corpus_array_import", f"""
    SELECT row_number() OVER (ORDER BY doc_id) - 1 AS full_corpus_idx,
      '{_HARD[0]}' || lang || '{_HARD[1]}' AS title, text
    FROM documents""")
def corpus_array_import(spark, sf):
    """The documents as one JSON array with quotes and braces in its texts, read in splits."""
    path = f"{scratch_path(spark, 'corpus')}.json"
    rows = X.load(spark, sf, "documents").select("doc_id",
        F.concat(F.lit(_HARD[0]), "lang", F.lit(_HARD[1])).alias("title"), "text")
    write_json_list(rows, path, "doc_id")
    return tables.import_corpus_array(spark, path)


@register("json_list_output", f"""
    SELECT row_number() OVER (ORDER BY example_pos) - 1 AS position, example_id, query,
      array_to_string(answers, '|') AS answers, {O.ids_text('document_indices')} AS document_indices
    FROM contexts""", "contexts")
def json_list_output(spark, sf):
    """A run as one JSON list in position order, parsed again."""
    path = f"{scratch_path(spark, 'run')}.json"
    write_json_list(X.contexts(spark, sf).select(
        "example_pos", "example_id", "query", "answers", "document_indices"), path, "example_pos")
    rows = read_json_array(
        spark, path, "example_id STRING, query STRING, answers ARRAY<STRING>, document_indices ARRAY<LONG>")
    return rows.select("position", "element.*").withColumns({
        "answers": F.array_join("answers", "|"), "document_indices": joined("document_indices")})


@register("corpus_subset_join", """
    SELECT c.full_corpus_idx, c.title, c.text
    FROM corpus c JOIN labels l ON c.full_corpus_idx = l.doc_id""", "corpus")
def corpus_subset_join(spark, sf):
    subset = X.corpus(spark, sf).select(
        (F.col("full_corpus_idx") * 2 + 1).alias("subset_idx"), "title", "text")
    return tables.subset_corpus(subset, X.corpus_map(spark, sf))


@register("examples_scan", """
    SELECT example_pos, example_id, query, array_to_string(answers, '|') AS answers,
      gold_document_idx FROM examples""", "examples")
def examples_scan(spark, sf):
    """Questions and answers are words 1-13 of a document, by definition of the test table."""
    return X.examples(spark, sf).withColumn("answers", F.array_join("answers", "|"))


@register("search_hits_explode", """
    SELECT example_pos, generate_subscripts(doc_ids, 1)::INT AS rank, unnest(doc_ids) AS doc_id,
      round(1.0::DOUBLE / generate_subscripts(doc_ids, 1), 6) AS score FROM search_results""",
          "search_results")
def search_hits_explode(spark, sf):
    hits = C.explode_hits(C.with_search_results(
        X.examples(spark, sf).select("example_pos"), X.search_results(spark, sf)))
    return hits.withColumn("score", F.round("score", 6))


@register("shards_union", """
    SELECT (example_pos // 250 + 1) * 250 AS shard, example_pos, example_id, query
    FROM examples""", "examples")
def shards_union(spark, sf):
    """Questions and answers are words 1-13 of a document, by definition of the test table."""
    path = scratch_path(spark, "shards")
    rows = X.examples(spark, sf).select("example_pos", "example_id", "query")
    tables.write_shards(rows, path, 250)
    return tables.read_shards(spark, path).orderBy("shard", "example_pos")


@register("foreign_shards", f"""
    SELECT example_pos // 250 AS shard, row_number() OVER (PARTITION BY example_pos // 250
      ORDER BY example_pos) - 1 AS position, example_id, query, prompt,
      {O.ids_text('document_indices')} AS document_indices, 'x' || example_id AS generated_answer,
      example_pos % 3 = 0 AS flag FROM contexts""", "contexts")
def foreign_shards(spark, sf):
    """A run pickled by other code in shards of 250 positions, decoded without unpickling it."""
    def pickled(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["example_pos"])
        shard = [{
            "example_id": r["example_id"], "query": r["query"], "prompt": r["prompt"],
            "document_indices": r["document_indices"], "generated_answer": ["x" + r["example_id"]],
            "flag": r["example_pos"] % 3 == 0, "other": (1.5, None)} for r in rows]
        number = rows[0]["example_pos"] // 250
        return pa.table({"path": [f"run_{number}.pkl"], "content": [pickle.dumps(shard, protocol=number % 6)]})

    run = X.contexts(spark, sf).select("example_pos", "example_id", "query", "prompt", "document_indices")
    files = run.groupBy(F.floor(F.col("example_pos") / 250)).applyInArrow(pickled, "path STRING, content BINARY")
    rows = decode_shards(stored(files, "pickled"), (
        "example_id STRING, query STRING, prompt STRING, document_indices ARRAY<LONG>, "
        "generated_answer ARRAY<STRING>, flag BOOLEAN"))
    return rows.select(
        tables.shard_number(F.col("path"), r"(\d+)\.pkl$").alias("shard"), "position", "example_id", "query", "prompt",
        joined("document_indices").alias("document_indices"), F.col("generated_answer")[0].alias("generated_answer"), "flag")


@register("guarded_overwrite", """
    SELECT step, example_pos, example_id, answer FROM (
      SELECT 'kept' AS step, example_pos, example_id, 'first' AS answer FROM contexts UNION ALL
      SELECT 'replaced', example_pos, example_id, 'second' FROM contexts UNION ALL
      SELECT 'extended', example_pos, example_id, 'second' FROM contexts UNION ALL
      SELECT 'extended', example_pos, example_id, 'third' FROM contexts)""", "contexts")
def guarded_overwrite(spark, sf):
    """A result that stays where overwriting is not asked for, is replaced, and is extended."""
    path = scratch_path(spark, "guarded")
    run = stored(X.contexts(spark, sf).select("example_pos", "example_id"), "run")

    def step(name: str, df: DataFrame) -> DataFrame:
        return stored(df.select(F.lit(name).alias("step"), "example_pos", "example_id", "answer"), "step")

    def answered(text: str) -> DataFrame:
        return run.withColumn("answer", F.lit(text))

    sink.save(answered("first"), path, kind="json")
    kept = step("kept", sink.save_guarded(answered("second"), path))
    replaced = step("replaced", sink.save_guarded(answered("second"), path, overwrite=True))
    sink.extend(answered("third"), path)
    return kept.unionAll(replaced).unionAll(step("extended", sink.load(spark, path)))


@register("result_sink", f"""
    SELECT example_pos, example_id, prompt, {O.ids_text('document_indices')} AS document_indices,
      'documents' AS dataset, 'toy' AS model, 'test' AS split, 'retrieved' AS prompt_type,
      {X.K} AS k FROM contexts""", "contexts")
def result_sink(spark, sf):
    path = scratch_path(spark, "run")
    run = X.contexts(spark, sf).select(
        "example_pos", "example_id", "prompt",
        joined("document_indices").alias("document_indices"))
    tables.write_run(
        run, path, dataset="documents", model="toy", split="test", prompt_type="retrieved", k=X.K)
    return tables.read_runs(spark, path)


@register("resume_anti_join", """
    SELECT e.example_pos, e.example_id, e.query FROM examples e
    WHERE e.example_pos NOT IN (SELECT doc_id FROM labels)""", "examples")
def resume_anti_join(spark, sf):
    """Questions and answers are words 1-13 of a document, by definition of the test table."""
    finished = X.load(spark, sf, "labels").select(
        F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("example_id"))
    return tables.pending(X.examples(spark, sf), finished, "example_id").select(
        "example_pos", "example_id", "query")


@register("resume_by_position", """
    SELECT e.example_pos, 'id' AS example_id, e.query FROM examples e
    WHERE e.example_pos NOT IN (SELECT doc_id FROM labels)""", "examples")
def resume_by_position(spark, sf):
    nameless = X.examples(spark, sf).withColumn("example_id", F.lit(fv.DEFAULT_EXAMPLE_ID))
    finished = X.load(spark, sf, "labels").select(F.col("doc_id").alias("example_pos"))
    return tables.pending(nameless, finished).select("example_pos", "example_id", "query")


@register("ordinal_slice", """
    SELECT example_pos, example_id, query FROM examples
    WHERE example_pos >= 150 AND example_pos < 3000""", "examples")
def ordinal_slice(spark, sf):
    """Questions and answers are words 1-13 of a document, by definition of the test table."""
    return tables.ordinal_slice(X.examples(spark, sf), 150, 3000).select(
        "example_pos", "example_id", "query")


@register("sample_head", """
    SELECT example_pos, example_id, query FROM examples ORDER BY example_pos LIMIT 15""",
          "examples")
def sample_head(spark, sf):
    """Questions and answers are words 1-13 of a document, by definition of the test table."""
    return tables.sample_head(X.examples(spark, sf)).select("example_pos", "example_id", "query")


@register("training_loss_curve", """
    SELECT event_id AS step, value AS loss FROM events WHERE value IS NOT NULL""")
def training_loss_curve(spark, sf):
    log = X.load(spark, sf, "events").select(F.array(
        F.struct(F.col("event_id").alias("step"), F.col("value").alias("loss")),
        F.struct(F.col("event_id").alias("step"), F.lit(None).cast("double").alias("loss")),
    ).alias("log_history"))
    return tables.loss_curve(log)


# ============================ scalar functions ============================
@register("norm_text", f"SELECT doc_id, {O.norm_text('text')} AS normalized FROM docs", "docs")
def norm_text(spark, sf):
    return X.documents(spark, sf).select("doc_id", T.norm_text("text").alias("normalized"))


@register("norm_answer", f"SELECT doc_id, {O.norm_answer('text')} AS normalized FROM docs", "docs")
def norm_answer(spark, sf):
    return X.documents(spark, sf).select("doc_id", T.norm_answer("text").alias("normalized"))


@register("norm_answer_cased",
          f"SELECT doc_id, {O.norm_answer('text', False)} AS normalized FROM docs", "docs")
def norm_answer_cased(spark, sf):
    return X.documents(spark, sf).select(
        "doc_id", T.norm_answer("text", lowercase=False).alias("normalized"))


# Documents with answers that match in several ways or not at all.
_SQL_ANSWERS = sql_cases(
    f"['The ' || lower({O.words_at('sq', 9, 3)}) || '!', 'no such words']",
    f"['«' || {O.words_at('sq', 3, 2)}, {O.words_at('sq', 2, 1)}]",
    "['the']", "[]::VARCHAR[]", f"['x' || {O.words_at('sq', 1, 2)}, NULL]")
_DOC_ANSWERS = f"(SELECT doc_id, text, sq, {_SQL_ANSWERS} AS answers FROM docs)"


def _doc_answers(spark, sf):
    def w(start, count):
        return T.words_at(F.col("sq"), start, count)

    answers = cases(
        F.array(F.concat(F.lit("The "), F.lower(w(9, 3)), F.lit("!")), F.lit("no such words")),
        F.array(F.concat(F.lit("«"), w(3, 2)), w(2, 1)),
        F.array(F.lit("the")), F.array().cast("array<string>"),
        F.array(F.concat(F.lit("x"), w(1, 2)), F.lit(None).cast("string")))
    return X.documents(spark, sf).select("doc_id", "text", "sq", answers.alias("answers"))


@register("answer_match", f"""
    SELECT doc_id, {O.answer_match('text', 'answers')} AS matches FROM {_DOC_ANSWERS}""", "docs")
def answer_match(spark, sf):
    return _doc_answers(spark, sf).select(
        "doc_id", M.answer_match("text", "answers").alias("matches"))


@register("answer_in_context", f"""
    SELECT doc_id, {O.answer_in_text('text', 'answers')} AS in_context
    FROM {_DOC_ANSWERS}""", "docs")
def answer_in_context(spark, sf):
    return _doc_answers(spark, sf).select(
        "doc_id", M.answer_in_text("text", "answers").alias("in_context"))


_SQL_PHRASES = sql_cases(
    *[f"sq || ' {p.upper() if i % 2 else p.lower()}'".replace("'T", "''T").replace("n't", "n''t")
      for i, p in enumerate(fv.ABSTENTION_PHRASES)], "sq", "'No-Res' || sq", "''")


@register("abstention_flag", f"""
    SELECT doc_id, {O.abstains('answer')} AS abstains
    FROM (SELECT doc_id, {_SQL_PHRASES} AS answer FROM docs)""", "docs")
def abstention_flag(spark, sf):
    sq = F.col("sq")
    told = [F.concat(sq, F.lit(" "), F.lit(p.upper() if i % 2 else p.lower()))
            for i, p in enumerate(fv.ABSTENTION_PHRASES)]
    answer = cases(*told, sq, F.concat(F.lit("No-Res"), sq), F.lit(""))
    return X.documents(spark, sf).select("doc_id", M.abstains(answer).alias("abstains"))


@register("abstention_strict", f"""
    SELECT doc_id, {O.abstains_strict('answer')} AS abstains FROM (SELECT doc_id, {sql_cases(
        "sq || ' NO-RES.'", "sq || chr(10) || 'NO-RES'", "'no-res ' || text",
        "'(NO  RES)' || text", "text")} AS answer FROM docs)""", "docs")
def abstention_strict(spark, sf):
    text, sq = F.col("text"), F.col("sq")
    answer = cases(
        F.concat(sq, F.lit(" NO-RES.")), F.concat(sq, F.lit("\nNO-RES")),
        F.concat(F.lit("no-res "), text), F.concat(F.lit("(NO  RES)"), text), text)
    return X.documents(spark, sf).select("doc_id", M.abstains_strict(answer).alias("abstains"))


@register("first_line", f"""
    SELECT doc_id::VARCHAR AS id, {O.first_line('text')} AS line FROM docs
    UNION ALL SELECT conv_id || '/' || turn, {O.first_line('text')} FROM conversations""", "docs")
def first_line(spark, sf):
    docs = X.documents(spark, sf).select(F.col("doc_id").cast("string").alias("id"), "text")
    turns = X.load(spark, sf, "conversations").select(
        F.concat_ws("/", "conv_id", "turn").alias("id"), "text")
    return docs.unionByName(turns).select("id", T.first_line("text").alias("line"))


_MARK = fv.ANSWER_MARKER
_SQL_MARKED = sql_cases(
    "text", f"'Question {_MARK}  ' || text || ' '",
    f"'{_MARK} one' || chr(10) || '{_MARK}' || chr(9) || text")


@register("answer_extract", f"""
    SELECT doc_id, {O.strip(O.after('marked', _MARK))} AS first_answer,
      {O.strip(O.after(f"({O.after('marked', _MARK)})", _MARK))} AS second_answer
    FROM (SELECT doc_id, {_SQL_MARKED} AS marked FROM docs)""", "docs")
def answer_extract(spark, sf):
    text = F.col("text")
    marked = cases(
        text, F.concat(F.lit(f"Question {_MARK}  "), text, F.lit(" ")),
        F.concat(F.lit(f"{_MARK} one\n{_MARK}\t"), text))
    return X.documents(spark, sf).select("doc_id", marked.alias("marked")).select(
        "doc_id", M.extract_answer("marked").alias("first_answer"),
        M.extract_answer("marked", occurrence=2).alias("second_answer"))


_SQL_PROVED = sql_cases(
    "text", "sq || ' Proof:  ' || text", "'Proof:' || chr(10) || ' ' || text || ' Proof: x'")


def _proved(spark, sf):
    text, sq = F.col("text"), F.col("sq")
    answer = cases(
        text, F.concat(sq, F.lit(" Proof:  "), text),
        F.concat(F.lit("Proof:\n "), text, F.lit(" Proof: x")))
    return X.documents(spark, sf).select("doc_id", "text", "sq", answer.alias("answer"))


@register("proof_extract", f"""
    SELECT doc_id, {O.proof_of('answer')} AS proof
    FROM (SELECT doc_id, {_SQL_PROVED} AS answer FROM docs)""", "docs")
def proof_extract(spark, sf):
    return _proved(spark, sf).select("doc_id", M.proof_of("answer").alias("proof"))


@register("answer_in_proof", f"""
    SELECT doc_id, {O.answer_in_text('proof', '[generated]')} AS ans_in_proof FROM (
      SELECT doc_id, {O.proof_of('answer')} AS proof, {O.first_line('text')} AS generated
      FROM (SELECT doc_id, text, sq, {_SQL_PROVED} AS answer FROM docs))""", "docs")
def answer_in_proof(spark, sf):
    """The generated answer is the first line of the document, whole."""
    return _proved(spark, sf).select(
        "doc_id", M.proof_of("answer").alias("proof"), T.first_line("text").alias("generated"),
    ).select("doc_id", M.answer_in_proof("proof", "generated").alias("ans_in_proof"))


@register("no_proof_rate", f"""
    SELECT count(*) AS examples, {O.percent(f"WHERE proof = '{fv.NO_PROOF}'", 'count(*)')}
      AS missing_proof_rate
    FROM (SELECT {O.proof_of('answer')} AS proof
          FROM (SELECT doc_id, {_SQL_PROVED} AS answer FROM docs))""", "docs")
def no_proof_rate(spark, sf):
    proofs = _proved(spark, sf).select(M.proof_of("answer").alias("proof"))
    return proofs.agg(
        F.count("*").alias("examples"), E.missing_proof_rate().alias("missing_proof_rate"))


@register("doc_hash", f"""
    SELECT doc_id, sha256({O.content('title', 'sq')}) AS doc_hash
    FROM (SELECT * REPLACE (CASE WHEN source = 'src3' THEN '' ELSE title END AS title)
          FROM docs)""", "docs")
def doc_hash(spark, sf):
    title = F.when(F.col("source") == "src3", F.lit("")).otherwise(F.col("title"))
    return X.documents(spark, sf).select("doc_id", P.content_hash(title, "sq").alias("doc_hash"))


@register("doc_render", f"""
    SELECT doc_id, {O.document('doc_id', 'title', 'sq')} AS document,
      {O.document("'Id_' || (doc_id % 5 + 1)", 'title', 'sq')} AS aliased FROM docs""", "docs")
def doc_render(spark, sf):
    alias = F.concat(F.lit(fv.ALIAS_PREFIX), (F.col("doc_id") % 5 + 1).cast("string"))
    return X.documents(spark, sf).select(
        "doc_id", P.render_document(F.col("doc_id"), F.col("title"), F.col("sq")).alias("document"),
        P.render_document(alias, F.col("title"), F.col("sq")).alias("aliased"))


_LAST = P.Template(fv.INSTRUCTION_ANSWER, P.QUERY_LAST)
_FORMS = {
    "query_first": P.TEMPLATES["answer"], "query_last": _LAST,
    "open_context": P.TEMPLATES["answer_training"], "query_only": P.TEMPLATES["query_only"],
    "with_proof": P.TEMPLATES["answer_with_proof"],
}


_ASKED = O.words_at("sq", 1, 8)


@register("prompt_build", f"""
    SELECT doc_id, {O.prompt(fv.INSTRUCTION_ANSWER, _ASKED, 'sq')} AS query_first,
      {O.prompt_query_last(fv.INSTRUCTION_ANSWER, _ASKED, 'sq')} AS query_last,
      {O.prompt_open(fv.INSTRUCTION_ALWAYS_ANSWER, _ASKED)} AS open_context,
      {O.prompt(fv.INSTRUCTION_QUERY_ONLY, _ASKED)} AS query_only,
      {O.prompt(fv.INSTRUCTION_PROOF, _ASKED, 'sq')} AS with_proof FROM docs""", "docs")
def prompt_build(spark, sf):
    question = T.words_at(F.col("sq"), 1, 8)
    return X.documents(spark, sf).select("doc_id", *[
        P.fill(form, question, F.col("sq")).alias(name) for name, form in _FORMS.items()])


_CHAT_MODEL = "google/gemma-2-2b-it"
_CHAT = P.Template(fv.INSTRUCTION_ANSWER, chat_model=_CHAT_MODEL)
_CHAT_QUERY = P.Template(fv.INSTRUCTION_QUERY_ONLY, P.QUERY_ONLY, chat_model=_CHAT_MODEL)


@register("prompt_chat_wrap", f"""
    SELECT doc_id, {O.in_turns(O.prompt(fv.INSTRUCTION_ANSWER, _ASKED, 'sq'))} AS prompt,
      {O.in_turns(O.prompt(fv.INSTRUCTION_QUERY_ONLY, _ASKED))} AS query_prompt FROM docs""",
          "docs")
def prompt_chat_wrap(spark, sf):
    question = T.words_at(F.col("sq"), 1, 8)
    return X.documents(spark, sf).select(
        "doc_id", P.fill(_CHAT, question, F.col("sq")).alias("prompt"),
        P.fill(_CHAT_QUERY, question).alias("query_prompt"))


@register("prompt_token_len", f"""
    SELECT doc_id, {O.token_len('text')}::INT AS tokens FROM docs""", "docs")
def prompt_token_len(spark, sf):
    return X.documents(spark, sf).select("doc_id", P.token_len("text").alias("tokens"))


@register("bleu_max", O.bleu_by_ngram_counts(
    f"""SELECT doc_id, {O.first_line('text')} AS line, {O.words_at('sq', 9, 5)} AS short,
      [{O.words_at('sq', 9, 3)}, {O.words_at('sq', 1, 4)}, {O.words_at('sq', 11, 6)}] AS refs
      FROM docs"""), "docs")
def bleu_max_query(spark, sf):
    def w(start, count):
        return T.words_at(F.col("sq"), start, count)

    return X.documents(spark, sf).select(
        "doc_id", "text", w(9, 5).alias("short"),
        F.array(w(9, 3), w(1, 4), w(11, 6)).alias("refs"),
    ).select(
        "doc_id", F.round(bleu_max(T.first_line("text"), "refs"), 6).alias("line_bleu"),
        F.round(bleu_max("short", "refs"), 6).alias("answer_bleu"))


_SQL_ALIASED = "prompt"
for _i in range(1, X.K + 1):
    _SQL_ALIASED = (f"replace({_SQL_ALIASED}, coalesce('[' || document_indices[{_i}] || ']', "
                    f"chr(1)), '[Id_{_i}]')")


@register("id_alias", f"""
    SELECT example_id, {_SQL_ALIASED} AS prompt,
      array_to_string(list_transform(document_indices, lambda d, i: 'Id_' || i || '=' || d), ',')
        AS id_map FROM contexts""", "contexts")
def id_alias(spark, sf):
    entries = F.map_entries(S.alias_map("document_indices"))
    return X.contexts(spark, sf).select(
        "example_id", S.alias_prompt("prompt", "document_indices").alias("prompt"),
        F.array_join(F.transform(entries, lambda e: F.concat(
            e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("id_map"))


def _selector_texts(spark, sf):
    return X.contexts(spark, sf, template="answer_always").select(
        "example_pos", "example_id", "document_indices",
        X.toy_selector(F.col("prompt")).alias("reply"))


@register("selection_decode", f"""
    SELECT example_id, coalesce({O.decoded('selector_reply', 'document_indices')}, '{fv.NO_DOCS}')
      AS selected FROM selector""", "selector")
def selection_decode(spark, sf):
    return _selector_texts(spark, sf).select(
        "example_id", S.decode_selection("reply", "document_indices").alias("selected"))


@register("selection_decode_comma", f"""
    SELECT example_id, coalesce({O.decoded('selector_reply', 'document_indices', True)},
      '{fv.NOTHING_FOUND}') AS selected FROM selector""", "selector")
def selection_decode_comma(spark, sf):
    return _selector_texts(spark, sf).select("example_id", S.decode_selection(
        "reply", "document_indices", comma_only=True, missing=fv.NOTHING_FOUND).alias("selected"))


@register("prompt_parse_docs", """
    SELECT example_id, query AS question, docs[n].doc_id::VARCHAR AS doc_id,
      trim(docs[n].text || CASE WHEN n = len(docs) THEN chr(10) || 'Answer:' ELSE '' END, ' ')
        AS body
    FROM contexts, unnest(generate_series(1, len(docs))) AS u(n)""", "contexts")
def prompt_parse_docs(spark, sf):
    return X.contexts(spark, sf).select(
        "example_id", S.parse_question("prompt").alias("question"),
        F.explode(S.parse_documents("prompt")).alias("d"),
    ).select("example_id", "question", "d.doc_id", "d.body")


@register("prompt_rebuild", f"""
    SELECT example_id, {O.rebuilt(fv.INSTRUCTION_ALWAYS_ANSWER, 'query', 'picked')} AS prompt,
      {O.rebuilt(fv.INSTRUCTION_ANSWER, 'query', 'picked', turn=False)} AS plain_prompt
    FROM selection""", "selection")
def prompt_rebuild(spark, sf):
    parsed = X.contexts(spark, sf, template="answer_always").withColumn(
        "selected", S.decode_selection(X.toy_selector(F.col("prompt")), "document_indices"),
    ).select(
        "example_id", "selected", S.parse_question("prompt").alias("question"),
        S.parse_documents("prompt").alias("parsed"))
    return parsed.select(
        "example_id", S.rebuild_prompt("question", "parsed", "selected").alias("prompt"),
        S.rebuild_prompt(
            "question", "parsed", "selected", fv.INSTRUCTION_ANSWER, S.PLAIN_STYLE,
        ).alias("plain_prompt"))


_RAW_SELECTIONS = (
    "", fv.NO_DOCS, fv.UNKNOWN_EMPTY, "Unknown(NO_DOCS)", "Unknown(Id_9)", "12, 7", "5,5", " , 3")


def _raw_selections(spark, sf):
    doc_id = F.col("doc_id").cast("string")
    mixed = F.concat(doc_id, F.lit(",Unknown(Id_3), Unknown(x),"), doc_id)
    raw = cases(*[F.lit(r) for r in _RAW_SELECTIONS], mixed)
    return X.load(spark, sf, "documents").select("doc_id", raw.alias("raw"))


_SQL_RAW = "(SELECT doc_id, " + sql_cases(
    *[O.s(r) for r in _RAW_SELECTIONS],
    "doc_id || ',Unknown(Id_3), Unknown(x),' || doc_id") + " AS raw FROM documents)"


@register("valid_id_count", f"SELECT doc_id, {O.valid_ids('raw')} AS n FROM {_SQL_RAW}")
def valid_id_count(spark, sf):
    return _raw_selections(spark, sf).select("doc_id", S.valid_id_count("raw").alias("n"))


@register("valid_id_count_loose",
          f"SELECT doc_id, {O.valid_ids_loose('raw')} AS n FROM {_SQL_RAW}")
def valid_id_count_loose(spark, sf):
    return _raw_selections(spark, sf).select("doc_id", S.valid_id_count_loose("raw").alias("n"))


@register("answer_after_marker", f"""
    SELECT example_id, {O.after_marker('prompt', 'answers')} AS with_documents,
      {O.after_marker('query', 'answers')} AS without_marker FROM contexts""", "contexts")
def answer_after_marker(spark, sf):
    return X.contexts(spark, sf).select(
        "example_id", M.answer_after_marker("prompt", "answers").alias("with_documents"),
        M.answer_after_marker("query", "answers").alias("without_marker"))


@register("instruction_swap", f"""
    SELECT example_id, replace(prompt, {O.s(fv.INSTRUCTION_ALWAYS_ANSWER)}, '') AS emptied,
      replace(prompt, {O.s(fv.INSTRUCTION_ALWAYS_ANSWER)}, {O.s(fv.INSTRUCTION_ANSWER)}) AS swapped
    FROM contexts_always""", "contexts_always")
def instruction_swap(spark, sf):
    old = fv.INSTRUCTION_ALWAYS_ANSWER
    return X.contexts(spark, sf, template="answer_always").select(
        "example_id", P.swap_instruction("prompt", old, "").alias("emptied"),
        P.swap_instruction("prompt", old, fv.INSTRUCTION_ANSWER).alias("swapped"))


@register("chat_render", f"""
    SELECT conv_id, turn, {O.chat(fv.INSTRUCTION_SELECT_ALIASES, 'text', 'role')} AS training,
      {O.chat(fv.INSTRUCTION_SELECT_ALIASES, 'text')} AS testing FROM conversations""")
def chat_render(spark, sf):
    rows = X.load(spark, sf, "conversations").select(
        "conv_id", "turn", F.col("text").alias("prompt"), F.col("role").alias("output"))
    training = R.chat_rows(rows).withColumnRenamed("formatted_chat", "training")
    return R.chat_rows(training, training=False).select(
        "conv_id", "turn", "training", F.col("formatted_chat").alias("testing"))


# ============================ context assembly ============================
_SQL_TOP = f"list_reverse(doc_ids[1:{X.K}])"


def _insert_sql(position: str) -> str:
    return (f"({_SQL_TOP})[1 : {position}] || [gold_document_idx] "
            f"|| ({_SQL_TOP})[{position} + 1 : len({_SQL_TOP})]")


@register("topk_reversed", f"""
    SELECT example_pos, {O.ids_text(_SQL_TOP)} AS ids FROM search_results""", "search_results")
def topk_reversed(spark, sf):
    return X.search_results(spark, sf).select(
        "example_pos", joined(C.topk_reversed("doc_ids", X.K)).alias("ids"))


def _with_hits(spark, sf):
    return C.with_search_results(X.examples(spark, sf), X.search_results(spark, sf))


@register("gold_insert_fixed", f"""
    SELECT example_pos, {O.ids_text(_insert_sql('2'))} AS ids
    FROM examples JOIN search_results USING (example_pos) WHERE gold_document_idx <> -1""",
          "examples", "search_results")
def gold_insert_fixed(spark, sf):
    known = _with_hits(spark, sf).where(F.col("gold_document_idx") != fv.NO_GOLD)
    return known.select(
        "example_pos", joined(C.context_ids(X.K, gold_position=2)).alias("ids"))


_SQL_PLACE = f"({O.stable_hash('example_id', 7)} % {X.K})"


@register("gold_insert_random", f"""
    SELECT example_pos, {O.ids_text(_insert_sql(_SQL_PLACE))} AS ids
    FROM examples JOIN search_results USING (example_pos) WHERE gold_document_idx <> -1""",
          "examples", "search_results")
def gold_insert_random(spark, sf):
    known = _with_hits(spark, sf).where(F.col("gold_document_idx") != fv.NO_GOLD)
    return known.select(
        "example_pos", joined(C.context_ids(X.K, random_gold_seed=7)).alias("ids"))


@register("context_lookup", f"""
    SELECT l.example_pos, (l.pos - 1)::INT AS pos, l.doc_id, d.title, d.text, d.doc_hash
    FROM (SELECT example_pos, unnest({_SQL_TOP}) AS doc_id,
            generate_subscripts({_SQL_TOP}, 1) AS pos FROM search_results) l
    LEFT JOIN hashed_corpus d ON d.full_corpus_idx = l.doc_id""",
          "search_results", "hashed_corpus")
def context_lookup(spark, sf):
    listed = X.search_results(spark, sf).select(
        "example_pos", C.topk_reversed("doc_ids", X.K).alias("ids"))
    return C.lookup_documents(listed, X.corpus(spark, sf)).select(
        "example_pos", "pos", "doc_id", "title", "text", "doc_hash")


_GOLD_SECOND = ("list_reverse(r.doc_ids[1:4])[1:1] || [e.gold_document_idx] "
                "|| list_reverse(r.doc_ids[1:4])[2:4]")


@register("context_dedup", f"""
    SELECT example_pos, len(docs)::INT AS n_docs, {O.ids_text('document_indices')} AS ids
    FROM ({O.context_cte(4, _GOLD_SECOND, fv.INSTRUCTION_ANSWER)}) WHERE gold_document_idx <> -1""",
          "examples", "search_results", "hashed_corpus")
def context_dedup(spark, sf):
    """Gold document put in at position 1, so k+1 ids compete for k = 4 places."""
    known = X.examples(spark, sf).where(F.col("gold_document_idx") != fv.NO_GOLD)
    docs = C.assemble_documents(
        known, X.search_results(spark, sf), X.corpus(spark, sf), 4, gold_position=1)
    return docs.select(
        "example_pos", F.size("docs").alias("n_docs"),
        joined(F.transform("docs", lambda d: d["doc_id"])).alias("ids"))


@register("lost_hits", f"""
    SELECT l.example_pos, count(*) FILTER (WHERE c.full_corpus_idx IS NULL) AS lost_hits
    FROM (SELECT example_pos, unnest(doc_ids[1:{X.K}]) AS hit FROM search_results) l
    LEFT JOIN corpus c ON c.full_corpus_idx = l.hit GROUP BY 1""", "search_results", "corpus")
def lost_hits(spark, sf):
    return X.assembled(spark, sf).select("example_pos", "lost_hits")


_CONTEXT_OUT = f"""
    SELECT example_id, query, prompt, {O.ids_text('document_indices')} AS document_indices,
      gold_document_idx, {O.token_len('prompt')}::INT AS prompt_tokens_len,
      array_to_string(answers, '|') AS answers FROM contexts"""


@register("context_assemble", _CONTEXT_OUT, "contexts")
def context_assemble(spark, sf):
    return X.contexts(spark, sf).select(
        "example_id", "query", "prompt", joined("document_indices").alias("document_indices"),
        "gold_document_idx", "prompt_tokens_len", F.array_join("answers", "|").alias("answers"))


_MAX_TOKENS = 4096 - 2


@register("length_filter", f"""
    SELECT example_id, prompt, {O.token_len('prompt')}::INT AS prompt_tokens_len FROM contexts
    WHERE {O.token_len('prompt')} < {_MAX_TOKENS}""", "contexts")
def length_filter(spark, sf):
    return C.length_filter(X.contexts(spark, sf), _MAX_TOKENS).select(
        "example_id", "prompt", "prompt_tokens_len")


@register("length_excluded", f"""
    SELECT example_pos, example_id FROM contexts
    WHERE {O.token_len('prompt')} >= {_MAX_TOKENS}""", "contexts")
def length_excluded(spark, sf):
    return C.length_excluded(X.contexts(spark, sf), _MAX_TOKENS)


@register("short_context_count", f"""
    SELECT count(*) FILTER (WHERE len(docs) <> {X.K}) AS short_contexts FROM contexts
    WHERE {O.token_len('prompt')} < {_MAX_TOKENS}""",
          "contexts")
def short_context_count(spark, sf):
    return C.short_context_count(X.contexts(spark, sf), X.K, _MAX_TOKENS)


@register("query_only_prompts", """
    SELECT example_id, query, prompt FROM only_query""", "only_query")
def query_only_prompts(spark, sf):
    """Questions and answers are words 1-13 of a document, by definition of the test table."""
    return C.query_only_prompts(X.examples(spark, sf)).select("example_id", "query", "prompt")


# ============================ joins ============================
@register("eval_join", """
    SELECT e.example_id, e.query, array_to_string(CASE WHEN l.doc_id IS NOT NULL
      THEN e.answers END, '|') AS answers
    FROM examples e LEFT JOIN labels l ON e.example_pos = l.doc_id""", "examples")
def eval_join(spark, sf):
    """Gold rows exist for labelled documents only, each with a later duplicate.

    Questions and answers are words 1-13 of a document, by definition of the test table.
    """
    results = X.examples(spark, sf)
    gold = results.join(
        X.load(spark, sf, "labels").select(F.col("doc_id").alias("example_pos")),
        "example_pos", "left_semi").select("example_id", "example_pos", "answers")
    later = gold.select(
        "example_id", (F.col("example_pos") + (1 << 40)).alias("example_pos"),
        F.array(F.lit("later duplicate")).alias("answers"))
    return E.attach_gold(results, gold.unionByName(later)).select(
        "example_id", "query", F.array_join("answers", "|").alias("answers"))


def _two_runs(spark, sf):
    """Both scored runs as stored tables: results of a generator are kept, not recomputed."""
    kept = ("example_id", "row_pos", "generated_answer", "document_indices",
            "ans_match_after_norm", "ans_in_documents", "is_no_res", "is_correct")
    docs = X.stored_documents(spark, sf)
    run_a = X.scored_selected(spark, sf, docs).select(*kept, "selected_ids_raw")
    run_b = X.scored_retrieved(spark, sf, docs).select(*kept)
    return stored(run_a, "run-a"), stored(run_b, "run-b")


_COMMON = """(SELECT a.*, b.ans_match_after_norm AS match_b FROM scored_selected a
    JOIN scored_retrieved b USING (example_id) WHERE a.ans_in_documents AND b.ans_in_documents)"""


@register("compare_common_rows", f"""
    SELECT example_id, example_pos AS row_pos, generated_answer, selected_ids_raw,
      {O.ids_text('document_indices')} AS document_indices, ans_match_after_norm,
      ans_in_documents, is_no_res, is_correct, match_b FROM {_COMMON}""",
          "scored_selected", "scored_retrieved")
def compare_common_rows(spark, sf):
    return J.common_answerable(*_two_runs(spark, sf)).withColumn(
        "document_indices", joined("document_indices"))


@register("compare_common", f"""
    SELECT count(*) AS common_examples, round(coalesce(avg(ans_match_after_norm::INT), 0), 6) AS accuracy_a,
      round(coalesce(avg(match_b::INT), 0), 6) AS accuracy_b FROM {_COMMON}""",
          "scored_selected", "scored_retrieved")
def compare_common(spark, sf):
    return J.compare_common(*_two_runs(spark, sf))


@register("common_ids", """
    SELECT 'q' || doc_id AS example_id FROM labels WHERE quality = 1
    INTERSECT SELECT 'q' || doc_id FROM labels WHERE toxic = 0""")
def common_ids(spark, sf):
    labels = X.load(spark, sf, "labels").withColumn(
        "example_id", F.concat(F.lit("q"), F.col("doc_id").cast("string")))
    return J.common_ids(labels.where("quality = 1"), labels.where("toxic = 0"))


@register("attach_example_id", """
    SELECT e.example_pos, e.query, arg_max(o.example_id, o.example_pos) AS example_id
    FROM examples e JOIN examples o USING (query) GROUP BY ALL""", "examples")
def attach_example_id(spark, sf):
    """Questions and answers are words 1-13 of a document, by definition of the test table."""
    rows = X.examples(spark, sf).select(
        "example_pos", "query", F.lit(None).cast("string").alias("example_id"))
    questions = X.examples(spark, sf).select(
        F.col("query").alias("question"), "example_pos", "example_id")
    return J.attach_example_id(rows, questions).select("example_pos", "query", "example_id")


@register("attach_doc_indices", f"""
    SELECT e.example_pos, e.query, {O.ids_text('arg_max(o.ids, o.example_pos)')}
      AS document_indices
    FROM examples e JOIN (SELECT x.query, x.example_pos, r.doc_ids[1:{X.K}] AS ids
      FROM examples x JOIN search_results r USING (example_pos)) o USING (query)
    GROUP BY ALL""", "examples", "search_results")
def attach_doc_indices(spark, sf):
    rows = X.examples(spark, sf).select(
        "example_pos", "query", F.lit(None).cast("array<bigint>").alias("document_indices"))
    other = _with_hits(spark, sf).select(
        "query", "example_pos", F.slice("doc_ids", 1, X.K).alias("document_indices"))
    return J.attach_doc_indices(rows, other).select(
        "example_pos", "query", joined("document_indices").alias("document_indices"))


_WINS = f"""(SELECT a.* FROM scored_selected a JOIN scored_retrieved b USING (example_id)
    WHERE a.is_correct AND a.ans_in_documents AND a.generated_answer <> '{fv.ABSTAIN_TOKEN}'
      AND NOT b.is_correct)"""
_RUN_OUT = ("example_id, generated_answer, selected_ids_raw, "
            f"{O.ids_text('document_indices')} AS document_indices")


def _run_out(df):
    return df.select(
        "example_id", "generated_answer", "selected_ids_raw",
        joined("document_indices").alias("document_indices"))


@register("wins_a_over_b", f"SELECT {_RUN_OUT} FROM {_WINS}", "scored_selected", "scored_retrieved")
def wins_a_over_b(spark, sf):
    return _run_out(J.wins_a_over_b(*_two_runs(spark, sf)))


@register("wins_reordered", f"""
    SELECT {_RUN_OUT} FROM {_WINS} WHERE list_filter(string_split(selected_ids_raw, ','),
      lambda p: NOT starts_with(lower(p), 'unknown')) <>
      list_transform(document_indices, lambda i: i::VARCHAR)""",
          "scored_selected", "scored_retrieved")
def wins_reordered(spark, sf):
    return _run_out(J.wins_reordered(J.wins_a_over_b(*_two_runs(spark, sf))))


@register("useful_abstentions", f"""
    SELECT {_RUN_OUT.replace("document_indices)", "a.document_indices)")}
    FROM (SELECT a.example_id, a.generated_answer, a.selected_ids_raw, a.document_indices
      FROM scored_selected a JOIN scored_retrieved b USING (example_id)
      WHERE a.is_correct AND a.is_no_res AND a.generated_answer = '{fv.ABSTAIN_TOKEN}'
        AND len(list_intersect(list_filter(string_split(a.selected_ids_raw, ','),
          lambda p: NOT contains(p, 'Unknown')),
          list_transform(a.document_indices, lambda i: i::VARCHAR))) = 0
        AND NOT b.is_correct AND b.generated_answer <> '{fv.ABSTAIN_TOKEN}') a""",
          "scored_selected", "scored_retrieved")
def useful_abstentions(spark, sf):
    return _run_out(J.useful_abstentions(*_two_runs(spark, sf)))


# ============================ scoring and metrics ============================
_FLAGS = ("ans_match_after_norm", "gold_in_retrieved", "ans_in_documents", "is_no_res",
          "is_correct")


@register("evaluate_run", f"""
    SELECT example_id, query, generated_answer, array_to_string(answers, '|') AS answers,
      {O.ids_text('document_indices')} AS document_indices, {', '.join(_FLAGS)}
    FROM scored_retrieved""", "scored_retrieved")
def evaluate_run(spark, sf):
    """Flagship: assemble contexts, answer, look up gold answers, flag each row.

    The gold join runs on the narrow examples, before any text is attached.
    """
    examples = X.examples(spark, sf)
    gold = examples.select("example_id", "example_pos", "answers")
    contexts = C.assemble_context(
        E.attach_gold(examples, gold), X.search_results(spark, sf), X.corpus(spark, sf), X.K)
    replied = G.batch_generate(contexts, lambda prompt: F.concat(
        prompt, F.lit(" "), X.toy_answer(F.col("docs")), F.lit("\nQuestion: next")))
    scored = E.score(replied.withColumn("generated_answer", M.extract_answer("generated_text")))
    return scored.select(
        "example_id", "query", "generated_answer", F.array_join("answers", "|").alias("answers"),
        joined("document_indices").alias("document_indices"), *_FLAGS)


@register("evaluate_run_query_only", f"""
    SELECT example_id, query, prompt, generated_answer,
      {O.answer_match('generated_answer', 'answers')} AS ans_match_after_norm,
      {O.answer_in_text('prompt', 'answers')} AS ans_in_documents
    FROM (SELECT *, {O.first_line('generated_full')} AS generated_answer FROM only_query)""",
          "only_query")
def evaluate_run_query_only(spark, sf):
    """Questions and answers are words 1-13 of a document, by definition of the test table."""
    return E.score_query_only(X.only_query_run(spark, sf)).select(
        "example_id", "query", "prompt", "generated_answer", "ans_match_after_norm",
        "ans_in_documents")


@register("gold_recall", """
    SELECT example_id, gold_in_retrieved FROM scored_retrieved""", "scored_retrieved")
def gold_recall(spark, sf):
    return X.contexts(spark, sf).select(
        "example_id", E.gold_recall("document_indices", "gold_document_idx")
        .alias("gold_in_retrieved"))


_MATCHED = O.percent("WHERE ans_match_after_norm", "count(*)")
_AWARE = O.percent("WHERE is_correct", "count(*)")
_OUTSIDE = "count(*) FILTER (WHERE NOT ans_in_documents)"
_REJECTED = O.percent(
    f"WHERE NOT ans_in_documents AND {O.abstains_strict('generated_answer')}", _OUTSIDE)
_LUCKY = O.percent("WHERE NOT ans_in_documents AND ans_match_after_norm", _OUTSIDE)


def _metric(name: str, sql: str, expression: Callable):
    @register(name, f"SELECT count(*) AS examples, {sql} AS {name} FROM scored_retrieved",
              "scored_retrieved")
    def metric(spark, sf):
        return X.scored_retrieved(spark, sf).agg(
            F.count("*").alias("examples"), expression().alias(name))

    return metric


_metric("accuracy_attr", _MATCHED, lambda: E.accuracy("ans_match_after_norm"))
_metric("accuracy_context_aware", _AWARE, E.context_aware_accuracy)
_metric("neg_rejection_rate", _REJECTED, E.negative_rejection_rate)
_metric("correct_no_context_rate", _LUCKY, E.correct_without_context_rate)


@register("metrics_by_run", " UNION ALL ".join(f"""
    SELECT '{run}' AS run, count(*) AS examples, {_MATCHED} AS match_accuracy,
      {_AWARE} AS context_aware_accuracy, {_REJECTED} AS negative_rejection_rate,
      {_LUCKY} AS correct_without_context_rate FROM scored_{run}"""
    for run in ("retrieved", "selected")), "scored_retrieved", "scored_selected")
def metrics_by_run(spark, sf):
    needed = ("ans_in_documents", "ans_match_after_norm", "generated_answer")
    docs = X.stored_documents(spark, sf)
    runs = X.scored_retrieved(spark, sf, docs).select(F.lit("retrieved").alias("run"), *needed)
    runs = runs.unionByName(
        X.scored_selected(spark, sf, docs).select(F.lit("selected").alias("run"), *needed))
    return E.metrics_by(runs, "run")


def _ratio_sql(hits: str, total: str) -> str:
    return f"round(coalesce({hits} / nullif({total}, 0)::DOUBLE, 0), 6)"


@register("context_breakdown", f"""
    SELECT total_examples, examples_with_answer_in_context, examples_without_answer_in_context,
      correct_with_context, correct_without_context,
      {_ratio_sql('correct_with_context', 'examples_with_answer_in_context')}
        AS average_correct_with_context,
      {_ratio_sql('correct_without_context', 'examples_without_answer_in_context')}
        AS average_correct_without_context,
      {_ratio_sql('total_correct', 'total_examples')} AS overall_accuracy
    FROM (SELECT count(*) AS total_examples,
      count(*) FILTER (WHERE ans_in_documents) AS examples_with_answer_in_context,
      count(*) FILTER (WHERE NOT ans_in_documents) AS examples_without_answer_in_context,
      count(*) FILTER (WHERE ans_in_documents AND ans_match_after_norm) AS correct_with_context,
      count(*) FILTER (WHERE NOT ans_in_documents AND ans_match_after_norm)
        AS correct_without_context,
      count(*) FILTER (WHERE ans_match_after_norm) AS total_correct
      FROM scored_retrieved)""", "scored_retrieved")
def context_breakdown(spark, sf):
    ratios = ("average_correct_with_context", "average_correct_without_context",
              "overall_accuracy")
    return E.context_breakdown(X.scored_retrieved(spark, sf)).withColumns(
        {name: F.round(name, 6) for name in ratios})


def _histogram_sql(size: str, hit: str, source: str) -> str:
    sized = f"(SELECT {size} AS n, {hit} AS hit FROM {source})"
    return f"""
    SELECT z.n_docs::INT AS n_docs, count(x.n) AS examples,
      count(*) FILTER (WHERE x.hit) AS with_answer
    FROM generate_series(0, 5) AS z(n_docs) LEFT JOIN {sized} x ON x.n = z.n_docs GROUP BY 1
    UNION ALL SELECT -1, count(*), count(*) FILTER (WHERE hit) FROM {sized}"""


@register("selection_histogram", _histogram_sql(
    O.valid_ids("selected_ids_raw"), O.after_marker("prompt", "answers"), "selected"), "selected")
def selection_histogram(spark, sf):
    return E.selection_histogram(X.selected_run(spark, sf))


@register("selection_histogram_loose", _histogram_sql(
    O.valid_ids_loose("selected_ids_raw"), "ans_in_documents", "scored_selected"),
          "scored_selected")
def selection_histogram_loose(spark, sf):
    return E.selection_histogram_loose(X.scored_selected(spark, sf))


_SQL_HOLDS = "coalesce(len(list_filter(answers, lambda a: contains(lower(d.text), lower(a)))) > 0, false)"
_AUDIT = f"""
    SELECT example_id, len(before) > 0 AS has_answer_before,
      array_to_string(before, ',') AS ids_before, len(hits) > 0 AS has_answer_after,
      hits[1].answer AS first_answer,
      array_to_string(list_transform(hits, lambda h: h.doc_id), ',') AS ids_after,
      {O.ids_text(O.split_ids('selected_ids_raw'))} AS ids_selected
    FROM (SELECT *, list_transform(list_filter(docs, lambda d: {_SQL_HOLDS}),
        lambda d: d.doc_id::VARCHAR) AS before,
      flatten(list_transform(picked, lambda d: list_transform(
        list_filter(answers, lambda a: contains(lower(d.text), lower(a))),
        lambda a: struct_pack(doc_id := d.doc_id::VARCHAR, answer := a)))) AS hits
      FROM selection)"""


def _audit(spark, sf):
    asked = X.contexts(spark, sf, template="answer_always").withColumn(
        "selected_ids_raw",
        S.decode_selection(X.toy_selector(F.col("prompt")), "document_indices"))
    return E.selection_audit(asked.select(
        "example_id", "document_indices", "selected_ids_raw", "answers",
        S.documents_as_parsed("docs").alias("docs")))


@register("selection_audit", _AUDIT, "selection")
def selection_audit(spark, sf):
    return _audit(spark, sf).select(
        "example_id", "has_answer_before", joined("ids_before").alias("ids_before"),
        "has_answer_after", "first_answer", joined("ids_after").alias("ids_after"),
        joined("ids_selected").alias("ids_selected"))


@register("selection_audit_rollup", f"""
    SELECT count(*) AS examples, round(avg(has_answer_before::INT), 4) AS answer_before_rate,
      round(avg(has_answer_after::INT), 4) AS answer_after_rate,
      count(*) FILTER (WHERE has_answer_before AND has_answer_after) AS kept,
      count(*) FILTER (WHERE has_answer_before AND NOT has_answer_after) AS lost
    FROM ({_AUDIT})""", "selection")
def selection_audit_rollup(spark, sf):
    return E.selection_audit_rollup(_audit(spark, sf))


# ============================ silver labels ============================
@register("silver_round", f"""
    SELECT example_id, best_doc, best_ok, round(best_score, 6) AS best_score,
      {O.ids_text('silver')} AS selected, active, len(trace)::INT AS evaluations
    FROM silver_1""", "silver_1")
def silver_round(spark, sf):
    return V.silver_round(X.contexts(spark, sf), X.toy_candidates).select(
        "example_id", "best_doc", "best_ok", F.round("best_score", 6).alias("best_score"),
        joined("silver").alias("selected"), "active", F.size("trace").alias("evaluations"))


_GREEDY = f"""
    SELECT example_id, {O.ids_text('silver')} AS selected, silver_ok,
      round(silver_score, 6) AS silver_score, len(trace)::INT AS evaluations,
      array_to_string(list_transform(trace, lambda t: {O.ids_text('t.docs', '+')} || ':' || t.answer
        || ':' || t.ok::VARCHAR), '|') AS trace
    FROM silver_{X.K}"""


def _greedy_out(mined):
    trace = F.transform("trace", lambda t: F.concat_ws(
        ":", joined(t["candidate_documents"], "+"), t["generated_answer"],
        t["is_correct"].cast("string")))
    return mined.select(
        "example_id", joined("silver").alias("selected"), "silver_ok",
        F.round("silver_score", 6).alias("silver_score"), F.size("trace").alias("evaluations"),
        F.array_join(trace, "|").alias("trace"))


@register("silver_greedy", _GREEDY, f"silver_{X.K}")
def silver_greedy(spark, sf):
    return _greedy_out(X.mined(spark, sf))


@register("silver_greedy_model", _GREEDY, f"silver_{X.K}")
def silver_greedy_model(spark, sf):
    """The search in batch rounds with a model that only sees prompts."""
    return _greedy_out(V.mine_silver_with_model(
        X.contexts(spark, sf), G.Model(X.load_toy_answer_model), base_prompt=X.task_line(),
        batch_size=256))


@register("silver_best_answer", f"""
    SELECT example_id, are_answer, generated_answer, {O.ids_text('selected_documents')} AS selected,
      number_documents_selected FROM silver""", "silver")
def silver_best_answer(spark, sf):
    return X.silver(spark, sf).select(
        "example_id", "are_answer", "generated_answer",
        joined("selected_documents").alias("selected"), "number_documents_selected")


@register("silver_counts", """
    SELECT count(*) AS examples, count(*) FILTER (WHERE are_answer) AS answered,
      count(*) FILTER (WHERE number_documents_selected > 1) AS several_documents,
      count(*) FILTER (WHERE number_documents_selected = 0 AND are_answer)
        AS answered_without_documents FROM silver""", "silver")
def silver_counts(spark, sf):
    return V.silver_counts(X.silver(spark, sf))


# ============================ training sets ============================
_SQL_INSTRUCTION = f"""(
    SELECT example_id, selected_documents, docs,
      'Question: ' || query || chr(10) || 'Documents:' || {O.render_aliased('docs')} AS prompt,
      list_filter(list_transform(docs, lambda d, i: CASE WHEN
        list_contains(selected_documents, d.doc_id) THEN 'Id_' || i END),
        lambda a: a IS NOT NULL) AS chosen
    FROM silver WHERE are_answer)"""


def _instruction_sql(chosen: str) -> str:
    return f"""
    SELECT example_id, prompt, CASE WHEN len(selected_documents) = 0 THEN '' ELSE
      array_to_string(list_transform(docs, lambda d, i: 'Id_' || i || '=' || d.doc_id), ',')
      END AS id_map,
      CASE WHEN len(chosen) = 0 THEN '{fv.NO_DOCS}' ELSE array_to_string({chosen}, ', ') END
        AS output
    FROM {_SQL_INSTRUCTION} WHERE {O.token_len('prompt')} < {_MAX_TOKENS}"""


def _instruction_out(rows):
    return rows.select(
        "example_id", "prompt", F.array_join(F.transform(
            F.map_entries("id_map"), lambda e: F.concat(
                e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("id_map"),
        "output")


@register("instruction_rows", _instruction_sql("chosen"), "silver")
def instruction_rows(spark, sf):
    return _instruction_out(R.instruction_rows(X.silver(spark, sf), _MAX_TOKENS))


def _shuffled_sql(items: str, seed: int) -> str:
    key = O.stable_hash("example_id || '/' || x", seed)
    return (f"list_transform(list_sort(list_transform({items}, lambda x: "
            f"struct_pack(h := {key}, x := x))), lambda z: z.x)")


@register("instruction_rows_shuffled", _instruction_sql(_shuffled_sql("chosen", 10)), "silver")
def instruction_rows_shuffled(spark, sf):
    return _instruction_out(R.instruction_rows(X.silver(spark, sf), _MAX_TOKENS, shuffle_seed=10))


@register("doc_count_distribution", f"""
    SELECT len(selected_documents)::INT AS n_docs, count(*) AS examples
    FROM {_SQL_INSTRUCTION} WHERE {O.token_len('prompt')} < {_MAX_TOKENS} GROUP BY 1""", "silver")
def doc_count_distribution(spark, sf):
    return V.doc_count_distribution(R.instruction_rows(X.silver(spark, sf), _MAX_TOKENS))


def _stored_silver(spark, sf):
    """Silver labels are used several times below, so they are written once."""
    return stored(X.silver(spark, sf).select(
        "example_pos", "example_id", "query", "document_indices", "selected_documents",
        "are_answer"), "silver")


_TASK = f"Task Instruction: {fv.INSTRUCTION_SELECT}\nQuestion:"
_MIXED = _shuffled_sql("selected_documents", 10)
_TURNED = f"""CASE WHEN {_MIXED} = selected_documents
    THEN selected_documents[2 : len(selected_documents)] || selected_documents[1:1]
    ELSE {_MIXED} END"""


def _sample_sql(cased: str, reranked: str) -> str:
    retrieved = f"""CASE
      WHEN sample_case IN ('case_1_single_doc', 'case_2_multiple_docs') THEN document_indices
      WHEN sample_case = 'case_3_no_docs' THEN []
      WHEN sample_case = 'case_5_reranking' THEN {reranked}
      ELSE selected_documents END"""
    return f"""
    SELECT example_id, sample_case, {O.s(_TASK)} || query AS query,
      {O.ids_text(retrieved)} AS retrieved_docs, {O.ids_text('selected_documents')} AS output
    FROM ({cased}) WHERE sample_case IS NOT NULL"""


def _sample_out(rows):
    return rows.select(
        "example_id", "sample_case", "query", joined("retrieved_docs").alias("retrieved_docs"),
        joined("output").alias("output"))


def _fill_sql(size: str, rank: str, shares: dict[str, float], *names: str) -> str:
    whens, upto = [], "0"
    for name in names:
        upto += f" + floor({size}::DOUBLE * {shares[name]}::DOUBLE)"
        whens.append(f"WHEN {rank} <= {upto} THEN '{name}'")
    return f"CASE {' '.join(whens)} END"


@register("quota_sample", _sample_sql(f"""
    SELECT *, CASE grp
      WHEN 0 THEN {_fill_sql('size', 'rk', fv.GROUP_SHARES, 'case_3_no_docs')}
      WHEN 1 THEN {_fill_sql('size', 'rk', fv.GROUP_SHARES, 'case_1_single_doc',
                             'case_6_single_doc_unchanged')}
      ELSE {_fill_sql('size', 'rk', fv.GROUP_SHARES, 'case_2_multiple_docs',
                      'case_4_multi_doc_unchanged', 'case_5_reranking')} END AS sample_case
    FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY example_pos) AS rk,
            count(*) OVER (PARTITION BY grp) AS size
          FROM (SELECT *, least(len(selected_documents), 2) AS grp
                FROM silver WHERE are_answer))""", _TURNED), "silver")
def quota_sample(spark, sf):
    return _sample_out(R.quota_sample(_stored_silver(spark, sf)))


_G = fv.GLOBAL_SHARES


@register("quota_sample_global", _sample_sql(f"""
    SELECT *, coalesce(early, {_fill_sql('total', 'rk2', _G, 'case_4_less_docs',
                                         'case_5_reranking')}) AS sample_case
    FROM (SELECT *, CASE WHEN early IS NULL AND len(selected_documents) > 2 THEN
            row_number() OVER (PARTITION BY early IS NULL AND len(selected_documents) > 2
              ORDER BY o, example_pos) END AS rk2
      FROM (SELECT *, CASE grp WHEN 0 THEN {_fill_sql('total', 'rk', _G, 'case_3_no_docs')}
              WHEN 1 THEN {_fill_sql('total', 'rk', _G, 'case_1_single_doc')}
              ELSE {_fill_sql('total', 'rk', _G, 'case_2_multiple_docs')} END AS early
        FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY o, example_pos) AS rk
          FROM (SELECT *, least(len(selected_documents), 2) AS grp,
                  {O.stable_hash("example_id || '/' || example_pos", 10)} AS o,
                  (SELECT count(*) FROM silver) AS total
                FROM silver WHERE are_answer))))""", _MIXED), "silver")
def quota_sample_global(spark, sf):
    return _sample_out(R.quota_sample_global(_stored_silver(spark, sf)))


# ============================ generation ============================
def load_echo_model():
    """Stand-in for a model: repeats the last three words of each prompt."""
    return lambda prompts: [p + " " + " ".join(p.split(" ")[-3:]) for p in prompts]


_ECHOED = "prompt || ' ' || array_to_string(string_split(prompt, ' ')[-3:], ' ')"


@register("batch_generate", f"SELECT example_id, {_ECHOED} AS generated_text FROM contexts", "contexts")
def batch_generate(spark, sf):
    return G.batch_generate(
        X.contexts(spark, sf).select("example_id", "prompt"), G.Model(load_echo_model),
    ).select("example_id", "generated_text")


@register("batch_generate_budget", f"SELECT example_id, {_ECHOED} AS generated_text FROM contexts", "contexts")
def batch_generate_budget(spark, sf):
    """Batches of prompts of like length, at most 16,384 tokens with their padding."""
    return G.batch_generate(
        X.contexts(spark, sf), G.Model(load_echo_model), token_budget=16384, keys=["example_id"])


@register("reply_store", f"""
    SELECT example_id, {_ECHOED} AS generated_text, (SELECT count(DISTINCT prompt) FROM contexts) AS asked,
      0::BIGINT AS asked_again FROM contexts""", "contexts")
def reply_store(spark, sf):
    """Two runs over one store of replies: each distinct prompt is asked once, then none."""
    path = scratch_path(spark, "replies")
    rows = stored(X.contexts(spark, sf).select("example_id", "prompt"), "contexts")
    asked = []
    for n in range(2):  # the second opens the folder anew, as a later session would
        store = ReplyStore(spark, path, f"{path.rpartition('/')[2].replace('-', '_')}_{n}", buckets=8)
        asked.append(store.ask(rows, G.Model(load_echo_model)))
    return store.attach(rows, keys=["example_id"]).select(
        "example_id", "generated_text", F.lit(asked[0]).cast("long").alias("asked"),
        F.lit(asked[1]).cast("long").alias("asked_again"))


_SQL_STOPPED = sql_cases(
    "text", "sq || chr(10) || 'Human: x'", "sq || '<|endoftext|>' || text",
    "sq || chr(10) || '```' || chr(10)", "sq")


@register("stop_cut", f"""
    SELECT doc_id, split_part(split_part(reply, chr(10), 1), '<|endoftext|>', 1) AS reply
    FROM (SELECT doc_id, {_SQL_STOPPED} AS reply FROM docs)""", "docs")
def stop_cut(spark, sf):
    text, sq = F.col("text"), F.col("sq")
    reply = cases(
        text, F.concat(sq, F.lit("\nHuman: x")), F.concat(sq, F.lit("<|endoftext|>"), text),
        F.concat(sq, F.lit("\n```\n")), sq)
    return X.documents(spark, sf).select("doc_id", M.cut_at_stop(reply).alias("reply"))


@register("selection_run", f"""
    SELECT example_id, selected_ids_raw,
      {O.rebuilt(fv.INSTRUCTION_ALWAYS_ANSWER, 'query', 'picked')} AS prompt
    FROM selection""", "selection")
def selection_run(spark, sf):
    asked = X.contexts(spark, sf, template="answer_always")
    return G.selection_run(asked, X.toy_selector).select(
        "example_id", "selected_ids_raw", "prompt")


@register("selection_then_answer", """
    SELECT example_id, selected_ids_raw, prompt, generated_full AS generated_answer
    FROM selected""", "selected")
def selection_then_answer(spark, sf):
    return X.selected_run(spark, sf).select(
        "example_id", "selected_ids_raw", "prompt", "generated_answer")


@register("selection_run_model", f"""
    SELECT example_id, selected_ids_raw,
      {O.rebuilt(fv.INSTRUCTION_ALWAYS_ANSWER, 'query', 'picked')} AS prompt
    FROM selection""", "selection")
def selection_run_model(spark, sf):
    asked = X.with_selector_task(X.contexts(spark, sf, template="answer_always"))
    return G.selection_run(asked, G.Model(X.load_toy_selector_model)).select(
        "example_id", "selected_ids_raw", "prompt")


@register("selection_then_answer_model", f"""
    SELECT example_id, selected_ids_raw,
      {O.rebuilt(fv.INSTRUCTION_ANSWER, 'query', 'picked')} AS prompt,
      {O.strip(f"CASE WHEN len(picked) = 0 THEN {O.s(fv.ABSTAIN_TOKEN)} ELSE "
               f"{O.words_at('picked[-1].text', 1, 6)} END")} AS generated_answer
    FROM selection""", "selection")
def selection_then_answer_model(spark, sf):
    asked = X.with_selector_task(X.contexts(spark, sf, template="answer_always"))
    return G.selection_then_answer(
        asked, G.Model(X.load_toy_selector_model), G.Model(X.load_last_words_model),
    ).select("example_id", "selected_ids_raw", "prompt", "generated_answer")


@register("reanswer_run", f"""
    SELECT example_id, {O.rebuilt(fv.INSTRUCTION_ANSWER, 'query', 'picked')} AS prompt,
      {O.strip(O.toy_answer('picked'))} AS generated_answer FROM selection""", "selection")
def reanswer_run(spark, sf):
    old = G.selection_run(X.contexts(spark, sf, template="answer_always"), X.toy_selector)
    return G.reanswer_run(old, X.toy_selected_answer).select(
        "example_id", "prompt", "generated_answer")
