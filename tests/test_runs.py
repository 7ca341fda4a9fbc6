"""Scoring, comparison, sampling, sinks and pipelines on small tables."""

import json
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from passagemill import fixed_values as fv
from passagemill.operators import (
    compare as J, evaluate as E, generate as G, trainset as R,
)
from passagemill.sources import tables


@pytest.fixture
def scored(spark):
    rows = [("d%d" % i, i, True, True, "Paris") for i in range(5)]
    rows += [("m", 9, True, False, "x"), ("n", 10, False, True, "lucky"),
             ("r", 11, False, False, "NO-RES"), ("s", 12, False, False, "no direct answer")]
    return spark.createDataFrame(
        rows, "example_id STRING, row_pos INT, ans_in_documents BOOLEAN, "
              "ans_match_after_norm BOOLEAN, generated_answer STRING")


def test_metrics(scored):
    got = scored.agg(
        E.accuracy("ans_match_after_norm"), E.context_aware_accuracy(),
        E.negative_rejection_rate(), E.correct_without_context_rate()).collect()[0]
    assert tuple(got) == (66.67, 77.78, 33.33, 33.33)
    inside = scored.where("ans_in_documents").agg(E.negative_rejection_rate()).collect()[0][0]
    assert inside == 0.0
    row = E.context_breakdown(scored).collect()[0]
    assert tuple(row)[:5] == (9, 6, 3, 5, 1)
    assert row.average_correct_with_context == pytest.approx(5 / 6)


def test_evaluate_run_takes_the_first_gold_row(spark):
    results = spark.createDataFrame(
        [("a", "The cat sat", "cat\nnoise", [1, 2], 2), ("b", "x", "NO-RES", [1], -1)],
        "example_id STRING, prompt STRING, generated_answer STRING, "
        "document_indices ARRAY<BIGINT>, gold_document_idx BIGINT")
    gold = spark.createDataFrame(
        [("a", 5, ["dog"]), ("a", 1, ["the cat"])],
        "example_id STRING, example_pos INT, answers ARRAY<STRING>")
    rows = {r.example_id: r for r in E.evaluate_run(results, gold, with_proof=True).collect()}
    a, b = rows["a"], rows["b"]
    assert (a.answers, a.generated_answer, a.ans_match_after_norm, a.gold_in_retrieved,
            a.ans_in_documents, a.is_no_res, a.is_correct) == (
        ["the cat"], "cat", True, True, True, False, True)
    assert (b.answers, b.ans_match_after_norm, b.ans_in_documents, b.is_correct, b.proof) == (
        None, False, False, True, "NO-PROOF")
    with pytest.raises(PySparkException, match="no gold answers"):
        E.score_query_only(E.attach_gold(results, gold)).collect()


def test_comparisons_use_the_last_duplicate(spark):
    schema = ("example_id STRING, row_pos INT, ans_in_documents BOOLEAN, ans_match_after_norm "
              "BOOLEAN, is_correct BOOLEAN, is_no_res BOOLEAN, generated_answer STRING, "
              "selected_ids_raw STRING, document_indices ARRAY<BIGINT>")
    run_a = spark.createDataFrame([
        ("a", 0, True, False, False, False, "x", "1", [1]),
        ("a", 1, True, True, True, False, "x", "2,1", [1, 2]),
        ("b", 2, True, True, True, False, "x", "1,2", [1, 2]),
        ("c", 3, False, False, True, True, "NO-RESPONSE", "Unknown(Id_7)", [4]),
        ("d", 4, False, False, True, True, "NO-RESPONSE", "4", [4])], schema)
    run_b = spark.createDataFrame([
        (i, 0, True, False, False, False, "y", "", [1]) for i in "abcd"], schema)
    assert [tuple(r) for r in J.compare_common(run_a, run_b).collect()] == [(2, 1.0, 0.0)]
    wins = J.wins_a_over_b(run_a, run_b)
    assert sorted(r.example_id for r in wins.collect()) == ["a", "b"]
    assert [r.example_id for r in J.wins_reordered(wins).collect()] == ["a"]
    assert [r.example_id for r in J.useful_abstentions(run_a, run_b).collect()] == ["c"]


def test_attaching_by_query_text(spark):
    rows = spark.createDataFrame(
        [("q1", "old", [9]), ("q2", "old", [9])],
        "query STRING, example_id STRING, document_indices ARRAY<BIGINT>")
    questions = spark.createDataFrame(
        [("q1", 0, "x"), ("q1", 1, "y")], "question STRING, example_pos INT, example_id STRING")
    assert {r.query: r.example_id for r in J.attach_example_id(rows, questions).collect()} == {
        "q1": "y", "q2": "old"}
    other = spark.createDataFrame(
        [("q1", 0, [1]), ("q1", 1, None)],
        "query STRING, example_pos INT, document_indices ARRAY<BIGINT>")
    got = {r.query: r.document_indices for r in J.attach_doc_indices(rows, other).collect()}
    assert got == {"q1": [], "q2": [9]}


def test_histograms_list_empty_sizes(spark):
    frame = spark.createDataFrame(
        [("1,2", "documents: cat", ["Cat"], True), ("", "none", ["x"], False),
         ("1,2,3,4,5,6", "documents: x", ["x"], True)],
        "selected_ids_raw STRING, prompt STRING, answers ARRAY<STRING>, ans_in_documents BOOLEAN")
    strict = {r.n_docs: (r.examples, r.with_answer) for r in E.selection_histogram(frame).collect()}
    assert strict == {0: (1, 0), 1: (0, 0), 2: (1, 1), 3: (0, 0), 4: (0, 0), 5: (0, 0), -1: (3, 2)}
    loose = {r.n_docs: r.examples for r in E.selection_histogram_loose(frame).collect()}
    assert loose[1] == 1 and loose[0] == 0


def silver_rows(spark, sizes):
    rows = [(i, f"e{i}", f"q{i}", list(range(5)), list(range(n)), ok)
            for i, (n, ok) in enumerate(sizes)]
    return spark.createDataFrame(
        rows, "example_pos BIGINT, example_id STRING, query STRING, document_indices "
              "ARRAY<BIGINT>, selected_documents ARRAY<BIGINT>, are_answer BOOLEAN")


def test_quota_sample_fills_cases_in_order(spark):
    sizes = [(0, True)] * 10 + [(1, True)] * 40 + [(3, True)] * 20 + [(2, False)] * 9
    rows = R.quota_sample(silver_rows(spark, sizes)).orderBy("example_pos").collect()
    cases = [r.sample_case for r in rows]
    assert cases == (
        ["case_3_no_docs"] + ["case_1_single_doc"] * 2 + ["case_6_single_doc_unchanged"] * 2
        + ["case_2_multiple_docs"] * 8 + ["case_4_multi_doc_unchanged"] * 7
        + ["case_5_reranking"] * 5)
    for r in rows:
        if r.sample_case == "case_5_reranking":
            assert r.retrieved_docs != r.output and sorted(r.retrieved_docs) == r.output
        if r.sample_case == "case_3_no_docs":
            assert r.retrieved_docs == [] == r.output


def test_global_quotas(spark):
    sizes = [(0, True)] * 30 + [(1, True)] * 30 + [(3, True)] * 30 + [(2, True)] * 5 + [(2, False)] * 5
    rows = R.quota_sample_global(silver_rows(spark, sizes), seed=1).collect()
    counts = {c: sum(r.sample_case == c for r in rows) for c in fv.GLOBAL_SHARES}
    assert counts["case_1_single_doc"] == 10 and counts["case_3_no_docs"] == 10
    assert counts["case_2_multiple_docs"] == 20
    several = [r for r in rows if r.sample_case in ("case_4_less_docs", "case_5_reranking")]
    assert counts["case_5_reranking"] == 0 and all(len(r.output) > 2 for r in several)
    two = sum(len(r.output) == 2 for r in rows)
    assert len(several) == 30 - (20 - two)
    again = R.quota_sample_global(silver_rows(spark, sizes), seed=1).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_instruction_rows(spark):
    docs = [(7, "t", "x"), (8, "t", "y"), (9, "t", "z")]
    frame = spark.createDataFrame(
        [("a", "q", docs, [9, 7], True), ("b", "q", docs, [], True), ("c", "q", docs, [7], False)],
        "example_id STRING, query STRING, docs ARRAY<STRUCT<doc_id: BIGINT, title: STRING, "
        "text: STRING>>, selected_documents ARRAY<BIGINT>, are_answer BOOLEAN")
    rows = {r.example_id: r for r in R.instruction_rows(frame, 1000).collect()}
    assert set(rows) == {"a", "b"}
    assert rows["a"].output == "Id_1, Id_3" and rows["a"].id_map == {"Id_1": 7, "Id_2": 8, "Id_3": 9}
    assert rows["b"].output == "NO_DOCS" and rows["b"].id_map == {}
    assert rows["b"].prompt.startswith("Question: q\nDocuments:Document [Id_1](Title: t) x\n")
    assert R.instruction_rows(frame, 5).count() == 0
    chat = R.chat_rows(R.instruction_rows(frame, 1000)).where("example_id = 'b'").collect()[0]
    assert [m.role for m in chat.chat] == ["system", "user", "assistant"]
    assert chat.formatted_chat.endswith("<|im_start|>assistant\nNO_DOCS<|im_end|>\n")


def test_corpus_import_and_subset(spark, tmp_path):
    path = str(tmp_path / "corpus.json")
    with open(path, "w") as out:
        json.dump([{"title": f"t{i}", "text": f"x{i}"} for i in range(50)], out)
    plain = tables.import_corpus_array(spark, path)
    assert sorted((r.full_corpus_idx, r.text) for r in plain.collect()) == [
        (i, f"x{i}") for i in range(50)]
    id_map = spark.createDataFrame([(100, 3), (200, 7)], "full_corpus_idx BIGINT, subset_idx BIGINT")
    mapped = tables.import_corpus_array(spark, path, id_map)
    assert sorted((r.full_corpus_idx, r.text) for r in mapped.collect()) == [(100, "x3"), (200, "x7")]


def test_example_defaults(spark):
    raw = spark.createDataFrame([(0, "q")], "example_pos BIGINT, question STRING")
    assert tuple(tables.read_examples(raw).collect()[0]) == (0, "id", "q", [None], -1)
    empty = spark.createDataFrame([(0, "x")], "example_pos BIGINT, example_id STRING")
    with pytest.raises(PySparkException, match="without query"):
        tables.read_examples(empty).collect()


def test_shards_by_file_number(spark, tmp_path):
    for number, name in ((500, "r_info_500"), (250, "r_info_250"), (None, "r_info_last")):
        part = str(tmp_path / f"part-{name}")
        spark.createDataFrame([(number or 0,)], "v INT").coalesce(1).write.parquet(part)
        source = [f for f in os.listdir(part) if f.endswith(".parquet")][0]
        os.makedirs(tmp_path / "shards", exist_ok=True)
        with open(f"{part}/{source}", "rb") as src, open(
                tmp_path / "shards" / f"{name}.parquet", "wb") as out:
            out.write(src.read())
    path = str(tmp_path / "shards")
    first = tables.read_shards(spark, path, "info").orderBy("shard").collect()
    assert [(r.shard, r.v) for r in first] == [(0, 0), (250, 250), (500, 500)]
    last = tables.read_shards(spark, path, missing=None).orderBy("shard").collect()
    assert [r.v for r in last] == [250, 500, 0]


def test_shards_round_trip(spark, tmp_path):
    rows = spark.range(1000).withColumnRenamed("id", "example_pos")
    tables.write_shards(rows, str(tmp_path / "own"), 250)
    got = tables.read_shards(spark, str(tmp_path / "own")).groupBy("shard").count().orderBy("shard").collect()
    assert [tuple(r) for r in got] == [(250, 250), (500, 250), (750, 250), (1000, 250)]
    tables.write_shards(rows.repartition(9), str(tmp_path / "many"), 5)
    many = tables.read_shards(spark, str(tmp_path / "many")).withColumn("file", F.col("_metadata.file_name"))
    by_shard = many.groupBy("shard").agg(F.count("*").alias("n"), F.count_distinct("file").alias("files")).collect()
    assert len(by_shard) == 200 and {(r.n, r.files) for r in by_shard} == {(5, 1)}
    assert many.select("file").distinct().count() <= 8


def test_resume_without_ids(spark):
    rows = spark.createDataFrame([(i, "id") for i in range(4)], "example_pos INT, example_id STRING")
    assert tables.pending(rows, rows.where("example_pos = 1")).count() == 3


def test_corpus_import_refuses_two_files(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.json").write_text('[{"title": "t", "text": "x"}]')
    assert tables.import_corpus_array(spark, str(tmp_path / "a.json")).count() == 1
    with pytest.raises(ValueError, match="one array file"):
        tables.import_corpus_array(spark, str(tmp_path))


def test_model_must_answer_every_prompt(spark):
    from passagemill.operators.generate import Model, batch_generate
    rows = spark.createDataFrame([("a",), ("b",)], "prompt STRING").coalesce(1)
    with pytest.raises(Exception, match="3 texts for 2 prompts"):
        batch_generate(rows, Model(lambda: lambda p: [*p, "more"]))


def test_sink_modes_and_resume(spark, tmp_path):
    path = str(tmp_path / "run")
    rows = spark.createDataFrame([(i, f"e{i}") for i in range(10)], "example_pos INT, example_id STRING")
    tables.write_run(tables.ordinal_slice(rows, 0, 4), path, dataset="d", k=5)
    todo = tables.pending(rows, tables.read_runs(spark, path))
    assert todo.count() == 6
    tables.write_run(todo, path, dataset="d", k=5)
    finished = tables.read_runs(spark, path)
    assert sorted(r.example_pos for r in finished.collect()) == list(range(10))
    assert tables.pending(rows, finished).isEmpty()
    assert tables.sample_head(rows, 3).count() == 3
    with pytest.raises(ValueError):
        tables.write_run(rows, path, wrong=1)
    out = str(tmp_path / "json")
    tables.write_json(rows, out)
    with pytest.raises(PySparkException):
        tables.write_json(rows, out)
    tables.write_json(rows.limit(2), out, overwrite=True)
    assert spark.read.json(out).count() == 2


def test_training_log(spark, tmp_path):
    path = str(tmp_path / "state.json")
    with open(path, "w") as out:
        json.dump({"log_history": [{"step": 20, "loss": 0.5}, {"step": 10, "loss": 1.5},
                                   {"step": 30, "eval": 1}]}, out, indent=1)
    curve = tables.loss_curve(tables.read_training_log(spark, path)).collect()
    assert [tuple(r) for r in curve] == [(10, 1.5), (20, 0.5)]


def test_pipeline_with_models(spark):
    docs = [(7, "t", "x"), (8, "t", "y")]
    contexts = spark.createDataFrame(
        [("a", "q", "P [7] [8]", docs, [7, 8]), ("b", "q", " ", docs, [7, 8])],
        "example_id STRING, query STRING, prompt STRING, docs ARRAY<STRUCT<doc_id: BIGINT, "
        "title: STRING, text: STRING>>, document_indices ARRAY<BIGINT>")

    def load_selector():
        def pick(prompts):
            assert all(p.strip() for p in prompts)
            return [p + "<|im_start|>assistant\nId_2<|im_end|>" for p in prompts]
        return pick

    def load_answerer():
        return lambda prompts: [
            p.replace("<start_of_turn>", "").replace("<end_of_turn>", "") + " yes" for p in prompts]

    rows = {r.example_id: r for r in G.selection_then_answer(
        contexts, G.Model(load_selector), G.Model(load_answerer)).collect()}
    assert "P [Id_1] [Id_2]" in rows["a"].selector_prompt
    assert rows["a"].selected_ids_raw == "8" and rows["a"].generated_answer == "yes"
    assert "Document [8](Title: t) y" in rows["a"].prompt
    assert rows["b"].selector_text == "" and rows["b"].selected_ids_raw == "NO_DOCS"


def test_only_number_and_prompt_reach_the_model(spark):
    from pyspark.sql import functions as F
    rows = spark.range(10).select("id", F.concat(F.lit("p"), "id").alias("prompt"),
                                  F.repeat(F.lit("x"), F.lit(1000)).alias("wide")).coalesce(1)
    sizes = spark.sparkContext.accumulator(0)

    def load():
        def answer(prompts):
            assert len(prompts) <= 4
            sizes.add(len(prompts))
            return [p.upper() for p in prompts]
        return answer

    got = G.batch_generate(rows, G.Model(load), batch_size=4)
    assert got.columns == ["id", "prompt", "wide", "generated_text"]
    for _ in range(2):  # a second use does not call the model again
        assert {r.id: r.generated_text for r in got.collect()} == {i: f"P{i}" for i in range(10)}
    assert sizes.value == 10
    asked = G.replies(rows.select("id", "prompt"), G.Model(load))
    assert asked.columns == ["id", "generated_text"]


def test_common_rows_are_whole(spark):
    schema = ("example_id STRING, row_pos INT, ans_in_documents BOOLEAN, "
              "ans_match_after_norm BOOLEAN, prompt STRING")
    run_a = spark.createDataFrame([("a", 0, True, False, "old"), ("a", 1, True, True, "new")], schema)
    run_b = spark.createDataFrame([("a", 0, True, False, "other")], schema)
    row = J.common_answerable(run_a, run_b).collect()[0]
    assert (row.prompt, row.ans_match_after_norm, row.match_b) == ("new", True, False)
