"""What crosses the network, and what is computed how often: findings of the third round."""

import re
import sys
import uuid

from pyspark.sql import functions as F

from passagemill import fixed_values as fv
from passagemill.functions import automaton, match as M, text as T
from passagemill.operators import context as C, generate as G, silver as V
from passagemill.operators.replies import ReplyStore


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def upper_model():
    def load():  # inside a function, so that it travels by value
        return lambda prompts: [p.upper() for p in prompts]

    return G.Model(load)


def test_neighbours_get_a_document_once(spark, monkeypatch):
    corpus = spark.createDataFrame(
        [(i, "t" if i % 2 else "", f"text {i % 7}" if i != 5 else None) for i in range(10)],
        "full_corpus_idx LONG, title STRING, text STRING")
    lists = [[1, 2, 3], [3, 99, 5, 8, 1], [], [4, None, 4, 7, 0]]
    listed = spark.createDataFrame(
        [(i, f"q{i}", lists[i % 4]) for i in range(128)], "example_pos LONG, query STRING, ids ARRAY<LONG>")
    want = C.gather_context(C.lookup_documents(listed, corpus), 3).orderBy("example_pos").collect()
    asked, lookup = [], C.lookup
    monkeypatch.setattr(C, "lookup", lambda hits, *rest: (asked.append(hits), lookup(hits, *rest))[1])
    got = C.gather_documents(listed, corpus, 3).orderBy("example_pos").collect()
    assert [r.asDict(True) for r in got] == [{k: r.asDict(True)[k] for k in got[0].asDict()} for r in want]
    assert asked[0].count() == 2 * len({i for ids in lists for i in ids if i is not None})


def test_whitespace_runs_are_one_expression(spark):
    points = [chr(n) for n in range(1, sys.maxunicode + 1) if not 0xD800 <= n < 0xE000]
    texts = ["x" + "".join(points[i:i + 50]) + "y" + points[i] * 2 for i in range(0, len(points), 50)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING").select(
        "i", T.squeeze("t").alias("a"), T.squash("t").alias("b"))
    for r in df.collect():
        for found, chars in ((r.a, fv.WHITESPACE), (r.b, fv.WHITESPACE + fv.PUNCTUATION)):
            assert found == re.sub(f"[{re.escape(chars)} ]+", " ", texts[r.i]).strip(" ")
    assert "translate(" not in optimized(df)


def test_raw_answers_come_first(spark):
    df = spark.createDataFrame([
        ("a b, c", ["b, c"]), ("a b, c", ["B; c!", None]), ("a b c", ["b c?"]), ("abc", None), ("abc", [None]), (None, ["a"]), ("abc", [])],
        "t STRING, a ARRAY<STRING>").select(M.answer_in_text("t", "a").alias("v"))
    assert [r.v for r in df.collect()] == [True, True, True, False, False, False, False]
    assert re.search(r"exists\(a#\d+, lambdafunction\(Contains\(t#\d+", optimized(df))


def test_rows_stay_with_their_replies(spark):
    df = spark.createDataFrame(
        [(i, f"p{i}", [i], {"k": i}) for i in range(50)] + [(50, None, None, None)],
        "id INT, prompt STRING, docs ARRAY<INT>, more MAP<STRING, INT>")
    for options in ({}, {"partitions": 3}, {"token_budget": 4}):
        got = G.batch_generate(df, upper_model(), **options)
        assert got.columns == ["id", "prompt", "docs", "more", "generated_text"]
        assert "Join" not in optimized(got)
        assert {r.id: (r.docs, r.more, r.generated_text) for r in got.collect()} == {
            **{i: ([i], {"k": i}, f"P{i}") for i in range(50)}, 50: (None, None, "")}


def test_replies_meet_rows_without_the_prompts(spark, tmp_path):
    store = ReplyStore(spark, str(tmp_path / "store"), f"replies_{uuid.uuid4().hex}", buckets=4)
    df = spark.createDataFrame([(i, f"prompt {i % 9}") for i in range(60)] + [(60, " ")], "id INT, prompt STRING")
    assert store.ask(df, upper_model()) == 9 and store.ask(df, upper_model()) == 0
    found = store.attach(df).select("id", "generated_text")
    left = optimized(found).split("Join")[1].split("\n")[1]
    assert "Project [id#" in left and not re.search(r"[\[ ]prompt#\d+[,\]]", left.split("Project")[1].replace("(", " (")), left
    assert {r.id: r.generated_text for r in found.collect()} == {**{i: f"PROMPT {i % 9}" for i in range(60)}, 60: ""}
    assert sorted(r.prompt for r in store.known().collect()) == [f"prompt {i}" for i in range(9)]


def test_contents_are_hashed_once_for_all_candidates(spark):
    df = spark.createDataFrame(
        [(1, "which", ["blue"], [(1, "t", "red"), (2, "t", "blue"), (3, "t", "blue")])],
        "example_id INT, query STRING, answers ARRAY<STRING>, docs ARRAY<STRUCT<doc_id: BIGINT, title: STRING, text: STRING>>")
    mined = V.mine_silver(df, lambda cs: F.transform(cs, lambda c: F.coalesce(F.get(c["docs"], F.size(c["docs"]) - 1)["text"], F.lit("none"))))
    assert mined.schema["docs"] == df.schema["docs"] and "_searched" not in mined.columns
    assert optimized(mined).count("sha2(") == 1
    assert mined.first().silver == [2]


def test_texts_of_a_batch_are_searched_in_slices(spark, monkeypatch):
    import pyarrow as pa

    held, found_in = [], automaton.found_in
    monkeypatch.setattr(automaton, "found_in", lambda texts, wanted: (held.append(sum(map(len, texts))), found_in(texts, wanted))[1])
    monkeypatch.setattr(automaton, "SLICE_BYTES", 1000)
    texts = pa.array([["a red " + "x" * 300, None], [], None, ["y" * 5000 + " blue"]] * 20)
    answers = pa.array([["red", "", None], ["red"], ["red"], ["blue", "red"]] * 20)
    for cut in (0, 3):
        got = automaton._matches(texts[cut:], answers[cut:]).to_pylist()
        assert got == ([[[0, 1], []], [], None, [[0]]] * 20)[cut:]
    assert max(held) <= 5005 and sum(h > 1100 for h in held) <= 40
    assert automaton._matches(texts[:0], answers[:0]).to_pylist() == []
