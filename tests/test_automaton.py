"""The shared automaton against one search for each answer and text."""

import random

from pyspark.sql import functions as F

from passagemill.functions import automaton, selection as S
from passagemill.operators import evaluate as E, silver as V


def test_an_automaton_finds_what_nested_loops_find():
    rng = random.Random(4)
    texts = ["".join(rng.choices("ab é", k=rng.randrange(30))) for _ in range(200)] + [""]
    wanted = sorted({"".join(rng.choices("ab é", k=rng.randrange(1, 5))) for _ in range(60)})
    for text, found in zip(texts, automaton.found_in(texts, wanted)):
        assert found == {n for n, w in enumerate(wanted) if w in text}
    assert automaton.found_in(["x"], []) == [set()]


def test_the_audit_is_that_of_nested_loops(spark):
    rng = random.Random(8)

    def words(n):
        return " ".join(rng.choices(["Cat", "dog", "É", "of", "the"], k=n))

    rows = []
    for i in range(150):
        docs = [(str(rng.randrange(6)), "", rng.choice([words(8), "", None])) for _ in range(rng.randrange(5))]
        answers = rng.choice([[words(2), words(1).upper(), "", None], [words(3)], [], None, [None], ["dog", "dog"]])
        ids = [rng.randrange(8) for _ in range(rng.randrange(6))]
        rows.append((i, docs, ids, rng.choice(["", "3,9,2", "NO_DOCS", "1, 1,5", ",".join(map(str, ids))]), answers))
    rows.append((1000, None, None, None, ["dog"]))
    df = spark.createDataFrame(
        rows, "example_id INT, docs ARRAY<STRUCT<doc_id: STRING, block: STRING, body: STRING>>, document_indices ARRAY<BIGINT>, "
              "selected_ids_raw STRING, answers ARRAY<STRING>").repartition(3)
    nested = df.select("example_id", S.ids_with_answer("docs", "document_indices", "answers").alias("before"),
                       S.answer_hits("docs", "selected_ids_raw", "answers").alias("after"))
    want = {r.example_id: r for r in nested.collect()}
    got = E.selection_audit(df).collect()
    assert len(got) == 151
    for r in got:
        w = want[r.example_id]
        assert (r.ids_before or []) == (w.before or [])
        assert (r.ids_after or []) == [h.doc_id for h in w.after or []]
        assert r.first_answer == next((h.answer for h in w.after or [] if h.answer), "" if w.after else None)


def test_documents_are_equal_in_the_search_as_they_are_by_hash(spark):
    """An empty title is left out, so ("", "a b") and ("a", "b") are one document."""
    df = spark.createDataFrame(
        [("q", ["b"], [(1, "", "a b"), (2, "a", "b"), (3, None, "c")])],
        "query STRING, answers ARRAY<STRING>, docs ARRAY<STRUCT<doc_id: BIGINT, title: STRING, text: STRING>>")
    kept = df.select(V._distinct_content(F.col("docs")).alias("d")).first().d
    assert [d.doc_id for d in kept] == [1, 3]
