"""Greedy search against a small sequential model."""

import random
import zlib

from pyspark.sql import functions as F

from passagemill import fixed_values as fv
from passagemill.functions.bleu import bleu_max
from passagemill.operators import silver as V
from passagemill.operators.generate import Model

REPLIES = [
    "no idea", "red fox", "the red fox", "a red fox ran", "red fox runs far away now",
    "blue bird sings", "red", "red fox jumps\nsecond line",
]
GOLD = ["red fox"]
DOCS = "ARRAY<STRUCT<doc_id: BIGINT, title: STRING, text: STRING>>"


def reply_to(prompt):
    return REPLIES[zlib.crc32(prompt.encode()) % len(REPLIES)]


def crc_model():
    replies, crc = list(REPLIES), zlib.crc32

    def load():
        return lambda prompts: [replies[crc(p.encode()) % len(replies)] for p in prompts]

    return Model(load)


def by_column(candidates):
    options = F.array(*[F.lit(r) for r in REPLIES])
    return F.transform(candidates, lambda c: F.get(
        options, (F.crc32(c["prompt"]) % len(REPLIES)).cast("int")))


def judge(query, docs, scores):
    """(is right, score, answer) for an ordered list of documents."""
    lines = [f"Document [{i}](Title: {t}) {x}" for i, t, x in docs]
    prompt = (f"{fv.INSTRUCTION_ALWAYS_ANSWER}\nQuestion: {query}\nDocuments:\n"
              + "\n".join(lines) + "\nAnswer:")
    answer = reply_to(prompt).split("\n")[0]
    return "red fox" in answer, scores[answer], answer


def search(query, docs, scores):
    """Selected ids and the number of evaluations, one set of candidates per round."""
    right, score, _ = judge(query, [], scores)
    kept, kept_score, calls = [], score if right else None, 1
    best, best_score = None, kept_score
    while True:
        tried = [d for d in docs if d not in kept]
        found = [(judge(query, kept + [d], scores), -n, d) for n, d in enumerate(tried)]
        calls += len(found)
        rightly = [(s, n, d) for (ok, s, _), n, d in found if ok]
        if rightly:
            top_score, _, top = max(rightly, key=lambda r: (r[0], r[1]))
            if best_score is None or top_score > best_score:
                best, best_score = top, top_score
        if best is None or best in kept or (kept_score is not None and best_score <= kept_score):
            return [d[0] for d in kept], calls
        kept, kept_score = kept + [best], best_score


def test_search_equals_the_sequential_model(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        ids = rng.sample(range(100), rng.randint(0, 4))
        rows.append((i, f"question {i}", GOLD, [(d, "t", f"text {d} {rng.random()}") for d in ids]))
    frame = spark.createDataFrame(
        rows, f"example_pos BIGINT, query STRING, answers ARRAY<STRING>, docs {DOCS}")
    lines = [(r.split("\n")[0],) for r in REPLIES]
    scores = {r.h: r.s for r in spark.createDataFrame(lines, "h STRING").select(
        "h", bleu_max("h", F.array(F.lit(GOLD[0]))).alias("s")).collect()}
    want = {i: search(q, d, scores) for i, q, _, d in rows}

    def result(mined):
        return {r.example_pos: (r.silver, len(r.trace)) for r in mined.collect()}

    assert result(V.mine_silver(frame, by_column)) == want
    assert result(V.mine_silver_with_model(frame, crc_model())) == want
    assert len({len(s) for s, _ in want.values()}) > 2  # the cases are varied


def test_model_is_called_once_per_candidate(spark):
    calls = spark.sparkContext.accumulator(0)

    def load():
        def answer(prompts):
            calls.add(len(prompts))
            return ["no idea"] * len(prompts)
        return answer

    rows = [(i, "q", GOLD, [(1, "t", "x"), (2, "t", "y")]) for i in range(20)]
    frame = spark.createDataFrame(
        rows, f"example_pos BIGINT, query STRING, answers ARRAY<STRING>, docs {DOCS}")
    mined = V.mine_silver_with_model(frame, Model(load))
    assert [r.silver for r in mined.collect()] == [[]] * 20
    assert calls.value == 20 * 3


def test_best_recorded_answer(evaluate):
    def row(selected, *trace):
        return ([([], a, ok, s) for a, ok, s in trace], selected)

    schema = f"trace {V.TRACE}, sel ARRAY<BIGINT>"
    rows = [
        row([], ("a", False, 0.9), ("b", True, 0.1), ("c", True, 0.5)),
        row([1], ("a", True, 0.2), ("b", True, 0.5), ("c", True, 0.5)),
        row([1], ("a", True, 0.0)), row([], ("a", False, 0.3)),
    ]
    assert evaluate(rows, schema, V.best_answer("trace", "sel")) == ["b", "b", None, None]


def test_equal_documents_are_never_added_twice(spark):
    docs = [(1, "t", "same"), (2, "t", "same"), (3, "t", "other")]
    frame = spark.createDataFrame(
        [(0, "q", GOLD, docs)], f"example_pos BIGINT, query STRING, answers ARRAY<STRING>, docs {DOCS}")

    def generate(candidates):
        return F.transform(candidates, lambda c: F.when(
            F.exists(c["docs"], lambda d: d["text"] == "same"), "red fox").otherwise("none"))

    assert V.mine_silver(frame, generate).collect()[0].silver == [1]


def test_search_goes_on_while_it_improves(spark):
    """Eight documents that each raise the score: all are selected."""
    words = "one two three four five six seven eight".split()
    docs = [(i, "t", w) for i, w in enumerate(words)]
    answers = [" ".join(words)]
    frame = spark.createDataFrame(
        [(0, "q", answers, docs), (1, "q", answers, [])],
        f"example_pos BIGINT, query STRING, answers ARRAY<STRING>, docs {DOCS}")
    whole = F.lit(answers[0])

    def generate(candidates):
        # a right answer that grows nearer to the expected one with each document
        return F.transform(candidates, lambda c: F.concat(whole, F.repeat(
            F.lit(" filler"), F.lit(20) - F.size(c["docs"]))))

    rows = {r.example_pos: r for r in V.mine_silver(frame, generate).collect()}
    assert sorted(rows[0].silver) == list(range(8)) and not rows[0].active
    assert rows[1].silver == []
    one = {r.example_pos: r for r in V.silver_round(frame, generate).collect()}
    assert len(one[0].silver) == 1 and one[0].active

    def load():
        return lambda prompts: [
            answers[0] + " filler" * (20 - sum(f"Document [{i}]" in p for i in range(8))) for p in prompts]

    by_model = {r.example_pos: r for r in V.mine_silver_with_model(frame, Model(load)).collect()}
    assert {i: r.silver for i, r in by_model.items()} == {i: r.silver for i, r in rows.items()}
