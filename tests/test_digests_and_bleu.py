"""Joins of long texts by digest, and BLEU whose cost follows the length of the texts."""

import math
import random
import time
from collections import Counter

from pyspark.sql import functions as F

from passagemill.functions.bleu import bleu_max
from passagemill.operators import compare as J


def test_texts_with_equal_digests_keep_their_own_values(spark):
    long = "a question of many words " * 400
    rows = spark.createDataFrame(
        [(f"{long}{i % 6}", "old", [9]) for i in range(30)] + [("none", "old", [9]), (None, "old", None)],
        "query STRING, example_id STRING, document_indices ARRAY<BIGINT>")
    questions = spark.createDataFrame(
        [(f"{long}{i % 4}", i, f"e{i}") for i in range(12)] + [(None, 99, "null")], "question STRING, example_pos INT, example_id STRING")
    other = questions.select(F.col("question").alias("query"), "example_pos", F.when(
        F.col("example_pos") < 11, F.array(F.col("example_pos").cast("long"))).alias("document_indices"))
    want_id = {f"{long}{k}": f"e{8 + k}" for k in range(4)}
    want_docs = {f"{long}{k}": [8 + k] if k < 3 else [] for k in range(4)}
    for digest in (F.md5, lambda t: F.when(t.isNotNull(), F.lit("same")), lambda t: F.substring(t, -1, 1)):
        got = J.attach_example_id(rows, questions, digest).collect()
        assert len(got) == 32 and all(r.example_id == want_id.get(r.query, "old") for r in got)
        got = J.attach_doc_indices(rows, other, digest).collect()
        assert len(got) == 32 and all(r.document_indices == want_docs.get(r.query, [9] if r.query else None) for r in got)
    plan = J.attach_example_id(rows, questions)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query" not in plan and "hashpartitioning(_text_digest" in plan.replace("#", "(")


def plain_bleu(hyp, ref):
    h, r = hyp.split(), ref.split()
    total = 0.0
    for n in range(1, 5):
        a, b = (Counter(tuple(x[i:i + n]) for i in range(len(x) - n + 1)) for x in (h, r))
        shared = sum((a & b).values())
        if n == 1 and not shared:
            return 0.0
        total += math.log((shared or 0.1) / max(1, len(h) - n + 1)) / 4
    return (1 if len(h) > len(r) else math.exp(1 - len(r) / len(h))) * math.exp(total)


def test_bleu_of_repeated_words(spark):
    rng = random.Random(6)
    pairs = [(" ".join(rng.choices("ab c d".split(), k=rng.randrange(12))), [" ".join(rng.choices("ab c d e".split(), k=rng.randrange(9))) for _ in range(3)])
             for _ in range(200)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i INT, hyp STRING, refs ARRAY<STRING>")
    got = {r.i: r.b for r in df.select("i", bleu_max("hyp", "refs").alias("b")).collect()}
    for i, (hyp, refs) in enumerate(pairs):
        assert math.isclose(got[i], max(plain_bleu(hyp, r) for r in refs), rel_tol=1e-9)


def test_bleu_costs_what_the_lengths_add_up_to(spark):
    rng = random.Random(7)
    seconds = []
    for n in (300, 300, 3000):
        text = " ".join(f"w{rng.randrange(n)}" for _ in range(n))
        df = spark.createDataFrame([(text, [" ".join(rng.sample(text.split(), n))])] * 8, "hyp STRING, refs ARRAY<STRING>")
        began = time.time()
        df.select(bleu_max("hyp", "refs").alias("b")).agg(F.sum("b")).collect()
        seconds.append(time.time() - began)
    assert seconds[2] < 30 * max(seconds[1], 0.3)  # by pairs of words it would be 100 times as much
