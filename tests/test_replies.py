"""Batches within a token budget, and replies that are kept."""

import os
import random
import uuid

import pytest
from pyspark.sql import functions as F

from passagemill.operators import generate as G, silver as V
from passagemill.operators.replies import ReplyStore


def recording_model(folder, fail_on=None):
    """Upper-cases prompts; leaves one file for each batch, with its prompts as lines."""
    def load():
        def answer(prompts):
            if fail_on is not None and any(fail_on in p for p in prompts):
                raise RuntimeError("model lost")
            with open(os.path.join(folder, uuid.uuid4().hex), "w") as out:
                out.write("\n".join(prompts))
            return [p.upper() for p in prompts]
        return answer
    return G.Model(load)


def batches(folder):
    return [open(os.path.join(folder, f)).read().split("\n") for f in os.listdir(folder)]


@pytest.fixture
def store(spark, tmp_path):
    def new(**options):
        return ReplyStore(spark, str(tmp_path / "store"), f"replies_{uuid.uuid4().hex}", buckets=4, **options)
    return new


def test_batches_stay_within_the_budget_and_pad_little(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.choice([1, 2, 3, 50, 70, 200]))) for i in range(600)] + [(600, None), (601, "  "), (602, "w " * 900)]
    df = spark.createDataFrame(rows, "id INT, prompt STRING").repartition(3)
    folders = []
    for n, options in enumerate(({"token_budget": 400}, {"batch_size": 8}, {"token_budget": 400, "batch_size": 5})):
        folders.append(tmp_path / str(n))
        folders[n].mkdir()
        got = {r.id: r.generated_text for r in G.batch_generate(df, recording_model(str(folders[n])), **options).collect()}
        assert got == {i: (p or "").strip() and p.upper() for i, p in rows}

    def padding(folder):
        sizes = [[len(p.split()) for p in b] for b in batches(folder)]
        return sum(len(b) * max(b) - sum(b) for b in sizes), sizes

    for n in (0, 2):
        less, sizes = padding(folders[n])
        assert all(len(b) * max(b) <= 400 or len(b) == 1 for b in sizes) and sum(map(len, sizes)) == 601
        assert n == 0 or max(map(len, sizes)) <= 5
    assert padding(folders[0])[0] < padding(folders[1])[0] / 5
    assert max(len(b) for b in padding(folders[0])[1]) > 100  # short prompts travel together


def test_equal_prompts_are_asked_once_across_runs(spark, tmp_path, store):
    calls = tmp_path / "calls"
    calls.mkdir()
    rows = [(i, f"prompt {i % 40}") for i in range(200)] + [(900, ""), (901, None)]
    df = spark.createDataFrame(rows, "id INT, prompt STRING").repartition(5)
    want = {i: (p or "").upper() for i, p in rows}
    for n in range(3):  # each time a new table over the same folder
        kept = store()
        got = G.batch_generate(df, recording_model(str(calls)), store=kept)
        assert {r.id: r.generated_text for r in got.collect()} == want
        assert sorted(p for b in batches(calls) for p in b) == sorted({p for _, p in rows if p})
    more = df.unionAll(spark.createDataFrame([(300, "new one")], df.schema))
    assert store().ask(more, recording_model(str(calls))) == 1
    plan = kept.attach(df)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(prompt" not in plan and "SelectedBucketsCount: 4 out of 4" in plan or "BroadcastHashJoin" in plan


def test_equal_digests_do_no_harm(spark, tmp_path, store):
    calls = tmp_path / "calls"
    calls.mkdir()
    same = {"digest": lambda p: F.lit("same")}
    df = spark.createDataFrame([(1, "a"), (2, "ab"), (3, "a"), (4, "b")], "id INT, prompt STRING")
    for _ in range(2):
        got = G.batch_generate(df, recording_model(str(calls)), store=store(**same)).collect()
        assert {r.id: r.generated_text for r in got} == {1: "A", 2: "AB", 3: "A", 4: "B"}
    assert sorted(p for b in batches(calls) for p in b) == ["a", "ab", "b"]


def test_a_killed_run_repeats_only_the_open_slice(spark, tmp_path, store):
    calls = tmp_path / "calls"
    calls.mkdir()
    df = spark.createDataFrame([(i, f"prompt {i:03d}") for i in range(300)], "id INT, prompt STRING")
    lost = df.where(F.pmod(F.xxhash64("prompt"), F.lit(10)) == 4).first().prompt  # in the fifth of ten slices
    with pytest.raises(Exception, match="model lost"):
        store().ask(df, recording_model(str(calls), fail_on=lost), slice_rows=30)
    kept = {r.prompt for r in store().known().collect()}
    before = [p for b in batches(calls) for p in b]
    assert 60 < len(kept) < 240 and lost not in kept
    assert len(set(before) - kept) <= 60  # what the open slice had asked
    assert store().ask(df, recording_model(str(calls)), slice_rows=30) == 300 - len(kept)
    again = [p for b in batches(calls) for p in b]
    assert len(again) - len(before) == 300 - len(kept)
    assert {r.prompt: r.reply for r in store().known().collect()} == {f"prompt {i:03d}": f"PROMPT {i:03d}" for i in range(300)}


def test_the_silver_search_asks_each_prompt_once(spark, tmp_path, store):
    docs = [(1, "t", "red"), (2, "t", "blue")]
    df = spark.createDataFrame(
        [(i, "which", ["blue"], docs) for i in range(6)],
        "example_id INT, query STRING, answers ARRAY<STRING>, docs ARRAY<STRUCT<doc_id: BIGINT, title: STRING, text: STRING>>")
    folders, found = [tmp_path / "plain", tmp_path / "kept"], []
    for folder, kept in zip(folders, (None, store())):
        folder.mkdir()
        mined = V.mine_silver_with_model(df, recording_model(str(folder)), store=kept)
        found.append(sorted((r.example_id, r.silver, r.silver_score, str(r.trace)) for r in mined.collect()))
    assert found[0] == found[1]
    asked = [sum(map(len, batches(f))) for f in folders]
    assert asked[1] * 6 == asked[0]


def test_keys_alone_go_with_the_prompts(spark, tmp_path, store):
    calls = tmp_path / "calls"
    calls.mkdir()
    df = spark.createDataFrame([(i, f"p{i % 7}", "wide " * 50) for i in range(60)] + [(60, None, "x")], "id INT, prompt STRING, rest STRING")
    want = {i: f"P{i % 7}" for i in range(60)} | {60: ""}
    model = recording_model(str(calls))
    for options in ({}, {"partitions": 3, "token_budget": 20}, {"store": store()}):
        got = G.batch_generate(df, model, keys=["id"], **options)
        assert got.columns == ["id", "generated_text"] and {r.id: r.generated_text for r in got.collect()} == want
        if not options:
            assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    plain = G.batch_generate(df.where("prompt IS NOT NULL"), F.upper, keys=["id"])
    assert plain.columns == ["id", "generated_text"] and {r.id: r.generated_text for r in plain.collect()} == {i: want[i] for i in range(60)}
