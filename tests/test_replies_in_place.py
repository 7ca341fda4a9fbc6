"""Prompts are asked where they lie, repeated openings are kept once, and no reply is sorted."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from passagemill.operators import generate as G, replies as R


def echo_model(folder):
    """Repeats the prompt, as a generator of whole texts does; leaves a file for each batch."""
    def load():
        def answer(prompts):
            with open(os.path.join(folder, uuid.uuid4().hex), "w") as out:
                out.write("\n".join(prompts))
            return [p if p.endswith("7") else "other text" if p.endswith("3") else p + " é😀" for p in prompts]
        return answer
    return G.Model(load)


def told(prompt):
    if not (prompt or "").strip():
        return ""
    return prompt if prompt.endswith("7") else "other text" if prompt.endswith("3") else prompt + " é😀"


def asked(folder):
    return sorted(p for f in os.listdir(folder) for p in open(os.path.join(folder, f)).read().split("\n"))


@pytest.fixture
def calls(tmp_path):
    (tmp_path / "calls").mkdir()
    return str(tmp_path / "calls")


@pytest.fixture
def store(spark, tmp_path):
    def new(name=None):
        return R.ReplyStore(spark, str(tmp_path / "store"), name or f"replies_{uuid.uuid4().hex}", buckets=4)
    return new


def test_no_text_moves_where_each_row_asks_its_own(spark, store, calls, tmp_path, monkeypatch):
    rows = [(i, f"prömpt 😀 {i}") for i in range(60)] + [(60, " "), (61, None)]
    df = spark.createDataFrame(rows, "id INT, prompt STRING").repartition(16)
    kept = store()
    monkeypatch.setattr(R.ReplyStore, "_texts", lambda *a: pytest.fail("texts are dealt out"))
    assert kept.ask(df, echo_model(calls)) == 60 and asked(calls) == sorted(p for _, p in rows[:60])
    raw = {r.prompt: (r.reply, r.same) for r in spark.read.parquet(str(tmp_path / "store")).collect()}
    assert raw["prömpt 😀 1"] == (" é😀", len("prömpt 😀 1")) and raw["prömpt 😀 3"] == ("other text", 0) and raw["prömpt 😀 7"][0] == ""
    assert {r.prompt: r.reply for r in kept.known().collect()} == {p: told(p) for _, p in rows[:60]}
    found = kept.attach(df, keys=["id"])
    assert found.columns == ["id", "generated_text"] and {r.id: r.generated_text for r in found.collect()} == {i: told(p) for i, p in rows}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Sort " not in plan and "Bucketed: true" in plan
    assert {r.id: r.generated_text for r in kept.attach(df).collect()} == {i: told(p) for i, p in rows}


@pytest.mark.parametrize("limits", [{}, {"IN_PLACE_BYTES": -1}, {"AT_ONCE_BYTES": 200}, {"TASK_ROWS": 3}])
def test_repeated_and_known_prompts_are_asked_once(spark, store, calls, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(R, name, value)
    rows = [(i, f"p {i % 50}" if i % 3 else f"own {i}") for i in range(300)] + [(300, ""), (301, None), (302, None)]
    df = spark.createDataFrame(rows + rows[:5], "id INT, prompt STRING").repartition(16)
    store().ask(df.where("id < 40"), echo_model(calls))
    assert store().ask(df, echo_model(calls), slice_rows=60) == len({p for _, p in rows[40:]} - {p for _, p in rows[:40]} - {"", None})
    assert store().ask(df, echo_model(calls)) == 0
    assert asked(calls) == sorted({p for _, p in rows if p})
    found = store().attach(df.withColumn("generated_text", F.lit("old")), keys=["id"]).collect()
    assert sorted((r.id, r.generated_text) for r in found) == sorted((i, told(p)) for i, p in rows + rows[:5])
    assert [r.generated_text for r in store().attach(spark.createDataFrame([(1, "never asked")], df.schema), keys=["id"]).collect()] == [None]


def test_few_readers_share_the_prompts_out(spark, store, calls):
    df = spark.createDataFrame([(i, f"prompt {i}") for i in range(200)], "id INT, prompt STRING").coalesce(1)
    assert store().ask(df, echo_model(calls)) == 200
    assert len(os.listdir(calls)) > 1 and asked(calls) == sorted(f"prompt {i}" for i in range(200))


def test_a_folder_of_before_is_read(spark, store, calls, tmp_path):
    name = f"replies_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} (digest STRING, prompt STRING, reply STRING) USING parquet "
              f"CLUSTERED BY (digest) SORTED BY (digest) INTO 4 BUCKETS LOCATION '{tmp_path / 'store'}'")
    spark.createDataFrame([(f"p {i}",) for i in range(9)], "prompt STRING").select(
        F.md5("prompt"), "prompt", F.concat("prompt", F.lit(" whole"))).write.insertInto(name)
    df = spark.createDataFrame([(i, f"p {i}") for i in range(12)], "id INT, prompt STRING").repartition(16)
    for kept in (store(), store(name)):  # under a new name, and the table itself
        assert {r.prompt: r.reply for r in kept.known().collect() if int(r.prompt[2:]) < 9} == {f"p {i}": f"p {i} whole" for i in range(9)}
        kept.ask(df, echo_model(calls))
        got = {r.id: r.generated_text for r in kept.attach(df, keys=["id"]).collect()}
        assert got == {i: f"p {i} whole" if i < 9 else told(f"p {i}") for i in range(12)}
    assert asked(calls) == ["p 10", "p 11", "p 9"]


def test_a_setting_holds_for_one_write(spark):
    from passagemill.session import setting
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key)
    with pytest.raises(RuntimeError), setting(spark, key, 7):
        assert spark.conf.get(key) == "7"
        raise RuntimeError
    assert spark.conf.get(key) == before


def test_a_batch_is_asked_in_runs_of_bounded_text(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(G, "WINDOW_BYTES", 100)
    batch = pa.record_batch({"prompt": ["x" * 40] * 5 + [None, "y" * 300, "", "z"], "n": list(range(9))})
    for part in (batch, batch.slice(2)):
        assert [w.column("n").to_pylist() for w in G._row_windows([part, part.slice(0, 0)], None, "prompt")] == [
            x for x in ([0, 1], [2, 3], [4, 5], [6], [7, 8]) if x[0] in part.column("n").to_pylist()]
    assert [w.num_rows for w in G._row_windows([batch], 4, "prompt")] == [4, 4, 1]
