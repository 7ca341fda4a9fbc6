"""Pickled shards that are read but never run, and results that change whole or not at all."""

import collections
import os
import pickle
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from passagemill.sources import pickled, sink


@pytest.mark.parametrize("protocol", range(pickle.HIGHEST_PROTOCOL + 1))
def test_plain_values_come_back(protocol):
    word = "wörd \n 'x' \U0001f600"
    shared = [1, 2]
    value = [{"a": word, "b": [word, word], "n": None, "t": (1, (2, 3, 4), (5, 6, 7, 8), ()), "f": -1.5e300,
              "big": 2**70, "neg": -3, "flags": [True, False], "one": (1,), "two": (1, 2)}, shared, shared, {}, [], 300, 70000, {1: {2: 3}}]
    assert pickled.plain_value(pickle.dumps(value, protocol)) == value
    for plain in (5, "x", None, [], [[[]]], {"a": {}}, list(range(3000)), {i: i for i in range(2500)}):
        assert pickled.plain_value(pickle.dumps(plain, protocol)) == plain


class Trap:
    def __reduce__(self):
        return os.mkdir, ("/tmp/never-made",)


@pytest.mark.parametrize("bad", [Trap(), collections.OrderedDict(a=1), {1, 2}, b"bytes", 1j, len, [Trap()]])
def test_anything_else_is_refused_and_nothing_runs(bad):
    for protocol in range(pickle.HIGHEST_PROTOCOL + 1):
        with pytest.raises(ValueError, match="only plain values"):
            pickled.plain_value(pickle.dumps(bad, protocol))
    assert not os.path.exists("/tmp/never-made")


def test_broken_pickles_are_errors():
    whole = pickle.dumps([{"a": [1, "x"]}])
    for broken in (b"", b"]", b"].", whole[:-1], whole[:9], b"(.", b"a.", b"]K\x01s.", b"h\x05.", b"\x85.", b"]K\x01]aa.x"):
        try:
            assert pickled.plain_value(broken) == []  # an empty list is whole
            assert broken == b"]."
        except ValueError:
            assert broken != b"]."


def test_shards_are_read_by_number_and_position(spark, tmp_path):
    rows = [{"example_id": f"e{i}", "query": "q", "generated_answer": [f"a{i}", "é"], "score": 0.5 * i, "extra": i} for i in range(23)]
    del rows[3]["query"]
    for n, name in enumerate(("run_250.pkl", "run_500.pkl", "run_1000.pkl", "run.pkl")):
        (tmp_path / name).write_bytes(pickle.dumps(rows[n * 6:n * 6 + 6]))
    (tmp_path / "run_9.txt").write_text("no shard")
    schema = "example_id STRING, query STRING, generated_answer ARRAY<STRING>, score DOUBLE"
    got = pickled.read_foreign_shards(spark, str(tmp_path), schema, prefix="run").orderBy("shard", "position").collect()
    assert [r.example_id for r in got] == [f"e{i}" for i in [*range(18, 23), *range(18)]]
    assert got[8].query is None and got[0].generated_answer == ["a18", "é"] and got[1].score == 9.5
    (tmp_path / "trap_1.pkl").write_bytes(pickle.dumps([{"example_id": Trap()}]))
    with pytest.raises(Exception, match="only plain values"):
        pickled.read_foreign_shards(spark, str(tmp_path), schema, prefix="trap").collect()
    (tmp_path / "hits.pkl").write_bytes(pickle.dumps([([3, 1], [0.5, 0.25]), ([], [])]))
    hits = pickled.read_foreign_results(spark, str(tmp_path / "hits.pkl")).orderBy("example_pos").collect()
    assert [tuple(r) for r in hits] == [(0, [3, 1], [0.5, 0.25]), (1, [], [])]


def test_a_failing_job_leaves_the_old_result(spark, tmp_path):
    path = str(tmp_path / "result")
    old = spark.range(100).withColumn("x", F.lit("old"))
    sink.save(old, path)
    bad = spark.range(0, 1000, 1, 8).withColumn("x", F.when(F.col("id") == 900, F.raise_error(F.lit("lost"))).otherwise(F.lit("new")))
    for attempt in (lambda: sink.save(bad, path, overwrite=True), lambda: sink.extend(bad, path)):
        with pytest.raises(Exception, match="lost"):
            attempt()
        assert sorted(map(tuple, sink.load(spark, path).collect())) == sorted(map(tuple, old.collect()))
        assert len([p for p in os.listdir(path) if p.startswith("version-")]) == 1
    with pytest.raises(FileExistsError):
        sink.save(old, path)
    new = old.withColumn("y", F.lit(1))
    assert sink.save_guarded(new, path).columns == ["id", "x"]
    assert sink.save_guarded(new, path, overwrite=True).columns == ["id", "x", "y"]
    sink.extend(new, path)
    assert sink.load(spark, path).count() == 200
    with pytest.raises(ValueError, match="other columns"):
        sink.extend(old, path)
    assert [p for p in os.listdir(path) if not p.startswith(("version-", "."))] == [sink.MANIFEST]
    sink.save(new.where("id < 0"), path, overwrite=True)
    assert sink.load(spark, path).collect() == []


def test_repeated_tasks_leave_no_second_copy(tmp_path):
    """Each task fails after half of its rows at its first attempt."""
    script = f"""
import sys
sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})
from pyspark import TaskContext
from pyspark.sql import SparkSession
from passagemill.sources import sink
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").getOrCreate()
def run(batches):
    for n, batch in enumerate(batches):
        if n == 2 and TaskContext.get().attemptNumber() == 0:
            raise RuntimeError("first attempt")
        yield batch
spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
sink.save(spark.range(0, 1000, 1, 4).mapInArrow(run, "id LONG"), {str(tmp_path / 'r')!r})
print("ROWS", sorted(r.id for r in sink.load(spark, {str(tmp_path / 'r')!r}).collect()) == list(range(1000)))
"""
    out = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=300)
    assert "ROWS True" in out.stdout, out.stderr[-2000:]
