"""JSON arrays in parallel splits against Python's own parser."""

import json
import random

import pytest

from passagemill.session import scratch_path
from passagemill.sources import tables
from passagemill.sources.json_array import read_json_array, write_json_list

HARD = ['a "quoted" {brace}', "}{][", '\\', '\\\\"', 'ends in a backslash\\', '"', '}', '{"a": [1, 2]}', "", "é ö 語 \U0001f600",
        "line\nbreak\ttab\r", ", {", "[", '\\"}', 'x' * 300]


@pytest.fixture
def small_splits(spark):
    """Splits of so many bytes; the settings are put back."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}

    def use(size):
        for n, value in zip(names, (size, 1)):
            spark.conf.set(n, str(value))

    yield use
    for n, value in before.items():
        spark.conf.set(n, value)


def objects(n, seed):
    rng = random.Random(seed)
    return [{"title": rng.choice([*HARD, None]), "text": "".join(rng.choice(HARD) for _ in range(rng.randrange(4)))} for _ in range(n)]


@pytest.mark.parametrize("indent, ascii_only, size", [(None, True, 512), (2, False, 300), (None, False, 64), (1, True, 97), (None, True, 1 << 20)])
def test_an_array_is_read_by_many_tasks(spark, tmp_path, small_splits, indent, ascii_only, size):
    rows = objects(150, size)
    path = tmp_path / "corpus.json"
    path.write_text(json.dumps(rows, indent=indent, ensure_ascii=ascii_only), encoding="utf-8")
    small_splits(size)
    got = tables.import_corpus_array(spark, str(path))
    if size <= 512:
        assert spark.read.option("lineSep", "}").text(str(path)).rdd.getNumPartitions() > 8
    found = {r.full_corpus_idx: {"title": r.title, "text": r.text} for r in got.collect()}
    assert found == dict(enumerate(rows)) and got.count() == len(rows)


def test_nested_objects_and_spacing(spark, tmp_path, small_splits):
    rows = [{"id": i, "more": {"deep": [{"x": HARD[i % len(HARD)]}] * (i % 3)}, "list": [[i], []]} for i in range(60)]
    path = tmp_path / "nested.json"
    path.write_text(" [\n " + " \n,\n ".join(json.dumps(r) for r in rows) + " ]\n ")
    small_splits(50)
    schema = "id LONG, more STRUCT<deep: ARRAY<STRUCT<x: STRING>>>, list ARRAY<ARRAY<LONG>>"
    got = read_json_array(spark, str(path), schema).orderBy("position").collect()
    assert [(r.position, r.element.asDict(recursive=True)) for r in got] == list(enumerate(rows))


@pytest.mark.parametrize("text", [
    "", "{}", '{"text": "x"}', '[{"text": "x"}', '[{"text": "x"}, 5]', '[{"text": "x"} {"text": "y"}]', '[5, {"text": "x"}]',
    '[{"text": "x"}] {"text": "y"}', '[{"text": "x}]', '[{"text": x}]', '["a", {"text": "b"}]', '[{"text": "b"}]]'])
def test_what_is_no_array_of_objects_is_an_error(spark, tmp_path, small_splits, text):
    path = tmp_path / "bad.json"
    path.write_text(text)
    small_splits(4)
    with pytest.raises(Exception, match="JSON|array of objects|MALFORMED"):
        read_json_array(spark, str(path), "title STRING, text STRING").collect()


def test_empty_arrays_and_several_files(spark, tmp_path, small_splits):
    small_splits(3)
    for n, text in enumerate(("[]", " [\n ] ")):
        path = tmp_path / f"empty{n}.json"
        path.write_text(text)
        assert read_json_array(spark, str(path), "text STRING").collect() == []
    with pytest.raises(ValueError, match="one array file"):
        read_json_array(spark, str(tmp_path), "text STRING")


def test_a_written_list_parses_in_order_and_reads_back(spark, tmp_path, small_splits):
    rng = random.Random(4)
    positions = rng.sample(range(-500, 5000), 400)
    rows = [(p, HARD[p % len(HARD)], [p, None], None if p % 3 else {"a": HARD[p % 7]}) for p in positions]
    df = spark.createDataFrame(rows, "position LONG, text STRING, ids ARRAY<LONG>, more MAP<STRING, STRING>").repartition(7)
    path = str(tmp_path / "list.json")
    parts = write_json_list(df, path, "position", part_bytes=4096)
    whole = open(path, "rb").read()
    want = [{"text": t, "ids": i, "more": m} for _, t, i, m in sorted(rows, key=lambda r: r[0])]
    assert json.loads(whole) == want
    assert len(parts) > 3 and sum(n for _, n in parts) == len(whole)
    assert all(whole[a:a + n].startswith((b"[", b",", b"]")) for a, n in parts if n)
    small_splits(200)
    back = read_json_array(spark, path, "text STRING, ids ARRAY<LONG>, more MAP<STRING, STRING>").orderBy("position").collect()
    assert [(r.position, r.element.text, r.element.ids, r.element.more) for r in back] == [
        (i, w["text"], w["ids"], w["more"]) for i, w in enumerate(want)]
    with pytest.raises(FileExistsError):
        write_json_list(df, path, "position")
    write_json_list(df.limit(0), path, "position", overwrite=True)
    assert json.load(open(path)) == []
    for bad in (df.unionAll(df.orderBy("position").limit(1)), df.withColumn("position", df.position % 2 + 1 + 0 * df.position).where("position = 1")):
        with pytest.raises(ValueError, match="repeated"):
            write_json_list(bad, scratch_path(spark, "bad"), "position")
    assert [p for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == [tmp_path / "list.json"]
