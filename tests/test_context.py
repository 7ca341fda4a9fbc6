"""Context assembly, lookups and their behaviour under hot keys."""

import pytest
from pyspark.sql import functions as F

from passagemill.functions import prompts as P
from passagemill.operators import context as C
from passagemill.operators.joins import first_per_key, last_per_key, lookup, semi_lookup
from passagemill.operators.ranking import global_rank
from passagemill.sources.tables import store_corpus


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(0, "t", "alpha"), (1, "t", "beta"), (2, "t", "alpha"), (3, "", "t alpha"),
            (4, "t", "delta"), (5, "u", "alpha")]
    return spark.createDataFrame(rows, "full_corpus_idx BIGINT, title STRING, text STRING")


@pytest.fixture(scope="module")
def examples(spark):
    rows = [(0, "a", "q’s", ["x"], 5), (1, "b", "r", ["y"], -1), (2, "c", "s", [], 4)]
    return spark.createDataFrame(
        rows, "example_pos BIGINT, example_id STRING, query STRING, answers ARRAY<STRING>, "
              "gold_document_idx BIGINT")


@pytest.fixture(scope="module")
def results(spark):
    rows = [(0, [0, 1, 2, 3, 4], [5.0, 4.0, 3.0, 2.0, 1.0]), (1, [99, 4], [2.0, 1.0])]
    return spark.createDataFrame(
        rows, "example_pos BIGINT, doc_ids ARRAY<BIGINT>, scores ARRAY<DOUBLE>")


def ids(frame):
    return {r.example_id: [d.doc_id for d in r.docs] for r in frame.collect()}


def test_order_dedup_and_missing(examples, results, corpus):
    docs = C.assemble_documents(examples, results, corpus, 5)
    # best last; documents 3, 2 and 0 have equal content, the first in the list stays
    assert ids(docs) == {"a": [4, 3, 1], "b": [4], "c": []}
    assert {r.query for r in docs.collect()} == {"q's", "r", "s"}
    assert {r.example_id: r.lost_hits for r in docs.collect()} == {"a": 0, "b": 1, "c": 0}


def test_gold_goes_in_and_the_last_falls_out(examples, results, corpus):
    known = examples.where("gold_document_idx <> -1")
    docs = C.assemble_documents(known, results, corpus, 2, gold_position=1)
    assert ids(docs) == {"a": [1, 5], "c": [4]}
    with pytest.raises(Exception, match="gold document"):
        C.assemble_documents(examples, results, corpus, 2, gold_position=0).collect()


def test_random_gold_is_stable(examples, results, corpus):
    known = examples.where("gold_document_idx >= 0")

    def run():
        return ids(C.assemble_documents(known, results, corpus, 4, random_gold_seed=3))

    assert run() == run()
    assert 5 in run()["a"]


def test_arguments(evaluate):
    for bad in ((0, None, None, False), (3, 0, None, False), (3, 9, 3, False), (3, 9, 1, True)):
        with pytest.raises(ValueError):
            C.check_arguments(*bad)
    column = C.insert_at("i", F.lit(9).cast("bigint"), 3)
    assert evaluate([([1, 2],), ([1, 2, 3, 4],), ([],)], "i ARRAY<BIGINT>", column) == [
        [1, 2, 9], [1, 2, 3, 9, 4], [9]]


def test_prompts_and_length_split(examples, results, corpus):
    prompts = C.assemble_context(examples, results, corpus, 5, P.Template("I")).cache()
    row = {r.example_id: r for r in prompts.collect()}["b"]
    assert row.prompt == "I\nQuestion: r\nDocuments:\nDocument [4](Title: t) delta\nAnswer:"
    limit = row.prompt_tokens_len
    assert C.short_context_count(prompts, 5, 10_000).collect()[0][0] == 3
    assert C.short_context_count(prompts, 5, limit).collect()[0][0] < 3
    kept = {r.example_id for r in C.length_filter(prompts, limit).collect()}
    out = {r.example_id for r in C.length_excluded(prompts, limit).collect()}
    assert "b" in out and kept | out == {"a", "b", "c"} and not kept & out


def test_random_gold_needs_a_gold_document(spark):
    frame = spark.createDataFrame([("a", [1, 2], -1)], "example_id STRING, ids ARRAY<BIGINT>, gold BIGINT")
    with pytest.raises(Exception, match="gold document"):
        frame.select(C.insert_gold_random("ids", "gold", 3, 1)).collect()


def test_hot_keys_are_split(spark):
    hits = spark.range(1000).select(
        F.col("id").alias("row"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id"))
        .cast("bigint").alias("key"))
    table = spark.range(0, 2000, 2).select(
        F.col("id").alias("key"), F.concat(F.lit("v"), "id").alias("value"))
    table = table.unionByName(spark.createDataFrame([(7, "v7")], "key BIGINT, value STRING"))
    spread = lookup(hits, table, "key", hot_rows=20)
    plain = hits.join(table, "key", "left")
    assert sorted(map(tuple, spread.select("row", "key", "value").collect())) == sorted(
        map(tuple, plain.select("row", "key", "value").collect()))


def test_global_rank_matches_a_plain_sort(spark):
    rows = [(i % 3 if i % 5 else 0, (i * 7919) % 100003 - 50000) for i in range(700)]
    frame = spark.createDataFrame(rows, "g INT, o BIGINT")
    ranked = global_rank(frame, "g", "o", "r", bits=6, group_size="n").collect()
    for group in (0, 1, 2):
        mine = sorted((r.o, r.r, r.n) for r in ranked if r.g == group)
        want = sorted(o for g, o in rows if g == group)
        assert mine == [(o, i + 1, len(want)) for i, o in enumerate(want)]


def test_first_and_last_per_key(spark):
    frame = spark.createDataFrame(
        [("a", 2, ["x"]), ("a", 1, None), ("b", 5, ["z"])], "k STRING, o INT, v ARRAY<STRING>")
    assert {r.k: r.v for r in first_per_key(frame, "k", "o").collect()} == {"a": None, "b": ["z"]}
    assert {r.k: r.v for r in last_per_key(frame, "k", "o").collect()} == {
        "a": ["x"], "b": ["z"]}


def test_semi_lookup_with_hot_keys(spark):
    hits = spark.range(300).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(
        F.col("id").cast("string")).alias("k"))
    keys = spark.createDataFrame([("hot",), ("4",), ("none",)], "k STRING")
    got = semi_lookup(hits, keys, "k", hot_rows=10)
    assert got.columns == ["k", "id"]
    assert sorted(r.id for r in got.collect()) == sorted([i for i in range(300) if i % 3 == 0] + [4])


def counted(spark, frame):
    """`frame` with a pass through Python tasks that counts its rows each time it runs."""
    calls = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            calls.add(batch.num_rows)
            yield batch

    return frame.mapInArrow(run, frame.schema), calls


def test_lookup_evaluates_its_hits_once(spark):
    hits, calls = counted(spark, spark.range(1000).select("id", (F.col("id") % 7).alias("k")))
    table = spark.range(5).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    assert lookup(hits, table, "k", hot_rows=100).where("v IS NOT NULL").count() == 715
    assert calls.value == 1000


def test_hot_rows_are_spread_whatever_their_columns(spark):
    hits = spark.range(1000).select(F.lit(1).alias("k"), F.array(F.lit("a")).alias("list"))
    table = spark.createDataFrame([(1, "v")], "k INT, v STRING")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = lookup(hits, table, "k", hot_rows=50).groupBy(
            F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r["count"] for r in placed) == 1000 and len(placed) > 1


def test_lookup_keeps_rows_without_a_key_and_refuses_mixed_types(spark):
    hits = spark.createDataFrame([(None, i) for i in range(30)] + [(4, 99)], "k BIGINT, i INT")
    table = spark.createDataFrame([(4, "v")], "k BIGINT, v STRING")
    got = lookup(hits, table, "k", hot_rows=10).collect()
    assert sorted(r.i for r in got) == [*range(30), 99]
    assert [r.v for r in got if r.i == 99] == ["v"] and all(r.v is None for r in got if r.i != 99)
    with pytest.raises(ValueError, match="different types"):
        lookup(hits, table.withColumn("k", F.col("k").cast("int")), "k")


def test_a_bucketed_corpus_is_not_shuffled(spark, tmp_path):
    corpus = spark.range(20000).select(
        F.col("id").alias("full_corpus_idx"), F.lit("t").alias("title"),
        F.sha2(F.col("id").cast("string"), 256).alias("text"))
    kept = store_corpus(corpus, "bucketed_corpus", 4, str(tmp_path / "corpus"))
    listed = spark.range(50).select(
        F.col("id").alias("example_pos"), F.array("id", F.col("id") + 1).alias("ids"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        found = C.lookup_documents(listed, kept)
        assert len(found.collect()) == 100
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE bucketed_corpus")
    final = plan.split("== Initial Plan ==")[0]
    above_scan = final[:final.index("bucketed_corpus")].splitlines()[-6:]
    assert "Bucketed: true" in final
    assert not any("Exchange" in line for line in above_scan), final
