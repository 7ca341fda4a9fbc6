"""The k-th keys of groups against sorting, whatever the keys."""

import random

from pyspark.sql import functions as F

from passagemill.operators import ranking, trainset
from passagemill.session import stored


def test_kth_keys_are_those_of_sorting(spark):
    rng = random.Random(3)
    rows = [(0, rng.randrange(-2**63, 2**63)) for _ in range(700)] + [(1, rng.randrange(5)) for _ in range(300)]
    rows += [(2, 7)] * 40 + [(3, i) for i in range(1500)] + [(None, 1), (4, -2**63), (4, 2**63 - 1)]
    rows = [(g, o, i) for i, (g, o) in enumerate(rows)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g INT, o LONG, t LONG").repartition(6)
    wanted = {0: {1, 2, 350, 699, 700, 800}, 1: {1, 60, 150, 299}, 2: {1, 17, 39}, 3: {1, 1024, 1499}, 4: {1, 2}, 5: {1}}
    got = ranking.kth_keys(df, "g", "o", wanted, "t")
    assert set(got) == {(g, k) for g, ks in wanted.items() for k in ks}
    for g, ks in wanted.items():
        keys = sorted((o, t) for h, o, t in rows if h == g)
        for k in ks:
            if k >= len(keys):
                assert got[g, k] is None
                continue
            assert got[g, k][0] == keys[k - 1][0]
            taken = df.where((F.col("g") == g) & ranking.up_to(got[g, k], "o", "t")).collect()
            assert sorted((r.o, r.t) for r in taken) == keys[:k]


def test_samples_sort_nothing_and_evaluate_silver_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = [(i, f"e{i}", f"q{i}", list(range(5)), list(range(i % 4)), i % 7 > 0) for i in range(500)]
    schema = ("example_pos BIGINT, example_id STRING, query STRING, document_indices ARRAY<BIGINT>, "
              "selected_documents ARRAY<BIGINT>, are_answer BOOLEAN")
    silver = stored(spark.createDataFrame(rows, schema), "silver").mapInArrow(counted, schema)
    for sample in (trainset.quota_sample, trainset.quota_sample_global):
        before = seen.value
        found = sample(silver)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Sort" not in plan and "Exchange" not in plan and "Window" not in plan
        assert len(found.collect()) > 20 and seen.value - before == 500
