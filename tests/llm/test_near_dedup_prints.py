"""near_dedup goes through SimHash: its groups are candidates, and the whole sets decide."""

import numpy as np
from pyspark.sql import functions as F

from passagemill.llm import minhash, simhash
from passagemill.session import stored


def test_simhash_groups_are_compared_where_no_band_agrees(spark):
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), " ".join(words[:-1]), " ".join(words + ["more"]), "other words stand here", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING")
    prints = [simhash.fingerprint(t) for t in texts[:3]]
    assert len(set(prints)) > 1 or len({t for t in texts[:3]}) == 3
    rows = stored(minhash.sketches(docs, 5, 0.8, simhash.fingerprint), "sketches")
    assert {r.doc_id: r.print for r in rows.collect()} == {
        i: int(np.uint64(simhash.fingerprint(t)).astype(np.int64)) for i, t in enumerate(texts)}
    apart = rows.withColumn("bands", F.array().cast("array<bigint>"))  # no band agrees
    near = [i for i in (1, 2) if (prints[i] ^ prints[0]).bit_count() <= 2]
    assert near
    assert minhash.links(docs, apart, 5, 0.8).count() == 0
    edges = minhash.links(docs, apart, 5, 0.8, proposed=simhash._close_prints(apart))
    assert edges.count() >= len(near)
    # close prints alone link nothing: the sets decide
    assert minhash.links(docs, apart, 5, 1.0, proposed=simhash._close_prints(apart)).count() == 0
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [0, 3, 4]
