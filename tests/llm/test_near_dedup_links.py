"""The near_dedup stage joins what op7 links and what the whole sets link."""

import random
from itertools import combinations

import numpy as np

import corpus_pipeline
from passagemill.llm import minhash, simhash


def plain_groups(docs):
    """Both kinds of links, pair by pair."""
    prints = {i: simhash.fingerprint(t) for i, t in docs.items()}
    sets = {i: minhash.shingle_set(t, 5) for i, t in docs.items()}
    root, kinds = {i: i for i in docs}, {"print": 0, "set": 0}
    for i, j in combinations(sorted(docs), 2):
        common = len(np.intersect1d(sets[i], sets[j]))
        near = len(sets[i]) and common >= 0.8 * (len(sets[i]) + len(sets[j]) - common)
        close = (prints[i] ^ prints[j]).bit_count() <= 2
        kinds["print"] += close and not near and bool(len(sets[i]))
        kinds["set"] += bool(near and not close)
        if near or close:
            low, high = sorted((root[i], root[j]))
            root = {k: low if r == high else r for k, r in root.items()}
    return root, kinds


def test_close_fingerprints_link_whatever_the_sets_say(spark):
    rng = random.Random(4)

    def words(n):
        return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))

    docs, chant = {}, "over and under " * 60
    for i in range(0, 40, 4):
        text = words(150)
        docs |= {i: text, i + 1: text + " " + words(2), i + 2: words(3) + " " + text, i + 3: words(150)}
    docs |= {100: chant + words(20), 101: chant + words(20), 102: words(20) + " " + chant, 103: "over and over", 104: "", 105: " \n"}
    # a chain: op7 links 110 and 111, the sets link 111 and 112
    tail = words(250)
    base = "again and again " * 400
    docs |= {110: base + words(30), 111: base + tail, 112: tail + " " + words(5)}
    root, kinds = plain_groups(docs)
    assert kinds["print"] >= 3 and kinds["set"] >= 3
    assert root[101] == 100 and root[112] == root[111] == root[110] == 110
    frame = spark.createDataFrame([(i, t, "s") for i, t in docs.items()] + [(200, None, "s"), (0, docs[0], "t")], "doc_id LONG, text STRING, source STRING")
    kept = corpus_pipeline.one_of_each_group(spark, frame, "")
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({root[i] for i in docs})


def test_links_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id LONG, text STRING")
    assert corpus_pipeline.one_of_each_group(spark, empty, "").count() == 0
