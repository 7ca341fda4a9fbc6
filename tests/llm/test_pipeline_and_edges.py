"""The pipeline against plain Python, and tables that are awkward in every way."""

import re
import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from passagemill.llm import (
    decontaminate, fingerprints, language, line_dedup, lm_score, packing, quality, secret_scan,
    sequences, simhash, tokens,
)
from test_operators import plain_line_dedup

SF = "/root/testdata/sf0.001"


def plain_shingles(text):
    words = "".join(c.lower() if c.isascii() else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", words)
    return {" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def test_pipeline(spark):
    from tokenizers import Tokenizer
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {i: t for i, t in text.items() if quality.log_odds([t], model.slot_scores(), model.bias)[0] >= 0}
    lines = {i: "\n".join(kept) for i, (_, kept) in plain_line_dedup(list(good.items())).items()}
    # groups by the whole sets of 5-word shingles, compared pair by pair
    sets = {i: plain_shingles(t) for i, t in sorted(lines.items())}
    root = {i: i for i in sets}
    for i, j in combinations(sets, 2):
        common = len(sets[i] & sets[j])
        if common >= 0.8 * (len(sets[i]) + len(sets[j]) - common):
            low, high = sorted((root[i], root[j]))
            root = {k: low if r == high else r for k, r in root.items()}
    one = {i: t for i, t in lines.items() if root[i] == i}
    items = [decontaminate.normal_bytes(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {i: t for i, t in one.items() if not any(x in decontaminate.normal_bytes(t) for x in items)}
    assert len(text) > len(good) > len(one) > len(clean) > 50

    tokenizer = Tokenizer.from_file(tokens.default_tokenizer())
    want = set()
    for i, t in clean.items():
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = ids[k:k + 2048]
            want.add((i, k // 2048, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    out = corpus_pipeline.run(spark, SF).collect()
    assert {tuple(r)[:5] for r in out} == want and len(out) == len(want)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert all(r.n_chars == len(r.text) for r in out.collect())


SCHEMA = ("doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG, score DOUBLE, fp STRING, "
          "first STRING, spans INT, target BOOLEAN, text_hash LONG, sequence_id STRING, component_id INT, "
          "held_out STRING, members ARRAY<INT>, slot MAP<STRING, INT>")


def awkward_rows():
    rest = (None,) * 11
    long = "a line of words that comes again \n" * 4000 + "x" * 70_000
    rows = [
        (1, None, None, None, None, *rest), (None, "an id is missing here, is it not", "en", "s", None, *rest),
        (None, None, None, None, None, *rest), (2, "", "en", "", 0, *rest), (3, " \n\t ", "en", "s", 4, *rest),
        (4, long, "en", "s", len(long), *rest), (5, "tie tie tie", "de", "s", 11, *rest),
        (5, "tie tie tie", "de", "s", 11, *rest), (5, "another text with the same id", "de", "s", 1, *rest),
        (6, "😀 emoji été İ", "fr", "s", 9, 1.0, "fp", "f", 3, True, 4, "q", 5, "h", [1], {"a": 1}),
        (-7, "Plain words in a line, once more and more.", "en", "s", 40, *rest),
        (8, "Plain words in a line, once more and more.", "en", "s", 40, *rest),
    ]
    return [tuple(c.encode("utf-16", "surrogatepass").decode("utf-16") if isinstance(c, str) else c for c in r) for r in rows]


@pytest.fixture(scope="module", params=["awkward", "empty"])
def case(request, spark):
    rows = awkward_rows() if request.param == "awkward" else []
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame(
        [(1, 1, None), (2, 0, 0), (None, 1, 1), (5, None, 0), (5, 1, 0), (5, 0, 0), (4, 0, 1)] if rows else [],
        "doc_id LONG, quality INT, toxic INT")
    items = spark.createDataFrame(
        [(1, None), (None, "words in a line, once"), (2, ""), (2, "tie"), (2, "tie")] if rows else [],
        "item_id LONG, text STRING")
    return docs, labels, items, rows


def ids(df):
    return sorted((r.doc_id is None, r.doc_id or 0) for r in df.select("doc_id").collect())


def test_one_row_for_each_row(spark, case):
    docs, labels, items, rows = case
    want = sorted((r[0] is None, r[0] or 0) for r in rows)
    outs = {
        "fingerprint": fingerprints.fingerprint(docs),
        "neighbours": fingerprints.compare_neighbours(docs, parts=3),
        "secrets": secret_scan.scan(docs),
        "language": language.identify(docs, language.train(docs)),
        "lm": lm_score.score(docs, lm_score.train(docs)),
        "simhash": simhash.near_duplicates(docs),
        "quality": quality.score(docs, quality.train(docs, labels)),
        "sequences": sequences.read_documents(spark, sequences.write_sequences(docs, parts=3)),
        "lines": line_dedup.drop_report(docs, line_dedup.build_shards(docs)),
    }
    for name, out in outs.items():
        assert ids(out) == want, name
    pieces = packing.pack_documents(docs).where("piece = 0")
    assert ids(pieces) == want
    assert set(i for _, i in ids(decontaminate.find(docs, items))) <= {r[0] or 0 for r in rows}


def test_defined_results(spark, case):
    docs, labels, items, rows = case
    if not rows:
        return
    found = defaultdict(list)
    for r in decontaminate.find(docs, items).collect():
        found[r.doc_id].append((r.item_id, r.edits))
    assert sorted(found, key=str) == sorted([-7, 8, 5, 5][:3], key=str)
    assert found[-7] == [(None, 0)] and sorted(found[5]) == [(2, 0)] * 4
    langs = language.identify(docs, language.train(docs)).collect()
    assert all(r.lang_pred == "und" and r.score == 0 for r in langs if r.doc_id in (1, 2, 3))
    same = {r.doc_id: r.fingerprint for r in fingerprints.fingerprint(docs).collect()}
    assert same[-7] == same[8] and set(same[1]) == set(same[2]) == {"0"}
    near = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert {(8, -7), (-7, -7), (1, 1), (2, 1), (3, 1), (None, 1)} <= near


def test_filters_keep_all_columns(spark, case):
    docs, labels, items, rows = case
    model = quality.train(docs, labels)
    for out in (quality.keep_good(docs, model, 0.0), line_dedup.drop_lines(docs),
                decontaminate.drop_contaminated(docs, items), simhash.keep_one(docs)):
        assert out.dtypes == docs.dtypes
        got = out.collect()
        assert len(got) <= len(rows)
        assert all(r["slot"] == {"a": 1} for r in got if r.doc_id == 6)
    if rows:
        assert quality.keep_good(docs, model, 0.0).count() == len(rows)
        kept = simhash.keep_one(docs).collect()
        assert sorted((r.doc_id for r in kept if r.doc_id is not None)) == [-7, 1, 4, 5, 5, 6]


def test_model_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "")], "doc_id LONG, text STRING")
    none = spark.createDataFrame([], "doc_id LONG, quality INT")
    assert {r.score for r in quality.score(docs, quality.train(docs, none)).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1)], "doc_id LONG, quality INT")
    scores = {r.score for r in quality.score(docs, quality.train(docs, one)).collect()}
    assert len(scores) == 1 and 0.5 <= scores.pop() <= 1
