"""Cases that an operator once left out: edges of texts, other scripts, tables of any size."""

import math
import random
import zlib
from collections import Counter

import numpy as np

from passagemill import fixed_values as fv
from passagemill.functions import selection
from passagemill.llm import decontaminate, language, lm_score, minhash, packing, quality, simhash
from passagemill.plans.queries import QUERIES

SF = "/root/testdata/sf0.01"


def benchmark_items(spark):
    return [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect()]


def found_in(texts, items):
    """For each text the items found in it."""
    index = decontaminate.Index([(i, decontaminate.normal_bytes(t)) for i, t in enumerate(items)], 4, 14, 0.1)
    return [{m[0] for m in found} for found in index.search(texts)]


def test_edited_items_at_both_ends_of_a_document(spark):
    items = benchmark_items(spark)
    around = "some other words that no item has " * 10
    shortened = [(t.split(" ", 1)[1], t.rsplit(" ", 1)[0]) for t in items] + [(t[1:], t[:-1]) for t in items]
    for part in (shortened[:len(items)], shortened[len(items):]):
        at_start = found_in([f"{head} {around}" for head, _ in part], items)
        at_end = found_in([f"{around}{tail}" for _, tail in part], items)
        for i in range(len(items)):
            assert i in at_start[i] and i in at_end[i]


def test_items_inside_unspaced_text(spark):
    rng = random.Random(3)

    def prose(first, last, n):
        return "".join(chr(rng.randrange(first, last)) for _ in range(n))

    scripts = [(0x4E00, 0x9FA5), (0x3041, 0x3097), (0x0E01, 0x0E2F)]
    items = [prose(*s, 50) for s in scripts for _ in range(10)]
    texts = [f"{prose(*s, 300)}{items[10 * k + j]}{prose(*s, 300)}" for k, s in enumerate(scripts) for j in range(10)]
    edited = [t.replace(x, x[:7] + x[8:25] + "q" + x[26:]) for t, x in zip(texts, items)]  # 2 of 50 characters
    for space in (" ", "　"):
        for t in benchmark_items(spark)[:10]:
            items.append(t.replace(" ", space))
            texts.append(f"one paragraph and{' another word' * 9} {items[-1]} and more words".replace(" ", space))
    for cases in (texts, edited):
        got = found_in(cases, items)
        assert [i for i in range(len(cases)) if i not in got[i]] == []
    assert found_in(["2024年" + items[0]], ["年" + items[0]]) == found_in([f"全部abc{items[0]}"], ["abc" + items[0]]) == [{0}]


def test_near_copies_of_a_few_words_go(spark):
    rng = random.Random(5)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(400).collect()]
    docs = {i: t for i, t in enumerate(texts)}
    for i, text in enumerate(texts):
        words = text.split()
        for k in range(int(0.035 * len(words) * rng.random())):
            words[rng.randrange(len(words))] = f"w{i}x{k}"
        docs[1000 + i] = " ".join(words)
    words = [f"base{k}" for k in range(200)]
    for i in range(300):  # one large group of copies, each of its own
        docs[5000 + i] = " ".join([*words[:150], f"own{i}", *words[151:]])

    def shingles(text):
        w = text.encode().lower().split()
        return frozenset(b" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets, root = {i: shingles(t) for i, t in docs.items()}, {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in sets.items():
        for j, y in sets.items():
            if i < j and 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)):
                if 9 * len(x & y) >= 4 * (len(x) + len(y)):
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
    want = {i for i in docs if find(i) == i}
    assert len(want) < len(docs) - 500
    frame = spark.createDataFrame(list(docs.items()), "doc_id LONG, text STRING")
    kept = [r.doc_id for r in simhash.keep_one(frame).collect()]
    assert len(kept) == len(set(kept)) and set(kept) == want
    # blocks far smaller than the group
    rows = minhash.sketches(frame, 5, 0.8).cache()
    edges = minhash.links(frame, rows, 5, 0.8, block_shingles=20_000)
    assert {r.component_id for r in simhash._grouped(rows.drop("size", "bands"), edges).collect()} == want


def test_a_band_of_copies_costs_its_size(spark):
    """Blocks hold some 8 sets; 500 near copies and 20 sets unlike them meet on one band."""
    cost, copies, strays = 1000, 500, 20
    members = spark.createDataFrame(
        [(i, 1, cost, 0, 0 if i < copies else i) for i in range(copies + strays)],
        "fp LONG, band LONG, cost LONG, blocks INT, root LONG")
    placed = minhash._strays(members, 8 * cost).collect()
    pairs = {}
    for r in placed:
        pairs.setdefault((r.low, r.high), set()).add(r.fp)
    met = {frozenset((a, b)) for x in pairs.values() for a in x for b in x if a != b}
    assert {frozenset((a, b)) for a in range(copies, copies + strays) for b in range(copies + strays) if a != b} <= met
    sent = Counter(r.fp for r in placed)
    assert max(sent[i] for i in range(copies)) <= 3  # blocks of strays, not of copies
    assert max(len(x) for x in pairs.values()) < 60
    edges = spark.createDataFrame([(0, i) for i in range(1, copies)], "a LONG, b LONG")
    one = members.where(f"fp < {copies}")
    assert minhash._still_apart(one, edges).isEmpty()
    assert minhash._still_apart(members, edges).count() == copies + strays


def test_spanning_skips_what_is_joined():
    rng = np.random.default_rng(1)
    base = np.sort(rng.integers(0, 1 << 60, 100).astype(np.uint64))
    sets = [np.sort(np.concatenate([base[:90], rng.integers(0, 1 << 60, 10).astype(np.uint64)])) for _ in range(6)]
    sets += [np.sort(rng.integers(0, 1 << 60, 100).astype(np.uint64))]
    assert len(minhash.spanning(sets, 0.8)) == 5
    found = minhash.spanning(sets, 0.8, np.array([5, 5, 5, 9, 9, 9, 1]))
    assert len(found) >= 1 and all((i < 3) != (j < 3) and 6 not in (i, j) for i, j in found)
    assert minhash.spanning(sets, 0.8, np.zeros(7)) == []


def test_slots_grow_with_the_words(spark):
    docs = spark.createDataFrame(
        [(i, " ".join(f"w{1000 * i + k}" for k in range(1000)), i % 2 == 0) for i in range(600)],
        "doc_id LONG, text STRING, target BOOLEAN")
    one = {r.doc_id: r for r in lm_score.score(docs, lm_score.train(docs)).collect()}
    model = lm_score.train(docs, keys_per_block=50_000)
    assert len(model.keys.places) >= 24 and (np.diff(model.keys.firsts.astype(float)) > 0).all()
    for r in lm_score.score(docs, model).collect():
        assert r == one[r.doc_id]
    # every word and pair once: counts that unrelated ones share would change the losses
    alone = -math.log(0.6 + 0.35 / 600_000 + 0.05 / 2**20)
    first = -math.log(0.6 / 600 + 0.35 / 600_000 + 0.05 / 2**20)
    mean = sum(r.background_loss for r in one.values()) / 600
    assert abs(mean - (999 * alone + first) / 1000) < 0.005


def test_emoji_are_no_letters():
    models = language.estimate({
        lang: np.unique(language.grams(*language.folded([text])[:2], 4)[1:], return_counts=True)
        for lang, text in (("de", "ein Haus am See"), ("en", "a house by the lake"))})
    langs, score, rejected = models.predict(["😀 12 🎉🎉 3", "𐐀𐐁 letters", "a 😀 house"])
    assert langs[0] == "und" and score[0] == 0 and rejected[0]
    symbols, lengths, letters = language.folded(["😀 12 🎉🎉 3", "𐐀𐐁 x", "a 😀 house"])
    assert letters.tolist() == [0, 3, 6] and langs[2] == "en"


def test_equal_pieces_are_dealt_over_all_groups(spark):
    piece = ("members ARRAY<STRUCT<doc_id: LONG, piece: INT, start: LONG, length: LONG, ids_crc32: LONG>>, size LONG")
    items = spark.createDataFrame([([(None, 0, 0, 1, 7)], 1)] * 4000, piece)
    out = packing._merge_round(items, 20, 1, 10, 0).collect()
    in_group = Counter()
    for r in out:
        in_group[r.sequence_id >> 24 & 0xFFFFFFFF] += len(r.members)
    assert sum(in_group.values()) == 4000 and len(in_group) == 20 and max(in_group.values()) < 400


def test_links_within_one_bit_in_groups_of_any_size(spark):
    def linked(values, within):
        return {frozenset((r.a, r.b)) for r in simhash.links(spark.createDataFrame([(v,) for v in values], "fp LONG"), within).collect()}

    base = 0x1234567890ABCDE0
    few = [base, base ^ 1, base ^ 6]
    many = [base ^ (m << 8) for m in range(64) if m.bit_count() % 2 == 0]  # two bits apart
    assert linked(few, 2) == {frozenset((base, base ^ 1)), frozenset((base, base ^ 6))}
    assert linked(few, 1) == {frozenset((base, base ^ 1))} and linked(few, 0) == set()
    assert len(many) > 16 and linked(many, 1) == linked(many[:10], 1) == set()
    assert all(bin(min(e) ^ max(e)).count("1") == 1 for e in linked([*many, many[0] ^ 256], 1))


def test_alias_numbers_of_any_length(spark):
    marker = fv.ASSISTANT_MARKER
    rows = [(f"{marker}Id_2,Id_3,Id_2147483647,Id_2147483648,Id_{'9' * 30},Id_02", [5, 7])]
    got = spark.createDataFrame(rows, "reply STRING, ids ARRAY<LONG>").select(
        selection.decode_selection("reply", "ids")).first()[0]
    assert got == f"7,Unknown(Id_3),Unknown(Id_2147483647),Unknown(Id_2147483648),Unknown(Id_{'9' * 30}),Unknown(Id_02)"


def test_queries_say_that_they_read_opening_words():
    for name in ("examples_scan", "shards_union", "resume_anti_join", "ordinal_slice", "sample_head",
                 "query_only_prompts", "evaluate_run_query_only", "eval_join", "attach_example_id"):
        assert "words 1-13" in (QUERIES[name].__doc__ or "")


def test_shared_files_are_named_by_their_file_system(spark, tmp_path, monkeypatch):
    from pyarrow import fs

    from passagemill.llm import common
    folder = common.shared_folder(spark, "x")
    assert folder.startswith("file:/")
    path = common.write_once(folder, "a", lambda out: out.write(b"text"))
    files, local = common.filesystem(path)
    assert isinstance(files, fs.LocalFileSystem) and files.open_input_file(local).read() == b"text"
    hadoop = spark._jsc.hadoopConfiguration()
    before = hadoop.get("fs.defaultFS")
    try:  # a path without scheme belongs to the default file system, not to the local one
        hadoop.set("fs.defaultFS", "viewfs://store/")
        hadoop.set("fs.viewfs.mounttable.store.link./shared", f"file://{tmp_path}")
        monkeypatch.setattr(common, "shared_dir", lambda _: "/shared/scratch")
        assert common.shared_folder(spark, "x").startswith("viewfs://store/shared/scratch/x-")
    finally:
        hadoop.set("fs.defaultFS", before)
    with_credentials = "?region=none"
    for uri, kind in (("s3a://bucket/a" + with_credentials, "s3"), ("s3n://bucket/a" + with_credentials, "s3"), ("dbfs:/mnt/a", "local")):
        assert common.filesystem(uri)[0].type_name == kind
    assert common.filesystem("dbfs:/mnt/a")[1] == "/dbfs/mnt/a"
    try:
        common.filesystem("/a/b")
    except ValueError:
        pass
    else:
        raise AssertionError("a path without file system")


def test_bands_follow_from_the_similarity(spark):
    assert minhash.layout(0.8) == (24, 6) and minhash.layout(1.0) == (1, 144)
    for wrong in (0.0, -1, 1.1, 0.01):
        try:
            minhash.layout(wrong)
        except ValueError:
            continue
        raise AssertionError(wrong)
    rng = random.Random(9)
    docs, near = [], []
    for i in range(150):  # pairs a little above and far below half of their shingles in common
        words = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        changed = list(words)
        for at in rng.sample(range(120), 6 if i % 2 else 60):
            changed[at] = "other"
        a, b = (minhash.shingle_set(" ".join(x), 5) for x in (words, changed))
        common = len(np.intersect1d(a, b))
        near.append(common / (len(a) + len(b) - common))
        docs += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(changed))]
    frame = spark.createDataFrame(docs, "doc_id LONG, text STRING")
    for similarity in (0.5, 0.8):
        kept = {r.doc_id for r in simhash.keep_one(frame, similarity=similarity).collect()}
        wanted = [i for i, s in enumerate(near) if s >= similarity]
        gone = [i for i in wanted if 2 * i + 1 not in kept]
        assert len(gone) >= 0.9 * len(wanted)
        assert all(2 * i in kept for i in range(150)) and all(2 * i + 1 in kept for i, s in enumerate(near) if s < similarity)
    assert sum(s >= 0.5 for s in near) > 30


def test_a_language_with_few_rows_is_learned(spark):
    english = [(i, f"the house by the lake number {i} was sold again", "en") for i in range(300)]
    few = [i for i in range(1000, 3000) if (zlib.crc32(str(i).encode()) % 3) != 1]
    calibrated = spark.createDataFrame([(i,) for i in few], "doc_id LONG").where("pmod(xxhash64(doc_id, 1), 10) = 0").limit(2).collect()
    german = [(r.doc_id, "das Haus am See wurde schon wieder verkauft", "de") for r in calibrated]
    docs = spark.createDataFrame(english + german, "doc_id LONG, text STRING, lang STRING")
    models = language.train(docs)
    assert models.languages == ["de", "en"] and models.predict(["das Haus am See"])[0] == ["de"]


def test_rounds_end_only_when_nothing_merges(spark):
    """Pieces that fit together by fours, in groups so small that most rounds merge few."""
    rng = random.Random(2)
    sizes = [rng.choice([26, 25, 24]) for _ in range(400)]
    found = spark.createDataFrame(
        [(i, 0, 0, n, i) for i, n in enumerate(sizes)], "doc_id LONG, piece INT, start LONG, length LONG, ids_crc32 LONG")
    from passagemill.session import stored
    out = packing.pack(stored(found, "pieces"), max_tokens=100, group_items=8).collect()
    assert sorted(r.doc_id for r in out) == list(range(400))
    filled = Counter()
    for r in out:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 100 and len(filled) <= 1.2 * sum(sizes) / 100


def test_a_repeated_labelled_id_is_one_row(spark):
    from passagemill.llm import quality
    docs = spark.createDataFrame(
        [(2, f"text of copy {i % 3}") for i in range(3000)] + [(3, "bad " * 9), (5, "good " * 9)], "doc_id LONG, text STRING")
    labels = spark.createDataFrame([(i, i % 2) for i in (2, 3, 5, 6)], "doc_id LONG, quality INT")
    seen, original = [], quality.fit
    try:
        quality.fit = lambda rows, **options: seen.extend(rows) or original(rows, **options)
        quality.train(docs, labels)
    finally:
        quality.fit = original
    assert len(seen) == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in (2, 3, 5))


def test_the_memo_of_words_is_bounded_by_their_length(monkeypatch):
    import pyarrow as pa

    from passagemill.llm import tokens
    monkeypatch.setattr(tokens, "MEMO_CHARS", 50_000)
    encoder = tokens.WordEncoder(tokens.default_tokenizer())
    rng = random.Random(1)
    for _ in range(6):  # texts without spaces: each is one word
        texts = ["".join(rng.choices("абвгд語", k=5000)) for _ in range(8)] + ["a few words"]
        ids, counts = encoder.encode(pa.array(texts))
        want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert ids.tolist() == [i for w in want for i in w] and counts.tolist() == [len(w) for w in want]
        assert encoder.chars <= 50_000 + 8 * 5000 + 20 and len(encoder.slot_of) <= 30


def test_long_texts_in_pieces(spark, monkeypatch):
    rng = random.Random(9)
    texts = [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(12).collect()]
    texts += ["", " ", "x" * 300, " " * 300, "ab  cd\n" * 80, "a b " * 100 + "  ", "日本語 text。" * 60,
              "".join(rng.choice("ab \n\tÄ9.😀") for _ in range(2000))]
    models = language.estimate({
        lang: np.unique(language.grams(*language.folded([t])[:2], 4)[1:], return_counts=True)
        for lang, t in (("de", "ein Haus am See steht auf Sand"), ("en", "a house by the lake stands on sand"))})
    scores = np.random.default_rng(1).normal(size=quality.SLOTS).astype(np.float32)
    loss, letters = models.cross_entropy(texts)
    odds, feats = quality.log_odds(texts, scores, 0.25), [quality.features(t) for t in texts]
    for piece in (1, 7, 64):
        monkeypatch.setattr(language, "PIECE", piece)
        monkeypatch.setattr(quality, "PIECE", piece)
        some = slice(None) if piece > 1 else slice(-9, None)
        got, n = models.cross_entropy(texts[some])
        assert np.allclose(got, loss[some], atol=1e-4) and (n == letters[some]).all()
        assert np.allclose(quality.log_odds(texts[some], scores, 0.25), odds[some], atol=1e-4)
        for (slots, shares), text in zip(feats[some], texts[some]):
            again = quality.features(text)
            assert (again[0] == slots).all() and np.allclose(again[1], shares)
