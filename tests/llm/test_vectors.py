"""The three vector operators against plain loops, and tables that are awkward in every way."""

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from passagemill.llm import bisectors, mtree, orchard, vectors

SCHEMA = ("vec_id LONG, embedding ARRAY<FLOAT>, label INT, row LONG, v STRING, pivot STRING, code INT, "
          "cluster STRING, distance DOUBLE, grp STRING, error STRING, rank STRING")
EXTRA = (None, "x", None, None, "c", 0.5, "g", "e", "r")


def frame(spark, rows):
    """Rows (vec_id, embedding, label), with further columns of clashing names."""
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA)


def random_rows(n, dims, seed=0, spread=1.0):
    """Vectors on a coarse grid, so that many are equal or equally far; ids in no order."""
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(0, spread, (n, dims)) * 4) / 4
    ids = rng.permutation(n * 3)[:n]
    return [(int(i), [float(c) for c in row], int(i) % 4 if i % 5 else None) for i, row in zip(ids, x)]


def awkward_rows(dims):
    rows = random_rows(300, dims, 1)
    common = [0.25] * dims
    rows += [(2000 + i, common, 1) for i in range(150)]  # a third of the rows are one vector
    rows += [rows[0], rows[0], (20, rows[1][1], None), (20, rows[2][1], None), (None, rows[3][1], None), (None, [-1.5] * dims, 2)]
    rows += [(9000, None, 1), (9020, [], 1), (9040, [0.5] * (dims - 1), 2), (9060, [0.5] * (dims - 1) + [math.nan], 1),
             (9080, [math.inf] + [0.5] * (dims - 1), 1), (9100, [None] + [0.5] * (dims - 1), 1), (9120, [0.0] * dims, 3)]
    return rows


def integers(embedding, factor):
    if embedding is None or any(x is None or not math.isfinite(x) for x in embedding):
        return None
    return [math.floor(factor * x) for x in embedding]


def squared(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def last(i):
    return math.inf if i is None else i


def nearest(x, entries):
    return min((squared(x, e), k) for k, e in enumerate(entries))


def moved(entries, members):
    """Entries replaced by the floors of their members' means."""
    return [[sum(c) // len(got) for c in zip(*got)] if (got := members[k]) else e for k, e in enumerate(entries)]


def plain_clusters(rows, k, rounds, dims, factor=256):
    kept = [(i, v) for i, e, _ in rows if (v := integers(e, factor)) is not None and len(v) == dims]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [v for _, v in first[:k]]
    for _ in range(rounds):
        members = defaultdict(list)
        for _, v in kept:
            members[nearest(v, centroids)[1]].append(v)
        centroids = moved(centroids, members)
    found = [(i, *nearest(v, centroids)[::-1]) for i, v in kept]
    inertia = defaultdict(int)
    for _, c, d in found:
        inertia[c] += d
    return [(i, c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest())
            for i, c, d in found]


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, x) for x in r))


@pytest.mark.parametrize("dims, k", [(64, 40), (8, 7)])
def test_clusters_are_those_of_plain_loops(spark, dims, k):
    rows = awkward_rows(dims)
    got = bisectors.cluster_report(frame(spark, rows).repartition(5), k=k, rounds=3, dims=dims)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert ordered(got.collect()) == ordered(plain_clusters(rows, k, 3, dims))


def test_fewer_vectors_than_centroids_or_none(spark):
    rows = random_rows(5, 8)
    assert ordered(bisectors.cluster_report(frame(spark, rows), k=40, dims=8).collect()) == ordered(plain_clusters(rows, 40, 5, 8))
    for none in ([], [(1, None, None), (2, [math.nan] * 8, 1)]):
        for got in (bisectors.cluster_report(frame(spark, none), dims=8), orchard.compress(frame(spark, none)),
                    mtree.top_k(frame(spark, none))):
            assert got.collect() == [] and len(got.columns) >= 4


def test_a_tournament_takes_the_smaller_number_on_the_plane():
    planes = bisectors.Tournament(np.array([[9, 9], [0, 2], [2, 0], [0, 2], [-2, 0], [0, -2]]))
    x = np.array([[0, 0], [1, 1], [-1, 1], [-1, -1], [0, 2], [9, 9]])
    assert planes.nearest(x).tolist() == [1, 1, 1, 4, 1, 0]


def plain_codes(rows, parts, size, rounds, dims, factor=256):
    kept = [(i, v, label) for i, e, label in rows if (v := integers(e, factor)) is not None and len(v) == dims]
    width = dims // parts
    cut = [[v[p * width:(p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda j: (last(kept[j][0]), kept[j][1]))[:size]
    books = [[cut[j][p] for j in first] for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for x in cut:
                members[nearest(x[p], books[p])[1]].append(x[p])
            books[p] = moved(books[p], members)
    coded = [[nearest(x[p], books[p]) for p in range(parts)] for x in cut]
    errors, by_label = [sum(d for d, _ in c) for c in coded], defaultdict(int)
    for (_, _, label), error in zip(kept, errors):
        by_label[label] += error
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return [(i, "".join(f"{k:02x}" for _, k in c), error, by_label[label], digest)
            for (i, _, label), c, error in zip(kept, coded, errors)]


@pytest.mark.parametrize("dims, size", [(64, 64), (32, 5)])
def test_codes_are_those_of_plain_loops(spark, dims, size):
    rows = awkward_rows(dims)
    got = orchard.compress(frame(spark, rows).repartition(5), size=size)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert ordered(got.collect()) == ordered(plain_codes(rows, 16, size, 2, dims))


def test_orchards_search_finds_the_nearest_and_skips_most():
    rng = np.random.default_rng(3)
    entries = rng.integers(-40, 40, (3 * 64, 2))
    entries[5] = entries[9] = entries[40]  # equal entries: the lowest index counts
    books = orchard.Codebooks(entries, 3)
    x = np.concatenate([rng.integers(-60, 60, (500, 6)), entries[[5, 9, 40]].repeat(3, axis=1)])
    code, away = books.nearest(x)
    for row, c, d in zip(x.reshape(-1, 3, 2).tolist(), code.tolist(), away.tolist()):
        for p in range(3):
            assert nearest(row[p], entries[64 * p:64 * p + 64].tolist()) == (d[p], c[p] - 64 * p)
    compared = []
    books._walks(x[:, :2].copy(), np.full(len(x), books.start[0]))
    original = np.einsum
    try:
        orchard.np.einsum = lambda s, a, b: compared.append(len(a)) or original(s, a, b)
        books._walks(x[:, :2].copy(), np.full(len(x), books.start[0]))
    finally:
        orchard.np.einsum = original
    assert sum(compared) < 0.5 * 64 * len(x)


def plain_top_k(rows, k, every, factor=64):
    kept = [(n, i, v) for n, (i, e, _) in enumerate(rows) if (v := integers(e, factor)) is not None]
    out = []
    for n, i, q in kept:
        if i is not None and i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), last(j), m) for m, j, v in kept if m != n)
            out += [(i, r + 1, None if j == math.inf else j, -s) for r, (s, j, _) in enumerate(scored[:k])]
    return out


@pytest.mark.parametrize("options", [
    {}, {"page_rows": 8, "shard_rows": 40, "query_block": 7}, {"page_rows": 16, "shard_rows": 50, "max_pivots": 3, "k": 3},
    {"k": 1000, "shard_rows": 64, "every": 60}])
def test_top_k_is_that_of_plain_loops(spark, options):
    rows = awkward_rows(12)
    got = mtree.top_k(frame(spark, rows).repartition(5), **options)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert ordered(got.collect()) == ordered(plain_top_k(rows, options.get("k", 20), options.get("every", 20)))


def test_the_tree_avoids_comparisons_of_clustered_vectors(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 1, (20, 16))
    x = np.floor(64 * (centres[rng.integers(0, 20, 4000)] + rng.normal(0, 0.05, (4000, 16)))).astype(np.int64)
    sphere = mtree.Sphere(int((x * x).sum(axis=1).max()), 16)
    pages = list(mtree.build_pages(x, rng.permutation(4000), sphere, 64))
    assert sorted(np.concatenate([p[1] for p in pages]).tolist()) == list(range(4000))
    pivot = x[:1]
    table = mtree.pa.table({
        "router": vectors.as_lists(np.array([p[0] for p in pages])), "radius": [float(p[2][-1]) for p in pages],
        "parent": sphere.stored(np.array([p[0] for p in pages]), pivot)[:, 0],
        "rows": [p[1] for p in pages], "ids": [p[1] for p in pages], "away": [p[2] for p in pages],
        "vectors": mtree.pa.array([x[p[1]].reshape(-1).astype(np.int32) for p in pages])})
    compared, original = [], mtree.products
    try:
        mtree.products = lambda a, b: compared.append(len(a) * len(b)) or original(a, b)
        q = x[:50]
        best = mtree.Shard(table, sphere).search(
            q, np.arange(50), sphere.queries(q, pivot)[:, 0], np.full(50, mtree.NO_SCORE), 20)
    finally:
        mtree.products = original
    exact = q @ x.T
    for i in range(50):
        exact[i, i] = mtree.NO_SCORE
        assert sorted(best.score[best.query == i].tolist()) == np.sort(exact[i])[-20:].tolist()
    assert sum(compared) < 0.5 * exact.size


def test_great_components_stay_exact_and_greater_ones_are_refused(spark):
    rows = [(20 * i, [float(c) for c in x], 0) for i, x in enumerate(np.random.default_rng(2).integers(-2**20, 2**20, (60, 8)))]
    assert ordered(mtree.top_k(frame(spark, rows), page_rows=8).collect()) == ordered(plain_top_k(rows, 20, 20))
    with pytest.raises(Exception, match="component beyond"):
        bisectors.cluster_report(frame(spark, [(1, [1e30] * 8, 0)]), dims=8).collect()
