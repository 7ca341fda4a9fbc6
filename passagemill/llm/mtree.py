"""Exact top-k by inner product: best-first search in a paged M-tree.

With one more component sqrt(R^2 - |x|^2), where R is the greatest length of any vector, all
vectors x' lie on one sphere, and a query q (0 in that place) has |q - x'|^2 = |q|^2 + R^2 -
2 q.x: the greatest inner products are the nearest neighbours in a metric.

The tree has three levels. At the top are up to `max_pivots` routing vectors with covering
radii; every vector belongs to its nearest one. What a pivot holds is cut into shards of
about `shard_rows` vectors, each the work of a task. A shard's middle level are routing
vectors of pages with their covering radii and their distances to the pivot; a leaf page is
up to `page_rows` vectors sorted by their distance to its routing vector.

A query first goes to the shard with the least lower bound. Its k-th score there goes along
to all shards whose bound does not lie beyond it. In a shard, pages that the stored distance
between page and pivot already rules out are passed over without a distance; the others are
visited by ascending lower bound until it lies beyond the k-th distance. Of a page only the
run of vectors whose stored distance is near enough to the query's is compared: by triangle
inequality no other can be as near. Scores are exact integers; bounds are floats with a
margin, so rounding never prunes a score that counts.

Queries come to a shard in blocks of about `query_block`, and each block of a shard is one
task's work: no task holds all queries, all vectors of a pivot, or all results.

Nulls: vectors that are null or hold null or non-finite components take no part; shorter
vectors end in zeros. Rows without vec_id are candidates, last among equal scores, and no
queries. A query's own row is no candidate; another row with its id is one. Repeated rows
count each. With fewer candidates than k all are returned; no vectors give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from passagemill.llm.common import column
from passagemill.llm.vectors import as_lists, as_matrix, integer_batches
from passagemill.session import stored

FOUND = "query_row LONG, query_id LONG, row LONG, vec_id LONG, score LONG"
NO_ID = 2**63 - 1  # behind every id among equal scores
NO_SCORE = -(2**63)


class Sphere:
    """Distances between vectors lifted to the sphere of radius R."""

    def __init__(self, radius2: int, dims: int) -> None:
        self.radius2, self.dims = radius2, dims

    def lift(self, x: np.ndarray) -> np.ndarray:
        """The component that brings stored vectors onto the sphere."""
        return np.sqrt(np.maximum(self.radius2 - np.einsum("ij,ij->i", x, x), 0).astype(np.float64))

    def stored(self, x: np.ndarray, to: np.ndarray) -> np.ndarray:
        """Distances between stored vectors, rows of x by rows of `to`."""
        flat = (x * x).sum(axis=1)[:, None] + (to * to).sum(axis=1)[None] - 2 * products(x, to)
        return np.sqrt(flat + (self.lift(x)[:, None] - self.lift(to)[None]) ** 2)

    def queries(self, q: np.ndarray, to: np.ndarray) -> np.ndarray:
        """Distances from queries to stored vectors."""
        return np.sqrt(np.maximum((q * q).sum(axis=1)[:, None] + self.radius2 - 2 * products(q, to), 0).astype(np.float64))

    def reach(self, q2: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The distance at which a score lies, a margin added; infinite without a score."""
        base = (q2 + self.radius2).astype(np.float64)
        known = score > NO_SCORE
        away = np.sqrt(np.maximum(base - 2.0 * np.where(known, score, 0) + 1 + 1e-9 * base, 0)) * (1 + 1e-9)
        return np.where(known, away, np.inf)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: by floats where 53 bits hold every sum, by integers otherwise."""
    most = a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    if most < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def build_pages(x: np.ndarray, order_by: np.ndarray, sphere: Sphere, page_rows: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Routing vector, members and their ascending distances of each page of a shard.

    Routing vectors are members spread evenly over `order_by`, which has no bearing on place.
    """
    n_routers = -(-len(x) // page_rows)
    routers = x[np.argsort(order_by, kind="stable")[:: max(1, len(x) // n_routers)]]
    own = np.empty(len(x), np.int64)
    away = np.empty(len(x))
    for a in range(0, len(x), 4096):
        apart = sphere.stored(x[a:a + 4096], routers)
        own[a:a + 4096] = apart.argmin(axis=1)
        away[a:a + 4096] = apart.min(axis=1)
    order = np.lexsort((away, own))
    for members in np.split(order, np.flatnonzero(np.diff(own[order])) + 1):
        for a in range(0, len(members), page_rows):
            page = members[a:a + page_rows]
            yield routers[own[page[0]]], page, away[page]


class Best:
    """The k best (score, then id) of each query of a block, and the scores to beat."""

    def __init__(self, n: int, k: int, least: np.ndarray) -> None:
        self.k, self.least = k, least.copy()
        self.query, self.row, self.id, self.score = (np.empty(0, np.int64) for _ in range(4))

    def add(self, query: np.ndarray, row: np.ndarray, vec_id: np.ndarray, score: np.ndarray) -> None:
        query, row, vec_id, score = (np.concatenate(x) for x in (
            (self.query, query), (self.row, row), (self.id, vec_id), (self.score, score)))
        order = np.lexsort((row, vec_id, -score, query))
        query = query[order]
        starts = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]]))
        rank = np.arange(len(query)) - np.repeat(starts, np.diff([*starts, len(query)]))
        kept = order[rank < self.k]
        full = order[rank == self.k - 1]
        self.least[query[rank == self.k - 1]] = np.maximum(self.least[query[rank == self.k - 1]], score[full])
        self.query, self.row, self.id, self.score = query[rank < self.k], row[kept], vec_id[kept], score[kept]


class Shard:
    """The pages of one shard, as rows of the page table."""

    def __init__(self, pages: pa.Table, sphere: Sphere) -> None:
        self.sphere = sphere
        self.routers = as_matrix(pages["router"], sphere.dims)
        self.radius, self.parent = pages["radius"].to_numpy(), pages["parent"].to_numpy()
        lists = {c: pages[c].combine_chunks() for c in ("rows", "ids", "away", "vectors")}
        self.pages = [(
            lists["rows"][i].values.to_numpy(), lists["ids"][i].values.to_numpy(), lists["away"][i].values.to_numpy(),
            lists["vectors"][i].values.to_numpy().reshape(-1, sphere.dims).astype(np.int64)) for i in range(len(pages))]

    def search(self, q: np.ndarray, own: np.ndarray, to_pivot: np.ndarray, least: np.ndarray, k: int) -> Best:
        """`own` are the queries' row numbers, `least` the scores that do not yet rule them out."""
        best, q2 = Best(len(q), k, least), (q * q).sum(axis=1)
        reach = self.sphere.reach(q2, best.least)
        # pages that the stored distance to the pivot leaves possible; only they are measured
        open_ = np.abs(to_pivot[:, None] - self.parent[None]) - self.radius[None] <= reach[:, None]
        asked = np.flatnonzero(open_.any(axis=0))
        to_page = np.full(open_.shape, np.inf)
        to_page[:, asked] = self.sphere.queries(q, self.routers[asked])
        bound = np.where(open_, to_page - self.radius[None], np.inf)
        order = np.argsort(bound, axis=1, kind="stable")
        going = np.arange(len(q))
        for step in range(len(self.pages)):
            page = order[going, step]
            possible = (bound[going, page] <= reach[going]) & (bound[going, page] < np.inf)
            going, page = going[possible], page[possible]  # bounds only rise: the others are done
            if not len(going):
                break
            found = []
            by_page = np.argsort(page, kind="stable")
            for group in np.split(by_page, np.flatnonzero(np.diff(page[by_page])) + 1):
                p, asking = page[group[0]], going[group]
                rows, ids, away, vectors = self.pages[p]
                here = to_page[asking, p]
                # members no further from the routing vector than the query's reach allows
                low = np.searchsorted(away, (here - reach[asking]).min(), "left")
                high = np.searchsorted(away, (here + reach[asking]).max(), "right")
                if low < high:
                    scores = products(q[asking], vectors[low:high])
                    hit, member = np.nonzero((scores >= best.least[asking, None]) & (rows[None, low:high] != own[asking, None]))
                    found.append((asking[hit], rows[low + member], ids[low + member], scores[hit, member]))
            if found:
                best.add(*(np.concatenate(x) for x in zip(*found)))
                reach = self.sphere.reach(q2, best.least)
        return best


def top_k(vectors: DataFrame, k: int = 20, factor: int = 64, every: int = 20, page_rows: int = 256,
          shard_rows: int = 1 << 14, query_block: int = 1 << 12, max_pivots: int = 1024) -> DataFrame:
    """query_id, rank, vec_id and score of the k best other rows for every `every`-th id.

    `max_pivots` bounds what the driver and every task hold of the tree: that many vectors.
    """
    spark = vectors.sparkSession
    result = "query_id LONG, rank INT, vec_id LONG, score LONG"
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    dims = given.agg(F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()[0]
    if dims < 0:
        dims = 0

    def integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in integer_batches(batches, factor, dims, pad=True):
            yield pa.RecordBatch.from_arrays(
                [column(part, "vec_id"), as_lists(x.astype(np.int32)), pa.array((x * x).sum(axis=1))],
                ["vec_id", "v", "square"])

    # written once with row numbers, which tell equal rows apart from here on
    rows = stored(given.mapInArrow(integers, "vec_id LONG, v ARRAY<INT>, square LONG")
                  .withColumn("row", F.monotonically_increasing_id()), "vectors")
    asks = F.coalesce(F.col("vec_id") % every == 0, F.lit(False))
    n, n_queries, radius2 = rows.agg(F.count("*"), F.count_if(asks), F.max("square")).first()
    if not n or not n_queries:
        return spark.createDataFrame([], result)
    sphere = Sphere(radius2, dims)
    wanted = min(max_pivots, -(-4 * n // shard_rows))
    pivots = np.unique(np.array([r.v for r in rows.select("v").orderBy(F.xxhash64("row"), "row").limit(
        wanted).collect()], np.int64).reshape(-1, dims), axis=0)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                apart = sphere.stored(as_matrix(column(part, "v"), dims).astype(np.int64), pivots)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(apart.argmin(axis=1).astype(np.int32)), pa.array(apart.min(axis=1))],
                    [*part.schema.names, "pivot", "parent"])

    placed = rows.select("row", "vec_id", "v").mapInArrow(
        nearest, "row LONG, vec_id LONG, v ARRAY<INT>, pivot INT, parent DOUBLE")
    held = {r.pivot: (r.n, r.r) for r in placed.groupBy("pivot").agg(
        F.count("*").alias("n"), F.max("parent").alias("r")).collect()}  # a row for each pivot
    cuts = np.array([-(-held.get(p, (0, 0))[0] // shard_rows) for p in range(len(pivots))])
    first_shard = np.concatenate([[0], np.cumsum(cuts)])
    radius = np.array([held.get(p, (0, 0.0))[1] for p in range(len(pivots))])

    def build(group: pa.Table) -> pa.Table:
        order = np.argsort(group["row"].to_numpy())  # equal pages on retry
        group = group.take(pa.array(order))
        x, row = as_matrix(group["v"], dims).astype(np.int64), group["row"].to_numpy()
        ids = group["vec_id"].to_numpy() if not group["vec_id"].null_count else np.array(
            [NO_ID if i is None else i for i in group["vec_id"].to_pylist()], np.int64)
        pages = list(build_pages(x, group["mixed"].to_numpy(), sphere, page_rows))
        routers = np.array([p[0] for p in pages])
        parent = sphere.stored(routers, pivots[[group["pivot"][0].as_py()]])[:, 0]
        return pa.table({
            "shard": pa.array([group["shard"][0].as_py()] * len(pages), pa.int32()), "router": as_lists(routers),
            "radius": [float(p[2][-1]) for p in pages], "parent": parent,
            "rows": [row[p[1]] for p in pages], "ids": [ids[p[1]] for p in pages], "away": [p[2] for p in pages],
            "vectors": pa.array([x[p[1]].reshape(-1).astype(np.int32) for p in pages], pa.list_(pa.int32()))})

    by_pivot = F.array(*[F.lit(int(s)) for s in first_shard])
    shard = (by_pivot[F.col("pivot")] + F.pmod(F.col("mixed"), by_pivot[F.col("pivot") + 1] - by_pivot[F.col("pivot")])).cast("int")
    pages = stored(placed.withColumn("mixed", F.xxhash64("row")).withColumn("shard", shard).groupBy("shard").applyInArrow(
        build, "shard INT, router ARRAY<LONG>, radius DOUBLE, parent DOUBLE, rows ARRAY<LONG>, ids ARRAY<LONG>, "
               "away ARRAY<DOUBLE>, vectors ARRAY<INT>"), "pages")
    blocks = -(-n_queries // query_block)

    def towards(batches: Iterator[pa.RecordBatch], first: bool) -> Iterator[pa.RecordBatch]:
        """A row for each query and shard to search: its best one, or all others that may count."""
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                q, number = as_matrix(column(part, "v"), dims).astype(np.int64), column(part, "row").to_numpy()
                away = sphere.queries(q, pivots)
                bound = np.where(cuts > 0, away - radius, np.inf)
                best = bound.argmin(axis=1)
                home = first_shard[best] + number % cuts[best]
                if first:
                    query, pivot, target = np.arange(len(q)), best, home
                else:
                    least = column(part, "least").fill_null(NO_SCORE).to_numpy()
                    open_ = bound <= sphere.reach((q * q).sum(axis=1), least)[:, None]
                    query, pivot = np.nonzero(open_ & (cuts > 0))
                    times = cuts[pivot]
                    target = np.repeat(first_shard[pivot] - (np.cumsum(times) - times), times) + np.arange(times.sum())
                    query, pivot = np.repeat(query, times), np.repeat(pivot, times)
                    other = target != home[query]
                    query, pivot, target = query[other], pivot[other], target[other]
                sent = part.take(pa.array(query))
                yield pa.RecordBatch.from_arrays(
                    [*sent.columns, pa.array(target.astype(np.int32)), pa.array(away[query, pivot])],
                    [*sent.schema.names, "shard", "to_pivot"])

    def search(queries: pa.Table, shard_pages: pa.Table) -> pa.Table:
        if not len(queries) or not len(shard_pages):
            return pa.table({c: pa.array([], pa.int64()) for c in ("query_row", "query_id", "row", "vec_id", "score")})
        queries = queries.take(pa.array(np.argsort(queries["row"].to_numpy())))
        own, q = queries["row"].to_numpy(), as_matrix(queries["v"], dims).astype(np.int64)
        least = queries["least"].combine_chunks().fill_null(NO_SCORE).to_numpy()
        best = Shard(shard_pages, sphere).search(q, own, queries["to_pivot"].to_numpy(), least, k)
        return pa.table({
            "query_row": own[best.query], "query_id": queries["vec_id"].to_numpy()[best.query],
            "row": best.row, "vec_id": best.id, "score": best.score})

    def searched(queries: DataFrame, first: bool) -> DataFrame:
        asked = queries.mapInArrow(
            lambda batches: towards(batches, first),
            "row LONG, vec_id LONG, v ARRAY<INT>, least LONG, shard INT, to_pivot DOUBLE",
        ).withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
        many = pages.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        return stored(asked.groupBy("shard", "block").cogroup(many.groupBy("shard", "block")).applyInArrow(search, FOUND), "found")

    queries = rows.where(asks).select("row", "vec_id", "v")
    near = searched(queries.withColumn("least", F.lit(None).cast("long")), True)
    kth = near.groupBy("query_row").agg(F.count("*").alias("n"), F.min("score").alias("s")).select(
        F.col("query_row").alias("row"), F.when(F.col("n") >= k, F.col("s")).alias("least"))
    far = searched(queries.join(kth, "row", "left"), False)
    ranked = near.unionAll(far).withColumn("rank", F.row_number().over(
        Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")))
    return ranked.where(F.col("rank") <= k).select(
        "query_id", "rank", F.when(F.col("vec_id") < NO_ID, F.col("vec_id")).alias("vec_id"), "score")
