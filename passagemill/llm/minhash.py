"""Links between texts whose sets of word shingles are similar, verified on the whole sets.

A text's set are the hashes of its shingles of `words_each` words (shorter texts are one
shingle). Bands of a few MinHash values each are its sketch: two sets of Jaccard similarity
s agree on a band of r values with probability s**r. From the similarity asked for follows
the greatest r at which the bands that VALUES allow miss less than 1 - RECALL of the pairs
just that similar: at 0.8 they are 24 bands of 6 (0.9993 are found), at 0.5 48 of 3. Sets
that agree on a band are candidates, and their true similarity decides; the links left span
each group, never all its pairs.

What meets on a band is cut into blocks of bounded size, so no task grows with a group. An
eighth of the bands goes first, block by block; the links found join most copies, and a band
all whose sets are joined by then is done. The others follow, block by block again. Of bands
of several blocks that still hold sets not joined to each other, those outside the band's
largest component are compared with all of it: two sets of one component need no link. So a
band of many near copies costs its size, and only what stays unlike it is compared with it
again; nothing that agrees on a band is left out.

Nulls: a null text counts as empty; texts without words have the empty set, which is similar
to none, and equal sets are one. Rows without doc_id have a sketch like any other; repeated
rows give repeated sketches, and an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from passagemill.llm.common import chunks, column, id_and_text, mix64
from passagemill.llm.graph import components
from passagemill.session import stored

VALUES = 144  # MinHash values of a sketch
RECALL = 0.998
BLOCK_SHINGLES = 1 << 19  # in a block; each of its sets counts SET_COST more
SET_COST = 512
FIRST_OF = 8  # one band in so many goes first
SEED = 42

_RNG = np.random.default_rng(SEED)
_FACTORS = _RNG.integers(0, 1 << 63, VALUES).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _RNG.integers(0, 1 << 63, VALUES).astype(np.uint64)
_PLACES = _RNG.integers(0, 1 << 63, 64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str, words_each: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; empty without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    each = min(words_each, len(words))
    n = len(words) - each + 1
    joined = np.full(n, each, np.uint64)
    for k in range(each):
        joined += mix64(hashes[k:k + n]) * _PLACES[k % 64]
        joined = mix64(joined)
    return np.unique(joined)


def layout(similarity: float) -> tuple[int, int]:
    """Number of bands and of values in each, for pairs at least that similar."""
    if not 0 < similarity <= 1:
        raise ValueError("a similarity lies above 0 and is at most 1")
    for rows in range(VALUES, 0, -1):
        bands = VALUES // rows
        if 1 - (1 - similarity**rows) ** bands >= RECALL:
            return bands, rows
    raise ValueError(f"{VALUES} MinHash values do not find pairs of similarity {similarity}")


def bands(shingles: np.ndarray, n: int, rows: int) -> np.ndarray:
    """The hash of each band's MinHash values."""
    least = np.full(VALUES, 2**64 - 1, np.uint64)
    for a in range(0, len(shingles), 512):
        np.minimum(least, (shingles[a:a + 512, None] * _FACTORS + _OFFSETS).min(axis=0), out=least)
    keys = np.arange(n, dtype=np.uint64)
    for k in range(rows):
        keys = mix64(keys * _PLACES[k % 64] + least[k:n * rows:rows])
    return keys


def sketches(docs: DataFrame, words_each: int, similarity: float,
             fingerprint: Callable[[str], int] = lambda text: 0) -> DataFrame:
    """doc_id, text_hash (of the row's text), fp (the hash of its set), size and bands of the
    set, and print, the text's `fingerprint`."""
    n, each = layout(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            texts = column(batch, "text").to_pylist()
            sets = [shingle_set(t, words_each) for t in texts]
            yield pa.RecordBatch.from_arrays([
                column(batch, "doc_id"), column(batch, "text_hash"),
                pa.array(np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([bands(s, n, each).view(np.int64) if len(s) else [] for s in sets], pa.list_(pa.int64())),
                pa.array(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)),
            ], ["doc_id", "text_hash", "fp", "size", "bands", "print"])

    return id_and_text(docs).withColumn("text_hash", F.xxhash64("text")).mapInArrow(
        run, "doc_id LONG, text_hash LONG, fp LONG, size LONG, bands ARRAY<LONG>, print LONG")


def spanning(sets: list[np.ndarray], similarity: float, roots: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Index pairs spanning the graph of sets whose Jaccard similarity is at least that.

    Each set is compared with all that no link has reached yet. Sets with equal `roots` are
    joined already and are not compared.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    names, codes = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.split(codes, np.cumsum(sizes)[:-1])
    marked = np.zeros(len(names), bool)
    left, flat, starts, held = np.arange(len(sets)), codes, np.cumsum(sizes) - sizes, np.arange(len(sets))
    links, todo = [], []

    def reach(new: np.ndarray) -> None:
        """Take `new` out of what is left, with all that is joined to it."""
        nonlocal left
        gone = np.isin(left, new) if roots is None else np.isin(roots[left], roots[new])
        todo.extend(left[gone].tolist())
        left = left[~gone]

    while len(left):
        if not todo:
            reach(left[:1])
        if not len(left):
            break
        i = todo.pop()
        if len(left) <= len(held) // 2:
            flat, held = np.concatenate([own[j] for j in left]), left
            starts = np.cumsum(sizes[held]) - sizes[held]
        marked[own[i]] = True
        common = np.add.reduceat(marked[flat], starts, dtype=np.int64)[np.searchsorted(held, left)]
        marked[own[i]] = False
        near = left[common >= similarity * (sizes[left] + sizes[i] - common) - 1e-9]
        if len(near):
            links.extend((i, j) for j in near.tolist())
            reach(near)
    return links


def _sets(docs: DataFrame, rows: DataFrame, wanted: DataFrame, words_each: int) -> DataFrame:
    """fp and shingles of the sets `wanted`, each from one of the texts that have it."""
    wanted = wanted.join(rows.groupBy("fp").agg(F.min("text_hash").alias("text_hash")), "fp")
    texts = id_and_text(docs).select("text", F.xxhash64("text").alias("text_hash"))
    texts = texts.join(wanted, "text_hash").dropDuplicates(["fp"]).select("fp", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            found = [shingle_set(t, words_each).view(np.int64) for t in column(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "fp"), pa.array(found, pa.list_(pa.int64()))], ["fp", "shingles"])

    return texts.mapInArrow(run, "fp LONG, shingles ARRAY<LONG>")


def _own_blocks(members: DataFrame) -> DataFrame:
    """Each set in one block of its band."""
    block = F.pmod(F.xxhash64("fp", "band"), F.col("blocks")).cast("int")
    return members.select("fp", "root", "band", block.alias("low"), block.alias("high"))


def _strays(members: DataFrame, block_shingles: int) -> DataFrame:
    """Block pairs of each band that compare all sets outside its largest component (the
    strays) with each other and with that component, but not the component with itself."""
    by_root = members.groupBy("band", "root").agg(F.sum("cost").alias("cost"))
    per_band = by_root.groupBy("band").agg(F.sum("cost").alias("all"), F.max(F.struct("cost", "root")).alias("most")).select(
        "band", F.col("most.root").alias("home"),
        F.ceil((F.col("all") - F.col("most.cost")) / block_shingles).cast("int").alias("strays"),
        F.ceil(F.col("most.cost") / block_shingles).cast("int").alias("others"))
    stray, mixed = F.col("root") != F.col("home"), F.xxhash64("fp", "band")
    own = F.when(stray, F.pmod(mixed, F.col("strays"))).otherwise(F.col("strays") + F.pmod(mixed, F.col("others")))
    last = F.when(stray, F.col("strays") + F.col("others")).otherwise(F.col("strays")) - 1
    return members.join(per_band, "band").select(
        "fp", "root", "band", own.cast("int").alias("own"), F.explode(F.sequence(F.lit(0), last)).alias("other"),
    ).select("fp", "root", "band", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))


def _still_apart(members: DataFrame, edges: DataFrame) -> DataFrame:
    """The members, with their component by now, of bands whose sets are not yet all joined."""
    known = members.drop("root").join(components(edges), F.col("fp") == F.col("node"), "left").select(
        "fp", "band", "cost", "blocks", F.coalesce("root", "fp").alias("root"))
    apart = known.groupBy("band").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b")
    return known.join(apart.select("band"), "band", "left_semi")


def links(docs: DataFrame, rows: DataFrame, words_each: int, similarity: float,
          block_shingles: int = BLOCK_SHINGLES, proposed: DataFrame | None = None) -> DataFrame:
    """Verified links (a, b) between the distinct sets `fp` of the sketches `rows` of `docs`.

    `proposed` (fp, size, band) are sets that meet for another reason; they are compared like
    those of a MinHash band.
    """
    met = rows.select("fp", "size", F.explode("bands").alias("band"))
    met = (met if proposed is None else met.unionByName(proposed)).distinct().withColumn("cost", F.col("size") + SET_COST)
    groups = met.groupBy("band").agg(
        F.count("*").alias("n"), F.sum("cost").alias("cost"), F.sum(F.xxhash64("fp").cast("decimal(38,0)")).alias("who"),
    ).where("n > 1")
    # bands on which the same sets meet are compared once
    groups = groups.groupBy("n", "who", "cost").agg(F.min("band").alias("band")).select(
        "band", F.ceil(F.col("cost") / block_shingles).cast("int").alias("blocks"))
    members = stored(met.join(groups, "band").select("fp", "band", "cost", "blocks", F.col("fp").alias("root")), "near-members")
    sets = stored(_sets(docs, rows, members.select("fp").distinct(), words_each), "near-sets")

    def verify(group: pa.Table) -> pa.Table:
        order = np.argsort(fps := group["fp"].to_numpy())  # equal results on retry
        lists = group["shingles"].combine_chunks()
        found = spanning([lists[i].values.to_numpy() for i in order.tolist()], similarity, group["root"].to_numpy()[order])
        a, b = np.array(found, np.int64).reshape(-1, 2).T
        return pa.table({"a": fps[order][a], "b": fps[order][b]})

    def compared(placed: DataFrame) -> DataFrame:
        return stored(placed.join(sets, "fp").groupBy("band", "low", "high").applyInArrow(
            verify, "a LONG, b LONG").distinct(), "near-links")

    early = F.pmod(F.xxhash64("band"), F.lit(FIRST_OF)) == 0
    edges = compared(_own_blocks(members.where(early)))
    edges = edges.unionAll(compared(_own_blocks(stored(_still_apart(members.where(~early), edges), "near-apart"))))
    cut = members.where("blocks > 1")
    if not cut.isEmpty():
        edges = edges.unionAll(compared(_strays(stored(_still_apart(cut, edges), "near-apart"), block_shingles)))
    return edges
