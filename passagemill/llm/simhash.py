"""Near duplicates by SimHash, joined on pigeonhole blocks.

A 64-bit fingerprint is cut into 8 blocks of 8 bits. Two fingerprints that differ in at
most 2 bits agree on at least 6 whole blocks, so each distinct fingerprint goes out under
its 28 choices of 6 blocks and rows meet on equal choices. The two blocks left out have
16 bits, so a meeting has at most 65,536 distinct fingerprints whatever the data, and
their Hamming distances are checked there: each one looks up the values within 2 bits of
its own, and a spanning forest of the verified links leaves the group, never all its
pairs. Copies are one fingerprint before anything is joined. Groups over several links
come from alternating large-star and small-star steps, cut by checkpoint().

Nulls: a null text counts as empty; texts without words have fingerprint zero and are
linked like any other. Rows without doc_id are fingerprinted; an id is then null in
component_id only if no linked row has one. Repeated rows give repeated result rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from passagemill.llm import minhash
from passagemill.llm.common import chunks, column, id_and_text, parts_for
from passagemill.llm.graph import components
from passagemill.operators.joins import lookup
from passagemill.session import stored

BLOCKS, BLOCK_BITS = 8, 8
SEED = 42
PRINT_BYTES = 2 << 20  # of distinct fingerprints in a task


def fingerprint(text: str, words_each: int = 3) -> int:
    """SimHash over the word shingles of a whole text."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    hashed = xxhash.xxh64_intdigest
    if len(words) <= words_each:
        return hashed(joined, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - words_each + 1].tolist()
    ends = ends[words_each - 1:].tolist()
    hashes = np.fromiter((hashed(joined[a:b], SEED) for a, b in zip(starts, ends)), np.uint64, len(starts))
    return _majority(hashes)


def _majority(hashes: np.ndarray) -> int:
    """Bits set in over half the hashes; counted 64k hashes at a time."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[i:i + (1 << 16)])
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words_each: int = 3) -> DataFrame:
    """doc_id, text_hash (of the row's text) and the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            prints = [fingerprint(t, words_each) for t in column(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                column(batch, "doc_id"), column(batch, "text_hash"),
                pa.array(np.array(prints, np.uint64).view(np.int64))], ["doc_id", "text_hash", "fp"])

    return id_and_text(docs).withColumn("text_hash", F.xxhash64("text")).mapInArrow(
        run, "doc_id LONG, text_hash LONG, fp LONG")


def _near_masks(bits: int, within: int) -> np.ndarray:
    """All values of `bits` bits with at most `within` bits set."""
    return np.array([sum(1 << b for b in chosen) for k in range(within + 1)
                     for chosen in combinations(range(bits), k)], np.int64)


def forest(values: np.ndarray, masks: np.ndarray, within: int) -> list[tuple[int, int]]:
    """Index pairs (parent, child) spanning the graph of values that differ by a mask.

    `masks` are all values of at most `within` bits.
    """
    at = {int(v): i for i, v in enumerate(values)}
    if len(values) <= 16:
        near = [[j for j, w in enumerate(values) if (int(v) ^ int(w)).bit_count() <= within] for v in values]
    else:
        where = np.full(1 << (2 * BLOCK_BITS), -1, np.int64)
        where[values] = np.arange(len(values))
        near = None
    seen, links = np.zeros(len(values), bool), []
    for root in range(len(at)):
        if seen[root]:
            continue
        seen[root] = True
        todo = [root]
        while todo:
            i = todo.pop()
            found = near[i] if near else where[values[i] ^ masks]
            for j in found:
                if j >= 0 and not seen[j]:
                    seen[j] = True
                    links.append((i, int(j)))
                    todo.append(int(j))
    return links


def links(prints: DataFrame, within: int = 2) -> DataFrame:
    """Verified links (a, b) between distinct fingerprints `fp`, enough to span every group.

    `within` is at most 2: BLOCKS - within whole blocks are what the rows meet on.
    """
    if not 0 <= within <= 2:
        raise ValueError("blocks are laid out for 0 to 2 differing bits")
    left_out = list(combinations(range(BLOCKS), 2))

    def mask(blocks: tuple[int, ...]) -> int:
        return sum(0xFF << (BLOCK_BITS * b) for b in blocks)

    def signed(x: int) -> int:
        return x - (1 << 64) if x >= 1 << 63 else x

    fp = F.col("fp")
    met = prints.select(F.inline(F.array(*[
        F.struct(
            F.lit(n).alias("choice"),
            fp.bitwiseAND(F.lit(signed(~mask(pair) & (2**64 - 1)))).alias("blocks"),
            (F.shiftrightunsigned(fp, BLOCK_BITS * pair[0]).bitwiseAND(F.lit(0xFF))
             + F.shiftleft(F.shiftrightunsigned(fp, BLOCK_BITS * pair[1]).bitwiseAND(F.lit(0xFF)), BLOCK_BITS)
             ).cast("int").alias("rest"))
        for n, pair in enumerate(left_out)])))
    groups = met.groupBy("choice", "blocks").agg(F.collect_list("rest").alias("rest")) \
        .where(F.size("rest") > 1)
    masks = _near_masks(2 * BLOCK_BITS, within)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for choice, blocks, rest in zip(*(column(batch, c).to_pylist() for c in ("choice", "blocks", "rest"))):
                low, high = left_out[choice]

                def whole(r: int) -> int:
                    return blocks % 2**64 | (r & 0xFF) << BLOCK_BITS * low | (r >> 8) << BLOCK_BITS * high

                values = np.array(sorted(rest), np.int64)
                for i, j in forest(values, masks, within):
                    a.append(signed(whole(int(values[i]))))
                    b.append(signed(whole(int(values[j]))))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return groups.mapInArrow(verify, "a LONG, b LONG").distinct()


def near_duplicates(docs: DataFrame, words_each: int = 3, within: int = 2) -> DataFrame:
    """doc_id, text_hash, fp, component_id (smallest id of the group) and first_hash.

    first_hash is the text hash that goes with the smallest id, for picking one row.
    """
    rows = stored(fingerprints(docs, words_each), "simhash")
    # each print becomes 28 rows right here: a stated number of parts is not coalesced
    distinct = rows.select("fp").distinct().repartition(parts_for(rows.select("fp"), PRINT_BYTES), "fp")
    return _grouped(rows, links(distinct, within))


def _grouped(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Stored rows (doc_id, text_hash, fp) with the component_id and first_hash of their linked group."""
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("i"), F.col("text_hash").alias("h"))).alias("first")
    distinct = rows.groupBy("fp").agg(first)
    roots = components(edges)
    # only linked fingerprints take part in the group join; all others are their own group
    linked = distinct.join(roots, F.col("fp") == F.col("node"), "left") \
        .select("fp", "first", F.coalesce("root", "fp").alias("root"))
    groups = linked.join(linked.groupBy("root").agg(F.min("first").alias("least")), "root") \
        .where("least <> first").select("fp", "least")
    own = distinct.select(F.col("fp"), "first")
    found = stored(own.join(groups, "fp", "left").select(
        "fp", F.coalesce("least", "first").alias("least")), "simhash-groups")
    # a fingerprint may have any share of the rows
    return lookup(rows, found, "fp", is_stored=True).select(
            "doc_id", "text_hash", "fp",
            F.when(F.col("least.i") < 2**63 - 1, F.col("least.i")).alias("component_id"),
            F.col("least.h").alias("first_hash"))


def _print_groups(rows: DataFrame, within: int = 2) -> DataFrame:
    """(fp, size, band) of the sets among stored sketches; a band is a SimHash group."""
    sets = rows.select("fp", "size", "print").distinct()
    distinct = sets.select(F.col("print").alias("fp")).distinct()
    distinct = distinct.repartition(parts_for(rows.select("print"), PRINT_BYTES), "fp")
    groups = sets.join(components(links(distinct, within)), F.col("print") == F.col("node"), "left")
    return groups.select("fp", "size", F.xxhash64(F.lit("simhash"), F.coalesce("root", "print")).alias("band"))


def _close_prints(rows: DataFrame) -> DataFrame:
    """The groups of the sets with words, to be compared."""
    return _print_groups(rows.where("size > 0"))


def _print_links(rows: DataFrame, within: int) -> DataFrame:
    """Links (a, b) from the least set of each SimHash group to its others."""
    placed = stored(_print_groups(rows, within).select("fp", "band").distinct(), "print-groups")
    least = placed.groupBy("band").agg(F.min("fp").alias("least"))
    # a group may have any share of the sets
    return lookup(placed, least, "band", is_stored=True).where("fp <> least").select(
        F.col("least").alias("a"), F.col("fp").alias("b"))


def keep_one(docs: DataFrame, words_each: int = 5, similarity: float = 0.8, within: int | None = None) -> DataFrame:
    """One row of each group, that of the smallest doc_id, with all its columns.

    Groups are linked by a similarity (Jaccard) of at least `similarity` between the sets of
    shingles of `words_each` words. Texts that agree on a MinHash band are compared by their
    whole sets, since close fingerprints miss most copies with a few changed words. With
    `within`, whatever op7 links is linked too: texts whose fingerprints of 3 words differ in
    at most so many bits, which the sets may miss where many changes lie in few places; a group
    is then what links of both kinds join. Without it the groups of op7 (2 bits) are only
    compared like a band, and the sets decide. Texts without words are one group.

    Rows equal in doc_id and text are one document and leave one row; which of their other
    columns stays is the choice of the aggregation.
    """
    rows = stored(minhash.sketches(docs, words_each, similarity, fingerprint), "sketches")
    if within is None:
        edges = minhash.links(docs, rows, words_each, similarity, proposed=_close_prints(rows))
    else:
        edges = minhash.links(docs, rows, words_each, similarity).unionAll(_print_links(rows, within))
    found = _grouped(rows.select("doc_id", "text_hash", "fp"), edges)
    wanted = found.where(
        F.coalesce("doc_id", F.lit(2**63 - 1)).eqNullSafe(F.coalesce("component_id", F.lit(2**63 - 1)))
        & (F.col("text_hash") == F.col("first_hash"))
    ).select(F.col("doc_id").alias("_keep_id"), F.col("text_hash").alias("_keep_hash")).distinct()
    marked = docs.withColumn("_keep_text", F.xxhash64(F.coalesce("text", F.lit(""))))
    kept = marked.join(wanted, F.col("doc_id").cast("long").eqNullSafe(F.col("_keep_id"))
                       & (F.col("_keep_text") == F.col("_keep_hash")), "left_semi")
    return kept.dropDuplicates(["doc_id", "_keep_text"]).drop("_keep_text")
