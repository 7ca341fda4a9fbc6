"""Best-fit packing of token pieces into sequences, by hierarchical residual merging.

Texts are tokenized whole, an end id follows each, and only longer ones are cut. Pieces as
long as a sequence are sequences at once. The others are dealt into groups of about
`group_items` pieces; each group packs best-fit decreasing and sends out its nearly full
bins. An underfull bin goes on to the next round as one item that carries its members (no
more than the sequence has tokens), and rounds of ever fewer groups pack such items until
one group is left or a round has merged nothing, so no task ever holds more than about one
group, whatever the input. Best fit leaves no two bins of a group that would fit together.

Nulls: a null text is empty and packs as its end id alone. Rows without doc_id are packed
with a null id; repeated rows are packed once each; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from passagemill.llm.common import CHUNK_BYTES, chunks, column, id_and_text
from passagemill.llm.tokens import default_tokenizer, encoder
from passagemill.session import stored


MOST_ROUNDS = 100  # what the sequence ids have room for; each round merges items at random partners


def pieces(docs: DataFrame, max_tokens: int = 2048, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece of every text."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in chunks(batches, limit=CHUNK_BYTES // 2):
            ids, counts = encode(column(batch, "text"))
            ends = np.cumsum(counts)
            ids = np.insert(ids, ends, end_id).astype("<u4")  # one end id behind each text
            sizes = counts + 1
            cut = -(-sizes // max_tokens)
            doc = np.repeat(np.arange(len(sizes)), cut)
            number = np.arange(len(doc)) - np.repeat(np.cumsum(cut) - cut, cut)
            start = number * max_tokens
            length = np.minimum(sizes[doc] - start, max_tokens)
            begin = (np.cumsum(sizes) - sizes)[doc] + start
            raw = memoryview(ids).cast("B")
            crc = [zlib.crc32(raw[4 * a:4 * (a + n)]) for a, n in zip(begin.tolist(), length.tolist())]
            yield pa.RecordBatch.from_arrays([
                column(batch, "doc_id").take(pa.array(doc)), pa.array(number.astype(np.int32)),
                pa.array(start), pa.array(length), pa.array(crc, pa.int64()),
            ], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return id_and_text(docs).mapInArrow(
        run, "doc_id LONG, piece INT, start LONG, length LONG, ids_crc32 LONG")


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: the items of each bin, by their index."""
    bins: list[list[int]] = []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by what is left in them
    rooms: list[int] = []  # sorted values of room that have a bin
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = bisect_left(rooms, sizes[i])
        if at == len(rooms):
            b, left = len(bins), capacity
            bins.append([])
        else:
            left = rooms[at]
            b = room[left].pop()
            if not room[left]:
                rooms.pop(at)
        bins[b].append(i)
        left -= sizes[i]
        if not room[left]:
            insort(rooms, left)
        room[left].append(b)
    return bins


def _merge_round(items: DataFrame, groups: int, number: int, capacity: int, fill: int) -> DataFrame:
    """Pack (members, size) items within each of `groups` groups.

    Bins of at least `fill` tokens get a sequence id; in a last round (`fill` 0) all do.
    """
    members = items.schema["members"].dataType

    def pack(table: pa.Table) -> pa.Table:
        # the order of rows in a group depends on the shuffle: sort for equal results on retry
        order = sorted(range(table.num_rows), key=list(zip(
            table["size"].to_pylist(), table["tie"].to_pylist())).__getitem__)
        group = table["grp"][0].as_py()
        lists = table["members"].combine_chunks()
        sizes = [table["size"][i].as_py() for i in order]
        bins = best_fit(sizes, capacity)
        flat = pa.array([order[i] for b in bins for i in b], pa.int64())
        taken = lists.take(flat)
        per_item = taken.value_lengths().to_numpy(zero_copy_only=False)
        item_ends = np.cumsum([len(b) for b in bins])
        offsets = np.concatenate([[0], np.cumsum(per_item)[item_ends - 1]]).astype(np.int32)
        totals = np.array([sum(sizes[i] for i in b) for b in bins], np.int64)
        ids = (np.int64(number) << 56) | (np.int64(group) << 24) | np.arange(len(bins))
        return pa.table({
            "members": pa.ListArray.from_arrays(pa.array(offsets), taken.flatten()),
            "size": totals,
            "sequence_id": pa.array(ids, mask=totals < fill),
        })

    # dealt by row, so that equal members do not meet; `items` is stored, so a retry numbers alike
    row = F.monotonically_increasing_id()
    dealt = items.select("members", "size", F.xxhash64("members").alias("tie"), F.pmod(
        F.xxhash64(row, F.lit(number)), F.lit(groups)).alias("grp"))
    return dealt.groupBy("grp").applyInArrow(
        pack, f"members {members.simpleString()}, size LONG, sequence_id LONG")


def pack(found: DataFrame, max_tokens: int = 2048, group_items: int = 4096, nearly: float = 0.999) -> DataFrame:
    """Adds sequence_id and offset to pieces of at most `max_tokens` tokens, a stored table."""
    member = F.struct("doc_id", "piece", "start", "length", "ids_crc32")
    done = [found.where(F.col("length") == max_tokens).select(
        F.array(member).alias("members"), F.monotonically_increasing_id().alias("sequence_id"))]
    items = found.where(F.col("length") < max_tokens).select(
        F.array(member).alias("members"), F.col("length").alias("size"))
    left = found.where(F.col("length") < max_tokens).count()
    number = 1
    while left:
        groups = -(-left // group_items)
        packed = stored(_merge_round(
            items, groups, number, max_tokens, 0 if groups == 1 else int(max_tokens * nearly)), "packing")
        done.append(packed.where("sequence_id IS NOT NULL").select("members", "sequence_id"))
        items = packed.where("sequence_id IS NULL").select("members", "size")
        before, left = left, 0 if groups == 1 else items.count()
        # a round that merged nothing: no two items of any group fit together
        if left == before or number == MOST_ROUNDS:
            done.append(items.select("members", (F.monotonically_increasing_id()
                        + F.lit((number + 1) << 56)).alias("sequence_id")))
            left = 0
        number += 1
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionAll(part)
    schema = f"{found.schema.simpleString()[7:-1]},sequence_id:bigint,offset:bigint"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = column(batch, "members")
            parts = lists.flatten()
            lengths = parts.field("length").to_numpy()
            per_bin = lists.value_lengths().to_numpy(zero_copy_only=False)
            before = np.cumsum(lengths) - lengths
            first = np.repeat(before[np.cumsum(per_bin) - per_bin], per_bin)
            yield pa.RecordBatch.from_arrays([
                *parts.flatten(), column(batch, "sequence_id").take(pa.array(np.repeat(np.arange(len(lists)), per_bin))),
                pa.array(before - first)], [*(f.name for f in parts.type), "sequence_id", "offset"])

    return whole.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, max_tokens: int = 2048, tokenizer: str | None = None,
                   end_id: int = 0, group_items: int = 4096) -> DataFrame:
    """Tokenize, cut and pack whole documents; one row per piece."""
    return pack(stored(pieces(docs, max_tokens, tokenizer, end_id), "pieces"), max_tokens, group_items)
