"""Exact global row numbers without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BUCKET_BITS = 20


def global_rank(
    df: DataFrame, group: str, order: str, out: str, bits: int = BUCKET_BITS,
    tie: str | None = None, group_size: str | None = None,
    running: dict[str, Column] | None = None,
) -> DataFrame:
    """1-based rank of each row in its group by the BIGINT column `order`.

    Rows are cut into key ranges of 2^bits; a window numbers the rows inside one
    range, and a small running sum over the range counts supplies the offset. No
    window ever sees more than one range, however large a group is. `order` must be
    unique in a group unless `tie` breaks ties. `running` adds for each of its flags the
    number of rows of the group that have it, up to and with the row.
    """
    running = running or {}
    bucketed = df.withColumn("_bucket", F.shiftright(F.col(order), bits))
    counts = bucketed.groupBy(group, "_bucket").agg(
        F.count("*").alias("_rows"),
        *[F.count_if(flag).alias(f"_flag_{name}") for name, flag in running.items()])
    by_group = Window.partitionBy(group)
    before = by_group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        group, "_bucket",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
        F.sum("_rows").over(by_group).alias("_total"),
        *[F.coalesce(F.sum(f"_flag_{name}").over(before), F.lit(0)).alias(f"_flag_{name}")
          for name in running],
    )
    ordering: list[Column] = [F.col(order)] + ([F.col(tie)] if tie else [])
    inside = Window.partitionBy(group, "_bucket").orderBy(*ordering)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = (
        bucketed.withColumns({
            "_inside": F.row_number().over(inside),
            **{name: F.count_if(flag).over(upto) for name, flag in running.items()}})
        .join(offsets, [group, "_bucket"])
        .withColumns({
            out: F.col("_before") + F.col("_inside"),
            **{name: F.col(f"_flag_{name}") + F.col(name) for name in running}})
    )
    if group_size:
        ranked = ranked.withColumn(group_size, F.col("_total"))
    return ranked.drop(
        "_bucket", "_inside", "_before", "_total", *[f"_flag_{name}" for name in running])


CELLS = 1024  # cells a range of keys is cut into at each refinement


def kth_keys(
    df: DataFrame, group: str, order: str, wanted: dict[int, set[int]], tie: str | None = None,
) -> dict[tuple[int, int], tuple[int, int | None] | None]:
    """For (g, k) the key of the k-th smallest row of group g, without sorting.

    Every pass counts the rows of the ranges in question by cells of equal width; each k then
    lies in one cell, whose least and greatest key are the next range. A pass adds up to
    `CELLS` numbers for each range on the executors, reads the narrow columns alone, and
    divides a range by 1024, so a few passes do for any number of rows. None stands for a
    group with at most k rows, which counts whole. Keys are BIGINTs; rows equal in `order`
    are told apart by `tie`, which then must differ.
    """
    rows = df.select(group, order, *([tie] if tie else []))
    whole = {r[0]: (r.n, r.lo, r.hi) for r in rows.where(F.col(group).isin(list(wanted))).groupBy(group).agg(
        F.count("*").alias("n"), F.min(order).alias("lo"), F.max(order).alias("hi")).collect()}
    found: dict[tuple[int, int], tuple[int, int | None] | None] = {}
    open_ = {}  # (g, k) -> least key, greatest key, rank among the rows between
    for g, ks in wanted.items():
        n, lo, hi = whole.get(g, (0, 0, 0))
        for k in ks:
            if k >= n or k < 1:
                found[g, k] = None
            else:
                open_[g, k] = lo, hi, k
    while open_:
        ranges = sorted({(g, lo, hi) for (g, _), (lo, hi, _) in open_.items() if lo < hi})
        cells: dict[tuple, list] = {}
        if ranges:
            at, cell = F, F
            for i, (g, lo, hi) in enumerate(ranges):
                inside = (F.col(group) == g) & F.col(order).between(lo, hi)
                at = at.when(inside, i)
                # decimals, since the distance of two keys may pass 63 bits
                cell = cell.when(inside, F.floor((F.col(order).cast("decimal(20,0)") - lo) / -(-(hi - lo + 1) // CELLS)))
            counted = rows.select(at.alias("at"), cell.alias("cell"), order).where("at IS NOT NULL").groupBy("at", "cell")
            for r in counted.agg(F.count("*").alias("n"), F.min(order).alias("lo"), F.max(order).alias("hi")).collect():
                cells.setdefault(ranges[r["at"]], []).append((r["lo"], r["hi"], r["n"]))
        for (g, k), (lo, hi, rank) in list(open_.items()):
            for low, high, n in sorted(cells.get((g, lo, hi), [])):
                if rank <= n:
                    lo, hi = low, high
                    break
                rank -= n
            open_[g, k] = lo, hi, rank
            if lo == hi:
                del open_[g, k]
                found[g, k] = lo, None
                if tie:
                    same = rows.where((F.col(group) == g) & (F.col(order) == lo))
                    among = kth_keys(same, group, tie, {g: {rank}})[g, rank]
                    found[g, k] = lo, among[0] if among else None
    return found


def up_to(key: tuple[int, int | None] | None, order: str, tie: str | None = None) -> Column:
    """Rows whose key is at most a cut of `kth_keys`; all of them where the cut is None."""
    if key is None:
        return F.lit(True)
    first, second = key
    if tie is None or second is None:
        return F.col(order) <= first
    return (F.col(order) < first) | (F.col(order) == first) & (F.col(tie) <= second)
