"""Join helpers that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from passagemill.session import stored

HOT_ROWS = 1_000_000


def first_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the smallest `order` for each key, by map-side combined aggregation."""
    return _pick(df, key, order, F.min_by)


def last_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the largest `order` for each key."""
    return _pick(df, key, order, F.max_by)


def _pick(df: DataFrame, key: str, order: str, pick) -> DataFrame:
    rest = [c for c in df.columns if c != key]
    chosen = pick(F.struct(*rest), F.col(order)).alias("_row")
    return df.groupBy(key).agg(chosen).select(key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def lookup(
    hits: DataFrame, table: DataFrame, key: str, hot_rows: int = HOT_ROWS,
    is_stored: bool = False,
) -> DataFrame:
    """Left equi-join of `hits` with a table that has unique keys.

    The adaptive skew rule does not help here: it looks at input bytes, while each narrow
    hit may copy a wide row. So `hits` is written once (`is_stored` says it is a scan of a
    stored table already), keys with more than `hot_rows` hits are counted from its key
    column, and only their rows take a salted join with repeated table rows. All others
    take a plain join, which leaves a table bucketed by the key where it is. Without hot
    keys the salted branch is empty, and the adaptive planner drops it before it reads the
    table again. Rows without a key are spread like those of a hot one.

    The list of hot keys has at most |hits| / hot_rows pairs of numbers; it is a stored
    table, so the session's size threshold decides whether it is broadcast.
    """
    if hits.schema[key].dataType != table.schema[key].dataType:
        raise ValueError(f"{key} has different types in the two tables")
    if not is_stored:
        hits = stored(hits, "hits")
    digest = F.xxhash64(key).alias("_digest")
    hot = stored(
        hits.groupBy(digest).agg(F.count("*").alias("_n")).where(F.col("_n") > hot_rows)
        .select("_digest", F.ceil(F.col("_n") / hot_rows).cast("int").alias("_salts")),
        "hot-keys")
    # The row number of a stored table is the same on every retry, also for equal rows.
    numbered = hits.select("*", digest, F.monotonically_increasing_id().alias("_number"))
    salted_hits = numbered.join(hot, "_digest").withColumn(
        "_salt", F.pmod(F.xxhash64("_number"), F.col("_salts")).cast("int"),
    ).drop("_digest", "_number", "_salts")
    salted_table = table.select("*", digest).join(hot, "_digest").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_digest", "_salts")
    ordinary = hits.select("*", digest).join(hot, "_digest", "left_anti").drop("_digest")
    return ordinary.join(table, key, "left").unionByName(
        salted_hits.join(salted_table, [key, "_salt"], "left").drop("_salt"))


def semi_lookup(
    hits: DataFrame, keys: DataFrame, key: str, hot_rows: int = HOT_ROWS,
    is_stored: bool = False,
) -> DataFrame:
    """Rows of `hits` whose key is among the unique `keys`."""
    known = keys.select(key, F.lit(True).alias("_known"))
    return lookup(hits, known, key, hot_rows, is_stored).where("_known").drop("_known")
