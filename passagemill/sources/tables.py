"""Readers and sinks. Positions are stored columns, never recomputed from read order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from passagemill import fixed_values as fv, schemas
from passagemill.sources.json_array import read_json_array

RUN_KEYS = ("dataset", "model", "split", "prompt_type", "k")


# --- corpus -------------------------------------------------------------------
def import_corpus_array(
    spark: SparkSession, path: str, id_map: DataFrame | None = None
) -> DataFrame:
    """One-off import of one JSON array file; write the result as parquet and use that.

    The array is read in parallel splits, and an object's position in it is its index; with
    a non-empty map the position is a subset index.
    """
    rows = read_json_array(spark, path, schemas.CORPUS_JSON).select("position", "element.*")
    if id_map is None or id_map.isEmpty():
        return rows.select(F.col("position").alias("full_corpus_idx"), "title", "text")
    return subset_corpus(rows.withColumnRenamed("position", "subset_idx"), id_map)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CORPUS).parquet(path)


def store_corpus(corpus: DataFrame, table: str, buckets: int, path: str | None = None) -> DataFrame:
    """Keep the corpus as a table bucketed and sorted by id, so that lookups never shuffle it.

    Choose `buckets` so that one bucket fits into a task: corpus bytes / 256 MB or so.
    """
    writer = corpus.repartition(buckets, "full_corpus_idx").write.mode("errorifexists")
    if path is not None:
        writer = writer.option("path", path)
    writer.bucketBy(buckets, "full_corpus_idx").sortBy("full_corpus_idx").saveAsTable(table)
    return corpus.sparkSession.table(table)


def subset_corpus(subset: DataFrame, id_map: DataFrame) -> DataFrame:
    """Subset rows (subset_idx, title, text) under their index in the full corpus."""
    return subset.join(id_map, "subset_idx").select("full_corpus_idx", "title", "text")


# --- examples and search results -----------------------------------------------
def read_examples(raw: DataFrame) -> DataFrame:
    """Fix the shape of question rows; `raw` has example_pos and any known fields.

    The question text is `query`, else `question`, else an error.
    """
    def field(name: str, kind: str) -> Column:
        return (F.col(name) if name in raw.columns else F.lit(None)).cast(kind)

    text = F.coalesce(
        field("query", "string"), field("question", "string"),
        F.raise_error(F.lit("example without query or question")).cast("string"))
    answers = field("answers", "array<string>")
    return raw.select(
        "example_pos",
        F.coalesce(field("example_id", "string"), F.lit(fv.DEFAULT_EXAMPLE_ID)).alias("example_id"),
        text.alias("query"),
        F.coalesce(answers, F.array(F.lit(None).cast("string"))).alias("answers"),
        F.coalesce(field("idx_gold_in_corpus", "bigint"), F.lit(fv.NO_GOLD))
        .cast("bigint").alias("gold_document_idx"))


def read_search_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.SEARCH_RESULTS).parquet(path)


# --- runs -----------------------------------------------------------------------
def write_run(
    df: DataFrame, path: str, rows_per_file: int = 1_000_000, mode: str = "append", **keys,
) -> None:
    """Append a run under its key directories (dataset, model, split, prompt type, k)."""
    unknown = set(keys) - set(RUN_KEYS)
    if unknown:
        raise ValueError(f"unknown run keys {sorted(unknown)}")
    keyed = df.withColumns({name: F.lit(value) for name, value in keys.items()})
    (keyed.write.mode(mode).option("maxRecordsPerFile", rows_per_file)
     .partitionBy(*[k for k in RUN_KEYS if k in keys]).parquet(path))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def shard_number(name: Column, pattern: str, missing: int | None = 0) -> Column:
    """Number captured in a shard name; without one `missing`, where None sorts last."""
    found = F.regexp_extract(name, pattern, 1)
    last = F.lit((1 << 63) - 1 if missing is None else missing)
    return F.when(found == "", last).otherwise(found.cast("bigint")).cast("bigint")


def read_shards(
    spark: SparkSession, path: str, prefix: str = "", missing: int | None = 0,
    pattern: str = r"(\d+)\.parquet$",
) -> DataFrame:
    """All shards whose file name contains `prefix`, with their number as `shard`.

    Shards of `write_shards` bring their number as a column; other files have it in their
    name. Sort by (shard, position) only where the order matters.
    """
    rows = spark.read.option("pathGlobFilter", f"*{prefix}*.parquet").parquet(path)
    if "shard" in rows.columns:
        return rows.withColumn("shard", F.col("shard").cast("bigint"))
    return rows.withColumn(
        "shard", shard_number(F.col("_metadata.file_name"), pattern, missing))


def write_shards(df: DataFrame, path: str, save_every: int = 250, position: str = "example_pos") -> None:
    """Shards of `save_every` positions, numbered by the position after their last one.

    A shard lies whole in one file, and a file holds many, sorted, with their number in a
    column whose ranges let readers of one shard skip the rest: files follow the tasks, not
    the shards, however small those are. Hash partitioning needs no sample of the rows, so
    the input is evaluated once.
    """
    shard = (F.floor(F.col(position) / save_every) + 1) * save_every
    sharded = df.withColumn("shard", shard.cast("bigint")).repartition("shard")
    sharded.sortWithinPartitions("shard", position).write.mode("append").parquet(path)


def pending(examples: DataFrame, finished: DataFrame, key: str = "example_pos") -> DataFrame:
    """Examples without a finished row: resuming is safe however often it runs.

    Positions tell all examples apart; ids do so only where every example has one, as
    those without an id share the default id.
    """
    return examples.join(finished.select(key).distinct(), key, "left_anti")


def ordinal_slice(rows: DataFrame, start: int, stop: int) -> DataFrame:
    """Rows with start <= example_pos < stop."""
    return rows.where((F.col("example_pos") >= start) & (F.col("example_pos") < stop))


def sample_head(rows: DataFrame, n: int = 15) -> DataFrame:
    return rows.orderBy("example_pos").limit(n)


def write_json(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """JSON lines; an existing result is an error unless `overwrite`."""
    df.write.mode("overwrite" if overwrite else "errorifexists").json(path)


# --- training log ------------------------------------------------------------------
def read_training_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.TRAINING_LOG).json(path, multiLine=True)


def loss_curve(log: DataFrame) -> DataFrame:
    """(step, loss) of the log entries that have a loss, in step order."""
    entries = log.select(F.explode("log_history").alias("e")).select("e.step", "e.loss")
    return entries.where(F.col("loss").isNotNull()).orderBy("step")
