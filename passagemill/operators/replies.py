"""Model replies that are kept: each distinct prompt is asked once, whatever asks it again."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from passagemill.operators.generate import Model, replies
from passagemill.session import input_bytes, setting, stored

_COLUMNS = "digest STRING, prompt STRING, reply STRING, same INT"
TASK_ROWS = 4096  # prompts that a task asks, where they are dealt out
IN_PLACE_BYTES = 8 << 20  # of 64-bit numbers that every task may hold to ask the others where they are
AT_ONCE_BYTES = 256 << 20  # of stored keys that are held while the replies are read once
BATCH_BYTES = 16 << 20  # of prompts on the way to the model
_OPTIONS = "compression 'zstd', 'parquet.block.size' '8388608'"  # a task has a file open for each bucket


class ReplyStore:
    """A table of prompts and replies, bucketed by a digest of the prompt.

    The folder is what lasts: a later session that opens it, under any table name, finds all
    replies that were stored. Lookups shuffle the asking side alone, and a reply counts only
    for a prompt with the SHA-256 of its own, so equal digests do no harm. `buckets` belongs to
    the folder and must stay the same. Every task of a run adds a file to each bucket that it
    has prompts for. Many generators repeat the prompt before their text: of such a reply the
    table has what follows, and in `same` the length of the prompt; `known` gives it whole.
    """

    def __init__(
        self, spark: SparkSession, path: str, table: str, buckets: int = 64,
        digest: Callable[[Column], Column] = F.md5,
    ) -> None:
        self.spark, self.table, self.buckets, self._digest = spark, table, buckets, digest
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table} ({_COLUMNS}) USING parquet OPTIONS ({_OPTIONS}) "
            f"CLUSTERED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'")
        if "same" not in spark.table(table).columns:  # a table of before; its replies are whole
            spark.sql(f"ALTER TABLE {table} ADD COLUMNS (same INT)")

    def known(self) -> DataFrame:
        """digest, prompt and the whole reply."""
        opening = F.col("prompt").substr(F.lit(1), F.coalesce("same", F.lit(0)))
        return self.spark.table(self.table).select("digest", "prompt", F.concat(opening, "reply").alias("reply"))

    @staticmethod
    def _sum(prompt: str) -> Column:
        """What tells prompts with equal digests apart, and travels in their place."""
        return F.sha2(F.col(prompt), 256)

    @staticmethod
    def _same(one: str, other: str) -> Column:
        """Equal sums. Written so that the digest stays the only join key: with the sum as a
        second one Spark would shuffle the bucketed table by both."""
        return F.startswith(F.col(one), F.col(other)) & F.startswith(F.col(other), F.col(one))

    def _keyed(self, prompts: DataFrame, prompt: str) -> DataFrame:
        asked = prompts.select(F.col(prompt).alias("prompt")).where(F.trim("prompt") != "")
        return asked.select(self._digest(F.col("prompt")).alias("digest"), self._sum("prompt").alias("sum"), "prompt")

    def _distinct_keys(self, prompts: DataFrame, prompt: str) -> DataFrame:
        """digest and sum of the distinct prompts, how many rows ask each, and the hash of the
        text: a number for slices, and for telling rows apart where they lie."""
        return self._keyed(prompts, prompt).select(
            "digest", "sum", F.xxhash64("prompt").alias("number")).groupBy("digest", "sum").agg(
            F.min("number").alias("number"), F.count("*").alias("asking"))

    def _unknown(self, keys: DataFrame) -> DataFrame:
        kept = self.known().select(F.col("digest").alias("_digest"), self._sum("prompt").alias("_sum"))
        return keys.join(kept, (F.col("digest") == F.col("_digest")) & self._same("sum", "_sum"), "left_anti")

    def _texts(self, prompts: DataFrame, prompt: str, keys: DataFrame, parts: int) -> DataFrame:
        """digest and prompt of the keys, each once, dealt by digest."""
        wanted = keys.select(F.col("digest").alias("_digest"), F.col("sum").alias("_sum")).repartition(parts, "_digest")
        dealt = self._keyed(prompts, prompt).repartition(parts, "digest")
        found = dealt.join(wanted, (F.col("digest") == F.col("_digest")) & self._same("sum", "_sum"), "left_semi")
        return found.dropDuplicates(["digest", "sum"]).select("digest", "prompt")

    def missing(self, prompts: DataFrame, prompt: str = "prompt") -> DataFrame:
        """digest and prompt of the distinct prompts without a reply; blank ones need none."""
        return self._texts(prompts, prompt, self._unknown(self._distinct_keys(prompts, prompt)), self.buckets)

    def ask(
        self, prompts: DataFrame, model: Model, prompt: str = "prompt", slice_rows: int = 1_000_000,
        **batching,
    ) -> int:
        """Get and keep the replies that are missing; returns how many were asked.

        What is missing is found by digests alone. The prompts are asked in slices of about
        `slice_rows`, each kept as it is finished, so a run that is killed repeats no slice but
        the open one. `prompts` is read once for the digests and up to twice for each slice, so
        let it be a stored table.

        A prompt that one row asks and the store lacks is asked where the row lies, and no text
        moves: each task that reads `prompts` puts its replies into the buckets. Only prompts
        that several rows ask, or some of which are known, are dealt out by digest first, to
        tasks of some TASK_ROWS with prompts of one bucket each; so are all where the others
        are too many to tell apart in place, or `prompts` is read by fewer tasks than there are
        cores. A task that has ended is kept, and a lost executor asks nothing of it again.
        """
        asked_keys = stored(self._distinct_keys(prompts, prompt), "asked-keys")
        keys = stored(self._unknown(asked_keys), "asked")
        n = keys.count()
        if not n:
            return 0
        slices = -(-n // slice_rows)
        elsewhere = stored(asked_keys.join(
            keys.where("asking = 1").select("digest", "sum"), ["digest", "sum"], "left_anti",
        ).select("number").distinct(), "asked-elsewhere")
        cores = self.spark.sparkContext.defaultParallelism
        in_place = input_bytes(elsewhere) <= IN_PLACE_BYTES and prompts.rdd.getNumPartitions() >= min(n, cores)
        elsewhere = F.broadcast(elsewhere)
        dealt = stored(keys.join(elsewhere, "number", "left_semi"), "asked-dealt") if in_place else keys
        to_deal = dealt.count()
        each = min(to_deal, slice_rows)
        tasks = max(-(-each // TASK_ROWS), min(each, cores))
        parts = self.buckets * max(1, -(-tasks // self.buckets))  # a multiple: no part has two buckets
        for i in range(slices):
            def mine(number: Column) -> Column:
                return F.pmod(number, F.lit(slices)) == i

            asked = prompts.where(mine(F.xxhash64(prompt))) if slices > 1 else prompts
            if in_place:
                numbered = asked.select(F.col(prompt).alias("prompt"), F.xxhash64(prompt).alias("number"))
                alone = numbered.join(elsewhere, "number", "left_anti")
                self._keep(self._keyed(alone, "prompt").select("digest", "prompt"), model, **batching)
                asked = numbered.join(elsewhere, "number", "left_semi").select(F.col("prompt").alias(prompt))
            if to_deal:
                self._keep(self._texts(asked, prompt, dealt.where(mine(F.col("number"))), parts), model, **batching)
        return n

    def _keep(self, asked: DataFrame, model: Model, **batching) -> None:
        """Ask the prompts and add the replies to the table, in the order in which they come:
        neighbours have documents in common, which the files then hold once for many."""
        replied = replies(asked, model, "prompt", "_reply", keep_prompt=True, **batching)
        echoed, after = F.startswith(F.col("_reply"), F.col("prompt")), F.length("prompt") + 1
        kept = replied.select(
            "digest", "prompt",
            F.when(echoed, F.col("_reply").substr(after, F.length("_reply"))).otherwise(F.col("_reply")).alias("reply"),
            F.when(echoed, F.length("prompt")).otherwise(0).alias("same"))
        # with a file open for each bucket a task need not sort its texts by bucket
        with setting(self.spark, "spark.sql.maxConcurrentOutputFileWriters", self.buckets), \
                setting(self.spark, "spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES):
            kept.write.insertInto(self.table)

    def attach(
        self, rows: DataFrame, prompt: str = "prompt", out: str = "generated_text", keys: list[str] | None = None,
    ) -> DataFrame:
        """The rows with their stored reply; a blank or null prompt has an empty one, an unasked one null.

        Where `keys` names all columns that are wanted beside the reply, they are held in memory
        and the replies pass by them, so that no reply is sorted; of more than AT_ONCE_BYTES a
        part at a time is held, and the replies are read again for each.
        """
        kept = self.known().select(
            F.col("digest").alias("_kept_digest"), self._sum("prompt").alias("_kept_sum"), F.col("reply").alias("_kept_reply"))
        # all that is needed of the prompt is taken before the join, which need not carry it
        keyed = rows.drop(out).withColumns({
            "_asked_digest": self._digest(F.col(prompt)), "_asked_sum": self._sum(prompt),
            "_blank": F.coalesce(F.trim(prompt), F.lit("")) == ""})
        same = (F.col("_asked_digest") == F.col("_kept_digest")) & self._same("_asked_sum", "_kept_sum")
        if keys is None:
            found = keyed.join(kept, same, "left")
        else:
            keyed = stored(keyed.select(*keys, "_asked_digest", "_asked_sum", "_blank"), "asking")
            turns = max(1, -(-input_bytes(keyed) // AT_ONCE_BYTES))
            # the row number of a stored table is the same on every retry
            turn = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(turns))
            found = reduce(DataFrame.unionAll, [
                (keyed.where(turn == i) if turns > 1 else keyed).hint("shuffle_hash").join(kept, same, "left")
                for i in range(turns)])
        return found.withColumn(out, F.when(F.col("_blank"), F.lit("")).otherwise(F.col("_kept_reply"))).drop(
            "_asked_digest", "_asked_sum", "_blank", "_kept_digest", "_kept_sum", "_kept_reply")
