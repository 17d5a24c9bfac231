"""Batches for training: drawn from a mixture of sources, in sequence, or in shuffled epochs. All draws are hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.operators.finetune import uniform
from corpusmill.operators.prefix import hash_rank

CHUNK = 65_536  # sequences of a chunk: 64 MB at 512 ids


def weights(sources: DataFrame) -> DataFrame:
    """``source, n, low, high``: each present source's stretch of the unit interval, from ``target_proportion``."""
    share = F.expr("target_proportion / sum(target_proportion) OVER ()")
    # One row for each source.
    high = F.sum("share").over(Window.orderBy("source").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return sources.where("n > 0").withColumn("share", share).withColumn("high", high).select("source", "n", (F.col("high") - F.col("share")).alias("low"), "high")


def _picked(spark: SparkSession, sources: DataFrame, batches: int, seed: int) -> DataFrame:
    """``batch_id, source, n``: the source of each batch, by weight."""
    drawn = spark.range(batches).select(F.col("id").alias("batch_id"), uniform(F.lit(f"{seed}"), F.lit("source"), F.col("id").cast("string")).alias("u"))
    last = F.max("high").over(Window.partitionBy())
    stretches = weights(sources).withColumn("last", F.col("high") == last)
    # The registry is a handful of rows, whatever the corpus' size.
    return drawn.join(F.broadcast(stretches), (F.col("u") >= F.col("low")) & ((F.col("u") < F.col("high")) | F.col("last"))).select("batch_id", "source", "n")


def mixture_rows(spark: SparkSession, sources: DataFrame, batches: int, size: int, seed: int = 42) -> DataFrame:
    """``batch_id, slot, source, row_idx``: a source by weight for each batch, then rows of it with replacement.

    ``sources`` has ``source, n, target_proportion``, with rows numbered from 0 to ``n - 1``.
    """
    slots = _picked(spark, sources, batches, seed).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    u = uniform(F.lit(f"{seed}"), F.lit("row"), F.col("batch_id").cast("string"), F.col("slot").cast("string"))
    return slots.select("batch_id", "slot", "source", F.floor(u * F.col("n")).cast("long").alias("row_idx"))


def chunked(packed: DataFrame, rows: int = CHUNK) -> DataFrame:
    """``packed`` with ``chunk``, for a layout that is partitioned by ``source, chunk``: ``rows`` following ``seq_id`` each.

    Rows are dealt by ranges, so a chunk is a file or two, and a source has as many chunks as it needs.
    """
    placed = packed.withColumn("chunk", F.expr(f"seq_id div {rows}"))
    return placed.repartitionByRange("source", "chunk").sortWithinPartitions("source", "chunk", "seq_id")


def gather(drawn: DataFrame, packed: DataFrame, rows: int = CHUNK) -> DataFrame:
    """Drawn rows with their tokens, as ints.

    From a layout of ``chunked`` with the same ``rows`` only the chunks that were drawn from are read: the draws, whose number
    the caller chose and which are no larger for a larger corpus, are broadcast and prune its partitions.
    """
    taken = packed.withColumn("row_idx", F.col("seq_id")).withColumn("tokens", F.col("tokens").cast("array<int>")).drop("seq_id")
    if "chunk" not in packed.columns:
        return drawn.join(taken.select("source", "row_idx", "tokens"), ["source", "row_idx"])
    asked = drawn.where("row_idx >= 0").withColumn("chunk", F.expr(f"row_idx div {rows}"))
    return F.broadcast(asked).join(taken.select("source", "chunk", "row_idx", "tokens"), ["source", "chunk", "row_idx"]).drop("chunk")


def validation_slices(spark: SparkSession, sources: DataFrame, batches: int, size: int, seed: int = 42) -> DataFrame:
    """``batch_id, source, start, stop``: a contiguous slice of a source drawn by weight; a short source whole."""
    u = uniform(F.lit(f"{seed}"), F.lit("start"), F.col("batch_id").cast("string"))
    start = F.when(F.col("n") <= size, F.lit(0)).otherwise(F.floor(u * (F.col("n") - size))).cast("long")
    return _picked(spark, sources, batches, seed).withColumn("start", start).select("batch_id", "source", "start", F.least(F.col("start") + size, F.col("n")).alias("stop"))


def slice_rows(slices: DataFrame) -> DataFrame:
    """The single rows of slices, so that they join by equality."""
    return slices.select("batch_id", "source", F.explode(F.sequence(F.col("start"), F.col("stop") - 1)).alias("row_idx"))


def epoch_batches(rows: DataFrame, by: list[str], row: str, size: int) -> DataFrame:
    """Adds ``batch``: full batches in order of each group; an unfinished last one is dropped. Rows count from 0."""
    counts = rows.groupBy(*by).agg(F.expr(f"count(*) div {size}").alias("_full"))
    return rows.withColumn("batch", F.expr(f"`{row}` div {size}")).join(counts, by).where(F.col("batch") < F.col("_full")).drop("_full")


def shuffled_epochs(rows: DataFrame, row: str, size: int, epochs: int, seed: int = 0) -> DataFrame:
    """Adds ``epoch, batch, slot``: every row once an epoch, each time in another order; unfinished batches are dropped."""
    spread = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("epoch").cast("string"), F.col(row).cast("string")), 256)
    ranked = hash_rank(spread.withColumn("_digest", digest), ["epoch"], "_digest", [row], "_place").drop("_digest")
    counts = rows.agg(F.expr(f"count(*) div {size}").alias("_full"))
    placed = ranked.withColumn("batch", F.expr(f"(_place - 1) div {size}")).withColumn("slot", (F.col("_place") - 1) % size)
    return placed.join(F.broadcast(counts), F.col("batch") < F.col("_full")).drop("_full", "_place")


def sample_rows(packed: DataFrame, by: list[str], row: str, n: int, seed: int) -> DataFrame:
    """``n`` draws with replacement from each group, whose rows are numbered from 0; a row can come out repeatedly."""
    sizes = packed.groupBy(*by).agg(F.count("*").alias("_n")).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    u = uniform(F.lit(f"{seed}"), *[F.col(c).cast("string") for c in by], F.col("draw").cast("string"))
    return sizes.select(*by, "draw", F.floor(u * F.col("_n")).cast("long").alias(row)).join(packed, [*by, row])
