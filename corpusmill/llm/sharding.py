"""Sharding by extendible hashing: a directory over hash prefixes in which only oversized buckets split.

Keys are hashed to 60 bits. A bucket is a prefix of these; while its bytes exceed the limit it splits on one more bit,
and other buckets stay whole. Sums of bytes over prefixes decide all splits at once: a row's bucket is the shortest
prefix of its hash that fits. The sums come from a histogram over prefixes somewhat longer than an even spread would
need; only rows in cells that are still too large are counted again on more bits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import Table, parallel, unused, written

BITS = 60
MARGIN = 6  # bits beyond those that an even spread needs, and that each further round adds


def key_hash(key: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def assign_shards(docs: DataFrame, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, bytes, shard, depth, shard_bytes, fits`` for every row; ``shard`` names the bits of the bucket's prefix.

    Bytes are those of the UTF-8 text, none for null. A null key hashes as an empty one. Rows of one key always share a
    shard: a bucket whose rows all have one hash can't split further and, if it is too large (one huge document, or a
    key with too many rows), is marked as not fitting. The limit is one byte at least. An empty table gives no rows. Other
    columns are not read.
    """
    if limit < 1:
        raise ValueError("a shard holds one byte at least")
    slim = parallel(docs.select(F.col(key).alias("key"), F.col(text).alias("text")))
    sized = written(slim.select("key", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"), key_hash(F.col("key")).alias("h")))
    total = sized.agg(F.sum("bytes")).first()[0] or 0
    depth, start, now, placed = min(BITS, max(1, math.ceil(math.log2(max(1, total / limit)))) + MARGIN), 0, sized, []
    while True:
        cell = F.shiftright("h", BITS - depth)
        cells = Table(now.groupBy(cell.alias("cell")).agg(F.sum("bytes").alias("bytes"), F.min("h").alias("low"), F.max("h").alias("high")))
        # Each cell counts in each of its prefixes that are open yet.
        opened = cells.df.select("*", F.explode(F.sequence(F.lit(start), F.lit(depth))).alias("depth"))
        prefix = F.expr(f"shiftright(cell, {depth} - depth)")
        sums = opened.groupBy("depth", prefix.alias("prefix")).agg(F.sum("bytes").alias("shard_bytes"), F.min("low").alias("low"), F.max("high").alias("high"))
        final = sums.where((F.col("shard_bytes") <= limit) | (F.col("low") == F.col("high")) | (F.col("depth") == BITS)).drop("low", "high")
        best = opened.select("cell", "depth", prefix.alias("prefix")).join(final, ["depth", "prefix"]).groupBy("cell").agg(F.min(F.struct("depth", "prefix", "shard_bytes")).alias("b"))
        directory = written(best.select("cell", "b.*"))
        hashed = now.withColumn("cell", cell)
        placed.append(hashed.join(directory, "cell").drop("cell"))
        if directory.count() == cells.df.count():
            break
        now = written(hashed.join(directory, "cell", "left_anti").drop("cell"))
        cells.drop()
        start, depth = depth + 1, min(BITS, depth + MARGIN)
    every = placed[0]
    for more in placed[1:]:
        every = every.unionByName(more)
    bits = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.expr("lpad(bin(prefix), depth, '0')"))
    return every.select(F.col("key").alias(key), "bytes", F.concat(F.lit("b"), bits).alias("shard"), F.col("depth").cast("long").alias("depth"), "shard_bytes", (F.col("shard_bytes") <= limit).alias("fits"))


def write_shards(docs: DataFrame, path: str, limit: int, key: str = "doc_id", text: str = "text") -> None:
    """``docs`` as one folder ``shard=b...`` of Parquet for each shard.

    A shard that fits is written by one task, as one file. One that doesn't (one key) is dealt to as many tasks as it
    holds limits, by all columns and a random number. Null keys and null or empty texts are written like any others;
    other columns, of any name but ``shard``, pass through, and a column of that name is replaced. An empty table writes
    an empty folder.
    """
    key_, parts, salt = unused(docs, "shard_key", "shard_parts", "shard_salt")
    slices = F.ceil(F.col("shard_bytes") / limit).cast("int")
    shards = written(assign_shards(docs.select(key, text), limit, key, text).select(F.col(key).alias(key_), "shard", F.greatest(slices, F.lit(1)).alias(parts)).distinct())
    placed = docs.drop("shard").join(shards.hint("merge"), F.col(key).eqNullSafe(F.col(key_))).withColumn(salt, F.floor(F.rand() * F.col(parts)))
    # The salt only spreads files: a task that is run again writes its rows anew, whatever their salts were.
    dealt = written(placed.drop(key_, parts))
    dealt.repartition("shard", salt).drop(salt).sortWithinPartitions("shard").write.partitionBy("shard").parquet(path)


LIMIT = 1 << 20


def op2(spark, sf_dir: str) -> DataFrame:
    return assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), LIMIT)


ORACLE = f"""
    WITH d AS (
        SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS bytes, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents
    ), p AS (SELECT *, unnest(range(0, 61)) AS depth FROM d),
    s AS (SELECT depth, h >> CAST(60 - depth AS INTEGER) AS prefix, CAST(sum(bytes) AS BIGINT) AS shard_bytes, min(h) AS low, max(h) AS high FROM p GROUP BY ALL),
    f AS (
        SELECT p.doc_id, p.bytes, p.h, s.depth, s.shard_bytes, s.prefix
        FROM p JOIN s ON s.depth = p.depth AND s.prefix = p.h >> CAST(60 - p.depth AS INTEGER)
        WHERE s.shard_bytes <= {LIMIT} OR s.low = s.high OR s.depth = 60
        QUALIFY row_number() OVER (PARTITION BY p.doc_id ORDER BY s.depth) = 1
    )
    SELECT doc_id, bytes, 'b' || CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), CAST(depth AS INTEGER), '0') END AS shard, CAST(depth AS BIGINT) AS depth, shard_bytes, shard_bytes <= {LIMIT} AS fits
    FROM f
"""
