"""Instruction-tuning examples: layout, loss mask, split, weighted replication, statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.constants import BOS, END_QUESTION, END_SCHEMA, END_SQL, EOS, FINETUNE_LENGTH, PAD, QUESTION, SCHEMA, SEED, SQL


def _ids(*ids: int) -> Column:
    return F.array(*[F.lit(i).cast("smallint") for i in ids])


def encode_examples(rows: DataFrame, length: int = FINETUNE_LENGTH) -> DataFrame:
    """Adds ``n``, ``tokens`` and ``mask`` to rows of token arrays ``schema_ids, question_ids, sql_ids``.

    Examples without SQL tokens are left out; those too long stay with null tokens, to be counted, and are never cut. The
    mask is 1 from the id that opens the SQL to the last but one: where the next token is part of the answer.
    """
    n = F.size("schema_ids") + F.size("question_ids") + F.size("sql_ids") + 8
    opens = F.size("schema_ids") + F.size("question_ids") + 5
    whole = F.concat(_ids(BOS, SCHEMA), "schema_ids", _ids(END_SCHEMA, QUESTION), "question_ids", _ids(END_QUESTION, SQL), "sql_ids", _ids(END_SQL, EOS))
    fits = F.col("n") <= length
    flag = lambda v, k: F.array_repeat(F.lit(v).cast("tinyint"), k.cast("int"))
    placed = rows.where(F.size("sql_ids") > 0).withColumn("n", n).withColumn("_opens", opens)
    tokens = F.concat(whole, F.array_repeat(F.lit(PAD).cast("smallint"), (F.lit(length) - F.col("n")).cast("int")))
    mask = F.concat(flag(0, F.col("_opens")), flag(1, F.col("n") - 1 - F.col("_opens")), flag(0, F.lit(length) - F.col("n") + 1))
    return placed.withColumn("tokens", F.when(fits, tokens)).withColumn("mask", F.when(fits, mask)).drop("_opens")


def uniform(*parts: Column) -> Column:
    """A number from 0 to 1 that depends on the parts only: 13 hexadecimal digits of their SHA-256."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 13), 16, 10).cast("double") / float(16**13)


def split_and_copy(kept: DataFrame, row: Column, source: Column, weight: Column, seed: int = SEED, val: float = 0.01) -> DataFrame:
    """Adds ``split`` and ``copy_no``; a row is repeated by the whole part of its weight, and once more by chance.

    Both draws are hashes of seed, source and row key. Rows may come out zero times. Validation rows are repeated too.
    """
    draw = lambda what: uniform(F.lit(f"{seed}"), F.lit(what), source, row)
    copies = (F.floor(weight) + (draw("copy") < weight - F.floor(weight)).cast("int")).cast("int")
    drawn = kept.withColumn("split", F.when(draw("val") < val, "val").otherwise("train")).withColumn("_copies", copies)
    return drawn.where("_copies > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("_copies")))).drop("_copies")


def numpy_draws(rows: DataFrame, nth: str, seed: int = SEED) -> DataFrame:
    """Adds ``val_draw, copy_draw``: NumPy's own stream for the seed, two numbers for each kept row of a source.

    ``nth`` numbers the kept rows of each source from 0; a null has no draws. A row's two numbers stand at twice its own in the
    stream, where the generator jumps in a few steps: so rows may lie anywhere, none is moved, and only ``nth`` goes to Python.
    """

    @F.arrow_udf("struct<val_draw: double, copy_draw: double>")
    def draw(numbers: pa.Array) -> pa.Array:
        given = numbers.fill_null(0).to_numpy(zero_copy_only=False)
        order = np.argsort(given, kind="stable")
        at, back = np.unique(given[order], return_inverse=True)
        out = np.empty((len(at), 2))
        starts = np.flatnonzero(np.concatenate(([True], np.diff(at) != 1))) if len(at) else []
        for i, j in zip(starts, [*starts[1:], len(at)], strict=True):
            bits = np.random.PCG64(seed)
            bits.advance(2 * int(at[i]))
            out[i:j] = np.random.Generator(bits).random((j - i, 2))
        found = np.empty((len(given), 2))
        found[order] = out[back]
        return pa.StructArray.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["val_draw", "copy_draw"], mask=numbers.is_null())

    drawn = rows.withColumn("_draws", draw.asNondeterministic()(F.col(nth).cast("long")))
    return drawn.withColumn("val_draw", F.col("_draws.val_draw")).withColumn("copy_draw", F.col("_draws.copy_draw")).drop("_draws")


def shuffled_train(rows: DataFrame, keys: list[str], seed: int = 0) -> DataFrame:
    """Adds ``digest``: sorted by it, train rows stand in a seeded random order; validation rows keep theirs (null)."""
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]), 256)
    return rows.withColumn("digest", F.when(F.col("split") == "train", digest))


def kept_and_skipped(encoded: DataFrame) -> DataFrame:
    return encoded.groupBy("source").agg(F.count("tokens").alias("kept"), F.sum(F.col("tokens").isNull().cast("long")).alias("skipped"))


def mask_density(examples: DataFrame) -> DataFrame:
    """``split, density``: the mean of all mask entries."""
    ones = F.aggregate("mask", F.lit(0).cast("long"), lambda a, x: a + x)
    return examples.where("mask IS NOT NULL").groupBy("split").agg((F.sum(ones) / F.sum(F.size("mask"))).alias("density"))


def capped(rows: DataFrame, order: str, cap: int | None) -> DataFrame:
    """At most ``cap`` rows, by order: for trials."""
    return rows if cap is None else rows.orderBy(order).limit(cap)
