"""Running sums and ranks in two levels, so that no task holds all rows of one source.

The order's first column is cut at its quantiles, so buckets hold about as many rows however the keys are clustered. A bucket is
summed first; the sums, at most ``BUCKETS`` a group, are accumulated in one window, and each bucket then runs through its
own rows from there.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS = 20_000  # rows a bucket should have
BUCKETS = 4096  # at most; a larger table has larger ones


def bucket_starts(df: DataFrame, key: str, rows: int = ROWS) -> list[float]:
    """Where the buckets of a whole-number key begin but for the first, by a quantile sketch: one pass over the key."""
    grid = [i / BUCKETS for i in range(1, BUCKETS)]
    n, cuts = df.agg(F.count(key), F.percentile_approx(key, grid, 10 * BUCKETS)).first()
    k = min(BUCKETS, -(-n // rows))
    return sorted({float(cuts[j * BUCKETS // k - 1]) for j in range(1, k)}) if n else []


def with_bucket(df: DataFrame, key: str, starts: list[float], name: str = "_bucket") -> DataFrame:
    """``df`` with the number of the bucket that ``key`` is in; nulls, which sort first, have one before the others."""
    if not starts:
        return df.withColumn(name, F.when(F.col(key).isNull(), -1).otherwise(0))
    cut = Bucketizer(splits=[float("-inf"), *starts, float("inf")], inputCol="_key", outputCol=name, handleInvalid="keep")
    found = cut.transform(df.withColumn("_key", F.col(key).cast("double"))).drop("_key")
    return found.withColumn(name, F.when(F.col(key).isNull(), -1).otherwise(F.col(name).cast("int")))


def exclusive_sums(df: DataFrame, by: list[str], order: list[str], sums: dict[str, Column], rows: int = ROWS, slim: DataFrame | None = None) -> DataFrame:
    """``df`` with a column for each of ``sums``: its sum over the rows before, in each group of ``by``, in the given order.

    The first order column is a whole number. The order must be total for the result to be unique. ``slim`` has the same
    rows with the same columns that the sums and the order need: where these are cheap and the rest of ``df`` is not, the
    quantiles and the sums of the buckets read that instead.
    """
    slim = df if slim is None else slim
    starts = bucket_starts(slim, order[0], rows)
    totals = with_bucket(slim, order[0], starts).groupBy(*by, "_bucket").agg(*[F.sum(v).alias(f"_sum_{n}") for n, v in sums.items()])
    through = Window.partitionBy(*by).orderBy("_bucket")
    bases = totals.select(*by, "_bucket", *[(F.sum(f"_sum_{n}").over(through) - F.col(f"_sum_{n}")).alias(f"_base_{n}") for n in sums])
    inside = Window.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # A value that the rows have under another sum's name must not change before it is summed.
    placed = with_bucket(df, order[0], starts).withColumns({f"_within_{n}": F.sum(v).over(inside) - v for n, v in sums.items()}).join(bases, [*by, "_bucket"])
    out = placed.withColumns({n: (F.col(f"_base_{n}") + F.col(f"_within_{n}")).cast("long") for n in sums})
    return out.drop("_bucket", *[f"_base_{n}" for n in sums], *[f"_within_{n}" for n in sums])


def exclusive_sum(df: DataFrame, by: list[str], order: list[str], value: str, name: str, rows: int = ROWS, slim: DataFrame | None = None) -> DataFrame:
    """``exclusive_sums`` of one column."""
    return exclusive_sums(df, by, order, {name: F.col(value)}, rows, slim)


def hash_rank(df: DataFrame, by: list[str], digest: str, ties: list[str], name: str, prefix: int = 4) -> DataFrame:
    """``df`` with ``name``: each row's place from 1 in its group by the hexadecimal column ``digest``, then ``ties``.

    Rows are counted in buckets of the digest's first digits: 65,536 a group by default, so ten billion rows are some
    150,000 a bucket, and few rows make no more buckets than rows. Pass slim rows and join the result back.
    """
    dealt = df.withColumn("_bucket", F.substring(digest, 1, prefix))
    counts = dealt.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    bases = counts.select(*by, "_bucket", (F.sum("_n").over(Window.partitionBy(*by).orderBy("_bucket")) - F.col("_n")).alias("_base"))
    within = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(digest, *ties))
    return dealt.withColumn("_within", within).join(bases, [*by, "_bucket"]).withColumn(name, (F.col("_base") + F.col("_within")).cast("long")).drop("_bucket", "_base", "_within")
