"""Helpers shared by the training-data operators: Arrow functions, unused names and connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.scratch import Table, dropped_after, written

__all__ = ["Table", "components", "dropped_after", "in_batches", "list_runs", "map_arrow", "numbered", "ordered", "parallel", "runs", "unused", "written"]


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that ``df`` doesn't have, whatever the case of its own."""
    there = {c.lower() for c in df.columns}
    mark = "_"
    while any(f"{mark}{n}".lower() in there for n in names):
        mark += "_"
    return [f"{mark}{n}" for n in names]


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` whose Spark schema is given as DDL."""
    return df.mapInArrow(fn, schema)


def parallel(df: DataFrame) -> DataFrame:
    """``df`` dealt evenly where the files gave fewer partitions than there are cores (a one-file table, say)."""
    sc = df.sparkSession.sparkContext
    return df.repartition(sc.defaultParallelism) if df.rdd.getNumPartitions() < sc.defaultParallelism else df


PART = 33  # ``monotonically_increasing_id`` has the partition above this bit


def ordered(df: DataFrame, keys: list[str]) -> Table:
    """``df`` written in the order of ``keys`` (nulls first), with ``place``: a number that rises in that order.

    Rows are dealt by ranges of all keys together, so rows of one leading key lie in as many parts as they need. The part
    is ``place`` shifted right by ``PART``. Pass slim rows, from a written table: the ranges take a pass of their own.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return Table(df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("place", F.monotonically_increasing_id()))


def numbered(df: DataFrame, by: str, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Each row's ``idx`` from 0 in its group by ``keys``, with ``gid``; and the groups: ``by, gid, size``.

    Groups are numbered from 0 in their own order, null first. What a window holds is a row for each part of the table,
    or, for the groups, a row for each of them in a part.
    """
    table = ordered(df, [by, *keys])
    part = F.shiftright("place", PART)
    pieces = written(table.df.groupBy(by, part.alias("part")).agg(F.count("*").alias("n"), F.min("place").alias("first")))
    sizes = written(pieces.groupBy(by).agg(F.sum("n").alias("size"), F.min("first").alias("at")))
    per_part = sizes.groupBy(F.shiftright("at", PART).alias("p")).agg(F.count("*").alias("k"))
    before = per_part.select("p", (F.sum("k").over(Window.orderBy("p")) - F.col("k")).alias("base"))
    rank = F.row_number().over(Window.partitionBy("p").orderBy("at")) - 1
    groups = written(sizes.withColumn("p", F.shiftright("at", PART)).withColumn("r", rank).join(before, "p").select(by, (F.col("base") + F.col("r")).alias("gid"), "size"))
    starts = pieces.withColumn("base", F.sum("n").over(Window.partitionBy(by).orderBy("part")) - F.col("n"))
    named = groups.withColumnRenamed(by, "g")
    starts = starts.join(named, F.col(by).eqNullSafe(F.col("g"))).select(F.col(by).alias("b"), F.col("part").alias("q"), "first", "base", "gid")
    rows = table.df.join(starts, F.col(by).eqNullSafe(F.col("b")) & (part == F.col("q")))
    return rows.select(*df.columns, "gid", (F.col("place") - F.col("first") + F.col("base")).alias("idx")), groups


def _cut_tables(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
    """Tables of whole runs, and where each run begins and ends, from batches sorted by the first ``keys`` (whole-number) columns."""
    held: list[pa.RecordBatch] = []

    def cut(end: bool) -> tuple[pa.Table, list[tuple[int, int]]]:
        nonlocal held
        table = pa.Table.from_batches(held).combine_chunks()
        new = np.zeros(len(table), bool)
        new[0] = True
        for i in range(keys):
            c = table.column(i).to_numpy()
            new[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(new).tolist()
        stops = [*starts[1:], len(table)]
        if not end:
            held = table.slice(starts.pop()).to_batches()
            stops.pop()
        return table, list(zip(starts, stops, strict=True))

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            if any(held[0].column(i)[0] != batch.column(i)[-1] for i in range(keys)):
                yield cut(end=False)
    if held:
        yield cut(end=True)


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The runs of rows with equal values in the first ``keys`` (whole-number) columns, from batches sorted by them."""
    for table, spans in _cut_tables(batches, keys):
        for a, b in spans:
            yield table.slice(a, b - a)


def list_runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[dict[str, list]]:
    """The same as lists by column, which is faster where runs are short."""
    for table, spans in _cut_tables(batches, keys):
        columns = table.slice(0, spans[-1][1] if spans else 0).to_pydict()
        for a, b in spans:
            yield {n: c[a:b] for n, c in columns.items()}


def in_batches(rows: Iterator[dict], schema: pa.Schema, size: int = 1000) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of up to ``size``."""
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph by alternating large-star and small-star steps.

    ``edges`` has long columns ``a`` and ``b``; loops and repeats are allowed. Returns ``node, root``, one row for each
    node that has an edge, where ``root`` is the component's smallest node. An empty input gives no rows. Each round
    is three joins on node ids whose sides are all plain scans, so adaptive execution can split the rows of a hub;
    the number of rounds grows with the logarithm of the component size.
    """
    ordered = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = Table(ordered)
    seen = None
    while True:
        mark = now.df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == seen or mark[0] == 0:
            break
        seen = mark
        both = now.df.unionByName(now.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = Table(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = Table(both.where("v > u").join(low.df, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = Table(large.df.groupBy("u").agg(F.min("v").alias("m")))
        # The edge to the smallest neighbour stays as it is; every other neighbour moves below that one.
        moved = large.df.join(least.df, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = Table(moved.unionByName(least.df.select("u", F.col("m").alias("v"))).distinct())
        for t in (now, low, large, least):
            t.drop()
        now = after
    leaves = now.df.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.unionByName(now.df.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
