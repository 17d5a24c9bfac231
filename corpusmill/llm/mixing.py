"""Mixing sources to target weights by the cube method of balanced sampling.

Each source gets a target number of words. A document is taken as often as the whole part of target over size says, and
once more with the fractional part as its inclusion probability. Which documents get the extra copy is drawn by the cube
method: the vector of probabilities moves at random along directions that leave the sums of words and of documents as
they are, until each probability is 0 or 1. Two sums are kept, so three undecided documents always have such a
direction; the at most two that remain at the end are a small landing problem.

The flight runs in blocks: every block keeps its own sums and leaves at most two documents undecided, which meet in the
blocks of the next round. The number of rounds grows with the logarithm of the table's size.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import Table, parallel, unused, written

BLOCK = 1024
NEAR = 1e-9


def words(text) -> F.Column:
    """Words of a text, parted by ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, most: int = 3, weights: int = 3) -> DataFrame:
    """``source, source_size, target``: each source's share of all words.

    Sources in code-point order, null last, weigh 1 to ``weights``, repeating. A target above ``most`` times its source's
    size is cut to that, and the rest is shared among the others by weight. With ``x`` words for a unit of weight, a
    source is cut if its limit for a unit is below ``x``, so in the order of these limits the first source that isn't
    cut gives ``x``.
    """
    source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    # Windows over all sources: one slim row for each source, not for each document.
    weighed = source.selectExpr("*", f"1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {weights} AS weight", f"{most} * source_size AS limit")
    order = "ORDER BY limit / weight, source"
    stepped = weighed.selectExpr("*", f"(sum(source_size) OVER () - (sum(limit) OVER ({order}) - limit)) / (sum(weight) OVER () - (sum(weight) OVER ({order}) - weight)) AS unit")
    return stepped.selectExpr("source", "source_size", "n_docs", "row_number() OVER (ORDER BY source NULLS LAST) AS source_no", "least(limit, weight * max(CASE WHEN unit <= limit / weight THEN unit END) OVER ()) AS target")


def flight(size: np.ndarray, p: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Moves ``p`` until at most two entries are undecided, keeping ``sum(p)`` and ``sum(p * size)``."""
    p = p.copy()
    held: list[int] = []
    at = turn = 0
    while True:
        while len(held) < 3 and at < len(p):
            if NEAR < p[at] < 1 - NEAR:
                held.append(at)
            at += 1
        if len(held) < 2:
            return p
        same = next(((i, j) for i, j in itertools.combinations(held, 2) if size[i] == size[j]), None)
        if same:
            who, along = list(same), [1.0, -1.0]
        elif len(held) == 3:
            a, b, c = held
            who, along = held, [size[b] - size[c], size[c] - size[a], size[a] - size[b]]
        else:
            return p
        up = min((1 - p[i]) / u if u > 0 else p[i] / -u for i, u in zip(who, along, strict=True) if u)
        down = min(p[i] / u if u > 0 else (1 - p[i]) / -u for i, u in zip(who, along, strict=True) if u)
        step = up if draws[turn % len(draws)] * (up + down) < down else -down
        turn += 1
        for i, u in zip(who, along, strict=True):
            p[i] += step * u
            if p[i] < NEAR or p[i] > 1 - NEAR:
                p[i] = round(p[i])
        held = [i for i in held if 0 < p[i] < 1]


def land(size: np.ndarray, start: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Rounds the undecided entries (two at most) so that the words change least, then the documents.

    What error in words that leaves is mended while exchanging one taken for one other document, or turning one over,
    makes it smaller. Only documents that were undecided at the ``start`` change.
    """
    left = np.flatnonzero((p > 0) & (p < 1))
    best = min(itertools.product((0.0, 1.0), repeat=len(left)), key=lambda x: (abs(((np.array(x) - p[left]) * size[left]).sum()), abs((np.array(x) - p[left]).sum()), x))
    p = p.copy()
    p[left] = best
    free = np.flatnonzero((start > NEAR) & (start < 1 - NEAR))
    for _ in range(16):
        error = ((p - start) * size).sum()
        # Index 0 stands for no document.
        outs, ins = np.append(-1, free[p[free] == 1]), np.append(-1, free[p[free] == 0])
        off, on = (np.append(0, size[x[1:]]) for x in (outs, ins))
        change = np.abs(error - off[:, None] + on[None, :])
        i, j = np.unravel_index(change.argmin(), change.shape)
        if change[i, j] >= abs(error) - NEAR * (1 + abs(error)):
            break
        for k in (outs[i], ins[j]):
            if k >= 0:
                p[k] = 1 - p[k]
    return p


def _fly(seed: int, level: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order", "doc_id", "size"], kind="stable").reset_index(drop=True)
        size, start, last = pdf["size"].to_numpy(np.float64), pdf["p"].to_numpy(np.float64), int(pdf["blocks"].iloc[0]) == 1
        p = flight(size, start, np.random.default_rng([seed, level, int(key[0]), int(key[1])]).random(len(pdf)))
        pdf["p"] = land(size, start, p) if last else p
        return pdf

    return run


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", most: int = 3, seed: int = 42) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` for every row: how often the mix takes it.

    Null texts have size 0 and take no words. A null source is a source of its own. Repeated rows are documents of their
    own. The draws depend on the seed and on keys and sizes only, so reruns agree, however the rows are dealt. Texts of
    any length are counted whole. An empty table gives no rows. Other columns are not read.
    """
    slim = parallel(docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text")))
    sized = written(slim.select("doc_id", "source", words(F.col("text")).alias("size")))
    plan = written(targets(sized, most))
    rate = "CASE WHEN source_size = 0 THEN 0D ELSE target / source_size END"
    planned = sized.alias("d").join(plan.alias("t"), F.expr("d.source <=> t.source")).selectExpr("doc_id", "d.source", "size", "source_size", "target", "source_no", "n_docs", f"floor({rate}) AS whole", f"{rate} - floor({rate}) AS p")
    open_rows = planned.selectExpr("*", "xxhash64(doc_id, size) AS order", f"CAST(ceil(n_docs / {BLOCK}) AS long) AS blocks").withColumn("block", F.pmod("order", "blocks")).drop("n_docs")
    done, level, now = [], 0, None
    while True:
        flown = Table(open_rows.groupBy("source_no", "block").applyInPandas(_fly(seed, level), open_rows.schema))
        done.append(flown.df.where("p = 0 OR p = 1"))
        rest = flown.df.where("p > 0 AND p < 1")
        left = rest.groupBy("source_no").agg(F.count("*").alias("n"))
        level, now = level + 1, written(left)
        if now.isEmpty():
            break
        open_rows = rest.drop("blocks", "block").join(now, "source_no").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("long")).drop("n")
        # Another hash in each round: those left over by one block part ways.
        open_rows = open_rows.withColumn("block", F.pmod(F.xxhash64("order", F.lit(level)), "blocks")).select(*flown.df.columns)
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    copies = "whole + CAST(p AS long)"
    return every.selectExpr("doc_id", "source", "size", "source_size", "target", f"{copies} AS copies", f"size * ({copies}) AS taken")


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", most: int = 3, seed: int = 42) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it. Rows with a null key are kept once.

    Where a key occurs repeatedly, the copies of all its rows are shared evenly, rounded up. Null and empty texts have no
    words, so they go where their source is taken less than once. A null source is a source of its own. Texts of any length
    are counted whole. An empty table gives an empty result. Columns of any names pass through.
    """
    id_, copies = unused(docs, "mix_id", "mix_copies")
    plan = mix(docs.where(F.col(key).isNotNull()), key, text, source, most, seed).groupBy("doc_id").agg(F.ceil(F.avg("copies")).cast("int").alias(copies)).withColumnRenamed("doc_id", id_)
    # The plan has a row for each document, so it is never broadcast, however small the table.
    placed = docs.join(written(plan).hint("merge"), F.col(key) == F.col(id_), "left").withColumn(copies, F.coalesce(copies, F.lit(1)))
    return placed.where(F.col(copies) > 0).withColumn(copies, F.explode(F.sequence(F.lit(1), copies))).select(*docs.columns)


def op4(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
