"""Exact top-k search by inner product: a Voronoi join of queries and vectors.

A sample of vectors serves as pivots, about the square root of the table; each vector belongs to the cell of its nearest
pivot. A cell's summary holds its radius and the distances of its k nearest members. With pivot p, any member x at
distance d has ``q.p - |q| d <= q.x <= q.p + |q| d``, so the summaries bound from below what a query's k-th best score
must be, and from above what a cell can offer. A query needs only the cells whose upper bound reaches its lower bound.

Neighbouring cells share slices of vectors, a large cell has several. A query goes to the slices of the cells it needs,
in groups with queries of neighbouring cells, and a slice to the groups that need it; each such block is solved at once
by matrix products. Where nothing can be pruned, N vectors and N / 100 queries make ``N * N / 100`` products whatever the
plan; the copies sent are fewer by the size of a group and of a slice. All scores are whole numbers and exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import map_arrow, parallel, written

PIVOTS = 32, 1 << 14  # at least and at most; between them the square root of the table
GROUP, SLICE = 8192, 32768  # queries and vectors of a block: 4 and 16 MB at 64 dimensions
SMALL = 1024  # vectors of a slice at least: a query brings k rows back from each slice
CHUNK = 1 << 22  # entries of the matrices that a task holds beside its block
LOW, HIGH = -(2**63), 2**63 - 1


def whole_vectors(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """``vec_id, vec``: components as ``floor(scale * x)``; rows with a null key or an unusable component are left out."""
    good = F.col(key).isNotNull() & F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where(good).select(F.col(key).cast("long").alias("vec_id"), F.transform(vector, lambda x: F.floor(x.cast("double") * scale)).alias("vec"))


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of whole numbers, shorter ones filled with zeros."""
    out = np.zeros((len(column), width), np.int64)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    out[np.arange(width)[None, :] < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: longs, or Python's whole numbers where these could leave the range of a long."""
    bound = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * max(1, a.shape[1])
    if bound < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if bound < 2**62:
        return a @ b.T
    return a.astype(object) @ b.T.astype(object)


def beyond(score: int) -> bytes | None:
    """What orders scores that a long can't tell apart: nothing for those inside its range, else all their digits."""
    return None if LOW < score < HIGH else (score + (1 << 191)).to_bytes(24, "big")


def _cells(pivots: np.ndarray):
    """``vec_id, cell, apart, salt, vec``: the salt parts rows that have one key and one vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pivots.astype(np.float64)
        step = max(1, CHUNK // len(p))
        for batch in batches:
            ints = matrix(batch.column(1), pivots.shape[1])
            x = ints.astype(np.float64)
            cell = np.concatenate([np.zeros(0, np.int64), *(((p * p).sum(1)[None, :] - 2 * x[i : i + step] @ p.T).argmin(1) for i in range(0, len(x), step))])
            apart = np.sqrt(((x - p[cell]) ** 2).sum(1))
            salt = np.arange(len(x), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell.astype(np.int32)), pa.array(apart), pa.array(salt), pa.array([r.tobytes() for r in ints], pa.binary())], names=["vec_id", "cell", "apart", "salt", "vec"])

    return run


def _nearest(k: int):
    """For each cell, its rows, the radius and the k smallest distances of those rows that are not queries."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size, radius, near = {}, {}, {}
        for pdf in batches:
            for cell, part in pdf.groupby("cell"):
                size[cell] = size.get(cell, 0) + len(part)
                radius[cell] = max(radius.get(cell, 0.0), part["apart"].max())
                near[cell] = sorted([*near.get(cell, []), *part.loc[~part["asks"], "apart"].nsmallest(k)])[:k]
        if radius:
            yield pd.DataFrame({"cell": list(radius), "n": list(size.values()), "radius": list(radius.values()), "near": [near[c] for c in radius]})

    return run


def _merge(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"cell": [pdf["cell"].iloc[0]], "n": [pdf["n"].sum()], "radius": [pdf["radius"].max()], "near": [sorted(x for row in pdf["near"] for x in row)[:k]]})

    return run


def dealt(order: list[int], sizes: dict[int, int], room: int) -> dict[int, tuple[int, int]]:
    """``cell: (first, parts)``: neighbouring cells share a part of up to ``room`` rows, a larger cell has several."""
    out, at, filled = {}, 0, 0
    for cell in order:
        parts = -(-sizes[cell] // room)
        if filled and (parts > 1 or filled + sizes[cell] > room):
            at, filled = at + 1, 0
        out[cell] = at, max(1, parts)
        if parts > 1:
            at += parts
        else:
            filled += sizes[cell]
    return out


def along(pivots: np.ndarray, cells: list[int]) -> list[int]:
    """The cells in the order of their pivots on the line through the two that lie far apart."""
    p = pivots[cells].astype(np.float64)
    if len(p) < 3:
        return cells
    far = p[((p - p[0]) ** 2).sum(1).argmax()]
    line = p[((p - far) ** 2).sum(1).argmax()] - far
    return [cells[i] for i in np.argsort(p @ line, kind="stable")]


def _needed(pivots: np.ndarray, summary: list[tuple[int, float, list[float]]], slices: dict[int, tuple[int, int]], k: int, width: int):
    """A query's needed slices: those of the cells that can reach its k-th best score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [c for c, _, _ in summary]
        p = pivots[cells].astype(np.float64)
        length = np.sqrt((p * p).sum(1))
        radius = np.array([r for _, r, _ in summary])
        near = np.full((len(summary), k), np.inf)
        for i, (_, _, x) in enumerate(summary):
            near[i, : len(x)] = x
        there = np.isfinite(near)
        first, parts = (np.array([slices[c][i] for c in cells], np.int64) for i in (0, 1))
        step = max(1, CHUNK // max(1, near.size))
        for batch in batches:
            every = np.frombuffer(b"".join(batch.column("vec").to_pylist()), np.int64).reshape(batch.num_rows, width).astype(np.float64)
            needs = []
            for low in range(0, len(every), step):
                q = every[low : low + step]
                norm, at = np.sqrt((q * q).sum(1)), q @ p.T
                # Rounding of sums of products and of distances is far below this share of the lengths involved.
                slack = 1 + 1e-9 * norm[:, None] * (length + radius)[None, :]
                # Each member of the k nearest of each cell scores at least this.
                least = np.where(there[None], (at - slack)[:, :, None] - norm[:, None, None] * np.where(there, near, 0)[None], -np.inf).reshape(len(q), -1)
                bound = -np.partition(-least, k - 1, axis=1)[:, k - 1] if least.shape[1] >= k else np.full(len(q), -np.inf)
                for row in at + norm[:, None] * radius[None, :] + slack >= bound[:, None]:
                    needs.append(np.unique(np.concatenate([np.arange(f, f + n) for f, n in zip(first[row].tolist(), parts[row].tolist(), strict=True)] or [first[:0]])))
            ends = np.cumsum([0, *map(len, needs)]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.int64), *needs])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("cell"), batch.column("vec"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["vec_id", "cell", "vec", "slices"])

    return run


def _solve(k: int, width: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        ask, found, scores = [], [], []
        if len(left) and len(right):
            right = right.sort_values("vec_id", kind="stable")
            q, x = (np.frombuffer(b"".join(d["vec"]), np.int64).reshape(len(d), width) for d in (left, right))
            ids, asks = right["vec_id"].to_numpy(), left["vec_id"].to_numpy()
            step = max(1, CHUNK // len(x))
            for low in range(0, len(q), step):
                for one, row in zip(asks[low : low + step].tolist(), products(q[low : low + step], x), strict=True):
                    names = ids
                    if (own := ids == one).any():
                        row, names = row[~own], ids[~own]
                    if len(row) > 4 * k:  # those above the k-th best, and all that tie with it
                        some = row >= -np.partition(-row, k - 1)[k - 1]
                        row, names = row[some], names[some]
                    best = np.argsort(-row, kind="stable")[:k]
                    ask += [one] * len(best)
                    found += names[best].tolist()
                    scores += row[best].tolist()
        return pd.DataFrame({"query_id": np.array(ask, np.int64), "vec_id": np.array(found, np.int64), "score": np.array([min(max(s, LOW), HIGH) for s in scores], np.int64), "beyond": [beyond(s) for s in scores]})

    return run


def top_k(vectors: DataFrame, every: int = 100, k: int = 10, scale: int = 1024, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the best ``k`` rows for each row whose key is divisible by ``every``.

    Keys are whole numbers, as the queries are told by them; a text that isn't one raises an error. Rows with a null key,
    a null vector or a null or non-finite component take no part; shorter vectors are filled with zeros. A query's own key is no candidate. Other rows count as often as they occur; a repeated query key asks once,
    with the smallest of its vectors. Ties go to the smaller key. Ranks follow the exact scores, also beyond the range of
    a long, where ``score`` shows the end of that range; a component beyond it counts as its end. No usable row: no
    result. Other columns are not read.
    """
    spark = vectors.sparkSession
    usable = whole_vectors(parallel(vectors.select(F.col(key).alias("k"), F.col(vector).alias("v"))), "k", "v", scale)
    width, total = usable.agg(F.max(F.size("vec")), F.count("*")).first()
    width, pivots = width or 0, min(PIVOTS[1], max(PIVOTS[0], math.isqrt(total)))
    sample = usable.orderBy(F.xxhash64("vec_id"), "vec_id", "vec").limit(pivots).collect()
    chosen = sorted({tuple(r["vec"]) for r in sample}) or [()]
    pivots = matrix(pa.array([list(x) for x in chosen], pa.list_(pa.int64())), width)
    placed = written(map_arrow(usable, _cells(pivots), "vec_id long, cell int, apart double, salt int, vec binary"))
    shape = "cell int, n long, radius double, near array<double>"
    partial = placed.select("cell", "apart", (F.col("vec_id") % every == 0).alias("asks")).mapInPandas(_nearest(k), shape)
    # A row of k numbers for each pivot.
    rows = sorted(partial.groupBy("cell").applyInPandas(_merge(k), shape).collect(), key=lambda r: r["cell"])
    summary, order = [(r["cell"], r["radius"], list(r["near"])) for r in rows], along(pivots, [r["cell"] for r in rows])
    # A small table still gives the tasks of a shuffle slices, but not such small ones that most of what they find is dropped.
    room = min(SLICE, max(SMALL, -(-total // int(spark.conf.get("spark.sql.shuffle.partitions")))))
    slices = dealt(order, {r["cell"]: r["n"] for r in rows}, room)
    asked = placed.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("vec", "cell")).alias("x")).select("vec_id", "x.cell", "x.vec")
    needs = written(map_arrow(asked, _needed(pivots, summary, slices, k, width), "vec_id long, cell int, vec binary, slices array<long>"))
    counts = {r["cell"]: r["count"] for r in needs.groupBy("cell").count().collect()}
    groups = dealt([c for c in order if c in counts], counts, GROUP)
    # Both plans have a row for each pivot, which are at most PIVOTS[1].
    plan = lambda d: F.broadcast(spark.createDataFrame([(c, *d[c]) for c in d], "cell int, first long, parts long"))
    part = lambda *salt: F.col("first") + F.pmod(F.xxhash64("vec_id", *salt), "parts")
    grouped = needs.join(plan(groups), "cell").select("vec_id", "vec", part().alias("group"), F.explode("slices").alias("slice"))
    wanted = grouped.select(F.col("slice").alias("at"), F.col("group").alias("to")).distinct()
    # The blocks grow with the square of the table over the sizes of a group and a slice, so they are joined by a shuffle.
    sent = placed.join(plan(slices), "cell").select("vec_id", "vec", part("salt").alias("at")).join(wanted.hint("merge"), "at")
    found = grouped.groupBy("slice", "group").cogroup(sent.groupBy("at", "to")).applyInPandas(_solve(k, width), "query_id long, vec_id long, score long, beyond binary")
    # A key is null inside the range, so it matters only among scores that show one end of it.
    ranked = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, beyond DESC, vec_id)"
    return found.selectExpr("query_id", f"CAST({ranked} AS int) AS rank", "vec_id", "score").where(F.col("rank") <= k)


ORACLE = """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), s AS (
        SELECT q.vec_id AS query_id, x.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, x.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
        FROM v q JOIN v x ON q.vec_id % 100 = 0 AND x.vec_id <> q.vec_id
    )
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
"""


def op10(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
