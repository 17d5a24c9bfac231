"""Document fingerprints: SimHash of weighted terms, and permuted block tables that find the near ones.

A text's terms are all pieces of six bytes of its words, in lower case and parted by single blanks: long enough to be
rare in other texts, short enough that a text of few words has many. Each distinct term has a 64-bit hash and a weight
that grows with the logarithm of its count, and votes with that weight for or against each bit. Which fingerprints lie
within a radius of which others is found by the block tables.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import map_arrow, written

FACTORS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)  # fixed values: odd multipliers that mix the bits of a term
PIECE = 6
RADIUS = 3  # bits: neighbours that the registered query counts


def hashed(terms: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        for factor, shift in ((FACTORS[0], 32), (FACTORS[1], 29), (FACTORS[0], 32)):
            terms = terms * factor
            terms ^= terms >> np.uint64(shift)
    return terms


def simhash(text: bytes) -> int:
    """The fingerprint of a whole UTF-8 text; 0 for a text without words. Equal texts have equal fingerprints.

    Words are lower-cased A-Z and parted by ASCII white space. A text shorter than a piece is filled with blanks.
    """
    text = b" ".join(text.lower().split())
    if not text:
        return 0
    data = np.frombuffer(text.ljust(PIECE), np.uint8)
    pieces = np.zeros((len(data) - PIECE + 1, 8), np.uint8)
    pieces[:, :PIECE] = np.lib.stride_tricks.sliding_window_view(data, PIECE)
    terms, counts = np.unique(pieces.view("<u8").ravel(), return_counts=True)
    # Whole-number weights: the sum doesn't depend on its order, nor on how wide its numbers are.
    weights = 16 + np.floor(16 * np.log2(counts))
    bits = np.unpackbits(hashed(terms).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    votes = weights.astype(np.float32 if weights.sum() < 1 << 23 else np.float64) @ bits
    return int(np.packbits(2 * votes > weights.sum(), bitorder="little").view(np.uint64)[0])


def likeness(a: int, b: int) -> float:
    return 1 - (a ^ b).bit_count() / 64


class _Pairing:
    """Result rows for documents and the ones that follow them."""

    names = ("kind", "part", "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "text")
    schema = "kind int, part int, doc_id {key}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, text string"
    types = (pa.int32(), pa.int32(), None, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string())

    def __init__(self, part: int = -1):
        self.part, self.rows, self.arrow = part, [], None

    def keyed(self, kind: pa.DataType) -> None:
        """The type of the documents' keys."""
        self.arrow = pa.schema([(n, t or kind) for n, t in zip(self.names, self.types, strict=True)])

    def mark(self, text: str | None) -> tuple[str, int]:
        text = text or ""
        return text, simhash(text.encode("utf-8", "surrogatepass"))

    def pair(self, doc_id, text: str, fp: int, after: str, after_fp: int) -> None:
        n = len(text)
        edited = (text[: n - n // 4] + after[: n // 4]).encode("utf-8", "surrogatepass")
        own = simhash(edited)
        self.rows.append((0, self.part, doc_id, n, hashlib.sha256(edited).hexdigest(), f"{fp:016x}", f"{own:016x}", likeness(fp, own), likeness(fp, after_fp), None))

    def edge(self, kind: int, doc_id, text: str) -> None:
        self.rows.append((kind, self.part, doc_id, None, None, None, None, None, None, text))

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*self.rows, strict=True), self.arrow.types, strict=True)] if self.rows else [pa.array([], t) for t in self.arrow.types], schema=self.arrow)
        self.rows = []
        return out


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs each document of a sorted partition with the next; the first and the last also come out as edges."""
    out, last = _Pairing(TaskContext.get().partitionId()), None
    for batch in batches:
        out.keyed(batch.schema.field(0).type)
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            text, fp = out.mark(text)
            if last is None:
                out.edge(1, doc_id, text)
            else:
                out.pair(*last, text, fp)
            last = doc_id, text, fp
        yield out.batch()
    if last is not None:
        out.edge(2, *last[:2])
        yield out.batch()


def _between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = _Pairing()
    for batch in batches:
        out.keyed(batch.schema.field(0).type)
        for doc_id, text, after in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            out.pair(doc_id, *out.mark(text), *out.mark(after))
        yield out.batch()


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text, and of the text whose last quarter the next document's beginning replaces.

    The documents are dealt by ranges of their key, once, so neighbours meet in one sorted partition; only the two
    documents at the ends of each partition are joined across partitions. Null texts count as empty, null keys come
    first, equal keys are ordered by text, and a single document follows itself. Texts of any length are read whole.
    Repeated rows come back as often. Keys may be of any type that can be sorted. An empty table gives an empty result.
    Other columns are not read.
    """
    ranged = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    schema = _Pairing.schema.format(key=ranged.schema["doc_id"].dataType.simpleString())
    done = written(map_arrow(ranged, _within, schema))
    firsts = done.where("kind = 1").select(F.col("part").alias("follows"), F.col("text").alias("after"))
    lasts = done.where("kind = 2").select("part", "doc_id", "text")
    # One row for each partition, without texts.
    order = done.where("kind = 1").selectExpr("part", "coalesce(lead(part) OVER (ORDER BY part), min(part) OVER ()) AS follows")
    edges = lasts.join(order, "part").join(firsts, "follows").select("doc_id", "text", "after")
    names = [n for n in _Pairing.names if n not in ("kind", "part", "text")]
    return done.where("kind = 0").select(*names).unionByName(map_arrow(edges, _between, schema).select(*names))


def _tables(radius: int, blocks: int) -> Column:
    """The masks of the tables: each keeps ``blocks - radius`` of the blocks of bits, its prefix after permutation."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    masks = []
    for chosen in itertools.combinations(range(blocks), blocks - radius):
        mask = sum(((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in chosen)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return F.array(*[F.struct(F.lit(i).alias("t"), F.lit(m).cast("long").alias("mask")) for i, m in enumerate(masks)])


def find_within(queries: DataFrame, fps: DataFrame, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """All pairs ``query, fp, distance`` of a fingerprint of ``queries`` and one of ``fps`` within ``radius`` bits.

    Both inputs have one long column, ``fp``; repeats count once and nulls not at all. The 64 bits are cut into
    ``blocks`` blocks (twice the radius by default). Each table permutes the bits so that ``blocks - radius`` blocks come
    first: fingerprints within the radius agree in all of these in at least one table. Candidates are verified on all
    bits. A fingerprint of both inputs is found at distance 0. Empty inputs give no rows.
    """
    tables = _tables(radius, blocks or max(2 * radius, radius + 1))
    keyed = lambda df, name: df.select("fp").distinct().where("fp IS NOT NULL").select(F.col("fp").alias(name), F.explode(tables).alias("x")).select(name, F.col("x.t").alias("t"), F.col(name).bitwiseAND(F.col("x.mask")).alias("top"))
    apart = F.bit_count(F.col("query").bitwiseXOR(F.col("found")))
    near = keyed(queries, "query").join(keyed(fps, "found").hint("merge"), ["t", "top"]).where(apart <= radius)
    return near.select("query", F.col("found").alias("fp"), apart.cast("int").alias("distance")).distinct()


def blocks_for(n: int, radius: int) -> int:
    """The fewest blocks, and so the fewest tables, whose prefixes have as many bits as tell ``n`` fingerprints apart."""
    return next(b for b in range(radius + 1, 65) if 64 * (b - radius) // b >= math.log2(max(2, n)) or b == 64)


def neighbours(queries: DataFrame, fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``fp, near_texts, nearest`` for each distinct fingerprint of ``queries``: how many other rows of ``fps`` have one
    within the radius, and the least distance (null if none is).

    Both have a long column ``fp`` and a row for each text, and the texts of ``queries`` are among those of ``fps``.
    Equal fingerprints are counted first, so a group of copies is one entry of each table. Nulls don't count.
    """
    counts = written(fps.where("fp IS NOT NULL").groupBy("fp").agg(F.count("*").alias("n")))
    asked = queries.select("fp").distinct()
    pairs = find_within(asked, counts, radius, blocks_for(counts.count(), radius))
    # The query's own text is one of those with its fingerprint.
    others = pairs.join(counts.hint("merge"), "fp").withColumn("n", F.col("n") - (F.col("distance") == 0).cast("int"))
    return written(others.groupBy(F.col("query").alias("fp")).agg(F.sum("n").alias("near_texts"), F.min(F.when(F.col("n") > 0, F.col("distance"))).alias("nearest")))


def op9(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all texts and edited texts; for each document whose id is divisible by 50, a search for how many
    other documents have a text within three bits of its own (null for the others, which aren't queries)."""
    done = written(edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("fp", F.conv("fingerprint", 16, -10).cast("long")))
    asks = F.col("doc_id") % 50 == 0
    near = neighbours(done.where(asks).select("fp"), done.select("fp"))
    # The queries grow with the table, so the join shuffles at every size.
    return done.withColumn("asked", F.when(asks, F.col("fp"))).join(near.withColumnRenamed("fp", "asked").hint("merge"), "asked", "left").drop("asked", "fp")
