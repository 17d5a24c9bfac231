"""Packing tokenized documents into fixed-length sequences: shortest-pack-first over the length histogram.

Documents are cut into pieces of at most the sequence length. Only the histogram of piece lengths, which has no more
entries than the sequence length, goes to the driver; it places lengths from the longest on, each into the shortest
pack that exists, and updates how often each packing pattern occurs. The patterns then go back to the pieces by the
pieces' ranks among those of equal length.
"""

from __future__ import annotations

import functools
import heapq
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import map_arrow, parallel, written

LENGTH, END_ID = 2048, 1
RANKED = 20_000  # pieces that a task of the ranking should have


SEPARATOR = "\x01"  # fixed value: a control character that is a token of its own between blanks


class WordTokens(dict):
    """Token ids of the white-space separated parts of texts, each part encoded once per worker.

    The tokenizer drops white space and no token spans it, so the ids of a text are those of its parts in turn. Parts
    are numbered; ``starts``, ``sizes`` and ``flat`` hold their ids. It forgets everything at ``limit`` parts.
    """

    def __init__(self, path: str, limit: int = 1 << 20):
        # A task has one core; threads of the library would only contend for it.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit, self.new = Tokenizer.from_file(path), limit, []
        self.separator = self.encode([SEPARATOR])[0]
        self.clear()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def clear(self) -> None:
        super().clear()
        self.starts, self.sizes, self.flat = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)

    def __missing__(self, part: bytes) -> int:
        self[part] = n = len(self)
        self.new.append(part)
        return n

    def learn(self) -> None:
        """Encodes the new parts: many at once, set apart by a separator; those that contain it one by one."""
        parts = [p.decode("utf-8", "replace") for p in self.new]
        found: list[np.ndarray] = [None] * len(parts)
        plain = [i for i, p in enumerate(parts) if SEPARATOR not in p]
        for at in range(0, len(plain), 1000):
            some = plain[at : at + 1000]
            ids = self.encode([f" {SEPARATOR} ".join(parts[i] for i in some)])[0]
            cuts = np.flatnonzero(ids == self.separator[0])
            for i, low, high in zip(some, np.append(0, cuts + 1).tolist(), np.append(cuts, len(ids)).tolist(), strict=True):
                found[i] = ids[low:high]
        odd = [i for i, x in enumerate(found) if x is None]
        for i, ids in zip(odd, self.encode([parts[i] for i in odd]), strict=True):
            found[i] = ids
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        self.starts = np.append(self.starts, len(self.flat) + np.cumsum(sizes) - sizes)
        self.sizes = np.append(self.sizes, sizes)
        self.flat = np.concatenate((self.flat, *found))
        self.new = []

    def ids(self, texts: list[bytes | None]) -> Iterator[np.ndarray]:
        if len(self) > self.limit:
            self.clear()
        # A-Z can be lowered before, as the tokenizer would do it, unless the text may spell a special token.
        split = ((t if b"<|" in t else t.lower()).split() if t else [] for t in texts)
        coded = [np.fromiter(map(self.__getitem__, parts), np.int64, len(parts)) for parts in split]
        if self.new:
            self.learn()
        for codes in coded:
            sizes = self.sizes[codes]
            ends = np.cumsum(sizes)
            n = int(ends[-1]) if len(ends) else 0
            yield self.flat[np.repeat(self.starts[codes] - ends + sizes, sizes) + np.arange(n)]


@functools.lru_cache(maxsize=1)
def word_tokens(path: str) -> WordTokens:
    """One cache for all tasks of a worker process."""
    return WordTokens(path)


def pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens``: each document's ids cut at every multiple of ``length``.

    A null text counts as empty; every document ends with ``end_id``, so each has at least one piece.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_tokens(tokenizer)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).cast(pa.binary())
            # A few megabytes at a time: the codes of a slice are all held.
            for at in range(0, len(keys), 500):
                rows = []
                for k, ids in enumerate(cache.ids(texts[at : at + 500].to_pylist()), at):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    rows += [(k, i, min(length, len(ids) - i), zlib.crc32(ids[i : i + length].tobytes()), len(ids)) for i in range(0, len(ids), length)]
                own, *others = (pa.array(x, pa.int64()) for x in zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([keys.take(own), *others], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    slim = parallel(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")))
    return map_arrow(slim, run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long")


def patterns(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[tuple[int, ...], int]]:
    """Packs ``(lengths, how many sequences have them)`` that use every piece of the histogram once.

    From the longest length on, pieces go to the packs with the most free space (the shortest packs); where none has
    room, they open new ones.
    """
    by_space: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    spaces: list[int] = []  # a heap of the free spaces that occur, the largest first

    def put(space: int, pack: tuple[int, ...], n: int) -> None:
        if space not in by_space:
            by_space[space] = []
            heapq.heappush(spaces, -space)
        by_space[space].append((pack, n))

    for size in sorted(histogram, reverse=True):
        left, made = histogram[size], []
        while left and spaces and -spaces[0] >= size:
            space = -spaces[0]
            pack, n = by_space[space].pop()
            if not by_space[space]:
                del by_space[space]
                heapq.heappop(spaces)
            used = min(n, left)
            if n > used:
                put(space, pack, n - used)
            put(space - size, (*pack, size), used)
            left -= used
        if left:
            per = length // size
            whole, rest = divmod(left, per)
            # New packs take as many pieces of this length as fit, as the next ones would go to the shortest anyway.
            made += [((size,) * per, whole)] if whole else []
            made += [((size,) * rest, 1)] if rest else []
        for pack, n in made:
            put(length - sum(pack), pack, n)
    return [x for space in sorted(by_space) for x in by_space[space]]


def spread(packs: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """``(length, low, high, first sequence, copies, offset)``: which ranks of each length go where."""
    used: dict[int, int] = {}
    rows, first = [], 0
    for pack, n in packs:
        offset = 0
        for size in sorted(set(pack), reverse=True):
            copies, low = pack.count(size), used.get(size, 0)
            used[size] = low + copies * n
            rows.append((size, low, used[size], first, copies, offset))
            offset += copies * size
        first += n
    return rows


def ranked(df: DataFrame, total: int) -> DataFrame:
    """``df`` of ``total`` pieces with ``rank``, from 0 among equal lengths, by hash bucket, document and start.

    All lengths are counted in as many parts as all pieces need, whose sizes are then summed up: so a length that a third
    of the pieces share has many.
    """
    dealt = df.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(max(1, total // RANKED))).cast("int"))
    sums = dealt.groupBy("length", "bucket").count()
    bases = written(sums.selectExpr("length", "bucket", "sum(count) OVER (PARTITION BY length ORDER BY bucket) - count AS base"))
    numbered = dealt.selectExpr("*", "row_number() OVER (PARTITION BY length, bucket ORDER BY doc_id, start, ids_crc32) - 1 AS nth")
    return numbered.join(bases, ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("nth")).drop("bucket", "base", "nth")


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """All documents as pieces of sequences of at most ``length`` tokens, one row for each piece.

    Null and empty texts are single end ids, and texts of any length are cut into pieces; repeated rows are packed as often
    as they occur. Keys may be of any type that can be sorted; null ones stay null. An empty table gives no rows. Other
    columns are not read.
    """
    spark = docs.sparkSession
    cut = written(pieces(docs, tokenizer, key, text, length, end_id))
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    plan = spark.createDataFrame(spread(patterns(histogram, length)), "length long, low long, high long, first long, copies long, at long")
    # The plan is as small as the histogram: its size depends on the sequence length, not on the documents.
    placed = ranked(cut, sum(histogram.values())).join(F.broadcast(plan), "length").where("rank >= low AND rank < high")
    return placed.selectExpr("doc_id", "start", "length", "ids_crc32", "doc_tokens", "first + (rank - low) div copies AS sequence_id", "at + (rank - low) % copies * length AS offset")


def op5(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
