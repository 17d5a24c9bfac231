"""Near-duplicate detection: SimHash fingerprints found by meet-in-the-middle ball hashing.

A fingerprint is a bit vector in which near texts differ in few bits. To find the pairs within a radius, every distinct
fingerprint emits keys: some of its bits, and each variant of them with one bit flipped (half the radius). Two
fingerprints meet in the middle: if their chosen bits differ in at most two places, some variant of the one equals some
variant of the other. One shuffle on the variants brings them together, each meeting is verified on whole fingerprints,
and only a spanning forest of the verified links leaves the bucket, so a group of k near copies gives fewer than k rows
a bucket, never k squared.

Which bits are chosen makes the search complete:

* ``link_fingerprints`` (radius 3): of four 16-bit blocks, one is left out at a time. Of three differing bits at least
  one lies in some block; without that block two are left, which the balls of radius one cover. 4 x 49 keys of 48 bits.
* ``near_fingerprints`` (radius 5 and many beyond): of the four blocks two are taken at a time. Of five differing bits at
  most two lie in some two of them. 6 x 33 keys of 32 bits.

``near_duplicates`` (the pipeline's stage: similarity of word shingles) takes the pairs that ball hashing finds and verifies
each on all shingles. What doesn't meet so and is alike nevertheless is found among the groups so made: their texts meet on the first shingles of one order, which no pair of the asked similarity can miss.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from corpusmill.llm.common import Table, components, map_arrow, parallel, written

SEED = 42
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)  # fixed values: the splitmix64 constants


class WordHashes(dict):
    """Word to 64-bit hash; forgets everything when it holds ``limit`` words, which costs time only."""

    limit = 1 << 19

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = found = xxh64_intdigest(word, SEED)
        return found


def mixed(x: np.ndarray) -> np.ndarray:
    """Splitmix64's last steps: every bit depends on every other."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[1])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[2])
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None, words: int, cache: WordHashes) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes, made from the hashes of their words.

    Words and shingles are those of ``shingle_hashes``; hashing each word once is several times as fast.
    """
    parts = text.lower().split() if text else []
    if not parts:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, parts), np.uint64, len(parts))
    n, size = max(1, len(h) - words + 1), min(words, len(h))
    with np.errstate(over="ignore"):
        factors = mixed(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(MIX[0])) | np.uint64(1)
        total = h[:n] * factors[0]
        for j in range(1, size):
            total = total + h[j : j + n] * factors[j]
        return np.unique(mixed(total))


def shingle_hashes(text: bytes | None, words: int) -> np.ndarray:
    """XXH64 of every shingle of a UTF-8 text: lower-cased A-Z, split at ASCII white space, joined by single spaces.

    A text of fewer words than a shingle has one shingle, all its words; a text without words (or null) has none.
    """
    parts = text.lower().split() if text else []
    if not parts:
        return np.empty(0, np.uint64)
    if len(parts) <= words:
        return np.array([xxh64_intdigest(b" ".join(parts), SEED)], np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.array([xxh64_intdigest(joined[i:j], SEED) for i, j in zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in more than half of the hashes; 0 for none."""
    n = len(hashes)
    if not n:
        return 0
    bits = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    # Sums of 255 bits fit a byte, which keeps the additions eight times as wide.
    votes = np.add.reduceat(bits, np.arange(0, n, 255), axis=0, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: Column, text: Column, words: int) -> DataFrame:
    """``key, fp``: the SimHash of each row's whole text as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [majority(shingle_hashes(t, words)) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], names=["key", "fp"])

    slim = parallel(docs.select(key.alias("key"), text.alias("text")))
    return map_arrow(slim, run, f"key {slim.schema['key'].dataType.simpleString()}, fp long")


def forest(keys: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links of at most ``radius`` bits between the fingerprints of one bucket.

    A breadth-first search that compares the newest member only with those not reached yet: where all are near, its cost
    is about linear.
    """
    rest, out = keys, []
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            top = queue.pop()
            near = np.bitwise_count(rest ^ top) <= radius
            if near.any():
                reached = rest[near]
                out += [(int(top), int(x)) for x in reached]
                queue += list(reached)
                rest = rest[~near]
    return out


BLOCKS, WIDTH = 4, 16  # blocks of bits, of which one is left out at a time
BITS = 64 - WIDTH
NO_FLIP = 63


def rebuilt(key: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Fingerprints from keys (block, then variant of the other bits) and rests (flipped place, then the block's bits)."""
    block = (key >> np.uint64(BITS)) * np.uint64(WIDTH)
    flip = rest >> np.uint64(WIDTH)
    part = (key & np.uint64((1 << BITS) - 1)) ^ np.where(flip == NO_FLIP, np.uint64(0), np.uint64(1) << flip)
    low = part & ((np.uint64(1) << block) - np.uint64(1))
    # The last block leaves no bits above it; numpy doesn't define a shift by 64.
    high = np.where(block == BITS, np.uint64(0), (part >> block) << np.minimum(block + np.uint64(WIDTH), np.uint64(63)))
    return low | ((rest & np.uint64((1 << WIDTH) - 1)) << block) | high


TWO = list(combinations(range(BLOCKS), 2))  # the blocks that are taken; the others are those from the list's end
FAR = 12  # bits in which fingerprints that meet may differ as candidates; only speed depends on it


def rebuilt_of_two(key: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Fingerprints from keys (number in ``TWO``, then variant of two blocks) and rests (flipped place, then the other two)."""
    n, flip = (key >> np.uint64(2 * WIDTH)).astype(np.int64), rest >> np.uint64(2 * WIDTH)
    part = key ^ np.where(flip == NO_FLIP, np.uint64(0), np.uint64(1) << flip)
    block, low = np.uint64(WIDTH), np.uint64((1 << WIDTH) - 1)
    shifts = np.array(TWO, np.uint64) * block
    taken, others = shifts[n], shifts[::-1][n]
    of = lambda bits, at: ((bits & low) << at[:, 0]) | (((bits >> block) & low) << at[:, 1])
    return of(part, taken) | of(rest, others)


def _meet(radius: int, rebuilt=rebuilt):
    """Reads (key, rest) sorted by both; gives the links among the fingerprints of each key."""

    def links(key: np.ndarray, rest: np.ndarray) -> list[np.ndarray]:
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(np.append(starts, len(key)))
        many = np.repeat(sizes > 1, sizes)
        fp, sizes = rebuilt(key[many], rest[many]), sizes[sizes > 1]
        starts = np.cumsum(sizes) - sizes
        two = starts[sizes == 2]
        a, b = fp[two], fp[two + 1]
        good = np.bitwise_count(a ^ b) <= radius
        out = [np.stack([a[good], b[good]], axis=1)]
        for at, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            if found := forest(fp[at : at + n], radius):
                out.append(np.array(found, np.uint64))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # the run that may go on in the next batch

        def flush(end: bool) -> pa.RecordBatch:
            nonlocal held
            key, rest = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = len(key) if end else int(np.searchsorted(key, key[-1]))
            held = [(key[cut:], rest[cut:])]
            found = np.unique(np.concatenate(links(key[:cut], rest[:cut])), axis=0).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, i])) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            if batch.num_rows:
                held.append((batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy().astype(np.uint64)))
                if held[0][0][0] != held[-1][0][-1]:
                    yield flush(end=False)
        if held:
            yield flush(end=True)

    return run


def link_fingerprints(fps: DataFrame) -> DataFrame:
    """All links of at most three bits among distinct 64-bit fingerprints, as a spanning forest ``a, b`` of each group.

    Each fingerprint's parts without one block, and their one-bit variants, are dealt by variant, and the sorted buckets
    stream past ``forest``. Beside the variant a row carries only what it lacks: the block and the flipped place.
    """
    spark, fp = fps.sparkSession, F.col("fp")
    parts = []
    for j in range(BLOCKS):
        low = fp.bitwiseAND(F.lit((1 << WIDTH * j) - 1).cast("long")) if j else F.lit(0).cast("long")
        high = F.shiftleft(F.shiftrightunsigned(fp, WIDTH * (j + 1)), WIDTH * j) if j < BLOCKS - 1 else F.lit(0).cast("long")
        out = F.shiftrightunsigned(fp, WIDTH * j).bitwiseAND(F.lit((1 << WIDTH) - 1).cast("long"))
        parts.append(F.struct(low.bitwiseOR(high).bitwiseOR(F.lit(j << BITS).cast("long")).alias("part"), out.cast("int").alias("out")))
    flips = F.array(*[F.struct(F.lit(1 << i if i < BITS else 0).cast("long").alias("bit"), F.lit(i << WIDTH).alias("place")) for i in (*range(BITS), NO_FLIP)])
    # The fingerprints are few bytes but many keys: adaptive execution must not gather them in a few tasks. It would, if
    # they were dealt by ``fp`` itself: the shuffle of a distinct before would do for both.
    dealt = fps.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("fp")).select(F.explode(F.array(*parts)).alias("x"))
    emitted = dealt.select("x.part", "x.out", F.explode(flips).alias("flip")).select(F.col("part").bitwiseXOR(F.col("flip.bit")).alias("key"), F.col("out").bitwiseOR(F.col("flip.place")).alias("rest"))
    met = emitted.repartition("key").sortWithinPartitions("key", "rest")
    return map_arrow(met, _meet(3), "a long, b long").distinct()


def near_fingerprints(fps: DataFrame) -> DataFrame:
    """Links of at most ``FAR`` bits among distinct fingerprints, all of five bits or fewer and many beyond, as trees.

    It differs from ``link_fingerprints`` in the parts: two of the four blocks.
    """
    spark, fp = fps.sparkSession, F.col("fp")

    def blocks_of(i: int, j: int) -> Column:
        a, b = (F.shiftrightunsigned(fp, WIDTH * x).bitwiseAND(F.lit((1 << WIDTH) - 1).cast("long")) for x in (i, j))
        return a.bitwiseOR(F.shiftleft(b, WIDTH))

    parts = [F.struct(blocks_of(*two).bitwiseOR(F.lit(n << 2 * WIDTH).cast("long")).alias("part"), blocks_of(*others).alias("out")) for n, (two, others) in enumerate(zip(TWO, reversed(TWO), strict=True))]
    flips = F.array(*[F.struct(F.lit(1 << i if i < 2 * WIDTH else 0).cast("long").alias("bit"), F.lit(i << 2 * WIDTH).cast("long").alias("place")) for i in (*range(2 * WIDTH), NO_FLIP)])
    dealt = fps.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("fp")).select(F.explode(F.array(*parts)).alias("x"))
    emitted = dealt.select("x.part", "x.out", F.explode(flips).alias("flip")).select(F.col("part").bitwiseXOR(F.col("flip.bit")).alias("key"), F.col("out").bitwiseOR(F.col("flip.place")).alias("rest"))
    met = emitted.repartition("key").sortWithinPartitions("key", "rest")
    return map_arrow(met, _meet(FAR, rebuilt_of_two), "a long, b long").distinct()


def group_by_fingerprint(marked: DataFrame, links: DataFrame) -> DataFrame:
    """``fp, component_id``: the smallest key of all rows whose fingerprints are linked, directly or in steps.

    ``marked`` has ``key, fp``. Null keys come last: a group of null keys only has the id null.
    """
    first = written(marked.groupBy("fp").agg(F.min("key").alias("low")))
    linked = written(components(links).join(first.withColumnRenamed("fp", "node"), "node"))
    low = written(linked.groupBy("root").agg(F.min("low").alias("component_id")))
    placed = linked.join(low, "root").select(F.col("node").alias("fp"), "component_id")
    return written(first.join(placed.withColumnRenamed("component_id", "joined"), "fp", "left").select("fp", F.coalesce("joined", "low").alias("component_id")))


def simhash_components(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """``key, fingerprint, component_id`` for every row: groups of fingerprints within three bits, over whole texts.

    Null and blank texts have fingerprint zero, which links like any other. Repeated rows come back as often as they
    went in. An empty table gives an empty result. Other columns are not read.
    """
    marked = written(fingerprints(docs, F.col(key), F.col(text), words))
    links = link_fingerprints(marked.select("fp").distinct())
    return marked.join(group_by_fingerprint(marked, links), "fp").select(F.col("key").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


HEAVY = 100_000  # shingles at most that stand last in the order because many texts have them; only speed depends on it


def prefix_size(n: int, similarity: float) -> int:
    """How many of the first of ``n`` shingles suffice: a text that shares none of them can't be as alike as asked."""
    return n - math.ceil(similarity * n - 1e-9) + 1 if n else 0


def _prefixes(words: int, similarity: float, heavy: np.ndarray):
    """``key, fp, n, sim, prefix`` of each text. A task gives SimHash and prefix of one set of shingles once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        cache = WordHashes()
        for batch in batches:
            fps, sizes, sims, prefixes = [], [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                found = shingle_set(text, words, cache)
                fps.append(set_id(found))
                sizes.append(len(found))
                if fps[-1] in seen:
                    sims.append(None)
                    prefixes.append(found[:0])
                    continue
                if len(seen) > 1 << 20:
                    seen.clear()
                seen.add(fps[-1])
                sims.append(int(np.uint64(majority(found)).view(np.int64)))
                last = np.isin(found, heavy, assume_unique=True)
                prefixes.append(np.concatenate((found[~last], found[last]))[: prefix_size(len(found), similarity)])
            ends = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
            flat = np.concatenate([np.empty(0, np.uint64), *prefixes]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64()), pa.array(sizes, pa.int32()), pa.array(sims, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["key", "fp", "n", "sim", "prefix"])

    return run


def set_id(shingles: np.ndarray) -> int:
    """A signed 64-bit hash of a whole set of shingles, sorted; equal sets have one id."""
    return int(np.uint64(xxh64_intdigest(shingles.tobytes(), SEED)).view(np.int64))


def _sets(words: int):
    """``fp, shingles`` of each text; of texts with a second column only those whose id that lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            found = [shingle_set(t, words, cache) for t in batch.column(0).cast(pa.binary()).to_pylist()]
            fps = [set_id(x) for x in found]
            if batch.num_columns > 1:
                asked = batch.column(1).to_pylist()
                held = [(f, x) for f, x, wanted in zip(fps, found, asked, strict=True) if f in wanted]
                fps, found = [f for f, _ in held], [x for _, x in held]
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            flat = np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(fps, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["fp", "shingles"])

    return run


def _heavy(slim: DataFrame, words: int) -> np.ndarray:
    """Shingles that several of a sixteenth of the texts have, by hash; at most ``HEAVY``, the most frequent ones."""
    drawn = map_arrow(slim.where(F.pmod(F.xxhash64("text"), F.lit(16)) == 0).select("text"), _sets(words), "fp long, shingles array<long>")
    counts = drawn.select(F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("n")).where("n >= 3")
    return np.sort(np.array([r.s for r in counts.orderBy(F.desc("n"), "s").limit(HEAVY).select("s").collect()], np.int64).view(np.uint64))


def _possible(n: np.ndarray, pos: np.ndarray, m: int, at: int, similarity: float) -> np.ndarray:
    """Which texts of ``n`` shingles can be alike to one of ``m``, if the shingle at these places is the first they share."""
    room = 1 + np.minimum(n - pos - 1, m - at - 1)
    return room >= similarity / (1 + similarity) * (n + m) - 1e-6


def _runs(batches: Iterator[pa.RecordBatch], runs) -> Iterator[list[np.ndarray]]:
    """``runs(cols, starts, sizes)`` over many keys at once, from batches sorted by key; a key's rows may span batches.

    Repeats of the first two columns and keys of a single row are left out.
    """
    held: list[list[np.ndarray]] = []

    def cut(end: bool):
        nonlocal held
        cols = [np.concatenate(x) for x in zip(*held, strict=True)]
        stop = len(cols[0]) if end else int(np.searchsorted(cols[0], cols[0][-1]))
        held = [[c[stop:] for c in cols]]
        cols = [c[:stop] for c in cols]
        fresh = np.concatenate(([True], (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])))
        key = cols[0][fresh]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        many = ~(new & np.append(new[1:], True))
        cols, new = [c[fresh][many] for c in cols], new[many]
        if len(new):
            starts = np.flatnonzero(new)
            yield from runs(cols, starts, np.diff(np.append(starts, len(new))))

    for batch in batches:
        if batch.num_rows:
            held.append([c.to_numpy() for c in batch.columns])
            if held[0][0][0] != held[-1][0][-1]:
                yield from cut(end=False)
    if held and sum(len(x[0]) for x in held):
        yield from cut(end=True)


def _packed(rows: Iterator[list[np.ndarray]], names: list[str]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += len(row[0])
        if n > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names=names)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names=names)


def _trees(similarity: float):
    """First round of the rest: pairs that join all texts of a bucket that can be alike, fewer than it has texts (``kind`` 0).

    Texts of one ``root`` are joined already, so they are no pair, and a bucket that has one root only gives nothing. The
    pairs are not verified yet, so the rows of a bucket of more than two texts come out as well, for the second round
    (``kind`` 1, with the bucket's key as ``a`` and the text as ``b``).
    """

    def pairs(a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
        none = np.zeros(len(a), np.int32)
        return [none.astype(np.int8), a, b, none, none]

    def runs(cols: list[np.ndarray], starts: np.ndarray, sizes: np.ndarray) -> Iterator[list[np.ndarray]]:
        several = np.minimum.reduceat(cols[4], starts) != np.maximum.reduceat(cols[4], starts)
        if not several.any():
            return
        key, fp, n, pos, root = (c[np.repeat(several, sizes)] for c in cols)
        sizes = sizes[several]
        starts = np.cumsum(sizes) - sizes
        first = np.repeat(starts, sizes)
        joined = root == root[first]
        good = _possible(n, pos, n[first], pos[first], similarity) & ~joined
        star = np.add.reduceat((good | joined).astype(np.int64), starts) == sizes  # all can be alike to the first
        take = good & np.repeat(star | (sizes == 2), sizes)
        yield pairs(fp[first[take]], fp[take])
        rest = np.repeat(sizes > 2, sizes)
        yield [np.ones(int(rest.sum()), np.int8), key[rest], fp[rest], n[rest], pos[rest]]
        for at, k in zip(starts[~star & (sizes > 2)].tolist(), sizes[~star & (sizes > 2)].tolist(), strict=True):
            left = np.arange(at, at + k)
            while len(left) > 1:
                queue, left = [left[0]], left[1:]
                while queue and len(left):
                    top = queue.pop()
                    near = _possible(n[left], pos[left], n[top], pos[top], similarity) | (root[left] == root[top])
                    reached, left = left[near], left[~near]
                    queue += reached.tolist()
                    reached = reached[root[reached] != root[top]]
                    if len(reached):
                        yield pairs(np.full(len(reached), fp[top]), fp[reached])

    def ordered(rows: Iterator[list[np.ndarray]]) -> Iterator[list[np.ndarray]]:
        for kind, a, b, n, pos in rows:
            swap = (kind == 0) & (a > b)
            yield [kind, np.where(swap, b, a), np.where(swap, a, b), n, pos]

    return lambda batches: _packed(ordered(_runs(batches, runs)), ["kind", "a", "b", "n", "pos"])


SPLIT = 4096  # rows of a bucket that are compared in one task; a larger bucket comes in blocks of two parts


def blocks(rows: DataFrame) -> DataFrame:
    """``block, fp, n, pos, root, side``: rows of buckets ``shingle``, those of a large bucket once for each of its parts.

    A block has the rows of two parts, told apart by ``side`` 0 and 1, or of one (2), so each pair of a bucket is in one.
    """
    sizes = written(rows.groupBy("shingle").agg(F.count("*").alias("k")).where(F.col("k") > SPLIT).select("shingle", F.ceil(F.col("k") / SPLIT).cast("int").alias("parts")))
    cut = rows.join(sizes, "shingle", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    met = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    side = F.when(F.col("part") == F.col("other"), 2).otherwise((F.col("part") > F.col("other")).cast("int"))
    # Two blocks of one hash would only compare more.
    block = F.when(F.col("parts") == 1, F.col("shingle")).otherwise(F.xxhash64("shingle", F.least("part", "other"), F.greatest("part", "other")))
    return met.select(block.alias("block"), "fp", "n", "pos", "root", side.cast("byte").alias("side"))


def _rest(similarity: float):
    """Second round of the rest: all pairs of a block that can be alike, aren't in one group yet and aren't both on side 0 or 1."""

    def runs(cols: list[np.ndarray], starts: np.ndarray, sizes: np.ndarray) -> Iterator[list[np.ndarray]]:
        mixed = np.minimum.reduceat(cols[4], starts) != np.maximum.reduceat(cols[4], starts)
        for at, k in zip(starts[mixed].tolist(), sizes[mixed].tolist(), strict=True):
            order = np.argsort(cols[4][at : at + k], kind="stable") + at
            fp, n, pos, root, side = (c[order] for c in cols[1:])
            after = np.searchsorted(root, root, side="right")
            for i in np.flatnonzero(after < k).tolist():
                m = int(after[i])
                near = np.flatnonzero(_possible(n[m:], pos[m:], n[i], pos[i], similarity) & ((side[m:] != side[i]) | (side[i] == 2))) + m
                if len(near):
                    yield [np.minimum(fp[near], fp[i]), np.maximum(fp[near], fp[i])]

    return lambda batches: _packed(_runs(batches, runs), ["a", "b"])


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``a, b`` whose sets of shingles have at least this Jaccard similarity, counted exactly."""
    left = sets.select(F.col("fp").alias("a"), F.col("shingles").alias("a_set"))
    right = sets.select(F.col("fp").alias("b"), F.col("shingles").alias("b_set"))
    both = F.size(F.array_intersect("a_set", "b_set"))
    joined = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b")
    return joined.where(both / (F.size("a_set") + F.size("b_set") - both) >= similarity).select("a", "b")


PLACES = 22  # bits of a key's place in the map of wanted keys: half a megabyte, whatever the table's size


def _wanted_only(keys: DataFrame):
    """Lets pass the rows whose place is that of a wanted key, and few others: a map of bits, of a fixed size."""
    place = F.pmod(F.xxhash64("key"), F.lit(1 << PLACES)) + 1
    maps = keys.select(place.alias("p")).groupBy(F.expr("bitmap_bucket_number(p)").alias("part")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("bits"))
    there = np.zeros(1 << PLACES, bool)
    for row in maps.collect():
        bits = np.unpackbits(np.frombuffer(row.bits, np.uint8), bitorder="little")
        there[(row.part - 1) * len(bits) : row.part * len(bits)] = bits
    packed = np.packbits(there)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(packed).astype(bool)
        for batch in batches:
            yield batch.filter(pa.array(known[batch.column(0).to_numpy() - 1])).drop_columns(["place"])

    return place.alias("place"), run


def sets_of(slim: DataFrame, first: DataFrame, pairs: DataFrame, words: int) -> Table:
    """``fp, shingles``: the sets of the texts that ``pairs`` name, each once. ``first`` has the key whose text has a set.

    Only texts whose keys may be wanted are shuffled. A key comes with the sets that are wanted from its texts, and each set
    is wanted from one key.
    """
    needed = pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).distinct()
    keys = written(first.join(needed.hint("merge"), "fp", "left_semi").groupBy("key").agg(F.collect_set("fp").alias("wanted")))
    place, run = _wanted_only(keys)
    kind = slim.schema["key"].dataType.simpleString()
    near = map_arrow(slim.select(place, "key", "text"), run, f"key {kind}, text string")
    texts = near.join(keys.hint("merge"), "key").withColumn("text_hash", F.xxhash64("text")).dropDuplicates(["key", "text_hash"]).select("text", "wanted")
    return Table(map_arrow(texts, _sets(words), "fp long, shingles array<long>"))


def ball_pairs(first: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of sets of shingles whose SimHashes meet (see ``near_fingerprints``), as trees that join all of them.

    ``first`` has ``fp, sim`` of each set. Of the sets of one SimHash the smallest stands for the others, which hang on it.
    The pairs are not verified yet.
    """
    low = written(first.groupBy("sim").agg(F.min("fp").alias("low")))
    same = first.join(low.hint("merge"), "sim").where("fp <> low").select(F.col("low").alias("a"), F.col("fp").alias("b"))
    ends = [low.select(F.col("sim").alias(s), F.col("low").alias(f"{s}_set")).hint("merge") for s in ("a", "b")]
    near = near_fingerprints(low.select(F.col("sim").alias("fp"))).join(ends[0], "a").join(ends[1], "b")
    return same.unionByName(near.select(F.least("a_set", "b_set").alias("a"), F.greatest("a_set", "b_set").alias("b")))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``key, component_id`` for every row with a key and a text of words: groups of alike texts, complete and exact.

    Two texts link if the Jaccard similarity of their distinct shingles is at least ``similarity``; shingles are equal
    if their 64-bit hashes are. SimHashes (of the distinct shingles) find most links but can't find all: at 0.8 two of them
    differ in about ten bits. All shingles have one order, and texts that are alike share one among the first fifth of each
    (``prefix_size``), so one shuffle on those brings every pair together that is left. Texts without words (null and empty
    ones) and rows with a null key aren't compared and don't come back. The group's id is its smallest key. Texts of any
    length are compared whole. Repeated rows come back as often. An empty table gives an empty result. Other columns are
    not read.

    Ball hashing comes first: the pairs whose SimHashes meet, of which the verified ones make groups.
    The rest are pairs of different groups, found in two rounds. In the first each bucket gives a tree of pairs, of which
    the verified ones join groups. In the second, a bucket of more than two texts gives all its pairs that no group joins
    yet: a group of k near copies is never k squared pairs, and no link is lost because a pair that stood in for it wasn't
    one.
    """
    slim = parallel(docs.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text")))
    kind = slim.schema["key"].dataType.simpleString()
    every = Table(map_arrow(slim, _prefixes(words, similarity, _heavy(slim, words)), f"key {kind}, fp long, n int, sim long, prefix array<long>").where("n > 0"))
    marked = written(every.df.select("key", "fp"))
    first = written(every.df.groupBy("fp").agg(F.min("key").alias("key"), F.max("sim").alias("sim")))
    tried = written(ball_pairs(first))
    sets = sets_of(slim, first, tried, words)
    links = written(verified(tried, sets.df, similarity))
    sets.drop()
    rooted = every.df.where(F.size("prefix") > 0).join(written(components(links)).withColumnRenamed("node", "fp").hint("merge"), "fp", "left")
    dealt = rooted.select("fp", "n", F.coalesce("root", "fp").alias("root"), F.posexplode("prefix").alias("pos", "shingle")).select("shingle", "fp", "n", "pos", "root").repartition("shingle").sortWithinPartitions("shingle", "fp")
    met = Table(map_arrow(dealt, _trees(similarity), "kind byte, a long, b long, n int, pos int"))
    every.drop()
    pairs = written(met.df.where("kind = 0").select("a", "b").distinct().join(tried.hint("merge"), ["a", "b"], "left_anti"))
    tried = tried.unionByName(pairs)
    open_ = met.df.where("kind = 1").select(F.col("a").alias("shingle"), F.col("b").alias("fp"), "n", "pos")
    sets = sets_of(slim, first, pairs, words)
    links = written(links.unionByName(verified(pairs, sets.df, similarity)))
    sets.drop()
    roots = written(components(links))
    placed = open_.join(roots.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").select("shingle", "fp", "n", "pos", F.coalesce("root", "fp").alias("root"))
    again = blocks(placed).repartition("block").sortWithinPartitions("block", "fp")
    more = written(map_arrow(again, _rest(similarity), "a long, b long").distinct().join(tried.hint("merge"), ["a", "b"], "left_anti"))
    links = written(links.unionByName(verified(more, sets_of(slim, first, more, words).df, similarity)))
    groups = group_by_fingerprint(marked, links)
    return marked.join(groups, "fp").select(F.col("key").alias(key), "component_id")


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` without those that belong to a group of near duplicates and are not its smallest key.

    Rows with a null key, and texts without words (null and empty ones), stay. Rows of one key are one document: all stay
    or all go. Texts of any length are compared whole. An empty table gives an empty result. Columns of any names pass
    through.
    """
    extra = near_duplicates(docs.select(key, text), key, text, words, similarity).where(F.col(key) != F.col("component_id"))
    # The list grows with the table, so the join always shuffles, also where a small one could be broadcast.
    return docs.join(written(extra.select(key).distinct()).hint("merge"), key, "left_anti").select(*docs.columns)


def op8(spark, sf_dir: str) -> DataFrame:
    return simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
