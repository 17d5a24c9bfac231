"""Packing documents end to end into rows of fixed length, and splitting these into train and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.constants import BOS, END_SQL, EOS, PAD, SCHEMA, SEED, SEQUENCE_LENGTH, VAL_PERCENT
from corpusmill.operators.prefix import exclusive_sum, hash_rank
from corpusmill.scratch import written


def wrap(docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Tokens between the begin and end marks."""
    return docs.withColumn(tokens, wrapped(F.col(tokens)))


def wrapped(tokens: Column) -> Column:
    mark = lambda i: F.array(F.lit(i).cast("smallint"))
    return F.concat(mark(BOS), tokens.cast("array<smallint>"), mark(EOS))


def pack(docs: DataFrame, by: list[str], order: list[str], length: int = SEQUENCE_LENGTH, tokens: str = "tokens", sizes: DataFrame | None = None) -> DataFrame:
    """``by, seq_id, tokens``: the groups' tokens in order, cut into rows of ``length``; an unfinished last row is dropped.

    ``sizes`` is as in ``pieces``.
    """
    return joined(pieces(docs, by, order, length, tokens, sizes), [*by, "seq_id"])


def joined(parts: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, tokens``: the rows that ``pieces`` make up. Parts that are dealt by ranges of ``keys`` are not dealt again."""
    packed = parts.groupBy(*keys).agg(F.sort_array(F.collect_list("p")).alias("ps"))
    return packed.select(*keys, F.flatten(F.col("ps.piece")).cast("array<smallint>").alias("tokens"))


def pieces(docs: DataFrame, by: list[str], order: list[str], length: int = SEQUENCE_LENGTH, tokens: str = "tokens", sizes: DataFrame | None = None, late: Column | None = None) -> DataFrame:
    """``by, seq_id, p``: what each document gives to each full row of its group, and at which place (``at, piece``).

    Where a document starts follows from the sizes before it, so each document is cut where it stands and only the
    pieces travel to their sequences. ``sizes`` has ``by``, ``order`` and ``n``, the tokens of each document: with it, a
    tokenizer behind ``docs`` runs once; without it, pass ``docs`` from a written table. With ``late``, which makes the
    tokens from columns of ``docs``, documents have their number of tokens as ``n`` and get the tokens when they are
    placed, so that texts travel to their places, which are half the size of their bytes' ids.
    """
    sized = docs.withColumn("_n", (F.size(tokens) if late is None else F.col("n")).cast("long")).where("_n > 0")
    slim = sized.select(*by, *order, "_n") if sizes is None else sizes.select(*by, *order, F.col("n").cast("long").alias("_n")).where("_n > 0")
    placed = exclusive_sum(sized, by, order, "_n", "_start", slim=slim)
    # Rows that belong to the dropped tail never enter the shuffle.
    # They are written, so that the plan knows how few groups are and doesn't deal whole documents by them.
    ends = written(slim.groupBy(*by).agg(F.expr(f"sum(_n) div {length}").alias("_full")).where("_full > 0"))
    last = F.least(F.expr(f"(_start + _n - 1) div {length}"), F.col("_full") - 1)
    first = F.expr(f"_start div {length}")
    placed = placed.join(ends, by).where(first < F.col("_full"))
    placed = placed if late is None else placed.withColumn(tokens, late)
    spread = placed.withColumn("seq_id", F.explode(F.sequence(first, last)))
    low = F.greatest(F.col("seq_id") * length, F.col("_start"))
    high = F.least((F.col("seq_id") + 1) * length, F.col("_start") + F.col("_n"))
    piece = F.slice(tokens, (low - F.col("_start") + 1).cast("int"), (high - low).cast("int"))
    return spread.select(*by, "seq_id", F.struct(low.alias("at"), piece.alias("piece")).alias("p"))


def packed_counts(docs: DataFrame, by: list[str], size: str, length: int = SEQUENCE_LENGTH) -> DataFrame:
    """How many full rows each group packs to, without packing: ``by, sequences, tokens``."""
    sums = docs.groupBy(*by).agg(F.sum(size).alias("_n"))
    return sums.select(*by, F.expr(f"_n div {length}").alias("sequences"), F.expr(f"_n div {length} * {length}").alias("tokens"))


def train_val_split(packed: DataFrame, by: list[str], row: str = "seq_id", seed: int = SEED, percent: int = VAL_PERCENT) -> DataFrame:
    """Adds ``split`` and ``position``: by a seeded hash order, the first percent (one row at least) is validation.

    ``position`` is the row's place in that order, from 1.
    """
    digest = split_digest(by, row, seed)
    ids = packed.select(*by, row)
    ranked = hash_rank(ids.withColumn("_digest", digest), by, "_digest", [row], "position").drop("_digest")
    counts = ids.groupBy(*by).agg(F.greatest(F.lit(1), F.expr(f"count(*) * {percent} div 100")).alias("_val"))
    placed = ranked.join(counts, by).withColumn("split", F.when(F.col("position") <= F.col("_val"), "val").otherwise("train")).drop("_val")
    return placed if set(packed.columns) == {*by, row} else packed.join(placed, [*by, row])


def split_digest(by: list[str], row: str, seed: int) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in [*by, row]]), 256)


def split_cuts(placed: DataFrame, by: list[str], row: str = "seq_id", seed: int = SEED) -> DataFrame:
    """``by, last``: the last validation row of each group in the order of ``train_val_split``, of whose result these are."""
    return placed.where("split = 'val'").groupBy(*by).agg(F.max(F.struct(split_digest(by, row, seed).alias("digest"), F.col(row).alias("row"))).alias("last"))


def with_split(rows: DataFrame, cuts: DataFrame, by: list[str], row: str = "seq_id", seed: int = SEED) -> DataFrame:
    """``rows`` with the ``split`` that ``train_val_split`` gives them, told from a row of each group: nothing is dealt.

    Pass ``cuts`` from a written table.
    """
    at = F.struct(split_digest(by, row, seed).alias("digest"), F.col(row).alias("row"))
    return rows.join(cuts, by).withColumn("split", F.when(at <= F.col("last"), "val").otherwise("train")).drop("last")


RANGE = 1024  # sequences of a range, and hashes of a hash above
FACTS = ("n_tokens", "low", "high", "bos", "pad", "delimiters", "inner_bos", "bad_bos", "digest")


def row_facts(packed: DataFrame) -> DataFrame:
    """``packed`` with what checks and manifest need of each sequence: slim columns that stand for its tokens.

    ``digest`` is the SHA-256 of the ids, the others count ids; ``bad_bos`` counts begin marks inside that follow no end mark.
    """
    t, listed = F.col("tokens"), F.concat(F.lit(","), F.array_join(F.col("tokens").cast("array<string>"), ","), F.lit(","))
    has = lambda ids: F.regexp_count("_listed", F.lit(f",{ids}(?=,)"))
    inner = F.col("bos") - (F.get(t, F.lit(0)) == BOS).cast("int")
    counted = packed.withColumn("_listed", listed).withColumns(
        {"n_tokens": F.size(t), "low": F.array_min(t).cast("int"), "high": F.array_max(t).cast("int"), "bos": has(BOS), "pad": has(PAD), "delimiters": has(f"[{SCHEMA}-{END_SQL}]"), "digest": F.sha2("_listed", 256)}
    )
    return counted.withColumn("inner_bos", F.coalesce(inner, F.lit(0))).withColumn("bad_bos", F.col("inner_bos") - has(f"{EOS},{BOS}")).drop("_listed")


def with_facts(packed: DataFrame) -> DataFrame:
    """``packed`` with its facts: those that it has, or else new ones."""
    return packed if set(FACTS) <= set(packed.columns) else row_facts(packed)


def content_ranges(packed: DataFrame) -> DataFrame:
    """``source, split, range, rows, sha256``: a hash of each range of ``RANGE`` following ``seq_id``.

    It covers numbers, contents and how often a sequence is there, and depends on no order of rows or files. Repeated
    sequences are counted first, so a range has few rows whatever a broken corpus holds.
    """
    same = with_facts(packed).groupBy("source", "split", "seq_id", "digest").agg(F.count("*").alias("n"))
    row = F.concat_ws(":", F.format_string("%020d", F.col("seq_id")), "digest", F.col("n").cast("string"))
    ranges = same.groupBy("source", "split", F.expr(f"seq_id div {RANGE}").alias("range"))
    return ranges.agg(F.sum("n").alias("rows"), F.sha2(F.array_join(F.array_sort(F.collect_list(row)), "\n"), 256).alias("sha256"))


def content_roots(ranges: DataFrame) -> DataFrame:
    """``source, split, sequences, content_hash``: the root of a tree of hashes over the ranges, three levels for any size."""
    level = ranges.withColumnRenamed("range", "node")
    for _ in range(3):
        child = F.concat_ws(":", F.format_string("%020d", F.col("node")), "sha256")
        level = level.groupBy("source", "split", F.expr(f"node div {RANGE}").alias("node")).agg(F.sum("rows").alias("rows"), F.sha2(F.array_join(F.array_sort(F.collect_list(child)), "\n"), 256).alias("sha256"))
    # Three levels of 1,024 take in 2 ** 40 sequences of a split.
    return level.select("source", "split", F.col("rows").alias("sequences"), F.col("sha256").alias("content_hash"))


def build_summary(packed: DataFrame) -> DataFrame:
    """``source, split, sequences, content_hash``: the hash doesn't depend on the rows' order or on files."""
    return content_roots(content_ranges(packed))


def with_missing(registry: DataFrame, counts: DataFrame) -> DataFrame:
    """All registered sources; those without output have 0 sequences."""
    return registry.select("source").join(counts, "source", "left").na.fill(0)
