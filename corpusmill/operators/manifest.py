"""The manifest of a packed corpus, and the checks of a finished one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.constants import PROPORTION_TOLERANCE, RATE_CEILING, SEQUENCE_LENGTH, VOCAB_SIZE
from corpusmill.operators.packing import FACTS, content_ranges, content_roots, row_facts, with_facts
from corpusmill.scratch import written


def split_counts(packed: DataFrame, length: int = SEQUENCE_LENGTH, ranges: DataFrame | None = None) -> DataFrame:
    """``source``, and for each split ``..._sequences``, ``..._tokens`` and ``..._hash``; from ``content_ranges`` if given."""
    summary = content_roots(content_ranges(packed) if ranges is None else ranges)
    rows = summary.groupBy("source").pivot("split", ["train", "val"]).agg(F.sum("sequences").alias("sequences"), F.max("content_hash").alias("hash"))
    for s in ("train", "val"):
        rows = rows.withColumn(f"{s}_sequences", F.coalesce(f"{s}_sequences", F.lit(0))).withColumn(f"{s}_tokens", F.col(f"{s}_sequences") * length)
    return rows


def proportions(counts: DataFrame, registry: DataFrame) -> DataFrame:
    """``counts`` beside budgets and targets; the shares of train tokens have six digits, and are 0 without any."""
    total = "sum(train_tokens) OVER ()"
    return counts.join(registry.select("source", "token_budget", "target_proportion"), "source").withColumn("actual_proportion", F.expr(f"CASE WHEN {total} = 0 THEN 0D ELSE round(train_tokens / {total}, 6) END")).withColumn("target_proportion", F.round("target_proportion", 6))


def missing_sources(registry: DataFrame, packed: DataFrame) -> DataFrame:
    return registry.select("source").join(packed.select("source").distinct(), "source", "left_anti")


def manifest(packed: DataFrame, registry: DataFrame, tokenizer_hash: str = "unknown", created: str | None = None, length: int = SEQUENCE_LENGTH, vocab: int = VOCAB_SIZE, ranges: DataFrame | None = None) -> DataFrame:
    """The manifest as one nested row. It has one map entry for each source."""
    rows = proportions(split_counts(packed, length, ranges), registry)
    part = lambda s: F.struct(F.concat(F.lit("source="), "source", F.lit(f"/split={s}")).alias("path"), F.array(F.col(f"{s}_sequences"), F.lit(length).cast("long")).alias("shape"), F.col(f"{s}_tokens").alias("tokens"), F.col(f"{s}_sequences").alias("sequences"), F.col(f"{s}_hash").alias("content_hash"))
    entry = F.struct(part("train").alias("train"), part("val").alias("val"), "token_budget", "target_proportion", "actual_proportion")
    at = F.lit(created) if created else F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return rows.agg(F.sum("train_tokens").alias("total_train_tokens"), F.count("*").cast("int").alias("total_sources"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", entry.alias("e"))))).alias("sources")).select(
        F.lit(vocab).alias("vocab_size"), F.lit(length).alias("sequence_length"), "total_train_tokens", "total_sources", F.lit(tokenizer_hash).alias("tokenizer_hash"), at.alias("created"), "sources"
    )


def id_facts(packed: DataFrame, length: int = SEQUENCE_LENGTH) -> DataFrame:
    """For each source and split what the checks of shape, ids and marks need, from the facts of its sequences."""
    count = lambda c: F.sum(F.col(c).cast("long")).alias(c)
    return with_facts(packed).groupBy("source", "split").agg(
        F.count("*").alias("sequences"), count("n_tokens"), F.sum((F.col("n_tokens") != length).cast("long")).alias("wrong_length"), F.min("low").cast("long").alias("low"), F.max("high").cast("long").alias("high"),
        count("bos"), count("pad"), count("delimiters"), count("inner_bos"), count("bad_bos"),
    )


def changed_ranges(now: DataFrame, recorded: DataFrame) -> DataFrame:
    """``source, split, range``: where two tables of ``content_ranges`` differ, in rows, contents or in having the range."""
    key = ["source", "split", "range"]
    then = recorded.select(*key, F.col("rows").alias("_rows"), F.col("sha256").alias("_sha256"))
    differ = ~(F.col("rows").eqNullSafe(F.col("_rows")) & F.col("sha256").eqNullSafe(F.col("_sha256")))
    return now.select(*key, "rows", "sha256").join(then, key, "full").where(differ).select(*key)


def verify(packed: DataFrame, registry: DataFrame, recorded: DataFrame | None = None, plausible: Callable[[DataFrame], DataFrame] | None = None, only: str | None = None, length: int = SEQUENCE_LENGTH, vocab: int = VOCAB_SIZE, ranges: DataFrame | None = None) -> DataFrame:
    """``check, passed, detail`` for every check of a packed corpus, over all of it and not a sample.

    ``recorded`` has ``source, split, sequences, content_hash`` as written at the build, and ``ranges`` the
    ``content_ranges`` of then, which name what differs; ``plausible`` tells ``source, passed`` from decoded rows. A check is
    left out without its argument. ``only`` limits all to one source. Facts are made anew from the tokens; rows without
    tokens must have them.
    """
    if only is not None:
        packed, registry = packed.where(F.col("source") == only), registry.where(F.col("source") == only)
        recorded, ranges = (x.where(F.col("source") == only) if x is not None else None for x in (recorded, ranges))
    # One pass over the tokens; all checks read the slim facts of the sequences.
    slim = written(row_facts(packed).select("source", "split", "seq_id", *FACTS)) if "tokens" in packed.columns else packed
    facts = written(id_facts(slim, length))
    train = facts.where("split = 'train'")
    wanted = registry.select("source", F.explode(F.array(F.lit("train"), F.lit("val"))).alias("split"))
    text = lambda *parts: F.concat_ws(" ", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    rate = lambda c: F.sum(c) / F.sum("n_tokens")
    number = lambda c: F.coalesce(c, F.lit(0)).cast("string")

    def one(df: DataFrame, name: str, passed: Column, detail: Column) -> DataFrame:
        return df.agg(passed.alias("passed"), detail.alias("detail")).select(F.lit(name).alias("check"), F.coalesce("passed", F.lit(False)).alias("passed"), "detail")

    shares = train.groupBy("source").agg(F.sum("n_tokens").alias("train_tokens")).withColumn("share", F.expr("train_tokens / sum(train_tokens) OVER ()"))
    targets = registry.withColumn("target", F.expr("target_proportion / sum(target_proportion) OVER ()")) if only is not None else registry.withColumnRenamed("target_proportion", "target")
    off = targets.join(shares, "source").withColumn("off", F.abs(F.col("share") - F.col("target"))).withColumn("relative", F.col("off") / F.col("target"))
    checks = [
        one(wanted.join(facts, ["source", "split"], "left_anti"), "files", F.count("*") == 0, text(number(F.count("*")), "missing")),
        one(facts, "shape", F.sum("wrong_length") == 0, text(number(F.sum("wrong_length")), f"rows without {length} tokens")),
        one(facts, "id_range", (F.min("low") >= 0) & (F.max("high") < vocab), text("ids from", number(F.min("low")), "to", number(F.max("high")))),
        one(facts.groupBy("source").agg(F.sum("bos").alias("bos")), "bos_present", F.min(F.when(F.col("bos") > 0, 1).otherwise(0)) == 1, text(number(F.sum("bos")), "begin marks")),
        one(facts, "eos_before_bos", F.sum("bad_bos") <= 0.05 * F.sum("inner_bos"), text(number(F.sum("bad_bos")), "of", number(F.sum("inner_bos")), "inner begin marks follow no end mark")),
        one(train, "pad_rate", rate("pad") <= RATE_CEILING, text(number(F.sum("pad")), "pad ids")),
        one(train, "delimiter_rate", rate("delimiters") <= RATE_CEILING, text(number(F.sum("delimiters")), "delimiter ids")),
        one(off, "proportions", F.max("off") <= PROPORTION_TOLERANCE, text("largest difference", number(F.round(F.max("off"), 6)), "relative", number(F.round(F.max("relative"), 6)))),
    ]
    if plausible is not None:
        checks.append(one(plausible(packed), "plausible", F.bool_and("passed"), text(number(F.sum((~F.col("passed")).cast("int"))), "sources without text")))
    if recorded is not None:
        here = written(content_ranges(slim))
        same = content_roots(here).select("source", "split", F.col("sequences").alias("n_now"), F.col("content_hash").alias("now")).join(recorded, ["source", "split"], "full")
        differ = ~(F.col("now").eqNullSafe(F.col("content_hash")) & F.col("n_now").eqNullSafe(F.col("sequences")))
        found = one(same, "checksums", F.count_if(differ) == 0, text(number(F.count_if(differ)), "differ"))
        if ranges is not None:
            # The first ten places name where to look; there may be as many as ranges.
            places = changed_ranges(here, ranges).orderBy("source", "split", "range").limit(10).agg(F.array_join(F.collect_list(F.concat_ws("/", "source", "split", F.col("range").cast("string"))), ", ").alias("places"))
            found = found.crossJoin(F.broadcast(places)).select("check", (F.col("passed") & (F.col("places") == "")).alias("passed"), F.when(F.col("places") == "", F.col("detail")).otherwise(F.concat("detail", F.lit(": "), "places")).alias("detail"))
        checks.append(found)
    every = checks[0]
    for c in checks[1:]:
        every = every.unionByName(c)
    return every


def all_passed(checks: DataFrame) -> bool:
    return bool(checks.agg(F.bool_and("passed")).first()[0])


def preflight(packed: DataFrame, vocabulary: int, least_tokens: int = 2_000_000_000, batch: int = 8, length: int = SEQUENCE_LENGTH, vocab: int = VOCAB_SIZE) -> DataFrame:
    """Checks before training: the tokenizer's size, the corpus' tokens, and that a batch has the right shape and ids."""
    facts = id_facts(packed.where("split = 'train'"), length).agg(F.sum("n_tokens").alias("tokens"), F.sum("sequences").alias("n"), F.sum("wrong_length").alias("wrong"), F.min("low").alias("low"), F.max("high").alias("high"))
    right = lambda c: F.coalesce(c, F.lit(False))
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("check"), passed.alias("passed"))
            for name, passed in (
                ("tokenizer", F.lit(vocabulary == vocab)),
                ("corpus_size", right(F.col("tokens") > least_tokens)),
                ("batch_shape", right((F.col("n") >= batch) & (F.col("wrong") == 0))),
                ("batch_ids", right((F.col("low") >= 0) & (F.col("high") < vocab))),
            )
        ]
    )
    return facts.select(F.explode(rows).alias("x")).select("x.check", "x.passed")
