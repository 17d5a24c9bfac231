"""The builds from end to end: pretraining corpus, instruction-tuning set, tokenizer."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.constants import FINETUNE_LENGTH, SEED, SEQUENCE_LENGTH
from corpusmill.functions.text import nfc
from corpusmill.operators import budget, finetune, manifest, packing, supplement, tokenizer
from corpusmill.operators.prefix import exclusive_sum
from corpusmill.scratch import dropped_after, written
from corpusmill.sources import readers, sinks
from corpusmill.sources.registry import FINETUNE_SOURCES, SOURCES, TOKENIZER_SOURCES, registry_table


def numbered(df: DataFrame, name: str = "doc_no") -> DataFrame:
    """``df`` with a number in the order of files and rows: stands in for the order of a stream.

    Numbers rise but have gaps, as each partition has its own range of them.
    """
    return df.withColumn(name, F.monotonically_increasing_id())


def ranked_by_content(df: DataFrame, by: list[str], name: str = "doc_no", text: str = "text") -> DataFrame:
    """``by``, ``text`` and numbers from 0 without gaps, in an order that depends on the texts only, so on no partitioning.

    Equal texts are counted first and come out as often again, so copies of one text never meet in one task. Only their
    digests are ranked.
    """
    same = written(df.groupBy(*by, F.sha2(text, 256).alias("_digest")).agg(F.any_value(text).alias(text), F.count("*").alias("_n")))
    # The digest's first 15 digits are a whole number whose ranges hold equally many texts.
    slim = same.select(*by, F.conv(F.substring("_digest", 1, 15), 16, 10).cast("long").alias("_h"), "_digest", "_n")
    placed = exclusive_sum(slim, by, ["_h", "_digest"], "_n", "_first").select(*by, "_digest", "_first")
    numbers = F.sequence(F.col("_first"), F.col("_first") + F.col("_n") - 1)
    return same.join(placed, [*by, "_digest"]).select(*by, text, F.explode(numbers).alias(name))


def build_corpus(docs: DataFrame, ids: Column, budgets: dict[str, int], order: str = "doc_no", length: int = SEQUENCE_LENGTH, split_first: bool = False, seed: int = SEED) -> DataFrame:
    """``source, split, seq_id, position, tokens`` from ``source, <order>, text``.

    Texts are tokenized once and cut to their source's budget, with repeated passes over small sources; then packed and
    split. Repeated passes come before the split, so validation may see a training text; with ``split_first`` documents
    are split before they are repeated instead.
    """
    limits = F.create_map(*[F.lit(x) for pair in budgets.items() for x in pair])
    by = ["source", "split"] if split_first else ["source"]
    # Sums, budgets and packing all read the tokens, so they are written once.
    rows = written(docs.select("source", order, ids.alias("tokens")).withColumn("n", F.size("tokens").cast("long")).where("n > 0"))
    if split_first:
        held = finetune.uniform(F.lit(str(seed)), F.lit("doc"), F.col("source"), F.col(order).cast("string")) < 0.01
        rows = rows.withColumn("split", F.when(held, "val").otherwise("train"))
        share = F.when(F.col("split") == "val", F.lit(0.01)).otherwise(F.lit(0.99))
    else:
        share = F.lit(1.0)
    limited = rows.drop("tokens").withColumn("limit", F.ceil(F.element_at(limits, F.col("source")) * share).cast("long")).where("limit > 0")
    chosen = budget.cycled(limited, by, [order], "n", "limit")
    # The order within a source is that of the passes, and of the documents within each.
    chosen = written(chosen.select(*by, order, F.col("before").alias("_at"), (F.col("n") + 2).alias("n")))
    packed = written(packing.pack(packing.wrap(chosen.drop("n").join(rows.select(*by, order, "tokens"), [*by, order])), by, ["_at", order], length, sizes=chosen))
    if split_first:
        return packed.withColumn("position", F.col("seq_id") + 1).select("source", "split", "seq_id", "position", "tokens")
    return packing.train_val_split(packed, ["source"], seed=seed).select("source", "split", "seq_id", "position", "tokens")


def build_sources(spark: SparkSession, base: str, out: str, bpe: tokenizer.Bpe, names: Iterable[str] = tuple(SOURCES), force: bool = False) -> tuple[list[str], DataFrame]:
    """Reads, filters, tokenizes, packs and writes the named sources below ``base``; what was written, and what skipped."""
    found, skipped = readers.load_all(spark, base, tuple(names))
    encode, done = tokenizer.encoder(bpe), []
    for name, docs in found.items():
        with dropped_after(spark):
            packed = build_corpus(ranked_by_content(docs, ["source"]), encode(F.col("text")), {name: SOURCES[name].token_budget})
            done += sinks.write_packed(packed, out, force)
    return done, skipped


def write_corpus_manifest(spark: SparkSession, out: str, bpe: tokenizer.Bpe) -> DataFrame:
    """Writes ``manifest.json`` and the hashes of ranges beside a built corpus; returns the manifest's row.

    It reads the facts that the corpus was written with, and no tokens.
    """
    slim = spark.read.parquet(out).select("source", "split", "seq_id", *packing.FACTS)
    packing.content_ranges(slim).write.mode("overwrite").parquet(f"{out}.ranges")
    row = manifest.manifest(slim, registry_table(spark), bpe.fingerprint(), ranges=spark.read.parquet(f"{out}.ranges"))
    sinks.write_manifest(row, f"{out}.manifest.json")
    return row


def recorded_hashes(row: DataFrame) -> DataFrame:
    """``source, split, sequences, content_hash`` from a manifest's row."""
    entries = row.select(F.explode("sources").alias("source", "e"))
    both = F.array(*[F.struct(F.lit(s).alias("split"), F.col(f"e.{s}.sequences").alias("sequences"), F.col(f"e.{s}.content_hash").alias("content_hash")) for s in ("train", "val")])
    return entries.select("source", F.explode(both).alias("x")).select("source", "x.split", "x.sequences", "x.content_hash").where("content_hash IS NOT NULL")


def verify_corpus(spark: SparkSession, out: str, bpe: tokenizer.Bpe | None = None, only: str | None = None) -> DataFrame:
    """All checks of a built corpus; with a tokenizer, also that every sequence decodes to text.

    The counts and hashes that the manifest beside the corpus recorded are compared with the rows of now, and the ranges
    that differ are named; without a manifest there is no such check.
    """

    def plausible(packed: DataFrame) -> DataFrame:
        texts = packed.select("source", tokenizer.decoder(bpe)(F.col("tokens")).alias("text"))
        return texts.groupBy("source").agg(F.bool_and(F.col("text").rlike(r"[\p{L}\p{N}]")).alias("passed"))

    path = f"{out}.manifest.json"
    recorded = recorded_hashes(readers.read_manifest(spark, path)) if readers.exists(spark, path) else None
    ranges = spark.read.parquet(f"{out}.ranges") if readers.exists(spark, f"{out}.ranges") else None
    return manifest.verify(spark.read.parquet(out).select("source", "split", "seq_id", "tokens"), registry_table(spark), recorded, plausible if bpe is not None else None, only, ranges=ranges)


def build_finetune(spark: SparkSession, base: str, bpe: tokenizer.Bpe, max_per_source: int | None = None, length: int = FINETUNE_LENGTH, seed: int = SEED, out: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``source, row_key, split, copy_no, digest, tokens, mask``; the kept and skipped rows of each source; the sources
    that couldn't be loaded, with the error. With ``out`` the examples and a manifest are written there as well.

    Texts are brought to normal form C first, as everywhere. Train rows stand in random order when sorted by ``digest``.
    """
    encode, every, left_out = tokenizer.encoder(bpe), None, []
    for name, (path, schema, triple, weight) in FINETUNE_SOURCES.items():
        try:
            rows = readers.read_table(spark, f"{base}/{path}", schema).select(triple().alias("t")).select("t.*")
        except (FileNotFoundError, ValueError, AnalysisException) as e:
            left_out.append((name, str(e).splitlines()[0]))
            continue
        for column in ("schema", "question", "sql"):
            rows = nfc(rows, column)
        keyed = rows.withColumn("row_key", F.sha2(F.concat_ws("\u0001", "schema", "question", "sql"), 256))
        keyed = finetune.capped(keyed, "row_key", max_per_source)
        ids = keyed.select("row_key", F.lit(name).alias("source"), F.lit(weight).alias("weight"), encode("schema").alias("schema_ids"), encode("question").alias("question_ids"), encode("sql").alias("sql_ids"))
        every = ids if every is None else every.unionByName(ids)
    if every is None:
        raise FileNotFoundError(f"no source could be loaded: {left_out}")
    encoded = written(finetune.encode_examples(every, length))
    stats = finetune.kept_and_skipped(encoded)
    copied = finetune.split_and_copy(encoded.where("tokens IS NOT NULL"), F.col("row_key"), F.col("source"), F.col("weight"), seed)
    examples = finetune.shuffled_train(copied, ["source", "row_key", "copy_no"]).select("source", "row_key", "split", "copy_no", "digest", "tokens", "mask")
    skipped = spark.createDataFrame(left_out, "source string, error string")
    if out is not None:
        sinks.write_examples(examples, stats, skipped, out, length)
    return examples, stats, skipped


def tokenizer_corpus(spark: SparkSession, base: str, out: str, names: Iterable[str] = tuple(TOKENIZER_SOURCES)) -> list[str]:
    """Writes the training text of the tokenizer: a sample of each source by characters, then the keyword supplement."""
    done = []
    for name in names:
        texts = ranked_by_content(readers.tokenizer_texts(spark, base, name).withColumn("one", F.lit(0)), ["one"])
        sample = budget.char_sample(texts, ["doc_no"], TOKENIZER_SOURCES[name][3])
        if sinks.append_texts(sample.select("text"), out, name):
            done.append(name)
    if sinks.append_texts(supplement.sentences(spark).select("text"), out, supplement.MARKER):
        done.append(supplement.MARKER)
    return done


def train_tokenizer(spark: SparkSession, corpus: str, vocab: int, min_frequency: int = 3) -> tokenizer.Bpe:
    lines = readers.read_lines(spark, corpus).select(F.col("value").alias("text"))
    return tokenizer.train(tokenizer.pre_token_counts(lines), vocab, min_frequency)
