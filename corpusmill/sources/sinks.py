"""Writing packed corpora, manifests, text corpora, metrics and NumPy files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators.packing import joined, row_facts
from corpusmill.scratch import dropped_after, written
from corpusmill.sources import npy
from corpusmill.sources.readers import exists


def sources_there(spark: SparkSession, path: str) -> list[str]:
    """The sources below ``path`` that have both splits."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/source=*/split=*")
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target)
    splits = [str(f.getPath()).split("/source=")[-1].split("/split=") for f in found or []]
    return sorted({s for s, k in splits if k == "train"} & {s for s, k in splits if k == "val"})


def write_packed(packed: DataFrame, path: str, force: bool = False) -> list[str]:
    """Packed sequences by source and split; sources that are there already are left alone unless ``force``.

    Returns the sources written. Only their own partitions are replaced. The pass that writes also makes each sequence's
    facts, as slim columns that the manifest reads in place of tokens, and observes which sources it meets. Rows are
    clustered by ``seq_id`` within a partition, so that later reads of some sequences skip files and row groups.
    """
    return _write_placed(row_facts(_absent(packed, path, force)).repartitionByRange(*PLACE), path)


def write_pieces(pieces: DataFrame, path: str, force: bool = False) -> list[str]:
    """The same from ``source, split, seq_id, p``, pieces of sequences: these travel once, to the files of their sequences."""
    return _write_placed(row_facts(joined(_absent(pieces, path, force).repartitionByRange(*PLACE), PLACE)), path)


PLACE = ["source", "split", "seq_id"]


def _absent(rows: DataFrame, path: str, force: bool) -> DataFrame:
    return rows if force else rows.where(~F.col("source").isin(sources_there(rows.sparkSession, path)))


def _write_placed(rows: DataFrame, path: str) -> list[str]:
    seen = Observation()
    placed = rows.sortWithinPartitions(*PLACE)
    placed.observe(seen, F.collect_set("source").alias("sources")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source", "split").parquet(path)
    return sorted(seen.get["sources"])


def write_examples(train: DataFrame, stats: DataFrame, skipped: DataFrame, path: str, length: int) -> DataFrame:
    """An instruction-tuning set as Parquet by split, and ``manifest.json`` beside it; returns the manifest's row.

    The manifest has the examples of each split, the kept and skipped rows of each source, and the sources left out.
    """
    train.write.mode("overwrite").partitionBy("split").parquet(path)
    there = train.sparkSession.read.parquet(path)
    counts = there.groupBy("split").agg(F.count("*").alias("n"))
    pairs = lambda df, k, v: df.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(k, v)))).alias("m"))
    kept = stats.select("source", F.struct("kept", "skipped").alias("rows"))
    # One row each: as many entries as splits and sources.
    row = pairs(counts, "split", "n").withColumnRenamed("m", "examples").crossJoin(pairs(kept, "source", "rows").withColumnRenamed("m", "sources")).crossJoin(pairs(skipped, "source", "error").withColumnRenamed("m", "left_out"))
    row = row.withColumn("max_length", F.lit(length))
    write_manifest(row, f"{path}.manifest.json")
    return row


def write_text_file(spark: SparkSession, path: str, text: str) -> None:
    """A small text to any file system that Spark can write to."""
    write_bytes_file(spark, path, text.encode())


def write_bytes_file(spark: SparkSession, path: str, content: bytes) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def write_manifest(manifest: DataFrame, path: str) -> None:
    """The one row of a manifest as a JSON object."""
    write_text_file(manifest.sparkSession, path, manifest.select(F.to_json(F.struct("*"), {"pretty": "true"})).first()[0] + "\n")


def append_texts(texts: DataFrame, path: str, part: str) -> bool:
    """Lines under ``part=...`` of a text corpus, unless that part is there already. True if it wrote."""
    if exists(texts.sparkSession, f"{path}/part={part}/_SUCCESS"):
        return False
    texts.select(F.col(texts.columns[0]).alias("value")).write.mode("overwrite").text(f"{path}/part={part}")
    return True


def append_metrics(rows: DataFrame, *paths: str) -> None:
    """JSON lines to each of the paths, a local and a remote one, say; the rows are computed once."""
    with dropped_after(rows.sparkSession):
        rows = written(rows) if len(paths) > 1 else rows
        for path in paths:
            rows.write.mode("append").json(path)


def write_npy(packed: DataFrame, path: str, rows: int = 4096, force: bool = False) -> list[str]:
    """NumPy files ``<source>/<split>-<first sequence>.npy`` below ``path``; returns their names.

    A file has the sequences of ``rows`` following ``seq_id``, so a source has as many files as it needs. Tasks write
    their files, and a commit puts them in place; with ``force`` it removes those that were there.
    """
    npy.register(packed.sparkSession)
    dealt = packed.select("source", "split", F.expr(f"seq_id div {rows}").alias("part"), "seq_id", F.col("tokens").cast("array<smallint>").alias("tokens")).repartition("source", "split", "part")
    dealt.sortWithinPartitions("source", "split", "part", "seq_id").write.format("npy").mode("overwrite" if force else "append").save(path)
    return npy.written_names(path)
