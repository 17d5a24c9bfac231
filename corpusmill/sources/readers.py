"""Reading sources, manifests, metrics, schema catalogues and NumPy files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType, _parse_datatype_string

from corpusmill.functions.text import nfc
from corpusmill.functions.predicates import length_ok, not_empty
from corpusmill.sources import npy
from corpusmill.sources.registry import SOURCES, TOKENIZER_SOURCES, Source


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def read_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A Parquet table (``path.parquet``) or JSON lines (``path.jsonl``) with the columns of ``schema``, or an error.

    A missing column would read as nulls throughout, which is how wrong field names go unnoticed, so it is refused.
    """
    if exists(spark, f"{path}.parquet"):
        found = spark.read.parquet(f"{path}.parquet")
    elif exists(spark, f"{path}.jsonl"):
        found = spark.read.json(f"{path}.jsonl")
    else:
        raise FileNotFoundError(f"neither {path}.parquet nor {path}.jsonl exists")
    if missing := [f.name for f in schema if f.name not in found.columns]:
        raise ValueError(f"{path} has no column {', '.join(missing)}; it has {', '.join(found.columns)}")
    if not exists(spark, f"{path}.parquet"):  # fields of JSON objects have no order, so they are read by name
        return spark.read.schema(schema).json(f"{path}.jsonl")
    return found.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in schema])


def documents_of(spark: SparkSession, base: str, source: Source) -> DataFrame:
    """``source, text`` of the rows that all of the source's filters keep."""
    rows = read_table(spark, f"{base}/{source.path}", source.schema)
    if source.before is not None:
        rows = rows.where(source.before())  # on raw columns, so before the Python step and down to the scan
    texts = nfc(rows.select(source.text().alias("text")).where(not_empty(F.col("text"))), "text").where(length_ok(F.col("text")))
    if source.keep is not None:
        texts = texts.where(source.keep(F.col("text")))
    return texts.select(F.lit(source.name).alias("source"), "text")


def load_all(spark: SparkSession, base: str, names=tuple(SOURCES)) -> tuple[dict[str, DataFrame], DataFrame]:
    """All sources that can be loaded, and ``source, error`` for those that can't and are skipped."""
    found, skipped = {}, []
    for name in names:
        try:
            found[name] = documents_of(spark, base, SOURCES[name])
        except (FileNotFoundError, ValueError, AnalysisException) as e:
            skipped.append((name, str(e).splitlines()[0]))
    return found, spark.createDataFrame(skipped, "source string, error string")


def tokenizer_texts(spark: SparkSession, base: str, name: str) -> DataFrame:
    """Stripped texts for tokenizer training, without empty ones."""
    from corpusmill.functions.extract import field_or_all
    from corpusmill.functions.text import strip

    path, schema, field, _ = TOKENIZER_SOURCES[name]
    texts = read_table(spark, f"{base}/{path}", schema).select(field_or_all(schema, field).alias("text"))
    return nfc(texts, "text").select(strip(F.col("text")).alias("text")).where(F.col("text") != "")


def sql_queries(rows: DataFrame, limit: int | None, key: str, fields=("query", "sql", "question")) -> DataFrame:
    """``query``: the first of the fields that is a text and not empty, of the first ``limit`` rows by key that have one."""
    kinds = {f.name: f.dataType for f in rows.schema}
    texts = [F.nullif(F.col(f), F.lit("")) for f in fields if isinstance(kinds.get(f), StringType)]
    if not texts:
        return rows.select(key, F.lit(None).cast("string").alias("query")).where("false")
    return first_rows(rows.select(key, F.coalesce(*texts).alias("query")).where(F.col("query").isNotNull()), key, limit)


def first_rows(rows: DataFrame, key: str, limit: int | None) -> DataFrame:
    """The first rows by key, for trials; all without a limit."""
    return rows if limit is None else rows.orderBy(key).limit(limit)


def in_file_order(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A table with ``row_no``, which rises in the order of its files and rows."""
    return read_table(spark, path, schema).withColumn("row_no", F.monotonically_increasing_id())


def reference_queries(spark: SparkSession, base: str, limit: int | None = 7000) -> tuple[str, DataFrame]:
    """The SQL texts that tokenizers are compared on, and the source they are from: ``spider_examples``, or where that can't
    be read or has none, the answers of ``sql_create_context``. ``row_no, query``, the first ``limit`` rows."""
    path = f"{base}/spider_examples"
    try:
        raw = spark.read.parquet(f"{path}.parquet") if exists(spark, f"{path}.parquet") else spark.read.json(f"{path}.jsonl")
        found = sql_queries(raw.withColumn("row_no", F.monotonically_increasing_id()), limit, "row_no")
        if not found.isEmpty():
            return "spider_examples", found
    except AnalysisException:  # not there
        pass
    other = in_file_order(spark, f"{base}/sql_create_context", SOURCES["sql_create_context"].schema)
    return "sql_create_context", sql_queries(other, limit, "row_no", ("answer",))


#: Held-out sets that predictions are made for, with the columns that their evaluation needs.
EVALUATION_SETS = {
    "gretelai_test": "sql_context string, sql_prompt string, sql string",
    "wikisql_test": "question string, sql struct<human_readable: string>, table struct<id: string, header: array<string>, types: array<string>>",
    "spider_validation": "question string, query string, db_id string",
}


def evaluation_set(spark: SparkSession, base: str, name: str, limit: int | None = None) -> DataFrame:
    """A held-out set below ``base`` with ``row_no``; with ``limit`` its first rows, for trials."""
    return first_rows(in_file_order(spark, f"{base}/{name}", _parse_datatype_string(EVALUATION_SETS[name])), "row_no", limit)


MANIFEST = "vocab_size int, sequence_length int, total_train_tokens bigint, total_sources int, tokenizer_hash string, created string, sources map<string, struct<train: struct<path: string, shape: array<bigint>, tokens: bigint, sequences: bigint, content_hash: string>, val: struct<path: string, shape: array<bigint>, tokens: bigint, sequences: bigint, content_hash: string>, token_budget: bigint, target_proportion: double, actual_proportion: double>>"
METRICS = "step bigint, kind string, loss double, grad_norm double, lr double"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).option("multiLine", True).json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; blank lines are skipped, and any kind of record is accepted."""
    return spark.read.schema(METRICS).json(path).where("step IS NOT NULL")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


CATALOGUE = "db_id string, table_names_original array<string>, column_names_original array<array<string>>, column_types array<string>"


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of databases; the mixed pairs of table index and column name become structs."""
    raw = spark.read.schema(CATALOGUE).option("multiLine", True).json(path)
    pairs = F.transform("column_names_original", lambda p: F.struct(p[0].cast("int").alias("tbl"), p[1].alias("col")))
    return raw.withColumn("column_names_original", pairs)


def read_npy(spark: SparkSession, path: str, rows: int = 65_536) -> DataFrame:
    """``path, row, tokens`` of two-dimensional NumPy files of 16-bit integers; a task reads at most ``rows`` of a file."""
    npy.register(spark)
    return spark.read.format("npy").option("rows", rows).load(path)
