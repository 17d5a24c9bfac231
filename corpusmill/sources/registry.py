"""The sources: their schemas, how their rows become text, which rows are kept, and how many tokens each may give."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from corpusmill.functions import extract, predicates


def strings(*names: str) -> StructType:
    return StructType([StructField(n, StringType()) for n in names])


@dataclass(frozen=True)
class Source:
    """``before`` filters on raw columns reach the file scan; ``keep`` sees the normalised text, in column ``text``."""

    name: str
    path: str
    schema: StructType
    text: Callable[[], Column]
    token_budget: int
    before: Callable[[], Column] | None = None
    keep: Callable[[Column], Column] | None = None
    gated: bool = False


CODE = strings("content", "max_stars_repo_path", "lang")


def _code(lang: str, budget: int, keep: Callable[[Column], Column] | None, path: Callable[[], Column] | None = None) -> Source:
    """Code files of one language; the language is a partition column where the table has one."""
    rows = (lambda: F.col("lang") == lang) if path is None else (lambda: (F.col("lang") == lang) & path())
    return Source(f"stack_{lang}", "code_files", CODE, lambda: extract.single("content"), budget, rows, keep, True)


#: Token budgets. The order is that of the build, sources without access control first.
SOURCES: dict[str, Source] = {
    s.name: s
    for s in (
        Source("sqale", "sqale", strings("schema", "question", "query"), lambda: extract.joined("schema", "question", "query"), 200_000_000),
        Source("gretelai", "gretelai", strings("sql_context", "sql_prompt", "sql", "sql_explanation"), lambda: extract.joined("sql_context", "sql_prompt", "sql", "sql_explanation"), 100_000_000),
        Source("nstext2sql", "nstext2sql", strings("instruction", "output"), lambda: extract.joined("instruction", "output"), 50_000_000),
        Source("sql_create_context", "sql_create_context", strings("question", "context", "answer"), lambda: extract.joined("question", "context", "answer"), 30_000_000),
        Source("fineweb", "fineweb", strings("text"), lambda: extract.single("text"), 600_000_000),
        Source("oasst", "oasst", strings("text", "role", "lang"), lambda: extract.single("text"), 15_000_000, before=lambda: predicates.first_turns(F.col("role"), F.col("lang"))),
        Source("bird", "bird", strings("schema", "question", "evidence", "SQL"), lambda: extract.joined_present("schema", "question", "evidence", "SQL"), 30_000_000),
        _code("sql", 1_100_000_000, predicates.sql_file),
        _code("markdown", 80_000_000, predicates.markdown_file),
        _code("python", 280_000_000, predicates.python_file),
        _code("ruby", 50_000_000, None, lambda: predicates.path_has(F.col("max_stars_repo_path"))),
    )
}

#: Instruction-tuning sources and how often each row counts, as (schema, question, sql) triples.
FINETUNE_SOURCES: dict[str, tuple[str, StructType, Callable[[], Column], float]] = {
    "bird": ("bird", SOURCES["bird"].schema, lambda: extract.hinted_triple("schema", "question", "evidence", "SQL"), 5.0),
    "nstext2sql": ("nstext2sql", SOURCES["nstext2sql"].schema, lambda: extract.marked_triple("instruction", "output"), 2.0),
    "sql_create_context": ("sql_create_context", SOURCES["sql_create_context"].schema, lambda: extract.plain_triple("context", "question", "answer"), 1.0),
    "gretelai": ("gretelai", SOURCES["gretelai"].schema, lambda: extract.plain_triple("sql_context", "sql_prompt", "sql"), 0.25),
}

#: Sources of the tokenizer's training text: (path, schema, text field or None, character budget).
TOKENIZER_SOURCES = {
    "code_sql": ("code_files", CODE, "content", 50_000_000),
    "sql_create_context": ("sql_create_context", SOURCES["sql_create_context"].schema, None, 30_000_000),
    "fineweb": ("fineweb", SOURCES["fineweb"].schema, "text", 20_000_000),
}


def registry_table(spark: SparkSession) -> DataFrame:
    """``run_order, source, token_budget, gated, target_proportion``."""
    rows = [(i, s.name, s.token_budget, s.gated) for i, s in enumerate(SOURCES.values())]
    return spark.createDataFrame(rows, "run_order int, source string, token_budget long, gated boolean").withColumn("target_proportion", F.expr("token_budget / sum(token_budget) OVER ()"))
