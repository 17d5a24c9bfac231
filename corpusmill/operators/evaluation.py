"""Scoring predicted SQL: exact match, execution in an in-memory database, summaries and breakdowns."""

from __future__ import annotations

import sqlite3

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from corpusmill.functions.text import normalise_sql
from corpusmill.operators.prefix import exclusive_sums

STEPS = 2_000_000  # virtual machine steps that a statement may take unless told otherwise
#: The authorizer's codes for attaching and detaching databases.
_DENIED = (24, 25)


def run_sql(sql: str | None, schema: str | None, steps: int | None = STEPS) -> tuple[frozenset | None, str | None]:
    """The distinct rows of a query over freshly made tables, or what went wrong.

    The SQL isn't trusted: it has no files, no other databases and only ``steps`` steps of the virtual machine; a query
    that needs more fails. With None it runs as long as it takes.
    """
    db = sqlite3.connect(":memory:")
    try:
        db.set_authorizer(lambda code, *_: sqlite3.SQLITE_DENY if code in _DENIED else sqlite3.SQLITE_OK)
        if steps is not None:
            left = [steps // 1000]

            def tick() -> int:
                left[0] -= 1
                return int(left[0] < 0)

            db.set_progress_handler(tick, 1000)
        db.executescript(schema or "")
        return frozenset(tuple(r) for r in db.execute(sql or "")), None
    except Exception as e:  # noqa: BLE001  any failure of foreign SQL is a result
        return None, str(e) or type(e).__name__
    finally:
        db.close()


_RESULT = StructType([StructField("ex", BooleanType()), StructField("pred_error", StringType()), StructField("gold_error", StringType()), StructField("empty_result", BooleanType())])


def _executor(steps: int | None):
    @F.pandas_udf(_RESULT)
    def execute(pred: pd.Series, gold: pd.Series, schema: pd.Series) -> pd.DataFrame:
        rows = []
        for p, g, s in zip(pred, gold, schema, strict=True):
            if not s:
                rows.append((False, None, None, False))
                continue
            (p_rows, p_error), (g_rows, g_error) = run_sql(p, s, steps), run_sql(g, s, steps)
            match = p_error is None and g_error is None and p_rows == g_rows
            rows.append((match, p_error, g_error, match and not p_rows))
        return pd.DataFrame(rows, columns=["ex", "pred_error", "gold_error", "empty_result"])

    return execute.asNondeterministic()


def exact_match(pred: Column, gold: Column) -> Column:
    return F.coalesce(normalise_sql(pred) == normalise_sql(gold), F.lit(False))


def score(examples: DataFrame, pred: str = "pred", gold: str = "gold", schema: str = "schema_sql", steps: int | None = STEPS) -> DataFrame:
    """Adds ``em``, ``ex``, ``exec_error`` and ``empty_result``.

    Without a schema nothing is executed. Order and repeats of rows don't count. An error is one of the prediction, not
    of the gold query. ``empty_result`` marks matches of two empty results, which say little. ``steps`` bounds what a
    statement may cost, as predictions need never end; raise it where right queries are long, or pass None.
    """
    done = examples.withColumn("em", exact_match(F.col(pred), F.col(gold))).withColumn("_x", _executor(steps)(F.col(pred), F.col(gold), F.col(schema)))
    has_schema = F.length(F.coalesce(F.col(schema), F.lit(""))) > 0
    failed = has_schema & ~F.col("_x.ex") & (F.length(F.coalesce(F.col(pred), F.lit(""))) > 0) & F.col("_x.pred_error").isNotNull()
    return done.withColumn("ex", F.col("_x.ex")).withColumn("exec_error", failed).withColumn("empty_result", F.col("_x.empty_result")).drop("_x")


def with_schema(examples: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Examples with the schema of their database; unknown databases have an empty one, so they aren't executed."""
    return examples.join(catalogue, "db_id", "left").na.fill("", ["schema_sql"])


def summary(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``n, em_count, ex_count, exec_errors, empty_results, em, ex``; the rates are 0 without examples."""
    count = lambda c: F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0))
    sums = scored.groupBy(*(by or [])).agg(F.count("*").alias("n"), count("em").alias("em_count"), count("ex").alias("ex_count"), count("exec_error").alias("exec_errors"), count("empty_result").alias("empty_results"))
    rate = lambda c: F.when(F.col("n") == 0, 0.0).otherwise(F.col(c) / F.col("n"))
    return sums.withColumn("em", rate("em_count")).withColumn("ex", rate("ex_count"))


def evaluate_gretelai(rows: DataFrame) -> DataFrame:
    """Scored rows of ``sql_context, sql_prompt, sql, pred``; rows without a gold query are left out."""
    gold = F.coalesce(F.col("sql"), F.lit(""))
    return score(rows.where(gold != "").select(F.col("sql_prompt").alias("question"), gold.alias("gold"), "pred", F.coalesce("sql_context", F.lit("")).alias("schema_sql")))


def evaluate_wikisql(rows: DataFrame) -> DataFrame:
    from corpusmill.functions.extract import wikisql_table

    return score(rows.select("question", F.col("sql.human_readable").alias("gold"), "pred", wikisql_table(F.col("table")).alias("schema_sql")))


def evaluate_spider(rows: DataFrame, catalogue: DataFrame) -> DataFrame:
    return score(with_schema(rows.select("question", F.col("query").alias("gold"), "pred", "db_id"), catalogue))


def length_bucket(n: Column) -> Column:
    """Buckets of 128 tokens up to 512; each includes its lower end."""
    return F.when(n >= 512, ">512").otherwise(F.concat((F.floor(n / 128) * 128).cast("int").cast("string"), F.lit("-"), (F.floor(n / 128) * 128 + 128).cast("int").cast("string")))


def by_length(scored: DataFrame, n: str = "n") -> DataFrame:
    """``bucket, n, ex_count, ex, median_length`` by the length of the example."""
    rows = scored.withColumn("bucket", length_bucket(F.col(n))).groupBy("bucket")
    return rows.agg(F.count("*").alias("n"), F.sum(F.col("ex").cast("long")).alias("ex_count"), F.avg(F.col("ex").cast("double")).alias("ex"), F.median(n).alias("median_length"))


def failure_class(em: Column, ex: Column, error: Column) -> Column:
    return F.when(em, "exact").when(ex, "same_rows").when(error, "error").otherwise("wrong_rows")


def compare_versions(metrics: DataFrame, version: str, names: list[str]) -> DataFrame:
    """Each metric with its change from the version before."""
    w = Window.orderBy(version)  # one row for each version
    return metrics.select(version, *names, *[(F.col(n) - F.lag(n).over(w)).alias(f"{n}_change") for n in names])


def running_rates(scored: DataFrame, order: str, every: int = 100) -> DataFrame:
    """The share of matches so far, after each ``every`` examples.

    Examples are summed in blocks first, and the blocks' sums run in two levels.
    """
    count = lambda c: F.sum(F.col(c).cast("long"))
    blocks = scored.groupBy(F.expr(f"`{order}` div {every}").alias("_block")).agg(F.count("*").alias("_n"), count("em").alias("_em"), count("ex").alias("_ex"))
    before = exclusive_sums(blocks.withColumn("_all", F.lit(0)), ["_all"], ["_block"], {"n": F.col("_n"), "em": F.col("_em"), "ex": F.col("_ex")})
    n = F.col("n") + F.col("_n")
    return before.select(n.alias("n"), ((F.col("em") + F.col("_em")) / n).alias("em_rate"), ((F.col("ex") + F.col("_ex")) / n).alias("ex_rate"))
