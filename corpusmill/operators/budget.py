"""Token and character budgets in order, with repeated passes over sources that are too small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.prefix import exclusive_sum


def within_budget(docs: DataFrame, by: list[str], order: list[str], cost: str, budget: Column) -> DataFrame:
    """The rows before whose start the group's earlier rows cost less than ``budget``; the crossing row stays whole.

    Adds ``before``, the cost of the earlier rows.
    """
    return exclusive_sum(docs, by, order, cost, "before").where(F.col("before") < budget)


def cycled(docs: DataFrame, by: list[str], order: list[str], cost: str, budget: str) -> DataFrame:
    """``within_budget`` over as many passes as the budget (a column) needs; adds ``epoch`` and ``before``.

    A group that costs nothing gives no rows, as further passes would never reach the budget.
    """
    placed = exclusive_sum(docs, by, order, cost, "before")
    totals = docs.groupBy(*by).agg(F.sum(cost).alias("_pass")).where("_pass > 0")
    passes = F.sequence(F.lit(0).cast("long"), F.ceil(F.col(budget) / F.col("_pass")) - 1)
    # Only passes that a row takes part in are made: a row is in all whole ones, and perhaps in the last.
    repeated = placed.join(totals, by).where(F.col(budget) > 0).withColumn("epoch", F.explode(passes))
    return repeated.withColumn("before", F.col("epoch") * F.col("_pass") + F.col("before")).where(F.col("before") < F.col(budget)).drop("_pass")


def char_sample(texts: DataFrame, order: list[str], budget: int, text: str = "text") -> DataFrame:
    """Texts in order until their characters, and one more for each line end, reach the budget."""
    costed = texts.withColumn("_cost", F.length(text) + 1).withColumn("_all", F.lit(0))
    return within_budget(costed, ["_all"], order, "_cost", F.lit(budget)).drop("_cost", "_all", "before")


def milestones(placed: DataFrame, by: list[str], every: int = 10_000_000) -> DataFrame:
    """How many rows start within each stretch of ``every`` tokens: the progress of a build."""
    return placed.groupBy(*by, F.expr(f"before div {every}").alias("milestone")).agg(F.count("*").alias("docs"))
