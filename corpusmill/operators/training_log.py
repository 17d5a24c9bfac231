"""Analytics over training logs, and the tabular steps of decoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.operators.prefix import ROWS, exclusive_sums


def of_kind(metrics: DataFrame, kind: str) -> DataFrame:
    return metrics.where(F.col("kind") == kind)


def best_step(metrics: DataFrame) -> DataFrame:
    """``step, loss`` of the least validation loss; the first step of several."""
    return of_kind(metrics, "val").agg(F.min(F.struct("loss", "step")).alias("b")).select("b.step", "b.loss")


def latest(metrics: DataFrame) -> DataFrame:
    return of_kind(metrics, "train").agg(F.max_by(F.struct("step", "loss"), "step").alias("b")).select("b.step", "b.loss")


def trailing_mean(metrics: DataFrame, window: int = 100, every: int = 100, rows: int = ROWS) -> DataFrame:
    """``step, mean``: the mean of the last ``window`` train losses, at each ``every`` steps.

    The losses of the last rows count, however far apart their steps are. Rows are ranked first and dealt in ranges of
    ranks; a range also gets the ``window - 1`` ranks before it, so no task holds the whole log. Equal steps are ordered
    by their losses, and each has a mean.
    """
    ranked = exclusive_sums(of_kind(metrics, "train").select("step", "loss").withColumn("_all", F.lit(0)), ["_all"], ["step", "loss"], {"_rank": F.lit(1)}, rows)
    size = max(rows, window)
    first = F.expr(f"_rank div {size}")
    spread = ranked.select("step", "loss", "_rank", first.alias("_own"), F.explode(F.sequence(first, F.expr(f"(_rank + {window - 1}) div {size}"))).alias("_to"))
    w = Window.partitionBy("_to").orderBy("_rank").rowsBetween(-(window - 1), 0)
    return spread.withColumn("mean", F.avg("loss").over(w)).where((F.col("_to") == F.col("_own")) & (F.col("step") % every == 0)).select("step", "mean")


def mean_loss(batches: DataFrame, loss: str = "loss") -> DataFrame:
    return batches.agg(F.avg(loss).alias("loss"))


def masked_mean(rows: DataFrame, loss: str, mask: str) -> DataFrame:
    return rows.agg((F.sum(F.col(loss) * F.col(mask)) / (F.sum(mask) + 1e-9)).alias("loss"))


def newest_checkpoint(names: DataFrame, name: str = "name") -> DataFrame:
    """The checkpoint of the highest step; the names end in it."""
    step = F.regexp_extract(name, r"(\d+)$", 1).cast("long")
    return names.agg(F.max_by(name, step).alias(name))


def nucleus(probabilities: DataFrame, by: list[str], p: float, token: str = "token", prob: str = "prob") -> DataFrame:
    """The most probable tokens of each group until their sum reaches ``p``; ``prob`` is rescaled to sum to 1.

    Ties go to the smaller token. A group is one position's vocabulary, so a window over it is bounded.
    """
    order = Window.partitionBy(*by).orderBy(F.desc(prob), token)
    before = F.sum(prob).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(prob)
    kept = probabilities.withColumn("_before", before).where(F.col("_before") < p)
    return kept.withColumn(prob, F.col(prob) / F.sum(prob).over(Window.partitionBy(*by))).drop("_before")


def greedy(probabilities: DataFrame, by: list[str], token: str = "token", prob: str = "prob") -> DataFrame:
    """The most probable token of each group; of several, the smallest."""
    return probabilities.groupBy(*by).agg(F.min(F.struct((-F.col(prob)).alias("p"), F.col(token).alias("t"))).alias("b")).select(*by, F.col("b.t").alias(token))


def beam_step(candidates: DataFrame, by: list[str], k: int, alpha: float = 0.6) -> DataFrame:
    """One step of beam search over given log-probabilities: ``beam, token, logp, total, length`` rows.

    Each beam's ``k`` best tokens, then each group's ``k`` best continuations by score over length to the power alpha.
    """
    inner = Window.partitionBy(*by, "beam").orderBy(F.desc("logp"), "token")
    some = candidates.withColumn("_r", F.row_number().over(inner)).where(F.col("_r") <= k)
    score: Column = (F.col("total") + F.col("logp")) / F.pow(F.col("length") + 1, F.lit(alpha))
    outer = Window.partitionBy(*by).orderBy(F.desc("score"), "beam", "token")
    return some.withColumn("score", score).withColumn("rank", F.row_number().over(outer)).where(F.col("rank") <= k).drop("_r")
