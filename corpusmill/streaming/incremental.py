"""An extension: a corpus that grows with the files of a folder, by Structured Streaming over what is new.

The builds themselves read finite data. Here each run takes the files that came since the last one
(``Trigger.AvailableNow``), and the checkpoint makes sure that none is taken twice or left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from corpusmill.functions.predicates import length_ok


def new_documents(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def filtered(docs: DataFrame, keep: Callable | None = None) -> DataFrame:
    """Texts of the right length, and those that the source's filter keeps."""
    kept = docs.where(length_ok(F.col("text")))
    return kept if keep is None else kept.where(keep(F.col("text")))


def append_new(docs: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends all new rows as Parquet and stops; call it again for what comes later."""
    return docs.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def loss_by_window(metrics: DataFrame, width: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """The mean of ``loss`` in windows of the event time ``ts``; rows later than ``late`` are left out."""
    return metrics.withWatermark("ts", late).groupBy(F.window("ts", width)).agg(F.avg("loss").alias("loss"), F.count("*").alias("n"))
