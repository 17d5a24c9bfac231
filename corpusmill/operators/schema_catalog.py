"""``CREATE TABLE`` texts from a catalogue of databases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Column types of the catalogue and of the created tables; all others are TEXT.
TYPES = {"text": "TEXT", "number": "REAL", "time": "TEXT", "boolean": "INTEGER", "others": "TEXT"}


def schema_texts(catalogue: DataFrame) -> DataFrame:
    """``db_id, schema_sql``: one statement a line for each table, in the catalogue's order.

    Columns of no table (index -1) are left out; a table without columns has one, ``id``. Works on each database's own
    row, without a shuffle.
    """
    kinds = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    columns = F.zip_with("column_names_original", "column_types", lambda c, t: F.struct(c["tbl"].alias("tbl"), F.concat(F.lit('"'), c["col"], F.lit('" '), F.coalesce(F.element_at(kinds, t), F.lit("TEXT"))).alias("text")))
    ready = catalogue.select("db_id", "table_names_original", F.explode(F.array(columns)).alias("columns"))

    def statement(name, i):
        own = F.transform(F.filter("columns", lambda c: c["tbl"] == i), lambda c: c["text"])
        return F.concat(F.lit('CREATE TABLE IF NOT EXISTS "'), name, F.lit('" ('), F.when(F.size(own) > 0, F.array_join(own, ", ")).otherwise(F.lit('"id" TEXT')), F.lit(");"))

    return ready.select("db_id", F.array_join(F.transform("table_names_original", statement), "\n").alias("schema_sql"))
