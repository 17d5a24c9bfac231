"""How each source's rows become one text, or a (schema, question, sql) triple: column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from corpusmill.functions.text import identifier, strip, text_or_empty


def single(field: str) -> Column:
    return text_or_empty(field)


def joined(*fields: str) -> Column:
    """All fields, one a line; absent values are empty lines."""
    return F.concat_ws("\n", *map(text_or_empty, fields))


def joined_present(*fields: str) -> Column:
    """The fields that are not empty, one a line."""
    return F.concat_ws("\n", *[F.nullif(F.col(f), F.lit("")) for f in fields])


def field_or_all(schema: StructType, field: str | None) -> Column:
    """The named field if it has text, else all texts of the row, in the schema's order, parted by blanks."""
    every = F.concat_ws(" ", *[F.nullif(F.col(f.name), F.lit("")) for f in schema if isinstance(f.dataType, StringType)])
    return F.coalesce(F.nullif(F.col(field), F.lit("")), every) if field else every


def triple(schema: Column, question: Column, sql: Column) -> Column:
    return F.struct(schema.alias("schema"), question.alias("question"), sql.alias("sql"))


def hinted_triple(schema: str, question: str, evidence: str, sql: str) -> Column:
    """The question is stripped; evidence that isn't blank follows it as a hint."""
    asked, hint = strip(text_or_empty(question)), strip(text_or_empty(evidence))
    return triple(text_or_empty(schema), F.when(hint != "", F.concat(asked, F.lit("\nHint: "), hint)).otherwise(asked), text_or_empty(sql))


def plain_triple(schema: str, question: str, sql: str) -> Column:
    return triple(text_or_empty(schema), text_or_empty(question), text_or_empty(sql))


#: Question markers, in the order in which they are tried.
MARKERS = ("Question:", "Q:", "question:")


def marked_triple(instruction: str, sql: str) -> Column:
    """An instruction cut at the first place of the first marker, in order of the markers, that occurs in it."""
    whole = text_or_empty(instruction)
    cut = lambda m: triple(strip(F.substring_index(whole, m, 1)), strip(F.substr(whole, F.locate(m, whole) + F.lit(len(m)))), text_or_empty(sql))
    out = None
    for m in MARKERS:
        out = F.when(F.contains(whole, F.lit(m)), cut(m)) if out is None else out.when(F.contains(whole, F.lit(m)), cut(m))
    return out.otherwise(triple(F.lit(""), whole, text_or_empty(sql)))


def prompt(question: Column, schema: Column) -> Column:
    return F.concat(F.lit("<schema>"), schema, F.lit("</schema><question>"), question, F.lit("</question><sql>"))


def wikisql_table(table: Column) -> Column:
    """``CREATE TABLE`` for a struct ``id, header, types``; a type other than text or real is TEXT."""
    kind = lambda t: F.when(t == "real", F.lit("REAL")).otherwise(F.lit("TEXT"))
    columns = F.zip_with(table["header"], table["types"], lambda c, t: F.concat(F.lit('"'), c, F.lit('" '), kind(t)))
    return F.concat(F.lit('CREATE TABLE "'), identifier(table["id"]), F.lit('" ('), F.array_join(F.filter(columns, lambda x: x.isNotNull()), ", "), F.lit(");"))
