import math
import unicodedata

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import extract, predicates, text
from corpusmill.sources.registry import strings


def values(spark, items, column, name="x"):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, {name} string").orderBy("i").select(column).collect()]


def test_nfc_counts_after_normalisation(spark):
    texts = ["é" * 100, "a" * 100, None, "é", "Å plain"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r.i: r.text for r in text.nfc(df, "text").collect()}
    assert got == {i: None if t is None else unicodedata.normalize("NFC", t) for i, t in enumerate(texts)}
    long_enough = text.nfc(df, "text").where(predicates.length_ok(F.col("text"))).select("i").collect()
    assert {r.i for r in long_enough} == {0, 1}


def test_length_bounds(spark):
    got = values(spark, ["a" * 99, "a" * 100, "a" * 1_000_000, "a" * 1_000_001], predicates.length_ok(F.col("x")))
    assert got == [False, True, True, False]


@pytest.mark.parametrize("sample,want", [("", 0.0), ("a...", 0.25), ("ab", 1.0), ("12 ", 2 / 3), ("你!", 0.5)])
def test_alnum_fraction(spark, sample, want):
    assert values(spark, [sample], text.alnum_fraction(F.col("x")))[0] == pytest.approx(want)


def test_keyword_filters(spark):
    x = F.col("x")
    texts = ["select a", "SELECT select", "selection fromage", "where join", "........SELECT", None]
    assert values(spark, texts, F.coalesce(predicates.markdown_file(x), F.lit(False))) == [False, False, True, True, False, False]
    assert values(spark, texts, F.coalesce(predicates.python_file(x), F.lit(False))) == [False, False, True, False, False, False]
    assert values(spark, texts, F.coalesce(predicates.sql_file(x), F.lit(False))) == [True, True, True, False, True, False]
    assert values(spark, ["." * 40 + "SELECT"], predicates.sql_file(x)) == [False]
    assert values(spark, ["db/Migrations/1.rb", "app/x.rb", None, "SCHEMA.rb"], predicates.path_has(x)) == [True, False, False, True]


def test_first_turns(spark):
    df = spark.createDataFrame([("prompter", "en"), ("assistant", "en"), ("prompter", "de"), (None, "en")], "role string, lang string")
    assert df.where(predicates.first_turns(F.col("role"), F.col("lang"))).count() == 1


def test_normalise_sql(spark):
    samples = [" SELECT  A ;", "select a;;", "a\t\nb", "", "  ", "X ;", ";", "A;b;", None]
    want = [" ".join([]) if s is None else None for s in samples]
    import re

    want = [None if s is None else re.sub(r"\s+", " ", s.strip().rstrip(";").lower()) for s in samples]
    assert values(spark, samples, text.normalise_sql(F.col("x"))) == want


def test_words_strip_identifier_preview(spark):
    x = F.col("x")
    assert values(spark, ["  a  b ", "", None, " c"], text.word_count(x)) == [2, 0, 0, 1]
    assert values(spark, ["\t a \n"], text.strip(x)) == ["a"]
    assert values(spark, ["a-b c.é"], text.identifier(x)) == ["a_b_c_é"]
    assert values(spark, ["a\nb\rc" + "d" * 200], text.preview(x)) == ["a bc" + "d" * 115]


def test_extraction_of_nulls(spark):
    df = spark.createDataFrame([(None, "a", "")], "p string, q string, r string")
    row = df.select(extract.joined("p", "q", "r").alias("j"), extract.joined_present("p", "q", "r").alias("k"), extract.single("p").alias("s"), extract.field_or_all(strings("p", "q", "r"), "p").alias("f")).first()
    assert (row.j, row.k, row.s, row.f) == ("\na\n", "a", "", "a")


@pytest.mark.parametrize(
    "instruction,want",
    [("S Question: q", ("S", "q")), ("question: early Q: late", ("question: early", "late")), ("none ", ("", "none ")), ("Q: a Q: b", ("", "a Q: b")), (None, ("", ""))],
)
def test_marked_triple(spark, instruction, want):
    df = spark.createDataFrame([(instruction, "SQL")], "i string, o string").select(extract.marked_triple("i", "o").alias("t"))
    t = df.first().t
    assert (t.schema, t.question, t.sql) == (*want, "SQL")


def test_hints_and_prompt(spark):
    df = spark.createDataFrame([("s", " q ", " e ", "x"), ("s", "q", "  ", "x"), (None, None, None, None)], "s string, q string, e string, x string")
    got = [r.t.question for r in df.select(extract.hinted_triple("s", "q", "e", "x").alias("t")).collect()]
    assert got == ["q\nHint: e", "q", ""]
    assert df.select(extract.prompt(F.col("q"), F.col("s")).alias("p")).first().p == "<schema>s</schema><question> q </question><sql>"


def test_schedules(spark):
    steps = [0, 1000, 2000, 72707, 72708, 74708, 76708, 80000]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in steps], "s long").select(text.warmup_stable_cosine(F.col("s"), 5e-4, 5e-5, 2000, 70708, 4000)).collect()]

    def want(s):
        if s < 2000:
            return 5e-4 * s / 2000
        t = min(max(s - 72708, 0), 4000) / 4000
        return 4.5e-4 * 0.5 * (1 + math.cos(math.pi * t)) + 5e-5

    assert got == pytest.approx([want(s) for s in steps])


def test_keywords_that_overlap(spark):
    from corpusmill.functions import text

    rows = [(0, "select", 1), (1, "inserted into", 3), (2, "SELECTFROM", 2), (3, "xselecx", 0), (4, "", 0), (5, None, None), (6, "insinsert", 2)]
    df = spark.createDataFrame(rows, "i int, t string, n int")
    words = ("SELECT", "FROM", "INSERT", "IN", "INTO")
    got = {r.i: (r.h, r.a) for r in df.select("i", text.keyword_hits(F.col("t"), words).alias("h"), text.contains_any(F.col("t"), words).alias("a")).collect()}
    assert got == {i: (n, None if n is None else n > 0) for i, _, n in rows}
