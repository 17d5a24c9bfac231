import itertools
from collections import Counter

import duckdb
import pytest

import corpus_pipeline as P
from corpusmill.llm import line_dedup, mixing
from corpusmill.llm.common import written


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage gives, and what it was given."""
    sf_dir = "/root/testdata/sf0.001"
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in P.STAGES:
        done = written(stage(spark, docs, sf_dir))
        out.append((name, docs, done))
        docs = done
    return {name: (given, done) for name, given, done in out}


def test_names_and_columns(spark, stages):
    assert list(stages) == ["language_id", "line_dedup", "near_dedup", "mixing", "packing"]
    want = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").columns
    assert all(done.columns == want for name, (_, done) in stages.items() if name != "packing")


def test_clean_documents_pass_language_id(stages):
    given, done = stages["language_id"]
    assert done.count() >= 0.98 * given.count()


def test_line_dedup_is_the_sql(stages):
    given, done = stages["line_dedup"]
    con = duckdb.connect()
    con.register("given", given.select("doc_id", "text").toPandas())
    want = con.execute(f"WITH {line_dedup.SQL_STEPS.format(docs='given')} SELECT g.doc_id, coalesce(r.text, '') FROM given g LEFT JOIN rebuilt r USING (doc_id)").fetchall()
    was = {r.doc_id: r.text for r in given.collect()}
    assert {r.doc_id: r.text for r in done.collect()} == {k: t for k, t in want if t.strip(" \t\n\x0b\f\r") or t == was[k]}
    assert all(r.n_chars == len(r.text) for r in done.collect())


def test_near_dedup_against_all_pairs(stages):
    given, done = stages["near_dedup"]

    def shingles(text):
        w = text.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    texts = {r.doc_id: shingles(r.text) for r in given.collect()}
    alike = {(a, b): len(texts[a] & texts[b]) / len(texts[a] | texts[b]) for a, b in itertools.combinations(sorted(texts), 2) if texts[a] & texts[b]}
    left = {r.doc_id for r in done.collect()}
    gone = set(texts) - left
    # Exactly those of a group at 0.8 that aren't its first stay away.
    assert not [k for k, v in alike.items() if v >= 0.8 and set(k) <= left]
    near = {x for k, v in alike.items() if v >= 0.8 for x in k}
    assert gone <= near


def test_mixing_takes_effect(stages):
    given, done = stages["mixing"]
    plan = {r.doc_id: r.copies for r in mixing.mix(given).collect()}
    assert Counter(r.doc_id for r in done.collect()) == Counter({k: v for k, v in plan.items() if v})


def test_packing_keeps_every_copy(stages):
    given, done = stages["packing"]
    copies = Counter(r.doc_id for r in given.select("doc_id").collect())
    rows = done.collect()
    assert Counter(r.doc_id for r in rows if r.start == 0) == copies
    assert sum(r.length for r in rows) == sum(r.doc_tokens for r in rows if r.start == 0)


ODD = "doc_id long, text string, lang string, source string, n_chars long, key string, fp long, size int, lines string, host string, draw int"


def odd_rows():
    prose = " ".join(f"the reason and the other thing {i} is that they were there" for i in range(12))
    return [
        (1, None, "en", "s", None, "k", 1, 1, "l", "h", 1), (2, "", "en", "s", 0, "k", 1, 1, "l", "h", 1), (3, prose, "en", None, len(prose), "k", 1, 1, "l", "h", 1), (3, prose, "en", None, len(prose), "k", 1, 1, "l", "h", 1),
        (4, prose + " it was", None, "s", 7, "k", 1, 1, "l", "h", 1), (None, prose, "en", "s", 7, "k", 1, 1, "l", "h", 1), (5, "word and the other " * 60_000, "en", "s", 7, "k", 1, 1, "l", "h", 1), (6, prose.replace("reason", "season") + "\n\n\n" + prose, "en", "s", 7, "k", 1, 1, "l", "h", 1),
    ]


@pytest.mark.parametrize("number", range(len(P.STAGES)))
def test_stages_take_odd_rows_and_empty_tables(spark, number):
    """Nulls, empty and very long texts, repeated rows, clashing names of other columns, and no rows at all."""
    name, stage = P.STAGES[number]
    df = spark.createDataFrame(odd_rows(), ODD)
    done = stage(spark, df, "/root/testdata/sf0.001")
    rows = done.collect()
    assert stage(spark, df.limit(0), "/root/testdata/sf0.001").count() == 0
    if name == "packing":
        assert sum(r.length for r in rows) == sum(r.doc_tokens for r in rows if r.start == 0)
        return
    assert done.columns == df.columns
    ids = [r.doc_id for r in rows]
    assert {"language_id": None in ids and 1 not in ids and 2 not in ids and 3 in ids and 5 in ids, "line_dedup": None in ids and 1 in ids and 2 in ids and ids.count(3) == 2 and 5 in ids, "near_dedup": None in ids and 1 in ids and 2 in ids and ids.count(3) == 2 and 4 not in ids and 5 in ids, "mixing": ids.count(None) == 1}[name]


def test_what_only_blank_lines_are_left_of_goes(spark):
    rows = [(1, "a b\nc d", "en", "s", 7), (2, "\na b\nc d\n\n", "en", "s", 11), (3, "\n\n", "en", "s", 2)]
    done = dict(P.STAGES)["line_dedup"](spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "")
    assert sorted(r.doc_id for r in done.collect()) == [1, 3]


def test_run(spark, stages):
    assert P.ORACLE_SQL is None
    assert P.run(spark, "/root/testdata/sf0.001").count() == stages["packing"][1].count()
