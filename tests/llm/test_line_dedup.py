import random

import pytest
from oracle import assert_same

from corpusmill.llm import line_dedup as L

SCHEMA = "doc_id long, text string, n_lines string, source string"


def dedup(spark, texts, ids=None):
    rows = [(i, t, "own", "s") for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return L.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()


def lines(rng, n, words=8):
    return ["".join(rng.choice("abcdefgh ") for _ in range(words * 4)) + str(rng.random()) for _ in range(n)]


def test_query_is_the_sql(spark, tiny):
    assert_same(L.op1(spark, tiny), L.ORACLE, tiny)


def test_shared_passage_is_cut_where_it_comes_again(spark):
    rng = random.Random(5)
    shared = lines(rng, 40)
    texts = ["\n".join(lines(rng, a) + shared + lines(rng, b)) for a, b in ((0, 5), (3, 0), (7, 9), (2, 2))]
    clean = "\n".join(lines(rng, 30))
    got = {r.doc_id: r for r in dedup(spark, [*texts, clean])}
    assert got[0].text == texts[0] and got[0].removed_lines == 0
    for i in (1, 2, 3):
        assert got[i].removed_lines == 40  # wherever it starts
        assert got[i].text.split("\n") == [x for x in texts[i].split("\n") if x not in set(shared)]
    assert got[4].text == clean and got[4].removed_chunks == 0


def test_edge_cases(spark):
    big = "\n".join(f"line {i} of a very long text" for i in range(60_000))
    texts = [None, "", "one short line", "one short line", "a\nb\nc", "a\nb\nc", "w " * 60, "w " * 60, big, big]
    got = {r.doc_id: r for r in dedup(spark, texts)}
    assert got[0].text is None and got[0].n_lines == 0
    assert got[1].text == "" and got[1].n_lines == 1
    assert got[2].text == got[3].text == "one short line"
    assert got[4].text == "a\nb\nc" and got[5].text == "" and got[5].removed_lines == 3
    assert got[6].text == "w " * 60 and got[7].text == ""
    assert got[8].text == big and got[9].text == "" and got[9].removed_lines == 60_000


def test_repeats_inside_one_text(spark):
    passage = lines(random.Random(8), 40)
    got = {r.doc_id: r for r in dedup(spark, ["\n".join([*passage, "between", *passage]), "\n".join(["same line"] * 100)])}
    assert got[0].removed_lines >= 30 and got[0].text.startswith("\n".join(passage))
    assert got[1].text.count("same line") + got[1].removed_lines == 100


def test_repeated_rows_and_null_keys(spark):
    got = dedup(spark, ["a\nb\nc"] * 4, [7, 7, None, None])
    assert [r.text for r in got] == ["a\nb\nc"] * 4


def test_clashing_and_empty(spark):
    df = L.dedup_lines(spark.createDataFrame([(1, "a", "own", "s")], SCHEMA))
    assert sorted(df.columns) == sorted(["doc_id", "source", "text", "n_lines", "removed_lines", "removed_chunks"]) and df.first().n_lines == 1
    assert L.dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_no_python_in_the_plan(spark, tiny):
    plan = L.op1(spark, tiny)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_blank_lines_and_short_lines_stay(spark):
    texts = ["a1\n\n\n\nb1\n\n\n", "a2\n\n\n\nb2", "\n\n\n", "\n\n\n", "same\n \n\t", "same\n \n\t"]
    assert [r.text for r in sorted(dedup(spark, texts), key=lambda r: r.doc_id)] == texts


def test_a_long_line_between_others(spark):
    passage = " ".join(f"word{i}" for i in range(50))
    short = " ".join(f"word{i}" for i in range(49))
    texts = [f"start {i}\nsecond {i}\n{passage}\nthird {i}\n{short}\nend {i}" for i in range(4)]
    got = sorted(dedup(spark, texts), key=lambda r: r.doc_id)
    assert got[0].text == texts[0] and [r.text for r in got[1:]] == [t.replace(passage + "\n", "") for t in texts[1:]]


def test_one_key_with_different_texts(spark):
    got = dedup(spark, ["a\nb\nc", "a\nb\nc", "x\ny\nz\nu", "q\nr\ns"], [1, 2, 2, 2])
    assert sorted((r.doc_id, r.text) for r in got) == [(1, "a\nb\nc"), (2, ""), (2, "q\nr\ns"), (2, "x\ny\nz\nu")]


def test_any_column_names(spark):
    names = ["_lines", "_cut", "_cut_key", "_cut_hash", "_n_chunks", "lines", "cut", "key", "passage", "__cut"]
    df = spark.createDataFrame([(i, "a\nb\nc", *[str(i)] * len(names)) for i in range(3)], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    got = sorted(L.dedup_lines(df).collect(), key=lambda r: r.doc_id)
    assert [r.text for r in got] == ["a\nb\nc", "", ""] and all(r[n] == str(r.doc_id) for r in got for n in names)


def test_lines_of_one_hash_are_told_apart(spark, monkeypatch):
    # With the first seed all lines have one of two hashes; that is seen by their bytes, and another seed is taken.
    from pyspark.sql import functions as F

    real, seeds = L.line_hash, []

    def poor(line, seed):
        seeds.append(seed)
        return F.length(line).cast("long") % 2 if seed == 0 else real(line, seed)

    monkeypatch.setattr(L, "line_hash", poor)
    texts = ["a\nb\nc", "a\nb\nc", "x\ny\nz", "x\ny\nz", "q\nr"]
    assert [r.text for r in sorted(dedup(spark, texts), key=lambda r: r.doc_id)] == ["a\nb\nc", "", "x\ny\nz", "", "q\nr"]
    assert 1 in seeds


@pytest.mark.parametrize("size", [2, 3, 5, 8, 12])
def test_short_passages_between_other_texts(spark, size):
    rng = random.Random(size)
    shared = [lines(rng, size) for _ in range(8)]
    texts = ["\n".join([*lines(rng, rng.randint(0, 6)), *p, *lines(rng, rng.randint(0, 6))]) for p in shared for _ in range(3)]
    got = sorted(dedup(spark, texts), key=lambda r: r.doc_id)
    assert [r.removed_lines for r in got] == [0, size, size] * 8
    assert [r.removed_chunks for r in got] == [0, 1, 1] * 8


def test_an_earlier_copy_of_every_line_stays(spark):
    texts = ["A\nB", "A\nB\nC", "B\nC\nD", "A\nA\nA\nA", "x\n\ny", "x\n\ny\nz", "x\n \ny"]
    got = [r.text for r in sorted(dedup(spark, texts), key=lambda r: r.doc_id)]
    assert got == ["A\nB", "C", "D", "A\nA", "x\n\ny", "z", "x\n \ny"]


@pytest.mark.parametrize("seed", range(3))
def test_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [*lines(rng, 12, 3), "", " ", *[" ".join(f"w{i}{k}" for i in range(60)) for k in range(2)]]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 16))) for _ in range(30)]
    first, gone = {}, [set() for _ in texts]
    for d, text in enumerate(texts):
        ls = text.split("\n")
        full = [i for i, x in enumerate(ls) if x.strip()]
        spans = [(a, b) for a, b in zip(full, full[1:], strict=False)] + [(a, a) for a in full if len(ls[a].split()) >= 50]
        for a, b in sorted(spans):
            d0, a0, b0 = first.setdefault(tuple(ls[a : b + 1]), (d, a, b))
            if (d0, a0) != (d, a):
                gone[d] |= set(range(max(a, b0 + 1) if d0 == d else a, b + 1))
    want = ["\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in enumerate(texts)]
    got = sorted(dedup(spark, texts), key=lambda r: r.doc_id)
    assert [r.text for r in got] == want and [r.removed_lines for r in got] == [len(g) for g in gone]
    assert [r.removed_chunks for r in got] == [sum(i - 1 not in g for i in g) for g in gone]
    # What went is still there.
    assert {x for t in want for x in t.split("\n")} >= {x for t in texts for x in t.split("\n") if x.strip()}
