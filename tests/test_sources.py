import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import packing, tokenizer
from corpusmill.plans import build
from corpusmill.sources import readers, sinks
from corpusmill.sources.registry import SOURCES, registry_table
from corpusmill.streaming import incremental

LONG = "SELECT name FROM users WHERE id = {} AND city IN ('a', 'b') ORDER BY name, city, born, id LIMIT 10 OFFSET {};"


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    """A folder with most of the sources, a few rows each; fineweb and oasst are JSON lines, sqale is missing."""
    path = str(tmp_path_factory.mktemp("sources"))
    write = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    code = [(LONG.format(i, i) * 3, "db/migration_1.rb" if i % 2 else "app/migration.rb", ["sql", "markdown", "python", "ruby"][i % 4]) for i in range(80)]
    write([*code, ("short", None, "sql"), (None, None, "sql")], "content string, max_stars_repo_path string, lang string", "code_files")
    write([("CREATE TABLE t (a INT)", f"how many {i}? " * 9, f"SELECT {i}", "explains") for i in range(30)], "sql_context string, sql_prompt string, sql string, sql_explanation string", "gretelai")
    write([(f"CREATE TABLE t (a INT) Q: what is {i}? " * 4, f"SELECT {i}") for i in range(30)], "instruction string, output string", "nstext2sql")
    write([(f"what is {i}", "CREATE TABLE t (a INT)" * 5, f"SELECT {i}") for i in range(30)], "question string, context string, answer string", "sql_create_context")
    write([("CREATE TABLE t (a INT)" * 5, f"what is {i}", None if i % 2 else "it is so", f"SELECT {i}") for i in range(30)], "schema string, question string, evidence string, SQL string", "bird")
    for name, rows in (("fineweb", [{"text": f"prose number {i} " * 20} for i in range(30)]), ("oasst", [{"text": f"question {i} " * 20, "role": "prompter" if i % 2 else "assistant", "lang": "en"} for i in range(30)])):
        with open(f"{path}/{name}.jsonl", "w") as out:
            out.write("\n".join(map(json.dumps, rows)))
    return path


@pytest.fixture(scope="module")
def bpe(spark, base):
    docs, _ = readers.load_all(spark, base)
    return tokenizer.train(tokenizer.pre_token_counts(docs["stack_sql"].unionByName(docs["fineweb"])), 500)


def test_all_sources_load_or_are_reported(spark, base):
    found, skipped = readers.load_all(spark, base)
    assert set(found) == set(SOURCES) - {"sqale"} and [r.source for r in skipped.collect()] == ["sqale"]
    counts = {n: d.count() for n, d in found.items()}
    assert counts["stack_sql"] == 20 and counts["stack_ruby"] == 20 and counts["oasst"] == 15 and counts["fineweb"] == 30


def test_raw_filters_reach_the_scan(spark, base):
    plan = readers.documents_of(spark, base, SOURCES["stack_ruby"])._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,ruby)" in plan


def test_wrong_columns_are_refused(spark, base, tmp_path):
    spark.createDataFrame([("a", "b")], "schema string, question string").write.parquet(f"{tmp_path}/sqale.parquet")
    with pytest.raises(ValueError, match="no column query"):
        readers.documents_of(spark, str(tmp_path), SOURCES["sqale"])


def test_registry(spark):
    rows = registry_table(spark).orderBy("run_order").collect()
    assert len(rows) == 11 and sum(r.target_proportion for r in rows) == pytest.approx(1) and not rows[0].gated and rows[-1].gated


def test_build_write_verify(spark, base, bpe, tmp_path):
    out = f"{tmp_path}/corpus"
    encode = tokenizer.encoder(bpe)
    docs, _ = readers.load_all(spark, base, ("bird", "gretelai", "stack_ruby"))
    for name, d in docs.items():
        packed = build.build_corpus(build.ranked_by_content(d, ["source"]), encode(F.col("text")), {name: 3000})
        assert sinks.write_packed(packed, out) == [name]
    again = build.build_corpus(build.ranked_by_content(docs["bird"], ["source"]), encode(F.col("text")), {"bird": 3000})
    assert sinks.write_packed(again, out) == []
    before = spark.read.parquet(out).count()
    assert sinks.write_packed(again, out, force=True) == ["bird"] and spark.read.parquet(out).count() == before
    row = build.write_corpus_manifest(spark, out, bpe).first()
    assert row.total_sources == 3
    checks = {r.check: r.passed for r in build.verify_corpus(spark, out, bpe).collect()}
    assert checks["plausible"] and checks["shape"] and checks["id_range"] and checks["checksums"] and not checks["files"]
    bird = spark.read.parquet(f"{out}/source=bird/split=train")
    other = bird.withColumn("tokens", F.when(F.col("seq_id") == 12, F.reverse("tokens")).otherwise(F.col("tokens")))
    other.write.parquet(f"{tmp_path}/changed/source=bird/split=train")
    plan = spark.read.parquet(out).select("source", "split", "seq_id", *packing.FACTS)._jdf.queryExecution().executedPlan().toString()
    assert "tokens:array" not in plan  # the manifest is made without the tokens
    sinks.write_manifest(spark.read.json(f"{out}.manifest.json", multiLine=True), f"{tmp_path}/changed.manifest.json")
    assert not {r.check: r.passed for r in build.verify_corpus(spark, f"{tmp_path}/changed").collect()}["checksums"]


def test_finetune_set(spark, base, bpe):
    rows, stats, skipped = build.build_finetune(spark, base, bpe, out=f"{base}/finetune")
    assert skipped.count() == 0
    back = spark.read.parquet(f"{base}/finetune")
    assert back.count() == rows.count() and {r.split for r in back.select("split").distinct().collect()} <= {"train", "val"}
    assert spark.read.json(f"{base}/finetune.manifest.json", multiLine=True).first().max_length == 1024
    counts = {r.source: (r.kept, r.skipped) for r in stats.collect()}
    assert set(counts) == {"bird", "nstext2sql", "sql_create_context", "gretelai"} and all(k + s == 30 for k, s in counts.values())
    per = {r.source: r["count"] for r in rows.groupBy("source").count().collect()}
    assert per["bird"] == 150 and per["nstext2sql"] == 60 and per["sql_create_context"] == 30 and per.get("gretelai", 0) < 30
    assert {len(r.tokens) for r in rows.collect()} == {1024}
    assert build.build_finetune(spark, base, bpe, max_per_source=5)[1].agg(F.sum("kept")).first()[0] == 20


def test_tokenizer_corpus(spark, base, tmp_path):
    out = f"{tmp_path}/text"
    assert len(build.tokenizer_corpus(spark, base, out)) == 4
    n = readers.read_lines(spark, out).count()
    assert build.tokenizer_corpus(spark, base, out) == [] and readers.read_lines(spark, out).count() == n
    assert build.train_tokenizer(spark, out, 400).size == 400


def test_npy(spark, tmp_path):
    matrix = np.arange(5 * 8, dtype=np.int16).reshape(5, 8)
    np.save(f"{tmp_path}/a.npy", matrix)
    got = readers.read_npy(spark, f"{tmp_path}/*.npy").orderBy("row").collect()
    assert [list(r.tokens) for r in got] == matrix.tolist()
    packed = spark.createDataFrame([("s", "train", i, matrix[i].tolist()) for i in range(5)], "source string, split string, seq_id long, tokens array<smallint>")
    assert sinks.write_npy(packed, f"{tmp_path}/out", rows=2) == [f"s/train-{i:012d}.npy" for i in (0, 2, 4)]
    assert np.load(f"{tmp_path}/out/s/train-{2:012d}.npy").tolist() == matrix[2:4].tolist()
    for path in ("out", "out/*/*.npy", "out/s"):
        assert [list(r.tokens) for r in readers.read_npy(spark, f"{tmp_path}/{path}").orderBy("path", "row").collect()] == matrix.tolist()
    # More files beside those that are there; with force, in place of them.
    assert sinks.write_npy(packed.withColumn("source", F.lit("t")), f"{tmp_path}/out") == ["t/train-000000000000.npy"]
    assert readers.read_npy(spark, f"{tmp_path}/out").count() == 10
    assert sinks.write_npy(packed, f"{tmp_path}/out", force=True) == ["s/train-000000000000.npy"]
    assert readers.read_npy(spark, f"{tmp_path}/out").count() == 5 and not list((tmp_path / "out").glob("_temporary*"))


def test_one_large_npy_is_read_by_many_tasks(spark, tmp_path):
    matrix = np.random.default_rng(1).integers(-32768, 32767, (10_007, 64)).astype(np.int16)
    np.save(f"{tmp_path}/m.npy", matrix)
    df = readers.read_npy(spark, f"{tmp_path}/m.npy", rows=1000)
    assert df.select(F.spark_partition_id()).distinct().count() == 11
    got = df.orderBy("row").toArrow()
    assert np.array_equal(np.stack(got["tokens"].to_numpy()), matrix) and got["row"].to_pylist() == list(range(10_007))


def test_npy_of_other_kinds_is_refused(spark, tmp_path):
    from corpusmill.sources import npy

    for bad in (np.zeros((3, 2), np.int32), np.zeros(4, np.int16), np.zeros((2, 2), np.int16, order="F")):
        np.save(f"{tmp_path}/b.npy", bad)
        with pytest.raises(ValueError, match="no matrix"):
            npy.Reader({"path": f"{tmp_path}/b.npy"}).partitions()
    with pytest.raises(FileNotFoundError):
        npy.files_of(f"{tmp_path}/none")
    empty = spark.createDataFrame([], "source string, split string, seq_id long, tokens array<smallint>")
    assert sinks.write_npy(empty, f"{tmp_path}/e") == []


def test_a_failed_npy_write_leaves_nothing(spark, tmp_path):
    packed = spark.createDataFrame([("s", "train", 0, [1, 2]), ("s", "train", 1, [3])], "source string, split string, seq_id long, tokens array<smallint>")
    with pytest.raises(Exception):  # noqa: B017  rows of one file differ in length
        sinks.write_npy(packed, f"{tmp_path}/f")
    assert not list(tmp_path.glob("f/**/*.npy"))


def test_json_readers(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"step": 1, "kind": "train", "loss": 2.0}\n\n{"step": 2, "kind": "val", "loss": 1.0, "lr": 0.1}\n')
    assert readers.read_metrics(spark, f"{tmp_path}/m.jsonl").count() == 2
    sinks.append_metrics(readers.read_metrics(spark, f"{tmp_path}/m.jsonl"), f"{tmp_path}/x", f"{tmp_path}/y")
    assert readers.read_metrics(spark, f"{tmp_path}/y").count() == 2
    (tmp_path / "t.json").write_text(json.dumps([{"db_id": "d", "table_names_original": ["t", "e"], "column_names_original": [[-1, "*"], [0, "a"]], "column_types": ["text", "number"]}]))
    from corpusmill.operators.schema_catalog import schema_texts

    assert schema_texts(readers.read_catalogue(spark, f"{tmp_path}/t.json")).first().schema_sql == 'CREATE TABLE IF NOT EXISTS "t" ("a" REAL);\nCREATE TABLE IF NOT EXISTS "e" ("id" TEXT);'
    q = spark.createDataFrame([(3, None, "b"), (1, "a", None), (2, "", "")], "k int, query string, question string")
    assert [r["query"] for r in readers.sql_queries(q, 5, "k").orderBy("k").collect()] == ["a", "b"]


def test_incremental(spark, tmp_path):
    schema = "doc_id long, text string"
    from pyspark.sql.types import _parse_datatype_string

    for i in range(2):
        spark.createDataFrame([(i, "x" * 200), (i + 10, "short")], schema).write.mode("append").parquet(f"{tmp_path}/in")
        docs = incremental.filtered(incremental.new_documents(spark, f"{tmp_path}/in", _parse_datatype_string(schema)))
        incremental.append_new(docs, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(60)
        assert spark.read.parquet(f"{tmp_path}/out").count() == i + 1


def test_reference_queries_and_their_fallback(spark, base, tmp_path):
    name, found = readers.reference_queries(spark, base, 5)
    assert name == "sql_create_context" and found.count() == 5 and found.first()["query"].startswith("SELECT")
    spark.createDataFrame([("q1", 7, "SELECT 1"), ("", 8, "SELECT 2"), ("q3", 9, None)], "question string, query int, sql string").write.parquet(f"{tmp_path}/spider_examples.parquet")
    name, found = readers.reference_queries(spark, str(tmp_path))
    # The column query is a number here, so the next field that is a text counts.
    assert name == "spider_examples" and sorted(r["query"] for r in found.collect()) == ["SELECT 1", "SELECT 2", "q3"]
    spark.createDataFrame([(1,)], "query int").write.mode("overwrite").parquet(f"{base}/spider_examples.parquet")
    assert readers.reference_queries(spark, base)[0] == "sql_create_context"


def test_evaluation_sets(spark, tmp_path):
    spark.createDataFrame([(f"q{i}", f"SELECT {i}", "db") for i in range(20)], "question string, query string, db_id string").coalesce(1).write.parquet(f"{tmp_path}/spider_validation.parquet")
    every = readers.evaluation_set(spark, str(tmp_path), "spider_validation")
    first = readers.evaluation_set(spark, str(tmp_path), "spider_validation", 3)
    assert every.count() == 20 and sorted(r.question for r in first.collect()) == ["q0", "q1", "q2"]
    (tmp_path / "wikisql_test.jsonl").write_text(json.dumps({"question": "q", "sql": {"human_readable": "SELECT a FROM t"}, "table": {"id": "1", "header": ["a"], "types": ["text"]}, "phase": 1}) + "\n")
    assert readers.evaluation_set(spark, str(tmp_path), "wikisql_test").first().table.header == ["a"]
    with pytest.raises(FileNotFoundError):
        readers.evaluation_set(spark, str(tmp_path), "gretelai_test")


def test_written_corpus_keeps_tokens_once(spark, tiny):
    """The only tokens on disk are the corpus itself: no table on the way has them, and pieces are dealt once."""
    from corpusmill import scratch
    from corpusmill.plans import catalogue

    before = set(scratch._left)
    assert catalogue.written_corpus(spark, tiny).count() > 0
    made = set(scratch._left) - before
    assert made and not any("tokens" in spark.read.parquet(p).columns for p in made)
