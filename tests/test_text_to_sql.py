import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import evaluation, finetune, supplement, tokenizer, training_log


def encoded(spark, shapes, length=32):
    rows = [(i, *[[20] * k for k in shape]) for i, shape in enumerate(shapes)]
    df = spark.createDataFrame(rows, "i int, schema_ids array<smallint>, question_ids array<smallint>, sql_ids array<smallint>")
    return {r.i: r for r in finetune.encode_examples(df, length).collect()}


@pytest.mark.parametrize("s,q,a", [(0, 0, 1), (3, 0, 2), (0, 4, 1), (5, 6, 7), (10, 10, 4)])
def test_layout_and_mask(spark, s, q, a):
    r = encoded(spark, [(s, q, a)])[0]
    want = [0, 4, *[20] * s, 7, 5, *[20] * q, 8, 6, *[20] * a, 9, 1]
    start = want.index(6)
    assert list(r.tokens) == want + [2] * (32 - len(want))
    assert list(r["mask"]) == [int(start <= i < len(want) - 1) for i in range(32)]
    assert sum(r["mask"]) == a + 2


def test_too_long_and_empty_answers(spark):
    got = encoded(spark, [(10, 10, 4), (10, 10, 5), (1, 1, 0)])
    assert got[0].n == 32 and got[0].tokens is not None
    assert got[1].n == 33 and got[1].tokens is None
    assert 2 not in got


def test_copies(spark):
    df = spark.range(4000).select(F.col("id").cast("string").alias("k"))
    for weight in (5.0, 2.0, 1.0, 0.25):
        n = finetune.split_and_copy(df, F.col("k"), F.lit("s"), F.lit(weight)).count()
        assert n == 4000 * weight if weight >= 1 else abs(n - 1000) < 120
    split = finetune.split_and_copy(df, F.col("k"), F.lit("s"), F.lit(1.0))
    assert 15 < split.where("split = 'val'").count() < 75
    again = finetune.split_and_copy(df.repartition(7), F.col("k"), F.lit("s"), F.lit(0.25))
    assert {r.k for r in again.collect()} == {r.k for r in finetune.split_and_copy(df, F.col("k"), F.lit("s"), F.lit(0.25)).collect()}


def test_numpy_stream(spark):
    import numpy as np

    n = 200_000
    df = spark.range(n).select(F.col("id").alias("nth"), F.array(F.lit(1)).alias("tokens")).repartition(7)  # in no order
    got = finetune.numpy_draws(df, "nth").orderBy("nth").select("val_draw", "copy_draw").toArrow()
    want = np.random.default_rng(42).random((n, 2))
    assert np.array_equal(np.stack([got["val_draw"].to_numpy(), got["copy_draw"].to_numpy()], axis=1), want)
    odd = spark.createDataFrame([(5,), (5,), (None,), (10**12,)], "k long")
    far = np.random.PCG64(42)
    far.advance(2 * 10**12)
    rows = sorted(((r.k or -1, r.val_draw) for r in finetune.numpy_draws(odd, "k").collect()), key=lambda x: x[0])
    assert rows == [(-1, None), (5, want[5, 0]), (5, want[5, 0]), (10**12, np.random.Generator(far).random())]
    plan = finetune.numpy_draws(df, "nth")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("ArrowEvalPython")[0]  # no row moves for its draws


def test_execution(spark):
    ddl = "CREATE TABLE t (a INT); INSERT INTO t VALUES (1), (1), (2);"
    loop = "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r) SELECT count(*) FROM r"
    cases = [
        ("SELECT a FROM t ORDER BY a DESC", "SELECT DISTINCT a FROM t", ddl, True, False),
        ("SELECT a FROM t WHERE a > 9", "SELECT a FROM t WHERE a > 8", ddl, True, False),
        ("SELECT a FROM t WHERE a > 1", "SELECT a FROM t", ddl, False, False),
        ("SELECT z FROM t", "SELECT a FROM t", ddl, False, True),
        ("SELECT a FROM t", "SELECT z FROM t", ddl, False, False),
        ("", "SELECT a FROM t", ddl, False, False),
        (loop, "SELECT a FROM t", ddl, False, True),
        ("ATTACH 'x.db' AS x", "SELECT a FROM t", ddl, False, True),
        ("SELECT 1", "SELECT 1", "CREATE TABLE (", False, True),
        ("SELECT 1", "SELECT 1", "", False, False),
        (None, None, None, False, False),
    ]
    df = spark.createDataFrame([(i, p, g, s) for i, (p, g, s, _, _) in enumerate(cases)], "i int, pred string, gold string, schema_sql string")
    got = [(r.ex, r.exec_error) for r in evaluation.score(df).orderBy("i").collect()]
    assert got == [(x, e) for *_, x, e in cases]


def test_evaluators(spark):
    rows = spark.createDataFrame([("CREATE TABLE t (a INT)", "q", "SELECT a FROM t", "select a from t;"), ("", "q", "", "x")], "sql_context string, sql_prompt string, sql string, pred string")
    s = evaluation.summary(evaluation.evaluate_gretelai(rows)).first()
    assert (s.n, s.em_count, s.ex_count) == (1, 1, 1)
    assert evaluation.summary(evaluation.evaluate_gretelai(rows.limit(0))).first().em == 0.0
    wiki = spark.createDataFrame([("q", ("SELECT Size FROM t_1",), ("t 1", ["Size"], ["real"]), "SELECT Size FROM t_1")], "question string, sql struct<human_readable: string>, table struct<id: string, header: array<string>, types: array<string>>, pred string")
    assert evaluation.evaluate_wikisql(wiki).first().ex
    spider = spark.createDataFrame([("q", "SELECT 1", "SELECT 1", "gone")], "question string, query string, pred string, db_id string")
    assert not evaluation.evaluate_spider(spider, spark.createDataFrame([("a", "")], "db_id string, schema_sql string")).first().ex


@pytest.fixture(scope="module")
def bpe(spark):
    texts = spark.createDataFrame([("SELECT name FROM users WHERE id = 12;",)] * 40 + [("café naïve select",)] * 5, "text string")
    return tokenizer.train(tokenizer.pre_token_counts(texts), 400)


def test_byte_symbols_and_specials(bpe):
    symbols = tokenizer.byte_symbols()
    assert len(set(symbols)) == 256 and symbols[32] == "Ġ" and symbols[ord("A")] == "A"
    assert bpe.ids["<bos>"] == 0 and bpe.ids["</sql>"] == 9 and bpe.ids["<reserved_12>"] == 22
    assert "ĠFROM" in bpe.ids


def test_encode_decode(spark, bpe):
    texts = ["", " SELECT", "SELECT ", "x\n\ty", "col_2023abc", "v1.2.3", "it''s", "éè", "a;\n\nb;", "  \t ", "\U0001f600 unseen 你"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert all(r.same for r in tokenizer.round_trips(df, bpe).collect())
    assert bpe.encode("a<schema>b")[1] == 4
    assert tokenizer.Bpe.from_json(bpe.to_json()).encode("SELECT name") == bpe.encode("SELECT name")
    assert bpe.fingerprint() == tokenizer.Bpe.from_json(bpe.to_json()).fingerprint()


def test_same_merges_as_a_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    lines = ["select alpha from beta where gamma", "select beta from alpha", "gamma gamma delta"] * 5
    mine = tokenizer.train(tokenizer.pre_token_counts(spark.createDataFrame([(x,) for x in lines], "text string")), 23 + 256 + 30)
    other = tokenizers.Tokenizer(tokenizers.models.BPE(vocab={n: i for i, n in enumerate(mine.names)}, merges=mine.merges, unk_token="<unk>"))
    other.pre_tokenizer = tokenizers.pre_tokenizers.Sequence([tokenizers.pre_tokenizers.Digits(individual_digits=True), tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False)])
    for text in [*lines, "Select 12 x  y\n z's", "café 3a  4"]:
        assert mine.encode(text) == other.encode(text, add_special_tokens=False).ids


def test_tokenizer_files(spark, bpe, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    tokenizer.write_tokenizer(spark, bpe, f"{tmp_path}/t")
    back, other = tokenizer.read_tokenizer(spark, f"{tmp_path}/t"), tokenizers.Tokenizer.from_file(f"{tmp_path}/t/tokenizer.json")
    for text in ("SELECT name FROM users", "a <schema>x</schema> 12 é\n\n z", "", "it's"):
        assert back.encode(text) == bpe.encode(text) == other.encode(text, add_special_tokens=False).ids


def test_training_counts_all_words(spark):
    # The merges of loops over all words, however rare; only pairs that occur often enough merge.
    import random
    from collections import Counter

    rng = random.Random(4)
    words = [" " + "".join(rng.choice("aaabbcdxyz") for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    bpe = tokenizer.train(tokenizer.pre_token_counts(spark.createDataFrame([(" ".join(words[i : i + 9]),) for i in range(0, 400, 9)], "text string")), 400, 5)
    counts = Counter()
    for i in range(0, 400, 9):
        for r in __import__("regex").findall(tokenizer.PRE_TOKEN, " ".join(words[i : i + 9])):
            counts[r] += 1
    symbols, split = tokenizer.byte_symbols(), {}
    for w in counts:
        split[w] = [symbols[b] for b in w.encode()]
    ids, want = {n: i for i, n in enumerate([*tokenizer.SPECIAL_TOKENS, *symbols])}, []
    while True:
        pairs = Counter()
        for w, s in split.items():
            for p in zip(s, s[1:], strict=False):
                pairs[p] += counts[w]
        best = min(pairs, key=lambda p: (-pairs[p], ids[p[0]], ids[p[1]]), default=None)
        if best is None or pairs[best] < 5 or len(ids) >= 400:
            break
        want.append(best)
        ids.setdefault("".join(best), len(ids))
        for w, s in split.items():
            out, i = [], 0
            while i < len(s):
                step = 2 if tuple(s[i : i + 2]) == best else 1
                out.append("".join(s[i : i + step]))
                i += step
            split[w] = out
    assert bpe.merges == want and len(want) > 30


def test_statement_may_be_bounded():
    endless = "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t) SELECT max(n) FROM t"
    assert evaluation.run_sql(endless, "CREATE TABLE a (b INT)", steps=10_000)[1]
    many = "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 300000) SELECT max(n) FROM t"
    assert evaluation.run_sql(many, "CREATE TABLE a (b INT)")[1] and evaluation.run_sql(many, "CREATE TABLE a (b INT)", None) == (frozenset({(300000,)}), None)


def test_pre_tokens_cover_the_text(spark):
    texts = ["ab 12  c's\n x", "", "  ", "aé你!?"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(tokenizer.pre_tokens(F.col("t"))).collect()]
    assert ["".join(x) for x in got] == texts
    assert got[0] == ["ab", " ", "1", "2", " ", " c", "'s", "\n", " x"]


def test_keywords_and_checks(spark, bpe):
    words = spark.createDataFrame([("FROM",), ("WHERE",), ("COALESCE",)], "keyword string")
    got = {r.keyword: r.single for r in tokenizer.keyword_table(words, bpe).collect()}
    assert got == {"FROM": True, "WHERE": True, "COALESCE": False}
    texts = spark.createDataFrame([("SELECT name FROM users",)], "text string")
    table = {r.check: r.passed for r in tokenizer.checks(spark, bpe, texts).collect()}
    assert table["special_ids"] and table["round_trip"] and not table["vocab_size"] and not table["keywords"]
    best = tokenizer.compare_fertility(texts, {"bytes": tokenizer.byte_ids(F.col("text")), "bpe": tokenizer.encoder(bpe)(F.col("text"))}).first()
    assert best.tokenizer == "bpe"
    assert tokenizer.fertility(texts.limit(0).withColumn("ids", F.array(F.lit(1))), "ids").first().fertility == 0.0


def test_supplement(spark):
    rows = supplement.sentences(spark, reps=3, extra_reps=2)
    assert rows.count() == len(supplement.KEYWORDS) * 6 + len(supplement.EXTRA) * 4
    assert all((r.keyword if r.upper else r.keyword.lower()) in r.text for r in rows.collect())


def test_log(spark):
    rows = [(s, "train", 100.0 - s, None, None) for s in range(1, 251)] + [(100, "val", 2.0, None, None), (200, "val", 1.0, None, None), (300, "val", 1.0, None, None), (7, "nan", None, None, None)]
    log = spark.createDataFrame(rows, "step long, kind string, loss double, grad_norm double, lr double")
    assert training_log.best_step(log).first().step == 200
    assert training_log.latest(log).first().step == 250
    means = {r.step: r["mean"] for r in training_log.trailing_mean(log).collect()}
    assert means == {100: pytest.approx(100 - 50.5), 200: pytest.approx(100 - 150.5)}
    assert training_log.newest_checkpoint(spark.createDataFrame([("s_9",), ("s_10",)], "name string")).first().name == "s_10"


def test_decoding(spark):
    p = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.3), (1, 2, 0.2), (2, 5, 1.0)], "g int, token int, prob double")
    got = {(r.g, r.token): r.prob for r in training_log.nucleus(p, ["g"], 0.75).collect()}
    assert got == {(1, 0): pytest.approx(0.625), (1, 1): pytest.approx(0.375), (2, 5): 1.0}
    assert {(r.g, r.token) for r in training_log.greedy(p, ["g"]).collect()} == {(1, 0), (2, 5)}
    c = spark.createDataFrame([(1, b, t, lp, tot, 1) for b, tot in ((0, -1.0), (1, -0.5)) for t, lp in ((0, -0.1), (1, -2.0))], "g int, beam int, token int, logp double, total double, length int")
    assert [(r.beam, r.token) for r in training_log.beam_step(c, ["g"], 2).orderBy("rank").collect()] == [(1, 0), (0, 0)]
