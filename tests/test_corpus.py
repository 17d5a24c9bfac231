import random

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import budget, manifest, packing, sampling
from corpusmill.operators.prefix import exclusive_sum, hash_rank
from corpusmill.plans import build
from corpusmill.plans.catalogue import lang_registry


def docs_of(spark, sizes, source="s"):
    """Documents of the given numbers of tokens, each token naming its document and place."""
    rows, n = [], 10
    for i, k in enumerate(sizes):
        rows.append((source, i, [(n + j) % 12000 for j in range(k)]))
        n += k
    return spark.createDataFrame(rows, "source string, doc_no long, tokens array<smallint>")


def flat_pack(docs, length):
    flat = [t for d in docs for t in d]
    return [flat[i : i + length] for i in range(0, len(flat) - length + 1, length)]


@pytest.mark.parametrize("sizes", [[511], [512], [513], [300, 300, 424], [0, 5, 0, 600, 3], [1700, 1, 1, 900], []])
def test_packing_equals_the_flat_list(spark, sizes):
    df = docs_of(spark, sizes)
    want = flat_pack([r.tokens for r in df.orderBy("doc_no").collect()], 512)
    got = [list(r.tokens) for r in packing.pack(df, ["source"], ["doc_no"]).orderBy("seq_id").collect()]
    assert got == want


def test_packing_many_sources_and_partitions(spark):
    rng = random.Random(7)
    parts = [docs_of(spark, [rng.randrange(0, 90) for _ in range(120)], s) for s in "abc"]
    df = parts[0].unionByName(parts[1]).unionByName(parts[2])
    want = {s: flat_pack([r.tokens for r in df.where(f"source = '{s}'").orderBy("doc_no").collect()], 64) for s in "abc"}
    for n in (1, 8):
        got = packing.pack(df.repartition(n, "doc_no"), ["source"], ["doc_no"], 64).collect()
        assert {s: [list(r.tokens) for r in sorted(got, key=lambda r: r.seq_id) if r.source == s] for s in "abc"} == want


def test_wrap(spark):
    assert packing.wrap(docs_of(spark, [2])).first().tokens == [0, 10, 11, 1]


def reference_budget(sizes, limit):
    """The loop: passes over the documents until the budget is met, the last document whole."""
    out, total, epoch = [], 0, 0
    while total < limit and sum(sizes) > 0:
        for i, n in enumerate(sizes):
            if total >= limit:
                break
            out.append((epoch, i))
            total += n
        epoch += 1
    return out


@pytest.mark.parametrize("sizes,limit", [([5, 5, 5], 10), ([5, 5, 5], 11), ([3, 0, 4], 20), ([0, 0], 5), ([7], 21), ([4, 4], 0), ([2, 9, 1], 12)])
def test_budget_and_cycles(spark, sizes, limit):
    df = spark.createDataFrame([("s", i, n, limit) for i, n in enumerate(sizes)], "source string, doc_no long, n long, budget long")
    got = sorted((r.epoch, r.doc_no) for r in budget.cycled(df, ["source"], ["doc_no"], "n", "budget").collect())
    # A document without tokens that stands just where the budget is met may follow in the loop or not; both cost nothing.
    assert [x for x in got if sizes[x[1]]] == [x for x in reference_budget(sizes, limit) if sizes[x[1]]]
    once = sorted(r.doc_no for r in budget.within_budget(df, ["source"], ["doc_no"], "n", F.col("budget")).collect())
    assert once == [i for i in range(len(sizes)) if sum(sizes[:i]) < limit]


def test_char_sample(spark):
    df = spark.createDataFrame([(i, "x" * 9) for i in range(10)], "doc_no long, text string")
    assert budget.char_sample(df, ["doc_no"], 30).count() == 3
    assert budget.char_sample(df, ["doc_no"], 31).count() == 4


def test_two_level_sums_and_ranks(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), i * 17 % 1009, rng.randrange(9)) for i in range(1009)]
    df = spark.createDataFrame(rows, "g string, k long, v long")
    got = {(r.g, r.k): r.before for r in exclusive_sum(df, ["g"], ["k"], "v", "before", rows=50).collect()}
    for g in "ab":
        total = 0
        for _, k, v in sorted(r for r in rows if r[0] == g):
            assert got[g, k] == total
            total += v
    ranked = hash_rank(df.withColumn("d", F.sha2(F.col("k").cast("string"), 256)), ["g"], "d", ["k"], "r").collect()
    for g in "ab":
        mine = sorted((r.r, r.d) for r in ranked if r.g == g)
        assert [x[0] for x in mine] == list(range(1, len(mine) + 1)) and mine == sorted(mine, key=lambda x: x[1])


@pytest.mark.parametrize("n,val", [(1, 1), (99, 1), (100, 1), (199, 1), (200, 2)])
def test_split_sizes(spark, n, val):
    df = spark.range(n).select(F.lit("s").alias("source"), F.col("id").alias("seq_id"))
    split = packing.train_val_split(df, ["source"])
    assert split.where("split = 'val'").count() == val
    assert split.where("split = 'train'").count() == n - val
    assert {r.position for r in split.collect()} == set(range(1, n + 1))


def test_missing_output_is_zero(spark):
    counts = spark.createDataFrame([("de", 3)], "source string, sequences long")
    got = {r.source: r.sequences for r in packing.with_missing(lang_registry(spark), counts).collect()}
    assert got["de"] == 3 and got["it"] == 0


def corpus(spark, change=None):
    """A small right corpus of two sources, or one with ``change(source, seq_id, tokens)`` made to it."""
    rows = []
    for s in ("a", "b"):
        for i in range(20):
            t = [0, *range(100, 612 - 2), 1][:512]
            rows.append((s, "val" if i == 0 else "train", i, (change or (lambda s, i, t: t))(s, i, t)))
    return spark.createDataFrame([r for r in rows if r[3] is not None], "source string, split string, seq_id long, tokens array<smallint>")


def registry(spark):
    return spark.createDataFrame([("a", 10, 0.5), ("b", 10, 0.5)], "source string, token_budget long, target_proportion double")


CORRUPT = {
    "shape": lambda s, i, t: t[:-1] if (s, i) == ("a", 3) else t,
    "id_range": lambda s, i, t: [*t[:9], 12288, *t[10:]] if (s, i) == ("b", 4) else t,
    "bos_present": lambda s, i, t: [5000, *t[1:]] if s == "a" else t,
    "eos_before_bos": lambda s, i, t: [*t[:50], 0, *t[51:]],
    "pad_rate": lambda s, i, t: [*t[:9], 2, *t[10:]] if (s, i) == ("b", 4) else t,
    "delimiter_rate": lambda s, i, t: [*t[:9], 4, *t[10:]] if (s, i) == ("b", 4) else t,
    "proportions": lambda s, i, t: None if s == "b" and 0 < i < 15 else t,
    "files": lambda s, i, t: None if s == "b" and i == 0 else t,
}


@pytest.mark.parametrize("fault", [None, "negative", "checksums", *CORRUPT])
def test_verify_finds_each_fault(spark, fault):
    change = CORRUPT.get(fault) or ((lambda s, i, t: [*t[:9], -1, *t[10:]] if i == 4 else t) if fault == "negative" else None)
    recorded = packing.build_summary(corpus(spark))
    if fault == "checksums":
        recorded = recorded.withColumn("content_hash", F.when(F.col("source") == "a", "0").otherwise(F.col("content_hash")))
    plausible = lambda packed: packed.groupBy("source").agg(F.lit(True).alias("passed"))
    checks = {r.check: r.passed for r in manifest.verify(corpus(spark, change), registry(spark), recorded if fault in (None, "checksums") else None, plausible).collect()}
    wrong = {k for k, v in checks.items() if not v}
    assert wrong == ({"id_range"} if fault == "negative" else {fault} - {None})


DAMAGE = {
    "changed": lambda df: df.withColumn("tokens", F.when(F.expr("source = 'a' AND seq_id = 7"), F.reverse("tokens")).otherwise(F.col("tokens"))),
    "lost": lambda df: df.where("NOT (source = 'a' AND seq_id = 7)"),
    "tripled": lambda df: df.unionByName(df.where("source = 'a' AND seq_id = 7")).unionByName(df.where("source = 'a' AND seq_id = 7")),
    "swapped": lambda df: df.withColumn("seq_id", F.expr("CASE WHEN source = 'a' AND seq_id = 7 THEN 8L WHEN source = 'a' AND seq_id = 8 THEN 7L ELSE seq_id END")),
    "shuffled rows": lambda df: df.orderBy(F.desc("seq_id")).repartition(7),
}


@pytest.mark.parametrize("damage", DAMAGE)
def test_checksums_find_each_damage(spark, damage, monkeypatch):
    monkeypatch.setattr(packing, "RANGE", 4)
    other = corpus(spark, lambda s, i, t: [*t[:9], 200 + i, *t[10:]])
    ranges = packing.content_ranges(other)
    checks = {r.check: r for r in manifest.verify(DAMAGE[damage](other), registry(spark), packing.content_roots(ranges), ranges=ranges).collect()}
    want = {"changed": "a/train/1", "lost": "a/train/1", "tripled": "a/train/1", "swapped": "a/train/1, a/train/2"}.get(damage)
    assert checks["checksums"].passed == (want is None) and (want is None or checks["checksums"].detail == f"1 differ: {want}")


def test_facts_against_loops(spark):
    rng = random.Random(8)
    rows = [("s", "train", i, [rng.choice([0, 0, 1, 1, 2, 4, 9, 10, 50, 12_288, -1]) for _ in range(rng.choice([1, 2, 30]))]) for i in range(60)] + [("s", "train", 99, [])]
    got = {r.seq_id: r for r in packing.row_facts(spark.createDataFrame(rows, "source string, split string, seq_id long, tokens array<smallint>")).collect()}
    for _, _, i, t in rows:
        r, inner = got[i], [k for k in range(1, len(t)) if t[k] == 0]
        assert (r.n_tokens, r.bos, r.pad, r.delimiters) == (len(t), t.count(0), t.count(2), sum(4 <= x <= 9 for x in t))
        assert (r.inner_bos, r.bad_bos) == (len(inner), sum(t[k - 1] != 1 for k in inner))
        assert (r.low, r.high) == (min(t, default=None), max(t, default=None))


def test_verify_one_source(spark):
    got = manifest.verify(corpus(spark, CORRUPT["shape"]), registry(spark), only="b")
    assert manifest.all_passed(got)


def test_manifest_counts(spark, tmp_path):
    from corpusmill.sources import readers, sinks

    row = manifest.manifest(corpus(spark), registry(spark), created="2020-01-01T00:00:00Z")
    sinks.write_manifest(row, f"{tmp_path}/manifest.json")
    got = readers.read_manifest(spark, f"{tmp_path}/manifest.json").first()
    assert got.total_train_tokens == 2 * 19 * 512 and got.total_sources == 2
    assert got.sources["a"].train.sequences == 19 and got.sources["a"].val.shape == [1, 512] and got.sources["b"].actual_proportion == 0.5


def test_preflight(spark):
    got = {r.check: r.passed for r in manifest.preflight(corpus(spark), 12288, least_tokens=1000).collect()}
    assert all(got.values()) and len(got) == 4
    assert not {r.check: r.passed for r in manifest.preflight(corpus(spark), 100).collect()}["corpus_size"]


def test_build_corpus(spark):
    rng = random.Random(1)
    docs = spark.createDataFrame([("a", i, "x" * rng.randrange(100, 900)) for i in range(60)] + [("b", i, "y" * 150) for i in range(5)], "source string, doc_no long, text string")
    from corpusmill.operators.tokenizer import byte_ids

    for first in (False, True):
        out = build.build_corpus(docs, byte_ids(F.col("text")), {"a": 20_000, "b": 5_000}, split_first=first).collect()
        assert {len(r.tokens) for r in out} == {512}
        for s, least in (("a", 20_000), ("b", 5_000)):
            n = sum(512 for r in out if r.source == s)
            assert least - 2 * 512 - 600 < n < least + 2500


def test_loaders(spark):
    sizes = spark.createDataFrame([("a", 5, 0.7), ("b", 100, 0.3), ("c", 0, 0.5)], "source string, n long, target_proportion double")
    drawn = sampling.mixture_rows(spark, sizes, 300, 4).collect()
    assert len(drawn) == 1200 and {r.source for r in drawn} == {"a", "b"}
    assert all(r.row_idx < {"a": 5, "b": 100}[r.source] for r in drawn)
    assert 160 < len({r.batch_id for r in drawn if r.source == "a"}) < 260
    slices = sampling.validation_slices(spark, sizes, 50, 8).collect()
    assert all(r.stop - r.start == {"a": 5, "b": 8}[r.source] and r.stop <= {"a": 5, "b": 100}[r.source] for r in slices)
    rows = spark.range(21).withColumnRenamed("id", "i")
    got = sampling.shuffled_epochs(rows, "i", 4, 3).collect()
    assert len(got) == 3 * 20 and all(len({r.i for r in got if r.epoch == e}) == 20 for e in range(3))
    assert sampling.epoch_batches(rows.withColumn("s", F.lit("x")), ["s"], "i", 4).count() == 20
    packed = corpus(spark)
    assert sampling.sample_rows(packed.where("split = 'train'").withColumn("seq_id", F.col("seq_id") - 1), ["source"], "seq_id", 100, 1).count() == 200


def test_batches_read_the_chunks_they_drew_from(spark):
    from corpusmill.scratch import Table

    rows = [(s, i, [i % 100] * 4) for s in ("a", "b") for i in range(400)]
    packed = spark.createDataFrame(rows, "source string, seq_id long, tokens array<smallint>")
    corpus = Table(sampling.chunked(packed, 20), ("source", "chunk")).df
    drawn = spark.createDataFrame([(0, k, "a", k) for k in (3, 5, 5, 390)], "batch_id int, slot int, source string, row_idx long")
    got = sampling.gather(drawn, corpus, 20)
    assert sorted((r.row_idx, r.tokens) for r in got.collect()) == [(3, [3] * 4), (5, [5] * 4), (5, [5] * 4), (390, [90] * 4)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    assert sorted((r.row_idx, r.tokens) for r in sampling.gather(drawn, packed).collect()) == sorted((r.row_idx, r.tokens) for r in got.collect())
