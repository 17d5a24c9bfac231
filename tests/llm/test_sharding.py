import hashlib

from oracle import assert_same

from corpusmill.llm import sharding as S

SCHEMA = "doc_id long, text string, shard string, bytes string"


def brute(rows, limit):
    """Buckets split while they are too large and hold several hashes."""
    h = lambda k: int(hashlib.md5(("" if k is None else str(k)).encode()).hexdigest()[:15], 16)
    out = {}

    def place(group, depth, prefix):
        size = sum(len((t or "").encode()) for _, t in group)
        if size <= limit or len({h(k) for k, _ in group}) == 1 or depth == 60:
            for k, _ in group:
                out[k] = ("b" + prefix, size)
            return
        for bit in "01":
            part = [r for r in group if (h(r[0]) >> (59 - depth)) & 1 == int(bit)]
            if part:
                place(part, depth + 1, prefix + bit)

    place(rows, 0, "")
    return out


def check(spark, rows, limit):
    df = spark.createDataFrame([(k, t, "x", "y") for k, t in rows], SCHEMA)
    got = S.assign_shards(df, limit).collect()
    assert len(got) == len(rows)
    want = brute(rows, limit)
    assert {r.doc_id: (r.shard, r.shard_bytes) for r in got} == want
    assert all(r.fits == (r.shard_bytes <= limit) for r in got)
    return got


def test_query_is_the_sql(spark, tiny):
    assert_same(S.op2(spark, tiny), S.ORACLE, tiny)


def test_only_oversized_buckets_split(spark):
    rows = [(i, "x" * (50_000 if i == 17 else 10 + i % 90)) for i in range(400)]
    got = check(spark, rows, 1000)
    assert [r.doc_id for r in got if not r.fits] == [17]
    assert len({r.depth for r in got}) > 2  # the rounds beyond the first histogram as well


def test_edge_cases(spark):
    check(spark, [(1, None), (2, ""), (3, "é" * 9), (None, "abc")], 5)
    rows = [(5, "x" * 40)] * 30 + [(i, "y" * 40) for i in range(6, 30)]
    df = spark.createDataFrame([(k, t, "x", "y") for k, t in rows], SCHEMA)
    got = S.assign_shards(df, 100).collect()
    assert len(got) == len(rows) and {r.shard for r in got if r.doc_id == 5} == {next(r.shard for r in got if r.doc_id == 5)}
    assert S.assign_shards(spark.createDataFrame([], SCHEMA), 10).count() == 0


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(i, "x" * 100) for i in range(100)], "doc_id long, text string")
    S.write_shards(df, f"{tmp_path}/out", 1500)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == 100 and back.groupBy("shard").count().agg({"count": "max"}).first()[0] <= 15
