"""Running sums over clustered keys, and means over logs with gaps, against loops."""

import random

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import evaluation, prefix, training_log


def test_buckets_of_clustered_keys_are_even(spark):
    # 99 of 100 rows lie in a thousandth of the range.
    df = spark.range(100_000).select(F.when(F.col("id") % 100 == 0, F.col("id") * 1_000_000).otherwise(F.col("id")).alias("k"))
    starts = prefix.bucket_starts(df, "k", 1000)
    sizes = [r["count"] for r in prefix.with_bucket(df, "k", starts).groupBy("_bucket").count().collect()]
    assert len(sizes) >= 90 and max(sizes) <= 4 * min(sizes)


@pytest.mark.parametrize("rows", [20_000, 7])
def test_sums_over_any_keys(spark, rows):
    rng = random.Random(rows)
    table = [(rng.choice("ab"), rng.choice([rng.randrange(20), rng.randrange(10**15), -rng.randrange(5), 2**62 + rng.randrange(9)]), i, rng.randrange(9)) for i in range(400)] + [("a", None, 500 + i, 3) for i in range(5)]
    df = spark.createDataFrame(table, "g string, k long, i int, v int").repartition(5)
    got = {r.i: (r.s, r.c) for r in prefix.exclusive_sums(df, ["g"], ["k", "i"], {"s": F.col("v"), "c": F.lit(1)}, rows).collect()}
    want, held = {}, {}
    for g, _, i, v in sorted(table, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        s, c = held.get(g, (0, 0))
        want[i] = (s, c)
        held[g] = (s + v, c + 1)
    assert got == want
    assert prefix.exclusive_sum(df.limit(0), ["g"], ["k"], "v", "s", rows).count() == 0


def test_no_window_over_all_rows(spark):
    # The one window without buckets runs over their sums, of which there are a bounded number.
    df = spark.range(1000).select("id", F.lit(1).alias("one"), F.lit(0).alias("g"))
    plan = prefix.exclusive_sum(df, ["g"], ["id"], "one", "s", 10)._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.splitlines() if "Window [" in x]
    assert len(windows) == 2 and sum("_sum_s" in x for x in windows) == 1
    assert all("_sum_s" in x or "_bucket" in x.split("windowspecdefinition")[1].split("ASC")[0] for x in windows)


@pytest.mark.parametrize("window, rows", [(100, 20_000), (100, 50), (7, 10), (40, 3), (1, 5)])
def test_trailing_means_of_a_log_with_gaps(spark, window, rows):
    rng = random.Random(window)
    log, step = [], 0
    for _ in range(600):
        step += rng.choice([1, 1, 10, 3000])
        log.append((step, "val" if rng.random() < 0.2 else "train", rng.random()))
    log += [(step, "train", 5.0), (step, "train", 6.0)]
    train = sorted((s, x) for s, k, x in log if k == "train")
    want = sorted((s, round(sum(x for _, x in train[max(0, i - window + 1) : i + 1]) / min(window, i + 1), 9)) for i, (s, _) in enumerate(train) if s % 5 == 0)
    df = spark.createDataFrame(log, "step long, kind string, loss double")
    got = sorted((r.step, round(r["mean"], 9)) for r in training_log.trailing_mean(df, window, 5, rows).collect())
    assert got == want


def test_running_rates(spark):
    rng = random.Random(3)
    rows = [(i, rng.random() < 0.3, rng.random() < 0.6) for i in range(950)]
    got = sorted(tuple(r) for r in evaluation.running_rates(spark.createDataFrame(rows, "i long, em boolean, ex boolean"), "i", 100).collect())
    want = [(n, sum(r[1] for r in rows[:n]) / n, sum(r[2] for r in rows[:n]) / n) for n in [*range(100, 901, 100), 950]]
    assert got == want
