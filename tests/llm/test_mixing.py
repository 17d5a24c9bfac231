import numpy as np
import pytest

from corpusmill.llm import mixing as M

SCHEMA = "doc_id long, text string, source string, target string, taken string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", "y") for i, t, s in rows], SCHEMA)


def want_targets(sizes, weights=3, most=3):
    """Water filling by rounds: whatever is above its limit is cut, and the rest shared anew."""
    order = sorted(k for k in sizes if k is not None) + ([None] if None in sizes else [])
    weight = {k: 1 + i % weights for i, k in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [k for k in order if k not in fixed]
        rest = total - sum(fixed.values())
        share = {k: rest * weight[k] / sum(weight[f] for f in free) for k in free}
        over = [k for k in free if share[k] > most * sizes[k]]
        if not over:
            return {**fixed, **share}
        fixed |= {k: most * sizes[k] for k in over}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 100, "b": 1, "c": 2, None: 50}, {"é": 5, "z": 500, "A": 3}, {"a": 7}, {"a": 0, "b": 9}])
def test_targets(spark, sizes):
    rows = [(i, "w " * n, s) for i, (s, n) in enumerate(sizes.items())]
    got = {r.source: r.target for r in M.mix(docs(spark, rows)).collect()}
    assert got == pytest.approx(want_targets(sizes))


def test_balance_and_limits(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "w " * int(rng.integers(0, 300)), "abcd"[min(3, i % 7)]) for i in range(3000)]
    got = M.mix(docs(spark, rows)).collect()
    assert len(got) == 3000 and all(0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size for r in got)
    for s in "abcd":
        mine = [r for r in got if r.source == s]
        assert sum(r.taken for r in mine) == pytest.approx(mine[0].target, abs=3)
        # documents are balanced too, beside words
        assert sum(r.copies for r in mine) == pytest.approx(len(mine) * mine[0].target / mine[0].source_size, abs=8)
    again = M.mix(docs(spark, rows).repartition(5)).collect()
    assert {(r.doc_id, r.taken) for r in got} == {(r.doc_id, r.taken) for r in again}


def test_flight_keeps_both_sums():
    rng = np.random.default_rng(0)
    size, p = rng.integers(1, 9, 500).astype(float), np.full(500, 0.37)
    done = M.flight(size, p, rng.random(500))
    assert ((done > 0) & (done < 1)).sum() <= 2
    assert done.sum() == pytest.approx(p.sum()) and (done * size).sum() == pytest.approx((p * size).sum())


def test_inclusion_probabilities_hold():
    size, p = np.arange(1.0, 13.0), np.full(12, 0.25)
    mean = np.mean([M.flight(size, p, np.random.default_rng(s).random(40)) for s in range(3000)], axis=0)
    assert mean == pytest.approx(p, abs=0.04)


def test_edge_cases(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "x", None), (4, "x y", None), (4, "x y", None), (5, "z " * 50_000, "b"), (None, "q", "b")]
    got = M.mix(docs(spark, rows)).collect()
    assert len(got) == 7 and all(r.taken == 0 for r in got if r.size == 0) and max(r.size for r in got) == 50_000
    assert M.mix(docs(spark, []).select("doc_id", "text", "source")).count() == 0
    only_empty = M.mix(docs(spark, [(1, None, "a"), (2, "", "b")])).collect()
    assert [r.taken for r in only_empty] == [0, 0]


def test_mixed_rows(spark):
    rows = [(i, "w " * (5 + i % 11), "ab"[i % 2]) for i in range(200)] + [(None, "n", "a")]
    plan = {r.doc_id: r.copies for r in M.mix(docs(spark, rows[:-1])).collect()}
    out = M.mixed(docs(spark, rows))
    assert out.columns == ["doc_id", "text", "source", "target", "taken"]
    counts = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert counts == {k: v for k, v in plan.items() if v} | {None: 1}
