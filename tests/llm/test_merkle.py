from hashlib import sha256
from zlib import crc32

import pytest
from oracle import assert_same
from pyspark.sql import functions as F

from corpusmill.llm import merkle as M

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def way(tree, i):
    for level in tree[:-1]:
        j = i ^ 1
        yield [("L" if i & 1 else "R") + level[j]] if j < len(level) else [""]
        i >>= 1


def brute(rows):
    """doc_id, leaf, subroot, root, proof of every row, whole levels at a time."""
    leaf = lambda r: h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in r])
    lows = lambda x: (x is not None, x or 0)
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((lows(r[0]), leaf(r), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([x[1] for x in sorted(groups[g], key=lambda x: x[:2])]) for g in order}
    top = levels([trees[g][-1][0] for g in order])
    for k, g in enumerate(order):
        for i, (_, lf, r) in enumerate(sorted(groups[g], key=lambda x: x[:2])):
            proof = [s for part in (way(trees[g], i), way(top, k)) for s in part]
            yield r[0], lf, trees[g][-1][0], top[-1][0], [p[0] for p in proof]


def found(df):
    leaf = M.leaf_hash(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")])
    return M.merkle_manifest(df, F.col("doc_id"), F.col("lang"), leaf)


@pytest.mark.parametrize("n", [1, 2, 3, 31, 64, 100])
@pytest.mark.parametrize("more", [0, 2])
def test_traversal_against_whole_levels(n, more):
    leaves = [h(str(i)) for i in range(n)]
    tree = levels(leaves)
    for _ in range(more):
        tree.append([h(*tree[-1])])
    height = len(tree) - 1
    assert M.tree_root(leaves, height) == tree[-1][0]
    assert list(M.paths(leaves, height)) == [[p[0] for p in way(tree, i)] for i in range(n)]


def test_the_state_is_logarithmic():
    leaves = [h(str(i)) for i in range(1 << 10)]
    whole = M.TreeHash(leaves, 0, 10)
    most = 0
    while whole.step():
        most = max(most, len(whole.stack))
    assert most <= 11


def test_against_brute_force(spark):
    rows = [(i, f"s{i % 3}", ["en", "de", None, "", "é"][min(4, i % 40)], i if i % 5 else None, ["", None, "x" * (i % 50), "ü\n"][i % 4]) for i in range(2500)]
    rows += [(None, None, None, None, None)] * 2 + [(7, "s1", "en", 7, "again"), (7, "s1", "en", 7, "again"), (9_000_000_000, "s", "en", 1, "wörter " * 40_000)]
    got = sorted((tuple(r) for r in found(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    assert got == sorted(brute(rows), key=repr)


def test_many_groups(spark):
    rows = [(i, "s", f"g{i % 1500:05d}", 1, str(i)) for i in range(3000)]
    got = sorted((tuple(r) for r in found(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()), key=repr)
    assert got == sorted(brute(rows), key=repr)


def test_empty_lone_and_clashing_names(spark):
    assert found(spark.createDataFrame([], SCHEMA)).collect() == []
    one = spark.createDataFrame([(1, "s", "en", 3, "abc")], SCHEMA)
    row = found(one).first()
    assert row.leaf == row.subroot == row.root and row.proof == []
    clash = one.select("*", *[F.lit(1).alias(c) for c in ("gid", "idx", "node", "place", "key", "group", "proof", "root", "size", "block")])
    assert found(clash).first() == row
    again = M.merkle_manifest(clash, F.col("doc_id"), F.col("lang"), F.lit("0" * 64), size=F.col("size"))
    assert again.first().size == 1


def test_folding_finds_any_change(spark):
    rows = [(i, "s", "en" if i % 2 else "de", i, f"text {i}") for i in range(21)]
    proven = found(spark.createDataFrame(rows, SCHEMA))
    other = F.sha2(F.concat("leaf", F.lit("x")), 256)
    checked = proven.select((M.folded(F.col("leaf"), F.col("proof")) == F.col("root")).alias("good"), (M.folded(other, F.col("proof")) == F.col("root")).alias("bad"))
    assert {(r.good, r.bad) for r in checked.collect()} == {(True, False)}


def test_op13_against_sql(spark, tiny):
    got = M.op13(spark, tiny)
    assert_same(got, M.ORACLE, tiny)
    bad = {r.doc_id for r in got.where("NOT verified").collect()}
    assert bad == {i for i in range(200) if crc32(str(i).encode()) % 7 == 0}
