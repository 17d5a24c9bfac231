import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import simhash_dedup as S
from corpusmill.llm.common import components

SCHEMA = "doc_id long, text string, fp string, component_id string"


def classes(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    n = 60
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(35)] + [(i, i + 1) for i in range(40, 59)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = classes(n, edges)
    assert got == {i: want[i] for i in {x for e in edges if e[0] != e[1] for x in e}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_links_find_every_distance(spark):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(40)]
    near = [b ^ sum(1 << i for i in rng.sample(range(64), rng.randrange(1, 6))) for b in base for _ in range(4)]
    dense = [base[0] ^ (1 << i) ^ (1 << j) for i, j in itertools.combinations(range(0, 64, 5), 2)]
    inside = [base[1] ^ (m << (16 * k)) for k in range(4) for m in (7, 0x8001, 0xE000)]  # all three bits in one block
    every = sorted({x - (1 << 64) if x >> 63 else x for x in [*base, *near, *dense, *inside, 0, (1 << 64) - 1, 7]})
    got = S.link_fingerprints(spark.createDataFrame([(x,) for x in every], "fp long")).collect()
    at = {x: i for i, x in enumerate(every)}
    apart = lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count()
    assert all(apart(r.a, r.b) <= 3 for r in got)
    want = classes(len(every), [(i, j) for i, j in itertools.combinations(range(len(every)), 2) if apart(every[i], every[j]) <= 3])
    assert classes(len(every), [(at[r.a], at[r.b]) for r in got]) == want


def keys_of(fp):
    """All rows (key, rest) of one fingerprint, bit by bit."""
    out = []
    for j in range(4):
        bits = [i for i in range(64) if not 16 * j <= i < 16 * j + 16]
        part = sum((fp >> i & 1) << k for k, i in enumerate(bits))
        own = fp >> 16 * j & 0xFFFF
        out += [(j << 48 | part ^ (1 << k), k << 16 | own) for k in range(48)] + [(j << 48 | part, 63 << 16 | own)]
    return out


def test_rebuilt_fingerprints():
    rng = random.Random(2)
    for fp in [0, (1 << 64) - 1, 1 << 63, *(rng.getrandbits(64) for _ in range(20))]:
        key, rest = (np.array(x, np.uint64) for x in zip(*keys_of(fp), strict=True))
        assert set(S.rebuilt(key, rest).tolist()) == {fp} and len(set(key.tolist())) == 196


def test_buckets_across_batches():
    rng = random.Random(0)
    base = [rng.getrandbits(64) for _ in range(8)]
    rows = sorted(x for f in {b ^ sum(1 << i for i in rng.sample(range(64), 2)) for b in base for _ in range(5)} for x in keys_of(f))
    key, rest = (np.array(x, np.int64) for x in zip(*rows, strict=True))
    import pyarrow as pa

    def run(size):
        batches = (pa.RecordBatch.from_arrays([pa.array(key[i : i + size]), pa.array(rest[i : i + size])], names=["key", "rest"]) for i in range(0, len(key), size))
        return {tuple(sorted(x)) for b in S._meet(3)(batches) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)}

    assert run(1) == run(7) == run(100) == run(50000) and run(7)
    assert list(S._meet(3)(iter([]))) == []


def brute_fp(text, words=3):
    from xxhash import xxh64_intdigest

    import re

    parts = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not parts:
        return 0
    h = [xxh64_intdigest(" ".join(parts[i : i + words]).encode(), 42) for i in range(max(1, len(parts) - words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_contract(spark):
    texts = [None, "", " \n", "A b", "a B", "É É é\u00a0x y", "one two three four", "One  two\tthree four", "a\x0bb\x1cc d e", "w " * 30_000, " ".join(map(str, range(2000)))]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r for r in S.simhash_components(df).collect()}
    fps = [brute_fp(t) for t in texts]
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{x:016x}" for x in fps]
    want = classes(len(texts), [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if (fps[i] ^ fps[j]).bit_count() <= 3])
    assert [got[i].component_id for i in range(len(texts))] == want


def test_same_hash_as_spark(spark):
    df = spark.createDataFrame([("the quick Brown",), ("é € x",)], "t string").select("t", F.xxhash64(F.lower("t")).alias("h"))
    assert all(int(S.shingle_hashes(r.t.encode(), 3)[0]) == r.h % 2**64 for r in df.where("t <> 'x'").collect())


def test_repeated_rows_null_keys_and_empty(spark):
    df = spark.createDataFrame([(3, "a b c", "", "")] * 3 + [(None, "a b c", "", ""), (9, "q", "", "")], SCHEMA)
    got = S.simhash_components(df).collect()
    assert len(got) == 5 and {r.component_id for r in got} == {3, 9}
    assert S.simhash_components(df.limit(0)).count() == 0
    assert S.drop_near_duplicates(df.limit(0)).count() == 0


def edited(rng, words, n):
    words = list(words)
    for i in rng.sample(range(len(words)), n):
        words[i] = f"new{rng.random()}"
    return " ".join(words)


def test_near_copies_go_and_others_stay(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, copies = [], 0
    for g in range(60):
        words = rng.choices(vocabulary, k=400)
        rows.append((g * 10, " ".join(words), "", ""))
        for k in range(1, 4):  # similarities of about 1, 0.95 and 0.88
            rows.append((g * 10 + k, edited(rng, words, 2 * k - 2), "", ""))
            copies += 1
        half = rng.choices(vocabulary, k=200)
        rows.append((g * 10 + 5, " ".join([*words[:200], *half]), "", ""))  # a third alike: no near copy
    rows += [(1000, "", "", ""), (1001, None, "", ""), (1002, "", "", ""), (None, " ".join(words), "", "")]
    left = {r.doc_id for r in S.drop_near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {g * 10 for g in range(60)} | {g * 10 + 5 for g in range(60)} | {1000, 1001, 1002, None} <= left
    assert len(left) <= 124 + 0.03 * copies


def test_big_group_of_near_copies(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, edited(rng, words, 1), "", "") for i in range(700)] + [(i, "same text again and again", "", "") for i in range(700, 1400)]
    left = S.drop_near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r.doc_id for r in left) == [0, 700]


def alike(a, b, words=5):
    sets = []
    for text in (a, b):
        w = text.lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def grouped(spark, texts):
    rows = [(i, t, "", "") for i, t in enumerate(texts)]
    got = {r.doc_id: r.component_id for r in S.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    return [got[i] for i in range(len(texts))]


def family(rng, n, edits, words=200):
    base = [f"w{rng.random()}" for _ in range(words)]
    return [edited(rng, base, edits) for _ in range(n)]


def test_families_below_the_limit_stay(spark):
    rng = random.Random(11)
    texts = [t for _ in range(3) for t in family(rng, 120, 4)]  # within a family about 0.67 alike
    links = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if i // 120 == j // 120 and alike(texts[i], texts[j]) >= 0.8]
    assert len(links) < 30
    assert grouped(spark, texts) == classes(len(texts), links)


def test_links_in_a_half_alike_family_are_found(spark):
    rng = random.Random(12)
    texts = []
    for t in family(rng, 60, 8):  # about a half alike; each has a copy that is 0.83 alike
        texts += [t, edited(rng, t.split(), 4)]
    links = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if alike(texts[i], texts[j]) >= 0.8]
    assert len(links) >= 55
    assert grouped(spark, texts) == classes(len(texts), links)


def test_no_pair_at_the_limit_is_lost(spark):
    rng = random.Random(13)
    texts = []
    for _ in range(80):
        words = [f"w{rng.random()}" for _ in range(404)]
        texts += [" ".join(words), " ".join([*words[:360], *(f"v{rng.random()}" for _ in range(44))])]  # 356 of 444 shingles: 0.80
    links = [(i, i + 1) for i in range(0, 160, 2) if alike(texts[i], texts[i + 1]) >= 0.8]
    assert len(links) == 80
    assert grouped(spark, texts) == classes(len(texts), links)


def simhash(text):
    return S.majority(S.shingle_set(text.encode(), 5, S.WordHashes()))


def test_near_copies_meet_by_ball_hashing(spark, monkeypatch):
    """With nothing but ball hashing, all that lies within five bits and is alike is joined; the rest joins what lies further apart."""
    rng = random.Random(21)
    texts = [t for _ in range(25) for t in family(rng, 6, 1, 400)]
    texts += [" ".join(["same", "words", "over"] * k) for k in (40, 50)] + ["short text", "Short  text"]
    texts += [t for _ in range(10) for t in family(rng, 2, 8, 300)]
    links = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if alike(texts[i], texts[j]) >= 0.8]
    near = [(i, j) for i, j in links if (simhash(texts[i]) ^ simhash(texts[j])).bit_count() <= 5]
    assert 100 < len(near) < len(links)
    assert grouped(spark, texts) == classes(len(texts), links)
    none = lambda names: lambda similarity: lambda batches: iter([b for b in batches if not b])  # noqa: ARG005, E731
    monkeypatch.setattr(S, "_trees", none("kind a b n pos"))
    monkeypatch.setattr(S, "_rest", none("a b"))
    got, whole = grouped(spark, texts), classes(len(texts), links)
    assert all(got[i] == got[j] for i, j in near)
    assert all(whole[i] == whole[g] for i, g in enumerate(got)) and got != whole


def test_ball_pairs_join_all_within_five_bits(spark):
    rng = random.Random(22)
    base = [rng.getrandbits(63) for _ in range(30)]
    sims = [b ^ sum(1 << i for i in rng.sample(range(63), rng.randrange(1, 6))) for b in base for _ in range(4)] + base + [x ^ ~0 for x in base[:3]]
    rows = [(rng.getrandbits(62), None, s) for s in sims]
    pairs = [(r.a, r.b) for r in S.ball_pairs(spark.createDataFrame(rows, "fp long, key long, sim long")).collect()]
    at = {fp: i for i, (fp, _, _) in enumerate(rows)}
    apart = lambda i, j: ((sims[i] ^ sims[j]) & (2**64 - 1)).bit_count()
    near = [(i, j) for i, j in itertools.combinations(range(len(sims)), 2) if apart(i, j) <= 5]
    assert len(near) > 100 and all(a < b and apart(at[a], at[b]) <= S.FAR for a, b in pairs)
    joined = classes(len(sims), [(at[a], at[b]) for a, b in pairs])
    assert all(joined[i] == joined[j] for i, j in near)
    assert S.ball_pairs(spark.createDataFrame([], "fp long, key long, sim long")).count() == 0


@pytest.mark.parametrize("split", [4096, 3])
def test_large_buckets_are_split(spark, monkeypatch, split):
    # Texts that share a shingle which all have, and differ otherwise in part: every pair at 0.8 is found, none below.
    monkeypatch.setattr(S, "SPLIT", split)
    rng = random.Random(6)
    common = [f"c{i}" for i in range(40)]
    texts = {}
    for i in range(80):
        own = [f"o{i % 20}x{k}" for k in range(rng.randint(0, 14))]
        texts[i] = " ".join([*common, *own])
    df = spark.createDataFrame([(k, t, "", "") for k, t in texts.items()], SCHEMA)
    sets = {k: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for k, w in ((k, t.split()) for k, t in texts.items())}
    links = [(a, b) for a, b in itertools.combinations(texts, 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    want = dict(enumerate(classes(len(texts), links)))
    assert {r.doc_id: r.component_id for r in S.near_duplicates(df).collect()} == want


def test_blocks_have_every_pair_once(spark, monkeypatch):
    monkeypatch.setattr(S, "SPLIT", 4)
    rows = [(7, i, 10, 0, i) for i in range(30)] + [(8, i, 10, 0, i) for i in range(3)]
    held = {}
    for r in S.blocks(spark.createDataFrame(rows, "shingle long, fp long, n int, pos int, root long")).collect():
        held.setdefault(r.block, []).append((r.fp, r.side))
    pairs = [tuple(sorted((a, b))) for members in held.values() for (a, s), (b, t) in itertools.combinations(members, 2) if s != t or s == 2]
    want = [*itertools.combinations(range(30), 2), *itertools.combinations(range(3), 2)]
    assert sorted(pairs) == sorted(want) and len(held) > 10


def test_clashing_names(spark):
    words = " ".join(f"w{i}" for i in range(30))
    names = ["fp", "n", "pos", "shingle", "root", "component_id", "key", "low", "block", "side"]
    df = spark.createDataFrame([(i, words, *[i] * len(names)) for i in range(3)] + [(None, words, *[9] * len(names)), (5, None, *[5] * len(names)), (6, "", *[6] * len(names))], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    left = S.drop_near_duplicates(df)
    assert left.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id or 0, r.root) for r in left.collect()) == [(False, 0, 0), (False, 5, 5), (False, 6, 6), (True, 0, 9)]
