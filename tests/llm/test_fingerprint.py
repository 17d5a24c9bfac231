import hashlib
import random

import numpy as np
import pytest

from corpusmill.llm import fingerprint as P

SCHEMA = "doc_id long, text string, n_chars string, kind string"


def brute(text):
    """The fingerprint by loops over plain numbers."""
    import math
    import re
    from collections import Counter

    data = " ".join(re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))).encode()
    if not data:
        return 0
    data = data.ljust(6)
    votes = [0] * 64
    for term, n in Counter(data[i : i + 6] for i in range(len(data) - 5)).items():
        h = int.from_bytes(term, "little")
        for factor, shift in ((0x9E3779B97F4A7C15, 32), (0xC2B2AE3D27D4EB4F, 29), (0x9E3779B97F4A7C15, 32)):
            h = h * factor % 2**64
            h ^= h >> shift
        for b in range(64):
            votes[b] += (16 + math.floor(16 * math.log2(n))) * (1 if h >> b & 1 else -1)
    return sum(1 << b for b in range(64) if votes[b] > 0)


def rows_of(spark, texts, parts=3):
    df = spark.createDataFrame([(k, t, "x", "y") for k, t in texts], SCHEMA).repartition(parts)
    return P.edited_fingerprints(df).collect()


@pytest.mark.parametrize("parts", [1, 5])
def test_contract(spark, parts):
    rng = random.Random(parts)
    texts = [(i, " ".join(rng.choice(["é", "\U0001f600x", "word", "Other"]) for _ in range(rng.randrange(0, 60)))) for i in rng.sample(range(10_000), 80)]
    texts[7] = (texts[7][0], None)
    texts[8] = (texts[8][0], "long " * 40_000)
    got = {r.doc_id: r for r in rows_of(spark, texts, parts)}
    order = sorted((k, t or "") for k, t in texts)
    assert len(got) == len(order)
    for i, (k, t) in enumerate(order):
        after = order[(i + 1) % len(order)]
        q = len(t) // 4
        e = t[: len(t) - q] + after[1][:q]
        r = got[k]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert r.fingerprint == f"{brute(t):016x}" and r.edited_fingerprint == f"{brute(e):016x}"
        assert r.near_next == P.likeness(int(r.fingerprint, 16), int(got[after[0]].fingerprint, 16))
        assert r.near_edited == P.likeness(int(r.fingerprint, 16), int(r.edited_fingerprint, 16))


def test_edge_cases(spark):
    (one,) = rows_of(spark, [(5, "abcdefgh")])
    assert one.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and one.near_next == 1.0
    assert len(rows_of(spark, [(1, "a"), (1, "a"), (None, "b"), (2, None)])) == 4
    assert P.edited_fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0


def test_edits_stay_near(spark):
    rows = P.op9(spark, "/root/testdata/sf0.001").collect()
    assert np.mean([r.near_edited > r.near_next for r in rows]) > 0.95
    assert np.mean([r.near_edited for r in rows]) > 0.7 and np.mean([r.near_next for r in rows]) < 0.6


def test_length_alone_changes_little():
    rng = random.Random(2)
    for n in (60, 119, 120, 121, 500):
        apart = []
        for _ in range(60):
            text = "".join(rng.choice("abcdefghij ") for _ in range(n)).encode()
            apart.append(P.likeness(P.simhash(text), P.simhash(text + b"x")))
        assert np.mean(apart) > 0.87


def test_query_counts_neighbours(spark):
    rows = P.op9(spark, "/root/testdata/sf0.001").collect()
    fps = [int(r.fingerprint, 16) for r in rows]
    for i, r in enumerate(rows):
        near = [(fps[i] ^ f).bit_count() for k, f in enumerate(fps) if k != i and (fps[i] ^ f).bit_count() <= 3]
        assert (r.near_texts, r.nearest) == ((len(near), min(near, default=None)) if r.doc_id % 50 == 0 else (None, None))


def test_neighbours(spark):
    fps = [0, 0, 0, 7, 15, 1 << 40, -1]
    df = spark.createDataFrame([(x,) for x in [*fps, None]], "fp long")
    got = {r.fp: (r.near_texts, r.nearest) for r in P.neighbours(df.where("fp IN (0, 15, -1)"), df).collect()}
    assert got == {0: (4, 0), 15: (1, 1), -1: (0, None)}
    assert [P.blocks_for(n, 3) for n in (1, 1 << 16, 1 << 18, 1 << 30, 1 << 40)] == [4, 4, 5, 6, 8]
    assert P.neighbours(df.limit(0), df.limit(0)).count() == 0


@pytest.mark.parametrize("radius", [1, 3])
def test_block_tables_find_all(spark, radius):
    rng = random.Random(radius)
    fps = {rng.getrandbits(64) for _ in range(30)}
    fps |= {x ^ sum(1 << i for i in rng.sample(range(64), rng.randrange(1, 6))) for x in list(fps) for _ in range(4)}
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    df = spark.createDataFrame([(x,) for x in signed] * 2, "fp long")
    queries = df.where("fp % 3 = 0")
    got = {(r.query, r.fp): r.distance for r in P.find_within(queries, df, radius).collect()}
    apart = lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count()
    want = {(a, b): apart(a, b) for a in signed if np.fmod(a, 3) == 0 for b in signed if apart(a, b) <= radius}
    assert got == want


def test_keys_of_other_types(spark):
    df = spark.createDataFrame([("b", "second text"), ("a", "first text"), (None, "none")], "doc_id string, text string")
    got = {r.doc_id: r.edited_sha256 for r in P.edited_fingerprints(df).collect()}
    assert got == {None: hashlib.sha256(b"nonf").hexdigest(), "a": hashlib.sha256(b"first tese").hexdigest(), "b": hashlib.sha256(b"second teno").hexdigest()}
