import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpusmill.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, offset string, length string"
ODD = ["", None, "Plain words, and more.", "ÀÉ é \u00a0x\u2003y  z\u0085", "a<|endoftext|>b <|startoftext|>", "<|ENDOFTEXT|>", "don't I'll we're", "tab\x1cfs\x01 \x01\x01", "İI\u0307 ß ﬁ K", "\U0001f600 你好 안녕 \u1100\u1161", "x" * 3000, "12 345 ½", "ΣΑΣ σας", "e\u0301 E\u0301"]


def test_ids_are_the_tokenizers():
    words, other = P.WordTokens(PATH), Tokenizer.from_file(PATH)
    rng = random.Random(2)
    texts = [t for t in ODD if t is not None] + [" ".join(rng.choice(ODD) or "q" for _ in range(20)) for _ in range(20)]
    for _ in range(2):
        for t, ids in zip(texts, words.ids([t.encode() for t in texts]), strict=True):
            assert ids.tolist() == other.encode(t, add_special_tokens=False).ids, t
    words.limit = 1
    assert [x.tolist() for x in words.ids([b"new words"])] == [other.encode("new words", add_special_tokens=False).ids]


@pytest.mark.parametrize("seed", range(6))
def test_patterns_use_the_histogram_once(seed):
    rng = random.Random(seed)
    histogram = {rng.randrange(1, 65): rng.choice([1, 2, 7, 1000, 10**9]) for _ in range(rng.choice([1, 5, 40]))}
    packs = P.patterns(histogram, 64)
    used = Counter()
    for pack, n in packs:
        assert n > 0 and sum(pack) <= 64
        used.update({k: v * n for k, v in Counter(pack).items()})
    assert dict(used) == histogram
    rows = P.spread(packs)
    assert sum((high - low) for _, low, high, *_ in rows) == sum(histogram.values())


def test_packing_is_dense():
    rng = np.random.default_rng(0)
    histogram = dict(Counter(rng.integers(1, 2048, 20_000).tolist()))
    packs = P.patterns(histogram)
    assert sum(k * n for k, n in histogram.items()) / sum(2048 * n for _, n in packs) > 0.97


def whole(rows, texts, length):
    """Every id once, offsets without gaps, checksums right."""
    other = Tokenizer.from_file(PATH)
    at, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        at[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    for k, t in texts.items():
        ids = [*other.encode(t or "", add_special_tokens=False).ids, 1]
        mine = sorted(at[k], key=lambda r: r.start)
        assert [r.start for r in mine] == list(range(0, len(ids), length)) and sum(r.length for r in mine) == len(ids)
        for r in mine:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) and r.doc_tokens == len(ids)
    for s in seqs.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == [sum(x.length for x in s[:i]) for i in range(len(s))] and sum(r.length for r in s) <= length


def test_round_trip(spark):
    rng = random.Random(4)
    texts = {i: t for i, t in enumerate(ODD)} | {100 + i: "word " * rng.randrange(0, 400) for i in range(150)}
    df = spark.createDataFrame([(k, t, "x", "y") for k, t in texts.items()], SCHEMA)
    rows = P.pack(df, PATH, length=256).collect()
    whole(rows, texts, 256)
    assert {tuple(r) for r in rows} == {tuple(r) for r in P.pack(df.repartition(7), PATH, length=256).collect()}


def test_repeated_rows_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c", "x", "y")] * 50 + [(None, "d", "x", "y")] * 2, SCHEMA)
    rows = P.pack(df, PATH).collect()
    assert len(rows) == 52 and len({(r.sequence_id, r.offset) for r in rows}) == 52
    assert P.pack(df.limit(0), PATH).count() == 0


def test_keys_of_other_types(spark):
    df = spark.createDataFrame([("a/1", "one two"), ("b", ""), (None, "three")], "doc_id string, text string")
    assert sorted((r.doc_id or "", r.doc_tokens) for r in P.pack(df, PATH).collect()) == [("", 2), ("a/1", 3), ("b", 1)]
