"""Training in rounds against merging one pair at a time, and encoding by arrays against encoding text by text."""

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.operators import bpe_training as B
from corpusmill.operators import tokenizer as T


def pairs_of(words):
    out = Counter()
    for w, n in words:
        for p in zip(w, w[1:], strict=False):
            out[p] += n
    return out


def joined(w, a, b, new):
    out, i = [], 0
    while i < len(w):
        if i + 1 < len(w) and (w[i], w[i + 1]) == (a, b):
            out.append(new)
            i += 2
        else:
            out.append(w[i])
            i += 1
    return out


def one_by_one(words, names, vocab, least):
    names, words, merges = list(names), [(list(w), n) for w, n in words], []
    while len(names) < vocab:
        counts = pairs_of(words)
        if not counts or max(counts.values()) < least:
            break
        a, b = min(counts, key=lambda p: (-counts[p], p))
        merges.append((names[a], names[b]))
        if names[a] + names[b] not in names:
            names.append(names[a] + names[b])
        words = [(joined(w, a, b, names.index(names[a] + names[b])), n) for w, n in words]
    return merges


class Held:
    """What ``Words`` does, with a list."""

    def __init__(self, words):
        self.words, self.rounds, self.starts = [(list(w), n) for w, n in words], 0, 0

    def top(self, k):
        self.starts += 1
        ranked = sorted(pairs_of(self.words).items(), key=lambda x: (-x[1], x[0]))[:k]
        return dict(ranked), (-ranked[-1][1], ranked[-1][0]) if len(ranked) == k else (1, (0, 0))

    def facts(self, pairs):
        self.rounds += 1
        out = {p: (0, {}, {}) for p in pairs}
        for w, n in self.words:
            for i, p in enumerate(zip(w, w[1:], strict=False)):
                if p in out:
                    total, left, right = out[p]
                    out[p] = (total + n, left, right)
                    if i:
                        left[w[i - 1]] = left.get(w[i - 1], 0) + n
                    if i + 2 < len(w):
                        right[w[i + 2]] = right.get(w[i + 2], 0) + n
        return out

    def apply(self, merges):
        for a, b, new in merges:
            self.words = [(joined(w, a, b, new), n) for w, n in self.words]


def in_rounds(words, names, vocab, least):
    held = Held(words)
    return B.learned(held.top, held.facts, held.apply, list(names), vocab, least), held


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text(st.sampled_from("abc"), min_size=2, max_size=9), st.integers(1, 6)), max_size=12), st.integers(1, 4), st.integers(1, 6), st.integers(2, 30))
def test_rounds_give_the_order_of_single_merges(texts, least, candidates, known):
    words = [([ord(c) - 97 for c in w], n) for w, n in texts]
    before = B.CANDIDATES, B.KNOWN
    B.CANDIDATES, B.KNOWN = candidates, known
    try:
        got, _ = in_rounds(words, "abc", 40, least)
    finally:
        B.CANDIDATES, B.KNOWN = before
    assert got == one_by_one(words, "abc", 40, least)


@pytest.mark.parametrize("seed", range(3))
def test_a_round_takes_many_merges(seed):
    rng = random.Random(seed)
    names = [chr(97 + i) for i in range(20)]
    words = [([min(19, int(rng.expovariate(0.2))) for _ in range(rng.randint(2, 8))], rng.randint(1, 9)) for _ in range(1500)]
    got, held = in_rounds(words, names, 150, 3)
    assert got == one_by_one(words, names, 150, 3)
    assert held.rounds < len(got) / 3


def test_arrays_merge_as_lists_do():
    rng = random.Random(5)
    words = [[rng.randrange(3) for _ in range(rng.randint(1, 9))] for _ in range(200)]
    merges = [(0, 0, 3), (1, 2, 4), (3, 3, 5), (4, 4, 6), (3, 0, 7)]
    v = np.array([x for w in words for x in w])
    end = np.zeros(len(v), bool)
    end[np.cumsum([len(w) for w in words]) - 1] = True
    got, last, weight = B.merged(v, end, np.arange(len(v)), merges)
    held = Held([(w, 1) for w in words])
    held.apply(merges)
    assert [x.tolist() for x in np.split(got, np.flatnonzero(last)[:-1] + 1)] == [w for w, _ in held.words] and len(weight) == len(got)


@pytest.mark.parametrize("pending", [256, 3])
def test_on_spark(spark, monkeypatch, pending):
    monkeypatch.setattr(B, "PENDING", pending)
    rng = random.Random(7)
    texts = [" ".join("".join(rng.choice("aabcdé") for _ in range(rng.randint(1, 6))) for _ in range(40)) for _ in range(30)] + ["", "x", "aaaaaaaa"]
    counts = T.pre_token_counts(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    names = [*T.SPECIAL_TOKENS, *T.byte_symbols()]
    rows = [([b + T.FIRST_BYTE for b in r.word.encode()], r.n) for r in counts.collect()]
    assert T.train(counts, 340).merges == one_by_one(rows, names, 340, 3)
    assert T.train(counts.limit(0), 340).merges == []


def test_encoding_by_arrays(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["SELECT", "<schema>", "naïve x", "12", "  ", "\n", "</sql>!", "a<sql>b", "\U0001f600", "'s"]) for _ in range(rng.randint(0, 30))) for _ in range(200)]
    texts += ["", " ", "<bos>", "a" * 50_000, "\x1c \x85 y", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    bpe = T.train(T.pre_token_counts(df), 330)
    got = {r.i: r for r in df.repartition(3).select("i", T.encoder(bpe)(F.col("text")).alias("ids")).withColumn("back", T.decoder(bpe)(F.col("ids"))).collect()}
    special = {s: i for i, s in enumerate(bpe.special)}
    for i, t in enumerate(texts):
        assert got[i].ids == (None if t is None else bpe.encode(t))
        if t is None:
            assert got[i].back is None
        else:
            for s in special:
                t = t.replace(s, "")
            assert got[i].back == t


def test_a_word_is_merged_by_rank_from_the_left():
    bpe = T.Bpe([("a", "b"), ("b", "a"), ("ab", "ab"), ("a", "a")])

    def slowly(text):
        parts = list(text)
        while True:
            found = [(bpe.rank[p], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in bpe.rank]
            if not found:
                return [bpe.ids[p] for p in parts]
            _, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 14)))
        assert bpe.word(text) == slowly(text)


def test_decoding_broken_characters():
    bpe = T.Bpe([])
    ids = [b + T.FIRST_BYTE for b in "é!".encode()]
    assert bpe.decode([0, *ids, 1, 99_999]) == "é!" and bpe.decode(ids[1:]) == "�!" and bpe.decode([]) == ""
