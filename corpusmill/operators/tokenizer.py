"""A byte-level BPE tokenizer: pre-tokens, training, encoding, decoding and its checks.

Training counts pre-tokens and merges in rounds (``bpe_training``). Texts are split by built-in expressions; a task encodes each
distinct pre-token of an Arrow batch once and puts the ids of all occurrences together by arrays, without a loop over texts.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, ShortType

from corpusmill.constants import FIRST_BYTE, SPECIAL_TOKENS, UNK, VOCAB_SIZE
from corpusmill.functions.text import word_count
from corpusmill.operators import bpe_training

#: Fixed value: single digits, contractions, words and symbols each with at most one blank before, white space.
PRE_TOKEN = r"\p{N}|'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?[^\t-\r\x85\p{Z}\p{L}\p{N}]+|[\t-\r\x85\p{Z}]+(?![^\t-\r\x85\p{Z}\p{N}])|[\t-\r\x85\p{Z}]+"


@functools.cache
def byte_symbols() -> tuple[str, ...]:
    """A printable character for each byte: itself where it is printable, else the next code point from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return tuple(chr(b) if b in plain else chr(next(spare)) for b in range(256))


def pre_tokens(text: Column) -> Column:
    """The pre-tokens of a text, as an array, by a built-in expression."""
    return F.regexp_extract_all(text, F.lit(f"({PRE_TOKEN})"), 1)


def pieces(text: Column, special: tuple[str, ...] = SPECIAL_TOKENS) -> Column:
    """Special tokens that a text spells out, and the pre-tokens of what lies between them."""
    names = "|".join(re.escape(s) for s in sorted(special, key=len, reverse=True))
    marks = F.array(*map(F.lit, special))
    split = F.transform(F.split(text, f"(?={names})|(?<={names})"), lambda p: F.when(F.array_contains(marks, p), F.array(p)).otherwise(pre_tokens(p)))
    return F.when(F.rlike(text, F.lit(names)), F.flatten(split)).otherwise(pre_tokens(text))


def pre_token_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """``word, n``: how often each pre-token occurs. Counts are summed before the shuffle."""
    return texts.select(F.explode(pre_tokens(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def _ids_of_bytes(texts: pa.Array) -> pa.Array:
    data = texts.cast(pa.binary())
    if data.offset:
        data = pa.concat_arrays([data.slice(0, 0), data])
    ends = np.frombuffer(data.buffers()[1], np.int32, len(data) + 1) if len(data) else np.zeros(1, np.int32)
    flat = np.frombuffer(data.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].astype(np.int16) + np.int16(FIRST_BYTE)
    return pa.ListArray.from_arrays(pa.array(ends - ends[0]), pa.array(flat), mask=data.is_null() if data.null_count else None)


# Where a plan names the ids more than once, they are still made once, but no filter passes them.
_byte_ids = F.arrow_udf(_ids_of_bytes, ArrayType(ShortType())).asNondeterministic()
_plain_byte_ids = F.arrow_udf(_ids_of_bytes, ArrayType(ShortType()))


def byte_ids(text: Column, once: bool = True) -> Column:
    """The bytes of a text as ids behind the special ones: a tokenizer without any training.

    Without ``once``, filters on other columns pass this one on their way down; name it in one place only.
    """
    return _byte_ids(text) if once else _plain_byte_ids(text)


@dataclass
class Bpe:
    """A vocabulary (special tokens, then bytes, then merged symbols in order of training) and its merges."""

    merges: list[tuple[str, str]]
    special: tuple[str, ...] = SPECIAL_TOKENS
    ids: dict[str, int] = field(init=False)
    rank: dict[tuple[str, str], int] = field(init=False)

    def __post_init__(self) -> None:
        names = [*self.special, *byte_symbols()]
        seen = set(names)
        for a, b in self.merges:
            if a + b not in seen:
                seen.add(a + b)
                names.append(a + b)
        self.ids = {name: i for i, name in enumerate(names)}
        self.rank = {pair: i for i, pair in enumerate(self.merges)}
        self.names = names

    @property
    def size(self) -> int:
        return len(self.names)

    def to_json(self) -> str:
        return json.dumps({"special": list(self.special), "merges": [list(m) for m in self.merges]}, ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> Bpe:
        found = json.loads(text)
        return cls([tuple(m) for m in found["merges"]], tuple(found["special"]))

    def fingerprint(self) -> str:
        return hashlib.sha256(self.to_json().encode()).hexdigest()

    @functools.cached_property
    def _joins(self) -> dict[tuple[int, int], tuple[int, int]]:
        """Each pair's rank and the symbol that it becomes."""
        return {(self.ids[a], self.ids[b]): (i, self.ids[a + b]) for i, (a, b) in enumerate(self.merges)}

    def word(self, text: str) -> list[int]:
        """Ids of one pre-token: the earliest learned pair merges first, from the left. In n log n for n bytes."""
        ids = [self.ids[byte_symbols()[b]] for b in text.encode()]
        n, joins = len(ids), self._joins
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(*joins[p], i, p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in joins]
        heapq.heapify(heap)
        while heap:
            _, new, i, pair = heapq.heappop(heap)
            j = after[i]
            if j >= n or (ids[i], ids[j]) != pair:  # one of the two has merged meanwhile
                continue
            ids[i], ids[j] = new, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (p := (ids[left], ids[right])) in joins:
                    heapq.heappush(heap, (*joins[p], left, p))
        return [x for x in ids if x >= 0]

    @functools.cached_property
    def _split(self):
        import regex

        return regex.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")"), regex.compile(PRE_TOKEN)

    def encode(self, text: str) -> list[int]:
        """Ids of one text, on the driver. Special tokens that the text spells out become their ids."""
        special, pattern = self._split
        parts = enumerate(special.split(text))
        return [x for i, part in parts for x in ([self.ids[part]] if i % 2 else [x for w in pattern.findall(part) for x in self.word(w)])]

    @functools.cached_property
    def _bytes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What each id stands for, nothing for special tokens: all bytes end to end, where an id's begin, and how many it has."""
        back = {s: b for b, s in enumerate(byte_symbols())}
        parts = [b""] * len(self.special) + [bytes(back[c] for c in n) for n in self.names[len(self.special) :]]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(sizes) - sizes, sizes

    def decode(self, ids) -> str:
        """The text of ids; special tokens are left out, and bytes that aren't UTF-8 become replacement characters."""
        return self.decode_all(np.asarray(ids, np.int64), np.array([0, len(ids)]))[0].as_py()

    def decode_all(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The texts of lists of ids that stand end to end."""
        data, starts, sizes = self._bytes
        good = (ids >= 0) & (ids < len(starts))
        safe = np.where(good, ids, 0)
        many = np.where(good, sizes[safe], 0)
        ends = np.concatenate(([0], np.cumsum(many)))
        found = data[np.arange(ends[-1]) + np.repeat(starts[safe] - ends[:-1], many)]
        cuts = ends[offsets].astype(np.int32)
        texts = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(found.tobytes())])
        try:
            return texts.cast(pa.string())
        except pa.ArrowInvalid:  # sequences may begin or end inside a character
            return pa.array([t.decode("utf-8", "replace") for t in texts.to_pylist()], pa.string())

    def to_library_json(self) -> str:
        """The same tokenizer as a file that the ``tokenizers`` library loads."""
        special = [{"id": i, "content": s, "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True} for i, s in enumerate(self.special)]
        digits = {"type": "Digits", "individual_digits": True}
        level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        model = {"type": "BPE", "unk_token": self.special[UNK], "fuse_unk": False, "byte_fallback": False, "ignore_merges": False, "vocab": self.ids, "merges": [list(m) for m in self.merges]}
        return json.dumps({"version": "1.0", "added_tokens": special, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [digits, level]}, "decoder": level, "model": model}, ensure_ascii=False)

    def __getstate__(self):
        return {"merges": self.merges, "special": self.special}

    def __setstate__(self, state):
        self.__init__(**state)


def train(counts: DataFrame, vocab: int = VOCAB_SIZE, min_frequency: int = 3) -> Bpe:
    """Merges learned from ``word, n``, all of it.

    All 256 bytes are in the vocabulary from the start, so every text survives the round trip. The most frequent pair
    merges next; of equal ones, that of the smaller ids; none that occurs less than ``min_frequency`` times. Words stay on
    the executors: what comes to the driver are counts of ``KNOWN`` pairs, and of the neighbours of ``CANDIDATES`` ones.
    """
    words = bpe_training.Words(counts)
    try:
        return Bpe(bpe_training.learned(words.top, words.facts, words.apply, [*SPECIAL_TOKENS, *byte_symbols()], vocab, min_frequency))
    finally:
        words.table.drop()


def _lists(offsets: np.ndarray, values: pa.Array, nulls: pa.Array) -> pa.Array:
    mask = nulls if nulls.true_count else None
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values, mask=mask)


def encoder(bpe: Bpe):
    """A function from a column of texts to one of ids. It is marked so that a filter on the ids doesn't run it twice."""
    cache: dict[str, list[int]] = {name: [i] for i, name in enumerate(bpe.special)}

    @F.arrow_udf("array<smallint>")
    def encode(lists: pa.Array) -> pa.Array:
        offsets = lists.offsets.to_numpy().astype(np.int64)
        words = lists.flatten().dictionary_encode()
        if len(cache) > 500_000:
            cache.clear()
            cache.update({name: [i] for i, name in enumerate(bpe.special)})
        found = [cache[w] if w in cache else cache.setdefault(w, bpe.word(w)) for w in words.dictionary.to_pylist()]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter((x for ids in found for x in ids), np.int16, int(sizes.sum()))
        starts, at = np.cumsum(sizes) - sizes, words.indices.to_numpy(zero_copy_only=False)
        # Where the ids of each occurrence begin; null lists have none.
        many = sizes[at] if len(at) else np.empty(0, np.int64)
        ends = np.concatenate(([0], np.cumsum(many)))
        whole = ids[np.arange(ends[-1]) + np.repeat(starts[at] - ends[:-1], many)] if len(at) else ids[:0]
        return _lists(ends[offsets - offsets[0]], pa.array(whole), lists.is_null())

    marked = encode.asNondeterministic()
    return lambda text: marked(pieces(F.col(text) if isinstance(text, str) else text, bpe.special))


def decoder(bpe: Bpe):
    @F.arrow_udf("string")
    def decode(lists: pa.Array) -> pa.Array:
        offsets = lists.offsets.to_numpy().astype(np.int64)
        ids = lists.flatten().to_numpy(zero_copy_only=False)
        texts = bpe.decode_all(ids.astype(np.int64), offsets - offsets[0])
        return pc.if_else(lists.is_null(), pa.scalar(None, pa.string()), texts) if lists.null_count else texts

    return decode.asNondeterministic()


def fertility(texts: DataFrame, ids: str, text: str = "text") -> DataFrame:
    """Tokens for each white-space separated word, over all texts; 0 without words."""
    sums = texts.agg(F.sum(F.size(ids).cast("long")).alias("tokens"), F.sum(word_count(F.col(text))).alias("words"))
    return sums.withColumn("fertility", F.when(F.coalesce("words", F.lit(0)) == 0, 0.0).otherwise(F.col("tokens") / F.col("words")))


def compare_fertility(texts: DataFrame, by_name: dict[str, Column], text: str = "text") -> DataFrame:
    """``tokenizer, tokens, words, fertility`` of several tokenizers over the same texts, the best (lowest) first."""
    out = None
    for name, ids in by_name.items():
        one = fertility(texts.withColumn("_ids", ids), "_ids", text).withColumn("tokenizer", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.orderBy("fertility")


#: Keywords that should be single tokens, and rarer ones that are only reported.
MAIN_KEYWORDS = (
    "SELECT", "FROM", "WHERE", "JOIN", "HAVING", "INSERT", "UPDATE", "DELETE", "CREATE", "ALTER", "DROP", "DISTINCT", "UNION", "EXISTS", "LIMIT", "OFFSET",
    "ON", "AS", "NULL", "NOT", "AND", "OR", "IN", "LIKE", "LEFT", "RIGHT", "INNER", "OUTER", "CROSS", "INT", "VARCHAR", "DECIMAL", "BOOLEAN", "TIMESTAMP",
    "TEXT", "FLOAT", "BIGINT", "COUNT", "SUM", "AVG", "MAX", "MIN", "COALESCE", "NULLIF", "CAST", "WINDOW", "EXCEPT", "FILTER",
)
LONG_TAIL_KEYWORDS = (
    "PARTITION", "WINDOW", "OVER", "RECURSIVE", "LATERAL", "FILTER", "EXCEPT", "INTERSECT", "ROLLUP", "CUBE", "MERGE", "WITH", "VALUES", "RETURNING", "USING",
    "PRIMARY", "FOREIGN", "REFERENCES", "CHECK", "UNIQUE", "TRIGGER", "PROCEDURE", "FUNCTION", "VIEW", "INDEX",
)


def keyword_table(keywords: DataFrame, bpe: Bpe) -> DataFrame:
    """Adds ``single`` and, for those that aren't, ``single_lower``: is the keyword one token inside a sentence?"""
    vocabulary, encode = {i: n for n, i in bpe.ids.items()}, encoder(bpe)

    @F.pandas_udf("boolean")
    def has(ids: pd.Series, word: pd.Series) -> pd.Series:
        return pd.Series([byte_symbols()[32] + w in {vocabulary[i] for i in x} for x, w in zip(ids, word, strict=True)])

    sentence = lambda w: F.concat(F.lit("it says "), w, F.lit(" here"))
    one = keywords.withColumn("single", has(encode(sentence(F.col("keyword"))), F.col("keyword")))
    lower = F.lower("keyword")
    return one.withColumn("single_lower", F.when(~F.col("single"), has(encode(sentence(lower)), lower)))


def round_trips(texts: DataFrame, bpe: Bpe, text: str = "text") -> DataFrame:
    """Adds ``back`` and ``same``: each text after encoding and decoding."""
    return texts.withColumn("back", decoder(bpe)(encoder(bpe)(F.col(text)))).withColumn("same", F.col("back").eqNullSafe(F.col(text)))


def write_tokenizer(spark, bpe: Bpe, path: str) -> None:
    """``tokenizer.json`` (for the ``tokenizers`` library) and ``bpe.json`` (for this one) in a folder of any file system."""
    from corpusmill.sources.sinks import write_text_file

    write_text_file(spark, f"{path}/bpe.json", bpe.to_json())
    write_text_file(spark, f"{path}/tokenizer.json", bpe.to_library_json())


def read_tokenizer(spark, path: str) -> Bpe:
    return Bpe.from_json(spark.read.text(f"{path}/bpe.json", wholetext=True).first()[0])


def checks(spark, bpe: Bpe, texts: DataFrame, ceiling: float = 2.5, vocab: int = VOCAB_SIZE) -> DataFrame:
    """``check, passed, detail``: vocabulary size, special ids, keywords, fertility and round trips."""
    words = spark.createDataFrame([(w,) for w in MAIN_KEYWORDS], "keyword string")
    split = keyword_table(words, bpe).where(~F.col("single")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("keyword")), ",").alias("names")).first()
    rate = fertility(texts.withColumn("_ids", encoder(bpe)(F.col("text"))), "_ids").first()["fertility"]
    lost = round_trips(texts, bpe).where(~F.col("same")).count()
    rows = [
        ("vocab_size", bpe.size == vocab, str(bpe.size)),
        ("special_ids", [bpe.ids.get(s) for s in SPECIAL_TOKENS] == list(range(len(SPECIAL_TOKENS))), str(len(SPECIAL_TOKENS))),
        ("keywords", split["n"] == 0, f"{split['n']} split: {split['names']}"),
        ("fertility", rate <= ceiling, f"{rate:.3f}"),
        ("round_trip", lost == 0, f"{lost} texts differ"),
    ]
    return spark.createDataFrame(rows, "check string, passed boolean, detail string")
