"""Language identification by Bayesian fusion of what a text, its markup, its address and its host suggest.

A naive Bayes model over hashed byte trigrams gives the likelihood of a text under each language. Text in no known
language shows in trigrams that the likeliest language doesn't have. How many it has by chance is computed from the model:
the share of known ones among trigrams of letters drawn at random from all labelled texts. A text whose share is no better is more probably in
none; how much more is the divergence of the two shares, for each trigram. The declared language and the country
suffix of the address multiply it by how often such hints are right. The prior comes from the host: how many of its texts are in each
language, smoothed towards the registered domain, that towards the suffix and that towards the whole table, all by
grouped aggregation of counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import map_arrow, parallel, written
from corpusmill.llm.url_filter import host_of, registered, suffix_table

CELLS = 1 << 16
TRAIN_ROWS = 4000  # labelled texts, on average, that the model is fitted on, whatever the table's size
OVERLAP = 3  # trigrams that share each byte, so a text counts as a third as many independent ones
PRIOR = 300  # trigrams of all languages together that each language holds beside its own
PIECE = 1 << 20  # bytes of text that are looked at together
DECLARED_RIGHT, SUFFIX_RIGHT = 0.9, 0.8
SMOOTHING = 5.0  # texts of its parent that a host's prior holds beside its own
UNKNOWN = "und"
#: Country suffixes and their main language.
COUNTRY_LANGUAGE = {"ar": "es", "at": "de", "au": "en", "de": "de", "es": "es", "fr": "fr", "ie": "en", "mx": "es", "nz": "en", "uk": "en", "us": "en"}


def padded(text: bytes) -> bytes:
    """A blank before the text and two behind it, so that its ends are trigrams too."""
    return b" " + text + b"  "


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all (padded) texts end to end, the hash of the trigram at each, and how many bytes each text has.

    Texts are lower-cased (A-Z); white space, digits and ASCII punctuation all count as a blank. Trigrams that begin with
    two blanks, or span two texts, have the hash -1.
    """
    data = _FOLD[np.frombuffer(b"".join(texts), np.uint8)]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.full(len(data), -1, np.int64)
    if len(data) > 2:
        codes[:-2] = _hash(data[:-2].astype(np.int64), data[1:-1], data[2:])
        codes[:-2][(data[:-2] == 32) & (data[1:-1] == 32)] = -1
    ends = np.cumsum(sizes)
    codes[ends - 1] = codes[ends - 2] = -1
    return data, codes, sizes


def _hash(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((a * 961 + b) * 961 + c) * 2654435761 % (1 << 32) >> 16


def pieces(texts: Iterable[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Padded texts, with their numbers, some at a time; a very long one in pieces that share two bytes."""
    numbers, held, size = [], [], 0
    for k, text in enumerate(texts):
        whole = padded(text)
        for at in range(0, max(1, len(whole) - 2), PIECE):
            numbers.append(k)
            held.append(whole[at : at + PIECE + 2])
            size += len(held[-1])
            if size >= PIECE:
                yield numbers, held
                numbers, held, size = [], [], 0
    if held:
        yield numbers, held


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[i for i in range(128) if not chr(i).isalpha()]] = 32


@dataclass
class Model:
    """Trigram hashes of each language, by hash: languages ``lang[start[c]:start[c + 1]]`` have c."""

    languages: list[str]
    start: np.ndarray
    lang: np.ndarray
    gain: np.ndarray  # log-likelihood of the trigram in that language, beyond one that hasn't seen it
    common: np.ndarray  # log-likelihood of each hash in all languages together
    alone: np.ndarray  # log-share of that in each language
    chance: float  # share of the trigrams of random letters that the best fitting language has

    @classmethod
    def of(cls, languages: list[str], lang: np.ndarray, cell: np.ndarray, n: np.ndarray) -> Model:
        """From counts of trigram hashes; counts from ``CELLS`` on are those of letters."""
        letters = cell >= CELLS
        frequency = np.bincount(cell[letters] - CELLS, n[letters], 256)
        order = np.flatnonzero(~letters)[np.argsort(cell[~letters], kind="stable")]
        lang, cell, n = lang[order], cell[order], n[order].astype(float)
        every = np.bincount(cell, n, CELLS) + 0.01
        every /= every.sum()
        totals = np.bincount(lang, n, len(languages))
        drawn = drawn_cells(frequency)
        chances = np.bincount(lang, drawn[cell], len(languages))
        return cls(languages, np.searchsorted(cell, np.arange(CELLS + 1)), lang, np.log1p(n / (PRIOR * every[cell])), np.log(every), np.log(PRIOR / (totals + PRIOR)), chances.max(initial=0.0))

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Each text's mean log-likelihood of a trigram under each language and under none; its trigrams."""
        width = len(self.languages)
        n, sums, known = np.zeros(len(texts), np.int64), np.zeros((len(texts), width)), np.zeros((len(texts), width))
        for numbers, held in pieces(texts):
            _, codes, sizes = trigrams(held)
            use = codes >= 0
            text, code = np.repeat(numbers, sizes)[use], codes[use]
            n += np.bincount(text, minlength=len(texts))
            if width:
                sums += np.bincount(text, self.common[code], len(texts))[:, None]
                many = self.start[code + 1] - self.start[code]
                at = np.arange(many.sum()) + np.repeat(self.start[code] - np.cumsum(many) + many, many)
                flat = np.repeat(text, many) * width + self.lang[at]
                sums += np.bincount(flat, self.gain[at], sums.size).reshape(sums.shape)
                known += np.bincount(flat, minlength=sums.size).reshape(sums.shape)
        if not width:
            return np.zeros((len(texts), 1)), n
        sums += n[:, None] * self.alone
        best = sums.argmax(axis=1)
        rows = np.arange(len(texts))
        none = sums[rows, best] - n * evidence(known[rows, best] / np.maximum(n, 1), self.chance)
        return np.column_stack((sums, none)) / np.maximum(n, 1)[:, None], n


def drawn_cells(letters: np.ndarray) -> np.ndarray:
    """How probable each trigram hash is if letters are drawn one by one, as often as they are counted."""
    if not letters.any():
        return np.zeros(CELLS)
    there = np.flatnonzero(letters)
    p = letters[there] / letters.sum()
    a, b, c = (x.astype(np.int64) for x in np.meshgrid(there, there, there, indexing="ij"))
    weight = p[:, None, None] * p[None, :, None] * p[None, None, :] * ~((a == 32) & (b == 32))
    cells = np.bincount(_hash(a, b, c).ravel(), weight.ravel(), CELLS)
    return cells / max(cells.sum(), 1e-300)


def evidence(share: np.ndarray, chance: float) -> np.ndarray:
    """For a known language, by trigram: the divergence of the share of known ones from chance; negative where it is less."""
    low = 1e-9
    q, s = np.clip(share, low, 1 - low), min(max(chance, low), 1 - low)
    return np.sign(q - s) * (q * np.log(q / s) + (1 - q) * np.log((1 - q) / (1 - s)))


def _count(languages: list[str]):
    """For each partition and language the counts of trigram hashes, and of letters behind them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        place = {x: i for i, x in enumerate(languages)}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                own = counts.setdefault(lang, np.zeros(CELLS + 256, np.int64))
                for _, held in pieces([text]):
                    data, codes, _ = trigrams(held)
                    own[:CELLS] += np.bincount(codes[codes >= 0], minlength=CELLS)
                    own[CELLS:] += np.bincount(data, minlength=256)
        for lang, own in counts.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), place[lang], np.int32)), pa.array(at.astype(np.int32)), pa.array(own[at])], names=["lang", "cell", "n"])

    return run


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = TRAIN_ROWS) -> Model:
    """A model from a sample of about ``rows`` labelled texts, drawn by the hash of key and text; smaller tables whole.

    Repeated rows are drawn together and count once, so the sample is no larger for them. The languages are those of the
    sample, however many. What comes to the driver is a row for each of them and for each trigram hash that the sample
    has in it. Rows without text or label don't count; without any there are no languages.
    """
    usable = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.xxhash64(key, text).alias("draw"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    n = usable.count()
    span = 1 << 20
    drawn = usable.where(F.pmod("draw", F.lit(span)) < span * rows / max(n, rows))
    once = written(drawn.groupBy("draw", "lang").agg(F.min("text").alias("text")).select("lang", "text"))
    languages = sorted(r[0] for r in once.select("lang").distinct().collect())
    counted = map_arrow(parallel(once), _count(languages), "lang int, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    return Model.of(languages, *(counted[c].to_numpy() for c in ("lang", "cell", "n")))


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(0).cast(pa.binary()).to_pylist()]
            means, counts = [], []
            for i in range(0, len(texts), 256):  # a bounded table of texts and languages at a time
                mean, n = model.score(texts[i : i + 256])
                means.append(mean)
                counts.append(n)
            flat = np.concatenate(means).ravel() if means else np.zeros(0)
            width = len(model.languages) + 1
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, width, dtype=np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], lists, pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64))], names=[*batch.schema.names[1:], "means", "trigrams"])

    return run


def _hint(value: Column, languages: list[str], right: float) -> Column:
    """Log-likelihoods of a hint under each language and the background; nothing where the hint names none of them."""
    other = math.log((1 - right) / max(1, len(languages) - 1))
    names = F.array(*map(F.lit, languages)) if languages else F.array().cast("array<string>")
    rows = F.concat(F.transform(names, lambda x: F.when(value == x, math.log(right)).otherwise(other)), F.array(F.lit(-math.log(max(1, len(languages))))))
    return F.when(F.array_contains(names, value), rows).otherwise(F.array_repeat(F.lit(0.0), len(languages) + 1))


def _priors(counted: DataFrame, languages: list[str], suffixes: DataFrame) -> DataFrame:
    """``host, prior`` from ``host, guess, n``: the share of each language, smoothed from the table over suffix and domain to the host."""
    size = len(languages) + 1
    placed = written(counted.join(registered(counted.select("host").distinct(), suffixes), "host"))

    def tally(*by: str) -> DataFrame:
        """A row's counts as an array over the languages and none."""
        sums = placed.groupBy(*by, "guess").agg(F.sum("n").alias("n")).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("guess", "n"))).alias("m"))
        row = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)).cast("double"))
        return sums.select(*by, row.alias("row")).withColumn("total", F.aggregate("row", F.lit(0.0), lambda a, x: a + x))

    toward = lambda parent: F.zip_with("row", parent, lambda n, p: (n + SMOOTHING * p) / (F.col("total") + SMOOTHING))
    top = tally().select(F.transform("row", lambda x: (x + 1) / (F.col("total") + size)).alias("top"))
    # One row.
    above = tally("suffix").join(F.broadcast(top), F.lit(True)).select("suffix", toward("top").alias("above"))
    around = tally("domain", "suffix").join(above, "suffix").select("domain", toward("above").alias("around"))
    return tally("host", "domain").join(around, "domain").select("host", toward("around").alias("prior"))


def identify(texts: DataFrame, model: Model, text: Column, declared: Column, host: Column, key: str, suffixes: DataFrame | None = None) -> DataFrame:
    """``key, host, declared, lang, posterior, unknown, trigrams`` for every row; ``unknown`` is the posterior of no language.

    ``lang`` is the most probable language, or ``und`` if none is; equal ones go to the first in order, ``und`` last. A
    text without letters has no trigrams and rests on its hints and its host. Nulls in the text, the declaration or the
    host count as empty. A declaration counts by its first two letters. Texts of any length are scored whole. Repeated
    rows come back repeatedly; an empty table gives no rows. Other columns are not read.
    """
    languages = model.languages
    every = [*languages, UNKNOWN]
    said = F.lower(F.substring(F.coalesce(declared, F.lit("")), 1, 2))
    slim = parallel(texts.select(F.coalesce(text, F.lit("")).alias("text"), F.col(key).alias("key"), said.alias("declared"), F.coalesce(host, F.lit("")).alias("host")))
    kind = slim.schema["key"].dataType.simpleString()
    scored = map_arrow(slim, _score(model), f"key {kind}, declared string, host string, means array<double>, trigrams long")
    country = F.element_at(F.create_map(*[F.lit(x) for pair in COUNTRY_LANGUAGE.items() for x in pair]), F.substring_index("host", ".", -1))
    hints = F.arrays_zip(_hint(F.col("declared"), languages, DECLARED_RIGHT).alias("a"), _hint(country, languages, SUFFIX_RIGHT).alias("b"), F.col("means").alias("m"))
    weight = F.col("trigrams") / OVERLAP
    fused = written(scored.select("key", "declared", "host", "trigrams", F.transform(hints, lambda x: x["a"] + x["b"] + x["m"] * weight).alias("evidence")))
    guess = F.array_position("evidence", F.array_max("evidence")) - 1
    # Counted before the join: a host with a third of all rows is a few rows a task.
    priors = written(_priors(fused.groupBy("host", guess.alias("guess")).agg(F.count("*").alias("n")), languages, suffix_table(texts.sparkSession) if suffixes is None else suffixes))
    joined = fused.join(priors, "host").withColumn("logs", F.transform(F.arrays_zip("evidence", "prior"), lambda x: x["evidence"] + F.log(x["prior"])))
    top = F.array_max("logs")
    mass = F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - top))
    lang = F.element_at(F.array(*map(F.lit, every)), F.array_position("logs", top).cast("int"))
    return joined.select(F.col("key").alias(key), "host", "declared", lang.alias("lang"), (1 / mass).alias("posterior"), (F.exp(F.element_at("logs", -1) - top) / mass).alias("unknown"), "trigrams")


CONFIDENT = 0.5  # posterior of all known languages together that a text needs


def keep_known(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", declared: str = "lang", host: str = "source") -> DataFrame:
    """The rows of ``docs`` that are in some known language with a posterior of at least one half.

    Rejected are texts without any letter (null and empty ones too) and texts of whose trigrams their likeliest language
    has no more than chance. Rows with a null key are kept: they can't be looked up. If rows share a key, all go if one
    does. Texts of any length are scored whole. An empty table gives an empty result. Columns of any other names pass
    through.
    """
    named = docs.where(F.col(key).isNotNull()).select(*{c: F.col(c) for c in (key, text, declared, host)}.values())
    judged = identify(named, model, F.col(text), F.col(declared), F.col(host), key)
    bad = judged.where((F.col("unknown") > 1 - CONFIDENT) | (F.col("trigrams") == 0)).select(key).distinct()
    return docs.join(written(bad).hint("merge"), key, "left_anti").select(*docs.columns)


def visible_text(html: Column) -> Column:
    """A page's text: without comments, scripts, styles, tags and entities."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ")
    return F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"&[#A-Za-z0-9]{1,10};", " ")


def op6(spark, sf_dir: str) -> DataFrame:
    """The language of every page, by a model of the labelled documents; posteriors to six digits."""
    model = fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    declared = F.regexp_extract("html", r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z-]+)", 1)
    found = identify(pages, model, visible_text(F.col("html")), declared, host_of(F.col("url")), "page_id")
    return found.drop("unknown").withColumn("posterior", F.round("posterior", 6))
