"""Personal data in texts, disguised or not: e-mail and IP addresses, card and phone numbers, with their places.

Plain ones are found in the text as it is. For the others transducers rewrite the text one after another: lookalike
characters become ASCII and invisible ones go, letters that stand for digits and spelled digits become digits, and "at" and
"dot" in words or brackets become their signs. Each one notes which stretch of its input a stretch of its output stands for, so what is
found in the last text is mapped back, step by step, to the characters of the source.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import map_arrow, parallel

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    twice = lambda d: d * 2 - 9 * (d > 4)
    return sum(twice(int(c)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """A local part can't hold the sign behind it, so each sign is looked at once: the local part before it, the domain behind."""
    done, at = 0, text.find("@")
    while at >= 0:
        low = at
        while low > done and text[low - 1] in _LOCAL:
            low -= 1
        found = _DOMAIN.match(text, at + 1) if low < at else None
        if found:
            done = found.end()
            yield low, done
        at = text.find("@", max(at + 1, done))


def plain_spans(text: str) -> list[tuple[int, int, int]]:
    """``start, kind, end`` of what stands undisguised in a text, in order: the leftmost of each kind that don't overlap."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := m.group().replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m.group())) <= 15]
    return sorted(out)


class Rewritten:
    """A text after some transducers, and the way back to the source."""

    def __init__(self, text: str):
        self.source = self.text = text
        self.layers: list[tuple[list[int], list[tuple[int, int, int, int]]]] = []

    def replace(self, edits: Iterable[tuple[int, int, str]]) -> None:
        """Replaces stretches ``start, end, new`` of the text, in order and without overlaps."""
        parts, segments, at, size = [], [], 0, 0
        for start, end, new in edits:
            parts += [self.text[at:start], new]
            size += start - at
            segments.append((size, size + len(new), start, end))
            size += len(new)
            at = end
        if segments:
            self.text = "".join([*parts, self.text[at:]])
            self.layers.append(([s[0] for s in segments], segments))

    def sub(self, pattern: re.Pattern, new: Callable[[re.Match], str | None]) -> None:
        self.replace((m.start(), m.end(), x) for m in pattern.finditer(self.text) if (x := new(m)) is not None)

    def back(self, start: int, end: int) -> tuple[int, int]:
        """The stretch of the source that a stretch of the text (not empty) stands for."""
        for starts, segments in reversed(self.layers):
            start, end = self._one(starts, segments, start, False), self._one(starts, segments, end - 1, True)
        return start, end

    @staticmethod
    def _one(starts: list[int], segments: list[tuple[int, int, int, int]], at: int, behind: bool) -> int:
        k = bisect_right(starts, at) - 1
        if k < 0:
            return at + behind
        low, high, first, last = segments[k]
        if at >= high:
            return last + at - high + behind
        if high - low == last - first:  # a character each
            return first + at - low + behind
        return last if behind else first

    def changed(self, start: int, end: int) -> bool:
        a, b = self.back(start, end)
        return self.source[a:b] != self.text[start:end]


# Lookalikes

#: Letters of other scripts that look like ASCII ones, and signs that stand for the dot.
LOOKALIKES = dict(zip("авсԁеһіјӏкмнорԛѕтухАВСЕНІЈКМОРЅТХУԚԜαικνορτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧıɑɡ·‧∙⋅。", "abcdehijlkmhopqstyxABCEHIJKMOPSTXYQWaikvoptuxABEZHIKMNOPTYXiag.....", strict=True))


@functools.cache
def ascii_for(c: str) -> str | None:
    """What a character stands for: an ASCII one, nothing for an invisible one; None where it stands for itself."""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    kind = unicodedata.category(c)
    if kind == "Cf" or c == "͏":
        return ""
    if kind == "Nd":
        return str(unicodedata.decimal(c))
    if kind in ("Pd", "Zs") or c == "−":
        return " " if kind == "Zs" else "-"
    same = unicodedata.normalize("NFKC", c)
    return same if len(same) == 1 and same.isascii() else LOOKALIKES.get(same)


def fold(r: Rewritten) -> None:
    """Lookalikes, digits of other scripts, wide forms, dashes and spaces as ASCII; invisible characters go."""
    if r.text.isascii():
        return
    stands = {c: x for c in set(r.text) if c > "\x7f" and (x := ascii_for(c)) is not None}
    if stands:
        r.sub(re.compile("[" + "".join(map(re.escape, stands)) + "]"), lambda m: stands[m.group()])


# Digits

#: The digits in English, German, French and Spanish words.
DIGIT_WORDS = {
    **{w: str(i) for words in ("zero one two three four five six seven eight nine", "null eins zwei drei vier fünf sechs sieben acht neun", "zéro un deux trois quatre cinq six sept huit neuf", "cero uno dos tres cuatro cinco seis siete ocho nueve") for i, w in enumerate(words.split())},
    "oh": "0", "fuenf": "5", "zwo": "2",
}
_WORD = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_DOT = "dot|punkt|punto|point"
_PLUS = "plus|más"
_SEP = r"(?:[ \t\n]{1,2}|[ \t]?[-,.()][ \t]?){1,2}"
_TOKEN = re.compile(rf"(?P<times>(?:double|triple)[ \t])?\b(?:(?P<word>{_WORD})|(?P<dot>{_DOT})|(?P<plus>{_PLUS})|(?P<digits>[0-9]+))\b", re.I)
_ONE = rf"\b(?:(?:double|triple)[ \t])?(?:{_WORD}|{_DOT}|{_PLUS}|[0-9]+)\b"
_PHRASE = re.compile(rf"{_ONE}(?:{_SEP}{_ONE}){{2,}}", re.I)
_LETTERS = str.maketrans("OolI|SB", "0011158")
_MIXED = re.compile(r"(?<![A-Za-z0-9|])[0-9OolI|SB]++(?![A-Za-z0-9|])|(?<=\+)[lI](?=[ (.-])")


def letter_digits(r: Rewritten) -> None:
    """Letters that look like digits, in words of such letters and digits only."""

    def digits(m: re.Match) -> str | None:
        word = m.group()
        some = sum(map(str.isdigit, word))
        if some == len(word) or not (some >= 2 or some and not set("SB") & set(word) or r.text[m.start() - 1 : m.start()] == "+"):
            return None
        return word.translate(_LETTERS)

    r.sub(_MIXED, digits)


def _phrase(text: str, begin: int, end: int) -> Iterator[tuple[int, int, str]]:
    tokens = [m for m in _TOKEN.finditer(text, begin, end)]
    if not any(m["word"] or m["dot"] or m["plus"] for m in tokens):
        return
    for i, m in enumerate(tokens):
        before, after = tokens[i - 1] if i else None, tokens[i + 1] if i + 1 < len(tokens) else None
        numeral = lambda x: x is not None and (x["word"] or x["digits"])
        low = m.start()
        if before is not None:
            between = text[before.end() : m.start()]
            # What parts two spelled digits, or a sign and a digit, goes; what parts numerals stays.
            if (m["word"] and before["word"] and "." not in between and "(" not in between and ")" not in between) or (before["plus"] and numeral(m)):
                yield before.end(), low, ""
        if m["word"]:
            yield low, m.end(), DIGIT_WORDS[m["word"].lower()] * {"d": 2, "t": 3}.get((m["times"] or "x")[0].lower(), 1)
        elif m["plus"] and numeral(after):
            yield low, m.end(), "+"
        elif m["dot"] and numeral(before) and numeral(after):
            yield before.end(), after.start(), "."


def spelled_digits(r: Rewritten) -> None:
    """Digits, plus and dot in words, in phrases of at least three of these and numerals."""
    text = r.text
    r.replace([e for m in _PHRASE.finditer(text) for e in _phrase(text, m.start(), m.end())])
    r.sub(re.compile(r"(?<=[0-9])[ \t]{1,2}\.[ \t]{1,2}(?=[0-9])"), lambda m: ".")


# At and dot

#: Last labels of domains that a spelled one must have.
ENDINGS = frozenset("com org net edu gov mil int info biz io co me dev app ai xyz online site eu de at ch fr be nl lu es mx ar cl uk ie us ca au nz it pt pl se no dk fi cz ru ua in jp cn br example test".split())
#: Words behind a spelled "at" that begin no domain.
NO_DOMAINS = frozenset("the a an this that these those our my your his her its their any each every some no".split())
_AT_WORD = "at|ät|arroba|arobase|klammeraffe"
_BRACKET_AT = re.compile(rf"\s{{0,3}}[\[({{<]\s{{0,3}}(?:{_AT_WORD}|@)\s{{0,3}}[\])}}>]\s{{0,3}}|&(?:#0*64|#x0*40|commat);", re.I)
_BRACKET_DOT = re.compile(rf"\s{{0,3}}[\[({{<]\s{{0,3}}(?:{_DOT}|\.)\s{{0,3}}[\])}}>]\s{{0,3}}|&(?:#0*46|#x0*2e|period);", re.I)
_LABEL = rf"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:[ \t]{{1,2}}(?:{_WORD})\b)*"
_DOT_SIGN = rf"(?:\s{{1,3}}(?:{_DOT})\s{{1,3}}|[_-](?:dot)[_-]|\.|\s{{1,2}}\.\s{{1,2}})"
_DISGUISED = re.compile(
    rf"(?<![A-Za-z0-9._%+-])(?P<local>[A-Za-z0-9._%+-]*[A-Za-z0-9](?:[ \t]{{1,2}}(?:{_WORD})\b)*(?:\s{{1,3}}(?:{_DOT})\s{{1,3}}{_LABEL})*)(?P<at>\s{{1,3}}(?:{_AT_WORD})\s{{1,3}}|[_-]at[_-]|\s{{0,2}}@\s{{0,2}})(?P<domain>{_LABEL}(?:{_DOT_SIGN}{_LABEL})+)",
    re.I,
)
_GLUED = re.compile(r"(?<![A-Za-z0-9._%+-])[a-z0-9][a-z0-9._%+-]*(?P<at>AT)(?P<domain>[a-z0-9-]+(?:DOT[a-z0-9-]+)+)")
_DOTS = re.compile(_DOT_SIGN, re.I)
_SPELLED = re.compile(rf"[ \t]{{1,2}}({_WORD})\b", re.I)


def _address(r: Rewritten, m: re.Match) -> Iterator[tuple[int, int, str]]:
    """The edits that make an address of a match of ``_DISGUISED``; none where it may be plain prose."""
    low, dots = m.start("domain"), list(_DOTS.finditer(m["domain"]))
    ends = [d.start() for d in dots] + [len(m["domain"])]
    starts = [0] + [d.end() for d in dots]
    # The last label that can end a domain ends it; what follows is the sentence that goes on.
    last = max((k for k in range(1, len(ends)) if m["domain"][starts[k] : ends[k]].lower() in ENDINGS), default=0)
    if not last:
        return
    dots, high = dots[:last], low + ends[last]
    at_word, dot_word = m["at"].strip(" \t\n_-").lower(), any(d.group().strip() != "." for d in dots)
    odd = dot_word or r.changed(low, high) or r.changed(m.start("at"), m.end("at"))
    spaced = any(len(d.group()) > 1 for d in dots)
    if at_word == "@":
        if not (dot_word or spaced or len(m["at"]) > 1):
            return  # an address as it is
    elif at_word == "at" and not odd and not re.search(r"[A-Za-z][A-Za-z0-9]*[._+-][A-Za-z0-9]|[A-Za-z][0-9]", m["local"]):
        return  # "look at example.com"
    elif at_word == "at" and m["domain"][: ends[0]].lower() in NO_DOMAINS:
        return  # "at the dot com"
    local = m.start("local")
    edits = [(local + d.start(), local + d.end(), ".") for d in re.finditer(rf"\s{{1,3}}(?:{_DOT})\s{{1,3}}", m["local"], re.I)]
    edits += [(local + d.start(), local + d.end(), DIGIT_WORDS[d[1].lower()]) for d in _SPELLED.finditer(m["local"])]
    edits.append((m.start("at"), m.end("at"), "@"))
    edits += [(low + d.start(), low + d.end(), ".") for d in dots]
    edits += [(low + d.start(), low + d.end(), DIGIT_WORDS[d[1].lower()]) for d in _SPELLED.finditer(m["domain"]) if low + d.end() <= high]
    behind = -1
    for e in sorted(edits):
        if e[0] >= behind:
            yield e
            behind = e[1]


def at_and_dot(r: Rewritten) -> None:
    """The signs of an address, from words, brackets, entities and blanks around them."""
    r.sub(_BRACKET_AT, lambda m: "@")
    r.sub(_BRACKET_DOT, lambda m: ".")
    r.replace([e for m in _DISGUISED.finditer(r.text) for e in _address(r, m)])
    glued = [m for m in _GLUED.finditer(r.text) if m["domain"].rsplit("DOT", 1)[1] in ENDINGS]
    r.replace([e for m in glued for e in ((m.start("at"), m.end("at"), "@"), *((d.start(), d.end(), ".") for d in re.compile("DOT").finditer(r.text, m.start("domain"), m.end("domain"))))])


TRANSDUCERS = (fold, letter_digits, spelled_digits, at_and_dot)

#: What a text must have for a transducer to have any work; linear patterns without look around.
GATES = (
    r"[^\x00-\x7f]",
    r"[0-9][OolI|SB]|[OolI|SB][0-9]|\+[lI]",
    rf"(?i)\b(?:{_WORD}|{_DOT}|{_PLUS})(?:[ \t\n]{{1,2}}|[ \t]?[-,.()][ \t]?)+(?:(?:double|triple)[ \t])?(?:{_WORD}|[0-9]+)\b|[0-9][ \t]{{1,2}}\.[ \t]{{1,2}}[0-9]",
    rf"(?i)[\[({{<]\s*(?:{_AT_WORD}|@|{_DOT}|\.)\s*[\])}}>]|&(?:#|commat|period)|\s(?:dot|punkt|punto|arroba|arobase|klammeraffe)\s|[_-](?:at|dot)[_-]|\s@|@\s|[a-z0-9]dot[a-z0-9]|[a-z0-9]\s+at\s+[a-z0-9-]+\.[a-z0-9]|[a-z0-9]\s+at\s+[a-z0-9-]+\s+point\s",
)


def disguised_spans(text: str, open_: Iterable[bool] = (True,) * len(TRANSDUCERS)) -> list[tuple[int, int, int]]:
    """``start, kind, end`` of what only the transducers uncover."""
    r = Rewritten(text)
    for go, transducer in zip(open_, TRANSDUCERS, strict=True):
        # What an earlier transducer made can be work for a later one.
        if go or r.layers:
            transducer(r)
    if not r.layers:
        return []
    return sorted({(*r.back(a, b)[:1], kind, r.back(a, b)[1]) for a, kind, b in plain_spans(r.text) if r.changed(a, b)})


def all_spans(text: str, open_: Iterable[bool] = (True,) * len(TRANSDUCERS)) -> list[tuple[int, int, int, bool]]:
    """``start, kind, end, plain``; a disguised one within a plain one of its kind is none."""
    plain = plain_spans(text)
    own = [[(a, b) for a, k, b in plain if k == kind] for kind in range(len(KINDS))]

    def within(start: int, kind: int, end: int) -> bool:
        # Spans of one kind don't overlap: only the last one that begins no later can hold another.
        i = bisect_right(own[kind], (start, len(text))) - 1
        return i >= 0 and own[kind][i][1] >= end

    return sorted([(*s, True) for s in plain] + [(*s, False) for s in disguised_spans(text, open_) if not within(*s)])


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("plain", pa.bool_())]))


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1)
        gates = [pc.match_substring_regex(texts, g).to_pylist() for g in GATES]
        found = [[{"kind": KINDS[k], "start": a, "end": b, "plain": p} for a, k, b, p in all_spans(t, go)] for t, *go in zip(texts.to_pylist(), *gates, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _SPAN)], names=["key", "spans"])


def find_pii(docs: DataFrame, key: Column, text: Column) -> DataFrame:
    """``key, spans`` for every row: ``kind, start, end, plain`` of its personal data, by start and then kind.

    Places count code points of the source, ``end`` is behind the last. ``plain`` spans are found in the text as it is, the
    others by the transducers. Null texts count as empty; an empty text has no spans. Texts of any length are read whole,
    in time about linear in it. Keys may be of any type, null or repeated: each row comes back. An empty table gives
    an empty result. Only the given expressions are read, so other columns and their names don't matter.
    """
    slim = parallel(docs.select(key.alias("key"), F.coalesce(text, F.lit("")).alias("text")))
    return map_arrow(slim, _find, f"key {slim.schema['key'].dataType.simpleString()}, spans array<struct<kind: string, start: long, end: long, plain: boolean>>")


def masked(text: Column, spans: Column) -> Column:
    """The text with each span as its kind in brackets; of spans that overlap, the first stands and takes in the others."""
    step = lambda a, s: F.when(s["start"] < a["at"], F.struct(a["out"].alias("out"), F.greatest(a["at"], s["end"]).alias("at"))).otherwise(
        F.struct(F.concat(a["out"], F.substring(text, a["at"].cast("int") + 1, (s["start"] - a["at"]).cast("int")), F.lit("["), s["kind"], F.lit("]")).alias("out"), s["end"].alias("at"))
    )
    end = F.aggregate(spans, F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")), step)
    return F.concat(end["out"], F.substring(text, end["at"].cast("int") + 1, F.length(text)))


def op11(spark, sf_dir: str) -> DataFrame:
    """The personal data of every document; the counts and ``base_sha256`` are of the plain spans."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = find_pii(docs, F.col("doc_id"), F.col("text"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    plain = F.filter("spans", lambda s: s["plain"])
    count = lambda kind: F.size(F.filter(plain, lambda s: s["kind"] == kind)).cast("long")
    counts = [count(k).alias(f"n_{k}") for k in KINDS]
    return found.select(F.col("key").alias("doc_id"), *counts, F.sha2(listed(plain), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
