"""Line dedup: repeated passages of lines, cut out wherever they come again.

A rolling hash over the hashes of a text's lines, of two neighbouring lines that aren't blank, makes every such pair an
anchor; a line of 50 words or more is an anchor by itself. An anchor that stands somewhere before, in this text or
another, is part of a repeated chunk, and a chunk goes on as long as its anchors were there before: where it ends depends on the lines
only, so lines added or removed elsewhere shift nothing. Marks that choose some anchors only, by their hash, would lose short
passages between other texts. All anchors of the whole table are compared, and hashes decide nothing: lines that share one
are compared byte by byte, and if any two differ, all are hashed anew with another seed. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import Table, parallel, unused

PASSAGE = 50  # words that make a single line a passage
WORD = r"[^\x20\x09-\x0D]+"


def once(value: Column) -> Column:
    """``value`` as a generated column: what stands above can use it often, and it is computed but once a row."""
    return F.explode(F.array(value))


def line_hash(line: Column, seed: int) -> Column:
    return F.xxhash64(line, F.lit(seed))


def anchors(docs: DataFrame, key: str, text: str, words: int, seed: int) -> DataFrame:
    """``key, text_hash, first, last, h``: the pairs of neighbouring lines and the long lines of every text.

    Lines count from 1. Blank lines are in no pair, but those between its two lines belong to it. ``h`` has the hash of each
    line from ``first`` to ``last``.
    """
    lines = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("text_hash"), once(F.split(text, "\n", -1)).alias("lines"))
    full = F.filter(F.sequence(F.lit(1), F.size("lines")), lambda i: F.rlike(F.get("lines", i - 1), F.lit(WORD)))
    hashed = lines.select("key", "text_hash", "lines", once(full).alias("full"), once(F.transform("lines", lambda x: line_hash(x, seed))).alias("hs"))
    # Words are counted in lines only that have room for so many.
    long = F.filter("full", lambda i: (F.length(F.get("lines", i - 1)) >= 2 * words - 1) & (F.regexp_count(F.get("lines", i - 1), F.lit(WORD)) >= words))
    pairs = F.transform(F.sequence(F.lit(1), F.size("full") - 1), lambda k: F.struct(F.get("full", k - 1).alias("first"), F.get("full", k).alias("last")))
    spans = F.concat(F.when(F.size("full") > 1, pairs).otherwise(F.array().cast("array<struct<first:int,last:int>>")), F.transform(long, lambda i: F.struct(i.alias("first"), i.alias("last"))))
    spread = hashed.select("key", "text_hash", "hs", F.explode(spans).alias("s"))
    return spread.select("key", "text_hash", "s.first", "s.last", F.slice("hs", F.col("s.first"), F.col("s.last") - F.col("s.first") + 1).alias("h"))


def repeated(docs: DataFrame, key: str, text: str, words: int, seed: int) -> DataFrame:
    """``key, text_hash, cut, seen``: the lines of each text that go, as spans in order, and all its spans that are repeated."""
    every = Table(anchors(docs, key, text, words, seed))
    # The anchors are counted before the join: a hot one is a row a task.
    kept = Table(every.df.groupBy("h").agg(F.min(F.struct("key", "text_hash", "first", "last")).alias("kept"), F.count("*").alias("n")).where("n > 1").select("h", "kept"))
    met = every.df.join(kept.df.hint("merge"), "h")
    own = F.struct("key", "text_hash", "first") == F.struct("kept.key", "kept.text_hash", "kept.first")
    # An anchor that overlaps its own first occurrence leaves that whole.
    same = (F.col("key") == F.col("kept.key")) & (F.col("text_hash") == F.col("kept.text_hash"))
    low = F.when(same, F.greatest(F.col("first"), F.col("kept.last") + 1)).otherwise(F.col("first"))
    gone = F.when(~own & (low <= F.col("last")), F.struct(low.alias("first"), "last"))
    # Repeated rows of a text give the same spans, so a text has no more of them than lines.
    sets = Table(met.groupBy("key", "text_hash").agg(F.array_sort(F.collect_set(gone)).alias("cut"), F.collect_set(F.struct("first", "last")).alias("seen")))
    every.drop()
    kept.drop()
    return sets.df


def _chunks(spans: Column) -> Column:
    """Spans in order that touch or overlap as one. Of the anchors' spans none reaches beyond the two behind it."""
    last = lambda k: F.coalesce(F.get(spans, k)["last"], F.lit(-1))
    begins = F.filter(F.sequence(F.lit(0), F.size(spans) - 1), lambda k: (k == 0) | (F.get(spans, k)["first"] > F.greatest(last(k - 1), last(k - 2), last(k - 3)) + 1))
    end = lambda k: F.greatest(last(k - 1), last(k - 2), last(k - 3))
    return F.transform(begins, lambda b, i: F.struct(F.get(spans, b)["first"].alias("first"), end(F.coalesce(F.get(begins, i + 1), F.size(spans))).alias("last")))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = PASSAGE) -> DataFrame:
    """``docs`` with repeated passages removed, and ``n_lines, removed_lines, removed_chunks`` beside the columns it has.

    A passage has two lines that aren't blank, with the blank ones between them, or one line of ``words`` words; passages
    are equal if all their bytes are. The first occurrence, by key and then by place, stays, and so does some earlier
    copy of every line that goes. Null and empty texts, and rows with a null key, come back as they are; so do single
    lines of fewer words, however often they occur, and runs of blank lines. Repeated rows of one key are one document;
    rows of one key with different texts are documents of their own, in the order of their hashes. A text of which
    nothing is left is empty. ``removed_chunks`` counts the stretches of lines that went. Texts of any length are read
    whole. An empty table gives an empty result. Columns of any other names pass through; if the input has columns of the
    new names, the new ones replace them.
    """
    named = parallel(docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, text))
    key_, hash_, cut_, seen_, lines_ = unused(docs, "cut_key", "cut_hash", "cut", "seen", "lines")
    seed = 0
    while True:
        spans = repeated(named, key, text, words, seed).toDF(key_, hash_, cut_, seen_)
        # The spans grow with the table, so the join always shuffles, also where a small table would let it broadcast.
        joined = docs.join(spans.hint("merge"), (F.col(key) == F.col(key_)) & (F.xxhash64(text) == F.col(hash_)), "left").drop(key_, hash_)
        # The lines of all repeated passages, each once: a hash that stands for two of them is of no use.
        lines = joined.where(F.col(seen_).isNotNull()).select(once(F.split(text, "\n", -1)).alias("lines"), F.col(seen_).alias("seen"))
        lines = lines.select(F.explode(F.flatten(F.transform("seen", lambda s: F.slice("lines", s["first"], s["last"] - s["first"] + 1)))).alias("line"))
        twice = lines.groupBy(line_hash(F.col("line"), seed).alias("h"), "line").agg(F.lit(1).alias("one")).groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
        if twice.isEmpty():
            break
        seed += 1
    others = [c for c in docs.columns if c != text and c not in ("n_lines", "removed_lines", "removed_chunks")]
    merged = joined.select(*others, text, once(F.when(F.size(cut_) > 0, _chunks(F.col(cut_)))).alias(cut_))
    # What is left stands between the removed chunks; a span behind the last line closes the list.
    split = merged.select(*others, text, once(F.split(text, "\n", -1)).alias(lines_), cut_)
    end = F.size(lines_) + 1
    closed = split.select(*others, text, lines_, once(F.when(F.col(cut_).isNotNull(), F.concat(cut_, F.array(F.struct(end.alias("first"), end.alias("last")))))).alias(cut_))
    before = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get(F.col(cut_), k - 1)["last"])
    left = F.flatten(F.transform(cut_, lambda c, k: F.slice(lines_, before(k) + 1, c["first"] - 1 - before(k))))
    gone = F.aggregate(cut_, F.lit(0), lambda a, c: a + c["last"] - c["first"] + 1) - 1
    return closed.select(
        *others,
        F.when(F.col(cut_).isNull(), F.col(text)).otherwise(F.array_join(left, "\n")).alias(text),
        F.coalesce(F.size(lines_), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(gone, F.lit(0)).cast("long").alias("removed_lines"),
        F.coalesce(F.size(cut_) - 1, F.lit(0)).cast("long").alias("removed_chunks"),
    )


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "removed_lines", "removed_chunks", "text")


#: The same from ``documents`` with columns ``doc_id, text``, for DuckDB; used by the pipeline's test too.
SQL_STEPS = """
    lines AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM {docs}),
    filled AS (SELECT *, list_filter(range(1, len(l) + 1), lambda i: regexp_matches(l[i], '[^\\x20\\x09-\\x0D]')) AS f FROM lines),
    steps AS (SELECT *, unnest(range(1, len(f) + 1)) AS k FROM filled),
    anchors AS (
        SELECT doc_id, f[k] AS first, f[k + 1] AS last, l[f[k]:f[k + 1]] AS own FROM steps WHERE k < len(f)
        UNION ALL SELECT doc_id, f[k], f[k], [l[f[k]]] FROM steps WHERE len(regexp_extract_all(l[f[k]], '[^\\x20\\x09-\\x0D]+')) >= 50
    ),
    placed AS (SELECT *, first_value({{'d': doc_id, 'first': first, 'last': last}}) OVER (PARTITION BY own ORDER BY doc_id, first) AS kept FROM anchors),
    gone_lines AS (
        SELECT DISTINCT doc_id, unnest(range(CASE WHEN kept.d = doc_id THEN greatest(first, kept.last + 1) ELSE first END, last + 1)) AS i
        FROM placed WHERE kept.d <> doc_id OR kept.first <> first
    ),
    line_rows AS (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS i FROM lines),
    kept_lines AS (SELECT r.* FROM line_rows r ANTI JOIN gone_lines g ON g.doc_id = r.doc_id AND g.i = r.i),
    rebuilt AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM kept_lines GROUP BY doc_id),
    totals AS (SELECT doc_id, count(*) FILTER (NOT EXISTS (SELECT 1 FROM gone_lines b WHERE b.doc_id = g.doc_id AND b.i = g.i - 1)) AS removed_chunks FROM gone_lines g GROUP BY doc_id),
    sizes AS (SELECT doc_id, count(*) AS removed_lines FROM gone_lines GROUP BY doc_id)
"""

ORACLE = f"""
    WITH {SQL_STEPS.format(docs="documents")}
    SELECT d.doc_id, CAST(len(string_split(d.text, chr(10))) AS BIGINT) AS n_lines, coalesce(s.removed_lines, 0) AS removed_lines,
           coalesce(t.removed_chunks, 0) AS removed_chunks, coalesce(r.text, '') AS text
    FROM documents d LEFT JOIN totals t USING (doc_id) LEFT JOIN sizes s USING (doc_id) LEFT JOIN rebuilt r USING (doc_id)
"""
