"""Registered queries over the test tables, each with the SQL that must give the same rows.

The tables stand in for the sources: ``documents`` by language, ``conversations`` for question and answer pairs, ``events``
for a training log. Small fixtures, where the tables have nothing to show, are written inline on both sides.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.constants import BOS, EOS, FIRST_BYTE, FINETUNE_LENGTH, SEQUENCE_LENGTH, VOCAB_SIZE
from corpusmill.functions import extract, predicates, text
from corpusmill.operators import budget, evaluation, finetune, manifest, packing, sampling, schema_catalog, supplement, tokenizer, training_log
from corpusmill.operators.prefix import exclusive_sum, hash_rank
from corpusmill.plans import build
from corpusmill.scratch import Table, scratch_dir, written
from corpusmill.sources import readers, sinks
from corpusmill.sources.registry import registry_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its own name, with its SQL where there is one."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str, cores: bool = False) -> DataFrame:
    """A test table; with ``cores``, dealt to all cores where its one file would keep one busy."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    n = spark.sparkContext.defaultParallelism
    return df.repartition(n) if cores and df.rdd.getNumPartitions() < n else df


def long(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("long")


GOOD = "length(text) BETWEEN 100 AND 1000000"
DEMO_WORDS = ("THE", "FROM", "DER", "QUE", "AND", "UND", "LES")  # words that the invented prose has
BUDGETS = (("en", 500_000), ("fr", 400_000), ("de", 10_000), ("es", 700_000))  # bytes: some below a pass, some above


def good_docs(spark: SparkSession, sf_dir: str, cores: bool = False) -> DataFrame:
    return table(spark, sf_dir, "documents", cores).where(predicates.length_ok(F.col("text")))


# Extraction, filters and functions


@query(f"SELECT doc_id, lang, CAST(length(text) AS BIGINT) AS chars FROM documents WHERE {GOOD}")
def length_filtered_docs(spark, sf_dir):
    return good_docs(spark, sf_dir).select("doc_id", "lang", long(F.length("text")).alias("chars"))


@query("""SELECT lang, count(*) AS docs, round(avg(length(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')) / length(text)), 6) AS alnum FROM documents WHERE length(text) > 0 GROUP BY lang""")
def alnum_fraction_by_lang(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", True).where(predicates.not_empty(F.col("text")))
    return docs.groupBy("lang").agg(F.count("*").alias("docs"), F.round(F.avg(text.alnum_fraction(F.col("text"))), 6).alias("alnum"))


@query("SELECT doc_id, sha256(nfc_normalize(text)) AS digest FROM documents")
def nfc_normalized_docs(spark, sf_dir):
    return text.nfc(table(spark, sf_dir, "documents", True), "text").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("SELECT doc_id, sha256(nfc_normalize(replace(replace(text, 'é', 'e' || chr(769)), 'ü', 'u' || chr(776)))) AS digest FROM documents")
def nfc_decomposed_docs(spark, sf_dir):
    """Texts whose accents are characters of their own beforehand, so that normalisation has something to do."""
    apart = F.replace(F.replace("text", F.lit("é"), F.lit("e\u0301")), F.lit("ü"), F.lit("u\u0308"))
    return text.nfc(table(spark, sf_dir, "documents", True).select("doc_id", apart.alias("text")), "text").select("doc_id", F.sha2("text", 256).alias("digest"))


_HITS = " + ".join(f"CAST(contains(upper(text), '{w}') AS INTEGER)" for w in DEMO_WORDS)


@query(f"SELECT doc_id, CAST({_HITS} AS BIGINT) AS hits FROM documents WHERE {_HITS} >= 2")
def keyword_hits_ge2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", True).where(predicates.markdown_file(F.col("text"), DEMO_WORDS))
    return docs.select("doc_id", long(text.keyword_hits(F.col("text"), DEMO_WORDS)).alias("hits"))


@query("SELECT doc_id, source FROM documents WHERE (contains(upper(text), 'SELECT') OR contains(upper(text), 'FROM') OR contains(upper(text), 'CREATE') OR contains(upper(text), 'INSERT')) AND length(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')) / length(text) >= 0.25")
def sql_style_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(predicates.sql_file(F.col("text"))).select("doc_id", "source")


@query("SELECT doc_id FROM documents WHERE contains(upper(text), 'FROM') AND (contains(upper(text), 'WHERE') OR contains(upper(text), 'THE'))")
def python_style_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(predicates.python_file(F.col("text"), "FROM", ("WHERE", "THE"))).select("doc_id")


@query("SELECT page_id, url FROM pages WHERE contains(lower(url), '/en/') OR contains(lower(url), 'blog')")
def path_filter(spark, sf_dir):
    return table(spark, sf_dir, "pages").where(predicates.path_has(F.col("url"), ("/en/", "blog"))).select("page_id", "url")


@query("SELECT conv_id, turn, text FROM conversations WHERE role = 'user'")
def user_turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where(predicates.first_turns(F.col("role"), want_role="user")).select("conv_id", "turn", "text")


def qa_pairs(spark, sf_dir) -> DataFrame:
    """``conv_id, turn, system, question, answer``: user turns and the assistant's turn after them."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    answers = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    first = turns.where("role = 'system' AND turn = 0").select("conv_id", F.col("text").alias("system"))
    return asked.join(answers, ["conv_id", "turn"]).join(first, "conv_id", "left").select("conv_id", "turn", "system", "question", "answer")


_QA = """qa AS (
    SELECT q.conv_id, q.turn, s.text AS system, q.text AS question, a.text AS answer FROM conversations q
    JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant'
    LEFT JOIN conversations s ON s.conv_id = q.conv_id AND s.role = 'system' AND s.turn = 0 WHERE q.role = 'user'
)"""


@query(f"WITH {_QA} SELECT conv_id, turn, coalesce(system, '') || chr(10) || question || chr(10) || answer AS joined, concat_ws(chr(10), nullif(system, ''), nullif(question, ''), nullif(answer, '')) AS present FROM qa")
def concat_extract(spark, sf_dir):
    return qa_pairs(spark, sf_dir).select("conv_id", "turn", extract.joined("system", "question", "answer").alias("joined"), extract.joined_present("system", "question", "answer").alias("present"))


@query("SELECT conv_id, turn, concat_ws(' ', nullif(role, ''), nullif(text, '')) AS every, coalesce(nullif(text, ''), concat_ws(' ', nullif(role, ''), nullif(text, ''))) AS named FROM conversations")
def field_or_all_texts(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    schema = turns.select("role", "text").schema
    return turns.select("conv_id", "turn", extract.field_or_all(schema, None).alias("every"), extract.field_or_all(schema, "text").alias("named"))


@query(f"WITH {_QA} SELECT conv_id, turn, coalesce(system, '') AS schema, coalesce(question, '') AS question, coalesce(answer, '') AS sql FROM qa")
def plain_triples(spark, sf_dir):
    return qa_pairs(spark, sf_dir).select("conv_id", "turn", extract.plain_triple("system", "question", "answer").alias("t")).select("conv_id", "turn", "t.*")


@query(f"WITH {_QA} SELECT conv_id, turn, '<schema>' || coalesce(system, '') || '</schema><question>' || question || '</question><sql>' AS prompt FROM qa")
def prompts(spark, sf_dir):
    return qa_pairs(spark, sf_dir).select("conv_id", "turn", extract.prompt(F.col("question"), text.text_or_empty("system")).alias("prompt"))


@query("""
    SELECT * FROM (VALUES (1, 'CREATE t', 'list all'), (2, 'one question: two', 'three'), (3, '', 'no marker here '), (4, 'a', 'b Q: c'), (5, '', '')) AS x(id, schema, question)
""")
def instruction_split(spark, sf_dir):
    rows = [(1, "CREATE t\nQuestion: list all"), (2, "one question: two Q: three"), (3, "no marker here "), (4, " a Q:  b Q: c\n"), (5, None)]
    df = spark.createDataFrame(rows, "id int, instruction string").withColumn("output", F.lit("x"))
    return df.select("id", extract.marked_triple("instruction", "output").alias("t")).select("id", "t.schema", "t.question")


@query(f"WITH {_QA} SELECT conv_id, turn, trim(question, ' ' || chr(9) || chr(10) || chr(13)) || CASE WHEN system IS NULL OR trim(system) = '' THEN '' ELSE chr(10) || 'Hint: ' || trim(system, ' ' || chr(9) || chr(10) || chr(13)) END AS question FROM qa")
def hinted_questions(spark, sf_dir):
    return qa_pairs(spark, sf_dir).select("conv_id", "turn", extract.hinted_triple("system", "question", "system", "answer").alias("t")).select("conv_id", "turn", "t.question")


@query("SELECT doc_id, replace(replace(substr(text, 1, 120), chr(10), ' '), chr(13), '') AS preview, len(regexp_extract_all(text, '\\S+')) AS words FROM documents")
def previews(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.preview(F.col("text")).alias("preview"), text.word_count(F.col("text")).alias("words"))


# Tokenizer


@query("SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '\\S+')) AS word FROM documents) GROUP BY word ORDER BY n DESC, word LIMIT 100")
def word_counts_top(spark, sf_dir):
    words = table(spark, sf_dir, "documents", True).select(F.explode(F.regexp_extract_all("text", F.lit(r"(\S+)"), 1)).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(100)


# Without a look ahead: a mark parts the last white space before a word from those before it, and no pattern takes a mark.
@query("""SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(
        regexp_replace(text, '(\\s)(\\s)([^\\s\\p{N}])', '\\1' || chr(1) || '\\2\\3', 'g'),
        '\\p{N}|''(?:s|t|re|ve|m|ll|d)| ?\\p{L}+| ?[^\\s\\p{L}\\p{N}\\x01]+|\\s+')) AS word FROM documents) GROUP BY word""")
def pretoken_counts(spark, sf_dir):
    return tokenizer.pre_token_counts(table(spark, sf_dir, "documents", True))


@query("SELECT lang, CAST(sum(strlen(text)) AS BIGINT) AS tokens, CAST(sum(len(regexp_extract_all(text, '\\S+'))) AS BIGINT) AS words, round(sum(strlen(text)) / sum(len(regexp_extract_all(text, '\\S+'))), 6) AS fertility FROM documents GROUP BY lang")
def byte_fertility(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", True)
    sums = docs.groupBy("lang").agg(long(F.sum(F.octet_length("text"))).alias("tokens"), long(F.sum(text.word_count(F.col("text")))).alias("words"))
    return sums.withColumn("fertility", F.round(F.col("tokens") / F.col("words"), 6))


@query()
def bpe_training(spark, sf_dir):
    """A vocabulary of 1,024 learned from all documents: ``id, token``."""
    bpe = tokenizer.train(tokenizer.pre_token_counts(table(spark, sf_dir, "documents", True)), 1024)
    return spark.createDataFrame(list(enumerate(bpe.names)), "id int, token string")


@query()
def bpe_round_trip(spark, sf_dir):
    """Every document encoded and decoded: ``doc_id, tokens, same``."""
    docs = table(spark, sf_dir, "documents", True)
    bpe = tokenizer.train(tokenizer.pre_token_counts(docs), 512)
    done = docs.select("doc_id", "text", tokenizer.encoder(bpe)(F.col("text")).alias("ids"))
    return done.select("doc_id", long(F.size("ids")).alias("tokens"), tokenizer.decoder(bpe)(F.col("ids")).eqNullSafe(F.col("text")).alias("same"))


_WORDS = ", ".join(f"('{w}')" for w in supplement.KEYWORDS)


@query(f"SELECT upper, count(*) AS n, count(DISTINCT k) AS keywords FROM (SELECT k FROM (VALUES {_WORDS}) AS v(k), range(1500) UNION ALL SELECT k FROM (VALUES ('CROSS'), ('NULLIF')) AS v(k), range(800)), (VALUES (true), (false)) AS u(upper) GROUP BY upper")
def keyword_supplement_counts(spark, sf_dir):
    word = F.when(F.col("upper"), F.col("keyword")).otherwise(F.lower("keyword"))
    return supplement.sentences(spark).where(F.contains("text", word)).groupBy("upper").agg(F.count("*").alias("n"), F.countDistinct("keyword").alias("keywords"))


@query("SELECT CAST(sum(strlen(text)) AS BIGINT) AS tokens, CAST(sum(len(regexp_extract_all(text, '\\S+'))) AS BIGINT) AS words, round(sum(strlen(text)) / sum(len(regexp_extract_all(text, '\\S+'))), 6) AS fertility FROM documents")
def corpus_fertility(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", True).withColumn("ids", tokenizer.byte_ids(F.col("text")))
    return tokenizer.fertility(docs, "ids").withColumn("fertility", F.round("fertility", 6))


# Budgets, packing, split


@query("SELECT doc_id, chars_before FROM (SELECT doc_id, CAST(coalesce(sum(length(text) + 1) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS chars_before FROM documents) WHERE chars_before < 1000000")
def char_budget_sample(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.length("text") + 1).alias("cost"), F.lit(0).alias("one"))
    return budget.within_budget(docs, ["one"], ["doc_id"], "cost", F.lit(1_000_000)).select("doc_id", F.col("before").alias("chars_before"))


@query("SELECT doc_id FROM (SELECT doc_id, coalesce(sum(length(text) + 1) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents) WHERE before < 700000")
def char_sampled_docs(spark, sf_dir):
    return budget.char_sample(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"], 700_000).select("doc_id")


_BUDGET_SQL = "budgets AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {v})" for k, v in BUDGETS) + ") AS b(lang, budget))"


def budgeted(spark, sf_dir) -> DataFrame:
    docs = good_docs(spark, sf_dir).select("doc_id", "lang", long(F.octet_length("text")).alias("n"))
    budgets = F.create_map(*[F.lit(x) for pair in BUDGETS for x in pair])
    return docs.withColumn("budget", long(F.element_at(budgets, F.col("lang"))))


@query(f"""WITH {_BUDGET_SQL} SELECT doc_id, lang, before FROM (
    SELECT doc_id, lang, budget, CAST(coalesce(sum(strlen(text)) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
    FROM documents JOIN budgets USING (lang) WHERE {GOOD}) WHERE before < budget""")
def token_budget_cut(spark, sf_dir):
    return budget.within_budget(budgeted(spark, sf_dir), ["lang"], ["doc_id"], "n", F.col("budget")).select("doc_id", "lang", "before")


@query(f"""WITH {_BUDGET_SQL}, p AS (
    SELECT doc_id, lang, budget, strlen(text) AS n, coalesce(sum(strlen(text)) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(strlen(text)) OVER (PARTITION BY lang) AS total
    FROM documents JOIN budgets USING (lang) WHERE {GOOD}
), e AS (SELECT *, unnest(range(CAST(ceil(budget / total) AS BIGINT))) AS epoch FROM p)
SELECT lang, epoch, count(*) AS docs, CAST(sum(n) AS BIGINT) AS tokens FROM e WHERE epoch * total + before < budget GROUP BY lang, epoch""")
def epoch_cycle_counts(spark, sf_dir):
    done = budget.cycled(budgeted(spark, sf_dir), ["lang"], ["doc_id"], "n", "budget")
    return done.groupBy("lang", "epoch").agg(F.count("*").alias("docs"), F.sum("n").alias("tokens"))


@query(f"SELECT lang, CAST(b // 100000 AS BIGINT) AS milestone, count(*) AS docs FROM (SELECT lang, coalesce(sum(strlen(text)) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM documents WHERE {GOOD}) GROUP BY ALL")
def build_milestones(spark, sf_dir):
    placed = exclusive_sum(budgeted(spark, sf_dir), ["lang"], ["doc_id"], "n", "before")
    return budget.milestones(placed, ["lang"], 100_000)


@query("""
    SELECT lang, CAST(sum(strlen(text) + 2) // 512 AS BIGINT) AS sequences, CAST(sum(strlen(text) + 2) // 512 * 512 AS BIGINT) AS tokens
    FROM documents WHERE length(text) BETWEEN 100 AND 1000000 GROUP BY lang
""")
def packed_counts_by_lang(spark, sf_dir):
    sized = good_docs(spark, sf_dir).select("lang", (F.octet_length("text") + 2).alias("n"))
    return packing.packed_counts(sized, ["lang"], "n", SEQUENCE_LENGTH)


def packed_docs(spark, sf_dir) -> DataFrame:
    """All documents in bytes, packed by language: ``source, seq_id, tokens``."""
    return packing.joined(doc_pieces(spark, sf_dir), ["source", "seq_id"])


def doc_pieces(spark, sf_dir) -> DataFrame:
    """The pieces of all documents in bytes: ``source, seq_id, p``."""
    docs = good_docs(spark, sf_dir).select("doc_id", F.col("lang").alias("source"), "text", (F.octet_length("text") + 2).alias("n"))
    ids = packing.wrapped(tokenizer.byte_ids(F.col("text"), once=False))
    return packing.pieces(docs, ["source"], ["doc_id"], sizes=written(docs.drop("text")), late=ids)


_TOKENS = f"""tok AS (
    SELECT lang AS source, doc_id, unnest(list_concat([{BOS}], list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST('0x' || x AS INTEGER) + {FIRST_BYTE}), [{EOS}])) AS id, generate_subscripts(regexp_extract_all(hex(encode(text)) || 'FFFF', '..'), 1) AS i
    FROM documents WHERE {GOOD}
), pos AS (SELECT source, id, row_number() OVER (PARTITION BY source ORDER BY doc_id, i) - 1 AS p, count(*) OVER (PARTITION BY source) AS n FROM tok),
seqs AS (SELECT source, p // 512 AS seq_id, p % 512 AS place, id FROM pos WHERE p // 512 < n // 512)"""


@query(f"WITH {_TOKENS} SELECT source, seq_id, count(*) AS size, CAST(sum(id * (place + 1)) AS BIGINT) AS checksum, CAST(min(id) AS BIGINT) AS low, CAST(max(id) AS BIGINT) AS high FROM seqs GROUP BY source, seq_id")
def packed_sequences(spark, sf_dir):
    weighed = F.aggregate(F.transform("tokens", lambda x, i: long(x) * (i + 1)), F.lit(0).cast("long"), lambda a, x: a + x)
    return packed_docs(spark, sf_dir).select("source", "seq_id", long(F.size("tokens")).alias("size"), weighed.alias("checksum"), long(F.array_min("tokens")).alias("low"), long(F.array_max("tokens")).alias("high"))


_SPLIT = """seq AS (SELECT lang AS source, unnest(range(CAST(sum(strlen(text) + 2) // 512 AS BIGINT))) AS seq_id FROM documents WHERE length(text) BETWEEN 100 AND 1000000 GROUP BY lang),
split AS (
    SELECT source, seq_id, row_number() OVER (PARTITION BY source ORDER BY sha256('42|' || source || '|' || seq_id), seq_id) AS position, greatest(1, count(*) OVER (PARTITION BY source) // 100) AS n_val FROM seq
)"""


def split_ids(spark, sf_dir) -> DataFrame:
    counts = packed_counts_by_lang(spark, sf_dir).where("sequences > 0")
    ids = counts.select(F.col("lang").alias("source"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("sequences") - 1)).alias("seq_id"))
    return packing.train_val_split(ids, ["source"])


@query(f"WITH {_SPLIT} SELECT source, seq_id, position, CASE WHEN position <= n_val THEN 'val' ELSE 'train' END AS split FROM split")
def train_val_split(spark, sf_dir):
    return split_ids(spark, sf_dir).select("source", "seq_id", "position", "split")


@query(f"""WITH {_SPLIT}, c AS (SELECT source, CASE WHEN position <= n_val THEN 'val' ELSE 'train' END AS split, count(*) AS n FROM split GROUP BY ALL)
    SELECT r.source, coalesce(max(n) FILTER (split = 'train'), 0) AS train, coalesce(max(n) FILTER (split = 'val'), 0) AS val FROM (VALUES ('de'), ('en'), ('es'), ('fr'), ('it')) AS r(source) LEFT JOIN c USING (source) GROUP BY r.source""")
def build_totals(spark, sf_dir):
    """Sequences of each split of the packed documents, also of the source that has none."""
    counts = packing.build_summary(split_facts(spark, sf_dir)).groupBy("source").pivot("split", ["train", "val"]).agg(F.sum("sequences"))
    return packing.with_missing(lang_registry(spark), counts)


def split_facts(spark, sf_dir) -> DataFrame:
    """The facts of the packed documents' sequences with their split: the tokens are made once and kept nowhere."""
    facts = written(packing.row_facts(packed_docs(spark, sf_dir)).select("source", "seq_id", *packing.FACTS))
    return written(packing.train_val_split(facts, ["source"]).select("source", "split", "seq_id", *packing.FACTS))


@query(f"""WITH {_SPLIT}, {_TOKENS}, t AS (SELECT s.source, s.seq_id, count(*) AS n, min(id) AS low, max(id) AS high FROM seqs s JOIN split p ON p.source = s.source AND p.seq_id = s.seq_id WHERE position > n_val GROUP BY ALL),
    f AS (SELECT count(*) AS rows, sum(n) AS tokens, bool_and(n = 512) AS whole, min(low) AS low, max(high) AS high FROM t)
    SELECT "check", CASE "check" WHEN 'tokenizer' THEN {FIRST_BYTE} + 256 = {VOCAB_SIZE} WHEN 'corpus_size' THEN tokens > 1000000 WHEN 'batch_shape' THEN rows >= 8 AND whole ELSE low >= 0 AND high < {VOCAB_SIZE} END AS passed
    FROM f, (VALUES ('tokenizer'), ('corpus_size'), ('batch_shape'), ('batch_ids')) AS v("check")""")
def preflight_checks(spark, sf_dir):
    """The tokenizer of bytes has too small a vocabulary; the other checks are of the packed documents."""
    return manifest.preflight(split_facts(spark, sf_dir), FIRST_BYTE + 256, least_tokens=1_000_000)


LANG_TARGETS = (("de", 0.2), ("en", 0.5), ("es", 0.1), ("fr", 0.15), ("it", 0.05))


def lang_registry(spark) -> DataFrame:
    return spark.createDataFrame([(n, int(1e6 * p), p) for n, p in LANG_TARGETS], "source string, token_budget long, target_proportion double")


@query(f"""WITH {_SPLIT}, c AS (SELECT source, count(*) FILTER (position > n_val) AS train_sequences, count(*) FILTER (position <= n_val) AS val_sequences FROM split GROUP BY source)
    SELECT source, train_sequences, val_sequences, train_sequences * 512 AS train_tokens, round(train_sequences / CAST(sum(train_sequences) OVER () AS BIGINT), 6) AS actual_proportion FROM c""")
def manifest_sources(spark, sf_dir):
    return manifest.proportions(manifest.split_counts(split_facts(spark, sf_dir)), lang_registry(spark)).select("source", "train_sequences", "val_sequences", "train_tokens", "actual_proportion")


@query("SELECT 'it' AS source WHERE NOT EXISTS (SELECT 1 FROM documents WHERE lang = 'it')")
def missing_sources(spark, sf_dir):
    present = table(spark, sf_dir, "documents").select(F.col("lang").alias("source"))
    return manifest.missing_sources(lang_registry(spark), present)


_TARGETS = ", ".join(f"('{n}', {p})" for n, p in LANG_TARGETS)


_FACT_SQL = f"""{_SPLIT}, {_TOKENS},
    marks AS (SELECT source, seq_id, id, place, lag(id) OVER (PARTITION BY source, seq_id ORDER BY place) AS before FROM seqs),
    rowsum AS (
        SELECT source, seq_id, count(*) AS n, min(id) AS low, max(id) AS high, count(*) FILTER (id = {BOS}) AS bos, count(*) FILTER (id = 2) AS pad, count(*) FILTER (id BETWEEN 4 AND 9) AS delimiters,
            count(*) FILTER (id = {BOS} AND place > 0) AS inner_bos, count(*) FILTER (id = {BOS} AND place > 0 AND before <> {EOS}) AS bad_bos, sha256(',' || string_agg(id, ',' ORDER BY place) || ',') AS digest FROM marks GROUP BY source, seq_id
    ),
    facts AS (SELECT r.*, CASE WHEN position <= n_val THEN 'val' ELSE 'train' END AS split FROM rowsum r JOIN split p ON p.source = r.source AND p.seq_id = r.seq_id),
    targets(source, target) AS (VALUES {_TARGETS})"""


@query(f"""WITH {_FACT_SQL},
    shares AS (SELECT source, sum(n) / sum(sum(n)) OVER () AS share FROM facts WHERE split = 'train' GROUP BY source),
    marked AS (SELECT source, sum(bos) AS bos FROM facts GROUP BY source),
    r AS (SELECT bool_and(n = 512) AS shape, min(low) >= 0 AND max(high) < {VOCAB_SIZE} AS id_range, sum(bad_bos) <= 0.05 * sum(inner_bos) AS eos_before_bos, sum(pad) FILTER (split = 'train') / sum(n) FILTER (split = 'train') <= 1e-6 AS pad_rate, sum(delimiters) FILTER (split = 'train') / sum(n) FILTER (split = 'train') <= 1e-6 AS delimiter_rate FROM facts)
    SELECT 'files' AS "check", (SELECT count(DISTINCT source || split) FROM facts) = (SELECT 2 * count(*) FROM targets) AS passed UNION ALL SELECT 'shape', shape FROM r UNION ALL SELECT 'id_range', id_range FROM r
    UNION ALL SELECT 'bos_present', (SELECT min(bos) > 0 FROM marked) UNION ALL SELECT 'eos_before_bos', eos_before_bos FROM r UNION ALL SELECT 'pad_rate', pad_rate FROM r UNION ALL SELECT 'delimiter_rate', delimiter_rate FROM r
    UNION ALL SELECT 'proportions', (SELECT max(abs(share - target)) <= 0.05 FROM shares JOIN targets USING (source)) UNION ALL SELECT 'checksums', (SELECT count(*) = count(DISTINCT (source, seq_id)) FROM facts)""")
def verify_summary(spark, sf_dir):
    """All checks over the packed documents; one registered source is missing."""
    facts = split_facts(spark, sf_dir)
    return manifest.verify(facts, lang_registry(spark), packing.build_summary(facts)).select("check", "passed")


@query(f"""WITH {_FACT_SQL},
    ranges AS (SELECT source, split, seq_id // {packing.RANGE} AS node, count(*) AS rows, sha256(string_agg(lpad(CAST(seq_id AS VARCHAR), 20, '0') || ':' || digest || ':1', chr(10) ORDER BY seq_id)) AS h FROM facts GROUP BY ALL),
    l1 AS (SELECT source, split, node // {packing.RANGE} AS up, sum(rows) AS rows, sha256(string_agg(lpad(CAST(node AS VARCHAR), 20, '0') || ':' || h, chr(10) ORDER BY node)) AS h FROM ranges GROUP BY ALL),
    l2 AS (SELECT source, split, up // {packing.RANGE} AS top, sum(rows) AS rows, sha256(string_agg(lpad(CAST(up AS VARCHAR), 20, '0') || ':' || h, chr(10) ORDER BY up)) AS h FROM l1 GROUP BY ALL)
    SELECT source, split, CAST(sum(rows) AS BIGINT) AS sequences, sha256(string_agg(lpad(CAST(top AS VARCHAR), 20, '0') || ':' || h, chr(10) ORDER BY top)) AS content_hash FROM l2 GROUP BY source, split""")
def content_hashes(spark, sf_dir):
    """The hash of every split of the packed documents, as the manifest records it."""
    return packing.build_summary(split_facts(spark, sf_dir))


@query(f"""WITH {_SPLIT}, d AS (SELECT source, CASE WHEN position <= n_val THEN 'val' ELSE 'train' END AS split, seq_id FROM split WHERE seq_id % 1500 IN (0, 1, 2, 3, 4))
    SELECT DISTINCT source, split, seq_id // {packing.RANGE} AS "range" FROM d""")
def changed_ranges(spark, sf_dir):
    """Which ranges differ after of each 1,500 sequences one was lost, one came three times and three changed."""
    facts = split_facts(spark, sf_dir)
    k = F.col("seq_id") % 1500
    kept = facts.where(k != 0).withColumn("digest", F.when(k == 2, F.sha2("digest", 256)).otherwise(F.col("digest")))
    moved = kept.withColumn("digest", F.when(k.isin(3, 4), F.concat("digest", F.lit("'"))).otherwise(F.col("digest")))
    damaged = moved.withColumn("copies", F.explode(F.when(k == 1, F.sequence(F.lit(1), F.lit(3))).otherwise(F.array(F.lit(1))))).drop("copies")
    return manifest.changed_ranges(packing.content_ranges(damaged), packing.content_ranges(facts))


@query("SELECT source, CAST(budget AS BIGINT) AS token_budget, round(budget / 2535000000, 9) AS target FROM (VALUES ('stack_sql', 1100000000), ('stack_markdown', 80000000), ('sqale', 200000000), ('gretelai', 100000000), ('nstext2sql', 50000000), ('sql_create_context', 30000000), ('stack_python', 280000000), ('stack_ruby', 50000000), ('fineweb', 600000000), ('oasst', 15000000), ('bird', 30000000)) AS v(source, budget)")
def registry_proportions(spark, sf_dir):
    return registry_table(spark).select("source", "token_budget", F.round("target_proportion", 9).alias("target"))


# Sources and sinks, over the test tables written in the shapes of the sources

_RAW = f"""{_QA},
    code AS (SELECT doc_id, text AS content, CASE doc_id % 3 WHEN 0 THEN 'db/migration/' WHEN 1 THEN 'Schema.rb' END AS path, CASE doc_id % 4 WHEN 0 THEN 'sql' WHEN 1 THEN 'markdown' WHEN 2 THEN 'python' ELSE 'ruby' END AS lang FROM documents),
    alnum AS (SELECT *, length(regexp_replace(content, '[^\\p{{L}}\\p{{N}}]', '', 'g')) / greatest(1, length(content)) AS share, upper(content) AS u FROM code)"""


def source_tables(spark, sf_dir) -> str:
    """A folder with the test tables in the shapes of ten sources; one is left out."""
    base = f"{scratch_dir(spark)}/sources-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents", True)
    lang = F.element_at(F.array(*map(F.lit, ("sql", "markdown", "python", "ruby"))), (F.col("doc_id") % 4 + 1).cast("int"))
    path = F.when(F.col("doc_id") % 3 == 0, "db/migration/").when(F.col("doc_id") % 3 == 1, "Schema.rb")
    qa = qa_pairs(spark, sf_dir)
    texts = {"system": "s", "question": "q", "answer": "a"}
    some = lambda **names: qa.select(*[F.col(next(c for c, k in texts.items() if k == v)).alias(n) for n, v in names.items()])
    tables = {
        "code_files": docs.select(F.col("text").alias("content"), path.alias("max_stars_repo_path"), lang.alias("lang")), "fineweb": docs.select("text"),
        "oasst": table(spark, sf_dir, "conversations").select("text", F.when(F.col("role") == "user", "prompter").otherwise(F.col("role")).alias("role"), F.when(F.col("conv_id") % 5 == 0, "de").otherwise("en").alias("lang")),
        "gretelai": some(sql_context="s", sql_prompt="q", sql="a", sql_explanation="q"), "nstext2sql": some(instruction="q", output="a"), "sql_create_context": some(question="q", context="s", answer="a"),
        "bird": some(schema="s", question="q", evidence="s", SQL="a"),
    }
    for name, df in tables.items():
        df.write.parquet(f"{base}/{name}.parquet")
    return base


def _source_sql(name: str, text: str, rows: str) -> str:
    return f"SELECT '{name}' AS source, {text} AS text FROM {rows}"


_EMPTY = lambda c: f"coalesce({c}, '')"
_SOURCE_TEXTS = " UNION ALL ".join([
    _source_sql("gretelai", f"{_EMPTY('system')} || chr(10) || question || chr(10) || answer || chr(10) || question", "qa"), _source_sql("nstext2sql", "question || chr(10) || answer", "qa"), _source_sql("sql_create_context", f"question || chr(10) || {_EMPTY('system')} || chr(10) || answer", "qa"),
    _source_sql("bird", "concat_ws(chr(10), nullif(system, ''), nullif(question, ''), nullif(system, ''), nullif(answer, ''))", "qa"), _source_sql("fineweb", "text", "documents"), _source_sql("oasst", "text", "conversations WHERE role = 'user' AND conv_id % 5 <> 0"),
    _source_sql("stack_sql", "content", "alnum WHERE lang = 'sql' AND share >= 0.25 AND regexp_matches(u, 'SELECT|FROM|CREATE|INSERT')"),
    _source_sql("stack_markdown", "content", "alnum WHERE lang = 'markdown' AND len(list_filter(['SELECT', 'FROM', 'WHERE', 'JOIN', 'TABLE', 'CREATE', 'INSERT', 'UPDATE', 'DELETE'], lambda w: contains(u, w))) >= 2"),
    _source_sql("stack_python", "content", "alnum WHERE lang = 'python' AND contains(u, 'SELECT') AND regexp_matches(u, 'FROM|WHERE|JOIN')"), _source_sql("stack_ruby", "content", "alnum WHERE lang = 'ruby' AND doc_id % 3 < 2"),
])


@query(f"WITH {_RAW}, t AS ({_SOURCE_TEXTS}) SELECT source, count(*) AS docs, CAST(sum(length(text)) AS BIGINT) AS chars FROM t WHERE length(text) BETWEEN 100 AND 1000000 GROUP BY source UNION ALL SELECT 'sqale', -1, -1")
def registered_sources(spark, sf_dir):
    """What every source of the registry gives, read, filtered and normalised; -1 for the one that isn't there."""
    found, skipped = readers.load_all(spark, source_tables(spark, sf_dir))
    every = functools.reduce(DataFrame.unionByName, found.values())
    counts = every.groupBy("source").agg(F.count("*").alias("docs"), long(F.sum(F.length("text"))).alias("chars"))
    return counts.unionByName(skipped.select("source", long(F.lit(-1)).alias("docs"), long(F.lit(-1)).alias("chars")))


_TUNING = """SELECT 'bird' AS source, strlen(coalesce(system, '')) AS s, strlen(trim(question, ' ' || chr(9) || chr(10) || chr(13))) + CASE WHEN system IS NULL OR trim(system) = '' THEN 0 ELSE 7 + strlen(trim(system, ' ' || chr(9) || chr(10) || chr(13))) END AS q, strlen(answer) AS a FROM qa
    UNION ALL SELECT 'sql_create_context', strlen(coalesce(system, '')), strlen(question), strlen(answer) FROM qa UNION ALL SELECT 'gretelai', strlen(coalesce(system, '')), strlen(question), strlen(answer) FROM qa UNION ALL SELECT 'nstext2sql', 0, strlen(question), strlen(answer) FROM qa"""


@query(f"WITH {_QA}, t AS ({_TUNING}) SELECT source, count(*) FILTER (s + q + a + 8 <= {FINETUNE_LENGTH}) AS kept, count(*) FILTER (s + q + a + 8 > {FINETUNE_LENGTH}) AS skipped FROM t WHERE a > 0 GROUP BY source")
def tuning_sources(spark, sf_dir):
    """The instruction-tuning set of all its sources, in bytes: kept and skipped rows."""
    return build.build_finetune(spark, source_tables(spark, sf_dir), tokenizer.Bpe([]))[1]


@query(f"WITH {_TOKENS} SELECT source, seq_id, CAST(sum(id * (place + 1)) AS BIGINT) AS checksum FROM seqs GROUP BY source, seq_id")
def npy_round_trip(spark, sf_dir):
    """The packed documents written as NumPy files and read again."""
    path = f"{scratch_dir(spark)}/npy-{uuid.uuid4().hex}"
    sinks.write_npy(packed_docs(spark, sf_dir).withColumn("split", F.lit("train")), path, rows=1000)
    back = readers.read_npy(spark, path, rows=300)
    at = F.regexp_extract("path", r"([^/]+)/train-([0-9]+)\.npy$", 2).cast("long") + F.col("row")
    weighed = F.aggregate(F.transform("tokens", lambda x, i: long(x) * (i + 1)), F.lit(0).cast("long"), lambda a, x: a + x)
    return back.select(F.regexp_extract("path", r"([^/]+)/train-[0-9]+\.npy$", 1).alias("source"), at.alias("seq_id"), weighed.alias("checksum"))


@query(f"WITH {_SPLIT} SELECT source, CASE WHEN position <= n_val THEN 'val' ELSE 'train' END AS split, count(*) AS sequences, 0 AS written_again FROM split GROUP BY ALL")
def written_corpus(spark, sf_dir):
    """The packed and split documents written by source and split, a second time without effect, and read again."""
    path = f"{scratch_dir(spark)}/corpus-{uuid.uuid4().hex}"
    # Which sequences there are follows from the sizes, and the split from one row of each source.
    cuts = written(packing.split_cuts(split_ids(spark, sf_dir), ["source"]))
    pieces = packing.with_split(doc_pieces(spark, sf_dir), cuts, ["source"])
    sinks.write_pieces(pieces, path)
    again = len(sinks.write_pieces(pieces, path))
    return spark.read.parquet(path).groupBy("source", "split").agg(F.count("*").alias("sequences")).withColumn("written_again", F.lit(again))


@query("SELECT event_id AS step, CASE WHEN event_id % 10 = 0 THEN 'val' ELSE 'train' END AS kind, value AS loss FROM events")
def metrics_read_back(spark, sf_dir):
    path = f"{scratch_dir(spark)}/metrics-{uuid.uuid4().hex}"
    sinks.append_metrics(log(spark, sf_dir), path)
    return readers.read_metrics(spark, path).select("step", "kind", "loss")


@query("SELECT tokenizer, tokens, words, round(tokens / words, 6) AS fertility FROM (SELECT 'bytes' AS tokenizer, CAST(sum(strlen(text)) AS BIGINT) AS tokens, CAST(sum(len(regexp_extract_all(text, '\\S+'))) AS BIGINT) AS words FROM documents UNION ALL SELECT 'characters', CAST(sum(length(text)) AS BIGINT), CAST(sum(len(regexp_extract_all(text, '\\S+'))) AS BIGINT) FROM documents)")
def compared_tokenizers(spark, sf_dir):
    """Bytes and characters as tokens of all documents, the fewer to a word the better."""
    docs = table(spark, sf_dir, "documents", True)
    both = {"bytes": tokenizer.byte_ids(F.col("text")), "characters": F.regexp_extract_all("text", F.lit("(?s)(.)"), 1)}
    return tokenizer.compare_fertility(docs, both).select("tokenizer", "tokens", "words", F.round("fertility", 6).alias("fertility"))


@query("SELECT doc_id, strlen(text) AS tokens, true AS same FROM documents")
def byte_round_trips(spark, sf_dir):
    """Every document encoded and decoded by the tokenizer before any merge."""
    docs, bpe = table(spark, sf_dir, "documents", True), tokenizer.Bpe([])
    done = tokenizer.round_trips(docs.select("doc_id", "text"), bpe).withColumn("ids", tokenizer.encoder(bpe)(F.col("text")))
    return done.select("doc_id", long(F.size("ids")).alias("tokens"), "same")


@query("SELECT conv_id, turn, text AS query FROM conversations WHERE length(text) > 0 ORDER BY conv_id * 100 + turn LIMIT 300")
def first_queries(spark, sf_dir):
    """The first of some fields that is a text, of the first rows that have one; one field here is a number."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("conv_id") * 100 + F.col("turn")).alias("k"), F.col("turn").alias("query"), F.col("text").alias("sql"))
    return readers.sql_queries(turns.drop("conv_id", "turn"), 300, "k").join(turns.select("k", "conv_id", "turn"), "k").select("conv_id", "turn", "query")


# Instruction tuning


def finetune_rows(spark, sf_dir) -> DataFrame:
    qa = qa_pairs(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism)
    ids = lambda c: tokenizer.byte_ids(text.text_or_empty(c))
    rows = qa.select("conv_id", "turn", F.lit("conversations").alias("source"), ids("system").alias("schema_ids"), ids("question").alias("question_ids"), ids("answer").alias("sql_ids"))
    return finetune.encode_examples(rows)


_FT = f"WITH {_QA}, x AS (SELECT *, strlen(coalesce(system, '')) AS s, strlen(question) AS q, strlen(answer) AS a, strlen(coalesce(system, '')) + strlen(question) + strlen(answer) + 8 AS n FROM qa WHERE strlen(answer) > 0)"


@query("SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) - 1 AS nth FROM conversations")
def numpy_numbered(spark, sf_dir):
    """Every turn with its number, where NumPy's stream gave two draws from the unit interval; the draws are tested against NumPy."""
    turns = exclusive_sum(table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lit(0).alias("all"), F.lit(1).alias("one")), ["all"], ["conv_id", "turn"], "one", "nth")
    drawn = finetune.numpy_draws(turns, "nth")
    return drawn.where("val_draw >= 0 AND val_draw < 1 AND copy_draw >= 0 AND copy_draw < 1").select("conv_id", "turn", "nth")


@query(f"{_FT} SELECT conv_id, turn, n, s + q + 5 AS first_one, a + 2 AS ones, CAST({FINETUNE_LENGTH} - n AS BIGINT) AS pads FROM x WHERE n <= {FINETUNE_LENGTH}")
def finetune_examples(spark, sf_dir):
    kept = finetune_rows(spark, sf_dir).where("tokens IS NOT NULL")
    return kept.select("conv_id", "turn", long("n").alias("n"), long(F.array_position("mask", F.lit(1).cast("tinyint")) - 1).alias("first_one"), long(F.size(F.filter("mask", lambda x: x == 1))).alias("ones"), long(F.size(F.filter("tokens", lambda x: x == 2))).alias("pads"))


@query(f"{_FT} SELECT 'conversations' AS source, count(*) FILTER (n <= {FINETUNE_LENGTH}) AS kept, count(*) FILTER (n > {FINETUNE_LENGTH}) AS skipped FROM x")
def finetune_stats(spark, sf_dir):
    return finetune.kept_and_skipped(finetune_rows(spark, sf_dir))


@query(f"{_FT} SELECT 'train' AS split, round(sum(a + 2) / (count(*) * {FINETUNE_LENGTH}), 9) AS density FROM x WHERE n <= {FINETUNE_LENGTH}")
def finetune_mask_stats(spark, sf_dir):
    return finetune.mask_density(finetune_rows(spark, sf_dir).withColumn("split", F.lit("train"))).withColumn("density", F.round("density", 9))


_U = "CAST('0x' || substr(sha256({}), 1, 13) AS BIGINT) / 4503599627370496.0"


@query(f"""WITH {_QA}, d AS (SELECT conv_id, turn, (conv_id % 4) AS k, {_U.format("'42|val|conversations|' || conv_id || '-' || turn")} AS uv, {_U.format("'42|copy|conversations|' || conv_id || '-' || turn")} AS uc FROM qa),
    w AS (SELECT *, CASE k WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 WHEN 2 THEN 1.0 ELSE 0.25 END AS weight FROM d)
    SELECT conv_id, turn, CASE WHEN uv < 0.01 THEN 'val' ELSE 'train' END AS split, CAST(unnest(range(1, 1 + CAST(floor(weight) + CASE WHEN uc < weight - floor(weight) THEN 1 ELSE 0 END AS BIGINT))) AS BIGINT) AS copy_no FROM w""")
def weighted_copies(spark, sf_dir):
    qa = qa_pairs(spark, sf_dir).select("conv_id", "turn")
    weight = F.element_at(F.array(F.lit(5.0), F.lit(2.0), F.lit(1.0), F.lit(0.25)), (F.col("conv_id") % 4 + 1).cast("int"))
    return finetune.split_and_copy(qa, F.concat_ws("-", "conv_id", "turn"), F.lit("conversations"), weight).select("conv_id", "turn", "split", long("copy_no").alias("copy_no"))


@query(f"WITH {_QA} SELECT conv_id, turn, row_number() OVER (ORDER BY sha256('0|' || conv_id || '|' || turn), conv_id, turn) AS position FROM qa")
def shuffled_examples(spark, sf_dir):
    rows = finetune.shuffled_train(qa_pairs(spark, sf_dir).select("conv_id", "turn", F.lit("train").alias("split"), F.lit(0).alias("one")), ["conv_id", "turn"])
    return hash_rank(rows, ["one"], "digest", ["conv_id", "turn"], "position").select("conv_id", "turn", "position")


# Sampling

_SOURCES = "src AS (SELECT lang AS source, count(*) AS n, CASE lang WHEN 'de' THEN 0.2 WHEN 'en' THEN 0.5 WHEN 'es' THEN 0.1 ELSE 0.15 END AS w FROM documents GROUP BY lang), wts AS (SELECT source, n, w, sum(w) OVER () AS t, sum(w) OVER (ORDER BY source) AS c FROM src)"


_SEQ_SOURCES = f"src AS (SELECT lang AS source, sum(strlen(text) + 2) // 512 AS n, CASE lang WHEN 'de' THEN 0.2 WHEN 'en' THEN 0.5 WHEN 'es' THEN 0.1 ELSE 0.15 END AS w FROM documents WHERE {GOOD} GROUP BY lang), wts AS (SELECT source, n, w, sum(w) OVER () AS t, sum(w) OVER (ORDER BY source) AS c FROM src)"


def source_sizes(spark, sf_dir) -> DataFrame:
    sizes = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("source")).agg(F.count("*").alias("n"))
    return sizes.join(lang_registry(spark).select("source", "target_proportion"), "source")


@query(f"""WITH {_SOURCES}, b AS (SELECT unnest(range(200)) AS batch_id), d AS (SELECT batch_id, {_U.format("'42|source|' || batch_id")} AS u FROM b),
    p AS (SELECT batch_id, source, n FROM d JOIN wts ON u * t >= c - w AND u * t < c), s AS (SELECT *, unnest(range(8)) AS slot FROM p)
    SELECT batch_id, CAST(slot AS BIGINT) AS slot, source, CAST(floor({_U.format("'42|row|' || batch_id || '|' || slot")} * n) AS BIGINT) AS row_idx FROM s""")
def mixture_batches(spark, sf_dir):
    return sampling.mixture_rows(spark, source_sizes(spark, sf_dir), 200, 8).withColumn("slot", long("slot"))


@query(f"""WITH {_SEQ_SOURCES}, {_TOKENS}, sums AS (SELECT source, seq_id, CAST(sum(id) AS BIGINT) AS total FROM seqs GROUP BY ALL), b AS (SELECT unnest(range(50)) AS batch_id),
    d AS (SELECT batch_id, {_U.format("'42|source|' || batch_id")} AS u FROM b), p AS (SELECT batch_id, source, n FROM d JOIN wts ON u * t >= c - w AND u * t < c), s AS (SELECT *, unnest(range(8)) AS slot FROM p),
    r AS (SELECT batch_id, CAST(slot AS BIGINT) AS slot, source, CAST(floor({_U.format("'42|row|' || batch_id || '|' || slot")} * n) AS BIGINT) AS row_idx FROM s)
    SELECT batch_id, slot, r.source, row_idx, total FROM r JOIN sums ON sums.source = r.source AND seq_id = row_idx""")
def batch_tokens(spark, sf_dir):
    """The drawn sequences themselves, from a layout of which only the drawn chunks are read: the sum of the tokens of each."""
    sizes = packed_counts_by_lang(spark, sf_dir).select(F.col("lang").alias("source"), F.col("sequences").alias("n")).join(lang_registry(spark).select("source", "target_proportion"), "source")
    corpus = Table(sampling.chunked(packed_docs(spark, sf_dir), 256), ("source", "chunk")).df
    drawn = sampling.gather(sampling.mixture_rows(spark, sizes, 50, 8), corpus, 256)
    return drawn.select("batch_id", long("slot").alias("slot"), "source", "row_idx", F.aggregate("tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query(f"""WITH {_SOURCES}, b AS (SELECT unnest(range(20)) AS batch_id), d AS (SELECT batch_id, {_U.format("'42|source|' || batch_id")} AS u FROM b),
    p AS (SELECT batch_id, source, n, CASE WHEN n <= 64 THEN 0 ELSE CAST(floor({_U.format("'42|start|' || batch_id")} * (n - 64)) AS BIGINT) END AS start FROM d JOIN wts ON u * t >= c - w AND u * t < c)
    SELECT batch_id, source, CAST(unnest(range(start, least(start + 64, n))) AS BIGINT) AS row_idx FROM p""")
def validation_rows(spark, sf_dir):
    return sampling.slice_rows(sampling.validation_slices(spark, source_sizes(spark, sf_dir), 20, 64))


@query(f"""WITH n AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS row_idx, count(*) OVER (PARTITION BY lang) AS n FROM documents),
    d AS (SELECT lang, n, unnest(range(20)) AS draw FROM (SELECT DISTINCT lang, n FROM n))
    SELECT d.lang, CAST(draw AS BIGINT) AS draw, doc_id FROM d JOIN n ON n.lang = d.lang AND row_idx = CAST(floor({_U.format("'7|' || d.lang || '|' || draw")} * d.n) AS BIGINT)""")
def sampled_docs(spark, sf_dir):
    rows = exclusive_sum(table(spark, sf_dir, "documents").select("doc_id", "lang", F.lit(1).alias("one")), ["lang"], ["doc_id"], "one", "row_idx")
    return sampling.sample_rows(rows, ["lang"], "row_idx", 20, 7).select("lang", long("draw").alias("draw"), "doc_id")


@query(f"""WITH {_SOURCES}, b AS (SELECT unnest(range(100)) AS batch_id), d AS (SELECT batch_id, {_U.format("'42|source|' || batch_id")} AS u FROM b),
    p AS (SELECT batch_id, source, n, CASE WHEN n <= 64 THEN 0 ELSE CAST(floor({_U.format("'42|start|' || batch_id")} * (n - 64)) AS BIGINT) END AS start FROM d JOIN wts ON u * t >= c - w AND u * t < c)
    SELECT batch_id, source, start, least(start + 64, n) AS stop FROM p""")
def validation_slices(spark, sf_dir):
    return sampling.validation_slices(spark, source_sizes(spark, sf_dir), 100, 64)


@query("SELECT doc_id, lang, (r - 1) // 32 AS batch FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents) WHERE (r - 1) // 32 < n // 32")
def epoch_batches(spark, sf_dir):
    rows = exclusive_sum(table(spark, sf_dir, "documents").select("doc_id", "lang", F.lit(1).alias("one")), ["lang"], ["doc_id"], "one", "row")
    return sampling.epoch_batches(rows, ["lang"], "row", 32).select("doc_id", "lang", "batch")


@query("""WITH e AS (SELECT doc_id, unnest(range(2)) AS epoch FROM documents), r AS (SELECT doc_id, epoch, row_number() OVER (PARTITION BY epoch ORDER BY sha256('0|' || epoch || '|' || doc_id), doc_id) - 1 AS p, count(*) OVER (PARTITION BY epoch) AS n FROM e)
    SELECT doc_id, epoch, p // 64 AS batch, p % 64 AS slot FROM r WHERE p // 64 < n // 64""")
def shuffled_epochs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return sampling.shuffled_epochs(docs, "doc_id", 64, 2).select("doc_id", long("epoch").alias("epoch"), "batch", "slot")


# Evaluation

PREDICTIONS = (
    (1, "SELECT a FROM t;", "select a from t", "a", 40),
    (2, "SELECT b FROM t ;;", "SELECT  b\tFROM t", "b", 130),
    (3, "SELECT a FROM t ORDER BY a", "SELECT a FROM t", "a", 300),
    (4, "SELECT nothing FROM t", "SELECT a FROM t", "a", 511),
    (5, "SELECT b FROM t", "SELECT a FROM t", "b", 512),
    (6, "SELECT a FROM t WHERE a > 5", "SELECT b FROM t WHERE b > 9", "a", 700),
    (7, "", "SELECT a FROM t", "a", 10),
    (8, "SELECT 1", "SELECT 1", "missing", 20),
)
T_SQL = "CREATE TABLE t (a INT, b INT); INSERT INTO t VALUES (1, 2), (1, 2), (3, 4);"


def predictions(spark) -> DataFrame:
    rows = spark.createDataFrame(list(PREDICTIONS), "id int, pred string, gold string, db_id string, n int")
    return evaluation.with_schema(rows, spark.createDataFrame([("a", T_SQL), ("b", T_SQL)], "db_id string, schema_sql string"))


@query("SELECT id, em FROM (VALUES (1, true), (2, false), (3, false), (4, false), (5, false), (6, false), (7, false), (8, true)) AS v(id, em)")
def sql_exact_match(spark, sf_dir):
    return predictions(spark).select("id", evaluation.exact_match(F.col("pred"), F.col("gold")).alias("em"))


@query("SELECT * FROM (VALUES (1, true, true, false, false), (2, false, false, true, false), (3, false, true, false, false), (4, false, false, true, false), (5, false, false, false, false), (6, false, true, false, true), (7, false, false, false, false), (8, true, false, false, false)) AS v(id, em, ex, exec_error, empty_result)")
def sql_exec_accuracy(spark, sf_dir):
    return evaluation.score(predictions(spark)).select("id", "em", "ex", "exec_error", "empty_result")


@query("SELECT 8::BIGINT AS n, 2::BIGINT AS em_count, 3::BIGINT AS ex_count, 2::BIGINT AS exec_errors, 1::BIGINT AS empty_results, 0.25::DOUBLE AS em, 0.375::DOUBLE AS ex")
def sql_eval_summary(spark, sf_dir):
    return evaluation.summary(evaluation.score(predictions(spark)))


_BUCKET = "CASE WHEN {n} >= 512 THEN '>512' ELSE CAST({n} // 128 * 128 AS VARCHAR) || '-' || CAST({n} // 128 * 128 + 128 AS VARCHAR) END"


@query(f"SELECT {_BUCKET.format(n='n')} AS bucket, count(*) AS n, count(*) FILTER (ex) AS ex_count, median(n) AS median_length FROM (VALUES (40, true), (130, false), (300, true), (511, false), (512, false), (700, true), (10, false), (20, false)) AS v(n, ex) GROUP BY bucket")
def ex_by_length_bucket(spark, sf_dir):
    return evaluation.by_length(evaluation.score(predictions(spark))).select("bucket", "n", "ex_count", "median_length")


@query(f"SELECT {_BUCKET.format(n='length(text)')} AS bucket, count(*) AS n, count(*) FILTER (doc_id % 3 = 0) AS ex_count, round(count(*) FILTER (doc_id % 3 = 0) / count(*), 9) AS ex, median(length(text)) AS median_length FROM documents GROUP BY bucket")
def rates_by_text_length(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.length("text").alias("n"), (F.col("doc_id") % 3 == 0).alias("ex"))
    return evaluation.by_length(docs).withColumn("ex", F.round("ex", 9))


_NORMAL = "regexp_replace(lower(regexp_replace(regexp_replace({x}, '^\\s+|\\s+$', '', 'g'), ';+$', '')), '\\s+', ' ', 'g')"


@query(f"""WITH p AS (SELECT conv_id, turn, text AS gold, CASE turn % 3 WHEN 0 THEN '  ' || replace(text, ' ', chr(10) || ' ') || ';;' WHEN 1 THEN text || ' x' ELSE lower(text) || ' ;' END AS pred FROM conversations)
    SELECT conv_id, turn, {_NORMAL.format(x="pred")} = {_NORMAL.format(x="gold")} AS em FROM p""")
def turns_exact_match(spark, sf_dir):
    pred = F.expr("CASE turn % 3 WHEN 0 THEN concat('  ', replace(text, ' ', '\\n '), ';;') WHEN 1 THEN concat(text, ' x') ELSE concat(lower(text), ' ;') END")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", evaluation.exact_match(pred, F.col("text")).alias("em"))


@query("SELECT outcome, n::BIGINT AS n FROM (VALUES ('exact', 2), ('same_rows', 2), ('error', 2), ('wrong_rows', 2)) AS v(outcome, n)")
def failure_taxonomy(spark, sf_dir):
    scored = evaluation.score(predictions(spark)).withColumn("outcome", evaluation.failure_class(F.col("em"), F.col("ex"), F.col("exec_error")))
    return scored.groupBy("outcome").agg(F.count("*").alias("n"))


@query("SELECT v AS version, ex, coalesce(round(ex - lag(ex) OVER (ORDER BY v), 6), 0) AS ex_change FROM (VALUES (1, 0.25::DOUBLE), (2, 0.5::DOUBLE), (3, 0.375::DOUBLE)) AS t(v, ex)")
def version_comparison(spark, sf_dir):
    metrics = spark.createDataFrame([(1, 0.25), (2, 0.5), (3, 0.375)], "version int, ex double")
    return evaluation.compare_versions(metrics, "version", ["ex"]).withColumn("ex_change", F.coalesce(F.round("ex_change", 6), F.lit(0.0)))


@query("SELECT CAST(c AS BIGINT) AS n, round(e / c, 9) AS em_rate, round(x / c, 9) AS ex_rate FROM (SELECT sum(n) OVER w AS c, sum(e) OVER w AS e, sum(x) OVER w AS x FROM (SELECT event_id // 100 AS b, count(*) AS n, count(*) FILTER (value > 50) AS e, count(*) FILTER (value > 20) AS x FROM events GROUP BY b) WINDOW w AS (ORDER BY b))")
def running_rates(spark, sf_dir):
    scored = table(spark, sf_dir, "events").select("event_id", (F.col("value") > 50).alias("em"), (F.col("value") > 20).alias("ex"))
    return evaluation.running_rates(scored, "event_id").select("n", F.round("em_rate", 9).alias("em_rate"), F.round("ex_rate", 9).alias("ex_rate"))


@query("""SELECT * FROM (VALUES ('shop', 'CREATE TABLE IF NOT EXISTS "item" ("name" TEXT, "price" REAL, "sold" INTEGER);' || chr(10) || 'CREATE TABLE IF NOT EXISTS "empty" ("id" TEXT);'), ('zoo', 'CREATE TABLE IF NOT EXISTS "animal" ("born" TEXT, "odd" TEXT);')) AS v(db_id, schema_sql)""")
def schema_from_catalog(spark, sf_dir):
    rows = [("shop", ["item", "empty"], [(-1, "*"), (0, "name"), (0, "price"), (0, "sold")], ["text", "text", "number", "boolean"]), ("zoo", ["animal"], [(-1, "*"), (0, "born"), (0, "odd")], ["text", "time", "blob"])]
    catalogue = spark.createDataFrame(rows, "db_id string, table_names_original array<string>, column_names_original array<struct<tbl: int, col: string>>, column_types array<string>")
    return schema_catalog.schema_texts(catalogue)


@query("""SELECT 'CREATE TABLE "t_1_2" ("Name x" TEXT, "Size" REAL, "Other" TEXT);' AS ddl""")
def wikisql_schema(spark, sf_dir):
    rows = spark.createDataFrame([(("t 1-2", ["Name x", "Size", "Other"], ["text", "real", "date"]),)], "t struct<id: string, header: array<string>, types: array<string>>")
    return rows.select(extract.wikisql_table(F.col("t")).alias("ddl"))


# Training logs and decoding


def log(spark, sf_dir) -> DataFrame:
    """Events as a log: every tenth is a validation record."""
    kind = F.when(F.col("event_id") % 10 == 0, "val").otherwise("train")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("step"), kind.alias("kind"), F.col("value").alias("loss"))


@query("SELECT event_id AS step, value AS loss FROM events WHERE event_id % 10 = 0 ORDER BY value, event_id LIMIT 1")
def best_step(spark, sf_dir):
    return training_log.best_step(log(spark, sf_dir))


@query("SELECT event_id AS step, value AS loss FROM events WHERE event_id % 10 <> 0 ORDER BY event_id DESC LIMIT 1")
def latest_point(spark, sf_dir):
    return training_log.latest(log(spark, sf_dir))


@query("SELECT step, round(m, 6) AS mean FROM (SELECT event_id * 7 AS step, avg(value) OVER (ORDER BY event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS m FROM events WHERE event_id % 10 <> 0) WHERE step % 50 = 0")
def trailing_loss_with_gaps(spark, sf_dir):
    """Steps seven apart, of which every tenth is a validation record."""
    metrics = log(spark, sf_dir).withColumn("step", F.col("step") * 7)
    return training_log.trailing_mean(metrics, every=50).select("step", F.round("mean", 6).alias("mean"))


@query("SELECT step, round(m, 6) AS mean FROM (SELECT event_id AS step, avg(value) OVER (ORDER BY event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS m FROM events) WHERE step % 100 = 0")
def trailing_loss(spark, sf_dir):
    return training_log.trailing_mean(log(spark, sf_dir).withColumn("kind", F.lit("train"))).select("step", F.round("mean", 6).alias("mean"))


@query("SELECT round(avg(value), 6) AS loss FROM events WHERE event_id % 10 = 0")
def mean_val_loss(spark, sf_dir):
    return training_log.mean_loss(training_log.of_kind(log(spark, sf_dir), "val")).select(F.round("loss", 6).alias("loss"))


@query("""WITH c AS (SELECT user_id, user_id % 50 AS grp, user_id // 50 AS beam, event_type AS token, count(*) AS n FROM events GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY user_id) AS logp FROM c),
    i AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY grp, beam ORDER BY logp DESC, token) <= 2), s AS (SELECT *, (logp - beam) / pow(4, 0.6) AS score FROM i)
    SELECT grp, beam, token, round(score, 9) AS score, CAST(row_number() OVER (PARTITION BY grp ORDER BY score DESC, beam, token) AS INTEGER) AS rank FROM s QUALIFY row_number() OVER (PARTITION BY grp ORDER BY score DESC, beam, token) <= 2""")
def beam_steps(spark, sf_dir):
    """Groups of users as the beams of one search; the share of an event type stands for its log-probability."""
    probs = token_probabilities(spark, sf_dir).select((F.col("user_id") % 50).alias("grp"), F.expr("user_id div 50").alias("beam"), "token", F.col("prob").alias("logp"))
    rows = probs.withColumn("total", -F.col("beam").cast("double")).withColumn("length", F.lit(3))
    return training_log.beam_step(rows, ["grp"], 2).select("grp", "beam", "token", F.round("score", 9).alias("score"), "rank")


@query("SELECT round(sum(value * (event_id % 2)) / (sum(event_id % 2) + 1e-9), 6) AS loss FROM events")
def masked_mean_loss(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("value", (F.col("event_id") % 2).alias("mask"))
    return training_log.masked_mean(rows, "value", "mask").select(F.round("loss", 6).alias("loss"))


@query("SELECT 'step_10000' AS name")
def newest_checkpoint(spark, sf_dir):
    return training_log.newest_checkpoint(spark.createDataFrame([("step_500",), ("step_10000",), ("step_9500",)], "name string"))


_COSINE = "round(CASE WHEN s < {w} THEN {p} * s / {w} WHEN s < {w} + {st} THEN {p} ELSE ({p} - {m}) * 0.5 * (1 + cos(pi() * least(s - {w} - {st}, {d}) / {d})) + {m} END, 9)"


@query("SELECT s AS step, " + _COSINE.format(w=2000, st=70708, d=4000, p="5e-4", m="5e-5") + " AS lr FROM range(0, 77000, 100) AS t(s)")
def lr_schedule(spark, sf_dir):
    return spark.range(0, 77000, 100).select(F.col("id").alias("step"), F.round(text.warmup_stable_cosine(F.col("id"), 5e-4, 5e-5, 2000, 70708, 4000), 9).alias("lr"))


@query("SELECT s AS step, " + _COSINE.format(w=200, st=0, d=9800, p="1e-4", m="1e-5") + " AS lr FROM range(0, 11000, 50) AS t(s)")
def finetune_lr_schedule(spark, sf_dir):
    return spark.range(0, 11000, 50).select(F.col("id").alias("step"), F.round(text.warmup_cosine(F.col("id"), 1e-4, 1e-5, 200, 10000), 9).alias("lr"))


def token_probabilities(spark, sf_dir) -> DataFrame:
    """The relative frequency of each event type of each user, as a distribution over tokens."""
    counts = table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("token")).agg(F.count("*").alias("n"))
    return counts.join(counts.groupBy("user_id").agg(F.sum("n").alias("all")), "user_id").select("user_id", "token", (F.col("n") / F.col("all")).alias("prob"))


_PROBS = "c AS (SELECT user_id, event_type AS token, count(*) AS n FROM events GROUP BY ALL), p AS (SELECT user_id, token, n, sum(n) OVER (PARTITION BY user_id) AS t FROM c)"


@query(f"WITH {_PROBS}, o AS (SELECT *, coalesce(sum(n / t) OVER (PARTITION BY user_id ORDER BY n DESC, token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p) SELECT user_id, token, round(n / CAST(sum(n) OVER (PARTITION BY user_id) AS BIGINT), 6) AS prob FROM o WHERE before < 0.777")
def nucleus_cut(spark, sf_dir):
    return training_log.nucleus(token_probabilities(spark, sf_dir), ["user_id"], 0.777).withColumn("prob", F.round("prob", 6))


@query(f"WITH {_PROBS} SELECT user_id, token FROM p QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, token) = 1")
def greedy_argmax(spark, sf_dir):
    return training_log.greedy(token_probabilities(spark, sf_dir), ["user_id"])
