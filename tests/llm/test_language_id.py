import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusmill.llm import language_id as L


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return L.fit(docs.where("doc_id % 2 = 0"))


def ident(spark, model, rows):
    df = spark.createDataFrame(rows, "id long, text string, declared string, host string")
    return {r.id: r for r in L.identify(df, model, F.col("text"), F.col("declared"), F.col("host"), "id").collect()}


def test_held_out_accuracy(docs, model):
    held = docs.where("doc_id % 2 = 1")
    got = L.identify(held.withColumnRenamed("lang", "label"), model, F.col("text"), F.lit(None).cast("string"), F.lit(""), "doc_id").join(held.select("doc_id", F.col("lang").alias("label")), "doc_id")
    assert got.where("lang = label").count() / got.count() > 0.98


def test_clean_documents_stay(docs, model):
    kept = L.keep_known(docs, model)
    assert kept.columns == docs.columns and kept.count() >= 0.99 * docs.count()


def test_rejects_what_is_no_language(spark, docs, model):
    rows = [(1, "", "en", "s", 0), (2, None, "en", "s", 0), (3, "1234 %% $$ 99", "en", "s", 0), (4, "zq xvk qqw zxj kqv wvz qxz jjq vkk zzx " * 20, "en", "s", 0), (None, "", "en", "s", 0)]
    df = spark.createDataFrame(rows, docs.schema).unionByName(docs.where("doc_id < 5 AND doc_id > 4"))
    assert [r.doc_id for r in L.keep_known(df, model).collect()] == [None]


def test_hints_decide_short_texts(spark, model):
    rows = [(i, "in", None, "plain.org") for i in range(3)] + [(10, "", "fr-FR", "a.com"), (11, "", None, "x.de"), (12, "", "xx", ""), (13, None, None, None)]
    got = ident(spark, model, rows)
    assert got[10].lang == "fr" and got[10].declared == "fr" and got[11].lang == "de" and got[10].posterior > got[13].posterior
    assert got[13].trigrams == 0


def test_host_prior_pulls_unclear_texts(spark, docs, model):
    german = [r.text for r in docs.where("lang = 'de'").orderBy("doc_id").limit(30).collect()]
    got = ident(spark, model, [(i, t, None, "www.site.com") for i, t in enumerate(german)] + [(100, "", None, "www.site.com"), (101, "", None, "other.site.com"), (102, "", None, "else.org")])
    assert got[100].lang == "de" and got[101].lang == "de"
    assert got[100].posterior > got[101].posterior > got[102].posterior


def test_rows_and_empty(spark, model):
    df = spark.createDataFrame([(1, "und der die", "de", "h")] * 3, "id long, text string, lang string, evidence string")
    assert L.identify(df, model, F.col("text"), F.col("lang"), F.lit("h"), "id").count() == 3
    assert L.identify(df.limit(0), model, F.col("text"), F.col("lang"), F.lit("h"), "id").count() == 0
    long = ident(spark, model, [(1, "the and of " * 200_000, None, "")])
    assert long[1].lang == "en"


def test_visible_text(spark):
    html = '<html lang="fr"><script>var t="</p>";</script><style>p{}</style><!-- x --><p class="a">Bon&eacute;jour</p></html>'
    row = spark.createDataFrame([(html,)], "h string").select(L.visible_text(F.col("h")).alias("t")).first()
    assert row.t.split() == ["Bon", "jour"]


def test_query(spark, tiny):
    rows = L.op6(spark, tiny).collect()
    assert len(rows) == spark.read.parquet(f"{tiny}/pages.parquet").count()
    assert sum(r.lang == r.declared for r in rows) >= 0.9 * len(rows)  # the declared language is right on these pages


#: The first article of the declaration of human rights in languages that the model doesn't know.
FOREIGN = (
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
    "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.",
    "人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心,并应以兄弟关系的精神相对待。",
    "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler.",
    "Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek, ésszel és lelkiismerettel bírván.",
)


#: Sentences as people write them, which the model's invented prose has none of.
NATURAL = {
    "en": ("The quick brown fox jumps over the lazy dog while engineers debug the compiler output.", "She walked to the market and bought some fresh bread before the rain began to fall.", "Scientists have discovered that the ancient river changed its course several times."),
    "de": ("Die Regierung hat gestern beschlossen, die Steuern im nächsten Jahr zu senken.", "Am Wochenende fahren wir mit dem Zug nach München und besuchen unsere Freunde.", "Der alte Mann saß auf der Bank und fütterte die Vögel mit trockenem Brot."),
    "fr": ("Le gouvernement a annoncé hier une nouvelle réforme des retraites pour les fonctionnaires.", "Nous sommes allés à la plage hier soir pour regarder le coucher du soleil.", "Les enfants jouent dans le jardin pendant que leurs parents préparent le dîner."),
    "es": ("El gobierno anunció ayer una nueva reforma de las pensiones para los trabajadores.", "Mañana iremos a la playa con nuestros amigos si el tiempo lo permite.", "La niña compró un libro de cuentos en la librería del centro de la ciudad."),
}


def test_natural_sentences_stay(spark, model):
    rows = [(10 * k + i, t, None, f"h{k}{i}") for k, ts in enumerate(NATURAL.values()) for i, t in enumerate(ts)]
    got = ident(spark, model, rows)
    assert {i: got[i].lang for i in got} == {10 * k + i: lang for k, (lang, ts) in enumerate(NATURAL.items()) for i in range(len(ts))}
    docs = spark.createDataFrame([(i, t, got[i].lang, "s", 0) for i, t, _, _ in rows], "doc_id long, text string, lang string, source string, n_chars int")
    assert L.keep_known(docs, model).count() == len(rows)


def test_other_languages_are_unknown(spark, docs, model):
    got = ident(spark, model, [(i, t, None, f"h{i}") for i, t in enumerate(FOREIGN)])
    assert [got[i].lang for i in range(len(FOREIGN))] == ["und"] * len(FOREIGN)
    held = docs.where("doc_id % 2 = 1").select(F.col("doc_id").alias("id"), F.substring("text", 1, 120).alias("text"), F.lit(None).cast("string").alias("declared"), F.concat(F.lit("s"), "doc_id").alias("host"))
    short = L.identify(held.where("length(text) >= 40"), model, F.col("text"), F.col("declared"), F.col("host"), "id")
    assert short.where("lang = 'und'").count() <= 0.01 * short.count()


def test_any_number_of_labels_and_none(spark):
    rows = [(None, "aaa bbb ccc", "a")] * 500 + [(i, f"ddd eee f{i}", "b") for i in range(50)] + [(1000 + i, f"x{chr(97 + i % 26)}{i} y", f"odd{i:03d}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit(df)
    assert model.languages == ["a", "b", *[f"odd{i:03d}" for i in range(300)]]
    got = L.identify(df.where("doc_id = 5"), model, F.col("text"), F.lit(None).cast("string"), F.lit("h"), "doc_id").first()
    assert got.lang == "b"
    assert L.fit(df.limit(0)).languages == []
    none = L.identify(df.limit(3), L.fit(df.limit(0)), F.col("text"), F.col("lang"), F.lit("h"), "doc_id").collect()
    assert [r.lang for r in none] == ["und"] * 3


def test_the_sample_is_bounded(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), "id").alias("text"), F.lit("a").alias("lang"))
    model = L.fit(df, rows=200)
    grams = len(model.lang)
    assert 0 < grams < 200 * 8


def test_pieces_of_long_texts(monkeypatch):
    text = "the cat sat on the mat, and then it ate. ".encode() * 50
    want = L.trigrams([L.padded(text)])[1]
    monkeypatch.setattr(L, "PIECE", 100)
    found = [c for _, held in L.pieces([text]) for c in L.trigrams(held)[1] if c >= 0]
    assert found == [c for c in want if c >= 0]


def test_chance_against_drawn_letters():
    rng = random.Random(4)
    text = " ".join("".join(rng.choice("abcdeeeiou") for _ in range(rng.randint(1, 6))) for _ in range(60))
    codes = L.trigrams([L.padded(text.encode())])
    letters = [0] * 256
    for b in codes[0]:
        letters[b] += 1
    import numpy as np

    seen = np.zeros(L.CELLS, bool)
    seen[codes[1][codes[1] >= 0]] = True
    drawn = L.trigrams([bytes(rng.choices(range(256), letters, k=60_000))])[1]
    assert abs(L.drawn_cells(np.array(letters, float))[seen].sum() - seen[drawn[drawn >= 0]].mean()) < 0.02


def test_ties_and_any_columns(spark):
    model = L.fit(spark.createDataFrame([(1, "abc abc", "xx"), (2, "abc abc", "yy")], "doc_id long, text string, lang string"))
    df = spark.createDataFrame([(1, "abc", "s", "p", "q", "r", "t", None)], "doc_id long, text string, source string, prior string, evidence string, host string, _no_language string, lang string")
    got = L.identify(df, model, F.col("text"), F.col("lang"), F.col("source"), "doc_id").first()
    assert got.lang == "xx"
    assert L.keep_known(df, model).first().asDict() == df.first().asDict()


def test_against_brute_force(spark):
    """All of the method by loops: counts, likelihoods, hints, priors by levels, posterior."""
    rng = random.Random(1)
    sounds = {"de": "sch ung ein und ber", "en": "the ing and wh oo", "fr": "eau que les ou ai"}
    say = lambda lang, n: " ".join("".join(rng.choice(sounds[lang].split()) for _ in range(rng.randrange(1, 3))) for _ in range(n))
    train = [(i, say(lang, 30), lang) for i, lang in enumerate(["de", "en", "fr"] * 6)]
    hosts = ["a.x.de", "b.x.de", "y.co.uk", "y.com", "z.com", ""]
    rows = [(i, rng.choice([say(rng.choice("de en fr".split()), rng.randrange(1, 6)), "", None, "zq xw qk", "12"]), rng.choice([None, "de-AT", "FR", "zz"]), rng.choice(hosts)) for i in range(60)]
    got = ident(spark, L.fit(spark.createDataFrame(train, "doc_id long, text string, lang string")), rows)

    def grams(text):
        data = [b + 32 if 65 <= b <= 90 else 32 if b < 128 and not chr(b).isalpha() else b for b in b" " + (text or "").encode() + b"  "]
        return [((a * 961 + b) * 961 + c) * 2654435761 % 2**32 >> 16 for a, b, c in zip(data, data[1:], data[2:], strict=False) if not (a == b == 32)]

    langs, every = ["de", "en", "fr"], ["de", "en", "fr", "und"]
    counts = {lang: Counter(g for _, t, x in train if x == lang for g in grams(t)) for lang in langs}
    total = sum(sum(c.values()) for c in counts.values())

    def p(lang, g):
        base = (sum(c[g] for c in counts.values()) + 0.01) / (total + 0.01 * 65536)
        return (counts[lang][g] + 300 * base) / (sum(counts[lang].values()) + 300)

    letters = Counter(b for _, t, _ in train for b in b" " + t.lower().encode() + b"  ")
    drawn = {x: letters[x[0]] * letters[x[1]] * letters[x[2]] for x in itertools.product(letters, repeat=3) if not x[0] == x[1] == 32}
    known = lambda lang: sum(w for (a, b, c), w in drawn.items() if ((a * 961 + b) * 961 + c) * 2654435761 % 2**32 >> 16 in counts[lang])
    chance = max(map(known, langs)) / sum(drawn.values())

    def hint(value, right):
        return [math.log(right if x == value else (1 - right) / 2) for x in langs] + [-math.log(3)] if value in langs else [0.0] * 4

    def evidence(text, declared, host):
        gs = grams(text)
        sums = [sum(math.log(p(x, g)) for g in gs) for x in langs]
        best = langs[sums.index(max(sums))]
        share = min(1 - 1e-9, max(1e-9, sum(g in counts[best] for g in gs) / max(1, len(gs))))
        apart = share * math.log(share / chance) + (1 - share) * math.log((1 - share) / (1 - chance))
        none = max(sums) - len(gs) * (apart if share > chance else -apart)
        country = L.COUNTRY_LANGUAGE.get(host.split(".")[-1])
        return [s / 3 + a + b for s, a, b in zip([*sums, none], hint((declared or "")[:2].lower(), 0.9), hint(country, 0.8), strict=True)]

    suffix = lambda h: "co.uk" if h.endswith("co.uk") else h.split(".")[-1]
    domain = lambda h: ".".join(h.split(".")[-(suffix(h).count(".") + 2) :])
    facts = {i: evidence(t, d, h) for i, t, d, h in rows}
    guess = {i: e.index(max(e)) for i, e in facts.items()}

    def tally(same):
        return [sum(guess[i] == k and same(h) for i, _, _, h in rows) for k in range(4)]

    def toward(n, parent):
        return [(x + 5 * q) / (sum(n) + 5) for x, q in zip(n, parent, strict=True)]

    top = tally(lambda h: True)
    top = [(x + 1) / (sum(top) + 4) for x in top]
    for i, _, _, h in rows:
        prior = toward(tally(lambda x: x == h), toward(tally(lambda x: domain(x) == domain(h)), toward(tally(lambda x: suffix(x) == suffix(h)), top)))
        logs = [e + math.log(q) for e, q in zip(facts[i], prior, strict=True)]
        assert got[i].lang == every[logs.index(max(logs))]
        assert abs(got[i].posterior - 1 / sum(math.exp(x - max(logs)) for x in logs)) < 1e-9
