"""URL filters: explicit rules, and for all other pages an empirical-Bayes reputation of the host.

Labelled outcomes of pages are counted by host. The rate of bad pages shrinks through beta-binomial priors: a suffix
towards the overall rate, a registered domain towards its suffix, a host towards its domain. How strong the priors are
comes from the data, by moments: the more hosts differ, the weaker. A host is blocked if even the lower bound of its
posterior rate is above the threshold. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import written

#: Suffixes below which anyone registers, beside single labels. By the country or the domain they stand under.
SUFFIXES = {
    "ar": "com edu gob net org", "au": "asn com edu gov id net org", "br": "blog com edu gov net org", "cn": "ac com edu gov net org", "es": "com edu gob nom org", "fr": "asso com gouv nom", "hk": "com edu gov net org", "il": "ac co gov net org",
    "in": "ac co edu firm gen gov ind net nic org res", "jp": "ac ad co ed go gr lg ne or", "kr": "ac co go ne or re", "mx": "com edu gob net org", "nz": "ac co geek gen govt net org school", "pl": "com edu gov net org", "sg": "com edu gov net org",
    "tr": "com edu gov net org", "tw": "com edu gov net org", "uk": "ac co gov ltd me net nhs org plc police sch", "za": "ac co edu gov net org",
    "com": "blogspot firebaseapp herokuapp wordpress", "io": "github gitlab readthedocs", "app": "netlify vercel web", "dev": "pages workers", "net": "azurewebsites cloudfront",
}
#: A star stands for any label, and an exclamation mark takes a name out of such a rule.
WIDE_SUFFIXES = ("*.ck", "!www.ck", "*.er", "*.fk", "*.kh", "*.mm", "*.np", "*.pg")
#: The rules of the registered query.
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "block"), ("example.net/de/8", "block"), ("org/es/", "block"))
Z, THRESHOLD = 1.645, 0.5
WEAKEST, STRONGEST = 1.0, 1000.0


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?`` or ``#``, with A-Z in lower case; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_rules() -> list[str]:
    return sorted([f"{name}.{top}" for top, names in SUFFIXES.items() for name in names.split()] + list(WIDE_SUFFIXES))


def suffix_table(spark: SparkSession) -> DataFrame:
    """``rule``: the suffixes of this module; pass a whole list of public suffixes in its place where there is one."""
    return spark.createDataFrame([(r,) for r in suffix_rules()], "rule string")


def ends(hosts: DataFrame, names: DataFrame, name: str) -> DataFrame:
    """``host, <name>``: the ends of each host that have as many labels as any of ``names`` has.

    A host of many labels gives no more ends than there are such numbers, and short ones: all its ends together would
    grow with the square of its length. A host without a fitting number has no row.
    """
    labels = lambda c: F.length(c) - F.length(F.replace(c, F.lit("."))) + 1
    # One row, of as many numbers as the names differ in.
    depths = names.agg(F.array_sort(F.collect_set(labels(F.col(name)))).alias("depths"))
    sized = hosts.select("host", labels(F.col("host")).alias("n")).join(F.broadcast(depths), F.lit(True))
    cut = F.expr("transform(filter(depths, d -> d <= n), d -> substring_index(host, '.', -d))")
    return sized.select("host", F.explode(cut).alias(name))


def registered(hosts: DataFrame, suffixes: DataFrame) -> DataFrame:
    """``host, suffix, domain`` of distinct hosts: the registered domain has one label more than its public suffix.

    Rules are names (``co.uk``), names below any label (``*.ck``) and exceptions from these (``!www.ck``, whose suffix is one
    label shorter). An exception wins, else the longest suffix; without a rule the last label is the suffix. The ends of a
    host meet the rules by equality, so the list may be of any length.
    """
    labels = lambda c: F.size(F.split(c, "[.]"))
    exact = suffixes.select(F.regexp_replace("rule", r"^(!|[*][.])", "").alias("tail"), F.col("rule").startswith("!").alias("out"), F.col("rule").startswith("*.").alias("wide"))
    spans = exact.select("tail", "out", (labels("tail") + F.when(F.col("out"), -1).when(F.col("wide"), 1).otherwise(0)).alias("span"))
    best = spans.groupBy("tail").agg(F.max(F.struct("out", "span")).alias("s"))
    # A star needs a label to stand for.
    met = ends(hosts, best, "tail").join(best, "tail").where(F.col("s.span") <= labels("host")).groupBy("host").agg(F.max("s").alias("s"))
    span = F.greatest(F.lit(1), F.coalesce("s.span", F.lit(1)))
    cut = lambda n: F.call_function("substring_index", F.col("host"), F.lit("."), -n)
    return hosts.select("host").join(met, "host", "left").select("host", cut(span).alias("suffix"), cut(span + 1).alias("domain"))


def reputations(outcomes: DataFrame, suffixes: DataFrame) -> DataFrame:
    """``host, n_labelled, bound`` from distinct hosts ``host, n, k`` (labelled pages, and the bad ones among them).

    Hosts without labelled pages (n = 0) get what their domain suggests. ``bound`` is the lower bound of the bad rate.
    """
    hosts = written(outcomes.join(registered(outcomes, suffixes), "host").select("host", "domain", "suffix", "n", "k"))
    # One row, of sums over hosts.
    total = hosts.where("n > 0").agg(F.sum("n").alias("n_all"), F.sum("k").alias("k_all"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.count("*").alias("g"), F.sum(F.expr("k * k / n")).alias("kkn"))
    rate = "CASE WHEN n_all > 0 THEN k_all / n_all ELSE 0D END"
    spread = "(kkn - k_all * p - (g - 1) * p * (1 - p)) / (n_all - nn / n_all)"
    prior = total.selectExpr("*", f"{rate} AS p").selectExpr("p", f"CASE WHEN g > 1 AND n_all - nn / n_all > 0 THEN {spread} END AS between")
    prior = prior.selectExpr("p", f"CASE WHEN between > 0 THEN greatest({WEAKEST}D, least({STRONGEST}D, p * (1 - p) / between - 1)) ELSE {STRONGEST}D END AS m")
    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).join(F.broadcast(prior), F.lit(True)).selectExpr("suffix", "m", "(k + m * p) / (n + m) AS suffix_rate")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).join(suffixes, "suffix").selectExpr("domain", "m", "(k + m * suffix_rate) / (n + m) AS domain_rate")
    posterior = hosts.join(domains, "domain").selectExpr("host", "n", "k + m * domain_rate AS a", "n - k + m * (1 - domain_rate) AS b")
    return posterior.selectExpr("host", "n AS n_labelled", f"a / (a + b) - {Z}D * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS bound")


def fitting_rules(parsed: DataFrame, hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """``host, path, rule, verdict``: the longest rule of each host and path that any rule fits.

    A path is cut at the lengths that the rules of the host's parents have, and its beginnings meet the rules by
    equality, so a page never meets rules that don't fit, however many a parent has.
    """
    split = rules.select("rule", "verdict", F.substring_index("rule", "/", 1).alias("parent"), F.regexp_extract("rule", r"(?s)^[^/]*(.*)", 1).alias("start"))
    # A parent has no more lengths than a path has characters.
    lengths = split.groupBy("parent").agg(F.array_sort(F.collect_set(F.length("start"))).alias("cuts"))
    tries = ends(hosts, lengths, "parent").join(lengths, "parent").select("host", "parent", F.explode("cuts").alias("cut"))
    met = parsed.select("host", "path").distinct().join(tries, "host").where(F.length("path") >= F.col("cut"))
    found = met.select("host", "path", "parent", F.expr("substring(path, 1, cut)").alias("start")).join(split, ["parent", "start"])
    best = found.groupBy("host", "path").agg(F.min(F.struct((-F.length("rule")).alias("order"), "rule", "verdict")).alias("r"))
    return best.select("host", "path", F.struct("r.rule", "r.verdict").alias("r"))


def filter_urls(pages: DataFrame, labels: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", suffixes: DataFrame | None = None) -> DataFrame:
    """``key, host, path, rule, verdict, n_labelled`` for every row of ``pages``; ``suffixes`` as in ``registered``.

    The longest rule that fits decides (of equal rules, the first by verdict); else the host's reputation. ``labels`` has
    ``key`` and ``bad`` (0 or 1, null: no label); several labels of a key count as bad if one is. A null or relative url
    has an empty host and path, and all of these share one reputation. Repeated rows count repeatedly. Without labels
    every host is allowed. Urls of any length are read whole. An empty table gives no rows. Other columns are not read.
    """
    parsed = pages.select(F.col(key).alias("key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    outcomes = written(labels.where(F.col("bad").isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max("bad").alias("bad")))
    judged = parsed.select("key", "host").join(outcomes, "key", "left")
    hosts = written(judged.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("k")))
    known = written(reputations(hosts, suffix_table(pages.sparkSession) if suffixes is None else suffixes))
    ruled = fitting_rules(parsed, hosts, rules)
    named = parsed.join(known, "host").join(ruled, ["host", "path"], "left")
    verdict = F.coalesce(F.col("r.verdict"), F.when(F.col("bound") > THRESHOLD, "block").otherwise("allow"))
    return named.select(F.col("key").alias(key), "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), "n_labelled")


def op7(spark, sf_dir: str) -> DataFrame:
    """The labels are those with the page's number; a page is bad if it is toxic or of low quality."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").selectExpr("doc_id AS page_id", "CAST(toxic = 1 OR quality = 0 AS int) AS bad")
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), labels, spark.createDataFrame(list(RULES), "rule string, verdict string"))


ORACLE = f"""
    WITH p AS (
        SELECT page_id,
            translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
    ), l AS (SELECT doc_id AS page_id, max(CAST(toxic = 1 OR quality = 0 AS INTEGER)) AS bad FROM labels GROUP BY doc_id),
    rules(rule) AS (VALUES {", ".join(f"('{r}')" for r in suffix_rules())}),
    tails AS (SELECT host, string_split(host, '.') AS parts, unnest(range(1, len(string_split(host, '.')) + 1)) AS i FROM (SELECT DISTINCT host FROM p)),
    ends AS (SELECT host, parts, i, array_to_string(parts[-i:], '.') AS tail FROM tails),
    spans AS (
        SELECT host, any_value(parts) AS parts, max(CASE WHEN rule = tail THEN i WHEN rule = '*.' || tail AND len(parts) > i THEN i + 1 END) AS span2,
            max(i - 1) FILTER (rule = '!' || tail) AS out
        FROM ends LEFT JOIN rules ON rule IN (tail, '!' || tail, '*.' || tail) GROUP BY host
    ),
    sized AS (SELECT host, parts, coalesce(out, span2, 1) AS span FROM spans),
    h AS (
        SELECT host, array_to_string(parts[-(span + 1):], '.') AS domain, array_to_string(parts[-span:], '.') AS suffix, count(bad) AS n, coalesce(CAST(sum(bad) AS BIGINT), 0) AS k
        FROM p JOIN sized USING (host) LEFT JOIN l USING (page_id) GROUP BY ALL
    ), t AS (SELECT sum(n) AS n_all, sum(k) AS k_all, sum(n * n) AS nn, count(*) AS g, sum(k * k / n) AS kkn FROM h WHERE n > 0),
    q AS (SELECT *, CASE WHEN n_all > 0 THEN k_all / n_all ELSE 0 END AS p FROM t),
    b AS (SELECT p, CASE WHEN g > 1 AND n_all - nn / n_all > 0 THEN (kkn - k_all * p - (g - 1) * p * (1 - p)) / (n_all - nn / n_all) END AS between_hosts FROM q),
    m AS (SELECT p, CASE WHEN between_hosts > 0 THEN greatest({WEAKEST}, least({STRONGEST}, p * (1 - p) / between_hosts - 1)) ELSE {STRONGEST} END AS m FROM b),
    s AS (SELECT suffix, any_value(m) AS m, (sum(k) + any_value(m) * any_value(p)) / (sum(n) + any_value(m)) AS rate FROM h, m GROUP BY suffix),
    d AS (SELECT h.domain, any_value(s.m) AS m, (sum(h.k) + any_value(s.m) * any_value(s.rate)) / (sum(h.n) + any_value(s.m)) AS rate FROM h JOIN s USING (suffix) GROUP BY h.domain, h.suffix),
    ab AS (SELECT h.host, h.n, h.k + d.m * d.rate AS a, h.n - h.k + d.m * (1 - d.rate) AS b FROM h JOIN d USING (domain)),
    r AS (SELECT *, split_part(rule, '/', 1) AS parent, substr(rule, strpos(rule, '/')) AS start FROM (VALUES {", ".join(f"('{r}', '{v}')" for r, v in RULES)}) AS x(rule, action)),
    c AS (
        SELECT p.*, r.rule, r.action, ab.n AS n_labelled, ab.a / (ab.a + ab.b) - {Z} * sqrt(ab.a * ab.b / ((ab.a + ab.b) * (ab.a + ab.b) * (ab.a + ab.b + 1))) AS bound
        FROM p JOIN ab ON ab.host = p.host LEFT JOIN r ON (p.host = r.parent OR ends_with(p.host, '.' || r.parent)) AND starts_with(p.path, r.start)
        QUALIFY row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rule) DESC NULLS LAST) = 1
    )
    SELECT page_id, host, path, rule, coalesce(action, CASE WHEN bound > {THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict, n_labelled FROM c
"""
