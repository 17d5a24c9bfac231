import re

import pytest
from oracle import assert_same

from corpusmill.llm import url_filter as U


def judge(spark, urls, labels=(), rules=U.RULES):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    table = spark.createDataFrame(list(labels), "page_id long, bad int")
    return {r.page_id: r for r in U.filter_urls(pages, table, spark.createDataFrame(list(rules), "rule string, verdict string")).collect()}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_is_the_sql(spark, sf):
    assert_same(U.op7(spark, f"/root/testdata/{sf}"), U.ORACLE, f"/root/testdata/{sf}")


CASES = [
    ("https://A.Example.COM/en/7x?q#f", "a.example.com", "/en/7x", "example.com/en/7", "allow"),
    ("http://example.com/en/1", "example.com", "/en/1", "com/en/", "block"),
    ("http://com/en/", "com", "/en/", "com/en/", "block"),
    ("http://notcom/en/", "notcom", "/en/", None, "allow"),
    ("http://m.example.net/de/8", "m.example.net", "/de/8", "example.net/de/8", "block"),
    ("http://x.net/de", "x.net", "/de", None, "allow"),
    ("http://x.org/es/?a", "x.org", "/es/", "org/es/", "block"),
    ("//x.org/es/", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("http://", "", "", None, "allow"),
    ("a://b://c/d", "b:", "//c/d", None, "allow"),
    ("http://h?x/en/", "h", "", None, "allow"),
    ("http://\n.com/en/\nz", "\n.com", "/en/\nz", "com/en/", "block"),
]


def test_hosts_paths_and_rules(spark):
    got = judge(spark, [c[0] for c in CASES])
    for i, (_, host, path, rule, verdict) in enumerate(CASES):
        r = got[i]
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict)


def test_reputation_shrinks(spark):
    # Two bad pages of two say less than sixty of sixty; a host of a bad domain without labels follows the domain.
    urls = ["http://bad.evil.com/"] * 60 + ["http://few.fine.com/"] * 2 + ["http://good.fine.com/"] * 60 + ["http://new.evil.com/", "http://rule.evil.com/ok/"]
    labels = [(i, 1) for i in range(62)] + [(i, 0) for i in range(62, 122)] + [(5, 0), (6, None)]
    got = judge(spark, urls, labels, (("evil.com/ok/", "allow"),))
    assert got[0].verdict == "block" and got[60].verdict == "allow" and got[62].verdict == "allow"
    assert got[0].n_labelled == 60 and got[122].n_labelled == 0 and got[123].verdict == "allow"
    assert got[122].host == "new.evil.com"


def test_suffixes(spark):
    want = {
        "a.b.co.uk": ("co.uk", "b.co.uk"), "co.uk": ("co.uk", "co.uk"), "x.com": ("com", "x.com"), "com": ("com", "com"), "": ("", ""), "a.b.c.d": ("d", "c.d"), "me.github.io": ("github.io", "me.github.io"), "a.me.github.io": ("github.io", "me.github.io"),
        "shop.id.au": ("id.au", "shop.id.au"), "ck": ("ck", "ck"), "any.ck": ("any.ck", "any.ck"), "a.any.ck": ("any.ck", "a.any.ck"), "b.a.any.ck": ("any.ck", "a.any.ck"), "www.ck": ("ck", "www.ck"), "m.www.ck": ("ck", "www.ck"),
    }
    hosts = spark.createDataFrame([(h,) for h in want], "host string")
    assert {r.host: (r.suffix, r.domain) for r in U.registered(hosts, U.suffix_table(spark)).collect()} == want
    own = spark.createDataFrame([("b.c.d",), ("*.com",), ("!x.com",), ("c.d",)], "rule string")
    got = {r.host: r.suffix for r in U.registered(hosts, own).collect()}
    assert got["a.b.c.d"] == "b.c.d" and got["x.com"] == "com" and got["a.b.co.uk"] == "uk"


def test_strangers_under_one_suffix_share_no_reputation(spark):
    urls = ["http://bad.github.io/"] * 60 + ["http://a.github.io/"] * 20 + ["http://b.github.io/"] * 20 + ["http://bad.own.com/"] * 60 + ["http://new.own.com/", "http://new.github.io/"]
    labels = [(i, 1) for i in range(60)] + [(i, 0) for i in range(60, 100)] + [(i, 1) for i in range(100, 160)]
    got = judge(spark, urls, labels)
    assert got[0].verdict == got[100].verdict == got[160].verdict == "block"
    assert got[60].verdict == got[161].verdict == "allow"


def test_very_long_urls_and_other_columns(spark):
    url = "http://" + "a." * 30_000 + "com/en/" + "x" * 100_000
    pages = spark.createDataFrame([(1, url, "r", 2, 3)], "page_id long, url string, rule string, verdict int, bad int")
    row = U.filter_urls(pages, spark.createDataFrame([], "page_id long, bad int"), spark.createDataFrame(list(U.RULES), "rule string, verdict string")).first()
    assert (row.rule, row.verdict, len(row.path)) == ("com/en/", "block", 100_004)


def test_hosts_of_very_many_labels(spark):
    # All ends of such a host are 40 GB.
    pages = spark.createDataFrame([(1, "http://" + "a." * 200_000 + "example.com/en/7"), (2, "http://" + "." * 300_000 + "net/de/"), (3, "http://x.net/en/")], "page_id long, url string")
    got = U.filter_urls(pages, spark.createDataFrame([], "page_id long, bad int"), spark.createDataFrame(list(U.RULES), "rule string, verdict string")).collect()
    assert {r.page_id: (r.rule, r.verdict) for r in got} == {1: ("example.com/en/7", "allow"), 2: ("net/de/", "block"), 3: (None, "allow")}


def by_the_contract(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.split("[/?#]", rest)[0]
    path = re.split("[?#]", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(r, v) for r, v in U.RULES if f".{host}".endswith("." + r.split("/")[0]) and path.startswith(r[r.index("/") :])]
    return (host, path, *max(fits, key=lambda x: len(x[0]), default=(None, None)))


def test_odd_urls_against_the_contract(spark):
    """All rules on odd hosts and paths, every page labelled so that its host's reputation is against the rules that allow."""
    hosts = ["com", "COM", "a.com", "example.com", "Shop.Example.COM", "a.b.example.net", "example.net", "net", "..net", "x.org", "notcom", "com.", "example.com:80", "u@example.com", "\u2028.com", "bücher.com", "İ.com", "\u212a.net", "😀.org", ""]
    paths = ["", "/", "/en", "/en/", "/en/7", "/en/70?x", "/EN/7", "/de/", "/de/8", "/de/80#y", "/es/", "//es/", "/%65s/", "?/en/7", "#/en/7", "/en/\n7"]
    urls = [None, "", "com/en/"] + [s + h + p for s in ("http://", "HTTPS://", "\n://", "://", "//") for h in hosts for p in paths]
    got = judge(spark, urls, [(i, 1) for i in range(len(urls))])
    assert len(got) == len(urls)
    for i, url in enumerate(urls):
        host, path, rule, verdict = by_the_contract(url)
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict or "block"), url


def test_repeated_rows_and_empty(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")] * 3 + [(None, "http://a.com/")], "page_id long, url string")
    none, rules = spark.createDataFrame([], "page_id long, bad int"), spark.createDataFrame([], "rule string, verdict string")
    assert U.filter_urls(pages, none, rules).count() == 4
    assert U.filter_urls(pages.limit(0), none, rules).count() == 0


def test_no_python_in_the_plan(spark, tiny):
    plan = U.op7(spark, tiny)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
