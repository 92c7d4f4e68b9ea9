import random

import pytest
from pyspark.sql import functions as F

from quarry.llm import url_rules

RULES = [*url_rules.RULES, ("Deep.Site.NET", None, "block"), ("a.b.c.d.e.f.g.h.i.j", "/x", "block"), ("b.c.d.e.f.g.h.i.j", "", "allow"), ("long.io", "/" + "p" * 700, "block"), ("long.io", "/" + "p" * 600, "allow"), ("tie.io", "/a", "block"), ("tie.io", "/a", "allow"), ("", "/everywhere", "block")]


def plain(url, rules, words, otherwise="allow"):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    ends = [rest.find(c) for c in "/?#" if c in rest]
    host, tail = rest[: min(ends, default=len(rest))], rest[min(ends, default=len(rest)) :]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = []
    for h, p, v in rules:
        h, p = (h or "").lower(), p or ""
        if (h == "" or host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append((len(h + p), len(h), v, h + p))
    if fits:
        return host, path, max(fits)[3], max(fits)[2], None
    word = max([w for w in words if w in "".join(c if c.isascii() and c.isalnum() and not c.isupper() else " " for c in host).split()], key=lambda w: (len(w), w), default=None)
    return host, path, None, "block" if word else otherwise, word


URLS = [
    None, "", "no scheme", "://", "http://", "http://ORG", "http://org/", "http://example.org/es/1", "https://x.example.org/en/1864.html", "https://xexample.org/en/1", "http://é.COM/de/?q#f", "http://a.com?/fr/", "http://a.com#/de/", "http://a.com/fr/a?b://c.org/",
    "http://deep.site.net", "http://x.deep.site.net:80/", "http://x.deep.site.net/y", "http://z.a.b.c.d.e.f.g.h.i.j/xyz", "http://z.a.b.c.d.e.f.g.h.i.j/y", "http://long.io/" + "p" * 650, "http://long.io/" + "p" * 5000, "http://long.io/p", "http://tie.io/abc",
    "http://big-casino.net/", "http://casino.ads.net/", "http://casinos.net/", "http://q.net/everywhere/else", "http://.org/", "http://org./", "http://a..com/de/x", "ftp://u:p@h.com:21/de/x\ny", "http://" + "s." * 3000 + "com/de/1",
]


@pytest.fixture
def tables(spark):
    words = spark.createDataFrame([(w,) for w in url_rules.WORDS], "word string")
    return spark.createDataFrame(RULES, "host string, path string, verdict string"), words


@pytest.mark.parametrize("few", [True, False])
def test_urls_equal_the_definition(spark, tables, monkeypatch, few):
    if not few:
        monkeypatch.setattr(url_rules, "BROADCAST_RULES", 0)
    rng = random.Random(3)
    urls = URLS + ["http://" + ".".join(rng.choice(["example", "org", "com", "a", "ads"]) for _ in range(rng.randint(1, 4))) + rng.choice(["", "/", "/es/", "/en/1", "/fr/x", "/de"]) for _ in range(200)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict, r.word) for r in url_rules.judge(pages, *tables).collect()}
    assert [got[i] for i in range(len(urls))] == [plain(u, RULES, url_rules.WORDS) for u in urls]


def test_prefix_clashes_are_confirmed(spark, tables, monkeypatch):
    """With one hex digit nearly all candidates are wrong; none survives the full digest."""
    monkeypatch.setattr(url_rules, "PREFIX", 1)
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict, r.word) for r in url_rules.judge(pages, *tables).collect()}
    assert [got[i] for i in range(len(URLS))] == [plain(u, RULES, url_rules.WORDS) for u in URLS]


def test_odd_tables(spark, tables):
    rows = [(1, "http://a.org/"), (1, "http://a.org/"), (None, "http://a.org/"), (None, None), (2, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    for name in ("host", "path", "rule", "verdict", "labels", "k", "prefix", "n", "x"):
        pages = pages.withColumn(name, F.lit("clash"))
    rules, words = tables
    got = sorted(map(repr, url_rules.judge(pages, rules, words).collect()))
    assert len(got) == 5 and sum("rule='org/'" in x for x in got) == 3
    assert url_rules.judge(pages.limit(0), rules, words).count() == 0
    none = url_rules.judge(pages, rules.limit(0), otherwise="block").collect()
    assert len(none) == 5 and {(r.rule, r.verdict) for r in none} == {(None, "block")}
