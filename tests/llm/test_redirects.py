"""Canonical links and refresh redirects as raw pages write them."""

from __future__ import annotations

import random
import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pytest

from lakewright.llm import url_filter as uf

PAGE = "http://x.com/a/b?q=1"
CASES = [
    ('<link rel=canonical href="/de/1">', ["http://x.com/de/1"]),
    ('<link rel="alternate canonical" href="//x.com/de/1"/>', ["http://x.com/de/1"]),
    ("<LINK HREF='c?x=1&amp;y=2' REL='canonical'>", ["http://x.com/a/c?x=1&y=2"]),
    ('<meta http-equiv="refresh" content="0; url=/new">', ["http://x.com/new"]),
    ("<meta content=\"5;URL='../up/./z'\" http-equiv=refresh>", ["http://x.com/up/z"]),
    ("<meta http-equiv=refresh content=0;url=http://y.org/1>", ["http://y.org/1"]),
    ('<meta http-equiv="refresh" content="0; url=&quot;/q&quot;">', ["http://x.com/q"]),
    ('<link rel="canonical" href="&#x2F;de&#47;&#228;&amp;lt;">', ["http://x.com/de/ä&lt;"]),
    ('<link rel=canonical href=/1><link rel=canonical href="http://z.com/2"><meta http-equiv=refresh content="0;url=/3"><meta http-equiv=refresh content="9;url=/4">',
     ["http://x.com/1", "http://z.com/2", "http://x.com/3", "http://x.com/4"]),
    ('<base href="/root/"><link rel=canonical href="c">', ["http://x.com/root/c"]),
    ('<link rel=canonical href="?p=2">', ["http://x.com/a/b?p=2"]),
    ('<link rel=canonical href="/r?u=http://w.com/de/1">', ["http://x.com/r?u=http://w.com/de/1"]),
    ('<link rel=canonical href="#top"><link rel=canonical href="">', []),
    ('<link rel="stylesheet" href="/s.css"><link rel=noncanonical href=/n><a href="/a">', []),
    ('<link rel=canonical href="mailto:a@b.c">', []),
    ("", []),
    (None, []),
]


def test_links_of_raw_pages(spark):
    rows = spark.createDataFrame([(f"{PAGE}&n={n}", html) for n, (html, _) in enumerate(CASES)], "url string, html string")
    got = {}
    for r in uf.page_links(rows).collect():
        got.setdefault(int(r.url.rpartition("=")[2]), []).append(r.target)
    assert {n: sorted(v) for n, v in got.items()} == {n: sorted(v) for n, (_, v) in enumerate(CASES) if v}


@pytest.mark.parametrize("href", ["/de/1", "//x.com/de/1", "../de/1", "/de&#47;1"])
def test_block_reaches_relative_aliases(spark, href):
    rows = [(1, "http://x.com/de/1", None), (2, "http://x.com/p/q", f'<link rel=stylesheet href=/s><link rel="alternate canonical" href="{href}">')]
    out = uf.redirect_equivalence(spark.createDataFrame(rows, "page_id long, url string, html string"), rules=[("x.com/de/", "block")])
    assert {r.page_id: (r.verdict, r.by_alias) for r in out.collect()} == {1: ("block", False), 2: ("block", True)}


HIDDEN = [
    ('<!-- <link rel=canonical href="/de/1"> --><link rel=canonical href="/ok">', ["http://x.com/ok"]),
    ('<script>document.write(\'<link rel=canonical href="/de/1">\')</script><link rel=canonical href="/ok">', ["http://x.com/ok"]),
    ('<style>/* <meta http-equiv=refresh content="0;url=/de/1"> */</style>', []),
    ('<title><link rel=canonical href="/de/1"></title><noscript><meta http-equiv=refresh content="0;url=/plain"></noscript>', ["http://x.com/plain"]),
    ('<link rel=canonical href="/ok"><!-- never closed <link rel=canonical href="/de/1">', ["http://x.com/ok"]),
]


def test_what_is_no_markup_holds_no_links(spark):
    rows = spark.createDataFrame([(f"{PAGE}&n={n}", html) for n, (html, _) in enumerate(HIDDEN)], "url string, html string")
    got = {}
    for r in uf.page_links(rows).collect():
        got.setdefault(int(r.url.rpartition("=")[2]), []).append(r.target)
    assert got == {n: v for n, (_, v) in enumerate(HIDDEN) if v}


class Links(HTMLParser):
    """Canonical links and refresh redirects as a real parser finds them."""

    def __init__(self, html):
        super().__init__()
        self.base, self.targets = None, []
        self.feed(html)

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "base" and self.base is None and a.get("href"):
            self.base = a["href"]
        if tag == "link" and "canonical" in a.get("rel", "").lower().split():
            self.targets.append(a.get("href", ""))
        if tag == "meta" and a.get("http-equiv", "").lower() == "refresh":
            self.targets.append(re.split(r"(?i)url=", a.get("content", ""), maxsplit=1)[-1].strip("'\""))


def plain_resource(url):
    rest = url.split("://", 1)[1].split("#")[0]
    address, _, query = rest.partition("?")
    host, slash, path = address.partition("/")
    kept = sorted(p for p in query.split("&") if p and not re.match(r"(utm_[^=&]*|ref|fbclid|gclid)(=|$)", p))
    return re.sub(r"^www\.", "", host.lower()) + (slash + path).rstrip("/") + ("?" + "&".join(kept) if kept else "")


def plain_rule(url):
    host, slash, path = url.split("://", 1)[1].split("#")[0].split("?")[0].partition("/")
    fits = [(len(r), v == "allow", r, v) for r, v in uf.RULES if ("." + host.lower()).endswith("." + r.split("/")[0]) and (slash + path).startswith(r[r.index("/") :])]
    return max(fits, default=(0, None, None, None))[2:]


def plain_verdicts(pages):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    urls = [u for _, u, _ in pages]
    for _, url, html in pages:
        found = Links(html or "")
        base = urljoin(url, found.base) if found.base else url
        for t in found.targets:
            urls.append(urljoin(base, t))
            parent[find(plain_resource(url))] = find(plain_resource(urls[-1]))
    blocked = {find(plain_resource(u)) for u in urls if plain_rule(u)[1] == "block"}
    out = []
    for i, url, _ in pages:
        rule, verdict = plain_rule(url)
        out.append((i, rule, verdict or ("block" if find(plain_resource(url)) in blocked else "allow")))
    return sorted(out)


def test_query_equals_a_parser_and_union_find(spark, tmp_path):
    """``op2_redirects`` on raw pages with links of all kinds, against plain Python."""
    rng = random.Random(12)
    hosts = ["x.com", "www.x.com", "y.net", "Z.net", "a.example.org", "q.de", "v.io", "www.v.io"]
    paths = ["/de/1", "/fr/2", "/es/3", "/a/b", "/a/", "/c/d/e", "", "/en/12", "/n1", "/n2", "/n3/", "/n4"]
    address = lambda: rng.choice(["http", "https"]) + "://" + rng.choice(hosts) + rng.choice(paths) + rng.choice(["", "", "?k=1&j=2", "?utm_source=a", "#top"])
    target = lambda: rng.choice([address, address, lambda: rng.choice(paths[:-1]) or "/", lambda: "//" + rng.choice(hosts) + rng.choice(paths), lambda: "../n" + str(rng.randint(1, 4)), lambda: "?k=" + str(rng.randint(1, 2))])().replace("&", "&amp;")
    tag = [
        lambda: f'<link rel="canonical" href="{target()}">', lambda: f"<LINK href='{target()}' rel='nofollow Canonical'/>", lambda: f'<meta http-equiv="Refresh" content="3; url={target()}">',
        lambda: f"<!-- <link rel=canonical href=\"{address()}\"> -->", lambda: f"<script>x = '<link rel=canonical href=\"{address()}\">'</script>", lambda: f'<link rel="stylesheet" href="{address()}">', lambda: "<p>text &amp; <a href='/de/1'>link</a>",
    ]
    pages = [(i, address(), rng.choice([None, "".join(rng.choice(tag)() for _ in range(rng.randint(0, 3)))])) for i in range(150)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = uf.op2_redirects(spark, str(tmp_path)).collect()
    assert sorted((r.page_id, r.rule, r.verdict) for r in got) == plain_verdicts(pages)
    assert sum(r.by_alias for r in got) > 10 and sum(r.verdict == "allow" and r.rule is None for r in got) > 10
