"""URL filter by redirect equivalence, in DataFrame operations only.

Pages whose addresses name the same resource form one class: addresses that
differ in scheme, fragment, a leading ``www.``, tracking parameters or a
trailing slash; a page and the addresses in its canonical links and refresh
redirects, relative ones resolved against its base; and any redirect pairs given.  Classes are the connected components
of these links.  A block rule that hits one member blocks every member that no
rule fits; a member that a rule fits keeps its own rule's verdict, so an
explicit allow goes before a block that came through an alias.

Defined results: a null url, or one without ``://``, has empty host and path,
no rule and no aliases, and is allowed.  Repeated rows are judged alike, each
giving a row.  An empty table gives no rows.  Extra columns of the input are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewright.llm.common import connected_components, let
from lakewright.sources.shared import materialise

#: (rule, verdict); a rule is a host and a path prefix.
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)

#: A list of rules becomes literals of the plan; more than these are given as a table.
MAX_RULES = 10_000

#: Query parameters that only track the reader.
TRACKING = "utm_[^=&]*|ref|fbclid|gclid"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def _tail(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(_tail(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_tail(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def resource(url: Column) -> Column:
    """The address without what does not change the resource; null if not an address."""
    query = F.regexp_extract(_tail(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(
        F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^(?:{TRACKING})(?:=|$)"))), "&"
    )
    host = F.regexp_replace(host_of(url), r"^www\.", "")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    return F.when(_tail(url).isNotNull(), F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null.

    Rules stand in a map from host to (path, verdict) pairs.  Every suffix of
    the url's host is looked up, so the cost does not grow with the number of
    rules and a very common host is no hot key.
    """
    rules = list(rules)
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; the bound is {MAX_RULES}")
    if not rules:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    by_host: dict[str, list] = {}
    for rule, verdict in rules:
        if verdict not in ("allow", "block") or "/" not in rule:
            raise ValueError(f"not a rule: {rule!r}, {verdict!r}")
        by_host.setdefault(rule[: rule.index("/")], []).append((rule[rule.index("/") :], rule, verdict))
    lookup = F.create_map(
        *(
            x
            for h, own in sorted(by_host.items())
            for x in (
                F.lit(h),
                F.array(*(F.struct(F.lit(p).alias("path"), F.lit(r).alias("rule"), F.lit(v).alias("verdict")) for p, r, v in own)),
            )
        )
    )
    labels = F.split(host, r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    found = F.filter(
        F.flatten(F.transform(suffixes, lambda s: F.coalesce(F.try_element_at(lookup, s), F.array().cast("array<struct<path:string,rule:string,verdict:string>>")))),
        lambda r: F.startswith(path, r["path"]),
    )
    # the longest rule; of rules repeated with both verdicts, allow goes first
    best = F.array_max(F.transform(found, lambda r: F.struct(F.length(r["rule"]).alias("n"), (r["verdict"] == "allow").alias("ok"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    return F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict")))


def with_fit(rows: DataFrame, rules) -> DataFrame:
    """``rows`` (with host and path) and the fitting rule as ``fit``.

    A table of rules (rule, verdict) of any size meets the suffixes of the
    distinct hosts and paths in a join, whose hot suffixes can be split.
    """
    if not isinstance(rules, DataFrame):
        return rows.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    cut = F.instr("rule", "/")
    own = rules.where(cut > 0).select(F.substring("rule", F.lit(1), cut - 1).alias("suffix"), F.substring("rule", cut, F.length("rule")).alias("prefix"), "rule", "verdict")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    met = rows.select("host", "path").distinct().withColumn("suffix", F.explode(suffixes)).join(own, "suffix").where(F.startswith("path", "prefix"))
    best = met.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), (F.col("verdict") == "allow").alias("ok"), "rule", "verdict")).alias("b"))
    return rows.join(best, ["host", "path"], "left").withColumn("fit", F.when(F.col("b").isNotNull(), F.struct(F.col("b.rule").alias("rule"), F.col("b.verdict").alias("verdict")))).drop("b")


#: Named character references that are decoded, and those by number; other names stay as they are.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "sol": "/", "colon": ":", "period": ".", "quest": "?",
    "num": "#", "equals": "=", "percnt": "%", "commat": "@", "plus": "+", "comma": ",", "semi": ";", "lowbar": "_", "Tab": "\t", "NewLine": "\n",
}

#: What stands in comments and in elements whose content is no markup; one that is not closed goes to the end.
_HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style|template|textarea|title|xmp)\b.*?(?:</\1\b|\z)"

_VALUE = r"""(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def _one_of(text: Column, pattern: str) -> Column:
    """What the one of the pattern's three groups that took part has found, else empty."""
    return F.concat(*(F.regexp_extract(text, pattern, n) for n in (1, 2, 3)))


def _attribute(tag: Column, name: str) -> Column:
    return _one_of(tag, rf"(?is)(?<![\w:-]){name}\s*=\s*{_VALUE}")


def unescape(text: Column) -> Column:
    """``text`` with its character references decoded, in one pass."""
    names = F.create_map(*(F.lit(x) for k, v in ENTITIES.items() for x in (f"&{k};", v)))

    def char(code: Column) -> Column:
        valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        return F.decode(F.unhex(F.lpad(F.hex(F.when(valid, code).otherwise(0xFFFD)), 8, "0")), "UTF-32")

    def plain(piece: Column) -> Column:
        digits = F.regexp_extract(piece, r"^&#([0-9]{1,7});?$", 1)
        hexed = F.regexp_extract(piece, r"^&#[xX]([0-9a-fA-F]{1,6});?$", 1)
        code = F.coalesce(F.when(digits != "", digits.cast("int")), F.when(hexed != "", F.conv(hexed, 16, 10).cast("int")))
        return F.when(piece.startswith("&#"), F.coalesce(let(code, lambda c: F.when(c.isNotNull(), char(c))), piece)).otherwise(F.coalesce(F.try_element_at(names, piece), piece))

    pieces = lambda t: F.regexp_extract_all(t, F.lit(r"&#[xX][0-9a-fA-F]+;?|&#[0-9]+;?|&[a-zA-Z]+;|[^&]+|&"), F.lit(0))
    return let(text, lambda t: F.when(F.instr(t, "&") > 0, F.array_join(F.transform(pieces(t), plain), "")).otherwise(t))


def _without_dots(path: Column) -> Column:
    """A path whose ``.`` and ``..`` segments are resolved."""
    up = lambda acc: F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
    parts = F.split(F.regexp_replace(path, "^/", ""), "/")
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(x == "..", up(acc)).when(x == ".", acc).otherwise(F.concat(acc, F.array(x))))
    # a dot segment at the end leaves its folder
    end = F.when((F.size(kept) > 0) & path.rlike(r"/\.\.?$"), "/").otherwise("")
    return F.when(path.rlike(r"/\.\.?(?:/|$)"), F.concat(F.lit("/"), F.array_join(kept, "/"), end)).otherwise(path)


def resolve(target: Column, base: Column) -> Column:
    """The address that ``target`` names on the page ``base``; null if it names no other address."""
    t = F.regexp_replace(F.trim(F.regexp_replace(target, r"[\t\r\n]", "")), r"^\\+|^/\\", "//")

    def joined(x: Column) -> Column:
        t, base = x["t"], x["base"]
        scheme = F.when(F.instr(base, "://") > 0, F.substring(base, F.lit(1), F.instr(base, "://") - 1))
        site = F.concat(scheme, F.lit("://"), F.regexp_extract(_tail(base), r"^[^/?#]*", 0))
        folder = F.concat(F.lit("/"), F.regexp_extract(path_of(base), r"^/(.*/)?[^/]*$", 1))
        return (
            F.when((t == "") | t.startswith("#"), None)
            .when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), t)
            .when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
            .when(t.startswith("//"), F.concat(scheme, F.lit(":"), t))
            .when(t.startswith("/"), F.concat(site, t))
            .when(t.startswith("?"), F.concat(site, path_of(base), t))
            .otherwise(F.concat(site, folder, t))
        )

    def plain(whole: Column) -> Column:
        head = F.regexp_extract(whole, r"(?s)^[^:]*://[^/?#]*", 0)
        rest = F.regexp_extract(whole, r"(?s)^[^:]*://[^/?#]*[^?#]*(.*)$", 1)
        return F.when(whole.isNotNull(), F.concat(head, let(path_of(whole), _without_dots), rest))

    return let(let(F.struct(t.alias("t"), base.alias("base")), joined), plain)


def page_links(pages: DataFrame) -> DataFrame:
    """(url, target): all canonical links and refresh redirects in the pages' html, as absolute addresses.

    Targets are resolved against the page's first ``<base href>``, else its url.  What stands in
    comments, scripts and other content that is no markup is no link.
    """
    marked = F.when(F.col("html").rlike(r"(?i)<(?:link|meta|base)\b"), F.regexp_replace("html", _HIDDEN, " "))
    tags = pages.select("url", F.regexp_extract_all(marked, F.lit(r"(?is)<(?:link|meta|base)\b[^>]*>"), F.lit(0)).alias("tags")).where(F.size("tags") > 0)
    of = lambda name: F.filter("tags", lambda x: x.rlike(rf"(?i)^<{name}\b"))
    first = F.get(F.filter(F.transform(of("base"), lambda x: _attribute(x, "href")), lambda x: x != ""), F.lit(0))
    relation = r"""(?is)(?<![\w:-])rel\s*=\s*(?:"(?:[^"]*\s)?canonical(?:\s[^"]*)?"|'(?:[^']*\s)?canonical(?:\s[^']*)?'|canonical(?=[\s/>]))"""
    refresh = r"""(?is)(?<![\w:-])http-equiv\s*=\s*["']?\s*refresh\b"""
    used = F.filter("tags", lambda x: x.rlike(r"(?i)^<link\b") & x.rlike(relation) | x.rlike(r"(?i)^<meta\b") & x.rlike(refresh))
    named = tags.select("url", first.alias("base"), F.explode(used).alias("tag"))
    # the quotes around a refresh address may be references, so it is decoded before they are taken off
    content = F.regexp_extract(F.col("text"), r"(?is)^\s*(?:[\d.]*[\s;,]*url\s*=\s*|[\d.]+[\s;,]+)(.*)$", 1)
    moved = _one_of(content, r"""(?s)^(?:"([^"]*)|'([^']*)|([^"'].*))""")
    link = F.col("tag").rlike(r"(?i)^<link\b")
    read = named.select("url", "base", link.alias("link"), unescape(F.when(link, _attribute(F.col("tag"), "href")).otherwise(_attribute(F.col("tag"), "content"))).alias("text"))
    read = read.select("url", F.when(F.col("base").isNotNull(), resolve(unescape(F.col("base")), F.col("url"))).alias("base"), F.when(F.col("link"), F.col("text")).otherwise(moved).alias("target"))
    return read.select("url", resolve(F.col("target"), F.coalesce("base", "url")).alias("target")).where("target is not null")


def redirect_equivalence(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """Judge every page: page_id, host, path, rule, verdict, resource, component, by_alias.

    ``rules`` is a list of (rule, verdict), or a table of them.  ``redirects``
    may hold further (url, target) pairs.  ``component`` names the class (its least resource); ``by_alias`` tells that a block came from
    another member.
    """
    rows = pages.select("page_id", "url").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url")), "resource": resource(F.col("url"))})
    rows = with_fit(rows, rules)
    links = page_links(pages)
    if redirects is not None:
        links = links.unionByName(redirects.select("url", "target"))
    # three steps read the links; the pages' html is searched once
    links = materialise(links.select(resource(F.col("url")).alias("a"), resource(F.col("target")).alias("b"), F.col("url"), "target"), "links")
    classes = connected_components(links).select(F.col("node").alias("resource"), "component")
    # the targets of redirects are members too, though no page of theirs is at hand
    named = links.select(F.col("b").alias("resource"), F.col("target").alias("u")).unionByName(
        links.select(F.col("a").alias("resource"), F.col("url").alias("u"))
    )
    hit = (
        rows.where("fit.verdict = 'block'").select("resource")
        .unionByName(with_fit(named.select("resource", host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path")), rules).where("fit.verdict = 'block'").select("resource"))
        .where("resource is not null")
        .distinct()
    )
    blocked = (
        hit.join(classes, "resource", "left")
        .select(F.coalesce("component", "resource").alias("component"))
        .distinct()
        .withColumn("blocked", F.lit(True))
    )
    judged = rows.join(classes, "resource", "left").withColumn("component", F.coalesce("component", "resource")).join(blocked, "component", "left")
    alias = F.col("fit").isNull() & F.coalesce("blocked", F.lit(False))
    return judged.select(
        "page_id",
        "host",
        "path",
        F.col("fit.rule").alias("rule"),
        F.when(F.col("fit").isNotNull(), F.col("fit.verdict")).when(alias, "block").otherwise("allow").alias("verdict"),
        "resource",
        "component",
        alias.alias("by_alias"),
    )


def op2_redirects(spark, sf_dir: str) -> DataFrame:
    """All pages: page_id, host, path, rule, verdict, then whether the block came by an alias."""
    out = redirect_equivalence(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "host", "path", "rule", "verdict", "by_alias")


ORACLE = r"""
WITH RECURSIVE u AS (
  SELECT page_id, url, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS tail FROM pages
), p AS (
  SELECT page_id, html, url,
    coalesce(translate(regexp_extract(tail, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(tail, '^[^/?#]*([^?#]*)', 1), '') AS path, tail,
    list_sort(list_filter(string_split(coalesce(regexp_extract(tail, '^[^?#]*\?([^#]*)', 1), ''), '&'),
      lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=&]*|ref|fbclid|gclid)(=|$)'))) AS args
  FROM u
), r AS (
  SELECT *, CASE WHEN tail IS NOT NULL THEN regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '')
    || CASE WHEN len(args) > 0 THEN '?' || array_to_string(args, '&') ELSE '' END END AS resource FROM p
), rules(h, q, rule, v) AS (VALUES ('org', '/', 'org/', 'allow'), ('example.org', '/es/', 'example.org/es/', 'block'),
  ('example.org', '/en/1', 'example.org/en/1', 'block'), ('com', '/fr/', 'com/fr/', 'allow'), ('com', '/de/', 'com/de/', 'block')
), j AS (
  SELECT r.page_id, r.host, r.path, r.resource,
    (SELECT rule FROM rules WHERE (r.host = h OR ends_with(r.host, '.' || h)) AND starts_with(r.path, q) ORDER BY length(rule) DESC LIMIT 1) AS rule
  FROM r
), k AS (
  SELECT j.*, rules.v FROM j LEFT JOIN rules USING (rule)
), b AS (
  SELECT DISTINCT resource FROM k WHERE v = 'block'
)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN b.resource IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
  v IS NULL AND b.resource IS NOT NULL AS by_alias
FROM k LEFT JOIN b ON k.resource = b.resource
"""
