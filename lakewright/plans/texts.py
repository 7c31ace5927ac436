"""Queries that parse or rewrite text."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakewright.functions import text as T
from lakewright.plans.binding import query
from lakewright.sources import editions as E

_RAW = ["/a/b[3]", "/a/b", "/gen/stringAttribute[@name=x]/value[1]", "/a[2]/b[0]", "/only", "/x[@name=地区計画]/y"]
_BASE = ["/a/b", "/a/b", "/gen/stringAttribute[@name=x]/value", "/a[2]/b", "/only", "/x[@name=地区計画]/y"]
_FOLD = ["/a/b", "/a/b", "/gen/stringAttribute/value", "/a/b", "/only", "/x/y"]


@query("SELECT p_partkey AS id, base, fold, last FROM part JOIN (VALUES " + ", ".join(f"({i}, '{b}', '{f}', '{f.rsplit('/', 1)[1]}')" for i, (b, f) in enumerate(zip(_BASE, _FOLD))) + ") t(i, base, fold, last) ON p_partkey % 6 = i")
def path_normalise(spark, d):
    raw = F.get(F.array(*(F.lit(p) for p in _RAW)), (F.col("p_partkey") % 6).cast("int"))
    rows = E.table(spark, d, "part").select(F.col("p_partkey").alias("id"), raw.alias("raw"))
    r = F.col("raw")
    return rows.select("id", T.base_path(r).alias("base"), T.fold_names(r).alias("fold"), T.local_name(r).alias("last"))


@query(
    """WITH b AS (SELECT event_id, [('0', 'Change-Type', event_type), ('1', 'Building-ID', CAST(user_id AS VARCHAR))] AS a, event_id % 4 = 0 AS twice FROM events)
SELECT event_id, CAST(0 AS INTEGER) AS pos, 'Change-Type' AS key, event_type AS value FROM events UNION ALL SELECT event_id, 1, 'Building-ID', CAST(user_id AS VARCHAR) FROM events
UNION ALL SELECT event_id, 2, 'Change-Type', 'again' FROM events WHERE event_id % 4 = 0"""
)
def trailers(spark, d):
    again = F.when(F.col("event_id") % 4 == 0, "\nChange-Type:   again  ").otherwise("")
    body = F.concat(F.lit("subject\n\nOther: x\nChange-Type: "), "event_type", F.lit("\nBuilding-ID:\t"), F.col("user_id").cast("string"), again, F.lit("\nnot a trailer"))
    return E.table(spark, d, "events").select("event_id", F.inline(T.trailers(body, ("Change-Type", "Building-ID"))))


@query("SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN 'm/' || doc_id || '.json' END AS path, CASE WHEN doc_id % 3 <> 0 THEN sha256(text) END AS digest FROM documents")
def manifest_ref(spark, d):
    k = F.col("doc_id")
    value = F.concat(F.lit("m/"), k.cast("string"), F.lit(".json@sha256:"), F.when(k % 3 == 0, "abc").otherwise(F.sha2("text", 256)))
    ref = T.manifest_reference(value)
    return E.table(spark, d, "documents").select("doc_id", ref["path"].alias("path"), ref["digest"].alias("digest"))


@query("SELECT o_orderkey AS key, CASE WHEN o_custkey % 10 = 0 THEN 'g' || o_orderkey ELSE CAST(o_custkey AS VARCHAR) END AS id FROM orders")
def stable_id_rule(spark, d):
    """The id attribute, unless its value is known to be invalid; then the fallback."""
    own = F.when(F.col("o_custkey") % 10 == 0, "1000000").otherwise(F.col("o_custkey").cast("string"))
    return E.table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.coalesce(F.when(~own.isin("1000000"), own), F.concat(F.lit("g"), F.col("o_orderkey").cast("string"))).alias("id"))


@query("SELECT c_nationkey AS file, CASE WHEN count(DISTINCT code) = 1 THEN min(code) END AS city, min_by(code, c_custkey) AS first FROM (SELECT *, CASE WHEN c_nationkey % 3 = 0 THEN '13101' ELSE CAST(13100 + c_custkey % 2 AS VARCHAR) END AS code FROM customer) GROUP BY 1")
def city_code(spark, d):
    """The five-digit code that all records of a file share, and the first one met."""
    code = F.when(F.col("c_nationkey") % 3 == 0, "13101").otherwise((F.lit(13100) + F.col("c_custkey") % 2).cast("string"))
    rows = E.table(spark, d, "customer").withColumn("text", F.concat(F.lit("Tokyo "), code, F.lit(" ward"))).withColumn("code", F.regexp_extract("text", r"\b([0-9]{5})\b", 1))
    return rows.groupBy(F.col("c_nationkey").alias("file")).agg(F.when(F.count_distinct("code") == 1, F.min("code")).alias("city"), F.min_by("code", "c_custkey").alias("first"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE '<b><h>' || (p_size + 1) || '</h><s>' || p_size || '</s></b>' END AS text FROM part")
def leaf_replace_unique(spark, d):
    """A leaf's value replaced only where the leaf stands once."""
    k, s = F.col("p_partkey"), F.col("p_size").cast("string")
    leaf = F.concat(F.lit("<h>"), s, F.lit("</h>"))
    text = F.concat(F.lit("<b>"), leaf, F.when(k % 4 == 0, leaf).otherwise(""), F.lit("<s>"), s, F.lit("</s></b>"))
    return E.table(spark, d, "part").select(k.alias("id"), T.replace_leaf(text, "h", s, (F.col("p_size") + 1).cast("string")).alias("text"))


@query(
    """SELECT p_partkey AS id, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE '<b id="' || p_partkey || '"><x:use codeSpace="' || CASE WHEN p_partkey % 4 = 0 THEN 'new$.xml' ELSE 'old.xml' END || '">' || (p_size + 1) || '</x:use><h>' || p_brand || '</h>' ||
  CASE WHEN p_partkey % 5 = 0 THEN '<n codeSpace="new$.xml">$1\\</n>' ELSE '<n>7</n>' END || '<h>other</h></b>' END AS text FROM part"""
)
def manifest_changes(spark, d):
    """Records with the changes that a manifest lists applied in order, byte for byte elsewhere."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    text = F.concat(
        F.lit('<b id="'), k, F.lit('"><x:use codeSpace="old.xml">'), size, F.lit("</x:use><h>"), "p_brand", F.lit("</h><n>7</n>"), F.when(k % 6 == 0, F.lit("<n>7</n>")).otherwise(""), F.lit("<h>other</h></b>")
    )
    new, none = F.lit("new$.xml"), F.lit(None).cast("string")
    change = lambda tag, old, to, space: F.struct(F.lit(tag).alias("tag"), old.alias("old"), to.alias("new"), space.alias("code_space"))
    first = change("use", size, (F.col("p_size") + 1).cast("string"), F.when(k % 4 == 0, new))
    second = F.when((k % 5 == 0) | (k % 6 == 0), change("n", F.lit("7"), F.lit("$1\\"), F.when(k % 5 == 0, new).otherwise(none)))
    return E.table(spark, d, "part").select(k.alias("id"), T.apply_changes(text, F.array_compact(F.array(first, second))).alias("text"))


_REASONS = ["## Reason and supporting evidence\nsurvey of 2024\n## Next\nx", "## A <!-- sec:reason -->\n<!-- hint -->TODO\n", "no heading", "## Summary of changes\n  abc \n", "# t\n\n## 変更理由\n現地を確認した\n\n## z"]
_REASON_OUT = [("survey of 2024", True), ("TODO", False), ("", False), ("abc", False), ("現地を確認した", True)]


@query("SELECT p_partkey AS id, reason, ok FROM part JOIN (VALUES " + ", ".join(f"({i}, '{a}', {str(b).lower()})" for i, (a, b) in enumerate(_REASON_OUT)) + ") t(i, reason, ok) ON p_partkey % 5 = i")
def reason_section(spark, d):
    body = F.get(F.array(*(F.lit(b) for b in _REASONS)), (F.col("p_partkey") % 5).cast("int"))
    rows = E.table(spark, d, "part").select(F.col("p_partkey").alias("id"), T.reason_section(body).alias("reason"))
    return rows.withColumn("ok", T.is_reason(F.col("reason")))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_brand || ',' || p_type ELSE p_brand END AS ids FROM part")
def heading_ids(spark, d):
    h = lambda c: F.concat(F.lit("\n#### `"), c, F.lit("`\ntext"))
    body = F.concat(F.lit("# Report"), h(F.col("p_brand")), F.when(F.col("p_partkey") % 3 == 0, h(F.col("p_type"))).otherwise(""), h(F.col("p_brand")))
    return E.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(T.heading_ids(body), ",").alias("ids"))


@query(r"""SELECT page_id, regexp_extract(substr(html, 1, 8192), '<html lang="([a-z]+)"', 1) AS lang, regexp_extract(substr(html, 1, 8192), '<title>([^<]*)</title>', 1) AS title, strlen(html) AS bytes FROM pages""")
def header_scan(spark, d):
    """Facts from the first 8 KiB of a file only."""
    head = F.substring("html", 1, 8192)
    return E.table(spark, d, "pages").select(
        "page_id", F.regexp_extract(head, '<html lang="([a-z]+)"', 1).alias("lang"), F.regexp_extract(head, "<title>([^<]*)</title>", 1).alias("title"), F.octet_length("html").cast("long").alias("bytes")
    )


_MAGIC = {"png": "89504E47", "jpg": "FFD8FF", "gif": "47494638"}


@query("SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'png' WHEN 1 THEN 'jpg' ELSE 'gif' END AS extension, p_partkey % 5 <> 0 AS ok FROM part")
def image_magic(spark, d):
    """Whether a file's first bytes fit its extension."""
    k = F.col("p_partkey")
    ext = F.when(k % 3 == 0, "png").when(k % 3 == 1, "jpg").otherwise("gif")
    magic = F.create_map(*(F.lit(x) for kv in _MAGIC.items() for x in kv))
    content = F.unhex(F.concat(F.when(k % 5 == 0, "0000").otherwise(magic[ext]), F.lit("00FF00FF")))
    rows = E.table(spark, d, "part").select(k.alias("id"), ext.alias("extension"), content.alias("content"))
    return rows.select("id", "extension", F.startswith(F.hex("content"), magic[F.col("extension")]).alias("ok"))
