"""Queries on documents as they are read, checked, edited and published."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F

from lakewright.plans.binding import query
from lakewright.plans.files import city_files
from lakewright.sources import documents as Doc
from lakewright.sources import editions as E
from lakewright.sources import gml, sinks


@query("SELECT 'list' || n_regionkey || '.xml' AS list, CAST(n_nationkey AS VARCHAR) AS code, n_name AS label FROM nation WHERE n_regionkey <> 0")
def code_list_scan(spark, d):
    """Codes and labels of dictionary files; one file is cut off and skipped."""
    entry = F.concat(
        F.lit("<gml:dictionaryEntry><gml:Definition><gml:description> "), "n_name", F.lit(" </gml:description><gml:name>"), F.col("n_nationkey").cast("string"), F.lit("</gml:name></gml:Definition></gml:dictionaryEntry>")
    )
    files = E.table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.collect_list(entry), "\n").alias("body"))
    text = F.concat(F.lit('<gml:Dictionary xmlns:gml="http://www.opengis.net/gml"><gml:name>all</gml:name>'), "body", F.when(F.col("n_regionkey") != 0, "</gml:Dictionary>").otherwise("</gml:Dict"))
    return gml.scan_code_lists(files.select(F.concat(F.lit("lists/list"), F.col("n_regionkey").cast("string"), F.lit(".xml")).alias("file"), F.encode(text, "UTF-8").alias("content")))


@query("SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'refused' WHEN 1 THEN 'refused' WHEN 2 THEN 'malformed' ELSE 'ok' END AS verdict FROM part")
def xml_hardening(spark, d):
    """Documents with types, entities or errors among good ones."""
    k = F.col("p_partkey") % 5
    body = F.concat(F.lit("<a><b>"), "p_name", F.lit("</b></a>"))
    text = (
        F.when(k == 0, F.concat(F.lit('<!DOCTYPE a SYSTEM "http://q.example/x.dtd">'), body))
        .when(k == 1, F.lit('<!DOCTYPE a [<!ENTITY x "y">]><a>&x;</a>'))
        .when(k == 2, F.concat(F.lit("<a>"), body))
        .otherwise(F.concat(F.lit('<?xml version="1.0"?><!-- c -->'), body))
    )
    return E.table(spark, d, "part").select(F.col("p_partkey").alias("id"), gml.xml_verdict(F.encode(text, "UTF-8")).alias("verdict"))


@query("""SELECT p_partkey AS id, sha256(chr(65279) || '<?xml version="1.0" encoding="UTF-8"?>' || chr(13) || chr(10) || '<a>ü' || chr(13) || chr(10) || p_name || chr(13) || chr(10) || '</a>') AS digest FROM part""")
def gml_serialised(spark, d):
    """Documents as they are published: byte-order mark, declaration, one kind of line end."""
    body = F.concat(F.lit("<a>ü\n"), "p_name", F.lit("\r\n</a>"))
    out = F.pandas_udf(lambda s: s.map(gml.serialise), "binary")
    return E.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.sha2(out(body), 256).alias("digest"))


@query("""SELECT p_partkey AS id, '{"a":"' || p_name || ' ü","b":[1,null,{"x":true,"y":' || p_size || '}],"z":' || p_partkey || '}' AS json FROM part""")
def canonical_json(spark, d):
    """Values as canonical JSON, whatever the order of their keys."""
    k = F.col("p_partkey").cast("string")
    inner = F.concat(F.lit('"b": [1, null, {"y": '), F.col("p_size").cast("string"), F.lit(', "x": true}]'))
    name = F.concat(F.lit('"a": "'), "p_name", F.lit(' \\u00fc"'))
    text = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit('{"z": '), k, F.lit(", "), inner, F.lit(", "), name, F.lit("}"))).otherwise(F.concat(F.lit("{"), name, F.lit(', "z": '), k, F.lit(", "), inner, F.lit("}")))
    out = F.pandas_udf(lambda s: s.map(lambda x: sinks.canonical_json(json.loads(x)).decode()), "string")
    return E.table(spark, d, "part").select(F.col("p_partkey").alias("id"), out(text).alias("json"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS digest, true AS link_safe FROM documents")
def payload_roundtrip(spark, d):
    """Texts packed for a link and unpacked again."""
    pack, back = F.pandas_udf(lambda s: s.map(Doc.payload), "string"), F.pandas_udf(lambda s: s.map(Doc.unpack), "string")
    rows = E.table(spark, d, "documents").select("doc_id", pack(F.coalesce("text", F.lit(""))).alias("p"))
    return rows.select("doc_id", F.sha2(back("p"), 256).alias("digest"), F.col("p").rlike("^[A-Za-z0-9_-]*$").alias("link_safe"))


@query(
    """WITH b AS (SELECT p_partkey AS k, p_type, CASE p_partkey % 2 WHEN 0 THEN p_partkey + 1 ELSE p_partkey - 1 END AS other FROM part)
SELECT 'B' || CASE WHEN other IN (SELECT p_partkey FROM part) THEN other ELSE k END AS gml_id, p_type AS usage FROM b"""
)
def ids_replaced(spark, d):
    """Neighbours in a file swap their ids; every other byte stays."""

    def swapped(raw: bytes) -> bytes:
        ids = {m.gml_id for m in gml.scan(raw)}
        pairs = {i: f"B{int(i[1:]) ^ 1}" for i in ids}
        return gml.replace_ids(raw, {i: j for i, j in pairs.items() if j in ids})

    out = F.pandas_udf(lambda s: s.map(lambda x: swapped(bytes(x))), "binary")
    files = city_files(spark, d).select("file", out("content").alias("content"))
    return gml.attributes(gml.scan_files(files)).where("path = '/usage[0]'").select("gml_id", F.col("value").alias("usage"))


@query("SELECT 'f' || CAST(floor(p_partkey / 20) AS BIGINT) AS file, count(*) AS renamed, CAST(0 AS BIGINT) AS old_names, 2 * count(*) AS new_names FROM part GROUP BY 1")
def elements_renamed(spark, d):
    """Footprints renamed to roof edges in every building: buildings told, and name tokens left and made."""

    def renamed(contents: pd.Series) -> pd.DataFrame:
        rows = []
        for raw in contents:
            out, done, _ = gml.rename_elements(bytes(raw), "lod0FootPrint", "lod0RoofEdge")
            rows.append((len(done), out.count(b"lod0FootPrint"), out.count(b"lod0RoofEdge")))
        return pd.DataFrame(rows, columns=["renamed", "old_names", "new_names"])

    out = F.pandas_udf(renamed, "renamed long, old_names long, new_names long")
    return city_files(spark, d).select("file", out("content").alias("r")).select("file", "r.*")


_SCHEMA = {
    "type": "object", "required": ["id", "segment"], "additionalProperties": False,
    "properties": {"id": {"type": "integer", "minimum": 1}, "segment": {"enum": ["BUILDING", "MACHINERY"]}, "name": {"type": "string", "pattern": "^C"}, "tags": {"type": "array", "minItems": 1, "items": {"$ref": "#/$defs/tag"}}},
    "$defs": {"tag": {"type": "string"}},
}


@query(
    """SELECT c_custkey AS id, array_to_string(list_sort(list_filter([CASE WHEN c_custkey % 5 = 0 THEN '$: segment is missing' WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN '$.segment: not in the list' END, CASE WHEN c_custkey % 7 = 0 THEN '$: more is not allowed' END,
  CASE WHEN c_custkey % 11 = 0 THEN '$.id: below the minimum' WHEN c_custkey % 11 = 1 THEN '$.id: integer expected' END, CASE WHEN NOT starts_with(c_name, 'C') THEN '$.name: does not match' END,
  CASE c_custkey % 3 WHEN 0 THEN '$.tags: too few items' WHEN 1 THEN '$.tags[1]: string expected' END], lambda x: x IS NOT NULL)), '; ') AS errors FROM customer"""
)
def schema_violations(spark, d):
    """Records as JSON against a schema with required, listed, bounded and referenced parts."""
    k = F.col("c_custkey")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    number = F.when(k % 11 == 0, (-k).cast("string")).when(k % 11 == 1, F.lit("true")).otherwise(k.cast("string"))
    tags = F.when(k % 3 == 0, "[]").when(k % 3 == 1, '["a", 1]').otherwise('["a", "b"]')
    parts = F.array(
        F.concat(F.lit('"id": '), number), F.when(k % 5 != 0, F.concat(F.lit('"segment": '), quoted("c_mktsegment"))), F.concat(F.lit('"name": '), quoted("c_name")), F.concat(F.lit('"tags": '), tags), F.when(k % 7 == 0, F.lit('"more": 0'))
    )
    text = F.concat(F.lit("{"), F.array_join(F.array_compact(parts), ", "), F.lit("}"))
    out = F.pandas_udf(lambda s: s.map(lambda x: "; ".join(sorted(Doc.violations(_SCHEMA, json.loads(x))))), "string")
    return E.table(spark, d, "customer").select(k.alias("id"), out(text).alias("errors"))
