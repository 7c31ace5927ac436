"""Queries of lint rules, gates and classifications."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakewright.functions import geo
from lakewright.functions import text as T
from lakewright.functions import verdicts as V
from lakewright.plans.binding import query
from lakewright.sources import editions as E

# The tallest building in metres and the most storeys that pass for plausible.
MAX_HEIGHT_M, MAX_STOREYS = 300.0, 200


@query(
    """WITH b AS (SELECT p_partkey AS id, CASE p_partkey % 7 WHEN 0 THEN -1.0 * p_size WHEN 1 THEN 9999 WHEN 2 THEN p_size * 20.0 ELSE p_size END::DOUBLE AS h, CASE WHEN p_partkey % 2 = 0 THEN 'ft' ELSE 'm' END AS uom, p_size * 6 AS s FROM part),
m AS (SELECT *, h * CASE uom WHEN 'ft' THEN 0.3048::DOUBLE ELSE 1 END AS metres FROM b)
SELECT id, 'nonpositive_height' AS code, h AS value FROM m WHERE h <= 0 AND h <> -9999 UNION ALL SELECT id, 'height_out_of_range', h FROM m WHERE h > 0 AND h <> 9999 AND metres > 300
UNION ALL SELECT id, 'storeys_out_of_range', s FROM m WHERE s > 200"""
)
def plausibility_lint(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    h = F.when(k % 7 == 0, s * -1.0).when(k % 7 == 1, 9999.0).when(k % 7 == 2, s * 20.0).otherwise(s.cast("double"))
    rows = E.table(spark, d, "part").select(k.alias("id"), h.alias("h"), F.when(k % 2 == 0, "ft").otherwise("m").alias("uom"), (s * 6).alias("s"))
    h, tall = F.col("h"), geo.metres(F.col("h"), F.col("uom"))
    found = lambda cond, code, v: F.when(cond, F.struct(F.lit(code).alias("code"), v.cast("double").alias("value")))
    rules = [
        found(~T.is_sentinel(h) & (h <= 0), "nonpositive_height", h),
        found(~T.is_sentinel(h) & (h > 0) & (tall > MAX_HEIGHT_M), "height_out_of_range", h),
        found(~T.is_sentinel(F.col("s")) & (F.col("s") > MAX_STOREYS), "storeys_out_of_range", F.col("s")),
    ]
    return rows.select("id", F.inline(F.array_compact(F.array(*rules))))


_LIFE = """e AS (SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'split' WHEN 1 THEN 'merge' WHEN 2 THEN 'rebuild' WHEN 3 THEN 'move' END AS kind, o_orderkey % 4 AS nold, o_orderkey % 3 AS nnew, o_orderkey % 11 = 0 AS twice, o_orderkey % 13 = 0 AS spaced,
  CASE o_orderkey % 17 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE o_orderpriority END AS reason, CASE o_orderkey % 19 WHEN 0 THEN NULL WHEN 1 THEN '2024-02-30' WHEN 2 THEN '20240501' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS confirmed,
  CASE o_orderkey % 23 WHEN 0 THEN 'x' WHEN 1 THEN '2999-01-01' WHEN 2 THEN '1900-01-01' END AS occurred FROM orders)"""


@query(
    f"""WITH {_LIFE}, f AS (SELECT *, nold = 0 AS no_old, nnew = 0 OR spaced AS no_new, nold + CASE WHEN twice THEN 1 ELSE 0 END AS olds, nnew AS news,
  coalesce(regexp_full_match(confirmed, '\\d{{4}}-\\d{{2}}-\\d{{2}}') AND try_cast(confirmed AS DATE) IS NOT NULL, false) AS day1, coalesce(regexp_full_match(occurred, '\\d{{4}}-\\d{{2}}-\\d{{2}}') AND try_cast(occurred AS DATE) IS NOT NULL, false) AS day2 FROM e)
SELECT id, concat_ws(',', CASE WHEN kind IS NULL OR kind = 'move' THEN 'kind' END, CASE WHEN no_old THEN 'oldIds' WHEN twice THEN 'oldIds_duplicate' END, CASE WHEN no_new THEN 'newIds' END,
  CASE WHEN kind = 'split' AND NOT no_old AND NOT no_new AND NOT (olds = 1 AND news >= 2) THEN 'split_cardinality' END, CASE WHEN kind = 'merge' AND NOT no_old AND NOT no_new AND NOT (olds >= 2 AND news = 1) THEN 'merge_cardinality' END,
  CASE WHEN trim(coalesce(reason, '')) = '' THEN 'reason' END, CASE WHEN NOT day1 THEN 'confirmedOn' END, CASE WHEN occurred IS NOT NULL AND NOT day2 THEN 'occurredOn' END, CASE WHEN day1 AND day2 AND occurred > confirmed THEN 'order' END) AS errors FROM f"""
)
def lifecycle_validation(spark, d):
    """The rules that each of many lifecycle events breaks: kinds, ids missing, doubled or with spaces, dates."""
    k = F.col("o_orderkey")
    ids = lambda n, letter: F.when(n > 0, F.transform(F.sequence(F.lit(1), n.cast("int")), lambda i: F.concat(F.lit(letter), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    old = F.when((k % 11 == 0) & (k % 4 > 0), F.concat(ids(k % 4, "a"), F.array(F.lit("a1")))).otherwise(ids(k % 4, "a"))
    new = F.when((k % 13 == 0) & (k % 3 > 0), F.transform(ids(k % 3, "b"), lambda x: F.concat(x, F.lit(" ")))).otherwise(ids(k % 3, "b"))
    kind = F.when(k % 5 == 0, "split").when(k % 5 == 1, "merge").when(k % 5 == 2, "rebuild").when(k % 5 == 3, "move")
    reason = F.when(k % 17 == 0, None).when(k % 17 == 1, "  ").otherwise(F.col("o_orderpriority"))
    confirmed = F.when(k % 19 == 0, None).when(k % 19 == 1, "2024-02-30").when(k % 19 == 2, "20240501").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    occurred = F.when(k % 23 == 0, "x").when(k % 23 == 1, "2999-01-01").when(k % 23 == 2, "1900-01-01")
    return E.table(spark, d, "orders").select(k.alias("id"), F.array_join(V.lifecycle_errors(kind, old, new, reason, confirmed, occurred), ",").alias("errors"))


@query(
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 13 = 0 THEN 'lifecycle' WHEN o_orderkey % 5 > 1 THEN 'multi-modified' WHEN o_orderkey % 5 = 1 THEN 'single' WHEN o_orderkey % 3 = 0 THEN 'rename' ELSE 'none' END AS class FROM orders"""
)
def change_class(spark, d):
    k = F.col("o_orderkey")
    n = lambda c: F.when(c, 1).otherwise(0)
    return E.table(spark, d, "orders").select(k.alias("id"), V.change_class(n(k % 13 == 0), F.lit(0), k % 5, n(k % 3 == 0)).alias("class"))


_GATES = "g(ord, gate, severity) AS (VALUES " + ", ".join(f"({i}, '{k}', '{s}')" for i, (k, s) in enumerate(V.GATES)) + ")"
_RUNS = f"""{_GATES}, r AS (SELECT o_orderkey AS run, ord, gate, severity, CASE (o_orderkey + ord) % 9 WHEN 0 THEN NULL WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS code, (o_orderkey + ord) % 11 <> 0 AS applies, (o_orderkey * 3 + ord) % 4 AS warnings
  FROM orders, g), s AS (SELECT *, CASE WHEN NOT applies THEN 'na' WHEN code IS NULL THEN 'pending' WHEN code = 0 THEN CASE WHEN warnings > 0 THEN 'warn' ELSE 'pass' END
  WHEN code = 1 THEN CASE WHEN severity = 'blocking' THEN 'fail' ELSE 'warn' END ELSE 'error' END AS status FROM r)"""


@query(f"WITH {_RUNS} SELECT run, gate, severity, status, status IN ('pass', 'warn', 'fail') AS ran FROM s")
def gate_status(spark, d):
    gates = F.broadcast(spark.createDataFrame([(i, k, s) for i, (k, s) in enumerate(V.GATES)], "ord int, gate string, severity string"))
    k = F.col("o_orderkey")
    runs = E.table(spark, d, "orders").select(k.alias("run")).join(gates, F.lit(True))
    m = (F.col("run") + F.col("ord")) % 9
    code = F.when(m == 0, None).when(m == 1, 1).when(m == 2, 2).otherwise(0)
    status = V.gate_status(code, F.col("severity"), (F.col("run") + F.col("ord")) % 11 != 0, (F.col("run") * 3 + F.col("ord")) % 4)
    return runs.withColumn("status", status).select("run", "gate", "severity", "status", F.col("status").isin("pass", "warn", "fail").alias("ran"))


@query(f"WITH {_RUNS} SELECT run, count(*) FILTER (status <> 'na') AS applicable, count(*) FILTER (status = 'pass') AS passed, bool_or(severity = 'blocking' AND status IN ('fail', 'error', 'pending')) AS blocked FROM s GROUP BY run")
def inspection_summary(spark, d):
    s = F.col("status")
    return gate_status(spark, d).groupBy("run").agg(
        F.count_if(s != "na").alias("applicable"), F.count_if(s == "pass").alias("passed"), F.bool_or((F.col("severity") == "blocking") & s.isin(*V.BLOCKING_STATUSES)).alias("blocked")
    )


@query(
    """WITH p AS (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'edit/' WHEN 1 THEN 'geom/' WHEN 2 THEN 'tex/' ELSE 'x/' END || p_name AS branch, CASE p_partkey % 3 WHEN 0 THEN 'Update textures' WHEN 1 THEN 'a rebuild of' ELSE 'misc' END || p_type AS title FROM part)
SELECT id, CASE WHEN starts_with(branch, 'edit/') THEN 'attribute' WHEN starts_with(branch, 'tex/') THEN 'texture' WHEN starts_with(branch, 'geom/') THEN 'geometry' WHEN starts_with(title, 'Update textures') THEN 'texture'
  WHEN contains(title, 'rebuild') THEN 'geometry' WHEN id % 7 = 0 THEN 'administrative' WHEN id % 2 = 0 THEN 'other' ELSE 'unclassified' END AS class FROM p"""
)
def proposal_class(spark, d):
    k = F.col("p_partkey")
    branch = F.concat(F.when(k % 5 == 0, "edit/").when(k % 5 == 1, "geom/").when(k % 5 == 2, "tex/").otherwise("x/"), "p_name")
    title = F.concat(F.when(k % 3 == 0, "Update textures").when(k % 3 == 1, "a rebuild of").otherwise("misc"), "p_type")
    return E.table(spark, d, "part").select(k.alias("id"), V.proposal_class(branch, title, k % 2 != 0, k % 7 == 0).alias("class"))


_PATHS = ["data/part_1.xml", "data/run_all.py", "docs/how.txt", "NOTES.md", "town/udx/veg/part_2.xml", ".github/workflows/nightly.yml", ".github/owners", "limits.json", "sign.png", "bin/make_all.py", "provenance/batch.json", "docs/make_all.sh"]
_SCOPE = ["data", "rejected", "docs", "docs", "data", "pin", "tooling", "config", "config", "rejected", "data", "rejected"]


@query("SELECT path, CASE WHEN p_partkey % 29 = 0 THEN 'removed' ELSE scope END AS scope, count(*) AS n FROM part JOIN (VALUES " + ", ".join(f"({i}, '{p}', '{s}')" for i, (p, s) in enumerate(zip(_PATHS, _SCOPE))) + ") t(i, path, scope) ON p_partkey % 12 = i GROUP BY 1, 2")
def path_scope(spark, d):
    names = F.array(*(F.lit(p) for p in _PATHS))
    rows = E.table(spark, d, "part").select(F.get(names, (F.col("p_partkey") % 12).cast("int")).alias("path"), (F.col("p_partkey") % 29 == 0).alias("removed"))
    return rows.groupBy("path", V.path_scope(F.col("path"), F.col("removed")).alias("scope")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey AS account, count(*) AS merged, CAST(CASE WHEN count(*) >= 30 THEN 30 WHEN count(*) >= 10 THEN 10 WHEN count(*) >= 3 THEN 3 WHEN count(*) >= 1 THEN 1 ELSE 0 END AS INTEGER) AS tier FROM orders GROUP BY 1")
def contribution_tier(spark, d):
    rows = E.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("account")).agg(F.count(F.lit(1)).alias("merged"))
    return rows.withColumn("tier", V.contribution_tier(F.col("merged")))


_HEADS = ["/address/a", "/bldgDataQualityAttribute", "/x", "", "/DisasterRiskAttribute", "/buildingIDAttribute", "/stringAttribute"]
_LEAVES = ["lodType", "lod1HeightType", "src", "depth", "storeysAboveGround", "usage", "detailedUsage", "urbanPlanType", "measuredHeight", "id", "v"]


@query(
    f"""WITH p AS (SELECT p_partkey AS id, ({_HEADS})[1 + p_partkey % 7] AS head, ({_LEAVES})[1 + p_partkey % 11] AS leaf FROM part)
SELECT id, head || '/' || leaf AS path, CASE WHEN head = '/address/a' THEN 'address' WHEN leaf IN ('lodType', 'lod1HeightType') THEN 'lod_quality' WHEN head = '/bldgDataQualityAttribute' THEN 'source_quality'
  WHEN head = '/DisasterRiskAttribute' THEN 'disaster_risk' WHEN head = '' AND leaf = 'storeysAboveGround' THEN 'storeys' WHEN leaf = 'detailedUsage' OR (head = '' AND leaf = 'usage') THEN 'usage_class_landuse'
  WHEN leaf = 'urbanPlanType' THEN 'planning_zoning_rates' WHEN leaf = 'measuredHeight' THEN 'survey_building_detail' WHEN head = '/buildingIDAttribute' THEN 'source_identity'
  WHEN head = '/stringAttribute' THEN 'generic_attributes' ELSE 'other_attributes' END AS family FROM p"""
)
def attribute_family(spark, d):
    """Paths of every head with every leaf, each in one family."""
    k = F.col("p_partkey")
    pick = lambda names: F.get(F.array(*(F.lit(x) for x in names)), (k % len(names)).cast("int"))
    rows = E.table(spark, d, "part").select(k.alias("id"), F.concat(pick(_HEADS), F.lit("/"), pick(_LEAVES)).alias("path"))
    return rows.withColumn("family", T.attribute_family(F.col("path")))


@query(f"WITH {E.SQL}, r AS (SELECT priority, id FROM e2 UNION ALL SELECT priority, id FROM e1 WHERE id % 997 = 0) SELECT priority AS area, count(*) AS records, count(DISTINCT id) AS ids, count(*) - count(DISTINCT id) AS repeated FROM r GROUP BY 1")
def edition_unique_id(spark, d):
    """Records, ids and repeated ids in every area of an edition into which some records came twice."""
    rows = E.edition(spark, d, 2).select("priority", "id").unionByName(E.edition(spark, d, 1).where("id % 997 = 0").select("priority", "id"))
    own = rows.groupBy(F.col("priority").alias("area"), "id").agg(F.count(F.lit(1)).alias("n"))
    return own.groupBy("area").agg(F.sum("n").alias("records"), F.count(F.lit(1)).alias("ids"), F.sum(F.col("n") - 1).alias("repeated"))


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'mismatch' WHEN doc_id % 10 = 1 THEN 'unexpected' ELSE 'ok' END AS verdict FROM documents")
def material_digest_check(spark, d):
    """Materials against the digests a manifest expects."""
    docs = E.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    k = F.col("doc_id")
    expected = docs.where(k % 10 != 1).select("doc_id", F.when(k % 10 == 0, F.sha2(F.col("digest"), 256)).otherwise(F.col("digest")).alias("expected"))
    met = docs.join(expected, "doc_id", "left")
    return met.select("doc_id", F.when(F.col("expected").isNull(), "unexpected").when(F.col("expected") == F.col("digest"), "ok").otherwise("mismatch").alias("verdict"))


@query("SELECT c_custkey AS id, '{\"name\":\"' || c_name || '\",\"segment\":\"' || c_mktsegment || '\"}' AS metadata FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def version_metadata_lookup(spark, d):
    """Metadata of the records that a set of ids asks for, as JSON."""
    asked = E.table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    rows = E.table(spark, d, "customer").join(asked, "c_custkey", "left_semi")
    return rows.select(F.col("c_custkey").alias("id"), F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))).alias("metadata"))


@query("SELECT p_type AS name, count(*) AS n FROM part WHERE p_type NOT IN ('ECONOMY', 'SMALL', 'PROMO') GROUP BY 1")
def unsupported_names(spark, d):
    """Names outside the list of supported ones; a conversion stops if there are any."""
    allowed = F.broadcast(spark.createDataFrame([("ECONOMY",), ("SMALL",), ("PROMO",)], "p_type string"))
    return E.table(spark, d, "part").join(allowed, "p_type", "left_anti").groupBy(F.col("p_type").alias("name")).agg(F.count(F.lit(1)).alias("n"))


_SIG = "SELECT l_orderkey AS id, sha256(string_agg(DISTINCT CAST(l_partkey AS VARCHAR) || ':' || CAST(l_suppkey AS VARCHAR), chr(10) ORDER BY CAST(l_partkey AS VARCHAR) || ':' || CAST(l_suppkey AS VARCHAR))) AS sig FROM {0} GROUP BY 1"


@query(f"WITH o AS ({_SIG.format('(SELECT * FROM lineitem WHERE l_linenumber <> 7)')}), n AS ({_SIG.format('(SELECT * FROM lineitem WHERE l_suppkey % 50 <> 0)')}) SELECT coalesce(o.id, n.id) AS id, o.sig AS old_signature, n.sig AS new_signature FROM o FULL JOIN n ON o.id = n.id WHERE o.sig IS DISTINCT FROM n.sig")
def reference_signature(spark, d):
    """Records whose set of (image, target) references changed."""
    rows = E.table(spark, d, "lineitem")
    text = F.concat_ws(":", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))
    sig = lambda df, out: df.groupBy(F.col("l_orderkey").alias("id")).agg(T.set_hash(F.collect_set(text)).alias(out))
    both = sig(rows.where("l_linenumber <> 7"), "old_signature").join(sig(rows.where("l_suppkey % 50 <> 0"), "new_signature"), "id", "full")
    return both.where(~F.col("old_signature").eqNullSafe(F.col("new_signature")))


@query(
    """WITH f AS (SELECT l_orderkey AS polygon, l_linenumber AS ring, l_partkey FROM lineitem), t AS (SELECT l_orderkey AS polygon, l_linenumber AS ring, min(l_suppkey) AS image FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY 1, 2),
p AS (SELECT o_orderkey AS polygon, o_custkey % 10 AS image FROM orders WHERE o_orderkey % 3 = 0)
SELECT f.polygon, f.ring, f.l_partkey AS part, coalesce(t.image, p.image) AS image, CASE WHEN t.image IS NOT NULL THEN 'ring' WHEN p.image IS NOT NULL THEN 'polygon' ELSE 'none' END AS source FROM f LEFT JOIN t USING (polygon, ring) LEFT JOIN p ON p.polygon = f.polygon"""
)
def face_texture(spark, d):
    """Faces with the texture of their ring, else of their polygon."""
    rows = E.table(spark, d, "lineitem")
    f = rows.select(F.col("l_orderkey").alias("polygon"), F.col("l_linenumber").alias("ring"), F.col("l_partkey").alias("part"))
    t = rows.where("l_linenumber % 2 = 0").groupBy(F.col("l_orderkey").alias("polygon"), F.col("l_linenumber").alias("ring")).agg(F.min("l_suppkey").alias("r_image"))
    p = E.table(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("polygon"), (F.col("o_custkey") % 10).alias("p_image"))
    met = f.join(t, ["polygon", "ring"], "left").join(p, "polygon", "left")
    source = F.when(F.col("r_image").isNotNull(), "ring").when(F.col("p_image").isNotNull(), "polygon").otherwise("none")
    return met.select("polygon", "ring", "part", F.coalesce("r_image", "p_image").alias("image"), source.alias("source"))
