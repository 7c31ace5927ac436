"""Queries of statistics, drift, distributions and sizes."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakewright.functions import text as T
from lakewright.operators import layout as L
from lakewright.operators import stats as S
from lakewright.plans.binding import query
from lakewright.sources import editions as E

_READ = """rd AS (SELECT event_type AS name, CASE WHEN event_id % 17 = 0 THEN 9999.0::DOUBLE WHEN event_id % 19 = 0 THEN -9999.0::DOUBLE ELSE value END AS value, event_id FROM events)"""
_STATS = """SELECT name, count(*) AS total, count(*) FILTER (abs(value) <> 9999) AS valid, count(*) FILTER (abs(value) = 9999) AS sentinel, round(count(*) FILTER (abs(value) = 9999) / count(*), 4) AS unknown_rate,
  round(CAST(avg(CAST(value AS DECIMAL(18,4))) FILTER (abs(value) <> 9999) AS DOUBLE), 3) AS mean, min(value) FILTER (abs(value) <> 9999) AS min, max(value) FILTER (abs(value) <> 9999) AS max FROM {0} GROUP BY name"""


def _readings(spark, d):
    e = F.col("event_id")
    v = F.when(e % 17 == 0, 9999.0).when(e % 19 == 0, -9999.0).otherwise(F.col("value"))
    return E.table(spark, d, "events").select(F.col("event_type").alias("name"), v.alias("value"), "event_id")


@query(f"WITH {_READ} {_STATS.format('rd')}")
def numeric_stats(spark, d):
    return S.numeric_stats(_readings(spark, d))


@query(f"WITH {_READ} SELECT event_id, name, abs(value) = 9999 AS sentinel, CASE WHEN abs(value) = 9999 THEN NULL ELSE value END AS known FROM rd")
def sentinel_flags(spark, d):
    v = F.col("value")
    return _readings(spark, d).select("event_id", "name", T.is_sentinel(v).alias("sentinel"), T.known(v).alias("known"))


_NOW = "nw AS (SELECT CASE WHEN name = 'view' THEN 'impression' ELSE name END AS name, CASE WHEN name = 'error' AND event_id % 3 = 0 THEN 9999.0::DOUBLE WHEN name = 'click' THEN value * 1.5 ELSE value END AS value FROM rd WHERE name <> 'purchase' OR event_id % 2 = 0)"


def _later(spark, d):
    n, v, e = F.col("name"), F.col("value"), F.col("event_id")
    rows = _readings(spark, d).where((n != "purchase") | (e % 2 == 0))
    return rows.select(F.when(n == "view", "impression").otherwise(n).alias("name"), F.when((n == "error") & (e % 3 == 0), 9999.0).when(n == "click", v * 1.5).otherwise(v).alias("value"))


@query(
    f"""WITH {_READ}, {_NOW}, b AS ({_STATS.format('rd')}), c AS ({_STATS.format('nw')}), j AS (SELECT coalesce(b.name, c.name) AS name, b.name IS NOT NULL AS hb, c.name IS NOT NULL AS hc, b.total AS bt, c.total AS ct, b.unknown_rate AS bu, c.unknown_rate AS cu,
  b.mean AS bm, c.mean AS cm, b.max AS bx, c.max AS cx FROM b FULL JOIN c ON b.name = c.name)
SELECT name, 'new' AS metric, NULL::DOUBLE AS base, ct::DOUBLE AS now, 'info' AS severity FROM j WHERE NOT hb
UNION ALL SELECT name, 'missing', bt, NULL, 'warn' FROM j WHERE NOT hc
UNION ALL SELECT name, 'unknown_rate', bu, cu, CASE WHEN cu > bu THEN 'warn' ELSE 'info' END FROM j WHERE hb AND hc AND abs(cu - bu) > 0.05
UNION ALL SELECT name, 'total', bt, ct, CASE WHEN ct < bt THEN 'warn' ELSE 'info' END FROM j WHERE hb AND hc AND abs((ct - bt) / bt) > 0.1
UNION ALL SELECT name, 'mean', bm, cm, 'warn' FROM j WHERE hb AND hc AND ((bm IS NULL) <> (cm IS NULL) OR abs((cm - bm) / abs(nullif(bm, 0))) > 0.1)
UNION ALL SELECT name, 'max', bx, cx, 'warn' FROM j WHERE hb AND hc AND ((bx IS NULL) <> (cx IS NULL) OR abs((cx - bx) / abs(nullif(bx, 0))) > 0.1)"""
)
def drift_findings(spark, d):
    return S.drift(S.numeric_stats(_readings(spark, d)), S.numeric_stats(_later(spark, d)))


@query(
    """SELECT l_returnflag, count(l_extendedprice) AS n, min(l_extendedprice) AS min, quantile_cont(l_extendedprice, 0.1) AS p10, median(l_extendedprice) AS median, quantile_cont(l_extendedprice, 0.9) AS p90,
  max(l_extendedprice) AS max FROM lineitem GROUP BY 1"""
)
def metric_distribution(spark, d):
    return S.distribution(E.table(spark, d, "lineitem"), "l_returnflag", F.col("l_extendedprice"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag), 4) AS rate FROM lineitem GROUP BY 1, 2")
def rate_in_group(spark, d):
    return S.rate_in_group(E.table(spark, d, "lineitem"), "l_returnflag", "l_linestatus")


_SAMPLES = """sm AS (SELECT l_suppkey % 10 AS site, l_orderkey, CAST(avg(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) AS m, CAST(avg(CAST(l_quantity * l_quantity AS DECIMAL(18,4))) AS DOUBLE) AS s, count(*) AS n FROM lineitem GROUP BY 1, 2)"""


def _samples(spark, d):
    q = F.col("l_quantity")
    return E.table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 10).alias("site"), "l_orderkey").agg(
        F.avg(q.cast("decimal(18,4)")).cast("double").alias("m"), F.avg((q * q).cast("decimal(18,4)")).cast("double").alias("s"), F.count(F.lit(1)).alias("n")
    )


@query(f"WITH {_SAMPLES} SELECT site, CAST(sum(n) AS BIGINT) AS n, round(sum(m * n) / sum(n), 4) AS mean, round(sqrt(greatest(sum(s * n) / sum(n) - (sum(m * n) / sum(n)) ** 2, 0)), 4) AS deviation FROM sm GROUP BY site")
def weighted_stats(spark, d):
    return S.weighted_stats(_samples(spark, d), "site", "m", "s", "n")


@query(f"WITH {_SAMPLES}, w AS (SELECT site, CAST(sum(n) AS BIGINT) AS n, sum(m * n) / sum(n) AS a, sqrt(greatest(sum(s * n) / sum(n) - (sum(m * n) / sum(n)) ** 2, 0)) AS b FROM sm GROUP BY site) SELECT site, n, round(a / greatest(1, b), 3) AS contrast FROM w")
def tone_stats(spark, d):
    """Mean over deviation, the latter at least one."""
    w = S.weighted_stats(_samples(spark, d), "site", "m", "s", "n")
    q = F.sum(F.col("m") * F.col("n")) / F.sum("n")
    s = F.sqrt(F.greatest(F.sum(F.col("s") * F.col("n")) / F.sum("n") - q * q, F.lit(0.0)))
    del w
    return _samples(spark, d).groupBy("site").agg(F.sum("n").alias("n"), F.round(q / F.greatest(F.lit(1.0), s), 3).alias("contrast"))


@query("SELECT CAST(i AS INTEGER) AS level, CAST(round(255 * (i / 255.0::DOUBLE) ** 0.8::DOUBLE) AS INTEGER) AS tone FROM range(256) t(i)")
def tone_lut(spark, d):
    i = F.col("id")
    return spark.range(256).select(i.cast("int").alias("level"), F.round(F.pow(i / 255.0, F.lit(0.8)) * 255).cast("int").alias("tone"))


@query(
    """WITH h AS (SELECT doc_id, sha256(text) AS g FROM documents), r AS (SELECT *, count(*) OVER (PARTITION BY g) AS copies FROM h)
SELECT a.doc_id, a.copies, (SELECT array_to_string(list_slice(list_sort(list(b.doc_id)), 1, 3), ',') FROM r b WHERE b.g = a.g AND b.doc_id <> a.doc_id) AS others FROM r a WHERE copies > 1"""
)
def duplicate_geometry(spark, d):
    """Records that share a content hash, with up to three of the others."""
    return S.duplicate_groups(E.table(spark, d, "documents"), "doc_id", F.sha2("text", 256))


@query(
    """SELECT CASE WHEN strlen(text) >= 5000 THEN 'large' WHEN strlen(text) >= 500 THEN 'medium' ELSE 'small' END AS category, count(*) AS files, CAST(sum(strlen(text)) AS BIGINT) AS bytes,
  round(sum(strlen(text)) / (SELECT sum(strlen(text)) FROM documents), 4) AS share FROM documents GROUP BY 1"""
)
def size_breakdown(spark, d):
    n = F.octet_length("text")
    category = F.when(n >= 5000, "large").when(n >= 500, "medium").otherwise("small")
    return S.size_breakdown(E.table(spark, d, "documents"), category, n.cast("long"))


@query(
    """SELECT l_orderkey AS image, min(l_orderkey * 10 + l_linenumber) AS first, count(*) AS n, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_orderkey * 10 + l_linenumber, l_partkey) AS targets
FROM lineitem GROUP BY 1"""
)
def texture_regroup(spark, d):
    rows = E.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("image"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), "l_partkey")
    return L.regroup(rows, "image", "pos", "l_partkey").select("image", "first", "n", "targets")


@query("SELECT a.r_name AS region, count(*) AS customers, CAST(count(*) FILTER (c_acctbal < 0) AS BIGINT) AS negative, min(c_custkey) AS least FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region a ON n_regionkey = r_regionkey GROUP BY 1")
def municipality_profile(spark, d):
    """Counts of records by the area they belong to."""
    n = E.table(spark, d, "nation").join(E.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("region"))
    rows = E.table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("region").agg(F.count(F.lit(1)).alias("customers"), F.count_if(F.col("c_acctbal") < 0).alias("negative"), F.min("c_custkey").alias("least"))


@query(
    """WITH c AS (SELECT * FROM customer WHERE c_nationkey = 3), o AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c))
SELECT (SELECT count(*) FROM c) AS records, (SELECT count(*) FROM o) AS refs, (SELECT count(*) FROM o ANTI JOIN c ON o.o_custkey = c.c_custkey) AS dangling,
  (SELECT sha256(string_agg(h, chr(10) ORDER BY s)) FROM (SELECT substr(sha256(v), 1, 3) AS s, sha256(string_agg(v, chr(10) ORDER BY v)) AS h FROM (SELECT CAST(c_custkey AS VARCHAR) AS v FROM c) GROUP BY 1)) AS digest"""
)
def municipality_extract(spark, d):
    """One area cut out, with its references, the dangling ones and a digest of its ids."""
    c = E.table(spark, d, "customer").where("c_nationkey = 3").select("c_custkey")
    o = E.table(spark, d, "orders").select("o_orderkey", "o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    lost = o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left_anti").agg(F.count(F.lit(1)).alias("dangling"))
    head = c.agg(F.count(F.lit(1)).alias("records")).join(F.broadcast(T.sliced_set_hash(c.select(F.col("c_custkey").cast("string").alias("v")), "v", "digest")), F.lit(True))
    return head.join(F.broadcast(o.agg(F.count(F.lit(1)).alias("refs"))), F.lit(True)).join(F.broadcast(lost), F.lit(True))


@query("SELECT l_orderkey AS id, l_linenumber AS part, l_linenumber AS lod FROM lineitem WHERE l_linenumber < 2")
def strip_detail(spark, d):
    """Geometry rows without those of the second level of detail or more."""
    path = F.concat(F.lit("lod"), F.col("l_linenumber").cast("string"), F.lit("Solid"))
    rows = E.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("part"), F.col("l_linenumber").alias("lod"), path.alias("path"))
    return rows.where(~F.col("path").rlike("^lod([2-9]|[1-9][0-9])")).drop("path")


@query("SELECT nationkey, count(*) AS n, string_agg(DISTINCT 'lod' || lod, ',' ORDER BY 'lod' || lod) AS lods FROM (SELECT c_nationkey AS nationkey, c_custkey % (1 + c_nationkey % 4) AS lod FROM customer) GROUP BY 1")
def lod_set(spark, d):
    """Levels of detail present in each group of paths."""
    lod = F.concat(F.lit("lod"), (F.col("c_custkey") % (F.lit(1) + F.col("c_nationkey") % 4)).cast("string"), F.lit("MultiSurface"))
    rows = E.table(spark, d, "customer").select(F.col("c_nationkey").alias("nationkey"), lod.alias("path"))
    return rows.groupBy("nationkey").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set(F.regexp_extract("path", "^(lod[0-9])", 1))), ",").alias("lods"))
