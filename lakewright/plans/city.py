"""Operators bound to city-model files: diff, statistics, lint and code distribution by path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.functions import geo
from lakewright.functions import text as T
from lakewright.functions.verdicts import edition_status
from lakewright.operators import diff as D
from lakewright.operators import lint
from lakewright.operators import semantics as S
from lakewright.operators import stats
from lakewright.plans.rules import MAX_HEIGHT_M, MAX_STOREYS
from lakewright.sources import gml


def members(spark: SparkSession, path: str) -> DataFrame:
    """Buildings of the files under ``path``; of an id in several files the last file's."""
    found = gml.scan_files(gml.read_files(spark, path))
    last = found.groupBy("gml_id").agg(F.max("file").alias("file"))
    return found.join(last, ["gml_id", "file"], "left_semi")


def values(found: DataFrame) -> DataFrame:
    """(gml_id, path, name, value, list, uom) of every attribute."""
    name = T.local_name(F.col("path"))
    return gml.attributes(found).select("gml_id", "path", name.alias("name"), "value", F.regexp_extract("code_space", r"([^/]*)$", 1).alias("list"), "uom")


def building_diff(spark: SparkSession, old: str, new: str) -> DataFrame:
    """(gml_id, status, new_id, geometry_changed, changes) between two sets of files.

    status: added, deleted, modified, unchanged or renamed (the id alone changed,
    and the content is unique on both sides).
    """
    a, b = members(spark, old), members(spark, new)
    attrs = lambda m: values(m).select(F.col("gml_id").alias("id"), "path", "value")
    changes = D.attribute_diff(attrs(a), attrs(b), "id")
    per = changes.groupBy(F.col("id").alias("gml_id")).agg(F.array_sort(F.collect_list(F.struct("path", "old", "new"))).alias("changes"))
    raw = lambda m: m.select("gml_id", F.sha2(F.to_json(F.struct(F.array_sort("attrs").alias("a"), "geom_hash"), {"ignoreNullFields": "false"}), 256).alias("sig"))
    renames = D.unique_renames(raw(a), raw(b), "gml_id", F.col("sig"))
    geometry = a.select("gml_id", F.col("geom_hash").alias("g_old"), F.lit(True).alias("o")).join(b.select("gml_id", F.col("geom_hash").alias("g_new"), F.lit(True).alias("n")), "gml_id", "full")
    moved = ~F.col("g_old").eqNullSafe(F.col("g_new"))
    rows = geometry.join(per, "gml_id", "left")
    both = F.col("o").isNotNull() & F.col("n").isNotNull()
    status = edition_status(F.col("o").isNotNull(), F.col("n").isNotNull(), ~moved & F.col("changes").isNull())
    out = rows.select("gml_id", status.alias("status"), F.when(both, moved).alias("geometry_changed"), F.when(both, F.col("changes")).alias("changes"))
    out = out.join(renames, F.col("gml_id") == F.col("old_id"), "left")
    came = renames.select(F.col("new_id").alias("gml_id"))
    folded = out.withColumn("status", F.when(F.col("old_id").isNotNull(), "renamed").otherwise(F.col("status")))
    return folded.join(came, "gml_id", "left_anti").select("gml_id", "status", "new_id", "geometry_changed", "changes")


def code_lists(spark: SparkSession, path: str) -> DataFrame:
    return gml.scan_code_lists(gml.read_files(spark, path))


def building_stats(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Numeric statistics of the first value of each named attribute."""
    own = values(members(spark, path)).where(F.col("name").isin(*names))
    first = own.groupBy("gml_id", "name").agg(F.min_by("value", "path").alias("value"))
    return stats.numeric_stats(first.select("name", F.col("value").try_cast("double").alias("value")))


def building_codes(spark: SparkSession, path: str, lists: str) -> DataFrame:
    """Counts and rates of every code, by element and list."""
    own = values(members(spark, path)).where("list is not null and list <> ''")
    return stats.code_distribution(own.select(F.col("name").alias("element"), "list", F.col("value").alias("code")), code_lists(spark, lists))


def building_lint(spark: SparkSession, path: str, lists: str | None = None) -> DataFrame:
    """(gml_id, severity, code, detail): geometry errors, and warnings on heights, storeys and codes."""
    found = members(spark, path)
    shape = lint.geometric_lint(found).withColumn("detail", F.lit(None).cast("string"))
    own = values(found)
    v = F.col("value").try_cast("double")
    usual = own.where(v.isNotNull() & ~T.is_sentinel(v))
    height = usual.where("name = 'measuredHeight'")
    storeys = usual.where("name in ('storeysAboveGround', 'storeysBelowGround')")
    warn = lambda df, code: df.select("gml_id", F.lit("warning").alias("severity"), F.lit(code).alias("code"), F.concat_ws(" = ", "name", "value").alias("detail"))
    out = (
        shape.unionByName(warn(height.where(v <= 0), "nonpositive_height"))
        .unionByName(warn(height.where((v > 0) & (geo.metres(v, F.col("uom")) > MAX_HEIGHT_M)), "height_out_of_range"))
        .unionByName(warn(storeys.where(v > MAX_STOREYS), "storeys_out_of_range"))
    )
    if lists is None:
        return out
    coded = own.where("list is not null and list <> ''").select("gml_id", "name", "list", F.col("value").alias("code"))
    bad = S.invalid_codes(coded, code_lists(spark, lists))
    hit = coded.join(bad, ["name", "list", "code"], "left_semi").select("gml_id", F.lit("warning").alias("severity"), F.lit("invalid_code").alias("code0"), F.concat_ws(" = ", "name", "code").alias("detail"))
    return out.unionByName(hit.withColumnRenamed("code0", "code").distinct())
