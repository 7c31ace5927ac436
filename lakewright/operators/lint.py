"""Geometric checks on scanned members."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewright.operators.polygons import ring_crosses
from lakewright.operators.stats import duplicate_groups


def geometric_lint(members: DataFrame) -> DataFrame:
    """(gml_id, severity, code): each error once a record, and duplicate geometry as a warning.

    Ring rules are array functions; only rings of footprints that are otherwise
    sound reach the Python test for crossing edges.
    """
    r = F.col("rings")
    some = lambda rule: F.exists(r, rule)
    pts = lambda x: x["pts"]
    sound = lambda x: pts(x).isNotNull() & (F.size(pts(x)) > 0)
    rules = [
        (some(lambda x: (x["n"] % 3 != 0) | pts(x).isNull()), "coord_count"),
        (some(lambda x: sound(x) & (F.size(pts(x)) < 4)), "too_few_points"),
        (some(lambda x: sound(x) & (F.element_at(pts(x), 1) != F.element_at(pts(x), -1))), "ring_not_closed"),
        (some(lambda x: sound(x) & (F.size(F.array_distinct(pts(x))) < 3)), "degenerate_face"),
    ]
    errors = members.select("gml_id", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(k)) for c, k in rules)))).alias("code"))
    rings = members.select("gml_id", F.explode("rings").alias("r")).where("r.footprint and r.pts is not null and size(r.pts) >= 4")
    crossing = rings.where(ring_crosses("r.pts")).select("gml_id", F.lit("self_intersection").alias("code")).distinct()
    twins = duplicate_groups(members.select("gml_id", "geom_hash"), "gml_id", F.col("geom_hash")).select("gml_id", F.lit("duplicate_geometry").alias("code"))
    out = errors.unionByName(crossing).withColumn("severity", F.lit("error")).unionByName(twins.withColumn("severity", F.lit("warning")))
    return out.select("gml_id", "severity", "code")
