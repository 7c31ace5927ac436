"""Spatial and physical partitioning of footprints and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lakewright.functions.geo import clamped_cell, quadrant
from lakewright.operators.match import overlap


def quadrant_by_area(rects: DataFrame, mid_x: Column, mid_y: Column, far: float = 1e12) -> DataFrame:
    """(id, cell): the quadrant that holds most of a footprint, ties to the lowest; without area the centre decides."""
    big, low = F.lit(far), F.lit(-far)
    cells = {1: (low, low, mid_x, mid_y), 2: (mid_x, low, big, mid_y), 3: (low, mid_y, mid_x, big), 4: (mid_x, mid_y, big, big)}
    rows = rects
    for q, (x0, y0, x1, y1) in cells.items():
        rows = rows.withColumns({"_x0": x0, "_y0": y0, "_x1": x1, "_y1": y1}).withColumn(f"_a{q}", overlap("", "_")).drop("_x0", "_y0", "_x1", "_y1")
    most = F.greatest(*(F.col(f"_a{q}") for q in cells))
    best = F.when(F.col("_a1") == most, 1).when(F.col("_a2") == most, 2).when(F.col("_a3") == most, 3).otherwise(4)
    centre = quadrant((F.col("y0") + F.col("y1")) / 2, (F.col("x0") + F.col("x1")) / 2, mid_y, mid_x)
    return rows.select("id", F.when(most > 0, best).otherwise(centre).cast("int").alias("cell"))


def tile_split(rects: DataFrame, low_x: float, low_y: float, size: float, n: int) -> DataFrame:
    """(id, tile_x, tile_y) by the centre of the box, clamped to the tile's edge cells."""
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    return rects.select("id", clamped_cell(cx, F.lit(low_x), F.lit(size), n).alias("tile_x"), clamped_cell(cy, F.lit(low_y), F.lit(size), n).alias("tile_y"))


def inside_box(rects: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Records whose centre lies in the box, edges included."""
    return rects.where(((F.col("x0") + F.col("x1")) / 2).between(x0, x1) & ((F.col("y0") + F.col("y1")) / 2).between(y0, y1))


def envelope(rects: DataFrame, *group: str) -> DataFrame:
    return rects.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")
    )


def regroup(targets: DataFrame, key: str, order: str, target: str) -> DataFrame:
    """(key, first, n, targets): targets of equal keys joined in their order; groups are small by nature."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(order, target))), lambda s: s[target].cast("string"))
    return targets.groupBy(key).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"), F.array_join(ordered, ",").alias("targets"))


def atlas_offsets(walls: DataFrame, group: str) -> DataFrame:
    """Walls (group, id, width, height) stacked by falling height, width, then id: y offset and scale to fit."""
    w = Window.partitionBy(group).orderBy(F.desc("height"), F.desc("width"), "id")
    y = F.coalesce(F.sum("height").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return walls.select(group, "id", y.alias("y"), "width", "height")


def planned_ids(parts: DataFrame, owner: str, order: str) -> DataFrame:
    """Identifiers ``<owner>_p<i>`` for parts that have none, numbered in order."""
    i = F.row_number().over(Window.partitionBy(owner).orderBy(order)) - 1
    return parts.withColumn("planned", F.concat(F.col(owner).cast("string"), F.lit("_p"), i.cast("string")))


def route_targets(targets: DataFrame, cells: DataFrame) -> DataFrame:
    """Targets (ref) with the cell of what they refer to; null where nothing has that id."""
    return targets.join(cells.select(F.col("id").alias("ref"), "cell"), "ref", "left")


def merge_parts(parts: DataFrame, parent: Column) -> DataFrame:
    """Cells of one parent with a common envelope."""
    return envelope(parts.withColumn("parent", parent), "parent")
