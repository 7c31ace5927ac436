"""Matching records across editions: by id, by fingerprint, by overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lakewright.operators import polygons
from lakewright.sources.shared import materialise

RECT = ("x0", "y0", "x1", "y1")
MIN_IOU, PADDING = 0.5, 2.0
PIECE, COVERAGE = 0.1, 0.5


def area(p: str = "") -> Column:
    return (F.col(f"{p}x1") - F.col(f"{p}x0")) * (F.col(f"{p}y1") - F.col(f"{p}y0"))


def overlap(a: str, b: str) -> Column:
    """Area of the intersection of rectangles with column prefixes ``a`` and ``b``."""
    w = F.least(f"{a}x1", f"{b}x1") - F.greatest(f"{a}x0", f"{b}x0")
    h = F.least(f"{a}y1", f"{b}y1") - F.greatest(f"{a}y0", f"{b}y0")
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def rect_fingerprint() -> Column:
    """Corners rounded to millimetres, as text."""
    return F.concat_ws(",", *(F.round(F.col(c) * 1000).cast("long").cast("string") for c in RECT))


def has_shapes(df: DataFrame) -> bool:
    """Whether footprints are polygons (id, rings) and not rectangles (id, x0, y0, x1, y1)."""
    return "rings" in df.columns


#: Extents along the diagonals, beside those along the axes.
DIAGONAL = ("u0", "u1", "v0", "v1")


def bounds(df: DataFrame) -> DataFrame:
    """Polygons (id, rings: array<array<struct<a, b>>>) with their extents along the axes and the diagonals."""
    along = {"x": lambda p: p["a"], "y": lambda p: p["b"], "u": lambda p: p["a"] + p["b"], "v": lambda p: p["a"] - p["b"]}
    ends = {f"{k}{n}": end(F.transform(F.flatten("rings"), f)) for k, f in along.items() for n, end in enumerate((F.array_min, F.array_max))}
    return df.select("id", "rings", *(c.alias(n) for n, c in ends.items()))


def fingerprint_of(df: DataFrame) -> Column:
    return polygons.shape_key("rings") if has_shapes(df) else rect_fingerprint()


def overlapping_shapes(old: DataFrame, new: DataFrame, cell: float = 50.0) -> DataFrame:
    """As :func:`overlapping` for polygons: extents along the axes and the diagonals only find the candidates.

    The rings travel with the rectangles, so that no join by id follows and each pair keeps its own
    shapes where an id repeats.  IoU is rounded to 12 digits, so that ties are decided by id and not by
    the last bit of a sum.
    """
    near = meeting(bounds(old), bounds(new), cell, ("rings", *DIAGONAL))
    # the slack is above the rounding of a sum of coordinates
    for k in "uv":
        near = near.where(F.greatest(f"o_{k}0", f"n_{k}0") <= F.least(f"o_{k}1", f"n_{k}1") + 1e-6)
    met = near.select("o_id", "n_id", polygons.measures("o_rings", "n_rings").alias("m"))
    return met.select("o_id", "n_id", "m.*").where("inter > 0").withColumn("iou", F.round("iou", 12))


#: Grid levels of :func:`meeting`; each has cells four times as long as the one before.
LEVELS = 12


def meeting(old: DataFrame, new: DataFrame, cell: float, kept: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of overlapping rectangles with their area of overlap as ``inter``; the columns of either side,
    among them ``kept``, are under the prefixes ``o_`` and ``n_``.

    A rectangle is dealt to the cells that it touches on a grid whose cells are no shorter than its
    longer side, so to four at most (but on the coarsest level), and the sides meet in an equi join on
    level and cell.  For the meeting of levels, the new side is dealt to the level of its own size and
    probed from every level that the old side has, each pair on the coarser of its two levels.  A pair
    is kept only in the cell that holds the lower left corner of its intersection, so no later distinct
    is needed.  With ``kept`` columns of unknown width the sides are merged: the size that Spark assumes
    for an array is far below the real one, and a side broadcast by it would not fit the driver.
    """

    def levelled(df: DataFrame, p: str) -> DataFrame:
        longest = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
        level = F.greatest(F.least(F.ceil(F.log(F.greatest(longest, F.lit(1e-9)) / cell) / F.log(F.lit(4.0))), F.lit(LEVELS - 1)), F.lit(0)).cast("int")
        return df.select(F.col("id").alias(f"{p}id"), *(F.col(c).alias(f"{p}{c}") for c in (*RECT, *kept)), level.alias(f"{p}level"))

    size = F.pow(F.lit(4.0), F.col("level")) * cell

    def dealt(df: DataFrame, p: str) -> DataFrame:
        cells = lambda lo, hi: F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size))
        return df.withColumn("cx", F.explode(cells(f"{p}x0", f"{p}x1"))).withColumn("cy", F.explode(cells(f"{p}y0", f"{p}y1")))

    def all_levels(df: DataFrame, p: str, met: DataFrame) -> DataFrame:
        """Each row on its own level, and on every coarser one that the other side has."""
        levels = F.filter(F.col("_levels"), lambda n: n >= F.col(f"{p}level"))
        both = F.array_distinct(F.concat(F.array(f"{p}level"), levels))
        return dealt(df.join(F.broadcast(met), F.lit(True)).withColumn("level", F.explode(both)).drop("_levels"), p)

    o, n = levelled(old, "o_"), levelled(new, "n_")
    # at most LEVELS numbers each
    named = lambda df, p: df.agg(F.array_sort(F.collect_set(f"{p}level")).alias("_levels"))
    cells = all_levels(n, "n_", named(o, "o_"))
    pairs = all_levels(o, "o_", named(n, "n_")).join(cells.hint("merge") if kept else cells, ["level", "cx", "cy"]).where(F.col("level") == F.greatest("o_level", "n_level"))
    inter = overlap("o_", "n_")
    home = (F.floor(F.greatest("o_x0", "n_x0") / size) == F.col("cx")) & (F.floor(F.greatest("o_y0", "n_y0") / size) == F.col("cy"))
    return pairs.withColumn("inter", inter).where((F.col("inter") > 0) & home)


def overlapping(old: DataFrame, new: DataFrame, cell: float = 50.0) -> DataFrame:
    """Pairs of overlapping footprints: o_id, n_id, both areas, inter, iou, centroid_m."""
    if has_shapes(old):
        return overlapping_shapes(old, new, cell)
    pairs = meeting(old, new, cell)
    centre = lambda p, a: (F.col(f"{p}{a}0") + F.col(f"{p}{a}1")) / 2
    dx, dy = centre("o_", "x") - centre("n_", "x"), centre("o_", "y") - centre("n_", "y")
    return pairs.select(
        "o_id",
        "n_id",
        area("o_").alias("o_area"),
        area("n_").alias("n_area"),
        "inter",
        (F.col("inter") / (area("o_") + area("n_") - F.col("inter"))).alias("iou"),
        F.sqrt(dx * dx + dy * dy).alias("centroid_m"),
    )


def mutual_best(pairs: DataFrame, minimum: float = MIN_IOU) -> DataFrame:
    """Pairs that are each other's best by IoU, ties by id, with at least ``minimum``."""
    by_old = F.row_number().over(Window.partitionBy("o_id").orderBy(F.desc("iou"), "n_id"))
    by_new = F.row_number().over(Window.partitionBy("n_id").orderBy(F.desc("iou"), "o_id"))
    return pairs.withColumn("_a", by_old).withColumn("_b", by_new).where((F.col("_a") == 1) & (F.col("_b") == 1) & (F.col("iou") >= minimum)).drop("_a", "_b")


def best_per_side(pairs: DataFrame, side: str, other: str) -> DataFrame:
    """The best partner of each value of ``side``."""
    rank = F.row_number().over(Window.partitionBy(side).orderBy(F.desc("iou"), other))
    return pairs.withColumn("_r", rank).where("_r = 1").drop("_r")


def unique_fingerprints(old: DataFrame, new: DataFrame, fingerprint: Column) -> DataFrame:
    """(o_id, n_id) whose fingerprint is unique on both sides."""

    def unique(df: DataFrame, out: str) -> DataFrame:
        return df.select(F.col("id").alias(out), fingerprint.alias("fp")).where("fp is not null").groupBy("fp").agg(F.min(out).alias(out), F.count(F.lit(1)).alias("c")).where("c = 1").drop("c")

    return unique(old, "o_id").join(unique(new, "n_id"), "fp").select("o_id", "n_id")


def cascade(old: DataFrame, new: DataFrame, fingerprint: Column, minimum: float = MIN_IOU) -> DataFrame:
    """(o_id, n_id, method): by id, then fingerprint, then mutual best overlap, each on what is left."""
    same = old.select(F.col("id").alias("o_id")).join(new.select(F.col("id").alias("n_id")), F.col("o_id") == F.col("n_id"))
    old1 = old.join(same, F.col("id") == F.col("o_id"), "left_anti")
    new1 = new.join(same, F.col("id") == F.col("n_id"), "left_anti")
    prints = unique_fingerprints(old1, new1, fingerprint)
    old2 = old1.join(prints, F.col("id") == F.col("o_id"), "left_anti")
    new2 = new1.join(prints, F.col("id") == F.col("n_id"), "left_anti")
    rest = mutual_best(overlapping(old2, new2), minimum).select("o_id", "n_id")
    return (
        same.withColumn("method", F.lit("same_id"))
        .unionByName(prints.withColumn("method", F.lit("fingerprint")))
        .unionByName(rest.withColumn("method", F.lit("overlap")))
    )


def _union_area(rects: Column) -> Column:
    """Area of the union of array<struct<x0, y0, x1, y1>>: slab by slab between neighbouring x, the merged length in y."""
    xs = F.array_sort(F.array_distinct(F.concat(F.transform(rects, lambda r: r["x0"]), F.transform(rects, lambda r: r["x1"]))))
    zero = F.struct(F.lit(0.0).alias("n"), F.lit(None).cast("double").alias("top"))

    def grow(acc: Column, r: Column) -> Column:
        more = F.greatest(r["y1"] - F.greatest(r["y0"], F.coalesce(acc["top"], r["y0"])), F.lit(0.0))
        return F.struct((acc["n"] + more).alias("n"), F.greatest(acc["top"], r["y1"]).alias("top"))

    def slab(i: Column) -> Column:
        left, right = F.get(xs, i), F.get(xs, i + 1)
        own = F.filter(rects, lambda r: (r["x0"] <= left) & (r["x1"] >= right))
        low = F.array_sort(F.transform(own, lambda r: F.struct(r["y0"].alias("y0"), r["y1"].alias("y1"))))
        return (right - left) * F.aggregate(low, zero, grow, lambda acc: acc["n"])

    slabs = F.when(F.size(xs) > 1, F.sequence(F.lit(0), F.size(xs) - 2)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.aggregate(slabs, F.lit(0.0), lambda total, i: total + slab(i))


def split_candidates(pairs: DataFrame, old: DataFrame, new: DataFrame, whole: str = "o", piece: str = "n", share: float = PIECE, least: float = COVERAGE) -> DataFrame:
    """Rectangles of which two or more pieces each take ``share`` and whose union covers ``least``:
    id, pieces, ids (of the pieces, ascending), coverage.

    Swapping ``whole`` and ``piece`` gives merge candidates.
    """
    sides = {"o": old, "n": new}
    corners = lambda p: sides[p].select(F.col("id").alias(f"{p}_id"), *(F.col(c).alias(f"{p}_{c}") for c in RECT))
    got = pairs.where(F.col("inter") >= share * F.col(f"{whole}_area")).join(corners("o"), "o_id").join(corners("n"), "n_id")
    cut = F.struct(*(f(f"o_{c}", f"n_{c}").alias(c) for c, f in zip(RECT, (F.greatest, F.greatest, F.least, F.least))))
    own = got.groupBy(f"{whole}_id").agg(F.array_sort(F.collect_list(f"{piece}_id")).alias("ids"), F.collect_list(cut).alias("_cuts"), F.max(f"{whole}_area").alias("_area"))
    own = own.where(F.size("ids") >= 2).withColumn("coverage", _union_area(F.col("_cuts")) / F.col("_area"))
    return own.select(f"{whole}_id", F.size("ids").cast("long").alias("pieces"), "ids", "coverage").where(F.col("coverage") >= least)


def split_shapes(pairs: DataFrame, old: DataFrame, new: DataFrame, whole: str = "o", piece: str = "n", share: float = PIECE, least: float = COVERAGE) -> DataFrame:
    """As :func:`split_candidates` for polygons; coverage is rounded to 12 digits."""
    sides = {"o": old, "n": new}
    rings = lambda p, out: sides[p].select(F.col("id").alias(f"{p}_id"), F.col("rings").alias(out))
    got = pairs.where(F.col("inter") >= share * F.col(f"{whole}_area")).join(rings(piece, "_piece"), f"{piece}_id")
    own = got.groupBy(f"{whole}_id").agg(F.array_sort(F.collect_list(f"{piece}_id")).alias("ids"), F.collect_list("_piece").alias("_pieces")).where(F.size("ids") >= 2)
    own = own.join(rings(whole, "_whole"), f"{whole}_id")
    return own.select(f"{whole}_id", F.size("ids").cast("long").alias("pieces"), "ids", F.round(polygons.coverage("_whole", "_pieces"), 12).alias("coverage")).where(F.col("coverage") >= least)


def splits(pairs: DataFrame, old: DataFrame, new: DataFrame, whole: str = "o", piece: str = "n") -> DataFrame:
    return (split_shapes if has_shapes(old) else split_candidates)(pairs, old, new, whole, piece)


def competitor(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """(o_id, n_id, competitor_iou): the best IoU of the new record with any other old one."""
    others = links.select("o_id", "n_id").join(pairs.select(F.col("o_id").alias("other"), "n_id", "iou"), "n_id", "left")
    return others.groupBy("o_id", "n_id").agg(F.coalesce(F.max(F.when(F.col("other") != F.col("o_id"), F.col("iou"))), F.lit(0.0)).alias("competitor_iou"))


def rect_hausdorff(a: str, b: str) -> Column:
    """Hausdorff distance of the outlines of rectangles with column prefixes ``a`` and ``b``, met at a corner of one."""

    def to(px: Column, py: Column, p: str) -> Column:
        x0, y0, x1, y1 = (F.col(f"{p}{c}") for c in RECT)
        dx, dy = F.greatest(x0 - px, px - x1, F.lit(0.0)), F.greatest(y0 - py, py - y1, F.lit(0.0))
        return F.when((dx == 0) & (dy == 0), F.least(px - x0, x1 - px, py - y0, y1 - py)).otherwise(F.sqrt(dx * dx + dy * dy))

    corners = lambda p: [(F.col(f"{p}{x}"), F.col(f"{p}{y}")) for x in ("x0", "x1") for y in ("y0", "y1")]
    return F.greatest(*(to(x, y, b) for x, y in corners(a)), *(to(x, y, a) for x, y in corners(b)))


def match_records(matches: DataFrame, old: DataFrame, new: DataFrame, hausdorff: Column) -> DataFrame:
    """Each match (o_id, n_id, method) with what differs.

    ``old`` and ``new`` have (id, fingerprint, city, lods: array, attrs: map) and what ``hausdorff``
    reads, there under the prefixes ``o_`` and ``n_``.
    """
    side = lambda df, p: df.select(*(F.col(c).alias(f"{p}{c}") for c in df.columns))
    met = matches.join(side(old, "o_"), "o_id").join(side(new, "n_"), "n_id")
    paths = F.array_sort(F.array_union(F.map_keys("o_attrs"), F.map_keys("n_attrs")))
    changed = F.filter(paths, lambda p: ~F.try_element_at("o_attrs", p).eqNullSafe(F.try_element_at("n_attrs", p)))
    return met.select(
        "o_id", "n_id", "method", hausdorff.alias("hausdorff_m"), changed.alias("changed_paths"),
        (~F.col("o_fingerprint").eqNullSafe(F.col("n_fingerprint"))).alias("geometry_changed"), (F.size(changed) > 0).alias("attributes_changed"),
        (F.array_sort("o_lods") != F.array_sort("n_lods")).alias("lod_changed"), (F.col("o_id") != F.col("n_id")).alias("id_changed"),
        F.coalesce("o_city", F.lit("unknown")).alias("old_city"), F.coalesce("n_city", F.lit("unknown")).alias("new_city"),
    )


METHODS = ("same_id", "fingerprint", "overlap")


def match_summary(records: DataFrame, old: DataFrame, new: DataFrame, splits: DataFrame, merges: DataFrame) -> DataFrame:
    """One row of counts over :func:`match_records`, both editions, and the split and merge candidates."""
    any_change = F.col("geometry_changed") | F.col("attributes_changed") | F.col("lod_changed") | F.col("id_changed")
    counts = {f"by_{m}": F.col("method") == m for m in METHODS} | {
        "matched_changed": any_change, "matched_unchanged": ~any_change, "id_changed": F.col("id_changed"), "city_changed": F.col("old_city") != F.col("new_city"), "geometry_changed": F.col("geometry_changed"),
        "attributes_changed": F.col("attributes_changed"), "lod_changed": F.col("lod_changed"), "equal_1mm": ~F.col("geometry_changed"), "within_1cm": F.col("hausdorff_m") <= 0.01, "within_10cm": F.col("hausdorff_m") <= 0.10,
    }
    out = records.agg(F.count(F.lit(1)).alias("matched"), *(F.count_if(c).alias(n) for n, c in counts.items()))
    for df, name in ((old, "old_n"), (new, "new_n"), (splits, "split_candidates"), (merges, "merge_candidates")):
        out = out.join(F.broadcast(df.agg(F.count(F.lit(1)).alias(name))), F.lit(True))
    lost, come = F.col("old_n") - F.col("matched"), F.col("new_n") - F.col("matched")
    return out.withColumns({"unmatched_old": lost, "unmatched_new": come, "proposals": F.col("matched_changed") + lost + come})


def nearest(left: DataFrame, right: DataFrame, cell: float) -> DataFrame:
    """(id, nearest_id, d2): for each point (id, x, y) of ``left`` the nearest of ``right`` at any
    distance, ties by id; a right point may serve several, and those that serve none follow with a
    null id.  Without ``right`` the nearest is null.

    Points of one place count once: a place of ``left`` meets each place of ``right``, which stands for
    its least id.  Places meet those of the nine grid cells around them.  A place whose nearest lies
    within one cell is done; the others go on with cells of twice the size.
    """
    points, right = left.select("id", "x", "y"), materialise(right.select("id", "x", "y"), "right")
    ids = right.select(F.col("id").alias("nearest_id"))
    left, right = points.select("x", "y").distinct(), materialise(right.groupBy("x", "y").agg(F.min("id").alias("id")), "places")
    spans = [F.max(c) - F.min(c) for c in ("x", "y")]
    extent = left.unionByName(right.select("x", "y")).agg(F.greatest(*spans).alias("e")).first()["e"] or 0.0
    todo, done = materialise(left, "left"), None
    while True:
        whole = cell >= extent
        at = [F.floor(F.col(c) / cell).alias(k) for c, k in (("x", "cx"), ("y", "cy"))]
        r = right.select(F.col("id").alias("r_id"), F.col("x").alias("rx"), F.col("y").alias("ry"), *at)
        around = F.explode(F.array(*(F.lit(i) for i in (-1, 0, 1))))
        probe = todo.select("x", "y", *at).withColumn("dx", around).withColumn("dy", around)
        probe = probe.withColumn("cx", F.col("cx") + F.col("dx")).withColumn("cy", F.col("cy") + F.col("dy"))
        d2 = (F.col("x") - F.col("rx")) * (F.col("x") - F.col("rx")) + (F.col("y") - F.col("ry")) * (F.col("y") - F.col("ry"))
        best = probe.join(r, ["cx", "cy"]).groupBy("x", "y").agg(F.min(F.struct(d2.alias("d2"), "r_id")).alias("b"))
        met = todo.join(best, ["x", "y"], "left").select("x", "y", F.col("b.r_id").alias("nearest_id"), F.col("b.d2").alias("d2"))
        near = F.lit(True) if whole else F.coalesce(F.col("d2") <= cell * cell, F.lit(False))
        met = materialise(met.withColumn("near", near), "met")
        found = met.where("near").select("x", "y", "nearest_id", "d2")
        done = found if done is None else done.unionByName(found)
        if whole or met.where("not near").isEmpty():
            break
        todo, cell = met.where("not near").select("x", "y"), cell * 2
    unclaimed = ids.join(done.select("nearest_id"), "nearest_id", "left_anti")
    done = points.join(done, ["x", "y"], "left").select("id", "nearest_id", "d2")
    return done.unionByName(unclaimed.select(F.lit(None).cast(done.schema["id"].dataType).alias("id"), "nearest_id", F.lit(None).cast("double").alias("d2")))
