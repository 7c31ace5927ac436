"""Queries on footprints, matches, identity links and spatial partitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakewright.functions import geo
from lakewright.operators import identity as I
from lakewright.operators import layout as L
from lakewright.operators import match as M
from lakewright.plans.binding import query
from lakewright.sources import editions as E
from lakewright.sources.shared import materialise

_PAIRS = """pr AS (SELECT o.id AS o_id, n.id AS n_id, (o.x1 - o.x0) * (o.y1 - o.y0) AS o_area, (n.x1 - n.x0) * (n.y1 - n.y0) AS n_area,
  (least(o.x1, n.x1) - greatest(o.x0, n.x0)) * (least(o.y1, n.y1) - greatest(o.y0, n.y0)) AS inter,
  sqrt(((o.x0 + o.x1) / 2 - (n.x0 + n.x1) / 2) ** 2 + ((o.y0 + o.y1) / 2 - (n.y0 + n.y1) / 2) ** 2) AS centroid_m
  FROM r1 o JOIN r2 n ON o.x0 < n.x1 AND n.x0 < o.x1 AND o.y0 < n.y1 AND n.y0 < o.y1),
pa AS (SELECT *, inter / (o_area + n_area - inter) AS iou FROM pr)"""
_BEST = """mb AS (SELECT o_id, n_id, iou FROM (SELECT *, row_number() OVER (PARTITION BY o_id ORDER BY iou DESC, n_id) AS a, row_number() OVER (PARTITION BY n_id ORDER BY iou DESC, o_id) AS b FROM {0})
  WHERE a = 1 AND b = 1 AND iou >= 0.5)"""
_FP = "concat_ws(',', CAST(round(x0 * 1000) AS BIGINT), CAST(round(y0 * 1000) AS BIGINT), CAST(round(x1 * 1000) AS BIGINT), CAST(round(y1 * 1000) AS BIGINT))"


def _fp_sql(old: str, new: str, out: str) -> str:
    u = lambda t, c: f"SELECT {_FP} AS fp, min(id) AS {c} FROM {t} GROUP BY fp HAVING count(*) = 1"
    return f"{out} AS (SELECT o_id, n_id FROM ({u(old, 'o_id')}) JOIN ({u(new, 'n_id')}) USING (fp))"


def _split_sql(whole: str, piece: str) -> str:
    """Wholes of which two or more pieces take a tenth each and whose union, slab by slab, covers half."""
    return f"""pc AS (SELECT w.id AS w_id, p.id AS p_id, (w.x1 - w.x0) * (w.y1 - w.y0) AS w_area, greatest(w.x0, p.x0) AS x0, greatest(w.y0, p.y0) AS y0, least(w.x1, p.x1) AS x1, least(w.y1, p.y1) AS y1
  FROM {whole} w JOIN {piece} p ON w.x0 < p.x1 AND p.x0 < w.x1 AND w.y0 < p.y1 AND p.y0 < w.y1),
big AS (SELECT * FROM pc WHERE (x1 - x0) * (y1 - y0) >= 0.1 * w_area), xs AS (SELECT w_id, x0 AS x FROM big UNION SELECT w_id, x1 FROM big),
sl AS (SELECT w_id, x AS a, lead(x) OVER (PARTITION BY w_id ORDER BY x) AS b FROM xs),
co AS (SELECT sl.w_id, b - a AS width, y0, y1, max(y1) OVER (PARTITION BY sl.w_id, a ORDER BY y0, y1, p_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM sl JOIN big USING (w_id) WHERE x0 <= a AND x1 >= b),
un AS (SELECT w_id, sum(width * greatest(0, y1 - greatest(y0, coalesce(top, y0)))) AS u FROM co GROUP BY w_id),
sp AS (SELECT w_id, count(*) AS pieces, string_agg(CAST(p_id AS VARCHAR), ',' ORDER BY p_id) AS ids, round(max(u) / max(w_area), 6) AS coverage FROM big JOIN un USING (w_id) GROUP BY w_id HAVING count(*) >= 2 AND max(u) / max(w_area) >= 0.5)"""


_LINKS = f"""cons AS (SELECT * FROM pa WHERE o_id = n_id AND iou >= 0.5 AND centroid_m <= 2.0), sh AS (SELECT id FROM r1 JOIN r2 USING (id)),
reg AS (SELECT CASE WHEN (SELECT count(*) FROM sh) = 0 THEN CASE WHEN (SELECT count(*) FROM r1) > 0 AND (SELECT count(*) FROM r2) > 0 THEN 'renumbered' ELSE 'continuous' END
  WHEN (SELECT count(*) FROM cons) / (SELECT count(*) FROM sh) >= 0.95 THEN 'continuous' WHEN (SELECT count(*) FROM cons) / (SELECT count(*) FROM sh) < 0.5 THEN 'renumbered' ELSE 'mixed' END AS regime),
byid AS (SELECT cons.* FROM cons, reg WHERE regime <> 'renumbered'),
a1 AS (SELECT * FROM r1 WHERE id NOT IN (SELECT o_id FROM byid)), b1 AS (SELECT * FROM r2 WHERE id NOT IN (SELECT n_id FROM byid)),
{_fp_sql('a1', 'b1', 'fpr')},
p2 AS (SELECT * FROM pa WHERE o_id IN (SELECT id FROM a1) AND n_id IN (SELECT id FROM b1)),
p3 AS (SELECT * FROM p2 WHERE o_id NOT IN (SELECT o_id FROM fpr) AND n_id NOT IN (SELECT n_id FROM fpr)), {_BEST.format('p3')},
spl AS (SELECT o_id FROM p2 WHERE inter >= 0.1 * o_area GROUP BY o_id HAVING count(*) >= 2 AND sum(inter) / max(o_area) >= 0.5),
mrg AS (SELECT n_id FROM p2 WHERE inter >= 0.1 * n_area GROUP BY n_id HAVING count(*) >= 2 AND sum(inter) / max(n_area) >= 0.5),
part AS (SELECT o_id FROM spl UNION SELECT o_id FROM p2 WHERE n_id IN (SELECT n_id FROM mrg) AND inter >= 0.1 * n_area),
fnd AS (SELECT o_id, n_id, 'fingerprint' AS method FROM fpr UNION ALL SELECT o_id, n_id, 'overlap' FROM mb UNION ALL SELECT o_id, n_id, 'same_id' FROM byid),
cmpt AS (SELECT f.o_id, f.n_id, f.method, coalesce(max(p.iou) FILTER (p.o_id <> f.o_id), 0.0::DOUBLE) AS competitor_iou FROM fnd f LEFT JOIN pa p ON p.n_id = f.n_id GROUP BY ALL),
ln AS (SELECT c.o_id, c.n_id, c.method, CASE
  WHEN c.method <> 'same_id' AND (c.o_id IN (SELECT o_id FROM part) OR (regime <> 'renumbered' AND c.o_id <> c.n_id AND pa.iou < 0.9)) THEN 'C'
  WHEN c.method = 'fingerprint' OR (pa.iou >= 0.9 AND centroid_m <= 1.0) THEN 'A'
  WHEN (c.method = 'same_id' OR (pa.iou >= 0.5 AND centroid_m <= 2.0)) AND n_area / o_area BETWEEN 0.67 AND 1.5 AND competitor_iou < 0.2 THEN 'B' ELSE 'C' END AS tier, pa.iou, competitor_iou
  FROM cmpt c JOIN pa USING (o_id, n_id), reg),
un AS (SELECT id AS o_id, CASE WHEN id IN (SELECT id FROM sh) AND id NOT IN (SELECT o_id FROM cons) THEN 'inconsistent_id' WHEN id IN (SELECT o_id FROM part) THEN 'split_or_merge' ELSE 'no_match' END AS method FROM r1 WHERE id NOT IN (SELECT o_id FROM ln)),
bl AS (SELECT * FROM ln UNION ALL SELECT o_id, NULL, method, CASE method WHEN 'no_match' THEN 'D' ELSE 'C' END, NULL, NULL FROM un)"""


def _rects(spark, d):
    return E.footprints(spark, d, 1), E.footprints(spark, d, 2)


def pairs(spark, d):
    return M.overlapping(*_rects(spark, d))


def _round(df, *cols, n=9):
    return df.withColumns({c: F.round(c, n) for c in cols})


@query(f"WITH {E.RECTANGLES}, {_PAIRS} SELECT o_id, n_id, o_area, n_area, inter, round(iou, 9) AS iou, round(centroid_m, 9) AS centroid_m FROM pa")
def overlap_join(spark, d):
    return _round(pairs(spark, d), "iou", "centroid_m")


@query(f"WITH {E.RECTANGLES}, {_fp_sql('r1', 'r2', 'f')} SELECT o_id, n_id FROM f")
def fingerprint_match(spark, d):
    return M.unique_fingerprints(*_rects(spark, d), M.rect_fingerprint())


@query(f"WITH {E.RECTANGLES}, {_PAIRS}, {_BEST.format('pa')} SELECT o_id, n_id, round(iou, 9) AS iou FROM mb")
def mutual_best_iou(spark, d):
    return _round(M.mutual_best(pairs(spark, d)).select("o_id", "n_id", "iou"), "iou")


@query(
    f"""WITH {E.RECTANGLES}, {_PAIRS}, sid AS (SELECT id FROM r1 JOIN r2 USING (id)), a1 AS (SELECT * FROM r1 ANTI JOIN sid USING (id)), b1 AS (SELECT * FROM r2 ANTI JOIN sid USING (id)),
{_fp_sql('a1', 'b1', 'f')}, p2 AS (SELECT * FROM pa WHERE o_id IN (SELECT id FROM a1) AND n_id IN (SELECT id FROM b1) AND o_id NOT IN (SELECT o_id FROM f) AND n_id NOT IN (SELECT n_id FROM f)), {_BEST.format('p2')}
SELECT id AS o_id, id AS n_id, 'same_id' AS method FROM sid UNION ALL SELECT o_id, n_id, 'fingerprint' FROM f UNION ALL SELECT o_id, n_id, 'overlap' FROM mb"""
)
def match_cascade(spark, d):
    return M.cascade(*_rects(spark, d), M.rect_fingerprint())


def _splits(old, new, whole, piece):
    rows = _round(M.split_candidates(M.overlapping(old, new), old, new, whole, piece), "coverage", n=6)
    return rows.withColumn("ids", F.array_join("ids", ","))


@query(f"WITH {E.RECTANGLES}, {E.PIECES}, {_split_sql('r1', 'r3')} SELECT w_id AS o_id, pieces, ids, coverage FROM sp")
def split_candidates(spark, d):
    return _splits(E.footprints(spark, d, 1), E.pieces(spark, d), "o", "n")


@query(f"WITH {E.RECTANGLES}, {E.PIECES}, {_split_sql('r1', 'r3')} SELECT w_id AS n_id, pieces, ids, coverage FROM sp")
def merge_candidates(spark, d):
    """Merges of the way back: the later edition's pieces against the earlier whole."""
    return _splits(E.pieces(spark, d), E.footprints(spark, d, 1), "n", "o")


# what the records of both editions carry besides their footprint
_FACTS = """fo AS (SELECT *, {fp} AS fp, CASE WHEN id % 41 = 0 THEN NULL ELSE 'c' || id % 5 END AS city, id % 13 = 0 AS lod2, id % 7 AS usage, id % 9 AS storeys FROM r1),
fn AS (SELECT *, {fp} AS fp, 'c' || CASE WHEN b % 37 = 0 THEN 9 ELSE b % 5 END AS city, b % 13 = 0 AND b % 26 <> 0 AS lod2, b % 7 + CASE WHEN b % 11 = 0 THEN 1 ELSE 0 END AS usage, CASE WHEN b % 17 = 0 THEN NULL ELSE b % 9 END AS storeys FROM (SELECT *, id % 1000000 AS b FROM r2)),
rc1 AS (SELECT c.*, {far} AS hausdorff_m, concat_ws(',', CASE WHEN n.storeys IS NULL THEN 'storeys' END, CASE WHEN o.usage <> n.usage THEN 'usage' END) AS changed_paths, o.fp <> n.fp AS geometry_changed,
  o.usage <> n.usage OR n.storeys IS NULL AS attributes_changed, o.lod2 <> n.lod2 AS lod_changed, o.id <> n.id AS id_changed, coalesce(o.city, 'unknown') AS old_city, n.city AS new_city FROM ca c JOIN fo o ON o.id = c.o_id JOIN fn n ON n.id = c.n_id)"""


def _to(x: str, y: str, p: str) -> str:
    dx, dy = f"greatest({p}.x0 - {x}, {x} - {p}.x1, 0)", f"greatest({p}.y0 - {y}, {y} - {p}.y1, 0)"
    return f"CASE WHEN {dx} = 0 AND {dy} = 0 THEN least({x} - {p}.x0, {p}.x1 - {x}, {y} - {p}.y0, {p}.y1 - {y}) ELSE sqrt({dx} ** 2 + {dy} ** 2) END"


_CASCADE = f"""sid AS (SELECT id FROM r1 JOIN r2 USING (id)), a1 AS (SELECT * FROM r1 ANTI JOIN sid USING (id)), b1 AS (SELECT * FROM r2 ANTI JOIN sid USING (id)),
{_fp_sql('a1', 'b1', 'f')}, p2 AS (SELECT * FROM pa WHERE o_id IN (SELECT id FROM a1) AND n_id IN (SELECT id FROM b1) AND o_id NOT IN (SELECT o_id FROM f) AND n_id NOT IN (SELECT n_id FROM f)), {_BEST.format('p2')},
ca AS (SELECT id AS o_id, id AS n_id, 'same_id' AS method FROM sid UNION ALL SELECT o_id, n_id, 'fingerprint' FROM f UNION ALL SELECT o_id, n_id, 'overlap' FROM mb)"""
_FAR = "greatest(" + ", ".join(_to(f"{a}.{x}", f"{a}.{y}", b) for a, b in (("o", "n"), ("n", "o")) for x in ("x0", "x1") for y in ("y0", "y1")) + ")"
_RECORDS = f"{E.RECTANGLES}, {_PAIRS}, {_CASCADE}, {_FACTS.format(fp=_FP, far=_FAR)}"


def _records(spark, d):
    """Matches with what differs, and both editions."""
    a, b = _rects(spark, d)
    base = F.col("id") % 1_000_000
    lods = lambda two: F.when(two, F.array(F.lit("2"), F.lit("1"))).otherwise(F.array(F.lit("1")))
    own = {"id": F.col("id"), "fingerprint": M.rect_fingerprint(), **{c: F.col(c) for c in M.RECT}}
    attrs = lambda usage, storeys: F.map_filter(F.create_map(F.lit("usage"), usage.cast("string"), F.lit("storeys"), storeys.cast("string")), lambda k, v: v.isNotNull())
    old = {"city": F.when(base % 41 != 0, F.concat(F.lit("c"), base % 5)), "lods": lods(base % 13 == 0), "attrs": attrs(base % 7, base % 9)}
    new = {"city": F.concat(F.lit("c"), F.when(base % 37 == 0, 9).otherwise(base % 5)), "lods": lods((base % 13 == 0) & (base % 26 != 0)), "attrs": attrs(base % 7 + F.when(base % 11 == 0, 1).otherwise(0), F.when(base % 17 != 0, base % 9))}
    sides = [df.select(*(c.alias(n) for n, c in (own | facts).items())) for df, facts in ((a, old), (b, new))]
    return M.match_records(M.cascade(a, b, M.rect_fingerprint()), *sides, M.rect_hausdorff("o_", "n_")), a, b


def _shapes(spark, d, pieces: bool = False):
    """The footprints turned by the angle of the 3-4-5 triangle, as polygons: no side lies along an axis, areas stay."""
    turned = lambda x, y: F.struct((F.col(x) * 0.6 - F.col(y) * 0.8).alias("a"), (F.col(x) * 0.8 + F.col(y) * 0.6).alias("b"))
    ring = F.array(*(turned(x, y) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0"))))
    sides = E.footprints(spark, d, 1), E.pieces(spark, d) if pieces else E.footprints(spark, d, 2)
    return tuple(df.select("id", F.array(ring).alias("rings")) for df in sides)


@query(f"WITH {E.RECTANGLES}, {_PAIRS} SELECT o_id, n_id, round(o_area, 6) AS o_area, round(n_area, 6) AS n_area, round(inter, 6) AS inter, round(iou, 6) AS iou, round(centroid_m, 6) AS centroid_m FROM pa")
def shape_overlap(spark, d):
    """Overlaps of polygons; the bounding rectangles, which meet far more often, only find the candidates."""
    return _round(M.overlapping(*_shapes(spark, d)), "o_area", "n_area", "inter", "iou", "centroid_m", n=6)


# halves have an IoU of one half to rounding, so the least IoU lies a little below
_SHAPE_CASCADE = _CASCADE.replace("iou >= 0.5", "iou >= 0.49")


@query(f"WITH {E.RECTANGLES}, {_PAIRS.replace('inter / (o_area + n_area - inter)', 'round(inter / (o_area + n_area - inter), 9)')}, {_SHAPE_CASCADE} SELECT * FROM ca")
def shape_cascade(spark, d):
    """Matches of polygons by id, millimetre fingerprint, then mutual best overlap."""
    old, new = _shapes(spark, d)
    return M.cascade(old, new, M.fingerprint_of(old), 0.49)


@query(f"WITH {E.RECTANGLES}, {_fp_sql('r1', 'r2', 'f')} SELECT o_id, n_id FROM f")
def shape_fingerprint_match(spark, d):
    """Polygons whose canonical millimetre form is unique on both sides."""
    old, new = _shapes(spark, d)
    return M.unique_fingerprints(old, new, M.fingerprint_of(old))


@query(f"WITH {E.RECTANGLES}, {E.PIECES}, {_split_sql('r1', 'r3')} SELECT w_id AS o_id, pieces, ids, coverage FROM sp")
def shape_splits(spark, d):
    """Polygons split into slivers, overlapping and oversized pieces, by the area of their union."""
    old, new = _shapes(spark, d, True)
    return _round(M.splits(M.overlapping(old, new), old, new), "coverage", n=6).withColumn("ids", F.array_join("ids", ","))


@query(f"""WITH {E.RECTANGLES}, {_PAIRS}, {_BEST.format('pa').replace('iou >= 0.5', 'iou >= 0.55')} SELECT m.o_id, m.n_id, round(m.iou, 6) AS iou, round(coalesce(max(p.iou) FILTER (p.o_id <> m.o_id), 0), 6) AS competitor_iou
FROM mb m LEFT JOIN pa p ON p.n_id = m.n_id GROUP BY ALL""")
def shape_best(spark, d):
    """Mutually best polygons with their strongest competitor."""
    # read three times below, and each time costs the areas of every pair
    pairs = materialise(M.overlapping(*_shapes(spark, d)).select("o_id", "n_id", F.round("iou", 9).alias("iou")), "pairs")
    best = M.mutual_best(pairs, 0.55)
    return _round(M.competitor(pairs, best).join(best.select("o_id", "n_id", "iou"), ["o_id", "n_id"]), "iou", "competitor_iou", n=6)


@query(f"WITH {_RECORDS} SELECT o_id, n_id, method, round(hausdorff_m, 6) AS hausdorff_m, changed_paths, geometry_changed, attributes_changed, lod_changed, id_changed, old_city, new_city FROM rc1")
def match_records(spark, d):
    """Every match with its distance and what differs."""
    return _round(_records(spark, d)[0], "hausdorff_m", n=6).withColumn("changed_paths", F.array_join("changed_paths", ","))


@query(f"WITH {_RECORDS} SELECT old_city, new_city, count(*) AS n FROM rc1 GROUP BY 1, 2")
def city_transitions(spark, d):
    """How many matched records went from which city to which."""
    return _records(spark, d)[0].groupBy("old_city", "new_city").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {_RECORDS}, spl AS (SELECT o_id FROM pa WHERE inter >= 0.1 * o_area GROUP BY 1 HAVING count(*) >= 2 AND sum(inter) / max(o_area) >= 0.5), mrg AS (SELECT n_id FROM pa WHERE inter >= 0.1 * n_area GROUP BY 1 HAVING count(*) >= 2 AND sum(inter) / max(n_area) >= 0.5),
x AS (SELECT *, geometry_changed OR attributes_changed OR lod_changed OR id_changed AS changed FROM rc1),
c AS (SELECT count(*) AS matched, count(*) FILTER (method = 'same_id') AS by_same_id, count(*) FILTER (method = 'fingerprint') AS by_fingerprint, count(*) FILTER (method = 'overlap') AS by_overlap, count(*) FILTER (changed) AS matched_changed, count(*) FILTER (NOT changed) AS matched_unchanged,
  count(*) FILTER (id_changed) AS id_changed, count(*) FILTER (old_city <> new_city) AS city_changed, count(*) FILTER (geometry_changed) AS geometry_changed, count(*) FILTER (attributes_changed) AS attributes_changed, count(*) FILTER (lod_changed) AS lod_changed,
  count(*) FILTER (NOT geometry_changed) AS equal_1mm, count(*) FILTER (hausdorff_m <= 0.01) AS within_1cm, count(*) FILTER (hausdorff_m <= 0.1) AS within_10cm FROM x),
s AS (SELECT (SELECT count(*) FROM r1) AS old_n, (SELECT count(*) FROM r2) AS new_n, (SELECT count(*) FROM spl) AS split_candidates, (SELECT count(*) FROM mrg) AS merge_candidates)
SELECT *, old_n - matched AS unmatched_old, new_n - matched AS unmatched_new, matched_changed + old_n - matched + new_n - matched AS proposals FROM c, s"""
)
def match_summary(spark, d):
    """One row of counts over the matches of two editions."""
    records, a, b = _records(spark, d)
    pairs = M.overlapping(a, b)
    return M.match_summary(records, a, b, M.split_candidates(pairs, a, b), M.split_candidates(pairs, a, b, "n", "o"))


@query(
    f"""WITH {E.RECTANGLES}, {_PAIRS}, {_BEST.format('pa')} SELECT m.o_id, m.n_id, round(coalesce(max(p.iou) FILTER (p.o_id <> m.o_id), 0), 9) AS competitor_iou
FROM mb m LEFT JOIN pa p ON p.n_id = m.n_id GROUP BY 1, 2"""
)
def competitor_iou(spark, d):
    p = pairs(spark, d)
    return _round(M.competitor(p, M.mutual_best(p)), "competitor_iou")


@query(f"WITH {E.RECTANGLES}, {_PAIRS}, best AS (SELECT *, row_number() OVER (PARTITION BY n_id ORDER BY iou DESC, o_id) AS r FROM pa) SELECT n_id, o_id, round(iou, 9) AS iou FROM best WHERE r = 1")
def best_per_side(spark, d):
    return _round(M.best_per_side(pairs(spark, d), "n_id", "o_id").select("n_id", "o_id", "iou"), "iou")


@query(
    f"""WITH {E.RECTANGLES}, {_PAIRS}, {_LINKS} SELECT (SELECT count(*) FROM sh) AS shared, (SELECT count(*) FROM cons) AS consistent, (SELECT count(*) FROM r1) AS old_n, (SELECT count(*) FROM r2) AS new_n, regime FROM reg"""
)
def id_regime(spark, d):
    a, b = _rects(spark, d)
    return I.id_regime(a, b, M.overlapping(a, b))


@query(f"WITH {E.RECTANGLES}, {_PAIRS}, {_LINKS} SELECT round((SELECT count(*) FROM cons) / (SELECT count(*) FROM sh), 6) AS share, regime FROM reg")
def regime_share(spark, d):
    return id_regime(spark, d).select(F.round(F.col("consistent") / F.col("shared"), 6).alias("share"), "regime")


@query(f"WITH {E.RECTANGLES}, {_PAIRS}, {_LINKS} SELECT o_id, n_id, method, tier, round(iou, 9) AS iou, round(competitor_iou, 9) AS competitor_iou FROM bl")
def boundary_links(spark, d):
    return _round(I.boundary_links(*_rects(spark, d)), "iou", "competitor_iou")


_STEPS = """s1 AS (SELECT a.id AS from_id, b.id AS to_id, CASE WHEN a.key % 29 = 0 THEN 'C' WHEN a.key % 5 = 0 THEN 'B' ELSE 'A' END AS tier, 1 - (a.key % 40) / 100.0::DOUBLE AS iou FROM e1 a JOIN e2 b USING (key)),
s2 AS (SELECT a.id AS from_id, b.id AS to_id, CASE WHEN a.key % 31 = 0 THEN 'C' WHEN a.key % 4 = 0 THEN 'B' ELSE 'A' END AS tier, 1 - (a.key % 30) / 100.0::DOUBLE AS iou FROM e2 a JOIN e3 b USING (key))"""


def _steps(spark, d):
    e = [E.edition(spark, d, n).select("key", F.col("id").alias("id")) for n in (1, 2, 3)]
    k = F.col("key")

    def step(a, b, cut, weak, spread):
        tier = F.when(k % cut == 0, "C").when(k % weak == 0, "B").otherwise("A")
        # two columns of a wide file look small enough to broadcast at any number of rows
        return a.withColumnRenamed("id", "from_id").join(b.withColumnRenamed("id", "to_id").hint("merge"), "key").select("from_id", "to_id", tier.alias("tier"), (F.lit(1.0) - (k % spread) / 100.0).alias("iou"))

    return [step(e[0], e[1], 29, 5, 40), step(e[1], e[2], 31, 4, 30)]


@query(
    f"""WITH {E.SQL}, {_STEPS} SELECT s1.from_id AS start, CASE WHEN s1.tier <> 'C' AND s2.tier IN ('A', 'B') THEN s2.to_id END AS finish,
  CASE WHEN s1.tier = 'C' THEN 'A' WHEN coalesce(s2.tier, 'C') = 'C' THEN s1.tier ELSE greatest(s1.tier, s2.tier) END AS tier,
  round(CASE WHEN s1.tier = 'C' THEN NULL WHEN coalesce(s2.tier, 'C') = 'C' THEN s1.iou ELSE least(s1.iou, s2.iou) END, 9) AS iou,
  CASE WHEN s1.tier = 'C' THEN 0 WHEN coalesce(s2.tier, 'C') = 'C' THEN 1 END AS cut
FROM s1 LEFT JOIN s2 ON s2.from_id = s1.to_id"""
)
def link_chain(spark, d):
    return _round(I.compose_chain(_steps(spark, d)), "iou")


# every part moves to the next number: a chain of 1200 links up to a number that stays, longer ones that
# end at a free number, two-cycles, and links to themselves
_MOVES = """mv AS (SELECT p_partkey AS from_id, p_partkey + CASE WHEN p_partkey % 3000 = 2500 THEN 10000000 ELSE CASE p_partkey % 50 WHEN 6 THEN 4 WHEN 7 THEN 1 WHEN 8 THEN -1 WHEN 9 THEN 0 ELSE 1 END END AS to_id
  FROM part WHERE p_partkey % 3000 <> 1200)"""


def _moves(spark, d):
    k = F.col("p_partkey")
    p = E.table(spark, d, "part").where(k % 3000 != 1200)
    at = k % 50
    step = F.when(k % 3000 == 2500, 10_000_000).when(at == 6, 4).when(at == 8, -1).when(at == 9, 0).otherwise(1)
    return p.select(k.alias("from_id"), (k + step).alias("to_id"))


@query(
    f"""WITH RECURSIVE {_MOVES}, o AS (SELECT from_id, to_id, 0 AS step FROM mv WHERE to_id = from_id OR to_id NOT IN (SELECT from_id FROM mv)
  UNION ALL SELECT mv.from_id, mv.to_id, o.step + 1 FROM mv JOIN o ON mv.to_id = o.from_id WHERE mv.to_id <> mv.from_id)
SELECT from_id, to_id, step FROM o UNION ALL SELECT from_id, to_id, NULL FROM mv WHERE from_id NOT IN (SELECT from_id FROM o)"""
)
def link_order(spark, d):
    return I.link_order(_moves(spark, d))


@query(
    f"""WITH RECURSIVE {_MOVES}, r AS (SELECT mv.from_id, mv.to_id FROM mv WHERE to_id IN (SELECT p_partkey FROM part) AND to_id NOT IN (SELECT from_id FROM mv)
  UNION SELECT mv.from_id, mv.to_id FROM mv JOIN r ON mv.to_id = r.from_id) SELECT from_id, to_id FROM r"""
)
def link_collision(spark, d):
    return I.collisions(_moves(spark, d), E.table(spark, d, "part").select(F.col("p_partkey").alias("id")))


@query(
    f"""WITH {E.SQL}, {_STEPS}, m AS (SELECT e1.id, e1.key, coalesce(s1.to_id, e1.id) AS new_id FROM e1 LEFT JOIN s1 ON s1.from_id = e1.id)
SELECT id, new_id, count(*) OVER (PARTITION BY new_id) AS n FROM m"""
)
def apply_links(spark, d):
    return I.apply_links(E.edition(spark, d, 1).select("id"), _steps(spark, d)[0]).select("id", "new_id", "n")


@query(
    f"""WITH RECURSIVE {_MOVES}, e AS (SELECT * FROM mv WHERE from_id <> to_id), w AS (SELECT from_id AS head, from_id AS id FROM e WHERE from_id NOT IN (SELECT to_id FROM e)
  UNION ALL SELECT w.head, e.to_id FROM w JOIN e ON e.from_id = w.id)
SELECT id, min(id) OVER (PARTITION BY head) AS canonical FROM w UNION ALL SELECT from_id, least(from_id, to_id) FROM mv WHERE from_id NOT IN (SELECT id FROM w)"""
)
def alias_closure(spark, d):
    return I.alias_closure(_moves(spark, d))


@query(
    f"""WITH {E.SQL}, {_STEPS}, c AS (SELECT s1.from_id AS start, s2.to_id AS finish, greatest(s1.tier, s2.tier) AS tier FROM s1 JOIN s2 ON s2.from_id = s1.to_id WHERE s1.tier <> 'C' AND s2.tier <> 'C'),
s AS (SELECT * FROM c WHERE start <> finish)
SELECT (SELECT count(*) FROM s1) AS first_boundary, (SELECT count(*) FROM s2) AS second_boundary, (SELECT count(*) FROM c WHERE start = finish) AS unchanged, count(*) AS links,
  count(*) FILTER (tier = 'A') AS tier_a, count(*) FILTER (tier = 'B') AS tier_b FROM s"""
)
def identity_manifest(spark, d):
    """One row of counts of a manifest over three editions."""
    steps = _steps(spark, d)
    chain = I.compose_chain(steps).where("finish is not null")
    moved = F.col("start") != F.col("finish")
    out = chain.agg(
        F.count_if(~moved).alias("unchanged"), F.count_if(moved).alias("links"), F.count_if(moved & (F.col("tier") == "A")).alias("tier_a"), F.count_if(moved & (F.col("tier") == "B")).alias("tier_b")
    )
    sizes = [s.agg(F.count(F.lit(1)).alias(n)) for s, n in zip(steps, ("first_boundary", "second_boundary"))]
    return sizes[0].join(F.broadcast(sizes[1]), F.lit(True)).join(F.broadcast(out), F.lit(True))


@query(
    """WITH l AS (SELECT s_suppkey AS id, (s_suppkey * 37 % 1000) * 1.0::DOUBLE + CASE WHEN s_suppkey % 7 = 0 THEN 9000.0 ELSE 0.0 END AS x, (s_suppkey * 91 % 1000) * 1.0::DOUBLE AS y FROM supplier),
r AS (SELECT p_partkey AS id, (p_partkey * 53 % 1000) * 1.0::DOUBLE AS x, (p_partkey * 29 % 1000) * 1.0::DOUBLE AS y FROM part),
k AS (SELECT l.id, r.id AS nearest_id, (l.x - r.x) ** 2 + (l.y - r.y) ** 2 AS d2, row_number() OVER (PARTITION BY l.id ORDER BY (l.x - r.x) ** 2 + (l.y - r.y) ** 2, r.id) AS n FROM l, r),
f AS (SELECT id, nearest_id, d2 FROM k WHERE n = 1)
SELECT * FROM f UNION ALL SELECT NULL, id, NULL FROM r WHERE id NOT IN (SELECT nearest_id FROM f)"""
)
def nearest_removed(spark, d):
    """Added records with the nearest removed one at any distance, and removed ones that none claims."""
    xy = lambda c, a, b, far: [F.col(c).alias("id"), ((F.col(c) * a % 1000) * 1.0 + far).cast("double").alias("x"), ((F.col(c) * b % 1000) * 1.0).cast("double").alias("y")]
    left = E.table(spark, d, "supplier").select(*xy("s_suppkey", 37, 91, F.when(F.col("s_suppkey") % 7 == 0, 9000.0).otherwise(0.0)))
    right = E.table(spark, d, "part").select(*xy("p_partkey", 53, 29, F.lit(0.0)))
    return M.nearest(left, right, 50.0)


_MESH = "m AS (SELECT DISTINCT CAST(53394500 + p_partkey % 80 AS VARCHAR) || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE CAST(1 + p_partkey % 4 AS VARCHAR) END AS code FROM part)"


@query(
    f"""WITH {_MESH}, g AS (SELECT code, length(code) = 9 AS q, CASE WHEN length(code) = 9 THEN CAST(substr(code, 9, 1) AS INTEGER) ELSE 0 END AS n,
  CAST(substr(code, 1, 2) AS INTEGER) / 1.5 + CAST(substr(code, 5, 1) AS INTEGER) / 12 + CAST(substr(code, 7, 1) AS INTEGER) / 120 AS south,
  CAST(substr(code, 3, 2) AS INTEGER) + 100 + CAST(substr(code, 6, 1) AS INTEGER) / 8 + CAST(substr(code, 8, 1) AS INTEGER) / 80 AS west FROM m)
SELECT code, round(CAST(south + CASE WHEN n >= 3 THEN 1 / 240 ELSE 0 END AS DOUBLE), 9) AS south, round(CAST(west + CASE WHEN n IN (2, 4) THEN 1 / 160 ELSE 0 END AS DOUBLE), 9) AS west,
  round(CASE WHEN q THEN 1 / 240 ELSE 1 / 120 END, 9) AS height, round(CASE WHEN q THEN 1 / 160 ELSE 1 / 80 END, 9) AS width FROM g"""
)
def mesh_bounds(spark, d):
    k = F.col("p_partkey")
    code = F.concat((F.lit(53394500) + k % 80).cast("string"), F.when(k % 3 == 0, "").otherwise((F.lit(1) + k % 4).cast("string")))
    own = E.table(spark, d, "part").select(code.alias("code")).distinct()
    return own.select("code", *(F.round(c.cast("double"), 9).alias(n) for n, c in geo.mesh_bounds(F.col("code")).items()))


def _quad(x: str, y: str) -> str:
    return f"greatest(0, least(x1, {x[1]}) - greatest(x0, {x[0]})) * greatest(0, least(y1, {y[1]}) - greatest(y0, {y[0]}))"


_HALF = ("-1e12", "2003.0"), ("2003.0", "1e12")


@query(
    f"""WITH {E.RECTANGLES}, q AS (SELECT id, {_quad(_HALF[0], ('-1e12', '103.0'))} AS a1, {_quad(_HALF[1], ('-1e12', '103.0'))} AS a2,
  {_quad(_HALF[0], ('103.0', '1e12'))} AS a3, {_quad(_HALF[1], ('103.0', '1e12'))} AS a4 FROM r1)
SELECT id, CAST(CASE greatest(a1, a2, a3, a4) WHEN a1 THEN 1 WHEN a2 THEN 2 WHEN a3 THEN 3 ELSE 4 END AS INTEGER) AS cell FROM q"""
)
def quadrant_by_area(spark, d):
    return L.quadrant_by_area(E.footprints(spark, d, 1), F.lit(2003.0), F.lit(103.0))


@query(
    f"""WITH {E.RECTANGLES} SELECT id, CAST(greatest(least(floor(((x0 + x1) / 2 - 100) / 500), 3), 0) AS INTEGER) AS tile_x, CAST(greatest(least(floor(((y0 + y1) / 2 - 10) / 500), 3), 0) AS INTEGER) AS tile_y FROM r1"""
)
def utm_tile_split(spark, d):
    return L.tile_split(E.footprints(spark, d, 1), 100.0, 10.0, 500.0, 4)


@query(f"WITH {E.RECTANGLES} SELECT id, x0, y0, x1, y1 FROM r1 WHERE (x0 + x1) / 2 BETWEEN 500 AND 1500 AND (y0 + y1) / 2 BETWEEN 20 AND 150")
def bbox_extract(spark, d):
    return L.inside_box(E.footprints(spark, d, 1), 500.0, 20.0, 1500.0, 150.0)


@query(f"WITH {E.RECTANGLES} SELECT CAST(floor(x0 / 250) AS BIGINT) AS cell, count(*) AS n, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM r1 GROUP BY 1")
def envelope_by_cell(spark, d):
    return L.envelope(E.footprints(spark, d, 1).withColumn("cell", F.floor(F.col("x0") / 250)), "cell")


@query(f"WITH {E.RECTANGLES} SELECT CAST(floor(floor(x0 / 250) / 4) AS BIGINT) AS parent, count(*) AS n, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM r1 GROUP BY 1")
def merge_tiles(spark, d):
    return L.merge_parts(E.footprints(spark, d, 1), F.floor(F.floor(F.col("x0") / 250) / 4))


@query(f"WITH {E.RECTANGLES} SELECT id, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM r1")
def bbox_center(spark, d):
    return E.footprints(spark, d, 1).select("id", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"))


@query(f"WITH {E.RECTANGLES} SELECT id, 5 AS points, (x1 - x0) * (y1 - y0) AS area FROM r1")
def ring_points(spark, d):
    """Rings parsed from coordinate lists: closed, with their area."""
    c = {k: F.col(k).cast("string") for k in ("x0", "y0", "x1", "y1")}
    text = F.concat_ws(" ", *(x for p in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1")) for x in (c[p[0]], c[p[1]], F.lit("0"))))
    own = E.footprints(spark, d, 1).select("id", geo.pos_list(text).alias("ring"))
    return own.select("id", F.size("ring").alias("points"), geo.shoelace(F.col("ring.a"), F.col("ring.b")).alias("area"))


@query(
    f"""WITH {E.RECTANGLES}, c AS (SELECT id, CAST(floor(x0 / 250) AS BIGINT) AS cell FROM r1), t AS (SELECT l_orderkey AS target, l_partkey AS ref FROM lineitem)
SELECT cell, count(*) AS n, count(DISTINCT ref) AS refs FROM t LEFT JOIN c ON c.id = t.ref GROUP BY cell"""
)
def target_routing(spark, d):
    """References sent to the cell of what they name; dangling ones have a null cell."""
    cells = E.footprints(spark, d, 1).select("id", F.floor(F.col("x0") / 250).alias("cell"))
    refs = E.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("target"), F.col("l_partkey").alias("ref"))
    return L.route_targets(refs, cells).groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ref").alias("refs"))


@query(
    f"""WITH {E.RECTANGLES}, w AS (SELECT floor(id / 20) AS building, id, x1 - x0 AS width, y1 - y0 AS height FROM r1)
SELECT CAST(building AS BIGINT) AS building, id, coalesce(sum(height) OVER (PARTITION BY building ORDER BY height DESC, width DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS y, width, height FROM w"""
)
def atlas_offsets(spark, d):
    walls = E.footprints(spark, d, 1).select(F.floor(F.col("id") / 20).alias("building"), "id", (F.col("x1") - F.col("x0")).alias("width"), (F.col("y1") - F.col("y0")).alias("height"))
    return L.atlas_offsets(walls, "building")


@query("SELECT l_orderkey AS owner, l_linenumber AS ord, l_orderkey || '_p' || (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1) AS planned, l_partkey AS part FROM lineitem")
def planned_ids(spark, d):
    rows = E.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("owner"), F.col("l_linenumber").alias("ord"), F.col("l_partkey").alias("part"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("o"))
    return L.planned_ids(rows, "owner", "o").select("owner", "ord", "planned", "part")


_GRID = "g AS (SELECT p_partkey AS id, 300000.0::DOUBLE + (p_partkey % 400) * 1000 AS e, 3900000.0::DOUBLE + (p_partkey % 97) * 2000 AS n FROM part)"


@query(f"WITH {_GRID} SELECT id, round(n / 1000 * 111320.0::DOUBLE, 3) AS y, round(e / 1000 * (111320.0::DOUBLE * cos(radians(35.71::DOUBLE))), 3) AS x FROM g")
def equirectangular(spark, d):
    k = F.col("p_partkey")
    x, y = geo.local_xy((F.lit(3900000.0) + (k % 97) * 2000) / 1000, (F.lit(300000.0) + (k % 400) * 1000) / 1000)
    return E.table(spark, d, "part").select(k.alias("id"), F.round(y, 3).alias("y"), F.round(x, 3).alias("x"))


@query(
    f"""WITH {_GRID}, k AS (SELECT 6378137.0::DOUBLE AS a, (1 / 298.257222101::DOUBLE) * (2 - 1 / 298.257222101::DOUBLE) AS e2),
k2 AS (SELECT *, (1 - sqrt(1 - e2)) / (1 + sqrt(1 - e2)) AS e1, e2 / (1 - e2) AS ep2 FROM k),
m AS (SELECT g.*, k2.*, n / (0.9996::DOUBLE * a * (1 - e2 / 4 - 3 * e2 ** 2 / 64 - 5 * e2 ** 3 / 256)) AS mu FROM g, k2),
p AS (SELECT *, mu + (3 * e1 / 2 - 27 * e1 ** 3 / 32) * sin(2 * mu) + (21 * e1 ** 2 / 16 - 55 * e1 ** 4 / 32) * sin(4 * mu) + (151 * e1 ** 3 / 96) * sin(6 * mu) + (1097 * e1 ** 4 / 512) * sin(8 * mu) AS phi FROM m),
q AS (SELECT *, ep2 * cos(phi) ** 2 AS c1, tan(phi) ** 2 AS t1, a / sqrt(1 - e2 * sin(phi) ** 2) AS n1, a * (1 - e2) / (1 - e2 * sin(phi) ** 2) ** 1.5 AS r1, (e - 500000) / (a / sqrt(1 - e2 * sin(phi) ** 2) * 0.9996::DOUBLE) AS d FROM p)
SELECT id, round(degrees(phi - (n1 * tan(phi) / r1) * (d ** 2 / 2 - (5 + 3 * t1 + 10 * c1 - 4 * c1 ** 2 - 9 * ep2) * d ** 4 / 24 + (61 + 90 * t1 + 298 * c1 + 45 * t1 ** 2 - 252 * ep2 - 3 * c1 ** 2) * d ** 6 / 720)), 7) AS lat,
  round(54 * 6 - 183 + degrees((d - (1 + 2 * t1 + c1) * d ** 3 / 6 + (5 - 2 * c1 + 28 * t1 - 3 * c1 ** 2 + 8 * ep2 + 24 * t1 ** 2) * d ** 5 / 120) / cos(phi)), 7) AS lon FROM q"""
)
def utm_inverse(spark, d):
    k = F.col("p_partkey")
    lat, lon = geo.utm_inverse(F.lit(300000.0) + (k % 400) * 1000, F.lit(3900000.0) + (k % 97) * 2000, F.lit(54))
    return E.table(spark, d, "part").select(k.alias("id"), F.round(lat, 7).alias("lat"), F.round(lon, 7).alias("lon"))


@query(f"WITH {_GRID} SELECT id, round(e, 3) AS e, round(n, 3) AS n FROM g")
def utm_roundtrip(spark, d):
    """Coordinates taken to degrees and back, equal to the millimetre."""
    k = F.col("p_partkey")
    lat, lon = geo.utm_inverse(F.lit(300000.0) + (k % 400) * 1000, F.lit(3900000.0) + (k % 97) * 2000, F.lit(54))
    own = E.table(spark, d, "part").select(k.alias("id"), lat.alias("lat"), lon.alias("lon"))
    e, n = geo.utm_forward(F.col("lat"), F.col("lon"), F.lit(54))
    return own.select("id", F.round(e, 3).alias("e"), F.round(n, 3).alias("n"))


def _lcc_iter(n: int) -> str:
    out = "pi() / 2 - 2 * atan(tp)"
    steps = [f"i0 AS (SELECT *, {out} AS phi0 FROM b)"]
    for i in range(n):
        steps.append(f"i{i + 1} AS (SELECT *, pi() / 2 - 2 * atan(tp * ((1 - e * sin(phi{i})) / (1 + e * sin(phi{i}))) ** (e / 2)) AS phi{i + 1} FROM i{i})")
    return ", ".join(steps)


@query(
    f"""WITH g AS (SELECT p_partkey AS id, 900000.0::DOUBLE + (p_partkey % 400) * 500 AS x_ft, 120000.0::DOUBLE + (p_partkey % 97) * 1500 AS y_ft FROM part),
c0 AS (SELECT sqrt((1 / 298.257222101::DOUBLE) * (2 - 1 / 298.257222101::DOUBLE)) AS e, radians(41 + 2 / 60) AS p1, radians(40 + 40 / 60) AS p2, radians(40 + 10 / 60) AS p0, 1200 / 3937 AS ft, 6378137.0::DOUBLE AS a),
c1 AS (SELECT *, cos(p1) / sqrt(1 - e ** 2 * sin(p1) ** 2) AS m1, cos(p2) / sqrt(1 - e ** 2 * sin(p2) ** 2) AS m2, tan(pi() / 4 - p1 / 2) / ((1 - e * sin(p1)) / (1 + e * sin(p1))) ** (e / 2) AS t1,
  tan(pi() / 4 - p2 / 2) / ((1 - e * sin(p2)) / (1 + e * sin(p2))) ** (e / 2) AS t2, tan(pi() / 4 - p0 / 2) / ((1 - e * sin(p0)) / (1 + e * sin(p0))) ** (e / 2) AS t0 FROM c0),
c2 AS (SELECT *, (ln(m1) - ln(m2)) / (ln(t1) - ln(t2)) AS n FROM c1), c3 AS (SELECT *, m1 / (n * t1 ** n) AS f FROM c2), c4 AS (SELECT *, a * f * t0 ** n AS rho0 FROM c3),
b0 AS (SELECT g.id, c4.*, x_ft * ft - 984250.0::DOUBLE * ft AS x, rho0 - y_ft * ft AS y FROM g, c4), b AS (SELECT *, (sqrt(x * x + y * y) / (a * f)) ** (1 / n) AS tp FROM b0), {_lcc_iter(6)}
SELECT id, round(degrees(phi6), 7) AS lat, round(degrees(atan2(x, y) / n + radians(-74.0::DOUBLE)), 7) AS lon FROM i6"""
)
def lcc_inverse(spark, d):
    k = F.col("p_partkey")
    lat, lon = geo.lcc_inverse(F.lit(900000.0) + (k % 400) * 500, F.lit(120000.0) + (k % 97) * 1500)
    return E.table(spark, d, "part").select(k.alias("id"), F.round(lat, 7).alias("lat"), F.round(lon, 7).alias("lon"))


@query(
    """SELECT p_partkey AS id, round(p_size * CASE p_partkey % 4 WHEN 0 THEN 0.3048::DOUBLE WHEN 1 THEN 1200 / 3937 WHEN 2 THEN 1 ELSE 0.3048::DOUBLE END, 6) AS metres FROM part"""
)
def unit_to_metres(spark, d):
    k = F.col("p_partkey") % 4
    uom = F.when(k == 0, "urn:x:ft").when(k == 1, "ftUS").when(k == 2, None).otherwise("u#Foot")
    return E.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.round(geo.metres(F.col("p_size"), uom), 6).alias("metres"))
