"""Matching on polygon footprints that their bounding rectangles would judge otherwise."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lakewright.operators import identity as I
from lakewright.operators import match as M
from lakewright.operators import polygons as P

SHAPE = "id long, rings array<array<struct<a: double, b: double>>>"


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def frame(spark, rows):
    return spark.createDataFrame([(i, [[(float(x), float(y)) for x, y in ring] for ring in rings]) for i, rings in rows], SHAPE)


ELL = [(0, 0), (10, 0), (10, 2), (2, 2), (2, 10), (0, 10)]


def test_area_overlap_and_centre(spark):
    old = frame(spark, [(1, [ELL]), (2, [box(100, 0, 110, 10), box(102, 2, 108, 8)])])
    # 11 lies in the notch, 12 in the hole; 13 turns the ring and moves nothing
    new = frame(spark, [(11, [box(4, 4, 9, 9)]), (12, [box(103, 3, 107, 7)]), (13, [[*ELL[2:][::-1], *ELL[:2][::-1]]])])
    rows = {(r.o_id, r.n_id): r for r in M.overlapping(old, new, 4.0).collect()}
    assert set(rows) == {(1, 13)}
    assert tuple(rows[1, 13])[2:] == pytest.approx((36, 36, 36, 1, 0))
    assert P.middle([box(0, 0, 4, 2), box(0, 0, 2, 2)]) == pytest.approx((3, 1))
    assert {(r.o_id, r.n_id, r.method) for r in M.cascade(old, new, M.fingerprint_of(old)).collect()} == {(1, 13, "fingerprint")}
    # all of one extent, but not of one shape
    assert M.cascade(frame(spark, [(1, [ELL])]), frame(spark, [(5, [box(0, 0, 10, 10)])]), M.fingerprint_of(old)).count() == 0


def test_split_takes_the_union(spark):
    old = frame(spark, [(1, [box(0, 0, 10, 10)]), (2, [box(50, 0, 60, 10)]), (3, [box(90, 0, 100, 10)])])
    # of 1: the same 30 % twice; of 2: two halves; of 3: a half, and 0.5 % by one that lies in it whole
    new = [(11, [box(0, 0, 3, 10)]), (12, [box(0, 0, 3, 10)]), (21, [box(50, 0, 55, 10)]), (22, [box(55, 0, 60, 10)]), (31, [box(90, 0, 97, 10)]), (32, [box(98, 0, 98.5, 1)])]
    new = frame(spark, new)
    got = {r.o_id: (r.pieces, r.coverage) for r in M.split_shapes(M.overlapping(old, new), old, new).collect()}
    assert got == {2: (2, pytest.approx(1.0))}
    back = {r.n_id for r in M.split_shapes(M.overlapping(new, old), new, old, "n", "o").collect()}
    assert back == {2}


def test_boundary_links_of_polygons(spark):
    old = frame(spark, [(1, [ELL]), (2, [box(50, 0, 60, 10)]), (3, [box(90, 0, 100, 10)])])
    new = frame(spark, [(11, [ELL]), (21, [box(50, 0, 55, 10)]), (22, [box(55, 0, 60, 10)]), (31, [box(90.5, 0, 100.5, 10)])])
    got = {r.o_id: (r.n_id, r.method, r.tier) for r in I.boundary_links(old, new).collect()}
    assert got == {1: (11, "fingerprint", "A"), 2: (21, "overlap", "C"), 3: (31, "overlap", "A")}


def test_rectangles_as_polygons_agree(spark):
    from lakewright.sources import editions as E

    rect = [E.footprints(spark, "/root/testdata/sf0.001", n) for n in (1, 2)]
    at = lambda x, y: F.struct(F.col(x).cast("double").alias("a"), F.col(y).cast("double").alias("b"))
    ring = F.array(at("x0", "y0"), at("x1", "y0"), at("x1", "y1"), at("x0", "y1"))
    shape = [r.select("id", F.array(ring).alias("rings")) for r in rect]
    rows = lambda df: sorted(tuple(round(v, 6) for v in r) for r in df.collect())
    assert rows(M.overlapping(*shape)) == rows(M.overlapping(*rect))


def test_pairs_of_polygons_keep_their_own_shapes(spark):
    # two new shapes share an id and both overlap the old one
    old, new = frame(spark, [(1, [box(0, 0, 10, 10)])]), frame(spark, [(11, [box(0, 0, 4, 10)]), (11, [box(5, 0, 10, 10)])])
    pairs = M.overlapping(old, new)
    assert sorted(r.inter for r in pairs.collect()) == pytest.approx([40, 50])
    # shapes are wider than Spark assumes, so no side is sent to the driver
    assert "BroadcastHashJoin" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_convex_polygons_agree_with_the_sweep():
    import math
    import random

    rnd = random.Random(3)

    def polygon(x, y):
        turns = sorted(rnd.uniform(0, 2 * math.pi) for _ in range(rnd.randint(3, 7)))
        return [(x + 6 * math.cos(t), y + 4 * math.sin(t)) for t in turns][:: rnd.choice((1, -1))]

    for _ in range(300):
        a, b = polygon(1e5, 2e5), polygon(1e5 + rnd.uniform(0, 9), 2e5 + rnd.uniform(0, 9))
        assert P.convex([a]) and P.convex([[*b, b[0]]])
        total = [0.0, 0.0, 0.0]
        for on, size, _, _ in P._sweep([[a], [b]]):
            total = [t + size * hit for t, hit in zip(total, (0 in on, 1 in on, len(on) == 2))]
        assert P.overlap_areas([a], [b]) == pytest.approx(tuple(total), abs=1e-7)
    star = [(math.cos(4 * math.pi * i / 5), math.sin(4 * math.pi * i / 5)) for i in range(5)]
    assert P.convex([star]) is None and P.convex([ELL]) is None and P.convex([[(0, 0), (2, 0), (4, 0)]]) is None
    # shapes that share a wall do not overlap
    wall = [[(x * 0.6 - y * 0.8, x * 0.8 + y * 0.6) for x, y in box(100_000 + at, 70_000.1, 100_000 + at + 10.1, 70_009)] for at in (0, 10.1)]
    assert P.overlap_areas([wall[0]], [wall[1]])[2] == 0
