"""Scenarios of single operators with hand-computed results."""

from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lakewright.functions import geo
from lakewright.functions import text as T
from lakewright.operators import diff as D
from lakewright.operators import history as H
from lakewright.operators import identity as I
from lakewright.operators import match as M
from lakewright.operators import polygons as P
from lakewright.operators import semantics as S
from lakewright.operators import stats as St
from lakewright.operators.planner import family_plan, review_lanes
from lakewright.sources import gml
from lakewright.sources import sinks

NUMBERS = ["1", "1.0", "01", "+5", "-0", "-0.0", ".5", "-.5", "5.", "000", "0.10", "13.80", "6.00", "abc", "", "1.2.3", "--1", "007.700", "100", "0", "-12.3400"]


def test_numbers_equal_decimal(spark):
    got = {r.t: r.n for r in spark.createDataFrame([(n,) for n in NUMBERS], "t string").select("t", T.norm_num(F.col("t")).alias("n")).collect()}
    for n in NUMBERS:
        try:
            want = format(Decimal(n).normalize(), "f")
        except ArithmeticError:
            want = n
        assert got[n] == want


def attrs(spark, rows):
    return spark.createDataFrame(rows, "id string, path string, value string")


def test_attribute_edit_and_number_noise(spark):
    old = attrs(spark, [("b", "/storeys", "9999"), ("b", "/h", "13.8"), ("gone", "/h", "1")])
    new = attrs(spark, [("b", "/storeys", "4"), ("b", "/h", "13.80"), ("new", "/h", None)])
    assert {(r.id, r.path, r.old, r.new) for r in D.attribute_diff(old, new, "id").collect()} == {("b", "/storeys", "9999", "4"), ("gone", "/h", "1", None)}


def test_missing_side_is_all_added_or_deleted(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "2")], "id string, v string")
    none = a.limit(0)
    assert {r.status for r in D.edition_diff(none, a, "id", ["v"]).collect()} == {"added"}
    assert {r.status for r in D.edition_diff(a, none, "id", ["v"]).collect()} == {"deleted"}
    assert {r.status: r.n for r in D.status_counts(D.edition_diff(a, a, "id", ["v"])).collect()} == {"added": 0, "deleted": 0, "modified": 0, "unchanged": 2}


def test_rename_needs_unique_content(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "2")], "id string, v string")
    new = spark.createDataFrame([("x", "1"), ("y", "2"), ("z", "2")], "id string, v string")
    assert [(r.old_id, r.new_id) for r in D.unique_renames(old, new, "id", F.col("v")).collect()] == [("a", "x")]
    assert {(r.old_id, r.new_id) for r in D.greedy_renames(old, new, "id", F.col("v")).collect()} == {("a", "x"), ("b", "y"), ("c", "z")}


def test_set_hash_ignores_order_and_counts_repeats(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "a"], ["a", "b", "b"], [])], "a array<string>, b array<string>, c array<string>, d array<string>")
    r = df.select(*(T.set_hash(F.col(c)).alias(c) for c in "abcd")).first()
    assert r.a == r.b != r.c and r.d is None


def test_three_way_outcomes(spark):
    row = lambda *r: spark.createDataFrame([("b", k, v) for k, v in r], "id string, key string, value string")
    base = row(("s", "9999"), ("a", "1"), ("c", "1"), ("gone", "1"), ("q", "1"), ("i", "1"), ("u", "0"))
    cur = row(("s", "4"), ("a", "6"), ("c", "5"), ("gone", "2"), ("q", "2"), ("i", "2"), ("u", "0"))
    new = row(("s", "9999"), ("a", "6"), ("c", "9"), ("q0", "1"), ("q1", "1"), ("u", "0"))
    succ = spark.createDataFrame([("gone", None), ("q", "q0"), ("q", "q1"), ("q", "q3")], "key string, target string")
    got = {(r.key, r.target): r.outcome for r in S.three_way(base, cur, new, succ).collect()}
    assert got == {("s", "s"): "reapply", ("a", "a"): "absorbed", ("c", "c"): "conflict", ("gone", None): "unmappable", ("q", "q0"): "reapply", ("q", "q1"): "reapply", ("q", "q3"): "split_absent", ("i", "i"): "insert_needed", ("u", "u"): "unchanged_locally"}


def test_statistics_leave_sentinels_out(spark):
    df = spark.createDataFrame([("h", 10.0), ("h", 20.0), ("h", -9999.0), ("h", None)], "name string, value double")
    r = St.numeric_stats(df).first()
    assert (r.total, r.valid, r.unknown_rate, r.mean) == (3, 2, 0.3333, 15.0)


def test_tiers(spark):
    words = {"一律値 取得不可": "missing", "衛星写真": "documented", "推定": "provisional", "写真測量": "measured", "": "other", None: "other", "x": "other"}
    got = {r.w: r.t for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", T.quality_tier(F.col("w")).alias("t")).collect()}
    assert got == words


def test_lane_precedence_and_tolerance(spark):
    rows = [("a", ["/class"], 0.01, True, False), ("b", ["/class"], 0.010001, True, False), ("c", [], None, True, True), ("d", ["/xDataQualityAttribute/s"], None, True, False), ("e", ["/address/z"], None, None, None), ("f", [], 0.01, False, False)]
    df = spark.createDataFrame([(*r, False) for r in rows], "id string, paths array<string>, hausdorff_m double, equal_1mm boolean, lod_changed boolean, id_changed boolean")
    got = {r.id: r.lane for r in review_lanes(df).collect()}
    assert got == {"a": "attribute_review", "b": "geometry_or_lod_review", "c": "geometry_or_lod_review", "d": "source_metadata_review", "e": "representation_review", "f": "unchanged"}
    plan = {r.family: r.proposals for r in family_plan(spark.createDataFrame([("a", "/usage"), ("b", "/usage[1]"), ("a", "/address/q"), ("a", "/buildingIDAttribute/x")], "id string, path string")).collect()}
    assert plan == {"usage_class_landuse": 2, "address": 1}


def test_chain_cut_and_collisions(spark):
    step = lambda rows: spark.createDataFrame(rows, "from_id long, to_id long, tier string, iou double")
    out = {r.start: (r.finish, r.tier, r.iou, r.cut) for r in I.compose_chain([step([(1, 11, "A", 0.9), (2, 12, "C", 0.6), (3, 3, "B", 0.7)]), step([(11, 21, "B", 0.8), (3, 3, "A", 1.0)])]).collect()}
    assert out == {1: (21, "B", 0.8, None), 2: (None, "A", None, 0), 3: (3, "B", 0.7, None)}
    links = spark.createDataFrame([(1, 2), (2, 3), (8, 9), (9, 8)], "from_id long, to_id long")
    order = {r.from_id: r.step for r in I.link_order(links).collect()}
    assert order == {2: 0, 1: 1, 8: None, 9: None}
    held = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    assert {r.from_id for r in I.collisions(links.where("from_id < 5"), held).collect()} == {1, 2}


def test_split_and_unchanged_footprints(spark):
    rect = "id long, x0 double, y0 double, x1 double, y1 double"
    old = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0)], rect)
    new = spark.createDataFrame([(2, 0.0, 0.0, 5.0, 10.0), (3, 5.0, 0.0, 10.0, 10.0)], rect)
    pairs = M.overlapping(old, new, 4.0)
    assert pairs.count() == 2  # spans several cells, each pair stays single
    assert tuple(M.split_candidates(pairs, old, new).first()) == (1, 2, [2, 3], 1.0)
    assert {r.method for r in M.cascade(old, old.withColumn("id", F.lit(9).cast("long")), M.rect_fingerprint()).collect()} == {"fingerprint"}


def test_overlaps_of_all_sizes(spark):
    """Footprints from a metre to ten kilometres, against brute force."""
    import random

    rng = random.Random(7)

    def some(n):
        out = []
        for i in range(n):
            w, h = (rng.choice([1, 3, 20, 20, 300, 9000]) * rng.uniform(0.5, 1) for _ in "wh")
            x, y = rng.uniform(-2000, 2000), rng.uniform(-2000, 2000)
            out.append((i, x, y, x + w, y + h))
        return out

    a, b = some(150), some(150)
    want = {(o[0], n[0]) for o in a for n in b if o[1] < n[3] and n[1] < o[3] and o[2] < n[4] and n[2] < o[4]}
    rect = "id long, x0 double, y0 double, x1 double, y1 double"
    pairs = [(r.o_id, r.n_id) for r in M.overlapping(spark.createDataFrame(a, rect), spark.createDataFrame(b, rect)).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == want and len(want) > 500


def test_detail_goes_and_other_bytes_stay():
    raw = b'<c:M xmlns:c="u/citygml" xmlns:gml="http://www.opengis.net/gml"><gml:boundedBy><e/></gml:boundedBy>\r\n<c:b ><c:lod1Solid/> <c:lod2Solid a=">"><c:lod2Solid/></c:lod2Solid ><c:x/></c:b><c:b><c:lod3Solid/></c:b></c:M>'
    assert gml.without_elements(raw) == raw.replace(b'<c:lod2Solid a=">"><c:lod2Solid/></c:lod2Solid >', b"").replace(b"<c:lod3Solid/>", b"")


def test_unknown_names_stop_a_conversion(spark):
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "name string")
    gml.require_supported(names("a", "b", "a"), names("a", "b", "c"))
    with pytest.raises(ValueError, match="nothing is converted: x, y$"):
        gml.require_supported(names("y", "a", "x"), names("a"))


def test_polygons_by_hand():
    square, ell = [(0, 0), (2, 0), (2, 2), (0, 2)], [(0, 0), (2, 0), (2, 1), (1, 1), (1, 2), (0, 2)]
    hole = [(0.5, 0.5), (1.5, 0.5), (1.5, 1.5), (0.5, 1.5)]
    assert P.overlap_areas([square], [ell]) == pytest.approx((4, 3, 3))
    assert P.overlap_areas([square, hole], [square]) == pytest.approx((3, 4, 3))
    assert P.iou([square], [[(1, 0), (3, 0), (3, 2), (1, 2)]]) == pytest.approx(1 / 3)
    assert P.iou([square], [[(5, 5), (6, 5), (6, 6)]]) == 0
    tilted = [(1, -1), (3, 1), (1, 3), (-1, 1)]
    assert P.overlap_areas([square], [tilted]) == pytest.approx((4, 8, 4))
    assert P.centroid(square) == pytest.approx((1, 1)) and P.hausdorff(square, ell) == pytest.approx(1)
    assert P.canonical(square) == P.canonical([(2, 2), (0, 2), (0, 0), (2, 0), (2, 2)]) != P.canonical(ell)
    assert P.self_intersects([(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)]) and not P.self_intersects([*ell, ell[0]])


def test_quadrants_and_mesh(spark):
    r = spark.range(1).select(*(geo.quadrant(F.lit(a), F.lit(b), F.lit(0.5), F.lit(0.5)).alias(n) for n, a, b in (("sw", 0.1, 0.1), ("se", 0.1, 0.5), ("nw", 0.5, 0.1), ("ne", 0.9, 0.9)))).first()
    assert (r.sw, r.se, r.nw, r.ne) == (1, 2, 3, 4)
    b = spark.range(1).select(*(v.alias(k) for k, v in geo.mesh_bounds(F.lit("53394525")).items())).first()
    assert (b.south, b.west) == (pytest.approx(35 + 1 / 3 + 4 / 12 + 2 / 120), pytest.approx(139 + 5 / 8 + 5 / 80))


def test_history_events(spark):
    rows = [("k", 1, 1, "a", 0), ("k", 2, 21, "a", 0), ("m", 1, 5, "a", 0), ("m", 3, 5, "b", 0), ("n", 2, 7, "a", 0), ("n", 3, 7, "b", 1)]
    df = spark.createDataFrame(rows, "key string, ed int, id long, digest string, place int")
    got = {(r.key, r.ed): r.event for r in H.edition_history(df, "key", 3).collect()}
    assert got == {("k", 1): "first_appearance", ("k", 2): "id_changed", ("k", 3): "removed", ("m", 1): "first_appearance", ("m", 2): "removed", ("m", 3): "reappeared", ("n", 2): "first_appearance", ("n", 3): "changed"}


# ---- files

HEAD = '<core:CityModel xmlns:core="http://www.opengis.net/citygml/2.0" xmlns:b="http://www.opengis.net/citygml/building/2.0" xmlns:gml="http://www.opengis.net/gml">'


def building(i, height="13.8", extra="", pos="0 0 0 1 0 0 1 1 0 0 0 0"):
    ring = f"<b:lod1Solid><gml:LinearRing><gml:posList>{pos}</gml:posList></gml:LinearRing></b:lod1Solid>"
    return f'<core:cityObjectMember><b:Building gml:id="{i}"><!-- c --><b:measuredHeight uom="m">{height}</b:measuredHeight>{extra}{ring}</b:Building></core:cityObjectMember>'


def model(*members):
    return gml.serialise(HEAD + "\n" + "\n".join(members) + "\n</core:CityModel>\n")


def test_scan_of_one_file():
    raw = model(building("a", extra='<b:q><b:s>000</b:s><b:s>023</b:s></b:q><gen name="N"><v>1</v></gen>'), building("b", "13.80"), "<core:cityObjectMember><x/></core:cityObjectMember>")
    a, b = gml.scan(raw)
    assert raw.startswith(b"\xef\xbb\xbf<?xml") and b"\r\n" in raw
    assert gml.indexed(a.attrs) == {"/measuredHeight": "13.8", "/q/s[0]": "000", "/q/s[1]": "023", "/gen[@name=N]/v": "1"}
    assert raw[a.start : a.stop].decode() == building("a", extra='<b:q><b:s>000</b:s><b:s>023</b:s></b:q><gen name="N"><v>1</v></gen>')
    assert a.geom_hash == b.geom_hash == gml.scan(model(building("c", pos="0.0 0 0 1 0 0 1 1.00 0 0 0 0")))[0].geom_hash
    assert a.rings[0][1] == 12 and len(a.rings[0][2]) == 4


def test_unsafe_documents_are_refused():
    with pytest.raises(gml.UnsafeXml):
        gml.scan(b'<!DOCTYPE x [<!ENTITY e "y">]><x>&e;</x>')


def test_rebuild_changes_only_what_differs():
    base = model(building("a"), building("b"), building("c"))
    head = model(building("a", "13.80"), building("b", "14"), building("d"))
    out = gml.rebuild(base, head)
    assert building("a").encode() in out and building("b", "14").encode() in out and building("d").encode() in out and building("c").encode() not in out
    assert gml.rebuild(base, base) == base


def test_code_lists_skip_malformed_files(spark):
    good = b'<Dictionary xmlns:gml="http://www.opengis.net/gml"><gml:Definition><gml:description>office</gml:description><gml:name> 401 </gml:name></gml:Definition></Dictionary>'
    rows = gml.scan_code_lists(spark.createDataFrame([("x/a.xml", bytearray(good)), ("x/b.xml", bytearray(b"<broken"))], "file string, content binary")).collect()
    assert [tuple(r) for r in rows] == [("a.xml", "401", "office")]


def test_sinks(spark, tmp_path):
    assert sinks.canonical_json({"b": [1, "é"], "a": None}) == '{"a":null,"b":[1,"é"]}'.encode()
    rows = spark.createDataFrame([(1, 2, "x"), (1, 1, "y"), (2, 1, None)], "id long, ord int, what string")
    sinks.write_documents(rows, "id", "ord", f"{tmp_path}/docs", 2)
    back = {r.id: [x.ord for x in r.rows] for r in spark.read.json(f"{tmp_path}/docs").collect()}
    assert back == {1: [1, 2], 2: [1]}
    sinks.write_cells(rows, "ord", f"{tmp_path}/cells")
    assert spark.read.parquet(f"{tmp_path}/cells").count() == 3
    assert sinks.markdown(rows, "t", 2).endswith("1 more\n")


def test_stream_twin_equals_batch(spark, tmp_path):
    from lakewright.streaming.history import change_feed, windowed_counts

    rows = [(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (2, 1, "c"), (2, 4, "d")]
    df = spark.createDataFrame(rows, "id long, ord long, state string")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    run = change_feed(stream, "id", "ord", "state").writeStream.format("memory").queryName("feed").outputMode("append").start()
    run.processAllAvailable()
    run.stop()
    got = {(r.id, r.ord, r.event) for r in spark.table("feed").collect()}
    want = {(r.id, r.ord, r.event) for r in H.entity_history(df, "id", ["ord"], "state").where("event <> 'unchanged'").collect()}
    assert got == want
    times = spark.createDataFrame([("2024-01-01 00:10:00", "x"), ("2024-01-01 00:50:00", "x"), ("2024-01-01 01:10:00", "y")], "t string, kind string").withColumn("t", F.to_timestamp("t"))
    assert {(r.kind, r.n) for r in windowed_counts(times, "t", "kind").collect()} == {("x", 2), ("y", 1)}


def test_reasons_and_trailers(spark):
    body = "subject\n\nChange-Type: a\nBuilding-ID:  b c \nChange-Type: d"
    r = spark.range(1).select(T.trailers(F.lit(body), ("Change-Type", "Building-ID")).alias("t"), T.reason_section(F.lit("## 変更理由\nabc def\n## x")).alias("s")).first()
    assert [(x.key, x.value) for x in r.t] == [("Change-Type", "a"), ("Building-ID", "b c"), ("Change-Type", "d")] and r.s == "abc def"


def test_renamed_elements_and_ids():
    foot = "<b:lod0FootPrint><gml:LinearRing><gml:posList>0 0 0 1 0 0 1 1 0 0 0 0</gml:posList></gml:LinearRing></b:lod0FootPrint>"
    raw = model(building("a", extra=foot), building("b"), building("c", extra=foot.replace("FootPrint", "RoofEdge")), "<!-- lod0FootPrint -->")
    out, done, left = gml.rename_elements(raw, "lod0FootPrint", "lod0RoofEdge")
    assert done == ["a"] and left == [("b", "absent"), ("c", "already-renamed")]
    assert out == raw.replace(b"b:lod0FootPrint>", b"b:lod0RoofEdge>")
    with pytest.raises(ValueError):
        gml.rename_elements(model(building("a", extra=foot * 2)), "lod0FootPrint", "lod0RoofEdge")
    swapped = gml.replace_ids(raw, {"a": "b", "b": "a"})
    assert [m.gml_id for m in gml.scan(swapped)] == ["b", "a", "c"]
    with pytest.raises(ValueError):
        gml.replace_ids(raw, {"a": "c"})


def test_small_documents(spark, tmp_path):
    from lakewright.sources import documents as docs

    schema = {
        "type": "object", "required": ["v", "items"], "additionalProperties": False, "$defs": {"item": {"type": "string", "pattern": "^a"}},
        "properties": {"v": {"type": "integer", "minimum": 1, "const": 1}, "items": {"type": "array", "minItems": 1, "items": {"$ref": "#/$defs/item"}}, "n": {"type": "number", "maximum": 2}},
    }
    assert list(docs.violations(schema, {"v": 1, "items": ["ab"]})) == []
    assert list(docs.violations(schema, {"v": True, "items": [], "x": 1, "n": 3})) == ["$.v: integer expected", "$.items: too few items", "$: x is not allowed", "$.n: above the maximum"]
    assert list(docs.violations(schema, {"items": ["b"]})) == ["$: v is missing", "$.items[0]: does not match"]
    assert docs.table_rows("x\n| a | b |\n|---|---|\n| 1 | p\\|q |\n\nend") == [{"a": "1", "b": "p|q"}]
    assert docs.payload("é" * 50) == docs.payload("é" * 50) and docs.unpack(docs.payload("é" * 50)) == "é" * 50
    (tmp_path / "533945_bldg.gml").write_bytes(b"12345")
    assert [(r.code, r.bytes) for r in docs.catalogue(spark, str(tmp_path)).collect()] == [("533945", 5)]
