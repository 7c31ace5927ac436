"""City-model files end to end, through the command line's functions."""

from __future__ import annotations

import json

import pytest

from lakewright import __main__ as cli
from lakewright.plans import city

from test_operators import building, model  # noqa: I001

LIST = b'<d xmlns:gml="http://www.opengis.net/gml"><gml:Definition><gml:description>office</gml:description><gml:name>401</gml:name></gml:Definition></d>'


@pytest.fixture()
def files(tmp_path):
    for d in ("old", "new", "lists"):
        (tmp_path / d).mkdir()
    usage = lambda c: f'<b:usage codeSpace="../lists/usage.xml">{c}</b:usage>'
    far = "0 0 0 5 0 0 5 5 0 0 0 0"
    (tmp_path / "old/t1.gml").write_bytes(model(building("a", "10", usage(401)), building("b", "20"), building("gone", "-1", pos="9 0 0 1 0 0 1 1 0 9 0 0"), building("id1", "33", pos=far)))
    (tmp_path / "new/t1.gml").write_bytes(model(building("a", "10.0", usage(402)), building("b", "2000", "<b:storeysAboveGround>9999</b:storeysAboveGround>", pos="0 0 0 1 0 0 1 2 0 0 0 0"), building("id2", "33", pos=far)))
    (tmp_path / "new/t2.gml").write_bytes(model(building("new", "-9999", "<b:storeysAboveGround>300</b:storeysAboveGround>", pos="0 0 0 1 0 0 1 1 0")))
    (tmp_path / "lists/usage.xml").write_bytes(LIST)
    return tmp_path


def test_diff(spark, files):
    got = {r.gml_id: r for r in city.building_diff(spark, f"{files}/old", f"{files}/new").collect()}
    assert {k: r.status for k, r in got.items()} == {"a": "modified", "b": "modified", "gone": "deleted", "id1": "renamed", "new": "added"}
    assert got["id1"].new_id == "id2" and not got["a"].geometry_changed and got["b"].geometry_changed
    assert [tuple(c) for c in got["a"].changes] == [("/usage", "401", "402")]
    assert [c.path for c in got["b"].changes] == ["/measuredHeight", "/storeysAboveGround"]


def test_stats_codes_and_lint(spark, files):
    s = {r.name: r for r in city.building_stats(spark, f"{files}/new", ["measuredHeight", "storeysAboveGround"]).collect()}
    assert (s["measuredHeight"].total, s["measuredHeight"].valid, s["storeysAboveGround"].sentinel) == (4, 3, 1)
    codes = [(r.element, r.list, r.code, r.label, r.rate) for r in city.building_codes(spark, f"{files}/old", f"{files}/lists").collect()]
    assert codes == [("usage", "usage.xml", "401", "office", 1.0)]
    found = {(r.gml_id, r.severity, r.code) for r in city.building_lint(spark, f"{files}/new", f"{files}/lists").collect()}
    assert found == {("a", "warning", "invalid_code"), ("b", "warning", "height_out_of_range"), ("new", "warning", "storeys_out_of_range"), ("new", "error", "too_few_points"), ("new", "error", "ring_not_closed")}


def test_command_line(spark, files, capsys):
    assert cli.main(["diff", f"{files}/old", f"{files}/new"]) == 0
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert {x["status"] for x in lines} == {"modified", "deleted", "renamed", "added"}
    assert cli.main(["--out", f"{files}/lint", "lint", f"{files}/new"]) == 1
    assert cli.main(["lint", f"{files}/old"]) == 0
