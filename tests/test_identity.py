"""Identity operators on long chains, cycles and kept ids against brute force."""

from __future__ import annotations

import random

import pytest

from lakewright.operators import identity as I


def order(links):
    left, done, step = dict(links), {}, 0
    while ready := [f for f, t in left.items() if t not in left or t == f]:
        done |= {(f, left.pop(f)): step for f in ready}
        step += 1
    return done | {(f, t): None for f, t in left.items()}


def refused(links, held):
    kept = dict(links)
    while out := [f for f, t in kept.items() if t in held and t not in kept]:
        for f in out:
            del kept[f]
    return set(links) - set(kept.items())


def closure(links):
    near = {}
    for f, t in links:
        near.setdefault(f, []).append(t)
        near.setdefault(t, []).append(f)
    out = {}
    for start in sorted(near):
        todo = [start]
        while todo:
            if (x := todo.pop()) not in out:
                out[x] = start
                todo += near[x]
    return out


def frame(spark, links):
    return spark.createDataFrame(links, "from_id long, to_id long")


def agree(spark, links, ids):
    moves, held = frame(spark, links), spark.createDataFrame([(i,) for i in ids], "id long")
    assert {(r.from_id, r.to_id): r.step for r in I.link_order(moves).collect()} == order(links)
    assert {(r.from_id, r.to_id) for r in I.collisions(moves, held).collect()} == refused(links, set(ids))
    assert {r.id: r.canonical for r in I.alias_closure(moves).collect()} == closure(links)


def test_chains_longer_than_a_thousand(spark):
    """A renumbering k -> k + 1 that ends at a held id is refused as a whole."""
    agree(spark, [(k, k + 1) for k in range(1500)], range(1501))


def test_links_to_themselves(spark):
    """They wait for nothing, free their id for others, and end chains."""
    agree(spark, [(1, 1), (2, 1), (3, 2), (5, 6), (8, 8), (10, 11), (11, 10), (12, 10)], [1, 2, 3, 5, 6, 8, 10, 11, 12])
    out = {(r.from_id, r.to_id): r.step for r in I.link_order(frame(spark, [(1, 1), (1, 2), (3, 1)])).collect()}
    assert out == {(1, 1): 0, (1, 2): 0, (3, 1): 1}


def test_nearest_at_any_distance(spark):
    from lakewright.operators import match as M

    rng = random.Random(2)
    left = [(i, rng.uniform(0, 100), rng.uniform(0, 100)) for i in range(60)] + [(100, 5000.0, 40.0), (101, -900.0, -900.0), (102, 3.0, 3.0), (103, 3.0, 3.0)]
    right = [(i, float(rng.randint(0, 30)) * 4, float(rng.randint(0, 30)) * 4) for i in range(40)]
    points = lambda rows: spark.createDataFrame(rows, "id long, x double, y double")
    want = {}
    for i, x, y in left:
        want[i] = min(((x - a) ** 2 + (y - b) ** 2, k) for k, a, b in right)[::-1]
    got = M.nearest(points(left), points(right), 5.0).collect()
    assert {r.id: (r.nearest_id, r.d2) for r in got if r.id is not None} == {i: (k, pytest.approx(d)) for i, (k, d) in want.items()}
    assert sorted(r.nearest_id for r in got if r.id is None) == sorted({k for k, _, _ in right} - {k for k, _ in want.values()})
    assert {(r.id, r.nearest_id) for r in M.nearest(points(left[:2]), points([]), 5.0).collect()} == {(0, None), (1, None)}
    assert {(r.id, r.nearest_id) for r in M.nearest(points([]), points(right[:2]), 5.0).collect()} == {(None, 0), (None, 1)}


def test_every_part_moves(spark):
    """All part rows: long chains in mixed order, cycles, tails into them, gaps and kept ids."""
    ids = sorted(r[0] for r in spark.read.parquet("/root/testdata/sf0.01/part.parquet").select("p_partkey").collect())
    rng = random.Random(1)
    mixed = rng.sample(ids, len(ids))
    links = list(zip(mixed[:1200], mixed[1:1201])) + list(zip(mixed[1201:1600], mixed[1202:1601]))
    links += [(mixed[1600], max(ids) + 1)]
    for at in (1601, 1603, 1650):
        ring = mixed[at : at + (2 if at < 1650 else 40)]
        links += list(zip(ring, [*ring[1:], ring[0]]))
    links += list(zip(mixed[1605:1650], [*mixed[1606:1650], mixed[1660]]))
    links += list(zip(mixed[1690:], [*mixed[1691:], mixed[3]]))
    held = [i for i in ids if i % 37]
    assert len(dict(links)) == len(links) > 1900
    agree(spark, links, held)


def test_far_least_id(spark):
    """The least id at the one end, ids falling to the next least at the other."""
    path = [0, *range(300, 0, -1)]
    links = list(zip(path, path[1:]))
    assert {r.canonical for r in I.alias_closure(frame(spark, links)).collect()} == {0}


@pytest.mark.parametrize("cyclic", [False, True])
def test_several_links_of_an_id(spark, cyclic):
    links = [(1, 2), (1, 3), (2, 4), (4, 5), (6, 1)] + [(5, 4)] * cyclic
    out = {(r.from_id, r.to_id): r.step for r in I.link_order(frame(spark, links)).collect()}
    free = {(1, 3): 0}
    assert out == (free | {(1, 2): None, (2, 4): None, (4, 5): None, (5, 4): None, (6, 1): None} if cyclic else free | {(4, 5): 0, (2, 4): 1, (1, 2): 2, (6, 1): 3})


def test_points_of_one_place_count_once(spark, monkeypatch):
    from lakewright.operators import match as M

    sizes, write = {}, M.materialise

    def noted(df, name="step"):
        back = write(df, name)
        sizes[name] = back.count()
        return back

    monkeypatch.setattr(M, "materialise", noted)
    points = lambda rows: spark.createDataFrame([(i, float(x), float(y)) for i, x, y in rows], "id long, x double, y double")
    left = points([(i, 1, 1) for i in range(50)] + [(90, 3, 5)])
    got = M.nearest(left, points([(i, 2, 1) for i in range(7, 60)] + [(99, 3, 5)]), 5.0).collect()
    assert {(r.id, r.nearest_id, r.d2) for r in got} == {(i, 7, 1.0) for i in range(50)} | {(90, 99, 0.0)} | {(None, i, None) for i in range(8, 60)}
    assert (sizes["places"], sizes["met"]) == (2, 2)
