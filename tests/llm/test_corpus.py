"""Decontamination, near-duplicates, sharding and packing against brute force."""

from __future__ import annotations

import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from lakewright.llm import decontaminate as dc
from lakewright.llm import minmax_dedup as md
from lakewright.llm import packing as pk
from lakewright.llm import sharding as sh


def plain_words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_hits(docs, items, window):
    out = []
    for i, text in docs:
        w = plain_words(text)
        hit, found = set(), set()
        for item, t in items:
            q = plain_words(t)
            n = min(window, len(q))
            if not n:
                continue
            for s in range(len(q) - n + 1):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == q[s : s + n]:
                        hit |= set(range(p, p + n))
                        found.add(item)
        out.append((str(i), len(w), len(hit), sorted(map(str, found))))
    return sorted(out)


ITEMS = [(1, "ka lo mi"), (2, "the Same, the same"), (3, None), (4, ""), (5, "naïve ünï"), (2, "two words"), (None, "single"), (6, "lo lo lo lo lo lo lo lo lo lo lo lo")]


@pytest.fixture(scope="module")
def bench(spark, awkward_rows):
    long = [t for i, t in awkward_rows if i == 9][0].split()
    return [*ITEMS, (7, " ".join(long[300:340])), (8, " ".join(long[-12:]) + " tail")]


@pytest.mark.parametrize("limit", [1 << 25, 120])
def test_spans_equal_brute_force(spark, awkward, awkward_rows, bench, monkeypatch, limit):
    monkeypatch.setattr(dc, "TEST_BYTES", limit)
    items = spark.createDataFrame([(i, t, 0) for i, t in bench], "item_id long, text string, doc_id int")
    docs = awkward.repartition(5, F.rand(seed=4)) if limit < 1000 else awkward
    rows = dc.contaminated_spans(docs, items, window=4).collect()
    got = sorted((str(r.doc_id), r.n_words, sum(s.stop - s.start for s in r.spans), sorted(map(str, r.item_ids))) for r in rows)
    assert got == plain_hits(awkward_rows, bench, 4)
    for r in rows:
        assert all(a.stop < b.start for a, b in itertools.pairwise(r.spans))


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a x b y c"), (2, "a b c"), (3, "a x x x b c"), (4, "c b a")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    near = {r.doc_id: len(r.spans) for r in dc.contaminated_spans(docs, items, slop=2).collect()}
    assert near == {1: 1, 2: 1, 3: 0, 4: 0}
    with pytest.raises(ValueError):
        dc.contaminated_spans(docs, items, slop=dc.GAP)


def test_contamination_edges(spark, awkward, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.contaminated_spans(empty, items).count() == 0
    assert dc.contaminated_spans(awkward, none).where(F.size("spans") > 0).count() == 0
    kept = dc.drop_contaminated(awkward, items)
    assert kept.columns == awkward.columns
    assert kept.where("doc_id in (7, 8, 11)").count() == 0 and kept.where("doc_id is null and text is null").count() == 1


def test_rows_that_share_an_id_are_judged_each_by_its_own(spark):
    docs = spark.createDataFrame([(1, "some clean words"), (1, "here the same the same stands"), (None, "clean too"), (None, "the same the same")], "doc_id long, text string")
    items = spark.createDataFrame([(2, "the Same, the same")], "item_id long, text string")
    assert {(r.doc_id, r.text) for r in dc.drop_contaminated(docs, items).collect()} == {(1, "some clean words"), (None, "clean too")}


def test_phrase_table_is_compact():
    import numpy as np

    rng = np.random.default_rng(0)
    items = [rng.integers(0, 5000, n).astype(np.int32) for n in [0, 1, 4, 5000, 20_000]]
    items.append(items[4][100:160])
    table = dc.Phrases(items, 10, 5000)
    windows = {}
    for k, w in enumerate(items):
        for i in range(max(1, len(w) - 9) if len(w) else 0):
            windows.setdefault(tuple(w[i : i + 10].tolist()), set()).add(k)
    got = {tuple(t[:n].tolist()): set(table.owners[a:b].tolist()) for t, n, a, b in zip(table.terms, table.size, table.first, table.first[1:])}
    assert got == windows
    order = table.by_rarity(rng.integers(1, 99, 5001))
    assert sum(x.nbytes for x in (table.terms, table.size, table.owners, table.first, order)) < 80 * len(windows)


# ---- near duplicates


def plain_classes(rows, k, percent):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        sets.append({tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set())
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, (i, _)), (b, (j, _)) in itertools.combinations(enumerate(rows), 2):
        if i is None or j is None or not sets[a] or not sets[b]:
            continue
        n = len(sets[a] & sets[b])
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            ri, rj = find(i), find(j)
            parent[max(ri, rj)] = min(ri, rj)
    return sorted((str(i), len(s), str(None if i is None else find(i) if s else i)) for (i, _), s in zip(rows, sets))


def near_copies(rng, n):
    """A group around one text with one to many edits, as links, near links and others."""
    base = [f"w{rng.randint(0, 400)}" for _ in range(120)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = f"e{rng.randint(0, 10_000)}"
        out.append((1000 + i, " ".join(w)))
    return out


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_classes_equal_brute_force(spark, awkward_rows, k, percent, monkeypatch):
    monkeypatch.setattr(md, "SHINGLES", 900)  # clusters of more than a few texts are dealt into blocks
    rows = [r for r in awkward_rows] + near_copies(random.Random(k), 60)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, rep int, bands string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in md.near_duplicates(df, k, percent).collect())
    assert got == plain_classes(rows, k, percent)


def test_texts_under_one_id_are_one_node(spark):
    a, b, c = "one two three four five six", "red green blue white black pink", "uno due tre quattro cinque sei"
    rows = [(1, a), (5, a), (5, b), (9, b), (7, c), (8, c + " "), (None, c)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in md.near_duplicates(df, 3, 85).collect())
    assert got == plain_classes(rows, 3, 85)
    assert {i: c for i, _, c in got} == {"1": "1", "5": "1", "9": "1", "7": "7", "8": "7", "None": "None"}


def test_distinct_texts_keeps_one_row_of_each_class(spark, awkward_rows):
    rng = random.Random(8)
    near = near_copies(rng, 40)
    rows = [r for r in awkward_rows] + near + [(5000, near[0][1]), (5000, "another text that stands under the same number"), (5000, "another text that stands under the same number"), (None, near[0][1])]
    df = spark.createDataFrame([(i, t, n % 3, "x") for n, (i, t) in enumerate(rows)], "doc_id long, text string, node int, `band` string")
    kept = md.distinct_texts(df, 5, 80)
    assert kept.columns == df.columns
    # brute force over distinct texts, each a node of its own
    texts = sorted({t for _, t in rows if t and t.split()})
    classes = {texts[int(i)]: int(c) for i, _, c in plain_classes(list(enumerate(texts)), 5, 80)}
    want: dict[int, tuple] = {}
    for i, t in rows:
        if t in classes:
            c = classes[t]
            want[c] = min(want.get(c, (True, 0)), (i is None, i or 0))
    got = kept.collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got if r.text and r.text.split()) == sorted(want.values())
    assert sorted(str(r.doc_id) for r in got if not (r.text and r.text.split())) == sorted(str(i) for i, t in rows if not (t and t.split()))
    assert len({classes[r.text] for r in got if r.text in classes}) == len(want)


@pytest.mark.parametrize("cross", [False, True])
def test_links_of_shared_bands(cross):
    import numpy as np

    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 40, 30).astype(np.uint64)) for _ in range(60)]
    bands = rng.integers(0, 9, (60, 3))
    side = rng.integers(0, 2, 60) if cross else None
    same = lambda f: {(i, j) for i, j in itertools.combinations(range(60), 2) if f(i) == f(j)}
    partly = 0
    for percent in range(30, 60):
        parent = list(range(60))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for i, j in itertools.combinations(range(60), 2):
            both = len(np.intersect1d(sets[i], sets[j]))
            if (bands[i] == bands[j]).any() and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both) and not (cross and side[i] == side[j]):
                parent[find(i)] = find(j)
        label = md.exact_links(sets, bands, percent, side)
        assert same(lambda i: label[i]) == same(find)
        partly += 1 < len(set(label.tolist())) < 60
    assert partly > 5


def test_no_documents_no_classes(spark, empty):
    assert md.near_duplicates(empty).count() == 0
    assert md.near_duplicates(spark.createDataFrame([(1, None), (None, "a b")], "doc_id long, text string")).count() == 2


def test_min_and_max_estimate_similarity():
    import numpy as np

    rng = np.random.default_rng(0)
    pool = rng.integers(0, 1 << 62, 1500, dtype=np.uint64)
    a, b = np.unique(pool[:1200]), np.unique(pool[300:])
    low = []
    for s in (a, b):
        p = s[None, :] * md._MIX[:, None]
        p ^= p >> np.uint64(31)
        p *= md._C
        low.append(np.concatenate([p.min(axis=1), p.max(axis=1)]))
    assert abs((low[0] == low[1]).mean() - 0.6) < 0.2


# ---- sharding


def test_differencing_beats_greedy_on_a_known_case():
    sums, place = sh.difference([[8, 0], [7, 0], [6, 0], [5, 0], [4, 0]])
    assert sorted(sums) == [14, 16]  # the differencing result for 8 7 6 5 4
    shards = [p[0] for p in place]
    assert sorted(sum(v for v, s in zip((8, 7, 6, 5, 4), shards) if s == k) for k in (0, 1)) == [14, 16]
    assert sh.difference([]) == ([], [])


def test_differencing_keeps_every_item():
    rng = random.Random(2)
    sizes = [rng.randint(1, 1000) for _ in range(500)]
    sums, place = sh.difference([[s] + [0] * 15 for s in sizes])
    got = [0] * 16
    for s, p in zip(sizes, place):
        got[p[0]] += s
    assert got == sums and max(sums) - min(sums) <= 2


@pytest.mark.parametrize("bucket,fan", [(8192, 1024), (3, 2)])
def test_shards(spark, awkward, awkward_rows, monkeypatch, bucket, fan):
    monkeypatch.setattr(sh, "GROUPS_A_BUCKET", bucket)
    monkeypatch.setattr(sh, "FAN", fan)
    rows = sh.shard_documents(awkward, 4).collect()
    assert len(rows) == len(awkward_rows)
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    import zlib

    want = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in awkward_rows)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == want
    groups = {}
    for r in rows:
        groups.setdefault((r.size, r.text_crc32), set()).add(r.shard)
    assert all(len(v) == 1 for v in groups.values())


def test_shard_balance_and_none(spark, empty):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("repeat('x', cast(id * 7919 % 1000 as int) + 1)").alias("t"), F.col("id")).select("doc_id", F.concat("t", F.col("id").cast("string")).alias("text"))
    sums = [r.b for r in sh.shard_documents(df).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sums) == 16 and max(sums) - min(sums) <= 4
    assert sh.shard_documents(empty).count() == 0


# ---- packing


def padding(histogram, bounds):
    return sum(c * (min(b for b in bounds if b >= n) - n) for n, c in histogram)


@pytest.mark.parametrize("seed", range(6))
def test_boundaries_are_optimal(seed):
    rng = random.Random(seed)
    histogram = [(n, rng.randint(1, 9)) for n in rng.sample(range(1, 60), 9)]
    lengths = sorted(n for n, _ in histogram)
    for k in (1, 2, 3, 4, 9, 12):
        best = min(padding(histogram, [*some, lengths[-1]]) for r in range(k) for some in itertools.combinations(lengths[:-1], min(r, len(lengths) - 1)))
        got = pk.boundaries(histogram, k)
        assert len(got) <= k and got == sorted(got) and padding(histogram, got) == best
    assert pk.boundaries([]) == []


def test_batches(spark, awkward, awkward_rows, empty):
    rows = pk.pack(awkward, buckets=3, budget=100).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in rows) == sorted((str(i), len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) + 1) for i, t in awkward_rows)
    batches = {}
    for r in rows:
        assert r.n_tokens <= r.bucket_len
        batches.setdefault((r.bucket, r.batch), []).append(r)
    last = {b: max(n for x, n in batches if x == b) for b, _ in batches}
    for (bucket, n), own in batches.items():
        room = max(1, 100 // own[0].bucket_len)
        assert sorted(r.place for r in own) == list(range(len(own))) and (len(own) == room or (n == last[bucket] and len(own) < room))
    assert pk.pack(empty).count() == 0
    assert math.isfinite(sum(r.bucket_len for r in rows))
