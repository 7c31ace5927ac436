"""URL classes, tool calls and order MinHash."""

from __future__ import annotations

import hashlib
import json

import pytest
import xxhash
from pyspark.sql import functions as F

from lakewright.llm import order_minhash as om
from lakewright.llm import toolcalls as tc
from lakewright.llm import url_filter as uf
from lakewright.llm.common import connected_components, number_within

PAGES = "page_id long, url string, html string, rule int, component string, host string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, 1, "c", "h") for i, u, h in rows], PAGES)


def test_rules_longest_and_literal_paths(spark):
    rows = [
        (1, "http://a.org/x", None), (2, "http://Example.ORG/es/1", None), (3, "https://b.example.org/en/12", None), (4, "http://x.com/fr/1", None),
        (5, "http://x.com/de/1?q", None), (6, "http://x.net/", None), (7, None, None), (8, "no scheme", None), (9, "http://a.org", None), (10, "http://notexample.org/es/1", None),
        (11, "://", None), (12, "", None), (1, "http://a.org/x", None),
    ]
    out = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in uf.redirect_equivalence(pages(spark, rows)).collect()]
    assert sorted(out) == sorted(
        [
            (1, "a.org", "/x", "org/", "allow"), (1, "a.org", "/x", "org/", "allow"), (2, "example.org", "/es/1", "example.org/es/", "block"),
            (3, "b.example.org", "/en/12", "example.org/en/1", "block"), (4, "x.com", "/fr/1", "com/fr/", "allow"), (5, "x.com", "/de/1", "com/de/", "block"),
            (6, "x.net", "/", None, "allow"), (7, "", "", None, "allow"), (8, "", "", None, "allow"), (9, "a.org", "", None, "allow"),
            (10, "notexample.org", "/es/1", "org/", "allow"), (11, "", "", None, "allow"), (12, "", "", None, "allow"),
        ]
    )


def test_blocks_reach_aliases_but_not_allowed_ones(spark):
    canonical = '<html><head><link rel="canonical" href="http://x.com/de/1"></head>'
    refresh = "<meta http-equiv=refresh content=\"0; url=http://m.net/a\">"
    rows = [(1, "http://m.net/a?utm_source=z", canonical), (2, "http://other.net/b", refresh), (3, "https://www.other.net/b/#top", None), (4, "http://c.com/fr/q", canonical), (5, "http://free.net/", None)]
    got = {r.page_id: (r.verdict, r.by_alias) for r in uf.redirect_equivalence(pages(spark, rows)).collect()}
    assert got == {1: ("block", True), 2: ("block", True), 3: ("block", True), 4: ("allow", False), 5: ("allow", False)}
    more = spark.createDataFrame([("http://free.net/", "http://x.com/de/9")], "url string, target string")
    got = {r.page_id: r.verdict for r in uf.redirect_equivalence(pages(spark, rows), redirects=more).collect()}
    assert got[5] == "block"


def test_rules_as_a_table_judge_alike(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").unionByName(pages(spark, [(-1, None, None), (-2, "http://x.com/de/1", None), (-3, "http://b.example.org/es/", None), (-4, "http://q.net/", '<link rel=canonical href="http://x.com/de/1">')]), allowMissingColumns=True)
    table = spark.createDataFrame(list(uf.RULES), "rule string, verdict string")
    key = lambda df: sorted(map(str, df.select("page_id", "host", "path", "rule", "verdict", "by_alias").collect()))
    assert key(uf.redirect_equivalence(rows, table)) == key(uf.redirect_equivalence(rows))


def test_url_edge_tables(spark):
    assert uf.redirect_equivalence(pages(spark, [])).count() == 0
    assert uf.redirect_equivalence(pages(spark, [(1, "http://x.com/de/1", None)]), rules=[]).first().verdict == "allow"
    with pytest.raises(ValueError):
        uf.fitting_rule(F.lit("a"), F.lit("/"), [("org/", "maybe")])


def test_components_against_union_find(spark):
    import random

    rng = random.Random(1)
    edges = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(150)] + [(500, i) for i in range(501, 700)] + [(i, i + 1) for i in range(1000, 1060)] + [(None, 1), (3, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    want = {x: find(x) for x in list(parent)}
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_numbers_are_gapless(spark):
    df = spark.range(1000).withColumn("g", F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 5))
    rows = number_within(df, "g", ["id"], "n", 100_000).collect()
    seen = {}
    for r in rows:
        seen.setdefault(r.g, []).append(r.n)
    assert len(rows) == 1000 and all(sorted(v) == list(range(len(v))) for v in seen.values())


CALLS = "conv_id long, call_id string, seq long, name string, arguments string, depends array<string>, extra int"
RESULTS = "conv_id long, call_id string, seq long, content string, status string"


def test_tool_calls(spark):
    schemas = {"add": {"a": ("integer", True), "b": ("number", True), "note": ("string", False)}}
    calls = [
        (1, "x", 1, "add", '{"b": 2.5, "a": 1}', [], 0), (1, "y", 2, "add", '{"a": 1, "b": 2}', ["x"], 0), (1, "z", 3, "add", '{"a": 1, "b": 2, "a": 3}', ["y", "gone"], 0),
        (1, "m", 4, "add", '{"a": "1", "q": 2}', [], 0), (1, "u", 5, "nope", None, [], 0), (2, "p", 1, "add", '{"a":1,"b":1}', ["q"], 0), (2, "q", 2, "add", '{"a":1,"b":1}', ["p"], 0),
        (2, "x", 3, "add", '{"a":1,"b":1}', [], 0), (2, "x", 1, "add", '{"b":1,"a":7}', [], 0), (None, "x", 1, "add", '{"a":1,"b":1}', [], 0), (3, "n", 1, "add", "not json", None, 0),
    ]
    results = [(1, "x", 9, 'a "b"\n', "s"), (1, "x", 8, "first", "s"), (1, "y", 9, "r", "s"), (1, "lost", 3, None, "s"), (2, "q", 3, "r", "s"), (2, "x", 9, "r", "s"), (None, None, 1, "c", "s")]
    out = tc.link_tool_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), schemas).collect()
    again = [r for r in out if r.status == "duplicate_id"]
    got = {(r.conv_id, r.call_id, r.name): r for r in out if r.status != "duplicate_id"}
    assert sorted((r.conv_id, r.call_id, r.seq, r.level, r.n_calls, r.n_results) for r in again) == [(1, "x", 9, None, 0, 2), (2, "x", 3, None, 2, 0)]
    assert {r.json for r in again} == {'{"arguments":null,"id":"x","name":null,"result":"a \\"b\\"\\n"}', '{"arguments":{"a":1,"b":1},"id":"x","name":"add","result":null}'}
    status = {k: (r.status, r.level) for k, r in got.items()}
    assert status == {
        (1, "x", "add"): ("ok", 0), (1, "y", "add"): ("ok", 1), (1, "z", "add"): ("malformed_arguments", 2), (1, "m", "add"): ("invalid_arguments", 0), (1, "u", "nope"): ("unknown_tool", 0),
        (1, "lost", None): ("orphan_result", None), (2, "p", "add"): ("cyclic", None), (2, "q", "add"): ("cyclic", None), (2, "x", "add"): ("ok", 0), (None, "x", "add"): ("missing_result", 0),
        (None, None, None): ("orphan_result", None), (3, "n", "add"): ("malformed_arguments", 0),
    }
    assert got[1, "m", "add"].errors == ["type:a", "missing:b", "extra:q"]
    assert got[1, "x", "add"].json == '{"arguments":{"a":1,"b":2.5},"id":"x","name":"add","result":"first"}'
    assert got[1, "x", "add"].n_results == 2 and got[2, "x", "add"].n_calls == 2
    assert json.loads(got[2, "x", "add"].json)["arguments"] == {"a": 7, "b": 1}
    for r in out:
        assert json.loads(r.json)["id"] == (r.call_id or "")
    none = tc.link_tool_calls(spark.createDataFrame([], CALLS), spark.createDataFrame([], RESULTS))
    assert none.count() == 0


def test_calls_in_turns(spark):
    turns = [
        (1, 0, "user", "hi"), (1, 1, "assistant", '{"tool_calls":[{"id":"c1","name":"add","arguments":{"b":1,"a":2},"depends":[]}]}'), (1, 2, "tool", '{"tool_call_id":"c1","content":{"z":1,"y":[]}}'),
        (2, 0, "user", None), (2, 1, "assistant", "{broken"), (None, 0, "user", "x"), (3, None, "user", "x"),
    ]
    calls, results = tc.calls_and_results(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    assert {(r.conv_id, r.call_id, r.arguments) for r in calls.where("name = 'add'").collect()} == {(1, "c1", '{"a":2,"b":1}')}
    out = {(r.conv_id, r.call_id): r for r in tc.link_tool_calls(calls, results).collect()}
    assert out[1, "c1"].status == "unknown_tool" and '"result":"{\\"y\\":[],\\"z\\":1}"' in out[1, "c1"].json
    assert out[2, "turn-0"].status == "ok" and out[None, "turn-0"].status == "missing_result"


def test_turns_with_calls_keep_their_content(spark):
    turns = [
        (1, 0, "user", "hi"), (1, 1, "assistant", '{"tool_calls":[],"content":"no tool"}'), (2, 0, "assistant", '{"tool_calls":[]}'), (3, 0, "user", "q"),
        (3, 1, "assistant", '{"tool_calls":[{"id":"a","function":{"name":"add","arguments":"{\\"b\\":1}"}}],"content":"let me see"}'),
        (4, 0, "assistant", '{"tool_call_id":"a","content":"r","tool_calls":[{"id":"b","name":"add","arguments":{}}]}'), (5, 0, "tool", '{"tool_calls":"none"}'),
    ]
    calls, results = tc.calls_and_results(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    assert {(r.conv_id, r.call_id, r.name, r.arguments) for r in calls.where("name <> 'reply' or conv_id = 5").collect()} == {
        (3, "a", "add", '{"b":1}'), (4, "b", "add", "{}"), (5, "turn-0", "reply", '{"prompt":"{\\"tool_calls\\":\\"none\\"}","role":"tool","turn":0}'),
    }
    assert {(r.conv_id, r.call_id, r.content) for r in results.collect()} == {(1, "turn-0", "no tool"), (2, "turn--1", None), (3, "turn-0", "let me see"), (4, "a", '"r"')}
    assert {r.conv_id for r in tc.link_tool_calls(calls, results).collect()} == {1, 2, 3, 4, 5}


def test_levels_against_brute_force(spark):
    import random

    rng = random.Random(4)
    needs = {(0, f"c{i}"): [f"c{i - 1}"] if i else [] for i in range(1500)}  # a long chain
    for conv in range(1, 60):
        n = rng.randint(1, 12)
        for i in range(n):
            # mostly of earlier calls, now and then of any, so that some lie on cycles or behind them
            needs[conv, f"c{i}"] = [f"c{rng.randrange(i if i and rng.random() < 0.95 else n + 2)}" for _ in range(rng.randint(0, 3))]
    want: dict = {}
    while True:
        new = {}
        for (conv, c), need in needs.items():
            own = [(conv, x) for x in need if (conv, x) in needs]
            if (conv, c) not in want and all(x in want for x in own):
                new[conv, c] = 1 + max((want[x] for x in own), default=-1)
        if not new:
            break
        want |= new
    assert len(want) < len(needs)
    calls = spark.createDataFrame([(conv, c, 0, "add", None, [*need, None], 0) for (conv, c), need in needs.items()], CALLS)
    assert {(r.conv_id, r.call_id): r.level for r in tc.levels(calls).collect()} == want


def test_query_equals_sql_on_repeated_turns(spark, tmp_path):
    """``op6_tool_calls`` and its SQL on turns that repeat, have no partner or no text."""
    import random

    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(9)
    rows = [(rng.randint(0, 30), rng.randint(0, 9), rng.choice(["user", "system", "assistant", "assistant", None]), rng.choice(["a", "b \"q\"", "", None, "ü\n"])) for _ in range(300)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    out = tc.op6_tool_calls(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    twin = con.execute(tc.ORACLE)
    names = [c[0] for c in twin.description]
    assert sorted(map(tuple, out.select(*names).collect()), key=repr) == sorted(twin.fetchall(), key=repr)
    assert {r.status for r in out.collect()} == {"ok", "duplicate_id", "invalid_arguments", "missing_result", "orphan_result"} and out.where("level > 2").count() > 0


# ---- order MinHash against a plain Python version

MASK = (1 << 64) - 1
HIGH = MASK ^ ((1 << 26) - 1)


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def h_long(x, seed=42):
    return xxhash.xxh64_intdigest((x & MASK).to_bytes(8, "little"), seed)


def h_int(x, seed):
    return xxhash.xxh64_intdigest((x & 0xFFFFFFFF).to_bytes(4, "little"), seed)


def plain_tokens(text):
    out = [""]
    for c in text or "":
        if "\u0e01" <= c <= "\u0edf" or "\u3040" <= c <= "\u30ff" or "\u4e00" <= c <= "\u9fff":
            out += [c, ""]
        elif c in " \t\n\v\f\r":
            out.append("")
        else:
            out[-1] += c
    return [w for w in out if w]


def plain_kmers(text, k=om.K):
    """(hash of k-mer and occurrence, position)."""
    w = plain_tokens(text)
    keyed = []
    for i in range(max(1, len(w) - k + 1) if w else 0):
        h = 42
        for x in w[i : i + k]:
            h = xxhash.xxh64_intdigest(x.encode(), h)
        keyed.append((h & HIGH, i))
    seen, u = {}, []
    for h, i in sorted(keyed):
        n = seen[h] = seen.get(h, -1) + 1
        u.append((h_int(n, h_long(h)) & HIGH, i))
    return u


def in_text_order(chosen):
    """The hash of the chosen (hash, position) in text order."""
    out = 42
    for _, h in sorted((i, h) for h, i in chosen):
        out = h_long(h >> 26, out)
    return out & 0x7FFFFFFF


def plain_signature(text, k=om.K, l=om.L, m=om.M, rings=om.RINGS):  # noqa: E741
    """Each permutation by its definition: k-mers sorted by how far they lie above its point of the ring."""
    u = plain_kmers(text, k)
    if not u:
        return [0] * m
    out = []
    for r in range(rings):
        ring = [(h_int(r, h_long(h)) & HIGH if r else h, i) for h, i in u]
        for j in range(m // rings):
            start = (1 << 63) + j * ((1 << 64) // (m // rings))
            out.append(in_text_order(sorted(ring, key=lambda x: ((x[0] | x[1]) - start) & MASK)[:l]))
    return out


def test_fingerprints_equal_plain_version(spark, awkward_rows):
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(awkward_rows)], "i long, text string")
    got = {r.i: r.sig for r in om.fingerprint(df, "text", "sig").collect()}
    assert got == {i: plain_signature(t) for i, (_, t) in enumerate(awkward_rows)}


def test_edited_pairs_equal_plain_version(spark, awkward, awkward_rows):
    order = sorted(awkward_rows, key=lambda r: (r[0] is None, -(r[0] or 0), ~signed(xxhash.xxh64_intdigest((r[1] or "").encode(), 42))))
    want = []
    for at, (i, text) in enumerate(order):
        text, after = text or "", order[(at + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = plain_signature(text), plain_signature(edited), plain_signature(after)
        share = lambda p, q: sum(x == y for x, y in zip(p, q)) / om.M
        want.append((str(i), len(text), hashlib.sha256(edited.encode()).hexdigest(), share(a, b), share(a, c)))
    rows = om.edited_pairs(awkward).select("doc_id", "n_chars", F.sha2("edited", 256).alias("e"), om.likeness(F.col("sig"), F.col("edited_sig")).alias("x"), om.likeness(F.col("sig"), F.col("next_sig")).alias("y"))
    assert sorted((str(r.doc_id), r.n_chars, r.e, r.x, r.y) for r in rows.collect()) == sorted(want)


def test_likeness_estimates_order_minhash():
    """Against permutations that are all independent: the same mean, and a deviation little above theirs."""
    import random
    import statistics

    rng = random.Random(3)
    got, want = [], []
    for _ in range(150):
        w = [f"w{rng.randrange(10**6)}" for _ in range(30)]
        v = list(w)
        v[rng.randrange(30)] = "changed"
        a, b = " ".join(w), " ".join(v)
        share = lambda p, q: sum(x == y for x, y in zip(p, q)) / len(p)
        got.append(share(plain_signature(a), plain_signature(b)))
        own = []
        for text in (a, b):
            u = plain_kmers(text)
            own.append([in_text_order(sorted((h_int(seed, h_long(h)) & HIGH, i) for h, i in u)[: om.L]) for seed in range(1000, 1000 + om.M)])
        want.append(share(*own))
    print("likeness: rings", statistics.mean(got), statistics.stdev(got), "independent", statistics.mean(want), statistics.stdev(want))
    assert abs(statistics.mean(got) - statistics.mean(want)) < 0.015
    assert statistics.stdev(got) < 1.35 * statistics.stdev(want)


def test_scripts_without_spaces_have_kmers(spark):
    a = "\u6211\u4eec\u7684\u4e2d\u56fd\u4eba\u6c11\u5927\u5b66\u751f\u6d3b" * 9
    rows = om.fingerprint(om.fingerprint(spark.createDataFrame([(a, a.replace("\u5b66\u751f", "\u5b66 \u8001", 2), a[::-1])], "a string, b string, c string"), "a", "x"), "b", "y")
    r = om.fingerprint(rows, "c", "z").select(om.likeness(F.col("x"), F.col("y")).alias("near"), om.likeness(F.col("x"), F.col("z")).alias("far"), "x").first()
    assert 0.6 < r.near < 1 and r.far < 0.2 and list(r.x) == plain_signature(a)


def test_order_matters_to_the_fingerprint(spark):
    a = " ".join(f"w{i}" for i in range(200))
    b = " ".join([f"w{i}" for i in range(100, 200)] + [f"w{i}" for i in range(100)])
    c = a.replace("w57 ", "changed ")
    rows = om.fingerprint(spark.createDataFrame([(a, b, c)], "a string, b string, c string"), "a", "sa")
    rows = om.fingerprint(om.fingerprint(rows, "b", "sb"), "c", "sc")
    r = rows.select(om.likeness(F.col("sa"), F.col("sb")).alias("moved"), om.likeness(F.col("sa"), F.col("sc")).alias("near")).first()
    assert r.near > 0.85 and r.moved < 0.75 < r.near


def test_edited_pairs_of_none_and_one(spark, empty):
    assert om.edited_pairs(empty).count() == 0
    one = om.edited_pairs(spark.createDataFrame([(1, "abcd ef")], "doc_id long, text string")).first()
    assert one.edited == "abcdabc" and one.sig == one.next_sig
