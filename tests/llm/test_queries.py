"""Every registered query on a folder of awkward tables, and on empty ones, by what its contract says."""

from __future__ import annotations

import hashlib
import re
import zlib

import pytest

from lakewright.llm import registry
from test_corpus import plain_classes, plain_hits


ITEMS = [(1, "ka lo mi ne su ka lo mi ne su ka lo"), (2, "the Same, the same"), (3, None), (4, ""), (None, "single"), (10, "two words")]


@pytest.fixture(scope="module")
def folder(spark, awkward, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    awkward.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (3, 0, 1), (None, 1, 1), (9, None, 0), (105, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, "http://x.com/de/1", None), (1, None, ""), (None, "http://a.org", "<p>"), (2, "nothing", "<link rel=canonical href=/q>")], "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    spark.createDataFrame([(1, 0, "user", None), (1, 1, "assistant", "a"), (None, 0, None, ""), (2, None, "user", "x")], "conv_id long, turn long, role string, text string").write.parquet(f"{at}/conversations.parquet")
    return at


@pytest.fixture(scope="module")
def bare(spark, folder, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "benchmark", "labels", "pages", "conversations"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{at}/{name}.parquet")
    return at


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_empty_tables_give_no_rows(spark, bare, name):
    assert registry.queries()[name](spark, bare).count() == 0


def rows_of(spark, folder, name):
    return registry.queries()[name](spark, folder).collect()


def held(i, by, rest):
    return zlib.crc32(("" if i is None else str(i)).encode()) % by == rest


def test_op1(spark, folder, awkward_rows):
    rows = rows_of(spark, folder, "op1_empirical_bayes")
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _ in awkward_rows)
    assert all(0 <= r.quality <= 1 and 0 <= r.toxic <= 1 and r.kept == (r.quality >= 0.5 and r.toxic < 0.5) for r in rows)


def test_op2(spark, folder):
    assert sorted(map(str, (tuple(r)[:5] for r in rows_of(spark, folder, "op2_redirects")))) == sorted(
        map(str, [(1, "x.com", "/de/1", "com/de/", "block"), (1, "", "", None, "allow"), (None, "a.org", "", None, "allow"), (2, "", "", None, "allow")])
    )


def test_op3(spark, folder, awkward_rows):
    want = []
    for (i, n, hit, items), (j, _) in zip(plain_hits(awkward_rows, ITEMS, 10), sorted(awkward_rows, key=lambda r: str(r[0]))):
        names = sorted(x for x in items if x != "None")
        want.append((i, n, hit, len(items), hashlib.sha256(",".join(names).encode()).hexdigest(), hit > 0))
    got = [(str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows_of(spark, folder, "op3_positional_index")]
    assert sorted(got) == sorted(want) and any(r[-1] for r in got)


def test_op4(spark, folder, awkward_rows):
    rows = rows_of(spark, folder, "op4_karmarkar_karp")
    key = lambda t: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == sorted((str(i), *key(t)) for i, t in awkward_rows)
    assert {r.law for r in rows} == {"bytes"} and all(r.grown_shard is None and 0 <= r.shard < 16 for r in rows)
    for s in range(16):
        own = sorted(r.slot for r in rows if r.shard == s)
        assert own == list(range(len(own)))
    shard_of = {}
    for r in rows:
        assert shard_of.setdefault((r.size, r.text_crc32), r.shard) == r.shard  # equal texts stay together
    total = [sum(r.size for r in rows if r.shard == s) for s in range(16)]
    groups = {}
    for r in rows:
        groups[r.size, r.text_crc32] = groups.get((r.size, r.text_crc32), 0) + r.size
    # a group is not cut, so the fullest shard is the largest group's or near the mean
    assert max(total) <= max(max(groups.values()), 1.2 * sum(total) / 16)


def test_op5(spark, folder, awkward_rows):
    rows = rows_of(spark, folder, "op5_length_buckets")
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _ in awkward_rows)
    assert all(r.n_tokens <= r.bucket_len for r in rows) and len({(r.bucket, r.batch, r.place) for r in rows}) == len(rows)


def test_op6(spark, folder):
    assert sorted((str(r.conv_id), r.call_id, r.status) for r in rows_of(spark, folder, "op6_tool_calls")) == [("1", "turn-0", "ok"), ("2", None, "invalid_arguments"), ("None", "turn-0", "missing_result")]


def test_op7(spark, folder, awkward_rows):
    rows = rows_of(spark, folder, "op7_order_minhash")
    texts = {}
    for i, t in awkward_rows:
        texts.setdefault(i, []).append(t or "")
    for r in rows:
        assert r.n_chars in {len(t) for t in texts[r.doc_id]} and re.fullmatch("[0-9a-f]{512}", r.fingerprint) and re.fullmatch("[0-9a-f]{512}", r.edited_fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert len({r.fingerprint for r in rows if r.doc_id in (1, 2)}) == 1 and len(rows) == len(awkward_rows)
    # after the largest id comes the next smaller one
    two = sorted((i for i in texts if i is not None and i >= 100), reverse=True)[:2]
    a, b = (texts[i][0] for i in two)
    half = len(a) // 2
    assert [r.edited_sha256 for r in rows if r.doc_id == two[0]] == [hashlib.sha256((a[: len(a) - half] + b[:half]).encode()).hexdigest()]


def test_op8(spark, folder, awkward_rows):
    rows = rows_of(spark, folder, "op8_bigru")
    assert sorted((str(r.doc_id), r.held_out) for r in rows) == sorted((str(i), held(i, 3, 1)) for i, _ in awkward_rows)
    assert {r.lang_pred for r in rows} == {"en", "und"} and all(r.lang_pred == "und" for r in rows if r.doc_id in (4, 5, 6, 13))


def test_op9(spark, folder, awkward_rows):
    rows = rows_of(spark, folder, "op9_minmax")
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in rows) == plain_classes(awkward_rows, 3, 85)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_op10(spark, folder, awkward_rows):
    rows = rows_of(spark, folder, "op10_lattice")
    n = sum(len((t or "").split()) + 1 for i, t in awkward_rows if not held(i, 7, 2))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens) for r in rows) == sorted((str(i), held(i, 7, 2), len((t or "").split()) + 1) for i, t in awkward_rows)
    assert {r.train_tokens for r in rows} == {n} and all(r.n_known <= r.n_tokens and r.score < 0 and r.base_score < 0 for r in rows)


def test_pipeline_keeps_what_brute_force_keeps(spark, folder, awkward_rows):
    """The stages that plain Python can redo, on what the one before kept: near duplicates and decontamination."""
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    after = cp.near_duplicates(spark, docs, folder)
    texts = sorted({t for _, t in awkward_rows if t and t.split()})
    classes = {texts[int(i)]: c for i, _, c in plain_classes(list(enumerate(texts)), 5, 80)}
    kept = [(r.doc_id, r.text) for r in after.collect()]
    assert sorted(classes[t] for _, t in kept if t in classes) == sorted(set(classes.values()))
    assert sum(t not in classes for _, t in kept) == sum(t not in classes for _, t in awkward_rows)
    clean = cp.uncontaminated(spark, after, folder)
    hits = [h[2] for h in plain_hits(sorted(kept, key=lambda r: str(r[0])), ITEMS, 10)]
    assert clean.count() == hits.count(0) < len(kept) and clean.columns == docs.columns
    packed = cp.packed(spark, clean, folder)
    assert packed.count() == clean.count()
