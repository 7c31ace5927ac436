"""Language identification, lattice scoring, the quality classifier and the pipeline."""

from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakewright.llm import langid as li
from lakewright.llm import lattice_lm as lm
from lakewright.llm import quality as q
from lakewright.llm import registry

LANGS = {"aa": ("ka", "lo", "mi", "ne"), "bb": ("sch", "ung", "ver", "eit"), "cc": ("ção", "que", "ões", "lha")}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(LANGS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


# ---- language identification


def test_backpropagation_matches_finite_differences():
    net = li.Network(["a", "b", "c"], hidden=3, seed=1)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    rng = np.random.default_rng(0)
    data, target = rng.integers(0, 256, (7, 5)).astype(np.uint8), rng.integers(0, 3, 5)
    _, grad = net.gradients(data, target)
    for name, w in net.w.items():
        spots = [tuple(rng.integers(0, s) for s in w.shape) for _ in range(6)]
        if name == "x":
            spots = [(d, int(data[t, 0]), int(g)) for d in (0, 1) for t in (0, 3) for g in (0, 4, 8)]
        for at in spots:
            eps, keep = 1e-2, w[at]
            w[at] = keep + eps
            up, _ = net.gradients(data, target)
            w[at] = keep - eps
            down, _ = net.gradients(data, target)
            w[at] = keep
            assert grad[name][at] == pytest.approx((up - down) / (2 * eps), abs=2e-4)


def test_windows_cover_every_position_once():
    net = li.Network(["a", "b"])
    rng = random.Random(5)
    texts = [bytes(rng.randint(32, 122) for _ in range(n)) for n in (1, 5, li.SPAN - 1, li.SPAN, li.SPAN + 1, 3 * li.SPAN + 7)]
    p = li.document_probabilities(net, texts)
    assert np.allclose(p.sum(axis=1), 1, atol=1e-4)
    # a text of whole windows: the mean over its windows
    one = texts[3]
    alone = net.probabilities(np.frombuffer(one, np.uint8)[:, None])[:, 0].mean(axis=0)
    assert np.allclose(p[3], alone, atol=1e-5)
    # batches do not change a result
    assert np.allclose(li.document_probabilities(net, [texts[5]])[0], p[5], atol=1e-5)


def test_held_out_accuracy_and_edges(spark):
    rng = random.Random(9)
    rows = [(i, text(rng, lang, rng.randint(3, 60)), lang) for i, lang in enumerate(list(LANGS) * 60)]
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 !?", "aa"), (1003, text(rng, "bb", 5000), None), (None, text(rng, "cc", 20), None)]
    docs = spark.createDataFrame([(i, t, lang, "p", 1.5) for i, t, lang in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    net = li.fit(li.training_sample(docs.where(li.remainder(F.col("doc_id")) != 1)), steps=150)
    out = li.identify(docs, net).select("row.doc_id", "row.lang", "lang_pred", "score").collect()
    assert len(out) == len(rows)
    held = [r for r in out if r.doc_id is not None and r.doc_id < 1000 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95
    got = {r.doc_id: (r.lang_pred, r.score) for r in out}
    assert got[1000] == got[1001] == got[1002] == ("und", 0.0)
    assert got[1003][0] == "bb" and got[None][0] == "cc" and all(0 <= s <= 1 for _, s in got.values())


def test_letters():
    assert not any(map(li.has_letter, ["", "½ ² ①", "12 !?", "٣", "\u20ac\n"]))
    assert all(map(li.has_letter, ["½a", "é", "1 中", "ª", "\u0301я"]))


def test_nothing_to_learn(spark, awkward, empty):
    assert li.training_sample(empty) == []
    net = li.fit([])
    assert {r.lang_pred for r in li.identify(awkward, net).collect()} == {"und"}
    one = li.fit(li.training_sample(awkward))
    assert {r.lang_pred for r in li.identify(awkward, one).collect()} == {"und", "en"}
    assert li.identify(empty, one).count() == 0


# ---- lattice scoring


def segmentations(word, pieces):
    if not word:
        yield []
    for j in range(1, len(word) + 1):
        if word[:j] in pieces:
            for rest in segmentations(word[j:], pieces):
                yield [word[:j], *rest]


PIECES = {"▁": 0.1, "▁a": 0.1, "a": 0.2, "b": 0.1, "ab": 0.2, "ba": 0.05, "▁ab": 0.05} | {chr(0xDC00 + b): 0.2 / 256 for b in range(256)}


def test_lattice_sums_all_segmentations():
    model = lm.Lattice({p: math.log(w) for p, w in PIECES.items()}, go_on=0.6)
    for word in ("a", "ab", "abab", "baab", "abbaabab" * 3):
        want = sum(math.prod(PIECES[p] for p in s) * 0.6 ** (len(s) - 1) * 0.4 for s in segmentations("▁" + word, PIECES))
        assert model.logq(word) == pytest.approx(math.log(want))
    # a character without a piece is spelt in bytes
    assert model.logq("é") == pytest.approx(math.log(0.1 * (0.2 / 256) ** 2 * 0.6**2 * 0.4))
    assert math.isfinite(model.logq("ab" * 5000))


@pytest.mark.parametrize("frequent", [50_000, 5, 0])
def test_scores_equal_plain_version(spark, awkward, awkward_rows, monkeypatch, frequent):
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    rows = {}
    for r in lm.score_documents(awkward).collect():
        rows.setdefault(r.doc_id, []).append(r)
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    tokens = [(i, lm.tokens_of(t)) for i, t in awkward_rows]
    count, n = {}, 0
    for i, w in tokens:
        if not held(i):
            for x in [*w, None]:
                count[x] = count.get(x, 0) + 1
                n += 1
    v = len(count)
    want = {}
    for i, w in tokens:
        base = sum(math.log10((count.get(x, 0) + 1) / (n + v + 1)) for x in [*w, None])
        want.setdefault(i, []).append((held(i), len(w) + 1, sum(x in count for x in [*w, None]), n, pytest.approx(base)))
    for i, own in rows.items():
        got = sorted(((r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in own), key=lambda x: x[1])
        assert got == sorted(want[i], key=lambda x: x[1])
        assert all(r.score <= 0 and math.isfinite(r.score) for r in own)
    assert sum(map(len, rows.values())) == len(awkward_rows)
    # the same word has the same price in every document, wherever it is counted
    single = {len(w): r for (i, w), r in ((x, rows[x[0]][0]) for x in tokens if x[0] in (5, 6))}
    assert len({round(r.score, 9) for r in single.values()}) == 1


def plain_pieces():
    """Piece probabilities, read from the vocabulary once more."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=lm.VOCABULARY)
    weight = {}
    for k in range(model.get_piece_size()):
        if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k)):
            piece = "".join(c.lower() if c.isascii() else c for c in model.id_to_piece(k))
            weight[piece] = weight.get(piece, 0) + 1 / (lm.ZIPF_SHIFT - model.get_score(k))
    total = sum(weight.values())
    return {p: (1 - lm.BYTE_MASS) * w / total for p, w in weight.items()}


def plain_marginal(word, pieces):
    """Sum over all segmentations by recursion on the first piece; no trie, no logarithms."""
    done = {}

    def ways(rest):
        if not rest:
            return 0.25 / 0.75
        if rest not in done:
            first = 0.0 if rest[0] in pieces else math.prod([0.75 * lm.BYTE_MASS / 256] * len(rest[0].encode())) * ways(rest[1:])
            done[rest] = first + sum(0.75 * pieces[rest[:n]] * ways(rest[n:]) for n in range(1, len(rest) + 1) if rest[:n] in pieces)
        return done[rest]

    return ways("\u2581" + word)


def test_query_scores_equal_plain_version(spark, tmp_path):
    """``op10_lattice`` against sums over all segmentations of every word."""
    words = ["the", "The", "lattice", "unbelievable", "na\u00efve", "x\u4e2dy", "zzqj", "don't", "3.14", "\u2581odd"]
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))) for i in range(40)] + [(None, "the"), (41, None), (42, "only-here " * 3)]
    spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id long, text string, word string, n int").write.parquet(str(tmp_path / "documents.parquet"))
    pieces, low = plain_pieces(), lambda t: "".join(c.lower() if c.isascii() else c for c in t or "").split()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    count = {}
    for i, t in rows:
        for w in [] if held(i) else [*low(t), None]:
            count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)

    def price(w):
        c = count.get(w, 0)
        return math.log10((c - 0.75) / n if w is None else max(c - 0.75, 0) / n + 0.75 * v / n * plain_marginal(w, pieces))

    want = sorted((str(i), held(i), pytest.approx(sum(map(price, [*low(t), None])))) for i, t in rows)
    got = sorted((str(r.doc_id), r.held_out, r.score) for r in lm.op10_lattice(spark, str(tmp_path)).collect())
    assert got == want and any(map(held, range(40)))


def test_scores_of_nothing(spark, empty):
    assert lm.score_documents(empty).count() == 0
    only = lm.score_documents(spark.createDataFrame([(11, "x y")], "doc_id long, text string")).first()  # 11 is held out
    assert math.isfinite(only.score) and math.isfinite(only.base_score)


# ---- quality


def labelled(spark, n=400):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        bad, toxic = i % 5 == 0, i % 7 == 0
        t = text(rng, "aa", 40)
        if bad:
            t = " ".join(w.upper() + "!!" for w in t.split())
        if toxic:
            t += " " + " ".join(rng.sample(["vilea", "vileb", "vilec", "viled"], 2))
        rows.append((i, t, f"h{i % 4}", f"p{i % 3}", "clash"))
        if i % 2:
            labels.append((i, int(not bad), int(toxic)))
    rows += [(900, None, None, None, "c"), (901, "", "h0", "p0", "c"), (None, text(rng, "aa", 30), "new", "p9", "c"), (1, rows[1][1], "h1", "p1", "c")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, site_host string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_classifier_finds_planted_kinds(spark):
    docs, labels = labelled(spark)
    out = q.judge(docs, labels, F.col("source"), F.col("lang")).select("row.*", "quality", "toxic", "kept").collect()
    assert len(out) == 404
    for r in out:
        if r.doc_id is not None and r.doc_id < 400:
            assert (r.toxic >= 0.5) == (r.doc_id % 7 == 0)
            assert (r.quality < 0.5) == (r.doc_id % 5 == 0)
            assert r.kept == (r.doc_id % 7 != 0 and r.doc_id % 5 != 0)
    assert [r.kept for r in out if r.doc_id is None] == [True]


def test_sparse_sites_lean_on_their_parents(spark):
    rows = [("big", "a", 10_000, 1000.0, 0.0), ("big", "b", 10, 9.0, 0.0), ("bad", "a", 10_000, 9000.0, 0.0), ("one", "a", 1, 1.0, 0.0)]
    got = {(r.host, r.path): r for r in q.site_posteriors(spark.createDataFrame(rows, "host string, path string, n long, s_quality double, s_toxic double")).collect()}
    prior = (1000 + 9 + 9000 + 1) / 20011
    assert got["big", "a"].prior_quality == pytest.approx(prior)
    assert got["big", "a"].site_quality == pytest.approx(0.1, abs=0.01)
    assert got["bad", "a"].site_quality == pytest.approx(0.9, abs=0.01)
    assert 0.1 < got["big", "b"].site_quality < 0.9
    assert prior < got["one", "a"].site_quality < 1


def plain_judgements(docs, labels):
    """Brute force of the posteriors: every document's site is added up anew, without the document."""
    model = q.fit([(t, m) for _, t, m in sorted(docs.sample)])
    rows = [(i, h, p, *model.logits(*q.features(t, {}))) for i, t, h, p in docs.rows]
    sig = lambda z: 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
    odds = lambda x: math.log(min(max(x, 1e-6), 1 - 1e-6) / (1 - min(max(x, 1e-6), 1 - 1e-6)))
    out = []
    for k, t in enumerate(q.TARGETS):
        e = [r[3 + k] for r in rows]
        own = [sig(z) for z in e]
        x = [own[j] if labels.get(r[0], {}).get(t) is None else labels[r[0]][t] for j, r in enumerate(rows)]
        paths, hosts = {}, {}
        for r, v in zip(rows, x):
            paths.setdefault((r[1], r[2]), []).append(v)
            hosts.setdefault(r[1], []).append(v)
        n, m = len(x), sum(x) / len(x)
        sq = lambda groups: sum(sum(g) ** 2 / len(g) for g in groups.values())
        host_var = max((sq(hosts) - n * m * m - (len(hosts) - 1) * m * (1 - m)) / max(n - sum(len(g) ** 2 for g in hosts.values()) / n, 1), 1e-6)
        within = (sum(x) - sq(hosts)) / n
        path_var = max((sq(paths) - sq(hosts) - (len(paths) - len(hosts)) * within) / max(n - sum(len(g) ** 2 / len(hosts[h]) for (h, _), g in paths.items()), 1), 1e-6)
        wh, wp = (max(min(v, 1e6), 1) for v in (m * (1 - m) / host_var - 1, within / path_var - 1))
        got = []
        for j, r in enumerate(rows):
            h, s = hosts[r[1]], paths[r[1], r[2]]
            host = (max(sum(h) - own[j], 0) + wh * m) / (len(h) - 1 + wh)
            site = (max(sum(s) - own[j], 0) + wp * host) / (len(s) - 1 + wp)
            got.append(sig(e[j] + odds(site) - odds(m)))
        out.append(got)
    return sorted((str(r[0]), a, b) for r, a, b in zip(rows, *out))


def test_query_equals_brute_force(spark, tmp_path):
    """``op1_empirical_bayes`` on sites of all sizes, with labels that lack a target."""
    rng = random.Random(6)
    rows, marks = [], {}
    for i in range(300):
        host = rng.choice(["a", "a", "a", "b", "c", None, f"h{i}"])
        bad, toxic = rng.random() < {"a": 0.1, "b": 0.7}.get(host, 0.3), rng.random() < 0.2
        t = text(rng, "aa", rng.randint(5, 40)) + (" FREE!! WIN!! $$$" * 3 if bad else "") + (" vilea vileb" if toxic else "")
        rows.append((i if i % 50 else None, rng.choice([t, t, t, None]) if i % 9 == 0 else t, host, rng.choice(["p", "q", None])))
        if i % 3 and i % 50:
            marks[i] = {"quality": None if i % 11 == 0 else float(not bad), "toxic": None if i % 13 == 0 else float(toxic)}
    spark.createDataFrame([(i, t, p, h, 0.5) for i, t, h, p in rows], "doc_id long, text string, lang string, source string, n double").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, m["quality"], m["toxic"]) for i, m in marks.items()] + [(9999, 1.0, 1.0), (None, 0.0, 1.0)], "doc_id long, quality double, toxic double").write.parquet(str(tmp_path / "labels.parquet"))
    h = {(r.doc_id, r.text): r.h for r in spark.read.parquet(str(tmp_path / "documents.parquet")).select("doc_id", "text", F.xxhash64("doc_id", "text").alias("h")).collect()}

    class docs:
        sample = [(h[i, t], t, marks[i]) for i, t, _, _ in rows if i in marks]

    docs.rows = rows
    got = sorted((str(r.doc_id), r.quality, r.toxic, r.kept) for r in q.op1_empirical_bayes(spark, str(tmp_path)).collect())
    want = plain_judgements(docs, marks)
    assert [(a, pytest.approx(b), pytest.approx(c), b >= 0.5 and c < 0.5) for a, b, c in want] == got


def test_sample_is_bounded(spark, monkeypatch):
    docs, labels = labelled(spark)
    twice = docs.unionByName(docs).unionByName(docs)
    monkeypatch.setattr(q, "SAMPLE_BYTES", 3000)
    rows = q.labelled_sample(twice, labels, 50)
    assert 5 < len(rows) <= 50 and len({t for t, _ in rows}) == len(rows) and sum(len(t) for t, _ in rows) <= 3000
    monkeypatch.setattr(q, "SAMPLE_BYTES", 1)
    assert q.labelled_sample(docs.where("doc_id < 100"), labels) == []


def test_without_labels_nothing_is_rejected(spark, awkward, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert q.judge(awkward, none, F.col("source"), F.col("lang")).where("not kept").count() == 0
    assert q.judge(empty, none, F.col("source"), F.col("lang")).count() == 0
    nulls = spark.createDataFrame([(1, None, 1), (None, 1, 0), (2, 1, None), (7777, 0, 0)], "doc_id long, quality int, toxic int")
    assert q.judge(awkward, nulls, F.col("source"), F.col("lang")).count() == awkward.count()


# ---- the pipeline and the registry


def test_stages_keep_columns_and_take_effect(spark, sf_dir):
    import corpus_pipeline as cp
    from lakewright.sources.shared import materialise

    assert [n for n, _ in cp.STAGES] == ["language", "quality", "near_duplicates", "decontamination", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("row", F.lit(1)).withColumn("__lakewright", F.lit("x"))
    odd = [(None, None, None, None, None), (90_001, "", "en", "src0", 0), (90_002, None, None, None, None)]
    docs = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long"), allowMissingColumns=True)
    before = docs.count()
    for name, stage in cp.STAGES[:-1]:
        after = materialise(stage(spark, docs, sf_dir), name)
        assert after.columns == docs.columns
        assert 0 < after.count() <= docs.count()
        if name == "language":
            assert after.where("doc_id in (90001, 90002) or doc_id is null").count() == 0
        docs = after
    assert docs.count() < before
    assert docs.groupBy("doc_id").count().where("count > 1").count() == 0
    last = cp.packed(spark, docs, sf_dir)
    assert last.count() == docs.count()


def test_stages_take_empty_tables(spark, sf_dir):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.count() == 0


def test_registry_names():
    names = registry.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10
    assert set(registry.oracle_sql()) <= set(names)
