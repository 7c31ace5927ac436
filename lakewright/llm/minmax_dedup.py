"""Near-duplicate classes by min-max hashing.

A document is the set of its distinct word shingles, each a 64-bit hash.  Every
permutation gives two signature values, the least and the greatest hash, so
``PERMUTATIONS`` evaluations give twice as many values; they are banded by
``ROWS``.  Two sets are compared if they share a band, and linked if their full
sets are similar enough; nothing else decides, whatever the size of a group:

1. equal sets collapse to one node;
2. nodes that share a band are joined to the least one of it, and the components
   of these edges are the candidate clusters;
3. a cluster is compared in one task, band by band.  Pairs already connected by
   other links need no comparison, and of several shared bands the first counts.
   A cluster of more than ``SHINGLES`` shingles is dealt to a task for each of its
   bands, and a band that is itself heavier into blocks, each pair of blocks
   being a task;
4. the components of the links are the classes.

With 24 bands of 5 values a pair of similarity 0.85 shares no band with a chance
of 8e-7, one of 0.8 with 7e-5.  Tens of thousands of different texts that share
one band cost block pairs, which grow with the square of the band over the block
size; no pair of documents is ever a row of its own.

Defined results: a document without words, or with null text, has the empty set
and links with nothing; one of fewer words than a shingle is one shingle.  In
:func:`near_duplicates` rows that share a doc_id are one node, so their texts are
linked through it; a null doc_id links with nothing and has a null class; repeated
rows each give a row.  :func:`distinct_texts` looks at texts alone: one row of each
class stays, the least by (doc_id with nulls last, hash of the text), and rows
without words stay.  An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lakewright.llm.common import connected_components
from lakewright.sources.shared import materialise

BANDS, ROWS = 24, 5
PERMUTATIONS = BANDS * ROWS // 2
#: Shingles whose sets one task compares.
SHINGLES = 1 << 20
#: Word hashes that a task remembers.
CACHE = 1 << 19

_MIX = np.random.default_rng(20).integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


def shingles(text: str | None, k: int, hashes: _Hashes) -> np.ndarray:
    """Ascending distinct hashes of the ``k``-word shingles."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter(map(hashes.__getitem__, w), np.uint64, len(w))
    if not len(h):
        return h
    k = min(k, len(h))
    out = np.full(len(h) - k + 1, np.uint64(k))
    for i in range(k):
        out = (out ^ h[i : len(h) - k + 1 + i]) * _A
        out ^= out >> np.uint64(29)
    out *= _B
    out ^= out >> np.uint64(32)
    return np.unique(out)


def bands_of(s: np.ndarray) -> np.ndarray:
    """One hash a band, of the least and greatest values under each permutation."""
    low = np.empty(PERMUTATIONS, np.uint64)
    high = np.empty(PERMUTATIONS, np.uint64)
    step = max(1, 65_536 // len(s))
    for i in range(0, PERMUTATIONS, step):
        p = s[None, :] * _MIX[i : i + step, None]
        p ^= p >> np.uint64(31)
        p *= _C
        low[i : i + step], high[i : i + step] = p.min(axis=1), p.max(axis=1)
    values = np.stack([low, high], axis=1).reshape(BANDS, ROWS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64) * _B
    for r in range(ROWS):
        out = (out ^ values[:, r]) * _A
        out ^= out >> np.uint64(30)
    return out.view(np.int64)


def text_key() -> Column:
    return F.xxhash64("text")


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, text_key, n_shingles, set_key, bands; the last two null for the empty set."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            sizes, keys, bands = [], [], []
            for text in batch.column(2):
                s = shingles(text.as_py(), k, hashes)
                sizes.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                bands.append(bands_of(s) if len(s) else None)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long"), text_key().alias("text_key"), "text")
    return rows.mapInArrow(sign, "doc_id long, text_key long, n_shingles long, set_key binary, bands array<long>")


def exact_links(sets: list[np.ndarray], bands: np.ndarray, percent: int, side: np.ndarray | None = None) -> np.ndarray:
    """Component number of each set under links of at least ``percent`` similarity.

    ``bands`` has a row a set; two sets are compared if they are equal in a column.  With ``side``
    only sets of different sides are.
    """
    size = np.array([len(s) for s in sets], dtype=np.int64)
    at = np.concatenate([[0], np.cumsum(size)])
    values, code = np.unique(np.concatenate(sets), return_inverse=True)
    marked = np.zeros(len(values), dtype=bool)
    label = np.arange(len(sets))
    member = {i: [i] for i in range(len(sets))}

    def similar(p: int, others: np.ndarray) -> np.ndarray:
        n = size[others]
        begin = np.concatenate([[0], np.cumsum(n)[:-1]])
        spot = np.repeat(at[others] - begin, n) + np.arange(n.sum())
        own = code[at[p] : at[p + 1]]
        marked[own] = True
        both = np.add.reduceat(marked[code[spot]], begin, dtype=np.int64)
        marked[own] = False
        return others[100 * both >= percent * (n + size[p] - both)]

    for c in range(bands.shape[1]):
        order = np.argsort(bands[:, c], kind="stable")
        cut = np.flatnonzero(np.diff(bands[order, c])) + 1
        for g in np.split(order, cut):
            done = np.zeros(len(g), dtype=bool)
            while len(g) > 1:
                # every pair of different components has an end outside the largest one
                names, which, n = np.unique(label[g], return_inverse=True, return_counts=True)
                todo = np.flatnonzero((which != n.argmax()) & ~done)
                if len(names) == 1 or not len(todo):
                    break
                grown = False
                for t in todo:
                    p, done[t] = g[t], True
                    others = g[label[g] != label[p]]
                    others = others[(100 * size[others] >= percent * size[p]) & (100 * size[p] >= percent * size[others])]
                    if side is not None:
                        others = others[side[others] != side[p]]
                    others = others[(bands[others, :c] != bands[p, :c]).all(axis=1)]
                    if len(others):
                        for other in set(label[similar(p, others)].tolist()):
                            a, b = sorted((int(label[p]), other), key=lambda x: len(member[x]))
                            label[member[a]] = b
                            member[b] += member.pop(a)
                            grown = True
                    if grown:
                        break
    return label


def _classes(docs: DataFrame, k: int, percent: int, by_id: bool) -> tuple[DataFrame, DataFrame]:
    """The signatures, and for every set key the least row of its class: (set_key, kept: struct<none, doc_id, text_key>)."""
    signed = materialise(signatures(docs, k), "signatures")
    full = signed.where("set_key is not null and doc_id is not null" if by_id else "set_key is not null")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    sets = full.groupBy("set_key").agg(F.min(row).alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    sets = materialise(sets.withColumn("node", F.monotonically_increasing_id()), "sets")
    keyed = sets.select("node", F.explode("bands").alias("band"))
    # written first, so that the join below is of two plain exchanges, whose hot bands can be split
    shared = materialise(keyed.groupBy("band").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("c")).where("c > 1"), "shared")
    banded = materialise(keyed.join(shared, "band").select("node", "band", "least"), "banded")
    near = connected_components(banded.where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")))
    member = near.select("node", F.col("component").alias("cluster")).join(sets.select("node", "rep", "n", "bands"), "node")
    links = _verify(docs, materialise(member, "members"), banded, k, percent)
    if by_id:
        links = links.unionByName(_same_id(full, sets))
    linked = connected_components(links)
    linked = materialise(linked.join(sets.select("node", "rep"), "node"), "linked")
    least = materialise(linked.groupBy("component").agg(F.min("rep").alias("kept")), "least")
    linked = linked.join(least, "component").select("node", "kept")
    return signed, sets.select("set_key", "node", "rep").join(linked, "node", "left").select("set_key", F.coalesce("kept", "rep").alias("kept"))


def _same_id(full: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges (a, b) between the different sets that stand under one doc_id."""
    several = full.groupBy("doc_id").agg(F.min("set_key").alias("first"), F.max("set_key").alias("last")).where("first <> last")
    pairs = full.join(several, "doc_id").where("set_key <> first").select("first", "set_key").distinct()
    node = lambda key, out: sets.select(F.col("set_key").alias(key), F.col("node").alias(out))
    return pairs.join(node("first", "a"), "first").join(node("set_key", "b"), "set_key").select("a", "b")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """For every row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id."""
    signed, classes = _classes(docs, k, percent, by_id=True)
    alone = F.col("set_key").isNull() | F.col("doc_id").isNull()
    empty = signed.where(alone).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    full = signed.where(~alone).select("doc_id", "n_shingles", "set_key")
    named = classes.select("set_key", F.col("kept.doc_id").alias("component_id"))
    return full.join(named, "set_key").select("doc_id", "n_shingles", "component_id").unionByName(empty)


def distinct_texts(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay: one of each class of texts, and all without words."""
    _, classes = _classes(docs, k, percent, by_id=False)
    keep = classes.select(F.col("kept.doc_id").alias("__lakewright_id"), F.col("kept.text_key").alias("__lakewright_text")).distinct()
    words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    keyed = docs.where(words).withColumn("__lakewright_key", text_key())
    named = keyed.join(keep, F.col("doc_id").cast("long").eqNullSafe(F.col("__lakewright_id")) & (F.col("__lakewright_key") == F.col("__lakewright_text")), "left_semi")
    # rows equal in id and text are copies too; which stays does not depend on their order
    plain = [c for c, t in docs.dtypes if "map<" not in t and "variant" not in t]
    first = F.row_number().over(Window.partitionBy("doc_id", "__lakewright_key").orderBy(F.xxhash64(*(F.col(f"`{c}`") for c in plain))))
    one = named.withColumn("__lakewright_copy", first).where("__lakewright_copy = 1")
    return one.drop("__lakewright_copy", "__lakewright_key").unionByName(docs.where(~words))


def _tasks(member: DataFrame, banded: DataFrame) -> DataFrame:
    """(node, task, i, j, own, side, bands): which sets each task compares.

    Inside a task, sets of the same ``own`` meet.  Clusters of up to ``SHINGLES`` are whole, several
    to a task; the members of a heavier one meet band by band, and those of a heavier band in pairs
    of blocks, of which ``side`` is the block.
    """
    # at most one row for every SHINGLES shingles
    heavy = materialise(member.groupBy("cluster").agg(F.sum("n").alias("weight")).where(F.col("weight") > SHINGLES).select("cluster"), "heavy")
    light = member.join(heavy, "cluster", "left_anti").select("node", F.col("cluster").alias("own"), "n", "bands")
    big = materialise(banded.select("node", "band").join(member.join(heavy, "cluster", "left_semi").select("node", "n"), "node"), "big")
    heavier = materialise(big.groupBy("band").agg(F.sum("n").alias("weight")).where(F.col("weight") > SHINGLES), "heavier")
    single = big.join(heavier, "band", "left_anti").select("node", F.col("band").alias("own"), "n", F.array("band").alias("bands"))
    shared = materialise(light.withColumn("kind", F.lit(-1)).unionByName(single.withColumn("kind", F.lit(-2))), "shared")
    total = shared.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    task = F.pmod(F.xxhash64("own"), F.lit(max(1, -(-total // SHINGLES))))
    together = shared.select("node", task.alias("task"), F.col("kind").alias("i"), F.col("kind").alias("j"), "own", F.lit(0).alias("side"), "bands")
    blocks = big.join(heavier, "band").withColumn("blocks", F.ceil(F.col("weight") / SHINGLES).cast("int"))
    blocks = blocks.withColumn("side", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    paired = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "node", F.col("band").alias("task"), F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), F.col("band").alias("own"), "side", F.array("band").alias("bands")
    )
    return together.unionByName(paired)


def _verify(docs: DataFrame, member: DataFrame, banded: DataFrame, k: int, percent: int) -> DataFrame:
    """Edges (a, b) of a forest with the same components as the exact links between candidates."""
    dealt = _tasks(member, banded)

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        hashes = _Hashes()
        out = []
        for _, own in pdf.sort_values(["own", "node"], kind="stable").groupby("own", sort=False):
            if len(own) > 1:
                sets = [shingles(t, k, hashes) for t in own["text"]]
                side = own["side"].to_numpy() if own["i"].iat[0] != own["j"].iat[0] else None
                node = own["node"].to_numpy()
                label = exact_links(sets, np.array(own["bands"].tolist(), dtype=np.int64), percent, side)
                out.append(pd.DataFrame({"a": node, "b": node[label]}))
        found = pd.concat(out) if out else pd.DataFrame({"a": [], "b": []}, dtype="int64")
        return found[found["a"] != found["b"]]

    # of rows equal in id and text one is sent; grouped by what they are joined on, texts move once
    key = [F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id")]
    texts = docs.where(F.col("text").isNotNull()).select(*key, text_key().alias("text_key"), "text")
    texts = texts.groupBy("none", "id", "text_key").agg(F.first("text").alias("text"))
    reps = member.select("node", "rep.*").select("node", *key, "text_key")
    met = texts.join(reps, ["none", "id", "text_key"]).select("node", "text")
    return met.join(dealt, "node").groupBy("task", "i", "j").applyInPandas(link, "a long, b long")


def op9_minmax(spark, sf_dir: str) -> DataFrame:
    """All documents, 3-word shingles, links of 0.85 or more: doc_id, n_shingles, component_id, kept."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, percent=85)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM d, unnest(generate_series(1, greatest(1, len(w) - 2))) AS t(i) WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS (
  SELECT x, y FROM p JOIN n n1 ON n1.doc_id = x JOIN n n2 ON n2.doc_id = y WHERE 100 * c >= 85 * (n1.n + n2.n - c)
), r AS (
  SELECT DISTINCT x AS a, x AS b FROM e UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x
), k AS (SELECT a, min(b) AS m FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m, d.doc_id) AS component_id, coalesce(m, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN k ON k.a = d.doc_id
"""
