"""Benchmark decontamination with a positional inverted index.

Training documents are gathered into blocks of about ``BLOCK_WORDS`` words.
Each block is one row of the stored index: for every test-set term the ascending
positions at which it stands in the block, delta coded.  Terms that no test
item has are left out, since they cannot take part in a match.  Documents in a
block are ``GAP`` positions apart, so no match crosses from one to the next.

A phrase is looked up from its term that is rarest over the whole corpus:
that term's positions, shifted by its offset, are intersected with the
shifted positions of the next rarest, and so on.  With ``slop`` the words must
stand in order within that many further words (a proximity match).  Blocks are
queried one by one, so no term is a hot key and nothing is shuffled but the
term counts.

Test items are held by every task, at most ``TEST_BYTES`` of text at a time, as
arrays of about 60 bytes a window; a larger test set is taken in several passes,
over documents numbered once in a written table, whose spans are united.

Defined results: null text has no words; an item of fewer than ``window``
words, but not none, is one window; items with the same id count once; a null
item id stands in ``item_ids`` as null; repeated rows and null ids give a row
each; empty tables give no rows, or rows without hits; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewright.sources.shared import materialise

WINDOW = 10
BLOCK_WORDS = 1 << 20
GAP = 64
TEST_BYTES = 8 << 20

#: A-Z to lower case; everything that is no word character to a blank.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

INDEX = "part long, seq long, doc_ids array<long>, tags array<long>, n_words array<long>, terms array<int>, counts array<long>, deltas binary"
SPANS = "doc_id long, tag long, n_words long, spans array<struct<start:long,stop:long>>, item_ids array<long>"


def words_of(text: str | None) -> list[bytes]:
    """Runs of 0-9, a-z and characters beyond ASCII, after lower-casing A-Z."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def build_index(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """The stored index of ``docs`` (doc_id, tag, text) for the terms of ``vocabulary``; tags are handed through."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = pa.schema(
        [("part", pa.int64()), ("seq", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("tags", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64())), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64())), ("deltas", pa.binary())]
    )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, part, seq = shared.value.get, TaskContext.get().partitionId(), 0
        ids: list = []
        tags: list = []
        sizes: list[int] = []
        found: list[np.ndarray] = []
        held = 0

        def block() -> pa.RecordBatch:
            n = np.array(sizes, dtype=np.int64)
            start = np.concatenate([[0], np.cumsum(n + GAP)[:-1]])
            term = np.concatenate(found)
            at = np.arange(len(term), dtype=np.int64) + np.repeat(start - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
            known = term >= 0
            term, at = term[known], at[known]
            order = np.argsort(term, kind="stable")
            term, at = term[order], at[order]
            terms, first, counts = np.unique(term, return_index=True, return_counts=True)
            delta = np.diff(at, prepend=0)
            if len(first):
                delta[first] = at[first]
            return pa.record_batch(
                [pa.array([x], type=f.type) for x, f in zip((part, seq, ids, tags, n, terms, counts, delta.astype("<u4").tobytes()), schema)], schema=schema
            )

        for batch in batches:
            for doc, tag, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                w = words_of(text.as_py())
                ids.append(doc)
                tags.append(tag)
                sizes.append(len(w))
                found.append(np.fromiter(map(find, w, repeat(-1)), np.int32, len(w)))
                held += len(w) + GAP
                if held >= BLOCK_WORDS:
                    yield block()
                    ids, tags, sizes, found, held, seq = [], [], [], [], 0, seq + 1
        if ids:
            yield block()

    return materialise(docs.select(F.col("doc_id").cast("long"), F.col("tag").cast("long"), "text").mapInArrow(build, INDEX), "postings")


def rarity(index: DataFrame, size: int) -> np.ndarray:
    """How often each term stands in the corpus; at most one row a test term."""
    rows = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).groupBy("t.terms").agg(F.sum("t.counts").alias("n")).collect()
    out = np.zeros(size, dtype=np.int64)
    for r in rows:
        out[r["terms"]] = r["n"]
    return out


def find_phrase(postings, phrase: np.ndarray, order: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of a phrase; ``postings(term)`` gives ascending positions, ``order`` the words by rarity."""
    if not slop:
        at = postings(phrase[order[0]]) - order[0]
        for off in order[1:]:
            if not len(at):
                break
            other = postings(phrase[off])
            spot = np.searchsorted(other, at + off)
            spot[spot == len(other)] = 0
            at = at[other[spot] == at + off]
        return at, at + len(phrase)
    start = postings(phrase[0])
    end = start
    for term in phrase[1:]:
        other = postings(term)
        spot = np.searchsorted(other, end, side="right")
        keep = spot < len(other)
        start, end = start[keep], other[spot[keep]]
    fit = end - start + 1 <= len(phrase) + slop
    return start[fit], end[fit] + 1


class Phrases:
    """The distinct windows of test items as arrays.

    ``terms`` has a row a window, of fewer words padded with ``pad``; ``size`` its words; ``owners`` the
    numbers of the items that have window i, from ``first[i]`` to ``first[i + 1]``.
    """

    def __init__(self, items: list[np.ndarray], window: int, pad: int):
        rows = [np.empty((0, window), np.int32)]
        owner = [np.empty(0, np.int32)]
        for k, w in enumerate(items):
            if len(w):
                some = np.full((max(1, len(w) - window + 1), window), pad, dtype=np.int32)
                some[:, : len(w)] = np.lib.stride_tricks.sliding_window_view(w, min(window, len(w)))
                rows.append(some)
                owner.append(np.full(len(some), k, dtype=np.int32))
        table, owner = np.concatenate(rows), np.concatenate(owner)
        order = np.lexsort((owner, *table.T))
        table, owner = table[order], owner[order]
        new = np.ones(len(table), dtype=bool)
        new[1:] = (table[1:] != table[:-1]).any(axis=1)
        self.terms = table[new]
        self.size = (self.terms != pad).sum(axis=1)
        again = ~new
        again[1:] &= owner[1:] == owner[:-1]
        which = np.cumsum(new) - 1
        self.owners = owner[~again]
        self.first = np.searchsorted(which[~again], np.arange(len(self.terms) + 1))

    def by_rarity(self, common: np.ndarray) -> np.ndarray:
        """The places of each window's words, rarest first; padding comes last."""
        return np.argsort(common[self.terms], axis=1, kind="stable").astype(np.int8 if self.terms.shape[1] < 128 else np.int32)


def search(index: DataFrame, items: list[tuple[int | None, np.ndarray]], terms: int, window: int = WINDOW, slop: int = 0) -> DataFrame:
    """Rows ``SPANS``: for every document the merged spans of matches and the items that match."""
    if slop >= GAP:
        raise ValueError(f"slop must be below {GAP}")
    names = sorted({i for i, _ in items}, key=lambda x: (x is not None, x))
    number = {i: k for k, i in enumerate(names)}
    merged = Phrases([w for _, w in items], window, terms)
    named = np.array([number[i] for i, _ in items], dtype=np.int32)
    common = rarity(index, terms + 1)
    common[terms] = np.iinfo(np.int64).max  # padding
    shared = index.sparkSession.sparkContext.broadcast((merged.terms, merged.size, merged.by_rarity(common), merged.first, named[merged.owners], names))
    schema = pa.schema(
        [("doc_id", pa.int64()), ("tag", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("item_ids", pa.list_(pa.int64()))]
    )

    def query(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases, length, orders, begin, owners, names = shared.value
        for batch in batches:
            for row in range(batch.num_rows):
                ids, tags, n, have, counts, delta = (batch.column(c)[row] for c in range(2, 8))
                n, have, counts = (x.values.to_numpy(zero_copy_only=False) for x in (n, have, counts))
                delta = np.frombuffer(delta.as_py(), dtype="<u4")
                start = np.concatenate([[0], np.cumsum(n + GAP)[:-1]])
                first = np.concatenate([[0], np.cumsum(counts)])
                place = {int(t): i for i, t in enumerate(have)}
                present = np.zeros(terms + 1, dtype=bool)
                present[have] = True
                present[terms] = True
                read: dict[int, np.ndarray] = {}

                def postings(term: int) -> np.ndarray:
                    if term not in read:
                        i = place[term]
                        read[term] = np.cumsum(delta[first[i] : first[i + 1]], dtype=np.int64)
                    return read[term]

                edge = np.zeros(int((n + GAP).sum()) + 1, dtype=np.int32)
                hit_items: dict[int, set] = {}
                for i in np.flatnonzero(present[phrases].all(axis=1)):
                    a, b = find_phrase(postings, phrases[i, : length[i]], orders[i, : length[i]], slop)
                    if not len(a):
                        continue
                    np.add.at(edge, a, 1)
                    np.add.at(edge, b, -1)
                    for d in np.unique(np.searchsorted(start, a, side="right") - 1):
                        hit_items.setdefault(int(d), set()).update(owners[begin[i] : begin[i + 1]].tolist())
                inside = np.cumsum(edge) > 0
                turns = np.diff(inside.astype(np.int8), prepend=0)
                up, down = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
                spans: dict[int, list] = {}
                for u, v in zip(up, down):
                    d = int(np.searchsorted(start, u, side="right") - 1)
                    spans.setdefault(d, []).append({"start": int(u - start[d]), "stop": int(v - start[d])})
                size = len(n)
                yield pa.record_batch(
                    [
                        ids.values,
                        tags.values,
                        pa.array(n, pa.int64()),
                        pa.array([spans.get(d, []) for d in range(size)], schema.field("spans").type),
                        pa.array([[names[x] for x in sorted(hit_items.get(d, ()))] for d in range(size)], schema.field("item_ids").type),
                    ],
                    schema=schema,
                )

    return index.mapInArrow(query, SPANS)


def contaminated_spans(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 0, tag: str | None = None) -> DataFrame:
    """For every row of ``docs`` (doc_id, text): doc_id, n_words, spans of word numbers
    [start, stop) that test items (item_id, text) cover, and item_ids; then column ``tag`` as tag."""
    rows = docs.select(F.col("doc_id").cast("long"), (F.col(tag) if tag else F.lit(None)).cast("long").alias("tag"), "text")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    passes = max(1, -(-size // TEST_BYTES))
    if passes > 1:
        # every pass must name the same row alike, so the numbers are written once
        rows = materialise(rows.withColumn("number", F.monotonically_increasing_id()), "numbered")
        named, rows = rows.select("number", "doc_id", "tag"), rows.select("doc_id", F.col("number").alias("tag"), "text")
    found = None
    for k in range(passes):
        own = items.where(F.pmod(F.xxhash64("text"), F.lit(passes)) == k).select(F.col("item_id").cast("long"), "text").toLocalIterator()
        vocabulary: dict[bytes, int] = {}
        numbered = [(r["item_id"], np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(r["text"])], dtype=np.int32)) for r in own]
        one = search(build_index(rows, vocabulary), numbered, len(vocabulary), window, slop)
        found = one if found is None else found.unionByName(one)
    if passes > 1:
        found = found.groupBy(F.col("tag").alias("number")).agg(
            F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_distinct(F.flatten(F.collect_list("item_ids"))).alias("item_ids")
        )
        joined = F.aggregate(
            "spans",
            F.expr("cast(array() as array<struct<start:bigint,stop:bigint>>)"),
            lambda acc, s: F.when(
                (F.size(acc) > 0) & (F.element_at(acc, -1)["stop"] >= s["start"]),
                F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["stop"], s["stop"]).alias("stop")))),
            ).otherwise(F.concat(acc, F.array(s))),
        )
        found = named.join(found.withColumn("spans", joined), "number")
    return found.select("doc_id", "n_words", "spans", "item_ids", *(["tag"] if tag else []))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a match, each judged by its own text, also where rows share an id.

    Only ids and hashes of the texts of contaminated rows are joined, not texts.
    """
    keyed = docs.withColumn("__lakewright_key", F.xxhash64("text"))
    bad = contaminated_spans(keyed, items, tag="__lakewright_key").where(F.size("spans") > 0)
    bad = bad.select(F.col("doc_id").alias("__lakewright_id"), F.col("tag").alias("__lakewright_bad")).distinct()
    same = (F.col("__lakewright_key") == F.col("__lakewright_bad")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__lakewright_id"))
    return keyed.join(bad, same, "left_anti").drop("__lakewright_key")


def op3_positional_index(spark, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    rows = contaminated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    names = F.array_join(F.array_sort(F.transform("item_ids", lambda i: i.cast("string"))), ",")
    return rows.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (hit > 0).alias("contaminated")
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM b, unnest(generate_series(1, greatest(1, len(w) - 9))) AS t(i) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM bw
), dw AS (
  SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM d, sizes, unnest(generate_series(1, greatest(0, len(w) - n + 1))) AS t(i)
), m AS (
  SELECT rid, i, dw.n, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n
), h AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM m, unnest(generate_series(i, i + n - 1)) AS t(p) GROUP BY rid
), k AS (
  SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names FROM m GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN k USING (rid)
"""
