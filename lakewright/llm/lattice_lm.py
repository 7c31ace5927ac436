"""Language-model scoring by subword lattice likelihood.

Every word is a lattice over its characters: an arc for each piece of an
existing vocabulary that fits there, and one arc for the whole word as the
training documents know it.  A forward recursion in log space sums all
segmentations, so a word's probability is marginal over them:

    P(word) = max(c - DISCOUNT, 0) / N + DISCOUNT * V / N * Q(word)

with c its count, N all tokens and V distinct tokens in training, and Q the sum
over segmentations of ``_`` + word of the product of piece probabilities, where
after a piece the word goes on with probability ``GO_ON``.  Piece probabilities
are the vocabulary's scores and nothing is fitted to them: the vocabulary at hand
is BPE, whose scores are minus the rank of the piece, so they are read as the Zipf
law 1 / (ZIPF_SHIFT + rank); pieces that differ in A-Z only are added up, and byte
pieces share ``BYTE_MASS``.  Words are lower-cased in A-Z.  A document's score is
the log10 of the product over its words and one end token.

Counts are over all training documents.  The ``FREQUENT`` most frequent words or
fewer go to every task, which scores them where they stand; only the others
travel, once a document each, to meet their counts.  So no word is a hot key.

Defined results: null or empty text is the end token alone; a null doc_id is in
training; repeated rows are scored and counted each; without training documents
the whole-word arcs vanish; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewright.sources.shared import materialise

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
FREQUENT = 50_000
#: Distinct words that a task counts before it hands them on.
HELD = 300_000
DISCOUNT, GO_ON, BYTE_MASS, ZIPF_SHIFT = 0.75, 0.75, 1e-3, 2.7

_LN10 = math.log(10)


def piece_scores(path: str = VOCABULARY) -> dict[str, float]:
    """ln probability of each piece; byte pieces stand as one character U+DC00 + byte."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    weight: dict[str, float] = {}
    for i in plain:
        piece = model.id_to_piece(i)
        low = piece.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
        weight[low] = weight.get(low, 0.0) + 1.0 / (ZIPF_SHIFT - model.get_score(i))
    total = sum(weight.values())
    out = {p: math.log((1 - BYTE_MASS) * w / total) for p, w in weight.items()}
    for b in range(256):
        out[chr(0xDC00 + b)] = math.log(BYTE_MASS / 256)
    return out


class Lattice:
    """Marginal probability of words under piece scores (ln probability by piece)."""

    def __init__(self, scores: dict[str, float], go_on: float = GO_ON):
        self.score = [x + math.log(go_on) for x in scores.values()]
        self.number = {p: k for k, p in enumerate(scores)}
        # a trie of [piece or -1, children by character]
        self.trie: dict[str, list] = {}
        for p, k in self.number.items():
            level = self.trie
            for c in p[:-1]:
                level = level.setdefault(c, [-1, {}])[1]
            level.setdefault(p[-1], [-1, {}])[0] = k
        self.stop = math.log(1 - go_on) - math.log(go_on)

    def arcs(self, word: str) -> tuple[int, list[list[tuple[int, int]]]]:
        """The positions of the lattice, and the arcs (to, piece) that leave each.

        A character without a piece of its own is spelt as a chain of byte
        pieces through positions after the last.
        """
        text = "▁" + word
        n = len(text)
        out: list[list[tuple[int, int]]] = []
        trie = self.trie
        for i in range(n):
            own: list[tuple[int, int]] = []
            level, j = trie, i
            for c in text[i:]:
                found = level.get(c)
                if found is None:
                    break
                j += 1
                k, level = found
                if k >= 0:
                    own.append((j, k))
            if not own or own[0][0] != i + 1:
                chain = [self.number[chr(0xDC00 + b)] for b in text[i].encode("utf-8", "surrogatepass")]
                own.append((i + 1, -1 - len(self.chains)))
                self.chains.append(chain)
            out.append(own)
        return n, out

    chains: list[list[int]]

    def logq(self, word: str) -> float:
        """ln Q(word), summed over all segmentations in log space."""
        self.chains = []
        n, arcs = self.arcs(word)
        into: list[list[float]] = [[] for _ in range(n + 1)]
        into[0].append(0.0)
        score, exp, log = self.score, math.exp, math.log
        for i in range(n):
            own = into[i]
            if len(own) == 1:
                here = own[0]
            else:
                top = max(own)
                here = top + log(sum([exp(x - top) for x in own]))
            for j, k in arcs[i]:
                into[j].append(here + (score[k] if k >= 0 else sum(score[c] for c in self.chains[-1 - k])))
        own = into[n]
        top = max(own)
        return top + log(sum([exp(x - top) for x in own])) + self.stop


def tokens_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(7)) == 2


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c, n): occurrences in training documents and in all, over whole texts."""
    schema = pa.schema([("word", pa.binary()), ("c", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            held, train = seen
            words = list(train) + [w for w in held if w not in train]
            out = pa.record_batch([pa.array(words, pa.binary()), pa.array([train.get(w, 0) for w in words], pa.int64()), pa.array([train.get(w, 0) + held.get(w, 0) for w in words], pa.int64())], schema=schema)
            held.clear()
            train.clear()
            return out

        for batch in batches:
            for train, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                seen[train].update(tokens_of(text.as_py()))
                if len(seen[0]) + len(seen[1]) >= HELD:
                    yield flush()
        yield flush()

    parts = docs.select((~held_out(F.col("doc_id"))).alias("train"), "text").mapInArrow(count, "word binary, c long, n long")
    return parts.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def score_documents(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of (doc_id, text)."""
    spark = docs.sparkSession
    counted = materialise(word_counts(docs), "counts")
    ends = docs.agg(F.count_if(~held_out(F.col("doc_id"))).alias("n")).first()["n"]
    sums = counted.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("c"), F.count_if(F.col("c") > 0).alias("v")).first()
    total, distinct = sums["c"] + ends, sums["v"] + (ends > 0)
    scores = spark.sparkContext.broadcast(piece_scores(vocabulary))
    schema = pa.schema([("word", pa.binary()), ("c", pa.int64()), ("n", pa.int64()), ("base", pa.float64()), ("lp", pa.float64())])

    def price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Lattice(scores.value)
        spread = DISCOUNT * distinct / total if total else 1.0
        for batch in batches:
            c = batch.column(1).to_numpy().astype(float)
            q = np.array([model.logq(w.as_py().decode("utf-8", "surrogatepass")) for w in batch.column(0)])
            known = np.maximum(c - DISCOUNT, 0) / total if total else c * 0
            with np.errstate(divide="ignore"):
                lp = np.logaddexp(np.log(known), math.log(spread) + q) / _LN10
            yield pa.record_batch([*batch.columns, pa.array(np.log10(c + 1)), pa.array(lp)], schema=schema)

    priced = materialise(counted.mapInArrow(price, "word binary, c long, n long, base double, lp double"), "prices")
    step = F.floor(F.log2("n") * 8)
    by_step = sorted(((r["s"], r["k"]) for r in priced.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("k")).collect()), reverse=True)
    common, least = 0, None
    for s, k in by_step:
        if common + k > FREQUENT:
            break
        common, least = common + k, s
    often = priced.where(step >= least).collect() if least is not None else []  # FREQUENT words at most
    table = spark.sparkContext.broadcast({bytes(r["word"]): (r["c"] > 0, r["base"], r["lp"]) for r in often})
    end = (ends > 0, math.log10(ends + 1), math.log10(max(ends - DISCOUNT, 0.25) / total) if total else 0.0)
    layout = "key long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, lp double, word binary, n long"
    full = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("lp", pa.float64()), ("word", pa.binary()), ("n", pa.int64())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part, at = table.value, TaskContext.get().partitionId() << 40, 0

        def layout_of(own: dict, n: int) -> pa.RecordBatch:
            return pa.record_batch([(own[f.name] if isinstance(own[f.name], pa.Array) else pa.array(own[f.name], f.type)) if f.name in own else pa.nulls(n, f.type) for f in full], schema=full)

        for batch in batches:
            sums: dict[str, list] = {k: [] for k in ("n_tokens", "n_known", "base", "lp")}
            words_out: list[bytes] = []
            counts_out: list[int] = []
            rare_of: list[int] = []
            first = part + at
            for text in batch.column(2):
                words = Counter(tokens_of(text.as_py()))
                n, (end_known, base, lp) = 1, end
                n_known, before = int(end_known), len(words_out)
                for w, k in words.items():
                    n += k
                    hit = known.get(w)
                    if hit is None:
                        words_out.append(w)
                        counts_out.append(k)
                    else:
                        n_known += k * hit[0]
                        base += k * hit[1]
                        lp += k * hit[2]
                rare_of.append(len(words_out) - before)
                for name, x in zip(sums, (n, n_known, base, lp)):
                    sums[name].append(x)
            size = batch.num_rows
            keys = np.arange(first, first + size, dtype=np.int64)
            at += size
            yield layout_of({"key": keys, "doc_id": batch.column(0), "held_out": batch.column(1), **sums}, size)
            if words_out:
                yield layout_of({"key": np.repeat(keys, rare_of), "word": words_out, "n": counts_out}, len(words_out))

    parts = materialise(docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(score, layout), "parts")
    rare = priced.where(step < least) if least is not None else priced
    missing = (
        parts.where("word is not null")
        .select("key", "word", "n")
        .join(rare.select("word", "c", F.col("base").alias("b"), F.col("lp").alias("l")), "word")
        .select("key", F.when(F.col("c") > 0, F.col("n")).otherwise(0).alias("n_known"), (F.col("n") * F.col("b")).alias("base"), (F.col("n") * F.col("l")).alias("lp"))
        .groupBy("key")
        .agg(F.sum("n_known").alias("n_known"), F.sum("base").alias("base"), F.sum("lp").alias("lp"))
    )
    rows = parts.where("word is null").select("key", "doc_id", "held_out", "n_tokens", "n_known", "base", "lp")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("doc_id", "long"), ("held_out", "boolean"), ("n_tokens", "long"))]
    summed = (
        rows.unionByName(missing.select("key", *none, "n_known", "base", "lp"))
        .groupBy("key")
        .agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base"), F.sum("lp").alias("lp"))
    )
    return summed.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(math.log10(total + distinct + 1))).alias("base_score"), F.col("lp").alias("score"),
    )


def op10_lattice(spark, sf_dir: str) -> DataFrame:
    """All documents scored by a model learnt from those whose crc32 leaves no remainder of 2 by 7."""
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
