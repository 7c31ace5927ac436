"""Language identification by a bidirectional gated recurrent network over bytes.

Each direction is a GRU of ``HIDDEN`` units whose input is the byte itself; a
softmax over both states labels every position, and a document's probabilities
are the mean over all its positions.  Texts are read whole, in windows of
``SPAN`` bytes that start from a zero state; a text's last window reaches back
to be full, and only positions not yet labelled count.

The network is trained in numpy by backpropagation through time with Adam, from
at most ``SAMPLE`` labelled documents a language, of each one excerpt of
``EXCERPT`` characters (both documented bounds of the fit).  Everything is seeded:
the same table gives the same weights.

Defined results: text that is null or has no letter is ``und`` with score 0; so
is every text if no document has a language; ties go to the first language in
alphabetical order; repeated rows and null ids are predicted alike; an empty
table gives no rows; other columns are ignored by the prediction and kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

HIDDEN, SPAN = 8, 128
SAMPLE, EXCERPT = 400, 400
STEPS, BATCH, STEP_SPAN, RATE = 700, 128, 40, 0.02
#: Bytes labelled at a time, and windows a block of the recurrence.
AT_ONCE, BLOCK = 1 << 20, 1024

_ASCII_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str) -> bool:
    """Whether a character is a letter (a general category of L); fractions, circled and raised digits are none."""
    return bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text))


def remainder(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(3))


class Network:
    """Weights: x[2, 256, 3H] and u[2, H, 3H] for update, reset and candidate; b[2, H] inside the reset; o[2H, L] and c[L]."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels = labels
        f = np.float32
        self.w = {
            "x": (rng.normal(size=(2, 256, 3 * hidden)) * 0.3).astype(f),
            "u": (rng.normal(size=(2, hidden, 3 * hidden)) / np.sqrt(hidden)).astype(f),
            "o": (rng.normal(size=(2 * hidden, len(labels))) * 0.3).astype(f),
            "c": np.zeros(len(labels), dtype=f),
        }

    def states(self, data: np.ndarray, keep: bool = False):
        """Hidden states [T, 2, B, H] for bytes [T, B]; the second direction reads backwards.

        With ``keep``, also what backpropagation needs.
        """
        t_max, b = data.shape
        x, u = self.w["x"], self.w["u"]
        h_size = u.shape[1]
        # sigmoid(a) = 0.5 + 0.5 tanh(a / 2): gates are halved once, here
        scale = np.concatenate([np.full(2 * h_size, 0.5), np.ones(h_size)]).astype(np.float32)
        x, u = x * scale, u * scale
        out = np.zeros((t_max, 2, b, h_size), dtype=np.float32)
        h = np.zeros((2, b, h_size), dtype=np.float32)
        g = np.empty((2, b, 3 * h_size), dtype=np.float32)
        inp = np.empty((2, b, 3 * h_size), dtype=np.float32)
        trace = []
        for t in range(t_max):
            np.take(x[0], data[t], axis=0, out=inp[0], mode="clip")
            np.take(x[1], data[t_max - 1 - t], axis=0, out=inp[1], mode="clip")
            np.matmul(h, u, out=g)
            gate = g[..., : 2 * h_size] + inp[..., : 2 * h_size]
            np.tanh(gate, out=gate)
            gate *= 0.5
            gate += 0.5
            z, r = gate[..., :h_size], gate[..., h_size:]
            rec = g[..., 2 * h_size :]
            n = r * rec
            n += inp[..., 2 * h_size :]
            np.tanh(n, out=n)
            if keep:
                trace.append((h, z, r, rec.copy(), n))
            h = n + z * (h - n)
            out[t, 0] = h[0]
            out[t_max - 1 - t, 1] = h[1]
        return (out, trace) if keep else out

    def probabilities(self, data: np.ndarray) -> np.ndarray:
        """[T, B, L]: the label of every position."""
        s = self.states(data)
        h = s.shape[-1]
        y = s[:, 0] @ self.w["o"][:h]
        y += s[:, 1] @ self.w["o"][h:]
        y += self.w["c"]
        y -= y.max(axis=-1, keepdims=True)
        np.exp(y, out=y)
        y /= y.sum(axis=-1, keepdims=True)
        return y

    def gradients(self, data: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over all positions of bytes [T, B] with label [B], and its gradients."""
        t_max, b = data.shape
        s, trace = self.states(data, keep=True)
        h = s.shape[-1]
        both = np.concatenate([s[:, 0], s[:, 1]], axis=-1)
        y = both @ self.w["o"] + self.w["c"]
        y -= y.max(axis=-1, keepdims=True)
        p = np.exp(y)
        p /= p.sum(axis=-1, keepdims=True)
        hot = np.eye(len(self.labels), dtype=np.float32)[target]
        loss = -np.log(np.maximum((p * hot).sum(axis=-1), 1e-9)).mean()
        dy = (p - hot) / (t_max * b)
        grad = {k: np.zeros_like(v) for k, v in self.w.items()}
        grad["o"] = both.reshape(-1, 2 * h).T @ dy.reshape(-1, dy.shape[-1])
        grad["c"] = dy.sum(axis=(0, 1))
        d_both = dy @ self.w["o"].T
        carry = np.zeros((2, b, h), dtype=np.float32)
        ut = self.w["u"].transpose(0, 2, 1)
        for t in range(t_max - 1, -1, -1):
            before, z, r, rec, n = trace[t]
            dh = carry + np.stack([d_both[t, :, :h], d_both[t_max - 1 - t, :, h:]])
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (before - n) * z * (1 - z)
            dr = dn * rec * r * (1 - r)
            into = np.concatenate([dz, dr, dn], axis=-1)
            back = np.concatenate([dz, dr, dn * r], axis=-1)
            carry = dh * z + back @ ut
            grad["u"] += before.transpose(0, 2, 1) @ back
            np.add.at(grad["x"][0], data[t], into[0])
            np.add.at(grad["x"][1], data[t_max - 1 - t], into[1])
        return float(loss), grad


def fit(samples: list[tuple[bytes, str]], hidden: int = HIDDEN, steps: int = STEPS, seed: int = 11) -> Network:
    """Train on (bytes, language) by backpropagation through time."""
    labels = sorted({lang for _, lang in samples})
    net = Network(labels, hidden)
    if len(labels) < 2:
        return net
    by = [[np.frombuffer(x, np.uint8) for x, lang in samples if lang == name and x] for name in labels]
    rng = np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.w.items()}
    v2 = {k: np.zeros_like(v) for k, v in net.w.items()}
    for step in range(1, steps + 1):
        target = rng.integers(0, len(labels), BATCH)
        data = np.empty((STEP_SPAN, BATCH), dtype=np.uint8)
        for j, y in enumerate(target):
            x = by[y][rng.integers(0, len(by[y]))]
            at = int(rng.integers(0, max(1, len(x) - STEP_SPAN + 1)))
            data[:, j] = np.resize(x[at : at + STEP_SPAN], STEP_SPAN)
        _, grad = net.gradients(data, target)
        rate = RATE * (1 - step / (steps + 1)) + 1e-4
        for k, g in grad.items():
            g = np.clip(g, -1, 1)
            m[k] += 0.1 * (g - m[k])
            v2[k] += 0.01 * (g * g - v2[k])
            net.w[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def training_sample(docs: DataFrame, per_language: int = SAMPLE) -> list[tuple[bytes, str]]:
    """At most ``per_language`` excerpts of each language, chosen by a hash of the id and text."""
    own = docs.select("lang", "text", F.xxhash64("doc_id", "text").alias("h")).where("lang is not null and text is not null and text <> ''")
    counts = {r["lang"]: r["n"] for r in own.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return []
    share = F.create_map(*(x for k, n in sorted(counts.items()) for x in (F.lit(k), F.lit(min(1.0, 1.5 * per_language / n)))))
    start = F.pmod("h", F.greatest(F.length("text") - EXCERPT + 1, F.lit(1))).cast("int") + 1
    picked = own.where((F.pmod(F.col("h"), F.lit(1 << 20)) / (1 << 20)) < share[F.col("lang")])
    rows = picked.select("lang", "h", F.substring("text", start, F.lit(EXCERPT)).alias("excerpt")).collect()
    out: list[tuple[bytes, str]] = []
    held: dict[str, int] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["h"], r["excerpt"])):
        if held.get(r["lang"], 0) < per_language:
            held[r["lang"]] = held.get(r["lang"], 0) + 1
            out.append((r["excerpt"].encode("utf-8", "surrogatepass"), r["lang"]))
    return out


def document_probabilities(net: Network, texts: list[bytes]) -> np.ndarray:
    """[documents, L]: the mean over every position of each (non-empty) text."""
    windows, owner, skip, sizes = [], [], [], []
    for d, text in enumerate(texts):
        x = np.frombuffer(text, np.uint8)
        n = len(x)
        sizes.append(n)
        if n < SPAN:
            windows.append(np.resize(x, SPAN)[None, :])
            owner.append(d)
            skip.append(n - SPAN)  # negative: only the first n count
            continue
        whole = n // SPAN
        windows.append(x[: whole * SPAN].reshape(whole, SPAN))
        owner += [d] * whole
        skip += [0] * whole
        if n > whole * SPAN:
            windows.append(x[-SPAN:][None, :])
            owner.append(d)
            skip.append(SPAN - (n - whole * SPAN))  # these were labelled before
    data = np.concatenate(windows)
    skip = np.array(skip)
    out = np.zeros((len(texts), len(net.labels)), dtype=np.float64)
    for i in range(0, len(data), BLOCK):
        p = net.probabilities(np.ascontiguousarray(data[i : i + BLOCK].T))
        some = skip[i : i + BLOCK]
        for j in np.flatnonzero(some):
            if some[j] > 0:
                p[: some[j], j] = 0
            else:
                p[SPAN + some[j] :, j] = 0
        np.add.at(out, owner[i : i + BLOCK], p.sum(axis=0))
    return out / np.array(sizes)[:, None]


def identify(docs: DataFrame, net: Network) -> DataFrame:
    """(row, lang_pred, score): ``row`` is the whole input row as a struct."""
    names = docs.columns
    at = names.index("text")
    nested = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"))
    shared = docs.sparkSession.sparkContext.broadcast((net.labels, net.w))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network.__new__(Network)
        net.labels, net.w = shared.value
        for batch in batches:
            texts = batch.column(0).field(at)
            pred, score = ["und"] * len(texts), [0.0] * len(texts)
            todo: list[tuple[int, bytes]] = []
            held = 0

            def run() -> None:
                for (i, _), p in zip(todo, document_probabilities(net, [x for _, x in todo])):
                    best = int(p.argmax())
                    pred[i], score[i] = net.labels[best], min(1.0, float(p[best]))
                todo.clear()

            for i, text in enumerate(texts):
                text = text.as_py()
                if net.labels and text and has_letter(text):
                    todo.append((i, text.encode("utf-8", "surrogatepass")))
                    held += len(todo[-1][1])
                    if held >= AT_ONCE:
                        run()
                        held = 0
            if todo:
                run()
            yield pa.record_batch([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["row", "lang_pred", "score"])

    layout = StructType([*nested.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return nested.mapInArrow(predict, layout)


def op8_bigru(spark, sf_dir: str) -> DataFrame:
    """All documents: doc_id, held_out, lang_pred, score; learnt where the id's remainder is not 1."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = fit(training_sample(docs.where(remainder(F.col("doc_id")) != 1)))
    out = identify(docs.select("doc_id", "text"), net)
    return out.select("row.doc_id", (remainder(F.col("row.doc_id")) == 1).alias("held_out"), "lang_pred", "score")
