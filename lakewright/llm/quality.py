"""Quality and toxicity by hierarchical empirical Bayes.

A linear classifier on a document's words gives evidence.  Sites are hosts and,
inside each, paths; a site's posterior is a mean shrunk towards its parent by as
many pseudo-observations as the spread between sites of its level warrants
(method of moments, hosts and paths inside hosts each with a variance of their
own), so a sparse path leans on its host and a sparse host on the global prior.
Site statistics are one grouped aggregation over all documents: a label where
there is one, else the classifier's probability.  A document's log odds are the
classifier's plus how far the log odds of its site without it lie from the
prior's, so its own evidence counts once.  Texts are read once, besides the
sample; the scores of all rows are a written table.

The classifier is, per target, a logistic regression on the log odds of a
document's distinct telling words and on shape features, fitted on at most
``SAMPLE`` labelled documents of together ``SAMPLE_BYTES`` (documented bounds of
the fit), in the order of a hash.

Defined results: null text is the empty text; null host or path are sites of
their own; labels for unknown documents are ignored, of several for one document
the mean counts, each target by itself; a target without labels of both kinds has probability 0.5 for
quality and 0 for toxicity and rejects nothing; repeated rows and null ids are
judged alike; an empty table gives no rows; extra columns are kept.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lakewright.sources.shared import materialise

SAMPLE, SAMPLE_BYTES = 6000, 64 << 20
BITS = 20
#: Words that fewer documents of the sample have, or whose kinds differ by fewer standard errors, get no weight.
SEEN, SIGNIFICANT = 5, 5.0
RIDGE = 0.1
#: Sites up to this number go to every task; more are joined by shuffle.
BROADCAST_SITES = 50_000
TARGETS = ("quality", "toxic")

_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")
_SYMBOLS = [c for c in range(33, 127) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122) and c not in b".,'-"]


def features(text: str | None, cache: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word slots, and shape features, of a whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    low = raw.lower()
    size = max(1, len(raw))
    words = _WORD.findall(low)
    distinct = set(words)
    slots = set()
    for w in distinct:
        slot = cache.get(w)
        if slot is None:
            if len(cache) > 500_000:
                cache.clear()
            slot = cache[w] = zlib.crc32(w) & ((1 << BITS) - 1)
        slots.add(slot)
    kinds = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lines = low.split(b"\n")
    n = max(1, len(words))
    shape = [
        1.0,
        min(1.0, 4 * kinds[65:91].sum() / size),
        min(1.0, 20 * kinds[_SYMBOLS].sum() / size),
        kinds[48:58].sum() / size,
        sum(map(eq, words, islice(words, 1, None))) / n,
        len(distinct) / n,
        len(set(lines)) / len(lines),
        math.log1p(len(words)) / 10,
    ]
    return np.fromiter(slots, np.int64, len(slots)), np.array(shape)


def telling(odds: np.ndarray, slots: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """What the regression sees: sums and extremes of the words' log odds, and the shape."""
    s = odds[slots]
    up, down = np.maximum(s, 0), np.minimum(s, 0)
    return np.concatenate([[up.sum(), down.sum(), up.max(initial=0.0), down.min(initial=0.0)], shape])


class Linear:
    """One logistic regression a target: the words' log odds and the weights of :func:`telling`."""

    def __init__(self, w: dict[str, tuple[np.ndarray, np.ndarray] | None]):
        self.w = w

    def logits(self, slots: np.ndarray, shape: np.ndarray) -> list[float]:
        return [float("nan") if self.w[t] is None else float(telling(self.w[t][0], slots, shape) @ self.w[t][1]) for t in TARGETS]


def fit(rows: list[tuple[str, dict[str, float | None]]]) -> Linear:
    """Fit on (text, labels).

    Words whose document frequency differs between the kinds by ``SIGNIFICANT``
    standard errors weigh their log odds; a logistic regression on the sum of
    these and the shape features then sets their scale and the threshold.
    """
    cache: dict[bytes, int] = {}
    made = [features(t, cache) for t, _ in rows]
    out: dict[str, tuple | None] = {}
    for target in TARGETS:
        y = np.array([np.nan if lab.get(target) is None else float(lab[target]) for _, lab in rows])
        own = np.flatnonzero(~np.isnan(y))
        if not len(own) or y[own].min() == y[own].max():
            out[target] = None
            continue
        count = np.zeros((2, 1 << BITS))
        size = np.zeros(2)
        for i in own:
            for kind, share in ((1, y[i]), (0, 1 - y[i])):
                count[kind, made[i][0]] += share
                size[kind] += share
        rate = count / size[:, None]
        mean = count.sum(axis=0) / size.sum()
        error = np.sqrt(np.maximum(mean * (1 - mean), 1e-12) * (1 / size).sum())
        marked = (count.sum(axis=0) >= SEEN) & (np.abs(rate[1] - rate[0]) >= SIGNIFICANT * error)
        odds = np.where(marked, np.log((count[1] + 0.5) / (size[1] + 1)) - np.log((count[0] + 0.5) / (size[0] + 1)), 0.0)
        x = np.array([telling(odds, *made[i]) for i in own])
        # iteratively reweighted least squares with a ridge
        scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
        x = x / scale
        beta = np.zeros(x.shape[1])
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            bend = np.maximum(p * (1 - p), 1e-6)
            step = np.linalg.solve((x * bend[:, None]).T @ x + RIDGE * np.eye(len(beta)), x.T @ (y[own] - p) - RIDGE * beta)
            beta += step
            if np.abs(step).max() < 1e-8:
                break
        out[target] = (odds.astype(np.float32), beta / scale)
    return Linear(out)


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[tuple[str, dict]]:
    """At most ``sample`` labelled documents of ``SAMPLE_BYTES``, in the order of a hash of id and text.

    Repeated rows count once; a text that no longer fits is passed over.
    """
    marks = labels.groupBy("doc_id").agg(*(F.avg(t).alias(t) for t in TARGETS)).where("doc_id is not null")
    n = marks.count()
    if not n:
        return []
    share = min(1.0, 1.2 * sample / n)
    # the choice is made on the labels and on hashes, so that only chosen texts move
    chosen = marks.where((F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / (1 << 20)) < share)
    hashed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("h"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
    sizes = hashed.drop("text").join(chosen.select("doc_id"), "doc_id").select("h", "size").distinct().orderBy("h", "size").limit(sample).collect()
    left, taken = SAMPLE_BYTES, []
    for r in sizes:
        if r["size"] <= left:
            left -= r["size"]
            taken.append((r["h"],))
    if not taken:
        return []
    wanted = F.broadcast(docs.sparkSession.createDataFrame(taken, "h long").distinct())
    rows = hashed.join(wanted, "h").join(chosen, "doc_id").groupBy("h").agg(F.first("text").alias("text"), *(F.first(t).alias(t) for t in TARGETS)).collect()
    return [(r["text"], {t: r[t] for t in TARGETS}) for r in sorted(rows, key=lambda r: r["h"])]


def evidence(rows: DataFrame, model: Linear) -> DataFrame:
    """``rows`` without their column ``text``, and the log odds e_quality and e_toxic (NaN without a model)."""
    shared = rows.sparkSession.sparkContext.broadcast(model.w)
    at = rows.columns.index("text")
    fields = [f for i, f in enumerate(rows.schema.fields) if i != at]
    names = [*(f.name for f in fields), *(f"e_{t}" for t in TARGETS)]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, cache = Linear(shared.value), {}
        for batch in batches:
            z = [own.logits(*features(t.as_py(), cache)) for t in batch.column(at)]
            kept = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.record_batch([*kept, *(pa.array([x[k] for x in z], pa.float64()) for k in range(len(TARGETS)))], names=names)

    return rows.mapInArrow(score, StructType([*fields, *(StructField(f"e_{t}", DoubleType()) for t in TARGETS)]))


def _odds(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(p / (1 - p))


def _probability(z: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))


def _posterior(t: str, own: Column | None = None) -> Column:
    """The posterior of a site for target ``t``; with ``own``, without one document of that probability."""
    out = F.greatest(F.col(f"h_{t}") - (0.0 if own is None else own), F.lit(0.0)), F.greatest(F.col(f"s_{t}") - (0.0 if own is None else own), F.lit(0.0))
    one = 0 if own is None else 1
    host = (out[0] + F.col(f"wh_{t}") * F.col(f"prior_{t}")) / (F.col("hn") - one + F.col(f"wh_{t}"))
    return (out[1] + F.col(f"wp_{t}") * host) / (F.col("n") - one + F.col(f"wp_{t}"))


def site_posteriors(stats: DataFrame) -> DataFrame:
    """``stats`` (host, path, n, s_t: the sum of n probabilities) with prior_t and site_t for each target t,
    and what these are made of: hn and h_t of the host, the weights wh_t of the prior and wp_t of the host.

    Two grouped levels; the global figures are one row.
    """
    total = lambda names: [F.sum(c).alias(out) for out, c in names.items()]
    each = lambda f: {k: v for t in TARGETS for k, v in f(t).items()}
    hosts = stats.groupBy("host").agg(
        F.sum("n").alias("hn"), F.sum(F.col("n") * F.col("n")).alias("hn2"), F.count(F.lit(1)).alias("paths"),
        *total(each(lambda t: {f"h_{t}": F.col(f"s_{t}"), f"hq_{t}": F.col(f"s_{t}") * F.col(f"s_{t}") / F.col("n")})),
    )
    whole = hosts.agg(
        F.sum("hn").alias("gn"), F.count(F.lit(1)).alias("k"), F.sum("paths").alias("kp"), F.sum(F.col("hn") * F.col("hn")).alias("n2"), F.sum(F.col("hn2") / F.col("hn")).alias("np2"),
        *total(each(lambda t: {f"g_{t}": F.col(f"h_{t}"), f"q_{t}": F.col(f"h_{t}") * F.col(f"h_{t}") / F.col("hn"), f"qp_{t}": F.col(f"hq_{t}")})),
    )
    named = hosts.select(F.col("host").alias("h"), "hn", *(f"h_{t}" for t in TARGETS))
    out = stats.join(named, F.col("host").eqNullSafe(F.col("h"))).drop("h").join(F.broadcast(whole), F.lit(True))

    def weight(within: Column, between: Column, spread: Column) -> Column:
        """A parent weighs within / variance - 1 observations; the variance by moments."""
        variance = F.greatest(between / F.greatest(spread, F.lit(1.0)), F.lit(1e-6))
        return F.greatest(F.least(within / variance - 1, F.lit(1e6)), F.lit(1.0))

    for t in TARGETS:
        m = F.col(f"g_{t}") / F.col("gn")
        among = m * (1 - m)
        inside = (F.col(f"g_{t}") - F.col(f"q_{t}")) / F.col("gn")
        out = out.withColumns(
            {
                f"prior_{t}": m,
                f"wh_{t}": weight(among, F.col(f"q_{t}") - F.col("gn") * m * m - (F.col("k") - 1) * among, F.col("gn") - F.col("n2") / F.col("gn")),
                f"wp_{t}": weight(inside, F.col(f"qp_{t}") - F.col(f"q_{t}") - (F.col("kp") - F.col("k")) * inside, F.col("gn") - F.col("np2")),
            }
        )
    out = out.withColumns({f"site_{t}": _posterior(t) for t in TARGETS})
    return out.select("host", "path", "n", "hn", *(f"{k}_{t}" for t in TARGETS for k in ("s", "h", "wh", "wp", "prior", "site")))


def judge(docs: DataFrame, labels: DataFrame, host: Column, path: Column, keep: list[str] | None = None) -> DataFrame:
    """(row, quality, toxic, kept): the input row (its columns ``keep``) as a struct, both probabilities, and the verdict."""
    model = fit(labelled_sample(docs, labels))
    row = F.struct(*(F.col(f"`{c}`") for c in (docs.columns if keep is None else keep))).alias("row")
    scored = evidence(docs.select(row, F.col("doc_id").alias("id"), "text", host.alias("host"), path.alias("path")), model)
    p = {t: F.when(F.isnan(f"e_{t}"), 0.5 if t == "quality" else 0.0).otherwise(_probability(F.col(f"e_{t}"))) for t in TARGETS}
    scored = materialise(scored.withColumns({f"p_{t}": c for t, c in p.items()}), "scored")
    soft = scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), *(F.sum(f"p_{t}").alias(f"s_{t}") for t in TARGETS))
    marks = labels.groupBy("doc_id").agg(*(F.avg(t).alias(f"m_{t}") for t in TARGETS)).where("doc_id is not null")
    # a label takes the place of the classifier's probability
    told = marks.join(scored.select("id", "host", "path", *(f"p_{t}" for t in TARGETS)), F.col("doc_id") == F.col("id"))
    told = told.groupBy("host", "path").agg(F.lit(0).cast("long").alias("n"), *(F.sum(F.coalesce(F.col(f"m_{t}") - F.col(f"p_{t}"), F.lit(0.0))).alias(f"s_{t}") for t in TARGETS))
    stats = soft.unionByName(told).groupBy("host", "path").agg(F.sum("n").alias("n"), *(F.sum(f"s_{t}").alias(f"s_{t}") for t in TARGETS))
    sites = materialise(site_posteriors(stats).withColumnsRenamed({"host": "site_host", "path": "site_path"}), "sites")
    if sites.count() <= BROADCAST_SITES:
        sites = F.broadcast(sites)
    final = scored.join(sites, F.col("host").eqNullSafe(F.col("site_host")) & F.col("path").eqNullSafe(F.col("site_path")))
    lean = lambda t: _odds(_posterior(t, F.col(f"p_{t}"))) - _odds(F.col(f"prior_{t}"))
    out = {t: F.when(F.isnan(f"e_{t}"), F.col(f"p_{t}")).otherwise(_probability(F.col(f"e_{t}") + lean(t))) for t in TARGETS}
    return final.select("row", out["quality"].alias("quality"), out["toxic"].alias("toxic")).withColumn("kept", (F.col("quality") >= 0.5) & (F.col("toxic") < 0.5))


def op1_empirical_bayes(spark, sf_dir: str) -> DataFrame:
    """All documents: doc_id, quality, toxic, kept; a host is a source, its paths are languages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.col("source"), F.col("lang"), keep=["doc_id"])
    return out.select("row.doc_id", "quality", "toxic", "kept")
