"""Packing by optimal length buckets.

The histogram of lengths over all documents goes to the driver; its size is
bounded by the longest document, not by their number.  Dynamic programming
picks at most ``BUCKETS`` boundaries so that padding every document to its
bucket's boundary adds the fewest tokens.  Inside a bucket, documents fill
batches of ``TOKEN_BUDGET // boundary`` rows.

Length is the number of white-space words plus one end token.  Defined
results: null text has length 1; a document longer than the budget is a batch
of its own, whole; repeated rows are packed each; null ids are kept; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewright.llm.common import number_within
from lakewright.sources.shared import materialise

BUCKETS = 16
TOKEN_BUDGET = 65_536


def length_of(text: Column) -> Column:
    return (F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")) + 1).cast("long")


def boundaries(histogram: list[tuple[int, int]], buckets: int = BUCKETS) -> list[int]:
    """Ascending bucket lengths that minimise the padding; of equal choices the one with fewest buckets.

    With prefix counts N and tokens T, a bucket over lengths i+1..j pads
    B[j] * (N[j] - N[i]) - (T[j] - T[i]) tokens.  For fixed j this is a minimum
    over lines in B[j] with falling slopes -N[i], so one convex hull a layer
    gives every j in linear time.
    """
    histogram = sorted((int(b), int(c)) for b, c in histogram if c)
    if not histogram:
        return []
    lengths = [b for b, _ in histogram]
    n = len(lengths)
    count, tokens = [0], [0]
    for b, c in histogram:
        count.append(count[-1] + c)
        tokens.append(tokens[-1] + b * c)
    best = [0] + [None] * n
    back: list[list[int]] = []
    done = None
    for layer in range(1, min(buckets, n) + 1):
        now, chosen = [None] * (n + 1), [0] * (n + 1)
        hull: list[tuple[int, int, int]] = []  # (slope, intercept, i)
        at = 0
        for j in range(1, n + 1):
            i = j - 1
            if best[i] is not None:
                line = (-count[i], best[i] + tokens[i], i)
                while len(hull) >= 2 and _hidden(hull[-2], hull[-1], line):
                    hull.pop()
                hull.append(line)
                at = min(at, len(hull) - 1)
            if not hull:
                continue
            x = lengths[j - 1]
            while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] <= hull[at][0] * x + hull[at][1]:
                at += 1
            slope, intercept, i = hull[at]
            now[j] = slope * x + intercept + x * count[j] - tokens[j]
            chosen[j] = i
        back.append(chosen)
        if done is None or now[n] < done[0]:
            done = (now[n], layer)
        best = now
        if done[0] == 0:
            break
    out, j = [], n
    for layer in range(done[1], 0, -1):
        out.append(lengths[j - 1])
        j = back[layer - 1][j]
    return out[::-1]


def _hidden(a, b, c) -> bool:
    """Line b is nowhere below both a and c (slopes fall from a to c)."""
    return (c[1] - a[1]) * (a[0] - b[0]) <= (b[1] - a[1]) * (a[0] - c[0])


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = TOKEN_BUDGET) -> DataFrame:
    """doc_id, n_tokens, bucket, bucket_len, batch, place for every row.

    The driver holds one number for each distinct length: d of them need texts of d * d / 2 words in
    all, so 10^13 words have 4.5 million at most.
    """
    rows = materialise(docs.select("doc_id", length_of(F.col("text")).alias("n_tokens"), F.xxhash64("text").alias("_h")), "lengths")
    histogram = [(r["n_tokens"], r["n"]) for r in rows.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()]
    bounds = boundaries(histogram, buckets) or [1]
    n = sum(c for _, c in histogram)
    lengths = F.array(*(F.lit(b).cast("long") for b in bounds))
    rows = rows.withColumn("bucket", F.size(F.filter(lengths, lambda b: b < F.col("n_tokens"))))
    rows = rows.withColumn("bucket_len", F.get(lengths, F.col("bucket")))
    rows = number_within(rows, "bucket", ["doc_id", "_h"], "_slot", n)
    held = F.greatest(F.floor(F.lit(budget) / F.col("bucket_len")), F.lit(1)).cast("long")
    return rows.withColumn("batch", F.floor(F.col("_slot") / held).cast("long")).withColumn("place", F.pmod("_slot", held)).select(
        "doc_id", "n_tokens", "bucket", "bucket_len", "batch", "place"
    )


def op5_length_buckets(spark, sf_dir: str) -> DataFrame:
    """All documents in token-budget batches inside optimal length buckets."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
