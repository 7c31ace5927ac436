"""Sharding by Karmarkar-Karp differencing.

Equal texts form one indivisible group.  A partial partition holds one sum a
shard; the two with the largest spread are combined, the largest sum of one
meeting the least of the other, until one is left.

The method is run as a tree.  Groups are dealt into buckets by a hash of their
key, each task reduces one bucket to one partial partition, and further levels
reduce ``FAN`` partial partitions to one until the driver holds at most ``FAN``
of them.  Groups heavier than ``1 / (HEAVY * shards)`` of all bytes, of which
there are fewer than ``HEAVY * shards``, and the groups of the first bucket skip
that and join at the top as partial partitions of their own: the large ones are
differenced first and the small ones even out what they leave.

Defined results: null text counts as the empty text (size 1, CRC 0) and shares
its group; null ids are kept; repeated rows all get slots of their own; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewright.llm.common import number_within
from lakewright.sources.shared import materialise

SHARDS = 16
#: Groups that one task takes, and partial partitions that one node of the tree combines.
GROUPS_A_BUCKET, FAN = 8192, 1024
HEAVY = 64


def difference(vectors: list[list[int]]) -> tuple[list[int], list[list[int]]]:
    """Combine partial partitions to one: its sums, and the shard of each entry of each vector.

    Ties go by the order of the vectors.  Entries that sum to nothing may go
    anywhere and are spread with the rest.
    """
    if not vectors:
        return [], []
    k = len(vectors[0])
    left, right = [], []  # inner nodes, numbered after the leaves
    leaves = len(vectors) * k
    heap = []
    for i, v in enumerate(vectors):
        entries = sorted(((s, i * k + j if s else -1) for j, s in enumerate(v)), reverse=True)
        heap.append((entries[-1][0] - entries[0][0], i, entries))
    heapq.heapify(heap)
    made = len(vectors)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        merged = []
        for (x, p), (y, q) in zip(a, reversed(b)):
            if p < 0 or q < 0:
                merged.append((x + y, max(p, q)))
            else:
                merged.append((x + y, leaves + len(left)))
                left.append(p)
                right.append(q)
        merged.sort(reverse=True)
        made += 1
        heapq.heappush(heap, (merged[-1][0] - merged[0][0], made, merged))
    final = heap[0][2]
    place = [[0] * k for _ in vectors]
    todo = [(node, shard) for shard, (_, node) in enumerate(final) if node >= 0]
    while todo:
        node, shard = todo.pop()
        if node < leaves:
            place[node // k][node % k] = shard
        else:
            todo += [(left[node - leaves], shard), (right[node - leaves], shard)]
    return [s for s, _ in final], place


def assign_groups(groups: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(key, shard) for groups (key, bytes)."""
    groups = materialise(groups.select("key", "bytes"), "groups")
    total = groups.agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n")).first()
    if not total["n"]:
        return groups.select("key", F.lit(0).alias("shard"))
    spark = groups.sparkSession
    least = total["b"] // (HEAVY * shards) + 1
    # fewer than HEAVY * shards groups can weigh this much, and a bucket is bounded
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets := -(-total["n"] // GROUPS_A_BUCKET)))
    single = groups.where((F.col("bytes") >= least) | (bucket == 0)).orderBy(F.desc("bytes"), "key").collect()

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "key"], ascending=[False, True], kind="stable")
        _, place = difference([[int(b)] + [0] * (shards - 1) for b in pdf["bytes"]])
        return pd.DataFrame({"key": pdf["key"], "bytes": pdf["bytes"], "bucket": pdf["bucket"], "part": [p[0] for p in place]})

    key_type = groups.schema["key"].dataType.simpleString()
    light = groups.where((F.col("bytes") < least) & (bucket > 0)).withColumn("bucket", bucket)
    dealt = materialise(light.groupBy("bucket").applyInPandas(local, f"key {key_type}, bytes long, bucket long, part int"), "parts")
    sums = dealt.groupBy("bucket", "part").agg(F.sum("bytes").alias("bytes"))
    # each level of the tree: (bucket, part) -> (bucket of the next level, part there)
    where = dealt.select("key", "bucket", "part")
    while buckets > FAN:
        level = _combine(sums, shards)
        level = materialise(level, "tree")
        where = where.join(level.drop("bytes"), ["bucket", "part"]).select("key", F.col("up").alias("bucket"), F.col("up_part").alias("part"))
        sums = level.groupBy(F.col("up").alias("bucket"), F.col("up_part").alias("part")).agg(F.sum("bytes").alias("bytes"))
        buckets = -(-buckets // FAN)
    vectors: dict[int, list[int]] = {}
    for r in sums.collect():  # at most FAN buckets of ``shards`` sums
        vectors.setdefault(r["bucket"], [0] * shards)[r["part"]] = r["bytes"]
    order = sorted(vectors)
    _, place = difference([[g["bytes"]] + [0] * (shards - 1) for g in single] + [vectors[b] for b in order])
    top = [(b, part, place[len(single) + i][part]) for i, b in enumerate(order) for part in range(shards)]
    small = spark.createDataFrame(top, "bucket long, part int, shard int")
    own = spark.createDataFrame([(g["key"], place[i][0]) for i, g in enumerate(single)], f"key {key_type}, shard int")
    return where.join(F.broadcast(small), ["bucket", "part"]).select("key", "shard").unionByName(own)


def _combine(sums: DataFrame, shards: int) -> DataFrame:
    def node(pdf: pd.DataFrame) -> pd.DataFrame:
        vectors: dict[int, list[int]] = {}
        for b, p, s in zip(pdf["bucket"], pdf["part"], pdf["bytes"]):
            vectors.setdefault(int(b), [0] * shards)[int(p)] = int(s)
        order = sorted(vectors)
        _, place = difference([vectors[b] for b in order])
        spot = {b: place[i] for i, b in enumerate(order)}
        return pdf.assign(up_part=[spot[int(b)][int(p)] for b, p in zip(pdf["bucket"], pdf["part"])])

    return sums.withColumn("up", F.floor(F.col("bucket") / FAN)).groupBy("up").applyInPandas(
        node, "bucket long, part int, bytes long, up long, up_part int"
    )


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row."""
    body = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).cast("long").alias("text_crc32"), F.unhex(F.md5(body)).alias("key")
    )
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    n = docs.count()
    placed = materialise(rows.join(assign_groups(groups, shards), "key").drop("key"), "placed")
    return number_within(placed, "shard", ["doc_id", "text_crc32"], "slot", n)


def op4_karmarkar_karp(spark, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes; equal texts stay together."""
    out = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
