"""Editions, footprints and histories derived from the driver's tables.

The driver's tables carry no dated editions, so three are derived from
``orders`` by fixed arithmetic rules, and axis-aligned footprints from ``part``.
Nothing but this package and the query catalogue knows table names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def edition(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """Edition 1, 2 or 3 of ``orders``: key, id, status, total, priority, cust.

    ``key`` is the natural key; ``id`` is the stable identifier, which some
    records change from one edition to the next.
    """
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("key"),
        F.col("o_orderkey").alias("id"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").cast(MONEY).alias("total"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_custkey").alias("cust"),
    )
    k = F.col("key")
    if n == 1:
        return o.where(k % 11 != 0)
    if n == 2:
        return o.where(k % 7 != 0).withColumns(
            {"id": k + F.when(k % 13 == 0, 1_000_000).otherwise(0), "status": F.when(k % 5 == 0, "X").otherwise(F.col("status"))}
        )
    if n == 3:
        return o.where(k % 17 != 0).withColumns(
            {"id": k + F.when(k % 13 == 0, 2_000_000).otherwise(0), "total": F.when(k % 3 == 0, F.col("total") * 2).otherwise(F.col("total")).cast(MONEY)}
        )
    raise ValueError(f"no edition {n}")


#: Columns of an edition that count as its attributes.
ATTRIBUTES = ["status", "total", "priority", "cust"]

#: The same editions for DuckDB, as common table expressions e1, e2, e3.
SQL = """
e1 AS (SELECT o_orderkey AS key, o_orderkey AS id, o_orderstatus AS status, CAST(o_totalprice AS DECIMAL(18,2)) AS total,
  o_orderpriority AS priority, o_custkey AS cust FROM orders WHERE o_orderkey % 11 <> 0),
e2 AS (SELECT o_orderkey AS key, o_orderkey + CASE WHEN o_orderkey % 13 = 0 THEN 1000000 ELSE 0 END AS id,
  CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS status, CAST(o_totalprice AS DECIMAL(18,2)) AS total,
  o_orderpriority AS priority, o_custkey AS cust FROM orders WHERE o_orderkey % 7 <> 0),
e3 AS (SELECT o_orderkey AS key, o_orderkey + CASE WHEN o_orderkey % 13 = 0 THEN 2000000 ELSE 0 END AS id, o_orderstatus AS status,
  CAST(CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_totalprice AS DECIMAL(18,2)) * 2 ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS DECIMAL(18,2)) AS total,
  o_orderpriority AS priority, o_custkey AS cust FROM orders WHERE o_orderkey % 17 <> 0)
"""


def footprints(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """Rectangles (id, x0, y0, x1, y1) in metres, edition 1 or 2, on a 20 m lattice of parts.

    Edition 2 drops some, renumbers some, shifts some by a fraction of their
    width, and cuts some into a west and an east half.
    """
    k = F.col("p_partkey")
    base = table(spark, sf_dir, "part").select(
        k.alias("id"), ((k % 200) * 20.0).alias("x0"), (F.floor(k / 200) * 20.0).alias("y0"), (F.lit(8.0) + k % 5).alias("w"), (F.lit(6.0) + k % 4).alias("h")
    )
    i = F.col("id")
    if n == 1:
        return base.select("id", "x0", "y0", (F.col("x0") + F.col("w")).alias("x1"), (F.col("y0") + F.col("h")).alias("y1")).where(i % 19 != 0)
    moved = base.where(i % 23 != 0).withColumn("x0", F.col("x0") + F.when(i % 7 == 3, F.col("w") * 0.25).when(i % 31 == 5, F.col("w") * 0.75).otherwise(0.0))
    whole = moved.where(i % 10 != 0).select(
        F.when(i % 6 == 1, i + 1_000_000).otherwise(i).alias("id"), "x0", "y0", (F.col("x0") + F.col("w")).alias("x1"), (F.col("y0") + F.col("h")).alias("y1")
    )
    half = F.col("x0") + F.col("w") / 2
    west = moved.where(i % 10 == 0).select((i + 2_000_000).alias("id"), "x0", "y0", half.alias("x1"), (F.col("y0") + F.col("h")).alias("y1"))
    east = moved.where(i % 10 == 0).select((i + 3_000_000).alias("id"), half.alias("x0"), "y0", (F.col("x0") + F.col("w")).alias("x1"), (F.col("y0") + F.col("h")).alias("y1"))
    return whole.unionByName(west).unionByName(east)


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edition 2 of the footprints and, on the records that it cuts in two: a sliver, a third piece
    that overlaps both halves, and a wide one that takes part of the record and lies beyond it."""
    k = F.col("p_partkey")
    cut = table(spark, sf_dir, "part").where((k % 10 == 0) & (k % 23 != 0)).select(
        k.alias("i"), ((k % 200) * 20.0).alias("x"), (F.floor(k / 200) * 20.0).alias("y"), (F.lit(8.0) + k % 5).alias("w"), (F.lit(6.0) + k % 4).alias("h")
    )
    i, x, y, w, h = (F.col(c) for c in "ixywh")
    part = lambda df, n, x0, y0, x1, y1: df.select((i + n).alias("id"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
    out = footprints(spark, sf_dir, 2).unionByName(part(cut, 4_000_000, x, y, x + w * 0.0625, y + h))
    out = out.unionByName(part(cut.where(i % 20 == 0), 5_000_000, x + w * 0.25, y + h * 0.25, x + w * 0.75, y + h * 0.75))
    return out.unionByName(part(cut.where(i % 30 == 0), 6_000_000, x + w * 0.75, y - 5.0, x + w + 3.0, y + h * 0.5))


#: The same footprints for DuckDB, as r1 and r2.
RECTANGLES = """
rb AS (SELECT p_partkey AS id, (p_partkey % 200) * 20.0::DOUBLE AS x0, floor(p_partkey / 200) * 20.0::DOUBLE AS y0,
  8.0::DOUBLE + p_partkey % 5 AS w, 6.0::DOUBLE + p_partkey % 4 AS h FROM part),
r1 AS (SELECT id, x0, y0, x0 + w AS x1, y0 + h AS y1 FROM rb WHERE id % 19 <> 0),
rm AS (SELECT id, x0 + CASE WHEN id % 7 = 3 THEN w * 0.25::DOUBLE WHEN id % 31 = 5 THEN w * 0.75::DOUBLE ELSE 0.0::DOUBLE END AS x0, y0, w, h FROM rb WHERE id % 23 <> 0),
r2 AS (SELECT CASE WHEN id % 6 = 1 THEN id + 1000000 ELSE id END AS id, x0, y0, x0 + w AS x1, y0 + h AS y1 FROM rm WHERE id % 10 <> 0
  UNION ALL SELECT id + 2000000, x0, y0, x0 + w / 2, y0 + h FROM rm WHERE id % 10 = 0
  UNION ALL SELECT id + 3000000, x0 + w / 2, y0, x0 + w, y0 + h FROM rm WHERE id % 10 = 0)
"""

#: And the pieces, as r3.
PIECES = """
rc AS (SELECT * FROM rb WHERE id % 10 = 0 AND id % 23 <> 0),
r3 AS (SELECT * FROM r2 UNION ALL SELECT id + 4000000, x0, y0, x0 + w * 0.0625::DOUBLE, y0 + h FROM rc
  UNION ALL SELECT id + 5000000, x0 + w * 0.25::DOUBLE, y0 + h * 0.25::DOUBLE, x0 + w * 0.75::DOUBLE, y0 + h * 0.75::DOUBLE FROM rc WHERE id % 20 = 0
  UNION ALL SELECT id + 6000000, x0 + w * 0.75::DOUBLE, y0 - 5.0::DOUBLE, x0 + w + 3.0::DOUBLE, y0 + h * 0.5::DOUBLE FROM rc WHERE id % 30 = 0)
"""
