"""Helpers shared by the corpus operators: distributed numbering and connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lakewright.sources.shared import discard, materialise

#: Rows that one task numbers in :func:`number_within`.
ROWS_A_SLICE = 20_000


def number_within(df: DataFrame, group: str, key: list[str], out: str, rows: int) -> DataFrame:
    """Gapless numbers from 0 inside each value of ``group``, as column ``out``.

    A group is dealt over slices by a hash of ``key`` so that no task holds a
    whole group; slice counts give each slice its first number.  ``rows`` is
    the row count, from which the number of slices follows.
    """
    slices = max(1, -(-rows // ROWS_A_SLICE))
    cut = df.withColumn("_slice", F.pmod(F.xxhash64(*key), F.lit(slices)).cast("int"))
    counts = cut.groupBy(group, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    first = F.sum("_n").over(Window.partitionBy(group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(F.col(group).alias("_g"), F.col("_slice").alias("_s"), F.coalesce(first, F.lit(0)).alias("_first"))
    at = F.row_number().over(Window.partitionBy(group, "_slice").orderBy(*key)) - 1
    numbered = cut.withColumn("_at", at)
    return (
        numbered.join(starts, numbered[group].eqNullSafe(starts["_g"]) & (numbered["_slice"] == starts["_s"]))
        .withColumn(out, (F.col("_at") + F.col("_first")).cast("long"))
        .drop("_slice", "_g", "_s", "_first", "_at")
    )


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"),
    ).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node reachable, for every node of an edge.

    Alternates large-star and small-star contraction.  The least neighbour of
    a node is a grouped minimum with map-side combine, joined back to the
    edges, so a node with very many edges is never gathered in one task.
    Null ends and loops are ignored; an empty edge table gives no rows.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    e = materialise(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _fingerprint(e)
    while state[0]:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # the minima are written first: a join of two plain exchanges is one whose hot keys Spark can split
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        least = materialise(least.select(F.col("a").alias("u"), F.least("a", "m").alias("m")), "least")
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialise(large.where("a <> b").distinct(), "large")
        down = materialise(large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m"), "down")
        hung = large.join(down, F.col("a") == F.col("u"))
        small = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(down.select("u", "m")).distinct()
        after = materialise(small, "edges")
        for used in (e, least, large, down):
            discard(used)
        e, before = after, state
        state = _fingerprint(e)
        if state == before:
            break
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a lambda variable.

    Without it the optimiser may paste an array expression into the lambda
    that indexes it, which evaluates the array for every element.
    """
    return F.transform(F.array(value), body)[0]
