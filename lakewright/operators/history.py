"""Histories of records over ordered versions, and other ordered computations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def entity_history(versions: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """Each version with what happened: first appearance, changed, or carried unchanged."""
    before = F.lag(state).over(Window.partitionBy(key).orderBy(*order))
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    event = F.when(F.col("n") == 1, "first_appearance").when(F.col(state).eqNullSafe(F.col("before")), "unchanged").otherwise("changed")
    return versions.withColumns({"before": before, "n": n}).withColumn("event", event)


#: Kinds of versions that carry whole editions, in which an unchanged record is still told.
CARRYING = ("source-baseline", "scope-extract", "layout")


def member_history(versions: DataFrame, key: str, order: str) -> DataFrame:
    """What happened to each record over its versions (key, order, kind, id, values: map, mentioned).

    A version without the record has a null id.  Events: first appearance, changed, id changed,
    carried unchanged (in a version of a kind of ``CARRYING``), removed.  A version that leaves the
    record as it was has none unless it mentions it; a removal in a plain proposal counts only if it
    mentions the record.  ``changes`` maps each key that differs to its old and new value, and
    ``id_from`` is the id before.  After a removal the record appears for the first time again.
    """
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    there = F.col("id").isNotNull()
    told = F.coalesce(F.col("mentioned"), F.lit(False))
    gone = ~there & ((F.col("kind") != "proposal") | told)
    last = lambda value: F.last(F.when(there, value), True).over(w)
    rows = versions.withColumns(
        {"_seen": F.max(F.when(there, F.col(order))).over(w), "_gone": F.max(F.when(gone, F.col(order))).over(w), "_id": last(F.col("id")), "_values": last(F.col("values"))}
    )
    known = F.col("_seen").isNotNull() & (F.col("_gone").isNull() | (F.col("_gone") < F.col("_seen")))
    rows = rows.withColumn("_known", known).withColumn("_old", F.when(known, F.col("_values")))
    names = F.array_union(F.map_keys("values"), F.coalesce(F.map_keys("_old"), F.array().cast("array<string>")))
    differing = F.filter(F.array_sort(names), lambda k: ~F.try_element_at("_old", k).eqNullSafe(F.try_element_at("values", k)) | ~F.col("_known"))
    changes = F.map_from_arrays(differing, F.transform(differing, lambda k: F.struct(F.try_element_at("_old", k).alias("old"), F.try_element_at("values", k).alias("new"))))
    same = F.col("_known") & (F.size(differing) == 0) & (F.col("id") == F.col("_id"))
    event = (
        F.when(gone & F.col("_known"), "removed")
        .when(~there, None)
        .when(same & F.col("kind").isin(*CARRYING), "carried unchanged")
        .when(same & ~told, None)
        .when(~F.col("_known"), "first appearance")
        .when(F.col("id") != F.col("_id"), "id changed")
        .otherwise("changed")
    )
    rows = rows.withColumns({"event": event, "changes": F.when(there & (event != "carried unchanged"), changes), "id_from": F.when(there & (F.col("id") != F.col("_id")), F.col("_id"))})
    return rows.where("event is not null").select(key, order, "kind", "event", F.when(there, F.col("id")).otherwise(F.col("_id")).alias("id"), "id_from", "changes")


def edition_history(editions: DataFrame, key: str, n: int) -> DataFrame:
    """(key, ed, event) over editions 1..n of rows (key, ed, id, digest, place).

    Events in order of precedence: first_appearance, reappeared, removed, id_changed, changed, moved, unchanged.
    """
    grid = editions.select(key).distinct().withColumn("ed", F.explode(F.sequence(F.lit(1), F.lit(n))))
    rows = grid.join(editions.withColumn("there", F.lit(True)), [key, "ed"], "left").withColumn("there", F.coalesce("there", F.lit(False)))
    w = Window.partitionBy(key).orderBy("ed")
    last = lambda c: F.last(F.when(F.col("there"), F.col(c)), True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    was = F.lag("there", 1, False).over(w)
    rows = rows.withColumns({"was": was, "p_id": last("id"), "p_digest": last("digest"), "p_place": last("place")})
    event = (
        F.when(F.col("there") & F.col("p_id").isNull(), "first_appearance")
        .when(F.col("there") & ~F.col("was"), "reappeared")
        .when(~F.col("there") & F.col("was"), "removed")
        .when(~F.col("there"), None)
        .when(F.col("id") != F.col("p_id"), "id_changed")
        .when(F.col("digest") != F.col("p_digest"), "changed")
        .when(F.col("place") != F.col("p_place"), "moved")
        .otherwise("unchanged")
    )
    return rows.select(key, "ed", event.alias("event")).where("event is not null")


def first_occurrence(rows: DataFrame, key: str, batch: Column) -> DataFrame:
    """(key, batch): the first batch in which each key stands."""
    return rows.groupBy(key).agg(F.min(batch).alias("batch"))


def repeated_changes(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Changes of a key after its first, with the number of the repeat."""
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("n > 1")


def latest(rows: DataFrame, key: str | list[str], order: list[str], cols: list[str]) -> DataFrame:
    """The last row of each key by ``order``."""
    keys = [key] if isinstance(key, str) else key
    best = rows.groupBy(*keys).agg(F.max(F.struct(*order, *cols)).alias("b"))
    return best.select(*keys, *(F.col(f"b.{c}").alias(c) for c in dict.fromkeys([*order, *cols])))


def occupancy(moves: DataFrame) -> DataFrame:
    """(ord, target, ok): whether the target of a move (ord, source, target) is free at its turn.

    A target is taken by the last earlier move that arrived there unless a later
    one, still earlier than now, left it.
    """
    visits = moves.select(F.col("target").alias("place"), "ord", F.lit(1).alias("kind")).unionByName(
        moves.select(F.col("source").alias("place"), "ord", F.lit(-1).alias("kind"))
    )
    w = Window.partitionBy("place").orderBy("ord", "kind").rowsBetween(Window.unboundedPreceding, -1)
    held = visits.withColumn("last", F.last("kind").over(w)).where("kind = 1")
    return held.select("ord", F.col("place").alias("target"), F.coalesce(F.col("last") != 1, F.lit(True)).alias("ok"))


def history_order(rows: DataFrame, group: str, current: Column, order: Column) -> DataFrame:
    """Position inside each group: the current one first, then the newest."""
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(group).orderBy(current.desc(), order.desc())))
