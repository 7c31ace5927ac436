"""Queries over ordered versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakewright.operators import diff as D
from lakewright.operators import history as H
from lakewright.plans.binding import query
from lakewright.sources import editions as E


def _events(spark, d):
    return E.table(spark, d, "events")


@query(
    """WITH v AS (SELECT user_id, ts, event_id, event_type, lag(event_type) OVER w AS before, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, before, n, CASE WHEN n = 1 THEN 'first_appearance' WHEN event_type IS NOT DISTINCT FROM before THEN 'unchanged' ELSE 'changed' END AS event FROM v"""
)
def entity_history(spark, d):
    out = H.entity_history(_events(spark, d).select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"], "event_type")
    return out.select("user_id", "event_id", "before", F.col("n").cast("long").alias("n"), "event")


_KIND = "CASE (key + ed) % 4 WHEN 0 THEN 'proposal' WHEN 1 THEN 'source-baseline' WHEN 2 THEN 'layout' ELSE 'source-update' END"


@query(
    f"""WITH {E.SQL}, r AS (SELECT key, 1 AS ed, id, status, total, priority FROM e1 UNION ALL SELECT key, 2, id, status, total, priority FROM e2 UNION ALL SELECT key, 3, id, status, total, priority FROM e3),
k AS (SELECT DISTINCT key FROM r), g AS (SELECT key, t.ed, {_KIND} AS kind, (key * 7 + t.ed) % 3 = 0 AS mentioned, r.id, r.status, CAST(r.total AS VARCHAR) AS total, CASE WHEN (key + t.ed) % 10 <> 0 THEN r.priority END AS priority
  FROM k CROSS JOIN (VALUES (1), (2), (3)) t(ed) LEFT JOIN r USING (key, ed)),
p AS (SELECT *, id IS NULL AND (kind <> 'proposal' OR mentioned) AS gone FROM g),
q AS (SELECT *, max(ed) FILTER (id IS NOT NULL) OVER w AS seen, max(ed) FILTER (gone) OVER w AS lost FROM p WINDOW w AS (PARTITION BY key ORDER BY ed ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
j AS (SELECT q.*, b.id AS b_id, b.status AS b_status, b.total AS b_total, b.priority AS b_priority, q.seen IS NOT NULL AND (q.lost IS NULL OR q.lost < q.seen) AS known FROM q LEFT JOIN p b ON b.key = q.key AND b.ed = q.seen),
x AS (SELECT *, concat_ws(',', CASE WHEN priority IS NOT NULL AND NOT known THEN 'priority:>' || priority WHEN known AND priority IS DISTINCT FROM b_priority THEN 'priority:' || coalesce(b_priority, '') || '>' || coalesce(priority, '') END,
    CASE WHEN NOT known THEN 'status:>' || status WHEN status <> b_status THEN 'status:' || b_status || '>' || status END, CASE WHEN NOT known THEN 'total:>' || total WHEN total <> b_total THEN 'total:' || b_total || '>' || total END) AS ch FROM j),
v AS (SELECT *, CASE WHEN gone AND known THEN 'removed' WHEN id IS NULL THEN NULL WHEN known AND ch = '' AND id = b_id AND kind IN ('source-baseline', 'layout') THEN 'carried unchanged' WHEN known AND ch = '' AND id = b_id AND NOT mentioned THEN NULL
  WHEN NOT known THEN 'first appearance' WHEN id <> b_id THEN 'id changed' ELSE 'changed' END AS event FROM x)
SELECT key, CAST(ed AS INTEGER) AS ed, kind, event, coalesce(id, b_id) AS id, CASE WHEN id <> b_id THEN b_id END AS id_from, CASE WHEN id IS NOT NULL AND event <> 'carried unchanged' THEN ch END AS changes FROM v WHERE event IS NOT NULL"""
)
def member_history(spark, d):
    """Every record over three versions of several kinds, with what changed key by key."""
    rows = None
    for n in (1, 2, 3):
        one = E.edition(spark, d, n).withColumn("ed", F.lit(n))
        rows = one if rows is None else rows.unionByName(one)
    grid = rows.select("key").distinct().withColumn("ed", F.explode(F.array(*(F.lit(n) for n in (1, 2, 3)))))
    at = (F.col("key") + F.col("ed")) % 4
    kind = F.when(at == 0, "proposal").when(at == 1, "source-baseline").when(at == 2, "layout").otherwise("source-update")
    some = F.when((F.col("key") + F.col("ed")) % 10 != 0, F.col("priority"))
    values = F.create_map(F.lit("status"), F.col("status"), F.lit("total"), F.col("total").cast("string"), F.lit("priority"), some)
    versions = grid.join(rows, ["key", "ed"], "left").select("key", "ed", kind.alias("kind"), "id", F.map_filter(values, lambda k, v: v.isNotNull()).alias("values"), ((F.col("key") * 7 + F.col("ed")) % 3 == 0).alias("mentioned"))
    out = H.member_history(versions, "key", "ed")
    part = lambda k, v: F.concat(k, F.lit(":"), F.coalesce(v["old"], F.lit("")), F.lit(">"), F.coalesce(v["new"], F.lit("")))
    return out.withColumn("changes", F.array_join(F.transform(F.map_entries("changes"), lambda e: part(e["key"], e["value"])), ","))


_DIG = "status || '|' || CAST(total AS VARCHAR) || '|' || priority"


@query(
    f"""WITH {E.SQL}, r AS (SELECT key, 1 AS ed, id, {_DIG} AS g, id % 3 AS place FROM e1 UNION ALL SELECT key, 2, id, {_DIG}, id % 3 FROM e2 UNION ALL SELECT key, 3, id, {_DIG}, id % 2 FROM e3),
k AS (SELECT DISTINCT key FROM r), gr AS (SELECT key, ed FROM k, (VALUES (1), (2), (3)) t(ed)),
j AS (SELECT gr.key, gr.ed, r.id, r.g, r.place, r.id IS NOT NULL AS there FROM gr LEFT JOIN r ON r.key = gr.key AND r.ed = gr.ed),
x AS (SELECT *, coalesce(lag(there) OVER w, false) AS was, last_value(id IGNORE NULLS) OVER p AS pid, last_value(g IGNORE NULLS) OVER p AS pg, last_value(place IGNORE NULLS) OVER p AS pp FROM j
  WINDOW w AS (PARTITION BY key ORDER BY ed), p AS (PARTITION BY key ORDER BY ed ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
e AS (SELECT key, CAST(ed AS INTEGER) AS ed, CASE WHEN there AND pid IS NULL THEN 'first_appearance' WHEN there AND NOT was THEN 'reappeared' WHEN NOT there AND was THEN 'removed' WHEN NOT there THEN NULL
  WHEN id <> pid THEN 'id_changed' WHEN g <> pg THEN 'changed' WHEN place <> pp THEN 'moved' ELSE 'unchanged' END AS event FROM x)
SELECT key, ed, event FROM e WHERE event IS NOT NULL"""
)
def history_index(spark, d):
    """Every record over three editions: appearances, removals, changes of id, content and place."""
    rows = None
    for n in (1, 2, 3):
        e = E.edition(spark, d, n)
        one = e.select("key", F.lit(n).alias("ed"), "id", D.content(["status", "total", "priority"]).alias("digest"), (F.col("id") % (2 if n == 3 else 3)).alias("place"))
        rows = one if rows is None else rows.unionByName(one)
    return H.edition_history(rows, "key", 3)


@query("SELECT user_id, min(CAST(ts AS DATE)) AS batch FROM events GROUP BY user_id")
def first_occurrence(spark, d):
    return H.first_occurrence(_events(spark, d), "user_id", F.to_date("ts"))


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events QUALIFY n > 1")
def duplicate_change(spark, d):
    return H.repeated_changes(_events(spark, d), "user_id", ["ts", "event_id"]).select("user_id", "event_id", F.col("n").cast("long").alias("n"))


@query("SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events WHERE event_type IN ('view', 'click', 'error') GROUP BY 1, 2")
def latest_opinion(spark, d):
    rows = _events(spark, d).where(F.col("event_type").isin("view", "click", "error"))
    return H.latest(rows, ["user_id", "event_type"], ["ts", "event_id"], ["value"]).select("user_id", "event_type", "event_id", "value")


@query("SELECT conv_id, max(turn) AS turn, arg_max(role, (turn, text)) AS role FROM conversations GROUP BY 1")
def latest_turn(spark, d):
    return H.latest(E.table(spark, d, "conversations"), "conv_id", ["turn", "text"], ["role"]).select("conv_id", "turn", "role")


@query("SELECT l_orderkey AS id, 'item' AS path, l_linenumber AS line, l_partkey AS part, CASE WHEN count(*) OVER (PARTITION BY l_orderkey) > 1 THEN 'item[' || (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1) || ']' ELSE 'item' END AS indexed FROM lineitem")
def repeat_index(spark, d):
    rows = E.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.lit("item").alias("path"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("o"))
    return D.repeat_index(rows, "id", "path", "o").drop("o")


_OCC = "mv AS (SELECT event_id AS ord, user_id AS source, user_id * 7 % 50 AS target FROM events WHERE event_type = 'click')"


@query(
    f"""WITH {_OCC}, v AS (SELECT target AS place, ord, 1 AS kind FROM mv UNION ALL SELECT source, ord, -1 FROM mv),
h AS (SELECT *, last_value(kind) OVER (PARTITION BY place ORDER BY ord, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM v)
SELECT ord, place AS target, coalesce(last <> 1, true) AS ok FROM h WHERE kind = 1"""
)
def id_occupancy(spark, d):
    rows = _events(spark, d).where("event_type = 'click'").select(F.col("event_id").alias("ord"), F.col("user_id").alias("source"), (F.col("user_id") * 7 % 50).alias("target"))
    return H.occupancy(rows)


@query(
    """WITH r AS (SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(CAST(json_extract(props, '$.k') AS INTEGER), (ts, event_id)) AS context FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT user_id, event_id, context FROM r WHERE context % 2 = 0"""
)
def newest_report(spark, d):
    """The newest report of each user, only where its context is current."""
    rows = _events(spark, d).where("event_type = 'error'").withColumn("context", F.get_json_object("props", "$.k").cast("int"))
    return H.latest(rows, "user_id", ["ts", "event_id"], ["context"]).where("context % 2 = 0").select("user_id", "event_id", "context")


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_type = 'purchase' DESC, event_id DESC) AS position FROM events")
def history_order(spark, d):
    return H.history_order(_events(spark, d), "user_id", F.col("event_type") == "purchase", F.col("event_id")).select("user_id", "event_id", F.col("position").cast("long").alias("position"))


@query(
    """SELECT user_id, bool_or(event_type = 'error') AS any_error, bool_or(value > 90) AS any_large, arg_max(event_type, (ts, event_id)) AS last_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1"""
)
def facts_rollup(spark, d):
    t = F.col("event_type")
    return _events(spark, d).groupBy("user_id").agg(
        F.bool_or(t == "error").alias("any_error"), F.bool_or(F.col("value") > 90).alias("any_large"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"), F.count(F.lit(1)).alias("n")
    )


@query(
    """SELECT user_id % 40 AS proposal, CASE WHEN bool_or(event_type = 'error' AND value > 80) THEN 'fail' WHEN bool_or(event_type = 'signup' AND value > 95) THEN 'pending' ELSE 'pass' END AS rollup FROM events GROUP BY 1"""
)
def check_rollup(spark, d):
    t, v = F.col("event_type"), F.col("value")
    fail, wait = F.bool_or((t == "error") & (v > 80)), F.bool_or((t == "signup") & (v > 95))
    return _events(spark, d).groupBy((F.col("user_id") % 40).alias("proposal")).agg(F.when(fail, "fail").when(wait, "pending").otherwise("pass").alias("rollup"))


@query(
    """WITH c AS (SELECT event_id AS ord, user_id AS id FROM events WHERE event_type = 'purchase'), m AS (SELECT DISTINCT user_id AS id FROM events WHERE event_type = 'signup')
SELECT coalesce(c.id, m.id) AS id, count(c.ord) AS applied, bool_or(m.id IS NOT NULL) AS listed, CASE WHEN NOT bool_or(m.id IS NOT NULL) THEN 'not_listed' WHEN count(c.ord) = 0 THEN 'missing' WHEN count(c.ord) > 1 THEN 'repeated' ELSE 'ok' END AS verdict
FROM c FULL JOIN m ON c.id = m.id GROUP BY 1"""
)
def manifest_commit_check(spark, d):
    """Changes a manifest lists against the commits that apply them."""
    t = F.col("event_type")
    c = _events(spark, d).where(t == "purchase").groupBy(F.col("user_id").alias("id")).agg(F.count(F.lit(1)).alias("applied"))
    m = _events(spark, d).where(t == "signup").select(F.col("user_id").alias("id"), F.lit(True).alias("listed")).distinct()
    rows = c.join(m, "id", "full").select("id", F.coalesce("applied", F.lit(0)).alias("applied"), F.coalesce("listed", F.lit(False)).alias("listed"))
    verdict = F.when(~F.col("listed"), "not_listed").when(F.col("applied") == 0, "missing").when(F.col("applied") > 1, "repeated").otherwise("ok")
    return rows.withColumn("verdict", verdict)


@query("SELECT user_id, count(*) AS events, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS ids FROM events GROUP BY 1")
def history_documents(spark, d):
    """One document a record with its ordered events, as the index writer stores it."""
    ids = F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x.cast("string"))
    return _events(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("events"), F.array_join(ids, ",").alias("ids"))


@query("SELECT event_type, event_id, n FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS n FROM events) WHERE n <= 50")
def capped_listing(spark, d):
    """At most fifty findings a kind, as a report lists them."""
    return H.history_order(_events(spark, d), "event_type", F.col("value"), -F.col("event_id")).where("position <= 50").select("event_type", "event_id", F.col("position").cast("long").alias("n"))
