"""Chat formatting by linking tool calls to their results, in DataFrame operations only.

``calls`` has (conv_id, call_id, seq, name, arguments, depends) and ``results``
(conv_id, call_id, seq, content); other columns are ignored.  Calls and results
meet in a hash join on the pair (conv_id, call_id), so a conversation of any
length is spread over all tasks.  Arguments are checked against the schema of
their tool, calls are levelled topologically by what they depend on, and every
link is serialised as canonical JSON: keys sorted at every depth, no white
space, duplicate keys refused.

Defined results: of several calls or results with one identifier the first by
(seq, name, arguments) or (seq, content) links and the number seen is returned;
each other that differs from it in more than seq is a row of its own, of status
``duplicate_id`` and without level.  A null identifier or conversation never
links; null arguments are an empty object; text that is no JSON object, or
repeats a key, is ``malformed``; a call on a cycle, or that waits for one, has a
null level.  Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewright.operators.identity import chain_ends
from lakewright.sources.shared import discard, materialise

#: tool -> field -> (JSON type, required)
SCHEMAS = {"reply": {"prompt": ("string", True), "turn": ("integer", True), "style": ("string", False)}}

_NO_ERRORS = "cast(array() as array<string>)"
_ACCEPTS = {
    "string": r"^STRING$",
    "integer": r"^BIGINT$",
    "number": r"^(BIGINT|DECIMAL.*|DOUBLE|FLOAT)$",
    "boolean": r"^BOOLEAN$",
    "object": r"^OBJECT",
    "array": r"^ARRAY",
}


def argument_errors(name: Column, arguments: Column, schemas=SCHEMAS) -> Column:
    """array<string> of ``kind:field``, empty when the arguments fit their tool's schema."""
    parsed = F.try_parse_json(F.coalesce(arguments, F.lit("{}")))
    whole = F.schema_of_variant(parsed)
    known = F.json_object_keys(arguments)
    out = F.array(F.concat(F.lit("unknown_tool:"), F.coalesce(name, F.lit(""))))
    for tool, fields in schemas.items():
        checks = []
        for field, (kind, required) in sorted(fields.items()):
            value = F.try_variant_get(parsed, f"$['{field}']", "variant")
            kind_of = F.schema_of_variant(value)
            if required:
                checks.append(F.when(value.isNull() | F.is_variant_null(value), f"missing:{field}"))
            checks.append(F.when(value.isNotNull() & ~F.is_variant_null(value) & ~kind_of.rlike(_ACCEPTS[kind]), f"type:{field}"))
        extra = F.transform(
            F.array_sort(F.array_except(F.coalesce(known, F.array().cast("array<string>")), F.array(*(F.lit(f) for f in sorted(fields))).cast("array<string>"))),
            lambda k: F.concat(F.lit("extra:"), k),
        )
        out = F.when(name == tool, F.concat(F.array_compact(F.array(*checks)).cast("array<string>"), extra)).otherwise(out)
    return F.when(parsed.isNull() | ~whole.startswith("OBJECT"), F.array(F.lit("malformed:"))).otherwise(out)


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): the longest chain of calls that must come before.

    Calls that wait for one other are followed by doubling, so a chain takes rounds by the logarithm
    of its length; calls that wait for several are then placed round by round, as many as stand one
    behind the other.  What is not placed lies on or behind a cycle and is left out.  Names of calls
    that do not exist are ignored.
    """
    key = lambda name: F.struct("conv_id", F.col(name).alias("call_id"))
    nodes = calls.select(key("call_id").alias("id")).distinct()
    needs = calls.select(key("call_id").alias("id"), "conv_id", F.explode("depends").alias("need")).select("id", key("need").alias("need")).distinct()
    needs = materialise(needs.join(nodes.select(F.col("id").alias("need")), "need", "left_semi").select("id", "need"), "needs")
    waits = materialise(needs.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("need").alias("need")), "waits")
    single = waits.where("n = 1").select(F.col("id").alias("from_id"), F.col("need").alias("to_id"))
    ends = chain_ends(single, single.select(F.col("from_id").alias("id"))).select("from_id", "at", "hops", "open")
    placed = materialise(nodes.join(waits, "id", "left_anti").select("id", F.lit(0).cast("long").alias("level")), "levels")
    edges = needs.join(waits.where("n > 1").select("id"), "id", "left_semi").join(ends, F.col("need") == F.col("from_id"), "left")
    edges = materialise(edges.select("id", F.when(~F.coalesce("open", F.lit(False)), F.coalesce("at", "need")).alias("on"), (F.coalesce("hops", F.lit(0)) + 1).alias("steps")), "edges")
    waiting = edges.select("id").distinct().count()
    while waiting:
        met = edges.join(placed.select(F.col("id").alias("on"), "level"), "on", "left")
        ready = met.groupBy("id").agg(F.count_if(F.col("level").isNull()).alias("open"), F.max(F.col("level") + F.col("steps")).alias("level")).where("open = 0").drop("open")
        after = materialise(placed.join(ready, "id", "left_anti").unionByName(ready), "levels")
        left = edges.select("id").distinct().join(after, "id", "left_anti").count()
        discard(placed)
        placed, before, waiting = after, waiting, left
        if left == before:
            break
    behind = ends.where("not open").join(placed, F.col("at") == F.col("id")).select(F.col("from_id").alias("id"), (F.col("level") + F.col("hops")).alias("level"))
    return placed.unionByName(behind).select("id.conv_id", "id.call_id", F.col("level").cast("int").alias("level"))


def _first_and_others(rows: DataFrame, fields: list[str], one: str, n: str) -> tuple[DataFrame, DataFrame]:
    """Of the rows under one identifier the first, as struct ``one``, and those that differ from it in more than seq.

    Identifiers with several kinds of rows are found by hashes alone; the others go one way.
    """
    key = ["conv_id", "call_id"]
    first = lambda df: df.groupBy(*key).agg(F.min(F.struct(*fields)).alias(one), F.count(F.lit(1)).alias(n))
    kind = F.xxhash64(*(c for f in fields[1:] for c in (F.col(f), F.col(f).isNull())))
    several = rows.groupBy(*key).agg(F.min(kind).alias("low"), F.max(kind).alias("high")).where("low <> high").select(*key)
    mixed = materialise(rows.join(materialise(several, "several"), key), "mixed")
    kinds = mixed.groupBy(*key, *fields[1:]).agg(F.min("seq").alias("seq"))
    others = kinds.join(first(mixed).withColumnRenamed(one, "_first"), key).where(~F.struct(*fields).eqNullSafe(F.col("_first")))
    return first(rows), others.select(*key, F.struct(*fields).alias(one), n, F.lit(True).alias("again"))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas=SCHEMAS) -> DataFrame:
    """One row a call, and one a result without call: conv_id, call_id, seq, name,
    level, n_calls, n_results, status, errors, json.

    status: the first that holds of duplicate_id, orphan_result, malformed_arguments, unknown_tool,
    invalid_arguments, cyclic, missing_result, ok.
    """
    keyed = "conv_id is not null and call_id is not null"
    one, more = _first_and_others(calls.where(keyed), ["seq", "name", "arguments"], "call", "n_calls")
    answer, unused = _first_and_others(results.where(keyed), ["seq", "content"], "result", "n_results")
    placed = levels(calls.where(keyed))
    linked = one.join(placed, ["conv_id", "call_id"], "left").join(answer, ["conv_id", "call_id"], "full")
    unkeyed = calls.where("conv_id is null or call_id is null").select(
        "conv_id",
        "call_id",
        F.struct("seq", "name", "arguments").alias("call"),
        F.lit(1).cast("long").alias("n_calls"),
        F.lit(0).alias("level"),
    )
    lost = results.where("conv_id is null or call_id is null").select(
        "conv_id", "call_id", F.struct("seq", "content").alias("result"), F.lit(1).cast("long").alias("n_results")
    )
    rows = linked.withColumn("again", F.lit(False))
    for part in (more, unused, unkeyed, lost):
        rows = rows.unionByName(part, allowMissingColumns=True)
    errors = F.when(F.col("call").isNull(), F.expr(_NO_ERRORS)).otherwise(argument_errors(F.col("call.name"), F.col("call.arguments"), schemas))
    rows = rows.withColumn("errors", errors)
    status = (
        F.when(F.col("again"), "duplicate_id")
        .when(F.col("call").isNull(), "orphan_result")
        .when(F.exists("errors", lambda e: e.startswith("malformed:")), "malformed_arguments")
        .when(F.exists("errors", lambda e: e.startswith("unknown_tool:")), "unknown_tool")
        .when(F.size("errors") > 0, "invalid_arguments")
        .when(F.col("level").isNull(), "cyclic")
        .when(F.col("result").isNull(), "missing_result")
        .otherwise("ok")
    )
    # malformed arguments stay in the record as the string they were
    parsed = F.try_parse_json(F.coalesce("call.arguments", F.lit("{}")))
    quoted = F.to_json(F.struct(F.col("call.arguments").alias("v")))
    arguments = F.when(parsed.isNotNull(), F.to_json(parsed)).otherwise(F.expr("substring(q, 6, length(q) - 6)"))
    rows = rows.withColumn("q", quoted).withColumn("arg_json", arguments)
    text = lambda c: F.expr(f"regexp_extract(to_json(struct(coalesce({c}, '') as v)), '(?s)^.{{5}}(.*).$', 1)")
    body = F.concat(
        F.lit('{"arguments":'), F.when(F.col("call").isNull(), F.lit("null")).otherwise(F.col("arg_json")),
        F.lit(',"id":'), text("cast(call_id as string)"),
        F.lit(',"name":'), F.when(F.col("call.name").isNull(), F.lit("null")).otherwise(text("call.name")),
        F.lit(',"result":'), F.when(F.col("result.content").isNull(), F.lit("null")).otherwise(text("result.content")),
        F.lit("}"),
    )
    return rows.select(
        "conv_id",
        "call_id",
        F.coalesce("call.seq", "result.seq").alias("seq"),
        F.col("call.name").alias("name"),
        "level",
        F.coalesce("n_calls", F.lit(0)).alias("n_calls"),
        F.coalesce("n_results", F.lit(0)).alias("n_results"),
        status.alias("status"),
        "errors",
        body.alias("json"),
    )


def calls_and_results(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The calls and results in a table of turns (conv_id, turn, role, text).

    A text that is a JSON object with ``tool_calls`` holds calls {id, name, arguments, depends}, or
    {id, function: {name, arguments}}; arguments may be an object or its text.  One with
    ``tool_call_id`` is a result.  ``content`` beside ``tool_calls`` is a plain turn besides, and so is
    an empty list of calls.  Of plain turns, one whose role is not ``assistant`` calls the tool
    ``reply`` under the identifier of its turn, with its role as an argument unless that is ``user``,
    and waits for the call in the turn before it, else in the one before that; an assistant's turn is
    the result of the turn before it.
    """
    turns = conversations.select("conv_id", "turn", "role", "text").withColumn("body", F.try_parse_json("text"))
    listed = F.expr("try_variant_get(body, '$.tool_calls', 'array<struct<id:string,name:string,arguments:variant,depends:array<string>,function:struct<name:string,arguments:variant>>>')")
    named = F.expr("try_variant_get(body, '$.tool_call_id', 'string')")
    content = F.expr("try_variant_get(body, '$.content', 'variant')")
    content = F.when(F.is_variant_null(content), None).when(F.schema_of_variant(content) == "STRING", F.expr("try_variant_get(body, '$.content', 'string')")).otherwise(F.to_json(content))
    turns = turns.withColumns({"listed": listed, "named": named}).withColumn("content", content)
    json = F.col("listed").isNotNull()
    plain = turns.where(F.col("named").isNull() & (~json | F.col("content").isNotNull() | (F.size("listed") == 0)))
    plain = plain.select("conv_id", "turn", "role", F.when(json, F.col("content")).otherwise(F.col("text")).alias("text"))
    name = lambda back: F.concat(F.lit("turn-"), (F.col("turn") - back).cast("string"))
    asked = plain.where("role is null or role <> 'assistant'")
    before = asked.select("conv_id", (F.col("turn") + 1).alias("turn")).distinct().withColumn("follows", F.lit(True))
    asked = asked.join(before, ["conv_id", "turn"], "left")
    own = asked.select(
        "conv_id",
        name(0).alias("call_id"),
        F.col("turn").alias("seq"),
        F.lit("reply").alias("name"),
        F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("prompt"), F.when(F.col("role") != "user", F.col("role")).alias("role"), "turn")).alias("arguments"),
        F.array(F.when(F.col("follows"), name(1)).otherwise(name(2))).alias("depends"),
    )
    text = F.when(F.schema_of_variant("arguments") == "STRING", F.expr("try_variant_get(arguments, '$', 'string')")).otherwise(F.to_json("arguments"))
    stated = turns.select("conv_id", "turn", F.explode("listed").alias("c")).select(
        "conv_id",
        F.col("c.id").alias("call_id"),
        F.col("turn").alias("seq"),
        F.coalesce("c.name", "c.function.name").alias("name"),
        F.coalesce("c.arguments", "c.function.arguments").alias("arguments"),
        F.coalesce("c.depends", F.expr(_NO_ERRORS)).alias("depends"),
    ).withColumn("arguments", text)
    replies = plain.where("role = 'assistant'").select("conv_id", name(1).alias("call_id"), F.col("turn").alias("seq"), F.col("text").alias("content"))
    returned = turns.where("named is not null").select(
        "conv_id", F.col("named").alias("call_id"), F.col("turn").alias("seq"), F.expr("to_json(try_variant_get(body, '$.content', 'variant'))").alias("content")
    )
    return own.unionByName(stated), replies.unionByName(returned)


def op6_tool_calls(spark, sf_dir: str) -> DataFrame:
    """All turns of ``conversations`` as linked calls, one row a call or orphan result."""
    calls, results = calls_and_results(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    # several steps read both; the turns are parsed once
    out = link_tool_calls(materialise(calls, "calls"), materialise(results, "results"))
    return out.select("conv_id", "call_id", "seq", "name", "level", "n_calls", "n_results", "status", F.array_join("errors", ",").alias("errors"), "json")


ORACLE = r"""
WITH RECURSIVE cv AS (
  SELECT conv_id, turn, CASE WHEN role <> 'user' THEN role END AS extra,
    '{"prompt":' || to_json(coalesce(text, '')) || CASE WHEN role <> 'user' THEN ',"role":' || to_json(role) ELSE '' END || ',"turn":' || turn || '}' AS arguments, count(*) AS n
  FROM conversations WHERE (role IS NULL OR role <> 'assistant') AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL
), c AS (
  SELECT *, sum(n) OVER (PARTITION BY conv_id, turn) AS n_calls, row_number() OVER (PARTITION BY conv_id, turn ORDER BY arguments) AS place FROM cv
), rv AS (
  SELECT conv_id, turn - 1 AS turn, text AS content, count(*) AS n FROM conversations WHERE role = 'assistant' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL
), r AS (
  SELECT *, sum(n) OVER (PARTITION BY conv_id, turn) AS n_results, row_number() OVER (PARTITION BY conv_id, turn ORDER BY content NULLS FIRST) AS place FROM rv
), node AS (SELECT conv_id, turn FROM c WHERE place = 1
), need AS (
  SELECT x.conv_id, x.turn, CASE WHEN a.turn IS NOT NULL THEN a.turn ELSE b.turn END AS need FROM node x
  LEFT JOIN node a ON a.conv_id = x.conv_id AND a.turn = x.turn - 1 LEFT JOIN node b ON b.conv_id = x.conv_id AND b.turn = x.turn - 2
), lv AS (
  SELECT conv_id, turn, 0 AS level FROM need WHERE need IS NULL UNION ALL SELECT need.conv_id, need.turn, level + 1 FROM need JOIN lv ON lv.conv_id = need.conv_id AND lv.turn = need.need
), m AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.turn, r.turn) AS turn, c.arguments, c.extra, c.n_calls, r.content, r.n_results, r.turn IS NOT NULL AS answered, FALSE AS again
  FROM (SELECT * FROM c WHERE place = 1) c FULL JOIN (SELECT * FROM r WHERE place = 1) r ON c.conv_id = r.conv_id AND c.turn = r.turn
  UNION ALL SELECT conv_id, turn, arguments, extra, n_calls, NULL, 0, FALSE, TRUE FROM c WHERE place > 1
  UNION ALL SELECT conv_id, turn, NULL, NULL, 0, content, n_results, TRUE, TRUE FROM r WHERE place > 1
)
SELECT m.conv_id, 'turn-' || m.turn AS call_id, CASE WHEN arguments IS NULL THEN m.turn + 1 ELSE m.turn END AS seq, CASE WHEN arguments IS NOT NULL THEN 'reply' END AS name,
  CASE WHEN arguments IS NOT NULL AND NOT again THEN CAST(level AS INTEGER) END AS level, CAST(coalesce(n_calls, 0) AS BIGINT) AS n_calls, CAST(coalesce(n_results, 0) AS BIGINT) AS n_results,
  CASE WHEN again THEN 'duplicate_id' WHEN arguments IS NULL THEN 'orphan_result' WHEN extra IS NOT NULL THEN 'invalid_arguments' WHEN NOT answered THEN 'missing_result' ELSE 'ok' END AS status,
  CASE WHEN extra IS NOT NULL THEN 'extra:role' ELSE '' END AS errors,
  '{"arguments":' || coalesce(arguments, 'null') || ',"id":' || to_json('turn-' || m.turn) || ',"name":' || CASE WHEN arguments IS NULL THEN 'null' ELSE '"reply"' END ||
  ',"result":' || CASE WHEN content IS NULL THEN 'null' ELSE to_json(content) END || '}' AS json
FROM m LEFT JOIN lv ON lv.conv_id = m.conv_id AND lv.turn = m.turn
"""
