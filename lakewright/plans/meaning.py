"""Queries on code lists, registries, crosswalks and merges of three editions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakewright.functions import text as T
from lakewright.operators import diff as D
from lakewright.operators import semantics as S
from lakewright.plans.binding import query
from lakewright.plans.diffs import attr_changes
from lakewright.sources import editions as E

# a small registry of our own: key, edition, path, is_alias
REGISTRY = [
    ("height", "2.0", "/measuredHeight", False), ("height", "3.0", "/measuredHeight", False), ("height", "3.0", "/height", True),
    ("usage", "2.0", "/usage", False), ("usage", "3.0", "/function", False),
    ("quality", "2.0", "/srcDesc", False), ("quality_lod0", "3.0", "/srcDescLod0", False), ("quality_lod1", "3.0", "/srcDescLod1", False),
    ("survey", "3.0", "/surveyYear", False), ("legacy", "2.0", "/legacyName", False),
]
_REG = "reg(key, edition, path, is_alias) AS (VALUES " + ", ".join(f"('{k}', '{e}', '{p}', {str(a).lower()})" for k, e, p, a in REGISTRY) + ")"

OLD_CODES = [
    ("usage", "1", "office"), ("usage", "2", "shop"), ("usage", "3", "house (all kinds)"), ("usage", "9", "public hall"), ("usage", "7", "barn"), ("usage", "8", "unknown"),
    ("src", "000", "survey"), ("src", "001", "drawing"), ("tier", "1", "不明"), ("tier", "2", "一律値"), ("tier", "3", "写真測量"), ("tier", "4", "衛星写真"),
    ("flag", "A", "yes"), ("flag", "N", "not known"), ("flag", "R", "Unknown state"),
]
NEW_CODES = [
    ("usage", "1", "office"), ("usage", "2", "shop, retail"), ("usage", "801", "public hall"), ("usage", "31", "house (all kinds): single"), ("usage", "32", "house (all kinds): row"), ("usage", "8", "not stated"),
    ("usage", "50", "tower"), ("src", "000", "surveyed"), ("src", "001", "drawings"), ("tier", "1", "不明"), ("tier", "2", "一律"), ("tier", "3", "測量"), ("tier", "4", "写真"),
]
_codes = lambda name, rows: f"{name}(list, code, label) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in rows) + ")"
_OLD, _NEW = _codes("oc", OLD_CODES), _codes("nc", NEW_CODES)


def _frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def old_codes(spark):
    return _frame(spark, OLD_CODES, "list string, code string, label string")


@query(
    f"""WITH {_REG}, a AS (SELECT key, path AS old_path FROM reg WHERE edition = '2.0' AND NOT is_alias), b AS (SELECT key, path AS new_path FROM reg WHERE edition = '3.0' AND NOT is_alias)
SELECT key, CASE WHEN old_path IS NULL THEN 'added' WHEN new_path IS NULL THEN 'removed' WHEN old_path = new_path THEN 'same' ELSE 'renamed' END AS relation, old_path, new_path FROM a FULL JOIN b USING (key)"""
)
def registry_crosswalk(spark, d):
    reg = _frame(spark, REGISTRY, "key string, edition string, path string, is_alias boolean").where("not is_alias")
    return S.registry_crosswalk(reg, "2.0", "3.0")


@query(
    f"""WITH {_REG}, a AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN '/measuredHeight' WHEN 1 THEN '/height' WHEN 2 THEN '/function' ELSE '/other' END AS path FROM part)
SELECT a.id, a.path, (SELECT arg_max(key, (is_alias, key)) FROM reg WHERE edition = '3.0' AND reg.path = a.path) AS key FROM a"""
)
def registry_key_lookup(spark, d):
    reg = _frame(spark, REGISTRY, "key string, edition string, path string, is_alias boolean")
    k = F.col("p_partkey") % 4
    path = F.when(k == 0, "/measuredHeight").when(k == 1, "/height").when(k == 2, "/function").otherwise("/other")
    return S.key_for(E.table(spark, d, "part").select(F.col("p_partkey").alias("id"), path.alias("path")), reg, "3.0").select("id", "path", "key")


_NORM = r"regexp_replace({0}, '[\s（）()・、,，。]+', '', 'g')"
_CROSS = f"""o AS (SELECT list, code, label, {_NORM.format('label')} AS n FROM oc), w AS (SELECT list, code, label, {_NORM.format('label')} AS n FROM nc),
ss AS (SELECT a.list, a.s = b.s AS same FROM (SELECT list, string_agg(code, ',' ORDER BY code) AS s FROM oc GROUP BY list) a JOIN (SELECT list, string_agg(code, ',' ORDER BY code) AS s FROM nc GROUP BY list) b USING (list)),
k AS (SELECT o.*, coalesce(ss.same, false) AS same, t.code IS NOT NULL AS twin, coalesce(t.label = o.label OR (o.n <> '' AND (contains(t.n, o.n) OR contains(o.n, t.n))), false) AS close,
  (SELECT list_sort(list(code)) FROM w WHERE w.list = o.list AND w.label = o.label) AS eq, (SELECT list_sort(list(code)) FROM w WHERE w.list = o.list AND o.n <> '' AND contains(w.n, o.n)) AS held
  FROM o LEFT JOIN ss USING (list) LEFT JOIN w t ON t.list = o.list AND t.code = o.code),
c AS (SELECT *, list_sort(list_distinct(list_concat(CASE WHEN len(eq) > 0 THEN eq ELSE coalesce(held, []) END, CASE WHEN twin THEN [code] ELSE [] END))) AS cand FROM k),
x AS (SELECT list, code, CASE WHEN same OR close OR coalesce(len(eq), 0) = 1 THEN 'exact' WHEN len(cand) > 0 THEN 'refined' ELSE 'dropped' END AS relation,
  CASE WHEN same OR close THEN [code] WHEN coalesce(len(eq), 0) = 1 THEN eq ELSE cand END AS dest FROM c),
z AS (SELECT list, code, relation, dest FROM x UNION ALL SELECT list, code, 'added', [code] FROM nc WHERE (list, code) NOT IN (SELECT list, unnest(dest) FROM x))"""


@query(f"WITH {_OLD}, {_NEW}, {_CROSS} SELECT list, code, relation, array_to_string(dest, ',') AS dest FROM z")
def codelist_crosswalk(spark, d):
    new = _frame(spark, NEW_CODES, "list string, code string, label string")
    return S.codelist_crosswalk(old_codes(spark), new).select("list", "code", "relation", F.array_join("to", ",").alias("dest"))


@query(
    f"""WITH {_OLD}, {_NEW}, {_CROSS} SELECT list, count(*) FILTER (relation = 'exact') AS exact, count(*) FILTER (relation = 'refined') AS refined, count(*) FILTER (relation = 'dropped') AS dropped,
  count(*) FILTER (relation = 'added') AS added FROM z GROUP BY list"""
)
def crosswalk_summary(spark, d):
    r = F.col("relation")
    return codelist_crosswalk(spark, d).groupBy("list").agg(*(F.count_if(r == n).alias(n) for n in ("exact", "refined", "dropped", "added")))


@query(
    f"""WITH {_OLD}, {_NEW}, {_CROSS} SELECT list, code, CASE WHEN list = 'usage' AND code = '3' THEN '31' ELSE dest[1] END AS target FROM z WHERE relation = 'exact' OR (list = 'usage' AND code = '3')"""
)
def crosswalk_resolve(spark, d):
    """The one new code of each old one; a reviewed rule settles a refined code."""
    new = _frame(spark, NEW_CODES, "list string, code string, label string")
    reviewed = _frame(spark, [("usage", "3", ["31"])], "list string, code string, to array<string>")
    return S.resolve(S.codelist_crosswalk(old_codes(spark), new), reviewed)


_KEYED = lambda e: f"SELECT id, 'status' AS key, status AS value FROM {e} UNION ALL SELECT id, 'total', CAST(total AS VARCHAR) FROM {e} UNION ALL SELECT id, 'priority', priority FROM {e} UNION ALL SELECT id, 'cust', CAST(cust AS VARCHAR) FROM {e}"
_MAP = [("status", "X", "XX"), ("status", "O", "O"), ("status", "F", "F")]
_THREE = f"""v1 AS ({_KEYED('e1')}), v2 AS ({_KEYED('e2')}), v3 AS ({_KEYED('e3')}), ids AS (SELECT id FROM e1 JOIN e2 USING (id) JOIN e3 USING (id)),
mp(code, dest) AS (VALUES ('X', 'XX'), ('O', 'O'), ('F', 'F')),
t AS (SELECT a.id, a.key, CASE a.key WHEN 'priority' THEN 'urgency' WHEN 'cust' THEN NULL ELSE a.key END AS target, a.value AS old, b.value AS cur, c.value AS official, a.key = 'status' AS coded,
  CASE WHEN a.key = 'status' THEN (SELECT dest FROM mp WHERE code = b.value) ELSE b.value END AS cur_to, CASE WHEN a.key = 'status' THEN (SELECT dest FROM mp WHERE code = a.value) ELSE a.value END AS old_to
  FROM v1 a JOIN v2 b USING (id, key) JOIN ids USING (id) LEFT JOIN v3 c ON c.id = a.id AND c.key = CASE a.key WHEN 'priority' THEN 'urgency' WHEN 'cust' THEN NULL ELSE a.key END)"""


@query(
    f"""WITH {E.SQL}, {_THREE} SELECT id, key, target, old, cur, official, CASE WHEN old = cur THEN 'unchanged_locally' WHEN target IS NULL THEN 'unmappable' WHEN official IS NULL AND target <> key THEN 'split_absent'
  WHEN official IS NULL THEN 'insert_needed' WHEN coded AND cur_to IS NULL AND (old_to IS NULL OR old_to = official) THEN 'carried' WHEN coded AND cur_to IS NULL THEN 'conflict'
  WHEN official = cur_to THEN 'absorbed' WHEN official = coalesce(old_to, old) THEN 'reapply' ELSE 'conflict' END AS outcome FROM t"""
)
def three_way_merge(spark, d):
    e = [E.edition(spark, d, n) for n in (1, 2, 3)]
    v = [D.unpivot(x, "id", E.ATTRIBUTES).withColumnRenamed("path", "key") for x in e]
    ids = e[0].select("id").join(e[1].select("id"), "id").join(e[2].select("id"), "id")
    successors = _frame(spark, [("priority", "urgency"), ("cust", None)], "key string, target string")
    mapping = _frame(spark, _MAP, "key string, code string, target_code string")
    return S.three_way(*v, successors=F.broadcast(successors), mapping=F.broadcast(mapping), ids=ids)


@query(
    f"""WITH {E.SQL}, u1 AS ({_KEYED('e1')}), u2 AS ({_KEYED('e2')}), ad AS (SELECT coalesce(a.id, b.id) AS id, coalesce(a.key, b.key) AS path, a.value AS old, b.value AS new
  FROM u1 a FULL JOIN u2 b ON a.id = b.id AND a.key = b.key WHERE a.value IS DISTINCT FROM b.value)
SELECT id, path, old, new, CASE WHEN path <> 'status' THEN 'other_family' WHEN old IS NULL THEN 'added_leaf' WHEN new IS NULL THEN 'removed_leaf' ELSE 'apply' END AS decision FROM ad"""
)
def source_update_plan(spark, d):
    return S.source_update(attr_changes(spark, d), F.col("path") == "status")


_VALUES = """vals AS (SELECT l_orderkey AS id, 'flag' AS list, 'returnFlag' AS name, l_returnflag AS code FROM lineitem UNION ALL SELECT p_partkey, 'usage', 'usage', CAST(p_size % 11 AS VARCHAR) FROM part
  UNION ALL SELECT p_partkey, 'absent', 'brand', p_brand FROM part)"""


def _values(spark, d):
    one = E.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.lit("flag").alias("list"), F.lit("returnFlag").alias("name"), F.col("l_returnflag").alias("code"))
    p = E.table(spark, d, "part")
    two = p.select(F.col("p_partkey").alias("id"), F.lit("usage").alias("list"), F.lit("usage").alias("name"), (F.col("p_size") % 11).cast("string").alias("code"))
    three = p.select(F.col("p_partkey").alias("id"), F.lit("absent").alias("list"), F.lit("brand").alias("name"), F.col("p_brand").alias("code"))
    return one.unionByName(two).unionByName(three)


@query(f"WITH {_OLD}, {_VALUES} SELECT DISTINCT name, list, code FROM vals WHERE list IN (SELECT list FROM oc) AND (list, code) NOT IN (SELECT list, code FROM oc)")
def invalid_code(spark, d):
    return S.invalid_codes(_values(spark, d), old_codes(spark))


@query("SELECT l_orderkey AS id, l_linenumber AS line, l_partkey AS ref FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 37 <> 0)")
def dangling_refs(spark, d):
    refs = E.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("ref"))
    return S.dangling(refs, E.table(spark, d, "part").where("p_partkey % 37 <> 0").select(F.col("p_partkey").alias("ref")), "ref").select("id", "line", "ref")


@query("SELECT p_partkey AS ref, p_name AS name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_linenumber = 2)")
def orphan_refs(spark, d):
    used = E.table(spark, d, "lineitem").where("l_linenumber = 2").select(F.col("l_partkey").alias("ref"))
    return S.dangling(E.table(spark, d, "part").select(F.col("p_partkey").alias("ref"), F.col("p_name").alias("name")), used, "ref")


@query(
    f"""WITH {E.SQL}, ch AS (SELECT a.id, 'status' AS path, a.key FROM e1 a JOIN e2 b USING (id) WHERE a.status <> b.status),
s AS (SELECT id, path, CAST(key % 3 AS VARCHAR) AS code FROM ch WHERE key % 4 <> 0 UNION ALL SELECT id, path, '1' FROM ch WHERE key % 6 = 0), c(code, usable) AS (VALUES ('0', true), ('1', true), ('2', false)),
p AS (SELECT id, path, count(*) AS n, bool_and(coalesce(usable, false)) AS u FROM s LEFT JOIN c USING (code) GROUP BY 1, 2)
SELECT ch.id, ch.path, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'duplicate' ELSE 'invalid' END AS problem FROM ch LEFT JOIN p USING (id, path) WHERE n IS NULL OR n > 1 OR NOT u"""
)
def source_coverage(spark, d):
    a, b = E.edition(spark, d, 1), E.edition(spark, d, 2).select("id", F.col("status").alias("now"))
    ch = a.join(b, "id").where("status <> now").select("id", F.lit("status").alias("path"), "key")
    k = F.col("key")
    s = ch.where(k % 4 != 0).select("id", "path", (k % 3).cast("string").alias("code")).unionByName(ch.where(k % 6 == 0).select("id", "path", F.lit("1").alias("code")))
    return S.source_coverage(ch, s, _frame(spark, [("0", True), ("1", True), ("2", False)], "code string, usable boolean"))


_FLAT = """f AS (SELECT p_partkey AS id, 'quality#' || (p_partkey % 2) || '/src' AS name, CAST(p_size AS VARCHAR) AS value FROM part UNION ALL
  SELECT p_partkey, 'quality#' || (p_partkey % 2) || '/src@codeSpace', 'list' || (p_size % 3) FROM part UNION ALL SELECT p_partkey, 'detail#0/height', CAST(p_size + 1 AS VARCHAR) FROM part UNION ALL
  SELECT p_partkey, 'detail#0/height@uom', 'm' FROM part WHERE p_partkey % 2 = 0)"""


@query(
    f"""WITH {_FLAT}, p AS (SELECT id, regexp_extract(name, '^([^#/]+)', 1) AS wrapper, CAST(regexp_extract(name, '#([0-9]+)', 1) AS INTEGER) AS occurrence, regexp_extract(name, '([^/@]+)(@[A-Za-z]+)?$', 1) AS leaf,
  regexp_extract(name, '@([A-Za-z]+)$', 1) AS kind, value FROM f)
SELECT id, wrapper, occurrence, leaf, max(value) FILTER (kind = '') AS value, max(value) FILTER (kind = 'codeSpace') AS code_space, max(value) FILTER (kind = 'uom') AS uom FROM p GROUP BY 1, 2, 3, 4"""
)
def generic_to_typed(spark, d):
    p = E.table(spark, d, "part")
    k, s = F.col("p_partkey"), F.col("p_size")
    q = F.concat(F.lit("quality#"), (k % 2).cast("string"), F.lit("/src"))
    row = lambda df, n, v: df.select(k.alias("id"), n.alias("name"), v.alias("value"))
    flat = (
        row(p, q, s.cast("string")).unionByName(row(p, F.concat(q, F.lit("@codeSpace")), F.concat(F.lit("list"), (s % 3).cast("string"))))
        .unionByName(row(p, F.lit("detail#0/height"), (s + 1).cast("string"))).unionByName(row(p.where(k % 2 == 0), F.lit("detail#0/height@uom"), F.lit("m")))
    )
    return S.nested_names(flat)


@query(f"WITH {_FLAT} SELECT id, name, value FROM f")
def typed_to_generic(spark, d):
    """Typed attributes taken back to the flat names they were read from."""
    return S.flat_names(generic_to_typed(spark, d))


_RENAMED = [("year", "uro:yearOfConstruction", True), ("use", "uro:usage", False)]


@query(
    """WITH f AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'year' WHEN p_partkey % 3 = 1 THEN 'use' ELSE 'old' END AS name, CASE WHEN p_partkey % 3 = 0 THEN CAST(1950 + p_size AS VARCHAR) ELSE p_type END AS value FROM part),
m(name, tag, is_year) AS (VALUES ('year', 'uro:yearOfConstruction', true), ('use', 'uro:usage', false))
SELECT id, coalesce(tag, 'gen:legacy/' || name) AS tag, CASE WHEN is_year THEN value || '-01-01' ELSE value END AS value, tag IS NULL AS legacy FROM f LEFT JOIN m USING (name)"""
)
def ade_rekey(spark, d):
    """Attribute rows under new tags; years become dates, names without a successor are kept as legacy."""
    k = F.col("p_partkey") % 3
    name = F.when(k == 0, "year").when(k == 1, "use").otherwise("old")
    value = F.when(k == 0, (F.lit(1950) + F.col("p_size")).cast("string")).otherwise(F.col("p_type"))
    m = F.broadcast(_frame(spark, _RENAMED, "name string, tag string, is_year boolean"))
    rows = E.table(spark, d, "part").select(F.col("p_partkey").alias("id"), name.alias("name"), value.alias("value")).join(m, "name", "left")
    return rows.select(
        "id", F.coalesce("tag", F.concat(F.lit("gen:legacy/"), "name")).alias("tag"), F.when(F.col("is_year"), F.concat("value", F.lit("-01-01"))).otherwise(F.col("value")).alias("value"), F.col("tag").isNull().alias("legacy")
    )


@query("SELECT CASE WHEN p_partkey % 3 = 0 THEN 'year_to_date' WHEN p_partkey % 3 = 1 THEN 'retag' ELSE 'legacy' END AS rule, count(*) AS n FROM part GROUP BY 1")
def rule_counters(spark, d):
    t = F.when(F.col("legacy"), "legacy").when(F.col("tag") == "uro:usage", "retag").otherwise("year_to_date")
    return ade_rekey(spark, d).groupBy(t.alias("rule")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT p_partkey AS id, CASE WHEN p_size % 4 = 0 THEN NULL ELSE (1950 + p_size) || '-01-01' || CASE WHEN p_size % 4 = 1 THEN '+09:00' ELSE '' END END AS day FROM part""")
def year_to_date(spark, d):
    s = F.col("p_size")
    raw = F.when(s % 4 == 0, "n/a").otherwise(F.concat((F.lit(1950) + s).cast("string"), F.when(s % 4 == 1, "+09:00").otherwise("")))
    pattern = r"^([0-9]{4})((?:Z|[+-][0-9]{2}:[0-9]{2})?)$"
    day = F.when(raw.rlike(pattern), F.concat(F.regexp_extract(raw, pattern, 1), F.lit("-01-01"), F.regexp_extract(raw, pattern, 2)))
    return E.table(spark, d, "part").select(F.col("p_partkey").alias("id"), day.alias("day"))


@query(f"WITH {_OLD} SELECT list, string_agg(code, ',' ORDER BY code) AS codes, count(*) AS n FROM oc WHERE contains(label, '不明') OR contains(label, '不詳') OR contains(lower(label), 'unknown') GROUP BY list")
def unknown_codes(spark, d):
    from lakewright.operators.stats import unknown_codes as unknown

    return unknown(old_codes(spark))


@query(f"WITH {_OLD} SELECT list, code, label, contains(label, '不明') OR contains(label, '不詳') OR contains(lower(label), 'unknown') AS unknown FROM oc")
def unknown_label(spark, d):
    return old_codes(spark).withColumn("unknown", T.is_unknown_label(F.col("label")))


_TIER = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(label, {chr(39)}{w}{chr(39)})' for w in words)} THEN '{tier}'" for tier, words in T.TIER_WORDS) + " ELSE 'other' END"


@query(f"WITH {_OLD} SELECT list, code, {_TIER} AS tier FROM oc")
def quality_tier(spark, d):
    return old_codes(spark).select("list", "code", T.quality_tier(F.col("label")).alias("tier"))


@query(f"SELECT p_partkey AS id, p_name || CASE p_partkey % 3 WHEN 0 THEN '_Scale' WHEN 1 THEN '_SRCDESC' ELSE '' END AS name, regexp_matches(p_name || CASE p_partkey % 3 WHEN 0 THEN '_Scale' WHEN 1 THEN '_SRCDESC' ELSE '' END, '(?i){T.QUALITY_AXIS}') AS axis FROM part")
def quality_axis(spark, d):
    k = F.col("p_partkey") % 3
    name = F.concat("p_name", F.when(k == 0, "_Scale").when(k == 1, "_SRCDESC").otherwise(""))
    return E.table(spark, d, "part").select(F.col("p_partkey").alias("id"), name.alias("name"), T.is_quality_axis(name).alias("axis"))


@query(f"WITH {_OLD}, {_VALUES} SELECT name, code, coalesce(label, code) AS label, count(*) AS n FROM vals LEFT JOIN oc USING (list, code) GROUP BY 1, 2, 3")
def code_label(spark, d):
    rows = _values(spark, d).join(F.broadcast(old_codes(spark)), ["list", "code"], "left")
    return rows.groupBy("name", "code", F.coalesce("label", "code").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {_OLD}, {_VALUES} SELECT list, count(*) AS total, count(*) FILTER (u) AS unknown, round(count(*) FILTER (u) / count(*), 4) AS unknown_rate
FROM (SELECT vals.list, coalesce(contains(label, '不明') OR contains(label, '不詳') OR contains(lower(label), 'unknown'), false) AS u FROM vals LEFT JOIN oc USING (list, code)) GROUP BY list"""
)
def coded_unknown_rate(spark, d):
    from lakewright.operators.stats import coded_unknown_rate as rate

    return rate(_values(spark, d), old_codes(spark))


_ELEM = """el AS (SELECT CASE WHEN p_partkey % 5 = 0 THEN 'geometrySrcDescLod' || (p_partkey % 3) ELSE 'thematicSrcDesc' END AS element, CASE WHEN p_partkey % 7 = 0 THEN 'usage' ELSE 'tier' END AS list, CAST(1 + p_size % 5 AS VARCHAR) AS code FROM part)"""


def _elements(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    e = F.when(k % 5 == 0, F.concat(F.lit("geometrySrcDescLod"), (k % 3).cast("string"))).otherwise("thematicSrcDesc")
    return E.table(spark, d, "part").select(e.alias("element"), F.when(k % 7 == 0, "usage").otherwise("tier").alias("list"), (F.lit(1) + s % 5).cast("string").alias("code"))


@query(
    f"""WITH {_OLD}, {_ELEM}, c AS (SELECT element, min(list) OVER (PARTITION BY element) AS list, code FROM el), t AS (SELECT element, {_TIER.replace("ELSE 'other'", "ELSE 'other'").replace('label', "coalesce(label, '')")} AS tier, count(*) AS n
  FROM c LEFT JOIN oc USING (list, code) GROUP BY 1, 2)
SELECT element, CAST(nullif(regexp_extract(element, '[Ll]od([0-9])', 1), '') AS INTEGER) AS lod, regexp_replace(element, '[Ll]od[0-9]', '') AS base, tier, CAST(n AS BIGINT) AS n, round(n / sum(n) OVER (PARTITION BY element), 4) AS rate FROM t"""
)
def quality_profile(spark, d):
    from lakewright.operators.stats import quality_profile as profile

    return profile(_elements(spark, d), old_codes(spark))


@query(
    f"""WITH {_OLD}, {_ELEM}, c AS (SELECT element, list, code, count(*) AS n FROM el GROUP BY ALL)
SELECT element, list, code, coalesce(label, code) AS label, n, round(n / sum(n) OVER (PARTITION BY element, list), 4) AS rate FROM c LEFT JOIN oc USING (list, code)"""
)
def code_distribution(spark, d):
    from lakewright.operators.stats import code_distribution as spread

    return spread(_elements(spark, d), old_codes(spark))


@query(
    f"""WITH {E.SQL}, {_THREE}, r AS (SELECT CASE WHEN key % 17 = 0 THEN 'c2023' ELSE 'c2024' END AS edition, 'status' AS list, status AS code FROM e2 WHERE status IN ('X', 'P'))
SELECT edition, list, code, count(*) AS n, count(*) > 100 AS over FROM r GROUP BY ALL"""
)
def codespace_report(spark, d):
    """Codes that still point at an older edition's list, with those above a limit."""
    rows = E.edition(spark, d, 2).where(F.col("status").isin("X", "P"))
    text = F.concat(F.lit("<a codeSpace='codelists/"), F.when(F.col("key") % 17 == 0, "c2023").otherwise("c2024"), F.lit("/status.xml'>"), "status", F.lit("</a>"))
    pattern = r"codeSpace='codelists/([^/]+)/([^.]+)\.xml'>([^<]*)<"
    found = rows.select(*(F.regexp_extract(text, pattern, i).alias(n) for i, n in ((1, "edition"), (2, "list"), (3, "code"))))
    return found.groupBy("edition", "list", "code").agg(F.count(F.lit(1)).alias("n")).withColumn("over", F.col("n") > 100)
