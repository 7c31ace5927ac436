"""Rules on attribute text and paths, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PLAIN = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)$"


def norm_num(c: Column) -> Column:
    """Canonical form of a plain decimal number; other text passes unchanged.

    Exponents, NaN, digit groups and non-ASCII digits are left as they are.
    """
    t = F.trim(c)
    n = F.regexp_replace(t, r"^[+]", "")
    n = F.regexp_replace(n, r"^(-?)0+(?=[0-9])", "$1")
    n = F.regexp_replace(n, r"^(-?)[.]", "$10.")
    n = F.regexp_replace(n, r"([.][0-9]*?)0+$", "$1")
    n = F.regexp_replace(n, r"[.]$", "")
    return F.when(t.rlike(_PLAIN), n).otherwise(c)


def same_value(a: Column, b: Column) -> Column:
    """Equality that ignores how a number is written; null equals null only."""
    return norm_num(a).eqNullSafe(norm_num(b))


def base_path(path: Column) -> Column:
    """A path without its trailing occurrence index."""
    return F.regexp_replace(path, r"\[[0-9]+\]$", "")


def fold_names(path: Column) -> Column:
    """A path without any ``[@name=...]`` selector or index."""
    return F.regexp_replace(F.regexp_replace(path, r"\[@name=[^\]]*\]", ""), r"\[[0-9]+\]", "")


def local_name(path: Column) -> Column:
    """The last step of a path."""
    return F.regexp_extract(fold_names(path), r"([^/]*)$", 1)


def set_hash(values: Column) -> Column:
    """Hash of a bag of texts, whatever their order; null for an empty bag."""
    ordered = F.array_sort(values)
    return F.when(F.size(ordered) > 0, F.sha2(F.array_join(ordered, "\n"), 256))


def sliced_set_hash(rows: DataFrame, value: str, out: str, digits: int = 3) -> DataFrame:
    """One row: the hash of a bag of texts of any size, made of the hashes of its slices by the first digits of each text's own hash.

    No row holds more than one slice, and the last step at most 16 ** digits hashes.
    """
    slices = rows.groupBy(F.substring(F.sha2(F.col(value), 256), 1, digits).alias("_slice")).agg(set_hash(F.collect_list(value)).alias("_hash"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_slice", "_hash"))), lambda s: s["_hash"])
    return slices.agg(F.sha2(F.array_join(ordered, "\n"), 256).alias(out))


def signature_id(paths: Column) -> Column:
    """Short identifier of a set of paths."""
    return F.concat(F.lit("paths-"), F.substring(F.sha2(F.array_join(F.array_sort(F.array_distinct(paths)), "\n"), 256), 1, 12))


def _any(c: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


# Names that decide the family of an attribute path, in order of precedence.
PLANNING_NAMES = (
    "areaClassificationType",
    "districtsAndZonesType",
    "specifiedBuildingCoverageRate",
    "specifiedFloorAreaRate",
    "urbanPlanType",
    "[@name=地区計画]",
)
SURVEY_NAMES = (
    "creationDate",
    "measuredHeight",
    "yearOfConstruction",
    "buildingRoofEdgeArea",
    "buildingFootprintArea",
    "totalFloorArea",
    "fireproofStructureType",
    "buildingStructureType",
    "surveyYear",
)


def is_source_path(path: Column) -> Column:
    return F.lower(path).contains("dataqualityattribute")


def is_address_path(path: Column) -> Column:
    return path.startswith("/address/")


def attribute_family(path: Column) -> Column:
    """The one family that a changed path belongs to; the first rule that holds decides."""
    low = F.lower(path)
    return (
        F.when(is_address_path(path), "address")
        .when(low.contains("lodtype") | low.contains("lod1heighttype"), "lod_quality")
        .when(is_source_path(path), "source_quality")
        .when(low.contains("disasterriskattribute"), "disaster_risk")
        .when(path.isin("/storeysAboveGround", "/storeysBelowGround"), "storeys")
        .when(path.isin("/class", "/usage") | _any(path, ("detailedUsage", "landUseType")), "usage_class_landuse")
        .when(_any(path, PLANNING_NAMES), "planning_zoning_rates")
        .when(_any(path, SURVEY_NAMES), "survey_building_detail")
        .when(path.contains("buildingIDAttribute/"), "source_identity")
        .when(_any(path, ("stringAttribute", "KeyValuePairAttribute")), "generic_attributes")
        .otherwise("other_attributes")
    )


# Readings of numbers and labels that mean "unknown".
SENTINELS = (9999.0, -9999.0)
UNKNOWN_WORDS = ("不明", "不詳")

# Label keywords of each quality tier, in order of precedence.
TIER_WORDS = (
    ("missing", ("未作成", "不明", "不詳", "取得不可", "定義なし", "未設定", "該当なし")),
    ("provisional", ("推定", "疑似", "仮", "一律", "概略", "みなし")),
    ("measured", ("測量", "実測", "点群", "レーザ", "写真測量", "現地測量", "数値実測", "LidarSLAM")),
    (
        "documented",
        (
            "図面", "ＣＡＤ", "CAD", "設計図", "完成図", "一般図", "台帳", "図書", "既成図", "数値化", "地図編集", "統計",
            "資料", "現地調査", "写真判読", "ＢＩＭ", "BIM", "基盤地図", "数値地形図", "図化", "GIS", "写真", "カメラ", "衛星",
        ),
    ),
)
QUALITY_AXIS = "SrcDesc|HeightType|srcScale|MapLevel|precisionType|_status|validType|yearType|lodType|_scale"


def is_sentinel(value: Column) -> Column:
    return F.coalesce(value.cast("double").isin(*SENTINELS), F.lit(False))


def known(value: Column) -> Column:
    """The number, or null where it stands for unknown."""
    return F.when(~is_sentinel(value), value)


def is_unknown_label(label: Column) -> Column:
    return F.coalesce(_any(label, UNKNOWN_WORDS) | F.lower(label).contains("unknown"), F.lit(False))


def quality_tier(label: Column) -> Column:
    out = F.when(F.coalesce(label, F.lit("")) == "", "other")
    for tier, words in TIER_WORDS:
        out = out.when(_any(label, words), tier)
    return out.otherwise("other")


def is_quality_axis(name: Column) -> Column:
    return name.rlike("(?i)" + QUALITY_AXIS)


def lod_of(name: Column) -> Column:
    """The level of detail that a name carries, else null."""
    return F.when(name.rlike("[Ll]od[0-9]"), F.regexp_extract(name, "[Ll]od([0-9])", 1).cast("int"))


def trailers(body: Column, keys) -> Column:
    """array<struct<pos, key, value>> of ``Key: value`` lines, in order."""
    names = "|".join(keys)
    pattern = rf"(?m)^({names}):[ \t]*(.+?)[ \t]*$"
    k = F.regexp_extract_all(body, F.lit(pattern), F.lit(1))
    v = F.regexp_extract_all(body, F.lit(pattern), F.lit(2))
    return F.transform(k, lambda x, i: F.struct(i.alias("pos"), x.alias("key"), F.get(v, i).alias("value")))


def manifest_reference(value: Column) -> Column:
    """struct(path, digest) of ``<path>@sha256:<64 hex>``, else null."""
    pattern = r"^(.+)@sha256:([0-9a-f]{64})$"
    return F.when(value.rlike(pattern), F.struct(F.regexp_extract(value, pattern, 1).alias("path"), F.regexp_extract(value, pattern, 2).alias("digest")))


# Headings of a reason section and texts that stand for an empty one.
REASON_HEADINGS = (
    "Reason and supporting evidence",
    "Summary of changes",
    "編集理由・根拠資料",
    "変更理由",
    "変更の理由",
    "変更の概要",
    "Begründung und Belege",
    "Zusammenfassung der Änderungen",
)
REASON_PLACEHOLDERS = ("please fill in", "not filled in", "記入してください", "未記入", "bitte ausfüllen", "nicht ausgefüllt", "TODO", "TBD")
REASON_LEAST = 5


def reason_section(body: Column) -> Column:
    """The text under the reason heading, without comments; empty without one."""
    after = r"[^\n]*\n(?s:(.*?))(?=\n##\s|\z)"
    anchored = F.regexp_extract(F.concat(F.lit("\n"), body), r"\n##[^\n]*<!--\s*sec:reason\s*-->" + after, 1)
    headed = F.regexp_extract(F.concat(F.lit("\n"), body), r"\n##\s+(?:" + "|".join(REASON_HEADINGS) + r")\s*?" + after, 1)
    found = F.when(body.rlike(r"##[^\n]*<!--\s*sec:reason\s*-->"), anchored).otherwise(headed)
    return F.trim(F.regexp_replace(F.regexp_replace(found, r"(?s)<!--.*?-->", ""), r"^\s+|\s+$", ""))


def is_reason(text: Column) -> Column:
    low = F.lower(text)
    return (F.length(text) >= REASON_LEAST) & ~_any(low, [w.lower() for w in REASON_PLACEHOLDERS])


def heading_ids(body: Column) -> Column:
    """Distinct identifiers of ``#### `id` `` headings, in order."""
    return F.array_distinct(F.regexp_extract_all(body, F.lit(r"(?m)^#### `([^`]+)`"), F.lit(1)))


def replace_leaf(text: Column, tag: str, old: Column, new: Column) -> Column:
    """``text`` with the value of ``tag`` replaced where that leaf stands exactly once, else null."""
    leaf = F.concat(F.lit(f"<{tag}>"), old, F.lit(f"</{tag}>"))
    once = (F.length(text) - F.length(F.replace(text, leaf, F.lit("")))) == F.length(leaf)
    return F.when(once, F.replace(text, leaf, F.concat(F.lit(f"<{tag}>"), new, F.lit(f"</{tag}>"))))


def apply_changes(text: Column, changes: Column) -> Column:
    """``text`` of one record after array<struct<tag, old, new, code_space>>, in order.

    Each change needs the one leaf of its tag whose value is ``old``; where there is none, or
    several, the result is null.  ``code_space`` sets or replaces the leaf's codeSpace attribute.
    """

    def one(acc: Column, c: Column) -> Column:
        leaf = F.concat(F.lit("(<(?:[A-Za-z][\\w.-]*:)?"), c["tag"], F.lit("(?:\\s[^>]*)?>)\\s*\\Q"), c["old"], F.lit("\\E\\s*(</)"))
        hits = F.regexp_extract_all(acc, leaf, F.lit(1))
        head = F.get(hits, F.lit(0))
        space = F.concat(F.lit(' codeSpace="'), c["code_space"], F.lit('"'))
        bare = F.regexp_replace(head, r'\s+codeSpace\s*=\s*"[^"]*"', "")
        opened = F.when(c["code_space"].isNull(), head).otherwise(F.concat(F.substring(bare, F.lit(1), F.length(bare) - 1), space, F.lit(">")))
        quoted = F.regexp_replace(F.concat(opened, c["new"]), r"([\\$])", r"\\$1")
        return F.when(F.size(hits) == 1, F.regexp_replace(acc, leaf, F.concat(quoted, F.lit("$2"))))

    return F.aggregate(changes, text, one)
