"""Status, class and gate rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def edition_status(in_old: Column, in_new: Column, same: Column) -> Column:
    return F.when(~in_old, "added").when(~in_new, "deleted").when(same, "unchanged").otherwise("modified")


def change_class(added: Column, deleted: Column, modified: Column, renamed: Column) -> Column:
    """Structural class from counts; the first that holds."""
    return (
        F.when((added > 0) | (deleted > 0), "lifecycle")
        .when(modified > 1, "multi-modified")
        .when(modified == 1, "single")
        .when(renamed > 0, "rename")
        .otherwise("none")
    )


# Branch prefixes, title prefixes and title words of each proposal class, in order.
BRANCH_PREFIXES = (("attribute", ("edit/",)), ("texture", ("tex/",)), ("geometry", ("geom/", "geometry/")))
TITLE_PREFIXES = (
    ("attribute", ("Update attributes", "Update building info", "属性修正", "Attributkorrektur")),
    ("texture", ("Update textures", "Add textures", "テクスチャ", "Textur")),
)
TITLE_WORDS = (("geometry", ("geometry", "building shape", "rebuild", "幾何", "建物形状", "建替", "建て替")),)


def proposal_class(branch: Column, title: Column, data_changed: Column, administrative: Column) -> Column:
    out = F.when(F.lit(False), "")
    for cls, words in BRANCH_PREFIXES:
        for w in words:
            out = out.when(branch.startswith(w), cls)
    for cls, words in TITLE_PREFIXES:
        for w in words:
            out = out.when(title.startswith(w), cls)
    for cls, words in TITLE_WORDS:
        for w in words:
            out = out.when(title.contains(w), cls)
    return out.when(administrative, "administrative").when(~data_changed, "other").otherwise("unclassified")


# The gates in order, each blocking or advisory.
GATES = (
    ("reason", "blocking"),
    ("classification", "blocking"),
    ("commit-scope", "blocking"),
    ("scope-reproducibility", "blocking"),
    ("reproduction", "blocking"),
    ("freshness", "blocking"),
    ("file-scope", "blocking"),
    ("schema", "blocking"),
    ("minimal-diff", "advisory"),
    ("texture", "blocking"),
    ("structure", "blocking"),
    ("plausibility", "advisory"),
    ("topology", "advisory"),
    ("model", "advisory"),
)
BLOCKING_STATUSES = ("fail", "error", "pending")


def gate_status(exit_code: Column, severity: Column, applicable: Column, warnings: Column) -> Column:
    return (
        F.when(~applicable, "na")
        .when(exit_code.isNull(), "pending")
        .when(exit_code == 0, F.when(warnings > 0, "warn").otherwise("pass"))
        .when(exit_code == 1, F.when(severity == "blocking", "fail").otherwise("warn"))
        .otherwise("error")
    )


def path_scope(path: Column, removed: Column, data_dirs=("data",), code=(".py", ".sh", ".js"), images=(".png", ".jpg")) -> Column:
    """The scope class of a changed file; the first rule that holds."""
    low = F.lower(path)
    is_code = F.lit(False)
    for s in code:
        is_code = is_code | low.endswith(s)
    is_data = path.startswith("provenance/") | path.rlike(r"^[^/]+/udx/.+")
    for d in data_dirs:
        is_data = is_data | path.startswith(d + "/")
    is_docs = path.startswith("docs/") | (~path.contains("/") & low.endswith(".md"))
    is_image = F.lit(False)
    for s in images:
        is_image = is_image | low.endswith(s)
    is_config = path.startswith(".github/ISSUE_TEMPLATE/") | (~path.contains("/") & (is_image | low.endswith(".json")))
    return (
        F.when(removed, "removed")
        .when(is_data & ~is_code, "data")
        .when(is_docs & ~is_code, "docs")
        .when(is_config, "config")
        .when(path.rlike(r"^\.github/workflows/.*\.ya?ml$"), "pin")
        .when(path.startswith(".github/"), "tooling")
        .otherwise("rejected")
    )


# Merged contributions that each tier takes.
TIERS = (30, 10, 3, 1, 0)


def contribution_tier(merged: Column) -> Column:
    out = F.when(F.lit(False), 0)
    for t in TIERS:
        out = out.when(merged >= t, t)
    return out.otherwise(0)


def lifecycle_errors(kind: Column, old_ids: Column, new_ids: Column, reason: Column, confirmed: Column, occurred: Column) -> Column:
    """array<string> of the rules that a lifecycle event breaks, in order."""
    bad_list = lambda ids: ids.isNull() | (F.size(ids) == 0) | F.exists(ids, lambda x: (x != F.trim(x)) | (x == "") | x.rlike(r"\s"))
    twice = lambda ids: F.size(F.array_distinct(ids)) < F.size(ids)
    day = lambda c: c.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(c, "yyyy-MM-dd").isNotNull()
    valid = ~bad_list(old_ids) & ~bad_list(new_ids)
    rules = [
        (~F.coalesce(kind.isin("rebuild", "split", "merge"), F.lit(False)), "kind"),
        (bad_list(old_ids), "oldIds"),
        (~bad_list(old_ids) & twice(old_ids), "oldIds_duplicate"),
        (bad_list(new_ids), "newIds"),
        (~bad_list(new_ids) & twice(new_ids), "newIds_duplicate"),
        (valid & (kind == "split") & ~((F.size(old_ids) == 1) & (F.size(new_ids) >= 2)), "split_cardinality"),
        (valid & (kind == "merge") & ~((F.size(old_ids) >= 2) & (F.size(new_ids) == 1)), "merge_cardinality"),
        (F.coalesce(F.trim(reason), F.lit("")) == "", "reason"),
        (~F.coalesce(day(confirmed), F.lit(False)), "confirmedOn"),
        (occurred.isNotNull() & ~F.coalesce(day(occurred), F.lit(False)), "occurredOn"),
        (F.coalesce(day(confirmed) & day(occurred) & (occurred > confirmed), F.lit(False)), "order"),
    ]
    return F.array_compact(F.array(*(F.when(cond, F.lit(name)) for cond, name in rules)))
