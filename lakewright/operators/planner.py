"""Review lanes, signatures and plans for the changes between two editions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewright.functions.text import attribute_family, base_path, is_address_path, is_source_path, signature_id

# Fixed value: the distance, in metres, up to which a shape counts as unchanged.
TOLERANCE_M = 0.01


def dimensions(paths: Column, hausdorff: Column, equal_1mm: Column, lod_changed: Column, id_changed: Column) -> dict[str, Column]:
    """What a match's changes touch; these may overlap."""
    return {
        "source_metadata": F.exists(paths, is_source_path),
        "address": F.exists(paths, is_address_path),
        "attribute_residual": F.exists(paths, lambda p: ~is_source_path(p) & ~is_address_path(p)),
        "geometry_over_tolerance": F.coalesce(hausdorff, F.lit(0.0)) > TOLERANCE_M,
        "geometry_changed_1mm": ~F.coalesce(equal_1mm, F.lit(True)),
        "lod": F.coalesce(lod_changed, F.lit(False)),
        "id_changed": F.coalesce(id_changed, F.lit(False)),
    }


def lane(d: dict[str, Column]) -> Column:
    """The one lane of a match; the first that holds."""
    return (
        F.when(d["geometry_over_tolerance"] | d["lod"], "geometry_or_lod_review")
        .when(d["attribute_residual"], "attribute_review")
        .when(d["source_metadata"], "source_metadata_review")
        .when(d["address"], "representation_review")
        .otherwise("unchanged")
    )


def review_lanes(matches: DataFrame) -> DataFrame:
    """Matches (id, paths, hausdorff_m, equal_1mm, lod_changed, id_changed) with their dimensions and lane."""
    d = dimensions(*(F.col(c) for c in ("paths", "hausdorff_m", "equal_1mm", "lod_changed", "id_changed")))
    return matches.select("id", *(c.alias(k) for k, c in d.items()), lane(d).alias("lane"))


def path_signatures(changes: DataFrame) -> DataFrame:
    """(signature, paths, n) of records by the set of paths that changed (rows id, path)."""
    sets = changes.groupBy("id").agg(F.array_sort(F.collect_set(base_path(F.col("path")))).alias("p"))
    return sets.groupBy("p").agg(F.count(F.lit(1)).alias("n")).select(signature_id(F.col("p")).alias("signature"), F.array_join("p", ",").alias("paths"), "n")


def family_plan(changes: DataFrame, evidence_only=("source_identity",)) -> DataFrame:
    """(family, records, changes, proposals): one proposal a family, two with a pilot of one record first."""
    named = changes.withColumn("family", attribute_family(base_path(F.col("path")))).where(~F.col("family").isin(*evidence_only))
    out = named.groupBy("family").agg(F.count_distinct("id").alias("records"), F.count(F.lit(1)).alias("changes"))
    return out.withColumn("proposals", F.when(F.col("records") == 1, 1).otherwise(2))


def memberships(changes: DataFrame) -> DataFrame:
    """One row: how many families the changed records belong to."""
    per = changes.withColumn("family", attribute_family(base_path(F.col("path")))).groupBy("id").agg(F.count_distinct("family").alias("f"))
    return per.agg(F.count(F.lit(1)).alias("records"), F.sum("f").alias("memberships"), F.max("f").alias("most"), F.median("f").alias("median"))


def top_paths(changes: DataFrame, n: int = 30) -> DataFrame:
    """The most changed paths, ties by path."""
    return changes.groupBy("path").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "path").limit(n)


def audit_sample(rows: DataFrame, key: str, seed: str, n: int = 30) -> DataFrame:
    """A seeded sample of at most ``n`` keys, by hash order."""
    return rows.select(key).distinct().orderBy(F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256)).limit(n)


#: Kinds of commits that may be declared; an ordinary commit declares none.
KINDS = ("lifecycle", "layout", "source-baseline", "scope-extract", "schema-update", "identity-baseline", "identity-correction")


def commit_scope(commits: DataFrame, members: DataFrame) -> DataFrame:
    """(commit, errors): the rules of its kind that each commit breaks, in order; an array of names.

    ``commits`` has (commit, parents: int, kinds: array, had_data: boolean, named, added, deleted,
    from_ids, to_ids, areas: array<string> of what its trailers name, manifests, corrects: int);
    ``members`` (commit, id: string, in_old, in_new, same: boolean, area) has a row for every record
    of the files that a commit changes.  The records are grouped with map-side combine; of changed
    ids only the least and greatest are kept, since more than two break the rules by their number.
    """
    added, deleted = ~F.col("in_old") & F.col("in_new"), F.col("in_old") & ~F.col("in_new")
    changed = added | deleted | ~F.col("same")
    trailers = commits.select(F.col("commit").alias("_c"), F.array_union(F.array_union("named", "added"), "deleted").alias("_all"), "areas", *(F.col(c).alias(f"_{c}") for c in ("named", "added", "deleted")))
    rows = members.join(trailers, F.col("commit") == F.col("_c"))
    here = (F.size("areas") == 1) & (F.col("area") == F.get("areas", F.lit(0)))
    here = F.coalesce(here, F.lit(False))
    modified = changed & ~added & ~deleted
    untold = lambda what, names: F.count_if(what != F.coalesce(F.array_contains(names, F.col("id")), F.lit(False)))
    facts = rows.groupBy("commit").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(added).alias("n_added"), F.count_if(deleted).alias("n_deleted"), F.count_if(changed).alias("n_changed"),
        *(f(F.when(what, F.col("id"))).alias(f"{n}_{k}") for k, what in (("added", added), ("deleted", deleted), ("changed", changed)) for n, f in (("min", F.min), ("max", F.max))),
        F.count_if(F.col("in_old") & F.col("area").isNull()).alias("n_unknown"), F.count_if(F.col("in_old") & here & ~F.col("in_new")).alias("n_missing"),
        F.count_if(F.col("in_new") & ~(F.col("in_old") & here)).alias("n_unexpected"), F.count_if(F.col("in_old") & F.col("in_new") & ~F.col("same")).alias("n_retained"),
        untold(added, "_added").alias("x_added"), untold(deleted, "_deleted").alias("x_deleted"), untold(modified, "_named").alias("x_named"),
        *(F.count_if(F.array_contains(f"_{k}", F.col("id"))).alias(f"found_{k}") for k in ("added", "deleted", "named")),
    )
    both = commits.join(facts, "commit", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    kind = F.coalesce(F.lower(F.get("kinds", F.size("kinds") - 1)), F.lit(""))
    both = both.withColumns({"kind": kind, "told": F.size("named") + F.size("added") + F.size("deleted")})
    is_ = lambda *k: F.col("kind").isin(*k)
    identity, data = is_("identity-baseline", "identity-correction"), F.col("n") > 0
    plain = ~is_(*KINDS)
    pair = (F.size("from_ids") == 1) & (F.size("to_ids") == 1)
    source, target = F.get("from_ids", F.lit(0)), F.get("to_ids", F.lit(0))
    one_moved = (
        (F.col("n_deleted") == 1) & (F.col("min_deleted") == source) & (F.col("n_added") == 1) & (F.col("min_added") == target) & (F.col("n_changed") == 2)
        & (F.least(source, target) == F.col("min_changed")) & (F.greatest(source, target) == F.col("max_changed"))
    )
    lists = lambda k: (F.col(f"x_{k}") > 0) | (F.size(k) != F.size(F.array_distinct(k))) | (F.col(f"found_{k}") != F.size(k))
    own = F.when(F.col("n_added") == 1, F.col("added")).when(F.col("n_deleted") == 1, F.col("deleted")).otherwise(F.col("named"))
    scope = is_("scope-extract") & data
    one_scope = F.size("areas") == 1
    rules = [
        (F.size("kinds") > 1, "several_kinds"),
        ((F.col("kind") != "") & plain, "unknown_kind"),
        (~data & is_("lifecycle"), "lifecycle_without_data"),
        (~data & (F.col("told") > 0), "trailers_without_data"),
        (~data & identity, "identity_without_data"),
        (data & is_("schema-update"), "schema_with_data"),
        (data & is_("source-baseline") & F.col("had_data"), "baseline_not_first"),
        (data & is_("layout") & (F.col("n_added") + F.col("n_deleted") > 0), "layout_changes_ids"),
        (data & is_("layout") & (F.col("n_changed") > 0), "layout_changes_content"),
        (scope & ~one_scope, "one_area"),
        (data & identity & ~pair, "one_pair_of_ids"),
        (data & (is_("source-baseline", "layout") | (scope & one_scope) | (identity & pair)) & (F.col("told") > 0), "trailers_not_allowed"),
        (scope & one_scope & (F.col("n_unknown") > 0), "unknown_area"),
        (scope & one_scope & (F.col("n_missing") > 0), "missing"),
        (scope & one_scope & (F.col("n_unexpected") > 0), "unexpected"),
        (scope & one_scope & (F.col("n_retained") > 0), "retained_changed"),
        (data & identity & pair & (F.col("manifests") != 1), "one_manifest"),
        (data & is_("identity-correction") & pair & (F.col("corrects") != 1), "one_correction"),
        (data & identity & pair & ~F.coalesce(one_moved, F.lit(False)), "not_one_replacement"),
        (data & is_("lifecycle") & (F.col("n_added") + F.col("n_deleted") == 0), "lifecycle_without_change"),
        *((data & is_("lifecycle") & lists(k), f"lifecycle_{k}") for k in ("added", "deleted", "named")),
        (data & is_("lifecycle") & (F.col("manifests") != 1), "one_manifest"),
        (data & plain & (F.col("n_changed") != 1), "not_one_record"),
        (data & plain & (F.col("n_changed") == 1) & (F.col("told") != 1), "one_trailer"),
        (data & plain & (F.col("n_changed") == 1) & (F.col("told") == 1) & ((F.size(own) != 1) | (F.get(own, F.lit(0)) != F.col("min_changed"))), "trailer_differs"),
    ]
    found = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for c, name in rules)))
    return both.select("commit", F.when(F.col("parents") != 1, F.array(F.lit("merge"))).otherwise(found).alias("errors"))
