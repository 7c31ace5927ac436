"""Data-quality statistics with unknown values, and drift against a baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lakewright.functions.text import is_sentinel, is_unknown_label, known, lod_of, quality_tier

# How far a rate (absolute) or another figure (relative) may move.
RATE_THRESHOLD, RELATIVE_THRESHOLD = 0.05, 0.10


def numeric_stats(rows: DataFrame, name: str = "name", value: str = "value") -> DataFrame:
    """One row an attribute: total, valid, sentinel, unknown_rate, mean, min, max; sentinels are not values."""
    v = F.col(value)
    own = known(v)
    return (
        rows.where(v.isNotNull())
        .groupBy(F.col(name).alias("name"))
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count(own).alias("valid"),
            F.count_if(is_sentinel(v)).alias("sentinel"),
            F.round(F.count_if(is_sentinel(v)) / F.count(F.lit(1)), 4).alias("unknown_rate"),
            F.round(F.avg(own.cast("decimal(18,4)")).cast("double"), 3).alias("mean"),
            F.min(own).alias("min"),
            F.max(own).alias("max"),
        )
    )


def unknown_codes(codelist: DataFrame) -> DataFrame:
    """(list, codes, n): the codes of each list whose label means unknown; lists without any are left out."""
    return codelist.where(is_unknown_label(F.col("label"))).groupBy("list").agg(F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"), F.count_distinct("code").alias("n"))


def coded_unknown_rate(values: DataFrame, codelist: DataFrame) -> DataFrame:
    """(list, total, unknown, unknown_rate) over coded values (list, code)."""
    unknown = codelist.where(is_unknown_label(F.col("label"))).select("list", "code", F.lit(1).alias("u")).distinct()
    met = values.where("code <> ''").join(unknown, ["list", "code"], "left")
    return met.groupBy("list").agg(
        F.count(F.lit(1)).alias("total"), F.count("u").alias("unknown"), F.round(F.count("u") / F.count(F.lit(1)), 4).alias("unknown_rate")
    )


def quality_profile(values: DataFrame, codelist: DataFrame) -> DataFrame:
    """(element, lod, base, tier, n, rate): how each element's codes spread over quality tiers.

    If an element refers to several lists, the least list's labels decide.
    """
    named = values.groupBy("element", "list", "code").agg(F.count(F.lit(1)).alias("n"))
    first = F.min("list").over(Window.partitionBy("element"))
    named = named.withColumn("list", first).groupBy("element", "list", "code").agg(F.sum("n").alias("n"))
    tiers = named.join(codelist, ["list", "code"], "left").groupBy("element", quality_tier(F.col("label")).alias("tier")).agg(F.sum("n").alias("n"))
    rate = F.col("n") / F.sum("n").over(Window.partitionBy("element"))
    base = F.regexp_replace("element", "[Ll]od[0-9]", "")
    return tiers.select("element", lod_of(F.col("element")).alias("lod"), F.when(base == "", F.col("element")).otherwise(base).alias("base"), "tier", "n", F.round(rate, 4).alias("rate"))


def code_distribution(values: DataFrame, codelist: DataFrame) -> DataFrame:
    """(element, list, code, label, n, rate) of every code."""
    counts = values.where("code <> ''").groupBy("element", "list", "code").agg(F.count(F.lit(1)).alias("n"))
    rate = F.round(F.col("n") / F.sum("n").over(Window.partitionBy("element", "list")), 4)
    return counts.join(codelist, ["list", "code"], "left").select("element", "list", "code", F.coalesce("label", "code").alias("label"), "n", rate.alias("rate"))


def drift(baseline: DataFrame, current: DataFrame, rate: float = RATE_THRESHOLD, relative: float = RELATIVE_THRESHOLD) -> DataFrame:
    """(name, metric, base, now, severity) of figures that moved beyond a threshold.

    The unknown rate is compared absolutely, the rest relative to the baseline,
    both strictly; a zero or missing base cannot be compared, but a mean or
    maximum on one side only is a warning.
    """
    fields = ["total", "unknown_rate", "mean", "max"]
    b = baseline.select("name", F.lit(True).alias("b"), *(F.col(f).cast("double").alias(f"b_{f}") for f in fields))
    c = current.select("name", F.lit(True).alias("c"), *(F.col(f).cast("double").alias(f"c_{f}") for f in fields))
    both = b.join(c, "name", "full")
    d = lambda m, base, now, sev: F.struct(F.lit(m).alias("metric"), base.cast("double").alias("base"), now.cast("double").alias("now"), sev.alias("severity"))
    step = lambda f: (F.col(f"c_{f}") - F.col(f"b_{f}")) / F.abs(F.nullif(F.col(f"b_{f}"), F.lit(0.0)))
    change = F.col("c_unknown_rate") - F.col("b_unknown_rate")
    here = F.col("b").isNotNull() & F.col("c").isNotNull()
    null = F.lit(None).cast("double")
    found = [
        F.when(F.col("b").isNull(), d("new", null, F.col("c_total"), F.lit("info"))),
        F.when(F.col("c").isNull(), d("missing", F.col("b_total"), null, F.lit("warn"))),
        F.when(here & (F.abs(change) > rate), d("unknown_rate", F.col("b_unknown_rate"), F.col("c_unknown_rate"), F.when(change > 0, "warn").otherwise("info"))),
        F.when(here & (F.abs(step("total")) > relative), d("total", F.col("b_total"), F.col("c_total"), F.when(step("total") < 0, "warn").otherwise("info"))),
    ]
    for f in ("mean", "max"):
        one = F.col(f"b_{f}").isNull() != F.col(f"c_{f}").isNull()
        found.append(F.when(here & (one | (F.abs(step(f)) > relative)), d(f, F.col(f"b_{f}"), F.col(f"c_{f}"), F.lit("warn"))))
    return both.select("name", F.inline(F.array_compact(F.array(*found))))


def distribution(rows: DataFrame, group: str, value: Column) -> DataFrame:
    """(group, n, min, p10, median, p90, max) with exact, linearly interpolated percentiles."""
    p = lambda q: F.percentile(value, F.lit(q))
    return rows.groupBy(group).agg(
        F.count(value).alias("n"), F.min(value).alias("min"), p(0.1).alias("p10"), p(0.5).alias("median"), p(0.9).alias("p90"), F.max(value).alias("max")
    )


def rate_in_group(rows: DataFrame, group: str, item: str) -> DataFrame:
    counts = rows.groupBy(group, item).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("rate", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(group)), 4))


def weighted_stats(rows: DataFrame, group: str, mean: str, square: str, weight: str) -> DataFrame:
    """Mean and deviation of pooled samples given each sample's mean, mean square and size."""
    w = F.sum(weight)
    m = F.sum(F.col(mean) * F.col(weight)) / w
    s = F.sum(F.col(square) * F.col(weight)) / w
    return rows.groupBy(group).agg(w.alias("n"), F.round(m, 4).alias("mean"), F.round(F.sqrt(F.greatest(s - m * m, F.lit(0.0))), 4).alias("deviation"))


def duplicate_groups(rows: DataFrame, key: str, digest: Column, shown: int = 3) -> DataFrame:
    """(key, copies, others): records that share a digest, with the first few other keys.

    The keys shown come from one small aggregate a digest; a group is never collected whole.
    """
    own = rows.select(key, digest.alias("digest")).where("digest is not null")
    ranked = own.withColumn("r", F.row_number().over(Window.partitionBy("digest").orderBy(key)))
    firsts = ranked.where(F.col("r") <= shown + 1).groupBy("digest").agg(F.array_sort(F.collect_list(key)).alias("firsts"))
    sizes = own.groupBy("digest").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    others = F.slice(F.filter("firsts", lambda x: x != F.col(key)), 1, shown)
    return own.join(sizes.join(firsts, "digest"), "digest").select(key, "copies", F.array_join(F.transform(others, lambda x: x.cast("string")), ",").alias("others"))


def size_breakdown(files: DataFrame, category: Column, size: Column) -> DataFrame:
    total = F.sum("bytes").over(Window.partitionBy())
    out = files.groupBy(category.alias("category")).agg(F.count(F.lit(1)).alias("files"), F.sum(size).alias("bytes"))
    return out.withColumn("share", F.round(F.col("bytes") / total, 4))
