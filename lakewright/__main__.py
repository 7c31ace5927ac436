"""``python -m lakewright``: run a named query, or compare, check and describe city-model files."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from lakewright.plans import catalogue, city


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lakewright", description=__doc__)
    p.add_argument("--out", help="folder for JSON lines; without it they go to standard output")
    sub = p.add_subparsers(dest="command", required=True)
    q = sub.add_parser("query", help="a query of the catalogue over a folder of Parquet tables")
    q.add_argument("name", choices=sorted(catalogue.queries()))
    q.add_argument("tables")
    d = sub.add_parser("diff", help="buildings added, deleted, modified or renamed between two sets of files")
    d.add_argument("old")
    d.add_argument("new")
    d.add_argument("--unchanged", action="store_true", help="list unchanged buildings too")
    s = sub.add_parser("stats", help="numeric statistics without unknown values")
    s.add_argument("files")
    s.add_argument("--numeric", nargs="+", default=["measuredHeight", "storeysAboveGround", "storeysBelowGround"])
    c = sub.add_parser("codes", help="counts and rates of every code")
    c.add_argument("files")
    c.add_argument("lists")
    n = sub.add_parser("lint", help="geometry errors and plausibility warnings; exit 1 on errors")
    n.add_argument("files")
    n.add_argument("--lists")
    return p


def result(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    if a.command == "query":
        return catalogue.queries()[a.name](spark, a.tables)
    if a.command == "diff":
        rows = city.building_diff(spark, a.old, a.new)
        return rows if a.unchanged else rows.where("status <> 'unchanged'")
    if a.command == "stats":
        return city.building_stats(spark, a.files, a.numeric)
    if a.command == "codes":
        return city.building_codes(spark, a.files, a.lists)
    return city.building_lint(spark, a.files, a.lists)


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("lakewright").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    rows = result(spark, a)
    if a.out:
        rows.write.mode("overwrite").json(a.out)
        rows = spark.read.schema(rows.schema).json(a.out)
    else:
        for line in rows.toJSON().toLocalIterator():
            print(line)
    return int(a.command == "lint" and not rows.where("severity = 'error'").isEmpty())


if __name__ == "__main__":
    sys.exit(main())
