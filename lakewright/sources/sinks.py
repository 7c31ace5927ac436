"""Writers: JSON, canonical JSON digests, one document a record, files by cell."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_json(value) -> bytes:
    """Sorted keys, no white space, text unescaped: equal values give equal bytes."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()


def row_digest(*cols: str) -> Column:
    """Digest of a row as JSON of the named columns."""
    return F.sha2(F.to_json(F.struct(*sorted(cols)), {"ignoreNullFields": "false"}), 256)


def write_documents(rows: DataFrame, key: str, order: str, path: str, buckets: int = 64) -> None:
    """One JSON document a record with its ordered rows, in ``buckets`` folders by a hash of the key."""
    body = F.array_sort(F.collect_list(F.struct(order, *(c for c in rows.columns if c not in (key, order)))))
    docs = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), body.alias("rows"))
    docs.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets))).write.partitionBy("bucket").mode("overwrite").json(path)


def write_cells(rows: DataFrame, cell: str, path: str) -> None:
    """Rows in one folder a cell; each cell is dealt over as many tasks as it needs."""
    rows.repartition(F.col(cell)).write.partitionBy(cell).mode("overwrite").parquet(path)


def markdown(rows: DataFrame, title: str, cap: int = 50) -> str:
    """A report of at most ``cap`` rows, with the number left out."""
    shown = rows.limit(cap + 1).collect()
    lines = [f"## {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    lines += ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in shown[:cap]]
    if len(shown) > cap:
        lines.append(f"\n{rows.count() - cap} more")
    return "\n".join(lines) + "\n"
