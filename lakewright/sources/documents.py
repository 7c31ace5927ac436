"""Small documents: manifest validation, report tables, compact payloads, file catalogues."""

from __future__ import annotations

import base64
import gzip
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_KINDS = {"object": dict, "array": list, "string": str, "integer": int, "number": (int, float)}


def violations(schema: dict, value, path: str = "$", defs: dict | None = None) -> Iterator[str]:
    """What in ``value`` breaks the schema subset: $ref, const, enum, type, required, properties,
    additionalProperties, items, minItems, pattern, minimum, maximum."""
    defs = schema.get("$defs", {}) if defs is None else defs
    if "$ref" in schema:
        schema = defs[schema["$ref"].rsplit("/", 1)[-1]]
    if "const" in schema and value != schema["const"]:
        yield f"{path}: not the constant"
    if "enum" in schema and value not in schema["enum"]:
        yield f"{path}: not in the list"
    kind = schema.get("type")
    if kind and (not isinstance(value, _KINDS[kind]) or (isinstance(value, bool) and kind in ("integer", "number"))):
        yield f"{path}: {kind} expected"
        return
    if kind == "object":
        known, more = schema.get("properties", {}), schema.get("additionalProperties")
        yield from (f"{path}: {k} is missing" for k in schema.get("required", ()) if k not in value)
        for k, v in value.items():
            if k in known:
                yield from violations(known[k], v, f"{path}.{k}", defs)
            elif more is False:
                yield f"{path}: {k} is not allowed"
            elif isinstance(more, dict):
                yield from violations(more, v, f"{path}.{k}", defs)
    elif kind == "array":
        if len(value) < schema.get("minItems", 0):
            yield f"{path}: too few items"
        for i, v in enumerate(value):
            yield from violations(schema["items"], v, f"{path}[{i}]", defs)
    elif kind == "string" and "pattern" in schema and not re.search(schema["pattern"], value):
        yield f"{path}: does not match"
    elif kind in ("integer", "number"):
        if value < schema.get("minimum", value):
            yield f"{path}: below the minimum"
        if value > schema.get("maximum", value):
            yield f"{path}: above the maximum"


def table_rows(markdown: str) -> list[dict[str, str]]:
    """Rows of the first table in a report, by its header."""
    lines = iter(markdown.splitlines())
    cells = lambda line: [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", line.strip())[1:-1]]
    for line in lines:
        if line.strip().startswith("|"):
            names = cells(line)
            next(lines, None)
            out = []
            for row in lines:
                if not row.strip().startswith("|"):
                    break
                out.append(dict(zip(names, cells(row))))
            return out
    return []


def payload(text: str) -> str:
    """Text compressed for a link; equal text gives equal payloads."""
    return base64.urlsafe_b64encode(gzip.compress(text.encode(), mtime=0)).decode().rstrip("=")


def unpack(data: str) -> str:
    return gzip.decompress(base64.urlsafe_b64decode(data + "=" * (-len(data) % 4))).decode()


def catalogue(spark: SparkSession, path: str, suffix: str = ".gml") -> DataFrame:
    """(file, code, bytes) of every file under ``path`` from its metadata; no content is read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return found.select(F.col("path").alias("file"), F.regexp_extract(name, r"^([0-9]+(?:_[0-9]+)?)", 1).alias("code"), F.col("length").alias("bytes"))


#: Suffixes of image files.
IMAGES = (".jpg", ".jpeg", ".png")


def sample_files(files: DataFrame, n: int, seed: str = "seed0", suffixes: tuple[str, ...] = IMAGES, path: str = "path") -> DataFrame:
    """``n`` of the files (rows with a path) that have one of the suffixes, in the order of a hash of seed and path.

    Files are listed by ``spark.read.format("binaryFile")``; a report on a sample is what this is for.
    """
    low = F.lower(path)
    some = F.lit(False)
    for s in suffixes:
        some = some | F.endswith(low, F.lit(s))
    return files.where(some).orderBy(F.sha2(F.concat(F.lit(seed), F.col(path)), 256), path).limit(n)
