"""Every query of the library outside the corpus operators, by name."""

from __future__ import annotations

from lakewright.plans import diffs, files, histories, matching, meaning, measures, publishing, rules, texts  # noqa: F401  they register their queries
from lakewright.plans.binding import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
