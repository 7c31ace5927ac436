"""Structured Streaming twins of the history operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(events: DataFrame, time: str, kind: str, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Counts of each kind in tumbling windows; events later than ``late`` are dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), kind, "n")


def change_feed(events: DataFrame, key: str, order: str, state: str) -> DataFrame:
    """The running form of an entity's history: first_appearance and changed rows only.

    One row a key is kept as state; inside a micro batch rows are taken in order.
    """
    types = dict(events.dtypes)
    out = f"`{key}` {types[key]}, `{order}` {types[order]}, before string, after string, event string"

    def step(name: tuple, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        last = kept.get[0] if kept.exists else None
        first = not kept.exists
        rows = pd.concat(list(batches)).sort_values(order)
        out_rows = []
        for at, now in zip(rows[order], rows[state]):
            if first or now != last:
                out_rows.append((name[0], at, last, now, "first_appearance" if first else "changed"))
            first, last = False, now
        kept.update((last,))
        yield pd.DataFrame(out_rows, columns=[key, order, "before", "after", "event"])

    return events.groupBy(key).applyInPandasWithState(step, out, "last string", "append", GroupStateTimeout.NoTimeout)
