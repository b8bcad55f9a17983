"""Bounded samples for what is fitted on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hashed_sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most `most` rows, those with the smallest hashes of `key`. Rows must be slim.

    A first cut by the hash leaves about four times as many, so no task and no merge sees more, however large the table.
    """
    n, h = rows.count(), F.xxhash64(key)
    if n > 4 * most:
        rows = rows.where(h < -(1 << 63) + int((1 << 64) * 4 * most / n))
    return rows.orderBy(h, *rows.columns).limit(most)
