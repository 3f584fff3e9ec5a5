"""Joins against dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 200_000
MAX_BROADCAST_BYTES = 64 << 20


def small_side(
    dim: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES
) -> DataFrame:
    """``dim`` with a broadcast hint if it is small in rows and in bytes, else as it is.

    A dimension such as the key table grows with the number of customers, so its size is
    looked at (never more than ``max_rows + 1`` rows are read). Few rows may hold long texts or
    arrays, so the length of the rows as JSON is added up as well. Beyond either bound Spark
    shuffles both sides and its adaptive skew join splits a hot key.
    """
    length = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in dim.columns])))
    rows, size = dim.limit(max_rows + 1).agg(
        F.count(F.lit(1)), F.coalesce(F.sum(length.cast("long")), F.lit(0))
    ).first()
    return F.broadcast(dim) if rows <= max_rows and size <= max_bytes else dim
