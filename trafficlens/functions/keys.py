"""API key helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def masked_key(key: Column) -> Column:
    """Keys of more than ten characters show their first five and last four only."""
    return F.when(
        F.length(key) > 10, F.concat(F.substring(key, 1, 5), F.lit("..."), F.right(key, F.lit(4)))
    ).otherwise(key)


def bearer_token(header: Column) -> Column:
    """Key in an authorization header; null when the header is missing or empty."""
    bare = F.when(
        header.startswith("Bearer "), F.replace(header, F.lit("Bearer "), F.lit(""))
    ).otherwise(header)
    return F.when(header != "", bare)
