"""Price and period helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def call_cost(prompt_tokens, completion_tokens, prompt_price, completion_price) -> Column:
    """Cost in USD of a call, with prices per thousand tokens."""
    return F.col(prompt_tokens) / 1000.0 * F.col(prompt_price) + F.col(
        completion_tokens
    ) / 1000.0 * F.col(completion_price)


def tokens_from_chars(chars: Column) -> Column:
    """Token estimate: four characters per token, cut down to a whole number, at least one."""
    return F.greatest(F.lit(1).cast("long"), F.floor(chars / 4.0).cast("long"))


def utc_time(ts: str) -> Column:
    """Wall-clock time in UTC, whatever the zone of the session.

    A time without a zone is taken to be in UTC already. The type of the column is known when the
    query is planned, so one of the two branches remains.
    """
    at = F.col(ts)
    since = F.unix_micros(at.cast("timestamp")).cast("decimal(18,0)") / F.lit(1_000_000)
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    zoned = epoch + F.make_dt_interval(secs=since.cast("decimal(18,6)"))
    return F.when(F.typeof(at) == "timestamp", zoned).otherwise(at.cast("timestamp_ntz"))


def utc_date(ts: str) -> Column:
    return F.to_date(utc_time(ts))


def utc_day(ts: str) -> Column:
    return F.date_format(utc_time(ts), "yyyy-MM-dd")


def utc_month(ts: str) -> Column:
    return F.date_format(utc_time(ts), "yyyy-MM")


def has_limit(limit: Column) -> Column:
    """A limit of null or zero means unlimited."""
    return F.coalesce(limit, F.lit(0.0)) != 0.0
