"""Figures over the request fact: spend, latency, usage and traffic."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens.functions.money import utc_date, utc_day, utc_month
from trafficlens.plans.scratch import materialise
from trafficlens.plans.sides import small_side
from trafficlens.plans.slices import ROWS_PER_SLICE, Running, running

# How a cache answer is marked, and how many recent calls a listing shows.
CACHE_BACKEND = "cache"
RECENT = 50
LATENCY_BOUNDS_MS = (5.0, 10.0, 25.0, 50.0, 75.0, 100.0, 250.0, 500.0, 750.0, 1000.0)


def traffic_kpis(calls: DataFrame) -> DataFrame:
    """Total calls, cache hits and their share, spend and mean latency; zeros when empty."""
    n = F.count(F.lit(1))
    hits = F.count_if(F.col("backend") == CACHE_BACKEND)
    return calls.agg(
        n.alias("total_requests"),
        hits.alias("cache_hits"),
        F.when(n > 0, hits / n * 100).otherwise(0.0).alias("cache_hit_rate_pct"),
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("total_spend_usd"),
        F.coalesce(F.avg("latency_ms"), F.lit(0.0)).alias("avg_latency_ms"),
    )


def spend_per_backend(calls: DataFrame) -> DataFrame:
    return calls.groupBy("backend").agg(F.sum("cost_usd").alias("spend_usd"))


def latency_per_backend(
    calls: DataFrame, exact: bool = True, rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """Mean, median and 95th percentile (interpolated).

    Exactly: calls are counted per latency, the counts are added up along the latencies in
    slices, and the values at the wanted positions are picked, so no task holds a backend's
    values. ``exact=False`` keeps a sketch of fixed size instead and needs a single pass.
    """
    if not exact:
        at = lambda p: F.percentile_approx("latency_ms", p).cast("double")
        return calls.groupBy("backend").agg(
            F.avg("latency_ms").alias("avg_latency_ms"),
            at(0.5).alias("p50_latency_ms"),
            at(0.95).alias("p95_latency_ms"),
        )
    counts = materialise(
        calls.groupBy("backend", "latency_ms").agg(F.count(F.lit(1)).alias("n")), "latencies"
    )
    known = counts.where(F.col("latency_ms").isNotNull())
    totals = counts.groupBy("backend").agg(
        F.sum(F.when(F.col("latency_ms").isNotNull(), F.col("n"))).alias("total"),
        (F.sum(F.col("latency_ms") * F.col("n")) / F.col("total")).alias("avg_latency_ms"),
    )
    placed = running(
        known, "backend", ["latency_ms"], [Running("upto", "sum", F.col("n"))], rows_per_slice
    )
    wanted = {"p50_latency_ms": 0.5, "p95_latency_ms": 0.95}
    held = lambda i: (F.col("upto") > i) & (F.col("upto") - F.col("n") <= i)
    joined = placed.join(small_side(totals.select("backend", "total")), "backend")
    picks, values = [], []
    for name, p in wanted.items():
        place = (F.col("total") - 1) * p
        for side, i in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            picks.append(F.max(F.when(held(i), F.col("latency_ms"))).alias(f"{name}_{side}"))
        lo, hi = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        values.append((lo + (hi - lo) * (place - F.floor(place))).alias(name))
    picked = joined.groupBy("backend").agg(*picks)
    return totals.join(small_side(picked), "backend", "left").select(
        "backend", "avg_latency_ms", *values
    )


def spend_by_period(calls: DataFrame, ts: str = "ts") -> DataFrame:
    """Spend per key and month, and per key, month and day (UTC), in one pass."""
    return (
        calls.select(
            "api_key",
            utc_month(ts).alias("month"),
            utc_day(ts).alias("day"),
            "cost_usd",
        )
        .groupingSets(
            [["api_key", "month", "day"], ["api_key", "month"]], "api_key", "month", "day"
        )
        .agg(
            F.sum("cost_usd").alias("spend_usd"),
            F.when(F.grouping("day") == 0, "day").otherwise("month").alias("period"),
        )
    )


def spend_now(calls: DataFrame, as_of: date, ts: str = "ts") -> DataFrame:
    """Spend of each key today and this month, seen on the day ``as_of``.

    Only that month is read; a period without calls is simply not summed, so nothing needs to be
    reset.
    """
    day = utc_date(ts)
    today = F.lit(as_of)
    first = as_of.replace(day=1)
    if "day" in calls.columns:  # of a fact in day folders only those of the month are opened
        calls = calls.where(F.col("day").cast("date").between(F.lit(first), today))
    return (
        calls.where((day >= F.lit(first)) & (day <= today))
        .groupBy("api_key")
        .agg(
            F.coalesce(F.sum(F.when(day == today, F.col("cost_usd"))), F.lit(0.0)).alias(
                "spend_today"
            ),
            F.sum("cost_usd").alias("spend_month"),
        )
    )


def requests_by_status(calls: DataFrame) -> DataFrame:
    """Calls per backend and status; failed calls are booked on backend ``unknown``."""
    return calls.groupBy(
        F.when(F.col("status") == "error", "unknown").otherwise(F.col("backend")).alias("backend"),
        "status",
    ).agg(F.count(F.lit(1)).alias("n_requests"))


def latency_histogram(
    calls: DataFrame, bounds: Sequence[float] = LATENCY_BOUNDS_MS
) -> DataFrame:
    """Cumulative buckets per backend (``le`` is the upper bound), with count and sum.

    One conditional count per bound, so no row is multiplied.
    """
    at_most = [
        F.count_if(F.col("latency_ms") <= b).alias(f"b{i}") for i, b in enumerate(bounds)
    ]
    total = calls.groupBy("backend").agg(
        *at_most,
        F.count("latency_ms").alias("n_requests"),
        F.sum("latency_ms").alias("latency_sum_ms"),
    )
    buckets = F.array(
        *[
            F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n_at_most"))
            for i, b in enumerate(bounds)
        ],
        F.struct(F.lit(float("inf")).alias("le"), F.col("n_requests").alias("n_at_most")),
    )
    return total.select(
        "backend", F.inline(buckets), "n_requests", "latency_sum_ms"
    )


def token_usage(calls: DataFrame, by: Sequence[str] = ("api_key", "model")) -> DataFrame:
    return calls.groupBy(*by).agg(
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"),
    )


def recent_requests(
    calls: DataFrame, n: int = RECENT, ts: str = "ts", id_col: str = "request_id"
) -> DataFrame:
    """The newest calls; equal times are ordered by id."""
    return (
        calls.select(
            id_col, "api_key", "backend", "model", "cost_usd", "latency_ms", ts
        )
        .orderBy(F.col(ts).desc(), F.col(id_col))
        .limit(n)
    )


def budget_key_drift(configured: DataFrame, stored: DataFrame) -> DataFrame:
    """Keys on one side only: configured but not stored, or stored but no longer configured."""
    left = configured.select("api_key").distinct()
    right = stored.select("api_key").distinct()
    return (
        left.join(right, "api_key", "left_anti")
        .withColumn("drift", F.lit("config_only"))
        .unionByName(
            right.join(left, "api_key", "left_anti").withColumn("drift", F.lit("ledger_only"))
        )
    )
