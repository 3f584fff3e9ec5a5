"""Prices, token estimates and costs of calls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens.functions.money import call_cost, tokens_from_chars, utc_day, utc_month
from trafficlens.plans.sides import small_side

# Fixed value: completion length assumed for a request that names none.
DEFAULT_MAX_TOKENS = 256


def requests_with_price(calls: DataFrame, backends: DataFrame) -> DataFrame:
    """Calls with the prices of the backend that served them; null where none is listed."""
    prices = backends.select("backend", "cost_per_1k_prompt", "cost_per_1k_completion")
    return calls.join(small_side(prices), "backend", "left")


def request_cost(calls: DataFrame, backends: DataFrame, name: str = "cost_usd") -> DataFrame:
    """Cost of each call; a call that no listed backend served costs nothing."""
    priced = requests_with_price(calls, backends)
    cost = call_cost(
        "prompt_tokens", "completion_tokens", "cost_per_1k_prompt", "cost_per_1k_completion"
    )
    return priced.withColumn(name, F.coalesce(cost, F.lit(0.0)))


def token_estimate(messages: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """Estimated prompt tokens of all messages of a request together."""
    return messages.groupBy(*keys).agg(
        tokens_from_chars(F.sum(F.coalesce(F.length(text), F.lit(0)))).alias("token_estimate")
    )


def preflight_cost(requests: DataFrame, first_backend: DataFrame) -> DataFrame:
    """Expected cost of a request at its first-ranked backend; 0 when none is available.

    ``requests`` has prompt_tokens and max_tokens, ``first_backend`` request_id and backend
    prices.
    """
    joined = requests.join(first_backend, "request_id", "left")
    completion = F.coalesce("max_tokens", F.lit(DEFAULT_MAX_TOKENS))
    cost = F.col("prompt_tokens") / 1000.0 * F.col("cost_per_1k_prompt") + (
        completion / 1000.0 * F.col("cost_per_1k_completion")
    )
    return joined.withColumn("estimate_usd", F.coalesce(cost, F.lit(0.0)))


def utc_period_keys(calls: DataFrame, ts: str = "ts") -> DataFrame:
    return calls.withColumn("day", utc_day(ts)).withColumn("month", utc_month(ts))
