"""Request ledger, budgets, breakers and the backend catalogue: reading and updating."""

from __future__ import annotations

import os
from collections.abc import Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficlens.functions.money import utc_date
from pyspark.sql import types as T

REQUEST_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("id", "api_key", "backend", "model")]
    + [T.StructField(c, T.LongType()) for c in ("prompt_tokens", "completion_tokens")]
    + [T.StructField(c, T.DoubleType()) for c in ("cost_usd", "latency_ms")]
    + [T.StructField("timestamp", T.TimestampNTZType())]
)
BUDGET_SCHEMA = "api_key string, daily_limit_usd double, monthly_limit_usd double, requests_per_minute int"
BREAKER_SCHEMA = "backend string, state string, consecutive_failures long, last_failure_time timestamp_ntz"
BACKEND_SCHEMA = (
    "backend string, cfg_idx int, provider string, model string, endpoint string, "
    "cost_per_1k_prompt double, cost_per_1k_completion double, capabilities array<string>, "
    "context_length long"
)
# Providers with a known wire format, and defaults for settings left out.
PROVIDERS = ("openai", "anthropic", "local_vllm")
DEFAULT_STRATEGY = "cost_first"
DEFAULT_RPM = 60


def load_requests(spark: SparkSession, path: str) -> DataFrame:
    """The request fact. Written partitioned by ``day``, date filters prune whole folders."""
    return spark.read.schema(REQUEST_SCHEMA).parquet(path)


def write_requests(calls: DataFrame, path: str) -> None:
    """Append to the fact. Rows are gathered by day for few files; a busy day is split."""
    calls.withColumn("day", utc_date("timestamp")).hint("rebalance", "day").write.mode(
        "append"
    ).partitionBy("day").parquet(path)


def load_budgets(budgets: DataFrame, spend: DataFrame | None = None) -> DataFrame:
    """Limits per key; with ``spend`` (api_key, spend_today, spend_month) the spend listing."""
    if spend is None:
        return budgets.select(
            "api_key", F.coalesce("requests_per_minute", F.lit(DEFAULT_RPM)).alias(
                "requests_per_minute")
        )
    return budgets.join(spend, "api_key", "left").select(
        "api_key",
        "daily_limit_usd",
        F.coalesce("spend_today", F.lit(0.0)).alias("spend_today"),
        "monthly_limit_usd",
        F.coalesce("spend_month", F.lit(0.0)).alias("spend_month"),
    )


def load_breakers(states: DataFrame) -> DataFrame:
    return states.select("backend", "state", "consecutive_failures", "last_failure_time")


def local_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Rows of a settings file as a relation kept in the plan, which needs no job to read."""
    names = [f.name for f in T.StructType.fromDDL(schema)]
    columns = list(zip(*rows)) or [()] * len(names)
    return spark.createDataFrame(
        pa.table({n: pa.array(list(c)) for n, c in zip(names, columns)}), schema
    )


def _read_yaml(path: str) -> dict[str, Any]:
    try:
        import yaml
    except ImportError as missing:
        raise RuntimeError("reading YAML settings needs the yaml module") from missing
    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def backends_from(spark: SparkSession, entries: Sequence[dict[str, Any]]) -> DataFrame:
    """Catalogue rows in configured order; entries of unknown providers are left out."""
    known = [e for e in entries if e.get("provider") in PROVIDERS]
    rows = [
        (
            e["id"], i, e["provider"], e["model"], e.get("endpoint", ""),
            float(e.get("cost_per_1k_prompt", 0.0)), float(e.get("cost_per_1k_completion", 0.0)),
            list(e.get("capabilities") or []), e.get("context_length"),
        )
        for i, e in enumerate(known)
    ]
    return local_table(spark, rows, BACKEND_SCHEMA)


def load_backends(spark: SparkSession, config_dir: str) -> DataFrame:
    path = os.path.join(config_dir, "backends.yaml")
    entries = _read_yaml(path).get("backends", []) if os.path.exists(path) else []
    return backends_from(spark, entries)


def load_strategy(config_dir: str) -> str:
    path = os.path.join(config_dir, "routing_policy.yaml")
    routing = _read_yaml(path).get("routing", {}) if os.path.exists(path) else {}
    return routing.get("strategy", DEFAULT_STRATEGY)


def load_budget_config(spark: SparkSession, config_dir: str) -> DataFrame:
    path = os.path.join(config_dir, "budgets.yaml")
    entries = _read_yaml(path).get("budgets", []) if os.path.exists(path) else []
    rows = [
        (b["api_key"], float(b["daily_limit_usd"]), float(b["monthly_limit_usd"]),
         b.get("requests_per_minute", DEFAULT_RPM))
        for b in entries
    ]
    return local_table(spark, rows, BUDGET_SCHEMA)


def new_ledger_rows(ledger: DataFrame, calls: DataFrame, order: Sequence[str],
                    id_col: str = "id") -> DataFrame:
    """Calls to append: the first per id, unless the ledger already has that id.

    ``min_by`` combines before the shuffle, so an id repeated very often stays one row per task.
    """
    first = calls.groupBy(id_col).agg(
        F.min_by(F.struct(*calls.columns), F.struct(*order)).alias("r")
    )
    return first.select("r.*").join(ledger.select(id_col), id_col, "left_anti")


def append_ledger(ledger: DataFrame, calls: DataFrame, order: Sequence[str],
                  id_col: str = "id") -> DataFrame:
    """Ledger after appending; ids stay unique, a duplicate is dropped."""
    fresh = new_ledger_rows(ledger, calls, order, id_col)
    return ledger.unionByName(fresh.select(*ledger.columns))


def upsert_budgets(base: DataFrame, changes: DataFrame) -> DataFrame:
    """Budget table after an ordered list of changes (seq, source, key, limits, rpm).

    A ``config`` change sets the rate to 60 when it names none; an ``admin`` change keeps the
    rate in force. Keys are never deleted. ``was_update`` tells whether the key existed before
    its last change; it is null for keys without a change.
    """
    rate = F.when(
        F.col("source") == "config", F.coalesce("requests_per_minute", F.lit(DEFAULT_RPM))
    ).otherwise(F.col("requests_per_minute"))
    latest = (
        changes.withColumn("rate", rate)
        .groupBy("api_key")
        .agg(
            F.max_by(F.struct("daily_limit_usd", "monthly_limit_usd"), "seq").alias("lim"),
            F.max_by("rate", F.when(F.col("rate").isNotNull(), F.col("seq"))).alias("rate"),
            F.count(F.lit(1)).alias("n"),
        )
    )
    old = base.select(
        "api_key",
        F.col("daily_limit_usd").alias("old_daily"),
        F.col("monthly_limit_usd").alias("old_monthly"),
        F.col("requests_per_minute").alias("old_rate"),
        F.lit(True).alias("existed"),
    )
    return old.join(latest, "api_key", "full_outer").select(
        "api_key",
        F.when(F.col("lim").isNull(), F.col("old_daily"))
        .otherwise(F.col("lim.daily_limit_usd")).alias("daily_limit_usd"),
        F.when(F.col("lim").isNull(), F.col("old_monthly"))
        .otherwise(F.col("lim.monthly_limit_usd")).alias("monthly_limit_usd"),
        F.coalesce("rate", "old_rate", F.lit(DEFAULT_RPM)).alias("requests_per_minute"),
        F.when(F.col("n").isNotNull(), F.coalesce("existed", F.lit(False)) | (F.col("n") > 1))
        .alias("was_update"),
    )


def upsert_breakers(states: DataFrame, order: Sequence[str]) -> DataFrame:
    """The last written state per backend."""
    return (
        states.groupBy("backend")
        .agg(
            F.max_by(
                F.struct("state", "consecutive_failures", "last_failure_time"), F.struct(*order)
            ).alias("s")
        )
        .select("backend", "s.*")
    )
