"""Structured Streaming jobs over model-API traffic.

Each function takes a streaming DataFrame and returns one; ``run_to_table`` starts it with a
checkpoint and an exactly-once file sink.
"""

from __future__ import annotations

import json
import threading
from collections.abc import Sequence
from datetime import timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trafficlens.functions.money import utc_date, utc_day
from trafficlens.functions.text import first_injection, redacted
from trafficlens.operators.admission import DEFAULT_RATE, RATE_WINDOW_SEC, Purse, SlidingLog
from trafficlens.operators.health import COOLDOWN_SEC, FAILURE_THRESHOLD
from trafficlens.operators.reuse import TTL_SEC
from trafficlens.plans.sides import small_side
from trafficlens.streaming.stateful import walk_stream

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


EVENT_TIME = "event_time_"
#: Whatever the day, so much later it is another month.
MONTH_MS = 31 * 86_400_000


def _with_event_time(rows: DataFrame, ts: str) -> DataFrame:
    """Watermarks need a time stamp with a zone; times without one are taken in the session's."""
    return rows.withColumn(EVENT_TIME, F.col(ts).cast("timestamp"))


def run_to_table(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    partition_by: Sequence[str] = (),
    trigger: dict | None = None,
):
    """Start a stream into a parquet table and return the running query."""
    spark = stream.sparkSession
    if spark.conf.get(PROVIDER, None) != ROCKSDB:
        spark.conf.set(PROVIDER, ROCKSDB)  # keyed state needs it
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .partitionBy(*partition_by)
        .outputMode("append")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def run_to_keyed_table(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Start an aggregating stream that writes what changed in each batch to a folder of its own.

    ``read_keyed_table`` takes the newest row of each key, so open windows are there as well. A
    retried batch overwrites its folder.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .outputMode("update")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_keyed_table(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    newest = F.max_by(F.struct(*values), F.col("batch").cast("long")).alias("v")
    return rows.groupBy(*keys).agg(newest).select(*keys, "v.*")


#: Parts of the ids of a ledger.
ID_BUCKETS = 64


def stream_ledger_ingest(
    calls: DataFrame,
    ledger_path: str,
    checkpoint: str,
    ts: str = "timestamp",
    id_col: str = "id",
    repeat_horizon_days: int | None = None,
    trigger: dict | None = None,
    buckets: int = ID_BUCKETS,
):
    """Append calls to the ledger in day folders, each id once, however late a call comes.

    Of the calls with one id in a batch the earliest is taken, unless the ledger has the id. Booked ids
    are looked up in an index beside the ledger, ``<ledger>-ids``: ids alone, in ``bucket=/run=`` folders by
    their hash, of which a batch opens those its own ids fall into. Where the source promises not to
    repeat an id after more than ``repeat_horizon_days``, the day folders around the batch are read
    instead. Each batch writes to folders named after the query and the batch; a retry overwrites them,
    and a query with another checkpoint has another name, so neither books a call twice nor loses one.
    Ids are booked after their calls; what a query that was stopped in between has left out is made up
    for when the next one starts, as is the index of a ledger that has none. Two queries that run at the
    same time do not see each other's open batches. The index gets a file per bucket and batch.
    """
    started, name = threading.Event(), []
    index_path = ledger_path.rstrip("/") + "-ids"
    bucket = F.pmod(F.xxhash64(id_col), F.lit(buckets)).cast("int")

    def index(rows: DataFrame) -> None:
        rows.select(id_col, "run", bucket.alias("bucket")).repartition("bucket").write.mode(
            "overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "bucket", "run").parquet(index_path)

    def book(batch: DataFrame, batch_id: int) -> None:
        started.wait()
        spark, run = batch.sparkSession, f"{name[0]}-{batch_id}"
        first = batch.groupBy(id_col).agg(
            F.min_by(F.struct(*batch.columns), F.struct(F.col(ts).isNull(), ts)).alias("r")
        ).select("r.*").withColumn("day", utc_date(ts)).withColumn("run", F.lit(run))
        if repeat_horizon_days is not None:
            booked = _booked(spark, ledger_path, first.schema)
            low, high = first.agg(F.min("day"), F.max("day")).first()
            if booked is not None and low is not None:
                wide = timedelta(days=repeat_horizon_days)
                near = F.col("day").between(F.lit(low - wide), F.lit(high + wide))
                booked = booked.where(near | F.col("day").isNull())
        else:
            booked = booked_ids(spark, ledger_path, batch, id_col, buckets)
        if booked is not None:
            known = booked.where(F.col("run") != run).select(id_col)
            first = first.join(known, id_col, "left_anti").select(*first.columns)
        first.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "day", "run"
        ).parquet(ledger_path)
        rows = _booked(spark, ledger_path, first.schema)
        if rows is not None:
            index(rows.where(F.col("run") == run))

    spark = calls.sparkSession
    rows = _booked(spark, ledger_path, T.StructType(
        [calls.schema[id_col], T.StructField("run", T.StringType())]))
    if rows is not None:
        runs = rows.select("run").distinct()
        ids = _booked(spark, index_path, T.StructType(
            [calls.schema[id_col], T.StructField("run", T.StringType())]))
        left = runs if ids is None else runs.join(ids.select("run").distinct(), "run", "left_anti")
        if not left.isEmpty():
            index(rows.join(small_side(left), "run", "left_semi"))

    query = (
        calls.writeStream.foreachBatch(book)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
    name.append(query.id)  # kept in the checkpoint, so a restart has it again
    started.set()
    return query


def booked_ids(spark: SparkSession, ledger_path: str, rows: DataFrame, id_col: str,
               buckets: int = ID_BUCKETS) -> DataFrame | None:
    """(id, run, bucket) of the ledger's index, from the buckets that ids of ``rows`` fall into."""
    schema = T.StructType([rows.schema[id_col], T.StructField("run", T.StringType()),
                           T.StructField("bucket", T.IntegerType())])
    ids = _booked(spark, ledger_path.rstrip("/") + "-ids", schema)
    if ids is None:
        return None
    bucket = F.pmod(F.xxhash64(id_col), F.lit(buckets)).cast("int")
    here = [r[0] for r in rows.select(bucket).distinct().collect()]  # as many as there are buckets
    return ids.where(F.col("bucket").isin(here))


def _booked(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    """What a table has so far, or nothing before its first batch."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def stream_rate_limit(
    calls: DataFrame,
    budgets: DataFrame | None = None,
    limit: int | None = None,
    window_sec: float = RATE_WINDOW_SEC,
    order: Sequence[str] = ("ts", "event_id"),
    keep: Sequence[str] = ("event_id", "api_key", "ts"),
    ttl_ms: int | None = None,
    delay: str | None = None,
) -> DataFrame:
    """Sliding-window decisions per key; ``delay`` lets calls come out of order by that much."""
    if limit is None and budgets is not None:
        rates = budgets.select("api_key", F.col("requests_per_minute").alias("__rate"))
        calls = calls.join(small_side(rates), "api_key", "left")
        rate = F.coalesce("__rate", F.lit(DEFAULT_RATE))
    else:
        rate = F.lit(DEFAULT_RATE if limit is None else limit)
    window_us = int(window_sec * 1_000_000)
    return walk_stream(
        calls.withColumn("limit_", rate.cast("long")), "api_key", order, keep, "allowed",
        T.BooleanType(), lambda: SlidingLog(order[0], "limit_", window_us), ttl_ms,
        delay=delay, forget_ms=-(-window_us // 1000),
    )


def stream_prompt_reuse(
    calls: DataFrame,
    key: str = "prompt_key",
    ttl_sec: float = TTL_SEC,
    order: Sequence[str] = ("ts", "event_id"),
    keep: Sequence[str] = ("event_id", "ts"),
    ttl_ms: int | None = None,
    delay: str | None = None,
) -> DataFrame:
    """Whether each prompt was answered from what was stored; ``delay`` as in ``stream_rate_limit``."""
    window_us = int(ttl_sec * 1_000_000) + 1
    stored = walk_stream(
        calls.withColumn("limit_", F.lit(1).cast("long")), key, order, [*keep, key], "stored",
        T.BooleanType(), lambda: SlidingLog(order[0], "limit_", window_us), ttl_ms,
        delay=delay, forget_ms=-(-window_us // 1000),
    )
    return stored.select(*keep, key, (~F.col("stored")).alias("hit"), "late")


def stream_budget_spend(
    calls: DataFrame,
    budgets: DataFrame,
    estimate: str = "budget_cost_usd",
    cost: str = "budget_cost_usd",
    order: Sequence[str] = ("ts", "event_id"),
    keep: Sequence[str] = ("event_id", "api_key", "ts"),
    delay: str | None = None,
) -> DataFrame:
    """Budget verdicts against a snapshot of the budgets; keys without one are denied.

    ``delay`` as in ``stream_rate_limit``.
    """
    ts = order[0]
    limits = budgets.select("api_key", "daily_limit_usd", "monthly_limit_usd").withColumn(
        "known_", F.lit(True)
    )
    priced = calls.join(small_side(limits), "api_key", "left").select(
        *dict.fromkeys([*keep, "api_key", *order, estimate, cost]),
        F.coalesce("daily_limit_usd", F.lit(0.0)).alias("daily"),
        F.coalesce("monthly_limit_usd", F.lit(0.0)).alias("monthly"),
        F.coalesce(utc_day(ts), F.lit("")).alias("day_"),
        F.coalesce("known_", F.lit(False)).alias("known_"),
    )
    names = {"day": "day_", "estimate": estimate, "cost": cost,
             "daily": "daily", "monthly": "monthly"}
    return walk_stream(
        priced, "api_key", order, keep, "decision", T.StringType(),
        lambda: RollingPurse(names), delay=delay, forget_ms=MONTH_MS,
    )


class RollingPurse(Purse):
    """A purse kept over months: the monthly part starts over with each month."""

    def walk(self, rows: dict[str, list]) -> list[str]:
        out: list[str] = []
        days, known = rows[self.c["day"]], rows["known_"]
        i = 0
        while i < len(days):
            month = days[i][:7]
            end = i
            while end < len(days) and days[end][:7] == month:
                end += 1
            if self.day is None or self.day[:7] != month:
                self.day, self.day_spend, self.month_spend = None, 0.0, 0.0
            if known[i]:
                out.extend(super().walk({c: v[i:end] for c, v in rows.items()}))
            else:
                out.extend(["no_budget"] * (end - i))
            i = end
        return out


class BreakerWalker:
    """State of one backend's breaker; says something only when the state changes."""

    def __init__(self, ts: str, ok: str, threshold: int, cooldown_us: int):
        self.ts, self.ok, self.threshold, self.cooldown = ts, ok, threshold, cooldown_us
        self.load(None)

    def load(self, state: str | None) -> None:
        self.state, self.failures, self.last_failure = (
            json.loads(state) if state else ["CLOSED", 0, None]
        )

    def dump(self) -> str:
        return json.dumps([self.state, self.failures, self.last_failure])

    def walk(self, rows: dict[str, list]) -> list[str | None]:
        out = []
        for now, ok in zip(rows[self.ts], rows[self.ok]):
            before = self.state
            if before == "OPEN" and now - self.last_failure >= self.cooldown:
                before = "HALF_OPEN"
            if ok:
                self.state, self.failures, self.last_failure = "CLOSED", 0, None
            else:
                self.failures += 1
                self.last_failure = now
                if before == "HALF_OPEN" or self.failures >= self.threshold:
                    self.state = "OPEN"
            out.append(None if before == self.state else f"{before}->{self.state}")
        return out


def stream_breaker_transitions(
    outcomes: DataFrame,
    ok: Column,
    key: str = "backend",
    order: Sequence[str] = ("ts", "event_id"),
    threshold: int = FAILURE_THRESHOLD,
    cooldown_sec: float = COOLDOWN_SEC,
    delay: str | None = None,
) -> DataFrame:
    """Changes of breaker state per backend. Failed health probes come in as failures;
    successful probes are not outcomes and must be left out. ``delay`` as in ``stream_rate_limit``;
    a backend is never forgotten."""
    cooldown_us = int(cooldown_sec * 1_000_000)
    return walk_stream(
        outcomes.withColumn("ok_", ok), key, order, [*order[1:], key, order[0]], "transition",
        T.StringType(), lambda: BreakerWalker(order[0], "ok_", threshold, cooldown_us),
        only_changes=True, delay=delay,
    )


def stream_traffic_kpis(
    calls: DataFrame, ts: str = "ts", width: str = "1 hour", delay: str = "10 minutes"
) -> DataFrame:
    """Calls, cost and mean latency per window, backend and status.

    Written by ``run_to_table``, a window is given out once the watermark has passed its end;
    ``run_to_keyed_table`` has the open windows too.
    """
    return (
        _with_event_time(calls, ts)
        .withWatermark(EVENT_TIME, delay)
        .groupBy(F.window(EVENT_TIME, width).alias("w"), "backend", "status")
        .agg(
            F.count(F.lit(1)).alias("n_requests"),
            F.sum("cost_usd").alias("spend_usd"),
            F.avg("latency_ms").alias("avg_latency_ms"),
        )
        .select(
            F.col("w.start").cast(calls.schema[ts].dataType).alias("window_start"), "backend", "status", "n_requests",
            "spend_usd", "avg_latency_ms",
        )
    )


def stream_redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """Redacted text with a ``quarantined`` flag, decided on the raw text; partition the sink by
    the flag to keep violations apart."""
    return docs.withColumn("quarantined", first_injection(F.col(text)).isNotNull()).withColumn(
        text, redacted(F.col(text))
    )
