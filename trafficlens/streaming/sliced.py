"""Micro-batches decided by the batch operators, for streams with few or hot keys.

Keyed state lives on one task per key, so a stream of three backends would keep three tasks busy. Here
each micro-batch is decided by the batch operator, which cuts a hot key into slices, over the new rows and
a few rows carried over from earlier ones: those that make the operator decide as if it had seen all.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trafficlens.operators.admission import RATE_WINDOW_SEC, rate_limit_decisions
from trafficlens.operators.health import COOLDOWN_SEC, FAILURE_THRESHOLD, breaker_trace
from trafficlens.plans.scratch import materialise
from trafficlens.plans.sides import small_side
from trafficlens.plans.slices import ROWS_PER_SLICE

NEW, LAST = "new_row_", "last_place_"


def run_sliced(
    rows: DataFrame,
    decide: Callable[[DataFrame], DataFrame],
    carry: Callable[[DataFrame], DataFrame],
    key: str,
    order: Sequence[str],
    decisions: Sequence[str],
    path: str,
    checkpoint: str,
    trigger: dict | None = None,
):
    """Start a stream whose micro-batches ``decide`` sees whole, and return the running query.

    ``decide`` adds the ``decisions`` to all columns it is given; ``carry`` takes what it returned and
    keeps the rows of each key that later decisions need, the key's last one among them. A row that
    is not later than the last one of its key, and a row without a time, is written undecided, the
    former with ``late`` set. Results are under ``path/decided``, a folder per micro-batch; the carried
    rows are in two tables that take turns, so a retried batch finds what it began with.
    """
    place = F.struct(*order)

    def book(batch: DataFrame, batch_id: int) -> None:
        spark, columns = batch.sparkSession, batch.columns
        fresh = materialise(batch, "sliced-batch").withColumn(NEW, F.lit(True))
        held = None
        if batch_id > 0:
            held = spark.read.schema(batch.schema).parquet(f"{path}/carried/{(batch_id - 1) % 2}")
            last = held.groupBy(F.col(key).alias("key_")).agg(F.max(place).alias(LAST))
            same = F.col(key).eqNullSafe(F.col("key_"))
            judged = fresh.join(small_side(last), same, "left").withColumn(
                "late", F.coalesce(place <= F.col(LAST), F.lit(False))).drop("key_", LAST)
        else:
            judged = fresh.withColumn("late", F.lit(False))
        apart = F.col("late") | F.col(order[0]).isNull()
        timely = judged.where(~apart).drop("late")
        if held is not None:
            timely = timely.unionByName(held.withColumn(NEW, F.lit(False)))
        decided = materialise(
            decide(timely).select(*columns, NEW, *decisions), "sliced-decisions")
        out = decided.where(NEW).drop(NEW).withColumn("late", F.lit(False))
        passed = judged.where(apart).drop(NEW).select(
            *columns, *[F.lit(None).cast(decided.schema[c].dataType).alias(c) for c in decisions], "late")
        out.unionByName(passed).write.mode("overwrite").parquet(f"{path}/decided/batch={batch_id}")
        carry(decided).select(*columns).write.mode("overwrite").parquet(
            f"{path}/carried/{batch_id % 2}")

    return (
        rows.writeStream.foreachBatch(book)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def sliced_breaker_transitions(
    outcomes: DataFrame,
    ok: Column,
    path: str,
    checkpoint: str,
    key: str = "backend",
    order: Sequence[str] = ("ts", "event_id"),
    threshold: int = FAILURE_THRESHOLD,
    cooldown_sec: float = COOLDOWN_SEC,
    rows_per_slice: int = ROWS_PER_SLICE,
    trigger: dict | None = None,
):
    """State of each backend's breaker before and after every outcome.

    The last ``threshold`` outcomes of a backend are carried over: they tell whether its breaker is
    open, how many failures it has counted and when the last one was.
    """
    latest = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])

    def decide(rows: DataFrame) -> DataFrame:
        return breaker_trace(rows, ok, key, order, threshold, cooldown_sec, rows_per_slice)

    def carry(decided: DataFrame) -> DataFrame:
        # only the first ranks are asked for, so tasks keep no more than those before the shuffle
        return decided.withColumn("rank_", F.row_number().over(latest)).where(
            F.col("rank_") <= threshold)

    return run_sliced(outcomes, decide, carry, key, order, ["state_before", "state_after"], path,
                      checkpoint, trigger)


def sliced_rate_limit(
    calls: DataFrame,
    path: str,
    checkpoint: str,
    budgets: DataFrame | None = None,
    limit: int | None = None,
    window_sec: float = RATE_WINDOW_SEC,
    order: Sequence[str] = ("ts", "event_id"),
    max_group_rows: int | None = None,
    rows_per_slice: int = ROWS_PER_SLICE,
    trigger: dict | None = None,
):
    """``allowed`` per call, as ``rate_limit_decisions`` says.

    Carried over are the calls allowed within one window before a key's last call, and that call.
    The former are no more than the limit, so the operator allows them again.
    """
    ts, place = order[0], F.struct(*order)
    window = F.expr(f"interval {int(window_sec * 1_000_000)} microsecond")
    walk = {"rows_per_slice": rows_per_slice}
    if max_group_rows is not None:
        walk["max_group_rows"] = max_group_rows

    def decide(rows: DataFrame) -> DataFrame:
        return rate_limit_decisions(rows, budgets, limit, window_sec, order, rows.columns, **walk)

    def carry(decided: DataFrame) -> DataFrame:
        last = decided.groupBy(F.col("api_key").alias("key_")).agg(F.max(place).alias(LAST))
        same = F.col("api_key").eqNullSafe(F.col("key_"))
        near = F.col("allowed") & (F.col(ts) > F.col(f"{LAST}.{ts}") - window)
        return decided.join(small_side(last), same).where(near | (place == F.col(LAST)))

    return run_sliced(calls, decide, carry, "api_key", order, ["allowed"], path, checkpoint, trigger)


def read_decided(spark, path: str, schema: T.StructType | None = None) -> DataFrame:
    """All rows of a sliced stream with their decisions and ``late``."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{path}/decided").drop("batch")
