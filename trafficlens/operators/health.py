"""Backend health: smoothed latency, failure streaks and breaker states."""

from __future__ import annotations

import math
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trafficlens.plans.scratch import materialise
from trafficlens.plans.sides import small_side
from trafficlens.plans.slices import (
    ROWS_PER_SLICE,
    SLICE,
    Running,
    running,
    slices_of,
)

# Smoothing weight, breaker settings, and the gauge code of each state.
EMA_ALPHA = 0.2
FAILURE_THRESHOLD = 3
COOLDOWN_SEC = 30
STATE_CODES = {"CLOSED": 0, "HALF_OPEN": 1, "OPEN": 2}


def seconds(n: float) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(n).cast("decimal(18,6)"))


def breaker_state_code(state: Column) -> Column:
    code = None
    for name, value in STATE_CODES.items():
        code = F.when(state == name, value) if code is None else code.when(state == name, value)
    return code


#: Rows of a block of a moving average at most.
EMA_BLOCK = 4096


def latency_ema(
    calls: DataFrame,
    key: str = "backend",
    order: Sequence[str] = ("ts", "event_id"),
    value: str = "latency_ms",
    alpha: float = EMA_ALPHA,
    rows_per_slice: int = ROWS_PER_SLICE,
    block: int = EMA_BLOCK,
) -> DataFrame:
    """Exponential moving average after each call: the first value as it is, then
    ``alpha * x + (1 - alpha) * previous``, for any alpha from 0 to 1.

    A call without a value leaves the average as it is (null before the first value). Calls are
    numbered per key and cut into blocks; see ``_decayed``.
    """
    if not 0.0 <= alpha <= 1.0:
        raise ValueError("alpha lies between 0 and 1")
    x = F.col(value)
    placed = running(
        calls, key, order, [Running("__n", "sum", x.isNotNull().cast("long"))], rows_per_slice
    ).withColumn("__n", F.col("__n") - 1)
    # a call without a value has the number of the one before it, and adds nothing
    weighed = placed.withColumn("__silent", x.isNull()).withColumn(
        "__v", F.when(x.isNull(), 0.0).when(F.col("__n") == 0, x).otherwise(alpha * x)
    )
    averaged = _decayed(weighed, key, 1.0 - alpha, block)
    return averaged.select(
        *calls.columns, F.when(F.col("__n") >= 0, F.col("__e")).alias("ema")
    )


def _decayed(rows: DataFrame, key: str, keep: float, block: int) -> DataFrame:
    """``rows`` (key, __n from 0, __silent, __v) with ``__e``: the sum of keep**(n - i) * v, i <= n.

    Rows are cut into blocks, each a unit of work, however few keys there are. If a block scales what
    came before it below what a double can show, the sum goes over a row's own block and the one
    before: each row goes to its block and, as context, to the next. Otherwise a block is an affine map
    of the sum before it: (keep**length, own weighted sum). What it takes over is the same sum over
    the blocks before, with keep**length instead of keep, found in the same way over a table that
    is a block's length shorter.
    """
    power = lambda n: F.pow(F.lit(keep), n)
    upto = lambda part: (
        Window.partitionBy(key, part)
        .orderBy("__n", "__silent")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    enough = math.inf if keep == 1.0 else 1
    if 0.0 < keep < 1.0:
        enough = max(1, math.ceil(60 * math.log(2) / -math.log(keep)))
    if enough <= block:
        paired = rows.select(
            "*", F.explode(F.array(F.lit(False), F.lit(True))).alias("__context")
        ).withColumn("__b", F.floor(F.col("__n") / enough) + F.col("__context").cast("long"))
        place = F.col("__n") - (F.col("__b") - 1) * enough
        if keep:
            grown = F.sum(F.col("__v") * power(-place)).over(upto("__b")) * power(place)
        else:
            own = F.when(~F.col("__silent"), F.col("__v"))
            grown = F.last(own, ignorenulls=True).over(upto("__b"))
        return paired.withColumn("__e", grown).where(~F.col("__context")).drop("__context", "__b")
    place = F.pmod(F.col("__n"), F.lit(block))
    placed = rows.withColumn("__b", F.floor(F.col("__n") / block))
    local = placed.withColumn(
        "__e", F.sum(F.col("__v") * power(-place)).over(upto("__b")) * power(place)
    )
    whole = placed.groupBy(key, "__b").agg(
        F.sum(F.col("__v") * power(block - 1 - place)).alias("__v"),
        F.count_if(~F.col("__silent")).alias("__rows"),
    )
    whole = materialise(
        whole.where((F.col("__rows") == block) & (F.col("__b") >= 0)).select(
            key, F.col("__b").alias("__n"), F.lit(False).alias("__silent"), "__v"
        ),
        "blocks",
    )
    if whole.isEmpty():
        return local.drop("__b")
    entered = _decayed(whole, key, keep**block, block).select(
        F.col(key).alias("__k"), (F.col("__n") + 1).alias("__m"), F.col("__e").alias("__in")
    )
    same = F.col(key).eqNullSafe(F.col("__k")) & (F.col("__b") == F.col("__m"))
    joined = local.join(entered, same, "left")
    carried = F.coalesce(F.col("__in") * power(place + 1), F.lit(0.0))
    return joined.withColumn("__e", F.col("__e") + carried).drop("__b", "__k", "__m", "__in")


def failure_streaks(
    outcomes: DataFrame,
    ok: Column,
    key: str = "backend",
    order: Sequence[str] = ("ts", "event_id"),
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Failures in a row up to and including each outcome (0 after a success)."""
    linked = _linked_streaks(outcomes, ok, key, order, rows_per_slice)
    return linked.select(*outcomes.columns, "streak")


def _linked_streaks(outcomes, ok, key, order, rows_per_slice) -> DataFrame:
    """Each outcome with its ``streak``, and time and streak of the outcome before it.

    Inside a slice the streak is the distance to the last success, or to the slice's start when
    there was none yet; then the streak the slice began with is added.
    """
    ts = order[0]
    slices = slices_of(outcomes, key, order, rows_per_slice)
    w = slices.local()
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = (
        slices.assign(outcomes.withColumn("__ok", ok))
        .withColumn("__n", F.row_number().over(w).cast("long"))
        .withColumn("__ok_at", F.max(F.when(F.col("__ok"), F.col("__n"))).over(upto))
        .withColumn("__run", F.col("__n") - F.coalesce("__ok_at", F.lit(0).cast("long")))
        .withColumn(
            "__prev", F.lag(F.struct(ts, F.col("__run"), F.col("__ok_at").isNull().alias("open")))
            .over(w)
        )
    )
    zero = F.lit(0).cast("long")
    if slices.number == 1:
        return local.select(
            *outcomes.columns,
            F.col("__run").alias("streak"),
            F.col(f"__prev.{ts}").alias("__prev_ts"),
            F.coalesce("__prev.__run", zero).alias("__prev_streak"),
        )
    per_slice = slices.spanning(local).groupBy(*slices.part).agg(
        F.count(F.lit(1)).alias("rows"), F.max("__ok_at").alias("ok_at"), F.max(ts).alias("last")
    )
    upto_here = Window.partitionBy(key).orderBy(SLICE)
    per_slice = per_slice.withColumn("total", F.sum("rows").over(upto_here)).withColumn(
        "ok_at", F.col("total") - F.col("rows") + F.col("ok_at")
    )
    carried = slices.carry(
        per_slice,
        {
            "__rows_in": F.sum("rows"),
            "__ok_in": F.max("ok_at"),
            "__ts_in": F.max("last"),
        },
    )
    streak_in = F.coalesce(F.col("__rows_in") - F.coalesce("__ok_in", zero), zero)
    first = F.col("__prev").isNull()
    return slices.bring(local, carried).select(
        *outcomes.columns,
        (F.col("__run") + F.when(F.col("__ok_at").isNull(), streak_in).otherwise(zero)).alias(
            "streak"
        ),
        F.when(first, F.col("__ts_in")).otherwise(F.col(f"__prev.{ts}")).alias("__prev_ts"),
        F.when(first, streak_in)
        .otherwise(
            F.col("__prev.__run") + F.when(F.col("__prev.open"), streak_in).otherwise(zero)
        )
        .alias("__prev_streak"),
    )


def breaker_trace(
    outcomes: DataFrame,
    ok: Column,
    key: str = "backend",
    order: Sequence[str] = ("ts", "event_id"),
    threshold: int = FAILURE_THRESHOLD,
    cooldown_sec: float = COOLDOWN_SEC,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Breaker state before and after each observed outcome.

    The failure count starts over at a success only, so the state after an outcome follows from
    the streak; an open breaker whose cooldown has passed is half open for the next call.
    """
    linked = _linked_streaks(outcomes, ok, key, order, rows_per_slice)
    cooled = F.col(order[0]) - F.col("__prev_ts") >= seconds(cooldown_sec)
    return linked.select(
        *outcomes.columns,
        "streak",
        F.when(F.col("__prev_streak") < threshold, "CLOSED")
        .when(cooled, "HALF_OPEN")
        .otherwise("OPEN")
        .alias("state_before"),
        F.when(F.col("streak") >= threshold, "OPEN").otherwise("CLOSED").alias("state_after"),
    )


def breaker_states(
    outcomes: DataFrame,
    ok: Column,
    key: str = "backend",
    order: Sequence[str] = ("ts", "event_id"),
    threshold: int = FAILURE_THRESHOLD,
    as_of: datetime | None = None,
) -> DataFrame:
    """Stored breaker state per backend after all outcomes up to ``as_of``.

    Two map-side combined aggregates: the last success per backend, then the failures after it.
    """
    ts = order[0]
    log = outcomes.withColumn("__ok", ok)
    if as_of is not None:
        log = log.where(F.col(ts) <= F.lit(as_of).cast("timestamp_ntz"))
    point = F.struct(*order)
    last_ok = log.groupBy(key).agg(F.max(F.when(F.col("__ok"), point)).alias("__last_ok"))
    later = ~F.col("__ok") & (F.col("__last_ok").isNull() | (point > F.col("__last_ok")))
    return (
        log.join(small_side(materialise(last_ok, "last-success")), key)
        .groupBy(key)
        .agg(
            F.count_if(later).alias("consecutive_failures"),
            F.max(F.when(later, F.col(ts))).alias("last_failure_time"),
        )
        .select(
            key,
            F.when(F.col("consecutive_failures") >= threshold, "OPEN")
            .otherwise("CLOSED")
            .alias("state"),
            "consecutive_failures",
            "last_failure_time",
        )
    )


def available_backends(
    backends: DataFrame,
    states: DataFrame,
    as_of: datetime,
    cooldown_sec: float = COOLDOWN_SEC,
) -> DataFrame:
    """Backends with the answer of their breaker at ``as_of`` and the state it leaves."""
    at = F.lit(as_of).cast("timestamp_ntz")
    state = F.coalesce("state", F.lit("CLOSED"))
    cooled = at - F.col("last_failure_time") >= seconds(cooldown_sec)
    allowed = (state == "CLOSED") | ((state == "OPEN") & F.coalesce(cooled, F.lit(True)))
    return (
        backends.join(small_side(materialise(states, "states")), "backend", "left")
        .withColumn("available", allowed)
        .withColumn(
            "state", F.when((state == "OPEN") & F.col("available"), "HALF_OPEN").otherwise(state)
        )
        .drop("consecutive_failures", "last_failure_time")
    )


def backend_health_board(
    backends: DataFrame, states: DataFrame, probes: DataFrame, order: Sequence[str] = ("ts",)
) -> DataFrame:
    """Per backend: model, last health probe and breaker state (CLOSED when none is stored)."""
    last = probes.groupBy("backend").agg(
        F.max_by("healthy", F.struct(*order)).alias("healthy")
    )
    states = materialise(states.select("backend", "state"), "states")
    last = materialise(last, "probes")
    return (
        backends.join(small_side(states), "backend", "left")
        .join(small_side(last), "backend", "left")
        .withColumn("state", F.coalesce("state", F.lit("CLOSED")))
    )


def breaker_gauge(states: DataFrame, order: Sequence[str]) -> DataFrame:
    """Current gauge code per backend from a log of states."""
    return states.groupBy("backend").agg(
        F.max_by(breaker_state_code(F.col("state")), F.struct(*order)).alias("code")
    )
