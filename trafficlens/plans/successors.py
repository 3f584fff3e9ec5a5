"""A sliding log with room for one, of groups that no task should walk alone.

While an accepted row lives, no other is accepted; so the row accepted next is a function of the one
accepted last: the first that comes ``window`` or more after it. Numbered along a group, that
successor is one more than the rows before its time, a running count. The accepted rows are the
chain of successors from the first row on. It is found by pointer doubling: tables of the 1st, 2nd,
4th, ... successor, each composed of the one before and kept only for rows that are such a successor
of some row, which soon are few; then the chain is laid out from the longest stride to the shortest.
The rounds grow with the logarithm of the chain's length, and everything is keyed by (group, number).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens.plans.scratch import materialise
from trafficlens.plans.sides import small_side
from trafficlens.plans.slices import ROWS_PER_SLICE, Running, running

NAME, AT, TO, SIDE, ABLE = "__name", "__at", "__to", "__side", "__able"


def chain(successors: DataFrame, firsts: DataFrame) -> DataFrame:
    """(name, at) of all that ``firsts`` (name, at) lead to, themselves included.

    ``successors`` (name, at, to) has at most one row per (name, at), with ``to`` above ``at``.
    """
    strides = [successors]
    while True:
        t = strides[-1]
        met = t.select(NAME, F.col(TO).alias(AT)).unionByName(firsts).distinct()
        ahead = t.select(NAME, F.col(AT).alias(TO), F.col(TO).alias("__then"))
        twice = materialise(
            t.join(met, [NAME, AT], "left_semi").join(ahead, [NAME, TO])
            .select(NAME, AT, F.col("__then").alias(TO)), "strides")
        if twice.isEmpty():
            break
        strides.append(twice)
    found = firsts
    for t in reversed(strides):
        after = found.join(t, [NAME, AT]).select(NAME, F.col(TO).alias(AT))
        found = materialise(found.unionByName(after), "chain")
    return found


def one_at_a_time(
    rows: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    keep: Sequence[str],
    window_us: int,
    decision: str,
    counts: str | None = None,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """``keep`` columns and ``decision`` per row: no row of the group accepted in the window before.

    Rows whose ``counts`` column is not true may be accepted, but do not count against later ones.
    """
    ts, rest = order[0], list(order[1:])
    keep = list(keep)
    step = F.expr(f"interval {window_us} microsecond")
    able = F.coalesce(F.col(counts), F.lit(False)) if counts else F.lit(True)
    extra = [c for c in order if c not in keep]
    own = rows.select(*keep, *extra, F.to_json(F.struct(*group)).alias(NAME), able.alias(ABLE),
                      F.lit(1).alias(SIDE))
    leaving = own.where(ABLE).select(
        NAME, (F.col(ts) + step).alias(ts), *rest, F.lit(0).alias(SIDE), F.lit(False).alias(ABLE))
    line = materialise(own.unionByName(leaving, allowMissingColumns=True), "line")
    # the n-th row to leave the window is the n-th that counts, so both are numbered in one pass
    number = Running(AT, "sum", F.col(ABLE).cast("long"))
    left = Running("__left", "sum", (F.col(SIDE) == 0).cast("long"))
    line = materialise(running(line, NAME, [ts, SIDE, *rest], [number, left], rows_per_slice), "numbered")
    last = line.where(ABLE).groupBy(NAME).agg(F.max(AT).alias("__last"))
    last = materialise(last, "last-rows")
    successors = line.where(F.col(SIDE) == 0).select(
        NAME, F.col("__left").alias(AT), (F.col(AT) + 1).alias(TO))
    successors = materialise(
        successors.join(small_side(last), NAME).where(F.col(TO) <= F.col("__last")).drop("__last"),
        "successors")
    firsts = last.select(NAME, F.lit(1).cast("long").alias(AT))
    accepted = chain(successors, firsts).withColumn("__mark", F.lit(True))
    marked = line.where(F.col(SIDE) == 1).join(
        accepted, [NAME, AT], "left").withColumn("__mark", F.col("__mark") & F.col(ABLE))
    newest = Running("__newest", "max", F.when(F.col("__mark"), F.col(ts)), prior=True)
    seen = running(materialise(marked, "marked"), NAME, list(order), [newest], rows_per_slice)
    free = F.col("__newest").isNull() | (F.col(ts) >= F.col("__newest") + step)
    return seen.select(*keep, free.alias(decision))
