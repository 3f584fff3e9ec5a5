"""As-of lookups: the newest fact of a key at the time of a row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficlens.plans.scratch import materialise
from trafficlens.plans.slices import ROWS_PER_SLICE, Running, running


def asof(
    rows: DataFrame,
    facts: DataFrame,
    key: str | None,
    order: Sequence[str],
    value: Sequence[str],
    strictly_before: bool = False,
    rows_per_slice: int = ROWS_PER_SLICE,
    pick: dict[str, Column] | None = None,
    previous: str | None = None,
) -> DataFrame:
    """Rows with ``value`` columns of the newest fact at (or strictly before) their time.

    Both sides are laid on one time line and the newest fact is a running maximum, so a key with
    many rows or many facts is spread over slices. ``order`` is (time, id) and present in both.
    ``pick`` names several lookups on one line instead (name -> condition on the facts); each
    yields a struct of the value columns. ``previous`` names a column for the time of the row before.
    """
    ts, rest = order[0], list(order[1:])
    side = F.lit(0 if strictly_before else 1)
    # facts are often the result of a long plan, and the time line is read by several jobs
    facts = materialise(facts, "facts")
    line = rows.withColumn("__side", side).withColumn("__row", F.lit(True)).unionByName(
        facts.withColumn("__side", F.lit(1) - side).withColumn("__row", F.lit(False)),
        allowMissingColumns=True,
    )
    carried = F.struct(ts, "__side", *rest, F.struct(*value).alias("v"))
    wanted = pick or {"__at": F.lit(True)}
    seen = running(
        line,
        key,
        [ts, "__side", *rest],
        [
            Running(name, "max", F.when(~F.col("__row") & cond, carried))
            for name, cond in wanted.items()
        ]
        + ([Running(previous, "max", F.when(F.col("__row"), F.col(ts)), prior=True)] if previous else []),
        rows_per_slice,
    ).where("__row")
    kept = [c for c in rows.columns if c not in value] + ([previous] if previous else [])
    if pick:
        return seen.select(*kept, *[F.col(f"{name}.v").alias(name) for name in pick])
    return seen.select(*kept, *[F.col(f"__at.v.{c}").alias(c) for c in value])
