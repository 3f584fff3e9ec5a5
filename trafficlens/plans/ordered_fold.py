"""Decisions that depend on earlier decisions of the same group.

A rate limiter, a budget or a time-limited cache looks only at calls it accepted before, so its
rows must be walked in order. The walk is a small Python class; Spark places the rows:

* groups of up to ``max_group_rows`` rows are hash-partitioned, sorted and walked in a stream of
  Arrow batches, many groups per task;
* a larger group is cut by position into steps of that many rows, or of more where it would be cut
  into very many, and all steps are walked at once, each from a supposed state (at first the empty
  one). Then the states are handed on: a step is settled when all before it are and the state they
  leave gives the decisions it has made already. The others are walked again from their new states,
  until none is left. What a step leaves rarely depends on what was long before it, so a few rounds
  settle all steps.

A step that is walked again in vain costs its time. So from the third round on steps are walked in
segments of up to ``SEGMENT_ROWS`` rows: one task hands the state on from step to step and walks
those that it may change, so a round settles a segment at least. A round takes on a segment, or
twice as many steps of a group as the round before has settled: however states depend on each other,
a step is walked four times on average at most, and in the worst case segments one after another.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trafficlens.plans.scratch import materialise, scratch_dir
from trafficlens.plans.sides import small_side
from trafficlens.plans.slices import ROWS_PER_SLICE, with_ordinal

MAX_GROUP_ROWS = 2_000_000
#: A group has no more steps than that while they are of fewer than ``MAX_GROUP_ROWS`` rows.
MANY_STEPS = 16
#: How many rows one task walks, step by step, once states have proved to depend on each other.
SEGMENT_ROWS = 500_000
STEP, ROUND, SETTLED, SEGMENT = "__step", "__round", "__settled", "__segment"
USED, STATE = "__used", "__state"


class Walker(Protocol):
    """Walks the rows of one group, given as plain lists per column (times in microseconds).

    ``state`` is text so that it can be stored in a table. Of a step that was walked from the state
    ``used`` and left the state ``left``, ``same`` tells whether it surely decides alike from
    ``entry``, and ``follow`` what it then leaves (a guess where ``same`` is false).
    """

    def load(self, state: str | None) -> None: ...
    def walk(self, rows: dict[str, list]) -> list: ...
    def dump(self) -> str: ...
    def same(self, entry: str | None, used: str | None, left: str) -> bool: ...
    def follow(self, entry: str | None, used: str | None, left: str) -> str: ...


def ordered_fold(
    rows: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    keep: Sequence[str],
    decision: str,
    decision_type: T.DataType,
    walker: Callable[[], Walker],
    max_group_rows: int = MAX_GROUP_ROWS,
    rows_per_slice: int = ROWS_PER_SLICE,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """``keep`` columns of every row plus ``decision``, walked along ``order`` per ``group``.

    ``sizes`` (group columns and ``count``) spares counting the rows when that is known already.
    """
    group, order, keep = list(group), list(order), list(keep)
    out_type = T.StructType(
        [rows.schema[c] for c in keep] + [T.StructField(decision, decision_type)]
    )
    sizes = rows.groupBy(*group).count() if sizes is None else sizes
    hot = materialise(sizes.where(F.col("count") > max_group_rows).select(*group, "count"), "hot-groups")
    largest = hot.agg(F.max("count")).first()[0]
    if largest is None:
        return _walk_small(rows, group, order, keep, decision, out_type, walker)

    step_rows = max(max_group_rows, min(MAX_GROUP_ROWS, -(-largest // MANY_STEPS)))
    hot_keys = small_side(hot.select(*group))
    cold = rows.join(hot_keys, group, "left_anti")
    done_cold = _walk_small(cold, group, order, keep, decision, out_type, walker)

    # one column naming the group; made of the group's values, so different groups stay apart
    name = F.to_json(F.struct(*group)).alias("__name")
    placed = with_ordinal(
        materialise(rows.join(hot_keys, group, "left_semi").select("*", name), "hot-rows"),
        "__name",
        order,
        "__ord",
        rows_per_slice,
    ).drop("__name")
    stepped = materialise(
        placed.withColumn(STEP, F.floor((F.col("__ord") - 1) / step_rows).cast("int")).drop(
            "__ord"
        ).repartition(STEP),
        "hot-steps",
        STEP,
    )
    per_segment = max(1, SEGMENT_ROWS // step_rows)
    return _walk_hot(
        stepped, group, order, keep, decision, out_type, walker, per_segment
    ).unionByName(done_cold)


def _walk_small(rows, group, order, keep, decision, out_type, walker) -> DataFrame:
    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, walk = None, None
        for frame in frames:
            if frame.empty:
                continue
            decided: list = []
            columns = _lists(frame)
            for lo, hi in _runs(frame, group):
                key = tuple(_plain(frame[c].iat[lo]) for c in group)
                if walk is None or key != current:
                    current, walk = key, walker()
                    walk.load(None)
                decided.extend(walk.walk({c: v[lo:hi] for c, v in columns.items()}))
            out = frame[keep].copy()
            out[decision] = decided
            yield out

    return (
        rows.repartition(*group)
        .sortWithinPartitions(*group, *order)
        .mapInPandas(batches, out_type)
    )


def _lists(frame: pd.DataFrame) -> dict[str, list]:
    """Columns as plain lists; timestamps become whole microseconds, missing numbers None."""
    out = {}
    for c in frame.columns:
        col = frame[c]
        if pd.api.types.is_datetime64_any_dtype(col):
            out[c] = col.astype("datetime64[us]").astype("int64").tolist()
        elif col.isna().any():
            out[c] = col.astype(object).where(col.notna(), None).tolist()
        else:
            out[c] = col.tolist()
    return out


def _runs(frame: pd.DataFrame, group: list[str]) -> Iterator[tuple[int, int]]:
    """Consecutive stretches of rows with the same group, in a frame sorted by group."""
    change = pd.Series(False, index=frame.index)
    for c in group:
        col = frame[c]
        change |= (col != col.shift()) & ~(col.isna() & col.shift().isna())
    starts = change.to_numpy().nonzero()[0].tolist()
    if not starts or starts[0] != 0:
        starts.insert(0, 0)
    return zip(starts, [*starts[1:], len(frame)])


def _plain(value):
    return None if pd.isna(value) else value


def _walk_hot(stepped, group, order, keep, decision, out_type, walker, per_segment) -> DataFrame:
    spark = stepped.sparkSession
    names = [f"__g{i}" for i in range(len(group))]
    key = [*names, STEP]
    key_type = [T.StructField(g, stepped.schema[c].dataType) for g, c in zip(names, group)]
    key_type.append(T.StructField(STEP, T.IntegerType()))
    text = lambda name: T.StructField(name, T.StringType())
    # group columns may also be kept, so steps carry them under names of their own
    full_type = T.StructType([*out_type, *key_type, text(USED), text(STATE)])
    judged_type = T.StructType([*key_type, text("__entry"), text(USED), text(STATE),
                                T.StructField(SEGMENT, T.IntegerType()),
                                T.StructField(SETTLED, T.LongType())])
    rows = stepped.select("*", *[F.col(c).alias(g) for c, g in zip(group, names)])

    def one_segment(part: pd.DataFrame, steps: pd.DataFrame) -> pd.DataFrame:
        """Steps in a row: each from the state the one before leaves, unless it has decided alike."""
        columns, done = [f.name for f in full_type], []
        if not len(part) or not len(steps):
            return pd.DataFrame(columns=columns)
        steps = steps.sort_values(STEP)
        parts = {step: rows for step, rows in part.groupby(STEP)}
        state = _plain(steps["__entry"].iat[0])
        for step, used, left in zip(steps[STEP], map(_plain, steps[USED]), map(_plain, steps[STATE])):
            walk, mine = walker(), parts.pop(step).sort_values(order, kind="stable")
            if left is not None and walk.same(state, used, left):
                state = walk.follow(state, used, left)
                continue
            walk.load(state)
            out = mine[keep].copy()
            out[decision] = walk.walk(_lists(mine))
            last = pd.DataFrame({USED: [state], STATE: [walk.dump()]})
            state = last[STATE].iat[0]
            out = pd.concat([out, last], ignore_index=True)
            for c in key:
                out[c] = mine[c].iat[0]
            done.append(out[columns])
        return pd.concat(done, ignore_index=True) if done else pd.DataFrame(columns=columns)

    def judged(steps: pd.DataFrame) -> pd.DataFrame:
        """The state each step begins with by what is known now, and where it is walked again."""
        steps = steps.sort_values(STEP)
        walk, state, sure = walker(), None, True
        entries, again, settled = [], [], 0
        for used, left in zip(map(_plain, steps[USED]), steps[STATE]):
            alike = walk.same(state, used, left)
            sure = sure and alike
            settled += sure
            entries.append(state)
            again.append(not alike)
            state = walk.follow(state, used, left)
        before = _plain(steps[SETTLED].iat[0])
        segments: list[int | None] = []
        if before is None:
            segments = [step if yes else None for step, yes in zip(steps[STEP], again)]
        else:
            room = max(per_segment, 2 * (settled - int(before)))
            for step, yes in zip(steps[STEP], again):
                begun = segments and segments[-1] == step // per_segment
                segments.append(step // per_segment if begun or (yes and room > 0) else None)
                room -= segments[-1] is not None
        out = steps[[*key, USED, STATE]].copy()
        out["__entry"], out[SETTLED] = entries, settled
        out[SEGMENT] = pd.array(segments, "Int32")
        return out[[f.name for f in judged_type]]

    folder = scratch_dir(spark, "hot-walk")
    todo = rows.select(*key).distinct().select(
        *key, *[F.lit(None).cast("string").alias(c) for c in ("__entry", USED, STATE)],
        F.col(STEP).alias(SEGMENT))
    done, walked_rounds = None, 0
    unit = [*names, "__unit"]
    while True:
        if done is None:
            here = rows.withColumn("__unit", F.col(STEP))
        else:
            lo, hi = todo.agg(F.min(STEP), F.max(STEP)).first()  # prunes the folders of other steps
            here = rows.where(F.col(STEP).between(lo, hi)).join(
                small_side(todo.select(*key, F.col(SEGMENT).alias("__unit"))), key)
        here.groupBy(*unit).cogroup(todo.groupBy(*names, SEGMENT)).applyInPandas(
            one_segment, full_type).write.parquet(f"{folder}/{ROUND}={walked_rounds}")
        walked = spark.read.schema(T.StructType([*full_type, T.StructField(ROUND, T.IntegerType())])
                                   ).option("basePath", folder).parquet(folder)
        walked_rounds += 1
        left = walked.where(F.col(STATE).isNotNull())
        latest = left.groupBy(*key).agg(F.max_by(F.struct(USED, STATE, ROUND), ROUND).alias("s"))
        steps = latest.select(*key, "s.*")
        steps = steps.join(done, key) if done is not None else steps.withColumn(
            SETTLED, F.lit(None).cast("long"))
        judgement = materialise(
            steps.groupBy(*names).applyInPandas(judged, judged_type), "judged-steps")
        done = judgement.select(*key, SETTLED)
        todo = judgement.where(F.col(SEGMENT).isNotNull()).drop(SETTLED)
        if todo.isEmpty():
            break
    final = materialise(latest.select(*key, F.col(f"s.{ROUND}").alias(ROUND)), "last-rounds")
    return walked.where(F.col(STATE).isNull()).join(small_side(final), [*key, ROUND], "left_semi"
                                                    ).select(*[f.name for f in out_type])
