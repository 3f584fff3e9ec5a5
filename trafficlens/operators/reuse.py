"""Repeated prompts: what a time-limited cache of bounded size would have answered."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trafficlens.operators.admission import sliding_log
from trafficlens.plans.ordered_fold import MAX_GROUP_ROWS
from trafficlens.plans.scratch import materialise
from trafficlens.plans.slices import (
    ROWS_PER_SLICE,
    SLICE,
    Running,
    running,
    slices_of,
)

# Lifetime and number of cache entries.
TTL_SEC = 300
CAPACITY = 1000


def prompt_reuse(
    calls: DataFrame,
    key: str = "prompt_key",
    ttl_sec: float = TTL_SEC,
    capacity: int | None = None,
    order: Sequence[str] = ("ts", "event_id"),
    keep: Sequence[str] = ("event_id", "ts"),
    max_group_rows: int = MAX_GROUP_ROWS,
    rows_per_slice: int = ROWS_PER_SLICE,
    stores: str | None = None,
) -> DataFrame:
    """``hit`` per call: an entry of the same key was stored at most ``ttl_sec`` ago.

    A call that misses stores an entry; with ``stores``, only if that column is true.

    A hit does not renew the entry. So misses of a key are the calls a sliding log with room for
    one would accept, in a window just longer than the lifetime. With ``capacity`` an entry
    pushed out by other keys is gone too, and its key starts over.
    """
    window_us = int(ttl_sec * 1_000_000) + 1
    keys, rows = [key], calls
    if capacity is not None:
        placed = materialise(
            reuse_distance(
                calls, key, capacity, order, list(dict.fromkeys([*keep, key, *order])),
                rows_per_slice,
            ),
            "resident",
        )
        epochs = Running("__epoch", "sum", (~F.col("resident")).cast("long"))
        rows = materialise(running(placed, key, order, [epochs], rows_per_slice), "epochs")
        keys = [key, "__epoch"]
    kept = list(dict.fromkeys([*keep, key]))
    stored = sliding_log(
        rows, keys, order, kept, F.lit(1), window_us, "__stored", max_group_rows, rows_per_slice,
        stores, single=True,
    )
    return stored.select(*kept, (~F.col("__stored")).alias("hit"))


def reuse_distance(
    calls: DataFrame,
    key: str = "prompt_key",
    capacity: int = CAPACITY,
    order: Sequence[str] = ("ts", "event_id"),
    keep: Sequence[str] = ("event_id", "ts"),
    rows_per_slice: int = 200_000,
) -> DataFrame:
    """How many other keys were touched since a key's last touch, while below ``capacity``.

    ``resident`` tells whether the key's entry survived; otherwise ``distance`` is null. All that
    earlier calls can matter for is the ``capacity`` keys touched last, in order. That list is
    made for every slice start by merging lists of neighbouring slices in doubling strides. Put
    before the slice's own touches it makes each slice a log of its own.

    Touches of a slice are numbered. Of the calls between a touch and the last touch of its key, a key
    counts once: those are left out that were touched again before the touch, so whose own pair of
    touches lies inside. Pairs inside ended earlier and began later; ``later_starts`` counts them
    for all touches of a slice together.
    """
    keep, order = list(keep), list(order)
    needed = list(dict.fromkeys([*keep, *order, key]))
    slices = slices_of(calls, None, order, rows_per_slice)
    sliced = slices.assign(calls.select(*needed))
    out_type = T.StructType(
        [calls.schema[c] for c in keep]
        + [T.StructField("distance", T.LongType()), T.StructField("resident", T.BooleanType())]
    )
    recent = _recent_keys(sliced, key, order, capacity, slices.number)

    def settle(rows: pa.Table, before: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in order])
        before = before.sort_by([(f"__{c}", "ascending") for c in order])
        keys = pa.chunked_array(
            [*before.column(key).chunks, *rows.column(key).chunks], rows.schema.field(key).type
        ).combine_chunks()
        codes = keys.dictionary_encode(null_encoding="encode").indices.to_numpy(False)
        distance = distinct_between(codes)[len(before):]
        near = (distance >= 0) & (distance < capacity)
        found = pa.array(distance, pa.int64(), mask=~near)
        columns = {c: rows.column(c) for c in keep} | {"distance": found, "resident": pa.array(near)}
        return pa.table(list(columns.values()), list(columns))

    return sliced.groupBy(SLICE).cogroup(recent.groupBy(SLICE)).applyInArrow(settle, out_type)


def distinct_between(codes: np.ndarray) -> np.ndarray:
    """Per touch how many other keys were touched since the last touch of its key; -1 at first."""
    n = len(codes)
    by_key = np.argsort(codes, kind="stable")
    last = np.full(n, -1)
    again = codes[by_key[1:]] == codes[by_key[:-1]]
    last[by_key[1:][again]] = by_key[:-1][again]
    at = np.flatnonzero(last >= 0)
    out = np.full(n, -1)
    out[at] = at - last[at] - 1 - later_starts(last[at])
    return out


def later_starts(starts: np.ndarray) -> np.ndarray:
    """Per element (all differ) how many before it are larger.

    Two numbers differ first in one bit. Per bit, highest to lowest, the elements alike in all higher
    ones stand together in their order, and those with the bit unset count those with it before them.
    """
    m = len(starts)
    rank = np.empty(m, np.int64)
    rank[np.argsort(starts)] = np.arange(m)
    place, out = np.arange(m), np.zeros(m, np.int64)
    for bit in reversed(range(max(m - 1, 0).bit_length())):
        value = rank[place]
        one = (value >> bit) & 1
        before = np.cumsum(one) - one
        group = value >> (bit + 1)
        first = np.searchsorted(group, group)  # groups stand in order
        zero = one == 0
        out[place[zero]] += (before - before[first])[zero]
        place = place[np.argsort(value >> bit, kind="stable")]
    return out


def _recent_keys(sliced, key, order, capacity, n_slices) -> DataFrame:
    """(slice, key, last touch): at the start of each slice, the keys touched last."""
    point = F.struct(*[F.col(c).alias(f"__{c}") for c in order])

    def newest(touched: DataFrame) -> DataFrame:
        once = touched.groupBy(SLICE, key).agg(F.max("at").alias("at"))
        rank = F.row_number().over(Window.partitionBy(SLICE).orderBy(F.col("at").desc()))
        return once.withColumn("__r", rank).where(F.col("__r") <= capacity).drop("__r")

    ahead = sliced.select((F.col(SLICE) + 1).alias(SLICE), key, point.alias("at"))
    lists = newest(ahead)
    stride = 1
    while stride < n_slices - 1:
        lists = materialise(lists, "recent-keys")
        moved = lists.withColumn(SLICE, F.col(SLICE) + stride)
        lists = newest(lists.unionByName(moved))
        stride *= 2
    return lists.where(F.col(SLICE) < n_slices).select(SLICE, key, "at.*")


def cache_hit_ratio(looked_up: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of lookups that hit, over all lookups or per group."""
    return looked_up.groupBy(*by).agg(
        F.count(F.lit(1)).alias("lookups"),
        F.count_if("hit").alias("hits"),
        F.avg(F.col("hit").cast("double")).alias("hit_ratio"),
    )
