"""Running totals over ordered logs whose keys may be few and hot.

``Window.partitionBy(backend).orderBy(ts)`` puts a whole backend into one task. Here the log is
cut into slices of about equal row count along (key, order): a hot key spans many slices, most
cold ones lie in one. Each (key, slice) pair is windowed on its own. What a pair needs from
before its slice comes from a small table: a cut falls inside at most one key, so at most one
pair per slice has rows before it, and that table has no more rows than there are cuts.

Small slices are made larger before there are more than ``MANY_SLICES``, so that what is sent to the
driver to place the cuts has a bound. Up to ``LISTED`` slices the cuts are a list that is searched in the scan, and the rows are shuffled
once. Of more slices, each is a partition of a range shuffle that is written as a table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trafficlens.plans.scratch import materialise
from trafficlens.plans.sides import small_side

SLICE = "__slice"
ROWS_PER_SLICE = 1_000_000
#: There are no more slices than that while they are of fewer than ``ROWS_PER_SLICE`` rows.
MANY_SLICES = 512
LISTED = 4096
SAMPLES_PER_SLICE = 60
_MICROS = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}
_LISTABLE = (T.StringType, T.LongType, T.IntegerType)


@dataclass
class Slices:
    """Where a log is cut: points of (key, order) as JSON, and the keys they fall into; or, of very
    many slices, only their number (``dealt``)."""

    key: str | None
    order: list[str]
    cuts: list[str] = field(default_factory=list)
    cut_keys: set[Any] | None = None
    dealt: int = 0

    @property
    def number(self) -> int:
        return self.dealt or len(self.cuts) + 1

    @property
    def along(self) -> list[str]:
        return [*([self.key] if self.key else []), *self.order]

    @property
    def part(self) -> list[str]:
        return [*([self.key] if self.key else []), SLICE]

    def assign(self, df: DataFrame) -> DataFrame:
        """``df`` with the number of each row's slice."""
        if self.dealt:
            ranged = df.repartitionByRange(self.dealt, *self.along)
            return materialise(ranged.withColumn(SLICE, F.spark_partition_id()), "slices")
        return df.withColumn(SLICE, self._number(df))

    def _number(self, df: DataFrame) -> Column:
        """How many cuts lie at or before a row, by binary search in the list of cuts.

        One expression: a chain of projections runs faster but takes the optimizer far too long
        to plan under joins.
        """
        if not self.cuts:
            return F.lit(0)
        point = T.StructType([T.StructField(c, df.schema[c].dataType) for c in self.along])
        cuts = F.from_json(F.lit("[" + ",".join(self.cuts) + "]"), T.ArrayType(point), _MICROS)
        row = F.struct(*self.along)
        size = len(self.cuts)
        strides = [1 << p for p in reversed(range(size.bit_length()))]

        def advance(pos: Column, stride: Column) -> Column:
            ahead = pos + stride
            return F.when((ahead <= size) & (F.get(cuts, ahead - 1) <= row), ahead).otherwise(pos)

        return F.aggregate(F.array(*map(F.lit, strides)), F.lit(0), advance)

    def spanning(self, df: DataFrame) -> DataFrame:
        """Rows of the keys that are cut, the only ones that carry anything over."""
        if self.cut_keys is None:
            return df
        named = F.col(self.key).isin([k for k in self.cut_keys if k is not None])
        return df.where(named | F.col(self.key).isNull() if None in self.cut_keys else named)

    def local(self) -> WindowSpec:
        """Rows of one key in one slice, in order."""
        return Window.partitionBy(*self.part).orderBy(*self.order)

    def carry(self, per_slice: DataFrame, columns: dict[str, Column]) -> DataFrame:
        """From one row per (key, slice) to what each slice takes over from the ones before.

        ``columns`` are aggregates over the earlier slices of the key.
        """
        keys = [self.key] if self.key else []
        earlier = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(
            Window.unboundedPreceding, -1
        )
        carried = per_slice.select(
            *self.part,
            F.count(F.lit(1)).over(earlier).alias("__before"),
            *[c.over(earlier).alias(name) for name, c in columns.items()],
        )
        return carried.where(F.col("__before") > 0).drop("__before")

    def bring(self, local: DataFrame, carried: DataFrame) -> DataFrame:
        """Join what was carried over; at most one row per cut, so a listed number is broadcast."""
        if self.dealt:
            carried = materialise(carried, "carried")
        renamed = carried.select(
            *[F.col(c).alias(f"__at{i}") for i, c in enumerate(self.part)],
            *[c for c in carried.columns if c not in self.part],
        )
        same = F.lit(True)
        for i, c in enumerate(self.part):
            same = same & F.col(c).eqNullSafe(F.col(f"__at{i}"))
        side = small_side(renamed) if self.dealt else F.broadcast(renamed)
        return local.join(side, same, "left").drop(
            *[f"__at{i}" for i in range(len(self.part))]
        )


def slices_of(
    df: DataFrame, key: str | None, order: Sequence[str], rows_per_slice: int = ROWS_PER_SLICE
) -> Slices:
    """Cut ``df`` into slices of about ``rows_per_slice`` rows, or of up to ``ROWS_PER_SLICE`` rows
    where that would be more than ``MANY_SLICES``.

    Two narrow jobs: a count, and a sample of key and order columns of some
    ``SAMPLES_PER_SLICE`` rows per slice. The sample only places the cuts; every row is kept and
    lies in exactly one slice. The number of slices grows with the rows without a bound.
    """
    found = Slices(key, list(order))
    rows = df.select(*found.along).count()
    n = min(-(-rows // rows_per_slice), max(MANY_SLICES, -(-rows // ROWS_PER_SLICE)))
    if n <= 1:
        return found
    if n > LISTED:
        found.dealt = n
        return found
    picked = (
        df.select(*found.along)
        .sample(min(1.0, n * SAMPLES_PER_SLICE / rows), seed=7)
        .orderBy(*found.along)
        .select(F.to_json(F.struct(*found.along), _MICROS).alias("cut"), *found.along[:1])
        .collect()
    )
    step = max(1, len(picked) // n)
    chosen = picked[step::step]
    found.cuts = [r[0] for r in chosen]
    if key and isinstance(df.schema[key].dataType, _LISTABLE):
        found.cut_keys = {r[1] for r in chosen}
    return found


@dataclass(frozen=True)
class Running:
    """One running total: ``kind`` is ``sum`` or ``max``; ``prior`` leaves the row itself out."""

    name: str
    kind: str
    value: Column
    prior: bool = False

    @property
    def fold(self):
        return F.sum if self.kind == "sum" else F.max


def running(
    df: DataFrame,
    key: str | None,
    order: Sequence[str],
    totals: Sequence[Running],
    rows_per_slice: int = ROWS_PER_SLICE,
    slices: Slices | None = None,
) -> DataFrame:
    """Add running totals per ``key`` along ``order`` (which must be unique per key).

    ``kind='max'`` over a struct led by the order columns gives the latest matching row, which
    is how as-of lookups are built. Without a key the whole table is one log. ``df`` is read by
    several jobs; hand over a table rather than a long plan.
    """
    slices = slices or slices_of(df, key, order, rows_per_slice)
    sliced = slices.assign(df)
    here = slices.local().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = slices.local().rowsBetween(Window.unboundedPreceding, -1)
    local = sliced.select(
        "*", *[t.fold(t.value).over(before if t.prior else here).alias(t.name) for t in totals]
    )
    if slices.number == 1:
        return local.select(*df.columns, *[_close(t, F.col(t.name)) for t in totals])

    per_slice = (
        slices.spanning(sliced)
        .groupBy(*slices.part)
        .agg(*[t.fold(t.value).alias(t.name) for t in totals])
    )
    carried = slices.carry(per_slice, {f"__c_{t.name}": t.fold(F.col(t.name)) for t in totals})
    out = []
    for t in totals:
        mine, brought = F.col(t.name), F.col(f"__c_{t.name}")
        both = (
            F.coalesce(mine + brought, mine, brought)
            if t.kind == "sum"
            else F.greatest(brought, mine)
        )
        out.append(_close(t, both))
    return slices.bring(local, carried).select(*df.columns, *out)


def _close(t: Running, value: Column) -> Column:
    """A sum over no rows is 0; a maximum over no rows stays null."""
    return (F.coalesce(value, F.lit(0)) if t.kind == "sum" else value).alias(t.name)


def with_ordinal(
    df: DataFrame,
    key: str | None,
    order: Sequence[str],
    name: str = "ord",
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Dense 1-based position of each row within its key, without a single-task window."""
    return running(df, key, order, [Running(name, "sum", F.lit(1).cast("long"))], rows_per_slice)
