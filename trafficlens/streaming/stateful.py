"""Keyed stream decisions with the same walkers the batch operators use."""

from __future__ import annotations

import json
import os
import tempfile
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from trafficlens.plans.ordered_fold import STATE, Walker, _lists

STATE_TYPE = T.StructType(
    [T.StructField(STATE, T.StringType()), T.StructField("last", T.StringType())]
)


#: Rows of a key that are sorted at once, and rows read at a time of those sorted before.
SORTED_ROWS, BLOCK_ROWS = 100_000, 1_000
#: Waiting rows of a key that are put together in the state store.
PART_ROWS = 10_000


class Parts:
    """Frames on the worker's local disk, which are gone with it."""

    def __init__(self):
        local = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
        self.file = tempfile.TemporaryFile(dir=local if os.path.isdir(local) else None)

    def put(self, frame: pd.DataFrame) -> tuple[int, int]:
        data = _packed(frame)
        at = self.file.seek(0, os.SEEK_END)
        self.file.write(data)
        return at, len(data)

    def get(self, place: tuple[int, int]) -> pd.DataFrame:
        self.file.seek(place[0])
        return _unpacked(self.file.read(place[1]))


def in_order(frames: Iterable[pd.DataFrame], order: Sequence[str]) -> Iterator[pd.DataFrame]:
    """The rows of all frames in order (missing values last), in frames of bounded size.

    What is more than ``SORTED_ROWS`` is sorted piece by piece; the pieces lie on disk in blocks, and are
    merged: of the blocks read, all rows up to the least end of a block are next.
    """
    order, pieces, parts = list(order), [], None
    sort = lambda held: pd.concat(held, ignore_index=True).sort_values(order, kind="stable")
    held, n = [], 0
    for frame in frames:
        held.append(frame)
        n += len(frame)
        if n >= SORTED_ROWS:
            parts = parts or Parts()
            piece = sort(held)
            pieces.append([parts.put(piece.iloc[i:i + BLOCK_ROWS]) for i in range(0, n, BLOCK_ROWS)])
            held, n = [], 0
    if not pieces:
        if n:
            yield sort(held)
        return
    if n:
        piece = sort(held)
        pieces.append([parts.put(piece.iloc[i:i + BLOCK_ROWS]) for i in range(0, n, BLOCK_ROWS)])
    held = []

    def place(frame: pd.DataFrame, i: int) -> tuple:
        return tuple((pd.isna(x), None if pd.isna(x) else x) for x in (frame[c].iat[i] for c in order))

    for piece in pieces:
        piece.reverse()  # the next block is the last
    ahead = max(1, SORTED_ROWS // (BLOCK_ROWS * len(pieces)))
    open_: list[pd.DataFrame | None] = [None] * len(pieces)
    while True:
        for k, piece in enumerate(pieces):
            if open_[k] is None and piece:
                blocks = [parts.get(piece.pop()) for _ in range(min(ahead, len(piece)))]
                open_[k] = pd.concat(blocks, ignore_index=True)
        ends = [place(f, -1) for f, piece in zip(open_, pieces) if f is not None and piece]
        if not ends:  # what is open is all there is
            last = [f for f in open_ if f is not None]
            if last:
                yield sort(last)
            return
        end, due = min(ends), []
        for k, frame in enumerate(open_):
            if frame is None:
                continue
            cut = bisect_right(range(len(frame)), end, key=lambda i: place(frame, i))
            due.append(frame.iloc[:cut])
            open_[k] = frame.iloc[cut:] if cut < len(frame) else None
        yield sort(due)


class WalkingProcessor(StatefulProcessor):
    """Walks each key's rows of a micro-batch in order and keeps the walker's state.

    Spark gives no order inside a micro-batch, so a key's rows are sorted, many of them with the help
    of the local disk. A row older than the
    last one walked comes too late to be decided: it is passed on with ``late`` set and changes
    nothing. ``only_changes`` leaves out rows the walker has nothing to say about. (Column names must
    not start with an underscore: Spark hands the rows over as named tuples.)
    """

    def __init__(self, walker: Callable[[], Walker], order: Sequence[str], keep: Sequence[str],
                 decision: str, ttl_ms: int | None, only_changes: bool):
        self.walker, self.order, self.keep = walker, list(order), list(keep)
        self.decision, self.ttl_ms, self.only_changes = decision, ttl_ms, only_changes

    def init(self, handle: StatefulProcessorHandle) -> None:
        if self.ttl_ms is None:
            self.state = handle.getValueState("walk", STATE_TYPE)
        else:
            self.state = handle.getValueState("walk", STATE_TYPE, self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        stored = self.state.get() if self.state.exists() else (None, None)
        last = tuple(json.loads(stored[1])) if stored[1] is not None else None
        walk, end = self.walker(), None
        walk.load(stored[0])
        for frame in in_order(rows, self.order):
            columns = _lists(frame)
            places = list(zip(*[columns[c] for c in self.order]))
            first = 0
            if last is not None and end is None:
                first = next((i for i, p in enumerate(places) if p > last), len(places))
            out = frame[self.keep].copy()
            out[self.decision] = [None] * first + list(
                walk.walk({c: v[first:] for c, v in columns.items()})
            )
            out["late"] = [i < first for i in range(len(places))]
            if first < len(places):
                end = places[-1]
            if self.only_changes:
                out = out[out[self.decision].notna() | out["late"]]
            yield out
        if end is not None:
            self.state.update((walk.dump(), json.dumps(end)))

    def close(self) -> None:
        pass


#: When a row happened, in microseconds; watermarks are compared with it.
EVENT_US = "event_us_"
ORDERED_TYPE = T.StructType([*STATE_TYPE, T.StructField("last_us", T.LongType())])


class ReorderingProcessor(WalkingProcessor):
    """Walks each key's rows in order of event time, in whatever order micro-batches bring them.

    Rows wait in a list until the watermark has passed them; then all that are due are walked. Only a
    row that belongs before one already walked is late: it is passed on with ``late`` set and changes
    nothing. A row without a time is passed on undecided. With ``forget_ms`` a key is forgotten once
    the watermark is that long after its last row, which must be when its state cannot matter any
    more; rows of a forgotten or new key that the watermark has passed are late. What waits of one
    key are the rows of the watermark's delay and of one micro-batch; they are in the state store, part by
    part, and are walked part by part.
    """

    def __init__(self, walker: Callable[[], Walker], order: Sequence[str], keep: Sequence[str],
                 decision: str, forget_ms: int | None, only_changes: bool):
        super().__init__(walker, order, keep, decision, None, only_changes)
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("walk", ORDERED_TYPE)
        # by number, since a list would be handed over whole
        self.waiting = handle.getMapState("parts", "part long", "rows binary")
        self.parts = handle.getValueState("held", "parts long")

    def _hold(self, frame: pd.DataFrame) -> None:
        n = self.parts.get()[0] if self.parts.exists() else 0
        self.waiting.updateValue((n,), (_packed(frame),))
        self.parts.update((n + 1,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        last = tuple(json.loads(self.state.get()[1])) if self.state.exists() else None
        earliest = None
        for frame in rows:
            timed = frame[EVENT_US].notna()
            if not timed.all():
                yield from self._out(frame[~timed], [None] * int((~timed).sum()), False)
                frame = frame[timed]
            if last is not None:
                late = pd.Series([p <= last for p in self._places(_lists(frame))], frame.index, bool)
            else:
                late = frame[EVENT_US] <= (watermark * 1000 if self.forget_ms is not None else -1)
            if late.any():
                yield from self._out(frame[late], [None] * int(late.sum()), True)
                frame = frame[~late]
            if len(frame):
                self._hold(frame)
                first = int(frame[EVENT_US].min())
                earliest = first if earliest is None else min(earliest, first)
        if earliest is not None:
            if earliest <= watermark * 1000:
                yield from self._advance(watermark)
            else:
                self._wake(earliest, watermark)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(timerValues.getCurrentWatermarkInMs())

    def _advance(self, watermark: int) -> Iterator[pd.DataFrame]:
        """Walk what the watermark has passed, and set the timer for what comes next."""
        rest, later, earliest = Parts(), [], None

        def due() -> Iterator[pd.DataFrame]:
            nonlocal earliest
            left, n = [], 0
            for part in range(self.parts.get()[0] if self.parts.exists() else 0):
                frame = _unpacked(self.waiting.getValue((part,))[0])
                passed = frame[EVENT_US] <= watermark * 1000
                if passed.any():
                    yield frame[passed]
                    frame = frame[~passed]
                if len(frame):
                    left.append(frame)
                    n += len(frame)
                    first = int(frame[EVENT_US].min())
                    earliest = first if earliest is None else min(earliest, first)
                if n >= PART_ROWS:
                    later.append(rest.put(pd.concat(left, ignore_index=True)))
                    left, n = [], 0
            if n:
                later.append(rest.put(pd.concat(left, ignore_index=True)))

        walk, end = self.walker(), None
        for now in in_order(due(), self.order):
            if end is None:
                walk.load(self.state.get()[0] if self.state.exists() else None)
            columns = _lists(now)
            yield from self._out(now, walk.walk(columns), False)
            end = json.dumps(self._places(columns)[-1]), int(now[EVENT_US].iat[-1])
        if end is not None:
            self.state.update((walk.dump(), *end))
            self.waiting.clear()
            self.parts.clear()
            for place in later:
                self._hold(rest.get(place))
        if earliest is not None:
            self._wake(earliest, watermark)
        elif self.forget_ms is not None and self.state.exists():
            end_us = self.state.get()[2] + self.forget_ms * 1000
            if end_us <= watermark * 1000:
                self.state.clear()
            else:
                self._wake(end_us, watermark)

    def _wake(self, at_us: int, watermark: int) -> None:
        """One timer per key, for the first thing to do; those at or before the watermark are spent."""
        at = -(-at_us // 1000)
        ahead = [t for t in self.handle.listTimers() if t > watermark]
        if any(t <= at for t in ahead):
            return
        for t in ahead:
            self.handle.deleteTimer(t)
        self.handle.registerTimer(at)

    def _places(self, columns: dict[str, list]) -> list[tuple]:
        return list(zip(*[columns[c] for c in self.order]))

    def _out(self, frame: pd.DataFrame, decisions: list, late: bool) -> Iterator[pd.DataFrame]:
        out = frame[self.keep].copy()
        out[self.decision] = pd.Series(decisions, frame.index, dtype=object)
        out["late"] = late
        if self.only_changes:
            out = out[out[self.decision].notna() | out["late"]]
        if len(out):
            yield out


def _packed(frame: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(frame, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(part: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(part)).read_all().to_pandas()


def walk_stream(
    rows: DataFrame,
    key: str,
    order: Sequence[str],
    keep: Sequence[str],
    decision: str,
    decision_type: T.DataType,
    walker: Callable[[], Walker],
    ttl_ms: int | None = None,
    only_changes: bool = False,
    delay: str | None = None,
    forget_ms: int | None = None,
) -> DataFrame:
    """``keep`` columns of every row, its decision and whether it came too late for one.

    With ``delay`` rows may come in any order within that much event time and are decided once the
    watermark has passed them, as in ``ReorderingProcessor``. Without it each micro-batch is walked as
    it comes, and a row older than the last one of its key is late.
    """
    out_type = T.StructType(
        [rows.schema[c] for c in keep]
        + [T.StructField(decision, decision_type), T.StructField("late", T.BooleanType())]
    )
    if delay is not None:
        # the walk looks at microseconds, so that Spark does not drop rows behind the watermark unseen
        timed = rows.withColumn("event_time_", F.col(order[0]).cast("timestamp")).withWatermark(
            "event_time_", delay).withColumn(EVENT_US, F.unix_micros("event_time_"))
        return timed.drop("event_time_").groupBy(key).transformWithStateInPandas(
            statefulProcessor=ReorderingProcessor(
                walker, order, keep, decision, forget_ms, only_changes),
            outputStructType=out_type,
            outputMode="Append",
            timeMode="EventTime",
        )
    return rows.groupBy(key).transformWithStateInPandas(
        statefulProcessor=WalkingProcessor(walker, order, keep, decision, ttl_ms, only_changes),
        outputStructType=out_type,
        outputMode="Append",
        timeMode="None" if ttl_ms is None else "ProcessingTime",
    )
