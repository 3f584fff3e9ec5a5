"""Streamed answers settled as their lines come in."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from trafficlens.operators.settlement import price_answers
from trafficlens.sources.wire import read_answer_lines

STATE_TYPE = (
    "n_chars long, id string, id_seq long, started string, started_seq long, chunks long, "
    "settled boolean"
)
SETTLED_TYPE = "stream_id {key}, id string, n_chars long, outcome string"


class SettlingProcessor(StatefulProcessor):
    """Adds up an answer's lines and gives it out once: at its end, or when no line came for long.

    What is kept of an answer is a few numbers, never its text. The answer stays marked as settled until
    the time-out, so lines that follow the end change nothing.
    """

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("answer", STATE_TYPE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True).sort_values("seq", kind="stable")
        last_ms = int(frame["event_ms"].max())
        n_chars, id_, id_seq, started, started_seq, chunks, settled = (
            self.state.get() if self.state.exists() else (0, None, -1, None, -1, 0, False))
        ended = False
        if not settled:
            for seq, ends, start, chunk_id, is_chunk, size in zip(
                    frame["seq"], frame["ends"], frame["started"], frame["chunk_id"],
                    frame["is_chunk"], frame["size"]):
                if isinstance(start, str) and seq > started_seq:
                    started, started_seq = start, int(seq)
                if is_chunk:
                    chunks, n_chars = chunks + 1, n_chars + int(size)
                    named = chunk_id if isinstance(chunk_id, str) else started
                    if named and seq > id_seq:
                        id_, id_seq = named, int(seq)
                if ends:
                    ended = True
                    break
        for expiry in list(self.handle.listTimers()):
            self.handle.deleteTimer(expiry)
        self.handle.registerTimer(
            max(last_ms + self.timeout_ms, timerValues.getCurrentWatermarkInMs() + 1))
        if ended and chunks:
            yield self._row(key, id_, n_chars, "ended")
        self.state.update((n_chars, id_, id_seq, started, started_seq, chunks, settled or ended))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            n_chars, id_, _, _, _, chunks, settled = self.state.get()
            self.state.clear()
            if chunks and not settled:
                yield self._row(key, id_, n_chars, "timed_out")

    def _row(self, key, id_, n_chars, outcome) -> pd.DataFrame:
        return pd.DataFrame({"stream_id": [key[0]], "id": [id_], "n_chars": [n_chars],
                             "outcome": [outcome]})

    def close(self) -> None:
        pass


def stream_settle_answers(
    lines: DataFrame,
    opened: DataFrame,
    backends: DataFrame,
    ts: str = "ts",
    delay: str = "1 minute",
    timeout_sec: float = 300.0,
) -> DataFrame:
    """Ledger rows of streamed answers, given out at their end or ``timeout_sec`` after their last line.

    ``lines`` is a stream of (stream_id, seq, line, ts), ``opened`` a table as ``price_answers`` takes
    it. ``stream_ledger_ingest`` books the rows, each id once. ``outcome`` tells how an answer came
    to its end. The lines of one answer may come in any order within a micro-batch; a source that
    keeps the order of a key, as a partitioned log does, never brings the end before the rest.
    """
    size = F.coalesce(F.length("content"), F.lit(0)).cast("long")
    read = read_answer_lines(lines.withColumn("event_time", F.col(ts).cast("timestamp")),
                             "event_time")
    answers = (
        read.select(
            "stream_id", "seq", "event_time", F.unix_millis("event_time").alias("event_ms"),
            "ends", "started", "chunk_id", "is_chunk", size.alias("size"))
        .withWatermark("event_time", delay)
        .groupBy("stream_id")
        .transformWithStateInPandas(
            statefulProcessor=SettlingProcessor(int(timeout_sec * 1000)),
            outputStructType=SETTLED_TYPE.format(
                key=lines.schema["stream_id"].dataType.simpleString()),
            outputMode="Append",
            timeMode="EventTime",
        )
    )
    return price_answers(answers, opened, backends, ["outcome"])
