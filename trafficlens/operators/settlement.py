"""Streamed answers settled in the ledger once they have ended."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens.functions.money import call_cost, tokens_from_chars
from trafficlens.plans.sides import small_side
from trafficlens.plans.slices import ROWS_PER_SLICE
from trafficlens.sources.ledger import new_ledger_rows
from trafficlens.sources.wire import parse_sse_chunks


def answer_sizes(lines: DataFrame, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """(stream_id, id, n_chars) of every streamed answer that gave at least one chunk.

    The id named last wins. Lengths are added up map-side, so no answer is put together for this.
    """
    chunks = parse_sse_chunks(lines, rows_per_slice)
    return chunks.groupBy("stream_id").agg(
        F.max_by("id", F.when(F.col("id") != "", F.col("seq"))).alias("id"),
        F.sum(F.coalesce(F.length("content"), F.lit(0))).alias("n_chars"),
    )


def price_answers(
    answers: DataFrame, opened: DataFrame, backends: DataFrame, also: Sequence[str] = ()
) -> DataFrame:
    """Ledger rows of ended answers (stream_id, id, n_chars), with columns ``also`` of theirs.

    ``opened`` has a row per opened stream: stream_id, api_key, backend, prompt_chars, latency_ms,
    timestamp. Tokens are estimated from characters on both sides. The model is the backend's own.
    An answer without an id takes its stream's. An answer of a stream that was never opened is
    left out; one of a backend that is not listed costs nothing and has no model.
    """
    prices = backends.select("backend", "model", "cost_per_1k_prompt", "cost_per_1k_completion")
    sized = answers.join(opened, "stream_id").join(small_side(prices), "backend", "left").select(
        "stream_id",
        *also,
        F.coalesce("id", F.col("stream_id").cast("string")).alias("id"),
        "api_key",
        "backend",
        "model",
        tokens_from_chars(F.coalesce("prompt_chars", F.lit(0))).cast("long").alias("prompt_tokens"),
        tokens_from_chars(F.col("n_chars")).cast("long").alias("completion_tokens"),
        "cost_per_1k_prompt",
        "cost_per_1k_completion",
        "latency_ms",
        "timestamp",
    )
    cost = call_cost(
        "prompt_tokens", "completion_tokens", "cost_per_1k_prompt", "cost_per_1k_completion"
    )
    return sized.select(
        "stream_id", *also, "id", "api_key", "backend", "model", "prompt_tokens", "completion_tokens",
        F.coalesce(cost, F.lit(0.0)).alias("cost_usd"), "latency_ms", "timestamp",
    )


def settle_streams(
    lines: DataFrame,
    opened: DataFrame,
    backends: DataFrame,
    ledger: DataFrame,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """The rows to append to the ledger for streamed answers, each id once.

    An answer that broke off is settled for what was sent; a stream that never gave a chunk is
    not. Of answers with one id the earliest is booked, and none if the ledger has the id.
    """
    rows = price_answers(answer_sizes(lines, rows_per_slice), opened, backends)
    fresh = new_ledger_rows(ledger, rows, ["timestamp", "stream_id"])
    return fresh.select(*[c for c in rows.columns if c != "stream_id"])
