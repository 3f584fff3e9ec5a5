"""Answer documents and streamed answers: normalised, settled in batch and as a stream."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from trafficlens.operators.settlement import settle_streams
from trafficlens.plans.sides import small_side
from trafficlens.sources.ledger import new_ledger_rows
from trafficlens.sources.wire import parse_provider_answers
from trafficlens.streaming import jobs, settling

T0 = datetime(2024, 1, 1)
CATALOGUE = ("backend string, provider string, model string, cost_per_1k_prompt double, "
             "cost_per_1k_completion double")
OPENED = ("stream_id string, api_key string, backend string, prompt_chars long, "
          "latency_ms double, timestamp timestamp_ntz")


@pytest.fixture(scope="module")
def catalogue(spark):
    return spark.createDataFrame(
        [("a", "openai", "gpt", 1.0, 2.0), ("c", "anthropic", "claude", 3.0, 4.0)], CATALOGUE)


def test_answers_of_both_dialects(spark, catalogue):
    bodies = [
        (1, "a", json.dumps({"id": "x", "choices": [
            {"message": {"role": "assistant", "content": "hi"}},
            {"message": {"role": "assistant", "content": None}}],
            "usage": {"prompt_tokens": 10, "completion_tokens": 20}})),
        (2, "c", json.dumps({"id": "y", "content": [
            {"type": "text", "text": "one "}, {"type": "tool_use", "id": "t"},
            {"type": "text", "text": "two"}], "usage": {"input_tokens": 1, "output_tokens": 2}})),
        (3, "a", "{}"), (4, "c", "{}"), (5, "a", "{nope"), (6, "a", None), (7, "a", "[1]"),
        (8, "gone", json.dumps({"id": "z", "choices": [], "usage": {"prompt_tokens": 5}})),
        (9, "c", json.dumps({"role": "other", "content": []})),
    ]
    sent = spark.createDataFrame(bodies, "n int, backend string, body string").withColumn(
        "id", F.lit("clash"))
    got = {r.n: r for r in parse_provider_answers(sent, catalogue).collect()}
    plain = lambda r: (r.ok, r.id, r.model, r.messages and [tuple(m) for m in r.messages],
                       r.prompt_tokens, r.completion_tokens, r.cost_usd)
    assert plain(got[1]) == (True, "x", "gpt", [("assistant", "hi"), ("assistant", "")],
                             10, 20, pytest.approx(0.05))
    assert plain(got[2]) == (True, "y", "claude", [("assistant", "one two")],
                             1, 2, pytest.approx(0.011))
    assert plain(got[3]) == (True, "", "gpt", [], 0, 0, 0.0)
    assert plain(got[4]) == (True, "", "claude", [("assistant", "")], 0, 0, 0.0)
    for n in (5, 6, 7):
        assert plain(got[n]) == (False, None, "gpt", None, None, None, None)
    assert plain(got[8]) == (True, "z", None, [], 5, 0, 0.0)
    assert plain(got[9]) == (True, "", "claude", [("other", "")], 0, 0, 0.0)


def chunk(text, id_="r"):
    return "data: " + json.dumps({"id": id_, "choices": [{"delta": {"content": text}}]})


def typed(**event):
    return "data: " + json.dumps(event)


def delta(text):
    return typed(type="content_block_delta", delta={"type": "text_delta", "text": text})


LINES = {
    "done": [chunk("x" * 8, "r1"), chunk("y" * 9, "r2"), "data: [DONE]", chunk("late" * 50, "r9")],
    "typed": [typed(type="message_start", message={"id": "m1"}), delta("z" * 41),
              typed(type="message_stop"), delta("late")],
    "broken": [chunk("b" * 80, "r3"), "data: {oops", ": note"],
    "nothing": [": hello", "data: {oops"],
    "unnamed": [chunk("u", ""), "data: [DONE]"],
    "again": [chunk("again" * 10, "r2"), "data: [DONE]"],
}
WANT = {  # id: (key, model, prompt tokens, completion tokens)
    "r2": ("k", "gpt", 25, 4), "m1": ("k", "claude", 25, 10), "r3": ("k", "gpt", 25, 20),
    "unnamed": ("k", "gpt", 25, 1),
}


def opened_of(spark):
    return spark.createDataFrame(
        [(s, "k", "c" if s == "typed" else "a", 100, 5.0, T0 + timedelta(seconds=i))
         for i, s in enumerate(LINES)], OPENED)


def lines_of(names, at=T0):
    return [(s, i, line, at + timedelta(seconds=i)) for s in names for i, line in enumerate(LINES[s])]


def settled(rows):
    rows = rows.collect()
    out = {r.id: (r.api_key, r.model, r.prompt_tokens, r.completion_tokens) for r in rows}
    assert len(out) == len(rows)
    return out


LINE = "stream_id string, seq int, line string, ts timestamp"


def test_settled_in_batch(spark, catalogue):
    ledger = spark.createDataFrame([], "id string")
    lines = spark.createDataFrame(lines_of(LINES), LINE).drop("ts")
    got = settle_streams(lines, opened_of(spark), catalogue, ledger)
    assert settled(got) == WANT
    assert {r.id: r.cost_usd for r in got.collect()}["m1"] == pytest.approx(0.025 * 3 + 0.010 * 4)
    booked = spark.createDataFrame([("r2",), ("m1",)], "id string")
    assert set(settled(settle_streams(lines, opened_of(spark), catalogue, booked))) == {
        "r3", "unnamed"}
    assert settled(settle_streams(lines.limit(0), opened_of(spark), catalogue, ledger)) == {}


def test_settled_as_a_stream_over_micro_batches(spark, catalogue, tmp_path):
    """Answers are cut over batches; one that breaks off is settled by the time-out."""
    every = lines_of(LINES)
    parts = [[x for x in every if x[1] == 0], [x for x in every if x[1] > 0],
             [("unopened", 0, chunk("t"), T0 + timedelta(hours=1))],
             [("unopened", 1, chunk("t"), T0 + timedelta(hours=2))]]

    def run():
        stream = spark.readStream.schema(LINE).option("maxFilesPerTrigger", 1).parquet(
            f"{tmp_path}/in/*")
        rows = settling.stream_settle_answers(stream, opened_of(spark), catalogue)
        jobs.run_to_table(rows, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
        return spark.read.parquet(f"{tmp_path}/out")

    def put(i):
        spark.createDataFrame(parts[i], LINE).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")

    put(0)
    run()
    put(1)
    first = run()
    assert {r.id for r in first.where("outcome = 'ended'").collect()} == {"r2", "m1", "unnamed"}
    put(2)
    run()
    put(3)
    got = run()
    assert [r.id for r in got.where("outcome = 'timed_out'").collect()] == ["r3"]
    # two answers have the id r2: the ledger books the earlier one
    ledger = spark.createDataFrame([], "id string")
    assert settled(new_ledger_rows(ledger, got, ["timestamp", "stream_id"])) == WANT


def test_a_side_is_small_in_rows_and_bytes(spark):
    def hinted(df):
        return "ResolvedHint" in df._jdf.queryExecution().analyzed().toString() or (
            "broadcast" in df._jdf.queryExecution().logical().toString().lower())

    few = spark.range(10).withColumn("text", F.repeat(F.lit("x"), 1000))
    assert hinted(small_side(few))
    assert not hinted(small_side(few, max_rows=9))
    assert not hinted(small_side(few, max_bytes=9000))
