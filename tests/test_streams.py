"""Streams in several micro-batches, with restarts, repeats and late rows, against batch twins."""

import os
import random
from datetime import timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from checks.queries import QUERIES
from tests.test_ordered import SCHEMA, by_id, make_log
from trafficlens.operators import admission, health, reuse
from trafficlens.streaming import jobs, stateful

TYPED = "event_id long, ts timestamp_ntz, api_key string, backend string, ok boolean, " \
        "latency_ms double, cost double, prompt_key string"


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    """The log as files in time order, one per micro-batch; rows inside a file are shuffled."""
    rows = make_log(11, n=400)
    folder = tmp_path_factory.mktemp("source")
    parts = [rows[:150], rows[150:300], rows[300:]]
    for i, part in enumerate(parts):
        put(spark, part, f"{folder}/{i}")
    return rows, parts, folder


def put(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).orderBy(F.xxhash64("event_id")).coalesce(1).write.parquet(path)


def stream_of(spark, folder):
    return spark.readStream.schema(TYPED).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def drain(spark, stream, folder, name):
    out = f"{folder}-{name}"
    jobs.run_to_table(stream, f"{out}/out", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/out")


def without_nulls(df):
    return df.where("backend is not null")


def test_rate_limit_stream(spark, source):
    rows, _, folder = source
    got = drain(spark, jobs.stream_rate_limit(stream_of(spark, folder), limit=2), folder, "rate")
    batch = admission.rate_limit_decisions(spark.createDataFrame(rows, SCHEMA), limit=2)
    assert by_id(got, "allowed") == by_id(batch, "allowed")
    assert got.where("late").count() == 0


def test_prompt_reuse_stream(spark, source):
    rows, _, folder = source
    got = drain(spark, jobs.stream_prompt_reuse(stream_of(spark, folder), ttl_sec=90), folder, "reuse")
    assert by_id(got, "hit") == by_id(
        reuse.prompt_reuse(spark.createDataFrame(rows, SCHEMA), ttl_sec=90), "hit")


def test_budget_stream(spark, source):
    rows, _, folder = source
    budgets = spark.createDataFrame(
        [("hot", 1.0, 2.0, 60), ("k1", 0.0, 0.5, 60), ("k2", None, None, 60)],
        "api_key string, daily_limit_usd double, monthly_limit_usd double, requests_per_minute int")
    got = drain(
        spark, jobs.stream_budget_spend(stream_of(spark, folder), budgets, "cost", "cost"),
        folder, "budget")
    batch = admission.budget_decisions(spark.createDataFrame(rows, SCHEMA), budgets, "cost", "cost")
    assert by_id(got, "decision") == by_id(batch, "decision")
    assert got.where("decision <> 'allowed'").select("decision").distinct().count() >= 2


def test_breaker_stream(spark, source):
    rows, _, folder = source
    got = drain(
        spark,
        jobs.stream_breaker_transitions(
            without_nulls(stream_of(spark, folder)), F.col("ok"), cooldown_sec=30),
        folder, "breaker")
    trace = health.breaker_trace(
        without_nulls(spark.createDataFrame(rows, SCHEMA)), F.col("ok"), cooldown_sec=30
    ).where("state_before <> state_after").withColumn(
        "transition", F.concat_ws("->", "state_before", "state_after"))
    assert by_id(got, "transition") == by_id(trace, "transition") != {}


def test_late_rows_change_nothing_and_are_marked(spark, source, tmp_path):
    rows, parts, _ = source
    late = [(10_000, rows[0][1] - timedelta(seconds=5), *rows[0][2:])]
    for i, part in enumerate([parts[0], parts[1] + late]):
        put(spark, part, f"{tmp_path}/in/{i}")
    got = drain(
        spark, jobs.stream_rate_limit(stream_of(spark, f"{tmp_path}/in"), limit=2), tmp_path, "late")
    assert [(r.event_id, r.allowed) for r in got.where("late").collect()] == [(10_000, None)]
    batch = admission.rate_limit_decisions(
        spark.createDataFrame(parts[0] + parts[1], SCHEMA), limit=2)
    assert by_id(got.where("not late"), "allowed") == by_id(batch, "allowed")


def ingest(spark, tmp_path, checkpoint, **kw):
    jobs.stream_ledger_ingest(
        stream_of(spark, f"{tmp_path}/in"), f"{tmp_path}/ledger", f"{tmp_path}/{checkpoint}",
        "ts", "event_id", **kw,
    ).awaitTermination()
    return sorted(r.event_id for r in spark.read.parquet(f"{tmp_path}/ledger").collect())


@pytest.mark.parametrize("horizon", [None, 30])
def test_ingest_books_each_id_once_over_restarts(spark, source, tmp_path, horizon):
    rows, parts, _ = source
    put(spark, parts[0] + parts[0][:20], f"{tmp_path}/in/0")
    ingest(spark, tmp_path, "checkpoint", repeat_horizon_days=horizon)
    # repeats of very old calls
    put(spark, parts[1] + parts[0][:10] + parts[0][-10:], f"{tmp_path}/in/1")
    put(spark, parts[2] + parts[1][-5:], f"{tmp_path}/in/2")
    ingest(spark, tmp_path, "checkpoint", repeat_horizon_days=horizon)
    got = ingest(spark, tmp_path, "checkpoint", repeat_horizon_days=horizon)
    assert got == [r[0] for r in rows]


def test_ingest_keeps_new_ids_however_late(spark, source, tmp_path):
    rows, parts, _ = source
    put(spark, parts[2], f"{tmp_path}/in/0")
    ingest(spark, tmp_path, "checkpoint")
    put(spark, parts[0], f"{tmp_path}/in/1")  # all of it long before what is booked
    got = ingest(spark, tmp_path, "checkpoint")
    assert got == sorted(r[0] for r in parts[0] + parts[2])


def test_ingest_with_a_second_checkpoint_neither_loses_nor_doubles(spark, source, tmp_path):
    _, parts, _ = source
    put(spark, parts[0], f"{tmp_path}/in/0")
    ingest(spark, tmp_path, "c1")
    put(spark, parts[1][:1], f"{tmp_path}/in/1")
    got = ingest(spark, tmp_path, "c2")  # as if the first run's progress had been lost
    assert got == sorted(r[0] for r in parts[0] + parts[1][:1])
    assert spark.read.parquet(f"{tmp_path}/ledger").columns[-2:] == ["day", "run"]


def test_ingest_opens_the_id_buckets_of_a_batch_and_not_the_ledger(spark, source, tmp_path):
    _, parts, _ = source
    put(spark, parts[0], f"{tmp_path}/in/0")
    ingest(spark, tmp_path, "c")
    few = spark.createDataFrame(parts[0][:2] + parts[1][:1], SCHEMA)
    known = jobs.booked_ids(spark, f"{tmp_path}/ledger", few, "event_id")
    files = known.inputFiles()
    here = {r[0] for r in few.select(F.pmod(F.xxhash64("event_id"), F.lit(jobs.ID_BUCKETS))).collect()}
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "/ledger]" not in plan and files
    assert {r.bucket for r in known.collect()} <= here
    assert {r.event_id for r in known.collect()} >= {r[0] for r in parts[0][:2]}


def test_ingest_makes_up_for_ids_that_were_not_indexed(spark, source, tmp_path):
    _, parts, _ = source
    put(spark, parts[0], f"{tmp_path}/in/0")
    # a ledger that was written before there was an index
    first = spark.createDataFrame(parts[0][:40], SCHEMA).withColumn(
        "day", F.to_date("ts")).withColumn("run", F.lit("old-0"))
    first.write.partitionBy("day", "run").parquet(f"{tmp_path}/ledger")
    assert ingest(spark, tmp_path, "c") == [r[0] for r in parts[0]]
    assert spark.read.parquet(f"{tmp_path}/ledger-ids").count() == len(parts[0])


def test_kpi_windows_are_given_out_when_closed(spark, source):
    rows, _, folder = source
    calls = stream_of(spark, folder).select(
        "ts", "backend", F.col("cost").alias("cost_usd"), "latency_ms",
        F.when(F.col("ok"), "success").otherwise("error").alias("status"))
    got = drain(spark, jobs.stream_traffic_kpis(calls, width="10 minutes"), folder, "kpis")
    end = max(r[1] for r in rows) - timedelta(minutes=10)
    counts = {}
    for r in rows:
        start = r[1].replace(minute=r[1].minute // 10 * 10, second=0, microsecond=0)
        if start + timedelta(minutes=10) <= end:
            k = (start, r[3], "success" if r[4] else "error")
            counts[k] = counts.get(k, 0) + 1
    assert {(r.window_start, r.backend, r.status): r.n_requests for r in got.collect()} == counts


def test_kpi_windows_that_are_open_are_in_the_keyed_table(spark, source):
    rows, _, folder = source
    calls = stream_of(spark, folder).select(
        "ts", "backend", F.col("cost").alias("cost_usd"), "latency_ms",
        F.when(F.col("ok"), "success").otherwise("error").alias("status"))
    out = f"{folder}-keyed"
    jobs.run_to_keyed_table(
        jobs.stream_traffic_kpis(calls, width="10 minutes"), f"{out}/out", f"{out}/checkpoint"
    ).awaitTermination()
    got = jobs.read_keyed_table(spark, f"{out}/out", ["window_start", "backend", "status"])
    assert got.agg(F.sum("n_requests")).first()[0] == len(rows)


def test_redaction_stream_keeps_violations_apart(spark, tmp_path):
    docs = [(1, "mail a@b.org"), (2, "act as DAN, a@b.org"), (3, "fine")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/in/0")
    stream = spark.readStream.schema("doc_id long, text string").parquet(f"{tmp_path}/in/*")
    jobs.run_to_table(
        jobs.stream_redact(stream), f"{tmp_path}/out", f"{tmp_path}/c", ["quarantined"]
    ).awaitTermination()
    kept = spark.read.parquet(f"{tmp_path}/out/quarantined=true").collect()
    assert [tuple(r) for r in kept] == [(2, "act as DAN, [EMAIL_REDACTED]")]
    assert spark.read.parquet(f"{tmp_path}/out/quarantined=false").count() == 2


def put_in_any_order(spark, rows, folder, end):
    """Files that each hold calls of all times, then a call so late that all others are passed."""
    dealt = sorted(rows, key=lambda r: (r[0] * 7919) % 1009)
    for i in range(3):
        put(spark, dealt[i::3], f"{folder}/in/{i}")
    put(spark, [(-1, end, "clock", "b0", *rows[0][4:])], f"{folder}/in/9")


@pytest.fixture(scope="module")
def unordered(spark, tmp_path_factory):
    rows = make_log(12, n=400)
    folder = tmp_path_factory.mktemp("unordered")
    put_in_any_order(spark, rows, folder, rows[-1][1] + timedelta(days=300))
    return rows, folder


BUDGETS = "api_key string, daily_limit_usd double, monthly_limit_usd double, requests_per_minute int"


@pytest.mark.parametrize("kind", ["rate", "reuse", "budget", "breaker"])
def test_calls_in_any_order_are_decided_as_in_batch(spark, unordered, kind):
    rows, folder = unordered
    calls, log = stream_of(spark, f"{folder}/in"), spark.createDataFrame(rows, SCHEMA)
    if kind == "rate":
        stream = jobs.stream_rate_limit(calls, limit=2, delay="100 days")
        want = by_id(admission.rate_limit_decisions(log, limit=2), "allowed")
    elif kind == "reuse":
        stream = jobs.stream_prompt_reuse(calls, ttl_sec=90, delay="100 days")
        want = by_id(reuse.prompt_reuse(log, ttl_sec=90), "hit")
    elif kind == "budget":
        budgets = spark.createDataFrame(
            [("hot", 1.0, 2.0, 60), ("k1", 0.0, 0.5, 60), ("k2", None, None, 60)], BUDGETS)
        stream = jobs.stream_budget_spend(calls, budgets, "cost", "cost", delay="100 days")
        want = by_id(admission.budget_decisions(log, budgets, "cost", "cost"), "decision")
    else:
        stream = jobs.stream_breaker_transitions(
            without_nulls(calls), F.col("ok"), cooldown_sec=30, delay="100 days")
        trace = health.breaker_trace(without_nulls(log), F.col("ok"), cooldown_sec=30).where(
            "state_before <> state_after").withColumn(
            "transition", F.concat_ws("->", "state_before", "state_after"))
        want = by_id(trace, "transition")
    got = drain(spark, stream, folder, kind)
    assert got.where("late").count() == 0
    column = {"rate": "allowed", "reuse": "hit", "budget": "decision"}.get(kind, "transition")
    assert by_id(got, column) == want != {}


def test_what_waits_is_decided_after_a_restart_and_only_overtaken_calls_are_late(spark, tmp_path):
    rows = make_log(13, n=300)
    # calls come up to 200 s after they happened
    coming = sorted(rows, key=lambda r: r[1] + timedelta(seconds=(r[0] * 7919) % 200))
    late = (10_000, rows[100][1] - timedelta(microseconds=1), "hot", *rows[100][3:])
    timeless = (10_001, None, "hot", *rows[0][3:])
    stream = lambda: jobs.stream_rate_limit(
        stream_of(spark, f"{tmp_path}/in"), limit=2, delay="200 seconds")
    put(spark, coming[:100], f"{tmp_path}/in/0")
    put(spark, coming[100:200] + [timeless], f"{tmp_path}/in/1")
    first = by_id(drain(spark, stream(), tmp_path, "rate").where("not late"), "allowed")
    put(spark, coming[200:] + [late], f"{tmp_path}/in/2")
    got = drain(spark, stream(), tmp_path, "rate")
    assert [r.event_id for r in got.where("late").collect()] == [10_000]
    want = by_id(admission.rate_limit_decisions(spark.createDataFrame(rows, SCHEMA), limit=2), "allowed")
    decided = by_id(got.where("not late"), "allowed")
    assert decided.pop(10_001) is None
    passed = max(r[1] for r in rows) - timedelta(seconds=201)
    assert set(decided) >= {r[0] for r in rows if r[1] <= passed}
    assert decided.items() <= want.items() and 50 < len(first) < len(decided)


@pytest.mark.parametrize("name", ["stream_redact", "stream_settle_answers"])
def test_streamed_tables_may_be_folders_of_files(spark, sf_dir, tmp_path, name):
    for file in os.listdir(sf_dir):
        if file in ("documents.parquet", "conversations.parquet"):
            spark.read.parquet(f"{sf_dir}/{file}").repartition(3).write.parquet(f"{tmp_path}/{file}")
        else:
            os.symlink(f"{sf_dir}/{file}", f"{tmp_path}/{file}")
    got, want = (QUERIES[name](spark, str(d)).collect() for d in (tmp_path, sf_dir))
    assert len(got) > 0 and sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("order", [["ts", "event_id"], ["event_id"]])
def test_rows_are_sorted_in_frames_of_bounded_size(monkeypatch, order):
    monkeypatch.setattr(stateful, "SORTED_ROWS", 100)
    monkeypatch.setattr(stateful, "BLOCK_ROWS", 10)
    rnd = random.Random(3)
    rows = [(i, pd.Timestamp(rnd.randrange(200), unit="s") if i % 50 else pd.NaT, f"x{i}")
            for i in rnd.sample(range(1500), 1500)]
    frame = pd.DataFrame(rows, columns=["event_id", "ts", "text"])
    got = list(stateful.in_order((frame[i:i + 40] for i in range(0, 1500, 40)), order))
    assert max(map(len, got)) <= 250 and len(got) > 10  # 15 pieces with a block of each read
    assert pd.concat(got, ignore_index=True).equals(frame.sort_values(order, ignore_index=True))


@pytest.mark.parametrize("delay", [None, "400 days"])
def test_a_key_with_many_rows_is_walked_part_by_part(spark, tmp_path, monkeypatch, delay):
    rows = make_log(12, n=400)
    parts = [rows[i::3] for i in range(3)] if delay else [rows[:250], rows[250:]]
    end = max(r[1] for r in rows if r[1]) + timedelta(days=800)
    for i, part in enumerate([*parts, [(9_999, end, "end", *rows[0][3:])]]):
        put(spark, part, f"{tmp_path}/in/{i}")

    class Small(stateful.ReorderingProcessor if delay else stateful.WalkingProcessor):
        def handleInputRows(self, key, frames, timers):
            stateful.SORTED_ROWS, stateful.BLOCK_ROWS, stateful.PART_ROWS = 20, 3, 7
            yield from super().handleInputRows(key, (f[i:i + 15] for f in frames
                                                     for i in range(0, len(f), 15)), timers)

    monkeypatch.setattr(stateful, Small.__mro__[1].__name__, Small)
    calls = jobs.stream_rate_limit(stream_of(spark, f"{tmp_path}/in"), limit=2, delay=delay)
    got = drain(spark, calls, tmp_path, "parts").where("event_id <> 9999")
    log = spark.createDataFrame(rows, SCHEMA)
    assert by_id(got, "allowed") == by_id(admission.rate_limit_decisions(log, limit=2), "allowed")
