"""Micro-batches decided by sliced batch operators, against one batch over all rows."""

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tests.test_ordered import SCHEMA, by_id, make_log
from tests.test_streams import put, stream_of
from trafficlens.operators import admission, health
from trafficlens.streaming import sliced


def breaker(spark, folder):
    sliced.sliced_breaker_transitions(
        stream_of(spark, f"{folder}/in"), F.col("ok"), f"{folder}/breaker", f"{folder}/c-breaker",
        threshold=3, cooldown_sec=30, rows_per_slice=40).awaitTermination()
    return sliced.read_decided(spark, f"{folder}/breaker")


def rate(spark, folder):
    sliced.sliced_rate_limit(
        stream_of(spark, f"{folder}/in"), f"{folder}/rate", f"{folder}/c-rate", limit=2,
        max_group_rows=25, rows_per_slice=40).awaitTermination()
    return sliced.read_decided(spark, f"{folder}/rate")


@pytest.mark.parametrize("seed", [21, 22])
def test_micro_batches_decide_as_one_batch_over_a_restart(spark, tmp_path, seed):
    rows = [r for r in make_log(seed, n=400) if r[3] is not None]
    cuts = [0, 90, 100, 230, len(rows)]
    for i in range(3):
        put(spark, rows[cuts[i]:cuts[i + 1]], f"{tmp_path}/in/{i}")
    breaker(spark, tmp_path), rate(spark, tmp_path)
    put(spark, rows[cuts[3]:], f"{tmp_path}/in/3")
    log = spark.createDataFrame(rows, SCHEMA)
    trace = health.breaker_trace(log, F.col("ok"), threshold=3, cooldown_sec=30)
    got = breaker(spark, tmp_path)
    columns = ["state_before", "state_after"]
    assert by_id(got, *columns) == by_id(trace, *columns)
    assert got.where("state_before = 'HALF_OPEN'").count() > 0 == got.where("late").count()
    decided = rate(spark, tmp_path)
    assert by_id(decided, "allowed") == by_id(admission.rate_limit_decisions(log, limit=2), "allowed")
    assert decided.where("not allowed").count() > 0 == decided.where("late").count()


def test_late_and_timeless_rows_are_passed_on_undecided(spark, tmp_path):
    rows = [r for r in make_log(23, n=200) if r[3] is not None]
    late = (10_000, rows[0][1] - timedelta(seconds=5), "hot", "b0", *rows[0][4:])
    timeless = (10_001, None, "hot", "b0", *rows[0][4:])
    put(spark, rows[:100] + [timeless], f"{tmp_path}/in/0")
    put(spark, rows[100:] + [late], f"{tmp_path}/in/1")
    log = spark.createDataFrame(rows, SCHEMA)
    got = rate(spark, tmp_path)
    odd = {r.event_id: (r.allowed, r.late) for r in got.where("event_id >= 10000").collect()}
    assert odd == {10_000: (None, True), 10_001: (None, False)}
    assert by_id(got.where("event_id < 10000"), "allowed") == by_id(
        admission.rate_limit_decisions(log, limit=2), "allowed")
    trace = health.breaker_trace(log, F.col("ok"), threshold=3, cooldown_sec=30)
    assert by_id(breaker(spark, tmp_path).where("event_id < 10000"), "state_after") == by_id(
        trace, "state_after")
