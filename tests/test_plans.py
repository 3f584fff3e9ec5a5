"""What the plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

from checks import views as v
from trafficlens.operators import admission, health, kpi, pricing, routing, text_safety
from trafficlens.plans.sides import small_side
from trafficlens.sources import ledger


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_dimension_joins_do_not_shuffle_calls(spark, sf_dir):
    t, b = v.traffic(spark, sf_dir), v.budgets(spark)
    for df in (
        pricing.request_cost(t, v.backends(spark)),
        admission.requests_with_budget(t, b),
        admission.known_key_filter(t, b),
        routing.native_model_map(t.select("event_id", "backend"), v.backends(spark)),
    ):
        p = plan(df)
        assert "BroadcastHashJoin" in p and "Exchange hashpartitioning" not in p


def test_a_large_dimension_is_not_broadcast(spark):
    dim = spark.range(50).withColumnRenamed("id", "k")
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString().lower()
    assert hinted(small_side(dim, 50)) and not hinted(small_side(dim, 49))


def test_only_needed_columns_are_read(spark, sf_dir):
    p = plan(kpi.spend_per_backend(pricing.request_cost(v.traffic(spark, sf_dir), v.backends(spark))))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", p).group(1)
    assert schema == "event_id:bigint,props:string"


def test_period_filter_reaches_the_scan(spark, sf_dir):
    early = v.table(spark, sf_dir, "events").where(F.col("ts") < F.lit("2024-01-05").cast("timestamp_ntz"))
    assert "PushedFilters: [IsNotNull(ts), LessThan(ts," in plan(early)


@pytest.mark.parametrize("rows_per_slice", [1_000_000, 1_500])
def test_windows_are_split_inside_keys(spark, sf_dir, rows_per_slice):
    """Every row window is partitioned by slice; the rows are shuffled once."""
    t = v.traffic(spark, sf_dir)
    ok = F.col("status") == "success"
    p = plan(health.breaker_trace(t, ok, rows_per_slice=rows_per_slice))
    assert "SinglePartition" not in p
    row_sides = re.findall(r"Exchange hashpartitioning\(backend#\d+, __slice", p)
    assert len(row_sides) <= 2  # the rows, and the narrow rows of the keys that are cut
    if rows_per_slice == 1_500:
        assert "BroadcastHashJoin" in p


def test_global_order_uses_no_single_task_over_rows(spark, sf_dir):
    p = plan(routing.round_robin_assign(v.traffic(spark, sf_dir), ["a", "b"], rows_per_slice=1_500))
    # the only single partition is the table with one row per slice
    assert p.count("SinglePartition") <= 1
    assert "Exchange hashpartitioning(__slice" in p


def test_text_operators_stay_in_the_jvm(spark, sf_dir):
    docs = v.docs_injected(spark, sf_dir)
    for df in (text_safety.redact_pii(docs), text_safety.pii_vault_mask(docs),
               text_safety.guardrail_scan(docs, "doc_id", "doc_id")):
        assert "Python" not in plan(df) and "ArrowEvalPython" not in plan(df)


def test_topk_does_not_sort_the_table(spark, sf_dir):
    assert "TakeOrderedAndProject" in plan(kpi.recent_requests(v.calls(spark, sf_dir)))


def test_aggregates_combine_before_the_shuffle(spark, sf_dir):
    calls = v.calls(spark, sf_dir)
    states = calls.select("backend", F.lit("OPEN").alias("state"),
                          F.lit(1).alias("consecutive_failures"),
                          F.col("ts").alias("last_failure_time"), "ts", "event_id")
    for df in (kpi.traffic_kpis(calls), kpi.spend_by_period(calls), kpi.latency_histogram(calls),
               ledger.upsert_breakers(states, ["ts", "event_id"])):
        assert re.search(r"partial_(count|sum|max_by|maxby)", plan(df))
