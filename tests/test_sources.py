"""Reading and updating ledgers, budgets, breakers, settings and wire formats."""

from datetime import date, datetime

from pyspark.sql import functions as F

from trafficlens.operators import health, kpi, pricing, routing
from trafficlens.sources import ledger, wire

BUDGET = "api_key string, daily_limit_usd double, monthly_limit_usd double, requests_per_minute int"
BACKENDS = [
    {"id": "cheap", "provider": "openai", "model": "c", "cost_per_1k_prompt": 0.001,
     "cost_per_1k_completion": 0.002, "capabilities": ["json_mode"], "context_length": 8192},
    {"id": "odd", "provider": "unknown", "model": "x"},
    {"id": "dear", "provider": "anthropic", "model": "d", "cost_per_1k_prompt": 0.01,
     "cost_per_1k_completion": 0.02},
    {"id": "free", "provider": "openai", "model": "f"},
]


def test_settings(spark, tmp_path):
    (tmp_path / "backends.yaml").write_text(
        "backends:\n"
        "  - {id: a, provider: openai, model: m, cost_per_1k_prompt: 0.5, capabilities: [json]}\n"
        "  - {id: b, provider: nobody, model: m}\n"
        "  - {id: c, provider: anthropic, model: n}\n"
    )
    (tmp_path / "budgets.yaml").write_text(
        "budgets:\n  - {api_key: k, daily_limit_usd: 1, monthly_limit_usd: 20}\n"
    )
    got = ledger.load_backends(spark, str(tmp_path)).orderBy("cfg_idx").collect()
    assert [(r.backend, r.cfg_idx, r.cost_per_1k_prompt) for r in got] == [("a", 0, 0.5), ("c", 1, 0.0)]
    assert ledger.load_strategy(str(tmp_path)) == "cost_first"
    (tmp_path / "routing_policy.yaml").write_text("routing: {strategy: complexity}\n")
    assert ledger.load_strategy(str(tmp_path)) == "complexity"
    assert tuple(ledger.load_budget_config(spark, str(tmp_path)).first()) == ("k", 1.0, 20.0, 60)
    assert ledger.load_backends(spark, str(tmp_path / "none")).count() == 0


def test_budget_changes(spark):
    base = spark.createDataFrame([("a", 1.0, 2.0, 7), ("b", 3.0, 4.0, 30), ("z", 9.0, 9.0, 9)], BUDGET)
    changes = spark.createDataFrame(
        [
            (1, "admin", "a", 5.0, 6.0, None),
            (2, "config", "b", 7.0, 8.0, None),
            (3, "admin", "b", 7.5, 8.5, 11),
            (4, "admin", "b", 7.6, 8.6, None),
            (5, "admin", "n", 1.0, 1.0, None),
            (6, "config", "m", 1.0, 1.0, 5),
            (7, "admin", "m", 2.0, 2.0, None),
        ],
        "seq int, source string, " + BUDGET,
    )
    got = {r[0]: tuple(r)[1:] for r in ledger.upsert_budgets(base, changes).collect()}
    assert got == {
        "a": (5.0, 6.0, 7, True), "b": (7.6, 8.6, 11, True), "z": (9.0, 9.0, 9, None),
        "n": (1.0, 1.0, 60, False), "m": (2.0, 2.0, 5, True),
    }


def test_ledger_ids_stay_unique(spark):
    old = spark.createDataFrame([("r1", 1.0)], "id string, cost_usd double")
    new = spark.createDataFrame(
        [("r2", 5.0, 2), ("r2", 4.0, 1), ("r1", 3.0, 3), ("r3", 2.0, 4)],
        "id string, cost_usd double, seq int",
    )
    got = {tuple(r) for r in ledger.append_ledger(old, new, ["seq"]).collect()}
    assert got == {("r1", 1.0), ("r2", 4.0), ("r3", 2.0)}


def test_request_fact_is_pruned_by_day(spark, tmp_path):
    rows = [(f"r{i}", "k", "b", "m", 1, 2, 0.1, 5.0, datetime(2024, 1, 1 + i % 3, 5)) for i in range(9)]
    path = str(tmp_path / "requests")
    ledger.write_requests(spark.createDataFrame(rows, ledger.REQUEST_SCHEMA), path)
    read = ledger.load_requests(spark, path)
    assert read.count() == 9
    one = read.where(F.col("day") == date(2024, 1, 2))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and one.count() == 3


def test_spend_starts_over_by_itself(spark):
    rows = [("a", datetime(2024, 1, 31, 23), 1.0), ("a", datetime(2024, 2, 1, 1), 2.0),
            ("a", datetime(2024, 2, 2, 1), 4.0), ("b", datetime(2024, 1, 31, 1), 8.0)]
    calls = spark.createDataFrame(rows, "api_key string, ts timestamp_ntz, cost_usd double")
    assert [tuple(r) for r in kpi.spend_now(calls, date(2024, 2, 2)).collect()] == [("a", 4.0, 6.0)]
    budgets = spark.createDataFrame([("a", 1.0, 2.0, 5), ("c", 1.0, 2.0, None)], BUDGET)
    listed = {r.api_key: (r.spend_today, r.spend_month)
              for r in ledger.load_budgets(budgets, kpi.spend_now(calls, date(2024, 2, 2))).collect()}
    assert listed == {"a": (4.0, 6.0), "c": (0.0, 0.0)}
    assert {r[0]: r[1] for r in ledger.load_budgets(budgets).collect()} == {"a": 5, "c": 60}


def test_kpis_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "backend string, cost_usd double, latency_ms double")
    assert tuple(kpi.traffic_kpis(empty).first()) == (0, 0, 0.0, 0.0, 0.0)


def test_bodies(spark):
    bodies = ['{"messages": [{"role": "user", "content": "hi"}], "model": "m", "n": 2}',
              '{"messages": []}', '{"model": "m"}', "not json", None]
    df = spark.createDataFrame(list(enumerate(bodies)), "i int, body string")
    got = wire.parse_chat_bodies(df).orderBy("i").collect()
    assert [r.code for r in got] == [200, 400, 400, 400, 400]
    assert got[0].params == {"n": "2"} and got[0].messages[0].content == "hi"


def test_streamed_lines(spark):
    lines = [
        (1, 0, 'data: {"id":"x","choices":[{"delta":{"content":"Hel"}}]}'),
        (1, 1, "event: ping"), (1, 2, "data: {bad"), (1, 3, ""),
        (1, 4, '  data: {"id":"x","choices":[{"delta":{"content":"lo"}}]} '),
        (1, 5, "data: [DONE]"), (1, 6, 'data: {"id":"x","choices":[{"delta":{"content":"!"}}]}'),
        (2, 0, 'data: {"type":"message_start","message":{"id":"msg"}}'),
        (2, 1, 'data: {"type":"content_block_delta","delta":{"type":"text_delta","text":"A"}}'),
        (2, 2, 'data: {"type":"content_block_delta","delta":{"type":"other","text":"B"}}'),
        (2, 3, 'data: {"type":"message_stop"}'),
        (2, 4, 'data: {"type":"content_block_delta","delta":{"type":"text_delta","text":"C"}}'),
    ]
    df = spark.createDataFrame(lines, "stream_id long, seq int, line string")
    for rows_per_slice in (1_000_000, 2):
        got = wire.parse_sse_chunks(df, rows_per_slice).orderBy("stream_id", "seq").collect()
        assert [tuple(r) for r in got] == [
            (1, 0, "x", "Hel", None), (1, 4, "x", "lo", None),
            (2, 1, "msg", "A", None), (2, 3, "msg", None, "stop"),
        ]


def test_service_log_lines(spark):
    messages = [
        "Routing request to cheap using model qwen2.5:0.5b (attempt 1/3)",
        "Transient failure on cheap (boom (x)). Retrying in 2s...",
        "Backend cheap failed after 3 attempts: boom", "Opening stream routing to b using model m",
        "Backend stream startup on b failed: no route", "Circuit breaker closed (healthy).",
    ]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(messages)], "i int, m string").select(
        "i", F.to_json(F.struct(F.col("m").alias("message"), F.lit("INFO").alias("level"))).alias("line")
    )
    got = [
        (r.kind, r.backend, r.model, r.attempt, r.max_attempts, r.backoff_s, r.error)
        for r in wire.parse_service_logs(df).orderBy("i").collect()
    ]
    assert got == [
        ("route", "cheap", "qwen2.5:0.5b", 1, 3, None, None),
        ("retry", "cheap", None, None, None, 2, "boom (x)"),
        ("exhausted", "cheap", None, None, 3, None, "boom"),
        ("stream_open", "b", "m", None, None, None, None),
        ("stream_failed", "b", None, None, None, None, "no route"),
    ]


def test_ranking_and_breakers(spark):
    backends = ledger.backends_from(spark, BACKENDS)
    requests = spark.createDataFrame([(1, True), (2, False)], "event_id int, complex boolean")

    def order(strategy, backends=backends):
        got = routing.rank_backends(requests, backends, strategy).orderBy("event_id", "rank").collect()
        return [[r.backend for r in got if r.event_id == i] for i in (1, 2)]

    assert order("cost_first") == [["free", "cheap", "dear"]] * 2
    assert order("complexity") == [["dear", "cheap", "free"], ["free", "cheap", "dear"]]
    assert order("capability") == [["cheap", "dear", "free"]] * 2

    at = datetime(2024, 1, 1, 12)
    states = spark.createDataFrame(
        [("cheap", "OPEN", 3, datetime(2024, 1, 1, 11, 59, 45)),
         ("dear", "OPEN", 4, datetime(2024, 1, 1, 11, 59, 30)),
         ("free", "HALF_OPEN", 3, datetime(2024, 1, 1, 11))],
        ledger.BREAKER_SCHEMA,
    )
    seen = {r.backend: (r.available, r.state)
            for r in health.available_backends(backends, states, at).collect()}
    assert seen == {"cheap": (False, "OPEN"), "dear": (True, "HALF_OPEN"), "free": (False, "HALF_OPEN")}
    up = health.available_backends(backends, states, at).where("available")
    assert order("cost_first", up) == [["dear"]] * 2


def test_preflight_without_a_backend_costs_nothing(spark):
    requests = spark.createDataFrame(
        [("r1", 1000, None), ("r2", 1000, 1000)], "request_id string, prompt_tokens long, max_tokens long")
    backends = ledger.backends_from(spark, BACKENDS[:1])
    first = routing.first_backend(requests.where("request_id = 'r1'").select("request_id"), backends)
    got = {r.request_id: r.estimate_usd for r in pricing.preflight_cost(requests, first).collect()}
    assert abs(got["r1"] - (0.001 + 0.256 * 0.002)) < 1e-12 and got["r2"] == 0.0


def test_failover(spark):
    attempts = spark.createDataFrame(
        [("r", 0, "a", 0, False), ("r", 1, "a", 1, False), ("r", 2, "a", 2, False), ("r", 3, "b", 0, True),
         ("s", 0, "a", 0, False), ("s", 1, "a", 1, False), ("s", 2, "a", 2, False)],
        "request_id string, seq int, backend string, attempt int, ok boolean",
    )
    got = {r[0]: tuple(r)[1:] for r in routing.failover_summary(attempts).collect()}
    assert got == {"r": ("b", 4, 1, 3.0, "success"), "s": (None, 3, 1, 3.0, "failed")}
