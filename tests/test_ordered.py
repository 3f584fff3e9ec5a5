"""Ordered operators against plain loops, on random logs with one hot key, cut very finely."""

import random
from bisect import bisect_left
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from trafficlens.operators import admission, health, pricing, reuse, routing
from trafficlens.plans import slices as slicing
from trafficlens.plans.slices import Running, running, slices_of

START = datetime(2024, 1, 31, 20, 0, 0)
SCHEMA = (
    "event_id long, ts timestamp_ntz, api_key string, backend string, ok boolean, "
    "latency_ms double, cost double, prompt_key string"
)


def make_log(seed, n=700, gap=20.0, whole_seconds=False):
    """A third of all calls share one key, backend and prompt; some times are equal."""
    rnd = random.Random(seed)
    at, rows = START, []
    for i in range(n):
        step = rnd.expovariate(1 / gap) if rnd.random() < 0.9 else rnd.choice([0, 0, 60, 300])
        at += timedelta(seconds=round(step) if whole_seconds else step)
        hot = rnd.random() < 0.34
        rows.append(
            (
                i,
                at,
                "hot" if hot else f"k{rnd.randrange(6)}",
                "b0" if hot else rnd.choice(["b0", "b1", "b2", None]),
                rnd.random() < 0.6,
                round(rnd.uniform(1, 900), 2),
                rnd.choice([0.0, 0.01, 0.02, 0.05, 0.3]),
                "hot" if hot else f"p{rnd.randrange(40)}",
            )
        )
    return rows


@pytest.fixture(params=[(1, False), (2, True)], ids=["micros", "whole-seconds"])
def log(request, spark):
    rows = make_log(request.param[0], whole_seconds=request.param[1])
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(5)


FINE = {"rows_per_slice": 70}


def by_id(df, *cols):
    return {r["event_id"]: tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]]
            for r in df.collect()}


def test_slices_hold_all_rows_once_and_evenly(log):
    rows, df = log
    s = slices_of(df, "api_key", ["ts", "event_id"], 70)
    sizes = [r["count"] for r in s.assign(df).groupBy("__slice").count().collect()]
    assert sum(sizes) == len(rows) and len(sizes) >= 10 and max(sizes) < 3 * 70
    assert s.number > 1


@pytest.mark.parametrize("key", ["api_key", "backend", None])
def test_running_totals(log, key):
    rows, df = log
    got = by_id(
        running(
            df,
            key,
            ["ts", "event_id"],
            [
                Running("n", "sum", F.lit(1).cast("long")),
                Running("before", "sum", F.lit(1).cast("long"), prior=True),
                Running("last", "max", F.when(F.col("ok"), F.struct("ts", "event_id")), prior=True),
            ],
            **FINE,
        ).select("event_id", "n", "before", F.col("last.event_id").alias("last")),
        "n", "before", "last",
    )
    place = {"api_key": 2, "backend": 3, None: None}[key]
    count, last = {}, {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        k = r[place] if place else None
        count[k] = count.get(k, 0) + 1
        assert got[r[0]] == (count[k], count[k] - 1, last.get(k))
        if r[4]:
            last[k] = r[0]


def test_small_slices_grow_before_there_are_very_many(log, monkeypatch):
    """What is collected to place the cuts grows with their number, so it has a bound."""
    rows, df = log
    monkeypatch.setattr(slicing, "MANY_SLICES", 4)
    s = slices_of(df, "api_key", ["ts", "event_id"], 7)
    sizes = [r["count"] for r in s.assign(df).groupBy("__slice").count().collect()]
    assert 2 <= s.number <= 5 and sum(sizes) == len(rows)
    n = [Running("n", "sum", F.lit(1).cast("long"))]
    got = running(df, "api_key", ["ts", "event_id"], n, 7)
    monkeypatch.undo()
    assert by_id(got, "n") == by_id(running(df, "api_key", ["ts", "event_id"], n), "n")


def test_very_many_slices_are_dealt_out_by_range(log, monkeypatch):
    """Above the listed number, slices come from a range shuffle; their number has no bound."""
    rows, df = log
    asked = [Running("n", "sum", F.lit(1).cast("long")),
             Running("last", "max", F.when(F.col("ok"), F.struct("ts", "event_id")), prior=True)]
    columns = ["event_id", "n", F.col("last.event_id").alias("last")]
    for key in ("api_key", None):
        listed = running(df, key, ["ts", "event_id"], asked, **FINE).select(*columns).collect()
        monkeypatch.setattr(slicing, "LISTED", 3)
        dealt = slices_of(df, key, ["ts", "event_id"], 70)
        assert not dealt.cuts and dealt.number == -(-len(rows) // 70)
        sizes = [r["count"] for r in dealt.assign(df).groupBy("__slice").count().collect()]
        assert sum(sizes) == len(rows) and max(sizes) < 3 * 70
        got = running(df, key, ["ts", "event_id"], asked, **FINE).select(*columns).collect()
        assert sorted(got, key=str) == sorted(listed, key=str)
        monkeypatch.undo()
    want = by_id(health.failure_streaks(df, F.col("ok"), **FINE), "streak")
    monkeypatch.setattr(slicing, "LISTED", 3)
    assert by_id(health.failure_streaks(df, F.col("ok"), **FINE), "streak") == want


@pytest.mark.parametrize(
    "alpha, block",
    [(0.2, 4096), (0.9, 4096), (0.01, 16), (0.0, 8), (1e-9, 8), (1.0, 4096), (1 - 2.0**-53, 4096)],
)
def test_latency_ema(log, alpha, block):
    rows, df = log
    df = df.withColumn("latency_ms", F.when(F.col("event_id") % 7 != 1, F.col("latency_ms")))
    got = by_id(health.latency_ema(df, alpha=alpha, block=block, **FINE), "ema")
    assert len(got) == len(rows)
    ema = {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        prev = ema.get(r[3])
        if r[0] % 7 != 1:
            ema[r[3]] = r[5] if prev is None else alpha * r[5] + (1 - alpha) * prev
        want = ema.get(r[3])
        assert got[r[0]] is None if want is None else got[r[0]] == pytest.approx(want, rel=1e-12)


def test_latency_ema_of_no_rows_and_wrong_alpha(log):
    _, df = log
    assert health.latency_ema(df.limit(0)).isEmpty()
    with pytest.raises(ValueError):
        health.latency_ema(df, alpha=1.5)


def test_breaker_trace(log):
    rows, df = log
    got = by_id(
        health.breaker_trace(df, F.col("ok"), threshold=3, cooldown_sec=40, **FINE),
        "streak", "state_before", "state_after",
    )
    state = {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        now, fails, failed_at = state.get(r[3], ("CLOSED", 0, None))
        if now == "OPEN" and (r[1] - failed_at).total_seconds() >= 40:
            now = "HALF_OPEN"
        before = now
        if r[4]:
            now, fails, failed_at = "CLOSED", 0, None
        else:
            fails, failed_at = fails + 1, r[1]
            if before == "HALF_OPEN" or fails >= 3:
                now = "OPEN"
        state[r[3]] = (now, fails, failed_at)
        assert got[r[0]] == (fails, before, now)
    stored = {
        r["backend"]: (r["state"], r["consecutive_failures"], r["last_failure_time"])
        for r in health.breaker_states(df.where("backend is not null"), F.col("ok")).collect()
    }
    assert stored == {k: s for k, s in state.items() if k is not None}


def limiter(rows, key, limit, window, live):
    accepted, out = {}, {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        kept = [t for t in accepted.get(r[key], []) if live((r[1] - t) / timedelta(seconds=1), window)]
        out[r[0]] = len(kept) < limit
        accepted[r[key]] = kept + [r[1]] if out[r[0]] else kept
    return out


@pytest.mark.parametrize(
    "limit, window, hot_rows",
    [(2, 60, 10**6), (1, 300, 10**6), (0, 60, 10**6), (60, 60, 10**6), (2, 60, 70), (1, 300, 110)],
)
def test_rate_limit(log, limit, window, hot_rows):
    rows, df = log
    got = by_id(
        admission.rate_limit_decisions(
            df, limit=limit, window_sec=window, max_group_rows=hot_rows, **FINE
        ),
        "allowed",
    )
    assert got == limiter(rows, 2, limit, window, lambda age, w: age < w)


def test_rate_limit_per_key(log, spark):
    rows, df = log
    budgets = spark.createDataFrame(
        [("hot", 1.0, 1.0, 3), ("k1", 1.0, 1.0, None)],
        "api_key string, daily_limit_usd double, monthly_limit_usd double, requests_per_minute int",
    )
    got = by_id(admission.rate_limit_decisions(df, budgets, window_sec=90, **FINE), "allowed")
    hot = limiter([r for r in rows if r[2] == "hot"], 2, 3, 90, lambda a, w: a < w)
    rest = limiter([r for r in rows if r[2] != "hot"], 2, 60, 90, lambda a, w: a < w)
    assert got == {**hot, **rest}


def test_rate_utilisation(log):
    rows, df = log
    got = by_id(admission.rate_utilisation(df, F.lit(4), 60, **FINE), "prior_calls")
    seen = {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        live = [t for t in seen.get(r[2], []) if (r[1] - t).total_seconds() < 60]
        assert got[r[0]] == len(live)
        seen[r[2]] = live + [r[1]]


@pytest.mark.parametrize("ttl, hot_rows", [(30, 10**6), (300, 10**6), (300, 70)])
def test_prompt_reuse(log, ttl, hot_rows):
    rows, df = log
    got = by_id(
        reuse.prompt_reuse(df, ttl_sec=ttl, max_group_rows=hot_rows, **FINE), "hit"
    )
    stored = {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        at = stored.get(r[7])
        hit = at is not None and (r[1] - at) / timedelta(seconds=1) <= ttl
        if not hit:
            stored[r[7]] = r[1]
        assert got[r[0]] == hit


@pytest.mark.parametrize("capacity", [1, 25, 1000])
def test_reuse_distance_and_bounded_cache(log, capacity):
    rows, df = log
    found = by_id(reuse.reuse_distance(df, capacity=capacity, **FINE), "distance", "resident")
    whole = reuse.reuse_distance(df, capacity=capacity)  # one slice
    assert by_id(whole, "distance", "resident") == found
    hits = by_id(
        reuse.prompt_reuse(df, ttl_sec=400, capacity=capacity, rows_per_slice=70), "hit"
    )
    cache = {}  # insertion order is the order of last touch
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        keys = list(cache)
        at = cache.pop(r[7], None)
        distance = None if at is None else len(keys) - 1 - keys.index(r[7])
        assert found[r[0]] == (distance, at is not None)
        hit = at is not None and (r[1] - at) / timedelta(seconds=1) <= 400
        assert hits[r[0]] == hit
        cache[r[7]] = at if hit else r[1]
        if len(cache) > capacity:
            cache.pop(next(iter(cache)))


@pytest.mark.parametrize("hot_rows", [10**6, 80], ids=["one pass", "stepwise"])
def test_budget_decisions(log, spark, hot_rows):
    rows, df = log
    limits = {"hot": (1.0, 2.5), "k0": (0.3, 0.9), "k1": (0.0, None), "k2": (None, 0.6),
              "k3": (50.0, 100.0)}
    budgets = spark.createDataFrame(
        [(k, d, m, 60) for k, (d, m) in limits.items()],
        "api_key string, daily_limit_usd double, monthly_limit_usd double, requests_per_minute int",
    )
    est = df.withColumn("estimate", F.col("cost") + 0.01)
    got = by_id(
        admission.budget_decisions(
            est, budgets, "estimate", "cost", max_group_rows=hot_rows, **FINE
        ),
        "decision",
    )
    day, month = {}, {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        k, cost = r[2], r[6]
        if k not in limits:
            assert got[r[0]] == "no_budget"
            continue
        dk, mk = (k, r[1].date()), (k, r[1].month)
        d, m = limits[k]
        if d and day.get(dk, 0.0) + (cost + 0.01) > d:
            want = "daily_exceeded"
        elif m and month.get(mk, 0.0) + (cost + 0.01) > m:
            want = "monthly_exceeded"
        else:
            want = "allowed"
            day[dk] = day.get(dk, 0.0) + cost
            month[mk] = month.get(mk, 0.0) + cost
        assert got[r[0]] == want


def test_budget_of_a_small_case(spark):
    """0.6 spent and 0.5 more expected is over a limit of 1.0; nothing spent is not."""
    rows = [(1, START, "a", 0.6), (2, START, "a", 0.5), (3, START, "b", 0.5)]
    calls = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, api_key string, cost double")
    budgets = spark.createDataFrame(
        [("a", 1.0, 10.0), ("b", 1.0, 10.0)],
        "api_key string, daily_limit_usd double, monthly_limit_usd double",
    )
    got = by_id(admission.budget_decisions(calls, budgets, "cost", "cost"), "decision")
    assert got == {1: "allowed", 2: "daily_exceeded", 3: "allowed"}


def test_asof_lookups(log):
    rows, df = log
    requests = df.select("event_id", "ts", "backend")
    emas = df.where(F.col("ok") & F.col("backend").isNotNull()).select(
        "backend", "ts", "event_id", F.col("latency_ms").alias("ema")
    )
    facts = sorted((r[1], r[0], r[5], r[3]) for r in rows if r[4] and r[3] is not None)
    for strict in (True, False):
        got = by_id(routing.latest_ema_asof(requests, emas, strictly_before=strict, **FINE), "ema")
        for r in rows:
            seen = [f for f in facts if f[3] == r[3] and (f[0] < r[1] if strict else f[0] <= r[1])]
            assert got[r[0]] == (seen[-1][2] if seen else 9999.0)


def test_key_cooldown_audit_uses_the_latest_mark(log):
    rows, df = log
    marks = df.where(~F.col("ok")).select(
        "event_id", "api_key", "ts", (F.col("event_id") % 90).cast("double").alias("cooldown_sec")
    )
    got = {
        r["event_id"] for r in routing.key_cooldown_audit(
            df.select("event_id", "api_key", "ts"), marks, **FINE).collect()
    }
    failed = sorted((r[1], r[0], r[2]) for r in rows if not r[4])
    want = set()
    for r in rows:
        seen = [f for f in failed if f[2] == r[2] and f[0] < r[1]]
        if seen and r[1] < seen[-1][0] + timedelta(seconds=seen[-1][1] % 90):
            want.add(r[0])
    assert got == want


def test_round_robin(log):
    rows, df = log
    got = by_id(routing.round_robin_assign(df, ["key1", "key2", "key3"], **FINE), "assigned")
    for i, r in enumerate(sorted(rows, key=lambda r: (r[1], r[0]))):
        assert got[r[0]] == ["key1", "key2", "key3"][i % 3]


def test_latency_first_ranking(log, spark):
    rows, df = log
    backends = spark.createDataFrame(
        [("b0", 0, "m0", 3.0, 1.0), ("b1", 1, "m1", 1.0, 1.0), ("b2", 2, "m2", 2.0, 1.0)],
        "backend string, cfg_idx int, model string, cost_per_1k_prompt double, "
        "cost_per_1k_completion double",
    )
    emas = df.where("backend is not null").select(
        "backend", "ts", "event_id", F.col("latency_ms").alias("ema")
    )
    ranked = routing.rank_backends(
        df.select("event_id", "ts"), backends, "latency_first", emas, **FINE
    ).where("rank = 1")
    got = by_id(ranked, "backend")
    facts = sorted((r[1], r[0], r[5], r[3]) for r in rows if r[3] is not None)
    times = [f[0] for f in facts]
    for r in rows:
        latest = {"b0": 9999.0, "b1": 9999.0, "b2": 9999.0}
        for f in facts[: bisect_left(times, r[1])]:
            latest[f[3]] = f[2]
        assert got[r[0]] == min(latest, key=lambda b: (latest[b], b))


def test_one_probe_at_a_time(spark):
    """After the cool-down one request may try the backend; others wait for that probe's outcome."""
    at = lambda s: START + timedelta(seconds=s)
    outcomes = [(i, at(t), "b0", ok) for i, (t, ok) in enumerate(
        [(1, False), (2, False), (3, False), (60, False), (95, True)])]
    trace = health.breaker_trace(
        spark.createDataFrame(outcomes, "event_id long, ts timestamp_ntz, backend string, ok boolean"),
        F.col("ok"), cooldown_sec=30)
    backends = spark.createDataFrame([("b0", 0), ("b1", 1)], "backend string, cfg_idx int")
    asked = [2.5, 4, 33, 40, 41, 42, 61, 90, 90, 91, 96, 97]
    requests = spark.createDataFrame(
        [(100 + i, at(t)) for i, t in enumerate(asked)], "event_id long, ts timestamp_ntz")
    got = by_id(routing.request_available_backends(requests, backends, trace, 30), "available")
    may = ["b0" in got[100 + i] for i in range(len(asked))]
    assert may == [True, False, True, False, False, False, False, True, False, False, True, True]
    assert all("b1" in a for a in got.values())


def test_availability_against_plain_loop(log, spark):
    rows, df = log
    trace = health.breaker_trace(df.where("backend is not null"), F.col("ok"), threshold=2,
                                 cooldown_sec=100, **FINE)
    names = ["b0", "b1", "b2"]
    backends = spark.createDataFrame([(b, i) for i, b in enumerate(names)], "backend string, cfg_idx int")
    requests = df.select((F.col("event_id") + 10_000).alias("event_id"),
                         (F.col("ts") + F.expr("interval 7 seconds")).alias("ts"))
    got = by_id(routing.request_available_backends(requests, backends, trace, 100, **FINE), "available")
    facts = [(r[1], 1, r[0], r[3], r[4]) for r in rows if r[3] is not None]
    asks = [(r[1] + timedelta(seconds=7), 0, r[0] + 10_000, None, None) for r in rows]
    state = {b: ("CLOSED", 0, None) for b in names}
    for now, kind, i, b, ok in sorted(facts + asks, key=lambda e: e[:3]):
        if kind:
            now_state, fails, _ = state[b]
            fails = 0 if ok else fails + 1
            state[b] = ("OPEN" if fails >= 2 else "CLOSED", fails, now)
            continue
        may = []
        for name in names:
            s, fails, failed = state[name]
            if s == "OPEN" and (now - failed).total_seconds() >= 100:
                state[name] = ("HALF_OPEN", fails, failed)
                may.append(name)
            elif s == "CLOSED":
                may.append(name)
        assert got[i] == may


def test_utc_keys_in_another_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        calls = spark.sql("""select 1 as event_id, 'a' as api_key, 0.6 as cost,
          timestamp '2024-01-01 02:00:00 UTC' as ts, timestamp_ntz '2024-01-01 02:00:00' as wall
          union all select 2, 'a', 0.6, timestamp '2023-12-31 23:00:00 UTC', timestamp_ntz '2023-12-31 23:00:00'
          union all select 3, 'a', 0.6, timestamp '1969-12-31 23:59:59.5 UTC', null""")
        for ts in ("ts", "wall"):
            got = {r.event_id: (r.day, r.month) for r in pricing.utc_period_keys(calls, ts).collect()}
            assert got[1] == ("2024-01-01", "2024-01") and got[2] == ("2023-12-31", "2023-12")
        assert pricing.utc_period_keys(calls).where("event_id = 3").first().day == "1969-12-31"
        budgets = spark.createDataFrame([("a", 1.0, None)],
                                        "api_key string, daily_limit_usd double, monthly_limit_usd double")
        calls = calls.withColumn("cost", F.col("cost").cast("double"))
        assert set(by_id(admission.budget_decisions(calls, budgets, "cost", "cost"), "decision").values()
                   ) == {"allowed"}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
