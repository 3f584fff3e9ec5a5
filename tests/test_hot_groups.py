"""Groups that are cut into many steps or chains, against plain loops."""

import os
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from trafficlens.operators import admission, reuse
from trafficlens.plans import ordered_fold, scratch, successors

START = datetime(2024, 1, 31, 20, 0, 0)


def calls_of(spark, gaps, seed=5):
    rnd, at, rows = random.Random(seed), START, []
    for i, gap in enumerate(gaps):
        at += timedelta(seconds=gap)
        rows.append((i, at, "hot" if rnd.random() < 0.8 else "k", rnd.choice([0.01, 0.02, 0.05, 0.1]),
                     rnd.random() < 0.5))
    schema = "event_id long, ts timestamp_ntz, api_key string, cost double, stores boolean"
    return rows, spark.createDataFrame(rows, schema).repartition(4)


def by_id(frame, c):
    return {r["event_id"]: r[c] for r in frame.collect()}


@pytest.fixture
def rounds(monkeypatch, tmp_path):
    """How many rounds of walks there were."""
    monkeypatch.setattr(ordered_fold, "scratch_dir", lambda spark, label: str(tmp_path / label))
    return lambda: len([d for d in os.listdir(tmp_path / "hot-walk") if d.startswith("__round")])


def limiter(rows, limit, window):
    accepted, out = {}, {}
    for i, ts, key, *_ in rows:
        live = [t for t in accepted.get(key, []) if (ts - t) / timedelta(seconds=1) < window]
        out[i] = len(live) < limit
        accepted[key] = [*live, ts] if out[i] else live
    return out


def test_many_steps_take_few_rounds(spark, rounds):
    """Bursts with pauses: what a step leaves does not depend on how it began."""
    rnd = random.Random(1)
    rows, df = calls_of(spark, [rnd.choice([1, 1, 1, 2, 40]) for _ in range(900)])
    got = by_id(admission.rate_limit_decisions(df, limit=3, max_group_rows=15, rows_per_slice=100),
                "allowed")
    assert got == limiter(rows, 3, 60)
    assert rounds() <= 5  # a run of some 700 calls has 47 steps


def test_steps_that_never_agree_are_walked_in_order(spark, rounds):
    """A steady overload: which calls pass depends on the first one for ever."""
    rows, df = calls_of(spark, [1] * 400)
    got = by_id(admission.rate_limit_decisions(df, limit=7, max_group_rows=40, rows_per_slice=100),
                "allowed")
    assert got == limiter(rows, 7, 60)


def test_a_steady_overload_takes_few_rounds(spark, rounds):
    """States depend on each other for ever, and a group could be cut into some 300 steps."""
    rows, df = calls_of(spark, [1] * 400)
    got = by_id(admission.rate_limit_decisions(df, limit=7, max_group_rows=1, rows_per_slice=100),
                "allowed")
    assert got == limiter(rows, 7, 60)
    assert rounds() <= 4


def test_segments_of_some_steps_hand_their_states_on(spark, rounds, monkeypatch):
    """Three steps to a segment, and fewer than the group has."""
    monkeypatch.setattr(ordered_fold, "SEGMENT_ROWS", 75)
    rows, df = calls_of(spark, [1] * 400)
    got = by_id(admission.rate_limit_decisions(df, limit=7, max_group_rows=5, rows_per_slice=100),
                "allowed")
    assert got == limiter(rows, 7, 60)
    assert 3 <= rounds() <= 8


@pytest.mark.parametrize("daily, monthly", [(1.0, 2.5), (0.5, 100.0), (1000.0, 9.0), (0.3, None)])
def test_budget_steps(spark, rounds, daily, monthly):
    rnd = random.Random(2)
    rows, df = calls_of(spark, [rnd.choice([10, 60, 400]) for _ in range(900)], 7)
    budgets = spark.createDataFrame(
        [("hot", daily, monthly), ("k", 1.0, 1.0)],
        "api_key string, daily_limit_usd double, monthly_limit_usd double")
    got = by_id(admission.budget_decisions(df, budgets, "cost", "cost", max_group_rows=20,
                                           rows_per_slice=100), "decision")
    day, month = {}, {}
    limits = {"hot": (daily, monthly), "k": (1.0, 1.0)}
    for i, ts, key, cost, _ in rows:
        d, m = limits[key]
        dk, mk = (key, ts.date()), (key, ts.month)
        if d and day.get(dk, 0.0) + cost > d:
            want = "daily_exceeded"
        elif m and month.get(mk, 0.0) + cost > m:
            want = "monthly_exceeded"
        else:
            want = "allowed"
            day[dk], month[mk] = day.get(dk, 0.0) + cost, month.get(mk, 0.0) + cost
        assert got[i] == want
    assert rounds() <= 12  # of some 30 steps a month


def test_purse_states():
    names = {c: c for c in ("day", "estimate", "cost", "daily", "monthly")}
    day = lambda n, d, limit: {"day": [d] * n, "estimate": [0.1] * n, "cost": [0.1] * n,
                               "daily": [limit] * n, "monthly": [None] * n}
    walk = admission.Purse(names)
    assert walk.walk(day(3, "a", 1.05)) == ["allowed"] * 3
    left = walk.dump()
    # far from the limit a small spend before changes nothing, a larger one may
    other = admission.Purse(names)
    other.walk(day(2, "a", 9.0))
    assert walk.same(other.dump(), None, left)
    other.walk(day(4, "a", 9.0))
    assert not walk.same(other.dump(), None, left)
    assert walk.same(other.dump().replace('"a"', '"z"'), None, left) is False  # the month's spend
    ahead = admission.Purse(names)
    ahead.load(walk.follow(other.dump(), None, left))
    assert ahead.month_spend == pytest.approx(0.9) and ahead.day_spend == pytest.approx(0.9)


def reused(rows, ttl, stores):
    at, out = {}, {}
    for i, ts, key, _, may in rows:
        out[i] = key in at and (ts - at[key]) / timedelta(seconds=1) <= ttl
        if not out[i] and (may or not stores):
            at[key] = ts
    return out


@pytest.mark.parametrize("stores", [None, "stores"])
@pytest.mark.parametrize("gaps", [[0, 0, 1, 3], [1], [0.5, 20, 90], [0]], ids=str)
def test_chain_of_stored_answers(spark, stores, gaps):
    rnd = random.Random(4)
    rows, df = calls_of(spark, [rnd.choice(gaps) for _ in range(500)])
    found = reuse.prompt_reuse(df, "api_key", 60, max_group_rows=30, rows_per_slice=40, stores=stores)
    assert by_id(found, "hit") == reused(rows, 60, stores)


def test_chain_rounds_grow_with_the_logarithm(spark, monkeypatch):
    steps = [(n, i, min(i + rnd, 3000)) for n, seed in (("a", 1), ("b", 2))
             for rnd_ in [random.Random(seed)] for i in range(1, 3000) for rnd in [rnd_.randrange(1, 4)]]
    frame = spark.createDataFrame(steps, "__name string, __at long, __to long")
    firsts = spark.createDataFrame([("a", 1), ("b", 7)], "__name string, __at long")
    written = []
    monkeypatch.setattr(successors, "materialise",
                        lambda df, label: (written.append(label), scratch.materialise(df, label))[1])
    got = {(r[0], r[1]) for r in successors.chain(frame, firsts).collect()}
    nxt = {(n, i): j for n, i, j in steps}
    want = set()
    for n, i in (("a", 1), ("b", 7)):
        while i is not None:
            want.add((n, i))
            i = nxt.get((n, i))
    assert got == want and len(want) > 2000
    assert written.count("strides") <= 12


def test_distinct_between_against_sets():
    rnd = random.Random(9)
    for n, kinds in ((0, 1), (1, 1), (50, 3), (300, 40), (257, 300)):
        codes = [rnd.randrange(kinds) for _ in range(n)]
        want = []
        for i, c in enumerate(codes):
            seen = [j for j in range(i) if codes[j] == c]
            want.append(len(set(codes[seen[-1] + 1:i])) if seen else -1)
        assert reuse.distinct_between(np.array(codes, dtype=np.int64)).tolist() == want
