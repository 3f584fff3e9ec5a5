"""Which calls are let in: keys, rates, empty bodies, budgets and the whole funnel."""

from __future__ import annotations

import json
import math
from bisect import bisect_left
from collections import deque
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trafficlens.functions.money import has_limit, utc_date
from trafficlens.functions.text import first_injection
from trafficlens.operators.health import seconds
from trafficlens.plans.ordered_fold import MAX_GROUP_ROWS, ordered_fold
from trafficlens.plans.scratch import materialise
from trafficlens.plans.sides import small_side
from trafficlens.plans.slices import ROWS_PER_SLICE, Running, running
from trafficlens.plans.successors import one_at_a_time

# Rate window and default calls per window.
RATE_WINDOW_SEC = 60
DEFAULT_RATE = 60


def known_key_filter(calls: DataFrame, budgets: DataFrame, unknown: bool = False) -> DataFrame:
    """Calls with a key that has a budget row (or, with ``unknown``, those turned away)."""
    keys = small_side(budgets.select("api_key"))
    return calls.join(keys, "api_key", "left_anti" if unknown else "left_semi")


def nonempty_messages(requests: DataFrame, messages: DataFrame, request: str) -> DataFrame:
    """Requests that have at least one message."""
    return requests.join(messages.select(request).distinct(), request, "left_semi")


def requests_with_budget(calls: DataFrame, budgets: DataFrame) -> DataFrame:
    """Calls with the limits of their key; ``has_budget`` false where there is no budget row."""
    return calls.join(
        small_side(budgets.withColumn("has_budget", F.lit(True))), "api_key", "left"
    ).withColumn("has_budget", F.coalesce("has_budget", F.lit(False)))


class SlidingLog:
    """Accepts a row while fewer than its limit were accepted in the window before it."""

    def __init__(self, ts: str, limit: str, window_us: int, counts: str | None = None):
        self.ts, self.limit, self.window, self.counts = ts, limit, window_us, counts
        self.accepted: deque[int] = deque()
        self.first: int | None = None

    def load(self, state: str | None) -> None:
        self.accepted = deque(json.loads(state)["log"] if state else [])

    def dump(self) -> str:
        return json.dumps({"first": self.first, "log": list(self.accepted)})

    def same(self, entry: str | None, used: str | None, left: str) -> bool:
        """What left the window before the first row does not matter."""
        first = json.loads(left)["first"]

        def live(state):
            return [t for t in (json.loads(state)["log"] if state else []) if first - t < self.window]

        return entry == used or first is None or live(entry) == live(used)

    def follow(self, entry: str | None, used: str | None, left: str) -> str:
        return left

    def walk(self, rows: dict[str, list]) -> list[bool]:
        times, limits = rows[self.ts], rows[self.limit]
        if times and self.first is None:
            self.first = times[0]
        accepted, window, n = self.accepted, self.window, len(times)
        counts = rows[self.counts] if self.counts else None
        out = [False] * n
        steady = n > 0 and min(limits) == max(limits)
        i = 0
        while i < n:
            now, limit = times[i], limits[i]
            while accepted and now - accepted[0] >= window:
                accepted.popleft()
            if len(accepted) < limit:
                if counts is None or counts[i]:
                    accepted.append(now)
                out[i] = True
                i += 1
            elif not steady:
                i += 1
            elif accepted:  # nothing is accepted until the oldest leaves the window
                i = bisect_left(times, accepted[0] + window, i + 1)
            else:
                break
        return out


def sliding_log(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    keep: Sequence[str],
    limit: Column,
    window_us: int,
    decision: str,
    max_group_rows: int = MAX_GROUP_ROWS,
    rows_per_slice: int = ROWS_PER_SLICE,
    counts: str | None = None,
    single: bool = False,
) -> DataFrame:
    """Decide each row by the rows of its key accepted within ``window_us`` before it.

    Rows whose ``counts`` column is false may be accepted, but do not count against later ones. A
    row without a time stays undecided (null).

    Only accepted rows count, so this is a recurrence. Most rows do not need it: time is cut into
    cells one window long, and where a cell and the one before hold no more rows than the limit,
    every row of the cell is accepted whatever happened earlier. That takes one map-side combined
    count per (key, cell). The rest forms runs of neighbouring cells; a run starts at an accepted
    cell or after an empty one, so it needs nothing from before and is walked on its own. With
    ``single`` (a limit of one) runs of more than ``max_group_rows`` are chains of successors.
    """
    ts = order[0]
    width = f"{window_us} microseconds"
    step = F.expr(f"interval {window_us} microsecond")
    timeless = rows.where(F.col(ts).isNull()).select(
        *keep, F.lit(None).cast("boolean").alias(decision)
    )
    # the window function leaves out rows without a time
    celled = rows.withColumn("__limit", limit.cast("long")).withColumn(
        "__cell", F.window(ts, width)["start"]
    )
    cells = celled.groupBy(*keys, "__cell").agg(
        F.count(F.lit(1)).alias("n"), F.min("__limit").alias("lim")
    )
    by_key = Window.partitionBy(*keys).orderBy("__cell")
    near = cells.select(
        *keys,
        "__cell",
        "n",
        "lim",
        (F.lag("__cell").over(by_key) + step == F.col("__cell")).alias("joined"),
        F.lag("n").over(by_key).alias("n_before"),
    )
    judged = near.withColumn(
        "unsafe",
        F.col("n") + F.when(F.col("joined"), F.col("n_before")).otherwise(0) > F.col("lim"),
    )
    lead = lambda c: F.lead(c).over(by_key)
    roles = judged.withColumn(
        "opens", F.coalesce(lead("unsafe") & lead("joined"), F.lit(False)) & ~F.col("unsafe")
    )
    start = F.when(
        F.col("opens") | (F.col("unsafe") & ~F.coalesce("joined", F.lit(False))), F.col("__cell")
    )
    # kept as a table: it is asked for by both kinds of rows and by the walk
    runs = materialise(
        roles.withColumn("__run", F.last(start, ignorenulls=True).over(by_key))
        .where(F.col("unsafe") | F.col("opens"))
        .select(*keys, "__cell", "__run", "n"),
        "cells",
    )
    on = [*keys, "__cell"]
    free = celled.join(runs.select(*on), on, "left_anti").select(
        *keep, F.lit(True).alias(decision)
    )
    extra = [counts] if counts else []
    needed = list(dict.fromkeys([*keys, *order, *keep, *extra, "__limit", "__run"]))
    tight = celled.join(runs, on).select(*needed)
    sizes = runs.groupBy(*keys, "__run").agg(F.sum("n").alias("count"))
    settled = free.unionByName(timeless)
    if single:
        hot = materialise(sizes.where(F.col("count") > max_group_rows), "hot-runs")
        if not hot.isEmpty():
            group = [*keys, "__run"]
            same = [F.col(f"tight.{c}").eqNullSafe(F.col(f"hot.{c}")) for c in group]
            side = small_side(hot.select(*group)).alias("hot")
            long = tight.alias("tight").join(side, same, "left_semi")
            settled = settled.unionByName(one_at_a_time(
                long, group, order, keep, window_us, decision, counts, rows_per_slice))
            tight = tight.alias("tight").join(side, same, "left_anti")
            sizes = sizes.where(F.col("count") <= max_group_rows)
    walked = ordered_fold(
        tight,
        [*keys, "__run"],
        order,
        keep,
        decision,
        T.BooleanType(),
        lambda: SlidingLog(ts, "__limit", window_us, counts),
        max_group_rows,
        rows_per_slice,
        sizes,
    )
    return settled.unionByName(walked)


def rate_limit_decisions(
    calls: DataFrame,
    budgets: DataFrame | None = None,
    limit: int | None = None,
    window_sec: float = RATE_WINDOW_SEC,
    order: Sequence[str] = ("ts", "event_id"),
    keep: Sequence[str] = ("event_id", "api_key", "ts"),
    max_group_rows: int = MAX_GROUP_ROWS,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """``allowed`` per call: fewer than the key's limit were allowed in the window before it."""
    if limit is None and budgets is not None:
        rates = budgets.select("api_key", F.col("requests_per_minute").alias("__rate"))
        calls = calls.join(small_side(rates), "api_key", "left")
        rate = F.coalesce("__rate", F.lit(DEFAULT_RATE))
    else:
        rate = F.lit(DEFAULT_RATE if limit is None else limit)
    return sliding_log(
        calls, ["api_key"], order, keep, rate, int(window_sec * 1_000_000), "allowed",
        max_group_rows, rows_per_slice,
    )


def rate_utilisation(
    calls: DataFrame,
    limit: Column,
    window_sec: float = RATE_WINDOW_SEC,
    order: Sequence[str] = ("ts", "event_id"),
    keep: Sequence[str] = ("event_id", "api_key", "ts"),
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Earlier calls of the key within the window (allowed or not), and their share of the limit.

    A call counts one when it happens and minus one when it leaves the window, so the number in
    the window is a running sum; unlike a range frame it can be cut inside a hot key.
    """
    ts = order[0]
    arrive = calls.withColumn("__limit", limit).withColumn("__leaves", F.lit(1)).withColumn(
        "__d", F.lit(1).cast("long")
    )
    leave = (
        arrive.withColumn(ts, F.col(ts) + seconds(window_sec))
        .withColumn("__leaves", F.lit(0))
        .withColumn("__d", F.lit(-1).cast("long"))
    )
    counted = running(
        arrive.unionByName(leave),
        "api_key",
        [ts, "__leaves", *order[1:]],
        [Running("prior_calls", "sum", F.col("__d"), prior=True)],
        rows_per_slice,
    )
    return counted.where(F.col("__leaves") == 1).select(
        *keep,
        "prior_calls",
        F.when(F.col("__limit") != 0, F.col("prior_calls") / F.col("__limit")).alias(
            "utilisation"
        ),
    )


class Purse:
    """Spend of one key in one month; the daily part starts over each day.

    ``margin`` is how near any comparison with a limit came to equality. While it is well above the
    difference between two states, both give the same decisions.
    """

    def __init__(self, columns: dict[str, str]):
        self.c = columns
        self.load(None)

    def load(self, state: str | None) -> None:
        self.day, self.day_spend, self.month_spend, self.charged = (
            json.loads(state)[:4] if state else (None, 0.0, 0.0, 0))
        self.first, self.margin = None, None

    def dump(self) -> str:
        return json.dumps([self.day, self.day_spend, self.month_spend, self.charged, self.first,
                           self.margin])

    def walk(self, rows: dict[str, list]) -> list[str]:
        c, out = self.c, []
        day, spent_day, spent_month = self.day, self.day_spend, self.month_spend
        near, charged = math.inf if self.margin is None else self.margin, self.charged
        if self.first is None and rows[c["day"]]:
            self.first = rows[c["day"]][0]
        for today, ahead, cost, daily, monthly in zip(
            rows[c["day"]], rows[c["estimate"]], rows[c["cost"]], rows[c["daily"]],
            rows[c["monthly"]],
        ):
            if today != day:
                day, spent_day = today, 0.0
            over = spent_day + ahead - daily if daily else -math.inf
            near = min(near, abs(over))
            if over <= 0:
                over_month = spent_month + ahead - monthly if monthly else -math.inf
                near = min(near, abs(over_month))
            if daily and spent_day + ahead > daily:
                out.append("daily_exceeded")
            elif monthly and spent_month + ahead > monthly:
                out.append("monthly_exceeded")
            else:
                out.append("allowed")
                spent_day += cost
                spent_month += cost
                charged += 1
        self.day, self.day_spend, self.month_spend = day, spent_day, spent_month
        self.charged, self.margin = charged, near if near < math.inf else None
        return out

    @staticmethod
    def _begin(state: str | None, first) -> tuple[float, float, int]:
        """Spend of the first row's day, of the month, and number of charges."""
        day, spent_day, spent_month, charged = json.loads(state)[:4] if state else (None, 0.0, 0.0, 0)
        return spent_day if day == first else 0.0, spent_month, charged

    def same(self, entry: str | None, used: str | None, left: str) -> bool:
        *_, first, margin = json.loads(left)
        a, b = self._begin(entry, first), self._begin(used, first)
        apart = max(abs(a[0] - b[0]), abs(a[1] - b[1]))
        if apart == 0.0 or margin is None:
            return True
        # the sums of a long chain of steps are rounded at other places than one long sum
        end = json.loads(self.follow(entry, used, left))
        rounding = (end[3] + 1) * 2.0 ** -51 * max(abs(end[2]), abs(a[1]), abs(b[1]))
        return margin > 2 * (apart + rounding)

    def follow(self, entry: str | None, used: str | None, left: str) -> str:
        day, spent_day, spent_month, charged, first, margin = json.loads(left)
        a, b = self._begin(entry, first), self._begin(used, first)
        if day == first:
            spent_day = a[0] + (spent_day - b[0]) if a[0] != b[0] else spent_day
        spent_month = a[1] + (spent_month - b[1]) if a[1] != b[1] else spent_month
        return json.dumps([day, spent_day, spent_month, a[2] + charged - b[2], first, margin])


def budget_decisions(
    calls: DataFrame,
    budgets: DataFrame,
    estimate: str = "budget_cost_usd",
    cost: str = "budget_cost_usd",
    order: Sequence[str] = ("ts", "event_id"),
    keep: Sequence[str] = ("event_id", "api_key", "ts"),
    max_group_rows: int = MAX_GROUP_ROWS,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Budget verdict per call: allowed, daily_exceeded, monthly_exceeded or no_budget.

    Only allowed calls are charged. A key's month whose total charge stays within every limit
    needs no walk: the totals come from one map-side combined aggregate per (key, day). The
    other months are walked in time order.
    """
    ts = order[0]
    limits = budgets.select("api_key", "daily_limit_usd", "monthly_limit_usd")
    # a call without a cost or an estimate costs nothing
    calls = calls.withColumns(
        {c: F.coalesce(F.col(c), F.lit(0.0)) for c in dict.fromkeys([estimate, cost])}
    )
    priced = requests_with_budget(calls, limits).select(
        *dict.fromkeys([*keep, "api_key", *order, estimate, cost]),
        "daily_limit_usd",
        "monthly_limit_usd",
        "has_budget",
        utc_date(ts).alias("__day"),
        F.trunc(utc_date(ts), "month").alias("__month"),
    )
    none = priced.where(~F.col("has_budget")).select(*keep, F.lit("no_budget").alias("decision"))
    held = priced.where(F.col("has_budget"))
    # room for the order in which doubles are added up
    fits = lambda spend, limit: ~has_limit(limit) | (spend <= limit * (1 - 1e-9))
    days = held.groupBy("api_key", "__month", "__day").agg(
        F.sum(cost).alias("spend"),
        F.max(F.greatest(F.col(estimate) - F.col(cost), F.lit(0.0))).alias("ahead"),
        F.min(cost).alias("least"),
        F.count(F.lit(1)).alias("n"),
        F.first("daily_limit_usd").alias("daily"),
        F.first("monthly_limit_usd").alias("monthly"),
    )
    months = days.groupBy("api_key", "__month").agg(
        F.min(
            F.coalesce(
                fits(F.col("spend") + F.col("ahead"), F.col("daily")) & (F.col("least") >= 0),
                F.lit(False),
            )
        ).alias("days_fit"),
        (F.sum("spend") + F.max("ahead")).alias("spend"),
        F.first("monthly").alias("monthly"),
        F.sum("n").alias("count"),
    )
    tight_months = months.where(
        ~(F.col("days_fit") & fits(F.col("spend"), F.col("monthly")))
    ).select("api_key", "__month", "count")
    on = ["api_key", "__month"]
    tight_months = materialise(tight_months, "months")
    tight_side = small_side(tight_months.select(*on))
    free = held.join(tight_side, on, "left_anti").select(
        *keep, F.lit("allowed").alias("decision")
    )
    names = {"day": "__day", "estimate": estimate, "cost": cost,
             "daily": "daily_limit_usd", "monthly": "monthly_limit_usd"}
    walked = ordered_fold(
        held.join(tight_side, on, "left_semi").withColumn(
            "__day", F.date_format("__day", "yyyy-MM-dd")
        ),
        on,
        order,
        keep,
        "decision",
        T.StringType(),
        lambda: Purse(names),
        max_group_rows,
        rows_per_slice,
        tight_months,
    )
    return free.unionByName(walked).unionByName(none)


# Stages in the order a request meets them, with the answer code of each.
FUNNEL = [
    ("unknown_key", 401),
    ("rate_limited", 429),
    ("empty", 400),
    ("guardrail", 400),
    ("cache_hit", 200),
    ("over_budget", 429),
    ("no_backend", 503),
    ("failed", 500),
    ("served", 200),
]


def decide_requests(
    requests: DataFrame,
    budgets: DataFrame,
    prompts: DataFrame,
    prompt: str = "prompt_key",
    rate_limit: int | None = None,
    rate_window_sec: float = RATE_WINDOW_SEC,
    ttl_sec: float | None = None,
    order: Sequence[str] = ("ts", "event_id"),
    cost: str = "budget_cost_usd",
    max_group_rows: int = MAX_GROUP_ROWS,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Every request with the answer of each stage it reached, in the order of ``FUNNEL``.

    ``requests`` has an id (the last column of ``order``), api_key, time, prompt, cost, and the
    flags empty, no_backend and failed; ``prompts`` has the text of each prompt once. A stage sees
    only what the stages before let through, and passes the columns of ``requests`` on.

    A call stores its answer in the cache and is charged only when it is served; the budget check
    sees its cost ahead in any case. So the cache depends on the budget and the budget on the cache.
    Both are walked in turn until the budget's answers are those that the cache walk had assumed:
    each turn settles at least one more call in time order, and few turns settle all.
    """
    from trafficlens.operators.reuse import TTL_SEC, prompt_reuse

    keep = requests.columns
    walk = {"max_group_rows": max_group_rows, "rows_per_slice": rows_per_slice}
    known = known_key_filter(requests, budgets)
    rates = rate_limit_decisions(
        known, budgets, rate_limit, rate_window_sec, order, keep, **walk
    ).select(*keep, (~F.col("allowed")).alias("rate_limited"))
    flagged = small_side(
        materialise(
            prompts.where(first_injection(F.col("text")).isNotNull())
            .select(prompt, F.lit(True).alias("guardrail"))
            .distinct(),
            "flagged-prompts",
        )
    )
    # the later stages each read this several times
    screened = materialise(
        rates.join(flagged, prompt, "left").select(
            *keep, "rate_limited", F.coalesce("guardrail", F.lit(False)).alias("guardrail")
        ),
        "screened",
    )
    stopped = F.coalesce("rate_limited", F.lit(False)) | F.col("empty") | F.col("guardrail")
    served = ~(F.col("no_backend") | F.col("failed"))
    assumed = screened.where(~stopped).select(*keep, F.lit(False).alias("__over"))
    while True:
        carry = [*keep, "__over"]
        found = materialise(
            prompt_reuse(
                assumed.withColumn("__stores", served & ~F.col("__over")),
                prompt, TTL_SEC if ttl_sec is None else ttl_sec, None, order, carry,
                stores="__stores", **walk,
            ),
            "looked-up",
        )
        missed = found.where(~F.col("hit")).withColumn(
            "__charge", F.when(served, F.col(cost)).otherwise(0.0)
        )
        charged = budget_decisions(missed, budgets, cost, "__charge", order, carry, **walk).select(
            *carry,
            F.lit(False).alias("cache_hit"),
            (F.col("decision") != "allowed").alias("over_budget"),
        )
        hits = found.where("hit").select(
            *carry, F.lit(True).alias("cache_hit"), F.lit(None).cast("boolean").alias("over_budget")
        )
        answered = materialise(hits.unionByName(charged), "answered")
        if answered.where("over_budget <> __over").isEmpty():
            break
        assumed = answered.select(*keep, F.coalesce("over_budget", F.lit(False)).alias("__over"))
    unknown = known_key_filter(requests, budgets, unknown=True).withColumn(
        "unknown_key", F.lit(True)
    )
    reached = answered.drop("__over").withColumns(
        {"rate_limited": F.lit(False), "guardrail": F.lit(False)}
    )
    return (
        screened.where(stopped)
        .unionByName(reached, allowMissingColumns=True)
        .withColumn("unknown_key", F.lit(False))
        .unionByName(unknown, allowMissingColumns=True)
    )


def admission_funnel(decided: DataFrame) -> DataFrame:
    """Requests per first stopping stage.

    ``decided`` has one boolean column per stage but the last, null where the stage was not
    reached.
    """
    stage = None
    for name, _ in FUNNEL[:-1]:
        stage = F.when(F.col(name), name) if stage is None else stage.when(F.col(name), name)
    codes = F.create_map(*[F.lit(x) for pair in FUNNEL for x in pair])
    return (
        decided.select(stage.otherwise(FUNNEL[-1][0]).alias("stage"))
        .groupBy("stage")
        .agg(F.count(F.lit(1)).alias("n_requests"))
        .select("stage", codes[F.col("stage")].alias("code"), "n_requests")
    )
