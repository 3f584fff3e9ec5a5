"""Choosing backends: candidates, rankings, rotation, failover and as-of lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficlens.operators.health import COOLDOWN_SEC, seconds
from trafficlens.plans.asof import asof
from trafficlens.plans.sides import small_side
from trafficlens.plans.slices import ROWS_PER_SLICE, with_ordinal

# Latency assumed for a backend not seen yet, tries after the first per backend,
# and how long a credential rests after a refusal.
UNKNOWN_LATENCY_MS = 9999.0
MAX_RETRIES = 2
KEY_COOLDOWN_SEC = 60
STRATEGIES = ("cost_first", "latency_first", "complexity", "round_robin", "weighted_round_robin")


def _entry(ema: Column | None = None) -> Column:
    return F.struct(
        (F.lit(0.0) if ema is None else ema).alias("sort_by"),
        "cfg_idx", "backend", "model", "cost_per_1k_prompt", "cost_per_1k_completion",
    )


def _listed(backends: DataFrame, *by: Column) -> Column:
    """All backends in order of ``by``, as an array: one small aggregate, evaluated once."""
    sorted_ = F.array_sort(F.collect_list(F.struct(*by, F.col("cfg_idx"), _entry().alias("e"))))
    return backends.select(sorted_["e"].alias("every")).scalar()


def _ranked(backends: DataFrame, strategy: str) -> Column:
    """Backends of a catalogue in the order of a strategy, best first, as an array column."""
    price = F.col("cost_per_1k_prompt")
    if strategy == "cost_first":
        return _listed(backends, price.alias("p"))
    if strategy == "complexity":
        return F.when(
            F.coalesce("complex", F.lit(False)), _listed(backends, (-price).alias("p"))
        ).otherwise(_listed(backends, price.alias("p")))
    return _listed(backends)


def request_available_backends(
    requests: DataFrame,
    backends: DataFrame,
    trace: DataFrame,
    cooldown_sec: float = COOLDOWN_SEC,
    order: Sequence[str] = ("ts", "event_id"),
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Adds ``available``: the names of the backends that a request may try, in configured order.

    ``trace`` is what ``breaker_trace`` makes of the calls. A backend is left out while its newest
    outcome before the request left the breaker open and the cool-down since has not passed. The first
    request after the cool-down is the probe, whichever backend it is sent to in the end: it leaves
    the breaker half open, and later requests are refused until the next outcome is known.
    """
    ts = order[0]
    # one running total per backend of the settings file
    names = [r.backend for r in backends.select("backend").orderBy("cfg_idx").collect()]
    facts = trace.select(*order, F.col("backend").alias("__b"),
                         F.col("state_after").alias("__state"), F.col(ts).alias("__since"))
    seen = asof(
        requests, facts, None, order, ["__state", "__since"], strictly_before=True,
        rows_per_slice=rows_per_slice,
        pick={f"__s{i}": F.col("__b") == name for i, name in enumerate(names)},
        previous="__previous",
    )
    may = []
    for i, name in enumerate(names):
        since = F.col(f"__s{i}.__since")
        cooled = since + seconds(cooldown_sec)
        # requests are in order, so a probe is out if the one before came after the cool-down too
        probed = (F.col("__previous") > since) & (F.col("__previous") >= cooled)
        open_ = (F.col(f"__s{i}.__state") == "OPEN") & (
            (F.col(ts) < cooled) | F.coalesce(probed, F.lit(False))
        )
        may.append(F.when(~F.coalesce(open_, F.lit(False)), F.lit(name)))
    return seen.select(*requests.columns, F.array_compact(F.array(*may)).alias("available"))


def request_candidates(
    requests: DataFrame, backends: DataFrame, available: str | None = None
) -> DataFrame:
    """Each request with every backend, or with those named in its ``available`` column."""
    listed = requests.withColumn("__every", _ranked(backends, "config"))
    return listed.withColumn("c", F.explode(_among(F.col("__every"), available))).select(
        *requests.columns, "c.backend", "c.cfg_idx", "c.cost_per_1k_prompt",
        "c.cost_per_1k_completion",
    )


def _among(ranked: Column, available: str | None) -> Column:
    if available is None:
        return ranked
    return F.filter(ranked, lambda e: F.array_contains(F.col(available), e["backend"]))


def _with_ranking(requests, backends, strategy, emas, order, rows_per_slice, available) -> DataFrame:
    if strategy in ("round_robin", "weighted_round_robin"):
        turned = with_ordinal(requests, None, order, "__n", rows_per_slice).withColumn(
            "__every", _ranked(backends, "config")
        ).withColumn("__every", _among(F.col("__every"), available))
        size = F.size("__every")
        shift = ((F.col("__n") - 1) % F.greatest(size, F.lit(1))).cast("int")
        return turned.withColumn(
            "ranked",
            F.concat(F.slice("__every", shift + 1, size), F.slice("__every", F.lit(1), shift)),
        ).drop("__n", "__every")
    if strategy != "latency_first":
        return requests.withColumn("ranked", _ranked(backends, strategy)).withColumn(
            "ranked", _among(F.col("ranked"), available)
        )
    # one running total per backend of the settings file
    names = [r.backend for r in backends.select("backend").orderBy("cfg_idx").collect()]
    seen = asof(
        requests,
        emas.select(*order, F.col("backend").alias("__b"), F.col("ema").alias("__ema")),
        None,
        order,
        ["__ema"],
        strictly_before=True,
        rows_per_slice=rows_per_slice,
        pick={f"__ema{i}": F.col("__b") == name for i, name in enumerate(names)},
    )
    latest = F.array(
        *[F.coalesce(F.col(f"__ema{i}.__ema"), F.lit(UNKNOWN_LATENCY_MS)) for i in range(len(names))]
    )
    ranked = F.array_sort(F.zip_with(
        F.col("__every"), latest, lambda e, ema: e.withField("sort_by", ema)
    ))
    return seen.withColumn("__every", _ranked(backends, "config")).select(
        *requests.columns, _among(ranked, available).alias("ranked")
    )


def rank_backends(
    requests: DataFrame,
    backends: DataFrame,
    strategy: str = "cost_first",
    emas: DataFrame | None = None,
    order: Sequence[str] = ("ts", "event_id"),
    rows_per_slice: int = ROWS_PER_SLICE,
    available: str | None = None,
) -> DataFrame:
    """Every request with its backends ranked from 1.

    ``cost_first``: cheapest prompt price; ``latency_first``: lowest moving average of the calls
    before (``emas``); ``complexity``: dearest first for ``complex`` requests, else cheapest;
    ``round_robin``: rotated by one per request; any other name: configured order. Ties keep the
    configured order. ``available`` names a column with the backends that a request may try; the
    others are left out.
    """
    ranked = _with_ranking(requests, backends, strategy, emas, order, rows_per_slice, available)
    return ranked.select(*requests.columns, F.posexplode("ranked").alias("p", "c")).select(
        *requests.columns, (F.col("p") + 1).alias("rank"), "c.backend", "c.model"
    )


def first_backend(
    requests: DataFrame,
    backends: DataFrame,
    strategy: str = "cost_first",
    emas: DataFrame | None = None,
    order: Sequence[str] = ("ts", "event_id"),
    rows_per_slice: int = ROWS_PER_SLICE,
    available: str | None = None,
) -> DataFrame:
    """Only the best backend per request, with its prices; no row is multiplied."""
    ranked = _with_ranking(requests, backends, strategy, emas, order, rows_per_slice, available)
    best = F.get("ranked", 0)
    return ranked.select(
        *requests.columns,
        *[
            best[c].alias(c)
            for c in ("backend", "model", "cost_per_1k_prompt", "cost_per_1k_completion")
        ],
    )


def round_robin_assign(
    calls: DataFrame,
    candidates: Sequence[str],
    order: Sequence[str] = ("ts", "event_id"),
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Call number i goes to candidate i modulo their number; also the rotation of keys."""
    placed = with_ordinal(calls, None, order, "__n", rows_per_slice)
    turn = ((F.col("__n") - 1) % len(candidates)).cast("int")
    return placed.withColumn(
        "assigned", F.get(F.array(*[F.lit(c) for c in candidates]), turn)
    ).drop("__n")


def native_model_map(chosen: DataFrame, backends: DataFrame) -> DataFrame:
    """The serving backend's own model beside the one the client asked for."""
    native = backends.select("backend", F.col("model").alias("native_model"))
    return chosen.join(small_side(native), "backend", "left")


def latest_ema_asof(
    requests: DataFrame,
    emas: DataFrame,
    order: Sequence[str] = ("ts", "event_id"),
    strictly_before: bool = False,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Newest moving average of the request's backend at its time; 9999 when there is none."""
    found = asof(
        requests,
        emas.select("backend", *order, "ema"),
        "backend",
        order,
        ["ema"],
        strictly_before,
        rows_per_slice,
    )
    return found.withColumn("ema", F.coalesce("ema", F.lit(UNKNOWN_LATENCY_MS)))


def key_cooldown_audit(
    uses: DataFrame,
    marks: DataFrame,
    cooldown_sec: float = KEY_COOLDOWN_SEC,
    key: str = "api_key",
    order: Sequence[str] = ("ts", "event_id"),
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Uses of a credential before its latest cooldown had passed.

    ``marks`` may bring a ``cooldown_sec`` column of its own; a later mark replaces an earlier.
    """
    rest = (
        F.coalesce("cooldown_sec", F.lit(cooldown_sec))
        if "cooldown_sec" in marks.columns
        else F.lit(cooldown_sec)
    )
    ts = order[0]
    until = marks.select(key, *order, (F.col(ts) + seconds_of(rest)).alias("cooldown_until"))
    found = asof(
        uses, until, key, order, ["cooldown_until"], True, rows_per_slice
    )
    return found.where(F.col(ts) < F.col("cooldown_until"))


def seconds_of(n: Column) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), n.cast("decimal(18,6)"))


def failover_summary(attempts: DataFrame, max_retries: int = MAX_RETRIES) -> DataFrame:
    """Per request: who served it, how many tries, backends given up, and time waited.

    Attempts are numbered from 0 per backend; a failed attempt waits 2**attempt seconds unless
    it was the last one allowed, which gives the backend up.
    """
    failed = ~F.col("ok")
    last = F.col("attempt") >= max_retries
    return attempts.groupBy("request_id").agg(
        F.max_by("backend", F.when(F.col("ok"), F.col("seq"))).alias("served_by"),
        F.count(F.lit(1)).alias("tries"),
        F.count_if(failed & last).alias("backends_exhausted"),
        F.sum(
            F.when(failed & ~last, F.pow(F.lit(2.0), F.col("attempt"))).otherwise(0.0)
        ).alias("backoff_s"),
        F.when(F.max("ok"), "success").otherwise("failed").alias("outcome"),
    )
