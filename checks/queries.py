"""Every operator as a query over the supplied tables, beside the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import views as v
from checks.views_sql import with_views
from trafficlens.functions.keys import bearer_token, masked_key
from trafficlens.functions.text import INJECTION_PATTERNS, PII_PATTERNS
from trafficlens.operators import (
    admission,
    conversations,
    health,
    kpi,
    pricing,
    reuse,
    routing,
    settlement,
    text_safety,
)
from trafficlens.plans.scratch import materialise, scratch_dir
from trafficlens.plans.slices import Running, running
from trafficlens.sources import ledger as store
from trafficlens.sources import wire
from trafficlens.streaming import jobs, settling, sliced

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
N = v.ROWS_PER_SLICE
AS_OF = datetime(2024, 1, 20, 12, 0, 0)


def OK():
    return F.col("status") == "success"



def query(name: str, needs: str = "", sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_views(needs, sql)
        return fn

    return keep


def r6(c: str):
    return F.round(c, 6).alias(c)


def r10(c: str):
    """Costs are multiples of 1e-9 USD, so ten places leave no ties to round."""
    return F.round(c, 10).alias(c)


# --- sources and sinks ---------------------------------------------------------------------------


@query("load_requests", "ledger", """
select id, api_key, backend, model, prompt_tokens, completion_tokens,
  round(cost_usd, 10) as cost_usd, round(latency_ms, 6) as latency_ms, "timestamp" from ledger""")
def load_requests(spark, d):
    path = scratch_dir(spark, "requests")
    store.write_requests(v.ledger(spark, d), path)
    return (
        store.load_requests(spark, path)
        .drop("day")
        .withColumn("cost_usd", F.round("cost_usd", 10))
        .withColumn("latency_ms", F.round("latency_ms", 6))
    )


@query("load_budgets", "calls budgets", """
select b.api_key, daily_limit_usd, round(coalesce(t, 0), 10) as spend_today, monthly_limit_usd,
  round(coalesce(m, 0), 10) as spend_month
from budgets b left join (select api_key,
    sum(case when cast(ts as date) = date '2024-01-15' then cost_usd end) as t, sum(cost_usd) as m
  from calls where ts >= timestamp '2024-01-01' and ts < timestamp '2024-01-16'
  group by api_key) s on s.api_key = b.api_key""")
def load_budgets(spark, d):
    spend = kpi.spend_now(v.calls(spark, d), date(2024, 1, 15))
    return store.load_budgets(v.budgets(spark), spend).select(
        "api_key", "daily_limit_usd", r10("spend_today"), "monthly_limit_usd", r10("spend_month")
    )


@query("load_breakers", "breakers", "select * from breakers")
def load_breakers(spark, d):
    return store.load_breakers(health.breaker_states(v.traffic(spark, d), OK(), as_of=AS_OF))


def _bodies(spark, d):
    """Chat bodies as JSON: one per conversation, some without messages, some cut off."""
    turns = v.table(spark, d, "conversations")
    said = turns.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias(
            "m"
        )
    )
    messages = F.transform("m", lambda m: F.struct(m["role"], m["content"]))
    body = F.to_json(
        F.struct(
            F.when(F.col("conv_id") % 7 == 0, F.slice(messages, 1, 0)).otherwise(messages).alias(
                "messages"
            ),
            F.concat(F.lit("m"), (F.col("conv_id") % 3).cast("string")).alias("model"),
            (F.col("conv_id") % 2 == 0).alias("stream"),
            F.when(F.col("conv_id") % 4 != 0, F.col("conv_id") % 500).alias("max_tokens"),
            (F.col("conv_id") % 20 / 10.0).alias("temperature"),
            F.lit("x").alias("trace_tag"),
        )
    )
    broken = F.col("conv_id") % 11 == 5
    return said.select(
        "conv_id", F.when(broken, F.substring(body, 1, 15)).otherwise(body).alias("body")
    )


@query("parse_chat_bodies", "", """
select conv_id, cast(n as int) as n_messages, cast(chars as bigint) as content_chars,
  case when not broken then concat('m', cast(conv_id % 3 as varchar)) end as model,
  case when not broken then conv_id % 2 = 0 end as stream,
  case when not broken and conv_id % 4 <> 0 then conv_id % 500 end as max_tokens,
  case when not broken then round(conv_id % 20 / 10.0, 6)::double end as temperature,
  cast(case when broken then 0 when conv_id % 4 <> 0 then 4 else 3 end as int) as n_params,
  case when n > 0 then 200 else 400 end as code
from (select conv_id, conv_id % 11 = 5 as broken,
    case when conv_id % 11 = 5 or conv_id % 7 = 0 then 0 else count(*) end as n,
    case when conv_id % 11 = 5 or conv_id % 7 = 0 then 0 else sum(length(text)) end as chars
  from conversations group by conv_id)""")
def parse_chat_bodies(spark, d):
    parsed = wire.parse_chat_bodies(_bodies(spark, d))
    whole = F.col("model").isNotNull()
    size = F.when(F.col("messages").isNotNull() & whole, F.size("messages")).otherwise(0)
    chars = F.aggregate(
        F.when(whole, F.col("messages")),
        F.lit(0).cast("long"),
        lambda n, m: n + F.length(m["content"]),
    )
    return parsed.select(
        "conv_id",
        size.alias("n_messages"),
        F.coalesce(chars, F.lit(0)).alias("content_chars"),
        "model",
        "stream",
        "max_tokens",
        "temperature",
        F.when(whole, F.size("params")).otherwise(0).alias("n_params"),
        "code",
    )


def _answers(spark, d):
    return _answers_of(v.table(spark, d, "conversations"))


def _answers_of(turns):
    return turns.where(F.col("role") == "assistant").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("stream_id"), "text"
    )


def _sse_lines(spark, d):
    return _lines_of(_answers(spark, d))


def _lines_of(answers):
    """Stored answers as streamed lines: two dialects, with noise and lines after the end."""
    deltas = conversations.split_stream_deltas(answers, ["stream_id"])
    plain = F.col("stream_id") % 2 == 0
    sid = F.concat(F.lit("s-"), F.col("stream_id").cast("string"))
    chunk = F.to_json(
        F.struct(
            sid.alias("id"),
            F.array(
                F.struct(
                    F.lit(0).alias("index"),
                    F.struct("content").alias("delta"),
                    "finish_reason",
                )
            ).alias("choices"),
        )
    )
    event = F.when(F.col("finish_reason") == "stop", F.lit('{"type":"message_stop"}')).otherwise(
        F.to_json(
            F.struct(
                F.lit("content_block_delta").alias("type"),
                F.struct(
                    F.lit("text_delta").alias("type"), F.col("content").alias("text")
                ).alias("delta"),
            )
        )
    )
    data = lambda c: F.concat(F.lit("data: "), c)
    body = deltas.select(
        "stream_id",
        (F.col("seq") * 10 + 100).alias("seq"),
        data(F.when(plain, chunk).otherwise(event)).alias("line"),
    )
    heads = answers.select("stream_id")
    noise = [
        (0, F.when(plain, ": hello").otherwise(data(F.to_json(F.struct(
            F.lit("message_start").alias("type"), F.struct(sid.alias("id")).alias("message")))))),
        (105, F.lit("data: {broken")),
        (100_000_000, F.when(plain, "data: [DONE]").otherwise("event: end")),
        (100_000_001, F.lit('data: {"id":"late","choices":[{"index":0,"delta":{"content":"x"}}]}')),
    ]
    for at, line in noise:
        body = body.unionByName(heads.select("stream_id", F.lit(at).alias("seq"), line.alias("line")))
    return body


@query("parse_sse_chunks", "", """
with words as (
  select conv_id * 1000 + turn as stream_id, string_split(text, ' ') as w
  from conversations where role = 'assistant'),
chunks as (
  select stream_id, unnest(range(len(w) + 1)) as i, w from words)
select stream_id, cast(100 + i * 10 as int) as seq, concat('s-', cast(stream_id as varchar)) as id,
  case when i < len(w) then concat(case when i > 0 then ' ' else '' end, w[i + 1]) end as content,
  case when i = len(w) then 'stop' end as finish_reason
from chunks""")
def parse_sse_chunks(spark, d):
    return wire.parse_sse_chunks(_sse_lines(spark, d), N * 20)


_CATALOGUE_PROVIDERS = {"b0": "openai", "b1": "local_vllm", "b2": "anthropic"}


def _catalogue(spark):
    named = F.create_map(*[F.lit(x) for kv in _CATALOGUE_PROVIDERS.items() for x in kv])
    return v.backends(spark).withColumn("provider", named[F.col("backend")])


def _answer_documents(spark, d):
    """Answers to the calls as documents of both dialects: some broken, some without usage."""
    calls = v.traffic(spark, d).withColumn("bare", F.col("event_id") % 13 == 4)
    given = lambda c: F.when(~F.col("bare"), F.col(c))
    said = F.concat(F.lit("to "), "api_key")
    choices = F.to_json(F.struct(
        F.col("request_id").alias("id"),
        F.array(F.struct(F.struct(F.lit("assistant").alias("role"), F.when(
            ~F.col("bare"), said).alias("content")).alias("message"))).alias("choices"),
        F.struct(given("prompt_tokens").alias("prompt_tokens"),
                 given("completion_tokens").alias("completion_tokens")).alias("usage")))
    block = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    blocks = F.to_json(F.struct(
        given("request_id").alias("id"),
        F.array(block("text", F.lit("to ")), block("tool_use", F.lit("x")),
                block("text", F.col("api_key"))).alias("content"),
        F.struct(given("prompt_tokens").alias("input_tokens"),
                 given("completion_tokens").alias("output_tokens")).alias("usage")))
    whole = F.when(F.col("backend") == "b2", blocks).otherwise(choices)
    body = F.when(F.col("event_id") % 17 == 3, "{broken").otherwise(whole)
    return calls.select("request_id", "backend", "latency_ms", body.alias("body"))


@query("parse_provider_answers", "traffic backends", """
with a as (select *, event_id % 17 = 3 as broken, event_id % 13 = 4 as bare, backend = 'b2' as typed
  from traffic),
t as (select *, case when not broken then case when bare then 0 else prompt_tokens end end as pt,
    case when not broken then case when bare then 0 else completion_tokens end end as ct from a)
select request_id, t.backend, not broken as ok,
  case when not broken then case when bare and typed then '' else request_id end end as id,
  b.model, case when not broken then 1 end as n_messages,
  case when not broken then 'assistant' end as role,
  case when not broken then case when bare and not typed then '' else concat('to ', api_key) end end
    as content,
  cast(pt as bigint) as prompt_tokens, cast(ct as bigint) as completion_tokens,
  round(pt / 1000.0 * b.cost_per_1k_prompt + ct / 1000.0 * b.cost_per_1k_completion, 10) as cost_usd,
  latency_ms
from t join backends b on b.backend = t.backend""")
def parse_provider_answers(spark, d):
    parsed = wire.parse_provider_answers(_answer_documents(spark, d), _catalogue(spark))
    first = F.get("messages", F.lit(0))
    return parsed.select(
        "request_id", "backend", "ok", "id", "model",
        F.when(F.col("ok"), F.size("messages")).alias("n_messages"),
        first["role"].alias("role"), first["content"].alias("content"),
        "prompt_tokens", "completion_tokens", r10("cost_usd"), "latency_ms",
    )


def _log_lines(spark, d):
    a = v.attempts(spark, d).withColumn("model", F.concat(F.lit("m"), F.substring("backend", 2, 9)))
    line = lambda level, text: F.to_json(
        F.struct(
            F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS").alias("timestamp"),
            F.lit(level).alias("level"),
            text.alias("message"),
            F.lit("root").alias("logger"),
        )
    )
    tried = F.col("attempt") + 1
    route = F.format_string(
        "Routing request to %s using model %s (attempt %d/3)", "backend", "model", tried
    )
    retry = F.format_string(
        "Transient failure on %s (%s). Retrying in %ds...",
        "backend", F.lit("status 500 (busy)"), F.pow(F.lit(2), F.col("attempt")).cast("int"),
    )
    gone = F.format_string("Backend %s failed after 3 attempts: %s", "backend", F.lit("status 500"))
    failure = F.when(F.col("attempt") < 2, line("WARNING", retry)).otherwise(
        line("WARNING", gone)
    )
    key = ["request_id", "seq"]
    return (
        a.select(*key, line("INFO", route).alias("line"))
        .unionByName(a.where(~F.col("ok")).select(*key, failure.alias("line")))
        .unionByName(a.select(*key, line("INFO", F.lit("unrelated")).alias("line")))
    )


@query("parse_service_logs", "attempts", """
select request_id, seq, 'route' as kind, backend, concat('m', substr(backend, 2)) as model,
  attempt + 1 as attempt, 3 as max_attempts, cast(null as int) as backoff_s,
  cast(null as varchar) as error from attempts
union all select request_id, seq, 'retry', backend, null, null, null,
  cast(pow(2, attempt) as int), 'status 500 (busy)' from attempts where not ok and attempt < 2
union all select request_id, seq, 'exhausted', backend, null, null, 3, null, 'status 500'
  from attempts where not ok and attempt >= 2""")
def parse_service_logs(spark, d):
    return wire.parse_service_logs(_log_lines(spark, d)).drop("logged_at", "level")


@query("append_ledger", "ledger", """
select id, api_key, round(cost_usd, 10) as cost_usd from ledger""")
def append_ledger(spark, d):
    every = v.ledger(spark, d)
    n = F.substring("id", 5, 20).cast("long")
    old = every.where(n % 3 != 0)
    incoming = every.withColumn("seq", F.lit(0)).unionByName(
        every.where(n % 5 == 0).withColumn("cost_usd", F.lit(9.0)).withColumn("seq", F.lit(1))
    )
    return store.append_ledger(old, incoming, ["seq"]).select("id", "api_key", r10("cost_usd"))


@query("upsert_budgets", "", """
with base as (select concat(case when c_custkey % 3 = 0 then 'old-' else 'ck-' end,
    cast(c_custkey as varchar)) as api_key,
    abs(c_acctbal) / 100 as daily, abs(c_acctbal) as monthly,
    cast(case when c_custkey % 4 = 0 then null else c_custkey % 90 end as int) as rpm
  from customer),
changes as (select o_orderkey as seq, o_orderkey % 2 = 0 as config,
    concat('ck-', cast(o_custkey as varchar)) as api_key, o_totalprice / 1000 as daily,
    o_totalprice as monthly,
    cast(case when o_orderkey % 3 = 0 then null else o_orderkey % 100 end as int) as rpm
  from orders),
eff as (select *, case when config then coalesce(rpm, 60) else rpm end as rate,
    row_number() over (partition by api_key order by seq desc) as newest,
    count(*) over (partition by api_key) as n from changes),
rates as (select api_key, arg_max(rate, seq) as rate from eff where rate is not null group by api_key)
select coalesce(b.api_key, e.api_key) as api_key,
  case when e.api_key is null then b.daily else e.daily end as daily_limit_usd,
  case when e.api_key is null then b.monthly else e.monthly end as monthly_limit_usd,
  coalesce(r.rate, b.rpm, 60) as requests_per_minute,
  case when e.api_key is not null then b.api_key is not null or e.n > 1 end as was_update
from base b full outer join (select * from eff where newest = 1) e on e.api_key = b.api_key
left join rates r on r.api_key = e.api_key""")
def upsert_budgets(spark, d):
    key = lambda c: F.concat(F.lit("ck-"), F.col(c).cast("string")).alias("api_key")
    # a third of the customers has keys of another name, so that changes bring new keys
    old = F.concat(F.lit("old-"), F.col("c_custkey").cast("string"))
    base = v.table(spark, d, "customer").select(
        F.when(F.col("c_custkey") % 3 == 0, old).otherwise(key("c_custkey")).alias("api_key"),
        (F.abs("c_acctbal") / 100).alias("daily_limit_usd"),
        F.abs("c_acctbal").alias("monthly_limit_usd"),
        F.when(F.col("c_custkey") % 4 != 0, F.col("c_custkey") % 90).cast("int").alias(
            "requests_per_minute"
        ),
    )
    changes = v.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("seq"),
        F.when(F.col("o_orderkey") % 2 == 0, "config").otherwise("admin").alias("source"),
        key("o_custkey"),
        (F.col("o_totalprice") / 1000).alias("daily_limit_usd"),
        F.col("o_totalprice").alias("monthly_limit_usd"),
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 100).cast("int").alias(
            "requests_per_minute"
        ),
    )
    return store.upsert_budgets(base, changes)


def _trace(spark, d, t=None):
    return health.breaker_trace(
        v.traffic(spark, d) if t is None else t, OK(), cooldown_sec=900, rows_per_slice=N
    )


@query("upsert_breakers", "trace", """
select backend, arg_max(state_after, event_id) as state,
  arg_max(streak, event_id) as consecutive_failures,
  arg_max(coalesce(case when streak > 0 then ts end, timestamp '1970-01-01'), event_id)
    as last_failure_time
from trace group by backend""")
def upsert_breakers(spark, d):
    states = _trace(spark, d).select(
        "backend",
        F.col("state_after").alias("state"),
        F.col("streak").alias("consecutive_failures"),
        F.when(F.col("streak") > 0, F.col("ts"))
        .otherwise(F.lit("1970-01-01").cast("timestamp_ntz"))
        .alias("last_failure_time"),
        "ts",
        "event_id",
    )
    return store.upsert_breakers(states, ["ts", "event_id"])


# --- projections ---------------------------------------------------------------------------------


@query("request_cost", "traffic backends", """
select event_id, backend, round(coalesce(prompt_tokens / 1000.0::double * cost_per_1k_prompt
  + completion_tokens / 1000.0::double * cost_per_1k_completion, 0), 10) as cost_usd
from (select t.*, case when event_id % 9 = 4 then 'unknown' else t.backend end as served
  from traffic t) t left join backends b on b.backend = t.served""".replace(
    "select event_id, backend", "select event_id, served as backend"))
def request_cost(spark, d):
    served = F.when(F.col("event_id") % 9 == 4, "unknown").otherwise(F.col("backend"))
    calls = v.traffic(spark, d).withColumn("backend", served)
    return pricing.request_cost(calls, v.backends(spark)).select(
        "event_id", "backend", r10("cost_usd")
    )


@query("token_estimate", "", """
select conv_id, greatest(1, cast(floor(sum(length(text)) / 4.0) as bigint)) as token_estimate
from conversations group by conv_id""")
def token_estimate(spark, d):
    return pricing.token_estimate(v.table(spark, d, "conversations"), ["conv_id"], "text")


@query("preflight_cost", "traffic backends breakers", """
with up as (select b.* from backends b left join breakers s on s.backend = b.backend
  where coalesce(state, 'CLOSED') = 'CLOSED'
    or timestamp '2024-01-20 12:00:00' - last_failure_time >= interval 30 second),
best as (select * from up order by cost_per_1k_prompt, cfg_idx limit 1)
select request_id, best.backend, round(prompt_tokens / 1000.0::double * cost_per_1k_prompt
  + case when event_id % 4 = 0 then 256 else completion_tokens end / 1000.0::double
  * cost_per_1k_completion, 10) as estimate_usd
from traffic, best""")
def preflight_cost(spark, d):
    t = v.traffic(spark, d)
    states = health.breaker_states(t, OK(), as_of=AS_OF)
    up = health.available_backends(v.backends(spark), states, AS_OF).where("available")
    ranked = routing.first_backend(t.select("request_id"), up)
    requests = t.select(
        "request_id",
        "prompt_tokens",
        F.when(F.col("event_id") % 4 != 0, F.col("completion_tokens")).alias("max_tokens"),
    )
    return pricing.preflight_cost(requests, ranked).select(
        "request_id", "backend", F.round("estimate_usd", 10).alias("estimate_usd")
    )


def _redact_sql(column: str) -> str:
    out = column
    for label, pattern in PII_PATTERNS:
        out = f"regexp_replace({out}, '{pattern}', '[{label}_REDACTED]', 'g')"
    return out


@query("redact_pii", "docs_injected",
       f"select doc_id, {_redact_sql('text')} as text from docs_injected")
def redact_pii(spark, d):
    return text_safety.redact_pii(v.docs_injected(spark, d)).select("doc_id", "text")


def _tainted_turns(spark, d):
    return v.table(spark, d, "conversations").withColumn(
        "text",
        F.concat(
            "text",
            F.when(F.col("turn") % 3 == 0, " mail a.b@x.org or +1 (555) 555-5555").otherwise(""),
        ),
    )


@query("redact_conversations", "", f"""
select conv_id, turn, role, {_redact_sql('text')} as content
from (select * replace (concat(text, case when turn % 3 = 0
  then ' mail a.b@x.org or +1 (555) 555-5555' else '' end) as text) from conversations)""")
def redact_conversations(spark, d):
    return text_safety.redact_conversations(_tainted_turns(spark, d))


def _vault_sql() -> str:
    """One step per label: matches are numbered from the right, pieces and tokens are joined."""
    steps = ["v0 as (select doc_id, text, [] :: struct(label varchar, seq int, token varchar, "
             "\"value\" varchar)[] as entries from docs_injected)"]
    for i, (label, pattern) in enumerate(PII_PATTERNS, 1):
        steps.append(f"""
m{i} as (select doc_id, entries, string_split_regex(text, '{pattern}') as parts,
    regexp_extract_all(text, '{pattern}') as vals from v{i - 1}),
v{i} as (select doc_id,
    array_to_string(list_transform(range(1, len(parts) + 1), lambda i: concat(parts[i],
      case when i <= len(vals) then concat('[{label}_', cast(len(vals) + 1 - i as varchar), ']')
      else '' end)), '') as text,
    list_concat(entries, list_transform(range(1, len(vals) + 1), lambda j: {{'label': '{label}',
      'seq': cast(j as int), 'token': concat('[{label}_', cast(j as varchar), ']'),
      'value': vals[len(vals) + 1 - j]}})) as entries
  from m{i})""")
    return ",\n".join(steps)


def _vault(statement: str) -> str:
    views = with_views("docs_injected", "")
    return f"{views},\n{_vault_sql()}\n{statement}"


@query("pii_vault_mask")
def pii_vault_mask(spark, d):
    return text_safety.pii_vault_mask(v.docs_injected(spark, d)).select(
        "doc_id", "text", F.size("entries").alias("n_entries")
    )


ORACLE["pii_vault_mask"] = _vault(
    f"select doc_id, text, cast(len(entries) as int) as n_entries from v{len(PII_PATTERNS)}")


@query("pii_vault_entries")
def pii_vault_entries(spark, d):
    masked = text_safety.pii_vault_mask(v.docs_injected(spark, d))
    return text_safety.pii_vault_entries(masked, ["doc_id", "source"])


ORACLE["pii_vault_entries"] = _vault(f"""
select doc_id, source, cast(p - 1 as int) as pos, e.label as label, e.seq as seq,
  e.token as token, e."value" as "value"
from (select v.doc_id, d.source, unnest(entries) as e, unnest(range(1, len(entries) + 1)) as p
  from v{len(PII_PATTERNS)} v join documents d on d.doc_id = v.doc_id)""")


@query("pii_vault_counts")
def pii_vault_counts(spark, d):
    masked = text_safety.pii_vault_mask(v.docs_injected(spark, d))
    return (
        text_safety.pii_vault_entries(masked, ["doc_id", "source"])
        .groupBy("label", "source")
        .agg(F.count(F.lit(1)).alias("n_values"))
    )


ORACLE["pii_vault_counts"] = _vault(f"""
select e.label as label, source, count(*) as n_values
from (select d.source, unnest(entries) as e
  from v{len(PII_PATTERNS)} v join documents d on d.doc_id = v.doc_id) group by all""")


@query("pii_restore", "docs_injected", "select doc_id, text from docs_injected")
def pii_restore(spark, d):
    masked = text_safety.pii_vault_mask(v.docs_injected(spark, d)).select(
        "doc_id", "text", "entries"
    )
    return text_safety.pii_restore(masked, text_safety.pii_vault_entries(masked, ["doc_id"]))


@query("prompt_cache_key", "traffic", """
select event_id, min(event_id) over (partition by k, k % 3) as same_as from traffic
order by event_id""")
def prompt_cache_key(spark, d):
    """Prompts that differ in white space only, or in parameters outside the key, are the same."""
    said = F.concat(
        F.repeat(F.lit(" "), (F.col("event_id") % 3).cast("int")),
        F.lit("prompt "),
        F.col("k").cast("string"),
        F.when(F.col("event_id") % 2 == 0, " \n").otherwise(""),
    )
    params = F.create_map(
        F.lit("temperature"), (F.col("k") % 3).cast("string"),
        F.lit("seed"), F.col("event_id").cast("string"),
    )
    keyed = conversations.prompt_cache_key(
        v.traffic(spark, d)
        .withColumn(
            "messages", F.array(F.struct(F.lit("user").alias("role"), said.alias("content")))
        )
        .withColumn("params", params)
    ).select("event_id", "prompt_key")
    firsts = keyed.groupBy("prompt_key").agg(F.min("event_id").alias("same_as"))
    return keyed.join(firsts, "prompt_key").select("event_id", "same_as")


@query("complexity_class", "prompt_messages", """
select doc_id, length(t) as "length", length(t) > 120 or contains(t, 'solve')
  or contains(t, 'code') or contains(t, 'optimize') or contains(t, 'analyze')
  or contains(t, 'debug') or contains(t, 'proof') or contains(t, 'explain') or contains(t, 'why')
  or contains(t, 'how to') or contains(t, 'write a') or contains(t, 'implement') as complex
from (select doc_id, lower(string_agg(text, ' ' order by turn)) as t from prompt_messages
  group by doc_id)""")
def complexity_class(spark, d):
    return conversations.complexity_class(v.prompt_messages(spark, d), "doc_id")


@query("mask_api_key", "traffic", """
select event_id, case when length(k) > 10 then concat(substr(k, 1, 5), '...', right(k, 4)) else k end
  as masked from (select event_id, concat(api_key, '-', repeat('x', user_id % 9), 'abc') as k
  from traffic)""")
def mask_api_key(spark, d):
    key = F.concat(
        "api_key",
        F.lit("-"),
        F.repeat(F.lit("x"), (F.col("user_id") % 9).cast("int")),
        F.lit("abc"),
    )
    return v.traffic(spark, d).select("event_id", masked_key(key).alias("masked"))


@query("bearer_token", "traffic", """
select event_id, case event_id % 5 when 3 then null when 4 then null else api_key end as token
from traffic""")
def bearer(spark, d):
    n, key = F.col("event_id") % 5, F.col("api_key")
    header = (
        F.when(n == 0, F.concat(F.lit("Bearer "), key))
        .when(n == 1, key)
        .when(n == 2, F.concat(F.lit("Bearer Bearer "), key))
        .when(n == 3, F.lit(""))
    )
    return v.traffic(spark, d).select("event_id", bearer_token(header).alias("token"))


@query("provider_params", "traffic", """
select event_id, case when event_id % 3 = 0 then 5 else 4 end as n_completion_params,
  case when event_id % 3 = 0 then cast(completion_tokens as bigint) else 1024 end as max_tokens,
  case when event_id % 7 <> 6 then least(1.0, greatest(0.0, k / 20.0::double - 1)) end as temperature,
  case when k % 2 = 0 then k / 100.0::double else 1.0 end as top_p,
  case when event_id % 2 = 0 then 'END' else 'END|STOP' end as stop_sequences
from traffic""")
def provider_params(spark, d):
    n, k = F.col("event_id"), F.col("k")
    number = lambda c: c.cast("string")
    body = F.concat(
        F.lit('{"max_tokens": '),
        F.when(n % 3 == 0, number(F.col("completion_tokens")))
        .when(n % 3 == 1, F.lit("null"))
        .otherwise(F.lit("null")),
        F.lit(', "temperature": '),
        F.when(n % 7 == 6, F.lit('"hot"')).otherwise(number(k / F.lit(20.0) - 1)),
        F.lit(', "top_p": '),
        F.when(k % 2 == 0, number(k / F.lit(100.0))).otherwise(F.lit("7")),
        F.lit(', "stop": '),
        F.when(n % 2 == 0, F.lit('"END"')).otherwise(F.lit('["END", "STOP"]')),
        F.lit(', "user": "u", "seed": null, "internal_flag": true}'),
    )
    return conversations.provider_params(
        v.traffic(spark, d).select("event_id", body.alias("body"))
    ).select(
        "event_id",
        F.size("completion_params").alias("n_completion_params"),
        "max_tokens",
        "temperature",
        "top_p",
        F.array_join("stop_sequences", "|").alias("stop_sequences"),
    )


@query("merge_adjacent_turns", "turns_doubled", """
with kept as (select * from turns_doubled where role in ('user', 'assistant')),
flagged as (select *, case when role = lag(role) over (partition by conv_id order by turn)
    then 0 else 1 end as starts from kept),
runs as (select *, sum(starts) over (partition by conv_id order by turn) as run from flagged)
select conv_id, min(turn) as start_turn, any_value(role) as role,
  string_agg(text, chr(10) || chr(10) order by turn) as content
from runs group by conv_id, run
union all select distinct conv_id, 0, 'user', '.' from turns_doubled
  where conv_id not in (select conv_id from kept)""")
def merge_adjacent_turns(spark, d):
    return conversations.merge_adjacent_turns(v.turns_doubled(spark, d), rows_per_slice=N)


@query("system_prompt", "", """
select conv_id, string_agg(text, chr(10) || chr(10) order by turn) as system
from conversations where role = 'system' and text <> '' group by conv_id""")
def system_prompt(spark, d):
    return conversations.system_prompt(v.table(spark, d, "conversations"))


@query("split_stream_deltas", "", """
select stream_id, cast(i as int) as seq, case when i < len(w) then
  concat(case when i > 0 then ' ' else '' end, w[i + 1]) end as content,
  case when i = len(w) then 'stop' end as finish_reason
from (select conv_id * 1000 + turn as stream_id, string_split(text, ' ') as w,
    unnest(range(len(string_split(text, ' ')) + 1)) as i
  from conversations where role = 'assistant')""")
def split_stream_deltas(spark, d):
    return conversations.split_stream_deltas(_answers(spark, d), ["stream_id"])


@query("assemble_stream", "", """
select conv_id * 1000 + turn as stream_id, text, 'stop' as finish_reason,
  concat('s-', cast(conv_id * 1000 + turn as varchar)) as id
from conversations where role = 'assistant'""")
def assemble_stream(spark, d):
    chunks = wire.parse_sse_chunks(_sse_lines(spark, d), N * 20).withColumn("model", F.lit("m0"))
    return conversations.assemble_stream(chunks, ["stream_id"], with_ids=True).drop("model")


def _opened(spark, d):
    """The opened streams, with the characters of all turns before the answer."""
    turns = v.table(spark, d, "conversations")
    before = running(
        turns.withColumn("chars", F.length("text").cast("long")), "conv_id", ["turn"],
        [Running("prompt_chars", "sum", F.col("chars"), prior=True)], N * 20,
    )
    return before.where(F.col("role") == "assistant").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("stream_id"),
        F.concat(F.lit("sk-"), (F.col("conv_id") % 10).cast("string")).alias("api_key"),
        F.concat(F.lit("b"), ((F.col("conv_id") + F.col("turn")) % 3).cast("string")).alias("backend"),
        "prompt_chars",
        F.col("turn").cast("double").alias("latency_ms"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id")).cast("timestamp_ntz").alias(
            "timestamp"),
    )


SETTLED_SQL = """
with turns as (
  select conv_id, turn, role, length(text) as n,
    coalesce(sum(length(text)) over (partition by conv_id order by turn
      rows between unbounded preceding and 1 preceding), 0) as chars from conversations),
s as (
  select concat('s-', cast(conv_id * 1000 + turn as varchar)) as id,
    concat('sk-', cast(conv_id % 10 as varchar)) as api_key,
    concat('b', cast((conv_id + turn) % 3 as varchar)) as backend,
    cast(greatest(1, floor(chars / 4.0)) as bigint) as pt,
    cast(greatest(1, floor(n / 4.0)) as bigint) as ct
  from turns where role = 'assistant')
select id, api_key, s.backend, model, pt as prompt_tokens, ct as completion_tokens,
  round(pt / 1000.0 * cost_per_1k_prompt + ct / 1000.0 * cost_per_1k_completion, 10) as cost_usd
from s join backends b on b.backend = s.backend"""


def _settled_columns(rows):
    return rows.select("id", "api_key", "backend", "model", "prompt_tokens", "completion_tokens",
                       r10("cost_usd"))


@query("settle_streams", "backends", SETTLED_SQL)
def settle_streams(spark, d):
    return _settled_columns(settlement.settle_streams(
        _sse_lines(spark, d), _opened(spark, d), v.backends(spark), v.ledger(spark, d), N * 20))


@query("response_envelope", "ledger", """
select id, to_json({'id': id, 'object': 'chat.completion', 'created': 1704067200, 'model': model,
  'choices': [{'index': 0, 'message': {'role': 'assistant', 'content': concat('to ', api_key)},
    'finish_reason': 'stop'}],
  'usage': {'prompt_tokens': prompt_tokens, 'completion_tokens': completion_tokens,
    'total_tokens': prompt_tokens + completion_tokens}})::varchar as document from ledger""")
def response_envelope(spark, d):
    responses = v.ledger(spark, d).withColumn("created", F.lit(1704067200)).withColumn(
        "messages",
        F.array(
            F.struct(
                F.lit("assistant").alias("role"),
                F.concat(F.lit("to "), "api_key").alias("content"),
            )
        ),
    )
    return conversations.response_envelope(responses, ["id"])


@query("breaker_state_code", "trace", """
select event_id, case state_before when 'CLOSED' then 0 when 'HALF_OPEN' then 1 else 2 end as code
from trace""")
def breaker_state_code(spark, d):
    return _trace(spark, d).select(
        "event_id", health.breaker_state_code(F.col("state_before")).alias("code")
    )


@query("utc_period_keys", "traffic", """
select event_id, strftime(ts, '%Y-%m-%d') as day, strftime(ts, '%Y-%m') as month from traffic""")
def utc_period_keys(spark, d):
    return pricing.utc_period_keys(v.traffic(spark, d)).select("event_id", "day", "month")


# --- filters -------------------------------------------------------------------------------------


def _screened_messages(spark, d):
    return v.docs_injected(spark, d).select(
        F.floor(F.col("doc_id") / 7).alias("conv_id"), (F.col("doc_id") % 7).alias("turn"), "text"
    )


def _phrase_sql() -> str:
    cases = " ".join(
        f"when regexp_matches(text, '(?i){p}') then {i}" for i, p in enumerate(INJECTION_PATTERNS)
    )
    return f"case {cases} end"


PHRASES = ", ".join(f"'{p}'" for p in INJECTION_PATTERNS)


@query("guardrail_scan", "docs_injected", f"""
select conv_id, turn, phrase, list_extract([{PHRASES}],
  phrase + 1) as pattern
from (select doc_id // 7 as conv_id, doc_id % 7 as turn, {_phrase_sql()} as phrase,
    row_number() over (partition by doc_id // 7 order by doc_id) as r
  from docs_injected where {_phrase_sql()} is not null) where r = 1""")
def guardrail_scan(spark, d):
    return text_safety.guardrail_scan(_screened_messages(spark, d))


@query("guardrail_clean", "docs_injected", f"""
select doc_id // 7 as conv_id, doc_id % 7 as turn, text from docs_injected
where doc_id // 7 not in (select doc_id // 7 from docs_injected where {_phrase_sql()} is not null)""")
def guardrail_clean(spark, d):
    return text_safety.guardrail_clean(_screened_messages(spark, d))


@query("known_key_filter", "traffic budgets", """
select event_id, api_key from traffic where api_key in (select api_key from budgets)""")
def known_key_filter(spark, d):
    return admission.known_key_filter(v.traffic(spark, d), v.budgets(spark)).select(
        "event_id", "api_key"
    )


@query("unknown_key_calls", "traffic budgets", """
select event_id, api_key from traffic where api_key not in (select api_key from budgets)""")
def unknown_key_calls(spark, d):
    return admission.known_key_filter(v.traffic(spark, d), v.budgets(spark), True).select(
        "event_id", "api_key"
    )


@query("available_backends", "backends breakers", """
select b.backend, b.cfg_idx, coalesce(state, 'CLOSED') <> 'OPEN'
    or timestamp '2024-01-20 12:00:00' - last_failure_time >= interval 30 second as available,
  case when state = 'OPEN'
    and timestamp '2024-01-20 12:00:00' - last_failure_time >= interval 30 second
    then 'HALF_OPEN' else coalesce(state, 'CLOSED') end as state
from backends b left join breakers s on s.backend = b.backend""")
def available_backends(spark, d):
    states = health.breaker_states(v.traffic(spark, d), OK(), as_of=AS_OF)
    return health.available_backends(v.backends(spark), states, AS_OF).select(
        "backend", "cfg_idx", "available", "state"
    )


@query("nonempty_messages", "", """
select doc_id from documents where doc_id in (select conv_id from conversations)""")
def nonempty_messages(spark, d):
    """Documents stand for requests; those that no conversation belongs to have no messages."""
    turns = v.table(spark, d, "conversations").withColumnRenamed("conv_id", "doc_id")
    return admission.nonempty_messages(
        v.table(spark, d, "documents").select("doc_id"), turns, "doc_id"
    )


# --- joins ---------------------------------------------------------------------------------------


@query("requests_with_budget", "traffic budgets", """
select event_id, t.api_key, daily_limit_usd, monthly_limit_usd, b.api_key is not null as has_budget
from traffic t left join budgets b on b.api_key = t.api_key""")
def requests_with_budget(spark, d):
    return admission.requests_with_budget(v.traffic(spark, d), v.budgets(spark)).select(
        "event_id", "api_key", "daily_limit_usd", "monthly_limit_usd", "has_budget"
    )


@query("requests_with_price", "traffic backends", """
select event_id, t.backend, cost_per_1k_prompt, cost_per_1k_completion
from traffic t join backends b on b.backend = t.backend""")
def requests_with_price(spark, d):
    return pricing.requests_with_price(v.traffic(spark, d), v.backends(spark)).select(
        "event_id", "backend", "cost_per_1k_prompt", "cost_per_1k_completion"
    )


@query("backend_health_board", "traffic backends breakers", """
select b.backend, b.model, coalesce(state, 'CLOSED') as state, healthy
from backends b left join breakers s on s.backend = b.backend
left join (select backend, arg_max(status = 'success', event_id) as healthy from traffic
  where event_type = 'view' or event_type = 'error' group by backend) p on p.backend = b.backend""")
def backend_health_board(spark, d):
    t = v.traffic(spark, d)
    probes = t.where(F.col("event_type").isin("view", "error")).withColumn("healthy", OK())
    states = health.breaker_states(t, OK(), as_of=AS_OF)
    return health.backend_health_board(
        v.backends(spark), states, probes, ["ts", "event_id"]
    ).select("backend", "model", "state", "healthy")


@query("native_model_map", "traffic backends", """
select event_id, concat('asked-', event_type) as model, t.backend, b.model as native_model
from traffic t join backends b on b.backend = t.backend""")
def native_model_map(spark, d):
    asked = v.traffic(spark, d).select(
        "event_id", F.concat(F.lit("asked-"), "event_type").alias("model"), "backend"
    )
    return routing.native_model_map(asked, v.backends(spark))


def _successes(spark, d):
    return v.traffic(spark, d).where(OK())


def _emas(spark, d):
    return health.latency_ema(_successes(spark, d), rows_per_slice=N).select(
        "backend", "ts", "event_id", "ema"
    )


@query("latest_ema_asof", "traffic ema", """
select t.event_id, t.backend, round(coalesce(e.ema, 9999.0), 6) as ema
from traffic t asof left join ema e on e.backend = t.backend and e.ts <= t.ts""")
def latest_ema_asof(spark, d):
    t = v.traffic(spark, d).select("event_id", "ts", "backend")
    return routing.latest_ema_asof(t, _emas(spark, d), rows_per_slice=N).select(
        "event_id", "backend", r6("ema")
    )


@query("key_cooldown_audit", "traffic", """
select t.event_id, t.api_key, t.ts, m.ts + interval 3600 second as cooldown_until
from traffic t asof join (select api_key, ts from traffic where status = 'error') m
  on m.api_key = t.api_key and m.ts < t.ts
where t.ts < m.ts + interval 3600 second""")
def key_cooldown_audit(spark, d):
    t = v.traffic(spark, d).select("event_id", "api_key", "ts", "status")
    marks = t.where(F.col("status") == "error").select("event_id", "api_key", "ts")
    return routing.key_cooldown_audit(
        t.drop("status"), marks, cooldown_sec=3600, rows_per_slice=N
    )


@query("request_candidates", "traffic backends", """
select event_id, b.backend, b.cfg_idx from traffic, backends b""")
def request_candidates(spark, d):
    return routing.request_candidates(
        v.traffic(spark, d).select("event_id"), v.backends(spark)
    ).select("event_id", "backend", "cfg_idx")


# --- aggregations --------------------------------------------------------------------------------


@query("traffic_kpis", "calls", """
select count(*) as total_requests, count(*) filter (backend = 'cache') as cache_hits,
  round(count(*) filter (backend = 'cache') / count(*) * 100, 6) as cache_hit_rate_pct,
  round(sum(cost_usd), 10) as total_spend_usd, round(avg(latency_ms), 6) as avg_latency_ms
from calls""")
def traffic_kpis(spark, d):
    return kpi.traffic_kpis(v.calls(spark, d)).select(
        "total_requests", "cache_hits", r6("cache_hit_rate_pct"), r10("total_spend_usd"),
        r6("avg_latency_ms"),
    )


@query("spend_per_backend", "calls", """
select backend, round(sum(cost_usd), 10) as spend_usd from calls group by backend""")
def spend_per_backend(spark, d):
    return kpi.spend_per_backend(v.calls(spark, d)).select("backend", r10("spend_usd"))


@query("latency_per_backend", "calls", """
select backend, round(avg(latency_ms), 6) as avg_latency_ms,
  round(quantile_cont(latency_ms, 0.5), 6) as p50_latency_ms,
  round(quantile_cont(latency_ms, 0.95), 6) as p95_latency_ms
from calls group by backend""")
def latency_per_backend(spark, d):
    return kpi.latency_per_backend(v.calls(spark, d), rows_per_slice=N).select(
        "backend", r6("avg_latency_ms"), r6("p50_latency_ms"), r6("p95_latency_ms")
    )


@query("spend_by_period", "calls", """
select api_key, strftime(ts, '%Y-%m') as month, strftime(ts, '%Y-%m-%d') as day,
  round(sum(cost_usd), 10) as spend_usd, 'day' as period from calls group by 1, 2, 3
union all select api_key, strftime(ts, '%Y-%m'), null, round(sum(cost_usd), 10), 'month'
from calls group by 1, 2""")
def spend_by_period(spark, d):
    return kpi.spend_by_period(v.calls(spark, d)).select(
        "api_key", "month", "day", r10("spend_usd"), "period"
    )


@query("requests_by_status", "calls", """
select case when status = 'error' then 'unknown' else backend end as backend, status,
  count(*) as n_requests from calls group by 1, 2""")
def requests_by_status(spark, d):
    return kpi.requests_by_status(v.calls(spark, d))


def _reused(spark, d):
    return reuse.prompt_reuse(
        v.traffic(spark, d), "k", 21600, keep=("event_id", "ts", "api_key"), rows_per_slice=N
    )


@query("cache_hit_ratio", "traffic reuse", """
select api_key, strftime(t.ts, '%Y-%m-%d') as day, count(*) as lookups,
  count(*) filter (hit) as hits, round(avg(cast(hit as double)), 6) as hit_ratio
from traffic t join reuse r on r.event_id = t.event_id group by 1, 2""")
def cache_hit_ratio(spark, d):
    looked = _reused(spark, d).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return reuse.cache_hit_ratio(looked, ["api_key", "day"]).withColumn(
        "hit_ratio", F.round("hit_ratio", 6)
    )


@query("latency_histogram", "calls", """
select backend, b.le, count(*) filter (latency_ms <= b.le) as n_at_most,
  count(*) as n_requests, round(sum(latency_ms), 6) as latency_sum_ms
from calls, (select unnest(['5', '10', '25', '50', '75', '100', '250', '500', '750', '1000',
  'inf']::double[]) as le) b group by backend, b.le""")
def latency_histogram(spark, d):
    return kpi.latency_histogram(v.calls(spark, d)).withColumn(
        "latency_sum_ms", F.round("latency_sum_ms", 6)
    )


@query("failover_summary", "attempts", """
select request_id, arg_max(backend, seq) filter (ok) as served_by, count(*) as tries,
  count(*) filter (not ok and attempt >= 2) as backends_exhausted,
  sum(case when not ok and attempt < 2 then pow(2.0::double, attempt) else 0.0 end) as backoff_s,
  case when bool_or(ok) then 'success' else 'failed' end as outcome
from attempts group by request_id""")
def failover_summary(spark, d):
    return routing.failover_summary(v.attempts(spark, d))


@query("admission_funnel", "traffic rate paid5 flagged_docs", """
select stage, cast(case stage when 'unknown_key' then 401 when 'rate_limited' then 429
    when 'empty' then 400 when 'guardrail' then 400 when 'cache_hit' then 200
    when 'over_budget' then 429 when 'no_backend' then 503 when 'failed' then 500 else 200 end
    as int) as code, count(*) as n_requests
from (select case when t.api_key = 'sk-9' then 'unknown_key' when not r.allowed then 'rate_limited'
    when t.event_id % 50 = 0 then 'empty'
    when t.k in (select doc_id from flagged_docs) then 'guardrail'
    when u.hit then 'cache_hit' when b.decision <> 'allowed' then 'over_budget'
    when t.status = 'error' and t.event_id % 2 = 0 then 'no_backend'
    when t.status = 'error' then 'failed' else 'served' end as stage
  from traffic t left join rate r on r.event_id = t.event_id
  left join hit5 u on u.event_id = t.event_id
  left join paid5 b on b.event_id = t.event_id)
group by stage""")
def admission_funnel(spark, d):
    t = v.traffic(spark, d)
    error = F.col("status") == "error"
    requests = t.select(
        "event_id",
        "api_key",
        "ts",
        "k",
        "budget_cost_usd",
        (F.col("event_id") % 50 == 0).alias("empty"),
        (error & (F.col("event_id") % 2 == 0)).alias("no_backend"),
        error.alias("failed"),
    )
    prompts = v.docs_injected(spark, d).select(F.col("doc_id").alias("k"), "text")
    decided = admission.decide_requests(
        requests,
        v.budgets(spark),
        prompts,
        prompt="k",
        rate_limit=2,
        rate_window_sec=3600,
        ttl_sec=21600,
        rows_per_slice=N,
    )
    return admission.admission_funnel(decided)


@query("breaker_gauge", "trace", """
select backend, arg_max(case state_after when 'OPEN' then 2 else 0 end, event_id) as code
from trace group by backend""")
def breaker_gauge(spark, d):
    return health.breaker_gauge(
        _trace(spark, d).withColumnRenamed("state_after", "state"), ["ts", "event_id"]
    )


@query("token_usage", "calls", """
select api_key, model, cast(sum(prompt_tokens) as bigint) as prompt_tokens,
  cast(sum(completion_tokens) as bigint) as completion_tokens,
  cast(sum(prompt_tokens + completion_tokens) as bigint) as total_tokens
from calls group by api_key, model""")
def token_usage(spark, d):
    return kpi.token_usage(v.calls(spark, d))


# --- ordered operators ---------------------------------------------------------------------------


@query("latency_ema", "ema", "select event_id, backend, round(ema, 6) as ema from ema")
def latency_ema(spark, d):
    return _emas(spark, d).select("event_id", "backend", r6("ema"))


@query("failure_streaks", "streaks", """
select event_id, backend, cast(streak as bigint) as streak from streaks""")
def failure_streaks(spark, d):
    return health.failure_streaks(v.traffic(spark, d), OK(), rows_per_slice=N).select(
        "event_id", "backend", "streak"
    )


@query("breaker_trace", "trace", """
select event_id, backend, streak, state_before, state_after from trace""")
def breaker_trace(spark, d):
    return _trace(spark, d).select("event_id", "backend", "streak", "state_before", "state_after")


@query("rate_limit_decisions", "rate", "select event_id, api_key, ts, allowed from rate")
def rate_limit_decisions(spark, d):
    return admission.rate_limit_decisions(
        v.traffic(spark, d), limit=2, window_sec=3600, rows_per_slice=N
    )


@query("rate_limit_per_key", "rate_keyed", "select event_id, api_key, ts, allowed from rate_keyed")
def rate_limit_per_key(spark, d):
    """Each key's own limit; groups of more than 250 calls are walked in steps."""
    own = v.budgets(spark).withColumn(
        "requests_per_minute", F.floor(F.col("requests_per_minute") / 30).cast("int"))
    return admission.rate_limit_decisions(
        v.traffic(spark, d), own, window_sec=3600, max_group_rows=250, rows_per_slice=N
    )


@query("budget_decisions_stepwise", "budgeted", "select event_id, api_key, ts, decision from budgeted")
def budget_decisions_stepwise(spark, d):
    return admission.budget_decisions(
        v.traffic(spark, d), v.budgets(spark), max_group_rows=100, rows_per_slice=N
    )


@query("prompt_reuse_chains", "reuse", "select event_id, ts, key as k, hit from reuse")
def prompt_reuse_chains(spark, d):
    """Runs of more than 20 calls are chains of successors."""
    return reuse.prompt_reuse(
        v.traffic(spark, d), "k", 21600, max_group_rows=20, rows_per_slice=N
    )


@query("rate_utilisation", "traffic", """
select a.event_id, a.api_key, a.ts, count(*) over w - 1 as prior_calls,
  (count(*) over w - 1) / 2.0::double as utilisation
from traffic a
window w as (partition by api_key order by ts
  range between interval '3599.999999 seconds' preceding and current row)""")
def rate_utilisation(spark, d):
    return admission.rate_utilisation(
        v.traffic(spark, d), F.lit(2), 3600, rows_per_slice=N
    )


@query("budget_decisions", "budgeted", "select event_id, api_key, ts, decision from budgeted")
def budget_decisions(spark, d):
    return admission.budget_decisions(v.traffic(spark, d), v.budgets(spark), rows_per_slice=N)


@query("prompt_reuse", "reuse", "select event_id, ts, key as k, hit from reuse")
def prompt_reuse(spark, d):
    return reuse.prompt_reuse(v.traffic(spark, d), "k", 21600, rows_per_slice=N)


@query("prompt_reuse_bounded", "reuse_bounded",
       "select event_id, ts, key as k, hit from reuse_bounded")
def prompt_reuse_bounded(spark, d):
    return reuse.prompt_reuse(v.traffic(spark, d), "k", 21600, capacity=50, rows_per_slice=N)


@query("reuse_distance", "resident", "select event_id, ts, distance, resident from resident")
def reuse_distance(spark, d):
    return reuse.reuse_distance(v.traffic(spark, d), "k", 50, rows_per_slice=N)


@query("round_robin_assign", "traffic", """
select event_id, concat('b', cast((row_number() over (order by ts, event_id) - 1) % 3 as varchar))
  as assigned from traffic""")
def round_robin_assign(spark, d):
    return routing.round_robin_assign(
        v.traffic(spark, d), ["b0", "b1", "b2"], rows_per_slice=N
    ).select("event_id", "assigned")


def _rank(spark, d, strategy, emas=None):
    t = v.traffic(spark, d).select("event_id", "ts", (F.col("k") % 2 == 0).alias("complex"))
    return routing.rank_backends(t, v.backends(spark), strategy, emas, rows_per_slice=N).select(
        "event_id", "rank", "backend"
    )


_RANK = "select event_id, cast(row_number() over (partition by event_id order by {}) as int) as rank, "


@query("rank_backends_cost_first", "traffic backends",
       _RANK.format("cost_per_1k_prompt, cfg_idx") + "b.backend from traffic, backends b")
def rank_cost_first(spark, d):
    return _rank(spark, d, "cost_first")


@query("rank_backends_complexity", "traffic backends",
       _RANK.format("case when k % 2 = 0 then -cost_per_1k_prompt else cost_per_1k_prompt end, "
                    "cfg_idx") + "b.backend from traffic, backends b")
def rank_complexity(spark, d):
    return _rank(spark, d, "complexity")


@query("rank_backends_round_robin", "traffic backends", """
select event_id, cast((cfg_idx - n % 3 + 3) % 3 + 1 as int) as rank, b.backend
from (select event_id, row_number() over (order by ts, event_id) - 1 as n from traffic), backends b
""")
def rank_round_robin(spark, d):
    return _rank(spark, d, "weighted_round_robin")


@query("rank_backends_latency_first", "traffic backends ema",
       _RANK.format("coalesce(ema, 9999.0), cfg_idx") + """backend
from (select t.event_id, t.backend, t.cfg_idx, e.ema
  from (select event_id, ts, b.backend, b.cfg_idx from traffic, backends b) t
  asof left join ema e on e.backend = t.backend and e.ts < t.ts)""")
def rank_latency_first(spark, d):
    return _rank(spark, d, "latency_first", _emas(spark, d))


_OPEN = """
grid as (select t.event_id, t.ts, b.* from traffic t, backends b),
known as (select g.*, r.ts as since, r.state_after = 'OPEN' as open,
    g.ts >= r.ts + interval 900 second as cooled
  from grid g asof left join trace r on r.backend = g.backend and r.ts < g.ts),
probes as (select *, row_number() over (partition by backend, since, cooled order by ts, event_id) as nth
  from known),
tried as (select * from probes where not coalesce(open and (not cooled or nth > 1), false))"""


def _available(spark, d):
    requests = v.traffic(spark, d).select("event_id", "ts")
    return routing.request_available_backends(
        requests, v.backends(spark), _trace(spark, d), 900, rows_per_slice=N
    )


@query("request_available_backends", "trace backends", f"""
with {_OPEN.strip()}
select t.event_id, coalesce(string_agg(tried.backend, '|' order by cfg_idx), '') as available
from traffic t left join tried on tried.event_id = t.event_id group by t.event_id""")
def request_available_backends(spark, d):
    return _available(spark, d).select("event_id", F.array_join("available", "|").alias("available"))


@query("rank_available_backends", "trace backends", f"""
with {_OPEN.strip()}
select event_id, cast(row_number() over (partition by event_id order by cost_per_1k_prompt, cfg_idx)
  as int) as rank, backend from tried""")
def rank_available_backends(spark, d):
    return routing.rank_backends(
        _available(spark, d), v.backends(spark), "cost_first", available="available"
    ).select("event_id", "rank", "backend")


# --- top-k and sets ------------------------------------------------------------------------------


@query("recent_requests", "calls", """
select request_id, api_key, backend, model, round(cost_usd, 10) as cost_usd,
  round(latency_ms, 6) as latency_ms, ts from calls order by ts desc, request_id limit 50""")
def recent_requests(spark, d):
    return kpi.recent_requests(v.calls(spark, d)).withColumn(
        "cost_usd", F.round("cost_usd", 10)
    ).withColumn("latency_ms", F.round("latency_ms", 6))


@query("cheapest_backend_per_request", "traffic", """
select event_id, case when k % 2 = 0 then 'b0' else 'b2' end as backend from traffic""")
def cheapest_backend_per_request(spark, d):
    t = v.traffic(spark, d).select("event_id", (F.col("k") % 2 == 0).alias("complex"))
    return routing.first_backend(t, v.backends(spark), "complexity").select("event_id", "backend")


@query("budget_key_drift", "traffic", """
select api_key, 'config_only' as drift from (
  select distinct concat('sk-', cast(user_id % 40 as varchar)) as api_key from traffic)
where api_key not in (select concat('sk-', cast(user_id % 25 + 5 as varchar)) from traffic)
union all select api_key, 'ledger_only' from (
  select distinct concat('sk-', cast(user_id % 25 + 5 as varchar)) as api_key from traffic)
where api_key not in (select concat('sk-', cast(user_id % 40 as varchar)) from traffic)""")
def budget_key_drift(spark, d):
    t = v.traffic(spark, d)
    key = lambda n: t.select(F.concat(F.lit("sk-"), n.cast("string")).alias("api_key"))
    return kpi.budget_key_drift(key(F.col("user_id") % 40), key(F.col("user_id") % 25 + 5))


# --- streams -------------------------------------------------------------------------------------


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream, whether it is one file or a folder of files."""
    table = v.table(spark, sf_dir, name)
    reader = spark.readStream.schema(table.schema)
    path = f"{sf_dir}/{name}.parquet"
    if any(f"/{name}.parquet/" in file for file in table.inputFiles()):
        return reader.parquet(path)
    # a stream is read from a folder, so of a single file it is the one with that name
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def _drain(spark: SparkSession, stream: DataFrame, partition_by=()) -> DataFrame:
    """Run a stream over everything there is, and read its sink."""
    folder = scratch_dir(spark, "stream")
    jobs.run_to_table(stream, f"{folder}/out", f"{folder}/checkpoint", partition_by).awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@query("stream_ledger_ingest", "calls", """
select request_id, api_key, round(cost_usd, 10) as cost_usd, ts from calls""")
def stream_ledger_ingest(spark, d):
    traffic = v.traffic_of(_stream(spark, d, "events"))
    priced = pricing.request_cost(traffic, v.backends(spark))
    cost = F.when(F.col("k") == 7, 0.0).otherwise(F.col("cost_usd"))
    sent = priced.select("request_id", "api_key", cost.alias("cost_usd"), "ts")
    twice = sent.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(1)))).drop("copy")
    folder = scratch_dir(spark, "ingest")
    jobs.stream_ledger_ingest(
        twice, f"{folder}/ledger", f"{folder}/checkpoint", "ts", "request_id"
    ).awaitTermination()
    return spark.read.parquet(f"{folder}/ledger").select(
        "request_id", "api_key", r10("cost_usd"), "ts"
    )


@query("stream_rate_limit", "rate", "select event_id, api_key, ts, allowed from rate")
def stream_rate_limit(spark, d):
    decided = jobs.stream_rate_limit(
        v.traffic_of(_stream(spark, d, "events")), limit=2, window_sec=3600
    )
    return _drain(spark, decided).drop("late")


@query("stream_breaker_transitions", "trace", """
select event_id, backend, ts, concat(state_before, '->', state_after) as transition
from trace where state_before <> state_after""")
def stream_breaker_transitions(spark, d):
    changes = jobs.stream_breaker_transitions(
        v.traffic_of(_stream(spark, d, "events")), OK(), cooldown_sec=900
    )
    return _drain(spark, changes).drop("late")


@query("stream_budget_spend", "budgeted", "select event_id, api_key, ts, decision from budgeted")
def stream_budget_spend(spark, d):
    decided = jobs.stream_budget_spend(v.traffic_of(_stream(spark, d, "events")), v.budgets(spark))
    return _drain(spark, decided).drop("late")


def _out_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events in four micro-batches dealt by hash, so that each has calls of all times, and then
    one call so late that the watermark passes all others."""
    events = v.table(spark, sf_dir, "events")
    folder = scratch_dir(spark, "out-of-order")
    for part in range(4):
        events.where(F.pmod(F.xxhash64("event_id"), F.lit(4)) == part).write.parquet(
            f"{folder}/{part}")
    end = events.agg(F.max("ts") + F.expr("interval 800 days")).first()[0]
    events.limit(1).withColumn("event_id", F.lit(-1).cast("long")).withColumn(
        "ts", F.lit(end).cast(events.schema["ts"].dataType)).write.parquet(f"{folder}/4")
    files = len(spark.read.schema(events.schema).parquet(f"{folder}/*").inputFiles())
    return v.traffic_of(spark.readStream.schema(events.schema).option(
        "maxFilesPerTrigger", max(1, files // 5)).parquet(f"{folder}/*"))


@query("stream_rate_limit_any_order", "rate", "select event_id, api_key, ts, allowed from rate")
def stream_rate_limit_any_order(spark, d):
    decided = jobs.stream_rate_limit(
        _out_of_order(spark, d), limit=2, window_sec=3600, delay="400 days")
    return _drain(spark, decided).drop("late")


@query("stream_budget_any_order", "budgeted", "select event_id, api_key, ts, decision from budgeted")
def stream_budget_any_order(spark, d):
    decided = jobs.stream_budget_spend(
        _out_of_order(spark, d), v.budgets(spark), delay="400 days")
    return _drain(spark, decided).drop("late")


def _in_runs(spark: SparkSession, sf_dir: str, start: Callable) -> str:
    """Run a stream over each quarter of the events' time, from its checkpoint; where it writes to."""
    events = v.table(spark, sf_dir, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    cuts = events.agg(F.percentile_approx(micros, [0.25, 0.5, 0.75])).first()[0] or []
    quarter = F.lit(0)
    for cut in cuts:
        quarter = quarter + F.coalesce((micros > cut).cast("int"), F.lit(0))
    folder = scratch_dir(spark, "runs")
    for part in range(len(cuts) + 1):
        events.where(quarter == part).write.parquet(f"{folder}/in/{part}")
        stream = v.traffic_of(spark.readStream.schema(events.schema).parquet(f"{folder}/in/*"))
        start(stream, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return f"{folder}/out"


@query("stream_rate_limit_sliced", "rate", "select event_id, api_key, ts, allowed from rate")
def stream_rate_limit_sliced(spark, d):
    out = _in_runs(spark, d, lambda calls, path, checkpoint: sliced.sliced_rate_limit(
        calls, path, checkpoint, limit=2, window_sec=3600))
    return sliced.read_decided(spark, out).select("event_id", "api_key", "ts", "allowed")


@query("stream_breaker_sliced", "trace", """
select event_id, backend, ts, state_before, state_after from trace""")
def stream_breaker_sliced(spark, d):
    out = _in_runs(spark, d, lambda calls, path, checkpoint: sliced.sliced_breaker_transitions(
        calls, OK(), path, checkpoint, cooldown_sec=900))
    return sliced.read_decided(spark, out).select(
        "event_id", "backend", "ts", "state_before", "state_after")


@query("stream_traffic_kpis", "traffic", """
select time_bucket(interval 1 hour, ts) as window_start, backend, status, count(*) as n_requests,
  round(sum(budget_cost_usd), 10) as spend_usd, round(avg(latency_ms), 6) as avg_latency_ms
from traffic group by 1, 2, 3""")
def stream_traffic_kpis(spark, d):
    traffic = v.traffic_of(_stream(spark, d, "events")).withColumnRenamed(
        "budget_cost_usd", "cost_usd"
    )
    folder = scratch_dir(spark, "kpis")
    jobs.run_to_keyed_table(
        jobs.stream_traffic_kpis(traffic), f"{folder}/out", f"{folder}/checkpoint"
    ).awaitTermination()
    keys = ["window_start", "backend", "status"]
    return jobs.read_keyed_table(spark, f"{folder}/out", keys).select(
        "window_start", "backend", "status", "n_requests", r10("spend_usd"), r6("avg_latency_ms")
    )


@query("stream_prompt_reuse", "reuse", "select event_id, ts, key as k, hit from reuse")
def stream_prompt_reuse(spark, d):
    found = jobs.stream_prompt_reuse(v.traffic_of(_stream(spark, d, "events")), "k", 21600)
    return _drain(spark, found).drop("late")


@query("stream_settle_answers", "backends", SETTLED_SQL)
def stream_settle_answers(spark, d):
    answers = _answers_of(_stream(spark, d, "conversations"))
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("stream_id"))
    settled = settling.stream_settle_answers(
        _lines_of(answers).withColumn("ts", at), _opened(spark, d), v.backends(spark))
    return _settled_columns(_drain(spark, settled))


@query("stream_redact", "docs_injected", f"""
select doc_id, {_redact_sql('text')} as text, {_phrase_sql()} is not null as quarantined
from docs_injected""")
def stream_redact(spark, d):
    docs = v.inject(_stream(spark, d, "documents"))
    cleaned = jobs.stream_redact(docs.select("doc_id", "text"))
    return _drain(spark, cleaned, ["quarantined"]).select(
        "doc_id", "text", F.col("quarantined").cast("boolean").alias("quarantined")
    )
