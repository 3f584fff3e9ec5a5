"""Request bodies, answer documents, streamed answer lines and service log lines as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trafficlens.functions.money import call_cost
from trafficlens.functions.text import stripped
from trafficlens.plans.scratch import materialise
from trafficlens.plans.sides import small_side
from trafficlens.plans.slices import ROWS_PER_SLICE, Running, running

BODY_TYPE = (
    "messages array<struct<role:string,content:string>>, model string, stream boolean, "
    "max_tokens long, temperature double, top_p double, presence_penalty double, "
    "frequency_penalty double"
)
CHUNK_TYPE = (
    "id string, type string, model string, message struct<id:string>, "
    "delta struct<type:string,text:string>, "
    "choices array<struct<delta:struct<content:string>,finish_reason:string>>"
)
CHOICES_TYPE = (
    "id string, choices array<struct<message:struct<role:string,content:string>>>, "
    "usage struct<prompt_tokens:long,completion_tokens:long>"
)
BLOCKS_TYPE = (
    "id string, role string, content array<struct<type:string,text:string>>, "
    "usage struct<input_tokens:long,output_tokens:long>"
)
#: The provider whose answers are typed blocks; all others answer with choices.
BLOCKS_PROVIDER = "anthropic"
LOG_TYPE = "timestamp string, level string, message string, logger string"

# Message templates of the service log, and the kind of fact each one states.
LOG_TEMPLATES: list[tuple[str, str]] = [
    ("route", r"^Routing request to (\S+) using model (\S+) \(attempt (\d+)/(\d+)\)$"),
    ("retry", r"^Transient failure on (\S+) \((.*)\)\. Retrying in (\d+)s\.\.\.$"),
    ("exhausted", r"^Backend (\S+) failed after (\d+) attempts: (.*)$"),
    ("stream_open", r"^Opening stream routing to (\S+) using model (\S+)$"),
    ("stream_failed", r"^Backend stream startup on (\S+) failed: (.*)$"),
]


def parse_chat_bodies(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Messages, typed parameters and all other parameters; ``code`` 400 without messages."""
    parsed = bodies.withColumn("b", F.from_json(body, BODY_TYPE)).withColumn(
        "every", F.from_json(body, "map<string,string>")
    )
    return parsed.select(
        *bodies.columns,
        "b.*",
        F.map_filter("every", lambda k, v: ~k.isin("messages", "model")).alias("params"),
        F.when(F.size(F.coalesce("b.messages", F.array())) > 0, 200).otherwise(400).alias("code"),
    )


def parse_provider_answers(
    answers: DataFrame, backends: DataFrame, body: str = "body"
) -> DataFrame:
    """Normalised responses from answer documents of either dialect.

    ``answers`` has the backend that was called and the document; ``backends`` tells provider, model and
    prices. Added are ok, id, model (the backend's own), messages, prompt_tokens,
    completion_tokens and cost_usd; a column of ``answers`` with one of these names is replaced.

    Each choice is a message. Of typed blocks those of type text are joined into the one message, whose role is
    assistant where none is named. What a document leaves out, or names as null, is an empty
    string or 0. A body that is null or not a JSON object is a failed call: ``ok`` is false and
    all but model is null. Backends that are not listed answer with choices, have no model and
    cost nothing.
    """
    catalogue = small_side(backends.select(
        "backend", F.col("provider").alias("__provider"), F.col("model").alias("__model"),
        F.col("cost_per_1k_prompt").alias("__prompt_price"),
        F.col("cost_per_1k_completion").alias("__completion_price"),
    ))
    called = answers.join(catalogue, "backend", "left")
    typed = F.coalesce(F.col("__provider") == BLOCKS_PROVIDER, F.lit(False))
    ok = F.coalesce(
        F.startswith(F.ltrim(body), F.lit("{")) & F.try_parse_json(body).isNotNull(), F.lit(False)
    )
    parsed = (
        called.withColumn("__ok", ok)
        .withColumn("__c", F.when(F.col("__ok") & ~typed, F.from_json(body, CHOICES_TYPE)))
        .withColumn("__b", F.when(F.col("__ok") & typed, F.from_json(body, BLOCKS_TYPE)))
    )
    message = lambda role, content: F.struct(role.alias("role"), content.alias("content"))
    choices = F.transform(
        F.coalesce("__c.choices", F.from_json(F.lit("[]"), _type_of(CHOICES_TYPE, "choices"))),
        lambda c: message(
            F.coalesce(c["message"]["role"], F.lit("")),
            F.coalesce(c["message"]["content"], F.lit("")),
        ),
    )
    blocks = F.filter("__b.content", lambda x: x["type"] == "text")
    block_text = F.coalesce(F.array_join(F.transform(blocks, lambda x: x["text"]), ""), F.lit(""))
    joined = F.array(message(F.coalesce("__b.role", F.lit("assistant")), block_text))

    def when_ok(value):
        return F.when(F.col("__ok"), value)

    new = {
        "ok": F.col("__ok"),
        "id": when_ok(F.coalesce("__c.id", "__b.id", F.lit(""))),
        "model": F.col("__model"),
        "messages": when_ok(F.when(typed, joined).otherwise(choices)),
        "prompt_tokens": when_ok(
            F.coalesce("__c.usage.prompt_tokens", "__b.usage.input_tokens", F.lit(0))),
        "completion_tokens": when_ok(
            F.coalesce("__c.usage.completion_tokens", "__b.usage.output_tokens", F.lit(0))),
    }
    kept = [c for c in answers.columns if c not in (*new, "cost_usd", body)]
    cost = call_cost("prompt_tokens", "completion_tokens", "__prompt_price", "__completion_price")
    return parsed.select(
        *kept, "__prompt_price", "__completion_price", *[c.alias(n) for n, c in new.items()]
    ).select(
        *kept, *new, F.when(F.col("ok"), F.coalesce(cost, F.lit(0.0))).alias("cost_usd")
    )


def _type_of(ddl: str, field: str) -> T.DataType:
    return T.StructType.fromDDL(ddl)[field].dataType


def read_answer_lines(lines: DataFrame, *also: str) -> DataFrame:
    """What each streamed answer line says, without regard to the lines around it.

    ``ends`` marks the last line of an answer, ``started`` is the id an answer begins with,
    ``is_chunk`` tells lines that are passed on. Lines that are not data are left out.
    """
    data = lines.select("stream_id", "seq", *also, stripped(F.col("line")).alias("line")).where(
        F.col("line").startswith("data: ")
    ).select("stream_id", "seq", *also, F.substring("line", 7, 2**31 - 1).alias("data"))
    typed = F.col("e.type")
    stopped = F.coalesce(typed == "message_stop", F.lit(False))
    content = F.coalesce(
        F.get("e.choices", 0)["delta"]["content"],
        F.when(
            (typed == "content_block_delta") & (F.col("e.delta.type") == "text_delta"),
            F.col("e.delta.text"),
        ),
    )
    plain = (
        typed.isNull() & F.col("data").startswith("{")
        & (F.col("e.choices").isNotNull() | F.try_parse_json("data").isNotNull())
    )
    return data.withColumn("e", F.from_json("data", CHUNK_TYPE)).select(
        "stream_id",
        "seq",
        *also,
        (F.coalesce(F.col("data") == "[DONE]", F.lit(False)) | stopped).alias("ends"),
        F.when(typed == "message_start", F.col("e.message.id")).alias("started"),
        content.alias("content"),
        F.when(typed.isNull(), F.col("e.id")).alias("chunk_id"),
        F.when(stopped, "stop").otherwise(
            F.get("e.choices", 0)["finish_reason"]).alias("finish_reason"),
        (F.coalesce(plain, F.lit(False)) | content.isNotNull() | stopped).alias("is_chunk"),
    )


def parse_sse_chunks(lines: DataFrame, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Content chunks of streamed answers from (stream_id, seq, line).

    Two dialects: completion chunks ended by ``[DONE]``, and typed events where
    ``message_start`` carries the id, text deltas the content and ``message_stop`` ends. Lines
    after the end, lines that are not data and broken JSON are left out. A chunk without choices (one
    that carries usage only) is passed on.
    """
    # parsing is the dear part, and running totals read their input more than once
    parsed = materialise(read_answer_lines(lines), "chunks")
    seen = running(
        parsed,
        "stream_id",
        ["seq"],
        [
            Running("ended", "sum", F.col("ends").cast("long"), prior=True),
            Running(
                "start",
                "max",
                F.when(F.col("started").isNotNull(), F.struct("seq", "started")),
            ),
        ],
        rows_per_slice,
    )
    return seen.where((F.col("ended") == 0) & F.col("is_chunk")).select(
        "stream_id",
        "seq",
        F.coalesce("chunk_id", "start.started").alias("id"),
        "content",
        "finish_reason",
    )


def parse_service_logs(lines: DataFrame, line: str = "line") -> DataFrame:
    """Attempt facts from JSON log lines; lines that match no template are left out."""
    log = lines.withColumn("l", F.from_json(line, LOG_TYPE)).select(
        *[c for c in lines.columns if c != line],
        F.col("l.timestamp").alias("logged_at"),
        F.col("l.level").alias("level"),
        F.col("l.message").alias("message"),
    )
    kind = None
    for name, pattern in LOG_TEMPLATES:
        hit = F.col("message").rlike(pattern)
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
    pattern = dict(LOG_TEMPLATES)

    def part(name: str, group: int):
        return F.when(
            F.col("kind") == name, F.regexp_extract("message", pattern[name], group)
        )

    return (
        log.withColumn("kind", kind)
        .where(F.col("kind").isNotNull())
        .select(
            *[c for c in log.columns if c != "message"],
            "kind",
            F.coalesce(*[part(n, 1) for n in pattern]).alias("backend"),
            F.coalesce(part("route", 2), part("stream_open", 2)).alias("model"),
            part("route", 3).cast("int").alias("attempt"),
            F.coalesce(part("route", 4), part("exhausted", 2)).cast("int").alias("max_attempts"),
            part("retry", 3).cast("int").alias("backoff_s"),
            F.coalesce(part("retry", 2), part("exhausted", 3), part("stream_failed", 2)).alias(
                "error"
            ),
        )
    )
