"""Chat messages and parameters: cache keys, prompt classes, dialects and answer streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficlens.functions.text import COMPLEX_LENGTH, COMPLEX_WORDS, is_complex, stripped
from trafficlens.plans.slices import ROWS_PER_SLICE, Running, running, slices_of

# Parameters that are part of a cache key, parameters the completion dialect
# accepts, and the answer length the other dialect assumes when none is given.
CACHE_KEY_PARAMS = ["temperature", "max_tokens", "top_p", "presence_penalty", "frequency_penalty"]
COMPLETION_PARAMS = [
    "temperature", "max_tokens", "top_p", "presence_penalty", "frequency_penalty", "stop",
    "user", "seed", "response_format",
]
DEFAULT_ANSWER_TOKENS = 1024


def cache_key(messages: Column, params: Column, extra: Sequence[Column] = ()) -> Column:
    """Digest of the stripped messages and the key parameters; equal prompts, equal digest.

    ``messages`` is an array of (role, content), ``params`` a map of raw JSON values; ``extra``
    columns (a model or tenant, say) narrow the key further.
    """
    said = F.transform(
        messages,
        lambda m: F.struct(
            stripped(F.coalesce(m["content"], F.lit(""))).alias("content"),
            stripped(F.coalesce(m["role"], F.lit(""))).alias("role"),
        ),
    )
    given = F.coalesce(params, F.create_map().cast("map<string,string>"))
    used = F.sort_array(
        F.map_entries(F.map_filter(given, lambda k, v: k.isin(CACHE_KEY_PARAMS)))
    )
    more = [c.alias(f"extra{i}") for i, c in enumerate(extra)]
    whole = F.struct(used.alias("kwargs"), said.alias("messages"), *more)
    return F.sha2(F.to_json(whole, {"ignoreNullFields": "false"}), 256)


def prompt_cache_key(
    requests: DataFrame, messages: str = "messages", params: str = "params",
    key_cols: Sequence[str] = (),
) -> DataFrame:
    key = cache_key(F.col(messages), F.col(params), [F.col(c) for c in key_cols])
    return requests.withColumn("prompt_key", key)


def complexity_class(
    messages: DataFrame,
    request: str = "conv_id",
    position: str = "turn",
    text: str = "text",
    words: Sequence[str] = COMPLEX_WORDS,
    max_length: int = COMPLEX_LENGTH,
) -> DataFrame:
    """``complex`` is decided on all messages of a request joined by a space.

    The joined length is a plain sum, so long requests are settled without joining any text;
    only requests within ``max_length`` characters are put together.
    """
    sized = messages.groupBy(request).agg(
        (F.sum(F.coalesce(F.length(F.lower(text)), F.lit(0))) + F.count(F.lit(1)) - 1).alias(
            "length"
        )
    )
    long = sized.where(F.col("length") > max_length).select(
        request, F.col("length"), F.lit(True).alias("complex")
    )
    short = sized.where(F.col("length") <= max_length)
    joined = (
        messages.join(short, request)
        .groupBy(request, "length")
        .agg(
            F.sort_array(
                F.collect_list(F.struct(position, F.coalesce(text, F.lit("")).alias("content")))
            ).alias("m")
        )
        .select(
            request,
            "length",
            is_complex(F.array_join("m.content", " "), words, max_length).alias("complex"),
        )
    )
    return long.unionByName(joined)


def clean_params(params: Column) -> Column:
    """Completion dialect: the accepted parameters that are not null."""
    return F.map_filter(params, lambda k, v: k.isin(COMPLETION_PARAMS) & v.isNotNull())


def provider_params(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Request parameters (a JSON object) in both provider dialects."""
    raw = F.from_json(body, "map<string,string>")
    typed = F.from_json(body, "max_tokens long, temperature double, top_p double, "
                              "stop array<string>")
    read = bodies.withColumn("__raw", raw).withColumn("__t", typed)
    stop = F.col("__raw")["stop"]
    # a single string is taken, values of other types are not
    single = F.schema_of_variant(
        F.try_variant_get(F.try_parse_json(F.col(body)), "$.stop", "variant")
    ) == "STRING"
    within = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    return read.select(
        *bodies.columns,
        clean_params(F.col("__raw")).alias("completion_params"),
        F.coalesce("__t.max_tokens", F.lit(DEFAULT_ANSWER_TOKENS).cast("long")).alias(
            "max_tokens"
        ),
        F.when(F.col("__t.temperature").isNotNull(), within(F.col("__t.temperature"))).alias(
            "temperature"
        ),
        F.when(F.col("__t.top_p").isNotNull(), within(F.col("__t.top_p"))).alias("top_p"),
        F.coalesce(
            "__t.stop",
            F.when(single, F.array(stop)),
        ).alias("stop_sequences"),
    )


def merge_adjacent_turns(
    turns: DataFrame,
    request: str = "conv_id",
    position: str = "turn",
    text: str = "text",
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Alternating user and assistant messages: neighbours of one role become one message.

    Other roles are left out without breaking a run. A request without any such message gets a
    single user message ``.``. A merged message is one value of the result.
    """
    role = F.coalesce("role", F.lit("user"))
    kept = turns.where(role.isin("user", "assistant")).select(
        request, position, role.alias("role"), F.coalesce(text, F.lit("")).alias("content")
    )
    slices = slices_of(kept, request, [position], rows_per_slice)
    before = running(
        kept,
        request,
        [position],
        [Running("prev", "max", F.struct(position, "role"), prior=True)],
        slices=slices,
    )
    starts = before.withColumn(
        "starts",
        F.when(F.col("prev.role").eqNullSafe(F.col("role")), F.lit(None)).otherwise(
            F.col(position)
        ),
    ).drop("prev")
    run = running(
        starts, request, [position], [Running("run", "max", F.col("starts"))], slices=slices
    )
    merged = run.groupBy(request, "run").agg(
        F.first("role").alias("role"),
        F.array_join(
            F.sort_array(F.collect_list(F.struct(position, "content")))["content"], "\n\n"
        ).alias("content"),
    ).withColumnRenamed("run", "start_turn")
    empty = (
        turns.select(request)
        .distinct()
        .join(kept.select(request).distinct(), request, "left_anti")
        .select(
            request,
            F.lit(0).cast(turns.schema[position].dataType).alias("start_turn"),
            F.lit("user").alias("role"),
            F.lit(".").alias("content"),
        )
    )
    return merged.unionByName(empty)


def system_prompt(
    turns: DataFrame, request: str = "conv_id", position: str = "turn", text: str = "text"
) -> DataFrame:
    """Non-empty system messages of a request joined in order; requests without one are absent."""
    return (
        turns.where((F.col("role") == "system") & (F.col(text) != ""))
        .groupBy(request)
        .agg(
            F.array_join(
                F.sort_array(F.collect_list(F.struct(position, F.col(text).alias("content"))))[
                    "content"
                ],
                "\n\n",
            ).alias("system")
        )
    )


def split_stream_deltas(answers: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """Replay stored answers word by word: content chunks, then one closing chunk."""
    words = F.split(text, " ", -1)
    chunks = F.concat(
        F.transform(
            words,
            lambda w, i: F.struct(
                F.when(i > 0, F.concat(F.lit(" "), w)).otherwise(w).alias("content"),
                F.lit(None).cast("string").alias("finish_reason"),
            ),
        ),
        F.array(
            F.struct(
                F.lit(None).cast("string").alias("content"), F.lit("stop").alias("finish_reason")
            )
        ),
    )
    return answers.select(*keys, F.posexplode(chunks).alias("seq", "chunk")).select(
        *keys, "seq", "chunk.*"
    )


def assemble_stream(chunks: DataFrame, keys: Sequence[str], with_ids: bool = False) -> DataFrame:
    """Whole answers from content chunks in order; the last id and model given win."""
    last = [
        F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
        for c in (("id", "model") if with_ids else ())
    ]
    return chunks.groupBy(*keys).agg(
        F.array_join(
            F.sort_array(
                F.collect_list(
                    F.when(F.col("content").isNotNull(), F.struct("seq", "content"))
                )
            )["content"],
            "",
        ).alias("text"),
        F.lit("stop").alias("finish_reason"),
        *last,
    )


def response_envelope(responses: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Completion documents (JSON) from normalised responses.

    Input: id, created, model, messages (array of role, content), prompt and completion tokens.
    """
    choices = F.transform(
        "messages",
        lambda m, i: F.struct(
            i.alias("index"),
            F.struct(m["role"].alias("role"), m["content"].alias("content")).alias("message"),
            F.lit("stop").alias("finish_reason"),
        ),
    )
    usage = F.struct(
        "prompt_tokens",
        "completion_tokens",
        (F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"),
    )
    doc = F.struct(
        "id", F.lit("chat.completion").alias("object"), "created", "model",
        choices.alias("choices"), usage.alias("usage"),
    )
    return responses.select(*keys, F.to_json(doc).alias("document"))
