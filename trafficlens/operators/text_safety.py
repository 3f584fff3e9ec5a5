"""Redaction, reversible masking and prompt screening."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficlens.functions.text import (
    INJECTION_PATTERNS,
    PII_PATTERNS,
    first_injection,
    java_regex,
    redacted,
    text_may_match,
)

VAULT_ENTRY = "array<struct<label:string,seq:int,token:string,value:string>>"


def redact_pii(
    docs: DataFrame, text: str = "text", patterns: Sequence[tuple[str, str]] = PII_PATTERNS
) -> DataFrame:
    return docs.withColumn(text, redacted(F.col(text), patterns))


def redact_conversations(
    turns: DataFrame, keys: Sequence[str] = ("conv_id", "turn"), text: str = "text"
) -> DataFrame:
    """Messages reduced to role and redacted content; a missing role or text becomes empty."""
    return turns.select(
        *keys,
        F.coalesce("role", F.lit("")).alias("role"),
        redacted(F.coalesce(text, F.lit(""))).alias("content"),
    )


def redact_messages(requests: DataFrame, messages: str = "messages") -> DataFrame:
    """The same for a nested message array."""
    return requests.withColumn(
        messages,
        F.transform(
            messages,
            lambda m: F.struct(
                F.coalesce(m["role"], F.lit("")).alias("role"),
                redacted(F.coalesce(m["content"], F.lit(""))).alias("content"),
            ),
        ),
    )


def pii_vault_mask(
    docs: DataFrame, text: str = "text", patterns: Sequence[tuple[str, str]] = PII_PATTERNS
) -> DataFrame:
    """Replace matches by numbered tokens and keep what they stood for in ``entries``.

    Per label the right-most match gets number 1. Every match gets a token of its own, also a
    repeated value. ``entries`` are in the order the tokens were made.
    """
    state = F.struct(
        F.coalesce(text, F.lit("")).alias("t"), F.array().cast(VAULT_ENTRY).alias("e")
    )
    steps = F.array(state)
    for label, pattern in patterns:
        steps = _mask_step(steps, label, pattern)
    # a generator is computed once per row; as a plain column the optimizer would repeat it for
    # each of its fields
    return (
        docs.select("*", F.explode(F.array(F.get(steps, 0))).alias("__m"))
        .withColumn(text, F.when(F.col(text).isNotNull(), F.col("__m.t")))
        .withColumn("entries", F.col("__m.e"))
        .drop("__m")
    )


def _mask_step(steps: Column, label: str, pattern: str) -> Column:
    return F.transform(steps, lambda s: _mask_label(s, label, pattern))


def _mask_label(state: Column, label: str, pattern: str) -> Column:
    regex = F.lit(java_regex(pattern))
    text = state["t"]
    found = F.array(
        F.struct(
            F.regexp_extract_all(text, regex, F.lit(0)).alias("v"),
            F.split(text, java_regex(pattern), -1).alias("parts"),
        )
    )

    def rewrite(f: Column) -> Column:
        n = F.size(f["v"])
        token = lambda i: F.concat(F.lit(f"[{label}_"), (n - i).cast("string"), F.lit("]"))
        pieces = F.transform(
            f["parts"], lambda part, i: F.concat(part, F.when(i < n, token(i)).otherwise(""))
        )
        entries = F.reverse(
            F.transform(
                f["v"],
                lambda value, i: F.struct(
                    F.lit(label).alias("label"),
                    (n - i).alias("seq"),
                    token(i).alias("token"),
                    value.alias("value"),
                ),
            )
        )
        return F.struct(
            F.array_join(pieces, "").alias("t"), F.concat(state["e"], entries).alias("e")
        )

    masked = F.get(F.transform(found, rewrite), 0)
    return F.when(text_may_match(label, text), masked).otherwise(state)


def pii_vault_entries(masked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The vault as a table, one row per token; ``pos`` is the order of making."""
    return masked.select(*keys, F.posexplode("entries").alias("pos", "entry")).select(
        *keys, "pos", "entry.*"
    )


def pii_restore(
    masked: DataFrame, entries: DataFrame, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Put the original values back, from a vault kept as a table.

    A text's entries come together in one row; there are never more of them than the text has
    room for.
    """
    per_doc = entries.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("pos", "token", "value"))).alias("entries")
    )
    return masked.select(*[c for c in masked.columns if c != "entries"]).join(
        per_doc, key, "left"
    ).withColumn(
        text,
        F.aggregate(
            F.coalesce("entries", F.array()),
            F.col(text),
            lambda t, e: F.replace(t, e["token"], e["value"]),
        ),
    ).drop("entries")


def guardrail_scan(
    messages: DataFrame,
    request: str = "conv_id",
    position: str = "turn",
    text: str = "text",
    patterns: Sequence[str] = INJECTION_PATTERNS,
) -> DataFrame:
    """Requests with an injection phrase: first offending message, first phrase in the list."""
    hits = messages.withColumn("phrase", first_injection(F.col(text), patterns)).where(
        F.col("phrase").isNotNull()
    )
    names = F.array(*[F.lit(p) for p in patterns])
    return (
        hits.groupBy(request)
        .agg(F.min(F.struct(position, "phrase")).alias("first"))
        .select(
            request,
            F.col(f"first.{position}").alias(position),
            F.col("first.phrase").alias("phrase"),
            F.get(names, F.col("first.phrase")).alias("pattern"),
        )
    )


def guardrail_clean(
    messages: DataFrame,
    request: str = "conv_id",
    text: str = "text",
    patterns: Sequence[str] = INJECTION_PATTERNS,
) -> DataFrame:
    """Messages of the requests without any violation."""
    bad = messages.where(first_injection(F.col(text), patterns).isNotNull()).select(request)
    return messages.join(bad.distinct(), request, "left_anti")
