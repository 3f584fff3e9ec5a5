"""The operators of this package as queries over the supplied tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficlens.llm import (
    brown,
    collocations,
    crf,
    exact_dedup,
    feistel,
    host_trust,
    jaccard_join,
    mixing,
    spaced_seeds,
    token_orc,
    toxicity,
    warc_salvage,
    whitening,
)
from trafficlens.llm.columns import id_crc, named
from trafficlens.plans.scratch import scratch_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op1_brown_lm")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = id_crc() % 7 == 2
    model, words = brown.train(docs.where(~held_out))
    return brown.score(docs, model, words, held_out)


@query("op2_spaced_seeds")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spaced_seeds.contaminated(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    ).select("doc_id", "item_id", "matched_words", "span_words")


#: A secret in production; here a constant, so that reruns agree.
PSEUDONYM_KEY = "example key"


@query("op3_feistel_pii")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return feistel.pseudonymise(docs, PSEUDONYM_KEY)


@query("op4_jaccard_join")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_shingles", "component_id")


@query("op5_crf_language")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_crc() % 4 == 2
    model = crf.train(docs.where(~held_out).select("text", "lang"))
    return crf.predict(docs, model, {"doc_id": named("doc_id"), "held_out": held_out})


@query("op6_exact_dedup", r"""
with base as (
  select doc_id, length(coalesce(text, '')) as size,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256
  from documents),
ranked as (
  select *, row_number() over best as place, count(*) over (partition by text_sha256) as group_size,
         first_value(doc_id) over best as keep_id
  from base window best as (partition by text_sha256 order by size desc, doc_id nulls last))
select doc_id, keep_id, cast(group_size as bigint) as group_size, place = 1 as kept, text_sha256
from ranked
""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


@query("op7_mix_sources", mixing.MIX_SQL.replace("{docs}", "documents") + """
select doc_id, cast(size as bigint) as size, source_size, target, cast(size * copies as bigint) as taken
from mixed
""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
         ("block", "net/es/"), ("block", "net/fr/"))


@query("op8_host_trust", host_trust.judge_sql(RULES))
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_trust.judge(table(spark, sf_dir, "pages"), RULES).select(
        "page_id", "host", "path", "rule", "verdict")


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    """Learned from labelled documents whose id's crc32 leaves a remainder other than 0 by 5."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    learn = table(spark, sf_dir, "documents").select("doc_id", "text").where(id_crc() % 5 != 0)
    return toxicity.train(learn, labels)


@query("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs.withColumn("held_out", id_crc() % 5 == 0),
                            toxicity_model(spark, sf_dir), ["doc_id", "held_out"])
    return scored.select(F.col("k0").alias("doc_id"), F.col("k1").alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op10_token_orc")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "token-orc")
    token_orc.write_tokens(table(spark, sf_dir, "documents"), path, vocabulary(),
                           added_tokens=True)
    return token_orc.token_digests(spark, path)


@query("op13_warc_salvage", """
with base as (
  select page_id, cast(strlen(coalesce(html, '')) as bigint) as payload_bytes,
         sha256(coalesce(html, '')) as payload_digest
  from pages),
least as (
  select *, min(page_id) over (partition by payload_digest) as first from base),
judged as (
  select *, payload_bytes >= 100 and first is not null and page_id is distinct from first as again
  from least)
select page_id, payload_bytes, payload_digest,
       case when again then 'revisit' else 'response' end as record_type,
       case when again then first end as refers_to
from judged
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "warc")
    warc_salvage.write_archives(table(spark, sf_dir, "pages"), path)
    found = warc_salvage.read_archives(spark, path).where("kind = 'record'")
    stated = F.substring_index("payload_digest", ":", -1)
    return found.select(
        F.col("record_id").cast("long").alias("page_id"), "payload_bytes",
        F.when(F.col("record_type") == "revisit", stated).otherwise(F.sha2("payload", 256))
        .alias("payload_digest"),
        "record_type", F.col("refers_to").cast("long").alias("refers_to"))


@query("op11_collocations", r"""
with pieces as (
  select coalesce(lang, 'und') as lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                                'abcdefghijklmnopqrstuvwxyz'),
                                      '[.,;:!?\x0A-\x0D]')) as piece
  from documents),
sequences as (
  select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
grams as (
  select lang, unnest(list_transform(range(1, len(w) - n + 2), lambda i: w[i:i + n - 1])) as g
  from sequences, (select unnest([1, 2, 3, 4]) as n) where len(w) >= n),
counts as materialized (
  select lang, array_to_string(g, ' ') as phrase, any_value(g) as g, len(any_value(g)) as size,
         count(*) as f
  from grams group by lang, phrase),
totals as (select lang, cast(sum(f) as bigint) as n from counts where size = 1 group by lang),
named as materialized (select lang || ' ' || phrase as name, f from counts where f >= 30),
candidates as materialized (select * from counts where size >= 2 and f >= 30),
parts as (
  select lang || ' ' || array_to_string(g[i:i + k - 1], ' ') as name, f
  from candidates, (select unnest([2, 3]) as k), (select unnest([1, 2, 3]) as i)
  where k < size and i + k - 1 <= size),
inside as materialized (select name, max(f) as most from parts group by name),
ways as materialized (
  select *, lang || ' ' || array_to_string(g[1:k], ' ') as head,
         lang || ' ' || array_to_string(g[k + 1:], ' ') as tail
  from candidates, (select unnest([1, 2, 3]) as k) where k < size),
headed as materialized (
  select ways.*, named.f as l from ways join named on named.name = ways.head),
cuts as (
  select headed.*, headed.f as a, named.f as r,
         (cast(2000000 as hugeint) * headed.f) // (l + named.f) as score
  from headed join named on named.name = headed.tail),
lowest as (
  select *, row_number() over (partition by lang, phrase order by score, k) as place from cuts),
kept as (
  select lowest.* from lowest left join inside on inside.name = lang || ' ' || phrase
  where place = 1 and (inside.most is null or 100 * inside.most < 80 * a)),
ranked as (
  select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select ranked.lang, rank, phrase, a, l, r, n, cast(score as bigint) as score
from ranked join totals using (lang) where rank <= 2000
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query("op12_qdwh_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    model = whitening.fit(rows)
    error = whitening.identity_error(rows, model)
    return whitening.whiten(rows, model, ["vec_id"]).select(
        F.col("k0").alias("vec_id"), "component", "n", "deviation", "whitened", "explained",
        F.lit(error).alias("identity_error"))
