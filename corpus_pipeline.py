"""A training corpus in five stages: rejected, deduplicated, decontaminated, mixed, written as ids.

Each stage takes all that the one before kept and returns the columns of documents; the last writes
the token files and returns what they hold: doc_id, start, n_tokens, ids_crc32.

What a stage returns is not run yet, so the first one bounds the batches that Python gets for the
session that runs the job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficlens.llm import jaccard_join, mixing, spaced_seeds, token_orc, toxicity
from trafficlens.llm.columns import bound_batches, id_crc, named, shared_table
from trafficlens.llm.queries import table, vocabulary
from trafficlens.plans.scratch import scratch_dir


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose toxicity is 0.5 or more; learned from labels outside the fold."""
    bound_batches(spark)
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    learn = docs.select("doc_id", "text").where(id_crc() % 5 != 0)
    model = toxicity.train(learn, labels)
    scored = toxicity.score(docs, model, docs.columns).where(F.col("score") < 0.5)
    return scored.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(docs.columns)])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group linked by shingle overlap."""
    return jaccard_join.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark passage."""
    return spaced_seeds.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources weighed 5, 2, 1 in turn; a document comes as often as the mix takes it, up to 3 times."""
    mixed = mixing.mix_sources(docs, keep=docs.columns).where(F.col("copies") > 0)
    own = [F.col(f"keep_{i}").alias(c) for i, c in enumerate(docs.columns)]
    times = F.sequence(F.lit(1).cast("long"), F.col("copies"))
    return mixed.withColumn("__copy", F.explode(times)).select(*own)


def write_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the documents, and their digests read back."""
    path = scratch_dir(spark, "corpus-ids")
    token_orc.write_tokens(docs.select(named("doc_id"), named("text")), path, vocabulary(),
                           added_tokens=True)
    return token_orc.token_digests(spark, path)


STAGES = [
    ("toxicity", reject_toxic),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix),
    ("token-ID output", write_ids),
]

#: The first stage is a trained model, which SQL does not express; tests hold stages against loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = shared_table(docs, "corpus-stage")
    return docs
