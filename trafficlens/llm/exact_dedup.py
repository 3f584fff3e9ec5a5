"""Exact duplicates: heavy digests are settled map-side, the others by an ordinary shuffle.

A digest that fills a large share of the rows would send all of them to one task. Misra-Gries
counters (``freqItems`` keeps at most ``1 / support`` of them and never misses a digest above that
share) name the candidates; an exact count, combined map-side, verifies them and finds the row that
stays. Those few winners are broadcast, and the rows of heavy digests never enter a shuffle. All
other digests are grouped in the usual way; the groups of two and more rows are joined back, where
both sides are plain exchanges that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficlens.llm.columns import SPACES, named, shared_table, text_of


def _best() -> Column:
    """Most code points, then smallest id (null ids last), then one of the identical rows."""
    return F.min(F.struct((-F.col("size")).alias("size"), F.col("id").isNull().alias("no_id"),
                          F.col("id").alias("id"), F.col("row").alias("row"))).alias("best")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     support: float = 0.001) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without white space. Null text counts as empty, and all empty
    texts are one group. Rows with a null id take part; a null id is chosen last. Of fully
    identical rows exactly one is kept. An empty table gives an empty result; other columns, of
    whatever name, are not looked at. ``support`` is the share of all rows from which a digest is
    settled by broadcast; it bounds the broadcast at ``1 / support`` rows and changes no result.
    """
    text = text_of(text_col)
    base = shared_table(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            named(id_col).alias("id"),
            F.length(text).cast("long").alias("size"),
            F.unhex(F.sha2(F.translate(text, SPACES, ""), 256)).alias("digest"),
        ),
        "digests",
    ).withColumn("short", F.xxhash64("digest"))
    n = base.count()
    counters = base.stat.freqItems(["short"], support)
    candidates = counters.select(F.explode(F.col(counters.columns[0])).alias("short"))
    heavy = shared_table(
        base.join(F.broadcast(candidates), "short", "left_semi")
        .groupBy("digest").agg(F.count("*").alias("members"), _best())
        .where(F.col("members") >= max(2.0, support * n)),
        "heavy-digests",
    )
    light_rows = base.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    groups = shared_table(
        light_rows.groupBy("digest").agg(F.count("*").alias("members"), _best())
        .where("members > 1"),
        "light-groups",
    )
    settled = base.join(F.broadcast(heavy), "digest").unionByName(
        light_rows.join(groups, "digest", "left"))
    alone = F.col("best").isNull()
    return settled.select(
        F.col("id").alias("doc_id"),
        F.when(alone, F.col("id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("members", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("best.row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
