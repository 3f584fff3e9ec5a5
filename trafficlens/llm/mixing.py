"""Mixing sources to target weights by hash thresholds.

Every document gets a fixed random key. A source's words are summed by leading key bits; the bucket
in which the running sum passes the source's budget is found, and only that bucket is cut by its
next bits, until one document is left at the border. What lies below the border is in. Documents
are never sorted; a histogram row is a sum made map-side, so a hot source costs no more than others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trafficlens.llm.columns import named, shared_table, text_of, word_count

#: Key bits that one histogram resolves, and the levels that two keys of 60 bits allow.
BITS, LEVELS = 12, 10
_KEY = 60


def source_targets(sizes: DataFrame, weights: Sequence[int], cap: int, share: float) -> DataFrame:
    """Targets for (source, source_size): weights repeat over the sources in code-point order.

    A source takes at most ``cap`` times its size; what it can't take goes to the others by weight.
    With sources in the order of cap / weight, the first i of which are full, the others' level is
    (budget - full caps) / (weights left), so one pass in that order finds the final level. One row
    per source, far below the number of documents, is windowed in one task.
    """
    everything = Window.partitionBy(F.lit(0))
    order = everything.orderBy(F.col("source").asc_nulls_last())
    listed = F.array(*[F.lit(int(w)) for w in weights])
    weighted = sizes.withColumn(
        "weight", F.element_at(listed, (F.row_number().over(order) - 1) % len(weights) + 1)
    ).withColumn("most", F.col("source_size") * cap)
    fill = everything.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    return (
        weighted
        .withColumn("full", F.coalesce(F.sum("most").over(before), zero))
        .withColumn("left_weight", F.sum("weight").over(everything)
                    - F.coalesce(F.sum("weight").over(before), zero))
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("level", (F.col("budget") - F.col("full")) / F.col("left_weight"))
        .withColumn("level", F.max("level").over(everything))
        .select("source", "source_size", "weight",
                F.least(F.col("most").cast("double"), F.col("weight") * F.col("level"))
                .alias("target"))
    )


def _borders(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Per source the key (k1, k2) of the document at the border and whether it is taken."""
    # a border: `low1`/`low2` the key bits found so far, `left` the budget left at their start
    open_ = shared_table(
        sources.select("source", F.lit(0).cast("long").alias("low1"),
                       F.lit(0).cast("long").alias("low2"), F.col("rest").alias("left")),
        "mix-borders")
    found = None
    for level in range(LEVELS):
        first = level < LEVELS // 2
        shift = _KEY - BITS * (level % (LEVELS // 2) + 1)
        key, low = ("k1", "low1") if first else ("k2", "low2")
        at = open_.select(F.col("source").alias("of"), "low1", "low2", "left")
        inside = F.col("source").eqNullSafe(F.col("of"))
        if not first:
            inside &= F.col("k1") == F.col("low1")
        above = F.shiftright(key, shift + BITS) == F.shiftright(low, shift + BITS)
        part = rows.join(_few(at), inside & above & (F.col("size") > 0))
        bucket = F.shiftright(key, shift).alias("bucket")
        sums = part.groupBy("of", "low1", "low2", "left", bucket).agg(
            F.sum("size").alias("words"), F.count("*").alias("n"))
        upto = Window.partitionBy("of").orderBy("bucket")
        cut = (
            sums.withColumn("upto", F.sum("words").over(upto))
            .where(F.col("upto") > F.col("left"))
            .groupBy("of").agg(F.min_by(F.struct("*"), "bucket").alias("b")).select("b.*")
            .select(F.col("of").alias("source"),
                    F.shiftleft("bucket", shift).alias("low1") if first else F.col("low1"),
                    F.lit(0).cast("long").alias("low2") if first
                    else F.shiftleft("bucket", shift).alias("low2"),
                    (F.col("left") - (F.col("upto") - F.col("words"))).alias("left"),
                    "words", "n")
        )
        cut = shared_table(cut, "mix-borders")
        # a bucket of one document is settled; a source without a cut takes everything
        one = cut.where("n = 1") if level < LEVELS - 1 else cut
        at_one = one.select(F.col("source").alias("of"), F.col("low1").alias("b1"),
                            F.col("low2").alias("b2"), "left", "words")
        match = F.col("source").eqNullSafe(F.col("of"))
        match &= F.shiftright("k1", shift if first else 0) == F.shiftright(
            "b1", shift if first else 0)
        if not first:
            match &= F.shiftright("k2", shift) == F.shiftright("b2", shift)
        hit = rows.join(_few(at_one), match & (F.col("size") > 0)).groupBy("of").agg(
            F.max("k1").alias("b1"), F.max("k2").alias("b2"),
            F.max((F.col("words") - F.col("left")) < F.col("left")).alias("taken"))
        found = hit if found is None else found.unionByName(hit)
        if level == LEVELS - 1 or cut.where("n > 1").isEmpty():
            break
        open_ = cut.where("n > 1").select("source", "low1", "low2", "left")
    return shared_table(found, "mix-found")


def _few(side: DataFrame) -> DataFrame:
    """A table of one row per source: broadcast when its size is checked to be small."""
    from trafficlens.plans.sides import small_side

    return small_side(side)


def mix_sources(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: int = 3,
                share: float = 1.0, id_col: str = "doc_id", text_col: str = "text",
                source_col: str = "source", keep: Sequence[str] = ()) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, copies, and the ``keep`` columns.

    Size is the number of words (null text: 0). A document is taken floor(target / source_size)
    times, and once more if its key lies below its source's border; the document at the border is
    in if that brings the source nearer to its target. The key comes from id and text, so reruns
    agree; of fully identical rows it does not matter which are taken. A null source is a source of
    its own, last in order. A source without words gets target 0, and no copies. An empty table
    gives an empty result. ``keep`` columns are carried as ``keep_0``, ``keep_1``, ...
    """
    text = text_of(text_col)
    seed = F.concat(F.coalesce(named(id_col).cast("string"), F.lit("")), F.lit(" "), text)
    rows = shared_table(
        docs.select(
            named(id_col).alias("doc_id"), named(source_col).alias("source"),
            word_count(text).alias("size"),
            F.conv(F.substring(F.md5(seed), 1, 15), 16, 10).cast("long").alias("k1"),
            F.xxhash64(F.monotonically_increasing_id()).bitwiseAND((1 << _KEY) - 1).alias("k2"),
            *[named(c).alias(f"keep_{i}") for i, c in enumerate(keep)],
        ),
        "mix-rows",
    )
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    sized = F.col("source_size") > 0
    sources = shared_table(
        source_targets(sizes, weights, cap, share)
        .withColumn("whole", F.when(sized, F.floor(F.col("target") / F.col("source_size")))
                    .otherwise(F.lit(0)).cast("long"))
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")),
        "mix-sources",
    )
    borders = _borders(rows.select("source", "size", "k1", "k2"), sources)
    plan = sources.join(_few(borders), F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    of = plan.select(F.col("source").alias("of"), "source_size", "target", "whole", "rest",
                     "b1", "b2", "taken")
    below = F.col("b1").isNull() | (F.col("k1") < F.col("b1")) | (
        (F.col("k1") == F.col("b1")) & (
            (F.col("k2") < F.col("b2")) | ((F.col("k2") == F.col("b2")) & F.col("taken"))))
    # a source whose rest is nothing has no border document, or none that is taken
    once_more = below & (F.col("rest") > 0)
    joined = rows.join(_few(of), F.col("source").eqNullSafe(F.col("of")))
    copies = (F.col("whole") + once_more.cast("long")).alias("copies")
    return joined.select("doc_id", "size", "source_size", "target", copies,
                         *[f"keep_{i}" for i in range(len(keep))]).withColumn(
        "taken", F.col("size") * F.col("copies"))


#: The same mix in SQL, where sorting is no concern: {docs} is a table with doc_id, text, source.
MIX_SQL = r"""
with rows_ as (
  select doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
         cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || ' ' || coalesce(text, '')), 1, 15)
              as bigint) as k1
  from {docs}),
sizes as (select source, cast(sum(size) as bigint) as source_size from rows_ group by source),
weighted as (
  select *, [5, 2, 1][cast((row_number() over (order by source nulls last) - 1) % 3 + 1 as int)] as weight,
         source_size * 3 as most from sizes),
filled as (
  select *, coalesce(sum(most) over before, 0) as full_,
         sum(weight) over () - coalesce(sum(weight) over before, 0) as left_weight,
         sum(source_size) over () as budget
  from weighted
  window before as (order by most / weight, source nulls last
                    rows between unbounded preceding and 1 preceding)),
levels as (select *, max((cast(budget as double) - full_) / left_weight) over () as level from filled),
targets as (
  select source, source_size, least(cast(most as double), weight * level) as target from levels),
parts as (
  select *, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as whole
  from targets),
summed as (
  select r.*, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size as rest,
         sum(r.size) over (partition by r.source order by r.k1) as upto
  from rows_ r join parts p on r.source is not distinct from p.source),
mixed as (
  select *, whole + case when rest > 0 and (upto <= rest or
      (upto - size <= rest and upto - rest < rest - (upto - size))) then 1 else 0 end as copies
  from summed)
"""
