"""Benchmark passages in training texts, by spaced seeds.

A seed is a fixed mask laid on consecutive words: words under a gap of the mask do not count, so a
replaced word there leaves the hash as it is. The masks join two runs of three words, with 0 to 4
words skipped in between; hashes of runs are made once and paired. Where these masks could miss an
alignment that reaches the bar, as with short items, single runs of three words or less are the
seeds: as many as must lie between the replaced words. Hashes of the benchmark are joined with those
of the texts; every hit fixes an alignment, which is then compared word by word.
An alignment counts if ``span`` consecutive words around agree in ``percent`` of their places.
Everything is DataFrame expressions.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficlens.llm.columns import named, shared_table, text_of, unique_name
from trafficlens.plans.sides import small_side

RUN = 3
#: Words skipped between the two runs of a mask.
SKIPS = (0, 1, 2, 3, 4)
SPAN, PERCENT = 13, 80
#: Patterns of replaced words up to which it is tried out whether the masks hold them all.
PATTERNS = 10_000


def kinds_of(wide: int, percent: int) -> tuple[int, ...]:
    """Seeds of which every alignment holds one that agrees in ``percent`` of ``wide`` places.

    A kind is the skip of a mask, or -n for a run of n words.
    """
    need = max(1, -(-percent * wide // 100))
    lost = wide - need
    if lost < 0:
        return ()

    def held(gone: tuple[int, ...]) -> bool:
        run = [all(x not in gone for x in range(a, a + RUN)) for a in range(wide - RUN + 1)]
        return any(run[a] and run[a + RUN + skip] for skip in SKIPS
                   for a in range(len(run) - RUN - skip))

    if comb(wide, lost) <= PATTERNS and all(map(held, combinations(range(wide), lost))):
        return SKIPS
    return (-min(RUN, -(-need // (lost + 1))),)


def word_hashes(text: Column) -> Column:
    """Hashes of the words: runs of letters and digits, in lower case."""
    parts = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.transform(F.array_remove(parts, ""), lambda w: F.xxhash64(w))


def _paired(skip: int):
    return lambda a, b: F.xxhash64(a, b, F.lit(skip))


def _with_seeds(rows: DataFrame, kinds: list[int]) -> DataFrame:
    """Adds ``seeds``: an array per kind, whose i-th hash starts at word i."""
    def shifted(c: str, by: int, n: Column) -> Column:
        return F.slice(c, by + 1, F.greatest(n, F.lit(0)))

    n = F.size("words")
    two = F.zip_with(shifted("words", 0, n - 2), shifted("words", 1, n - 2),
                     lambda a, b: F.xxhash64(a, b))
    runs = rows.withColumn("two", two).withColumn(
        "runs", F.zip_with("two", shifted("words", 2, n - 2), lambda a, b: F.xxhash64(a, b)))
    pairs = F.zip_with(shifted("words", 0, n - 1), shifted("words", 1, n - 1),
                       lambda a, b: F.xxhash64(a, b, F.lit(-2)))
    lists = {-1: F.col("words"), -2: pairs, -RUN: F.col("runs")}
    for skip in SKIPS:
        gap = RUN + skip
        m = F.size("runs") - gap
        lists[skip] = F.zip_with(shifted("runs", 0, m), shifted("runs", gap, m), _paired(skip))
    seeds = F.array(*[lists[k] for k in kinds]) if kinds else F.array().cast("array<array<long>>")
    return runs.withColumn("seeds", seeds).drop("two", "runs")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
                 text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                 span: int = SPAN, percent: int = PERCENT) -> DataFrame:
    """One row per document and benchmark item found in it: doc_row, doc_id, item_id, matched_words,
    span_words.

    ``span_words`` is the span compared (the item's length if that is shorter), ``matched_words``
    the most places that agree in it. Every alignment that reaches the bar is found, for items of any
    length; items without a word and empty tables find nothing. ``doc_row`` is a hash of id and text. Fully identical
    documents give one row; several documents with the same or no id give one each.
    """
    items = benchmark.select(named(item_col).alias("item_id"),
                             word_hashes(text_of(item_text_col)).alias("words"))
    items = shared_table(items.where(F.size("words") > 0), "seed-items")
    wide = F.least(F.lit(span), F.size("words"))
    ways = {w: kinds_of(w, percent) for w, in items.select(wide).distinct().collect()}  # <= span rows
    kinds = sorted({k for own in ways.values() for k in own})
    asked = F.lit(False)
    for w, own in ways.items():
        asked = asked | ((F.col("wide") == w) & F.col("mask").isin([kinds.index(k) for k in own]))
    lists = _with_seeds(items, kinds).select(
        "item_id", wide.alias("wide"), F.posexplode("seeds").alias("mask", "list")).where(asked)
    # tables are written as their input is dealt: after a shuffle, a few rows would lie in a file per partition
    tests = shared_table(
        lists.select("item_id", F.posexplode("list").alias("at", "seed")), "seed-tests")
    text = text_of(text_col)
    own = docs.select(F.xxhash64(named(id_col).cast("string"), text).alias("doc_row"),
                      named(id_col).alias("doc_id"), text.alias("text"))
    wanted = small_side(tests.select("seed").distinct())

    hashed = _with_seeds(own.select("doc_row", word_hashes(F.col("text")).alias("words")), kinds)
    # outer: else Spark filters by the size of "seeds" first, and computes them once more for that
    places = hashed.select("doc_row", F.explode_outer("seeds").alias("list")).select(
        "doc_row", F.posexplode("list").alias("i", "seed"))
    hits = shared_table(places.join(wanted, "seed", "left_semi"), "seed-hits")
    alignments = hits.join(
        small_side(tests.select("seed", "item_id", "at").distinct()), "seed").select(
        "doc_row", "item_id", (F.col("i") - F.col("at")).alias("shift")).distinct()
    # only documents with a hit are compared
    hit = small_side(hits.select("doc_row").distinct())
    near = own.join(hit, "doc_row", "left_semi").dropDuplicates(["doc_row"]).select(
        "doc_row", "doc_id", word_hashes(F.col("text")).alias("words"))

    length = F.size("item_words")
    first = F.greatest(-F.col("shift"), F.lit(0))  # the item's first word that lies in the text
    both = F.least(length - first, F.size("words") - F.col("shift") - first)
    same = F.zip_with(
        F.slice("words", F.col("shift") + first + 1, both), F.slice("item_words", first + 1, both),
        lambda a, b: (a == b).cast("int"))
    wide = F.least(F.lit(span), length)
    starts = F.sequence(F.lit(0), F.greatest(F.size("same") - wide, F.lit(0)))
    best = F.array_max(F.transform(starts, lambda s: F.aggregate(
        F.slice("same", s + 1, wide), F.lit(0), lambda t, x: t + x)))
    compared = (
        alignments
        .join(near, "doc_row")
        .join(small_side(items.select("item_id", F.col("words").alias("item_words"))), "item_id")
        .withColumn("same", same)
        .select("doc_row", "doc_id", "item_id", best.alias("matched_words"), wide.alias("span_words"))
    )
    return compared.where(100 * F.col("matched_words") >= percent * F.col("span_words")).groupBy(
        "doc_row", "doc_id", "item_id").agg(
        F.max("matched_words").alias("matched_words"), F.max("span_words").alias("span_words"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, in which no benchmark item was found."""
    found = contaminated(docs, benchmark, id_col, text_col)
    row = unique_name("row")
    dirty = shared_table(found.select(F.col("doc_row").alias(row)).distinct(), "seed-dirty")
    key = F.xxhash64(named(id_col).cast("string"), text_of(text_col))
    return docs.join(small_side(dirty), key == F.col(row), "left_anti")
