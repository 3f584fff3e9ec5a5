"""Documents whose shingle sets overlap: a blocked sparse product of document by n-gram incidence.

Only a document's leading n-grams enter the product: of n, the first n - ceil(t n) + 1 in an order
that all documents share; two sets of similarity t or more have one of these in common. Frequent
n-grams come last in that order, so the columns of the product stay thin. Columns thicker than a
block are cut into blocks, and a cell of the product joins two blocks. A cell passes a pair on only
if the sizes and the places of the shared n-gram leave room for the overlap that similarity t
needs; overlaps are accumulated per pair and bounded once more; the pairs left are counted exactly.

Copies share one node, the 64-bit hash of their set. Before the product, each column's documents are
held against the one that has its n-gram earliest. Pairs that these links already join need no comparison, so a group
of thousands of near copies costs stars, not all pairs; all other pairs are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficlens.llm.columns import named, shared_table, text_of, unique_name
from trafficlens.llm.components import components
from trafficlens.llm.word_arrays import shingle_sets, slices
from trafficlens.plans.sides import small_side

#: A n-gram seen so often is put last; at most MOST_FREQUENT of them, which bounds what is sent out.
OFTEN, MOST_FREQUENT = 16, 1 << 19
#: Nodes of a block of a thick column.
BLOCK = 256
_FLUSH = 1 << 21


def _signature(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little",
                          signed=True)


def _sketch(s: np.ndarray) -> np.ndarray | None:
    """How many n-grams fall into each of 256 parts of the hash range; none if a part overflows."""
    parts = np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=256)
    return parts.astype(np.int8) if parts.max() < 128 else None


def _repeated(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not sets:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    keys, counts = np.unique(np.concatenate(sets), return_counts=True)
    keep = counts > 1
    return keys[keep].view(np.int64), counts[keep]


def _profile(width: int):
    """Rows (row, doc_id, n, node, 0, sketch); (-, -, 0, n-gram, count, -) for those met again."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = []
        size = 0

        def counts():
            keys, found = _repeated(held)
            none = pa.nulls(len(keys), pa.int64())
            return pa.RecordBatch.from_arrays(
                [none, none, pa.array(np.zeros(len(keys), np.int64)), pa.array(keys),
                 pa.array(found, pa.int64()), pa.nulls(len(keys), pa.list_(pa.int8()))], names)

        names = ["row", "doc_id", "n", "key", "count", "sketch"]
        for batch in batches:
            for lo, texts in slices(batch.column(2)):
                sets = shingle_sets(texts, width)
                nodes = [_signature(s) for s in sets]
                part = batch.slice(lo, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(list(map(len, sets)), pa.int64()),
                     pa.array(nodes, pa.int64()), pa.array(np.zeros(len(sets), np.int64)),
                     pa.array([_sketch(s) for s in sets], pa.list_(pa.int8()))], names)
                for s, node in zip(sets, nodes):
                    if node not in seen:
                        seen.add(node)
                        held.append(s)
                        size += len(s)
                if size > _FLUSH:
                    yield counts()
                    held, size = [], 0
        yield counts()

    return run


def _leading(width: int, percent: int, frequent):
    """Rows (gram, node, n, place): the leading n-grams of the distinct sets of a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ranks = frequent.value
        seen: set[int] = set()
        for batch in batches:
            for _, texts in slices(batch.column(0)):
                grams, nodes, sizes, places = [], [], [], []
                for s in shingle_sets(texts, width):
                    n = len(s)
                    node = _signature(s)
                    if not n or node in seen:
                        continue
                    seen.add(node)
                    if len(keys):
                        at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
                        often = keys[at] == s
                        if often.any():
                            tail = s[often][np.argsort(ranks[at[often]])]
                            s = np.concatenate([s[~often], tail])
                    k = n + (-percent * n) // 100 + 1
                    grams.append(s[:k])
                    nodes.append(np.full(k, node))
                    sizes.append(np.full(k, n))
                    places.append(np.arange(k))
                if grams:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(grams).view(np.int64))]
                        + [pa.array(np.concatenate(x), pa.int64()) for x in (nodes, sizes, places)],
                        ["gram", "node", "n", "place"])

    return run


def _not_alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by n-gram, those whose n-gram a neighbouring row has too."""
    held: pa.RecordBatch | None = None  # the last row, until the next is known
    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        whole = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks(
        ).to_batches()[0]
        g = whole.column(0).to_numpy()
        same = g[1:] == g[:-1]
        prior = np.concatenate([[before is not None and g[0] == before], same])
        keep = prior[:-1] | same
        yield whole.slice(0, len(g) - 1).filter(pa.array(keep))
        held, before = whole.slice(len(g) - 1), g[-2] if len(g) > 1 else before
    if held is not None and before is not None and held.column(0)[0].as_py() == before:
        yield held


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in slices(batch.column(0)):
                sets = shingle_sets(texts, width)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_signature(s) for s in sets], pa.int64()),
                     pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                    ["node", "grams"])

    return run


def _room(percent: int) -> Column:
    """The sizes allow the similarity, and what is left from the shared place on allows the overlap."""
    na, nb = F.col("a.n"), F.col("b.n")
    left = F.least(na - F.col("a.place"), nb - F.col("b.place"))
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (
        (100 + percent) * left >= percent * (na + nb))


def _candidates(cells: DataFrame, percent: int) -> DataFrame:
    """Accumulate the overlap of each pair of a cell's output, and bound it by what can follow."""
    after = F.least(F.col("na") - 1 - F.col("pa"), F.col("nb") - 1 - F.col("pb"))
    return (
        cells.groupBy("a", "b", "na", "nb")
        .agg(F.count("*").alias("shared"), F.max("pa").alias("pa"), F.max("pb").alias("pb"))
        .where((100 + percent) * (F.col("shared") + after) >= percent * (F.col("na") + F.col("nb")))
        .select("a", "b", "na", "nb")
    )



def _pair() -> list[Column]:
    return [F.col("a.node").alias("a"), F.col("b.node").alias("b"), F.col("a.n").alias("na"),
            F.col("b.n").alias("nb"), F.col("a.place").alias("pa"), F.col("b.place").alias("pb")]


def _links(pairs: DataFrame, docs: DataFrame, places: DataFrame, width: int, percent: int
           ) -> DataFrame:
    """Those of the pairs whose whole sets are similar enough.

    No part of the hash range holds more common n-grams than the smaller of the two counts there,
    so the counts bound the overlap; only pairs within that bound need the sets themselves.
    """
    sketch = places.select("node", "sketch")
    most = F.aggregate(
        F.zip_with("sa", "sb", lambda x, y: F.least(x, y).cast("int")), F.lit(0), lambda s, x: s + x)
    need = percent * (F.col("na") + F.col("nb"))
    pairs = shared_table(
        pairs.join(sketch.select(F.col("node").alias("a"), F.col("sketch").alias("sa")), "a")
        .join(sketch.select(F.col("node").alias("b"), F.col("sketch").alias("sb")), "b")
        .where(F.col("sa").isNull() | F.col("sb").isNull() | ((100 + percent) * most >= need))
        .drop("sa", "sb"), "jaccard-bounded")
    involved = pairs.select(F.col("a").alias("node")).unionByName(
        pairs.select(F.col("b").alias("node"))).distinct()
    rows = shared_table(places.join(involved, "node").select("row"), "jaccard-rows")
    texts = docs.join(small_side(rows.distinct()), "row", "left_semi").select("text")
    sets = shared_table(
        texts.mapInArrow(_sets(width), "node long, grams array<long>")
        .groupBy("node").agg(F.first("grams").alias("grams")), "jaccard-sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("ga")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("grams").alias("gb")), "b")
    overlap = F.size(F.array_intersect("ga", "gb"))
    return both.where((100 + percent) * overlap >= need).select("a", "b")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      width: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: row, doc_id, n_shingles, component_id, stays.

    Two documents link when 100 * intersection >= percent * union of their shingle sets. Letters A-Z
    are lowered; a document of fewer than ``width`` words has its whole sequence as its one shingle.
    Null and wordless texts have no shingle, link with nothing and stay. ``component_id`` is the
    smallest id of the linked documents (null if none has one), ``row`` a hash of id and text that
    fully identical rows share, and ``stays`` is true on the row, or the identical rows, that stand
    for the component. Repeated ids are treated as documents of their own. An empty table gives an
    empty result.
    """
    text = text_of(text_col)
    own = docs.select(F.xxhash64(named(id_col).cast("string"), text).alias("row"),
                      named(id_col).cast("long").alias("doc_id"), text.alias("text"))
    profile = shared_table(
        own.mapInArrow(_profile(width), "row long, doc_id long, n long, key long, count long, "
                      "sketch array<tinyint>"),
        "jaccard-profile")
    meta = profile.where("count = 0").select(
        "row", "doc_id", "n", F.col("key").alias("node"), "sketch")
    often = (
        profile.where("count > 0").groupBy("key").agg(F.sum("count").alias("times"))
        .where(F.col("times") >= OFTEN).orderBy(F.desc("times"), "key").limit(MOST_FREQUENT)
    ).toPandas()
    keys = often["key"].to_numpy(np.int64).view(np.uint64)
    by_key = np.argsort(keys)
    # the most frequent has the last rank
    ranks = (len(keys) - np.arange(len(keys)))[by_key]
    frequent = docs.sparkSession.sparkContext.broadcast((keys[by_key], ranks))

    entries = own.select("text").mapInArrow(
        _leading(width, percent, frequent), "gram long, node long, n long, place long")
    columns = shared_table(
        entries.repartition("gram").sortWithinPartitions("gram")
        .mapInArrow(_not_alone, entries.schema)
        .groupBy("gram", "node").agg(F.first("n").alias("n"), F.first("place").alias("place")),
        "jaccard-columns")
    nodes = shared_table(
        meta.where("n > 0").groupBy("node").agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("top"),
            F.first("sketch").alias("sketch")),
        "jaccard-nodes")
    places = nodes.select("node", F.col("top.row").alias("row"), "sketch")

    # stars: each column's documents against the one that has the n-gram earliest, which has the
    # fewest rare n-grams and so is the likeliest to be close to all others
    centres = shared_table(
        columns.groupBy("gram").agg(
            F.count("*").alias("thick"),
            F.min(F.struct("place", "node", "n")).alias("c")).where("thick > 1")
        .select("gram", "thick", "c.*"), "jaccard-centres")
    stars = centres.alias("a").join(
        columns.alias("b"),
        (F.col("a.gram") == F.col("b.gram")) & (F.col("a.node") != F.col("b.node")) & _room(percent)
    ).select(*_pair())
    turned = F.col("a") > F.col("b")
    stars = stars.select(*[
        F.when(turned, F.col(y)).otherwise(F.col(x)).alias(x)
        for x, y in (("a", "b"), ("b", "a"), ("na", "nb"), ("nb", "na"), ("pa", "pb"), ("pb", "pa"))])
    tried = shared_table(_candidates(stars, percent), "jaccard-stars")
    first = shared_table(_links(tried, own, places, width, percent), "jaccard-links")
    labels = shared_table(components(first), "jaccard-labels")

    # the product: all pairs of a column that no link joins yet, block by block
    labelled = columns.join(labels, "node", "left").withColumn(
        "label", F.coalesce("label", "node"))
    labelled = shared_table(labelled, "jaccard-labelled")
    mixed_columns = shared_table(
        labelled.groupBy("gram").agg(F.count("*").alias("thick"), F.min("label").alias("least"),
                                     F.max("label").alias("most"))
        .where("least <> most").select("gram", F.ceil(F.col("thick") / BLOCK).alias("blocks")),
        "jaccard-mixed")
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    others = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    dealt = labelled.join(mixed_columns, "gram").withColumn("block", block).withColumn(
        "other", F.explode(others)).select(
        "gram", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        "block", "node", "n", "place", "label")
    a, b = dealt.alias("a"), dealt.alias("b")
    cell = ((F.col("a.gram") == F.col("b.gram")) & (F.col("a.i") == F.col("b.i"))
            & (F.col("a.j") == F.col("b.j")))
    across = (F.col("a.i") == F.col("a.j")) | (F.col("a.block") != F.col("b.block"))
    product = a.join(b, cell & across & (F.col("a.label") < F.col("b.label")) & _room(percent)
                     ).select(*_pair())
    rest = shared_table(_candidates(product, percent), "jaccard-pairs")
    links = first.unionByName(_links(rest, own, places, width, percent))
    final = shared_table(components(links), "jaccard-final")

    grouped = shared_table(
        nodes.join(final, "node", "left")
        .select("node", F.coalesce("label", "node").alias("label"), "top"), "jaccard-grouped")
    tops = shared_table(
        grouped.groupBy("label").agg(F.min("top").alias("best")), "jaccard-tops")
    of_node = shared_table(
        grouped.join(tops, "label").select("node", "best"), "jaccard-of-node")
    wordless = F.col("n") == 0
    return meta.join(of_node, "node", "left").select(
        "row", "doc_id", F.col("n").alias("n_shingles"),
        F.when(wordless, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("component_id"),
        (wordless | (F.col("row") == F.col("best.row"))).alias("stays"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, without those that another row stands for.

    Of fully identical rows one stays; rows without words all stay. See ``similar_documents``.
    """
    judged = shared_table(similar_documents(docs, id_col, text_col, width, percent), "jaccard-out")
    lost, twice = unique_name("gone"), unique_name("again")
    gone = judged.where(~F.col("stays")).select(F.col("row").alias(lost)).distinct()
    again = judged.where("stays and n_shingles > 0").groupBy("row").count().where("count > 1")
    key = F.xxhash64(named(id_col).cast("string"), text_of(text_col))
    kept = docs.join(small_side(gone), key == F.col(lost), "left_anti")
    if again.isEmpty():
        return kept
    again = small_side(again.select(F.col("row").alias(twice)))
    once = kept.join(again, key == F.col(twice), "left_semi").dropDuplicates([id_col, text_col])
    return kept.join(again, key == F.col(twice), "left_anti").unionByName(once)
