"""Phrases whose words stick together, from sorted streams of n-gram counts.

*Counting* goes by length. Words are counted first; of longer n-grams only those are looked at whose
two shorter parts are frequent, which a bit table of fixed size tells (a bit set by chance costs
work and changes nothing). n-grams are known by 64-bit hashes and counted in numpy per task, then in
Spark. A task hands on what numpy has combined as it is, in small batches: Spark adds up only where
all rows of a key come together. Texts of frequent n-grams are fetched last. A count comes with the
least tag, a short hash, of the documents its n-gram lies in; only documents of that tag name it, which
another bit table tells, so an n-gram is named about once at any number of tasks.

*Estimation* lays the frequent n-grams of all lengths out as one stream in prefix order: every n-gram
comes right after its own beginnings, so one pass in step hands each the counts of its left parts. The
same in suffix order, words read backwards, gives the right parts. What an n-gram is an extension of
are its longest left and right part, so both passes also tell which shorter phrases it absorbs. The
passes are running maxima over slices of even size (``plans.slices``); no table of counts is
looked up by hash, and a word that begins a third of all phrases fills many slices.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trafficlens.llm.columns import named, shared_table, text_of
from trafficlens.llm.word_arrays import (
    buffer_of,
    constants,
    mixed,
    piece_hash,
    running_hash,
    slices,
    windows,
)
from trafficlens.plans.sides import small_side
from trafficlens.plans.slices import Running, running

#: Least occurrences of a candidate; most words; a longer phrase with this percentage absorbs.
LEAST, WORDS, ABSORBS = 30, 4, 80
TOP = 2000
#: The bit tables have 2**BITS bits (8 MB) at any size of the corpus.
BITS = 26
#: Bytes of text worked on at once, and n-grams held before they are handed to Spark.
PIECE, HELD = 2 << 20, 1 << 20
#: Rows of a batch that is handed to Spark; it lies in memory on both sides.
GIVEN = 1 << 16
#: Bits of a document's tag.
TAG = 15
UNKNOWN = "und"
ROWS_PER_SLICE = 20_000

_byte = np.arange(256)
SPLITS = np.isin(_byte, np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8))
BREAKS = SPLITS | (_byte == 32) | (_byte == 9)
LOWER = np.where((_byte >= 65) & (_byte <= 90), _byte + 32, _byte).astype(np.uint8)


class _Words:
    """The words of a batch: where they lie, which follow their predecessor, and their hashes."""

    def __init__(self, langs: pa.Array, texts: pa.Array):
        raw, at = buffer_of(texts)
        self.raw = np.append(LOWER[raw], np.uint8(32))
        start, end, h = [], [], []
        for lo, part, s, e in windows(raw, at, BREAKS):
            h.append(piece_hash(running_hash(LOWER[part]), s, e))
            start.append(s + lo)
            end.append(e + lo)
        none = [np.empty(0, np.int64)]
        self.start, self.end = np.concatenate(start or none), np.concatenate(end or none)
        self.h = np.concatenate(h) if h else np.empty(0, np.uint64)
        self.row = np.searchsorted(at, self.start, side="right") - 1
        split = np.flatnonzero(SPLITS[raw])
        self.joined = np.zeros(len(self.h), bool)  # same piece as the word before
        if len(self.h):
            between = np.searchsorted(split, self.start[1:]) > np.searchsorted(split, self.end[:-1])
            self.joined[1:] = ~between & (self.row[1:] == self.row[:-1])
        self.langs = langs
        codes = langs.dictionary_encode()
        names = np.array([_lang_hash(x) for x in codes.dictionary.to_pylist()], np.uint64)
        self.lang = names[codes.indices.to_numpy()][self.row] if len(names) else self.h
        self.tag = np.empty(0, np.uint16)  # of the word's document, the same wherever that is read
        if len(self.h):
            first = np.flatnonzero(np.concatenate([[True], self.row[1:] != self.row[:-1]]))
            tags = mixed(np.add.reduceat(self.h, first)) >> np.uint64(64 - TAG)
            self.tag = np.repeat(tags.astype(np.uint16), np.diff(np.append(first, len(self.h))))

    def keys(self, n: int) -> np.ndarray:
        """The hash of the n words from each word on, language included; some cross pieces."""
        m = max(0, len(self.h) - n + 1)
        out = self.lang[:m] + np.uint64(n)
        for j, factor in enumerate(constants(n, 4000 + n)):
            out += self.h[j:m + j] * factor
        return mixed(out)

    def whole(self, n: int) -> np.ndarray:
        """Whether the n words from each word on lie in one piece."""
        m = max(0, len(self.h) - n + 1)
        out = np.ones(m, bool)
        for j in range(1, n):
            out &= self.joined[j:m + j]
        return out

    def places(self, n: int, tables: dict[int, np.ndarray]) -> np.ndarray:
        """The words where an n-gram begins whose two shorter parts may both be frequent."""
        ok = self.whole(n)
        if n > 1 and len(ok):
            part = _frequent(tables[n - 1], self.keys(n - 1))
            ok &= part[:-1] & part[1:]
        return np.flatnonzero(ok)

    def phrases(self, first: np.ndarray, n: int) -> pa.Array:
        """The texts of the n words from each of ``first`` on, joined by single spaces."""
        gap = len(self.raw) - 1
        begin = np.full((len(first), 2 * n - 1), gap, np.int64)
        size = np.ones_like(begin)
        for j in range(n):
            begin[:, 2 * j] = self.start[first + j]
            size[:, 2 * j] = self.end[first + j] - self.start[first + j]
        begin, flat = begin.reshape(-1), size.reshape(-1)
        total = np.cumsum(flat)
        where = np.arange(int(total[-1]) if len(total) else 0) + np.repeat(begin - total + flat, flat)
        ends = np.concatenate([[0], np.cumsum(size.sum(axis=1))])
        return pa.LargeStringArray.from_buffers(
            len(first), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(self.raw[where])
        ).cast(pa.string())


def _lang_hash(lang: str) -> int:
    import hashlib

    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[_Words]:
    for batch in batches:
        for lo, texts in slices(batch.column(1), PIECE):
            yield _Words(batch.column(0).slice(lo, len(texts)), texts)


def _has(bits: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (bits[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) > 0


def _frequent(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return _has(bits, keys >> np.uint64(64 - BITS))


class _Counter:
    """Counts and least tags of 64-bit keys; what grows too long is handed on."""

    def __init__(self):
        self.parts, self.held = [], 0

    def add(self, keys: np.ndarray, tags: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        self.parts.append(self._summed(keys, None, tags))
        self.held += len(self.parts[-1][0])
        if self.held > HELD:
            full = self.merged()
            if len(full[0]) > HELD // 2:
                yield full
                full = tuple(x[:0] for x in full)
            self.parts, self.held = [full], len(full[0])

    def merged(self) -> tuple[np.ndarray, ...]:
        if not self.parts:
            return self._summed(np.empty(0, np.uint64), None, np.empty(0, np.uint16))
        return self._summed(*map(np.concatenate, zip(*self.parts)))

    @staticmethod
    def _summed(keys, counts, tags):
        order = np.argsort(keys)
        keys, tags = keys[order], tags[order]
        first = np.flatnonzero(np.concatenate([keys[:1] == keys[:1], keys[1:] != keys[:-1]]))
        if not len(first):
            return keys, np.empty(0, np.int64), tags
        many = (np.diff(np.append(first, len(keys))) if counts is None
                else np.add.reduceat(counts[order], first))
        return keys[first], many, np.minimum.reduceat(tags, first)


def _shares(rows: int) -> Iterator[slice]:
    return (slice(lo, lo + GIVEN) for lo in range(0, rows, GIVEN))


def _hashed(n: int, sent):
    """(lang, key, n, tag) of n-grams by key; of single words also counts of all words by language."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, tables = _Counter(), {k: t.value for k, t in sent.items()}

        def rows(key, count, tag, lang=None):
            for part in _shares(len(key)):
                few = key[part]
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(len(few), pa.string()) if lang is None else lang[part],
                     pa.array(few.view(np.int64)), pa.array(count[part], pa.int64()),
                     pa.array(tag[part].astype(np.int16))], ["lang", "key", "n", "tag"])

        for words in _batches(batches):
            if n == 1:
                row, many = np.unique(words.row, return_counts=True)
                total = pa.table([words.langs.take(pa.array(row)), pa.array(many)], ["lang", "n"]
                                 ).group_by("lang").aggregate([("n", "sum")])
                none = np.zeros(len(total), np.uint64)
                yield from rows(none, total["n_sum"].to_numpy(), none, total["lang"].combine_chunks())
            at = words.places(n, tables)
            for full in counter.add(words.keys(n)[at], words.tag[at]):
                yield from rows(*full)
        yield from rows(*counter.merged())

    return run


def _named(sent):
    """(lang, key, phrase) of the n-grams that lie in documents of the tag that names them.

    Some others are among them by chance. A task names one once, or again when it has named very many.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {n: t.value for n, t in sent.items()}
        known = {n: np.empty(0, np.uint64) for n in tables}
        for words in _batches(batches):
            for n, table in tables.items():
                keys, own = words.keys(n), words.whole(n)
                tag = words.tag[:len(keys)].astype(np.uint64) << np.uint64(BITS - TAG)
                for part in (keys >> np.uint64(64 - BITS), keys & np.uint64((1 << BITS) - 1)):
                    own &= _has(table, part ^ tag)
                at = np.flatnonzero(own)
                key, first = np.unique(keys[at], return_index=True)
                have = known[n]
                spot = np.minimum(np.searchsorted(have, key), max(len(have) - 1, 0))
                new = have[spot] != key if len(have) else np.ones(len(key), bool)
                key, first = key[new], at[first[new]]
                known[n] = np.sort(np.concatenate([have, key]) if len(have) < HELD else key)
                for part in _shares(len(key)):
                    yield pa.RecordBatch.from_arrays(
                        [words.langs.take(pa.array(words.row[first[part]])),
                         pa.array(key[part].view(np.int64)), words.phrases(first[part], n)],
                        ["lang", "key", "phrase"])

    return run


def _bits(frequent: DataFrame) -> np.ndarray:
    """The bit table of a column ``key``; at most 2**(BITS - 6) numbers come to the driver."""
    slot = F.shiftrightunsigned("key", 64 - BITS)
    got = frequent.select(F.shiftright(slot, 6).alias("word"), (slot % 64).cast("int").alias("bit")
                          ).groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))
    table = got.toArrow()
    out = np.zeros(1 << (BITS - 6), np.uint64)
    out[table.column(0).to_numpy()] = table.column(1).to_numpy().view(np.uint64)
    return out


def _counts_by_key(rows: DataFrame, n: int, sent) -> DataFrame:
    """(lang, key, n, tag) of all n-grams; the rows of a key meet before Spark adds them up.

    Adding up map-side as well would hold all of a task's n-grams once more and combine next to none.
    """
    found = rows.mapInArrow(_hashed(n, sent), "lang string, key long, n long, tag short")
    return found.repartition("lang", "key").groupBy("lang", "key").agg(
        F.sum("n").alias("n"), F.min("tag").alias("tag"))


def _names_by_key(rows: DataFrame, sent) -> DataFrame:
    """(lang, key, phrase) of the n-grams in the bit tables ``sent``, each once."""
    found = rows.mapInArrow(_named(sent), "lang string, key long, phrase string")
    return found.repartition("key").distinct()


def _cut(words: str, first: Column, length: Column) -> Column:
    return F.slice(F.col(words), first, length)


def frequent_ngrams(docs: DataFrame, text_col: str = "text", lang_col: str = "lang",
                    least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f) of all n-grams up to ``WORDS`` words with f >= ``least``; and (lang, n).

    f counts all occurrences within pieces of text, overlaps included; n counts all words. Null
    languages are ``und``, null texts are empty. ``least`` is 1 or more.
    """
    send = docs.sparkSession.sparkContext.broadcast
    rows = docs.select(F.coalesce(named(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"),
                       text_of(text_col).alias("text"))
    high, low = F.shiftrightunsigned("key", 64 - BITS), F.col("key").bitwiseAND((1 << BITS) - 1)
    tag = F.shiftleft(F.col("tag").cast("long"), BITS - TAG)
    counted, totals, frequent, naming = [], None, {}, {}
    for n in range(1, WORDS + 1):
        found = shared_table(_counts_by_key(rows, n, frequent).where(
            (F.col("n") >= least) | F.col("lang").isNotNull()), "counts-by-key")
        totals = totals or found.where("lang is not null").select("lang", "n")
        kept = found.where("lang is null")
        counted.append(kept.select("key", F.col("n").alias("f")))
        _free(frequent)
        frequent = {n: send(_bits(kept))} if n < WORDS else {}
        slots = kept.select(F.explode(F.array(high.bitwiseXOR(tag), low.bitwiseXOR(tag))).alias("slot"))
        naming[n] = send(_bits(slots.select(F.shiftleft("slot", 64 - BITS).alias("key"))))
    names = shared_table(_names_by_key(rows, naming), "ngrams")
    _free(naming)
    out = names.join(reduce(DataFrame.unionByName, counted), "key")
    return out.select("lang", "phrase", "f"), totals


def _free(sent) -> None:
    for table in sent.values():
        table.destroy()


def with_parts(ngrams: DataFrame, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """n-grams with ``l1 ... l3`` and ``r1 ... r3``: counts of their first and last 1 to 3 words.

    Two passes over sorted streams. The newest n-gram of k words at or before a row, in prefix
    order, is the row's own beginning, since every part of a frequent n-gram is frequent.
    """
    stream = ngrams.withColumn("words", F.split("phrase", " ")).withColumn("size", F.size("words"))
    for order, letter in (("words", "l"), ("back", "r")):
        stream = shared_table(stream.withColumn("back", F.reverse("words")), "counts")
        newest = [Running(f"{letter}{k}", "max",
                          F.when(F.col("size") == k, F.struct(order, "f"))) for k in range(1, WORDS)]
        stream = running(stream, "lang", [order], newest, rows_per_slice).withColumns(
            {t.name: F.col(f"{t.name}.f") for t in newest})
    return stream.drop("back")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", top: int = TOP,
                 least: int = LEAST, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase of 2 to ``WORDS`` words with a >= ``least`` occurrences is cut where
    ``2000000 * a / (l + r)``, rounded down, is lowest (ties: the earliest cut); l and r count the two
    parts. Phrases inside a longer one with ``ABSORBS`` percent of their count are left out. Ranks go
    by score and a, falling, then by phrase. Empty tables and texts without phrases give no rows;
    other columns are not looked at.
    """
    ngrams, totals = frequent_ngrams(docs, text_col, lang_col, least)
    placed = shared_table(with_parts(ngrams, rows_per_slice), "parts")
    long = placed.where("size > 2")
    part = lambda letter: F.coalesce(*[F.when(F.col("size") == k + 1, F.col(f"{letter}{k}"))
                                       for k in range(2, WORDS)])
    size = F.col("size")
    absorbs = lambda letter: F.col("f") * 100 >= part(letter) * ABSORBS
    absorbed = long.where(absorbs("l")).select("lang", _cut("words", F.lit(1), size - 1).alias("words"))
    absorbed = absorbed.unionByName(
        long.where(absorbs("r")).select("lang", _cut("words", F.lit(2), size - 1).alias("words")))
    left = placed.where("size > 1").join(
        absorbed.distinct().hint("merge"), ["lang", "words"], "left_anti")
    ways = []
    for k in range(1, WORDS):
        for n in range(k + 1, WORDS + 1):
            score = F.expr(f"(2000000BD * cast(f as decimal(20,0))) div "
                           f"(cast(l{k} as decimal(20,0)) + cast(r{n - k} as decimal(20,0)))")
            ways.append(F.when(size == n, F.struct(
                score.alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"),
                F.col(f"r{n - k}").alias("r"))))
    scored = left.withColumn("cut", F.array_min(F.array_compact(F.array(*ways)))).select(
        "lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score")
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # first among shares of a language, so that no task ranks all phrases of one
    share = F.pmod(F.xxhash64("phrase"), F.lit(32)).alias("share")
    near = scored.select("*", share).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*best))).where(
        F.col("rank") <= top)
    ranked = near.withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).where(
        F.col("rank") <= top)
    return ranked.join(small_side(totals), "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
