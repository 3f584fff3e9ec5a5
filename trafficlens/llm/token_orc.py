"""Token ids in ORC files: integer run lengths, row indexes and Bloom filters on document ids.

Documents are range-partitioned and sorted by id, tokenised in Arrow batches and written as ORC: the
ids are an integer column, which ORC stores in run lengths; every stripe carries a row index and a
Bloom filter on ``doc_id``. A reader prunes stripes and row groups by that metadata, and splits a
file at stripes. Each range partition counts its tokens from 0; a small table of their totals,
made when reading, turns that into positions over all files.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trafficlens.llm.columns import bounded_batches, named, shared_table, text_of
from trafficlens.llm.word_arrays import buffer_of, piece_hash, running_hash, slices

#: Pieces of texts whose ids a task remembers at most, and ids of those pieces: some 16 MB.
CACHE, CACHED_IDS = 300_000, 1_200_000
#: Pieces that are given to the tokenizer as one text.
JOINED = 300
_MARK, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_MARK[list(b",.;:!?")] = True
_LETTER[list(range(65, 91)) + list(range(97, 123))] = True
SCHEMA = "doc_id long, local_start long, n_tokens long, ids array<int>"


def _exotic(raw: np.ndarray) -> np.ndarray:
    """Places where a white-space character beyond space and the controls 9 to 13 may lie."""
    at = np.flatnonzero((raw >= 0xC2) | ((raw >= 0x1C) & (raw <= 0x1F)))
    here, nxt = raw[at], np.append(raw, 0)[at + 1]
    return at[(here <= 0x1F) | ((here == 0xC2) & ((nxt == 0x85) | (nxt == 0xA0))) | (
        (here == 0xE1) & (nxt == 0x9A)) | ((here == 0xE2) & ((nxt == 0x80) | (nxt == 0x81))) | (
        (here == 0xE3) & (nxt == 0x80))]


@lru_cache(maxsize=1)
def _vocabulary(path: str, added_tokens: bool):
    """(tokenizer, its added tokens, characters of each id); a worker reads its vocabulary once."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = not added_tokens
    names = tok.get_vocab()
    width = np.zeros(max(names.values()) + 1, np.int64)  # one character stands for a byte
    for name, i in names.items():
        width[i] = len(name)
    return tok, [t.content for t in tok.get_added_tokens_decoder().values()], width


class _Encoder:
    """Ids of texts, by pieces whose ids are remembered.

    A pre-token of this vocabulary never reaches over a space that a visible character follows, nor
    from a letter into a punctuation mark, so texts are cut before such spaces and marks: a word is
    the same piece whatever mark follows it. Unknown pieces of many texts are encoded as one text and told
    apart by the lengths of the ids. A text with other white-space characters is one piece, and so is
    one that holds an added token of the vocabulary. Pieces are known by 64-bit hashes.
    """

    def __init__(self, vocabulary: str, added_tokens: bool):
        self.tok, self.added, self.width = _vocabulary(vocabulary, added_tokens)
        none = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.known, self.fresh = none, none  # hashes in order, and the numbers of their pieces
        self.start, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.ids = np.zeros(1 << 18, np.int32)
        self.pieces = self.used = 0

    def _lists(self, texts: list[bytes]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.tok.encode_batch_fast(
            [t.decode() for t in texts], add_special_tokens=False)]

    def _store(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        n, k = self.pieces, len(sizes)
        while len(self.ids) < self.used + len(flat):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self.start) < n + k:
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)])
                                     for x in (self.start, self.size))
        self.ids[self.used:self.used + len(flat)] = flat
        self.start[n:n + k] = self.used + np.cumsum(sizes) - sizes
        self.size[n:n + k] = sizes
        self.pieces += k
        self.used += len(flat)

    def _learn(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray, joined: np.ndarray
               ) -> np.ndarray:
        """Encode pieces; returns their numbers. Those that ``joined`` marks may stand together."""
        data = raw.tobytes()
        number = np.empty(len(start), np.int64)
        for together in (True, False):
            at = np.flatnonzero(joined == together)
            number[at] = self.pieces + np.arange(len(at))
            pieces = [data[i:j] for i, j in zip(start[at].tolist(), end[at].tolist())]
            if together:
                groups = [pieces[k:k + JOINED] for k in range(0, len(pieces), JOINED)]
                for group, flat in zip(groups, self._lists([b"".join(g) for g in groups])):
                    ends = np.cumsum([len(p) for p in group])
                    reached = np.cumsum(self.width[flat])
                    cut = np.searchsorted(reached, ends) + 1
                    if not (reached[cut - 1] == ends).all():
                        raise ValueError("an id of this vocabulary reaches over a space")
                    self._store(flat, np.diff(cut, prepend=0))
            elif pieces:
                lists = self._lists(pieces)
                self._store(np.concatenate(lists), np.array([len(x) for x in lists]))
        return number

    def _find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        for have, number in (self.known, self.fresh):
            if len(have):
                at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
                hit = have[at] == keys
                out[hit] = number[at[hit]]
        return out

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids per text), each text followed by ``end_id``."""
        raw, at = buffer_of(texts)
        size = len(raw)
        edge = np.zeros(size + 1, bool)
        edge[at] = True
        ink = (raw != 32) & ~((raw >= 9) & (raw <= 13))
        inside = np.zeros(size, bool)
        if size:
            inside[:-1] = (raw[:-1] == 32) & ink[1:] & ~edge[1:-1]
            inside[1:] |= _MARK.take(raw[1:]) & _LETTER.take(raw[:-1]) & ~edge[1:-1]
            odd = _exotic(raw)
            for r in np.unique(np.searchsorted(at, odd, side="right") - 1):
                inside[at[r]:at[r + 1]] = False
            for name in self.added:
                for r in np.flatnonzero(pc.match_substring(texts, name).to_numpy(False)):
                    inside[at[r]:at[r + 1]] = False
        start = np.flatnonzero(inside | edge[:-1])
        end = np.append(start[1:], size) if len(start) else start
        keys, first, which = np.unique(piece_hash(running_hash(raw), start, end),
                                       return_index=True, return_inverse=True)
        number = self._find(keys)
        new = number < 0
        before = self.pieces, self.used
        if new.any():
            s = start[first[new]]
            number[new] = self._learn(raw, s, end[first[new]], inside[s] & (raw[s] == 32))
        spot = number[which]
        begin, length = self.start[spot], self.size[spot]
        row = np.searchsorted(at, start, side="right") - 1
        sizes = np.bincount(row, length, len(texts)).astype(np.int64) + 1
        ends = np.cumsum(sizes)
        out = np.full(int(ends[-1]) if len(ends) else 0, end_id, np.int32)
        total = int(length.sum())
        within = np.arange(total) - np.repeat(np.cumsum(length) - length, length)
        source = np.repeat(begin, length) + within
        # an end id for every text before it shifts a piece's place
        out[np.arange(total) + np.repeat(row, length)] = self.ids[source]
        if self.pieces > CACHE or self.used > CACHED_IDS:
            self.pieces, self.used = before
        elif new.any():
            self._remember(keys[new], number[new])
        return out, sizes

    def _remember(self, keys: np.ndarray, number: np.ndarray) -> None:
        def merged(a, b):
            k = np.concatenate([a[0], b[0]])
            order = np.argsort(k, kind="stable")
            return k[order], np.concatenate([a[1], b[1]])[order]

        self.fresh = merged(self.fresh, (keys, number))
        if len(self.fresh[0]) > 1 << 16:
            self.known = merged(self.known, self.fresh)
            self.fresh = np.empty(0, np.uint64), np.empty(0, np.int64)


def _tokens(vocabulary: str, end_id: int, added_tokens: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, start = _Encoder(vocabulary, added_tokens), 0
        for batch in batches:
            for lo, texts in slices(batch.column(1)):
                ids, sizes = encoder.encode(texts, end_id)
                ends = np.cumsum(sizes)
                rows = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, len(texts)), pa.array(start + ends - sizes),
                     pa.array(sizes), rows], ["doc_id", "local_start", "n_tokens", "ids"])
                start += int(ends[-1])

    return run


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2,
                 id_col: str = "doc_id", text_col: str = "text",
                 stripe_mb: int = 16, files: int | None = None,
                 added_tokens: bool = False) -> None:
    """Write the token files of ``docs`` in ascending id order (null ids first).

    Null text is written as an empty document, which has the end id alone. Rows of the same id are
    kept side by side, also when one id fills many rows: ties are dealt by a row number. An empty
    table leaves a folder without rows. ``files`` fixes the number of files.
    With ``added_tokens`` a special token written in a text is that token, as in the library's own
    encoding of the vocabulary; without, it is text like any other.
    """
    rows = docs.select(named(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"),
                       F.monotonically_increasing_id().alias("tie"))
    keys = ("doc_id", "tie")
    dealt = rows.repartitionByRange(files, *keys) if files else rows.repartitionByRange(*keys)
    ids = dealt.sortWithinPartitions(*keys).select("doc_id", "text").mapInArrow(
        _tokens(vocabulary, end_id, added_tokens), SCHEMA)
    with bounded_batches(docs.sparkSession):
        (
            ids.write.mode("errorifexists")
            .option("orc.stripe.size", stripe_mb << 20)
            .option("orc.row.index.stride", 1000)
            .option("orc.bloom.filter.columns", "doc_id")
            .option("orc.bloom.filter.fpp", 0.01)
            .orc(path)
        )


def _files(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all files, with the number of the range partition that wrote each of them."""
    part = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).cast("long")
    return spark.read.schema(SCHEMA).orc(path).withColumn("part", part)


def file_starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, part_start): one row per range partition, from the files' own counts.

    A partition may have been written as several files, over which its own positions run on.
    """
    totals = _files(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    upto = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("tokens").over(upto), F.lit(0)).alias("part_start"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids of all documents; a filter on doc_id prunes stripes."""
    starts = shared_table(file_starts(spark, path), "token-files")
    from trafficlens.plans.sides import small_side

    return _files(spark, path).join(small_side(starts), "part").select(
        "doc_id", (F.col("part_start") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column(3)
        flat = ids.flatten().to_numpy(zero_copy_only=False).astype("<i4", copy=False)
        at = ids.offsets.to_numpy() - ids.offsets[0].as_py()
        crc = [zlib.crc32(flat[i:j]) for i, j in zip(at[:-1], at[1:])]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), b.column(2), pa.array(crc, pa.int64())],
            ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document, read back from the files: doc_id, start, n_tokens, ids_crc32.

    The digests are written to a table at once, so that the ids come to Python in bounded batches.
    """
    with bounded_batches(spark):
        return shared_table(read_tokens(spark, path).mapInArrow(
            _crc, "doc_id long, start long, n_tokens long, ids_crc32 long"), "token-digests")
