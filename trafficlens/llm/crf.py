"""Languages of words in mixed text, by a linear-chain conditional random field.

A word's emission is the sum of the weights of its features: the word itself (lexicon), its first
and last bytes (affixes) and its byte n-grams. Transitions between the languages of neighbouring
words are learned with them, by gradients from forward-backward over a bounded sample of labelled
texts, some of which are spliced to show switches. A text's language is the one with the largest
share of its words' posteriors.

Forward-backward runs over blocks of words at once: blocks are reduced to small matrices, the blocks
of a text are chained, and the words inside all blocks are settled side by side. The longest text
therefore costs few steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficlens.llm.columns import named, shared_table, text_of
from trafficlens.llm.subword import word_features
from trafficlens.llm.word_arrays import slices

LENGTHS, EDGES = (2, 3, 4), (1, 2, 3)
BUCKETS = 1 << 17
#: Texts of each language that are learned from at most.
SAMPLE = 250
BLOCK = 32
#: Bytes of text whose features are held at once.
PIECE = 1 << 18
UNKNOWN = "und"


@dataclass(frozen=True)
class Crf:
    """``weights``: bucket by language; ``steps``: language by next language, both in log space."""

    langs: list[str]
    weights: np.ndarray
    steps: np.ndarray


def posteriors(emission: np.ndarray, row: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Per word the probabilities of the languages, given all words of its row.

    ``emission`` and ``steps`` are logs; ``row`` is in order.
    """
    words, k = emission.shape
    if not words:
        return emission
    e = np.exp(emission - emission.max(1, keepdims=True))
    t = np.exp(steps - steps.max())
    # blocks of a row, padded at its end
    rows, first, size = np.unique(row, return_index=True, return_counts=True)
    blocks = -(-size // BLOCK)
    start = np.cumsum(blocks) - blocks
    total = int(blocks.sum())
    within = np.arange(words) - np.repeat(first, size)
    spot = np.repeat(start * BLOCK, size) + within
    grid = np.ones((total * BLOCK, k))
    grid[spot] = e
    used = np.zeros(total * BLOCK, bool)
    used[spot] = True
    grid, used = grid.reshape(total, BLOCK, k), used.reshape(total, BLOCK)

    # what a block does to the vector before it (rows: language before, columns: after); no
    # transition leads to the first word of a row
    whole = np.broadcast_to(np.eye(k), (total, k, k)).copy()
    for j in range(BLOCK):
        nxt = (whole.reshape(-1, k) @ t).reshape(total, k, k)
        if j == 0:
            nxt[start] = np.eye(k)
        nxt *= grid[:, j, None, :]
        nxt /= nxt.max((1, 2), keepdims=True) + 1e-300
        whole = np.where(used[:, j, None, None], nxt, whole)

    # chain the blocks of each row; rows with many blocks come first and stay longest
    order = np.argsort(-blocks, kind="stable")
    left, right = np.ones((total, k)), np.ones((total, k))
    depth = int(blocks.max())
    alive = np.searchsorted(-blocks[order], -np.arange(depth), side="left")  # rows of more blocks
    for j in range(depth - 1):
        at = start[order[:alive[j + 1]]] + j
        v = np.einsum("bi,bij->bj", left[at], whole[at])
        left[at + 1] = v / v.max(1, keepdims=True)
    for j in range(depth - 2, -1, -1):
        at = start[order[:alive[j + 1]]] + j
        v = np.einsum("bij,bj->bi", whole[at + 1], right[at + 1])
        right[at] = v / v.max(1, keepdims=True)

    # settle the words inside the blocks
    ahead = np.empty_like(grid)
    v = left
    for j in range(BLOCK):
        v = v @ t
        if j == 0:
            v[start] = 1.0
        v *= grid[:, j]
        v /= v.max(1, keepdims=True) + 1e-300
        ahead[:, j] = v
    v = right
    for j in range(BLOCK - 1, -1, -1):
        ahead[:, j] *= v
        nxt = (v * grid[:, j]) @ t.T
        nxt /= nxt.max(1, keepdims=True) + 1e-300
        v = np.where(used[:, j, None], nxt, v)
    p = ahead.reshape(-1, k)[spot]
    return p / p.sum(1, keepdims=True)


def _features(texts: list[str]):
    """(row of each word, word of each feature, bucket of each feature) of all texts."""
    rows, words, buckets, n = [], [], [], 0
    for lo, piece in slices(pa.array(texts, pa.large_string()), PIECE):
        for row, _, word, bucket in word_features(piece, LENGTHS, EDGES, BUCKETS):
            rows.append(row + lo)
            words.append(word + n)
            buckets.append(bucket)
            n += len(row)
    if not rows:
        none = np.empty(0, np.int64)
        return none, none, none
    return tuple(map(np.concatenate, (rows, words, buckets)))


def _sums(which: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(which, values[:, d], n) for d in range(values.shape[1])], 1)


def fit(texts: list[str], labels: np.ndarray, langs: list[str], passes: int = 4, rate: float = 0.3,
        piece: int = 40, seed: int = 3) -> Crf:
    """Train on texts in lower case with the numbers of their languages.

    Texts are cut into pieces of ``piece`` words; a quarter of the training sequences join two
    pieces of different texts, so that switches are seen.
    """
    rng = np.random.default_rng(seed)
    k = len(langs)
    row, word, bucket = _features(texts)
    order = np.argsort(word, kind="stable")
    word, bucket = word[order], bucket[order]
    seen = np.bincount(bucket, minlength=BUCKETS)
    cut = np.searchsorted(word, np.arange(len(row) + 1))
    weights, squares = np.zeros((BUCKETS, k)), np.full((BUCKETS, k), 1e-6)
    steps, step_squares = np.zeros((k, k)), np.full((k, k), 1e-6)
    first = np.flatnonzero(np.diff(row, prepend=-1) != 0)
    size = np.diff(np.append(first, len(row)))
    pieces = [np.arange(f + i, min(f + i + piece, f + s)) for f, s in zip(first, size)
              for i in range(0, s, piece)]
    truth = labels[row] if len(row) else row
    for _ in range(passes):
        deal = rng.permutation(len(pieces))
        for part in np.array_split(deal, max(1, len(deal) // 256)):
            at = np.concatenate([pieces[i] for i in part])
            # a sequence is a piece, or two that follow each other
            seq = np.repeat(np.cumsum(rng.random(len(part)) > 0.25),
                            [len(pieces[i]) for i in part])
            n = cut[at + 1] - cut[at]
            feature = np.repeat(cut[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            owner = np.repeat(np.arange(len(at)), n)
            b = bucket[feature]
            ok = seen[b] >= 3  # rarer features would only be learned by heart
            b, owner = b[ok], owner[ok]
            emission = _sums(owner, weights[b], len(at))
            p = posteriors(emission, seq, steps)
            y = truth[at]
            g = p.copy()
            g[np.arange(len(at)), y] -= 1
            used, where = np.unique(b, return_inverse=True)
            slope = _sums(where, g[owner], len(used)) / len(part)
            squares[used] += slope ** 2
            weights[used] -= rate * slope / np.sqrt(squares[used])
            same = seq[1:] == seq[:-1]
            real = np.zeros((k, k))
            np.add.at(real, (y[:-1][same], y[1:][same]), 1)
            # pairs of neighbours in the model: forward and backward parts joined by a transition
            joint = _neighbours(emission, seq, steps, p)[same].sum(0)
            slope = (joint - real) / len(part)
            step_squares += slope ** 2
            steps -= rate * slope / np.sqrt(step_squares)
    return Crf(langs, weights.astype(np.float32), steps)


def _neighbours(emission: np.ndarray, seq: np.ndarray, steps: np.ndarray, p: np.ndarray
                ) -> np.ndarray:
    """P(language of a word, language of the next) for each pair of neighbours."""
    size = np.unique(seq, return_counts=True)[1]
    t = np.exp(steps)
    e = np.exp(emission - emission.max(1, keepdims=True))
    place = np.concatenate([np.arange(s) for s in size])
    ahead = np.empty_like(e)
    for j in range(int(size.max())):
        at = np.flatnonzero(place == j)
        ahead[at] = e[at] * (1.0 if j == 0 else ahead[at - 1] @ t)
        ahead[at] /= ahead[at].sum(1, keepdims=True)
    # P(i, j) = P(j) P(i | j), and i given j does not depend on what follows j
    given = ahead[:-1, :, None] * t[None]
    given /= given.sum(1, keepdims=True)
    return given * p[1:, None, :]


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang",
          sample: int = SAMPLE) -> Crf:
    """Learn from rows with a language; of each, the ``sample`` texts with the smallest hashes.

    Copies of a text count once.

    The languages are the distinct labels. Without any labelled row the model has none.
    """
    rows = labelled.select(F.lower(text_of(text_col)).alias("text"),
                           named(lang_col).alias("lang")).where("lang is not null")
    langs = sorted(r.lang for r in rows.select("lang").distinct().collect())
    rows = rows.withColumn("hash", F.xxhash64("text"))
    hashes = shared_table(rows.select("lang", "hash").distinct(), "crf-hashes")
    least = [(r.lang, r.hash) for lang in langs for r in hashes.where(
        F.col("lang") == lang).orderBy("hash").limit(sample).collect()]
    chosen = rows.join(F.broadcast(rows.sparkSession.createDataFrame(
        least, "lang string, hash long")), ["lang", "hash"]).distinct().collect()
    texts, labels = [], []
    for i, lang in enumerate(langs):
        got = sorted((r.hash, r.text) for r in chosen if r.lang == lang)[:sample]
        texts += [t for _, t in got]
        labels += [i] * len(got)
    if not langs:
        return Crf([], np.zeros((BUCKETS, 1), np.float32), np.zeros((1, 1)))
    return fit(texts, np.array(labels), langs)


def _tagger(langs: list[str], weights: np.ndarray, steps: np.ndarray, carried: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = weights.shape[1]
        for batch in batches:
            texts = batch.column(carried)
            shares = np.zeros((len(texts), k))
            for lo, piece in slices(texts, PIECE):
                for row, _, word, bucket in word_features(piece, LENGTHS, EDGES, BUCKETS):
                    p = posteriors(_sums(word, weights[bucket], len(row)), row, steps)
                    shares[lo:lo + len(piece)] += _sums(row, p, len(piece))
            total = shares.sum(1)
            best = shares.argmax(1)
            score = np.where(total > 0, shares.max(1) / np.maximum(total, 1e-300), 0.0)
            names = [langs[b] if t > 0 and langs else UNKNOWN for b, t in zip(best, total)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:carried], pa.array(names, pa.string()), pa.array(score)],
                [*batch.schema.names[:carried], "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Crf, keep: dict[str, Column], text_col: str = "text"
            ) -> DataFrame:
    """The ``keep`` columns, ``lang_pred`` and ``score``, the share of words in that language.

    A null text and one without a letter get ``und`` and score 0, as all texts do when the model
    knows no language. Only the text decides, so repeated rows agree.
    """
    text = text_of(text_col)
    lettered = F.when(text.rlike(r"\p{L}"), F.lower(text)).otherwise(F.lit(""))
    rows = docs.select(*[c.alias(n) for n, c in keep.items()], lettered.alias("__text"))
    kinds = rows.drop("__text").schema.add("lang_pred", "string").add("score", "double")
    return rows.mapInArrow(_tagger(model.langs, model.weights, model.steps, len(keep)), kinds)
