"""Toxicity by a bag of subword vectors and a linear softmax.

A word is its own vector and those of its character n-grams, averaged; a text is the average of its
words, each weighing the root of its count; a softmax over the text's vector gives the class. Vectors and softmax are trained jointly in
numpy on a bounded sample of labelled rows. Misspelt words share most n-grams with the words they
come from. In scoring only the difference of the two class scores counts, which is linear in the
vectors, so the model is sent out as one number per n-gram bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens.llm.columns import named, shared_table, text_of
from trafficlens.llm.subword import word_features
from trafficlens.llm.word_arrays import slices

LENGTHS, EDGES = (3, 4, 5, 6), (3, 4)
#: Bytes of text whose features are held at once.
PIECE = 1 << 18
BUCKETS, WIDTH = 1 << 18, 8
#: Words of no meaning that every text is averaged with, so that a few words are not judged rashly.
BLANKS = 60.0
#: Rows with label 0 and with label 1 that are learned from at most.
SAMPLE = (3500, 1500)
#: n-grams of fewer texts of the sample have no vector of their own; they share these buckets.
LEAST, SHARED = 5, 1 << 10


@dataclass(frozen=True)
class Model:
    """``values``: per bucket what its n-gram adds to the log odds; ``bias``: log odds of no words."""

    values: np.ndarray
    bias: float


def _texts_with(texts: list[str]) -> np.ndarray:
    """In how many texts each bucket occurs."""
    seen = np.zeros(BUCKETS, np.int32)
    for _, piece in slices(pa.array(texts, pa.large_string()), PIECE):
        for row, _, word, bucket in word_features(piece, LENGTHS, EDGES, BUCKETS, True):
            seen += np.bincount(
                np.unique(row[word] * BUCKETS + bucket) % BUCKETS, minlength=BUCKETS
            ).astype(np.int32)
    return seen


def _homes(texts: list[str]) -> np.ndarray:
    """Per bucket the bucket whose vector its n-grams use, -1 where the sample has none of them."""
    seen = _texts_with(texts)
    own = np.arange(BUCKETS, dtype=np.int64)
    shared = BUCKETS + ((own * 0x9E3779B1) >> 7) % SHARED
    return np.where(seen >= LEAST, own, np.where(seen > 0, shared, -1))


def _bags(texts: list[str], homes: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Per text the buckets of its n-grams' vectors, and their shares of its average."""
    size = BUCKETS + SHARED
    buckets: list[list[np.ndarray]] = [[] for _ in texts]
    weights: list[list[np.ndarray]] = [[] for _ in texts]
    counts = np.zeros(len(texts))
    for lo, piece in slices(pa.array(texts, pa.large_string()), PIECE):
        for row, times, word, bucket in word_features(piece, LENGTHS, EDGES, BUCKETS, True):
            each = np.sqrt(times) / np.bincount(word, minlength=len(row))
            counts += np.bincount(row + lo, np.sqrt(times), len(texts))
            key, at = np.unique(row[word] * size + homes[bucket], return_inverse=True)
            weight = np.bincount(at, each[word]).astype(np.float32)
            cut = np.searchsorted(key, np.arange(len(piece) + 1) * size)
            for k in np.unique(row):
                some = slice(cut[k], cut[k + 1])
                buckets[lo + k].append((key[some] % size).astype(np.int32))
                weights[lo + k].append(weight[some])
    out_b = [np.concatenate([np.empty(0, np.int32), *x]) for x in buckets]
    out_w = [np.concatenate([np.empty(0, np.float32), *x]) / np.float32(n + BLANKS)
             for x, n in zip(weights, counts)]
    return out_b, out_w


def fit(texts: list[str], toxic: np.ndarray, share: float, passes: int = 8, rate: float = 1.5,
        batch: int = 32, seed: int = 7) -> Model:
    """Train on texts in lower case; ``share`` is the share of toxic rows among all labelled ones."""
    rng = np.random.default_rng(seed)
    homes = _homes(texts)
    bags, weights = _bags(texts, homes)
    vectors = np.zeros((BUCKETS + SHARED, WIDTH))  # n-grams that were not learned from say nothing
    soft = rng.uniform(-1, 1, (WIDTH, 2))
    # the sample is even, the table is not: the bias starts at the sample's and is shifted at the end
    bias = np.zeros(2)
    squares = [np.full(BUCKETS + SHARED, 1e-8), np.full(soft.shape, 1e-8), np.full(2, 1e-8)]
    target = np.eye(2)[toxic.astype(int)]
    for _ in range(passes):
        for part in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // batch)):
            size = np.array([len(bags[k]) for k in part])
            bucket = np.concatenate([bags[k] for k in part])
            weight = np.concatenate([weights[k] for k in part])
            owner = np.repeat(np.arange(len(part)), size)
            used, at = np.unique(bucket, return_inverse=True)
            dense = vectors[used]
            hidden = np.stack([np.bincount(owner, weight * dense[at, d], len(part))
                               for d in range(WIDTH)], 1)
            logit = hidden @ soft + bias
            logit -= logit.max(1, keepdims=True)
            p = np.exp(logit)
            p /= p.sum(1, keepdims=True)
            g = (p - target[part]) / len(part)
            back = g @ soft.T
            slope = np.stack([np.bincount(at, weight * back[owner, d], len(used))
                              for d in range(WIDTH)], 1)
            squares[0][used] += (slope ** 2).mean(1)
            vectors[used] = dense - rate * slope / np.sqrt(squares[0][used])[:, None]
            for value, grad, sq in ((soft, hidden.T @ g, squares[1]), (bias, g.sum(0), squares[2])):
                sq += grad ** 2
                value -= 0.2 * rate * grad / np.sqrt(sq)
    mean = float(np.clip(toxic.mean(), 1e-6, 1 - 1e-6)) if len(toxic) else 0.5
    share = float(np.clip(share, 1e-6, 1 - 1e-6))
    shift = np.log(share / (1 - share)) - np.log(mean / (1 - mean))
    values = vectors @ (soft[:, 1] - soft[:, 0])
    return Model(np.where(homes >= 0, values[homes], 0.0).astype(np.float32),
                 float(bias[1] - bias[0] + shift))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", sample: tuple[int, int] = SAMPLE) -> Model:
    """Learn from the texts of ``docs`` that ``labels`` marks 0 or 1, joined by id.

    Rows with another or no label, or without an id, are left out. At most ``sample`` rows of label
    0 and 1 are used, those with the smallest hashes of their ids; they are chosen from ids alone, so
    no text is shuffled. Class shares are counted over all rows. Without any row of one class the
    model gives every text the same score, next to 0 or 1 (0.5 without any labelled row).
    """
    marked = labels.select(named(id_col).alias("id"), named(label_col).cast("int").alias("label"))
    rows = shared_table(
        docs.select(named(id_col).alias("id")).join(marked.where("label in (0, 1)"), "id"),
        "toxicity-labelled")
    counts = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    total = sum(counts.values())
    if len(counts) < 2:
        even = np.zeros(BUCKETS, np.float32)
        return Model(even, 0.0 if not total else 12.0 if 1 in counts else -12.0)
    texts, labels_ = [], []
    for label in (0, 1):
        chosen = shared_table(
            rows.where(F.col("label") == label).select("id").distinct()
            .orderBy(F.xxhash64("id"), "id").limit(sample[label]), "toxicity-sample")
        own = docs.select(named(id_col).alias("id"), F.lower(text_of(text_col)).alias("text"))
        some = own.join(F.broadcast(chosen), "id").orderBy(F.xxhash64("id"), "id", "text")
        got = [r.text for r in some.select("text").limit(sample[label]).collect()]
        texts += got
        labels_ += [label] * len(got)
    return fit(texts, np.array(labels_), counts[1] / total)


def _scorer(values: np.ndarray, bias: float, carried: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(carried)
            scores = np.empty(len(texts))
            for lo, piece in slices(texts, PIECE):
                total, words = np.zeros(len(piece)), np.zeros(len(piece))
                for row, times, word, bucket in word_features(piece, LENGTHS, EDGES, BUCKETS, True):
                    weight = np.sqrt(times)
                    n = np.bincount(word, minlength=len(row))
                    mean = np.bincount(word, values[bucket], len(row)) / n
                    total += np.bincount(row, weight * mean, len(piece))
                    words += np.bincount(row, weight, len(piece))
                odds = bias + total / (words + BLANKS)
                scores[lo:lo + len(piece)] = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:carried], pa.array(scores)],
                [*batch.schema.names[:carried], "score"])

    return run


def score(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The ``keep`` columns of every row, in place ``k0``, ``k1``, ..., and ``score`` (0 to 1).

    Null text counts as empty; a text without words has the bias alone as its score. A row's score
    depends on its text only, so repeated rows agree.
    """
    carried = docs.select(*[named(c).alias(f"k{i}") for i, c in enumerate(keep)],
                          F.lower(text_of(text_col)).alias("text"))
    kinds = carried.drop("text").schema.add("score", "double")
    return carried.mapInArrow(_scorer(model.values, model.bias, len(keep)), kinds)
