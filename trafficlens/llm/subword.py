"""Character n-grams of the words of a batch, as bucket numbers of a fixed table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from trafficlens.llm.word_arrays import (
    buffer_of,
    constants,
    letter_breaks,
    mixed,
    piece_hash,
    running_hash,
    windows,
)


def word_features(column: pa.Array, lengths: tuple[int, ...], edges: tuple[int, ...], buckets: int,
                  distinct: bool = False) -> Iterator[
        tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row and count of each word, word and bucket of each feature), window by window.

    Features of a word: the word itself, its n-grams of ``lengths`` bytes, and its first and last
    n bytes for n in ``edges`` (where the word is at least that long). Texts come in lower case;
    every byte that is an ASCII letter or beyond ASCII belongs to a word. With ``distinct``, a word
    comes once per row (and window, in a row longer than a window).
    """
    raw, at = buffer_of(column)
    salt = constants(64, 5)
    for lo, part, s, e in windows(raw, at, letter_breaks()):
        row = np.searchsorted(at, s + lo, side="right") - 1
        total = running_hash(part)
        if distinct:
            key = mixed(piece_hash(total, s, e) + row.astype(np.uint64) * salt[1])
            _, kept, times = np.unique(key, return_index=True, return_counts=True)
            order = np.argsort(kept)
            kept, times = kept[order], times[order]
            row, s, e = row[kept], s[kept], e[kept]
        else:
            times = np.ones(len(s), np.int64)
        size = e - s
        number = np.arange(len(s))
        words, found = [number], [piece_hash(total, s, e) * salt[0]]
        # the word of every byte, -1 between words
        mark = np.zeros(len(part) + 1, dtype=np.int32)
        mark[s] = 1
        owner = np.cumsum(mark[:-1], dtype=np.int32) - 1
        for n in lengths:
            # a piece lies in a word if it starts there and ends no later
            i = np.flatnonzero((owner[:len(part) - n + 1] >= 0)) if len(part) >= n else np.empty(
                0, np.int64)
            i = i[(i + n) <= e[owner[i]]]
            words.append(owner[i])
            found.append(piece_hash(total, i, i + n) * salt[n])
        for n in edges:
            k = np.flatnonzero(size >= n)
            words += [k, k]
            found += [piece_hash(total, s[k], s[k] + n) * salt[20 + n],
                      piece_hash(total, e[k] - n, e[k]) * salt[40 + n]]
        bucket = (np.concatenate(found) >> np.uint64(20)) % np.uint64(buckets)
        yield row, times, np.concatenate(words), bucket.astype(np.int64)
