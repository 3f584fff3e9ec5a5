"""Words of a batch of texts as numpy arrays: where they lie, and 64-bit hashes.

The hash of a word is a polynomial over random byte values modulo 2**64, taken from one running sum
over the bytes; no Python object is made per word. Everything is worked off in windows, so one very
long text needs no more memory at once than many short ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of a window.
WINDOW = 1 << 19
_POWER = 0x9E3779B97F4A7C15


class _Tables(dict):
    """Tables made once per process; tasks are sent an empty one."""

    def __reduce__(self):
        return _Tables, ()


_state = _Tables()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over the word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """n fixed odd random numbers."""
    k = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_POWER) + np.uint64(seed)
    return mixed(k) | np.uint64(1)


def _tables(n: int) -> dict[str, np.ndarray]:
    if not _state:
        byte = np.arange(256)
        _state["space"] = (byte == 32) | ((byte >= 9) & (byte <= 13))
        _state["lower"] = np.where((byte >= 65) & (byte <= 90), byte + 32, byte).astype(np.uint8)
        _state["value"] = constants(256, 11)
        _state["no letter"] = (byte < 128) & ~((byte >= 97) & (byte <= 122)) & ~(
            (byte >= 65) & (byte <= 90))
    if len(_state.get("power", ())) <= n:
        size = max(n, WINDOW) + 1
        for name, base in (("power", _POWER), ("inverse", pow(_POWER, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _state[name] = np.cumprod(steps, dtype=np.uint64)
    return _state


def letter_breaks() -> np.ndarray:
    """Byte values that part words of letters: all of ASCII but its letters."""
    return _tables(0)["no letter"]


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and the offsets of its rows."""
    wide = pa.types.is_large_string(column.type)
    kind = np.int64 if wide else np.int32
    n = len(column)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset:column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def windows(raw: np.ndarray, at: np.ndarray, breaks: np.ndarray
            ) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first byte, bytes, word starts, word ends) of windows that end where words do.

    ``breaks`` says which byte values part words; rows part them too.
    """
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[at] = True
    lo = 0
    while lo < len(raw):
        hi = min(lo + WINDOW, len(raw))
        while hi < len(raw):
            back = np.flatnonzero(breaks[raw[lo:hi]] | edge[lo + 1:hi + 1])
            if len(back):
                hi = lo + int(back[-1]) + 1
                break
            hi = min(hi + WINDOW, len(raw))
        part = raw[lo:hi]
        gap = breaks[part]
        first = ~gap
        last = first.copy()
        first[1:] &= gap[:-1] | edge[lo + 1:hi]
        last[:-1] &= gap[1:] | edge[lo + 1:hi]
        yield lo, part, np.flatnonzero(first), np.flatnonzero(last) + 1
        lo = hi


def running_hash(part: np.ndarray) -> np.ndarray:
    """Running sums from which ``piece_hash`` takes the hash of any piece of ``part``."""
    tables = _tables(len(part))
    total = np.zeros(len(part) + 1, dtype=np.uint64)
    np.cumsum(tables["value"][part] * tables["power"][:len(part)], out=total[1:])
    return total


def piece_hash(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the pieces from start to end, equal for equal bytes wherever they lie."""
    return mixed((total[end] - total[start]) * _tables(0)["inverse"][start])


def word_spans(raw: np.ndarray, at: np.ndarray, lower: bool = True
               ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end, hash) of every word, rows in order. Words end at white space and rows."""
    tables = _tables(0)
    starts, ends, hashes = [], [], []
    for lo, part, s, e in windows(raw, at, tables["space"]):
        total = running_hash(tables["lower"][part] if lower else part)
        hashes.append(piece_hash(total, s, e))
        starts.append(s + lo)
        ends.append(e + lo)
    if not starts:
        none = np.empty(0, np.int64)
        return none, none, none, np.empty(0, np.uint64)
    start = np.concatenate(starts)
    return (np.searchsorted(at, start, side="right") - 1, start, np.concatenate(ends),
            np.concatenate(hashes))


def slices(column: pa.Array, most: int = WINDOW) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) in pieces of about ``most`` bytes; a longer row is a piece of its own."""
    _, at = buffer_of(column)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, side="right")) - 1)
        yield lo, column.slice(lo, hi - lo)
        lo = hi


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """Per row the sorted distinct hashes of its ``width``-word shingles.

    A row of fewer words has one: its whole sequence. A row without words has none.
    """
    raw, at = buffer_of(column)
    row, _, _, h = word_spans(raw, at)
    n = len(column)
    count = np.bincount(row, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)])
    factor = constants(width, 77)
    whole = np.zeros(max(0, len(h) - width + 1), dtype=np.uint64)
    for j in range(width if len(whole) else 0):
        whole += h[j:len(whole) + j] * factor[j]
    whole = mixed(whole)
    out = []
    for r in range(n):
        lo, k = first[r], count[r]
        if k == 0:
            out.append(np.empty(0, np.uint64))
        elif k < width:
            short = (h[lo:lo + k] * constants(width, 1000 + int(k))[:k]).sum(dtype=np.uint64)
            out.append(mixed(np.array([short], dtype=np.uint64)))
        else:
            s = np.sort(whole[lo:lo + k - width + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
    return out
