"""Words and word hashes of many texts at once, as numpy arrays over Arrow's text buffers."""

from __future__ import annotations

import ctypes
import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text whose words are hashed at once; the arrays take some 50 times as much.
PIECE = 1 << 18

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each bit of the input moves half of the output's."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, up to n."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), 1 << 20)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and where each begins; null texts are empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    begins = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[begins[0] : begins[-1]], begins - begins[0]


class Words:
    """Of a slice of texts: data (lower case for A-Z), begin, end and hash of each word, first (word number at which each text begins)."""

    def __init__(self, column: pa.Array | None, raw: np.ndarray | None = None):
        """Of a column of texts, or of the bytes of one."""
        raw, self.texts = buffers(column) if raw is None else (raw, np.array([0, len(raw)]))
        self.raw, self.data = raw, LOWER[raw]
        word = ~_SPACE[raw]
        edge = np.empty(len(raw) + 1, bool)
        edge[0], edge[-1] = len(raw) and word[0], False
        np.logical_and(word[1:], ~word[:-1], out=edge[1:-1]) if len(raw) > 1 else None
        cuts = self.texts[:-1][np.diff(self.texts) > 0]
        edge[cuts] |= word[cuts] if len(raw) else False
        self.begin = np.flatnonzero(edge)
        stop = np.empty(len(raw) + 1, bool)
        stop[0] = False
        stop[1:] = word
        if len(raw):
            stop[1:-1] &= ~word[1:]
            stop[cuts[cuts > 0]] = word[cuts[cuts > 0] - 1]
        self.end = np.flatnonzero(stop)
        up, down = _power(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * up[: len(raw)], out=sums[1:])
        self.hash = mixed((sums[self.end] - sums[self.begin]) * down[self.begin] + (self.end - self.begin).astype(np.uint64))
        self.first = np.searchsorted(self.begin, self.texts)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of that many words, and where each text's begin; a shorter text with words is one window."""
        n = np.diff(self.first)
        if len(self.hash) < size:
            whole = np.zeros(0, np.uint64)
        else:
            whole = np.zeros(len(self.hash) - size + 1, np.uint64)
            for k in range(size):
                whole = (whole ^ self.hash[k : k + len(whole)]) * np.uint64(0x9FB21C651E98DF25)
                whole ^= whole >> np.uint64(29)
        counts = np.where(n >= size, n - size + 1, np.minimum(n, 1))
        at = np.concatenate([[0], np.cumsum(counts)])
        out = np.empty(at[-1], np.uint64)
        place = np.arange(at[-1]) - np.repeat(at[:-1], counts) + np.repeat(self.first[:-1], counts)
        long = np.repeat(n >= size, counts)
        out[long] = whole[place[long]]
        for t in np.flatnonzero((n > 0) & (n < size)):
            h = np.uint64(n[t])
            for x in self.hash[self.first[t] : self.first[t + 1]]:
                h = mixed(np.array([h ^ x], np.uint64))[0] + np.uint64(1)
            out[at[t]] = h
        return mixed(out), at


def lengths(column: pa.Array) -> list[int]:
    """Bytes of each text; null texts have none."""
    return pc.fill_null(pc.binary_length(column), 0).to_pylist()


def slices(sizes: list[int], most: int = 4_000_000):
    """Runs of rows of about that many bytes."""
    begin, run = 0, 0
    for i, n in enumerate(sizes):
        if run and run + n > most:
            yield begin, i
            begin, run = i, 0
        run += n
    if begin < len(sizes):
        yield begin, len(sizes)


def text_windows(column: pa.Array, size: int):
    """For each text the hashes of its windows of that many words. Long texts go through in pieces that overlap by all but one word of a window, so memory beside the hashes stays at some 50 times PIECE."""
    sizes = lengths(column)
    for a, b in slices(sizes, PIECE):
        if b - a == 1 and sizes[a] > 2 * PIECE:
            yield _pieced(buffers(column.slice(a, 1))[0], size)
            continue
        hashes, at = Words(column.slice(a, b - a)).windows(size)
        for t in range(b - a):
            yield hashes[at[t] : at[t + 1]]


def pieces(raw: np.ndarray):
    """Words of a long text, some PIECE bytes at a time, cut where a word ends."""
    begin = 0
    while begin < len(raw):
        end = _word_end(raw, min(begin + PIECE, len(raw)))
        yield Words(None, raw[begin:end])
        begin = end


def _word_end(raw: np.ndarray, at: int) -> int:
    """The next place from ``at`` on that is no part of a word."""
    while at < len(raw) and not _SPACE[raw[at]]:
        spaces = np.flatnonzero(_SPACE[raw[at : at + PIECE]])
        at = at + int(spaces[0]) if len(spaces) else min(at + PIECE, len(raw))
    return at


def _pieced(raw: np.ndarray, size: int) -> np.ndarray:
    found, begin, least = [], 0, PIECE
    while True:
        end = _word_end(raw, min(begin + least, len(raw)))
        words = Words(None, raw[begin:end])
        n = len(words.begin)
        if n < size and end < len(raw):
            least *= 2  # blanks or very long words
            continue
        if n >= size or not found:
            found.append(words.windows(size)[0])
        if end == len(raw):
            return np.concatenate(found)
        begin, least = (begin + int(words.begin[n - size + 1]) if size > 1 else end), PIECE


@functools.cache
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


def release() -> None:
    """Gives freed memory back, so that a worker that waits for its next task holds little."""
    pa.default_memory_pool().release_unused()
    if (libc := _libc()) is not None and hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def releasing(run):
    """A function over batches that gives freed memory back at the end of its partition."""

    @functools.wraps(run)
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return whole
