"""Words of many texts at once, as arrays of 64-bit hashes (used inside pandas and Arrow tasks)."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from .common import LOWER, UPPER, mixed

ASCII_SPACE = re.compile(r"[\x20\x09-\x0D]+")
_LOWER = str.maketrans(UPPER, LOWER)
BASE = np.uint64(0x9E3779B97F4A7C15)
SPACE = np.isin(np.arange(256), [0x20, 9, 10, 11, 12, 13])
BYTES = mixed(np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint64), 7)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64, n of each at least."""
    if len(_powers[0]) < n:
        for k, x in enumerate((int(BASE), pow(int(BASE), -1, 1 << 64))):
            _powers[k] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, x, np.uint64)]))
    return _powers[0], _powers[1]


def hash_strings(words: list[str]) -> np.ndarray:
    """A fixed 64-bit hash of each string, the same on every machine."""
    if not words:
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(np.array(words, dtype=object), hash_key="tempora-tokens-0", categorize=False).astype(np.uint64)


def word_hashes(texts: list[str | None], clean=None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one after the other, and where each text begins (one more entry than texts).

    A-Z are lower-cased and words end at ASCII white space.  ``clean`` maps a distinct word to
    what is hashed in its place; words that it maps to "" go.
    """
    lowered = [("" if t is None else t).translate(_LOWER) if not (t or "").isascii() else (t or "").lower() for t in texts]
    lists = pc.split_pattern_regex(pa.array(lowered, pa.large_string()), r"[\x20\x09-\x0D]+")
    ends = lists.offsets.to_numpy()
    codes = pc.dictionary_encode(lists.flatten())
    words = codes.dictionary.to_pylist()
    if clean:
        words = [clean(w) for w in words]
    hashes = hash_strings(words)
    keep = np.array([w != "" for w in words], dtype=bool)
    index = codes.indices.to_numpy()
    used = keep[index] if len(index) else np.zeros(0, bool)
    starts = np.concatenate([[0], np.cumsum(used)])[ends - ends[0]]
    return hashes[index[used]] if len(index) else np.zeros(0, np.uint64), starts


def windows_hash(h: np.ndarray, offsets: tuple[int, ...]) -> np.ndarray:
    """A hash of the words at ``offsets`` behind every position that has room for them."""
    n = max(0, len(h) - max(offsets))
    out, h = np.zeros(n, np.uint64), mixed(h)
    for o in offsets:
        out = out * BASE + h[o : o + n]
    return mixed(out, len(offsets))


def inside(starts: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which ``span`` words lie inside one text, and the number of each such position's text."""
    n = np.maximum(0, np.diff(starts) - span + 1)
    text = np.repeat(np.arange(len(n)), n)
    first = np.concatenate([[0], np.cumsum(n)])[:-1]
    return np.arange(n.sum()) - first[text] + starts[:-1][text], text


def plain_word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """As ``word_hashes`` without ``clean``, from the bytes of the texts: a rolling hash over all of them, cut at white space."""
    coded = [(t or "").encode() for t in texts]
    data = np.frombuffer(b"\n".join(coded) + b"\n", np.uint8)
    space = SPACE[data]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    begin, end = edge[::2], edge[1::2]
    power, inverse = powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTES[data] * power[: len(data)], out=total[1:])
    h = mixed((total[end] - total[begin]) * inverse[begin] + (end - begin).astype(np.uint64))
    return h, np.searchsorted(begin, np.concatenate([[0], np.cumsum([len(c) + 1 for c in coded])]))


def shingle_lists(texts: list[str | None], size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """All word shingles of each text with repeats, and where each text begins.

    A text of fewer words has its whole sequence as its one shingle; one without words has none.
    """
    h, starts = plain_word_hashes(texts)
    n = np.diff(starts)
    count = np.where(n < size, np.minimum(n, 1), n - size + 1)
    first = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(first[-1]) - np.repeat(first[:-1] - starts[:-1], count)
    grams = np.zeros(len(at), np.uint64)
    long = np.repeat(n >= size, count)
    grams[long] = windows_hash(h, tuple(range(size)))[at[long]]
    for i in np.flatnonzero((n > 0) & (n < size)):
        grams[first[i]] = windows_hash(h[starts[i] : starts[i + 1]], tuple(range(n[i])))[0]
    return grams, first


def distinct(grams: np.ndarray) -> np.ndarray:
    """Sorted, each once."""
    s = np.sort(grams)
    keep = np.ones(len(s), bool)
    np.not_equal(s[1:], s[:-1], out=keep[1:])
    return s[keep]
