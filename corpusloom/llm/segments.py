"""Content-defined paragraphs: words, cuts and hashes of whole Arrow batches at once.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case. Every word has a value from itself and its
successor; a word whose value is the least of the ``REACH`` values on either side begins a
paragraph. What lies between two cuts of a passage is therefore the same wherever the passage
stands, whatever the lines, words or documents around it. Paragraphs are of ``LEAST`` words or more,
13 on average; stretches without a cut (a word repeated over and over) are divided evenly below
``MOST`` words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

REACH = 6
LEAST, MOST = 5, 40
SHINGLE = 5
#: Bytes that are worked on at once, whole documents together or a long one in parts.
BLOCK = 1 << 18

_RNG = np.random.default_rng(6)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE = _RNG.integers(0, 1 << 63, 256, np.uint64)[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ODD = _RNG.integers(0, 1 << 62, 128, np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _STEP)
    out[0] = 1
    return np.multiply.accumulate(out)


def _hash_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, byte after) of the words; none reaches over a bound."""
    solid = ~_SPACE[data]
    inside = solid[1:] & solid[:-1]
    edges = bounds[(bounds > 0) & (bounds < len(data))]
    inside[edges - 1] = False
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~inside
    last[:-1] &= ~inside
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(starts):
        return np.empty(0, np.uint64), starts, ends
    lengths = ends - starts
    at = np.cumsum(lengths) - lengths
    off = np.arange(lengths.sum()) - np.repeat(at, lengths)
    value = _BYTE[data[solid]] * _powers(int(lengths.max()))[off]
    return mix(np.add.reduceat(value, at) + lengths.astype(np.uint64)), starts, ends


class Words:
    """The words of some documents: ``hash``, ``start`` and ``end`` in code points, and ``count`` by document."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first = first
        hashes, starts, ends, at = [], [], [], 0
        while at < len(data):
            stop = _space_after(data, at + BLOCK) if len(data) > 2 * BLOCK else len(data)
            h, s, e = _hash_words(data[at:stop], offsets - at)
            hashes.append(h)
            starts.append(s + at)
            ends.append(e + at)
            at = stop
        self.hash = np.concatenate([np.empty(0, np.uint64), *hashes])
        start, end = np.concatenate([np.empty(0, np.int64), *starts]), np.concatenate([np.empty(0, np.int64), *ends])
        doc = np.searchsorted(offsets, start, "right") - 1
        self.count = np.bincount(doc, minlength=len(offsets) - 1)
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
        self.start, self.end = (points[x] - points[offsets[doc]] for x in (start, end))
        self.base = np.cumsum(self.count) - self.count


def _space_after(data: np.ndarray, at: int) -> int:
    while at < len(data):
        found = np.flatnonzero(_SPACE[data[at : at + BLOCK]])
        if len(found):
            return at + int(found[0])
        at += BLOCK
    return len(data)


def words(column: pa.Array) -> Iterator[Words]:
    """The words of a column of texts without nulls, some documents at a time."""
    if not len(column):
        return
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + BLOCK, "right")) - 1)
        yield Words(a, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        a = b


def cuts(value: np.ndarray, doc: np.ndarray, reach: int) -> np.ndarray:
    """Where the value is less than the ``reach`` values before it and not above those after it, in its document."""
    where = np.arange(len(value)) + reach * (doc + 1)
    padded = np.full(len(value) + reach * (int(doc[-1]) + 2) if len(doc) else 0, _MAX)
    padded[where] = value
    left = np.full(len(padded), _MAX)
    right = np.full(len(padded), _MAX)
    for j in range(1, reach + 1):
        np.minimum(left[j:], padded[:-j], out=left[j:])
        np.minimum(right[:-j], padded[j:], out=right[:-j])
    return ((padded < left) & (padded <= right))[where]


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """For every word the hash of it and its successors, ``size`` in all."""
    n = len(words)
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    value = padded[:n] * _ODD[64]
    for j in range(1, size):
        value = value + padded[j : j + n] * _ODD[64 + j]
    return mix(value)


class DocumentSets:
    """Sets of word shingles of whole documents; of a document of fewer words the set of its one sequence.

    ``docs``: the places in the column of the documents that have words.
    """

    def __init__(self, words: Words, size: int):
        have = words.count > 0
        self.docs = np.flatnonzero(have) + words.first
        count, self.base = words.count[have], words.base[have]
        self.value = shingle_hashes(words.hash, size)
        left = np.repeat(self.base + count, count) - np.arange(len(self.value))
        self.inside = left >= size
        for i in np.flatnonzero(count < size).tolist():
            a = self.base[i]
            self.inside[a] = True
            self.value[a] = shingle_hashes(words.hash[a : a + count[i]], size)[0]

    def band_keys(self, bands: int, rows: int) -> list[np.ndarray]:
        """Per document ``bands`` keys of ``rows`` minima each."""
        if not len(self.docs):
            return []
        keys = np.empty((len(self.docs), bands), np.uint64)
        odd = np.random.default_rng(11).integers(0, 1 << 62, (bands, rows, 2), np.uint64) * np.uint64(2) + np.uint64(1)
        for b in range(bands):
            key = np.uint64(b + 1)
            for r in range(rows):
                hashed = (self.value ^ odd[b, r, 0]) * odd[b, r, 1]
                hashed[~self.inside] = _MAX
                key = mix(key + np.minimum.reduceat(hashed, self.base) * _STEP)
            keys[:, b] = key
        return list(keys.view(np.int64))

    def sets(self) -> list[np.ndarray]:
        """Per document its distinct hashes."""
        stops = [*self.base[1:].tolist(), len(self.value)]
        return [np.unique(self.value[a:b][self.inside[a:b]]).view(np.int64) for a, b in zip(self.base.tolist(), stops, strict=True)]


class Paragraphs:
    """The paragraphs of the documents of ``least`` words or more.

    ``doc``: the document's place in the column; ``word``, ``size``: first word (in ``words``) and number of words;
    ``place``: number in the document; ``id``: hash of the words.
    """

    def __init__(self, words: Words, least: int):
        self.words = words
        count = np.where(words.count >= least, words.count, 0)
        use = np.repeat(count > 0, words.count)
        self.index = np.flatnonzero(use)
        self.hash = words.hash[use]
        n = len(self.hash)
        self.empty = n == 0
        if self.empty:
            return
        doc = np.repeat(np.flatnonzero(count), count[count > 0])
        rank = np.cumsum(count > 0)[doc] - 1
        at = np.arange(n) - (np.cumsum(count) - count)[doc]
        left = count[doc] - at
        value = mix(self.hash + np.concatenate([self.hash[1:], [0]]).astype(np.uint64) * _STEP)
        value[left == 1] = _MAX
        begins = cuts(value, rank, REACH) & (at >= LEAST) & (left >= LEAST) | (at == 0)
        word = np.flatnonzero(begins)
        size = np.diff(np.concatenate([word, [n]]))
        if size.max() > MOST:
            parts = -(-size // MOST)
            part = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            word = np.repeat(word, parts) + np.repeat(size, parts) * part // np.repeat(parts, parts)
            size = np.diff(np.concatenate([word, [n]]))
        self.word, self.size = word, size
        self.off = np.arange(n) - np.repeat(word, size)
        self.doc = doc[word] + words.first
        first = np.flatnonzero(np.concatenate([[True], self.doc[1:] != self.doc[:-1]]))
        self.place = np.arange(len(word)) - np.repeat(first, np.diff(np.concatenate([first, [len(word)]])))
        self.last = np.concatenate([self.doc[1:] != self.doc[:-1], [True]])
        self.id = mix(np.add.reduceat(mix(self.hash * _ODD[self.off]), word))

    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """First and last code point (exclusive) of each paragraph in its text."""
        return self.words.start[self.index[self.word]], self.words.end[self.index[self.word + self.size - 1]]

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """First word of each paragraph's document, and the word after its last."""
        first, stop = self.word[self.place == 0], (self.word + self.size)[self.last]
        document = np.cumsum(self.place == 0) - 1
        return first[document], stop[document]

    def shingles(self) -> tuple[np.ndarray, np.ndarray]:
        """(hash, whether it lies inside the paragraph of its first word) for every word."""
        return shingle_hashes(self.hash, SHINGLE), self.off + SHINGLE <= np.repeat(self.size, self.size)

    def band_keys(self, bands: int) -> np.ndarray:
        """Keys of one minimum each over the shingles: an array of (paragraphs, bands)."""
        value, inside = self.shingles()
        out = np.empty((len(self.word), bands), np.uint64)
        for b in range(bands):
            hashed = np.where(inside, (value ^ _ODD[96 + 2 * b]) * _ODD[97 + 2 * b], _MAX)
            out[:, b] = mix(np.minimum.reduceat(hashed, self.word) + _ODD[80 + b])
        return out


def growth(hashes: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Hashes of ever longer beginnings of rows of words, each row with its seed."""
    return mix(np.cumsum(mix(hashes * _ODD[: hashes.shape[1]]), axis=1) ^ seeds[:, None])
