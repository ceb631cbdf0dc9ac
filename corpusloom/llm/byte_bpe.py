"""Byte-level BPE by a hierarchical-bitmap rank queue (operator 9).

The merges of one pre-token: every adjacent pair whose bytes have a rank stands in the bucket
of that rank; a bucket is a heap of positions in a doubly linked list of parts, so the leftmost
pair of a rank comes first. A bitmap of non-empty buckets, in two levels, gives the
least rank by find-first-set at each level. A merge relinks the list and queues its two new
pairs; entries whose pair has changed are skipped when they come up. A pre-token of n bytes
costs O(n log n), however long it is.

Texts are cut at white space first in the way the split pattern cuts them (a space belongs to
the word behind it), and the ids of each cut are kept in a bounded worker cache; what misses is
split by the pattern itself and merged by the queue.

Defined cases: a null text counts as empty (0 tokens); repeated rows give repeated results;
extra columns are ignored; strings of special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from heapq import heappop, heappush
from operator import itemgetter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import map_rows, text_of

CACHE_ROWS = 1_000_000
_PACK = [struct.Struct(f"<{n}I").pack for n in range(16)]
#: Unicode White_Space, as the split pattern's \s has it.
_SPACE = "\t-\r \x85\xa0  -     　"
_CUT = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_worker: dict = {}


WORD = 10  # bits of a place in a word
_MASK = (1 << WORD) - 1
_BIT = [1 << i for i in range(1 << WORD)]


class RankBitmap:
    """A set of ranks below ``size`` with its least member by find-first-set: words of 1024 ranks, and a word of those that aren't empty."""

    def __init__(self, size: int):
        self.words, self.top = [0] * ((size >> WORD) + 1), 0

    def add(self, rank: int) -> None:
        word = rank >> WORD
        if not self.words[word]:
            self.top |= 1 << word
        self.words[word] |= _BIT[rank & _MASK]

    def remove(self, rank: int) -> None:
        word = rank >> WORD
        self.words[word] ^= _BIT[rank & _MASK]
        if not self.words[word]:
            self.top ^= 1 << word

    def least(self) -> int:
        """The least rank of a set that is not empty."""
        word = (self.top & -self.top).bit_length() - 1
        ranks = self.words[word]
        return (word << WORD) + (ranks & -ranks).bit_length() - 1


class RankQueue:
    """Merges pre-tokens by a rank table; reused from one pre-token to the next."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bitmap = RankBitmap(max(ranks.values()) + 1)
        self.pairs = {(p[0] << 8) + p[1]: r for p, r in ranks.items() if len(p) == 2}

    def encode(self, piece: bytes) -> list[int]:
        ranks, n = self.ranks, len(piece)
        if piece in ranks:
            return [ranks[piece]]
        # The bitmap's steps stand here in line, as they run for every pair: a word of ranks, and a top word of words.
        find, words, top, bits = ranks.get, self.bitmap.words, 0, _BIT
        buckets: dict[int, int | list[int]] = {}  # a lone position, or a heap of them
        known = buckets.get
        end = list(range(1, n + 1))  # of the part that starts at a position; 0: no part starts there
        before = list(range(-1, n - 1))
        pair, first = self.pairs.get, piece[0] << 8
        for at in range(n - 1):
            byte = piece[at + 1]
            rank = pair(first + byte)
            first = byte << 8
            if rank is not None:
                bucket = known(rank)
                if bucket is None:
                    buckets[rank] = at
                    word = rank >> WORD
                    if not words[word]:
                        top |= 1 << word
                    words[word] |= bits[rank & _MASK]
                elif type(bucket) is int:
                    buckets[rank] = [bucket, at]
                else:
                    bucket.append(at)  # in order, so a heap
        while top:
            word = (top & -top).bit_length() - 1
            set_ = words[word]
            low = set_ & -set_
            rank = (word << WORD) + low.bit_length() - 1
            bucket = buckets[rank]
            if type(bucket) is int:
                at = bucket
                bucket = None
            else:
                at = heappop(bucket)
            if not bucket:
                del buckets[rank]
                words[word] = set_ = set_ ^ low
                if not set_:
                    top ^= 1 << word
            middle = end[at]
            if not middle or middle >= n:
                continue
            stop = end[middle]
            if find(piece[at:stop]) != rank:
                continue
            end[at], end[middle] = stop, 0
            fresh = []
            if stop < n:
                before[stop] = at
                rank = find(piece[at : end[stop]])
                if rank is not None:
                    fresh.append((rank, at))
            left = before[at]
            if left >= 0:
                rank = find(piece[left:stop])
                if rank is not None:
                    fresh.append((rank, left))
            for rank, at in fresh:
                bucket = known(rank)
                if bucket is None:
                    buckets[rank] = at
                    word = rank >> WORD
                    if not words[word]:
                        top |= 1 << word
                    words[word] |= bits[rank & _MASK]
                elif type(bucket) is int:
                    buckets[rank] = [bucket, at] if bucket < at else [at, bucket]
                else:
                    heappush(bucket, at)
        out, at = [], 0
        while at < n:
            stop = end[at]
            out.append(ranks[piece[at:stop]])
            at = stop
        return out


class Codec:
    """Encoder and decoder of a rank file under a split pattern."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.vocabulary = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.vocabulary[rank] = token
        self.split = regex.compile(pattern)
        self.queue = RankQueue(self.ranks)
        self.young: dict[str, bytes] = {}  # two generations: what is still used moves from the old one
        self.old: dict[str, bytes] = {}

    def _ids(self, cut: str) -> bytes:
        """Of a cut; its pre-tokens are kept too, as they stand in other cuts."""
        pieces = self.split.findall(cut)
        if len(pieces) == 1:
            return self._merged(cut)
        return b"".join(map(self._known, pieces))

    def _known(self, piece: str) -> bytes:
        ids = self.young.get(piece) or self.old.get(piece)
        if ids is None:
            ids = self.young[piece] = self._merged(piece)
        return ids

    def _merged(self, piece: str) -> bytes:
        ids = self.queue.encode(piece.encode())
        return _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        cuts = _CUT.findall(text)
        missing = set(cuts).difference(self.young)
        if missing:
            if len(self.young) > CACHE_ROWS:
                self.old, self.young = self.young, {}
                missing = set(cuts)
            old, young = self.old, self.young
            for cut in missing:
                young[cut] = old.get(cut) or self._ids(cut)
        return b"".join(map(self.young.__getitem__, cuts))

    def decode(self, ids: bytes) -> bytes:
        at = np.frombuffer(ids, "<u4").tolist()
        return b"".join(itemgetter(*at)(self.vocabulary)) if len(at) > 1 else b"".join(self.vocabulary[i] for i in at)


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec for these files."""
    if _worker.get("key") != (path, pattern):
        _worker.update(key=(path, pattern), codec=Codec(path, pattern))
    return _worker["codec"]


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids binary, decoded binary): ids little-endian uint32, and their decoded bytes."""
    return _run(docs, path, pattern, id_col, text_col, digest=False)


def encoding_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), one row per row of ``docs``."""
    return _run(docs, path, pattern, id_col, text_col, digest=True)


def _run(docs: DataFrame, path: str, pattern: str, id_col: str, text_col: str, digest: bool) -> DataFrame:
    def encode(batches):
        own = codec(path, pattern)
        for batch in batches:
            ids = [own.encode(t) for t in batch["text"].to_pylist()]
            texts = [own.decode(x) for x in ids]
            if digest:
                yield {
                    "doc_id": batch["doc_id"],
                    "n_tokens": [len(x) >> 2 for x in ids],
                    "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                    "decoded_sha256": [hashlib.sha256(x).hexdigest() for x in texts],
                }
            else:
                yield {"doc_id": batch["doc_id"], "ids": ids, "decoded": texts}

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    kinds = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "ids binary, decoded binary"
    return map_rows(rows, encode, f"doc_id long, {kinds}", batch_rows=500)
