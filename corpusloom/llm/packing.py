"""Best-fit packing of tokenised documents into sequences (operator 3).

Piece lengths are whole numbers up to the capacity, so a packing is determined by how many
pieces have each length. The driver gets that histogram (``capacity`` counts at most, whatever the
input), packs the counts, and returns a plan of runs: pieces of one length with these ranks go,
so many to a bin, to these bins at this offset. Executors then give each piece its rank within its
length and look its place up. The packing is the same as if all pieces had met in one
place.

Large-item matching: pieces above a third of the capacity stand at most two to a bin; from
the longest down, each opens a bin and is matched with the longest other large piece that
fits. Smaller pieces, from the longest down, go to the bin with the least gap that holds
them (best fit), and open new bins when none does. Pieces as long as the capacity are bins of
their own and need no plan.

Ranks are counted per (length, salt), with salts by a hash of the piece, and offset by prefix
sums of at most ``capacity`` x ``salts`` counts, so that a frequent length is not one group.

Defined cases: a null text counts as empty and is the single token id 0; only documents longer
than the capacity are cut; repeated rows (same doc_id and text) are packed once each; a null
doc_id is packed like any other; extra columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.llm.common import checkpointed, map_rows, text_of

CAPACITY = 2048
CACHE_ROWS = 250_000
SALT_ROWS = 2_000
#: Unicode White_Space, at which the tokenizer's words always end.
_SPACE = "\t-\r \x85\xa0  -     　"
_WORDS = re.compile(f"[^{_SPACE}]+")
#: Letters of Latin-1 alone, then marks: the split pattern cuts between them, and NFC and lower case act on each letter.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)")
#: The characters by which byte-level vocabularies write bytes: printable ones are themselves, the others follow 255 in order.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_CHARACTERS = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
_PACK = [struct.Struct(f"<{n}I").pack for n in range(16)]
_NOT_WHITE = re.compile("[\x1c-\x1f]")
_worker: dict = {}


def packed_ids(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else np.array(ids, "<u4").tobytes()


class WordEncoder:
    """Ids of texts by the library, word by word, with bounded caches of two generations."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.merge = self.tokenizer.model.tokenize
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [packed_ids(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _merged(self, part: str) -> bytes:
        """Of what the normaliser and the split pattern leave as it is: the library's merges alone."""
        if not part.isascii():
            part = part.encode().decode("latin-1").translate(_BYTE_CHARACTERS)
        return packed_ids([t.id for t in self.merge(part)])

    def _learn(self, words: list[str]) -> None:
        """The words' ids; a plain word is merged once for all its cases and the marks behind it."""
        young, old, rest = self.young, self.old, []
        for word in words:
            plain = _PLAIN.fullmatch(word)
            if not plain:
                rest.append(word)
                continue
            ids = b""
            for part in (plain[1].lower(), plain[2]):
                if part:
                    own = young.get(part) or old.get(part)
                    if own is None:
                        own = young[part] = self._merged(part)
                    ids += own
            young[word] = ids
        young.update(zip(rest, self._library(rest), strict=True))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if any(s in text for s in self.special):
            return self._library([text])[0]
        words = _WORDS.findall(text) if _NOT_WHITE.search(text) else text.split()
        missing = set(words).difference(self.young)
        if missing:
            if len(self.young) > CACHE_ROWS:
                self.old, self.young = self.young, {}
                missing = set(words)
            old, young, unseen = self.old, self.young, []
            for word in missing:
                ids = old.get(word)
                if ids is None:
                    unseen.append(word)
                else:
                    young[word] = ids
            if unseen:
                self._learn(unseen)
        return b"".join(map(self.young.__getitem__, words))


def encoder(path: str) -> WordEncoder:
    if _worker.get("path") != path:
        _worker.update(path=path, encoder=WordEncoder(path))
    return _worker["encoder"]


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each document's ids and a 0, cut at the capacity.

    ``ids`` are little-endian unsigned 32-bit integers.
    """
    kinds = f"{PIECE}, ids binary" if ids else PIECE

    def cut(batches):
        own, width = encoder(tokenizer), 4 * capacity
        for batch in batches:
            out = {k.split()[0]: [] for k in kinds.split(", ")}
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                whole = own.encode(text) + b"\0\0\0\0"
                for piece, at in enumerate(range(0, len(whole), width)):
                    part = whole[at : at + width]
                    for k, v in zip(out, (doc_id, piece, at >> 2, len(part) >> 2, zlib.crc32(part), part), strict=False):
                        out[k].append(v)
            yield out

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return map_rows(rows, cut, kinds, batch_rows=500)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, first bin, pieces a bin, offset), and the number of bins."""
    left = {n: c for n, c in histogram.items() if c and n < capacity}
    used: dict[int, int] = defaultdict(int)
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: list[int] = []  # in order
    by_gap: dict[int, list[tuple[int, int]]] = defaultdict(list)  # (first bin, bins) of equal gaps
    bins = 0

    def place(length: int, first: int, count: int, each: int, gap: int) -> None:
        runs.append((length, used[length], first, each, capacity - gap))
        used[length] += count * each
        left[length] -= count * each

    def put(gap: int, first: int, count: int) -> None:
        if gap and count:
            if not by_gap[gap]:
                insort(gaps, gap)
            by_gap[gap].append((first, count))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        at = bisect_left(large, capacity - a + 1) - 1
        b = large[at] if at >= 0 else 0
        count = min(left[a], left[b]) if b and b != a else left[a] // 2 if b else left[a]
        if b == a and not count:  # one is left of it: the next shorter one, if any
            at -= 1
            b = large[at] if at >= 0 else 0
            count = min(left[a], left[b]) if b else left[a]
        place(a, bins, count, 1, capacity)
        if b:
            place(b, bins, count, 1, capacity - a)
        put(capacity - a - b, bins, count)
        bins += count
        large = [n for n in large if left[n]]
    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[length]:
            at = bisect_left(gaps, length)
            if at < len(gaps):
                gap = gaps[at]
                first, count = by_gap[gap].pop()
                if not by_gap[gap]:
                    gaps.pop(at)
            else:
                gap, first, count = capacity, bins, -(-left[length] // (capacity // length))
                bins += count
            each = gap // length
            full = min(count, left[length] // each)
            if full:
                place(length, first, full, each, gap)
                put(gap - each * length, first, full)
                first, count = first + full, count - full
            if count and left[length]:  # fewer are left than the next bin holds
                rest = left[length]
                place(length, first, 1, rest, gap)
                put(gap - rest * length, first, 1)
                first, count = first + 1, count - 1
            put(gap, first, count)
    return runs, bins


def _ranked(rows: DataFrame, total: int) -> DataFrame:
    """``rows`` with ``rank``: 0, 1, .. within each length."""
    salts = max(1, min(1 << 20, total // SALT_ROWS))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = W.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    return salted.withColumn("_rn", F.row_number().over(own)).join(offsets, ["length", "salt"]).withColumn(
        "rank", F.col("base") + F.col("_rn") - 1
    )


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset), one row per piece."""
    rows = checkpointed(pieces(docs, tokenizer, capacity, id_col, text_col, ids))
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs, bins = plan(histogram, capacity)
    runs.sort()
    table = np.array(runs, np.int64).reshape(-1, 5)
    # (length, rank) as one number: ranks stay below 2**48.
    shared = rows.sparkSession.sparkContext.broadcast(((table[:, 0] << 48) + table[:, 1], table))

    def look_up(batches):
        keys, runs = shared.value
        for batch in batches:
            length, rank = (batch[c].to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            run = runs[np.searchsorted(keys, (length << 48) + rank, side="right") - 1]
            turn, nth = np.divmod(rank - run[:, 1], run[:, 3])
            yield {k: batch[k] for k in names} | {
                "sequence_id": pa.array(run[:, 2] + turn),
                "offset": pa.array(run[:, 4] + nth * length),
            }

    kinds = f"{PIECE}, ids binary" if ids else PIECE
    names = [k.split()[0] for k in kinds.split(", ")]
    ranked = _ranked(rows.where(F.col("length") < capacity), sum(histogram.values()))
    placed = map_rows(ranked.select(*names, "rank"), look_up, f"{kinds}, sequence_id long, offset long", batch_rows=1 << 16)
    # A full piece is a sequence of its own; ids beyond the plan's bins, by task and row.
    full = rows.where(F.col("length") == capacity).select(
        *names, (F.monotonically_increasing_id() + F.lit(bins)).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return placed.union(full)


def sequences(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(sequence_id, length, ids, parts): the packed sequences themselves, one row each.

    ``ids`` are the token ids as little-endian unsigned 32-bit integers, ``parts`` (offset, doc_id, piece) in order.
    A sequence has ``capacity`` pieces at most, so no group grows.
    """
    part = F.struct("offset", "doc_id", "piece", "ids")
    grouped = pack(docs, tokenizer, capacity, id_col, text_col, ids=True).groupBy("sequence_id").agg(F.sum("length").alias("length"), F.array_sort(F.collect_list(part)).alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda whole, x: F.concat(whole, x["ids"]))
    parts = F.transform("p", lambda x: F.struct(x["offset"].alias("offset"), x["doc_id"].alias("doc_id"), x["piece"].alias("piece")))
    return grouped.select("sequence_id", "length", joined.alias("ids"), parts.alias("parts"))
