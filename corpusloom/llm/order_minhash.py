"""Document fingerprints by Order MinHash (operator 5).

Every k-mer of a text (k code points) is numbered by its occurrence, so repeats count. For each
of ``COMPONENTS`` hash orders the two least numbered k-mers are selected, put back in the order
in which they stand in the text, and hashed as a tuple to one 32-bit component. Two texts
agree in a component about as often as their numbered k-mers agree in content and in order,
so the share of equal components falls with edit distance, also where moves keep the
k-mer set as it was.

``compare_neighbours`` fingerprints each document beside the next one in descending order of
doc_id. Documents are dealt to ranges of doc_id and sorted there; a range's last document meets
the next range's first one, which is sent to both. Texts are shuffled once, compressed.

Defined cases: a null text counts as empty; an empty text's fingerprint is all zeros (two empty
texts are alike, likeness 1); a text shorter than k is one k-mer; a null doc_id comes last in the
order; rows that share a doc_id are in the order of their compressed texts' bytes, or, where they are so many that they fill several ranges, of a
hash of their texts first, by which they are dealt (wholly repeated rows stay together); a lone document is its own next; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import map_rows, shuffle_partitions, text_of

K = 8
COMPONENTS = 64
_BLOCK = 1 << 14
_RANDOM = np.random.default_rng(5)
_XOR = _RANDOM.integers(0, 1 << 32, COMPONENTS, np.uint32)
_TIMES = _RANDOM.integers(0, 1 << 31, COMPONENTS, np.uint32) * np.uint32(2) + np.uint32(1)
_POSITION_BITS = 24


def numbered_kmers(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of every occurrence-numbered k-mer, in an order fixed by the hashes."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    n = max(1, len(codes) - K + 1)
    if not len(codes):
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    h = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
    for i in range(min(K, len(codes))):
        h = (h ^ codes[i : i + n]) * np.uint64(0x100000001B3)
        h ^= h >> np.uint64(29)
    if n < 1 << _POSITION_BITS:
        low = np.uint64((1 << _POSITION_BITS) - 1)
        packed = np.sort((h & ~low) | np.arange(n, dtype=np.uint64))
        h, at = packed >> np.uint64(_POSITION_BITS), (packed & low).astype(np.int64)
    else:
        h = h >> np.uint64(_POSITION_BITS)
        at = np.argsort(h, kind="stable")
        h = h[at]
    starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    runs = np.diff(np.append(starts, n))
    occurrence = np.arange(n) - np.repeat(starts, runs)
    mixed = (h ^ (occurrence.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xFF51AFD7ED558CCD)
    return ((mixed ^ (mixed >> np.uint64(33))) >> np.uint64(8)).astype(np.uint32), at


def fingerprint(text: str) -> np.ndarray:
    """``COMPONENTS`` unsigned 32-bit components."""
    h, at = numbered_kmers(text)
    if not len(h):
        return np.zeros(COMPONENTS, np.uint32)
    rows = np.arange(COMPONENTS)
    best = np.full((COMPONENTS, 2), np.iinfo(np.int64).max, np.int64)  # order value, then index
    for start in range(0, len(h), _BLOCK):
        values = (h[start : start + _BLOCK] ^ _XOR[:, None]) * _TIMES[:, None]
        found = [best]
        for _ in range(2):
            i = values.argmin(axis=1)
            found.append((values[rows, i].astype(np.int64) << 31 | (start + i))[:, None])
            values[rows, i] = np.iinfo(np.uint32).max
            if values.shape[1] == 1:
                break
        best = np.sort(np.concatenate(found, axis=1), axis=1)[:, :2]
    index = best & ((1 << 31) - 1)
    if len(h) == 1:
        index[:, 1] = index[:, 0]
    swap = at[index[:, 0]] > at[index[:, 1]]
    index[swap] = index[swap][:, ::-1]
    pair = h[index].astype(np.uint64)
    mixed = (pair[:, 0] * np.uint64(0x9E3779B97F4A7C15) + pair[:, 1]) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (mixed >> np.uint64(32)).astype(np.uint32)


def written(components: np.ndarray) -> str:
    return components.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint), one row per row of ``docs``."""

    def run(batches):
        for batch in batches:
            yield {"doc_id": batch["doc_id"], "fingerprint": [written(fingerprint(t)) for t in batch["text"].to_pylist()]}

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return map_rows(rows, run, "doc_id long, fingerprint string")


def edited_text(text: str, following: str) -> str:
    """The last third of the code points replaced by as many of the following text's first."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


_LEAST = -(1 << 63)


class Ranges:
    """Ranges of the order (doc_id descending, then ``hash`` ascending), numbered against it.

    ``cuts`` are quantiles of the ids. An id that fills several of them is as many ranges of hashes; of all others only the id counts.
    """

    def __init__(self, cuts: list[int]):
        self.bounds, times = np.unique(np.array(cuts, np.int64), return_counts=True)
        self.times = np.where(times > 1, times + 1, 0)
        self.first = np.concatenate([[0], np.cumsum(1 + self.times)])

    def hot(self) -> list[int]:
        return self.bounds[self.times > 0].tolist()

    def of(self, keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.bounds, keys, side="left")
        out = self.first[at]
        if not len(self.bounds):
            return out
        own = np.minimum(at, len(self.bounds) - 1)
        times = np.where((at < len(self.bounds)) & (self.bounds[own] == keys), self.times[own], 0)
        turn = ((hashes.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(32)).astype(np.int64) * times >> 32
        return out + np.where(times > 0, times - turn, 0)


def compare_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)."""
    spark = docs.sparkSession
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(_LEAST))
    parts = 4 * shuffle_partitions(spark)
    # At most ``parts`` numbers each: cut points, and the first document of every range.
    cuts = docs.select(key.alias("key")).approxQuantile("key", [i / parts for i in range(1, parts)], 0.2 / parts)
    ranges = Ranges(np.array(cuts, np.float64).astype(np.int64).tolist())
    hashed = F.when(key.isin(ranges.hot()), F.xxhash64(text_of(text_col))).otherwise(0) if ranges.hot() else F.lit(0).cast("long")
    shared = spark.sparkContext.broadcast(ranges)

    def tops(batches):
        best: dict[int, tuple[int, int]] = {}
        for batch in batches:
            keys, hashes = (batch[c].to_numpy(zero_copy_only=False) for c in ("key", "hash"))
            for part in np.unique(own := shared.value.of(keys, hashes)).tolist():
                top = int(keys[own == part].max())
                mine = -top, int(hashes[(own == part) & (keys == top)].min())
                best[part] = min(best.get(part, mine), mine)
        yield {"part": list(best), "key": [-k for k, _ in best.values()], "hash": [h for _, h in best.values()]}

    found = map_rows(docs.select(key.alias("key"), hashed.alias("hash")), tops, "part long, key long, hash long")
    first = found.groupBy("part").agg(F.min(F.struct((-F.col("key").cast("decimal(20,0)")).alias("k"), "hash", "key")).alias("m"))
    order = [(r["part"], (r["m"]["key"], r["m"]["hash"])) for r in first.orderBy("part").collect()]
    # The first document of each range also goes, behind the others, to the range above it.
    above = {of: order[(i + 1) % len(order)][0] for i, (_, of) in enumerate(order)}
    firsts = spark.sparkContext.broadcast(above)

    def deal(batches):
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("part", "guest", "key", "hash", "doc_id", "body")}
            keys, hashes = batch["key"].to_pylist(), batch["hash"].to_pylist()
            own = shared.value.of(np.array(keys, np.int64), np.array(hashes, np.int64)).tolist()
            for part, key, mark, doc_id, text in zip(own, keys, hashes, batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                body = squeeze.compress(text.encode())
                places = [(part, 0)] + ([(firsts.value[key, mark], 1)] if (key, mark) in firsts.value else [])
                for to, guest in places:
                    for k, v in zip(out, (to, guest, key, mark, doc_id, body), strict=True):
                        out[k].append(v)
            yield out

    def compare(batches):
        inflate = zstandard.ZstdDecompressor()
        held = None
        out: dict[str, list] = {k: [] for k in _OUT}
        for batch in batches:
            for part, guest, doc_id, body in zip(*[batch[k].to_pylist() for k in ("part", "guest", "doc_id", "body")], strict=True):
                if guest and (held is None or held[0] != part):
                    continue  # a repeated row of the guest
                text = inflate.decompress(body).decode()
                now = (part, doc_id, text, fingerprint(text))
                if held is not None and held[0] == part:
                    _, held_id, own, marks = held
                    edited = edited_text(own, text)
                    marks_edited = fingerprint(edited)
                    values = (
                        held_id,
                        len(own),
                        hashlib.sha256(edited.encode()).hexdigest(),
                        written(marks),
                        written(marks_edited),
                        likeness(marks, marks_edited),
                        likeness(marks, now[3]),
                    )
                    for k, v in zip(_OUT, values, strict=True):
                        out[k].append(v)
                held = None if guest else now
            yield out
            out = {k: [] for k in _OUT}

    rows = docs.select(key.alias("key"), hashed.alias("hash"), F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    dealt = map_rows(rows, deal, "part long, guest int, key long, hash long, doc_id long, body binary", batch_rows=500)
    near = dealt.repartition(shuffle_partitions(spark), "part").sortWithinPartitions("part", "guest", F.desc("key"), "hash", "body")
    kinds = ("long", "long", "string", "string", "string", "double", "double")
    return map_rows(near, compare, ", ".join(f"{n} {k}" for n, k in zip(_OUT, kinds, strict=True)), batch_rows=500)


_OUT = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
