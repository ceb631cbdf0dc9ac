"""SimHash near-deduplication by bit-sliced comparison (operator 1).

A text's fingerprint is the bitwise majority of XXH64 (seed 42) over its word shingles. Distinct
fingerprints are compared within buckets that agree on two of four 16-bit blocks: fingerprints
that differ in at most two bits agree on at least two blocks, so six tables hold every link.
A bucket keeps its fingerprints as 64 bit planes, one lane a fingerprint. One query is compared
with all lanes of a block at once: each plane (inverted where the query's bit is set) is added
to two carry-save counter planes, and the block is abandoned once every lane is over the radius.
Buckets are searched breadth first, so each lane is claimed once and a bucket gives a spanning
forest of its links, not its pairs.

A bucket of more than ``BUCKET`` distinct fingerprints is split again on its other 32 bits, in the
same way (four 8-bit blocks, six tables): what agrees on 48 bits has 65,536 members at most,
so no bucket grows with the input. Copies share a fingerprint and are joined only at the end.

Defined cases: a null text counts as empty and has fingerprint zero, linked like any other; a
repeated row gets the same class; a null doc_id is kept and never names a class unless
the class has no other id; extra columns are ignored; an empty table gives an empty result.

``near_duplicate_rows`` is the form for removal: five-word shingles and a verified similarity of 0.8
or more. No pigeonhole is selective at the ten bits by which such fingerprints differ, so candidates come
from MinHash bands; they are compared by the same bit slices before they are verified.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import Presence, as_bytes, checkpointed, connected_components, map_rows, shuffle_partitions, text_of

RADIUS = 2
BUCKET = 4096
BLOCK_LANES = 4096
_PAIRS = [(a, b) for a in range(4) for b in range(a + 1, 4)]


def shingle_digests(text: bytes, size: int) -> np.ndarray:
    """XXH64 (seed 42) of every word shingle, repeats included, as big-endian unsigned integers."""
    words = text.lower().split()
    if not words:
        return np.empty(0, ">u8")
    line = b" ".join(words)
    if len(words) <= size:
        return np.frombuffer(xxhash.xxh64_digest(line, 42), ">u8")
    digest = xxhash.xxh64_digest
    stops = list(accumulate(map(len, words), lambda a, n: a + n + 1))
    starts = [0] + [s + 1 for s in stops]
    return np.frombuffer(b"".join([digest(line[a:b], 42) for a, b in zip(starts, stops[size - 1 :])]), ">u8")


def fingerprint(digests: np.ndarray) -> int:
    """The bits that are set in over half of the digests."""
    n = len(digests)
    if not n:
        return 0
    raw = digests.view("u1").reshape(n, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        ones += np.unpackbits(raw[at : at + (1 << 15)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


class BitSlices:
    """Fingerprints as bit planes: bit i of plane k is bit k of fingerprint i."""

    def __init__(self, values: list[int]):
        self.values = values
        self.n = len(values)
        self.blocks = []
        for at in range(0, self.n, BLOCK_LANES):
            part = values[at : at + BLOCK_LANES]
            bits = np.unpackbits(np.array(part, "<u8").view("u1").reshape(-1, 8), axis=1, bitorder="little")
            packed = np.packbits(bits.T, axis=1, bitorder="little")
            planes = [int.from_bytes(row.tobytes(), "little") for row in packed]
            self.blocks.append((at, planes, (1 << len(part)) - 1))

    def within(self, query: int, radius: int, alive: list[int]) -> list[int]:
        """Per block, the lanes of ``alive`` within ``radius`` of the query."""
        depth = (radius + 1).bit_length()
        out = []
        for (_, planes, full), live in zip(self.blocks, alive, strict=True):
            over, counters = full & ~live, [0] * depth
            for k in range(64):
                carry = planes[k] ^ full if query >> k & 1 else planes[k]
                for c in range(depth):
                    counters[c], carry = counters[c] ^ carry, counters[c] & carry
                    if not carry:
                        break
                else:
                    over |= carry
                if k >= radius:
                    over |= _above(counters, radius, full)
                    if over == full:
                        break
            out.append(full & ~over)
        return out

    def forest(self, radius: int, accept=None) -> list[tuple[int, int]]:
        """(lane, root lane) of a breadth-first spanning forest; roots link to themselves.

        ``accept(query lane, lanes)`` may refuse lanes that the fingerprints would link.
        """
        alive = [full for _, _, full in self.blocks]
        out = []
        for root in range(self.n):
            if not alive[root // BLOCK_LANES] >> (root % BLOCK_LANES) & 1:
                continue
            alive[root // BLOCK_LANES] ^= 1 << (root % BLOCK_LANES)
            out.append((root, root))
            frontier = [root]
            while frontier:
                lane = frontier.pop()
                found = []
                for b, hits in enumerate(self.within(self.values[lane], radius, alive)):
                    while hits:
                        low = hits & -hits
                        found.append(b * BLOCK_LANES + low.bit_length() - 1)
                        hits ^= low
                if accept and found:
                    found = accept(lane, found)
                for other in found:
                    alive[other // BLOCK_LANES] ^= 1 << (other % BLOCK_LANES)
                    out.append((other, root))
                frontier += found
        return out


def _above(counters: list[int], radius: int, full: int) -> int:
    """Lanes whose count is over the radius."""
    above, equal = 0, full
    for c in range(len(counters) - 1, -1, -1):
        if radius >> c & 1:
            equal &= counters[c]
        else:
            above |= equal & counters[c]
            equal &= ~counters[c]
    return above


def _keys(fp, blocks: int, width: int, shift: int = 0):
    """The six table keys of ``fp``: table number, then the two blocks it keeps."""
    mask = (1 << width) - 1
    block = lambda i: F.shiftrightunsigned(fp, shift + i * width).bitwiseAND(F.lit(mask))
    return F.array(
        *[
            F.lit(t << 2 * width).bitwiseOR(F.shiftleft(block(a), width)).bitwiseOR(block(b))
            for t, (a, b) in enumerate(_PAIRS)
        ]
    )


def _other_bits(fp, key):
    """The 32 bits of ``fp`` that its table doesn't keep."""
    block = lambda i: F.shiftrightunsigned(fp, i * 16).bitwiseAND(F.lit(0xFFFF))
    table = F.shiftrightunsigned(key, 32)
    out = None
    for t, pair in enumerate(_PAIRS):
        a, b = (i for i in range(4) if i not in pair)
        rest = F.shiftleft(block(a), 16).bitwiseOR(block(b))
        out = F.when(table == t, rest) if out is None else out.when(table == t, rest)
    return out


def bucket_links(rows: DataFrame, radius: int) -> DataFrame:
    """(src, dst) links of ``rows(key.., fp)``: in each bucket, each member with its tree's root."""
    keys = [c for c in rows.columns if c != "fp"]
    spark = rows.sparkSession

    def search(batches):
        held_key, held = None, []
        out: tuple[list, list] = ([], [])

        def close():
            if len(held) > 1:
                values = [v & 0xFFFFFFFFFFFFFFFF for v in held]
                for lane, root in BitSlices(values).forest(radius):
                    if lane != root:
                        out[0].append(held[lane])
                        out[1].append(held[root])

        for batch in batches:
            for *key, fp in zip(*[batch[c].to_pylist() for c in keys], batch["fp"].to_pylist(), strict=True):
                if key != held_key:
                    close()
                    held_key, held = key, []
                    if len(out[0]) > 10_000:
                        yield {"src": out[0], "dst": out[1]}
                        out = ([], [])
                held.append(fp)
        close()
        yield {"src": out[0], "dst": out[1]}

    dealt = rows.repartition(shuffle_partitions(spark), *keys).sortWithinPartitions(*keys, "fp")
    return map_rows(dealt, search, "src long, dst long", batch_rows=1 << 14)


def fingerprint_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(src, dst) links that connect all distinct fingerprints of ``fps(fp)`` within ``radius`` bits."""
    if radius > 2:
        raise ValueError("four blocks hold every link up to two bits")
    tables = checkpointed(fps.select("fp", F.explode(_keys(F.col("fp"), 4, 16)).alias("key")))
    sizes = tables.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    sizes = checkpointed(sizes.select("key", (F.col("n") > BUCKET).alias("hot")))
    shared = tables.join(sizes, "key")
    sub = F.explode(_keys(_other_bits(F.col("fp"), F.col("key")), 4, 8)).alias("sub")
    cold = shared.where(~F.col("hot")).select("key", F.lit(-1).cast("long").alias("sub"), "fp")
    hot = shared.where("hot").select("key", sub, "fp")
    return bucket_links(cold.union(hot), radius)


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit integer."""

    def compute(batches):
        for batch in batches:
            fps = [signed(fingerprint(shingle_digests(t, shingle))) for t in as_bytes(batch["text"])]
            yield {"doc_id": batch["doc_id"], "fp": fps}

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return map_rows(rows, compute, "doc_id long, fp long")


def simhash_classes(docs: DataFrame, shingle: int = 3, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of ``docs``."""
    rows = checkpointed(fingerprints(docs, shingle, id_col, text_col))
    own = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(fingerprint_links(own.select("fp"), radius))
    linked = own.join(roots, own["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    linked = checkpointed(linked)
    named = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = linked.join(named, "root").select("fp", "component_id")
    return rows.join(classes, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


GROUP = 4000
BANDS, ROWS = 12, 3
#: Fingerprints over distinct shingles differ in about 10 of 64 bits at a similarity of 0.8, in over 24 with a probability of 1e-5.
LOOSE_RADIUS = 24


def near_duplicate_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stay: of each class of near copies the one with the least doc_id.

    Texts are in one class if a chain of pairs with a Jaccard similarity of ``least`` or more over
    ``shingle``-word shingles links them. Candidates share a MinHash band; in each group of them
    fingerprints over the distinct shingles (a repeated line counts once) are compared by bit slices within
    ``LOOSE_RADIUS`` bits, and exact Jaccard decides. This holds for groups of any size: large ones are cut into pairs of blocks.
    Texts are known by 128 bits. Only rows that may be removed are shuffled with their texts.
    Texts without words are never near copies. Fully repeated rows stay or go together, as exact
    deduplication is the operator for them; of equal texts that have near copies the least doc_id stays.
    """
    from corpusloom.llm.near_sets import bucket_stars, classes, document_sets, verified_links

    def mark(batches):
        for batch in batches:
            keys: list = [None] * len(batch["text"])
            for found in document_sets(batch["text"], shingle):
                for i, own in zip(found.docs.tolist(), found.band_keys(BANDS, ROWS), strict=True):
                    keys[i] = own
            yield {"doc_id": batch["doc_id"], "id": batch["id"], "keys": keys}

    text = text_of(text_col)
    identity = F.unhex(F.md5(text.cast("binary")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), identity.alias("id"))
    marks = checkpointed(map_rows(rows, mark, "doc_id long, id binary, keys array<long>").where("keys IS NOT NULL"))
    distinct = marks.dropDuplicates(["id"])
    loose = classes(bucket_stars(checkpointed(distinct.select("id", F.explode("keys").alias("key")))))
    wanted = Presence(loose.select(F.xxhash64("id").alias("probe")), "probe")

    def read(batches):
        for batch in batches:
            hit = np.flatnonzero(wanted.may_hold(batch["probe"].to_numpy()))
            tokens: list = [None] * len(hit)
            for found in document_sets(batch["text"].take(hit), shingle):
                for i, own in zip(found.docs.tolist(), found.sets(), strict=True):
                    tokens[i] = own
            yield {"id": batch["id"].take(hit), "tokens": tokens}

    sets = map_rows(rows.select("id", F.xxhash64("id").alias("probe"), "text"), read, "id binary, tokens array<long>")
    items = sets.where("tokens IS NOT NULL").join(loose, "id").dropDuplicates(["id"]).select(F.col("root").alias("comp"), "id", "tokens")
    exact = classes(verified_links(items, GROUP, least, LOOSE_RADIUS))
    named = marks.select("doc_id", "id").join(exact, "id", "left").withColumn("root", F.coalesce("root", "id"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("d"), F.col("id").alias("i")))
    keep = named.groupBy("root").agg(first.alias("f"), F.count("*").alias("n")).where("n > 1").select("root", "f.d", "f.i")
    losers = checkpointed(named.join(keep, "root").where("id <> i OR NOT (doc_id <=> d)").select("doc_id", "id").distinct())
    return without_rows(docs, losers, id_col, identity)


def without_rows(docs: DataFrame, gone: DataFrame, id_col: str, identity) -> DataFrame:
    """``docs`` without the rows of ``gone(doc_id, id)``, a checkpointed table; the others aren't shuffled, but for false alarms."""
    own = docs.columns
    wanted = Presence(gone.select(F.xxhash64("id").alias("probe")), "probe")
    may = F.pandas_udf(lambda probe: pd.Series(wanted.may_hold(probe.to_numpy())), "boolean")
    tagged = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own)], F.col(id_col).cast("long").alias("_doc"), identity.alias("_id"))
    tagged = tagged.withColumn("_may", may(F.xxhash64("_id")))
    match = (F.col("_id") == gone["id"]) & F.col("_doc").eqNullSafe(gone["doc_id"])
    stay = tagged.where(~F.col("_may")).unionByName(tagged.where("_may").join(gone, match, "left_anti"))
    return stay.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(own)])
