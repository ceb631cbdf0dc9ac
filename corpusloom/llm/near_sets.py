"""Verified similarity of shingle sets: MinHash bands for candidates, exact Jaccard for links.

Candidates come as loose groups; a group is verified where it stands by a breadth-first
search with an inverted index or bit slices, so that each member is claimed once and no pair is emitted.
Groups of more than ``group`` members are cut into blocks by a hash, and every pair of
blocks is searched in a task of its own, which sees all pairs of the group between them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import checkpointed, connected_components, map_rows, shuffle_partitions
from corpusloom.llm.segments import DocumentSets, words
from corpusloom.llm.simhash import BitSlices, fingerprint

SHINGLE = 5
SIMILARITY = 0.8


def document_sets(column: pa.Array, shingle: int = SHINGLE) -> Iterator[DocumentSets]:
    """The shingle sets of a column of texts without nulls, some documents at a time."""
    for part in words(column):
        yield DocumentSets(part, shingle)


def set_fingerprint(hashes: np.ndarray) -> int:
    """SimHash of distinct hashes: the bits set in over half of them."""
    return fingerprint(hashes.view(np.uint64).astype(">u8"))


def sliced_forest(sets: list[np.ndarray], radius: int, least: float = SIMILARITY) -> list[tuple[int, int]]:
    """``jaccard_forest`` of the pairs whose fingerprints are within ``radius`` bits, found by bit slices."""
    sizes = np.array([len(s) for s in sets])

    def similar(lane: int, lanes: list[int]) -> list[int]:
        mine = np.isin(np.concatenate([sets[i] for i in lanes]), sets[lane])
        ends = np.cumsum(sizes[lanes])
        counted = np.concatenate([[0], np.cumsum(mine)])
        shared = counted[ends] - counted[ends - sizes[lanes]]
        good = shared >= least * (sizes[lane] + sizes[lanes] - shared) - 1e-9
        return [i for i, yes in zip(lanes, good.tolist(), strict=True) if yes]

    return BitSlices([set_fingerprint(s) for s in sets]).forest(radius, similar)


def jaccard_forest(sets: list[np.ndarray], least: float = SIMILARITY) -> list[tuple[int, int]]:
    """(member, root) of a spanning forest of the pairs with a Jaccard similarity of ``least`` or more."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    _, tokens = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(n), sizes)
    waiting = np.ones(n, bool)
    while True:  # who shares too few tokens with all others together is similar to none
        shared = np.bincount(tokens[waiting[owner]], minlength=len(tokens))[tokens] > 1
        able = waiting & (np.bincount(owner[shared], minlength=n) >= least * sizes - 1e-9)
        if (able == waiting).all():
            break
        waiting = able
    alone = np.flatnonzero(~waiting)

    def index():
        use = waiting[owner]
        order = np.argsort(tokens[use], kind="stable")
        pointers = np.concatenate([[0], np.cumsum(np.bincount(tokens[use], minlength=tokens.max() + 1))])
        return owner[use][order], pointers, waiting.sum()

    postings, pointers, indexed = index()
    out = [(int(i), int(i)) for i in alone]
    for root in range(n):
        if not waiting[root]:
            continue
        waiting[root] = False
        out.append((root, root))
        frontier = [root]
        while frontier:
            if 2 * waiting.sum() < indexed:
                if not waiting.any():
                    break
                postings, pointers, indexed = index()
            at = frontier.pop()
            mine = tokens[ends[at] - sizes[at] : ends[at]]
            starts, counts = pointers[mine], pointers[mine + 1] - pointers[mine]
            where = np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            shared = np.bincount(postings[where], minlength=n)
            found = np.flatnonzero(waiting & (shared >= least * (sizes[at] + sizes - shared) - 1e-9) & (shared > 0))
            waiting[found] = False
            out += [(int(i), root) for i in found]
            frontier += found.tolist()
    return out


def _plausible(items: DataFrame, least: float) -> DataFrame:
    """The items of which enough tokens are shared within their comp to be similar to anything there."""
    shared = items.select("comp", F.explode("tokens").alias("t")).groupBy("comp", "t").agg(F.count("*").alias("n")).where("n > 1")
    own = items.select("comp", "id", F.size("tokens").alias("size"), F.explode("tokens").alias("t")).join(shared, ["comp", "t"])
    enough = own.groupBy("comp", "id").agg(F.count("*").alias("n"), F.first("size").alias("size"))
    enough = enough.where(F.col("n") >= least * F.col("size") - 1e-9).select("comp", "id")
    return items.join(enough, ["comp", "id"], "left_semi")


def verified_links(items: DataFrame, group: int, least: float = SIMILARITY, radius: int | None = None) -> DataFrame:
    """(src, dst) links that connect all of ``items(comp, id, tokens)`` that are similar within their comp.

    ``tokens`` are distinct hashes. From comps of more than ``group`` members those go first that share
    too few tokens with all others together: texts around a common passage, which only look alike.
    With a ``radius`` only those are verified whose SimHash fingerprints are so near.
    """
    spark = items.sparkSession
    items = checkpointed(items)
    sizes = checkpointed(items.groupBy("comp").agg(F.count("*").alias("n")).where("n > 1"))  # apart, so that a skewed join can be split
    dealt = checkpointed(items.join(sizes, "comp"))
    large = dealt.where(F.col("n") > group)
    if large.limit(1).count():
        left = checkpointed(_plausible(large, least))
        cut = left.groupBy("comp").agg(F.count("*").alias("n"))
        dealt = dealt.where(F.col("n") <= group).unionByName(left.drop("n").join(cut, "comp"))
    blocks = F.ceil(F.col("n") / group).cast("int")
    own = F.pmod(F.xxhash64("id"), blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), blocks - 1))
    dealt = dealt.select("comp", own.alias("_own"), other.alias("_other"), "id", "tokens")
    dealt = dealt.select("comp", F.least("_own", "_other").alias("b0"), F.greatest("_own", "_other").alias("b1"), "id", "tokens")
    kind = {"bigint": "long"}.get(dict(items.dtypes)["id"], dict(items.dtypes)["id"])

    def search(batches):
        key, ids, sets = None, [], []
        out: tuple[list, list] = ([], [])

        def close():
            if len(ids) > 1:
                for i, root in jaccard_forest(sets, least) if radius is None else sliced_forest(sets, radius, least):
                    if i != root:
                        out[0].append(ids[i])
                        out[1].append(ids[root])

        for batch in batches:
            names = [batch[c].to_pylist() for c in ("comp", "b0", "b1", "id")]
            for at, (*now, i) in enumerate(zip(*names, strict=True)):
                if now != key:
                    close()
                    key, ids, sets = now, [], []
                if not ids or ids[-1] != i:
                    ids.append(i)
                    sets.append(batch["tokens"][at].values.to_numpy())
            if len(out[0]) > 10_000:
                yield {"src": out[0], "dst": out[1]}
                out = ([], [])
        close()
        yield {"src": out[0], "dst": out[1]}

    rows = dealt.repartition(shuffle_partitions(spark), "comp", "b0", "b1").sortWithinPartitions("comp", "b0", "b1", "id")
    return map_rows(rows, search, f"src {kind}, dst {kind}", batch_rows=500)


def bucket_stars(keys: DataFrame) -> DataFrame:
    """(src, dst): each member of a bucket of ``keys(key, id)`` with the bucket's least member."""
    least = keys.groupBy("key").agg(F.min("id").alias("dst"), F.max("id").alias("most")).where("dst <> most").select("key", "dst")
    return keys.join(least, "key").where("id <> dst").select(F.col("id").alias("src"), "dst")


def classes(links: DataFrame) -> DataFrame:
    """(id, root) of every linked id."""
    return checkpointed(connected_components(links).select(F.col("node").alias("id"), "root"))
