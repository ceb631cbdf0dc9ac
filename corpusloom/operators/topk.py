"""Exact top-k neighbours: blocks of queries against shards of the corpus, bounded heaps, pruned by upper bounds.

Both sides are packed where they stand, some thousand vectors a row. Every shard meets every block once, in one pass over the corpus
(the blocks are broadcast while their size, which is checked, allows it); a task keeps the k best of each
query over all its shards, and only these, at most k a query and task, meet in a ranked window. No posting, pair or vector is
shuffled by its term, so no term makes a hot key.

Sparse vectors: a shard is an inverted index with each term's greatest weight. A query's terms are taken from the rarest in the shard on.
What terms behind some place can add is at most the sum of their greatest products, and at most the norm of
that part of the query (documents have unit length), so as soon as this falls below the query's k-th score so far, documents that
have had none of the terms before it are out; of the others, those whose sum so far and the bound together stay below it.
Dense vectors: a block is one matrix product; a shard whose greatest norm times the query's can't reach the k-th score is left out.

Scores are rounded to ``PLACES`` before they are compared; ties go to the smaller document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SHARD = 2_048
BLOCK = 512
BROADCAST_BYTES = 64 << 20
PLACES = 9
#: Bounds are compared with this much to spare, as sums of floats and rounding may differ in the last places.
SLACK = 4e-9
FOUND = "query long, doc long, score double"


class Heaps:
    """The k best (score, document) of each query in a task."""

    def __init__(self, k: int):
        self.k = k
        self.best: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def least(self, query: int) -> float:
        """The score that a document must reach; minus infinity until there are k."""
        scores = self.best[query][0] if query in self.best else ()
        return scores[-1] if len(scores) == self.k else -np.inf

    def offer(self, query: int, scores: np.ndarray, docs: np.ndarray) -> None:
        if query in self.best:
            scores, docs = np.concatenate([self.best[query][0], scores]), np.concatenate([self.best[query][1], docs])
        keep = np.lexsort((docs, -scores))[: self.k]
        self.best[query] = scores[keep], docs[keep]

    def rows(self) -> pd.DataFrame:
        sizes = [len(s) for s, _ in self.best.values()]
        if not sizes:
            return pd.DataFrame({"query": np.zeros(0, np.int64), "doc": np.zeros(0, np.int64), "score": np.zeros(0)})
        return pd.DataFrame({"query": np.repeat(list(self.best), sizes), "doc": np.concatenate([d for _, d in self.best.values()]), "score": np.concatenate([s for s, _ in self.best.values()])})


# -- sparse ------------------------------------------------------------------------------


def _pack_sparse(frames: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """(key, terms, weights) rows as (ids, starts, terms, weights) binaries of ``size`` vectors."""
    for frame in frames:
        for at in range(0, len(frame), size):
            part = frame.iloc[at : at + size]
            lengths = [len(t) for t in part["terms"]]
            yield pd.DataFrame(
                {
                    "ids": [part["key"].to_numpy(np.int64).tobytes()],
                    "starts": [np.cumsum([0, *lengths]).astype(np.int64).tobytes()],
                    "terms": [np.concatenate([np.asarray(t, np.int64) for t in part["terms"]]).tobytes()],
                    "weights": [np.concatenate([np.asarray(w, np.float64) for w in part["weights"]]).tobytes()],
                }
            )


class SparseShard:
    """The inverted index of a shard."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray, terms: np.ndarray, weights: np.ndarray):
        order = np.argsort(terms, kind="stable")
        self.ids, self.docs, self.weights = ids, np.repeat(np.arange(len(ids)), np.diff(starts))[order], weights[order]
        self.terms, self.first = np.unique(terms[order], return_index=True)
        self.last = np.append(self.first[1:], len(order))
        self.most = np.maximum.reduceat(self.weights, self.first) if len(order) else np.zeros(0)
        self.postings = self.candidates = 0  # rows of a join on the term, and pairs whose scores were looked at

    def search(self, query: int, terms: np.ndarray, weights: np.ndarray, heaps: Heaps, same: bool) -> None:
        at = np.searchsorted(self.terms, terms)
        has = at < len(self.terms)
        has[has] = self.terms[at[has]] == terms[has]
        at, own = at[has], weights[has]
        if not len(at):
            return
        sizes = self.last[at] - self.first[at]
        self.postings += int(sizes.sum())
        rare = np.argsort(sizes, kind="stable")
        at, own = at[rare], own[rare]
        least = heaps.least(query) - SLACK
        reach = np.minimum(np.cumsum((own * self.most[at])[::-1])[::-1], np.sqrt(np.cumsum((own * own)[::-1])[::-1]))
        probed = int(np.searchsorted(-reach, -least, side="right"))  # reach falls: the terms that can still bring a document in
        if not probed:
            return
        scores = self._sums(at[:probed], own[:probed])
        rest = reach[probed] if probed < len(at) else 0.0
        found = scores > 0
        self.candidates += int(found.sum())
        found &= scores + rest >= least
        if not found.any():
            return
        if probed < len(at):
            scores += self._sums(at[probed:], own[probed:])
        if same:
            found &= self.ids != query
        pick = np.flatnonzero(found & (scores >= least))
        if len(pick):
            heaps.offer(query, np.round(scores[pick], PLACES), self.ids[pick])

    def _sums(self, at: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Per document the products over these terms."""
        sizes = self.last[at] - self.first[at]
        places = np.repeat(self.first[at] - np.cumsum(np.append(0, sizes[:-1])), sizes) + np.arange(sizes.sum())
        return np.bincount(self.docs[places], np.repeat(own, sizes) * self.weights[places], len(self.ids))


def sparse_top_k(queries: DataFrame, corpus: DataFrame, k: int, same: bool = False) -> DataFrame:
    """(query, doc, score, rank) over ``(key, terms, weights)``: arrays of distinct term ids and of weights; unit vectors in the corpus.

    Only documents that share a term count, by scores over 0. ``same``: a row isn't its own neighbour.
    """

    def best(frames):
        heaps, shards = Heaps(k), {}
        for frame in frames:
            for row in frame.itertuples(index=False):
                if row.shard not in shards:
                    shards = {row.shard: SparseShard(*_arrays(row.ids, row.starts, row.terms, row.weights))}
                ids, starts, terms, weights = _arrays(row.q_ids, row.q_starts, row.q_terms, row.q_weights)
                for i, query in enumerate(ids.tolist()):
                    part = slice(starts[i], starts[i + 1])
                    shards[row.shard].search(query, terms[part], weights[part], heaps, same)
        yield heaps.rows()

    kind = "ids binary, starts binary, terms binary, weights binary"
    return _ranked(_crossed(corpus, queries, lambda size: lambda frames: _pack_sparse(frames, size), kind).mapInPandas(best, FOUND), k)


def _arrays(ids: bytes, starts: bytes, terms: bytes, weights: bytes) -> tuple[np.ndarray, ...]:
    return np.frombuffer(ids, np.int64), np.frombuffer(starts, np.int64), np.frombuffer(terms, np.int64), np.frombuffer(weights, np.float64)


# -- dense -------------------------------------------------------------------------------


def _pack_dense(frames: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for at in range(0, len(frame), size):
            part = frame.iloc[at : at + size]
            yield pd.DataFrame({"ids": [part["key"].to_numpy(np.int64).tobytes()], "vectors": [np.array(part["vector"].tolist(), np.float64).tobytes()]})


def dense_block(ids: np.ndarray, vectors: np.ndarray, q_ids: np.ndarray, q_vectors: np.ndarray, heaps: Heaps, same: bool) -> int:
    """Offers a shard to a block of queries; the number of queries that the norms leave."""
    norm = np.sqrt((vectors * vectors).sum(1).max(initial=0.0))
    least = np.array([heaps.least(q) for q in q_ids.tolist()]) - SLACK
    left = np.flatnonzero(np.sqrt((q_vectors * q_vectors).sum(1)) * norm >= least)
    if not len(left) or not len(ids):
        return 0
    scores = np.round(q_vectors[left] @ vectors.T, PLACES)
    if same:
        scores[q_ids[left][:, None] == ids[None, :]] = -np.inf
    n = min(heaps.k, len(ids))
    edge = np.maximum(np.partition(scores, -n, axis=1)[:, -n], least[left])
    for i, query in enumerate(q_ids[left].tolist()):
        pick = np.flatnonzero((scores[i] >= edge[i]) & np.isfinite(scores[i]))
        if len(pick):
            heaps.offer(query, scores[i, pick], ids[pick])
    return len(left)


def dense_top_k(queries: DataFrame, corpus: DataFrame, k: int, same: bool = True) -> DataFrame:
    """(query, doc, score, rank) over ``(key, vector)`` by dot products; all vectors are of one length."""

    def best(frames):
        heaps = Heaps(k)
        for frame in frames:
            for row in frame.itertuples(index=False):
                ids, q_ids = np.frombuffer(row.ids, np.int64), np.frombuffer(row.q_ids, np.int64)
                dense_block(ids, np.frombuffer(row.vectors).reshape(len(ids), -1), q_ids, np.frombuffer(row.q_vectors).reshape(len(q_ids), -1), heaps, same)
        yield heaps.rows()

    return _ranked(_crossed(corpus, queries, lambda size: lambda frames: _pack_dense(frames, size), "ids binary, vectors binary").mapInPandas(best, FOUND), k)


# -- sets --------------------------------------------------------------------------------


class SetShard:
    """The inverted index of some sets, for the greatest Jaccard similarity to any of them."""

    #: Below this many pairs an index costs more than the pairs.
    FEW = 16

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in sets])
        terms = np.concatenate(sets)
        order = np.argsort(terms, kind="stable")
        self.docs = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.terms, self.first = np.unique(terms[order], return_index=True)
        self.last = np.append(self.first[1:], len(order))
        self.least_size = int(self.sizes.min())
        self.candidates = 0  # pairs whose overlaps were looked at

    def best(self, own: np.ndarray, least: float) -> float:
        """The greatest similarity, if it is ``least`` or more and over 0; else 0."""
        at = np.searchsorted(self.terms, own)
        has = at < len(self.terms)
        has[has] = self.terms[at[has]] == own[has]
        at = at[has]
        at = at[np.argsort(self.last[at] - self.first[at], kind="stable")]  # rare terms first
        # A set that has had none of the first i of m shared terms overlaps in m - i at most.
        left = np.arange(len(at), 0, -1)
        reach = left / np.maximum(len(own), len(own) + self.least_size - left)
        probed = int(np.searchsorted(-reach, -least, side="right"))
        if not probed:
            return 0.0
        overlap = self._overlaps(at[:probed])
        found = np.flatnonzero(overlap)
        self.candidates += len(found)
        most = np.minimum(overlap[found] + len(at) - probed, self.sizes[found])
        found = found[most / (len(own) + self.sizes[found] - most) >= least]
        if not len(found):
            return 0.0
        whole = overlap[found] + self._overlaps(at[probed:])[found] if probed < len(at) else overlap[found]
        best = float((whole / (len(own) + self.sizes[found] - whole)).max())
        return best if best >= least else 0.0

    def _overlaps(self, at: np.ndarray) -> np.ndarray:
        sizes = self.last[at] - self.first[at]
        places = np.repeat(self.first[at] - np.cumsum(np.append(0, sizes[:-1])), sizes) + np.arange(sizes.sum())
        return np.bincount(self.docs[places], minlength=len(self.sizes))


def _best_of_few(sets: list[np.ndarray], own: np.ndarray, least: float) -> float:
    mine, best = set(own.tolist()), 0.0
    for other in sets:
        shared = len(mine.intersection(other.tolist()))
        best = max(best, shared / (len(mine) + len(other) - shared))
    return best if best >= least else 0.0


def best_jaccard(left: DataFrame, right: DataFrame, least: float = 0.0) -> DataFrame:
    """(id, similarity): for each row of ``left(block, id, terms)`` the greatest Jaccard similarity to a set of ``right(block, terms)`` in its
    block, where it is over 0 and ``least`` or more; terms are distinct ids.

    Blocks are cut by hash into shards and groups of queries of a bounded size, and every shard of a block meets every group
    of it, so that a block of any size is many cells of work. A row keeps one number a cell: near copies make no pairs.
    """
    part = lambda rows, size: F.ceil(F.col(rows) / size).cast("int")
    sizes = left.groupBy("block").agg(F.count("*").alias("n_left")).join(right.groupBy("block").agg(F.count("*").alias("n_right")), "block")
    sizes = sizes.select("block", part("n_right", SHARD).alias("shards"), part("n_left", BLOCK).alias("groups"))
    cut = lambda n: F.pmod(F.xxhash64("terms"), F.col(n)).cast("int")
    shards = right.join(sizes, "block").groupBy("block", cut("shards").alias("shard")).agg(F.collect_list("terms").alias("sets"))
    groups = left.join(sizes, "block").groupBy("block", "shards", cut("groups").alias("group")).agg(F.collect_list("id").alias("ids"), F.collect_list("terms").alias("asked"))
    groups = groups.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).drop("shards", "group")
    cells = groups.join(shards, ["block", "shard"]).select("block", "shard", "ids", "asked", "sets")

    def best(frames):
        for frame in frames:
            ids, found, last, shard = [], [], None, None
            for block, number, own_ids, asked, sets in frame.itertuples(index=False):
                few = len(asked) * len(sets) <= SetShard.FEW
                if not few and last != (block, number):
                    last, shard = (block, number), SetShard(list(sets))
                for i, own in zip(own_ids.tolist(), asked, strict=True):
                    score = _best_of_few(sets, own, least) if few else shard.best(own, least)
                    if score > 0:
                        ids.append(i)
                        found.append(score)
            yield pd.DataFrame({"id": np.array(ids, np.int64), "similarity": np.array(found, float)})

    return cells.mapInPandas(best, "id long, similarity double").groupBy("id").agg(F.max("similarity").alias("similarity"))


# -- both --------------------------------------------------------------------------------


def _crossed(corpus: DataFrame, queries: DataFrame, pack, kind: str) -> DataFrame:
    """Each packed shard with each packed block of queries; the blocks are few rows, and broadcast while they are small."""
    shards = corpus.mapInPandas(pack(SHARD), kind).withColumn("shard", F.monotonically_increasing_id())
    blocks = queries.mapInPandas(pack(BLOCK), kind)
    names = blocks.columns
    blocks = blocks.select(*[F.col(c).alias(f"q_{c}") for c in names])
    size = blocks.agg(F.sum(sum(F.octet_length(f"q_{c}") for c in names))).first()[0] or 0
    return shards.crossJoin(F.broadcast(blocks) if size <= BROADCAST_BYTES else blocks)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    place = W.partitionBy("query").orderBy(F.desc("score"), "doc")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
