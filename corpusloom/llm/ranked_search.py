"""Ranked lexical search over sharded inverted indexes, a document at a time (operator 13).

Index: each task cuts its documents into shards of at most ``SHARD_DOCS`` documents and about ``SHARD_BYTES`` of text. In a shard
documents are numbered in the order of doc_id; a term's postings are the gaps between these numbers and the counts, both as
variable-length integers, so they are sorted by doc_id and can be merged as they are. A shard is one row: no
document, term or posting is shuffled. If the terms that will be looked up are known and few (``MOST_TERMS``) the
index holds these alone, with the lengths of all documents.

Statistics: N, L and the document frequencies of the terms asked for are sums over shards.

Search: each task goes through its shards and merges, per item, the postings of the item's terms by a heap of cursors keyed
by document. A bounded heap keyed by score, then doc_id, holds the best so far; it stays from one shard of the task to the next.
Terms whose greatest contributions in the shard together stay below the worst score in a full heap can't bring in a document
alone: they leave the merge and are only looked up for documents that others bring (with ties kept, so results are exact). The tasks' heaps are merged by a ranked
window, which Spark cuts to ``k`` before its shuffle.

Items are a query set, asked in blocks of at most ``BLOCK_ITEMS`` items and about ``BLOCK_BYTES`` of text against all
shards of one stored index; a block, its terms and frequencies are what the driver holds.

Defined cases: a null text has no terms and counts for nothing; rows with a null or repeated doc_id are documents of
their own (null ranks last among equal scores); each row of ``items`` is a query of its own and keeps its item_id,
null and repeated ones too; an item without terms, or whose terms are nowhere, has no rows; scores of 0 are left out; extra columns
are ignored; without documents or items the result is empty.
"""

from __future__ import annotations

import heapq
import math
import re
from bisect import bisect_left
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.llm.common import as_bytes, checkpointed, map_rows

SHARD_DOCS = 8_192
SHARD_BYTES = 64 << 20
MOST_TERMS = 200_000
BLOCK_ITEMS = 4_096
BLOCK_BYTES = 16 << 20
TOP = 10
#: The terms of a lower-cased text in UTF-8: runs of ASCII letters and digits and of anything beyond ASCII.
_TERMS = re.compile(rb"[0-9a-z\x80-\xff]+")
INDEX = "n_docs long, n_terms long, ids array<long>, lengths binary, terms array<string>, dfs array<int>, ends array<int>, gaps binary, gap_ends array<int>, counts binary"


def terms_of(text: bytes) -> list[bytes]:
    return _TERMS.findall(text.lower())  # of bytes, lower() changes A-Z alone


# -- variable-length integers ---------------------------------------------------------------


def pack(values: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Seven bits a byte, the last byte of a number without its top bit; and where each number ends."""
    values = values.astype(np.uint64)
    size = np.ones(len(values), np.int64)
    for bits in range(7, 64, 7):
        size += values >= np.uint64(1 << bits)
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(size.max()) if len(size) else 0):
        has = size > k
        out[ends[has] - size[has] + k] = (values[has] >> np.uint64(7 * k) & np.uint64(127)).astype(np.uint8) | ((size[has] > k + 1) * 128).astype(np.uint8)
    return out.tobytes(), ends


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    last = np.flatnonzero(raw < 128)
    first = np.concatenate([[0], last[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(first, last - first + 1)
    parts = (raw & 127).astype(np.uint64) << (7 * place).astype(np.uint64)
    return np.add.reduceat(parts, first).astype(np.int64)


# -- index ----------------------------------------------------------------------------------


class _Shard:
    """Documents of a task, until they are many enough."""

    def __init__(self, wanted: dict[bytes, int] | None):
        self.wanted = wanted
        self.ids: list = []
        self.lengths: list[int] = []
        self.codes: list[np.ndarray] = []
        self.names: dict[bytes, int] = {} if wanted is None else wanted
        self.bytes = 0

    def add(self, doc_id, text: bytes) -> None:
        terms = terms_of(text)
        self.ids.append(doc_id)
        self.lengths.append(len(terms))
        if self.wanted is None:
            codes = [self.names.setdefault(t, len(self.names)) for t in terms]
        else:
            codes = [c for c in map(self.names.get, terms) if c is not None]
        self.codes.append(np.array(codes, np.int64))
        self.bytes += len(text)

    def full(self) -> bool:
        return len(self.ids) >= SHARD_DOCS or self.bytes >= SHARD_BYTES

    def row(self) -> dict:
        n = len(self.ids)
        order = sorted(range(n), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        sizes = [len(c) for c in self.codes]
        pairs, counts = np.unique(np.concatenate(self.codes) * n + np.repeat(place, sizes), return_counts=True)
        code, doc = pairs // n, pairs % n
        start = np.flatnonzero(np.diff(code, prepend=-1))
        gaps = np.diff(doc, prepend=0)
        gaps[start] = doc[start]
        gap_bytes, gap_ends = pack(gaps)
        count_bytes, count_ends = pack(counts)
        stop = np.append(start[1:], len(code)) - 1 if len(start) else start
        names = list(self.names)
        return {
            "n_docs": [sum(x > 0 for x in self.lengths)],
            "n_terms": [sum(self.lengths)],
            "ids": [[self.ids[i] for i in order]],
            "lengths": [pack(np.array(self.lengths, np.int64)[order])[0]],
            "terms": [[names[c].decode() for c in code[start]]],
            "dfs": [(stop - start + 1).tolist()],
            "ends": [count_ends[stop].tolist()],
            "gaps": [gap_bytes],
            "gap_ends": [gap_ends[stop].tolist()],
            "counts": [count_bytes],
        }


def build_index(docs: DataFrame, terms: list[bytes] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The shards of ``docs``, stored: all terms, or the given ones alone."""
    shared = docs.sparkSession.sparkContext.broadcast(None if terms is None else {t: i for i, t in enumerate(terms)})

    def build(batches):
        shard = _Shard(shared.value)
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), as_bytes(batch["text"]), strict=True):
                shard.add(doc_id, text)
                if shard.full():
                    yield shard.row()
                    shard = _Shard(shared.value)
        if shard.ids:
            yield shard.row()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    return checkpointed(map_rows(rows, build, INDEX))


# -- search ---------------------------------------------------------------------------------


class _Best:
    """The ``k`` best (score, -doc_id) of an item."""

    def __init__(self, k: int):
        self.k, self.heap = k, []

    def least(self) -> int:
        """The score that a document must reach; 1 until there are ``k``."""
        return self.heap[0][0] if len(self.heap) == self.k else 1

    def offer(self, score: int, minus_id: float) -> bool:
        if len(self.heap) < self.k:
            heapq.heappush(self.heap, (score, minus_id))
            return len(self.heap) == self.k
        if (score, minus_id) <= self.heap[0]:
            return False
        heapq.heapreplace(self.heap, (score, minus_id))
        return True


def merge(lists: list[tuple[list[int], list[int], int]], minus_ids: list, best: _Best) -> None:
    """Offers the documents of ``(documents, contributions, greatest contribution)`` lists, a document at a time."""
    lists = sorted(lists, key=lambda x: x[2])  # the first ones can do without a cursor
    reach, total = [], 0
    for own in lists:
        total += own[2]
        reach.append(total)  # what a document that only these lists have can get at most
    least = best.least()
    if total < least:
        return
    first = bisect_left(reach, least)
    cursors = [(lists[i][0][0], i, 0) for i in range(first, len(lists))]
    heapq.heapify(cursors)
    while cursors:
        doc, score = cursors[0][0], 0
        while cursors and cursors[0][0] == doc:
            _, i, at = cursors[0]
            docs, gains, _ = lists[i]
            score += gains[at]
            at += 1
            if at < len(docs):
                heapq.heapreplace(cursors, (docs[at], i, at))
            else:
                heapq.heappop(cursors)
        for i in range(first - 1, -1, -1):
            if score + reach[i] < least:
                break
            docs, gains, _ = lists[i]
            at = bisect_left(docs, doc)
            if at < len(docs) and docs[at] == doc:
                score += gains[at]
        if score >= least and best.offer(score, minus_ids[doc]):
            least = best.least()
            if total < least:
                return
            higher = bisect_left(reach, least)
            if higher > first:
                first = higher
                cursors = [c for c in cursors if c[1] >= first]
                heapq.heapify(cursors)


def contributions(tf: np.ndarray, m: np.ndarray, weight: int) -> np.ndarray:
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def norms(lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    """Each document's m; in Python's integers where 64 bits could be too few on the way."""
    if len(lengths) and 75 * int(lengths.max()) * n >= 1 << 63:
        return np.array([25 + 75 * x * n // total for x in lengths.tolist()], np.int64)
    return 25 + 75 * lengths * n // total


def _statistics(index: DataFrame, terms: list[bytes]) -> tuple[int, int, dict[bytes, int]]:
    """N, L and the document frequency of each of the terms."""
    spark = index.sparkSession
    sums = index.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()
    wanted = spark.createDataFrame([(t.decode(),) for t in terms], "term string")
    each = index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("p")).select(F.col("p.terms").alias("term"), F.col("p.dfs").alias("df"))
    found = each.join(F.broadcast(wanted), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    return sums["n"] or 0, sums["l"] or 0, {r["term"].encode(): r["df"] for r in found.collect()}


def search(index: DataFrame, items: list[tuple], k: int = TOP) -> DataFrame:
    """(item, item_id, rank, doc_id, score) of the k best documents of each (item_id, text); ``item`` is its place in the block."""
    spark = index.sparkSession
    asked = [Counter(terms_of((text or "").encode())) for _, text in items]
    terms = sorted(set().union(*asked)) if asked else []
    n, total, df = _statistics(index, terms) if terms else (0, 0, {})
    weights = {t.decode(): math.floor(1000 * math.log((2 * n + 2) / (2 * c + 1))) for t, c in df.items()}
    shared = spark.sparkContext.broadcast((weights, [[(t.decode(), q) for t, q in a.items() if t in df] for a in asked], [i for i, _ in items]))

    def run(batches):
        weight, queries, item_ids = shared.value
        best = [_Best(k) for _ in queries]
        for batch in batches:
            for row in zip(*[batch[c].to_pylist() for c in ("ids", "lengths", "terms", "dfs", "ends", "gaps", "gap_ends", "counts")], strict=True):
                ids, lengths, names, dfs, ends, gaps, gap_ends, counts = row
                m = norms(unpack(lengths), n, total)
                minus = [-math.inf if i is None else -i for i in ids]
                lists: dict[str, tuple[list[int], list[int], int]] = {}
                for j, name in enumerate(names):
                    w = weight.get(name, 0)
                    if w:
                        docs = np.cumsum(unpack(gaps[gap_ends[j - 1] if j else 0 : gap_ends[j]]))
                        gains = contributions(unpack(counts[ends[j - 1] if j else 0 : ends[j]]), m[docs], w)
                        lists[name] = docs.tolist(), gains.tolist(), int(gains.max())
                for query, top in zip(queries, best, strict=True):
                    own = []
                    for name, q in query:
                        if name in lists:
                            docs, gains, most = lists[name]
                            own.append((docs, gains, most) if q == 1 else (docs, [q * g for g in gains], q * most))
                    if own:
                        merge(own, minus, top)
        found = [(i, item_ids[i], None if minus == -math.inf else -minus, score) for i, top in enumerate(best) for score, minus in top.heap]
        yield {c: [r[i] for r in found] for i, c in enumerate(("item", "item_id", "doc_id", "score"))}

    rows = map_rows(index.drop("n_docs", "n_terms"), run, "item long, item_id long, doc_id long, score long", batch_rows=1)
    ranked = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("item", "item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = TOP, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each row of ``items``."""
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    blocks = max(1, -(-size["n"] // BLOCK_ITEMS), -(-size["b"] // BLOCK_BYTES))
    index, out = None, None
    for i in range(blocks):
        block = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i)
        rows = [(r["item_id"], r["text"]) for r in block.collect()]
        if index is None:
            terms = sorted({t for _, text in rows for t in terms_of(text.encode())}) if blocks == 1 else None
            index = build_index(docs, terms if terms is not None and len(terms) <= MOST_TERMS else None)
        one = search(index, rows, k).select("item_id", "rank", "doc_id", "score")
        out = one if out is None else out.union(one)
    return out


#: DuckDB's SQL for the query's rows.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents),
s AS (SELECT count(*) FILTER (len(t) > 0) AS n, sum(len(t))::BIGINT AS l FROM d),
tf AS (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM d),
c AS (SELECT doc_id, dl, term, count(*) AS tf FROM tf GROUP BY ALL),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
qc AS (SELECT item_id, term, count(*) AS q FROM q GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM c, s WHERE term IN (SELECT term FROM qc) GROUP BY term),
g AS (
  SELECT item_id, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * dl * n) // l))))::BIGINT AS score
  FROM qc JOIN w USING (term) JOIN c USING (term), s GROUP BY item_id, doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM g WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 10
"""
