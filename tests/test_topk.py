"""Blocked exact neighbours against all pairs."""

import numpy as np
import pytest

from corpusloom.operators import knn, topk


def ranked(scores, ids, k):
    order = np.lexsort((ids, -scores))[:k]
    return [(int(ids[i]), float(scores[i])) for i in order]


def sparse_rows(rng, n, words, hot=0.9):
    """Unit vectors with one term that nearly all have, a few common ones and rare ones; some repeated."""
    out = []
    for key in range(n):
        if out and rng.random() < 0.3:
            out.append((key, *out[rng.integers(len(out))][1:]))
            continue
        terms = np.unique(np.concatenate([[0] if rng.random() < hot else [], rng.zipf(1.4, rng.integers(1, 12)) % words]).astype(np.int64))
        w = rng.random(len(terms)) + 0.01
        out.append((key, terms.tolist(), (w / np.sqrt((w * w).sum())).tolist()))
    return out


def dot(a, b):
    of = dict(zip(*b, strict=True))
    return sum(w * of.get(t, 0.0) for t, w in zip(*a, strict=True))


@pytest.mark.parametrize("shard,block,broadcast", [(2048, 512, 64 << 20), (7, 5, 64 << 20), (16, 4, 0)])
def test_sparse_neighbours_are_those_of_all_pairs(spark, monkeypatch, shard, block, broadcast):
    monkeypatch.setattr(topk, "SHARD", shard)
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "BROADCAST_BYTES", broadcast)
    rows = sparse_rows(np.random.default_rng(4), 120, 60)
    kind = "key long, terms array<long>, weights array<double>"
    corpus, asked = spark.createDataFrame(rows, kind).repartition(3), spark.createDataFrame(rows[::4] + [(999, [777], [1.0])], kind)
    for same in (True, False):
        got = {}
        for r in topk.sparse_top_k(asked, corpus, 4, same).orderBy("query", "rank").collect():
            got.setdefault(r["query"], []).append((r["doc"], r["score"]))
        for key, *own in rows[::4]:
            scores = np.array([round(dot(own, other), topk.PLACES) for _, *other in rows])
            keep = np.array([s > 0 and not (same and i == key) for i, s in enumerate(scores)])
            want = ranked(scores[keep], np.flatnonzero(keep), 4)
            assert [d for d, _ in got[key]] == [d for d, _ in want]
            assert [s for _, s in got[key]] == pytest.approx([s for _, s in want], abs=2e-9)
        assert 999 not in got
    assert topk.sparse_top_k(asked.limit(0), corpus, 4).collect() == [] == topk.sparse_top_k(asked, corpus.limit(0), 4).collect()


def test_bounds_leave_out_most_pairs():
    """Texts in clusters, with terms that all share: candidates stay under 5 % of the rows of a join on the term."""
    rng = np.random.default_rng(0)
    rows = []
    for key in range(2000):
        cluster = key % 200
        rare = 1000 + cluster * 20 + rng.choice(20, 12, replace=False)
        terms = np.concatenate([np.arange(10), np.sort(rare)])
        w = np.concatenate([np.full(10, 0.2), rng.random(12) + 1])
        rows.append((key, terms, w / np.sqrt((w * w).sum())))
    starts = np.cumsum([0, *[len(t) for _, t, _ in rows]])
    packed = starts, np.concatenate([t for _, t, _ in rows]), np.concatenate([w for *_, w in rows])
    first, second = topk.SparseShard(np.arange(2000), *packed), topk.SparseShard(np.arange(5000, 7000), *packed)
    heaps = topk.Heaps(3)
    matrix = np.zeros((2000, 6000))
    for key, t, w in rows:
        matrix[key, t] = w
    for key, t, w in rows[:300]:
        first.search(key, t, w, heaps, True)
    for key, t, w in rows[:300]:  # with a score to beat, as in a task's later shards
        second.search(key, t, w, heaps, True)
    assert second.candidates < 0.05 * second.postings
    for key in range(300):
        scores = matrix @ matrix[key]
        both = np.sort(np.concatenate([np.delete(scores, key), scores]))[::-1]
        assert heaps.best[key][0] == pytest.approx(both[:3], abs=2e-9)


@pytest.mark.parametrize("shard,block", [(2048, 512), (7, 4)])
def test_dense_neighbours_with_norms_and_repeats(spark, monkeypatch, shard, block):
    monkeypatch.setattr(topk, "SHARD", shard)
    monkeypatch.setattr(topk, "BLOCK", block)
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(60, 8)).round(3) * rng.choice([0.01, 1, 10], size=(60, 1))
    vectors[30:40] = vectors[20]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + [(77, None)], "id long, v array<double>").repartition(3)
    asked = frame.where("id % 5 = 0")
    got = sorted((r.query, r["rank"], r.doc) for r in knn.dense_neighbours(asked, frame, "id", "v", 3).collect())
    for q in range(0, 60, 5):
        s = np.round(vectors @ vectors[q], topk.PLACES)
        want = [i for i in sorted(range(60), key=lambda i: (-s[i], i)) if i != q][:3]
        assert [d for a, _, d in got if a == q] == want


def test_dense_norms_leave_out_shards():
    heaps = topk.Heaps(2)
    q = np.eye(4)
    assert topk.dense_block(np.arange(4), 5 * np.eye(4) + 4, np.arange(100, 104), q, heaps, True) == 4
    assert topk.dense_block(np.arange(4, 8), np.eye(4), np.arange(100, 104), q, heaps, True) == 0


def test_the_plan_does_not_grow_with_the_queries(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 4)
    asked = lambda n: spark.range(n).selectExpr("id AS key", "array(double(id), 1.0D) AS vector")
    plans = [topk.dense_top_k(asked(n), asked(50), 2)._jdf.queryExecution().optimizedPlan().toString().count("\n") for n in (3, 4000)]
    assert plans[0] == plans[1]


def jaccard(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("least", [0.0, 0.5, 0.92])
@pytest.mark.parametrize("shard,block", [(2048, 512), (5, 3)])
def test_best_jaccard_is_that_of_all_pairs(spark, monkeypatch, shard, block, least):
    monkeypatch.setattr(topk, "SHARD", shard)
    monkeypatch.setattr(topk, "BLOCK", block)
    rng = np.random.default_rng(3)
    make = lambda: np.unique(np.concatenate([np.arange(6), 10 + rng.zipf(1.3, rng.integers(0, 25)) % 40])).tolist()
    left = [(str(rng.choice(["a", "b", "c"], p=[0.8, 0.15, 0.05])), i, make()) for i in range(90)]
    right = [(str(rng.choice(["a", "b", "d"])), make()) for _ in range(80)]
    right += [(b, t) for b, _, t in left[:5]]
    got = topk.best_jaccard(spark.createDataFrame(left, "block string, id long, terms array<long>"), spark.createDataFrame(right, "block string, terms array<long>"), least)
    want = {i: max([jaccard(t, u) for c, u in right if c == b], default=0) for b, i, t in left}
    assert {r.id: r.similarity for r in got.collect()} == {i: s for i, s in want.items() if s > 0 and s >= least}


def test_hot_block_of_equal_openings():
    """Sets that all share an opening: at 0.92 next to none of the pairs is looked at, and near copies are found."""
    rng = np.random.default_rng(0)
    opening = np.arange(21)
    make = lambda: np.concatenate([opening, 100 + rng.choice(1 << 40, 60, replace=False)])
    sets = [make() for _ in range(3000)]
    shard = topk.SetShard(sets)
    assert [shard.best(make(), 0.92) for _ in range(200)] == [0.0] * 200
    assert shard.candidates < 0.01 * 200 * 3000
    near = sets[7].copy()
    near[-2:] = [5 << 41, 6 << 41]
    assert shard.best(near, 0.92) == 79 / 83 and shard.best(near, 0.96) == 0.0
