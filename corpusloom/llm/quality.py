"""Quality classifier: hashed word n-gram logistic regression trained by FTRL (operator 8).

Words, runs of punctuation and their shapes (lower, capitalised, upper, mixed, number) give unigrams
and bigrams, hashed into 2**18 slots; values are 1 + log(count), scaled to unit length. Training
follows the regularised leader (FTRL-proximal, per-coordinate rates, L1 and L2) over
at most ``TRAIN_ROWS`` labelled documents, those with the least hash of their doc_id, in one task;
the model is 1 MB of weights, broadcast. Every document is scored as a sparse dot product
where it stands, without a shuffle. Labels are read only where crc32(doc_id as text) mod 5 is not 0;
labels, lang, source and doc_id are never inputs of a score.

Defined cases: a null text counts as empty and gets the score of the bias; a null doc_id is never
trained on and counts as held out = false; repeated rows get equal scores; labels without a
document or a value are ignored, of several labels of one doc_id the greatest counts, of several texts the one with the greatest hash; with no usable labels every score is 0.5; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import map_rows, release, text_of

BITS = 18
TRAIN_ROWS = 8_000
CACHE_ROWS = 60_000
EPOCHS = 3
THRESHOLD = 0.3
FOLDS = 5
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.5
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_MASK = (1 << BITS) - 1
_TWICE = zlib.crc32(b"\x01twice")  # the bigram of any word with itself
_cache: dict[str, tuple[int, int]] = {}


def _shape(token: str) -> str:
    if token.isalpha():
        if token.islower():
            return "a"
        if token.isupper():
            return "A" if len(token) > 1 else "I"
        return "Aa" if token[1:].islower() else "aA"
    return "0" if token.isdigit() else token if not token[0].isalnum() else "a0"


def _hashes(token: str) -> tuple[int, int]:
    got = _cache.get(token)
    if got is None:
        if len(_cache) > CACHE_ROWS:
            _cache.clear()
        got = _cache[token] = (zlib.crc32(token.encode()), zlib.crc32(("\x00" + _shape(token)).encode()))
    return got


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(slots, values) of a text's hashed n-grams; unit length unless empty."""
    tokens = _TOKEN.findall(text)
    if not tokens:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    both = np.array([_hashes(t) for t in tokens], np.uint64).T
    words, shapes = both[0], both[1]
    mixed = lambda x: (x[:-1] * np.uint64(0x9E3779B1) + x[1:] * np.uint64(0x85EBCA77)) >> np.uint64(13)
    twice = words[1:][words[1:] == words[:-1]] * np.uint64(0) + np.uint64(_TWICE)
    grams = np.concatenate([words, shapes, mixed(words), mixed(shapes), twice]) & np.uint64(_MASK)
    slots, counts = np.unique(grams.astype(np.int32), return_counts=True)
    values = 1 + np.log(counts)
    return slots, (values / math.sqrt(float(values @ values))).astype(np.float32)


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> np.ndarray:
    """FTRL-proximal weights; the last one is the bias."""
    z, n = np.zeros(_MASK + 2), np.zeros(_MASK + 2)
    bias = np.array([_MASK + 1])

    def weights(at: np.ndarray) -> np.ndarray:
        zs = z[at]
        l1 = np.where(at == _MASK + 1, 0.0, L1)
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    labels = [label for *_, label in examples]
    share = [max(1, labels.count(c)) for c in (0, 1)]
    balance = [len(labels) / (2 * n) for n in share]  # both labels count alike
    for _ in range(epochs):
        for slots, values, label in examples:
            at, x = np.concatenate([slots, bias]), np.concatenate([values, [1.0]])
            w = weights(at)
            g = balance[label] * (1 / (1 + math.exp(-max(-35.0, min(35.0, float(w @ x))))) - label) * x
            old = n[at]
            n[at] = old + g * g
            z[at] += g - (np.sqrt(n[at]) - np.sqrt(old)) / ALPHA * w
    return weights(np.arange(_MASK + 2)).astype(np.float32)


def score_text(text: str, model: np.ndarray) -> float:
    slots, values = features(text)
    s = float(model[slots] @ values) + float(model[-1])
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, s))))


def held_out_rows(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Weights from the labelled documents outside the held-out fold."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out_rows("doc_id"))
    usable = usable.groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    order = F.xxhash64("doc_id")
    # At most ``rows`` rows of two numbers: the broadcast doesn't grow with the input.
    chosen = usable.orderBy(order, "doc_id").limit(rows)
    texts = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")
    # One text a doc_id, whichever order rows come in.
    texts = texts.groupBy("doc_id").agg(F.max_by("text", F.struct(F.xxhash64("text"), F.length("text"))).alias("text"), F.max("label").alias("label"))

    def learn(batches):
        examples = {}
        for batch in batches:
            for i, t, y in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), batch["label"].to_pylist(), strict=True):
                examples[zlib.crc32(str(i).encode()), i] = (*features(t), y)
        if examples:
            yield {"model": [train([examples[k] for k in sorted(examples)]).tobytes()]}

    got = map_rows(texts.repartition(1), learn, "model binary").collect()
    return np.frombuffer(got[0]["model"], np.float32) if got else np.zeros(_MASK + 2, np.float32)


def score(docs: DataFrame, model: np.ndarray, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of ``docs``."""
    weights = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            yield {"doc_id": batch["doc_id"], "score": [score_text(t, weights.value) for t in batch["text"].to_pylist()]}

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return map_rows(rows, run, "doc_id long, score double").select(
        "doc_id", held_out_rows().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, model: np.ndarray, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the model doesn't reject, with all their columns."""
    weights = docs.sparkSession.sparkContext.broadcast(model)

    def scored(texts):
        out = texts.map(lambda t: score_text(t or "", weights.value)).astype("float64")
        release()
        return out

    return docs.where(F.pandas_udf(scored, "double")(F.col(text_col)) >= threshold)
