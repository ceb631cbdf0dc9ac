"""Corpus metrics as mergeable aggregates: BLEU, chrF++, their geometric mean, output health.

Each row is turned into a vector of counts once; any grouping of rows (a bucket, a weight vector, a
grid cell, one row) is then a sum of vectors and a closed form, in SQL alone.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import measures as M
from corpusloom.functions import text as T

ORDERS, CHAR_ORDERS, WORD_ORDERS = 4, 6, 2
#: hypothesis length, reference length, BLEU matches and totals, then chrF (hypothesis, reference, match) by order.
WIDTH = 2 + 2 * ORDERS + 3 * (CHAR_ORDERS + WORD_ORDERS)
SIGNATURE = "bleu:nrefs:1|tok:13a|smooth:exp|eff:no;chrf:nc:6|nw:2|beta:2|space:no|eff:yes"

#: The published mteval v13a replacements and patterns.
_UNESCAPE = (("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))
_SPLIT = (
    (re.compile(r"([\{-\~\[-\` -\&\(-\+\:-\@\/])"), r" \1 "),
    (re.compile(r"([^0-9])([\.,])"), r"\1 \2 "),
    (re.compile(r"([\.,])([^0-9])"), r" \1 \2"),
    (re.compile(r"([0-9])(-)"), r"\1 \2 "),
)
#: The marks that a word is split from.
_PUNCTUATION = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def tokenize_13a(text: str) -> list[str]:
    """The mteval v13a tokeniser."""
    for old, new in _UNESCAPE:
        text = text.replace(old, new)
    text = f" {text} "
    for pattern, to in _SPLIT:
        text = pattern.sub(to, text)
    return text.split()


def chrf_words(text: str) -> list[str]:
    """Words with one mark at their end or start split off."""
    out: list[str] = []
    for word in text.split():
        if len(word) > 1 and word[-1] in _PUNCTUATION:
            out += [word[:-1], word[-1]]
        elif len(word) > 1 and word[0] in _PUNCTUATION:
            out += [word[0], word[1:]]
        else:
            out.append(word)
    return out


_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Rows that are counted at once: their number, and the hash of an n-gram, share 63 bits; and characters, for memory.
_ROWS, _CHARS = 1 << 11, 1 << 20


class _Side:
    """Sequences of many rows, one behind the other, as numbers; ``grow`` makes their n-grams one longer."""

    def __init__(self, sequences: list[np.ndarray]):
        sizes = [len(s) for s in sequences]
        self.row = np.repeat(np.arange(len(sizes)), sizes)
        self.first = np.concatenate([np.empty(0, np.uint64), *sequences]).astype(np.uint64) * _MIX
        self.gram, self.n = self.first, 1

    def grow(self) -> None:
        """An n-gram is its 64-bit hash; those that would reach into the next row go."""
        self.n += 1
        k = max(0, len(self.first) - self.n + 1)
        gram = ((self.gram[:k] ^ (self.gram[:k] >> np.uint64(29))) * _STEP) + self.first[self.n - 1 :]
        self.gram = gram
        self.whole = self.row[:k] == self.row[self.n - 1 :]

    def keys(self, side: int) -> np.ndarray:
        """Row, hash and side in one number, for each n-gram."""
        row, gram = (self.row, self.gram) if self.n == 1 else (self.row[: len(self.gram)][self.whole], self.gram[self.whole])
        mixed = (gram ^ (gram >> np.uint64(31))) * _MIX
        return row.astype(np.uint64) << np.uint64(53) | mixed >> np.uint64(12) << np.uint64(1) | np.uint64(side)


def _orders(hypotheses: list[np.ndarray], references: list[np.ndarray], orders: int):
    """Per order and row: n-grams of the hypothesis, of the reference, in both (as multisets)."""
    rows, (a, b) = len(hypotheses), (_Side(hypotheses), _Side(references))
    of_row = lambda keys, weights=None: np.bincount((keys >> np.uint64(53)).astype(np.int64), weights, minlength=rows).astype(np.int64)
    for n in range(orders):
        if n:
            a.grow()
            b.grow()
        x, y = a.keys(0), b.keys(1)
        both = np.sort(np.concatenate([x, y]))
        gram = both >> np.uint64(1)
        starts = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else np.empty(0, np.int64)
        theirs = np.add.reduceat((both & np.uint64(1)).astype(np.int64), starts) if len(gram) else starts
        total = np.diff(np.append(starts, len(both)))
        yield of_row(x), of_row(y), of_row(both[starts], np.minimum(theirs, total - theirs))


def _numbered(*sides: list[list[str]]) -> list[list[np.ndarray]]:
    ids: dict[str, int] = {}
    return [[np.array([ids.setdefault(w, len(ids) + 1) for w in text], np.uint64) for text in side] for side in sides]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer("".join(text.split()).encode("utf-32-le", "surrogatepass"), "<u4")


def batch_statistics(hypotheses: list[str], references: list[str]) -> np.ndarray:
    """The counts of each row, ``WIDTH`` of them."""
    hyp, ref = ([tokenize_13a(t) for t in side] for side in (hypotheses, references))
    own = list(_orders(*_numbered(hyp, ref), ORDERS))
    out = [[len(t) for t in hyp], [len(t) for t in ref], *[m for *_, m in own], *[n for n, *_ in own]]
    for counts in _orders([_codes(t) for t in hypotheses], [_codes(t) for t in references], CHAR_ORDERS):
        out += counts
    words = _numbered([chrf_words(t) for t in hypotheses], [chrf_words(t) for t in references])
    for counts in _orders(*words, WORD_ORDERS):
        out += counts
    return np.array(out, np.int64).T


def pair_statistics(hypothesis: str, reference: str) -> list[int]:
    return batch_statistics([hypothesis], [reference])[0].tolist()


def _statistics(hypotheses: pd.Series, references: pd.Series) -> pd.Series:
    """Equal pairs of a batch are counted once."""
    pairs: dict[tuple[str, str], int] = {}
    at = [pairs.setdefault((h or "", r or ""), len(pairs)) for h, r in zip(hypotheses, references, strict=True)]
    parts, held, size = [], [], 0
    for pair in pairs:
        if held and (len(held) == _ROWS or size + len(pair[0]) + len(pair[1]) > _CHARS):
            parts.append(batch_statistics(*map(list, zip(*held, strict=True))))
            held, size = [], 0
        held.append(pair)
        size += len(pair[0]) + len(pair[1])
    if held:
        parts.append(batch_statistics(*map(list, zip(*held, strict=True))))
    counts = np.concatenate(parts) if parts else np.empty((0, WIDTH), np.int64)
    return pd.Series(list(counts[at]))


def with_statistics(df: DataFrame, hypothesis: str, reference: str, name: str = "stats") -> DataFrame:
    return df.withColumn(name, F.pandas_udf(_statistics, "array<long>")(F.col(hypothesis), F.col(reference)))


def summed(name: str = "stats") -> list[Column]:
    return [F.sum(F.col(name)[i]).alias(f"_m{i}") for i in range(WIDTH)]


def bleu(m=lambda i: F.col(f"_m{i}")) -> Column:
    """Corpus BLEU from summed counts, exponentially smoothed."""
    log_sum, zeros, dead = F.lit(0.0), F.lit(0.0), F.lit(False)
    any_match = F.lit(False)
    for n in range(ORDERS):
        match, total = m(2 + n), m(2 + ORDERS + n)
        zeros = zeros + (match == 0).cast("double")
        precision = F.when(match > 0, match * 100.0 / total).otherwise(100.0 / (F.pow(F.lit(2.0), zeros) * total))
        log_sum = log_sum + F.when(total > 0, F.log(precision)).otherwise(0.0)
        dead, any_match = dead | (total == 0), any_match | (match > 0)
    brevity = F.when(m(0) < m(1), F.exp(1 - m(1) / m(0))).otherwise(1.0)
    return F.when(dead | ~any_match, 0.0).otherwise(brevity * F.exp(log_sum / ORDERS))


def chrf(m=lambda i: F.col(f"_m{i}"), beta: float = 2.0) -> Column:
    """chrF++: F-beta of the average precision and recall over the orders that both sides have."""
    precision, recall, orders = F.lit(0.0), F.lit(0.0), F.lit(0.0)
    for k in range(CHAR_ORDERS + WORD_ORDERS):
        at = 2 + 2 * ORDERS + 3 * k
        hyp, ref, match = m(at), m(at + 1), m(at + 2)
        both = (hyp > 0) & (ref > 0)
        precision = precision + F.when(both, match / hyp).otherwise(0.0)
        recall = recall + F.when(both, match / ref).otherwise(0.0)
        orders = orders + both.cast("double")
    p, r = precision / orders, recall / orders
    score = (1 + beta**2) * p * r / (beta**2 * p + r) * 100
    return F.when((orders > 0) & (p + r > 0), score).otherwise(0.0)


def geometric(a: Column, b: Column) -> Column:
    return F.sqrt(F.greatest(a, F.lit(0.0)) * F.greatest(b, F.lit(0.0)))


def corpus_scores(df: DataFrame, by: Sequence[str | Column] = (), name: str = "stats") -> DataFrame:
    """Per group: rows, BLEU, chrF++ and their geometric mean, from one pass."""
    sums = df.groupBy(*by).agg(F.count("*").alias("n_rows"), *summed(name))
    scored = sums.withColumn("bleu", bleu()).withColumn("chrfpp", chrf())
    return scored.withColumn("geom", geometric(F.col("bleu"), F.col("chrfpp"))).drop(*[f"_m{i}" for i in range(WIDTH)])


def row_scores(df: DataFrame, name: str = "stats") -> DataFrame:
    """Sentence scores of each row."""
    m = lambda i: F.col(name)[i]
    return df.withColumn("bleu", bleu(m)).withColumn("chrfpp", chrf(m)).withColumn("geom", geometric(F.col("bleu"), F.col("chrfpp")))


# -- health ------------------------------------------------------------------------------


def with_repeat_count(df: DataFrame, text: str, name: str) -> DataFrame:
    """How many rows have this row's text: an aggregate and a join, as a frequent text would be one window's work."""
    counts = df.groupBy(F.col(text).alias("_t")).agg(F.count("*").alias(name))
    return df.join(counts, F.col(text).eqNullSafe(F.col("_t"))).drop("_t")


def _by_text(df: DataFrame, text: Column, flags: dict[str, Column], ignore_empty: bool) -> DataFrame:
    """Means of the flags over rows, the share of rows whose text stands more than once, and of distinct texts, from one aggregation by text."""
    groups = df.groupBy(text.alias("_t")).agg(F.count("*").alias("_n"), *[F.sum(c.cast("double")).alias(k) for k, c in flags.items()])
    again = F.when((F.col("_n") > 1) & (F.lit(not ignore_empty) | (F.col("_t") != "")), F.col("_n")).otherwise(0)
    n = F.sum("_n")
    share = lambda c: F.try_divide(F.sum(c), n)
    means = [(share(k) * (1 if k.startswith("mean") else 100)).alias(k) for k in flags]
    return groups.agg(F.coalesce(n, F.lit(0)).alias("n_rows"), *means, (share(again) * 100).alias("repeat_pct"), F.try_divide(F.count("*") * 100.0, n).alias("unique_pct"))


def _pct(flag: Column) -> Column:
    return F.avg(flag.cast("double")) * 100


def health_by_chars(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """v1: empty, equal to the source, under half the reference's characters, unique, marks of a broken decoder."""
    p, s, r = F.col("prediction"), F.col("source"), F.col("reference")
    return df.groupBy(*by).agg(
        F.count("*").alias("n_rows"),
        _pct(T.strip(p) == "").alias("empty_pct"),
        _pct(T.strip(p) == T.strip(s)).alias("copy_pct"),
        _pct((F.length(r) > 0) & (F.length(p) < F.length(r) * 0.5)).alias("short_pct"),
        F.try_divide(F.count_distinct(p) * 100, F.count("*")).alias("unique_pct"),
        _pct(p.rlike(r"<extra_id_\d+>")).alias("bad_pct"),
        _pct(T.strip(p) == "<extra_id_0>").alias("only_mark_pct"),
    )


def health_by_words(df: DataFrame) -> DataFrame:
    """v2: lengths in words; a row is repeated if its text stands more than once, empty ones too."""
    p = F.col("prediction")
    w = df.withColumn("_pw", T.word_count(p)).withColumn("_rw", T.word_count(F.col("reference")))
    flags = {
        "empty_pct": F.col("_pw") == 0,
        "short_pct": F.col("_pw") < F.greatest(F.lit(1.0), F.col("_rw") / 2),
        "internal_repeat_pct": M.repeat_score(T.words(p)) > 0,
        "mean_pred_words": F.col("_pw"),
        "mean_ref_words": F.col("_rw"),
    }
    return _by_text(w, p, flags, ignore_empty=False).drop("unique_pct")


def health_nonempty(df: DataFrame) -> DataFrame:
    """v3: a copy needs a prediction, empty texts never count as repeated, short is in characters; with length statistics."""
    p, s, r = T.blank(F.col("prediction")), T.blank(F.col("source")), T.blank(F.col("reference"))
    rows = df.select(p.alias("p"), s.alias("s"), r.alias("r"), F.length(p).alias("pc"), F.length(r).alias("rc"), M.byte_tokens(p).alias("pt"), M.byte_tokens(r).alias("rt"))
    flags = {
        "empty_pct": T.strip(F.col("p")) == "",
        "copy_pct": (T.strip(F.col("p")) != "") & (T.strip(F.col("p")) == T.strip(F.col("s"))),
        "short_pct": (F.col("rc") > 0) & (F.col("pc") / F.col("rc") < 0.5),
        "internal_repeat_pct": M.repeat_score(T.words(F.col("p"))) > 0,
    }
    by_text = _by_text(rows, F.col("p"), flags, ignore_empty=True)
    zero = lambda c, name: F.coalesce(c, F.lit(0.0)).alias(name)
    lengths = rows.agg(
        zero(F.avg("pt"), "pred_tok_mean"),
        zero(F.avg("rt"), "ref_tok_mean"),
        *[zero(F.percentile(c, F.lit(0.95)), f"{name}_p95") for c, name in (("pt", "pred_tok"), ("rt", "ref_tok"), ("pc", "pred_char"), ("rc", "ref_char"))],
    )
    return by_text.crossJoin(lengths)


def top_repeated(df: DataFrame, column: str = "prediction", k: int = 10) -> DataFrame:
    """(text, count): of the k most frequent texts those that aren't empty; of equal counts the lesser text."""
    text = T.blank(F.col(column)).alias("text")
    return df.groupBy(text).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "text").limit(k).where("text <> ''")


def health_rounded(df: DataFrame) -> DataFrame:
    """v4: short is under max(1, half the reference's characters); shares rounded to 4 places."""
    p, s, r = F.col("prediction"), F.col("source"), F.col("reference")
    out = df.agg(
        F.count("*").alias("n_rows"),
        _pct(T.strip(p) == "").alias("empty_pct"),
        _pct(F.length(p) < F.greatest(F.lit(1.0), F.length(r) / 2)).alias("short_pct"),
        _pct((T.strip(p) == T.strip(s)) & (T.strip(p) != "")).alias("copy_pct"),
        F.try_divide(F.count_distinct(p) * 100, F.count("*")).alias("unique_pct"),
    )
    return out.select("n_rows", *[F.round(c, 4).alias(c) for c in out.columns if c != "n_rows"])


def health_rebuilt(parents: DataFrame) -> DataFrame:
    """v5: of rebuilt parents, on stripped lengths."""
    p, r = T.strip(F.col("prediction")), T.strip(F.col("reference"))
    return parents.agg(
        F.count("*").alias("n_rows"),
        _pct(p == "").alias("empty_pct"),
        _pct((F.length(r) > 0) & (F.length(p) / F.length(r) < 0.5)).alias("short_pct"),
        F.try_divide(F.count_distinct(p) * 100, F.count("*")).alias("unique_pct"),
    )


def top_values(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)
