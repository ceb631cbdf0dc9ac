"""Cross-tokenizer alignment as joins and windows (operator 11).

Token boundaries of two tokenizers A and B are put side by side per text, by byte offsets. The alignment is relational:
tokens are exploded with their places, a window sums their lengths to end offsets, a full outer
equi-join on (text, end) gives every offset at which a token of A or B ends, and running counts of the offsets that both
share number the groups. Between two neighbouring offsets lie one token of A and one of B, and no other interval has
this pair of occurrences, so the intervals are the links: each takes the next token that ends at or
behind it, by a window, where a range join in groups would look at all pairs of a group.

A corpus has far more words than different words, so this runs on the distinct segments of the texts, each with its count.
Segments are cut where both tokenizers end a token whatever stands around (``segments``; ``check_models`` proves it for B), so a
text's groups and links are those of its segments in order. Counts of id pairs are sums over links, weighted by the segments' counts; the best
count of each id of B is joined back, and both are summed per segment.

Documents then read off their segments' results: the ``HOT`` most frequent segments are broadcast (their size is bounded);
the others a text needs are joined by segment, collected per different text (a part of its own size), and joined to the
texts by hash. Copies share one list, and a text that many rows have is a skewed join that Spark splits.

Defined cases: texts that are null or empty, or that either tokenizer doesn't give back byte by byte (those with U+2581,
which B takes for a space), have no tokens: zeros and an empty digest, and they count for nothing; rows with null or repeated doc_ids
are rows of their own; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.llm.common import Stored, checkpointed, map_rows, setting, text_of

HOT = 200_000
HOT_CHARS = 200
COUNTED = 300_000
PAIRS = 500_000
NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_SPACE = r" \t\n\x0b\x0c"  # pieces of B hold a return behind other signs
_PLAIN = re.compile(rf"[\x00-\x0c\x0e-\x7f{_LETTERS}]*")
#: A cut stands between a letter and an ASCII character that is none, and before white space behind something else.
_SEGMENT = re.compile(rf"[{_SPACE}]+[^{_SPACE}{_LETTERS}]*[{_LETTERS}]*|[^{_SPACE}{_LETTERS}]+[{_LETTERS}]*|[{_LETTERS}]+")
_CUT = re.compile(rf"(?<=[{_LETTERS}])(?=[\x00-@\[-`{{-\x7f])|(?<=\S)(?=[{_SPACE}])")
_worker: dict = {}


def segments(text: str) -> list[str]:
    """The pieces of a text between sure cuts of both tokenizers; together they are the text."""
    return _SEGMENT.findall(text) if _PLAIN.fullmatch(text) else _CUT.split(text)


class Tokenizers:
    """A (byte-level BPE by ``tokenizers``) and B (BPE with byte fallback by ``sentencepiece``), with each id's bytes."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte_of = {c: i for i, c in enumerate(_byte_characters())}
        self.a_bytes = {i: bytes(byte_of[c] for c in piece) for piece, i in self.a.get_vocab(with_added_tokens=False).items()}
        self.b_bytes = {i: self._piece(i) for i in range(self.b.get_piece_size())}
        self.space = self.b.piece_to_id("▁")
        self.guard = self.b.encode("x")

    def _piece(self, i: int) -> bytes:
        if self.b.is_byte(i):
            return bytes([int(self.b.id_to_piece(i)[3:5], 16)])
        return b"" if self.b.is_control(i) or self.b.is_unknown(i) else self.b.id_to_piece(i).replace("▁", " ").encode()

    def encode(self, parts: list[str]) -> tuple[list[list[int]], list[list[int]], list[bool]]:
        """Ids of A, ids of B, and whether both give the segment back."""
        a = [e.ids for e in self.a.encode_batch_fast(parts, add_special_tokens=False)]
        # B puts a space first: that of the segment if it has one, else a letter that ends before anything a segment starts with.
        spaced = [p.startswith(" ") for p in parts]
        got = self.b.encode([p[1:] if s else "x" + p for p, s in zip(parts, spaced, strict=True)], num_threads=1)
        b = [(ids or [self.space]) if s else ids[len(self.guard) :] for ids, s in zip(got, spaced, strict=True)]
        raw = [p.encode() for p in parts]
        ok = [
            b"".join(map(self.a_bytes.__getitem__, x)) == r and b"".join(map(self.b_bytes.__getitem__, y)) == r
            for x, y, r in zip(a, b, raw, strict=True)
        ]
        return a, b, ok


def _byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it can be printed, else the next beyond U+00FF."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, beyond = [], 0x100
    for i in range(256):
        out.append(chr(i if i in shown else beyond))
        beyond += i not in shown
    return out


def tokenizers(a_path: str, b_path: str) -> Tokenizers:
    if _worker.get("paths") != (a_path, b_path):
        _worker.update(paths=(a_path, b_path), both=Tokenizers(a_path, b_path))
    return _worker["both"]


def check_models(a_path: str, b_path: str) -> None:
    """Raises if a piece of B could cross a cut, or if A doesn't split texts as the cuts suppose."""
    both = tokenizers(a_path, b_path)
    across = re.compile(rf"[{_LETTERS}](?:▁|[\x00-@\[-`{{-\x7f])|[^▁]▁|[^{_SPACE}][{_SPACE}]")
    for i in range(both.b.get_piece_size()):
        piece = both.b.id_to_piece(i)
        if not (both.b.is_byte(i) or both.b.is_control(i) or both.b.is_unknown(i)) and across.search(piece):
            raise ValueError(f"piece {piece!r} crosses a cut")
    split = [at for _, at in both.a.pre_tokenizer.pre_tokenize_str(" a1,b\n c  d's")]
    if split != [(0, 2), (2, 3), (3, 4), (4, 5), (5, 6), (6, 8), (8, 9), (9, 11), (11, 13)]:
        raise ValueError(f"the first tokenizer splits texts into {split}")


# -- segments and their tokens -------------------------------------------------------------


def _usable(text: str) -> bool:
    return bool(text) and "▁" not in text


def count_segments(docs: DataFrame, skip=None, sign: int = 1) -> DataFrame:
    """(seg, n) of ``docs(text)``, summed in each task first. With ``skip`` (a broadcast set) only texts that have one of these."""

    def count(batches):
        seen: Counter = Counter()
        for batch in batches:
            for text in batch["text"].to_pylist():
                if _usable(text):
                    parts = segments(" " + text)
                    if skip is None or not skip.value.isdisjoint(parts):
                        seen.update(parts)
                if len(seen) > COUNTED:
                    yield {"seg": list(seen), "n": [sign * n for n in seen.values()]}
                    seen = Counter()
        yield {"seg": list(seen), "n": [sign * n for n in seen.values()]}

    return map_rows(docs, count, "seg string, n long")


def encoded_segments(docs: DataFrame, a_path: str, b_path: str) -> Stored:
    """(seg, n, ok, h1, h2, a, b): the distinct segments of usable texts, their counts and tokens; (h1, h2) stands for the segment."""

    def encode(batches):
        both = tokenizers(a_path, b_path)
        for batch in batches:
            a, b, ok = both.encode(batch["seg"].to_pylist())
            yield {"seg": batch["seg"], "n": batch["n"], "ok": ok, "a": a, "b": b}

    counts = count_segments(docs).groupBy("seg").agg(F.sum("n").alias("n"))
    found = Stored(map_rows(counts, encode, "seg string, n long, ok boolean, a array<int>, b array<int>"), "segments")
    bad = found.rows.where("NOT ok").select("seg")
    if bad.isEmpty():
        return found
    # Texts that hold a segment that doesn't come back count for nothing: their segments are taken off again.
    lost = docs.sparkSession.sparkContext.broadcast(frozenset(r["seg"] for r in bad.toLocalIterator()))
    less = count_segments(docs, lost, -1).groupBy("seg").agg(F.sum("n").alias("less"))
    left = found.rows.join(less, "seg", "left").withColumn("n", F.col("n") + F.coalesce("less", F.lit(0))).drop("less")
    out = Stored(left, "segments")
    found.remove()
    return out


def _tokens(rows: DataFrame, ids: str, lengths: DataFrame) -> DataFrame:
    """(h1, h2, end, <ids>_id): each token with the offset at which it ends."""
    each = rows.select("h1", "h2", F.posexplode(ids).alias("pos", "id")).join(F.broadcast(lengths), "id")
    end = F.sum("length").over(W.partitionBy("h1", "h2").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    return each.select("h1", "h2", end.alias("end"), F.col("id").alias(f"{ids}_id"))


def _lengths(spark: SparkSession, of: dict[int, bytes]) -> DataFrame:
    """(id, length): bounded by the vocabulary."""
    return spark.createDataFrame([(i, len(b)) for i, b in of.items()], "id int, length int")


def aligned_segments(segs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(seg, n, ok, n_a, n_b, n_groups, n_links, groups, link_a, link_b): each distinct segment's groups, and the id pairs of its links."""
    spark, both = segs.sparkSession, tokenizers(a_path, b_path)
    key = ["h1", "h2"]
    hashed = segs.withColumns({"h1": F.xxhash64("seg"), "h2": F.xxhash64(F.lit(1), "seg")}).repartition("h1")
    rows = hashed.where("ok")
    cuts = _tokens(rows, "a", _lengths(spark, both.a_bytes)).join(_tokens(rows, "b", _lengths(spark, both.b_bytes)), [*key, "end"], "full_outer")
    # From the end backwards, a running last value is the next token that ends at or behind a cut.
    back = W.partitionBy(*key).orderBy(F.desc("end")).rowsBetween(W.unboundedPreceding, 0)
    shared = (F.col("a_id").isNotNull() & F.col("b_id").isNotNull()).cast("int")
    links = cuts.select(
        *key, "end", "a_id", "b_id", F.last("a_id", ignorenulls=True).over(back).alias("a"), F.last("b_id", ignorenulls=True).over(back).alias("b"), F.sum(shared).over(back).alias("from_end")
    )
    listed = lambda ids: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(ids).isNotNull(), F.struct("end", ids)))), lambda x: x[ids].cast("string")), ",")
    group = links.groupBy(*key, "from_end").agg(
        F.concat(listed("a_id"), F.lit("|"), listed("b_id")).alias("ids"), F.count("a_id").alias("n_a"), F.count("b_id").alias("n_b"), F.collect_list("a").alias("link_a"), F.collect_list("b").alias("link_b")
    )
    in_order = F.array_sort(F.collect_list(F.struct((-F.col("from_end")).alias("at"), "ids", "link_a", "link_b")))
    whole = group.groupBy(*key).agg(F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"), in_order.alias("g"))
    of_segment = whole.select(
        *key, "n_a", "n_b", F.size("g").cast("long").alias("n_groups"),
        F.array_join(F.transform("g", lambda x: x["ids"]), ";").alias("groups"),
        F.flatten(F.transform("g", lambda x: x["link_a"])).alias("link_a"), F.flatten(F.transform("g", lambda x: x["link_b"])).alias("link_b"),
    )
    out = hashed.select("seg", "n", "ok", *key).join(of_segment, key, "left")
    return out.select("seg", "n", "ok", "n_a", "n_b", "n_groups", F.size("link_a").cast("long").alias("n_links"), "groups", "link_a", "link_b")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, count, best): links corpus-wide of each id pair, and whether no pair of the same id of B has more."""
    each = aligned.select("n", F.explode(F.arrays_zip("link_a", "link_b")).alias("l")).select("n", F.col("l.link_a").alias("a"), F.col("l.link_b").alias("b"))
    counts = each.groupBy("a", "b").agg(F.sum("n").alias("count")).where("count > 0")
    top = counts.groupBy("b").agg(F.max("count").alias("top"))
    return counts.join(top, "b").select("a", "b", "count", (F.col("count") == F.col("top")).cast("long").alias("best"))


def segment_results(docs: DataFrame, a_path: str, b_path: str) -> Stored:
    """(seg, n, ok, groups) and ``NUMBERS`` of the distinct segments of ``docs(text)``."""
    spark = docs.sparkSession
    segs = encoded_segments(docs, a_path, b_path)
    # Tokens, cuts and the join of both tokenizers' ends are dealt by segment once.
    with setting(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false"):
        aligned = Stored(aligned_segments(segs.rows, a_path, b_path), "aligned")
    segs.remove()
    pairs = checkpointed(pair_counts(aligned.rows))
    own = pairs.withColumnsRenamed({"a": "link_a", "b": "link_b"})
    own = F.broadcast(own) if pairs.count() <= PAIRS else own
    each = aligned.rows.select("seg", F.explode(F.arrays_zip("link_a", "link_b")).alias("l")).select("seg", "l.*").join(own, ["link_a", "link_b"])
    sums = each.groupBy("seg").agg(F.sum("best").alias("n_best"), F.sum("count").alias("count_sum"))
    out = Stored(aligned.rows.drop("link_a", "link_b").join(sums, "seg", "left"), "segment-results")
    aligned.remove()
    return out


# -- documents ---------------------------------------------------------------------------------


def _text_key() -> list[Column]:
    return [F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2")]


def _frequent(results: DataFrame):
    """The broadcast of the most frequent segments: places, numbers (the last is 1 where tokens don't come back) and groups."""
    rows = results.where(F.length("seg") + F.coalesce(F.length("groups"), F.lit(0)) <= HOT_CHARS).orderBy(F.desc("n"), "seg").limit(HOT)
    got = rows.select("seg", "groups", _packed()).toArrow()
    numbers = np.array(got["numbers"].to_pylist(), np.int64).reshape(len(got), len(NUMBERS) + 1)
    return results.sparkSession.sparkContext.broadcast(({s: i for i, s in enumerate(got["seg"].to_pylist())}, numbers, got["groups"].to_pylist()))


def _packed() -> Column:
    return F.array(*[F.coalesce(F.col(c), F.lit(0)) for c in NUMBERS], F.when(F.col("ok"), 0).otherwise(1).cast("long")).alias("numbers")


def _missing(docs: DataFrame, results: DataFrame, hot) -> DataFrame:
    """(t1, t2, seg, groups, numbers): per different text its segments that aren't broadcast with their groups, and the sum of their numbers."""

    def miss(batches):
        for batch in batches:
            known = hot.value[0]
            lists = [Counter(s for s in segments(" " + t) if s not in known) if _usable(t) else {} for t in batch["text"].to_pylist()]
            some = pa.array([bool(x) for x in lists], pa.bool_())
            lists = [x for x in lists if x]
            yield {"t1": batch["t1"].filter(some), "t2": batch["t2"].filter(some), "segs": [list(x) for x in lists], "times": [list(x.values()) for x in lists]}

    found = map_rows(docs.select(*_text_key(), "text"), miss, "t1 long, t2 long, segs array<string>, times array<int>").dropDuplicates(["t1", "t2"])
    each = found.select("t1", "t2", F.explode(F.arrays_zip("segs", "times")).alias("s")).select("t1", "t2", F.col("s.segs").alias("seg"), F.col("s.times").alias("times"))
    each = each.join(results.select("seg", "groups", _packed()), "seg")
    sums = [F.sum(F.col("times") * F.get("numbers", F.lit(i))).alias(f"s{i}") for i in range(len(NUMBERS) + 1)]
    lists = each.groupBy("t1", "t2").agg(F.collect_list(F.struct("seg", "groups")).alias("l"), *sums)
    return lists.select("t1", "t2", F.col("l.seg").alias("seg"), F.col("l.groups").alias("groups"), F.array(*[f"s{i}" for i in range(len(NUMBERS) + 1)]).alias("numbers"))


COLUMNS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


def alignments(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups), one row per row of ``docs``; ``digest``: groups as SHA-256."""
    check_models(a_path, b_path)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    results = segment_results(rows.select("text"), a_path, b_path)
    hot = _frequent(results.rows)
    joined = rows.select("doc_id", "text", *_text_key()).join(_missing(rows, results.rows, hot), ["t1", "t2"], "left")

    def assemble(batches):
        places, table, names = hot.value
        for batch in batches:
            out = {c: [] for c in (*NUMBERS, "groups")}
            for text, seg, own_names, numbers in zip(*[batch[c].to_pylist() for c in ("text", "seg", "groups", "numbers")], strict=True):
                total, joined_ids = np.zeros(len(NUMBERS) + 1, np.int64), ""
                if _usable(text):
                    parts = segments(" " + text)
                    at = list(map(places.get, parts))
                    if None in at:
                        mine = dict(zip(seg, own_names, strict=True))
                        total = table[np.array([i for i in at if i is not None], np.int64)].sum(0) + np.array(numbers, np.int64)
                        strings = [mine[s] if i is None else names[i] for i, s in zip(at, parts, strict=True)]
                    else:
                        total = table[at].sum(0)
                        strings = [names[i] for i in at]
                    if total[-1]:  # a segment that doesn't come back
                        total[:] = 0
                    else:
                        joined_ids = ";".join(strings)
                for c, v in zip(NUMBERS, total[:-1].tolist(), strict=True):
                    out[c].append(v)
                out["groups"].append(hashlib.sha256(joined_ids.encode()).hexdigest() if digest and joined_ids else joined_ids)
            yield {"doc_id": batch["doc_id"], **out}

    return map_rows(joined.drop("t1", "t2"), assemble, COLUMNS, batch_rows=500)


def alignment_digests(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """The query's columns: groups as their SHA-256, empty without tokens."""
    out = alignments(docs, a_path, b_path, digest=True)
    return checkpointed(out.withColumnRenamed("groups", "groups_sha256"))
