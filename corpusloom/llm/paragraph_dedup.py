"""Substring deduplication by paragraph MinHash banding (operator 6).

Paragraphs are cut by content (``segments``), so a repeated passage has the same paragraphs inside,
whatever lines, words or documents stand around it. Each has ``BANDS`` keys of one MinHash
minimum over its five-word shingles: similar pairs share a key with a probability of 0.992 at
a similarity of 0.8, equal ones always. The different paragraphs of a key that occurs in
two documents are verified against each other by exact Jaccard similarity, and the verified links'
connected components are the classes. A class in two documents is repeated.

A run is a row of repeated paragraphs. Its ends grow outwards word by word as long as another document
goes on with the same words, so that a passage ends where its repetition ends and not at a cut. Runs that touch, or
leave out so few words that the whole would still be 0.8 similar (``SHARE`` of the words), are one
passage; passages of ``WORDS`` words or more are reported. The first occurrence of a class, by doc_id and then
place, stays; the others are removals.

The result has a row per stretch of a passage with one fate; documents without one don't appear.
``cleaned`` gives whole documents without the removed stretches.

Paragraphs have a 64-bit identity: it takes equal hashes in several neighbouring paragraphs to report a passage
that is none, as none has ``WORDS`` words alone.

Defined cases: a null text has no paragraphs; a null doc_id comes after all others (below 2^62), and its
document is known by its text; rows with the same doc_id are one document, of repeated rows (same text, too) the
first keeps what it has; passages that are repeated inside one document alone are none; extra columns
are ignored, and kept by ``cleaned``; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.llm.common import Presence, checkpointed, map_rows, shuffle_partitions, text_of
from corpusloom.llm.near_sets import classes, verified_links
from corpusloom.llm.segments import MOST, REACH, SHINGLE, Paragraphs, growth, mix, words

WORDS = 50
BANDS = 3
#: Of the words of a passage; what shares this part of its shingles with a text of its size has a similarity of 0.8.
SHARE = 8 / 9
GROUP = 1_000
UNNAMED = 1 << 62
#: Paragraphs of a task that are combined before they are shuffled.
COMBINED = 300_000


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(own, row, text): ``own`` is the doc_id, or made from the text and above ``UNNAMED`` where it is null; ``row`` is of the text."""
    text, doc_id = text_of(text_col), F.col(id_col).cast("long")
    row = F.xxhash64(text)
    own = F.coalesce(doc_id, row.bitwiseAND(F.lit(UNNAMED - 1)).bitwiseOR(F.lit(UNNAMED)))
    return docs.select(own.alias("own"), row.alias("row"), text.alias("text"))


def _doc_id(own: str):
    return F.when(F.col(own) < UNNAMED, F.col(own))


def _paragraphs(column, least: int):
    for part in words(column):
        found = Paragraphs(part, least)
        if not found.empty:
            yield found


def band_rows(texts: DataFrame, least: int) -> DataFrame:
    """(key, id, lo, hi): the band keys of each paragraph with the least and greatest document, combined map-side."""

    def cut(batches):
        held: list[tuple] = []

        def combined() -> dict:
            if not held:
                return {"key": [], "id": [], "lo": [], "hi": []}
            ids, keys, own = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((own, ids))
            ids, own = ids[order], own[order]
            first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            last = np.concatenate([first[1:], [len(ids)]]) - 1
            one = [np.repeat(x, BANDS) for x in (ids[first].view(np.int64), own[first], own[last])]
            return {"key": keys[order][first].reshape(-1).view(np.int64), "id": one[0], "lo": one[1], "hi": one[2]}

        for batch in batches:
            own = batch["own"].to_numpy()
            for p in _paragraphs(batch["text"], least):
                held.append((p.id, p.band_keys(BANDS), own[p.doc]))
                if sum(len(x[0]) for x in held) > COMBINED:
                    yield combined()
        yield combined()

    return map_rows(texts.select("own", "text"), cut, "key long, id long, lo long, hi long")


def _tokens(texts: DataFrame, ids: DataFrame, least: int) -> DataFrame:
    """(id, tokens) of the paragraphs named by ``ids``: their distinct shingles, read again from the texts."""
    ids = checkpointed(ids)
    wanted = Presence(ids, "id")

    def cut(batches):
        seen: set[int] = set()
        for batch in batches:
            out: dict[str, list] = {"id": [], "tokens": []}
            for p in _paragraphs(batch["text"], least):
                hit = np.flatnonzero(wanted.may_hold(p.id))
                if not len(hit):
                    continue
                value, inside = p.shingles()
                for i in hit.tolist():
                    own = int(p.id[i].view(np.int64))
                    if own not in seen:
                        seen.add(own)
                        at = slice(p.word[i], p.word[i] + p.size[i])
                        out["id"].append(own)
                        out["tokens"].append(np.unique(value[at][inside[at]].astype(np.uint32)).view(np.int32))
            if len(seen) > COMBINED:
                seen.clear()
            yield out

    found = map_rows(texts.select("text"), cut, "id long, tokens array<int>")
    return found.join(ids, "id", "left_semi").dropDuplicates(["id"])


def _places(texts: DataFrame, ids: DataFrame, least: int) -> DataFrame:
    """Every occurrence of the paragraphs named by ``ids`` (and of some others).

    ``at`` is the number of the paragraph and of its first word, ``sizes`` its size and those of its neighbours, ``span``
    its first code point and the one after, packed.
    """
    wanted = Presence(ids, "id")

    def cut(batches):
        for batch in batches:
            own, row = batch["own"].to_numpy(), batch["row"].to_numpy()
            for p in _paragraphs(batch["text"], least):
                hit = np.flatnonzero(wanted.may_hold(p.id))
                start, end = p.spans()
                word = p.word[hit] - p.word[np.searchsorted(p.doc, p.doc[hit])]
                before = np.where(p.place[hit] > 0, p.size[hit - 1], 0)
                after = np.where(p.last[hit], 0, p.size[(hit + 1) % len(p.size)])
                yield {
                    "id": p.id[hit].view(np.int64),
                    "own": own[p.doc[hit]],
                    "row": row[p.doc[hit]],
                    "at": p.place[hit] << 32 | word,
                    "sizes": (p.size[hit] | before << 8 | after << 16).astype(np.int32),
                    "span": start[hit] << 32 | end[hit],
                }

    return map_rows(texts, cut, "id long, own long, row long, at long, sizes int, span long")


def repeated_ids(texts: DataFrame, least: int) -> DataFrame:
    """(id, class_id, keep): the paragraphs whose class is in two documents, and the least of these documents."""
    key, same = W.partitionBy("key"), W.partitionBy("key", "id")
    own = {"own_lo": F.min("lo").over(same), "own_hi": F.max("hi").over(same)}
    rows = band_rows(texts, least).withColumns(own)
    rows = rows.withColumns({"key_lo": F.min("lo").over(key), "key_hi": F.max("hi").over(key), "least": F.min("id").over(key), "most": F.max("id").over(key)})
    near = rows.where("key_lo < key_hi").groupBy("key", "id").agg(*[F.first(c).alias(c) for c in ("own_lo", "own_hi", "least", "most")])
    near = checkpointed(near)
    shared = near.where("least < most").select(F.col("key").alias("comp"), "id")
    items = _tokens(texts, shared.select("id").distinct(), least).join(shared, "id").select("comp", "id", "tokens")
    exact = classes(verified_links(items, GROUP))
    ids = near.groupBy("id").agg(F.min("own_lo").alias("lo"), F.max("own_hi").alias("hi")).join(exact, "id", "left")
    of_class = W.partitionBy("class_id")
    ids = ids.select("id", F.coalesce("root", "id").alias("class_id"), "lo", "hi")
    ids = ids.select("id", "class_id", F.min("lo").over(of_class).alias("keep"), F.max("hi").over(of_class).alias("hi"))
    return checkpointed(ids.where("keep < hi").drop("hi"))


PLACES = ["own", "row", "at", "sizes", "span", "class_id", "keep"]


def repeated_places(texts: DataFrame, least: int) -> DataFrame:
    """Every occurrence of a paragraph whose class is in two documents; documents are whole in a partition, and in order."""
    ids = repeated_ids(texts, least)
    found = _places(texts, ids, least).join(ids, "id").select(*PLACES)
    dealt = found.repartition(shuffle_partitions(texts.sparkSession), "own", "row")
    return checkpointed(dealt.sortWithinPartitions("own", "row", "at"))


def _by_document(rows: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(table)`` over pandas tables of whole documents; ``rows`` has them so."""
    columns = rows.columns

    def run(batches):
        held: list[pd.DataFrame] = []
        for batch in batches:
            table = pd.DataFrame({c: batch[c].to_numpy(zero_copy_only=False) for c in columns})
            if not len(table):
                continue
            new = np.flatnonzero((np.diff(table["own"]) != 0) | (np.diff(table["row"]) != 0))
            whole = held and (table["own"].iat[0] != held[-1]["own"].iat[-1] or table["row"].iat[0] != held[-1]["row"].iat[-1])
            cut = int(new[-1]) + 1 if len(new) else 0
            if cut or whole:
                yield fn(pd.concat([*held, table.iloc[:cut]], ignore_index=True))
                held = []
            held.append(table.iloc[cut:])
        if held:
            yield fn(pd.concat(held, ignore_index=True))

    return map_rows(rows, run, schema, batch_rows=1 << 14)


def _joined(t: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
    """The table without copies of rows, and whether each paragraph but the first goes on with its predecessor's run."""
    t = t.drop_duplicates(["own", "row", "at"])
    own, row, place = t["own"].to_numpy(), t["row"].to_numpy(), t["at"].to_numpy() >> 32
    return t, (own[1:] == own[:-1]) & (row[1:] == row[:-1]) & (place[1:] == place[:-1] + 1)


def _ends(places: DataFrame, least: int) -> DataFrame:
    """(own, row, place, right, class_id, edge): the ends that are to grow, and ends for them to be compared with; ``edge`` names one.

    Runs that can't come to ``least`` words with their neighbours are left out. Another document may have a longer run
    around the same paragraph; of each way in which runs go on from the paragraph of an end, one is added.
    """
    kinds = "own long, row long, place int, right boolean, class_id long, edge long"

    def outer(t: pd.DataFrame) -> dict:
        t, joined = _joined(t)
        sizes = t["sizes"].to_numpy()
        first, last = np.concatenate([[True], ~joined]), np.concatenate([~joined, [True]])
        run = np.cumsum(first) - 1
        total = np.bincount(run, sizes & 255) + (sizes[first] >> 8 & 255) + (sizes[last] >> 16) + 2 * REACH
        use = total[run] >= least
        return _sides(t, np.flatnonzero(use & first), np.flatnonzero(use & last))

    def _sides(t: pd.DataFrame, left: np.ndarray, right: np.ndarray) -> dict:
        at = np.concatenate([left, right])
        out = {c: t[c].to_numpy()[at] for c in ("own", "row", "class_id")}
        place, right = t["at"].to_numpy()[at] >> 32, np.arange(len(at)) >= len(left)
        return out | {"place": place.astype(np.int32), "right": right, "edge": edge_names(out["own"], out["row"], place, right)}

    ends = checkpointed(_by_document(places, outer, kinds))
    wanted = Presence(ends.select("class_id"), "class_id")

    def inner(t: pd.DataFrame) -> dict:
        t, joined = _joined(t)
        kind = t["class_id"].to_numpy()
        may = wanted.may_hold(kind)
        left, right = np.flatnonzero(joined & may[1:]) + 1, np.flatnonzero(joined & may[:-1])
        return _sides(t, left, right) | {"other": np.concatenate([kind[left - 1], kind[right + 1]])}

    ways = _by_document(places, inner, f"{kinds}, other long")
    one = ways.groupBy("class_id", "right", "other").agg(F.min(F.struct("own", "row", "place", "edge")).alias("m"))
    one = checkpointed(one).join(checkpointed(ends.select("class_id", "right").distinct()), ["class_id", "right"], "left_semi")
    return checkpointed(ends.unionByName(one.select("m.*", "right", "class_id")).dropDuplicates(["edge"]))


def edge_names(own: np.ndarray, row: np.ndarray, place: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A 64-bit name of each side of each paragraph."""
    value = mix(own.view(np.uint64)) + row.view(np.uint64)
    return mix(value + (place.astype(np.uint64) << np.uint64(1)) + right.astype(np.uint64)).view(np.int64)


#: Words at which growth is tried first; then each word behind the last of them that another document has.
LADDER = 4


def _chains(texts: DataFrame, wanted: Presence, coarse: bool, least: int) -> DataFrame:
    """(g, own, edge, far) of the ends in ``wanted`` (and some others): names of beginnings of the words beyond an end.

    Coarse: after every ``LADDER`` words. Otherwise ``wanted`` holds ends with the words that are sure (``_sure``), and
    the names are of one word more up to the next step of the ladder.
    """

    def follow(batches):
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("g", "own", "edge", "far")}
            own, row = batch["own"].to_numpy(), batch["row"].to_numpy()
            for p in _paragraphs(batch["text"], least):
                place_of = p.words.start[p.index], p.words.end[p.index]
                shingle, _ = p.shingles()
                first, stop = p.bounds()
                for right in (False, True):
                    names = edge_names(own[p.doc], row[p.doc], p.place, np.full(len(p.doc), right))
                    # The words that are there: those of the neighbour and some more, as its end may depend on what follows.
                    beyond = np.append(p.size[1:], 0) if right else np.append(0, p.size[:-1])
                    room = np.minimum(np.where(p.last if right else p.place == 0, 0, beyond) + REACH, stop - p.word - p.size if right else p.word - first)
                    sure = [0] if coarse else range(0, int(room.max()) + 1, LADDER)
                    hits = [np.flatnonzero((room > s) & wanted.may_hold(names if coarse else _sure(names, s))) for s in sure]
                    at, known = np.concatenate(hits), np.repeat(sure, [len(h) for h in hits])
                    tried = np.arange(LADDER, MOST + REACH + 1, LADDER) if coarse else np.arange(1, LADDER)
                    for k in range(0, len(at), 4096):
                        i, steps = at[k : k + 4096], known[k : k + 4096, None] + tried
                        near = (p.word + p.size)[i] if right else p.word[i] - 1
                        reach = np.arange(max(1, int(room[i].max())))
                        word = np.clip(near[:, None] + (reach if right else -reach), 0, len(p.hash) - 1)
                        seed = shingle[near - SHINGLE if right else near + 1] ^ np.uint64(1 + right)
                        grown = growth(np.where(reach < room[i, None], p.hash[word], np.uint64(0)), seed)
                        e, c = np.nonzero(steps <= room[i, None])
                        t = steps[e, c]
                        out["g"].append(grown[e, t - 1].view(np.int64))
                        out["far"].append(t << 32 | place_of[right][word[e, t - 1]])
                        out["own"].append(own[p.doc[i[e]]])
                        out["edge"].append(names[i[e]])
            yield {k: np.concatenate(v) if v else [] for k, v in out.items()}

    return map_rows(texts, follow, "g long, own long, edge long, far long")


_STEP = 0x9E3779B97F4A7


def _sure(edges: np.ndarray, sure: int) -> np.ndarray:
    return edges ^ np.int64(sure * _STEP)


def _shared(chains: DataFrame) -> DataFrame:
    """(edge, far): the furthest of an end that another document has, too."""
    chains = checkpointed(chains)
    both = checkpointed(chains.groupBy("g").agg(F.min("own").alias("lo"), F.max("own").alias("hi")).where("lo < hi").select("g"))
    return chains.join(both, "g", "left_semi").groupBy("edge").agg(F.max("far").alias("far"))


def grown(texts: DataFrame, ends: DataFrame, least: int) -> DataFrame:
    """(own, row, place, right, steps, to): how many words an end grows, and the code point it comes to.

    Texts are read again, and where an end may be (a few false alarms only add to what ends are compared
    with) beginnings of the words beyond it are named by a hash, together with the five words before them.
    """
    coarse = checkpointed(_shared(_chains(texts, Presence(ends, "edge"), True, least)).join(ends.select("edge"), "edge", "right"))
    sure = F.coalesce(F.shiftright("far", 32), F.lit(0))
    sure_of = checkpointed(coarse.select(F.col("edge").bitwiseXOR(sure * F.lit(_STEP)).alias("x")))
    fine = _shared(_chains(texts, Presence(sure_of, "x"), False, least))
    far = coarse.unionByName(fine).groupBy("edge").agg(F.max("far").alias("far")).where("far IS NOT NULL")
    steps, to = F.shiftright("far", 32).cast("int").alias("steps"), F.col("far").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("to")
    return ends.join(far, "edge").select("own", "row", "place", "right", steps, to)


def _passages(t: pd.DataFrame, least: int) -> dict:
    """The stretches of the passages in whole documents.

    A row of ``t`` is a repeated paragraph, one for each copy of its row, or (``steps`` not 0) how far
    its left (below 0) or right end grows, with ``span`` the code point.
    """
    names = ("own", "row", "start", "end", "passage_words", "class_id", "keep", "removed", "turn")
    out: dict[str, list] = {k: [] for k in names}
    ends = t[t["steps"] != 0]
    far = {x[:3] + (x[3] > 0,): x[3:] for x in zip(ends["own"].tolist(), ends["row"].tolist(), (ends["at"].to_numpy() >> 32).tolist(), ends["steps"].tolist(), ends["span"].tolist(), strict=True)}
    t = t[t["steps"] == 0]
    key = ["own", "row", "at"]
    copies = t.groupby(key)["at"].transform("size").to_numpy()[~t.duplicated(key).to_numpy()].tolist() if len(t) else []
    t, joined = _joined(t) if len(t) else (t, np.empty(0, bool))
    own, row, kind, keep = (t[c].tolist() for c in ("own", "row", "class_id", "keep"))
    at, span = t["at"].to_numpy(), t["span"].to_numpy()
    place, word, size = (at >> 32).tolist(), (at & 0xFFFFFFFF).tolist(), (t["sizes"].to_numpy() & 255).tolist()
    start, end = (span >> 32).tolist(), (span & 0xFFFFFFFF).tolist()
    stays, met = [], set()
    for x in zip(own, row, kind, keep, strict=True):
        stays.append(x[0] == x[3] and x[:3] not in met)
        met.add(x[:3])

    def close(total: int, runs: list) -> None:
        """``runs``: first and last paragraph, first and last code point, of each run of the passage."""
        if total < least:
            return
        stretches: list[list] = []  # code points, keeper and fate, first paragraph
        for first, last, left, right in runs:
            for i in range(first, last + 1):
                a, b = left if i == first else start[i], right if i == last else end[i]
                fate = (keep[i], not stays[i])
                if stretches and stretches[-1][2] == fate:
                    stretches[-1][1] = max(b, stretches[-1][1])
                else:
                    stretches.append([max(a, stretches[-1][1] if stretches else 0), b, fate, i])
        for turn in range(copies[runs[0][0]]):
            for a, b, (keeper, gone), i in stretches:
                if a < b:
                    for k, v in zip(names, (own[i], row[i], a, b, total, kind[i], keeper, gone or turn > 0, turn), strict=True):
                        out[k].append(v)

    low = high = covered = 0
    doc, runs = None, []
    stops = np.flatnonzero(~joined).tolist() + [len(t) - 1] if len(t) else []
    i = 0
    for j in stops:
        a, left, b, right = word[i], start[i], word[j] + size[j], end[j]
        for k in range(i, j + 1):
            steps, to = far.get((own[k], row[k], place[k], False), (0, 0))
            if word[k] + steps < a:
                a, left = word[k] + steps, to
            steps, to = far.get((own[k], row[k], place[k], True), (0, 0))
            if word[k] + size[k] + steps > b:
                b, right = word[k] + size[k] + steps, to
        more = b - max(a, high)
        if runs and doc == (own[i], row[i]) and covered + more >= SHARE * (b - low):
            high, covered = max(b, high), covered + max(more, 0)
        else:
            close(high - low, runs)
            doc, low, high, covered, runs = (own[i], row[i]), a, b, b - a, []
        runs.append((i, j, left, right))
        i = j + 1
    close(high - low, runs)
    return out


def _stretches(docs: DataFrame, least: int, id_col: str, text_col: str) -> DataFrame:
    texts = _texts(docs, id_col, text_col)
    places = repeated_places(texts, least)
    ends = grown(texts, _ends(places, least), least)
    side = F.when(F.col("right"), F.col("steps")).otherwise(-F.col("steps"))
    none = F.lit(0).cast("long")
    ends = ends.select("own", "row", F.shiftleft(F.col("place").cast("long"), 32).alias("at"), F.lit(0).alias("sizes"), F.col("to").cast("long").alias("span"), none.alias("class_id"), none.alias("keep"), side.alias("steps"))
    rows = places.withColumn("steps", F.lit(0)).unionByName(ends)
    dealt = rows.repartition(shuffle_partitions(docs.sparkSession), "own", "row").sortWithinPartitions("own", "row", "at")
    kinds = "own long, row long, start int, end int, passage_words int, class_id long, keep long, removed boolean, turn int"
    return _by_document(dealt, lambda t: _passages(t, least), kinds)


def repeated_paragraphs(docs: DataFrame, least: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, end, passage_words, class_id, keep_doc_id, removed).

    The class is that of the stretch's first paragraph; ``start`` and ``end`` are code points.
    """
    found = _stretches(docs, least, id_col, text_col)
    return found.select(_doc_id("own").alias("doc_id"), "start", "end", "passage_words", "class_id", _doc_id("keep").alias("keep_doc_id"), "removed")


def cleaned(docs: DataFrame, least: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the removed stretches, all columns kept; repeated rows are treated alike."""
    gone = _stretches(docs, least, id_col, text_col).where("removed AND turn = 0")
    spans = gone.groupBy("own", "row").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("_spans"))

    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, own in zip(texts, spans, strict=True):
            if own is not None:
                parts, at = [], 0
                for span in own:
                    parts.append(text[at : max(at, span["start"])])
                    at = max(at, span["end"])
                text = "".join([*parts, text[at:]])
            out.append(text)
        return pd.Series(out, dtype=object)

    own = docs.columns
    names = [f"c{i}" for i in range(len(own))]
    where = dict(zip(own, names, strict=True))
    tagged = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in where.items()])
    text, doc_id = F.col(where[text_col]), F.col(where[id_col]).cast("long")
    row = F.xxhash64(text_of(where[text_col]))
    own_id = F.coalesce(doc_id, row.bitwiseAND(F.lit(UNNAMED - 1)).bitwiseOR(F.lit(UNNAMED)))
    tagged = tagged.withColumns({"own": own_id, "row": row})
    joined = tagged.join(spans, ["own", "row"], "left")
    cleared = F.when(F.col("_spans").isNull(), text).otherwise(F.pandas_udf(cut, "string")(text, F.col("_spans")))
    return joined.withColumn(where[text_col], cleared).select(*[F.col(n).alias(c) for c, n in where.items()])
