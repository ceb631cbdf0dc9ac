"""Paragraph deduplication, near copies and the pipeline against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers as P
import pyarrow as pa
import pytest

import corpus_pipeline
from corpusloom.llm import common, near_sets, packing, paragraph_dedup, quality, secrets, segments, simhash
from tests.llm.test_llm_operators import awkward, brute_components, documents


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))


def shingles(text, size=5):
    w = words_of(text)
    return {" ".join(w[i : i + size]) for i in range(len(w) - size + 1)} or ({" ".join(w)} if w else set())


def similar(a, b):
    return bool(a and b) and len(a & b) >= 0.8 * len(a | b) - 1e-9


def near_copies(rng, n, words=90):
    """Texts in families: a centre, copies with a few words changed, and unrelated ones."""
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(2000)]
    out = []
    for _ in range(n):
        centre = [rng.choice(vocabulary) for _ in range(words)]
        out.append(" ".join(centre))
        for _ in range(rng.choice([0, 0, 1, 4])):
            copy = list(centre)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(words)] = rng.choice(vocabulary)
            out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("most", [1 << 28, 1 << 16])
def test_presence_has_no_false_negatives(spark, monkeypatch, most):
    monkeypatch.setattr(common.Presence, "MOST_BITS", most)
    rng = np.random.default_rng(3)
    own, others = (rng.integers(-(1 << 63), 1 << 63, 20_000, np.int64) for _ in range(2))
    held = common.Presence(spark.createDataFrame(pd.DataFrame({"v": own})), "v")
    assert held.may_hold(own).all()
    assert held.may_hold(others).mean() < (0.03 if most > 1 << 20 else 1.0)
    assert not common.Presence(spark.createDataFrame([], "v long"), "v").may_hold(others).any()


@pytest.mark.parametrize("bits", [1 << 28, 1 << 16])
def test_results_do_not_depend_on_bitmaps(spark, monkeypatch, bits):
    """A saturated bitmap lets everything through, and nothing changes."""
    monkeypatch.setattr(common.Presence, "MOST_BITS", bits if bits > 1 << 20 else 64)
    monkeypatch.setattr(paragraph_dedup, "COMBINED", 300_000 if bits > 1 << 20 else 50)
    texts, _ = passages_in_texts(random.Random(11), 100, [60, 90])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = paragraph_dedup.repeated_paragraphs(docs).toPandas().sort_values(["doc_id", "start"]).reset_index(drop=True)
    RESULTS.append(got[["doc_id", "start", "end", "passage_words", "keep_doc_id", "removed"]])
    pd.testing.assert_frame_equal(RESULTS[0], RESULTS[-1])


RESULTS: list = []


def sets_of(texts):
    return [s for part in near_sets.document_sets(pa.array(texts)) for s in part.sets()]


@pytest.mark.parametrize("forest", [near_sets.jaccard_forest, lambda sets: near_sets.sliced_forest(sets, simhash.LOOSE_RADIUS)])
def test_forests_find_every_link(forest):
    rng = random.Random(1)
    texts = near_copies(rng, 40)
    roots = dict(forest(sets_of(texts)))
    own = [shingles(t) for t in texts]
    want = brute_components(len(texts), lambda i, j: similar(own[i], own[j]))
    assert {(i, roots[i]) for i in roots} == {(i, roots[w]) for i, w in enumerate(want)}


def test_loose_radius_loses_no_similar_pair():
    """Sets of all sizes, with similarities just over 0.8: fingerprints and bands."""
    rng = np.random.default_rng(4)
    lost = missed = pairs = 0
    for n in [5, 6, 9, 14, 20, 40, 100, 400] * 250:
        least = math.ceil(0.8 * n)
        both = rng.integers(0, 1 << 63, least, np.uint64)
        a, b = (np.concatenate([both, rng.integers(0, 1 << 63, k, np.uint64)]) for k in ((n - least) // 2, n - least - (n - least) // 2))
        pairs += 1
        lost += bin(near_sets.set_fingerprint(a) ^ near_sets.set_fingerprint(b)).count("1") > simhash.LOOSE_RADIUS
        odd = rng.integers(0, 1 << 62, (simhash.BANDS, simhash.ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
        least_of = lambda s: segments.mix(s * odd).min(axis=2)
        missed += not (least_of(a) == least_of(b)).all(axis=1).any()
    assert lost + missed <= 0.001 * pairs


@pytest.mark.parametrize("group", [20_000, 4])
def test_near_copies_match_brute_force(spark, sf_dir, monkeypatch, group):
    monkeypatch.setattr(simhash, "GROUP", group)
    texts = near_copies(random.Random(2), 30) + documents(sf_dir).text.tolist() + ["", "two words", "two words"]
    docs = spark.createDataFrame([(t, 500 - i, "x") for i, t in enumerate(texts)], "text string, doc_id long, keys string")
    got = simhash.near_duplicate_rows(docs)
    assert got.columns == docs.columns
    own = [shingles(t) for t in texts]
    roots = brute_components(len(texts), lambda i, j: similar(own[i], own[j]))
    keep = {max(i for i, r in enumerate(roots) if r == root) for root in set(roots)}
    assert sorted(r.doc_id for r in got.collect()) == sorted(500 - i for i in keep)


def test_near_copies_that_repeat_a_line(spark):
    rng = random.Random(6)
    texts = []
    for times in [1, 5, 10, 20, 50] * 6:
        word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
        own, line = " ".join(word() for _ in range(250)), " ".join(word() for _ in range(20))
        texts += [f"{own}\n{line}", "\n".join([own, *[line] * times])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    own = [shingles(t) for t in texts]
    roots = brute_components(len(texts), lambda i, j: similar(own[i], own[j]))
    assert len(set(roots)) == len(texts) // 2
    assert sorted(r.doc_id for r in simhash.near_duplicate_rows(docs).collect()) == sorted(set(roots))


def test_same_blocks_repeated_differently_are_one_class(spark):
    """Equal shingle sets with other counts have a similarity of 1, however far the multisets are apart."""
    rng = random.Random(8)
    texts = []
    for _ in range(60):
        blocks = [" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(12)) for _ in range(6)]
        for _ in range(2):
            texts.append(" ".join(b for b in blocks for _ in range(rng.randint(1, 8))))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    own = [shingles(t) for t in texts]
    roots = brute_components(len(texts), lambda i, j: similar(own[i], own[j]))
    assert len(set(roots)) < 0.9 * len(texts)
    assert sorted(r.doc_id for r in simhash.near_duplicate_rows(docs).collect()) == sorted(set(roots))


def test_near_copies_awkward(spark):
    docs = awkward(spark)
    kept = simhash.near_duplicate_rows(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} >= {1, 4, 5, 6, 7, 8, 9}
    assert simhash.near_duplicate_rows(docs.limit(0)).count() == 0


def brute_passages(texts, least=50):
    """Per document the maximal word runs covered by windows of ``least`` words that another document has too."""
    places = [[(m.start(), m.end(), m.group().lower()) for m in re.finditer(r"[^\x20\x09-\x0D]+", t)] for t in texts]
    seen: dict = {}
    for i, own in enumerate(places):
        for k in range(len(own) - least + 1):
            seen.setdefault(tuple(w for *_, w in own[k : k + least]), set()).add(i)
    out = set()
    for i, own in enumerate(places):
        covered = np.zeros(len(own) + 1, bool)
        for k in range(len(own) - least + 1):
            if len(seen[tuple(w for *_, w in own[k : k + least])]) > 1:
                covered[k : k + least] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[False], covered]).astype(int)))
        out |= {(i, own[a][0], own[b - 1][1]) for a, b in edges.reshape(-1, 2)}
    return out


def reported_passages(got):
    """Touching stretches of one passage as one."""
    out = []
    for r in got.sort_values(["doc_id", "start"]).itertuples():
        if out and out[-1][0] == r.doc_id and out[-1][2] + 3 >= r.start and out[-1][3] == r.passage_words:
            out[-1][2] = r.end
        else:
            out.append([r.doc_id, r.start, r.end, r.passage_words])
    return {tuple(x[:3]) for x in out}


def wrapped(rng, own):
    """The words with line breaks and other white space anywhere."""
    return "".join(w + rng.choice([" ", " ", " ", "\n", "\n\n", "  \t"]) for w in own)[:-1]


def passages_in_texts(rng, n, lengths):
    """Texts of unrelated words with common passages inside, at any place and wrapped anew each time."""
    word = lambda: "".join(rng.choice("abcdefghä") for _ in range(rng.randint(4, 8)))
    passages = [[word() for _ in range(rng.choice(lengths))] for _ in range(n // 6)]
    out = []
    for _ in range(n):
        parts = [word() for _ in range(rng.randint(0, 120))]
        for p in rng.sample(passages, rng.choice([0, 0, 1, 1, 2])):
            parts += p + [word() for _ in range(rng.randint(15, 80))]
        out.append(wrapped(rng, [rng.choice([w, w, w.upper()]) if w.isascii() else w for w in parts]))
    return out, passages


def test_planted_passages_match_brute_force(spark):
    texts, _ = passages_in_texts(random.Random(3), 240, [30, 42, 51, 55, 60, 80, 120])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = paragraph_dedup.repeated_paragraphs(docs).toPandas()
    want, found = brute_passages(texts), reported_passages(got)
    assert len(want) > 80
    # A paragraph at the edge may be similar to others with a word more; a word may follow in another document by chance.
    near = lambda x, some: any(d == x[0] and abs(a - x[1]) < 40 and abs(b - x[2]) < 40 for d, a, b in some)
    # Of passages of just over 50 words one in fifty has no whole paragraph inside.
    assert sum(near(x, found) for x in want) >= 0.97 * len(want) and all(near(x, want) for x in found)
    assert len(want & found) >= 0.8 * len(want)
    assert Counter(got.removed)[False] < Counter(got.removed)[True]
    clean = paragraph_dedup.cleaned(docs).toPandas().sort_values("doc_id").text.tolist()
    assert len([p for p in brute_passages(clean) if p[2] - p[1] > 420]) <= 0.02 * len(want)
    for i, text in enumerate(clean):
        assert (text == texts[i]) == (not got[(got.doc_id == i) & got.removed].size)


def test_passages_in_long_lines_and_new_wraps(spark):
    """What whole lines can't show: 60 common words in lines of 200 and 150 words, and in lines of 8 words."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    common = [word() for _ in range(60)]
    a = " ".join([*[word() for _ in range(70)], *common, *[word() for _ in range(70)]])
    b = " ".join([*[word() for _ in range(45)], *common, *[word() for _ in range(45)]])
    c = "\n".join(" ".join(common[i : i + 8]) for i in range(0, 60, 8))
    docs = spark.createDataFrame([(0, a), (1, b), (2, c), (3, " ".join(word() for _ in range(200)))], "doc_id long, text string")
    got = paragraph_dedup.repeated_paragraphs(docs).toPandas()
    assert reported_passages(got) == brute_passages([a, b, c])
    assert set(got.passage_words) == {60} and set(got.keep_doc_id) <= {0, 1}


def test_lightly_edited_passages(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, wanted = [], set()
    for k in range(60):
        passage = [word() for _ in range(rng.choice([120, 200]))]
        for turn in range(2):
            own = list(passage)
            if turn:
                own[rng.randrange(40, 80)] = word()
            rows.append((2 * k + turn, wrapped(rng, [word() for _ in range(30)] + own + [word() for _ in range(30)])))
            wanted.add(2 * k + turn)
    rows += [(1000 + i, wrapped(rng, [word() for _ in range(300)])) for i in range(40)]
    got = paragraph_dedup.repeated_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert {d for d in got.doc_id} <= wanted
    whole = got[got.passage_words >= 110].doc_id.nunique()
    assert whole >= 0.95 * len(wanted)


@pytest.mark.parametrize("group", [1000, 4])
def test_paragraph_classes_match_brute_force(spark, monkeypatch, group):
    """Paragraphs with another first or last word are similar, and one class whatever the group size."""
    monkeypatch.setattr(paragraph_dedup, "GROUP", group)
    texts, _ = passages_in_texts(random.Random(9), 150, [60, 90])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    places = paragraph_dedup.repeated_places(paragraph_dedup._texts(docs, "doc_id", "text"), 50).toPandas()
    sets, rows = [], []
    for part in segments.words(pa.array(texts)):
        cut = segments.Paragraphs(part, 50)
        start, end = cut.spans()
        for d, a, b in zip(cut.doc.tolist(), start.tolist(), end.tolist()):
            rows.append((d, a, b))
            sets.append(shingles(texts[d][a:b]))
    roots = brute_components(len(rows), lambda i, j: similar(sets[i], sets[j]))
    docs_of: dict = {}
    for r, (d, *_) in zip(roots, rows):
        docs_of.setdefault(r, set()).add(d)
    want = {x: r for x, r in zip(rows, roots) if len(docs_of[r]) > 1}
    got = {(r.own, r.span >> 32, r.span & 0xFFFFFFFF): r.class_id for r in places.itertuples()}
    assert set(got) == set(want)
    assert len({(got[x], want[x]) for x in want}) == len(set(want.values())) == len(set(got.values()))


def test_paragraphs_do_not_depend_on_batches(monkeypatch):
    texts = passages_in_texts(random.Random(1), 40, [60])[0] + ["", "x", "wort " * 500, "äö " * 70]
    cut = lambda: [
        (int(d), int(i), int(a), int(b))
        for w in segments.words(pa.array(texts))
        for p in [segments.Paragraphs(w, 50)]
        if not p.empty
        for d, i, a, b in zip(p.doc, p.id, *p.spans())
    ]
    whole = cut()
    monkeypatch.setattr(segments, "BLOCK", 300)
    assert cut() == whole
    for d, _, a, b in whole:
        assert not texts[d][a].isspace() and not texts[d][b - 1].isspace()
        assert segments.LEAST <= len(words_of(texts[d][a:b])) <= segments.MOST


def test_paragraphs_awkward(spark):
    docs = awkward(spark)
    assert paragraph_dedup.repeated_paragraphs(docs).count() == 0
    assert paragraph_dedup.repeated_paragraphs(docs.limit(0)).count() == 0
    assert paragraph_dedup.cleaned(docs).columns == docs.columns
    eight = docs.where("doc_id = 8")
    assert paragraph_dedup.repeated_paragraphs(eight.union(eight)).count() == 0
    other = eight.withColumn("doc_id", eight.doc_id + 1).select(*docs.columns)
    got = paragraph_dedup.repeated_paragraphs(eight.union(other).union(other)).toPandas()
    assert set(got.keep_doc_id) == {8}
    first = got[got.doc_id == 8].sort_values("start")  # its text repeats a word inside, too
    assert not first.removed.iloc[0] and first.removed.iloc[1:].all()
    assert got[got.doc_id == 9].removed.all() and len(got[got.doc_id == 9]) % 2 == 0
    nameless = eight.withColumn("doc_id", eight.doc_id * None).select(*docs.columns)
    got = paragraph_dedup.repeated_paragraphs(nameless.union(other)).toPandas().sort_values("doc_id")
    assert set(got.keep_doc_id) == {9} and got[got.doc_id.isna()].removed.all() and not got[got.doc_id == 9].removed.all()
    clean = paragraph_dedup.cleaned(nameless.union(other)).collect()
    assert sorted(len(words_of(r.text)) > 0 for r in clean) == [False, True]


def test_pipeline_matches_brute_force(spark, sf_dir):
    own = documents(sf_dir).sort_values("doc_id")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    own = own[[quality.score_text(t, model) >= 0.3 for t in own.text]]
    own = own.assign(d=[re.sub(r"[\x20\x09-\x0D]", "", t) for t in own.text], n=own.text.str.len())
    own = own.sort_values(["n", "doc_id"], ascending=[False, True]).drop_duplicates("d").sort_values("doc_id")
    sets = [shingles(t) for t in own.text]
    roots = brute_components(len(sets), lambda i, j: similar(sets[i], sets[j]))
    own = own[[i == r for i, r in enumerate(roots)]]
    texts = {i: secrets.redacted(t, secrets.all_spans(t)[1]) for i, t in zip(own.doc_id, own.text)}

    got = corpus_pipeline.run(spark, sf_dir).toPandas()
    library = packing.WordEncoder(P.path("word_bpe_49k.json"))
    assert set(got.doc_id) == set(texts)
    for i, text in texts.items():
        ids = library._library([text])[0] + b"\0\0\0\0"
        pieces = got[got.doc_id == i].sort_values("piece")
        assert pieces.length.sum() * 4 == len(ids)
        for row in pieces.itertuples():
            assert row.ids_crc32 == zlib.crc32(ids[4 * row.start : 4 * (row.start + row.length)])
    for _, sequence in got.groupby("sequence_id"):
        sequence = sequence.sort_values("offset")
        assert sequence.offset.tolist() == [0, *np.cumsum(sequence.length)[:-1]]
        assert sequence.length.sum() <= 2048
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 2048) + 1


def test_stages_keep_columns_and_take_awkward_rows(spark, sf_dir, tmp_path):
    docs = awkward(spark)
    pd.DataFrame({"doc_id": [1, 2, 4], "quality": [1, 0, 1], "toxic": [0, 0, 0]}).to_parquet(tmp_path / "labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
            assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        out.count()
