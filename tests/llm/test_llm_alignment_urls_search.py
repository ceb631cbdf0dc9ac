"""Token alignment, url filters and ranked search against plain loops."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import queries, ranked_search, token_alignment, url_filters

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
SCHEMA = "text string, doc_id long, n_a string, item_id int, seg string"
AWKWARD = [
    ("the cat sat", 3, "x", 1, None), (None, 4, "x", 1, "d"), ("", 5, None, None, "d"), (" \n", 6, "x", 1, "d"), ("the cat", None, "x", 1, "d"),
    ("the cat", None, "x", 1, "d"), ("the cat sat", 3, "x", 1, "d"), ("long words, " * 20_000, 8, "x", 1, "d"), ("x" * 30_000, 9, "x", 1, "d"),
    ("under▁bar the cat", 10, "x", 1, "d"), ("<|endoftext|> <s> é日本\r\n\t ok's  it", 11, "x", 1, "d"),
]


def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


# -- token alignment -----------------------------------------------------------------------


def aligned_one_by_one(rows):
    """The contract's columns from whole texts, two tokens at a time."""
    both = token_alignment.Tokenizers(A, B)
    found, counts = [], Counter()
    for doc_id, text in rows:
        a, b = ([], []) if not text else (both.a.encode(" " + text, add_special_tokens=False).ids, both.b.encode(text))
        raw = (" " + (text or "")).encode()
        ends_a = np.cumsum([len(both.a_bytes[i]) for i in a]).tolist()
        ends_b = np.cumsum([len(both.b_bytes[i]) for i in b]).tolist()
        if not text or b"".join(both.a_bytes[i] for i in a) != raw or b"".join(both.b_bytes[i] for i in b) != raw:
            found.append((doc_id, [], [], [], ""))
            continue
        spans = lambda ids, ends: [(i, s, e) for i, s, e in zip(ids, [0, *ends[:-1]], ends, strict=True)]
        ta, tb = spans(a, ends_a), spans(b, ends_b)
        links, j = [], 0
        for i, s, e in ta:
            while tb[j][2] <= s:
                j += 1
            k = j
            while k < len(tb) and tb[k][1] < e:
                links.append((i, tb[k][0]))
                k += 1
        groups = []
        for cut in sorted(set(ends_a) & set(ends_b)):
            start = groups[-1][0] if groups else 0
            groups.append((cut, start))
        by = lambda t: Counter(np.searchsorted([c for c, _ in groups], [e for _, _, e in t]).tolist())
        na, nb, parts, pa, pb = by(ta), by(tb), [], 0, 0
        for g in range(len(groups)):
            parts.append(",".join(map(str, a[pa : pa + na[g]])) + "|" + ",".join(map(str, b[pb : pb + nb[g]])))
            pa, pb = pa + na[g], pb + nb[g]
        counts.update(links)
        found.append((doc_id, a, b, links, ";".join(parts)))
    top = Counter()
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    return [
        (d, len(a), len(b), g.count("|"), len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(g.encode()).hexdigest() if g else "")
        for d, a, b, links, g in found
    ]


def by_id(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


@pytest.mark.parametrize("hot", [200_000, 150])
def test_alignment_query_matches_plain_loop(spark, sf_dir, hot, monkeypatch):
    monkeypatch.setattr(token_alignment, "HOT", hot)
    got = queries.op11_token_alignment(spark, sf_dir)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert by_id(got.collect()) == by_id(aligned_one_by_one([tuple(r) for r in docs]))


def odd_texts(n, seed=3):
    rng = random.Random(seed)
    signs = "aAbΣs' \n\t\x1c\x85\xa0éß1٣日本'st!?.,;)({}\r\x0b\x0c  😀́<|endoftext|> ▁ñÑ÷x-_\x00"
    return ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_alignment_of_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(token_alignment, "HOT", 50)
    rows = list(enumerate(odd_texts(1500)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_id(token_alignment.alignment_digests(docs, A, B).collect()) == by_id(aligned_one_by_one(rows))


def test_segments_encode_alone_as_in_their_text():
    both = token_alignment.Tokenizers(A, B)
    for text in odd_texts(4000, seed=9):
        if not text or "▁" in text:
            continue
        parts = token_alignment.segments(" " + text)
        assert "".join(parts) == " " + text
        a, b, ok = both.encode(parts)
        assert sum(a, []) == both.a.encode(" " + text, add_special_tokens=False).ids
        assert sum(b, []) == both.b.encode(text)
        assert all(ok)


def test_alignment_of_awkward_rows(spark):
    got = token_alignment.alignment_digests(awkward(spark), A, B)
    assert by_id(got.collect()) == by_id(aligned_one_by_one([(r[1], r[0]) for r in AWKWARD]))
    empty = token_alignment.alignment_digests(awkward(spark).limit(0), A, B)
    assert empty.collect() == [] and empty.columns == got.columns


def test_segments_that_do_not_come_back_count_for_nothing(spark, monkeypatch):
    """As if texts with a sign that a tokenizer changes weren't known beforehand."""
    monkeypatch.setattr(token_alignment, "_usable", bool)
    rows = [(1, "the cat sat"), (2, "the ca▁t sat"), (3, "the cat")]
    segs = token_alignment.encoded_segments(spark.createDataFrame(rows, "doc_id long, text string"), A, B)
    counts = {r["seg"]: r["n"] for r in segs.rows.collect()}
    assert counts[" the"] == 2 and counts[" cat"] == 2 and counts[" sat"] == 1
    segs.remove()


# -- url filters ---------------------------------------------------------------------------

URLS = [
    "https://www.Example.net/en/1", "http://example.net/fr/1?x=/en/", "https://sub.example.com/de/7#x", "https://example.com/de", "https://notexample.com/de/1",
    "https://a.org/fr/2", "https://a.org", "https://a.net", "https://a.net/", "https://net/x", "no scheme", "", None, "HTTP://A.B.ORG/FR/", "x://y://z/p", "https://h?q=/net/",
    "https://h#/f", "https://üÄ.org/fr/ß", "https://a.org/" + "p" * 50_000, "https://casino-spins.example.com/en/5", "://x.net/y", "https://a\nb.net/c\nd?e",
]


def parts_of(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule_for(host, path):
    best = None
    for verdict, name, start in url_filters.RULES:
        if (host == name or host.endswith("." + name)) and path.startswith(start) and (best is None or len(name + start) > len(best[1])):
            best = verdict, name + start
    return best


def grams(host, path):
    out = set()
    for place, text in ((0, f"<{host}>" if host else ""), (1, path)):
        text = re.sub("[0-9]", "0", text)
        out |= {(place, text[i : i + n]) for n in url_filters.SIZES for i in range(len(text) - n + 1)}
    return out


@pytest.fixture(scope="module")
def weights(spark):
    return url_filters.fit(url_filters.labelled_urls(spark))


def slot_numbers(spark, found):
    rows = spark.createDataFrame(sorted(found), "place int, gram string")
    return {(r[0], r[1]): r[2] for r in rows.select("place", "gram", F.pmod(F.xxhash64("place", "gram"), F.lit(url_filters.SLOTS))).collect()}


def test_url_training_matches_plain_gradient_descent(spark, weights):
    rows = sorted((r["url"], r["label"]) for r in url_filters.labelled_urls(spark).collect())
    found = [grams(*parts_of(u)) for u, _ in rows]
    slot = slot_numbers(spark, set().union(*found))
    x = np.zeros((len(rows), url_filters.SLOTS))
    for i, own in enumerate(found):
        at = sorted({slot[g] for g in own})
        x[i, at] = 1 / math.sqrt(len(at))
    y = np.array([label for _, label in rows], float)
    w, b = np.zeros(url_filters.SLOTS), 0.0
    for _ in range(url_filters.ROUNDS):
        err = (1 / (1 + np.exp(-(x @ w + b))) - y) / len(y)
        w, b = w - url_filters.RATE * (x.T @ err + url_filters.L2 * w), b - url_filters.RATE * err.sum()
    assert np.abs(np.array(weights[:-1]) / url_filters.UNIT - w).max() < 2e-6
    assert abs(weights[-1] / url_filters.UNIT - b) < 2e-6


def test_url_query_matches_plain_loop(spark, sf_dir, weights):
    got = queries.op12_url_filters(spark, sf_dir).collect()
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").collect()}
    assert sorted(r["page_id"] for r in got) == sorted(pages)
    split = {p: parts_of(u) for p, u in pages.items()}
    slot = slot_numbers(spark, set().union(*[grams(*s) for s in split.values()]))
    for r in got:
        host, path = split[r["page_id"]]
        rule = rule_for(host, path)
        at = {slot[g] for g in grams(host, path)}
        margin = weights[-1] + sum(weights[s] for s in at) / math.sqrt(max(1, len(at)))
        verdict = rule[0] if rule else "block" if margin / url_filters.UNIT >= math.log(4) else "allow"
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule and rule[1], verdict)


def test_url_model_on_hosts_it_has_not_seen(spark):
    bad = ["https://mega-casino.example.org/en/9", "https://m.ads-pixel.example.com/es/31", "https://cheap-pills-now.example.com/en/1", "https://adult-xxx.example.org/en/2"]
    good = ["https://www.river-news.example.org/en/9", "https://blog.mountains.example.com/es/31", "https://m.teachers.example.com/en/1", "https://orchestra.org/en/2"]
    pages = spark.createDataFrame(list(enumerate(bad + good)), "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filters.judge(pages, url_filters.labelled_urls(spark), rules=()).collect()}
    assert [got[i] for i in range(8)] == ["block"] * 4 + ["allow"] * 4


def test_url_awkward_rows(spark):
    rows = [(i if i % 5 else None, u, "x", 1.5) for i, u in enumerate(URLS)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, score double")
    got = url_filters.judge(pages, url_filters.labelled_urls(spark))
    want = []
    for page_id, url, _, _ in rows:
        host, path = parts_of(url)
        rule = rule_for(host, path)
        want.append((page_id, host, path, rule and rule[1]))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted([(r["page_id"], r["host"], r["path"], r["rule"]) for r in got.collect()], key=key) == sorted(want, key=key)
    assert url_filters.judge(pages.limit(0), url_filters.labelled_urls(spark)).collect() == []


def test_url_labels_that_give_no_model(spark):
    pages = spark.createDataFrame([(1, "https://casino.example.org/en/1"), (2, "https://a.net/b")], "page_id long, url string")
    for rows in ([], [("https://a.org/x", 1)], [(None, 1), ("https://a.org/x", None)]):
        labelled = spark.createDataFrame(rows, "url string, label int")
        assert url_filters.fit(labelled) is None
        got = {r["page_id"]: (r["rule"], r["verdict"], r["score"]) for r in url_filters.judge(pages, labelled).collect()}
        assert got == {1: (None, "allow", None), 2: ("net/", "block", None)}


def test_url_main_path_is_native(spark, sf_dir):
    plan = queries.op12_url_filters(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange|ExistingRDD", plan)


# -- ranked search -------------------------------------------------------------------------


def ranked_one_by_one(docs, items, k=10):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    found = [(d, Counter(term.findall(lower(t or "")))) for d, t in docs]
    n, total = sum(bool(c) for _, c in found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in found:
            size, score = sum(c.values()), 0
            for t, q in Counter(term.findall(lower(text or ""))).items():
                if c[t]:
                    m = 25 + 75 * size * n // total
                    score += q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                scores.append((-score, d is None, d or 0))
        out += [(item, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scores)[:k], 1)]
    return out


def in_order(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, x or 0) for x in r))


@pytest.mark.parametrize("shard", [8192, 17])
def test_search_query_matches_sql_and_plain_loop(spark, sf_dir, shard, monkeypatch):
    monkeypatch.setattr(ranked_search, "SHARD_DOCS", shard)
    got = in_order(queries.op13_ranked_search(spark, sf_dir).collect())
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    assert got == in_order(ranked_one_by_one(docs, items))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    assert got == in_order(con.execute(ranked_search.ORACLE_SQL).fetchall())


@pytest.mark.parametrize("block,most", [(4096, 200_000), (7, 200_000), (4096, 3)])
def test_search_in_blocks_with_ties_and_repeats(spark, monkeypatch, block, most):
    monkeypatch.setattr(ranked_search, "BLOCK_ITEMS", block)
    monkeypatch.setattr(ranked_search, "MOST_TERMS", most)
    monkeypatch.setattr(ranked_search, "SHARD_DOCS", 11)
    rng = random.Random(5)
    words = ["a", "B", "ß", "é9", "日本", "the", "of", "x1", "Zz", "rare", "q"]
    text = lambda n: " ".join(rng.choice(words[: rng.randint(1, len(words))]) + rng.choice(["", ",", "-"]) for _ in range(n))
    docs = [(rng.choice([i, None, i // 2]), rng.choice([text(rng.randint(0, 12)), None, "the of the"])) for i in range(300)]
    items = [(rng.choice([i, None, 3]), rng.choice([text(rng.randint(0, 6)), None, "nowhere", "the the of"])) for i in range(30)]
    got = ranked_search.ranked_search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert in_order(got.collect()) == in_order(ranked_one_by_one(docs, items))


def test_search_awkward_rows(spark):
    items = spark.createDataFrame([("the cat", 1, "z"), (None, 2, "z"), ("long", None, "z")], "text string, item_id long, score string")
    got = ranked_search.ranked_search(awkward(spark), items)
    want = ranked_one_by_one([(r[1], r[0]) for r in AWKWARD], [(1, "the cat"), (2, None), (None, "long")])
    assert in_order(got.collect()) == in_order(want)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert ranked_search.ranked_search(awkward(spark).limit(0), items).collect() == []
    assert ranked_search.ranked_search(awkward(spark), items.limit(0)).collect() == []


def test_variable_length_integers():
    values = np.array([0, 1, 127, 128, 16_383, 16_384, 1 << 40, 5])
    data, ends = ranked_search.pack(values)
    assert ranked_search.unpack(data).tolist() == values.tolist() and ends[-1] == len(data)
    assert ranked_search.unpack(data[ends[2] : ends[4]]).tolist() == [128, 16_383]
    assert ranked_search.unpack(b"").tolist() == [] and ranked_search.pack(values[:0])[0] == b""


def test_norms_beyond_64_bits():
    lengths = np.array([1 << 40, 3])
    assert ranked_search.norms(lengths, 1 << 30, 1 << 45).tolist() == [25 + 75 * (1 << 70) // (1 << 45), 25 + 75 * 3 * (1 << 30) // (1 << 45)]


def test_terms_without_lists_of_their_own_lose_no_document():
    """Against all scores, with many equal ones, and heaps that are full from earlier shards."""
    rng = random.Random(2)
    for _ in range(300):
        best, all_scores = ranked_search._Best(3), []
        for shard in range(3):
            ids = sorted(rng.sample(range(100), 12))
            lists, scores = [], Counter()
            for _ in range(rng.randint(1, 5)):
                docs = sorted(rng.sample(range(12), rng.randint(1, 12)))
                gains = [rng.randint(0, 4) for _ in docs]
                lists.append((docs, gains, max(gains)))
                scores.update(dict(zip(docs, gains, strict=True)))
            ranked_search.merge(lists, [-(i * 3 + shard) for i in ids], best)
            all_scores += [(s, -(ids[d] * 3 + shard)) for d, s in scores.items() if s > 0]
        assert sorted(best.heap, reverse=True) == sorted(all_scores, reverse=True)[:3]
