"""The ten operators against brute force, round trips, libraries and held-out labels."""

import base64
import bz2
import gzip
import hashlib
import lzma
import math
import random
import re
import time
import urllib.parse
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from corpusloom.llm import byte_bpe, exact_dedup, html_extract, order_minhash, packing, quality, queries, secrets, simhash, token_counts

SCHEMA = "text string, doc_id long, keep_id string, fingerprint int, _digest string"
ALPHABET = "aAbΣσ' \n\t\x1c\x85\xa0éßα1٣日本'sT!?. 😀́\r<|endoftext|> ▁"


def random_texts(n, seed=1, size=40):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, size))) for _ in range(n)]


def awkward(spark):
    """Nulls, empties, ties, repeated rows, a long text and columns with clashing names."""
    rows = [
        ("a b  c", 3, "x", 1, None),
        ("a b c", 2, None, None, "d"),
        ("abc ", 1, "x", 1, "d"),
        (None, 4, "x", 1, "d"),
        ("", 5, "x", 1, "d"),
        (" \n", 6, "x", 1, "d"),
        ("same", None, "x", 1, "d"),
        ("same", 7, "x", 1, "d"),
        ("same", 7, "x", 1, "d"),
        ("long " * 30_000, 8, "x", 1, "d"),
        ("token = abcdef0123456789abcdef0123", 9, "x", 1, "d"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def documents(sf_dir):
    return pd.read_parquet(f"{sf_dir}/documents.parquet")


# -- exact dedup -------------------------------------------------------------------------


@pytest.mark.parametrize("counters", [1, 3, 128])
def test_exact_dedup_matches_brute_force(spark, sf_dir, counters):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = exact_dedup.exact_duplicate_rows(docs, counters=counters).toPandas().set_index("doc_id")
    own = documents(sf_dir)
    own["d"] = [hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t).encode()).hexdigest() for t in own.text]
    own["n"] = own.text.str.len()
    for digest, group in own.groupby("d"):
        keep = group.sort_values(["n", "doc_id"], ascending=[False, True]).doc_id.iloc[0]
        for i in group.doc_id:
            row = got.loc[i]
            assert (row.keep_id, row.group_size, row.kept, row.text_sha256) == (keep, len(group), i == keep, digest)
    kept = exact_dedup.drop_exact_duplicates(docs, counters=counters).toPandas()
    assert sorted(kept.doc_id) == sorted(got[got.kept].index)


def test_exact_dedup_awkward(spark):
    docs = awkward(spark)
    got = exact_dedup.exact_duplicate_rows(docs).toPandas()
    assert len(got) == docs.count() and got.kept.sum() == 5
    assert set(got[got.kept].doc_id.dropna()) == {3, 6, 7, 8, 9}
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == 5
    assert exact_dedup.exact_duplicate_rows(docs.limit(0)).count() == 0


def test_misra_gries_keeps_what_is_frequent():
    rng, counts, seen = random.Random(2), {}, Counter()
    for _ in range(50):
        part = Counter(rng.choice("aab" + "".join(map(chr, range(200, 400)))) for _ in range(100))
        seen += part
        counts = exact_dedup.misra_gries(counts, part, 10)
        assert len(counts) <= 10
    n = sum(seen.values())
    assert all(k in counts for k, c in seen.items() if c > n / 11)


# -- tokens ------------------------------------------------------------------------------


def test_token_counts_match_the_library(spark, sf_dir):
    model = P.path("piece_bpe_32k.model")
    library, _ = token_counts._processor(model)
    texts = random_texts(300) + documents(sf_dir).text.tolist()[:60] + ["", " ", "  ", "a ", "<s> x </s>", "x" * 5000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = token_counts.token_counts(docs, model, limit=100).toPandas().set_index("doc_id")
    for i, t in enumerate(texts):
        n = len(library.encode(t))
        assert (got.n_tokens[i], got.n_bytes[i], got.over_limit[i]) == (n, len(t.encode()), n > 100)
    odd = token_counts.token_counts(awkward(spark), model).toPandas()
    assert len(odd) == 11 and odd[odd.doc_id == 4].n_tokens.item() == 0
    assert token_counts.token_counts(docs.limit(0), model).count() == 0


def test_byte_bpe_matches_the_library(spark, sf_dir):
    import tiktoken

    own = byte_bpe.Codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    rng = random.Random(4)
    long = ["".join(rng.choice("abc") for _ in range(5000)), "a" * 4097, " " * 999 + "x"]
    for text in random_texts(2000, 3) + documents(sf_dir).text.tolist()[:60] + long:
        ids = own.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert own.decode(ids) == text.encode()
    odd = byte_bpe.encoding_digests(awkward(spark), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).toPandas()
    assert odd[odd.doc_id == 4].n_tokens.item() == 0 and len(odd) == 11
    both = byte_bpe.encode_documents(awkward(spark), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).toPandas()
    assert bytes(both[both.doc_id == 2].decoded.item()) == b"a b c"


def test_rank_bitmap_is_a_priority_queue():
    rng, bitmap, own = random.Random(6), byte_bpe.RankBitmap(70_000), set()
    for _ in range(5000):
        rank = rng.randrange(70_000)
        if rank in own:
            own.discard(rank), bitmap.remove(rank)
        else:
            own.add(rank), bitmap.add(rank)
        if own:
            assert bitmap.least() == min(own)


def test_packing_plan_is_a_packing():
    rng = random.Random(5)
    for _ in range(150):
        capacity = rng.choice([10, 60, 2048])
        lengths = Counter(rng.choice([rng.randint(1, capacity - 1), rng.randint(1, max(1, capacity // 5))]) for _ in range(rng.randint(1, 300)))
        runs, bins = packing.plan(dict(lengths), capacity)
        placed = defaultdict(list)
        for length, n in lengths.items():
            own = sorted(r for r in runs if r[0] == length)
            assert sum(1 for _ in own) and own[0][1] == 0
            for rank in range(n):
                run = [r for r in own if r[1] <= rank][-1]
                turn, nth = divmod(rank - run[1], run[3])
                placed[run[2] + turn].append((run[4] + nth * length, length))
        assert sorted(placed) == list(range(bins))
        for parts in placed.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= capacity
        least = -(-sum(a * n for a, n in lengths.items()) // capacity)
        assert bins <= 11 / 9 * least + 2 or 2 * max(lengths) > capacity


def test_packed_sequences_hold_the_ids(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.union(docs.where("doc_id < 3"))
    path = P.path("word_bpe_49k.json")
    library = packing.WordEncoder(path)
    text_of = dict(docs.toPandas().fillna("").values.tolist())
    got = packing.sequences(docs, path).collect()
    seen = Counter()
    for row in got:
        ids = np.frombuffer(row.ids, "<u4")
        assert len(ids) == row.length <= packing.CAPACITY and row.parts[0].offset == 0
        stops = [p.offset for p in row.parts[1:]] + [row.length]
        for part, stop in zip(row.parts, stops):
            whole = np.frombuffer(library._library([text_of[part.doc_id]])[0] + b"\0\0\0\0", "<u4")
            at = part.piece * packing.CAPACITY
            assert (ids[part.offset : stop] == whole[at : at + packing.CAPACITY]).all()
            seen[part.doc_id, part.piece] += 1
    packed = packing.pack(docs, path).toPandas()
    assert seen == Counter(zip(packed.doc_id, packed.piece)) and len(got) == packed.sequence_id.nunique()


def test_packing_whole(spark, sf_dir):
    path = P.path("word_bpe_49k.json")
    library = packing.WordEncoder(path)
    texts = random_texts(200) + documents(sf_dir).text.tolist()[:100] + ["", "word " * 5000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = packing.pack(docs, path).toPandas()
    for i, text in enumerate(texts):
        ids = library._library([text])[0] + b"\0\0\0\0"
        own = got[got.doc_id == i].sort_values("piece")
        assert own.piece.tolist() == list(range(len(own))) and own.length.sum() * 4 == len(ids)
        for row in own.itertuples():
            assert row.ids_crc32 == zlib.crc32(ids[4 * row.start : 4 * (row.start + row.length)])
        assert (own.length[:-1] == 2048).all()
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == [0, *own.length.cumsum()[:-1]] and own.length.sum() <= 2048
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 2048) + 1
    odd = packing.pack(awkward(spark), path).toPandas()
    assert odd.doc_id.nunique(dropna=False) == 10
    assert packing.pack(docs.limit(0), path).count() == 0


# -- fingerprints ------------------------------------------------------------------------


def brute_fingerprint(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(n, linked):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash_classes_match_brute_force(spark, sf_dir):
    own = documents(sf_dir)
    texts = own.text.tolist() + ["", None, "One two", "one TWO", "a b c d"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = simhash.simhash_classes(docs).toPandas().sort_values("doc_id")
    marks = [brute_fingerprint(t or "", 3) for t in texts]
    assert got.fingerprint.tolist() == [f"{m:016x}" for m in marks]
    assert got.component_id.tolist() == brute_components(len(texts), lambda i, j: (marks[i] ^ marks[j]).bit_count() <= 2)
    assert simhash.simhash_classes(docs.limit(0)).count() == 0
    assert simhash.simhash_classes(awkward(spark)).count() == 11


def test_bit_slices_find_every_link():
    rng, values = random.Random(3), set()
    for _ in range(30):
        centre = rng.getrandbits(64)
        for _ in range(20):
            values.add(centre ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 4))))
    values = sorted(values)
    for radius in (0, 1, 2, 5, 12):
        roots = dict(simhash.BitSlices(values).forest(radius))
        want = brute_components(len(values), lambda i, j: (values[i] ^ values[j]).bit_count() <= radius)
        assert [roots[i] for i in range(len(values))] == want


def test_hot_buckets_are_split_without_losing_links(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 3)
    rng, values = random.Random(8), set()
    centre = rng.getrandbits(64)
    for _ in range(150):
        values.add(centre ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 5))))
    values = sorted(values)
    frame = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp long")
    links = simhash.fingerprint_links(frame).toPandas()
    pairs = {(a & (1 << 64) - 1, b & (1 << 64) - 1) for a, b in zip(links.src, links.dst)}
    at = {v: i for i, v in enumerate(values)}
    linked = {(at[a], at[b]) for a, b in pairs} | {(at[b], at[a]) for a, b in pairs}
    want = brute_components(len(values), lambda i, j: (values[i] ^ values[j]).bit_count() <= 2)
    assert brute_components(len(values), lambda i, j: (i, j) in linked) == want


def test_order_minhash(spark, sf_dir):
    own = documents(sf_dir)
    texts = own.text.tolist() + ["", "", "short", "short", "x" * 70_000]
    ids = [i * 7 % 1009 for i in range(len(texts))]
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    got = order_minhash.compare_neighbours(docs).toPandas().set_index("doc_id")
    order = sorted(zip(ids, texts), reverse=True)
    assert len(got) == len(texts)
    for k, (i, text) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        n = len(text) // 3
        edited = text[: len(text) - n] + following[:n]
        row = got.loc[i]
        a, b, c = (order_minhash.fingerprint(t) for t in (text, edited, following))
        assert (row.n_chars, row.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (row.fingerprint, row.edited_fingerprint) == (order_minhash.written(a), order_minhash.written(b))
        assert row.near_edited == pytest.approx((a == b).mean()) and row.near_next == pytest.approx((a == c).mean())
    assert order_minhash.compare_neighbours(awkward(spark)).count() == 11
    assert order_minhash.compare_neighbours(docs.limit(1)).toPandas().near_next.item() == 1
    assert order_minhash.compare_neighbours(docs.limit(0)).count() == 0


def plain_order_minhash(text):
    """Order MinHash by loops: numbered k-mers, the two least of each order, in text order, as a tuple."""
    mask = (1 << 64) - 1
    codes = [ord(c) for c in text]
    if not codes:
        return [0] * order_minhash.COMPONENTS
    k = min(order_minhash.K, len(codes))
    seen, numbered = Counter(), []
    for at in range(len(codes) - k + 1):
        h = 0x9E3779B97F4A7C15
        for c in codes[at : at + k]:
            h = (h ^ c) * 0x100000001B3 & mask
            h ^= h >> 29
        h >>= 24
        mixed = (h ^ (seen[h] * 0x9E3779B97F4A7C15 & mask)) * 0xFF51AFD7ED558CCD & mask
        seen[h] += 1
        numbered.append((((mixed ^ mixed >> 33) >> 8) & 0xFFFFFFFF, h, at))
    out = []
    for xor, times in zip(order_minhash._XOR.tolist(), order_minhash._TIMES.tolist()):
        ranked = sorted(numbered, key=lambda x: ((x[0] ^ xor) * times & 0xFFFFFFFF, x[1], x[2]))[:2]
        pair = [x[0] for x in sorted(ranked, key=lambda x: x[2])]
        pair = pair * 2 if len(pair) == 1 else pair
        out.append((pair[0] * 0x9E3779B97F4A7C15 + pair[1]) * 0xC2B2AE3D27D4EB4F % (1 << 64) >> 32)
    return out


def test_order_minhash_matches_plain_loops(sf_dir):
    rng = random.Random(4)
    texts = ["", "a", "short", "eight ch", "ninechars", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa", "éß漢字🙂 mixed 漢字🙂", "abab" * 30]
    texts += ["".join(rng.choice("abc ") for _ in range(rng.randint(1, 300))) for _ in range(40)] + documents(sf_dir).text.str[:700].tolist()[:30]
    for text in texts:
        assert order_minhash.fingerprint(text).tolist() == plain_order_minhash(text), text


def test_order_minhash_neighbours_match_plain_loops(spark, sf_dir):
    own = documents(sf_dir).sort_values("doc_id", ascending=False).reset_index(drop=True)
    got = queries.op5_order_minhash(spark, sf_dir).toPandas().set_index("doc_id")
    assert len(got) == len(own)
    for i, row in own.iterrows():
        after = own.text[(i + 1) % len(own)]
        edited = order_minhash.edited_text(row.text, after)
        a, b, c = (order_minhash.fingerprint(x) for x in (row.text, edited, after))
        r = got.loc[row.doc_id]
        assert r.fingerprint == order_minhash.written(a) and r.edited_fingerprint == order_minhash.written(b)
        assert (r.near_edited, r.near_next, r.n_chars) == ((a == b).mean(), (a == c).mean(), len(row.text))


def test_order_minhash_of_null_and_shared_ids(spark):
    rows = [(None, "one text here"), (None, "two texts here"), (3, "three"), (3, "three"), (3, "third text")]
    got = order_minhash.compare_neighbours(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert sorted(got.fingerprint) == sorted(order_minhash.written(order_minhash.fingerprint(t)) for _, t in rows)
    assert got.doc_id.isna().sum() == 2


@pytest.mark.parametrize("hot", [None, 7, 0, 99])
def test_order_minhash_of_one_id_with_most_rows(spark, hot):
    """The id's rows are many ranges, and every document still meets the next one of one order."""
    rng = random.Random(3)
    rows = [(hot if rng.random() < 0.7 else rng.randint(0, 99), f"text {i} " + "ab"[i % 2] * (i % 30)) for i in range(600)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = order_minhash.compare_neighbours(frame).toPandas()
    assert len(got) == 600
    marks = Counter(order_minhash.written(order_minhash.fingerprint(t)) for _, t in rows)
    assert Counter(got.fingerprint) == marks
    key = F.coalesce(F.col("doc_id"), F.lit(order_minhash._LEAST))
    hashes = {r["text"]: r["h"] for r in frame.select("text", F.xxhash64("text").alias("h")).collect()}
    squeeze = zstandard.ZstdCompressor(level=3)
    id_of = lambda d: order_minhash._LEAST if d is None else d
    cuts = frame.select(key.alias("key")).approxQuantile("key", [i / 16 for i in range(1, 16)], 0.2 / 16)
    of_hot = set(order_minhash.Ranges([int(c) for c in cuts]).hot())
    assert id_of(hot) in of_hot
    order = sorted(rows, key=lambda r: (-id_of(r[0]), hashes[r[1]] if id_of(r[0]) in of_hot else 0, squeeze.compress(r[1].encode())))
    want = Counter((d, hashlib.sha256(order_minhash.edited_text(t, order[(i + 1) % 600][1]).encode()).hexdigest()) for i, (d, t) in enumerate(order))
    assert Counter((None if pd.isna(d) else int(d), e) for d, e in zip(got.doc_id, got.edited_sha256)) == want


def test_ranges_of_a_hot_id():
    ranges = order_minhash.Ranges([5, 9, 9, 9, 20])
    low, high = -(1 << 63), (1 << 63) - 1
    of = lambda *rows: ranges.of(np.array([k for k, _ in rows]), np.array([h for _, h in rows])).tolist()
    assert ranges.hot() == [9]
    # Ids downwards, and of the hot one hashes upwards, go from the highest range to the lowest.
    assert of((99, 0), (20, 0), (10, 0), (9, low), (9, -1), (9, 0), (9, high), (8, 0), (6, 0), (5, 0), (1, 0)) == [7, 6, 6, 5, 4, 3, 2, 1, 1, 0, 0]


def test_order_minhash_sees_order_and_repeats():
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(400)]
    text, moved = " ".join(words), " ".join(words[200:] + words[:200])
    near = order_minhash.likeness(order_minhash.fingerprint(text), order_minhash.fingerprint(text + " more"))
    far = order_minhash.likeness(order_minhash.fingerprint(text), order_minhash.fingerprint(moved))
    assert near > 0.85 > 0.7 > far
    once, twice = order_minhash.fingerprint("abcdefgh" * 3), order_minhash.fingerprint("abcdefgh" * 30)
    assert order_minhash.likeness(once, twice) < 0.5


# -- secrets -----------------------------------------------------------------------------


def slow_base(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A | re.I):
        if len(m.group(2)) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(out)


def test_base_secrets_match_the_patterns(sf_dir):
    rng = random.Random(7)
    parts = ["token", "=", ":", " ", "'", '"', "Secret", "api_key", "APIKEY", "abcdef", "0123456789", "AKIA", "ABCDEFGHIJ", "ſecret", "é", "\n", "-"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(3000)] + documents(sf_dir).text.tolist()
    for text in texts:
        base, found = secrets.all_spans(text)
        assert base == slow_base(text) and set(base) <= set(found)


LAYERS = {
    "base64": lambda x: base64.b64encode(x.encode()).decode(),
    "percent": lambda x: urllib.parse.quote(x, safe=""),
    "unicode": lambda x: "".join(f"\\u{ord(c):04x}" for c in x),
    "gzip": lambda x: base64.b64encode(gzip.compress(x.encode(), mtime=0)).decode(),
    "zlib": lambda x: base64.urlsafe_b64encode(zlib.compress(x.encode())).decode(),
}


@pytest.mark.parametrize("outer", LAYERS)
@pytest.mark.parametrize("inner", LAYERS)
def test_nested_secrets_map_to_the_text(outer, inner):
    encoded = LAYERS[outer]("note " + LAYERS[inner]('password: "hunter2hunter2"') + " end")
    text = f"é before {encoded} after"
    _, found = secrets.all_spans(text)
    assign = [(a, b) for a, k, b in found if k == 0]
    start = text.find(encoded)
    assert any(start <= a < b <= start + len(encoded) for a, b in assign)
    assert "hunter2" not in "".join(str(x) for x in secrets.all_spans(secrets.redacted(text, found)))


def test_secrets_stop_at_cycles_and_bombs():
    assert secrets.all_spans("%25" * 50)[1] == []
    for deep, sign in (("%" + "25" * 50_000 + "3D", "="), ("\\u005c" + "u005c" * 20_000 + "u003d", "=")):
        text = f"token{deep}abcdefgh"
        assert (0, 0, len(text)) in secrets.all_spans(text)[1], sign
    bomb = base64.b64encode(zlib.compress(b"a" * 10_000_000)).decode()
    assert secrets.all_spans(bomb)[0] == slow_base(bomb)


@pytest.mark.parametrize("sign", ["%" + "25" * 40 + "3D", "\\u005c" + "u005c" * 40 + "u003d"])
def test_deeply_escaped_signs_leave_the_rest_decoded(sign, monkeypatch):
    plain = ["token%3Dabcdefgh", "\\u0074oken=hijklmno", f"a{sign}b token%3Dpqrstuvw{sign}%2561"]
    text = "\n".join([f"secret{sign}deepdeep", *plain, f"x{sign[:1]}{sign}0123456789abcdef{sign}"])
    _, found = secrets.all_spans(text)
    for line in plain[:2]:
        at = text.index(line)
        assert (at, 0, at + len(line)) in found
        assert line[-8:] not in secrets.redacted(text, found)
    never = re.compile("(?!)")
    monkeypatch.setattr(secrets, "_DEEP_PERCENT", never)
    monkeypatch.setattr(secrets, "_DEEP_ESCAPE", never)
    assert found == secrets.all_spans(text)[1]


SECRET = "password=hunter2hunter2"


@pytest.mark.parametrize("odd", ["\xa0", "\ufeff", "\u200b", "\xad", "\u3000", "\f", "\0", b"\xff\xfe\x80"])
@pytest.mark.parametrize("squeeze", [lambda x: x, gzip.compress])
def test_odd_bytes_beside_encoded_secrets(odd, squeeze):
    odd = odd if isinstance(odd, bytes) else odd.encode()
    encoded = base64.b64encode(squeeze(odd + f"long file\n{SECRET}\n{LAYERS['base64'](SECRET)}".encode() + odd)).decode()
    text = f"see {encoded} end"
    _, found = secrets.all_spans(text)
    spans = [(a, b) for a, k, b in found if k == 0]
    assert spans and all(4 <= a < b <= 4 + len(encoded) for a, b in spans)
    assert squeeze is gzip.compress or len(spans) == 2


@pytest.mark.parametrize("pack", ["plain", "gzip", "zlib"])
@pytest.mark.parametrize("width", [20, 64, 76])
@pytest.mark.parametrize("before,newline", [("", "\n"), ("-----BEGIN CERTIFICATE-----\n", "\r\n"), ("some_identifier_before_it\nodd\n", "\n  ")])
def test_wrapped_base64_is_joined(pack, width, before, newline):
    noise = "".join(random.Random(5).choice("ghijklmnopqrstuvwxyz ") for _ in range(300))
    raw = f"{noise} {SECRET} {noise}".encode()
    raw = {"plain": lambda x: x, "gzip": gzip.compress, "zlib": zlib.compress}[pack](raw)
    coded = base64.b64encode(raw).decode()
    text = before + newline.join(coded[i : i + width] for i in range(0, len(coded), width)) + "\nthe end"
    _, found = secrets.all_spans(text)
    assert any(k == 0 and len(before) <= a < b <= len(text) for a, k, b in found)
    assert SECRET not in "".join(secrets.redacted(text, found))
    if pack == "plain":  # just the secret goes, also where a line breaks in it
        a, b = next((a, b) for a, k, b in found if k == 0)
        joined = re.sub(r"\s", "", text[a:b])
        assert joined in coded and len(joined) <= len(SECRET) * 4 / 3 + 4


@pytest.mark.parametrize("sign", ["-", "_", "/", "+", "x-", "ab/", "abc_"])
@pytest.mark.parametrize("pack", ["base64", "gzip", "zlib"])
def test_runs_joined_to_a_prefix(sign, pack):
    encoded = LAYERS[pack](SECRET)
    text = f"see blob{sign}{encoded} end"
    spans = [(a, b) for a, k, b in secrets.all_spans(text)[1] if k == 0]
    assert any(4 <= a < b <= len(text) - 4 for a, b in spans)


def test_percent_runs_with_bytes_that_are_not_utf8():
    text = "a %FF%74%6F%6B%65%6E%3D%61%62%63%64%65%66%67%68%C3 b"
    assert secrets.all_spans(text)[1] == [(5, 0, 47)]


def test_inflated_data_of_any_size_and_depth(monkeypatch):
    monkeypatch.setattr(secrets, "WINDOW", 1 << 15)
    monkeypatch.setattr(secrets, "OVERLAP", 1 << 12)
    rng = random.Random(3)
    noise = lambda n: "".join(rng.choice("ghijklmnop qrstuvw") for _ in range(n))
    for before in (0, 40_000, 200_000, 32_768 - 10, 61_440 - 5):
        data = f"{noise(before)} {SECRET} {noise(50_000)}".encode()
        for _ in range(70):
            data = zlib.compress(data)
        coded = base64.b64encode(data).decode()
        found = [(a, k, b) for a, k, b in secrets.all_spans(f"x {coded} y")[1] if k == 0]
        whole = (2, 0, 2 + len(coded.rstrip("=")))  # data that can't be packed further may be found in parts of the run as well
        assert whole in found and all(a >= 2 and b == whole[2] for a, _, b in found)


def test_long_lines_take_little_memory():
    import time
    import tracemalloc

    text = "token%3Dabcdefgh " + "some words of a very long line " * 650_000 + "%70assword=hunter2hunter2"
    began = time.time()
    tracemalloc.start()
    _, found = secrets.all_spans(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len([x for x in found if x[1] == 0]) == 2
    assert len(text) > 20_000_000 and peak < 200_000_000 and time.time() - began < 60


def test_secret_query_awkward(spark):
    docs = awkward(spark)
    got = secrets.secret_spans(docs).toPandas()
    assert got[got.doc_id == 9].spans.item() == "assign:0:34,hex:8:34"
    assert got[got.doc_id == 4].base_sha256.item() == hashlib.sha256(b"").hexdigest()
    clean = secrets.redact(docs, length_col="fingerprint")
    assert clean.columns == docs.columns and clean.schema == docs.schema
    assert clean.where("doc_id = 9").first()["text"] == "[secret]"
    assert secrets.secret_spans(docs.limit(0)).count() == 0


# -- quality -----------------------------------------------------------------------------


def test_quality_on_held_out_labels(spark, sf01_dir):
    got = queries.op8_quality(spark, sf01_dir).toPandas()
    assert got.score.between(0, 1).all() and ((got.score >= 0.3) == got.predicted).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(got.doc_id, got.held_out))
    both = got.merge(pd.read_parquet(f"{sf01_dir}/labels.parquet"), on="doc_id")
    both = both[both.held_out]
    assert (both.predicted == both.quality).mean() > 0.95
    assert both[both.quality == 1].predicted.mean() > 0.97


def plain_ftrl(examples):
    """FTRL-proximal by loops over dictionaries."""
    z, n = defaultdict(float), defaultdict(float)
    labels = [y for _, y in examples]
    bias = (1 << quality.BITS)

    def weight(i):
        l1 = 0.0 if i == bias else quality.L1
        if abs(z[i]) <= l1:
            return 0.0
        sign = (z[i] > 0) - (z[i] < 0)
        return -(z[i] - sign * l1) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    for _ in range(quality.EPOCHS):
        for x, y in examples:
            x = {**x, bias: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = len(labels) / (2 * max(1, labels.count(y))) * (p - y) * v
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality.ALPHA
                z[i] += g - sigma * w[i]
                n[i] += g * g
    return weight, bias


def plain_features(text):
    """Counts of unigrams and bigrams of words and shapes in hashed slots, as 1 + log, of unit length."""
    tokens = re.findall(r"\w+|[^\w\s]+", text)
    words = [zlib.crc32(t.encode()) for t in tokens]
    shapes = [zlib.crc32(("\x00" + quality._shape(t)).encode()) for t in tokens]
    pair = lambda a, b: (a * 0x9E3779B1 + b * 0x85EBCA77) % (1 << 64) >> 13
    grams = words + shapes + [pair(*x) for x in zip(words, words[1:])] + [pair(*x) for x in zip(shapes, shapes[1:])]
    grams += [quality._TWICE for a, b in zip(words, words[1:]) if a == b]
    counts = Counter(g & ((1 << quality.BITS) - 1) for g in grams)
    length = math.sqrt(sum((1 + math.log(c)) ** 2 for c in counts.values()))
    return {i: (1 + math.log(c)) / length for i, c in counts.items()}


def test_quality_matches_plain_loops(spark, sf_dir):
    own = documents(sf_dir)
    labels = pd.read_parquet(f"{sf_dir}/labels.parquet").dropna(subset=["quality"])
    used = own.merge(labels[[zlib.crc32(str(i).encode()) % 5 != 0 for i in labels.doc_id]], on="doc_id")
    used = sorted(used.itertuples(), key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id))
    weight, bias = plain_ftrl([(plain_features(r.text), int(r.quality)) for r in used])
    got = queries.op8_quality(spark, sf_dir).toPandas().set_index("doc_id")
    assert len(got) == len(own)
    for row in own.itertuples():
        s = weight(bias) + sum(weight(i) * v for i, v in plain_features(row.text).items())
        assert abs(got.score[row.doc_id] - 1 / (1 + math.exp(-s))) < 1e-4
        assert got.held_out[row.doc_id] == (zlib.crc32(str(row.doc_id).encode()) % 5 == 0)


def test_quality_of_conflicting_labels(spark):
    docs = spark.createDataFrame([(1, "good words here"), (2, "bad ### ###")], "doc_id long, text string")
    one = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    two = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, None), (7, 1)], "doc_id long, quality int")
    assert (quality.fit(docs, one) == quality.fit(docs, two)).all()


def test_quality_of_several_texts_of_one_document(spark):
    """The same model in whatever order the rows come."""
    rows = [(1, "good words here"), (1, "other ### words"), (1, "third of them"), (2, "bad ### ###"), (2, "bad ### ###"), (3, None), (3, "more of it")]
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, quality int")
    models = [quality.fit(spark.createDataFrame(x, "doc_id long, text string").repartition(n), labels) for x, n in ((rows, 1), (rows[::-1], 3))]
    assert (models[0] == models[1]).all()


def test_quality_awkward(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (99, 1)], "doc_id long, quality int")
    docs = awkward(spark)
    model = quality.fit(docs, labels)
    assert len(quality.score(docs, model).collect()) == 11
    assert quality.keep_good(docs, model).columns == docs.columns
    none = quality.fit(docs, labels.limit(0))
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.score(docs.limit(0), none).count() == 0


def _raw_deflate(data):
    engine = zlib.compressobj(9, zlib.DEFLATED, -15)
    return engine.compress(data) + engine.flush()


@pytest.mark.parametrize("pack", [bz2.compress, lzma.compress, _raw_deflate, lambda d: bz2.compress(zlib.compress(d)), lambda d: lzma.compress(b"\x00\xff" + base64.b64encode(d))])
@pytest.mark.parametrize("wrapped", [False, True])
def test_compressed_layers_of_all_kinds(pack, wrapped):
    rng = random.Random(1)
    words = "".join(rng.choice("ghijk lm\n") for _ in range(300))
    data = pack(f'{words} token = "q9w8e7r6t5y4" {words}'.encode())
    run = base64.encodebytes(data).decode().rstrip("\n") if wrapped else base64.b64encode(data).decode()
    base, spans = secrets.all_spans(f"see {run} end")
    whole = (4, 0, 4 + len(run.rstrip("=")))
    assert base == [] and whole in spans
    joined = secrets.all_spans(f"key-{base64.b64encode(bz2.compress(words.encode() + b' password=hunter22 '))[:-4].decode()}")[1]
    assert joined == [] or joined[0][1] == 0


@pytest.mark.parametrize("kind,sign", [("utf-16-le", 0), ("utf-16-be", 1)])
def test_wide_text_in_base64(kind, sign):
    run = base64.b64encode("the password = hunter2222 is".encode(kind)).decode()
    spans = secrets.all_spans("x " + run)[1]
    first, last = 2 + 4 * 2 * 4 // 3, 2 + 25 * 2 * 4 // 3
    assert any(k == 0 and abs(a - first) <= 3 and abs(b - last) <= 3 for a, k, b in spans)


def test_octal_escapes():
    text = "".join(f"\\{ord(c):03o}" for c in "api_key:abc123def")
    assert secrets.all_spans(f"a {text} b") == ([], [(2, 0, 2 + len(text))])
    assert secrets.all_spans("C:\\123\\temp \\1 \\09")[1] == []


def test_work_on_long_runs_is_in_proportion():
    """Random base64, in which one byte in some hundreds begins like compressed data, in one line and in many."""
    data = random.Random(5).randbytes(3_000_000)
    for encode in (base64.b64encode, base64.encodebytes):
        took = []
        for n in (len(data) // 4, len(data)):
            text = encode(data[:n]).decode()
            began = time.process_time()
            secrets.all_spans(text)
            took.append(time.process_time() - began)
        assert took[1] < 8 * took[0] + 0.5


# -- pages -------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li><a>{n} menu</a></ul></nav>
<div class="cookie-notice">We use cookies</div><div><p>About us, always</p></div><div id="main"><h1>Head {n} &amp; more</h1>
<p>First&nbsp;{n}<br>line   <b>bold<p>Second {n}</div><div class="comments"><p>nice {n}</p></div><aside>see {n}</aside>
<form><input>go {n}</form><script>x="</p>{n}"</script><footer>&copy; {n}</footer></body></html>"""


def test_wrapper_induction_finds_constants_and_content(spark):
    rows = [(i, f"https://h.example/{i}", PAGE.format(n=f"w{i}")) for i in range(6)]
    rows += [(10, None, "<p>alone"), (11, "https://h.example/z", None), (12, "junk", ""), (13, "http://x.example", "no markup & such < x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1))
    got = html_extract.extract(pages).toPandas().set_index("page_id")
    assert got.text[3] == "Head w3 & more\n\nFirst w3 line bold\n\nSecond w3"
    assert got.text[10] == "alone" and got.text[11] == "" and got.text[12] == "" and got.text[13] == "no markup & such < x"
    assert (got.n_chars == got.text.str.len()).all()
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_every_layout_of_a_host_has_its_constants(spark):
    terms = " ".join(["terms"] * 40)
    a = "<body><div class='a'><p>Terms of A {t}</p></div><div class='t'><p>text {n}</p><p>all pages say so</p></div></body>"
    b = "<body><div class='t'><p>text {n}</p><p>all pages say so</p></div><section><div class='t'><p>Terms of B {t}</p></div></section></body>"
    html = lambda i, minor: (b if minor(i) else a).format(n=f"w{i}", t=terms)
    hosts = {"half": (40, lambda i: i % 2 == 0), "minor": (200, lambda i: i % 20 == 7)}
    rows = [(1000 * k + i, f"https://{h}.example/{i}", html(i, minor)) for k, (h, (n, minor)) in enumerate(hosts.items()) for i in range(n)]
    rows += [(9000 + i, f"https://copies.example/{i}", f"<body><div class='n{i}'></div><p>one text</p></body>") for i in range(9)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).toPandas().set_index("page_id").text
    # What all pages say outside of the region is template; a constant sentence in it stays.
    assert all(got[i] == (f"text w{i % 1000}\n\nall pages say so" if i < 9000 else "one text") for i, *_ in rows)


def neutral_page(i, comments=3, licence=True):
    """A page without article or main, whose names say nothing."""
    rng = random.Random(i)
    say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    menu = "".join(f"<li><a href='/{k}'>{say(2)}</a></li>" for k in range(12))
    legal = "This site uses your data as described at great length below. " * 12
    paragraphs = [say(rng.randint(8, 30)) for _ in range(rng.randint(2, 5))] + (["This article is published under a free licence."] if licence else [])
    body = f"<h1>{say(4)}</h1>" + "".join(f"<p>{p}</p>" for p in paragraphs)
    said = "".join(f"<div class='k{k % 2}'><span>{say(1)}</span><div>{say(1)}</div><p>{say(9)}</p></div>" for k in range(comments))
    html = f"<html><body><div class='c1'><ul>{menu}</ul></div><div class='c4'><p>{legal}</p></div><div class='c2'>{body}</div><div class='c3'>{said}</div></body></html>"
    return html, body


def test_neutral_names_need_the_wrapper(spark):
    """Menu, notice and comments go by alignment; alone, a page's long notice would win over its article."""
    made = [neutral_page(i, comments=i % 4) for i in range(30)]
    rows = [(i, f"https://n.example/{i}", html) for i, (html, _) in enumerate(made)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).toPandas().set_index("page_id").text
    want = ["\n\n".join(re.findall(r"<(?:h1|p)>(.*?)</(?:h1|p)>", body)) for _, body in made]
    assert [got[i] for i in range(30)] == want
    assert sum(html_extract.main_text(html) != w for (html, _), w in zip(made, want)) > 10


def test_whole_names_only(spark):
    html = (
        "<article><h1>t</h1><div class='share-price'><p>up 3</p></div><section id='related-work'><p>others</p></section>"
        "<div class='search-results'><p>found</p></div><fieldset><p>kept</p></fieldset><div class='ad'>buy</div><div class='related-links'><p>more</p></div></article>"
    )
    assert html_extract.main_text(html) == "t\n\nup 3\n\nothers\n\nfound\n\nkept"


def test_articles_in_main_and_in_articles():
    html = "<main><p>crumbs here</p><article><h1>t</h1><p>a long text of the article itself</p><article><p>nice</p></article><article><p>yes</p></article></article><div><p>other</p></div></main>"
    assert html_extract.main_text(html) == "t\n\na long text of the article itself"
    html = "<main><h1>t</h1><p>a long text of the page itself</p><article><p>teaser</p></article></main>"
    assert html_extract.main_text(html) == "t\n\na long text of the page itself\n\nteaser"


def test_simple_tree_matching_is_best():
    """Against all order-preserving matchings of small trees."""
    rng = random.Random(2)

    def tree(n):
        return [rng.choice("ab") for _ in range(n)], [rng.choice("xy") for _ in range(n)], [-1] + [rng.randrange(i) for i in range(1, n)]

    def ordered(t):
        """Numbered in page order, as outlines are."""
        below = [[j for j, p in enumerate(t[2]) if p == i] for i in range(len(t[0]))]
        order, stack = [], [0]
        while stack:
            i = stack.pop()
            order.append(i)
            stack += reversed(below[i])
        at = {i: k for k, i in enumerate(order)}
        return [t[0][i] for i in order], [t[1][i] for i in order], [-1 if i == 0 else at[t[2][i]] for i in order]

    def best(x, i, y, j):
        a, b = ([k for k, p in enumerate(t[2]) if p == at] for t, at in ((x, i), (y, j)))

        def pick(m, n):
            if m == len(a) or n == len(b):
                return 0
            out = max(pick(m + 1, n), pick(m, n + 1))
            return max(out, best(x, a[m], y, b[n]) + pick(m + 1, n + 1)) if x[0][a[m]] == y[0][b[n]] else out

        return 2 + (x[1][i] == y[1][j]) + pick(0, 0)

    for _ in range(300):
        x, y = ordered(tree(rng.randint(1, 8))), ordered(tree(rng.randint(1, 8)))
        got = html_extract.simple_tree_matching(*x, *y)
        assert len(set(got.values())) == len(got) and got[0] == 0
        for i, j in got.items():
            assert i == 0 or x[0][i] == y[0][j] and got[x[2][i]] == y[2][j]
        assert all((i < k) == (got[i] < got[k]) for i in got for k in got)
        assert sum(2 + (x[1][i] == y[1][j]) for i, j in got.items()) == best(x, 0, y, 0)


def test_pages_repeated_long_and_tied(spark):
    html = "<body><div><ul>" + "<li><a>m</a></li>" * 300 + "</ul></div><div>" + "".join(f"<p>word{i} and more</p>" for i in range(60_000)) + "</div></body>"
    rows = [(i, f"https://l.example/{i % 3}", html) for i in range(3)] + [(7, "https://l.example/7", "<p>x</p>"), (7, "https://l.example/7", "<p>x</p>")]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).toPandas()
    assert got[got.page_id == 7].text.tolist() == ["x", "x"]
    assert all(t.count("\n\n") == 59_999 for t in got[got.page_id < 3].text)


@pytest.mark.parametrize(
    "html,text",
    [
        ("<article><header class='entry-header'><h1>A &lt;b&gt;</h1></header><p>x<p>y<ul><li>1<li>2</ul></article>", "A <b>\n\nx\n\ny\n\n1\n\n2"),
        ("<header><h1>Site</h1></header><div class='content with-sidebar'><p>x</p><div class='sidebar'>s</div></div>", "x"),
        ("<main><p>a<script>if (1 < 2) { '</p>' }</script> b</p><section id='comments'><p>c</p></section></main><p>out</p>", "a b"),
        ("<div class='page-header'>h</div><p>a<br/>b&#8212;c</p><div class='ad-slot'>buy</div><div role='banner'>n</div><!-- c -->", "a b—c"),
        ("<table><tr><td>1<td>2<tr><td>3</table><pre>  k  l\n</pre>", "1\n\n2\n\n3\n\nk l"),
        ("<p hidden>no</p><p style='display: none'>no</p>&nbsp;yes", "yes"),
        ("<nav>only</nav>", ""),
        ("<div>" * 3000 + "deep", "deep"),
    ],
)
def test_page_parts(html, text):
    assert html_extract.main_text(html) == text


@pytest.mark.parametrize(
    "html,text",
    [
        ("<article><h1>t</h1><p>a text of some words</p><div class='related'><p>This section is prose about related work and has many words.</p></div></article>", "t\n\na text of some words\n\nThis section is prose about related work and has many words."),
        ("<article><h1>t</h1><p>words of text</p><div class='related'><p>See <a href='/'>one more of our long stories about this here</a></p></div></article>", "t\n\nwords of text"),
        ("<article><p class='share'>Prices of a share rose.</p><blockquote class='reply'>He replied at once.</blockquote><p>end</p></article>", "Prices of a share rose.\n\nHe replied at once.\n\nend"),
        ("<body><div><h1 class='page-header'>Title</h1><h2 class='section-header'>Part</h2><p>some text of it</p></div></body>", "Title\n\nPart\n\nsome text of it"),
        ("<main><h1>Title</h1><p>intro</p><article><p>a longer text of many words here</p></article><div><p>other</p></div></main>", "Title\n\nintro\n\na longer text of many words here"),
        ("<article><h1>t</h1><p>words of text</p><div class='alert'>watch out</div><p class='advert'>buy now</p></article>", "t\n\nwords of text"),
    ],
)
def test_names_drop_no_headings_and_no_prose(html, text):
    assert html_extract.main_text(html) == text


def long_page(n, seed=None):
    """Blocks in turns, or with a seed in any order."""
    rng = random.Random(seed)
    turn = lambda i: f"<h2>head {i}</h2><p>text {i} of it</p>"
    some = lambda i: rng.choice([f"<h2>head {i}</h2>", f"<p>text {i} of it</p>", f"<div class='k{i % 3}'><p>text {i} of it</p></div>", f"<ul><li>point {i}</li></ul>"])
    return "<body><div>" + "".join((turn if seed is None else some)(i) for i in range(n)) + "</div></body>"


@pytest.mark.parametrize("seed", [None, 4])
def test_long_pages_take_time_and_memory_in_proportion(seed):
    import tracemalloc

    outline = lambda k: html_extract.Outline(html_extract.parse(long_page(10_000 + k, seed and seed + k)))
    a, b = outline(0), outline(3)
    tracemalloc.start()
    began = time.process_time()
    match = html_extract.simple_tree_matching(a.tags, a.names, a.parents, b.tags, b.names, b.parents)
    assert time.process_time() - began < 20 and tracemalloc.get_traced_memory()[1] < 300 << 20
    tracemalloc.stop()
    assert len(match) > 0.7 * len(a.tags)


def test_siblings_in_turns_are_folded():
    fold = html_extract._folded
    assert fold([1, 1, 1, 2]) == [0, 0, 0, 3]
    assert fold([1, 2, 1, 2, 1, 2, 1]) == [0, 1, 0, 1, 0, 1, 6]
    assert fold([1, 2, 1, 2]) == [0, 1, 2, 3]
    assert fold([]) == []


def test_matching_in_halves_and_in_stretches(monkeypatch):
    rng = random.Random(8)
    weigh = lambda x, y, found: sum(3 if a == b else 2 for a, b in ((x[i], y[j]) for i, j in found))
    for _ in range(40):
        m = html_extract._Matching()
        x, y = ([rng.choice("ab") for _ in range(rng.randint(1, 40))] for _ in "xy")
        (own, _), (own2, _) = (m.classes(["r", *["p"] * len(z)], ["", *z], [-1, *[0] * len(z)]) for z in (x, y))
        best = m.pairs(own[1:], own2[1:])
        monkeypatch.setattr(html_extract, "SMALL", 4)
        halves = m.pairs(own[1:], own2[1:])
        assert weigh(x, y, halves) == weigh(x, y, best) == m.score(tuple(own[1:]), tuple(own2[1:]))
        monkeypatch.setattr(html_extract, "CELLS", 20)
        parts = m.pairs(own[1:], own2[1:])
        assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(parts, parts[1:]))
        monkeypatch.undo()


def test_wrappers_beyond_the_broadcast_bound(spark, monkeypatch):
    rows = [(i, f"https://h.example/{i}", PAGE.format(n=f"w{i}")) for i in range(6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    small = html_extract.extract(pages).toPandas().sort_values("page_id").text.tolist()
    monkeypatch.setattr(html_extract, "BROADCAST_ROWS", 0)
    assert html_extract.extract(pages).toPandas().sort_values("page_id").text.tolist() == small


def test_article_pages_of_the_tables(spark, sf_dir):
    got = queries.op10_html_extract(spark, sf_dir).toPandas().set_index("page_id")
    for page in pd.read_parquet(f"{sf_dir}/pages.parquet").itertuples():
        text = got.text[page.page_id]
        article = re.search("<article>(.*?)</article>", page.html, re.S).group(1)
        plain = lambda x: "".join(x.split())
        import html

        assert plain(text) == plain(html.unescape(re.sub("<[^>]*>", "", article)))


# -- oracle ------------------------------------------------------------------------------


def test_exact_dedup_oracle(spark, sf_dir):
    duckdb.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
    want = duckdb.execute(exact_dedup.ORACLE_SQL).df().sort_values("doc_id").reset_index(drop=True)
    got = queries.op4_exact_dedup(spark, sf_dir).toPandas()[want.columns].sort_values("doc_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want, check_dtype=False)
