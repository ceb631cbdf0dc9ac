"""What the queries without oracle SQL must return, by plain loops over the tables."""

import hashlib
import itertools
import math
import random
import re
import unicodedata
from collections import Counter, defaultdict

import pandas as pd

from corpusloom.functions import seq
from corpusloom.operators import clean, metrics, sample
from tests.test_functions import in_signs, slow_bleu, slow_chrf, slow_clamp, slow_collapse, slow_statistics

REFERENCES = {}


def reference(name):
    def keep(fn):
        REFERENCES[name] = fn
        return fn

    return keep


class Tables:
    def __init__(self, folder):
        self.folder, self.stats = folder, {}

    def __getattr__(self, name):
        frame = pd.read_parquet(f"{self.folder}/{name}.parquet")
        setattr(self, name, frame)
        return frame

    def texts(self):
        return list(zip(self.documents.doc_id.tolist(), self.documents.text.tolist()))

    def pairs(self):
        out = []
        for conv, own in self.conversations.sort_values(["conv_id", "turn"]).groupby("conv_id"):
            own = own.to_dict("records")
            for a, b in zip(own, own[1:]):
                if (a["role"], b["role"]) == ("user", "assistant"):
                    out.append({"id": conv * 1000 + a["turn"], "conv_id": conv, "turn": a["turn"], "source": a["text"], "target": b["text"]})
        return out

    def chunks(self):
        out = []
        for conv, own in self.conversations.sort_values(["conv_id", "turn"]).groupby("conv_id"):
            for r in own.to_dict("records"):
                t, text = r["turn"], r["text"]
                said = "" if t % 7 == 6 else (text[:30] + " ") * 5 if t % 4 == 1 and conv % 5 == 0 else text[: len(text) // 3] if t % 3 == 0 else text
                out.append({
                    "id": conv * 1000 + t, "parent": conv, "index": t, "total": len(own), "source": text, "reference": text.replace("e", "E"), "prediction": said,
                    "short": t % 5 == 3 or t % 5 == 4,
                })
        return out

    def candidates(self):
        out = []
        for p in self.pairs():
            half = len(p["target"]) // 2
            a, b = p["target"][:half], p["target"][half:]
            for label, text in (("a", a), ("b", a if p["id"] % 3 == 0 else b), ("c", p["target"].replace("e", "E"))):
                out.append({"id": p["id"], "label": label, "text": text, "reference": p["target"]})
        return out

    def dirty(self):
        out = []
        for i, text in self.texts():
            head = ("{ d }" if i % 5 == 0 else "") + ("< gap >" if i % 7 == 0 else "") + ("​" if i % 3 == 0 else "")
            out.append((i, head + text.replace(" the ", "  the\t").replace("\n", "\r\n")))
        return out

    def score(self, *pairs):
        """(bleu, chrf, geom) of the pairs together."""
        for p in pairs:
            if p not in self.stats:
                self.stats[p] = slow_statistics(*p)
        total = [sum(x) for x in zip(*[self.stats[p] for p in pairs])]
        b, c = slow_bleu(total), slow_chrf(total)
        return b, c, math.sqrt(max(b, 0) * max(c, 0))


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def number(text):
    return int(md5(text)[:8], 16)


def repeats(text, least=4):
    w = text.split()
    return sum(c - least + 1 for c in Counter(zip(w, w[1:], w[2:])).values() if c >= least)


STEMS = ("Seal of", "Sealed by", "send me the silver", "will pay the silver", "not paid the silver")


def formulas(text):
    return sum(text.count(s) for s in STEMS)


def loops(text):
    return " ".join([text, text[:40], text[:40], text[:40], "Seal of a Seal of a Seal of a Seal of a x y z w v u"])


def slow_formulas(text, times=2):
    """With a sign for each word: behind a formula's signs a repeated group of 2, 3 or 4, where the text is long enough."""
    for stem in STEMS:
        signs, words = in_signs(text.split() + stem.split())
        own, size = signs[len(signs) - len(stem.split()) :], len(stem.split())
        loops = "|".join(rf"(?=.{{{n * size}}})(.{{{n}}})\{n - 1}{{{times},}}" for n in (2, 3, 4))
        found = re.compile(rf"(?s)(?={own})(?:{loops}|{own})")
        signs = found.sub(lambda m: m[m.lastindex] * times if m.lastindex else m[0], signs[: len(signs) - size])
        text = " ".join(words[x] for x in signs)
    return text


def gaps(text):
    text = re.sub(r"(?i)(?<!<)\bgap>", "<gap>", text)
    return " ".join(re.sub(r"<gap>\s*<gap>", "<gap>", text).split())


def patched(text):
    return slow_formulas(" ".join(slow_clamp(gaps(text).split(), 12, 2)))


@reference("T13_repair_gaps")
def _(t):
    return [{"doc_id": i, "text": gaps(x.replace(" the ", " gap> <gap> <gap> "))} for i, x in t.texts()]


@reference("T14_collapse_spans")
def _(t):
    return [{"doc_id": i, "text": " ".join(slow_collapse(loops(x).split(), 8))} for i, x in t.texts()]


@reference("T15_clamp_spans")
def _(t):
    return [{"doc_id": i, "text": " ".join(slow_clamp(loops(x).split(), 12, 2))} for i, x in t.texts()]


@reference("T16_formula_loops")
def _(t):
    return [{"doc_id": i, "text": slow_formulas(loops(x))} for i, x in t.texts()]


@reference("T17_sanitize_draft")
def _(t):
    out = []
    for i, x in t.texts():
        text = "<chunk_1> " + loops(x)
        for pattern in (r"<parent_chunk_total>\d+</parent_chunk_total>", r"</?chunk_\d+>", r"/chunk_\d+>", r"\bchunk_idx\s*=\s*\d+\b", r"\bchunk_\d+\b", r"\bFinal translation:\b"):
            text = re.sub(pattern, " ", text, flags=re.I)
        words = slow_collapse(text.split(), 8)
        out.append({"doc_id": i, "text": " ".join(words if len(words) <= 120 else words[:100] + ["..."] + words[-20:])})
    return out


@reference("T18_term_lexicon")
def _(t):
    rules = [(r"(?i)\bseal o\b", "Seal of"), (r"(?i)\bseal of\b", "Seal of"), (r"(?i)\bsealed by\b", "Sealed by")]
    rules += [(r"(?i)\bSeal of Theran\b", "Seal of Theran"), (r"(?i)\bseal of?\s+Theran\b", "Seal of Theran"), (r"(?i)\bTHE\b", "THE"), (r"(?i)\bHaed\b", "Haed")]
    out = []
    for i, x in t.texts():
        text = loops(x)
        text = re.sub(r"\b(\d+)\s+(\d{4})(?=\s+(?:minas?|shekels?|talents?|textiles?|litres?)\b)", r"\1.\2", text)
        for pattern, to in rules:
            text = re.sub(pattern, to, text)
        out.append({"doc_id": i, "text": " ".join(text.split())})
    return out


@reference("T21_selective_patch")
def _(t):
    return [{"doc_id": i, "text": patched(loops(x))} for i, x in t.texts()]


@reference("T10_token_keys")
def _(t):
    counts = Counter()
    for _, x in t.texts():
        for token in x.split():
            key = unicodedata.normalize("NFC", token).lower()
            for k, c in enumerate("₀₁₂₃₄₅₆₇₈₉"):
                key = key.replace(c, str(k))
            key = key.strip("…\"'")
            counts[re.sub(r"^[^\w<]+|[^\w>]+$", "", key)] += 1
    return [{"token_key": k, "n": n} for k, n in counts.items()]


@reference("A8_pattern_examples")
def _(t):
    out = []
    for name, pattern in clean.PATTERNS.items():
        hits, shown = 0, []
        for i, x in sorted(t.dirty()):
            for m in re.finditer(pattern, x, re.M):
                hits += 1
                part = x[max(0, m.start() - 50) : m.end() + 50]
                shown.append((i, part if len(part) <= 160 else part[:159] + "…"))
        out.append({"pattern": name, "hits": hits, "examples": shown[:10] or None})
    return out


@reference("M23_character_names")
def _(t):
    counts = Counter(c for _, x in t.texts() for c in x)
    return [{"char": c, "count": n, "codepoint": ord(c), "name": unicodedata.name(c, "UNKNOWN")} for c, n in counts.items()]


@reference("M14_noise_score")
def _(t):
    out = []
    for p in t.pairs():
        s, r = p["source"].split(), p["target"].split()
        ratio = len(r) / max(1, len(s))
        score = 1.5 * (p["id"] % 2 == 0) + min(2.0, p["id"] % 10 / 10 / 0.4) + {0: 0.75, 1: 0.25, 2: 0.0}[p["id"] % 3]
        score += 0.5 * (repeats(p["target"], 3) > 0) + 0.25 * (repeats(p["source"], 3) > 0)
        score += 1.0 if ratio < 0.3 or ratio > 2.2 else 0.5 if ratio < 0.45 or ratio > 1.7 else 0.0
        score += 0.25 * (p["target"].count("<gap>") >= 3) + 0.25 * (p["turn"] + 1 >= 8)
        out.append({"id": p["id"], "score": score})
    return out


def split_by(text, pattern):
    text = re.sub("\r\n?", "\n", text).strip()
    return [p.strip() for p in re.split(pattern, text) if p.strip()] or ([text] if text else [])


def equal_parts(text, n):
    words = text.split(" ")
    words = [w for w in words if w]
    if not words:
        return [""]
    n = max(1, min(n, len(words)))
    cuts = [round(i * len(words) / n) for i in range(n + 1)]
    return [p for p in (" ".join(words[a:b]) for a, b in zip(cuts, cuts[1:])) if p]


def packed(text, n, pattern):
    parts = split_by(text, pattern)
    if len(parts) < n:
        return equal_parts(text, n)
    budget, out, now = max(1, sum(len(p) for p in parts) / n), [], []
    for k, part in enumerate(parts):
        now.append(part)
        rest = len(parts) - k - 1
        missing = n - len(out) - 1
        if rest < missing or (sum(map(len, now)) >= budget and missing <= rest):
            out.append(" ".join(now))
            now = []
    if now:
        out.append(" ".join(now))
    return out if len(out) >= n else equal_parts(text, n)


@reference("R3_packed_targets")
def _(t):
    return [{"doc_id": i, "parts": packed(x, 4, r"\n|\.|;")} for i, x in t.texts()]


def by_ratio(text, ratios):
    words = [w for w in text.split(" ") if w]
    if not words:
        return [""] * len(ratios)
    out, at = [], 0
    for k, r in enumerate(ratios):
        stop = len(words) if k == len(ratios) - 1 else min(len(words), at + max(1, round(len(words) * r / sum(ratios))))
        out.append(" ".join(words[at:stop]))
        at = stop
    return out


@reference("R4_ratio_split")
def _(t):
    return [{"doc_id": i, "parts": by_ratio(x, [1, 2, 1])} for i, x in t.texts()]


def resized(parts, n):
    if len(parts) == n:
        return parts
    whole = " ".join(p for p in parts if p).strip()
    return equal_parts(whole, n) if whole else [""] * n


@reference("R5_resize")
def _(t):
    return [{"doc_id": i, "parts": resized(split_by(x, "\n"), 3)} for i, x in t.texts()]


def two(text):
    parts = equal_parts(text, 2)
    if len(parts) > 1:
        return parts
    half = max(1, len(text.strip()) // 2)
    return [text.strip()[:half].strip(), text.strip()[half:].strip()]


def limited(rows, limits, most=8):
    """Rows of texts, a column for each limit; the worst row is halved until all fit."""
    rows = [list(r) for r in rows]
    while len(rows) < most:
        over = [max(len(x.encode()) + 1 - m for x, m in zip(r, limits)) for r in rows]
        if not rows or max(over) <= 0:
            break
        k = over.index(max(over))
        rows[k : k + 1] = [list(r) for r in zip(*[two(x) for x in rows[k]])]
    return rows


@reference("R6_fit_limits")
def _(t):
    return [{"doc_id": i, "parts": [r[0] for r in limited([[x]], [384])]} for i, x in t.texts()]


def chunked_pair(source, target):
    size = lambda x: len(x.encode()) + 1
    needed = max(1, math.ceil(size(source) / 384), math.ceil(size(target) / 384))
    if needed == 1:
        return "none", [[source, target]]
    left, right = split_by(source, r"\n|;|\|"), split_by(target, r"\n|;|\.|!|\?")
    if len(left) == len(right) >= 2:
        mode, n = "delimiter_aligned", min(8, len(left))
        left, right = resized(left, n), resized(right, n)
    else:
        mode, n = "ratio", min(8, max(2, needed))
        right = packed(target, n, r"\n|;|\.|!|\?")
        left = by_ratio(source, [max(1, len(x)) for x in right])
    if len(left) != len(right):
        return "fallback_single", [[source, target]]
    return mode, limited(list(zip(left, right)), [384, 384])


def chunk_rows(key, mode, rows, fields):
    n = len(rows)
    return [
        {"chunk_key": str(key) if n == 1 else f"{key}__c{i + 1}of{n}", "parent": key, "chunk_index": i, "chunk_total": n, "is_chunk": n > 1, "chunk_mode": mode, **dict(zip(fields, r))}
        for i, r in enumerate(rows)
    ]


@reference("R7_chunk_pairs")
def _(t):
    return [x for p in t.pairs() for x in chunk_rows(p["id"], *chunked_pair(p["source"], p["target"]), ["source", "target"])]


@reference("R7_chunk_udtf")
def _(t):
    out = []
    for p in t.pairs():
        mode, rows = chunked_pair(p["source"], p["target"])
        out += [{"id": p["id"], "mode": mode, "chunk_index": i, "chunk_total": len(rows), "source": a, "target": b} for i, (a, b) in enumerate(rows)]
    return out


@reference("R8_chunk_sources")
def _(t):
    out = []
    for i, x in t.texts():
        needed = max(1, math.ceil((len(x.encode()) + 1) / 384))
        parts = split_by(x, r"\n|;|\|")
        if needed == 1:
            mode, rows = "none", [[x]]
        elif len(parts) >= 2:
            mode, rows = "delimiter_only", limited([[p] for p in resized(parts, min(8, len(parts)))], [384])
        else:
            mode, rows = "ratio_only", limited([[p] for p in equal_parts(x, min(8, max(2, needed)))], [384])
        out += chunk_rows(i, mode, rows, ["source"])
    return out


@reference("R9_sentence_split")
def _(t):
    return [{"doc_id": i, "sentences": [p.strip() for p in re.split(r"(?:\n+|(?<=[.!?;:])\s+)", x) if p.strip()]} for i, x in t.texts()]


def segments(p):
    left = []
    for part in split_by(p["source"], r"\n|;|\|"):
        left += [x.strip() for x in re.split(r"(?:^|\s)\d+\.\s+", part) if x.strip()] or [part]
    right = [x.strip() for x in re.split(r"(?:\n+|(?<=[.!?;:])\s+)", re.sub("\r\n?", "\n", p["target"]).strip()) if x.strip()]
    return left, right


def sentence_pairs(t):
    return [{**p, "source": p["target"].replace(". ", "; ").replace("; T", " T")} for p in t.pairs()]


def length_ratio(pairs):
    ratios = sorted((len(p["target"]) + 1) / (len(p["source"]) + 1) for p in pairs)
    k = len(ratios)
    return min(5.0, max(0.2, (ratios[(k - 1) // 2] + ratios[k // 2]) / 2)) if k else 1.0


def aligned(t):
    """Segment pairs of the cheapest path, found by a table of costs."""
    alpha, out = length_ratio(sentence_pairs(t)), []
    for p in sentence_pairs(t):
        left, right = segments(p)
        if not left or not right or len(left) > 80 or len(right) > 80:
            continue
        cost = {(0, 0): (0.0, [])}
        for i, j in itertools.product(range(len(left) + 1), range(len(right) + 1)):
            if (i, j) not in cost:
                continue
            for a, b in ((1, 1), (1, 2), (2, 1)):
                if i + a > len(left) or j + b > len(right):
                    continue
                s, r = " ".join(left[i : i + a]), " ".join(right[j : j + b])
                step = abs(math.log(max(1e-6, len(r) / len(s) / alpha))) + (0.25 if a + b > 2 else 0)
                now = cost[i, j][0] + step
                if (i + a, j + b) not in cost or now < cost[i + a, j + b][0]:
                    cost[i + a, j + b] = (now, cost[i, j][1] + [(s, r, f"{a}:{b}", step)])
        for k, (s, r, kind, step) in enumerate(cost.get((len(left), len(right)), (0, []))[1]):
            out.append({"id": p["id"], "segment": k, "source": s, "target": r, "align_type": kind, "align_cost": step})
    return out


@reference("R10_length_alignment")
def _(t):
    return aligned(t)


@reference("F8_aligned_filter")
def _(t):
    out = []
    for x in aligned(t):
        s, r = len(x["source"].encode()) + 1, len(x["target"].encode()) + 1
        if x["align_cost"] <= 1.2 and 3 <= s <= 256 and 3 <= r <= 256 and 0.4 <= r / s <= 2.5 and (not re.search("[0-9]", x["source"]) or re.search("[0-9]", x["target"])):
            out.append(x)
    return out


@reference("R13_masked_spans")
def _(t):
    out = []
    for i, x in t.texts():
        words = [w for w in x.split(" ") if w]
        source, target = x, x
        if len(words) > 4:
            rng, wanted, masked = random.Random(f"42|{i}"), max(1, round(len(words) * 0.15)), set()
            while len(masked) < wanted:
                start = rng.randrange(len(words))
                if start in masked:
                    continue
                stop = min(len(words), start + rng.randint(1, 3))
                for k in range(start, stop):
                    if len(masked) < wanted:
                        masked.add(k)
            a, b, mark = [], [], 0
            for on, group in itertools.groupby(range(len(words)), key=lambda k: k in masked):
                run = [words[k] for k in group]
                a += [f"<extra_id_{mark}>"] if on else run
                b += [f"<extra_id_{mark}>", *run] if on else []
                mark += on
            source, target = " ".join(a), " ".join(b)
        out.append({"doc_id": i, "source": source, "target": target})
    return out


def found_spans(tokens, words):
    starts, cursor = [], 0
    for w in words:
        at = -1
        if w:
            for k in range(cursor, len(tokens)):
                if tokens[k] == w:
                    at, cursor = k, k + 1
                    break
        starts.append(at)
    return starts


@reference("W6_cursor_scan")
def _(t):
    return [{"doc_id": i, "starts": found_spans(x.split(), [line.split(" ")[0] for line in x.split("\n")])} for i, x in t.texts()]


@reference("R14_anchor_spans")
def _(t):
    out = []
    for i, x in t.texts():
        tokens = x.split()
        starts = found_spans([seq.token_key(w) for w in tokens], [seq.token_key(line.strip(" ").split(" ")[0]) for line in x.split("\n")])
        for k, a in enumerate(starts):
            if a >= 0:
                stop = min([b for b in starts[k + 1 :] if b > a][:1] or [len(tokens)])
                out.append({"doc_id": i, "position": k, "first_token": a, "last_token": stop, "span": " ".join(tokens[a:stop])})
    return out


@reference("W8_chunk_windows")
def _(t):
    out = {}
    for parent, own in itertools.groupby(t.chunks(), key=lambda c: c["parent"]):
        own = list(own)
        i = 0
        while i < len(own):
            n = 1
            while n < 3 and i + n < len(own) and all(sum(len(c[k].encode()) for c in own[i : i + n + 1]) + n + 1 <= 2000 for k in ("source", "reference")):
                n += 1
            row = {"parent": parent, "first_chunk": i, "n_chunks": n, **{k: " ".join(c[k] for c in own[i : i + n]) for k in ("source", "reference")}}
            out.setdefault((parent, row["source"], row["reference"]), row)
            i += n if len(own) <= 3 else 1
    return list(out.values())


@reference("P8_flat_prompt")
def _(t):
    out = []
    for parent, own in itertools.groupby(t.chunks(), key=lambda c: c["parent"]):
        labels = defaultdict(list)
        for c in own:
            labels[c["prediction"]].append(c["index"])
        rows = sorted((v[0], v, text) for text, v in labels.items() if text)
        if rows:
            out.append({"parent": parent, "prompt": "\n".join(",".join(f"c{i + 1}" for i in v[:6]) + ": " + text for _, v, text in rows)})
    return out


@reference("L8_balanced_sample")
def _(t):
    groups = defaultdict(list)
    for r in t.documents.sort_values("doc_id").itertuples():
        groups[r.source].append(r.doc_id)
    names, drawn = sorted(groups), defaultdict(list)
    for i in range(400):
        own = names[number(f"42{i}") % len(names)]
        drawn[own].append(groups[own][number(f"42child{i}") % len(groups[own])])
    return [{"source": k, "n": len(v), "n_docs": len(set(v))} for k, v in drawn.items()]


@reference("L11_stratified_draws")
def _(t):
    out, need = [], {"en": 5, "de": 3}
    for it in range(20):
        rows = []
        for lang, own in t.documents.groupby("lang"):
            ranked = sorted((md5(f"42|{it}|{i}"), i) for i in own.doc_id)
            rows += [(k >= need.get(lang, 0), d, i) for k, (d, i) in enumerate(ranked)]
        ids = [i for *_, i in sorted(rows)[:10]]
        out.append({"iteration": it, "n": len(ids), "ids": sum(ids)})
    return out


def votes(t, weights):
    """The pairs that a weighted vote chooses."""
    by_id = defaultdict(lambda: defaultdict(float))
    refs = {}
    for c in t.candidates():
        by_id[c["id"]][c["text"]] += weights[c["label"]]
        refs[c["id"]] = c["reference"]
    return [(min(v, key=lambda x: (-round(v[x], 12), len(x), x)), refs[i]) for i, v in by_id.items()]


@reference("L12_weight_search")
def _(t):
    out = []
    for k, w in enumerate(sample.dirichlet_weights(["a", "b", "c"], 12, "42")):
        chosen = votes(t, w)
        out.append({"weight_id": k, "n_rows": len(chosen), "geom": t.score(*chosen)[2]})
    return out


@reference("D4_weight_search")
def _(t):
    out = []
    for k, w in enumerate(sample.dirichlet_weights(["a", "b", "c"], 8, "7")):
        b, c, g = t.score(*votes(t, w))
        out.append({"weight_id": k, "bleu": b, "chrfpp": c, "geom": g})
    return out


def by_id(t):
    out = defaultdict(list)
    for c in t.candidates():
        out[c["id"]].append(c)
    return out


@reference("D6_minimum_risk")
def _(t):
    out = []
    for i, own in by_id(t).items():
        utility = {}
        for a in own:
            others = [t.score((a["text"], b["text"]))[2] for b in own if b["label"] != a["label"]]
            utility[a["label"]] = round(sum(others) / len(others), 9)
        best = max(utility.values())
        near = [a for a in own if utility[a["label"]] >= best - 0.35]
        pick = min(near, key=lambda a: (repeats(a["text"]), formulas(a["text"]), -utility[a["label"]], len(a["text"]), a["label"]))
        out.append({"id": i, "label": pick["label"], "utility": utility[pick["label"]]})
    return out


@reference("D7_oracle_pick")
def _(t):
    out = []
    for i, own in by_id(t).items():
        scored = [(-round(t.score((a["text"], a["reference"]))[2], 9), a["label"]) for a in own]
        g, label = min(scored)
        out.append({"id": i, "label": label, "geom": -g})
    return out


@reference("D7_heuristic_pick")
def _(t):
    out = []
    for c in t.chunks():
        floor = len(c["reference"].split()) * 0.12
        rank = lambda x: (-4 * repeats(x), -2 * formulas(x), -max(0.0, floor - len(x.split())), len(x))  # noqa: E731, B023
        out.append({"id": c["id"], "text": c["source"] if rank(c["source"]) > rank(c["prediction"]) else c["prediction"]})
    return out


ACTION_NAMES = ("pass_a_prediction", "selective_patch_light", "looptrim_concat")


def actions(t):
    out = []
    for c in t.chunks():
        band = "le_3" if c["total"] <= 3 else "4_6" if c["total"] <= 6 else "gt_6"
        out.append({"id": c["id"], "parent": c["parent"], "bucket": band, "reference": c["reference"], **dict(zip(ACTION_NAMES, (" ".join([c["prediction"]] * 3), c["prediction"], c["source"])))})
    return out


@reference("D8_bucket_policy")
def _(t):
    rows, policy = actions(t), {}
    tune = [r for r in rows if number(str(r["parent"])) % 10 < 4]
    for bucket in {r["bucket"] for r in tune}:
        own = [r for r in tune if r["bucket"] == bucket]
        geoms = [round(t.score(*[(r[a], r["reference"]) for r in own])[2], 9) for a in ACTION_NAMES]
        policy[bucket] = ACTION_NAMES[geoms.index(max(geoms))] if bucket == "4_6" else ACTION_NAMES[0]
    out = []
    for r in rows:
        action = policy.get(r["bucket"], ACTION_NAMES[0])
        base, text = r[ACTION_NAMES[0]], r[action]
        ratio = len(text.split()) / max(1, len(base.split()))
        gain = repeats(base) - repeats(text) + formulas(base) - formulas(text)
        out.append({"id": r["id"], "bucket": r["bucket"], "action": action, "switched": action != ACTION_NAMES[0] and ratio >= 0.8 and gain >= 1})
    return out


@reference("D9_row_gate")
def _(t):
    opened, rows = [], actions(t)
    for r in rows:
        base, best = r[ACTION_NAMES[0]], None
        for name in ACTION_NAMES[1:]:
            gain = repeats(base) - repeats(r[name])
            if gain >= 1 and len(r[name].split()) >= len(base.split()) * 0.3:
                score = round(gain + 0.5 * (formulas(base) - formulas(r[name])) + 0.002 * (len(r[name].split()) - len(base.split())), 9)
                best = score if best is None else max(best, score)
        if best is not None and best >= 1.0:
            opened.append((-best, r["id"]))
    rank = {i: k + 1 for k, (_, i) in enumerate(sorted(opened)[:40])}
    return [{"id": r["id"], "gate_rank": rank.get(r["id"]), "switched": r["id"] in rank} for r in rows]


@reference("D10_gate_grid")
def _(t):
    rows, cells = actions(t), []
    for ratio, gain, threshold, cap in itertools.product([0.3, 0.8], [1, 2], [0, 1], [10, -1]):
        ok = []
        for r in rows:
            a, b = r[ACTION_NAMES[0]], r[ACTION_NAMES[1]]
            g = repeats(a) - repeats(b)
            x = round(g + 0.5 * (formulas(a) - formulas(b)) + 0.002 * (len(b.split()) - len(a.split())), 9)
            if len(b.split()) / max(1, len(a.split())) >= ratio and g >= gain and x >= threshold:
                ok.append((-x, r["id"]))
        on = {i for _, i in sorted(ok)[: cap if cap >= 0 else None]}
        b, c, geom = t.score(*[(r[ACTION_NAMES[1 if r["id"] in on else 0]], r["reference"]) for r in rows])
        cells.append({"ratio": ratio, "gain": gain, "threshold": threshold, "cap": cap, "switched": len(on), "n_rows": len(rows), "bleu": b, "chrfpp": c, "geom": geom})
    best = max(round(c["geom"], 6) for c in cells)
    return [c for c in cells if round(c["geom"], 6) >= best - 0.03]


@reference("D12_concat_rerank")
def _(t):
    out = []
    for parent, own in itertools.groupby(t.chunks(), key=lambda c: c["parent"]):
        parts = [" ".join(c["prediction"].split()) for c in own]
        parts = [p for p in parts if p]
        raw, once = " ".join(parts), " ".join(p for k, p in enumerate(parts) if k == 0 or parts[k - 1] != p)
        options = {"raw": raw, "gapfix": gaps(raw), "looptrim": patched(raw), "looptrim_dedupe": patched(once)}

        def score(x):
            share = len(x.split()) / max(1, len(raw.split()))  # noqa: B023
            bad = 40 if re.search(r"\bc\d+:", x) else 0
            return round(max(0.0, 0.82 - share) * 120 + x.count("gap>") * 18 + repeats(x) * 4 + max(0.0, formulas(x) - 18.0) * 0.8 + bad, 9)

        name = min(options, key=lambda k: (score(options[k]), k != "raw", k))
        out.append({"parent": parent, "name": name, "score": score(options[name]), "text": options[name]})
    return out


@reference("D25_group_folds")
def _(t):
    """Groups from the largest down, each to the lightest fold, without any plan on sizes."""
    sizes, weights, fold = Counter(t.documents.source), [0] * 5, {}
    for name, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        fold[name] = weights.index(min(weights))
        weights[fold[name]] += n
    return [{"doc_id": r.doc_id, "fold": fold[r.source], "group_kind": "group"} for r in t.documents.itertuples()]


def grouped(t, rows, key, pair):
    out = defaultdict(list)
    for r in rows:
        out[key(r)].append(pair(r))
    return {k: (len(v), *t.score(*v)) for k, v in out.items()}


def metric_rows(t, rows, names, key, pair, columns=("n_rows", "bleu", "chrfpp", "geom")):
    out = []
    for k, v in grouped(t, rows, key, pair).items():
        all_of = dict(zip(("n_rows", "bleu", "chrfpp", "geom"), v))
        out.append({**dict(zip(names, k if isinstance(k, tuple) else (k,))), **{c: all_of[c] for c in columns}})
    return out


@reference("A13_corpus_bleu")
def _(t):
    return metric_rows(t, t.candidates(), ["label"], lambda c: c["label"], lambda c: (c["text"], c["reference"]), ("n_rows", "bleu"))


@reference("A14_corpus_chrf")
def _(t):
    return metric_rows(t, t.candidates(), ["label"], lambda c: c["label"], lambda c: (c["text"], c["reference"]), ("n_rows", "chrfpp"))


def bucket(c):
    return "le_3" if c["total"] <= 3 else "4_6" if c["total"] <= 6 else "gt_6"


@reference("A22_bucketed_metrics")
def _(t):
    return metric_rows(t, t.chunks(), ["bucket"], bucket, lambda c: (c["prediction"], c["reference"]))


def translated(t):
    """(source, reference) of each document."""
    puts = {0: (" the ", " 5 ma-na "), 1: (" and ", " qí-bi ")}
    for d, text in t.texts():
        source = text.replace(*puts[d % 4]) if d % 4 < 2 else text + " x [x]" if d % 4 == 2 else text
        head = {0: "From Aššur-idi to Puzur and Ilī: ", 1: "To Šalim-ahum, the man of iron and Enlil-bani: "}.get(d % 3, "")
        body = text.replace(" the ", f" {d % 3 + 1} minas of silver, ") if d % 5 == 0 else text.replace(" and ", ". Seal of  Nabû son of Iddin; ") if d % 5 == 1 else text
        yield source, head + body


@reference("A22_targeted_buckets")
def _(t):
    edge = "[]{}()<>.,;:\"'`"
    names = [[w for w in (w.strip(edge) if w != "<gap>" else w for w in s.lower().split()) if w != "<gap>" and len(w) >= 4 and not re.search(r"[\d₀-₉⁰¹²³⁴-⁹]", w)] for s, _ in translated(t)]
    seen = Counter(w for own in names for w in own)
    units = ("mina", "minas", "shekel", "shekels", "talent", "talents", "textile", "textiles", "litre", "litres", "silver", "tin", "copper")
    rows = []
    for (s, r), own in zip(translated(t), names, strict=True):
        pair = (r[: len(r) * 2 // 3], r)
        if re.search(r"<gap>|[\[\]{}<>]|[₀-₉]|(?<!\w)x(?!\w)", s, re.I):
            rows.append((pair, "marker_rich"))
        if re.search(r"\b(?:ma-na|ma\.na|gin2|g[íi]n|gur|qa|sila3|iku|sar)\b", s, re.I) or any(u in r.lower() for u in units):
            rows.append((pair, "measure"))
        if formulas(r) or re.search(r"\b(?:um-ma|q[ií]-bi|ki-a-am|li-mu-um)\b", s, re.I):
            rows.append((pair, "formula"))
        if any(seen[w] <= 2 for w in own):
            rows.append((pair, "rare_name"))
    assert len({name for _, name in rows}) == 4
    return metric_rows(t, rows, ["bucket"], lambda x: x[1], lambda x: x[0])


@reference("A34_pair_similarity")
def _(t):
    sides = defaultdict(list)
    for own in by_id(t).values():
        for a, b in itertools.permutations(own, 2):
            sides[a["label"], b["label"]].append((a["text"], b["text"]))
    out = []
    for l, r in itertools.combinations("abc", 2):
        one, two_ = t.score(*sides[l, r]), t.score(*sides[r, l])
        out.append({"l": l, "r": r, "bleu": (one[0] + two_[0]) / 2, "chrfpp": (one[1] + two_[1]) / 2})
    return out


@reference("A40_changed_subset_metrics")
def _(t):
    rows = [(name, c[name], c["reference"]) for c in t.chunks() if c["prediction"] != c["source"] for name in ("prediction", "source")]
    return metric_rows(t, rows, ["name"], lambda x: x[0], lambda x: x[1:])


@reference("A42_evaluation_slices")
def _(t):
    rows = []
    for c in t.chunks():
        part = number(str(c["parent"])) % 10
        split = "tune" if part < 4 else "holdout" if part < 7 else "report"
        rows += [(c, (name, split)) for name, on in (("all", True), ("hard", c["total"] >= 5), ("short", c["short"])) if on]
    return metric_rows(t, rows, ["slice", "split"], lambda x: x[1], lambda x: (x[0]["prediction"], x[0]["reference"]))


@reference("A43_parameter_sweep")
def _(t):
    rows = [(a, c["source"][: math.ceil(len(c["source"]) * a)], c["reference"]) for c in t.chunks() for a in (0.0, 0.25, 0.5, 1.0)]
    return metric_rows(t, rows, ["alpha"], lambda x: x[0], lambda x: x[1:])


@reference("M22_sentence_scores")
def _(t):
    out = []
    for c in t.candidates():
        b, r, g = t.score((c["text"], c["reference"]))
        out.append({"id": c["id"], "label": c["label"], "bleu": b, "chrfpp": r, "geom": g})
    return out


def neighbours(asked, texts, k, same=False):
    """The k nearest texts of each asked one by dense TF-IDF vectors of character n-grams inside words."""

    def grams(x):
        out = Counter()
        for w in x.split():
            w = f" {w} "
            for n in (3, 4, 5):
                out.update([w] if len(w) <= n else [w[i : i + n] for i in range(len(w) - n + 1)])
        return out

    known = {i: grams(x) for i, x in texts}
    df = Counter(g for c in known.values() for g in c)

    def vector(counts):
        v = {g: (1 + math.log(n)) * (math.log((1 + len(known)) / (1 + df[g])) + 1) for g, n in counts.items() if g in df}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {g: x / norm for g, x in v.items()} if norm else {}

    vectors = {i: vector(c) for i, c in known.items()}
    out = []
    for i, x in asked:
        own = vector(grams(x))
        found = [(round(sum(w * v.get(g, 0.0) for g, w in own.items()), 9), d) for d, v in vectors.items() if not (same and d == i)]
        found = sorted((f for f in found if f[0] > 0), key=lambda f: (-f[0], f[1]))[:k]
        out += [{"query": i, "doc": d, "score": s, "rank": r + 1} for r, (s, d) in enumerate(found)]
    return out


def benchmark(t):
    return list(zip(t.benchmark.item_id.tolist(), t.benchmark.text.tolist()))


@reference("J8_tfidf_neighbours")
def _(t):
    return neighbours([(p["id"], p["source"]) for p in t.pairs() if p["id"] % 50 == 0], benchmark(t), 5)


@reference("J8_tfidf_self_neighbours")
def _(t):
    return neighbours(benchmark(t), benchmark(t), 3, same=True)


@reference("R17_neighbour_votes")
def _(t):
    texts, hits, n = dict(benchmark(t)), Counter(), 0
    found = defaultdict(list)
    for r in neighbours(benchmark(t), benchmark(t), 3, same=True):
        found[r["query"]].append((r["rank"], r["score"], texts[r["doc"]]))
    for query, text in texts.items():
        score = defaultdict(float)
        for _, s, target in sorted(found[query]):
            if target.strip():
                score[target] += s
        total = sum(max(0.0, s) for s in score.values())
        tally = defaultdict(lambda: defaultdict(float))
        for target, s in score.items():
            for step, token in enumerate(target.split()):
                tally[step][token] += max(0.0, s) / total if total > 1e-12 else 1 / len(score)
        for step, token in enumerate(text.split()):
            ranked = sorted(tally[step], key=lambda x: (-round(tally[step][x], 9), x))  # noqa: B023
            n += 1
            for k in (1, 5):
                hits[k] += token in ranked[:k]
    return [{f"recall_at_{k}": hits[k] / n for k in (1, 5)}]


@reference("S12_markdown_report")
def _(t):
    rows = t.region.sort_values("r_regionkey")
    return [{"line": x} for x in ["| r_regionkey | r_name |", "| --- | --- |", *[f"| {r.r_regionkey} | {r.r_name} |" for r in rows.itertuples()]]]


@reference("X3_stream_sessions")
def _(t):
    out = []
    for user, own in t.events.groupby("user_id"):
        start = last = None
        n = 0
        for ts in sorted(own.ts):
            if last is not None and ts - last >= pd.Timedelta(minutes=30):
                out.append({"session_start": start.to_pydatetime(), "user_id": user, "n": n})
                start, n = None, 0
            start, last, n = start or ts, ts, n + 1
        out.append({"session_start": start.to_pydatetime(), "user_id": user, "n": n})
    return out

