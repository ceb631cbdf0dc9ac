"""Secret scans with a recursive decoding worklist (operator 7).

Base patterns, leftmost and non-overlapping per kind, over the whole text:
assign (a key word, an assignment, a value of 6 or more characters), access (AKIA and upper-case
letters or digits, 20 or more in all), hex (24 or more of 0-9a-f). A match that is too short
is dropped, but what it covers is not searched again.

The worklist then unwraps layers: lines with percent escapes or \\u, \\x and octal escapes are decoded as a
whole (a byte that isn't UTF-8 is a character of its own), runs of base64 (standard or URL alphabet) are decoded
by themselves in each of the four alignments and joined across line breaks, gzip, zlib, bzip2, xz or (as a whole run) raw deflated data inside are inflated, and
every stretch of ASCII text in what comes out, also with two bytes a character, is a layer, whatever stands around it. Each new layer is
scanned with the same patterns and unwrapped in turn until no layer yields a new one; a layer already seen at
the same place is not taken up again. A layer knows its parent and, by pieces, where its characters
come from, so spans are given in the original text; a span in inflated data covers the whole encoded run. Rounds
that would only take a level off escape signs escaped more than sixteen times over are one step, and give the same spans.

Inflated data are read as a stream, whatever their size and however often compressed: the first ``WINDOW`` bytes as a
whole and the rest in windows that overlap by ``OVERLAP``. All spans in them are the same run, so it matters only
that each pattern (and each encoded run of up to ``OVERLAP`` bytes) is whole in some window.

Work grows in proportion to a run, however long it is: places are found by line, and data that only begin like
compressed ones are decoded no further than the first bytes that aren't.

Defined cases: a null text counts as empty (no spans); equal spans are given once; repeated rows
give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import accumulate, chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import map_rows, release, text_of

KINDS = ("assign", "access", "hex")
#: Bytes of inflated data that are scanned at once, and that a window shares with the next.
WINDOW, OVERLAP = 1 << 24, 1 << 20
#: Bytes of memory that an xz stream may ask for.
MEMORY = 1 << 27
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_KEY = re.compile("pass|secret|token|api", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|\\[0-3][0-7]{2})+")
_UNIT = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|u\{([0-9A-Fa-f]{1,6})\}|U([0-9A-Fa-f]{8})|x([0-9A-Fa-f]{2})|([0-3][0-7]{2}))")
#: An escaped escape sign, over sixteen times around itself, and the length of a level: one at a time would be quadratic.
_DEEP_PERCENT = re.compile(r"%(?:25){17,}(?=[0-9A-Fa-f]{2})")
_DEEP_ESCAPE = re.compile(r"\\u005[cC](?:u005[cC]){16,}(?=u[0-9A-Fa-f]{4})")
_HEX_RUN = re.compile(r"[0-9a-f]*")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Base64 over several lines: the end of a line, whole lines, the start of a line.
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]++)+")
_PIECE = re.compile(r"[A-Za-z0-9+/_-]+")
#: A sign of the alphabet, with what base64 of compressed data can begin with behind it (checked again by ``_squeezed``).
_JOINT = re.compile("[+/_-](?=[CGKOSWaeimquy26+-][A-P]|H4s|Qlp|[/_]Td)")
#: No pattern, and no escape or base64 run that leads to one, fits in fewer characters of text or holds any other.
_TEXT = re.compile(rb"[\t\n\r\x20-\x7e]{12,}")
#: The same text with two bytes a character.
_WIDE = [(0, re.compile(rb"(?:[\t\n\r\x20-\x7e]\x00){12,}")), (1, re.compile(rb"(?:\x00[\t\n\r\x20-\x7e]){12,}"))]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the base patterns, in order."""
    out = []
    if _KEY.search(text):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


class Layer:
    """Decoded text; ``pieces`` tell from which characters of ``parent`` its own come (none: the text itself)."""

    def __init__(self, text: str, parent: Layer | None = None, pieces: list | None = None):
        self.text, self.parent = text, parent
        self.pieces = pieces or []
        self.starts = [x[0] for x in self.pieces]

    def original(self, start: int, end: int) -> tuple[int, int]:
        """The range of the original text of characters ``start`` to ``end``."""
        layer = self
        while layer.parent is not None:
            start, end = layer._source(start)[0], layer._source(end - 1)[1]
            layer = layer.parent
        return start, end

    def _source(self, i: int) -> tuple[int, int]:
        first, find = self.pieces[bisect_right(self.starts, i) - 1]
        return find(i - first)


def _same(at: int):
    """Characters as they are, from ``at`` on."""
    return lambda i: (at + i, at + i + 1)


def _cut(edges: array):
    """Characters between edges."""
    return lambda i: (edges[i], edges[i + 1])


def _bits(places, size: int, first: int):
    """Bytes from ``first`` on of a base64 run; ``places[i]`` is where its character ``i`` stands."""
    return lambda i: (places[(first + i) * 8 // 6], places[min(size, -(-(first + i + 1) * 8 // 6)) - 1] + 1)


def _line(layer: Layer, pattern: re.Pattern) -> list[tuple[int, int]]:
    """Ranges of the lines that hold a match."""
    text, out, at = layer.text, [], 0
    while m := pattern.search(text, at):
        start = text.rfind("\n", 0, m.start()) + 1
        end = text.find("\n", m.end())
        end = len(text) if end < 0 else end
        out.append((start, end))
        at = end
    return out


def _percent(run: str) -> tuple[str, array]:
    """The characters of the run, and the edges between what they come from."""
    text = bytes.fromhex(run.replace("%", "")).decode("utf-8", "surrogateescape")
    edges = array("q", [0])
    for c in text:
        edges.append(edges[-1] + (3 if "\udc80" <= c <= "\udcff" else 3 * len(c.encode())))
    return text, edges


def _escaped(run: str) -> tuple[str, array] | None:
    out, edges = [], array("q", [0])
    for m in _UNIT.finditer(run):
        code = int(m[5], 8) if m[5] else int(m[m.lastindex], 16)
        if out and 0xDC00 <= code < 0xE000 and 0xD800 <= ord(out[-1]) < 0xDC00:
            out[-1] = chr(0x10000 + ((ord(out[-1]) - 0xD800) << 10) + code - 0xDC00)
            edges[-1] = m.end()
        elif code > 0x10FFFF:
            return None
        else:
            out.append(chr(code))
            edges.append(m.end())
    return "".join(out), edges


def _replaced(layer: Layer, pattern: re.Pattern, decode, deep: re.Pattern, level: int) -> tuple[list[Layer], list[tuple[int, int, int]]]:
    """A layer for each line in which the pattern's runs were decoded, and the spans of the layers skipped.

    In a line with nothing to decode but signs of the ``deep`` pattern, each level of which is
    ``level`` characters, the rounds in which all of them stay signs are skipped.
    """
    text, out, skipped = layer.text, [], []
    for start, end in _line(layer, pattern):
        runs = [(m.start(), m.end(), *got) for m in pattern.finditer(text, start, end) if (got := decode(m.group())) is not None]
        if not runs:
            continue
        signs = {m.start(): (m.end() - m.start() - 1) // level for m in deep.finditer(text, start, end)}
        if signs and all(a in signs and b == a + 1 + level for a, b, *_ in runs):
            levels = min(signs[a] for a, *_ in runs) - 1
            runs = [(a, a + 1 + level * levels, text[a], array("q", [0, 1 + level * levels])) for a, *_ in runs]
            for a, *_ in runs:
                stop = _HEX_RUN.match(text, a + 1).end()
                for first in range(a + 1 + level, min(a + 1 + level * levels, stop - 23), level):
                    x, y = layer.original(first, stop)
                    skipped.append((x, 2, y))
        parts, pieces, last, n = [], [], start, 0
        for a, b, got, edges in [*runs, (end, end, "", None)]:
            if a > last:
                pieces.append((n, _same(last)))
                parts.append(text[last:a])
                n += a - last
            if got:
                pieces.append((n, _shifted(edges, a)))
                parts.append(got)
                n += len(got)
            last = b
        if n:
            out.append(Layer("".join(parts), layer, pieces))
    return out, skipped


def _shifted(edges: array, by: int):
    find = _cut(edges)
    return lambda i: tuple(by + x for x in find(i))


def _squeezed(data: bytes) -> bool:
    """Whether data begin like gzip, zlib, bzip2 or xz."""
    if data[:2] == b"\x1f\x8b" or data[:3] == b"BZh" or data[:3] == b"\xfd7z":
        return True
    return len(data) > 2 and data[0] & 15 == 8 and (data[0] << 8 | data[1]) % 31 == 0


def _inflated(data: Iterable[bytes]) -> Iterator[bytes]:
    """What the compressed stream holds, as far as it can be read."""
    engine = None
    try:
        for part in data:
            if engine is None:
                kind = part[:3]
                engine = bz2.BZ2Decompressor() if kind == b"BZh" else lzma.LZMADecompressor(lzma.FORMAT_XZ, MEMORY) if kind == b"\xfd7z" else zlib.decompressobj(47)
            if isinstance(engine, (bz2.BZ2Decompressor, lzma.LZMADecompressor)):
                while got := engine.decompress(part, OVERLAP):
                    yield got
                    part = b""
                    if engine.eof:
                        return
            else:
                while part:
                    if got := engine.decompress(part, OVERLAP):
                        yield got
                    part = engine.unconsumed_tail
            if engine.eof:
                return
    except (zlib.error, OSError, lzma.LZMAError):
        return


def _raw_deflated(data: bytes) -> Iterator[bytes] | None:
    """The contents of deflated data without a header, which nothing marks: only if they end where the data do."""
    engine, out = zlib.decompressobj(-15), []
    try:
        while data and not engine.eof:
            out.append(engine.decompress(data, OVERLAP))
            data = engine.unconsumed_tail
            if sum(map(len, out)) > WINDOW:  # surely no chance
                return chain(out, _rest(engine, data))
    except zlib.error:
        return None
    return iter(out) if engine.eof and len(engine.unused_data) <= 2 and any(out) else None


def _rest(engine, data: bytes) -> Iterator[bytes]:
    try:
        while data and not engine.eof:
            yield engine.decompress(data, OVERLAP)
            data = engine.unconsumed_tail
    except zlib.error:
        return


def _peeked(data: Iterator[bytes], least: int) -> tuple[bytes, Iterator[bytes]]:
    """The first ``least`` bytes or more, and the whole again."""
    head = b""
    for part in data:
        head += part
        if len(head) >= least:
            break
    return head, chain([head], data)


def _deflated(data: Iterator[bytes]) -> Iterator[bytes] | None:
    """What is left after all rounds of inflating; None if nothing is compressed. A cycle ends the rounds."""
    head, stream = _peeked(data, 4)
    seen, rounds = set(), 0
    while _squeezed(head) and head not in seen:
        if len(head) < OVERLAP:
            seen.add(head)
        inner, rest = _peeked(_inflated(stream), OVERLAP)
        if not inner:  # it only began like compressed data
            stream = chain([head], stream)
            break
        head, stream, rounds = inner, rest, rounds + 1
    return stream if rounds else None


def _decoded(body: str) -> bytes:
    """The bytes of a base64 run without padding; a last character that alone holds no byte is left out."""
    body = body[: len(body) - (len(body) % 4 == 1)].replace("-", "+").replace("_", "/")
    return binascii.a2b_base64(body + "=" * (-len(body) % 4))


def _windows(stream: Iterator[bytes]) -> Iterator[bytes]:
    held = b""
    for part in stream:
        held += part
        if len(held) >= WINDOW:
            yield held
            held = held[-OVERLAP:]
    yield held


def _chunks(body: str, first: int) -> Iterator[bytes]:
    """The bytes of a base64 run from ``first`` on, small parts first: what only begins like compressed data is soon given up."""
    size = 1 << 8
    while first < len(body):
        yield _decoded(body[first : first + size])
        first, size = first + size, min(2 * size, 1 << 20)


class Places:
    """Where the characters of joined pieces of a text stand in it, from the ``first`` on."""

    def __init__(self, pieces: list[tuple[int, int]], first: int = 0, starts: list[int] | None = None):
        self.pieces, self.first = pieces, first
        self.starts = starts or list(accumulate((b - a for a, b in pieces), initial=0))

    def after(self, first: int) -> Places:
        return Places(self.pieces, first, self.starts)

    def __getitem__(self, i: int) -> int:
        i += self.first
        at = bisect_right(self.starts, i, hi=len(self.pieces)) - 1
        return self.pieces[at][0] + i - self.starts[at]


def _texts(layer: Layer, body: str, first: int, places: Places, squeezed_only: bool = False) -> Iterator[Layer]:
    """The layers of a base64 run from its character ``first`` on; ``places`` tells where they stand in the layer."""
    squeezed = _squeezed(_decoded(body[first : first + 4]))
    if squeezed_only and not squeezed:
        return
    stream = _deflated(_chunks(body, first)) if squeezed else None
    data = b"" if stream is not None or squeezed_only else _decoded(body[first:])
    if len(data) > 16 and data[0] & 6 != 6:
        stream = _raw_deflated(data)
    if stream is not None:
        whole = (places.after(first)[0], places.after(first)[len(body) - first - 1] + 1)
        for window in _windows(stream):
            for text, *_ in _stretches(window):
                yield Layer(text, layer, [(0, lambda i: whole)])
    for text, at, width in _stretches(data):
        find = _bits(places.after(first), len(body) - first, at)
        yield Layer(text, layer, [(0, _pairs(find) if width == 2 else find)])


def _stretches(data: bytes) -> Iterator[tuple[str, int, int]]:
    """(text, first byte, bytes a character) of the stretches of ASCII text."""
    for m in _TEXT.finditer(data):
        yield m.group().decode(), m.start(), 1
    if b"\x00" in data:
        for low, pattern in _WIDE:
            for m in pattern.finditer(data):
                yield m.group()[low::2].decode(), m.start(), 2


def _pairs(find):
    return lambda i: (find(2 * i)[0], find(2 * i + 1)[1])


def _unpacked(layer: Layer) -> Iterator[Layer]:
    """Layers of the text, or compressed text, in base64 runs.

    A run may be joined to what stands before it by a sign of its alphabet: it is decoded in all four alignments,
    and as compressed data from behind every such sign. Lines that are joined may begin before the run does, too: they
    are decoded from the first line of each alignment, and from every line that begins like compressed data.
    """
    for m in _BASE64.finditer(layer.text):
        body, places = m.group().rstrip("="), Places([(m.start(), m.end())])
        for first in range(4):
            yield from _texts(layer, body, first, places)
        for sign in _JOINT.finditer(body):
            first = sign.end()
            if first > 3 and _squeezed(_decoded(body[first : first + 4])):
                yield from _texts(layer, body, first, places, squeezed_only=True)
    if "\n" not in layer.text:
        return
    for m in _WRAPPED.finditer(layer.text):
        if m.end() - m.start() < 16:
            continue
        pieces = [(p.start(), p.end()) for p in _PIECE.finditer(layer.text, m.start(), m.end())]
        body, places = "".join([layer.text[a:b] for a, b in pieces]), Places(pieces)
        aligned, first = set(), 0
        for a, b in pieces[:-1]:
            fresh = first % 4 not in aligned
            aligned.add(first % 4)
            if fresh or _squeezed(_decoded(body[first : first + 4])):
                yield from _texts(layer, body, first, places, squeezed_only=not fresh)
            first += b - a


def _layers(layer: Layer, found: set) -> Iterator[Layer]:
    for sign, *unwrap in (("%", _PERCENT, _percent, _DEEP_PERCENT, 2), ("\\", _ESCAPE, _escaped, _DEEP_ESCAPE, 5)):
        if sign in layer.text:
            layers, skipped = _replaced(layer, *unwrap)
            found.update(skipped)
            yield from layers
    yield from _unpacked(layer)


def all_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans), each (start, kind index, end) in order."""
    base = base_spans(text)
    found, seen, work = set(base), set(), [Layer(text)]
    while work:
        layer = work.pop()
        for x in _layers(layer, found):
            key = (hash(x.text), len(x.text), x.original(0, len(x.text)))
            if key in seen:
                continue
            seen.add(key)
            work.append(x)
            for start, kind, end in base_spans(x.text):
                a, b = x.original(start, end)
                found.add((a, kind, b))
    return base, sorted(found)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, overlapping ones together, replaced by a mark."""
    out, last = [], 0
    end = -1
    for a, _, b in spans:
        if a >= end:
            out += [text[last:a], "[secret]"]
        end = last = max(end, b)
    return "".join([*out, text[last:]]) if spans else text


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_spans); the counts are of base spans."""

    def scan(batches):
        for batch in batches:
            got = [all_spans(t) for t in batch["text"].to_pylist()]
            counts = [[sum(k == kind for _, k, _ in base) for base, _ in got] for kind in range(3)]
            yield {
                "doc_id": batch["doc_id"],
                "n_assign": counts[0],
                "n_access": counts[1],
                "n_hex": counts[2],
                "base_sha256": [hashlib.sha256(written(base).encode()).hexdigest() for base, _ in got],
                "spans": [written(spans) for _, spans in got],
                "n_spans": [len(spans) for _, spans in got],
            }

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    kinds = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_spans long"
    return map_rows(rows, scan, f"doc_id long, {kinds}")


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """``docs`` with the secrets in its texts replaced; ``length_col`` gets the new length in code points."""

    def clean(texts):
        out = texts.map(lambda t: t if t is None else redacted(t, all_spans(t)[1]))
        release()
        return out

    cleaned = F.pandas_udf(clean, "string")(F.col(text_col))
    own = docs.columns
    out = docs.withColumn(text_col, cleaned)
    if length_col in own:
        kind = docs.schema[length_col].dataType
        out = out.withColumn(length_col, F.when(F.col(text_col).isNull(), F.col(length_col)).otherwise(F.char_length(text_col)).cast(kind))
    return out.select(*[f"`{c}`" for c in own])
