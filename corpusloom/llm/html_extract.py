"""Main text of web pages by wrapper induction (operator 10).

Outlines: a page becomes the tree of its block elements, where alike siblings that follow each other
(paragraphs, list items, rows, comments) are one node. Pages of a host with the same container tags are one layout,
and the page of a layout whose text has the least hash is its reference.

Wrappers: every page's outline is aligned with the reference of its layout by simple tree matching
(the order-preserving matching of two trees with the most nodes), and words, link words and texts are
counted by node of the reference over all pages, map-side first. A node whose text is the same on nearly all
pages of the layout, or a text that is on nearly all pages of the host, is constant: template. The
others are slots. Slots hold menus, adverts and comments as well as the article, and these differ
from page to page, too. The content region is therefore induced from the counts: from the root down, the
container that has most of the prose in slots, where text in links, and groups of alike records without headings
(comments, teasers), are no prose. Where HTML says ``article`` or ``main``, these are the region (articles alone if they have most of the prose,
and without articles inside articles, which are comments by definition).
In the region everything stays, constant sentences as well, but for what is link text or records
and, where alignment can't tell, what HTML or a whole class or id says it is (nav, form, aside,
"cookie-notice", "ad"; a name that only contains such a word says nothing). Names of boxes that hold prose as well ("related", "share", "reply") count in an
article only where links outweigh its words, names of boxes say nothing of a paragraph or quotation, and no heading goes by its name.

Every page is then read whole again and aligned with its reference; its blocks in the region's nodes are
the text, white space in a block as one space. Layouts and hosts of fewer than ``LEAST_PAGES`` different pages
have no constants; the region then comes from the counts of these pages. Wrappers go to the executors by
broadcast while they are few (``BROADCAST_ROWS`` nodes, checked); beyond that pages and wrappers are
joined by host and layout, so a host of many layouts is many small keys.

Defined cases: null or empty html gives the empty text; a null or hostless url means no wrapper, the region is that of
the page; broken markup is read as far as it goes; nodes more than ``DEEP`` levels down belong to their
ancestor there; repeated rows give repeated results; extra columns are ignored; an empty table gives
an empty result. A page of many thousand blocks takes time and memory in proportion where its blocks come in turns or are
like the reference's; else see ``simple_tree_matching`` for the bounds.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import checkpointed, map_rows

LEAST_PAGES = 4
SHARE = 0.8
#: A container is gone into while it holds this part of the prose.
MOST_PROSE = 0.6
DEEP = 60
#: Siblings that come in turns (heading, paragraph, heading, paragraph) are folded up to so many a turn.
PERIOD = 8
#: Pairs of siblings that are aligned as a whole, and that are weighed for one page; beyond, see ``simple_tree_matching``.
CELLS, WEIGHED = 1 << 29, 1 << 25
#: Pairs of siblings up to which their whole table is held.
SMALL = 1 << 20
BROADCAST_ROWS = 200_000
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr br img label".split()
)
_ENDS_P = frozenset(
    "address article aside blockquote details dialog dir div dl dt dd fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr li main menu nav ol p pre section table ul".split()
)
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SAME_STOP = frozenset("ul ol dl table tbody thead select menu".split())
_NOT_TEXT = frozenset(
    "head title script style noscript template nav footer aside form button select textarea iframe svg canvas object audio video "
    "menu dialog datalist".split()
)
#: What makes a layout; paragraphs, lists, tables and their like depend on what a page says.
_CONTAINER = frozenset("html body div section article main header footer nav aside form".split())
_DIGITS = re.compile("[0-9]+")
#: These take no room in a text.
_UNSEEN = frozenset("script style noscript template".split())
_NOT_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: What a class or id must say as a whole to be believed, with words of mere structure beside it.
_ROLE_WORDS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs topbar masthead header footer sidebar aside ad ads advert adverts "
    "advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr notice notices banner alert "
    "popup modal overlay newsletter subscribe subscription signup share sharing social related recommended recommendations "
    "comment comments commentlist reply replies respond disqus login searchform pagination pager skip".split()
)
#: Names of boxes that hold prose as well as teasers and buttons: in an article the counts of words decide.
_MAYBE_WORDS = frozenset("related recommended recommendations share sharing social reply replies respond header".split())
#: Names that say something of a container only, not of a paragraph or quotation.
_BOX_WORDS = _MAYBE_WORDS | frozenset("topbar masthead footer sidebar aside banner nav navbar navigation menu menubar".split())
#: A header so called belongs to a part of the page.
_PART_WORDS = frozenset("page section entry post article content title story".split())
_PROSE = frozenset("p blockquote pre dl dt dd figcaption q cite".split())
_STRUCTURE_WORDS = frozenset(
    "site page main top bottom left right inner outer box bar wrap wrapper container block area section list item items slot unit "
    "links link widget row col column content group panel primary secondary user reader the".split()
)


_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class Node:
    __slots__ = ("tag", "name", "names", "children", "skip", "parent")

    def __init__(self, tag: str, name: str, parent: Node | None, skip: bool, names: str = ""):
        self.tag, self.name, self.parent, self.skip, self.names = tag, name, parent, skip, names
        self.children: list = []  # Nodes and texts


def _skipped(tag: str, attrs: dict, parent: Node) -> bool:
    if parent.skip or tag in _NOT_TEXT or "hidden" in attrs or attrs.get("aria-hidden") == "true":
        return True
    if (attrs.get("role") or "").lower() in _NOT_ROLE or "display:none" in (attrs.get("style") or "").replace(" ", "").lower():
        return True
    return tag == "header" and not _in_article(parent)  # an article's own header holds its title


def _drop_named(root: Node) -> None:
    """Skips what names say is no content. Headings are never skipped by name, and no article or main; prose is where only a box is named."""
    words: dict[int, tuple[int, int, bool]] = {}  # of an element: words, of these in links, a heading inside
    stack = [(root, False)]
    while stack:
        node, ready = stack.pop()
        kids = [c for c in node.children if isinstance(c, Node) and not c.skip]
        if not ready:
            stack.append((node, True))
            stack += [(c, False) for c in kids]
            continue
        own = sum(len(c.split()) for c in node.children if isinstance(c, str))
        n, links, heading = own, 0, node.tag in _HEADINGS
        for c in kids:
            n, links, heading = n + words[id(c)][0], links + words[id(c)][1], heading or words[id(c)][2]
        words[id(node)] = n, n if node.tag == "a" else links, heading
        if not node.names or node.tag in _HEADINGS or node.tag in ("html", "body", "article", "main"):
            continue
        roles = {r for name in node.names.lower().split() for r in _said(name)}
        if not roles or node.tag in _PROSE and roles <= _BOX_WORDS:
            continue
        inside = _in_article(node.parent)
        if roles <= _MAYBE_WORDS:
            if roles == {"header"} and (inside or heading and _PART_WORDS & set(re.split("[-_ ]+", node.names.lower()))):
                continue
            if inside and n - links >= max(8, links):
                continue
        node.skip = True


def _said(name: str) -> set[str]:
    """The roles that a name says, if it says nothing else."""
    parts = {x for x in re.split("[-_]+", name) if x}
    return parts & _ROLE_WORDS if parts <= _ROLE_WORDS | _STRUCTURE_WORDS else set()


def _in_article(node: Node | None) -> bool:
    while node is not None and node.tag not in ("article", "main"):
        node = node.parent
    return node is not None


class TreeBuilder(HTMLParser):
    """A tree of elements and texts; open p, li and table cells end where HTML ends them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", "", None, False)

    def handle_starttag(self, tag, attrs):
        got = dict(attrs)
        if tag in _ENDS_P:
            self._close_open("p", ("article", "section", "div", "td", "th", "li", "blockquote", "body", "main"))
        if tag in _SAME:
            for same in _SAME[tag]:
                self._close_open(same, _SAME_STOP)
        names = f"{got.get('class') or ''} {got.get('id') or ''}".strip()
        node = Node(tag, got.get("class") or got.get("id") or "", self.at, _skipped(tag, got, self.at), names)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.at = self.at.parent

    def _close_open(self, tag: str, stops) -> None:
        node = self.at
        while node.parent is not None and node.tag not in stops:
            if node.tag == tag:
                self.at = node.parent
                return
            node = node.parent

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None:
            if node.tag == tag:
                self.at = node.parent
                return
            node = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str) -> Node:
    builder = TreeBuilder()
    builder.feed(html)
    builder.close()
    _drop_named(builder.root)
    return builder.root


def blocks(root: Node) -> list[tuple[Node, str, int]]:
    """(innermost block element, text, words in links) of the blocks with text that aren't skipped."""
    out: list[tuple[Node, str, int]] = []
    parts: list[str] = []
    linked = 0

    def flush(node: Node) -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            out.append((node, text, linked))
        linked = 0

    # Without recursion, as broken pages nest deeply: (node, next child, block, in a link).
    stack = [(root, 0, root, False)]
    while stack:
        node, i, block, link = stack.pop()
        if i == len(node.children):
            if node is block:
                flush(block)
            continue
        stack.append((node, i + 1, block, link))
        child = node.children[i]
        if isinstance(child, str):
            parts.append(child)
            linked += len(child.split()) if link else 0
        elif child.tag == "br":
            parts.append(" ")
        elif child.skip:
            if child.tag not in _INLINE and child.tag not in _UNSEEN:
                flush(block)
        elif child.tag in _INLINE:
            stack.append((child, 0, block, link or child.tag == "a"))
        else:
            flush(block)
            stack.append((child, 0, child, link))
    return out


#: Elements that are records when they are repeated with two or more elements inside.
_RECORD = _CONTAINER | {"li", "dd"}


def _folded(shapes: list[int]) -> list[int]:
    """For each sibling the one it is folded into: itself, or, in a run with a period of up to ``PERIOD``, that of the first turn."""
    n, out, i = len(shapes), list(range(len(shapes))), 0
    if n < 2:
        return out
    runs = []
    longest = max(1, min(PERIOD, n // 3))
    for period in range(1, longest + 1):
        run = [0] * (n + 1)
        for k in range(n - period - 1, -1, -1):
            run[k] = run[k + 1] + 1 if shapes[k] == shapes[k + period] else 0
        runs.append(run)
    while i < n:
        # Two alike siblings are a run; longer periods need a third turn.
        period = next((p for p in range(1, longest + 1) if runs[p - 1][i] >= (1 if p == 1 else 2 * p)), 0)
        if not period:
            i += 1
            continue
        size = period * (1 + runs[period - 1][i] // period)
        out[i : i + size] = [i + k % period for k in range(size)]
        i += size
    return out


class Outline:
    """The tree of a page's block elements, in page order, alike siblings that follow each other as one node.

    Per node: ``tags``, ``names``, ``parents`` (-1 for the root), ``repeats``, own ``words``, of these ``links``, and ``texts``,
    a hash of its own text; ``node_of`` finds the node of an element.
    """

    def __init__(self, root: Node):
        self.found = blocks(root)
        self.tags, self.names, self.parents, self.repeats = [], [], [], []
        self.node_of: dict[int, int] = {}
        shapes = _shapes(root)
        # (element, parent's node, level, what it is folded into); the children of a node are numbered one behind the other.
        stack = [(root, -1, 0, None)]
        while stack:
            element, parent, level, twin = stack.pop()
            if twin is not None:
                at = self.node_of[id(twin)]
                self.repeats[at] += 1
                self.node_of[id(element)] = at
                continue
            at = len(self.tags)
            self.node_of[id(element)] = at
            self.tags.append(element.tag)
            self.names.append(_DIGITS.sub("0", element.name))
            self.parents.append(parent)
            self.repeats.append(1)
            if level < DEEP:
                below = list(_block_children(element))
                first = _folded([shapes[id(c)] for c in below])
                stack += [(c, at, level + 1, None if f == i else below[f]) for i, (c, f) in reversed(list(enumerate(zip(below, first, strict=True))))]
        self.words, self.links = [0] * len(self.tags), [0] * len(self.tags)
        texts: list[list[str]] = [[] for _ in self.tags]
        self.at = []
        for element, text, linked in self.found:
            i = self.node(element)
            self.at.append(i)
            self.words[i] += len(text.split())
            self.links[i] += linked
            texts[i].append(text)
        self.texts = [_hash("\0".join(t)) if t else 0 for t in texts]

    def node(self, element: Node) -> int:
        while id(element) not in self.node_of:
            element = element.parent
        return self.node_of[id(element)]


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 42) - (1 << 63)


def _block_children(element: Node) -> Iterator[Node]:
    """Block elements below, also through inline ones."""
    stack = list(reversed(element.children))
    while stack:
        child = stack.pop()
        if isinstance(child, Node) and not child.skip:
            if child.tag in _INLINE:
                stack += reversed(child.children)
            else:
                yield child


def _shapes(root: Node) -> dict[int, int]:
    """A hash of the structure below each block element, runs of alike children as one."""
    out: dict[int, int] = {}
    stack = [(root, False)]
    while stack:
        element, ready = stack.pop()
        if not ready:
            stack.append((element, True))
            stack += [(c, False) for c in _block_children(element)]
            continue
        below: list[int] = []
        for c in _block_children(element):
            if not below or below[-1] != out[id(c)]:
                below.append(out[id(c)])
        out[id(element)] = hash((element.tag, _DIGITS.sub("0", element.name), tuple(below)))
    return out


def layout(outline: Outline) -> int:
    """A number from 1 of the page's set of container paths, by tags."""
    paths: list[int] = []
    for tag, parent in zip(outline.tags, outline.parents, strict=True):
        above = paths[parent] if parent >= 0 else 0
        paths.append(zlib.crc32(f"{above}/{tag}".encode("utf-8", "surrogatepass")) if tag in _CONTAINER else above)
    return zlib.crc32(",".join(map(str, sorted(set(paths)))).encode()) >> 1 | 1


class _Matching:
    """Weights of the best order-preserving matchings, by subtrees that are alike (a class): two equal subtrees are matched as they are."""

    def __init__(self):
        self.ids: dict[tuple, int] = {}
        self.tag: list[str] = []
        self.name: list[str] = []
        self.kids: list[tuple[int, ...]] = []
        self.full: list[int] = []
        self.weights: dict[tuple[int, int], int] = {}
        self.left = WEIGHED

    def classes(self, tags: list, names: list, parents: list) -> tuple[list[int], list[list[int]]]:
        """The class of each node, and the children."""
        below: list[list[int]] = [[] for _ in parents]
        for i, p in enumerate(parents):
            if p >= 0:
                below[p].append(i)
        out = [0] * len(tags)
        for i in range(len(tags) - 1, -1, -1):
            key = (tags[i], names[i], tuple(out[c] for c in below[i]))
            if key not in self.ids:
                self.ids[key] = len(self.full)
                self.tag.append(tags[i])
                self.name.append(names[i])
                self.kids.append(key[2])
                self.full.append(3 + sum(self.full[c] for c in key[2]))
            out[i] = self.ids[key]
        return out, below

    def weigh(self, a: int, b: int) -> int:
        """The weight of the best matching of two subtrees whose roots match."""
        if a == b:
            return self.full[a]
        got = self.weights.get((a, b))
        if got is None:
            got = 2 + (self.name[a] == self.name[b])
            x, y = self.kids[a], self.kids[b]
            if x and y:
                self.left -= len(x) * len(y)
                got += self.score(x, y) if self.left > 0 else self._common(x, y)
            self.weights[a, b] = got
        return got

    def _common(self, x: tuple, y: tuple) -> int:
        """What equal children weigh, in whatever order."""
        return sum(n * self.full[c] for c, n in (Counter(x) & Counter(y)).items())

    def score(self, x, y) -> int:
        lead, trail = _ends(x, y)
        total = sum(self.full[c] for c in x[:lead]) + sum(self.full[c] for c in x[len(x) - trail :])
        x, y = x[lead : len(x) - trail], y[lead : len(y) - trail]
        return total + (int(self.last_row(x, y)[-1]) if x and y else 0)

    def row(self, c: int, kinds: list[int], codes: np.ndarray, known: dict) -> np.ndarray:
        """The weights of a subtree with each of the siblings ``kinds[codes]``."""
        got = known.get(c)
        if got is None:
            got = np.array([self.weigh(c, d) if self.tag[c] == self.tag[d] else 0 for d in kinds], np.int64)
            known[c] = got
        return got[codes]

    def rows(self, x, y):
        """The rows of the alignment's table."""
        kinds = list(dict.fromkeys(y))
        at = {d: i for i, d in enumerate(kinds)}
        codes = np.array([at[d] for d in y], np.int64)
        known: dict[int, np.ndarray] = {}
        row = np.zeros(len(y) + 1, np.int64)
        yield row
        for c in x:
            best = np.maximum(row[1:], row[:-1] + self.row(c, kinds, codes, known))
            row = np.concatenate([row[:1], np.maximum.accumulate(best)])
            yield row

    def last_row(self, x, y) -> np.ndarray:
        for row in self.rows(x, y):  # noqa: B007
            pass
        return row

    def pairs(self, x, y) -> list[tuple[int, int]]:
        """Places (i, j) of a best alignment of siblings, in space that grows with their number alone."""
        out, work = [], [(0, len(x), 0, len(y))]
        while work:
            a, b, c, d = work.pop()
            lead, trail = _ends(x[a:b], y[c:d])
            out += [(a + k, c + k) for k in range(lead)] + [(b - 1 - k, d - 1 - k) for k in range(trail)]
            a, b, c, d = a + lead, b - trail, c + lead, d - trail
            n, m = b - a, d - c
            if not n or not m:
                continue
            if n * m <= SMALL:
                out += [(a + i, c + j) for i, j in self._traced(x[a:b], y[c:d])]
            elif n * m > CELLS:  # in stretches
                k = -(-n * m // CELLS)
                work += [(a + n * i // k, a + n * (i + 1) // k, c + m * i // k, c + m * (i + 1) // k) for i in range(k)]
            elif n == 1 or m == 1:
                out += [(a + i, c + j) for i, j in self._traced(x[a:b], y[c:d])]
            else:
                half = a + n // 2
                ahead, behind = self.last_row(x[a:half], y[c:d]), self.last_row(x[half:b][::-1], y[c:d][::-1])[::-1]
                cut = c + int(np.argmax(ahead + behind))
                work += [(a, half, c, cut), (half, b, cut, d)]
        return sorted(out)

    def _traced(self, x, y) -> list[tuple[int, int]]:
        table = list(self.rows(x, y))
        out, i, j = [], len(x), len(y)
        while i and j:
            if table[i][j] == table[i - 1][j]:
                i -= 1
            elif table[i][j] == table[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((i, j))
        return out


def _ends(x, y) -> tuple[int, int]:
    """How many siblings are equal from the front on, and of the others from the back on."""
    most = min(len(x), len(y))
    lead = next((i for i in range(most) if x[i] != y[i]), most)
    most -= lead
    return lead, next((i for i in range(most) if x[len(x) - 1 - i] != y[len(y) - 1 - i]), most)


def simple_tree_matching(tags: list, names: list, parents: list, tags2: list, names2: list, parents2: list) -> dict[int, int]:
    """Nodes of the first tree -> nodes of the second in a matching with the most weight that keeps order and ancestry.

    A node matches one of the same tag (weight 2, and 1 more for the same name). Equal subtrees are weighed once, and siblings that are equal
    from the front or the back on are matched without a table; of the others' table two rows are held. Where more than
    ``CELLS`` pairs of siblings would meet they are aligned in stretches, and where the subtrees of a page make more than ``WEIGHED`` pairs of children
    in all, further ones are weighed by their equal children: the matching keeps order and ancestry, but may not be the heaviest.
    """
    if tags == tags2 and names == names2 and parents == parents2:
        return {i: i for i in range(len(tags))}
    matching = _Matching()
    (own, below), (own2, below2) = matching.classes(tags, names, parents), matching.classes(tags2, names2, parents2)
    out, stack = {}, [(0, 0)]
    while stack:
        a, b = stack.pop()
        out[a] = b
        x, y = below[a], below2[b]
        if x and y:
            stack += [(x[i], y[j]) for i, j in matching.pairs([own[c] for c in x], [own2[d] for d in y])]
    return out


def content(tags: list, parents: list, repeats: list, words: list, links: list, constant: list) -> set[int]:
    """The nodes of the content region, by the counts of their own words."""
    n = len(tags)
    if not n:
        return set()
    below: list[list[int]] = [[] for _ in tags]
    for i, p in enumerate(parents):
        if p >= 0:
            below[p].append(i)
    heading, all_words, all_links = [t in _HEADINGS for t in tags], list(words), list(links)
    for i in range(n - 1, 0, -1):
        p = parents[i]
        heading[p] |= heading[i]
        all_words[p] += all_words[i]
        all_links[p] += all_links[i]
    inner = [0] * n
    for i in range(n - 1, 0, -1):
        inner[parents[i]] += inner[i] + 1
    record = [repeats[i] > 1 and inner[i] > 1 and not heading[i] and tags[i] in _RECORD for i in range(n)]
    menu = [2 * all_links[i] > all_words[i] for i in range(n)]

    def sums(skip) -> list[int]:
        total = [0 if constant[i] else max(0, words[i] - links[i]) for i in range(n)]
        for i in range(n - 1, 0, -1):
            total[parents[i]] += 0 if skip(i) else total[i]
        return total

    prose = sums(lambda i: record[i] or menu[i])
    plain = prose[0] == 0  # nothing but records, links or constants
    if plain:
        prose = sums(lambda i: False)
    if prose[0] == 0:
        return set(range(n)) if not any(constant) else {i for i in range(n) if not constant[i]}
    within = [False] * n  # below an article
    for i in range(1, n):
        within[i] = within[parents[i]] or tags[parents[i]] == "article"
    articles = [i for i in range(n) if tags[i] == "article" and prose[i] and not within[i]]
    said = articles + [i for i in range(n) if tags[i] == "main" and prose[i]]
    if sum(prose[i] for i in articles) >= MOST_PROSE * max([prose[i] for i in said], default=1):
        said = articles
    out: set[int] = set()
    if said:
        said = set(said)
        opening = _openings(tags, parents, said, heading)
        # An article in an article is what readers add to it.
        for i in range(n):
            if i in said or i in opening or parents[i] in out and not (tags[i] == "article" and within[i]):
                out.add(i)
        return out
    region = 0
    while True:
        deeper = [c for c in below[region] if tags[c] in _CONTAINER and prose[c] >= MOST_PROSE * prose[region] and (plain or not record[c] and not menu[c])]
        if not deeper:
            break
        if not below[deeper[0]]:  # its text stands in it, headings and paragraphs beside it
            beside = [c for c in below[region] if not below[c] and tags[c] not in _CONTAINER and not menu[c] and not constant[c]]
            return {deeper[0], *beside}
        region = deeper[0]
    for i in range(n):
        if i == region or parents[i] in out and (plain or not record[i] and not menu[i]):
            out.add(i)
    return out


def _openings(tags: list, parents: list, said: set[int], heading: list) -> set[int]:
    """What stands between a heading of ``main`` and the first article behind it: the article's head, though outside of it."""
    out: set[int] = set()
    for main in {parents[i] for i in said if parents[i] >= 0 and tags[parents[i]] == "main"}:
        begun = False
        for i in range(main + 1, len(tags)):
            if parents[i] == main:
                if i in said:
                    break
                begun = begun or heading[i]
                if begun:
                    out.add(i)
    return out


def _kept(outline: Outline, wrapper: dict | None) -> set[int]:
    """The nodes of a page that are content: those aligned with its wrapper's, and what stands below them."""
    own = None
    if wrapper is not None:
        match = simple_tree_matching(outline.tags, outline.names, outline.parents, *wrapper["tree"])
        keep, kept = wrapper["keep"], set()
        for i, p in enumerate(outline.parents):
            at = match.get(i)
            if at in keep if at is not None else p in kept:
                kept.add(i)
        if any(outline.words[i] for i in kept):
            return kept
        own = [t in wrapper["texts"] for t in outline.texts]
    return content(outline.tags, outline.parents, outline.repeats, outline.words, outline.links, own or [False] * len(outline.tags))


def _content_text(outline: Outline, wrapper: dict | None = None) -> str:
    kept = _kept(outline, wrapper)
    return "\n\n".join(text for (_, text, _), i in zip(outline.found, outline.at, strict=True) if i in kept)


def main_text(html: str) -> str:
    """The blocks of content of a page by itself, joined by blank lines."""
    return _content_text(Outline(parse(html)))


def _host():
    return F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1))


OUTLINE = "tags array<string>, names array<string>, parents array<int>, repeats array<int>"


def outlines(pages: DataFrame) -> DataFrame:
    """(host, layout, page, outline, words, links, texts) of the different pages of each host; ``page`` is a hash of its text."""

    def read(batches):
        for batch in batches:
            names = ("page", "layout", "tags", "names", "parents", "repeats", "words", "links", "texts")
            out: dict[str, list] = {k: [] for k in names}
            for html in batch["html"].to_pylist():
                o = Outline(parse(html))
                page = _hash("\0".join(text for _, text, _ in o.found))
                for k, v in zip(names, (page, layout(o), o.tags, o.names, o.parents, o.repeats, o.words, o.links, o.texts), strict=True):
                    out[k].append(v)
            yield {"host": batch["host"], **out}

    rows = pages.select(_host().alias("host"), "html").where("host <> '' AND html <> ''")
    read_rows = map_rows(rows, read, f"host string, page long, layout long, {OUTLINE}, words array<int>, links array<int>, texts array<long>", batch_rows=500)
    return checkpointed(read_rows.dropDuplicates(["host", "layout", "page"]))


def _aligned(rows: DataFrame) -> DataFrame:
    """(host, layout, node, text, n, words, links, repeats): counts of each node of a reference, and of texts of a host (layout 0), combined map-side."""

    def count(batches):
        for batch in batches:
            seen: dict[tuple, list] = {}
            columns = [batch[c].to_pylist() for c in ("host", "layout", "tags", "names", "parents", "repeats", "words", "links", "texts", "ref_tags", "ref_names", "ref_parents")]
            for host, lay, tags, names, parents, repeats, words, links, texts, *reference in zip(*columns, strict=True):
                match = simple_tree_matching(tags, names, parents, *reference)
                own = enumerate(zip(texts, words, links, repeats, strict=True))
                keys = [((host, lay, match[i], t), w, k, r) for i, (t, w, k, r) in own if (t or r > 1) and i in match]
                keys += [((host, 0, 0, t), 0, 0, 1) for t in {t for t in texts if t}]
                for key, w, k, r in keys:
                    got = seen.setdefault(key, [0, 0, 0, 1])
                    got[0] += 1
                    got[1] += w
                    got[2] += k
                    got[3] = max(got[3], r)
            keys, values = list(seen), list(seen.values())
            yield {c: [x[i] for x in keys] for i, c in enumerate(("host", "layout", "node", "text"))} | {c: [x[i] for x in values] for i, c in enumerate(("n", "words", "links", "repeats"))}

    found = map_rows(rows, count, "host string, layout long, node int, text long, n long, words long, links long, repeats int", batch_rows=2000)
    return found.groupBy("host", "layout", "node", "text").agg(*[F.sum(c).alias(c) for c in ("n", "words", "links")], F.max("repeats").alias("repeats"))


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, layout, ref_tags, ref_names, ref_parents, keep, texts): a layout's reference, the nodes that are content, and its constant texts."""
    page = outlines(pages)
    tree = ["tags", "names", "parents"]
    reference = page.groupBy("host", "layout").agg(F.count("*").alias("pages"), F.min(F.struct("page", *tree)).alias("r"))
    reference = checkpointed(reference.select("host", "layout", "pages", *[F.col(f"r.{c}").alias(f"ref_{c}") for c in tree]))
    counts = checkpointed(_aligned(page.join(reference, ["host", "layout"])))
    nearly = lambda n, of: (n >= LEAST_PAGES) & (n - 1 >= SHARE * (of - 1) - 1e-9)
    sizes = reference.groupBy("host").agg(F.sum("pages").alias("pages"))
    template = counts.where("layout = 0").join(sizes, "host").where(nearly(F.col("n"), F.col("pages"))).select("host", "text", F.lit(True).alias("known"))
    here = counts.where("layout <> 0")
    said = F.when(F.col("text") != 0, F.col("n"))
    node = here.groupBy("host", "layout", "node").agg(
        F.coalesce(F.max(said), F.lit(0)).alias("top"), F.max_by("text", said).alias("text"), F.sum("words").alias("words"), F.sum("links").alias("links"), F.max("repeats").alias("repeats")
    )
    node = node.join(template, ["host", "text"], "left").withColumn("known", F.col("known").isNotNull())
    of_node = ("node", "top", "words", "links", "known", "repeats")
    nodes = node.groupBy("host", "layout").agg(F.collect_list(F.struct(*of_node)).alias("nodes"))
    texts = here.where("text <> 0").join(template, ["host", "text"]).groupBy("host", "layout").agg(F.collect_set("text").alias("texts"))
    whole = reference.join(nodes, ["host", "layout"]).join(texts, ["host", "layout"], "left")
    whole = whole.select("host", "layout", "pages", *[f"ref_{c}" for c in tree], *[F.col(f"nodes.{c}").alias(c) for c in of_node], "texts")

    def decide(batches):
        for batch in batches:
            out = []
            for row in zip(*[batch[c].to_pylist() for c in ("pages", "ref_tags", "ref_parents", *of_node)], strict=True):
                of, tags, parents, at, top, words, links, known, repeats = row
                total, linked, constant, most = [0] * len(tags), [0] * len(tags), [False] * len(tags), [1] * len(tags)
                for i, n, w, k, t, r in zip(at, top, words, links, known, repeats, strict=True):
                    total[i], linked[i], most[i] = w, k, r
                    constant[i] = n >= LEAST_PAGES and n - 1 >= SHARE * (of - 1) - 1e-9 or t
                out.append(sorted(content(tags, parents, most, total, linked, constant)))
            yield {c: batch[c] for c in ("host", "layout", "ref_tags", "ref_names", "ref_parents", "texts")} | {"keep": out}

    kinds = "host string, layout long, ref_tags array<string>, ref_names array<string>, ref_parents array<int>, keep array<int>, texts array<long>"
    return map_rows(whole, decide, kinds, batch_rows=200)


WRAPPER = ("ref_tags", "ref_names", "ref_parents", "keep", "texts")


def _wrapper(tags: list | None, names: list, parents: list, keep: list, texts: list | None) -> dict | None:
    return None if tags is None else {"tree": (tags, names, parents), "keep": frozenset(keep), "texts": frozenset(texts or ())}


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), one row per row of ``pages(page_id, url, html)``."""
    own = checkpointed(wrappers(pages))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), _host().alias("host"))
    size = own.agg(F.sum(F.size("ref_tags") + F.greatest(F.size("texts"), F.lit(0)) + 1).alias("n")).first()["n"] or 0
    shared = None
    if size <= BROADCAST_ROWS:
        known = {(r["host"], r["layout"]): _wrapper(*[r[c] for c in WRAPPER]) for r in own.collect()}
        shared = pages.sparkSession.sparkContext.broadcast(known)
    else:
        rows = map_rows(rows, _with_layouts, "page_id long, url string, html string, host string, layout long", batch_rows=500).join(own, ["host", "layout"], "left")

    def run(batches):
        for batch in batches:
            texts = []
            given = zip(*[batch[c].to_pylist() for c in WRAPPER], strict=True) if shared is None else None
            for html, host in zip(batch["html"].to_pylist(), batch["host"].to_pylist(), strict=True):
                outline = Outline(parse(html))
                texts.append(_content_text(outline, shared.value.get((host, layout(outline))) if shared else _wrapper(*next(given))))
            yield {"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]}

    return map_rows(rows, run, "page_id long, url string, text string, n_chars long", batch_rows=500)


def _with_layouts(batches):
    for batch in batches:
        yield {c: batch[c] for c in ("page_id", "url", "html", "host")} | {"layout": [layout(Outline(parse(html))) for html in batch["html"].to_pylist()]}
