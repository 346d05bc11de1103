"""Main-text extraction by wrapper induction.

Pages of one host share a template.  Each host has an exemplar, merged of
``SEEDS`` of its pages chosen by digest, so that it has the optional parts too.
Every page's tree of blocks is aligned with its host's exemplar by simple tree
matching: the greatest number of node pairs that keeps order and nesting, where
a pair has equal tags and classes that don't contradict.  Each exemplar node then
has the texts that the host's pages hold there.  A node is template if its texts recur: at least
half of the pages show there what some other page of the host shows too (a fixed
line, or one of a pool of menus, adverts or footers).  The other nodes are slots,
and slots are content.  A whole branch is template if most of its text is, with
whatever a page has there and the exemplar hasn't.

Inside an article or main element a recurring line may be the author's, so a
node is template there only if one text alone is in half of the host's pages.  Tags
that can't hold an article, and names of classes, settle what alignment can't:
readers' comments, hidden parts, hosts of a few pages.  A name loses against a
slot that holds most of the text.

Pages whose blocks have equal texts in equal order are copies and count once: what they
share says nothing about the template.

How it is laid out on a cluster
    * Three passes over the pages, local to a row: one picks seeds (built-in
      functions), one aligns, one extracts.  Pages are not shuffled while all
      wrappers together are within ``BROADCAST_BYTES`` (measured); else they are
      joined with their wrapper by host, which adaptive execution splits where a
      host is very common.
    * The texts' digests are counted by host, node and digest with map-side
      combine, so a host with a third of all pages is spread over tasks.
    * A wrapper is a tree of tags, classes and counts, not a page; no more than
      ``SEEDS`` trees of a host are ever gathered.

Defined results
    Null html counts as empty and gives empty text.  A null url, or one without
    a host, belongs to the host "".  A host of under ``LEAST_PAGES`` different
    pages has no template.  If the template leaves nothing of a page, the page is
    read without it.  Repeated rows are extracted alike; of several articles all
    count, in page order, and a main element where no article stands in it.  An
    empty table gives an empty result.
    White space runs become one space.  Blocks nested deeper than ``DEPTH`` are aligned as children of the
    block at that depth; their text stays in its place.
"""

from __future__ import annotations

import hashlib
import html
import json
import math
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle

BROADCAST_BYTES = 32 << 20
BROADCAST_SEEDS = 500_000
SEEDS = 12
LEAST_PAGES = 4
#: Share of pages with a recurring text from which a node is template, and share of a branch's text from which the branch is.
CONSTANT = 0.5
LINKS = 0.6
#: Where article elements hold less of a host's slots than this, they are not what its articles are in.
LEAST_SHARE = 0.2
DEPTH = 100
#: A block's text is told by a checksum above its length in so many bits; only a text of over 16 million characters counts as shorter than it is.
LENGTH_BITS = 24
LONGEST = (1 << LENGTH_BITS) - 1
#: Pairs of siblings compared in a table; of longer lists the same table is made row by row.
TABLE_CELLS = 250_000

# Element names of the HTML standard by how they are treated.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "title"}
NEVER = {"head", "nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "object", "canvas", "audio", "video", "map"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "dfn", "del", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
CLOSES_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
CLOSES_SAME = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
MAIN = {"article", "main"}
#: Words in class, id or role that mark what is not the article.
ASIDE_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "alert", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary", "consent", "contentinfo", "cookie", "cookies",
    "disqus", "footer", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pager", "pagination", "popup", "promo", "promoted",
    "recommended", "related", "replies", "reply", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "topbar", "widget",
}
#: Words that may stand beside those in a compound name; any other word makes it the name of something else.
BESIDE_WORDS = {
    "area", "bar", "block", "body", "bottom", "box", "button", "buttons", "container", "footer", "form", "global", "inner", "item", "items", "left", "link", "links", "list", "main", "outer", "page", "posts",
    "primary", "right", "secondary", "section", "site", "slot", "sticky", "stories", "text", "title", "top", "unit", "wrap", "wrapper",
}
#: Readers' words are never the article, however long they are.
READERS_WORDS = {"comment", "comments", "disqus", "replies", "reply"}

#: Comments, declarations, tags whose attributes are read as whole name=value pairs, and tags that never end well.
MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|))*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S
)
RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I) for tag in RAW}
ATTRIBUTE = re.compile(r"""([^\s=/"'][^\s=/]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'][^\s]*))?""")
NAMING = {"class", "id", "role"}
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


class Page:
    """The DOM tree of a page in preorder; node 0 is the root.  ``parts`` of a node are its texts and the numbers of its children."""

    __slots__ = ("tag", "classes", "words", "hidden", "parent", "parts")

    def __init__(self) -> None:
        self.tag: list[str] = []
        self.classes: list[str] = []
        self.words: list[frozenset[str]] = []
        self.hidden: list[bool] = []
        self.parent: list[int] = []
        self.parts: list[list[str | int]] = []

    def add(self, tag: str, parent: int, attributes: str = "") -> int:
        n = len(self.tag)
        classes, words, hidden = _marks(attributes) if attributes else ("", frozenset(), False)
        self.tag.append(tag)
        self.classes.append(classes)
        self.words.append(words)
        self.hidden.append(hidden)
        self.parent.append(parent)
        self.parts.append([])
        if parent >= 0:
            self.parts[parent].append(n)
        return n

    def sums(self, own: list[int]) -> list[int]:
        """Totals over each node's branch."""
        out = own[:]
        for n in range(len(out) - 1, 0, -1):
            out[self.parent[n]] += out[n]
        return out


def _marks(attributes: str) -> tuple[str, frozenset[str], bool]:
    """Class names without digits (sorted), words of names that say what a node is, and whether it isn't shown."""
    classes: set[str] = set()
    words: set[str] = set()
    hidden = False
    for name, value in ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name in NAMING:
            for whole in value.strip("\"'").split():
                parts = {p for p in re.split(r"[^a-z0-9]+", CAMEL.sub(" ", whole).lower()) if p and not p.isdigit()}
                if parts <= ASIDE_WORDS | BESIDE_WORDS:
                    words |= parts
                if name == "class":
                    classes.add(re.sub(r"\d+", "", whole.lower()))
        elif name == "hidden" or (name == "aria-hidden" and value.strip("\"'").lower() == "true") or (name == "style" and UNSEEN.search(value)):
            hidden = True
    return " ".join(sorted(classes)), frozenset(words), hidden


def parse(text: str) -> Page:
    """The DOM tree of a page, with the standard's implied ends of p, li and the like."""
    page = Page()
    at, here = 0, page.add("#root", -1)
    open_tags: dict[str, int] = {}
    tag_of, parent_of = page.tag, page.parent
    while m := MARKUP.search(text, at):
        if m.start() > at:
            page.parts[here].append(text[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if open_tags.get(tag):  # else nothing so named is open: the end tag is stray
                while tag_of[here] != tag:
                    open_tags[tag_of[here]] -= 1
                    here = parent_of[here]
                open_tags[tag] -= 1
                here = parent_of[here]
            continue
        if tag in CLOSES_P:
            if open_tags.get("p"):
                here = _closed(page, open_tags, here, "p", ())
        elif tag in CLOSES_SAME:
            here = _closed(page, open_tags, here, tag, CLOSES_SAME[tag])
            if tag in ("dt", "dd"):
                here = _closed(page, open_tags, here, "dt" if tag == "dd" else "dd", ("dl",))
        node = page.add(tag, here, m[3] or m[6] or "")
        if tag in RAW:  # its content isn't markup: go on after its end tag
            end = RAW_END[tag].search(text, at)
            at = end.end() if end else len(text)
        elif tag not in VOID:
            here = node
            open_tags[tag] = open_tags.get(tag, 0) + 1
    if at < len(text):
        page.parts[here].append(text[at:])
    return page


def _closed(page: Page, open_tags: dict[str, int], here: int, tag: str, within: tuple[str, ...]) -> int:
    """Where one stands after the implied end of an open ``tag``, if there is one inside ``within``."""
    if not open_tags.get(tag):
        return here
    up = here
    while up > 0 and page.tag[up] not in within and page.tag[up] not in ("article", "table", "button"):
        if page.tag[up] == tag:
            while here != up:
                open_tags[page.tag[here]] -= 1
                here = page.parent[here]
            open_tags[tag] -= 1
            return page.parent[up]
        up = page.parent[up]
    return here


def digest(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "replace")) << LENGTH_BITS | min(len(text), LONGEST) if text else 0


class Blocks:
    """The tree that is aligned: block elements in preorder, each with a digest of its text and that of its inline descendants."""

    __slots__ = ("labels", "texts", "parents", "children", "nodes", "inside")

    def __init__(self, labels: list[str], parents: list[int], texts: list[int] | None = None, nodes: list[int] | None = None) -> None:
        self.labels, self.parents, self.texts, self.nodes = labels, parents, texts, nodes
        self.children: list[list[int]] = [[] for _ in labels]
        #: Whether a block stands in an article or main element.
        self.inside: list[bool] = [False] * len(labels)
        for i in range(len(labels)):
            up = parents[i]
            if up >= 0:
                self.children[up].append(i)
            self.inside[i] = labels[i].partition(" ")[0] in MAIN or (up >= 0 and self.inside[up])

    def written(self) -> str:
        return json.dumps([self.labels, self.parents], separators=(",", ":"))


def read_blocks(text: str) -> Blocks:
    return Blocks(*json.loads(text))


def blocks(page: Page) -> Blocks:
    labels, parents, nodes, depths = ["#root"], [-1], [0], [0]
    texts: list[list[str]] = [[]]
    todo: list[tuple[Iterator[str | int], int]] = [(iter(page.parts[0]), 0)]
    while todo:
        parts, block = todo[-1]
        for p in parts:
            if isinstance(p, str):
                texts[block].append(p)
                continue
            tag = page.tag[p]
            if tag in INLINE:
                todo.append((iter(page.parts[p]), block))
                break
            texts[block].append(" ")
            if tag in RAW or tag in VOID:
                continue
            up = block
            while depths[up] >= DEPTH:
                up = parents[up]
            labels.append(f"{tag} {page.classes[p]}" if page.classes[p] else tag)
            parents.append(up)
            nodes.append(p)
            depths.append(depths[up] + 1)
            texts.append([])
            todo.append((iter(page.parts[p]), len(labels) - 1))
            break
        else:
            todo.pop()
    return Blocks(labels, parents, [digest(" ".join(html.unescape("".join(t)).split())) for t in texts], nodes)


class Matcher:
    """Simple tree matching of two block trees, with scores remembered by shape."""

    def __init__(self, a: Blocks, b: Blocks) -> None:
        self.a, self.b = a, b
        self.known: dict[tuple, int] = {}
        self.sizes: list[int] = []
        self.kinds: dict[str, tuple[str, frozenset[str]]] = {}
        self.scores: dict[tuple[int, int], int] = {}
        self.alike: dict[tuple[str, str], bool] = {}
        self.shape_a, self.shape_b = self.shapes(a), self.shapes(b)

    def shapes(self, tree: Blocks) -> list[int]:
        """A number per node, equal for equal branches."""
        out = [0] * len(tree.labels)
        for i in range(len(out) - 1, -1, -1):
            key = (tree.labels[i], *[out[c] for c in tree.children[i]])
            found = self.known.get(key)
            if found is None:
                found = self.known[key] = len(self.sizes)
                self.sizes.append(1 + sum(self.sizes[c] for c in key[1:]))
            out[i] = found
        return out

    def kind(self, label: str) -> tuple[str, frozenset[str]]:
        found = self.kinds.get(label)
        if found is None:
            tag, _, classes = label.partition(" ")
            found = self.kinds[label] = (tag, frozenset(classes.split()))
        return found

    def fits(self, i: int, j: int) -> bool:
        """Equal tags, and classes that are equal or share a name."""
        x, y = self.a.labels[i], self.b.labels[j]
        if x == y:
            return True
        found = self.alike.get((x, y))
        if found is None:
            (tag, own), (other, others) = self.kind(x), self.kind(y)
            found = self.alike[x, y] = tag == other and not own.isdisjoint(others)
        return found

    def score(self, i: int, j: int) -> int:
        if not self.fits(i, j):
            return 0
        key = (self.shape_a[i], self.shape_b[j])
        found = self.scores.get(key)
        if found is None:
            if key[0] == key[1]:
                found = self.sizes[key[0]]
            else:
                found = 1 + sum(self.score(x, y) for x, y in self.siblings(self.a.children[i], self.b.children[j]))
            self.scores[key] = found
        return found

    def siblings(self, xs: list[int], ys: list[int]) -> list[tuple[int, int]]:
        """The pairs of a best matching in order of two lists of siblings."""
        # Equal shapes at both ends match each other in some best matching.
        head, most = 0, min(len(xs), len(ys))
        while head < most and self.shape_a[xs[head]] == self.shape_b[ys[head]]:
            head += 1
        tail = 0
        while tail < most - head and self.shape_a[xs[-1 - tail]] == self.shape_b[ys[-1 - tail]]:
            tail += 1
        out = list(zip(xs[:head], ys[:head], strict=True))
        rest_x, rest_y = xs[head : len(xs) - tail], ys[head : len(ys) - tail]
        if rest_x and rest_y:
            out += self.by_rows(rest_x, rest_y) if len(rest_x) * len(rest_y) > TABLE_CELLS else self.tabled(rest_x, rest_y)
        return out + list(zip(xs[len(xs) - tail :], ys[len(ys) - tail :], strict=True))

    def tabled(self, xs: list[int], ys: list[int]) -> list[tuple[int, int]]:
        rows = [[0] * (len(ys) + 1)]
        for x in xs:
            last, row = rows[-1], [0]
            for j, y in enumerate(ys):
                gain = last[j] + self.score(x, y) if self.fits(x, y) else 0
                row.append(max(last[j + 1], row[j], gain))
            rows.append(row)
        out, i, j = [], len(xs), len(ys)
        while i and j:
            if rows[i][j] == rows[i - 1][j]:
                i -= 1
            elif rows[i][j] == rows[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((xs[i], ys[j]))
        return out[::-1]

    def by_rows(self, xs: list[int], ys: list[int]) -> list[tuple[int, int]]:
        """What :meth:`tabled` finds, for long lists: whole rows at a time, of which only every n-th is kept and the others are made again on the way back."""
        shapes, kind = np.unique([self.shape_b[y] for y in ys], return_inverse=True)
        first = {shape: y for y, shape in zip(ys, (self.shape_b[y] for y in ys), strict=True)}
        by_shape: dict[int, np.ndarray] = {}

        def following(last: np.ndarray, x: int) -> np.ndarray:
            own = by_shape.get(self.shape_a[x])
            if own is None:
                own = by_shape[self.shape_a[x]] = np.array([self.score(x, first[shape]) for shape in shapes.tolist()])
            score = own[kind]
            row = np.zeros_like(last)
            np.maximum.accumulate(np.maximum(last[1:], np.where(score > 0, last[:-1] + score, 0)), out=row[1:])
            return row

        block = math.isqrt(len(xs)) + 1
        row, kept = np.zeros(len(ys) + 1, dtype=np.int64), []
        for i, x in enumerate(xs):
            if i % block == 0:
                kept.append(row)
            row = following(row, x)
        out, i, j = [], len(xs), len(ys)
        while kept and j:
            begin = (len(kept) - 1) * block
            rows = [kept.pop()]
            rows += [row := following(rows[-1] if k == begin else row, xs[k]) for k in range(begin, i)]
            while i > begin and j:
                here = rows[i - begin]
                if here[j] == rows[i - begin - 1][j]:
                    i -= 1
                elif here[j] == here[j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    out.append((xs[i], ys[j]))
        return out[::-1]

    def pairs(self) -> Iterator[tuple[int, int]]:
        """Matched nodes of the two trees, whose roots match."""
        todo = [(0, 0)]
        while todo:
            i, j = todo.pop()
            yield i, j
            if self.a.children[i] and self.b.children[j]:
                todo += self.siblings(self.a.children[i], self.b.children[j])


def merged(trees: list[Blocks]) -> Blocks:
    """One tree with the nodes of all: each tree is aligned with what the ones before gave, and its unmatched branches are put in their places."""
    whole = trees[0]
    for tree in trees[1:]:
        partner = dict(Matcher(tree, whole).pairs())
        labels, parents = [], []

        def add(i: int | None, j: int | None, up: int, whole: Blocks = whole, tree: Blocks = tree, partner: dict[int, int] = partner, labels: list[str] = labels, parents: list[int] = parents) -> None:
            """Node j of the whole, which is node i of the tree, or a node of one of them alone."""
            here = len(labels)
            labels.append(tree.labels[i] if j is None else whole.labels[j])
            parents.append(up)
            rest = list(whole.children[j]) if j is not None else []
            for c in tree.children[i] if i is not None else []:
                own = partner.get(c)
                if own is None:
                    add(c, None, here)
                    continue
                while rest[0] != own:
                    add(None, rest.pop(0), here)
                add(c, rest.pop(0), here)
            for c in rest:
                add(None, c, here)

        add(0, 0, -1)
        whole = Blocks(labels, parents)
    return whole


# -- the main text of a page

def _dropped_by_name(page: Page, n: int, most: set[int]) -> bool:
    """Whether tag, attributes or names say that a node isn't the article; of a node with most of the text only readers' names do, and what can't hold text at all."""
    tag, words = page.tag[n], page.words[n]
    if page.hidden[n]:
        return True
    if tag in NEVER:
        return not (tag == "form" and n in most)
    if tag in MAIN or tag == "body" or tag == "html":
        return False
    return bool(words & ASIDE_WORDS) and (n not in most or bool(words & READERS_WORDS))


class Reader:
    """Reads the text of one page, given which nodes are template and which hold most of the host's slots."""

    def __init__(self, page: Page, branch: set[int] | frozenset[int] = frozenset(), own: set[int] | frozenset[int] = frozenset(), slots: set[int] | frozenset[int] = frozenset(), articles: bool = True) -> None:
        self.page, self.own, self.articles = page, own, articles
        lengths, linked = [0] * len(page.tag), [0] * len(page.tag)
        in_link = [False] * len(page.tag)
        for n, parts in enumerate(page.parts):
            in_link[n] = page.tag[n] == "a" or (n > 0 and in_link[page.parent[n]])
            if page.tag[n] not in RAW:
                lengths[n] = sum(len(p.strip()) for p in parts if isinstance(p, str))
                linked[n] = lengths[n] if in_link[n] else 0
        self.sizes, self.linked = page.sums(lengths), page.sums(linked)
        total = self.sizes[0]
        self.most = {n for n, size in enumerate(self.sizes) if total and 2 * size >= total} | slots
        # Template and named parts go with all that is inside.
        self.gone = [False] * len(page.tag)
        for n in range(1, len(page.tag)):
            self.gone[n] = self.gone[page.parent[n]] or n in branch or page.tag[n] in RAW or _dropped_by_name(page, n, self.most)

    def roots(self) -> list[int]:
        """Elements that hold the article: articles rather than the main element around them, readers' last; none on a host whose articles hold little of its slots' text."""
        page = self.page
        clean: list[int] = []
        doubtful: list[int] = []
        mains: list[int] = []
        holds: set[int] = set()  # nodes with a clean article inside
        under: list[bool] = [False] * len(page.tag)  # inside an article already taken
        for n in range(1, len(page.tag)):
            up = page.parent[n]
            under[n] = under[up] or (page.tag[up] == "article" and not self.gone[up])
            if self.gone[n] or under[n]:
                continue
            if page.tag[n] == "article":
                if page.words[n] & ASIDE_WORDS:
                    doubtful.append(n)
                    continue
                clean.append(n)
                up = n
                while up >= 0 and up not in holds:
                    holds.add(up)
                    up = page.parent[up]
            elif page.tag[n] == "main":
                mains.append(n)
        for n in mains:
            if n not in holds:
                clean.append(n)
                holds.add(n)
        if clean and not self.articles:
            return []
        return sorted(clean) or doubtful

    def text(self) -> str:
        """Text of the content slots in page order."""
        page, out = self.page, []
        roots = self.roots()
        for root in roots or [0]:
            todo: list[str | tuple[int, bool, bool]] = [(root, bool(roots), False)]
            while todo:
                item = todo.pop()
                if isinstance(item, str):
                    out.append(item)
                    continue
                n, in_main, in_header = item
                tag = page.tag[n]
                if tag == "br":
                    out.append(" ")
                if n != root and (self.gone[n] or (tag == "article" and page.words[n] & ASIDE_WORDS)):
                    continue
                in_header = in_header or tag == "header"
                if in_header and not in_main:
                    continue
                if tag in ("ul", "ol", "table", "div") and not in_main and self.linked[n] > LINKS * self.sizes[n]:
                    continue
                if tag not in INLINE:
                    out.append(" ")
                    todo.append(" ")
                drop, quiet = n in self.own, in_header and tag not in HEADINGS
                for p in reversed(page.parts[n]):
                    if not isinstance(p, str):
                        if not (drop and page.tag[p] in INLINE):
                            todo.append((p, in_main, quiet))
                    elif not drop and not quiet:
                        todo.append(p)
        return " ".join(html.unescape("".join(out)).split())


# -- wrappers


class Wrapper:
    """A host's exemplar, and which of its nodes are template (their own text, or the whole branch) or hold most of the slots' text."""

    def __init__(self, exemplar: Blocks, stats: list[tuple[int, int, int, int, int, int]]) -> None:
        self.exemplar = exemplar
        size = len(exemplar.labels)
        template, slots = [0] * size, [0] * size
        own: set[int] = set()
        everywhere = max((pages for _, pages, *_ in stats), default=0)
        for node, pages, recurring, top, chars, extra in stats:
            constant = top >= CONSTANT * everywhere if exemplar.inside[node] else recurring >= CONSTANT * pages
            if pages >= LEAST_PAGES and constant:
                own.add(node)
                template[node] += chars
            else:
                slots[node] += chars
            slots[node] += extra
        in_article, holds_article = 0, [label.partition(" ")[0] in MAIN for label in exemplar.labels]
        for i in range(size - 1, 0, -1):
            up = exemplar.parents[i]
            in_article += slots[i] if exemplar.inside[i] and not exemplar.inside[up] else 0
            template[up] += template[i]
            slots[up] += slots[i]
            holds_article[up] = holds_article[up] or holds_article[i]
        #: Whether article elements are what the host's slots are in; true where there are none, or too little to tell.
        self.articles = not any(holds_article) or everywhere < LEAST_PAGES or in_article >= LEAST_SHARE * slots[0]
        self.own = frozenset(own)
        self.slots = frozenset(i for i in range(1, size) if slots[0] and 2 * slots[i] >= slots[0])  # however much template stands beside them
        self.branch = frozenset(i for i in range(1, size) if template[i] and not holds_article[i] and i not in self.slots and template[i] >= CONSTANT * (template[i] + slots[i]))


def extract(text: str, wrapper: Wrapper | None) -> str:
    """Main text of one page under its host's wrapper."""
    page = parse(text)
    if wrapper is not None and (wrapper.own or wrapper.branch or wrapper.slots or not wrapper.articles):
        tree = blocks(page)
        own, branch, slots = set(), set(), set()
        for i, j in Matcher(tree, wrapper.exemplar).pairs():
            if j in wrapper.branch:
                branch.add(tree.nodes[i])
            elif j in wrapper.own:
                own.add(tree.nodes[i])
            elif j in wrapper.slots:
                slots.add(tree.nodes[i])
        if found := Reader(page, branch, own, slots, wrapper.articles).text():
            return found
    return Reader(page).text()


def aligned(tree: Blocks, exemplar: Blocks) -> tuple[list[int], list[int]]:
    """Exemplar nodes and digests of the texts that a page has there; negative: characters of blocks below that match no node."""
    partner = dict(Matcher(tree, exemplar).pairs())
    extra: dict[int, int] = {}
    nodes, texts = [], []
    nearest = [0] * len(tree.labels)
    for i, text in enumerate(tree.texts):
        j = partner.get(i)
        nearest[i] = nearest[tree.parents[i]] if j is None else j
        if not text:
            continue
        if j is None:
            extra[nearest[i]] = extra.get(nearest[i], 0) + (text & LONGEST)
        else:
            nodes.append(j)
            texts.append(text)
    return [*nodes, *extra], [*texts, *(-n for n in extra.values())]


def copy_key(tree: Blocks) -> int:
    """The same for pages whose blocks have the same texts in the same order."""
    return int.from_bytes(hashlib.blake2b(repr([t for t in tree.texts if t]).encode(), digest_size=8).digest(), "big", signed=True)


def _host(url: str) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


STATS = "array<struct<node:int,pages:bigint,recurring:bigint,top:bigint,chars:bigint,extra:bigint>>"


def _with_wrapper(rows: DataFrame, wrappers: DataFrame, limit: int) -> tuple[DataFrame, Callable[[pa.RecordBatch], Iterator[Wrapper | None]]]:
    """``rows`` with what a task needs to know each row's wrapper: a broadcast, or columns from a join by host."""
    size = wrappers.agg(F.sum(F.length("exemplar") + 48 * F.size("stats"))).first()[0] or 0
    read: dict[str, Wrapper | None] = {}

    def known(host: str, found: tuple[str, list] | None) -> Wrapper | None:
        if host not in read:
            if len(read) >= 256:
                read.clear()
            read[host] = Wrapper(read_blocks(found[0]), [tuple(s.values()) if isinstance(s, dict) else tuple(s) for s in found[1]]) if found else None
        return read[host]

    if size <= limit:
        shared = rows.sparkSession.sparkContext.broadcast({r["host"]: (r["exemplar"], [tuple(s) for s in r["stats"]]) for r in wrappers.collect()})

        def from_broadcast(batch: pa.RecordBatch) -> Iterator[Wrapper | None]:
            for host in batch.column(0).to_pylist():
                yield known(host, shared.value.get(host))

        return rows, from_broadcast

    def from_columns(batch: pa.RecordBatch) -> Iterator[Wrapper | None]:
        texts, stats = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
        for i, host in enumerate(batch.column(0).to_pylist()):
            yield known(host, None if host in read or not texts[i].is_valid else (texts[i].as_py(), stats[i].as_py()))

    return rows.join(wrappers, "host", "left"), from_columns


def induce(pages: DataFrame, url_col: str = "url", html_col: str = "html", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """host, exemplar (block tree as text), stats of its nodes: a row per host."""
    rows = pages.select(_host(url_col).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("page"))
    keyed = rows.withColumn("_key", F.xxhash64("page"))
    seeds = settle(keyed.groupBy("host", F.pmod("_key", F.lit(SEEDS)).alias("_turn")).agg(F.min("_key").alias("_least")).select(F.col("host").alias("_of"), "_least"))
    picked = keyed.join(F.broadcast(seeds) if seeds.count() <= BROADCAST_SEEDS else seeds, (keyed["host"] == seeds["_of"]) & (keyed["_key"] == seeds["_least"]))

    def outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees = [blocks(parse(x.as_py())).written() for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(trees, pa.string())], ["host", "key", "tree"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees = [merged([read_blocks(t) for t in x.as_py()]).written() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(trees, pa.string())], ["host", "exemplar"])

    trees = picked.select("host", "_key", "page").mapInArrow(outline, "host string, key bigint, tree string").groupBy("host", "key").agg(F.min("tree").alias("tree"))
    gathered = trees.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("key", "tree"))).alias("of"))  # SEEDS rows at most
    outlines = gathered.select("host", F.col("of.tree").alias("trees")).mapInArrow(merge, "host string, exemplar string")
    outlines = settle(outlines.withColumn("stats", F.array().cast(STATS)))
    given, wrapper_of = _with_wrapper(rows, outlines, broadcast_bytes)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, list[int], list[int]]] = []
            for value, wrapper in zip(batch.column(1), wrapper_of(batch), strict=True):
                tree = blocks(parse(value.as_py()))
                found.append((copy_key(tree), *aligned(tree, wrapper.exemplar)))
            keys, nodes, texts = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.int64()), pa.array(nodes, pa.list_(pa.int32())), pa.array(texts, pa.list_(pa.int64()))], ["host", "key", "nodes", "texts"])

    seen = given.mapInArrow(tally, "host string, key bigint, nodes array<int>, texts array<bigint>")
    # Copies count once: the one whose alignment sorts first.
    single = seen.groupBy("host", "key").agg(F.min(F.struct("nodes", "texts")).alias("of"))
    cells = single.select("host", F.explode(F.arrays_zip("of.nodes", "of.texts")).alias("cell")).select("host", F.col("cell.nodes").alias("node"), F.col("cell.texts").alias("text"))
    by_text = cells.groupBy("host", "node", "text").agg(F.count("*").alias("n"))
    real = lambda value: F.sum(F.when(F.col("text") > 0, value).otherwise(0))
    by_node = by_text.groupBy("host", "node").agg(
        real(F.col("n")).alias("pages"),
        real(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("recurring"),
        F.max(F.when(F.col("text") > 0, F.col("n")).otherwise(0)).alias("top"),
        real(F.col("n") * F.col("text").bitwiseAND(F.lit(LONGEST))).alias("chars"),
        F.sum(F.when(F.col("text") < 0, -F.col("n") * F.col("text")).otherwise(0)).alias("extra"),
    )
    stats = by_node.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("node", "pages", "recurring", "top", "chars", "extra"))).alias("found"))  # as many as the exemplar has blocks
    return settle(outlines.join(stats, "host", "left").select("host", "exemplar", F.coalesce("found", "stats").cast(STATS).alias("stats")))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    wrappers = induce(pages, url_col, html_col, broadcast_bytes)
    rows = pages.select(_host(url_col).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("page"), F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    given, wrapper_of = _with_wrapper(rows, wrappers, broadcast_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x.as_py(), w) for x, w in zip(batch.column(1), wrapper_of(batch), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(3), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    return given.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")
