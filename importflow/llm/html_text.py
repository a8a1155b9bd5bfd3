"""Main text of web pages by wrapper induction.

The pages of a host are parsed to trees of block elements (runs of alike siblings are one node, as
a template repeats them) and aligned by simple tree matching with
a wrapper, which takes up from every page what it does not have yet; then all are aligned with it.
In aligned runs, nodes whose text stands on nearly all pages, as often on each, are template; nodes
whose text varies are slots.  A page's text is what its articles (else main element, else body) hold in slots and in
nodes of its own, less elements that by tag or class are menus, headers, footers, sidebars,
notices, adverts, forms or reader comments; under the body, lists of links go too.  Articles with
less than ``LEAST_SHARE`` of the page's text are teasers, and the element round them counts.  A class tells
by a whole name ("sidebar", "ad-box", not "no-sidebar").  Names that articles use as well
(``_DOUBTFUL``: "discussion", "related") and ids, which may come from a heading, tell only of an
element that is mostly links, or of which nothing but headings would be left (ids: also the few
words of ``_OFF_IDS``); none of them cuts a heading, nor all of a page.  Nodes are
alike by tag and class words without digits, never by id.

A host's pages are aligned in chunks of about ``CHUNK`` pages or ``CHUNK_BYTES``, so that a host of
any size is dealt out over many tasks; a page alone in its chunk is read by tag and class only.  A
node counts as template from ``MIN_PAGES`` pages with different articles on.

NULL and empty html: empty text.  NULL url: a host of its own.  Repeated rows give a result each.
Empty table: empty result.  Columns other than the three are not read, so their names cannot clash.
Markup is read once from front to back, so broken and very long pages take time by their length,
and trees of any depth are aligned.  A quote opens a value only after "=" and if it is closed; a tag
that no ">" ends takes the rest of the page, as in browsers.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from importflow.llm import rows
from importflow.operators.skew import checked_broadcast
from importflow.session import freeze

CHUNK = 128
CHUNK_BYTES = 16 << 20
MIN_PAGES = 5
NEARLY_ALL = 0.9        # of the aligned pages show a template node with the same text
LINKED = 0.5            # share of a node's text in links from which on it is a menu
LEAST_SHARE = 0.25      # of a page's text is in its article or main element

_BEGIN = re.compile(r"<(?:(!--)|[!?]|/(?![a-zA-Z])|(/?)([a-zA-Z][^\s/>]*))")
_ATTRIBUTES = re.compile(r"((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
_RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "object",
        "annotation", "annotation-xml"}
_NAMES = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PARTS = re.compile(r"[^a-z0-9]+")
_VOID = {"br", "hr", "img", "input", "meta", "link", "source", "wbr", "area", "base", "col", "embed", "track"}
_BLOCKS = set(
    "html head body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th "
    "caption blockquote pre figure figcaption header footer nav aside form fieldset address details summary hr "
    "menu dialog center hgroup search legend select option button label".split()
)
_ENDED_BY = {       # an open element that the begin of another one ends
    "p": _BLOCKS - {"label", "button", "select", "option"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"},
    "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}, "head": {"body"},
}
_OFF_TAGS = {"head", "nav", "footer", "aside", "form", "menu", "dialog", "select", "button", "fieldset", "label", "search"}
_OFF_NAMES = set(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies "
    "consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup login "
    "sidebar sidenav menu nav navbar navigation navigational breadcrumb breadcrumbs footer masthead comment comments "
    "reply replies respond disqus discussion related recommended share sharing social widget toolbar pagination "
    "pager skip complementary contentinfo search form".split()
)
_DOUBTFUL = {"discussion", "search", "social", "related", "recommended", "respond", "reply", "replies", "share", "sharing"}
_PLACES = set(      # what a class may add to a listed name
    "box block container wrapper wrap outer inner bar area unit slot list item items section panel widget site page main "
    "top bottom left right primary secondary global local mobile sticky fixed posts articles links stories".split()
)
_OFF_IDS = {"comments", "disqus", "disqus_thread", "respond", "sidebar", "navbar", "masthead", "footer"}   # of a div
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


class Node:
    """An element; ``settle`` adds what its whole subtree holds: a number of its text (0: none), the
    characters, those in links, and those that are neither in headings nor in boilerplate."""

    __slots__ = ("tag", "names", "told", "parts", "linked", "said", "all", "all_linked", "left")

    def __init__(self, tag: str, names: frozenset, told: frozenset = frozenset()):
        self.tag, self.names, self.told, self.parts, self.linked = tag, names, told, [], 0
        self.said = self.all = self.all_linked = self.left = 0

    @property
    def label(self):
        return self.tag, self.names

    @property
    def children(self):
        return [p for p in self.parts if isinstance(p, Node)]

    def is_off(self, in_article: bool, by_name: bool = True) -> bool:
        if self.tag in _OFF_TAGS or self.tag == "header" and not in_article:
            return True
        if not by_name or not self.told or self.tag in _HEADINGS or self.tag in ("html", "body"):
            return False
        if "class" in self.told or "header" in self.told and not in_article:
            return True
        if "doubtful" in self.told and (_is_menu(self) or not self.left):
            return True
        return "id" in self.told and (self.tag == "div" and "plain id" in self.told or _is_menu(self))


def _told(found: list[tuple]) -> frozenset:
    """What the attributes (name and value) of an element say: which of them name boilerplate."""
    told = set()
    for name, value in found:
        for word in value.split():
            parts = [p for p in _PARTS.split(word) if p]
            listed = [p for p in parts if p in _OFF_NAMES]
            if name == "id":
                told |= {"id"} if listed else set()
                told |= {"plain id"} if word in _OFF_IDS else set()
            elif listed and all(p in _OFF_NAMES or p in _PLACES for p in parts):
                told.add("doubtful" if all(p in _DOUBTFUL for p in listed) else "class")
            elif "header" in parts and all(p == "header" or p in _PLACES for p in parts):
                told.add("header")
    return frozenset(told)


def parse(html: str) -> Node:
    """The tree of block elements; inline elements leave their text in the block round them."""
    root = Node("#", frozenset())
    stack, links, at = [root], 0, 0
    names_of: dict[str, tuple[frozenset, frozenset]] = {}

    def text(piece):
        if piece:
            piece = unescape(piece) if "&" in piece else piece
            stack[-1].parts.append(piece)
            if links:
                stack[-1].linked += sum(map(len, piece.split()))

    pos, end, whole = 0, len(html), True
    open_tags: Counter = Counter()

    def leave(first):
        for node in stack[first:]:
            open_tags[node.tag] -= 1
        del stack[first:]

    while pos < end:
        found = _BEGIN.search(html, pos)
        if not found:
            text(html[at:])
            break
        text(html[at:found.start()])
        pos = found.end()
        tag = found.group(3)
        if not tag:
            over = html.find("-->" if found.group(1) else ">", found.start() + 2)
            at = pos = end if over < 0 else over + (3 if found.group(1) else 1)
            continue
        attributes = _ATTRIBUTES.match(html, pos) if whole else None
        if attributes:
            at = pos = attributes.end()
            rest = attributes.group(1)
        else:       # quotes hide every ">" that is left: from here on the first one ends a tag
            whole = False
            over = html.find(">", pos)
            if over < 0:
                break
            rest = html[pos:over]
            at = pos = over + 1
        tag, closing = tag.lower(), found.group(2)
        if tag in _RAW:
            if not closing and not rest.endswith("/"):
                over = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, pos)
                at = pos = over.end() if over else end
        elif tag == "a":
            links = 0 if closing else 1
        elif tag in _BLOCKS and not closing:
            for open_ in range(len(stack) - 1, 0, -1):
                ended = _ENDED_BY.get(stack[open_].tag)
                if ended is None:
                    break
                if tag in ended:
                    leave(open_)
                    break
            names = names_of.get(rest)
            if names is None:
                told = [(m[0].lower(), "".join(m[1:]).lower()) for m in _NAMES.findall(rest)] if "=" in rest else []
                parts = frozenset(
                    n for name, value in told if name != "id" or value == "main"
                    for n in _PARTS.split(value) if n and not any(c.isdigit() for c in n)
                )
                names = names_of[rest] = parts, _told(told)
            node = Node(tag, *names)
            stack[-1].parts.append(node)
            links = 0
            if tag not in _VOID and not rest.endswith("/"):
                stack.append(node)
                open_tags[tag] += 1
        elif tag in _BLOCKS:
            if open_tags[tag]:
                open_ = len(stack) - 1
                while stack[open_].tag != tag:
                    open_ -= 1
                leave(open_)
                links = 0
        elif tag in ("br", "wbr", "img"):
            if tag == "br":
                stack[-1].parts.append(" ")
    return root


def blocks(node: Node, skip, out: list[str]) -> list[str]:
    """The texts of blocks in page order; ``skip`` tells which nodes to leave out."""
    work = [iter(node.parts)]
    line: list[str] = []

    def close():
        if line:
            words = "".join(line).split()
            if words:
                out.append(" ".join(words))
            line.clear()

    while work:
        for part in work[-1]:
            if isinstance(part, str):
                line.append(part)
            else:
                close()
                if not skip(part):
                    work.append(iter(part.parts))
                    break
        else:
            close()
            work.pop()
    return out


def settle(tree: Node, numbers: dict) -> int:
    """Fill in what subtrees hold, from the leaves up; ``numbers`` numbers texts.  Returns the depth."""
    order, work, deepest = [], [(tree, 1, False)], 0
    while work:
        node, depth, boxed = work.pop()
        boxed = boxed or node.tag in _HEADINGS
        order.append((node, boxed))
        deepest = max(deepest, depth)
        work += [(child, depth + 1, boxed) for child in node.children]
    for node, boxed in reversed(order):
        said, line = [], []
        for part in [*node.parts, None]:
            if isinstance(part, str):
                line.append(part)
                continue
            words = "".join(line).split() if line else None
            if words:
                said.append(" ".join(words))
                length = sum(map(len, words))
                node.all += length
                node.left += 0 if boxed else length
            line = []
            if part is not None and part.said:
                said.append(part.said)
                node.all += part.all
                node.left += 0 if part.is_off(True) else part.left
            if part is not None:
                node.all_linked += part.all_linked
        node.all_linked += node.linked
        if said:
            alone = len(said) == 1 and isinstance(said[0], int)
            node.said = said[0] if alone else numbers.setdefault(tuple(said), len(numbers) + 1)
    return deepest


def groups(nodes: list[Node]) -> list[list[Node]]:
    """Runs of alike siblings."""
    runs: list[list[Node]] = []
    for n in nodes:
        if runs and runs[-1][0].label == n.label:
            runs[-1].append(n)
        else:
            runs.append([n])
    return runs


class Shape:
    """A run of alike nodes and the runs below them: what trees are aligned by."""

    __slots__ = ("nodes", "below", "key")

    def __init__(self, nodes: list[Node], key: int = -1):
        self.nodes, self.key, self.below = nodes, key, []

    @classmethod
    def of(cls, tree: Node, keys: dict) -> Shape:
        order = [cls([tree])]
        for shape in order:
            shape.below = [cls(run) for run in groups([c for n in shape.nodes for c in n.children])]
            order += shape.below
        for shape in reversed(order):
            shape.name(keys)
        return order[0]

    def name(self, keys: dict):
        """The key: a number of ``keys`` for each label and keys below."""
        self.key = keys.setdefault((self.nodes[0].label, tuple(s.key for s in self.below)), len(keys))

    def copy(self) -> Shape:
        made = Shape(self.nodes, self.key)
        work = [(self, made)]
        while work:
            old, new = work.pop()
            new.below = [Shape(s.nodes, s.key) for s in old.below]
            work += zip(old.below, new.below)
        return made


def match(a: Shape, b: Shape, known: dict) -> tuple[int, list]:
    """Simple tree matching: how many nodes can be paired with order and descent kept, and which
    children are (as pairs of places)."""
    if a.nodes[0].label != b.nodes[0].label:
        return 0, []
    pair = known.get((a.key, b.key))
    if pair is None:
        # what both begin and end with is paired: no other way pairs more of it
        m, n, same, tail = len(a.below), len(b.below), 0, 0
        while same < min(m, n) and a.below[same].key == b.below[same].key:
            same += 1
        while tail < min(m, n) - same and a.below[-1 - tail].key == b.below[-1 - tail].key:
            tail += 1
        ends = [(i, i) for i in range(same)], [(m - k, n - k) for k in range(tail, 0, -1)]
        outer = sum([match(a.below[i], b.below[j], known)[0] for i, j in [*ends[0], *ends[1]]])
        first, second = a.below[same:m - tail], b.below[same:n - tail]
        m, n = len(first), len(second)
        best = [[0] * (n + 1) for _ in range(m + 1)]
        inner = [[match(x, y, known)[0] for y in second] for x in first]
        for i in range(1, m + 1):
            for j in range(1, n + 1):
                best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + inner[i - 1][j - 1])
        pairs, i, j = [], m, n
        while i and j:
            if inner[i - 1][j - 1] and best[i][j] == best[i - 1][j - 1] + inner[i - 1][j - 1]:
                pairs.append((same + i - 1, same + j - 1))
                i, j = i - 1, j - 1
            elif best[i][j] == best[i - 1][j]:
                i -= 1
            else:
                j -= 1
        pair = known[a.key, b.key] = best[m][n] + outer + 1, [*ends[0], *pairs[::-1], *ends[1]]
    return pair


def aligned(a: Shape, b: Shape, known: dict):
    """Pairs of runs of the two trees, from the roots down."""
    work = [(a, b)]
    while work:
        x, y = work.pop()
        if x.nodes[0].label == y.nodes[0].label:
            yield x, y
            work += [(x.below[i], y.below[j]) for i, j in match(x, y, known)[1]]


def grow(wrapper: Shape, page: Shape, known: dict, keys: dict) -> bool:
    """Put into the wrapper, at their places, the runs of a page that it does not have."""
    pairs = match(wrapper, page, known)[1]
    mine = dict((j, i) for i, j in pairs)
    grown, below, at = False, [], 0
    for j, run in enumerate(page.below):
        if j in mine:
            below += wrapper.below[at:mine[j] + 1]
            at = mine[j] + 1
            grown |= grow(below[-1], run, known, keys)
        else:
            below.append(run.copy())
            grown = True
    if grown:
        wrapper.below = below + wrapper.below[at:]
        wrapper.name(keys)
    return grown


def roots(tree: Node, template: set[int] = frozenset()) -> list[Node]:
    """The outermost articles outside boilerplate, else main elements there, else either anywhere, else
    all.  Outside boilerplate they must hold ``LEAST_SHARE`` of the page's text that is neither that nor link."""

    def find(wanted, anywhere=False):
        found, work = [], [tree]
        while work:
            node = work.pop()
            if id(node) in template:
                continue
            if (node.tag == wanted or wanted == "main" and "main" in node.names) and not node.is_off(True):
                found.append(node)
            else:
                work += [c for c in reversed(node.children) if anywhere or not c.is_off(False)]
        return found

    def size(of):
        total, work = 0, list(of)
        while work:
            node = work.pop()
            if id(node) not in template and (node is tree or not node.is_off(True)):
                total += sum(len(p) for p in node.parts if isinstance(p, str) and p.strip()) - node.linked
                work += node.children
        return total

    whole = None
    for wanted in ("article", "main"):
        found = find(wanted)
        if found:
            whole = size([tree]) if whole is None else whole
            if size(found) >= LEAST_SHARE * whole:
                return found
    if whole is None:
        for wanted in ("article", "main"):
            found = find(wanted, anywhere=True)
            if found:
                return found
    return [tree]


def template_runs(trees: list[Node]) -> set[int]:
    """The nodes (by identity) that stand for template on their page."""
    found: set[int] = set()
    if len(trees) < MIN_PAGES:
        return found
    known: dict = {}
    keys: dict = {}
    # copies of one article would make all of it look constant: each counts once
    articles: dict[tuple, int] = {}
    for i, tree in enumerate(trees):
        articles.setdefault(tuple(n.said for n in roots(tree)), i)
    if len(articles) < MIN_PAGES:
        return found
    voters = set(articles.values())
    pages = [Shape.of(t, keys) for t in trees]
    wrapper = pages[min(voters)].copy()
    taken = {wrapper.key}
    for shape in pages:
        if shape.key not in taken:
            taken.add(shape.key)
            grow(wrapper, shape, known, keys)
    seen: dict[int, Counter] = {}       # of each slot, the pages with a text so many times
    voted: Counter = Counter()
    where: dict[int, list] = {}
    for i, shape in enumerate(pages):
        for x, y in aligned(wrapper, shape, known):
            if y.nodes[0].tag not in ("#", "html", "head", "body", "article", "main"):
                texts = [node.said for node in y.nodes]
                often = Counter(texts)
                where.setdefault(id(x), []).extend(((t, often[t]), node) for t, node in zip(texts, y.nodes) if t)
                if i in voters:
                    voted[id(x)] += 1
                    seen.setdefault(id(x), Counter()).update(often.items())
    for slot, texts in seen.items():
        constant = {t for t, n in texts.items() if n >= MIN_PAGES and n >= NEARLY_ALL * voted[slot]}
        if constant:
            found.update(id(node) for mine, node in where[slot] if mine in constant)
    return found


def main_text(tree: Node, template: set[int], by_name: bool = True) -> str:
    out: list[str] = []
    named = False
    for root in roots(tree, template):
        whole = root is tree

        def skip(node):
            nonlocal named
            if id(node) in template or node.is_off(not whole, False):
                return True
            if by_name and node.is_off(not whole):
                named = named or _titled(node)
                return True
            if not whole and node.tag == "header":      # of an article: its headings stay
                for child in node.children:
                    if child.tag in _HEADINGS:
                        blocks(child, lambda _: False, out)
                return True
            return whole and node.tag in ("ul", "ol", "div", "table") and _is_menu(node)

        if not root.is_off(True):
            blocks(root, skip, out)
    if named and not out:       # a name round the title and all of the page tells nothing
        return main_text(tree, template, False)
    return "\n".join(out)


def _titled(node: Node) -> bool:
    work = [node]
    while work:
        n = work.pop()
        if n.tag == "h1":
            return True
        work += n.children
    return False


def _is_menu(node: Node) -> bool:
    return node.all_linked > LINKED * node.all


def extract_group(htmls: list[str | None]) -> list[str]:
    """The main texts of pages of one host."""
    trees, numbers = [parse(h or "") for h in htmls], {}
    depth = max((settle(t, numbers) for t in trees), default=0)
    usual = sys.getrecursionlimit()
    sys.setrecursionlimit(max(usual, usual + 4 * depth))       # trees are aligned from the root down
    try:
        template = template_runs(trees)
    finally:
        sys.setrecursionlimit(usual)
    return [main_text(t, template) for t in trees]


def host_of(url: str):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1)), F.lit(""))


def extract(
    df: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", chunk: int = CHUNK,
) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    pages = df.select(
        F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host_of(url).alias("host")
    )
    sizes = pages.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("html")).alias("bytes"))
    parts = F.greatest(F.ceil(F.col("n") / chunk), F.ceil(F.coalesce("bytes", F.lit(0)) / CHUNK_BYTES))
    large = sizes.select(F.col("host").alias("__large"), parts.alias("__chunks")).where(F.col("__chunks") > 1)
    dealt = pages.join(checked_broadcast(freeze(large)), F.col("host") == F.col("__large"), "left").withColumn(
        "part", F.xxhash64("host", F.pmod(F.xxhash64("page_id", "url"), F.coalesce("__chunks", F.lit(1))))
    ).select("page_id", "url", "html", "part")
    dealt = dealt.repartition("part").sortWithinPartitions("part", "page_id")
    kind = pages.schema["page_id"].dataType
    arrow_kind = to_arrow_type(kind)

    def run(batches):
        for _, group in rows.by_group(batches, "part"):
            texts = extract_group(group.column("html").to_pylist())
            yield rows.batch(
                page_id=pa.array(group.column("page_id").to_pylist(), arrow_kind),
                url=pa.array(group.column("url").to_pylist(), pa.string()),
                text=pa.array(texts, pa.string()), n_chars=pa.array([len(t) for t in texts], pa.int64()),
            )

    return dealt.mapInArrow(run, f"page_id {kind.simpleString()}, url string, text string, n_chars long")
