"""Main text of web pages by composite text density.

A page becomes a DOM by the usual implied-end rules.  Scripts, styles, controls and the like go.  Elements that their
tag, role, class or id calls something else than the article (menus, page headers, footers, sidebars, notices, adverts,
forms, reader comments) are suspects: one goes if enough text is left beside it, and stays if the page has its text there
(`prune`).  So a name is evidence, and the amount of text decides.

Every node left gets its composite text density: characters per tag, adjusted by the share of characters and tags that are
links.  A node's density sum is the sum of its children's densities.  The node with the greatest sum is where the article
is, and the threshold is the least density on the path from the body to it.  Going up that path, a parent is taken whole if
what it adds reaches half the threshold as one; from the first that doesn't, only siblings that reach the threshold by
themselves are added, and headings before the path.  An article element on the path, or else a main element, bounds it.

Inputs that need a rule: a null or empty page has an empty text; a page without tags is its own text; of equal sums the
first in page order wins; repeated rows are pages of their own; null ids and addresses stay null; an empty table gives
an empty result.  Unclosed and mismatched tags end where their enclosing element does; a page may stop anywhere.  Time is
linear in the page, however deep it is nested.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import rename_inputs

# Element and attribute names with a meaning.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
DROPPED = frozenset(
    "script style noscript template iframe noembed noframes xmp head title svg math canvas object embed applet video audio map select option button input textarea datalist "
    "meter progress menuitem".split()
)
#: Elements that say what they are.
ASIDE = frozenset("nav footer aside menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist tooltip status".split())
COMMENTS = frozenset("comment comments commentlist disqus respond replies".split())
NAMES = COMMENTS | frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox adslot adunit banner banners promo promos promotion sponsor sponsored sponsors cookie cookies consent gdpr "
    "notice notices notification alert sidebar sidebars aside nav navi navbar navigation menu menus topnav subnav breadcrumb breadcrumbs crumbs footer footers header headers "
    "masthead topbar reply related recommended recommendations share sharing social newsletter subscribe subscription signup "
    "login popup modal overlay widget widgets pagination pager toolbar skip skiplink search copyright disclaimer form".split()
)
#: Names of the article itself.
OWN = frozenset("post entry article story content main".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()
)
#: A start tag of the key ends an open element of these, up to one of the bounds.
ENDS = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())),
    "dt": (frozenset("dt dd".split()), frozenset(["dl"])),
    "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
    "tr": (frozenset("tr td th".split()), frozenset(["table"])),
    "td": (frozenset("td th".split()), frozenset("tr table".split())),
    "th": (frozenset("td th".split()), frozenset("tr table".split())),
    "tbody": (frozenset("thead tbody tfoot tr td th caption".split()), frozenset(["table"])),
    "thead": (frozenset("thead tbody tfoot tr td th caption".split()), frozenset(["table"])),
    "tfoot": (frozenset("thead tbody tfoot tr td th caption".split()), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset("select datalist".split())),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXTUAL = frozenset("p blockquote pre dd figcaption".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PART = re.compile(r"[a-z]+[0-9]*|[0-9]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_P, _P_BOUNDS = frozenset(["p"]), frozenset("table td th caption button object li".split())
#: Of these only the nearest open one ends, of rows and cells all.
_ONE = frozenset("p li option".split())

#: A suspect goes if the text beside it is at least this share of its own.
BESIDE_PART, BESIDE_NAME, BESIDE_SURE = 0.25, 0.1, 0.03
#: A suspect of the surest kind with less text than this goes in any case.
SHORT = 200


#: What a parent adds on the path is taken if its density is at least this share of the threshold; within an article or
#: main element less will do.
ADDED, ADDED_INSIDE = 0.5, 0.05


class Node:
    __slots__ = ("name", "attrs", "kids", "up", "chars", "tags", "link_chars", "link_tags", "density", "total", "prose", "plain", "beside", "head")

    def __init__(self, name: str, attrs: str = "", up: Node | None = None):
        self.name, self.attrs, self.up, self.kids = name, attrs, up, []
        self.chars = self.tags = self.link_chars = self.link_tags = self.prose = self.plain = 0
        self.density = self.total = 0.0
        self.beside: float | None = None
        self.head = False


class _Open:
    """The open elements: the path to the current one, and the depths at which each name is open."""

    def __init__(self, root: Node):
        self.path, self.depths = [root], {}

    def push(self, node: Node) -> None:
        self.depths.setdefault(node.name, []).append(len(self.path))
        self.path.append(node)

    def cut(self, depth: int) -> None:
        """Ends what is open from this depth on."""
        while len(self.path) > depth:
            self.depths[self.path.pop().name].pop()

    def nearest(self, names) -> int:
        """The depth of the nearest open element of these; 0 if there is none."""
        return max((self.depths[n][-1] for n in names if self.depths.get(n)), default=0)

    def end(self, ended: frozenset, bounds: frozenset) -> None:
        """Ends the nearest open element of these within the bounds, or the outermost such."""
        bound, at = self.nearest(bounds), self.nearest(ended)
        while at > bound:
            self.cut(at)
            if ended & _ONE:
                return
            at = self.nearest(ended)

    def close(self, name: str) -> None:
        """An end tag ends the nearest open element of its name; not out of a table, and an inline one not out of its block."""
        at = self.depths.get(name)
        if not at:
            return
        if name != "table" and self.nearest(("table",)) > at[-1]:
            return
        if name in INLINE and any(self.path[i].name not in INLINE for i in range(at[-1], len(self.path))):
            return
        self.cut(at[-1])


def parse(html: str) -> Node:
    """The page's tree; a child is a Node or a piece of text with its character references decoded."""
    root = Node("#root")
    opened = _Open(root)
    place, size, low = 0, len(html), None
    for m in iter(lambda: _TOKEN.search(html, place), None):
        if m.start() > place:
            opened.path[-1].kids.append(unescape(html[place : m.start()]))
        place = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name, attrs = name.lower(), m[3] or m[6] or ""
        if m[1] or m[4]:
            opened.close(name)
            continue
        if name in CLOSES_P:
            opened.end(_P, _P_BOUNDS)
        if name in ENDS:
            opened.end(*ENDS[name])
        if name in HEADINGS and opened.path[-1].name in HEADINGS:
            opened.cut(len(opened.path) - 1)
        node = Node(name, attrs, opened.path[-1])
        node.up.kids.append(node)
        if name in RAW and not attrs.endswith("/"):
            low = low or html.lower()
            if len(low) != size:  # a few capitals have longer small forms
                low = re.sub("[A-Z]+", lambda x: x[0].lower(), html)
            end = low.find(f"</{name}", place)
            place = size if end < 0 else end
        elif name not in VOID and not (attrs.endswith("/") and name not in CLOSES_P and name not in INLINE):
            opened.push(node)
    if place < size:
        opened.path[-1].kids.append(unescape(html[place:]))
    return root


def attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), unescape(next((x for x in m.groups()[1:] if x is not None), "")))
    return out


#: Before a name, these say what an element is like, not what it is.
_LIKE = frozenset("has with no without is".split())
_HEADS = frozenset("header headers masthead".split())


def _parts(name: str) -> list[str]:
    return [x.rstrip("0123456789") for x in _PART.findall(_CAMEL.sub(" ", name).lower())]


def suspicion(node: Node, in_article: bool) -> tuple[float | None, bool]:
    """How much text beside the node, as a share of its own, tells that it isn't the article (None: it is no suspect), and
    whether it may be a header of the article's own, of which the headings stay."""
    if node.name in ASIDE:
        return BESIDE_SURE, False
    if node.name in ("header", "form"):
        return BESIDE_PART, in_article and node.name == "header"
    if not node.attrs or node.name in ("html", "body", "main") or in_article and node.name in HEADINGS:
        return None, False
    a = attributes(node.attrs)
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", "").lower()):
        return BESIDE_NAME, False
    if a.get("role", "").lower() in ROLES:
        return BESIDE_NAME, False
    tokens = [_parts(x) for x in f"{a.get('class', '')} {a.get('id', '')}".split()]
    found = {p for t in tokens for last, p in zip([None, *t], t, strict=False) if p in NAMES and last not in _LIKE}
    if not found:
        return None, False
    own = any(not OWN.isdisjoint(t) for t in tokens)
    whole = {t[0] for t in tokens if len(t) == 1}
    if (in_article or own) and found <= _HEADS or not whole & found or whole & OWN:
        return BESIDE_PART, (in_article or own) and found <= _HEADS
    return (BESIDE_SURE if whole & COMMENTS else BESIDE_NAME), False


def _without_controls(root: Node) -> list[Node]:
    """Takes out what never has a page's text, and marks the suspects; the nodes in page order."""
    out, todo = [], [(root, False)]
    while todo:
        node, inside = todo.pop()
        out.append(node)
        node.kids = [k for k in node.kids if isinstance(k, str) or k.name not in DROPPED]
        for kid in reversed(node.kids):
            if not isinstance(kid, str):
                kid.beside, kid.head = suspicion(kid, inside)
                todo.append((kid, inside or kid.name in ("article", "main")))
    return out


def _headings_only(head: Node) -> None:
    todo, found = list(reversed(head.kids)), []
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            continue
        if node.name in HEADINGS:
            node.up = head
            found.append(node)
        else:
            todo.extend(reversed(node.kids))
    head.kids = found


def prune(root: Node) -> None:
    """Takes out the suspects that leave enough text beside them.

    Text in links doesn't count.  Begun with the text that is in no suspect, and with the suspect of most text: if the text
    so far is less than the share that tells, the page has its text there; it stays, and the suspects within it are looked
    at in their turn.
    """
    nodes = _without_controls(root)
    inner: dict[Node, list[Node]] = {}
    for node in reversed(nodes):
        suspects: list[Node] = []
        for kid in node.kids:
            if isinstance(kid, str):
                n = len("".join(kid.split()))
                node.prose, node.plain = node.prose + n, node.plain + n
                continue
            below = inner.get(kid, [])
            if kid.name != "a":
                node.prose += kid.prose
                node.plain += 0 if kid.beside is not None else kid.plain
            if kid.beside is not None:
                suspects.append(kid)
            elif below:
                del inner[kid]
                if len(below) > len(suspects):
                    suspects, below = below, suspects
                suspects.extend(below)
        if suspects:
            inner[node] = suspects
    order = {n: i for i, n in enumerate(nodes) if n.beside is not None}
    heap = [(-n.prose, order[n], n) for n in inner.get(root, [])]
    heapify(heap)
    beside, gone = root.plain, set()
    while heap:
        *_, n = heappop(heap)
        if beside < n.beside * n.prose and (n.beside > BESIDE_SURE or n.prose >= SHORT):
            beside += n.plain
            for kid in inner.get(n, []):
                heappush(heap, (-kid.prose, order[kid], kid))
        else:
            gone.add(n)
    for n in gone:
        if n.head:
            _headings_only(n)
        else:
            n.name = "#gone"
    for parent in {n.up for n in gone}:
        parent.kids = [k for k in parent.kids if isinstance(k, str) or k.name != "#gone"]


def _order(root: Node) -> list[Node]:
    """All nodes in page order."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(k for k in reversed(node.kids) if not isinstance(k, str))
    return out


def measure(body: Node) -> list[Node]:
    """Fills in every node's counts, density and density sum; the nodes in page order."""
    nodes = _order(body)
    for node in reversed(nodes):
        link = node.name == "a"
        for kid in node.kids:
            if isinstance(kid, str):
                node.chars += len("".join(kid.split()))
            else:
                node.chars += kid.chars
                node.tags += kid.tags + 1
                node.link_chars += kid.chars if kid.name == "a" else kid.link_chars
                node.link_tags += kid.link_tags + (kid.name == "a")
        if link:
            node.link_chars = node.chars
    share = body.link_chars / max(1, body.chars)
    for node in nodes:
        node.density = density(node, share)
    for node in nodes:
        node.total = sum(k.density for k in node.kids if not isinstance(k, str))
    return nodes


def density(node: Node, link_share: float) -> float:
    """Characters per tag times a logarithm that falls as links take characters and tags.  link_share: of the body.

    With no link in node or body the logarithm's base is 1, where the measure is characters per tag alone.
    """
    c, t, lc, lt = node.chars, max(1, node.tags), node.link_chars, node.link_tags
    if not c:
        return 0.0
    if not lc and not link_share:
        return c / t
    base = log(c * lc / max(1, c - lc) + link_share * c + e)
    return c / t * log(max(1.0, c / max(1, lc) * t / max(1, lt))) / max(log(base), 0.1)


def _rest(parent: Node, child: Node, share: float) -> float:
    """The density of what the parent has beside the child; without characters, infinite: it adds nothing."""
    rest = Node("#rest")
    rest.chars, rest.tags = parent.chars - child.chars, parent.tags - child.tags - 1
    linked = child.name == "a"
    rest.link_chars = parent.link_chars - (child.chars if linked else child.link_chars)
    rest.link_tags = parent.link_tags - child.link_tags - linked
    return density(rest, share) if rest.chars else float("inf")


def _alike(a: Node, b: Node) -> bool:
    """Blocks of text of one kind, as paragraphs beside a paragraph are."""
    return a.name == b.name and a.attrs == b.attrs and (a.name in TEXTUAL or bool(a.attrs))


def select(body: Node) -> list[Node]:
    """The subtrees that make up the article, in page order."""
    nodes = measure(body)
    best = max(nodes, key=lambda n: n.total)  # the first of equals
    if not best.total:
        return [body]
    path = [best]
    while path[-1] is not body:
        path.append(path[-1].up)
    threshold = min(n.density for n in path)
    bound = next((n for name in ("article", "main") for n in path if n.name == name), body)
    share = body.link_chars / max(1, body.chars)
    taken, whole = [best], True
    for child, parent in zip(path, path[1:], strict=False):
        if child is bound:
            break
        if whole and _rest(parent, child, share) >= threshold * (ADDED if bound is body else ADDED_INSIDE):
            taken = [parent]
            continue
        whole, before = False, True
        for kid in parent.kids:
            if kid is child:
                before = False
            elif not isinstance(kid, str) and kid.chars and 2 * kid.link_chars < kid.chars and (kid.density >= threshold or before and kid.name in HEADINGS or _alike(kid, child)):
                taken.append(kid)
    ids = {id(n) for n in taken}
    return [n for n in nodes if id(n) in ids]


def blocks(node: Node) -> Iterator[str]:
    """The texts of the subtree's blocks, white space made one space; br is white space."""
    piece: list[str] = []

    def cut() -> Iterator[str]:
        text = " ".join("".join(piece).split())
        piece.clear()
        if text:
            yield text

    todo: list[Node | str | None] = [node]
    while todo:
        x = todo.pop()
        if x is None:
            yield from cut()
        elif isinstance(x, str):
            piece.append(x)
        elif x.name in ("br", "wbr"):
            piece.append(" " * (x.name == "br"))
        elif x.name in INLINE:
            todo.extend(reversed(x.kids))
        else:
            yield from cut()
            todo.append(None)
            todo.extend(reversed(x.kids))
    yield from cut()


def main_text(html: str) -> str:
    root = parse(html)
    prune(root)
    body = next((n for n in _order(root) if n.name == "body"), root)
    return "\n\n".join(b for n in select(body) for b in blocks(n))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py() or "") for x in batch["html"]]
            yield pa.record_batch([batch["page_id"].cast(pa.int64()), batch["url"].cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], schema=schema)

    return rename_inputs(pages, page_id=page_id, url=url, html=html).mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
