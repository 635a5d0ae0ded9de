"""HTML extraction by composite text density.

A page becomes a tree in arrays. Parts that are never article text go first: scripts, styles and other raw or
hidden elements, forms, menus, headers, footers, sidebars, notices, adverts and reader comments, told by
element, role or class. Class and id say nothing about headings, outer articles and elements that hold the page's
landmarks or most of its text, and ids within landmarks are anchors; the same holds for a form around the page. A header
or banner of an article that holds a heading stays, as do a section of discussion made of paragraphs, the footer of a
quotation and labels without a field. Like-shaped siblings that each bear an author and a time are a thread of comments,
whatever its name. On the rest every node gets a density: characters per tag, adjusted for the share of
characters and tags in links and scaled by the body's own share of links. A node's density sum adds its
children's densities. The node of the largest sum is the core. Landmarks (article, main) on the path from the body to the
core count whole. Without one, the nearest div or section around the core counts whole but for blocks that are mostly
links, and so do plain blocks of the containers around it up to the first that holds parts of the page's layout. Farther out, blocks that aren't mostly links count if they are headings, paragraphs, lists, tables or the like, if
they hold a heading, or if they are as dense as the core; beside a landmark they must also reach the least density on
the path, unless they are landmarks themselves.

The text is that of the chosen subtrees in page order: character references decoded, white space within a block one
space, blocks joined by one space. Null or empty pages, and pages without text, give an empty text. Tags may be
unclosed, misnested or cut off at the end, those of head and body left out; what follows the body belongs to it. Every step is linear in the page.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import passes

TAG = re.compile(r"<!--|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
DROPPED = RAW | {"head", "nav", "footer", "aside", "button", "select", "datalist", "noscript", "template", "svg", "canvas", "object", "audio", "video", "dialog", "menu", "map", "input"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
ENDS_P = {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
#: What an element closes when it opens, up to the element that holds such ones.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: The last word of a class or id that marks a part which isn't article text.
BOILERPLATE = re.compile(
    r"(?:nav|navbar|navigation|menu|menus|breadcrumbs?|header|masthead|topbar|toolbar|footer|footnav|colophon|sidebars?|aside|widgets?|ads?|adv|advert|adverts|advertisement|advertising|adbox|adsense|banner|sponsor|sponsors|sponsored|promo|promos|promotion|cookies?|consent|gdpr|"
    r"notices?|notifications?|alerts?|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|social|share|sharing|sharebar|related|recommended|recommendations|comments?|commentlist|commentform|respond|discussion|disqus|replies|reply|threads?|search|searchbox|forms?|copyright|disclaimer|pagination|pager|skip|hidden)[0-9]*\Z"
)
#: The first word that marks one whatever follows it.
BOILERPLATE_FIRST = re.compile(r"(?:nav|navbar|navigation|menu|breadcrumbs?|footer|sidebars?|ads?|advert[a-z]*|sponsor[a-z]*|promo|cookies?|consent|gdpr|popup|modal|newsletter|subscribe|related|recommended|comments?|disqus)\Z")
#: Words after such a first word that tell of the layout: of a state, then nothing is marked, or of a side.
STATES = {"open", "opened", "closed", "enabled", "disabled", "layout", "on", "off", "active", "inactive"}
SIDES = {"left", "right", "top", "bottom"}
#: Marks of readers' comments, which may well be longer than the article.
READERS = re.compile(r"(?:comment|discussion|disqus|repl|respond|threads?\Z)", re.I)
#: What names can say of a node: nothing, an article's header, a discussion, layout or boilerplate, boilerplate, readers' comments.
NOT_NAMED, HEADED, DISCUSSED, SIDE, NAMED, READER = range(6)
#: First words of an article's own headers.
OWN = {"article", "blog", "chapter", "content", "entry", "hero", "news", "page", "post", "section", "story", "title"}
FIELDS = {"input", "select", "textarea", "button"}
#: Words of a class or of rel and itemprop that name an author, or tell when something was written.
AUTHORS = {"author", "avatar", "commenter", "fn", "nick", "nickname", "poster", "user", "username", "vcard"}
WHEN = {"ago", "date", "datetime", "published", "time", "timestamp"}
BY, AT = 1, 2
#: What a heading over readers' comments says.
ABOUT_READERS = re.compile(r"comment|repl(?:y|ies)|respon[ds]|what others|your thoughts|join", re.I)
#: Shares of the body's characters outside links that an element with the page's h1, or any, needs to be no boilerplate.
HALF, MOST = 0.5, 0.9
BOILERPLATE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
LANDMARKS = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
FLOW = {"p", "ul", "ol", "dl", "table", "figure", "blockquote", "pre", *INLINE}
ROWS = {"li", "dt", "dd", "tr", "thead", "tbody", "tfoot", "caption"}
#: What doesn't end the head or begin the body.
HEAD = {"html", "head", "body", "title", "meta", "link", "base", "script", "style", "noscript", "template"}
CONTAINERS = {"div", "section"}
#: The share of link characters beyond which a block is mostly links.
LINKS = 0.5
NAME_PART = re.compile(r"[a-z]+|[A-Z][a-z]*|[0-9]+")


def _boilerplate_name(names: str, within: bool) -> int:
    """What the words of a class or id say; within: inside a landmark."""
    found = NOT_NAMED
    for name in names.split():
        parts = [p for p in NAME_PART.findall(name)]
        if not parts or parts[0].lower() in ("with", "has", "no", "without"):
            continue
        if parts[-1].isdigit() and len(parts) > 1:
            parts.pop()
        first, last = parts[0].lower(), parts[-1].lower()
        if BOILERPLATE.match(last) or BOILERPLATE.match(name.lower()):
            if last in ("header", "banner") and (within or first in OWN) and not BOILERPLATE_FIRST.match(first):
                kind = HEADED
            elif last == "discussion" and first not in ("comment", "comments"):
                kind = DISCUSSED
            else:
                kind = READER if READERS.match(last) or READERS.match(name) else NAMED
            found = max(found, kind)
        elif BOILERPLATE_FIRST.match(first) and last not in STATES:
            found = max(found, READER if READERS.match(first) else SIDE if last in SIDES else NAMED)
    return found


class Tree:
    """Nodes in page order: parent, name, whether dropped, what class and id say, marks of author and time; texts as (node, decoded text), breaks as (node, None)."""

    def __init__(self, page: str) -> None:
        self.parent, self.name, self.dropped, self.named = [-1], ["#root"], [False], [NOT_NAMED]
        self.signs, self.plain = [0], [True]
        self.pieces: list[tuple[int, str | None]] = []
        self._stack: list[int] = [0]
        self._open: dict[str, list[int]] = {}  # places in the stack of the open elements of a name
        self._read(page)

    def _push(self, name: str, attributes: str) -> None:
        up = self._stack[-1]
        self.parent.append(up)
        self.name.append(name)
        self.signs.append(AT if name == "time" else 0)
        self.plain.append(not attributes.strip(" \t\n\r\f/"))
        drops, named = self._marks(name, attributes)
        self.dropped.append(drops)
        self.named.append(named)
        if name not in INLINE:
            self.pieces.append((up, None))
        if name not in VOID:
            self._stack.append(len(self.name) - 1)
            self._open.setdefault(name, []).append(len(self._stack) - 1)

    def _marks(self, name: str, attributes: str) -> tuple[bool, int]:
        """Whether the element drops whatever it holds, and what its class and id say."""
        quoted = name == "footer" and self._nearest({"blockquote"}) > self._nearest(LANDMARKS)
        if name in DROPPED and not quoted:
            return True, NOT_NAMED
        within = any(self._open.get(x) for x in LANDMARKS)
        if name == "header":
            return not within, NOT_NAMED
        own = NAMED if name == "form" else NOT_NAMED
        if name in ("html", "body", "main") or not attributes or attributes.isspace():
            return False, own
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
        if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I):
            return True, NOT_NAMED
        if found.get("role", "").lower() in BOILERPLATE_ROLES:
            return True, NOT_NAMED
        if name in HEADINGS or name == "label":
            return name == "label" and "for" in found, NOT_NAMED
        words = {w.lower() for k in ("class", "rel", "itemprop") if k in found for w in NAME_PART.findall(found[k])}
        self.signs[-1] |= (BY if words & AUTHORS else 0) | (AT if words & WHEN else 0)
        return False, max(own, *(_boilerplate_name(found[k], within) if k in found else NOT_NAMED for k in (("class",) if within else ("class", "id"))))

    def _nearest(self, names: set[str]) -> int:
        """The place in the stack of the nearest open element of these names, or 0."""
        return max((self._open[n][-1] for n in names if self._open.get(n)), default=0)

    def _pop_to(self, names: set[str], stops: set[str]) -> None:
        """Closes the nearest open element of these names, unless a stop is nearer."""
        k = self._nearest(names)
        if k > self._nearest(stops):
            self._close(k)

    def _close(self, k: int) -> None:
        for node in self._stack[k:]:
            self._open[self.name[node]].pop()
        closed = self._stack[k:]
        del self._stack[k:]
        if any(self.name[n] not in INLINE for n in closed):
            self.pieces.append((self._stack[-1], None))

    def _content(self) -> None:
        """Ends an open head and begins the body where content stands outside of both."""
        if self.name[self._stack[-1]] == "head":
            self._close(len(self._stack) - 1)
        if self.name[self._stack[-1]] in ("#root", "html") and not self._open.get("body"):
            self._push("body", "")

    def _text(self, text: str) -> None:
        if text and not text.isspace():
            self._content()
        self.pieces.append((self._stack[-1], html.unescape(text)))

    def _read(self, page: str) -> None:
        at, last = 0, page.rfind(">") + 1  # no tag ends after it, so none is looked for
        while m := TAG.search(page, at, last):
            if m.start() > at:
                self._text(page[at : m.start()])
            at = m.end()
            closing, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not name:
                if m[0] == "<!--":
                    end = page.find("-->", at)
                    at = end + 3 if end >= 0 else len(page)
                continue
            name = name.lower()
            if closing:
                if name in ("body", "html") and self._open.get("body"):  # what follows is put into the body
                    self._close(self._open["body"][0] + 1)
                    self.pieces.append((self._stack[-1], None))
                elif self._open.get(name):
                    self._close(self._open[name][-1])
                elif name in ("p", "br"):
                    self.pieces.append((self._stack[-1], None))
                continue
            if name in ENDS_P:
                self._pop_to({"p"}, {"td", "th", "button", "caption", "object"})
            if name in SIBLINGS:
                self._pop_to(*SIBLINGS[name])
            if name == "body" or (name == "article" and self._open.get("head")):
                self._pop_to({"head"}, set())
            if name == "body" and self._open.get("body"):
                continue
            if name not in HEAD:
                self._content()
            self._push(name, attributes)
            if name in RAW and not attributes.endswith("/"):
                end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
                at = end.start() if end else len(page)
        if at < len(page):
            rest = page[at:]
            if cut := re.search(r"<[/!a-zA-Z][^>]*\Z", rest):  # a tag that the page's end cuts off
                rest = rest[: cut.start()]
            self._text(rest)


def _dropped(tree: Tree) -> list[bool]:
    """Which nodes drop what they hold: by element, by name, labels of fields, threads of comments."""
    n, parent = len(tree.parent), tree.parent
    gone = list(tree.dropped)
    fields = [name in FIELDS for name in tree.name]
    for i in range(n - 1, 0, -1):
        fields[parent[i]] = fields[parent[i]] or fields[i]
    for i in range(1, n):
        if tree.name[i] == "label" and (fields[i] or _beside_field(tree, fields, i)):
            gone[i] = True
    if any(tree.named):
        gone = _named_dropped(tree, gone, fields)
    if any(sign & BY for sign in tree.signs):
        gone = _without_threads(tree, gone)
    return gone


def _beside_field(tree: Tree, fields: list[bool], label: int) -> bool:
    """Whether the label stands beside a field, in a block that isn't a form around the page."""
    up = tree.parent[label]
    return fields[up] and tree.name[up] not in ("form", "body", *LANDMARKS)


def _inherited(tree: Tree, gone: list[bool]) -> tuple[list[bool], list[int], list[int]]:
    """Per node: whether an ancestor or itself is gone, its characters outside links and those in links."""
    n, parent = len(tree.parent), tree.parent
    out, linked, plain, links = list(gone), [name == "a" for name in tree.name], [0] * n, [0] * n
    for i in range(1, n):
        out[i] = out[i] or out[parent[i]]
        linked[i] = linked[i] or linked[parent[i]]
    for node, text in tree.pieces:
        if text and not out[node]:
            (links if linked[node] else plain)[node] += len("".join(text.split()))
    for i in range(n - 1, 0, -1):
        plain[parent[i]] += plain[i]
        links[parent[i]] += links[i]
    return out, plain, links


def _named_dropped(tree: Tree, dropped: list[bool], fields: list[bool]) -> list[bool]:
    """Adds the nodes that their names mark, unless something excuses them."""
    n, parent = len(tree.parent), tree.parent
    gone, plain, links = _inherited(tree, dropped)
    within, nested = [False] * n, [False] * n
    for i in range(1, n):
        up = parent[i]
        within[i] = within[up] or tree.name[up] in LANDMARKS
        nested[i] = nested[up] or tree.name[up] == "article"  # as readers' comments are
    h1, articles, mains, headings, readers, paragraphs, about = ([0] * n for _ in range(7))
    for node, text in tree.pieces:
        if text and not gone[node] and tree.name[node] in HEADINGS and ABOUT_READERS.search(text):
            about[node] = 1
    for i in range(n - 1, 0, -1):
        up = parent[i]
        if not gone[i]:
            h1[i] += tree.name[i] == "h1"
            headings[i] += tree.name[i] in HEADINGS
            readers[i] += tree.named[i] == READER
            articles[i] += tree.name[i] == "article" and not nested[i] and not tree.named[i]
            mains[i] += tree.name[i] == "main"
            if tree.name[i] == "p":
                paragraphs[up] += plain[i]
        for sums in (h1, articles, mains, headings, readers, about):
            sums[up] += sums[i]
    landmarks = articles if articles[0] else mains

    def excused(i: int) -> bool:
        kind = tree.named[i]
        if tree.name[i] == "article" and not nested[i]:
            return True
        if headings[i] and not fields[i] and links[i] <= LINKS * (plain[i] + links[i]) and (within[i] or not landmarks[0]):
            if kind == HEADED:
                return True
            if kind == DISCUSSED and not readers[i] and not about[i] and paragraphs[i] > HALF * plain[i]:
                return True
        share, reader = plain[i] / max(plain[0], 1), kind in (READER, DISCUSSED)
        holds = 0 < landmarks[0] == landmarks[i]
        if holds and (not reader or share > HALF):
            return True
        if landmarks[0] and not holds and not within[i]:
            return False
        return share > HALF and (h1[i] > 0 or kind == SIDE) or share > MOST and (not reader or share == 1)

    return [drop or named and not excused(i) for i, (drop, named) in enumerate(zip(dropped, tree.named, strict=True))]


def _without_threads(tree: Tree, dropped: list[bool]) -> list[bool]:
    """Adds the parents of like-shaped siblings that bear an author and a time, with a heading about comments before them.

    Within an article they are always a thread; elsewhere only after paragraphs longer than one of them, so that lists of
    articles stay.
    """
    n, parent = len(tree.parent), tree.parent
    gone, plain, _ = _inherited(tree, dropped)
    nested, before, signs, h1 = [False] * n, [0] * n, list(tree.signs), [name == "h1" for name in tree.name]
    paragraphs, inside = 0, [False] * n
    for i in range(1, n):
        nested[i] = nested[parent[i]] or tree.name[parent[i]] == "article"
        inside[i] = inside[parent[i]] or tree.name[parent[i]] == "p"
        before[i] = paragraphs
        if tree.name[i] == "p" and not gone[i] and not inside[i]:
            paragraphs += plain[i]
    for i in range(n - 1, 0, -1):
        signs[parent[i]] |= signs[i]
        h1[parent[i]] = h1[parent[i]] or h1[i]
    alike: dict[tuple[int, str], list[int]] = {}
    for i in range(1, n):
        if signs[i] == BY | AT and not gone[i] and tree.name[i] in ("li", "article", "div", "section"):
            alike.setdefault((parent[i], tree.name[i]), []).append(i)
    out, last = list(dropped), [0] * n
    for (up, _), these in alike.items():
        signed = sum(plain[i] for i in these)
        if len(these) > 1 and not h1[up] and signed > HALF * plain[up] and (nested[up] or before[up] * len(these) > signed):
            out[up] = True
    about = {node for node, text in tree.pieces if text and tree.name[node] in HEADINGS and ABOUT_READERS.search(text)}
    for i in range(1, n):
        up = parent[i]
        if out[i] and not dropped[i] and last[up] in about:
            out[last[up]] = True
        if tree.name[i] not in INLINE:
            last[up] = i
    return out


@dataclass
class Measures:
    """Per node: whether it is dropped, its characters and those in links, loose ones (its own text and inline parts), whether it holds a heading, density and density sum."""

    gone: list[bool]
    chars: list[int]
    link_chars: list[int]
    loose: list[int]
    loose_links: list[int]
    holds_heading: list[bool]
    body: int
    density: np.ndarray
    sums: np.ndarray


def measures(tree: Tree) -> Measures:
    """Composite text density of every node: characters per tag, by the logarithm of characters per link character and tags
    per link tag, whose base grows where links outweigh plain text, by the body's own share of links. White space doesn't count."""
    n = len(tree.parent)
    parent = tree.parent
    gone, linked = [bool(d) for d in _dropped(tree)], [name == "a" for name in tree.name]
    for i in range(1, n):
        gone[i] = gone[i] or gone[parent[i]]
        linked[i] = linked[i] or linked[parent[i]]
    chars, link_chars, tags, link_tags = ([0] * n for _ in range(4))
    for node, text in tree.pieces:
        if text and not gone[node]:
            size = len("".join(text.split()))
            chars[node] += size
            if linked[node]:
                link_chars[node] += size
    for i in range(1, n):
        if not gone[i]:
            tags[i] += 1
            link_tags[i] += linked[i]
    loose, loose_links = list(chars), list(link_chars)
    holds_heading = [name in HEADINGS and not g for name, g in zip(tree.name, gone, strict=True)]
    for i in range(n - 1, 0, -1):
        up = parent[i]
        if tree.name[i] in INLINE:
            loose[up] += chars[i]
            loose_links[up] += link_chars[i]
        holds_heading[up] = holds_heading[up] or holds_heading[i]
        chars[up] += chars[i]
        link_chars[up] += link_chars[i]
        tags[up] += tags[i]
        link_tags[up] += link_tags[i]
    body = next((i for i in range(n) if tree.name[i] == "body" and not gone[i]), 0)
    c, lc, t, lt = (np.array(x, float) for x in (chars, link_chars, tags, link_tags))
    t1, lc1, lt1 = np.maximum(t, 1), np.maximum(lc, 1), np.maximum(lt, 1)
    base = np.log(c / np.maximum(c - lc, 1) * lc + lc[body] / max(c[body], 1) * c + np.e)
    density = np.where(c > 0, c / t1 * np.log(np.maximum(c / lc1 * t1 / lt1, 1)) / base, 0.0)
    density[np.array(gone)] = 0
    sums = np.zeros(n)
    np.add.at(sums, np.array(parent[1:], int), density[1:])
    return Measures(gone, chars, link_chars, loose, loose_links, holds_heading, body, density, sums)


def chosen(tree: Tree) -> np.ndarray:
    """Which nodes' own texts belong to the main text."""
    n, parent = len(tree.parent), tree.parent
    found = measures(tree)
    gone, chars, link_chars, body, density, sums = found.gone, found.chars, found.link_chars, found.body, found.density, found.sums
    keep = np.zeros(n, bool)
    inside = [False] * n
    inside[body] = True
    for i in range(body + 1, n):
        inside[i] = inside[parent[i]] and not gone[i]
    if not chars[body]:
        return keep
    able = np.array(inside)
    core = int(np.argmax(np.where(able, sums, -1.0)))
    if sums[core] <= 0:
        core = body
    path = [core]
    while path[-1] != body:
        path.append(parent[path[-1]])
    threshold = float(density[path].min())
    whole = core
    for node in path:
        if tree.name[node] in LANDMARKS:
            whole = node
    landmark = tree.name[whole] in LANDMARKS
    outer = path[path.index(whole) + 1 :]
    above = set(outer)
    container = None if landmark else next((node for node in outer if tree.name[node] in CONTAINERS), None)
    around = set() if container is None else set(outer[: outer.index(container) + 1])
    wider: set[int] = set()
    if container is not None:
        layout = {parent[i] for i in range(1, n) if gone[i] and tree.name[i] not in HEAD | FIELDS or link_chars[i] > LINKS * chars[i] and tree.name[i] not in INLINE}
        for node in outer[outer.index(container) + 1 :]:
            if tree.name[node] not in CONTAINERS or node in layout:
                break
            wider.add(node)
    keep[outer] = True
    keep[whole] = True

    def belongs(i: int) -> bool:
        """Whether a block beside the path is text of the article."""
        name, up = tree.name[i], parent[i]
        if name in HEADINGS:
            return True
        if found.loose_links[up] > LINKS * found.loose[up] if name in INLINE else link_chars[i] > LINKS * chars[i]:
            return False
        if up in around or name in LANDMARKS or up in wider and tree.plain[i]:
            return True
        if landmark and density[i] < threshold:
            return False
        return name in FLOW or name in ROWS or found.holds_heading[i] or density[i] >= density[core]

    for i in range(body + 1, n):
        if inside[i] and not keep[i]:
            keep[i] = belongs(i) if parent[i] in above else keep[parent[i]]
    return keep


def main_text(page: str | None) -> str:
    if not page:
        return ""
    tree = Tree(page)
    keep = chosen(tree)
    return " ".join("".join(" " if text is None else text for node, text in tree.pieces if text is None or keep[node]).split())


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages."""
    kinds = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in passes(batches, "html"):
            texts = [main_text(page) for page in batch.column("html").to_pylist()]
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
