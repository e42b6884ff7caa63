"""HTML to a small element tree, and union-free wrappers inferred from such trees.

A tree node is [name, children, class]; children are nodes and strings, the class is the first word of an element's class
or id without digits. A wrapper item is [label, flags, items, mass, pages] for an element or a group of them, whose label
is its name and class, or ["#", flags, texts, mass, pages] for text: the texts (``constant``) that all pages so far have
there, and SLOT among the flags once they differ in any.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter

OPTIONAL, REPEATED, SLOT = 1, 2, 4
#: Text of deeper elements goes to their parent, blocks apart, and what isn't article stays apart.
DEEPEST = 60
#: Places of one label in a child list that stay apart; with more, all of them are one repeated item.
PLACES = 8

# Element names of HTML by their role here.
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "object", "canvas", "xmp", "noembed"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "label"}
AWAY = {"nav", "header", "footer", "aside", "form", "button", "select", "dialog", "menu", "head", "title", "fieldset"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"html", "body", "article", "main", "section", "div", "table", "ul", "ol", "dl", "td", "th", "blockquote", "nav", "aside", "header", "footer", "form", "figure", "tr", "li", "dd"}
BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "dl", "table", "pre", "blockquote", "figure", "address"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Words in a class, id or role that mark what isn't the article.
AWAY_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "banner", "sidebar", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "footer", "header", "masthead", "cookie", "cookies", "consent", "notice", "notices", "alert", "comment", "comments", "disqus", "respond", "replies", "share", "sharing", "social", "related", "recommended", "newsletter", "subscribe", "signup", "login", "popup", "modal", "widget", "pagination", "pager", "toolbar", "skip", "search", "complementary", "contentinfo", "dialog"}
KEEP_ALWAYS = {"html", "body", "article", "main"}

# A quoted value holds < or >, not both: so no tag is searched beyond the next one, and a page takes time in proportion to its size.
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:"[^"<]*"|"[^">]*"|'[^'<]*'|'[^'>]*'|[^'"<>])*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>""", re.S)
_MARKS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_CLASS = re.compile(r"""\b(?:class|id)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:\s|^)(?:hidden(?=[\s/=]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)


def element_name(tag: str, attributes: str) -> str:
    """The tag, with "!" before it if it isn't part of an article."""
    if tag in AWAY:
        return "!" + tag
    if attributes and tag not in KEEP_ALWAYS:
        words = {w for m in _MARKS.finditer(attributes) for w in re.split("[^a-z]+", (m[1] or m[2] or m[3] or "").lower())}
        if words & AWAY_WORDS or _HIDDEN.search(attributes):
            return "!" + tag
        if tag != "main" and "main" in words and "=" in attributes and re.search(r"role\s*=\s*[\"']?main", attributes, re.I):
            return "main"
    return tag


def class_of(attributes: str) -> str:
    """The first word of the class or id, without digits, so that numbered names are one."""
    for m in _CLASS.finditer(attributes):
        words = (m[1] or m[2] or m[3] or "").split()
        if words:
            return re.sub("[0-9.]+", "", words[0].lower())
    return ""


def label(node: list) -> str:
    """An element's name in a wrapper."""
    return f"{node[0]}.{node[2]}" if node[2] else node[0]


def base(name: str) -> str:
    """The element name in a label."""
    return name.partition(".")[0]


def constant(text: str) -> str:
    """What a wrapper keeps of a text that is the same on all pages so far: itself, or its digest if it is long."""
    return text if len(text) <= 80 else "\0" + hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()


class _Stack:
    """Open elements, with how many of each name are open, below DEEPEST too, so that nothing is searched in vain."""

    def __init__(self, root: list) -> None:
        self.nodes, self.opened, self.deep = [root], Counter(), Counter()

    def push(self, node: list) -> None:
        if len(self.nodes) >= DEEPEST:
            self.deep[node[0]] += 1
            self.deep["!"] += node[0][0] == "!"
        self.nodes.append(node)
        self.opened[node[0].lstrip("!")] += 1

    def own_node(self, name: str) -> bool:
        """Below DEEPEST: what has a role of its own keeps its node, once, so the tree is few levels deeper at most."""
        if name[0] == "!":
            return not self.deep["!"]
        if name in HEADINGS:
            return self.nodes[-1][0] == "!header"
        return name in ("a", "article", "main") and not self.deep[name]

    def leave(self, i: int) -> None:
        """Ends the open elements from the i-th on; a block that has no node of its own ends its text."""
        breaks = False
        while len(self.nodes) > i:
            node = self.nodes.pop()
            self.opened[node[0].lstrip("!")] -= 1
            if len(self.nodes) >= DEEPEST:
                self.deep[node[0]] -= 1
                self.deep["!"] -= node[0][0] == "!"
            breaks |= len(node) > 3 and node[0] not in INLINE
        if breaks:
            self.nodes[-1][1].append(["/", [], ""])

    def close(self, tag: str) -> None:
        """The end of an element, or of none that is open."""
        if self.opened[tag]:
            i = len(self.nodes) - 1
            while i and self.nodes[i][0].lstrip("!") != tag:
                i -= 1
            if i:
                self.leave(i)
                return
        if tag in BLOCKS or tag == "div":
            self.nodes[-1][1].append(["/", [], ""])

    def make_way(self, tag: str) -> None:
        """Ends what the start of this element ends. Above an open p all is inline."""
        shut = CLOSES.get(tag) or ({"p"} if tag not in INLINE else set())
        if not any(self.opened[x] for x in shut):
            return
        for i in range(len(self.nodes) - 1, 0, -1):
            name = self.nodes[i][0].lstrip("!")
            if name in shut:
                self.leave(i)
                return
            if name in SCOPE or "p" in shut and name not in INLINE:
                return


def parse(source: str) -> list:
    """The tree of a page. Elements that are left open end with their parent; strange ends are ignored; raw elements and comments go."""
    root: list = ["html", [], ""]
    stack = _Stack(root)
    at, end, last = 0, len(source), source.rfind(">")
    while at < end:
        m = _TAG.search(source, at) if at <= last or source.find("<!--", at) >= 0 else None
        text = source[at : m.start()] if m else source[at:]
        if text:
            stack.nodes[-1][1].append(html.unescape(text))
        if not m:
            break
        at = m.end()
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag == "html":
            continue
        if closing:
            stack.close(tag)
            continue
        if tag in RAW:
            if not attributes.endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
                at = close.end() if close else end
            continue
        here = stack.nodes[-1][1]
        if tag in VOID:
            here.append("\n" if tag in ("br", "wbr") else ["/", [], ""] if tag == "hr" else " ")
            continue
        stack.make_way(tag)
        here = stack.nodes[-1][1]
        name = element_name(tag, attributes)
        node = [name, [], class_of(attributes) if attributes else ""]
        if len(stack.nodes) > DEEPEST and not stack.own_node(name):
            node = [name, here, "", True]  # the parent's children: no node of its own
            if name not in INLINE:
                here.append(["/", [], ""])
        else:
            here.append(node)
        if not attributes.endswith("/") or tag not in INLINE:
            stack.push(node)
    return root


def mass(node: list) -> int:
    """Characters of text that may be part of an article; links count a quarter."""
    total = 0
    for child in node[1]:
        if isinstance(child, str):
            total += len(child.strip())
        elif child[0][0] != "!":
            total += mass(child) // 4 if child[0] == "a" else mass(child)
    return total


def block_texts(node: list) -> list[tuple[str, list]]:
    """(text, path) of each block in page order: white space as one blank, trimmed, no empty ones. The path holds the names down to it."""
    out: list[tuple[str, list]] = []
    parts: list[str] = []

    def flush(path: list) -> None:
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            out.append((text, list(path)))

    def walk(current: list, path: list) -> None:
        for child in current[1]:
            if isinstance(child, str):
                parts.append(child)
            elif child[0] in INLINE:
                walk(child, path)
            elif child[0][0] == "!":
                flush(path)
                if child[0] == "!header":  # of the article: its headings stay
                    for inner in child[1]:
                        if not isinstance(inner, str) and inner[0] in HEADINGS:
                            walk(inner, [*path, inner[0]])
                            flush([*path, inner[0]])
            else:
                flush(path)
                inner_path = [*path, child[0]]
                walk(child, inner_path)
                flush(inner_path)

    walk(node, [])
    flush([])
    return out


def items_of(node: list) -> list:
    """Wrapper items of a node's children, repeats folded; inline elements are part of the text around them."""
    out: list = []
    text: list[str] = []

    def put_text() -> None:
        joined = " ".join("".join(text).split())
        text.clear()
        if joined:
            out.append(["#", 0, [constant(joined)], len(joined), 1])

    def inline(current: list) -> None:
        for child in current[1]:
            if isinstance(child, str):
                text.append(child)
            elif child[0] in INLINE:
                inline(child)
            else:
                put_text()
                items = items_of(child)
                out.append([label(child), 0, items, sum(i[3] for i in items) if child[0][0] != "!" else 0, 1])

    inline(node)
    put_text()
    return fold(out)


def merge_item(a: list, b: list, same_page: bool = False) -> list:
    """Two items of one name as one: text that differs becomes a slot, children are aligned."""
    flags, total = a[1] | b[1], a[3] + b[3]
    pages = max(a[4], b[4]) if same_page else a[4] + b[4]
    if a[0] == "#":
        own, other = set(a[2]), set(b[2])
        if same_page:
            return ["#", flags, sorted(own | other), total, pages]
        return ["#", flags | (SLOT if own != other else 0), sorted(own & other), total, pages]
    return [a[0], flags, align(a[2], b[2], same_page), total, pages]


def shape(item: list) -> frozenset[str]:
    """Labels of an item's children."""
    return frozenset(x[0] for x in item[2] if x[0] != "#") if item[0] != "#" else frozenset()


def alike(a: frozenset[str], b: frozenset[str]) -> float:
    """How well two elements of one label fit each other, from 1 to 2: by the share of child labels that both have."""
    return 1 + (len(a & b) / len(a | b) if a or b else 1)


def fold(items: list) -> list:
    """Neighbours of one label and the same child labels become one repeated item, and neighbouring equal groups of two or three a repeated group."""
    out: list = []
    for item in items:
        if out and out[-1][0] == item[0] and shape(out[-1]) == shape(item):
            out[-1] = merge_item(out[-1], item, True)
            out[-1][1] |= REPEATED
        else:
            out.append(item)
    for size in (2, 3):
        i = 0
        while i + 2 * size <= len(out):
            names = [x[0] for x in out[i : i + size]]
            if names == [x[0] for x in out[i + size : i + 2 * size]]:
                merged = [merge_item(x, y, True) for x, y in zip(out[i : i + size], out[i + size : i + 2 * size], strict=True)]
                for x in merged:
                    x[1] |= REPEATED
                out[i : i + 2 * size] = merged
            else:
                i += 1
    often = {k for k, n in Counter(x[0] for x in out).items() if n > PLACES}
    if often:
        first: dict[str, list] = {}
        rest = []
        for item in out:
            if item[0] not in often:
                rest.append(item)
            elif item[0] in first:
                kept = first[item[0]]
                kept[:] = merge_item(kept, item, True)
                kept[1] |= REPEATED | OPTIONAL
            else:
                first[item[0]] = item
                rest.append(item)
        out = rest
    return out


def matched(left: list[tuple[str, frozenset[str]]], right: list[tuple[str, frozenset[str]]], repeated: list[bool] | None = None) -> list[int]:
    """For each of the left, in order, its partner on the right or -1, such that they fit best together; a repeated one of the right may have several."""
    n, m = len(left), len(right)
    best = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        name, own = left[i]
        row, below = best[i], best[i + 1]
        for j in range(m - 1, -1, -1):
            most = below[j] if below[j] > row[j + 1] else row[j + 1]
            if right[j][0] == name:
                both = alike(own, right[j][1]) + below[j if repeated and repeated[j] else j + 1]
                if both > most:
                    most = both
            row[j] = most
    out, j = [-1] * n, 0
    for i in range(n):
        while j < m and best[i][j] == best[i][j + 1]:
            j += 1
        if j < m and best[i][j] > best[i + 1][j]:
            out[i] = j
            j += not (repeated and repeated[j])
    return out


def align(a: list, b: list, same_page: bool = False) -> list:
    """Items of one label that fit best, in order, are merged; what only one side has becomes optional."""
    if [x[0] for x in a] == [x[0] for x in b]:
        return [merge_item(x, y, same_page) for x, y in zip(a, b, strict=True)]
    out, j = [], 0
    for x, partner in zip(a, matched([(x[0], shape(x)) for x in a], [(y[0], shape(y)) for y in b]), strict=True):
        if partner < 0:
            out.append([x[0], x[1] | OPTIONAL, *x[2:]])
            continue
        out += [[y[0], y[1] | OPTIONAL, *y[2:]] for y in b[j:partner]]
        out.append(merge_item(x, b[partner], same_page))
        j = partner + 1
    return fold(out + [[y[0], y[1] | OPTIONAL, *y[2:]] for y in b[j:]])


def expression(items: list) -> str:
    """The wrapper as a union-free regular expression over names, # for a slot."""
    out = []
    for name, flags, inner, *_ in items:
        body = "#" if name == "#" and flags & SLOT else "".join(map(repr, inner)) if name == "#" else f"<{name}>{expression(inner)}</>"
        out.append({0: body, 1: f"({body})?", 2: f"({body})+", 3: f"({body})*"}[flags & 3])
    return "".join(out)
