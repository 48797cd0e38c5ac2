"""A small tolerant HTML reader: one pass over the page in linear time, no recursion.

The depths at which each tag is open are kept by tag, so finding what an end tag
or an implied end closes never searches the open elements.

``read`` gives the elements in document order. Each has its tag, its class, id
and role words, its parent's number, and its children (text or numbers).
Unclosed, crossed and cut-off tags are handled as browsers do in the common
cases: void elements, implied ends of paragraphs, list items, table parts and
options, raw text of scripts and styles, end tags without a start.
"""

from __future__ import annotations

import html
import re

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul".split())
#: What the start of a tag closes, and the elements the search for it stays inside.
CLOSES = {t: (frozenset("p"), frozenset("button table td th caption html".split())) for t in BLOCK if t not in ("body", "html", "option", "optgroup", "tr", "tbody", "thead", "tfoot", "caption", "legend")}
CLOSES |= {
    "p": (frozenset(["p"]), frozenset("button table td th caption html".split())),
    "li": (frozenset(["li"]), frozenset("ul ol menu dir table".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl", "table"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl", "table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "tbody": (frozenset(["thead", "tbody", "tfoot"]), frozenset(["table"])),
    "tfoot": (frozenset(["thead", "tbody", "tfoot"]), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
}

_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_STOP = re.compile(r">|=\s*[\"']")
_TOKEN = re.compile(r"[a-z]+|[0-9]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")


#: Elements that the end of an inline tag doesn't reach beyond.
WALLS = frozenset(["article", "main", "body", "table"])


class Element:
    __slots__ = ("tag", "attrs", "parent", "kids")

    def __init__(self, tag: str, attrs: dict[str, str], parent: int):
        self.tag, self.attrs, self.parent, self.kids = tag, attrs, parent, []


def attributes(raw: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _ATTR.finditer(raw):
        value = m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or ""
        found.setdefault(m[1].lower(), html.unescape(value))
    return found


def hint_words(element: Element) -> frozenset[str]:
    """Lower-case words of class, id and role: ``site-Header2`` gives site, header, 2."""
    a = element.attrs
    raw = " ".join(a[k] for k in ("class", "id", "role") if k in a)
    return frozenset(_TOKEN.findall(_CAMEL.sub(r"\1 \2", raw).lower())) if raw else frozenset()


def _tag_end(page: str, at: int) -> int:
    """Place of the ``>`` that ends the tag at ``at``, or -1; those in quoted values don't, unless the page has no end of the quote."""
    while m := _STOP.search(page, at):
        if m[0] == ">":
            return m.start()
        end = page.find(m[0][-1], m.end())
        if end < 0:
            return page.find(">", m.end())
        at = end + 1
    return -1


def read(page: str) -> list[Element]:
    """All elements; number 0 is the page itself."""
    nodes = [Element("#page", {}, -1)]
    stack = [0]
    depths: dict[str, list[int]] = {}  # where in the stack each tag is open

    def deepest(tags) -> int:
        """The innermost place of any of the tags in the stack, 0 if there is none."""
        return max((d[-1] for t in tags if (d := depths.get(t))), default=0)

    def close(k: int) -> None:
        for at in range(len(stack) - 1, k - 1, -1):
            depths[nodes[stack[at]].tag].pop()
        del stack[k:]

    def open_last(tag: str) -> None:
        depths.setdefault(tag, []).append(len(stack))
        stack.append(len(nodes) - 1)

    at, n = 0, len(page)
    low = None
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            nodes[stack[-1]].kids.append(html.unescape(page[at:lt]))
        if lt == n:
            break
        nxt = page[lt + 1 : lt + 2]
        if nxt in ("!", "?"):
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                at = n if end < 0 else end + 3
            else:
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            continue
        m = _NAME.match(page, lt + 1)
        if not m:
            if nxt == "/":  # an end tag without a name is a comment
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                nodes[stack[-1]].kids.append("<")
                at = lt + 1
            continue
        end = _tag_end(page, m.end())
        if end < 0:  # the page breaks off inside a tag
            break
        tag = m[1].lower()
        at = end + 1
        if nxt == "/":
            if len(stack) > 1 and nodes[stack[-1]].tag == tag:  # as it mostly is
                depths[tag].pop()
                stack.pop()
            elif (k := deepest((tag,))) and (tag in BLOCK or k >= deepest(WALLS)):
                close(k)
            elif not k and tag == "p":  # an end without a start is an empty paragraph
                nodes.append(Element("p", {}, stack[-1]))
                nodes[stack[-1]].kids.append(len(nodes) - 1)
            continue
        if rule := CLOSES.get(tag):
            what, bound = rule
            if any(map(depths.get, what)) and (k := deepest(what)) > deepest(bound):
                close(k)
        raw = page[m.end() : end]
        element = Element(tag, attributes(raw) if raw.strip(" /\n\t\r") else {}, stack[-1])
        nodes.append(element)
        nodes[stack[-1]].kids.append(len(nodes) - 1)
        if tag in RAW:
            if low is None:
                low = page.lower()
                if len(low) != n:  # some letters change length with their case
                    low = "".join(c.lower() if c < "\x80" else c for c in page)
            end = low.find(f"</{tag}", at)
            end = n if end < 0 else end
            element.kids.append(page[at:end])
            gt = page.find(">", end) if end < n else -1
            at = n if gt < 0 else gt + 1
        elif tag not in VOID and (tag in BLOCK or not raw.endswith("/")):  # on a block, browsers ignore the slash
            open_last(tag)
    return nodes
