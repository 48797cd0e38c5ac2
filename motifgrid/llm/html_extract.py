"""Main text of web pages: site templates and known furniture cut away.

1. Site templates: every element subtree of the page that holds text is hashed
   (tag, class, id, text and children), before an article is picked. Spark
   counts, for each host, on how many different pages a subtree occurs (pages
   with equal main text are one, so copied articles don't pass as templates).
   Deleted on every page of the host, from ``LEAST`` pages on:
   - blocks that ``SHARE`` of the host's different pages have, wherever they
     stand; paragraphs, headings and list items inside an explicit article are
     not taken by this rule, since passages do recur there;
   - outside articles, the variants that take turns at one place (the path of
     tag, class, id and number among like siblings): each on ``TURN`` of the
     pages, all of them together on ``SHARE``;
   - inside an explicit article, any element that ``SHARE`` of the pages have at
     one place, counted from the first or from the last of its like siblings.
   The two rules by place also take inline elements, unless these stand in a
   line of text. Where they would take more than half of a page's text, the page
   is one of many near copies, and they take nothing.
2. Furniture that says what it is goes too: by element (nav, aside, footer,
   form, script, ...), by role, or by a word of class or id (cookie, sidebar,
   advert, comments, ...).
3. The rest of the article (of the main element or the body where there is
   none) is written out block by block.

A host's template set is bounded: it has at most 1/SHARE + 2/TURN times the mean
number of subtrees of its pages. Counting aggregates on the map side, so a hot
host doesn't gather in a task, and the join is left to the planner, which splits
a hot host's pages.

Edge cases: a null or empty page has an empty text; pages without host (null or
odd url) are cut by rule 2 only; repeated rows are one page for the counts and
come out as often as they went in; an empty table gives an empty result; only
id, url and page columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, materialize, ship_package, slices
from .html_tree import BLOCK, RAW, Element, hint_words, read

#: Share of a host's different pages, and least count, from which a subtree is template.
SHARE, LEAST = 0.5, 4
#: Least share of a host's different pages for one of several variants at a place.
TURN = 0.01

# Elements and words of class, id or role that mark furniture.
GONE = frozenset("script style noscript template textarea title head nav aside footer form button select option datalist iframe object embed applet svg canvas dialog menu audio video map input label fieldset legend link meta noembed noframes xmp".split())
MARKS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promoted banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login signin register sidebar aside widget widgets nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager footer masthead topbar toolbar share sharing social related recommended recommendations comment comments commentlist disqus reply replies respond discussion search searchbox searchform contentinfo complementary dialog skip copyright legal disclaimer".split())
#: Marks that count on any element; on the article itself only those of reader comments and adverts do.
ARTICLE_MARKS = frozenset("ad ads advert advertisement sponsored comment comments reply related recommended".split())
HEADERS = frozenset(["header"])
OWN = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li".split())


def _hash(text: str) -> int:
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "replace"))
    return h - (1 << 64) if h >> 63 else h


def _hidden(e: Element) -> bool:
    return "hidden" in e.attrs or "display:none" in e.attrs.get("style", "").replace(" ", "").lower() or e.attrs.get("aria-hidden", "") == "true"


class Page:
    """A page read, with template and furniture marked and the article found."""

    def __init__(self, page: str, template: frozenset[int] = frozenset()):
        self.nodes = nodes = read(page)
        n = len(nodes)
        self.gone = gone = [False] * n
        self.article = inside = [False] * n  # inside an explicit article
        wraps = self._wraps()
        for k in range(1, n):
            e = nodes[k]
            up = e.parent
            inside[k] = inside[up] or e.tag == "article"
            if gone[up]:
                gone[k] = True
                continue
            words = hint_words(e) if e.attrs else frozenset()
            if e.tag in GONE or (e.attrs and _hidden(e)):
                gone[k] = True
            elif e.tag in ("article", "main", "body", "html"):
                gone[k] = e.tag == "article" and bool(words & ARTICLE_MARKS)
            elif e.tag == "header" or "header" in words and e.tag not in OWN:
                gone[k] = not inside[up]
            elif words & MARKS and k not in wraps:
                gone[k] = True
        self.tops = self._tops()
        self.cut = 0  # subtrees deleted as template
        if template:
            self._delete(template)

    def _delete(self, template: frozenset[int]) -> None:
        """Mark the template's subtrees; those by place only if they leave half of the text."""
        hard, soft = set(), set()
        for k, place, key in self.subtrees():
            if key in template:
                (hard if place is None else soft).add(k)
        named = self.gone
        self._drop(named, hard)
        if soft:
            whole, least, tops = self.gone, self._size(), self.tops
            self._drop(named, hard | soft)
            if 2 * self._size() < least:
                self.gone, self.tops = whole, tops
                soft = set()
        found, within = hard | soft, [False] * len(self.nodes)
        for k in range(1, len(self.nodes)):
            within[k] = (up := within[self.nodes[k].parent]) or k in found
            self.cut += within[k] and not up

    def _drop(self, named: list[bool], found: set[int]) -> None:
        self.gone = gone = named.copy()
        for k in range(1, len(gone)):
            gone[k] = gone[k] or k in found or gone[self.nodes[k].parent]
        self.tops = self._tops()

    def _size(self) -> int:
        """Characters of text that are left in the article."""
        size, todo = 0, list(self.tops)
        while todo:
            for kid in self.nodes[todo.pop()].kids:
                if isinstance(kid, str):
                    size += len(kid.strip())
                elif not self.gone[kid]:
                    todo.append(kid)
        return size

    def _wraps(self) -> set[int]:
        """The elements around the longest article or main element: a mark on them says nothing about it."""
        size, best, most = [0] * len(self.nodes), -1, 0
        for k in range(len(self.nodes) - 1, 0, -1):
            e = self.nodes[k]
            if e.tag in GONE:
                continue
            size[k] += sum(len(x) for x in e.kids if isinstance(x, str))
            if size[k] >= most and e.tag in ("article", "main") and not hint_words(e) & ARTICLE_MARKS:
                best, most = k, size[k]
            size[e.parent] += size[k]
        found: set[int] = set()
        while best > 0:
            best = self.nodes[best].parent
            found.add(best)
        return found

    def _tops(self) -> list[int]:
        """The article elements that aren't inside another, else the main element, else the page."""
        for kind in ("article", "main"):
            found = [k for k, e in enumerate(self.nodes) if not self.gone[k] and (e.tag == kind or kind == "main" and e.attrs.get("role") == "main" or kind == "article" and e.attrs.get("itemprop") == "articleBody")]
            within, chosen, tops = [False] * len(self.nodes), set(found), []
            for k in range(1, len(self.nodes)):
                up = self.nodes[k].parent
                within[k] = within[up] or up in chosen and up > 0
                if k in chosen and not within[k]:
                    tops.append(k)
            if any(self._has_text(k) for k in tops):
                return tops
        return [0]

    def _has_text(self, top: int) -> bool:
        todo = [top]
        while todo:
            for kid in self.nodes[todo.pop()].kids:
                if isinstance(kid, str):
                    if kid and not kid.isspace():
                        return True
                elif not self.gone[kid]:
                    todo.append(kid)
        return False

    def hashes(self) -> list[int]:
        """A signed 64-bit hash of every element's subtree, furniture inside what isn't furniture left out."""
        out = [0] * len(self.nodes)
        for k in range(len(self.nodes) - 1, -1, -1):
            e = self.nodes[k]
            parts = [e.tag, e.attrs.get("class", ""), e.attrs.get("id", "")]
            for kid in e.kids:
                if isinstance(kid, str):
                    if text := " ".join(kid.split()):
                        parts.append("t" + text)
                elif not self.gone[kid] or self.gone[k] and self.nodes[kid].tag not in RAW:
                    parts.append(f"e{out[kid]}")
            out[k] = _hash("\x00".join(parts))
        return out

    def subtrees(self) -> list[tuple[int, int | None, int]]:
        """Element, place and key of what may be template; without a place the key counts anywhere.

        Odd places are inside an explicit article.
        """
        nodes, hashes = self.nodes, self.hashes()
        n = len(nodes)
        text, line = [False] * n, [False] * n  # has text at all, or of its own
        for k in range(n - 1, 0, -1):
            e = nodes[k]
            if e.tag not in RAW:
                line[k] = any(isinstance(x, str) and not x.isspace() and x != "" for x in e.kids)
                if line[k] or text[k]:
                    text[k] = text[e.parent] = True
        steps, number, like = [""] * n, [0] * n, {}
        for k in range(1, n):
            e = nodes[k]
            steps[k] = step = f"{e.tag}.{e.attrs.get('class', '')}#{e.attrs.get('id', '')}"
            number[k] = like.get((e.parent, step), 0)
            like[e.parent, step] = number[k] + 1
        paths, found = [0] * n, []
        for k in range(1, n):
            e = nodes[k]
            up = e.parent
            paths[k] = _hash(f"{paths[up]}/{steps[k]}/{number[k]}")
            if not text[k] or e.tag in ("html", "head", "body", "main", "article"):
                continue
            if len(nodes[up].kids) == 1 and up and nodes[up].tag not in ("html", "body", "main", "article") and not nodes[up].attrs:
                continue  # the whole of its parent, which is counted
            own = self.article[k]
            block = e.tag in BLOCK
            if block and not (own and e.tag in OWN):
                found.append((k, None, hashes[k]))
            if block or not line[up]:
                places = [paths[k] & ~1]
                if own:
                    places = [paths[k] | 1, _hash(f"{paths[up]}/{steps[k]}/{number[k] - like[up, steps[k]]}") | 1]
                found += [(k, place, _hash(f"{place} {hashes[k]}")) for place in places]
        return found

    def text(self) -> str:
        """The article's blocks, one a line."""
        drop = self.gone
        blocks: list[str] = []
        held: list[str] = []

        def cut():
            if line := " ".join("".join(held).split()):
                blocks.append(line)
            held.clear()

        for top in self.tops:
            cut()
            todo: list = [iter(self.nodes[top].kids)]
            ends = [True]
            while todo:
                kid = next(todo[-1], None)
                if kid is None:
                    todo.pop()
                    if ends.pop():
                        cut()
                elif isinstance(kid, str):
                    held.append(kid)
                elif not drop[kid]:
                    e = self.nodes[kid]
                    block = e.tag in BLOCK
                    if block:
                        cut()
                    elif e.tag in ("br", "td", "th", "img", "wbr"):
                        held.append("" if e.tag == "wbr" else " ")
                    todo.append(iter(e.kids))
                    ends.append(block)
        cut()
        return "\n".join(blocks)


def host_of(url: Column) -> Column:
    """The lower-case host of a url, null if it has none."""
    found = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return F.when(found != "", found)


def site_templates(pages: DataFrame, share: float = SHARE, least: int = LEAST, turn: float = TURN) -> DataFrame:
    """``host, template array<bigint>`` from ``host, html``: the hosts that have one."""
    ship_package(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hosts, places, keys, mains = [], [], [], []
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                p = Page(page)
                own = {(place, key) for _, place, key in p.subtrees()} | {(None, None)}  # nulls stand for the page itself
                hosts += [host] * len(own)
                mains += [_hash(p.text())] * len(own)
                places += [place for place, _ in own]
                keys += [key for _, key in own]
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(places, pa.int64()), pa.array(keys, pa.int64()), pa.array(mains, pa.int64())], names=["host", "place", "subtree", "main"])

    rows = pages.filter("host IS NOT NULL AND html IS NOT NULL").select("host", "html").mapInArrow(run, "host string, place bigint, subtree bigint, main bigint")
    counts = materialize(rows.distinct().groupBy("host", "place", "subtree").agg(F.count("*").alias("n")).filter((F.col("n") >= least) | F.col("subtree").isNull()), "subtrees")
    total = counts.filter("subtree IS NULL").select("host", F.col("n").alias("total"))
    found = counts.filter("subtree IS NOT NULL").join(total, "host")
    often = F.col("n") >= share * F.col("total")
    outside = F.col("place").isNotNull() & (F.col("place").bitwiseAND(F.lit(1)) == 0)
    turns = found.filter(outside & (F.col("n") >= turn * F.col("total")))
    held = turns.groupBy("host", "place").agg(F.sum("n").alias("n"), F.first("total").alias("total")).filter(often).select("host", "place")
    every = found.filter(often & ~outside).select("host", "subtree").unionByName(turns.join(held, ["host", "place"]).select("host", "subtree"))
    return every.groupBy("host").agg(F.collect_set("subtree").alias("template"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", share: float = SHARE, least: int = LEAST) -> DataFrame:
    """``page_id, url, text`` of every page."""
    read_cols = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    template = materialize(site_templates(read_cols, share, least), "templates")
    joined = read_cols.join(template, "host", "left").select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), "template")

    def make():
        def run(columns):
            ids, urls, texts, templates = columns
            return [ids, urls, [Page(x, frozenset(t or ())).text() for x, t in zip(texts, templates)]]

        return run

    kind = pages.schema[id_col].dataType.simpleString()
    return map_rows(joined, make, f"page_id {kind}, url string, text string")
