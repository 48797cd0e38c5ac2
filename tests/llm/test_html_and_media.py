from __future__ import annotations

import hashlib
import re
import zlib
from html.parser import HTMLParser

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from motifgrid.llm import html_extract as H
from motifgrid.llm import html_tree
from motifgrid.llm import media_columns as M
from motifgrid.llm import queries
from tests.llm.conftest import LONG, ROWS, rows

ARTICLE = "<html><head><title>T</title></head><body class='no-sidebar'><header>Site</header><nav><a>x</a></nav><div id=main class='with-sidebar'><article><header><h1>Head</h1></header><p>One &amp; two&nbsp;three<br>four<p>Five <b>six</b><ul><li>a<li>b</ul><div class='Comments'>bad</div><form>f</form></article><aside>s</aside></div><div class='cookie-notice'>c</div><footer>f</footer></body></html>"


@pytest.mark.parametrize(
    "page,want",
    [
        (ARTICLE, "Head\nOne & two three four\nFive six\na\nb"),
        ("<body><header>Site</header><div><h2>T</h2><p>one</p>tail</div><script>var a='</p>';</script>", "T\none\ntail"),
        ("<main><p>in</p></main><p>out</p>", "in"),
        ("<article class=comment>c</article><article><p>text</p></article>", "text"),
        ("<article></article><p>body</p>", "body"),
        ("", ""),
        ("plain 1 < 2 &lt; 3", "plain 1 < 2 < 3"),
        ("<p>cut <b", "cut"),
        ("<!-- a <p> b --><p title='>'>x</p><!-- open", "x"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a b\nc"),
        ("<p hidden>h</p><p style='display: none'>n</p><p>v</p>", "v"),
        ("<style>p{}</style><STYLE>x</STYLE><p>&#x41;&notanentity;</p>", "A¬anentity;"),
    ],
)
def test_main_text(page, want):
    assert H.Page(page).text() == want


def test_deep_and_long_pages():
    assert H.Page("<div>" * 30_000 + "x" + "</div>" * 30_000).text() == "x"
    assert H.Page("<p>" + LONG + "</p>").text() == LONG
    assert H.Page("<a '" * 3000 + ">").text() == ""
    assert len(html_tree.read("</b>" * 5000)) == 1


def test_quoted_values_of_any_length():
    for n in (1, 15, 16, 17, 5000):
        inner = "<p>leak</p>" * n
        assert H.Page(f"<div data-x='{inner}' title=\"{inner}\"><p>text</p></div>").text() == "text"
        assert [e["text"] for e in M.sequence(f"<div data-x = '{inner}'>text</div>")] == ["text"]
    assert H.Page("<div data-x='" + ">" * 20 + "' title=\"open>text").text() == "text"  # the quote has no end
    assert H.Page("<a b='>'" * 200_000 + "<a c=\">x").text() == "x"  # in linear time


def slow_read(page):
    """The reader with plain searches through the open elements, for well-formed tags only."""
    nodes, stack = [("#page", [])], [0]
    for m in re.finditer(r"<(/?)([a-z0-9]+)(/?)>|([^<]+)", page):
        end, tag, slash, text = m.groups()
        if text:
            nodes[stack[-1]][1].append(text)
        elif end:
            for k in range(len(stack) - 1, 0, -1):
                if nodes[stack[k]][0] == tag:
                    del stack[k:]
                    break
                if nodes[stack[k]][0] in ("article", "main", "body", "table") and tag not in html_tree.BLOCK:
                    break
            else:
                if tag == "p":
                    nodes.append(("p", []))
                    nodes[stack[-1]][1].append(len(nodes) - 1)
        else:
            what, bound = html_tree.CLOSES.get(tag, ((), ()))
            for k in range(len(stack) - 1, 0, -1):
                if nodes[stack[k]][0] in what:
                    del stack[k:]
                    break
                if nodes[stack[k]][0] in bound:
                    break
            nodes.append((tag, []))
            nodes[stack[-1]][1].append(len(nodes) - 1)
            if tag not in html_tree.VOID and (not slash or tag in html_tree.BLOCK):
                stack.append(len(nodes) - 1)
    return nodes


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([f"{a}{t}{b}" for t in ("p", "b", "div", "article", "table", "tr", "td", "li", "ul", "br", "main", "option") for a, b in (("<", ">"), ("</", ">"), ("<", "/>"))] + ["x", "y z"]), max_size=40))
def test_reader_equals_plain_searches(parts):
    page = "".join(parts)
    assert [(e.tag, e.kids) for e in html_tree.read(page)] == slow_read(page)


def test_hostile_pages_take_linear_time():
    import time

    began = time.process_time()
    assert len(html_tree.read("<div>" * 20_000 + "</b>" * 200_000)) == 20_001
    assert len(html_tree.read("<b>" * 20_000 + "<article>" + "</b>" * 200_000)) == 20_002
    assert H.Page("<div>" * 20_000 + "<article>x</article>" * 20_000).text().count("x") == 20_000
    assert H.Page("<div><p>" * 20_000 + "x").text() == "x"
    assert time.process_time() - began < 20


def site(spark):
    made = []
    for k in range(8):
        own = f"<p>story number {k} of this site</p><p>second paragraph {k}</p>"
        made.append((k, f"http://Site.example/{k}", f"<body><div>Welcome to the site</div><section><span>Follow us</span></section><div>{own}</div></body>"))
        made.append((100 + k, f"https://user@b.example:80/{k}", f"<body><div><p>different {k}</p></div></body>"))
    made += [(200 + k, "http://copies.example/", "<body><div>the same page</div></body>") for k in range(9)]
    made += [(300, None, "<body><div>Welcome to the site</div></body>"), (301, "odd", None), (302, "http://site.example/x", ""), (0, "http://Site.example/0", made[0][2])]
    return spark.createDataFrame(made, "page_id bigint, url string, html string").withColumns({c: F.lit(1) for c in ("host", "text", "template", "n", "subtree", "main")})


def test_templates_of_a_site_go(spark):
    found = H.extract(site(spark))
    assert found.columns == ["page_id", "url", "text"]
    by = {r["page_id"]: r["text"] for r in found.collect()}
    assert all(by[k] == f"story number {k} of this site\nsecond paragraph {k}" for k in range(8))
    assert all(by[100 + k] == f"different {k}" for k in range(8))
    assert {by[200 + k] for k in range(9)} == {"the same page"}  # copies are one page, not a template
    assert by[300] == "Welcome to the site" and by[301] == by[302] == "" and found.filter("page_id = 0").count() == 2
    assert H.extract(site(spark).limit(0)).count() == 0


def test_templates_by_place_go(spark):
    made = []
    for k in range(20):
        more = "".join(f"<p>passage {k} {j} of a longer article</p>" for j in range(k % 5 + 2))
        quote = "<p>To be or not to be</p>" if k % 2 else ""
        body = f"<h1>Head {k}</h1><p>Filed under news</p>{more}{quote * (k % 7)}<p>goes <b>very</b> on {k}</p><div><span>Follow us</span> <span>{k}</span></div><ul><li>item {k}</li><li>Send a tip</li></ul><p>All rights reserved</p>"
        made.append((k, f"http://a.example/{k}", f"<body><div><p>Links {k % 2}</p></div><article>{body}</article><script>{k}</script></body>"))
        made.append((100 + k, f"http://b.example/{k}", f"<body><div><p>Links {k % 4}</p><span>Shop {k % 3}</span></div><section><p>story {k} goes on for a while here</p></section></body>"))
        same = "".join(f"<p>the same article's passage {j}</p>" for j in range(9))
        made.append((200 + k, f"http://c.example/{k}", f"<article><h1>The same head</h1>{same}<p>changed {k}</p></article>"))
    by = {r["page_id"]: r["text"] for r in H.extract(spark.createDataFrame(made, "page_id bigint, url string, html string")).collect()}
    for k in range(20):
        want = [f"Head {k}", *[f"passage {k} {j} of a longer article" for j in range(k % 5 + 2)], *["To be or not to be"] * (k % 7 if k % 2 else 0), f"goes very on {k}", str(k), f"item {k}"]
        assert by[k] == "\n".join(want)
        assert by[100 + k] == f"story {k} goes on for a while here"
        assert by[200 + k].startswith("The same head\n") and by[200 + k].count("\n") == 10  # near copies are no template


def test_named_furniture_is_counted_too():
    p = H.Page("<body><nav><ul><li>a</li></ul></nav><article><p>x</p></article><footer>f</footer></body>")
    keys = [(p.nodes[k].tag, place, key) for k, place, key in p.subtrees()]
    assert {t for t, place, _ in keys if place is None} == {"nav", "footer"}
    found = H.Page("<body><nav><ul><li>a</li></ul></nav><article><p>y</p></article><footer>f</footer></body>", frozenset(key for t, place, key in keys if place is None))
    assert found.cut == 2 and found.text() == "y"


def test_subtree_hashes_tell_contents_apart():
    a, b, c = (H.Page(f"<div class='{x}'><p>{y}</p></div>").hashes()[1] for x, y in (("q", "one"), ("q", "two"), ("r", "one")))
    assert len({a, b, c}) == 3
    assert a == H.Page("<section></section><div class='q'><p> one </p></div>").hashes()[2]


def test_page_query(spark, duck):
    found = {r["page_id"]: r for r in queries.op7_html_extract(spark, "/root/testdata/sf0.001").collect()}
    pages = duck.execute("SELECT page_id, html FROM pages").fetchall()
    assert found.keys() == {p for p, _ in pages}
    import html
    import re

    for page_id, page in pages:
        inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert found[page_id]["text"] == "\n".join(b for b in blocks if b)
        assert found[page_id]["n_chars"] == len(found[page_id]["text"])


# --- media --------------------------------------------------------------------------------


def test_sequences_keep_order_and_captions():
    page = "<p>one</p><figure><img src='m:1' alt='no'><img src=m:2><figcaption>both <i>of</i> them</figcaption></figure>text <img src='m:3' alt='third'> after<video src=v></video><script><img src=x></script><img><figure><p>in</p></figure>"
    got = [(e["pos"], e["kind"], e["text"] or e["ref"], e["caption"]) for e in M.sequence(page)]
    assert got == [(0, "text", "one", None), (1, "image", "m:1", "both of them"), (2, "image", "m:2", "both of them"), (3, "text", "text", None), (4, "image", "m:3", "third"), (5, "text", "after", None), (6, "video", "v", None), (7, "text", "in", None)]
    assert M.sequence("") == []


@pytest.mark.parametrize("n", [192, 384, 192 * 700])
def test_png_round_trip(n):
    raw = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()
    stored = M.to_png(raw)
    assert M.from_png(stored).tobytes() == raw
    with pytest.raises(ValueError):
        M.from_png(stored[:60] + bytes([stored[60] ^ 1]) + stored[61:])
    for bad in (b"", b"x", b"x" * 191):
        with pytest.raises(ValueError):
            M.to_png(bad)


def test_resolution_by_digest(spark):
    pages = spark.createDataFrame([(1, "<p>a</p><img src='m:x'><img src='m:gone'><img src='m:x'>"), (1, "<img src='m:y'>"), (2, None)], "id bigint, html string")
    payloads = spark.createDataFrame([("x", bytearray(b"p" * 192)), ("x", bytearray(b"p" * 192)), ("y", bytearray(b"q" * 384)), ("unused", bytearray(b"r" * 192))], "digest string, payload binary")
    media = M.read_back(M.media_table(payloads))
    assert media.count() == 3
    found = M.resolve(M.elements(M.sequences(pages, "id", "html")), media, F.regexp_extract("ref", "^m:(.*)$", 1))
    got = sorted((r["id"], r["pos"], r["kind"], r["digest"], r["payload_bytes"]) for r in found.fillna({"digest": "", "payload_bytes": 0}).collect())
    assert got == [(1, 0, "image", "y", 384), (1, 0, "text", "", 0), (1, 1, "image", "x", 192), (1, 2, "image", "", 0), (1, 3, "image", "x", 192)]
    assert M.elements(M.sequences(pages.limit(0), "id", "html")).count() == 0


def plain_png(payload):
    """The samples as stored bytes, and read again from them by the format's rules alone."""
    lines = [payload[k : k + 192] for k in range(0, len(payload), 192)]
    part = lambda kind, data: len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big")
    size = (192).to_bytes(4, "big") + len(lines).to_bytes(4, "big")
    stored = b"\x89PNG\r\n\x1a\n" + part(b"IHDR", size + bytes([8, 0, 0, 0, 0])) + part(b"IDAT", zlib.compress(b"".join(b"\0" + x for x in lines), 1)) + part(b"IEND", b"")
    raw = zlib.decompress(stored[41 : 41 + int.from_bytes(stored[33:37], "big")])
    return stored, [raw[k + 1 : k + 193] for k in range(0, len(raw), 193)]


def plain_feature(lines):
    flat = [v for x in lines for v in x]
    bins = [sum(v // 16 == k for v in flat) for k in range(16)]
    return f"192x{len(lines)};sum={sum(flat)};energy={sum(v * v for v in flat)};step={sum(abs(a - b) for a, b in zip(flat, flat[1:]))};bins=" + ".".join(map(str, bins))


def test_document_media(spark, docs, clashing, nothing, real):
    """Every column made again by plain means, from the text alone."""
    for df in (docs, clashing):
        assert M.document_media(df).count() == len(ROWS)
    assert M.document_media(nothing).count() == 0
    for df in (docs, real):
        want = []
        for r in df.collect():
            raw = (r["text"] or "").encode()
            payload = raw + b" " * (-len(raw) % 192 if raw else 192)
            stored, lines = plain_png(payload)
            assert b"".join(lines) == payload
            own = (r["text"] or "").split("\n")
            half = (len(own) + 1) // 2
            shown = [" ".join(x.split()) for x in own]
            blocks = [x for x in shown if x]
            media = (r["doc_id"], len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), plain_feature(lines))
            want.append((*media, sum(x != "" for x in shown[:half]), f"after line {half} of {len(own)}", len(blocks), hashlib.sha256("\n".join(blocks).encode()).hexdigest()))
        got = M.document_media(df).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pos", "caption", "n_blocks", "blocks_sha256")
        assert rows(got) == sorted(want, key=repr)
    assert M.document_media(real).select("pos", "caption").distinct().count() > 5


class Decoder(HTMLParser):
    """An independent reading of a page: texts of its paragraphs and its pictures, in order."""

    def __init__(self, page):
        super().__init__()
        self.found, self.held, self.caption = [], "", None
        self.feed(page)
        self.cut()

    def cut(self):
        if line := " ".join(self.held.split()):
            self.found.append(["text", line, None])
        self.held = ""

    def handle_starttag(self, tag, attrs):
        if tag in html_tree.BLOCK:
            self.cut()
        if tag == "br":
            self.held += " "
        if tag == "img":
            self.cut()
            self.found.append(["image", dict(attrs)["src"], None])
        if tag in ("figcaption", "script", "style", "title"):
            self.held, self.caption = "", tag

    def handle_endtag(self, tag):
        if tag == self.caption:
            if tag == "figcaption":
                self.found[-1][2] = " ".join(self.held.split())
            self.held, self.caption = "", None
        if tag in html_tree.BLOCK:
            self.cut()

    def handle_data(self, data):
        self.held += data


def test_pages_with_pictures_between_their_blocks(spark, duck):
    """Real pages with pictures put between their paragraphs: order, captions and payloads against another parser."""
    pages, payloads = [], {}
    for page_id, page in duck.execute("SELECT page_id, html FROM pages ORDER BY page_id").fetchall():
        parts = page.split("</p>")
        for k in range(page_id % 4 + 1):
            at = (page_id * 7 + k * 3) % len(parts)
            payload = f"picture {page_id % 9} {k}".encode().ljust(192)
            digest = hashlib.sha256(payload).hexdigest()
            if k != 3:  # the fourth picture of a page has no payload
                payloads[digest] = payload
            parts[at] = f"<figure><img src='sha256:{digest}'><figcaption>shows {k} &amp; {page_id}</figcaption></figure>" + parts[at]
        pages.append((page_id, "</p>".join(parts)))
    df = spark.createDataFrame(pages, "page_id bigint, html string")
    media = M.read_back(M.media_table(spark.createDataFrame([(d, bytearray(p)) for d, p in payloads.items()] * 2, "digest string, payload binary")))
    got: dict = {}
    for r in M.resolve(M.elements(M.sequences(df, "page_id", "html")), media, F.regexp_extract("ref", "^sha256:([0-9a-f]{64})$", 1)).collect():
        got.setdefault(r["id"], []).append((r["pos"], r["kind"], r["text"] or r["ref"], r["caption"], r["payload_sha256"], r["payload_bytes"]))
    places = set()
    for page_id, page in pages:
        want = [(k, kind, what, note, what[7:] if (held := kind == "image" and what[7:] in payloads) else None, 192 if held else None) for k, (kind, what, note) in enumerate(Decoder(page).found)]
        assert sorted(got[page_id], key=lambda x: x[0]) == want
        places |= {w[0] for w in want if w[1] == "image"}
    assert len(places) > 5


def test_media_query_columns(spark):
    assert queries.op8_media_columns(spark, "/root/testdata/sf0.001").columns[:8] == ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
