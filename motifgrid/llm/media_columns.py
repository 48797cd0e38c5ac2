"""Media columns: interleaved sequences of text and media references.

HTML parsing yields, for each page, an ordered array of structs: text blocks
and media references, with the caption beside its reference and positions as
they stand on the page. Media payloads live in a table of their own, one row
for each digest, stored losslessly as 8-bit grey samples (PNG, ``ROW`` samples
a line). A join by digest resolves the references; everything that is derived
from a payload is computed once for each distinct digest, so a payload that a
third of all pages share is stored, moved and read once.

``document_media`` applies this to a table of texts: a document is a page of its
own lines with a figure of its text between them.

Edge cases: null and empty pages have an empty sequence; references without a
payload stay, with nulls; null and empty payload texts are one row of blanks;
repeated rows share one payload; an empty table gives an empty result; only the
named columns are read. Payloads of any length are stored whole.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound, map_rows, whole
from .html_tree import BLOCK, read

#: Samples (bytes) of an image line.
ROW = 192
_SIGN = b"\x89PNG\r\n\x1a\n"
_MEDIA = {"img": "image", "image": "image", "video": "video", "audio": "audio", "embed": "object", "object": "object"}
_SILENT = frozenset("script style noscript template title head textarea".split())
SEQUENCE = "array<struct<pos:int,kind:string,text:string,ref:string,caption:string>>"


# --- the stored form ----------------------------------------------------------------------


def to_png(payload: bytes, row: int = ROW, level: int = 1) -> bytes:
    """8-bit grey PNG whose samples are the payload; its length must be a positive multiple of ``row``."""
    if not payload or len(payload) % row:
        raise ValueError(f"a payload is a positive multiple of {row} bytes")
    lines = np.zeros((len(payload) // row, row + 1), np.uint8)  # each line begins with its filter: none
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, row)

    def part(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return _SIGN + part(b"IHDR", struct.pack(">IIBBBBB", row, len(lines), 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines.tobytes(), level)) + part(b"IEND", b"")


def from_png(stored: bytes) -> np.ndarray:
    """The samples, a line an image line, of a PNG that ``to_png`` wrote; every checksum is tested."""
    if stored[:8] != _SIGN:
        raise ValueError("not a PNG")
    at, data, shape = 8, [], (0, 0)
    while at < len(stored):
        size, kind = struct.unpack(">I4s", stored[at : at + 8])
        body = stored[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", stored[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("a part of the image is damaged")
        if kind == b"IHDR":
            width, height, depth, colour, *rest = struct.unpack(">IIBBBBB", body)
            if (depth, colour, *rest) != (8, 0, 0, 0, 0):
                raise ValueError("only 8-bit grey images are read")
            shape = (height, width)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(shape[0], shape[1] + 1)
    if lines[:, 0].any():
        raise ValueError("only unfiltered lines are read")
    return lines[:, 1:]


def features(samples: np.ndarray) -> str:
    """Size, sum, energy, absolute step between neighbours, and counts of 16 brightness bins."""
    flat = samples.reshape(-1).astype(np.int64)
    bins = np.bincount(flat >> 4, minlength=16)
    return f"{samples.shape[1]}x{samples.shape[0]};sum={flat.sum()};energy={(flat * flat).sum()};step={np.abs(np.diff(flat)).sum()};bins=" + ".".join(map(str, bins))


# --- sequences ----------------------------------------------------------------------------


def sequence(page: str) -> list[dict]:
    """Text blocks and media references of a page in order; a figure's caption goes with each of its media."""
    nodes = read(page)
    caption: dict[int, str] = {}

    def plain(top: int) -> str:
        out, todo = [], [iter(nodes[top].kids)]
        while todo:
            kid = next(todo[-1], None)
            if kid is None:
                todo.pop()
            elif isinstance(kid, str):
                out.append(kid)
            else:
                out.append(" ")
                todo.append(iter(nodes[kid].kids))
        return " ".join("".join(out).split())

    for k, e in enumerate(nodes):
        if e.tag == "figcaption":
            up = e.parent
            while up > 0 and nodes[up].tag != "figure":
                up = nodes[up].parent
            if up > 0:
                caption.setdefault(up, plain(k))
    out: list[dict] = []
    held: list[str] = []

    def put(kind: str, text=None, ref=None, note=None):
        out.append({"pos": len(out), "kind": kind, "text": text, "ref": ref, "caption": note})

    def cut():
        if line := " ".join("".join(held).split()):
            put("text", line)
        held.clear()

    todo: list = [(iter(nodes[0].kids), True, 0)]
    while todo:
        kids, block, figure = todo[-1]
        kid = next(kids, None)
        if kid is None:
            todo.pop()
            if block:
                cut()
            continue
        if isinstance(kid, str):
            held.append(kid)
            continue
        e = nodes[kid]
        if e.tag in _SILENT or e.tag == "figcaption" and figure:
            continue
        if e.tag in _MEDIA and (ref := e.attrs.get("src") or e.attrs.get("data") or e.attrs.get("href")):
            cut()
            put(_MEDIA[e.tag], None, ref, caption.get(figure) or e.attrs.get("alt") or e.attrs.get("title") or None)
        elif e.tag == "br":
            held.append(" ")
        if e.tag in BLOCK:
            cut()
        todo.append((iter(e.kids), e.tag in BLOCK, kid if e.tag == "figure" else figure))
    cut()
    return out


def sequences(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """``id, sequence`` of every page."""

    def make():
        def run(columns):
            return [columns[0], [sequence(x) for x in columns[1]]]

        return run

    kind = pages.schema[id_col].dataType.simpleString()
    return map_rows(pages.select(F.col(id_col).alias("id"), whole(html_col).alias("html")), make, f"id {kind}, sequence {SEQUENCE}")


def elements(rows: DataFrame) -> DataFrame:
    """``id, pos, kind, text, ref, caption``: one row for each element of each sequence."""
    return rows.select("id", F.explode("sequence").alias("e")).select("id", "e.pos", "e.kind", "e.text", "e.ref", "e.caption")


# --- media --------------------------------------------------------------------------------


def payload_of(text: Column, row: int = ROW) -> Column:
    """The text's UTF-8 bytes with blanks up to a positive multiple of ``row``."""
    raw = F.coalesce(text, F.lit(""))
    over = F.pmod(F.octet_length(raw), F.lit(row))
    pad = F.when((over == 0) & (F.octet_length(raw) > 0), 0).otherwise(F.lit(row) - over)
    return F.concat(raw, F.repeat(F.lit(" "), pad)).cast("binary")


def media_table(payloads: DataFrame, digest_col: str = "digest", payload_col: str = "payload") -> DataFrame:
    """``digest, stored``: each distinct payload once, in its stored form."""

    def make():
        def run(columns):
            return [columns[0], [to_png(x) for x in columns[1]]]

        return run

    kind = payloads.schema[digest_col].dataType.simpleString()
    stored = map_rows(payloads.select(F.col(digest_col).alias("digest"), F.col(payload_col).alias("payload")), make, f"digest {kind}, stored binary", rows=256)
    return stored.dropDuplicates(["digest"])


def read_back(media: DataFrame) -> DataFrame:
    """The stored bytes of each digest read again, with what follows from them."""

    def make():
        def run(columns):
            out: list[list] = [[] for _ in range(6)]
            for stored in columns[1]:
                samples = from_png(stored)
                raw = samples.tobytes()
                for a, b in zip(out, (len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), features(samples))):
                    a.append(b)
            return [columns[0], *out]

        return run

    kind = media.schema["digest"].dataType.simpleString()
    return map_rows(media.select("digest", "stored"), make, f"digest {kind}, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string", rows=256)


def resolve(references: DataFrame, media: DataFrame, ref_digest: Column) -> DataFrame:
    """The elements with their media's columns joined by digest; unresolved and text elements keep nulls."""
    keyed = references.withColumn("__digest", ref_digest)
    return keyed.join(media, keyed["__digest"] == media["digest"], "left").drop("__digest")


def document_page(text: Column, digest: Column) -> Column:
    """A document as a page: every line a paragraph, and after the middle line a figure that shows the whole text.

    The figure's caption says after which line of how many it stands.
    """

    def of(lines: Column) -> Column:
        n = F.size(lines)
        half = F.ceil(n / 2).cast("int")
        caption = F.concat(F.lit("<figure><img src='sha256:"), digest, F.lit("'><figcaption>after line "), half.cast("string"), F.lit(" of "), n.cast("string"), F.lit("</figcaption></figure>"))
        shown = lambda some: F.when(F.size(some) > 0, F.concat(F.lit("<p>"), F.array_join(some, "</p><p>"), F.lit("</p>"))).otherwise("")
        return F.concat(F.lit("<article>"), shown(F.slice(lines, F.lit(1), half)), caption, shown(F.slice(lines, half + 1, n)), F.lit("</article>"))

    plain = F.replace(F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return bound(F.split(plain, "\n"), of)


def document_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's media: its own lines interleaved with the figure of its text, the figure resolved by digest.

    Returns ``doc_id, n_bytes, pos, caption, n_blocks, blocks_sha256, digest``
    and the columns of ``read_back``: where the figure stands in the sequence,
    how many text blocks that has, and the digest of those blocks, one a line.
    """
    payload = payload_of(F.col(text_col))
    digest = F.sha2(payload, 256)
    own = docs.select(F.struct(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("bigint").alias("n_bytes")).alias("own"), document_page(F.col(text_col), digest).alias("html"))
    rows = sequences(own, "own", "html")
    blocks = F.transform(F.filter("sequence", lambda e: e["kind"] == "text"), lambda e: e["text"])
    shown = rows.select("id", F.size(blocks).cast("bigint").alias("n_blocks"), F.sha2(F.array_join(blocks, "\n").cast("binary"), 256).alias("blocks_sha256"), F.inline(F.filter("sequence", lambda e: e["kind"] != "text")))
    media = read_back(media_table(docs.select(F.unhex(digest).alias("digest"), payload.alias("payload"))))
    found = resolve(shown.drop("kind", "text"), media, F.unhex(F.regexp_extract("ref", "^sha256:([0-9a-f]{64})$", 1)))
    return found.select("id.doc_id", "id.n_bytes", "pos", "caption", "n_blocks", "blocks_sha256", F.lower(F.hex("digest")).alias("digest"), *[c for c in media.columns if c != "digest"])
