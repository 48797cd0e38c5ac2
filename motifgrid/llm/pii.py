"""Personal data: patterns propose, checksums confirm, nearby words adjust the score.

Every text is scanned whole, in code points. The base kinds (email, ip, card,
phone) are defined by pattern and validity test alone and always reported. The
added kinds carry a score: a prior of the pattern, raised by a passed checksum
and by context words within ``CONTEXT`` characters, and are reported from
``KEEP`` on. Narrow: one pass, no shuffle.

Edge cases: a null or empty text has no spans; a failed match is dropped and
the scan goes on after it; repeated rows get equal results; an empty table
gives an empty result. Scans are linear in the text's length (the unbounded
left parts of the patterns are anchored), so a very long text is no special
case. Only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, whole

BASE = ("email", "ip", "card", "phone")
#: Report order of kinds that start at the same place.
KINDS = (*BASE, "iban", "ssn", "secret")
#: Characters before and after a span in which context words count.
CONTEXT = 48
#: Least score of an added kind.
KEEP = 0.5

# Prior score of each kind, and the words that support it.
PRIOR = {"email": 0.9, "ip": 0.5, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3, "secret": 0.2}
WORDS = {
    "email": ("mail", "email", "e-mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "credit", "mastercard", "cc", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "bic", "konto"),
    "ssn": ("ssn", "social", "security", "taxpayer"),
    "secret": ("token", "key", "secret", "password", "api", "bearer", "auth"),
}
LIFT = 0.35

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
# A run of digits matches from its first digit or not at all, hence the look-behinds.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"(?<![A-Za-z0-9])[0-9A-Fa-f]{32,64}(?![A-Za-z0-9])")
_WORD = re.compile(r"[^\W\d_][\w-]*")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The account number's check: country and digits moved behind, letters as 10 to 35."""
    rest = 0
    for c in iban[4:] + iban[:4]:
        v = int(c, 36)
        rest = (rest * (100 if v > 9 else 10) + v) % 97
    return rest == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _supported(text: str, kind: str, start: int, end: int) -> bool:
    near = text[max(0, start - CONTEXT) : start] + " " + text[end : end + CONTEXT]
    words = {w.lower() for w in _WORD.findall(near)}
    return any(w in words for w in WORDS[kind])


def spans(text: str) -> list[tuple[str, int, int, float]]:
    """``(kind, start, end, score)`` by start, then kind; end is exclusive."""
    found: list[tuple[str, int, int, float]] = []

    def put(kind: str, start: int, end: int, confirmed: float = 0.0):
        value = PRIOR[kind] + confirmed + LIFT * _supported(text, kind, start, end)
        if kind in BASE or value >= KEEP:
            found.append((kind, start, end, min(1.0, value)))

    if "@" in text:
        for a, b in _emails(text):
            put("email", a, b)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(_octet(p) for p in m[0].split(".")):
                put("ip", m.start(), m.end())
        for m in _CARD.finditer(text):
            if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                put("card", m.start(), m.end(), 0.15)
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_digits(m[0])) <= 15:
                    put("phone", m.start(), m.end())
        for m in _IBAN.finditer(text):
            if 15 <= len(c := m[0].replace(" ", "")) <= 34 and mod97(c):
                put("iban", m.start(), m.end(), 0.15)
        for m in _SSN.finditer(text):
            put("ssn", m.start(), m.end())
        for m in _SECRET.finditer(text):
            put("secret", m.start(), m.end())
    found.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return found


def redact(text: str, found: list[tuple[str, int, int, float]]) -> str:
    """The text with each span as ``[KIND]``; spans that overlap fall together under the first one's kind."""
    out, at, k = [], 0, 0
    while k < len(found):
        kind, start, end, _ = found[k]
        k += 1
        while k < len(found) and found[k][1] < end:
            end = max(end, found[k][2])
            k += 1
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join(out) + text[at:] if out else text


def listed(found: list[tuple[str, int, int, float]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b, _ in found)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, found array<struct<kind,start,end,score>>`` for every row."""

    def make():
        def run(columns):
            ids, texts = columns
            return [ids, [[dict(zip(("kind", "start", "end", "score"), s)) for s in spans(x)] for x in texts]]

        return run

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text")), make, f"doc_id {kind}, found array<struct<kind:string,start:bigint,end:bigint,score:double>>")


def redact_pii(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with spans replaced in the text (null stays null) and the length column, if there is one, set anew."""
    names = docs.columns
    at, long = names.index(text_col), names.index(length_col) if length_col in names else None

    def make():
        def run(columns):
            texts = columns[at] = [None if x is None else redact(x, spans(x)) for x in columns[at]]
            if long is not None:
                columns[long] = [n if x is None else len(x) for x, n in zip(texts, columns[long])]
            return columns

        return run

    return map_rows(docs, make, docs.schema)


def digests(docs: DataFrame) -> DataFrame:
    """The contract's columns of ``find_pii``."""
    found = find_pii(docs)
    of = lambda column: F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("found", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(of(base).cast("binary"), 256).alias("base_sha256"), of(F.col("found")).alias("spans"))

