"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed 1- to 3-grams of the text's letters (lower case; everything
else is one space), as ``(1 + ln tf) * idf``, scaled to length 1. Document
frequencies are counted over all learnable rows. The weights are learned by
follow-the-regularised-leader with elastic-net penalties (per coordinate
rates, exact zeros) on a bounded labelled sample: ``PER_LANG`` different rows of
a language and ``TOTAL`` in all in expectation, twice ``TOTAL`` at most (one row
a language at least), drawn by a hash of the whole row; texts of any length may
be drawn, since executors send n-gram counts only. All languages are learned.
A fifth of the sample is left out of training and fits one temperature. Its
targets are smoothed by one pseudo-count (as in Platt's scaling), so there is a
least loss at a finite temperature even if every row of that part is right, and
no score claims more than so many rows can show.

Prediction is narrow and covers whole texts (in pieces of ``PIECE`` characters
whose counts add up, so memory is bounded).

``accepted`` keeps the texts that the prediction identifies: the odds of the
predicted language must be at least ``GAIN`` times those that the model gives it
without any n-gram. A text in several languages is sure of none, so one that
falls short is predicted again in parts of ``PART`` characters, without words
that hold a digit, and stays if at least half of the n-grams stand in parts that
are identified. Texts in languages never learned fall short both ways. With one
language there are no odds and every text passes; the more languages there are,
the lower a score can be.

A check follows, whether a text is language of the learned kind at all: the
share of its n-grams that at least one in ``RARE`` learnable rows (and two of
them) has must reach ``FAMILIAR`` of what the sample's median text has. That
doesn't depend on how many languages there are.

Edge cases: null texts and texts without a letter are ``und`` with score 0;
rows with null language are never learned from; with no learnable row every
text is ``und``; with one language every text with a letter gets it; rows that
repeat in all columns read (text, language, key) are one row of the sample but
count as they come in the document frequencies; only the named columns are
read, and filtering keeps all columns as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_remainder, map_rows, ship_package, slices

#: Hash bins of the n-grams.
BINS = 1 << 15
#: Sample bound: expected labelled rows of one language, and of all.
PER_LANG, TOTAL = 600, 6000
#: Passes over the sample, and the learner's parameters.
EPOCHS, ALPHA, BETA, L1, L2 = 4, 0.5, 1.0, 0.002, 0.01
#: Characters handled at once.
PIECE = 1 << 20
#: An n-gram is rare if fewer than one in so many learnable rows has it.
RARE = 1000
#: Least share of not rare n-grams in an accepted text, against the median text's.
FAMILIAR = 0.75
#: Least rise of the predicted language's odds in an identified text, over a text that says nothing.
GAIN = 3.0
#: Characters of the parts that doubtful texts are predicted in.
PART = 64
UNKNOWN = "und"

_DIGIT = re.compile(r"\d")
_table: np.ndarray | None = None


def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or a space."""
    global _table
    if _table is None:
        out = np.full(0x110000, 32, np.uint32)
        for cp in range(0x110000):
            c = chr(cp)
            if c.isalpha():
                low = c.lower()
                out[cp] = ord(low) if len(low) == 1 else cp
        _table = out
    return _table


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Bins and counts of a text's n-grams; empty if it has no letter."""
    table, total, letter = _letters(), None, False
    left = np.array([32], np.uint32)
    for at in range(0, len(text), PIECE):
        code = table[np.frombuffer(text[at : at + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)]
        letter = letter or bool((code != 32).any())
        code = np.concatenate([left, code])
        keep = np.ones(len(code), bool)
        keep[1:] = (code[1:] != 32) | (code[:-1] != 32)
        code = code[keep]
        c = code.astype(np.uint32)
        new = len(left)
        one = c * np.uint32(2654435761) >> np.uint32(17)
        two = (c[:-1] * np.uint32(2246822519) ^ c[1:] * np.uint32(3266489917)) * np.uint32(668265263) >> np.uint32(17)
        three = (c[:-2] * np.uint32(374761393) ^ c[1:-1] * np.uint32(2246822519) ^ c[2:] * np.uint32(2654435761)) * np.uint32(3266489917) >> np.uint32(17)
        # only n-grams that end in this piece's own characters
        counts = np.bincount(np.concatenate([one[new:], two[new - 1 :], three[max(0, new - 2) :]]), minlength=BINS)
        total = counts if total is None else total + counts
        left = code[-2:]
    if not letter:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    at = np.flatnonzero(total)
    return at.astype(np.int32), total[at]


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    #: Largest inverse document frequency of an n-gram that isn't rare, and least share of such in an accepted text.
    common: float = 0.0
    familiar: float = 0.0

    def known_share(self, bins: np.ndarray, counts: np.ndarray) -> float:
        """Share of a text's n-grams that aren't rare."""
        return float(counts[self.idf[bins] <= self.common].sum() / max(1, counts.sum()))

    def identified(self, bins: np.ndarray, counts: np.ndarray) -> bool:
        """Whether n-grams raise the odds of the language predicted from them ``GAIN`` times."""
        p, before = self.probabilities(bins, counts), self.probabilities(bins[:0], counts[:0])
        k = int(p.argmax())
        return bool(p[k] * (1 - before[k]) >= GAIN * before[k] * (1 - p[k]))

    def identified_in_parts(self, text: str) -> bool:
        """Whether at least half of the n-grams of words without digits stand in identified parts."""
        known = total = 0
        for at in range(0, len(text), PIECE):
            line = " ".join(w for w in text[at : at + PIECE].split() if not _DIGIT.search(w))
            for start in range(0, len(line), PART):
                bins, counts = ngram_counts(line[start : start + PART])
                n = int(counts.sum())
                total += n
                known += n if n and self.identified(bins, counts) else 0
        return total > 0 and 2 * known >= total

    def accepts(self, text: str | None) -> bool:
        """Whether a text is identified as one or several learned languages and looks like them."""
        if not text or not self.langs:
            return False
        bins, counts = ngram_counts(text)
        if not len(bins) or self.known_share(bins, counts) < self.familiar:
            return False
        return self.identified(bins, counts) or self.identified_in_parts(text)

    def vector(self, bins: np.ndarray, counts: np.ndarray) -> np.ndarray:
        v = ((1 + np.log(counts)) * self.idf[bins]).astype(np.float32)
        return v / max(float(np.sqrt(v @ v)), 1e-12)

    def probabilities(self, bins: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return softmax((self.vector(bins, counts) @ self.weights[bins] + self.bias) / self.temperature)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs:
            return UNKNOWN, 0.0
        bins, counts = ngram_counts(text)
        if not len(bins):
            return UNKNOWN, 0.0
        p = self.probabilities(bins, counts)
        k = int(p.argmax())
        return self.langs[k], float(p[k])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], n_langs: int, epochs: int = EPOCHS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal with elastic net; ``rows`` hold bins, values and class. Returns weights and bias."""
    z, n = np.zeros((BINS + 1, n_langs)), np.zeros((BINS + 1, n_langs))
    order = np.random.default_rng(seed)

    def weights(zs, ns):
        w = -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(ns)) / ALPHA + L2)
        return np.where(np.abs(zs) <= L1, 0.0, w)

    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            bins, v, y = rows[k]
            at, x = np.r_[bins, BINS], np.r_[v, 1.0]  # the last row is the bias
            w = weights(z[at], n[at])
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    w = weights(z, n)
    return w[:BINS].astype(np.float32), w[BINS].astype(np.float32)


def calibrate(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss against smoothed targets, inside its bracket.

    Of N rows, a target is (N + 1) / (N + 2) for the row's class; the others
    share the rest. Logits that say nothing, or worse than nothing, have no least
    loss: then the temperature is the largest one tried.
    """
    n, k = logits.shape
    top = (n + 1) / (n + 2)
    target = np.full((n, k), (1 - top) / max(1, k - 1))
    target[np.arange(n), y] = top

    def loss(g: float) -> float:
        s = logits / np.exp(g)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - (target * s).sum(axis=1)).mean())

    low, high = -3.0, 3.0
    while high < 24:  # widen until the least value lies inside
        grid = np.linspace(low, high, 25)
        at = int(np.argmin([loss(g) for g in grid]))
        if 0 < at < 24:
            break
        low, high = low - 3, high + 3
    step = grid[1] - grid[0]
    low, high = grid[at] - step, grid[at] + step
    for _ in range(40):
        a, b = low + 0.382 * (high - low), low + 0.618 * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", key: Column | None = None, per_lang: int = PER_LANG, total: int = TOTAL) -> Model:
    """Learn from all given rows' text and non-null language; the sample is drawn by ``key`` (default: all columns) with text."""
    rows = rows.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    keys = [F.col(f"`{c}`") for c in rows.columns if not _maplike(rows.schema[c].dataType)] if key is None else [key]
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(*keys, F.col(text_col)).alias("key"))
    # different rows of each language; one row for each language comes to the driver
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("key").alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros(BINS), np.zeros((BINS, 0), np.float32), np.zeros(0, np.float32))
    langs = sorted(sizes)
    idf, n = _idf(rows.select("text"))
    each = min(per_lang, max(1, total // len(langs)))
    shares = rows.sparkSession.createDataFrame([(x, min(1.0, each / max(1, n))) for x, n in sizes.items()], "lang string, share double")
    draw = F.pmod(F.xxhash64("key", F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = rows.withColumn("draw", draw).join(F.broadcast(shares), "lang").filter("draw < share").drop("share")  # one row for each language
    drawn = drawn.distinct().orderBy("draw", "key").limit(2 * max(total, len(langs)))
    chosen = drawn.select("lang", "text", F.pmod(F.xxhash64("key", F.lit("part")), F.lit(5)).alias("part"))

    def make():
        def run(columns):
            found = [ngram_counts(x) for x in columns[1]]
            return [columns[0], columns[2], [b.astype("<u2").tobytes() for b, _ in found], [c.astype("<u4").tobytes() for _, c in found]]

        return run

    sample = map_rows(chosen, make, "lang string, part bigint, bins binary, counts binary").collect()
    sample.sort(key=lambda r: (r["lang"], r["part"], r["bins"], r["counts"]))  # row order must not matter
    model = Model(langs, idf, np.zeros((BINS, len(langs)), np.float32), np.zeros(len(langs), np.float32))
    model.common = float(np.log((1 + n) / (1 + max(2, n / RARE))) + 1 + 1e-9)
    number = {x: k for k, x in enumerate(langs)}
    read = [(np.frombuffer(r["bins"], "<u2").astype(np.int32), np.frombuffer(r["counts"], "<u4").astype(np.int64), number[r["lang"]], r["part"]) for r in sample if r["bins"]]
    made = [(b, model.vector(b, c), y, part) for b, c, y, part in read]
    train = [x[:3] for x in made if x[3] != 0] or [x[:3] for x in made]
    if train:
        model.weights, model.bias = ftrl(train, len(langs))
        model.familiar = FAMILIAR * float(np.median([model.known_share(b, c) for b, c, _, _ in read]))
    held = [x for x in made if x[3] == 0]
    if held and len(langs) > 1:
        model.temperature = calibrate(np.stack([v @ model.weights[b] + model.bias for b, v, _, _ in held]), np.array([x[2] for x in held]))
    return model


def _maplike(kind: T.DataType) -> bool:
    """Whether a column's type can't be hashed."""
    return "map<" in kind.simpleString() or "variant" in kind.simpleString()


def _idf(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Smoothed inverse document frequencies over all rows, and their number; each task sends one count for each bin."""
    ship_package(texts.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(BINS + 1, np.int64), 0
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                seen[ngram_counts(text)[0]] += 1
                n += 1
        seen[BINS] = n
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at])], names=["bin", "n"])

    found = texts.mapInArrow(run, "bin int, n bigint").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(BINS + 1)
    for r in found:
        df[r["bin"]] = r["n"]
    return np.log((1 + df[BINS]) / (1 + df[:BINS])) + 1, int(df[BINS])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def run(columns):
            found = [shared.value.predict(x) for x in columns[1]]
            return [columns[0], [a for a, _ in found], [b for _, b in found]]

        return run

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), make, f"doc_id {kind}, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text the model doesn't identify as learned languages; columns unchanged."""
    ship_package(docs.sparkSession)
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array([shared.value.accepts(x) for x in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def learnable(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows that may be learned from: those not held out by the id's checksum."""
    return docs.filter(id_remainder(id_col) != 2)
