"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes go through ``FILTERS`` learned filters of ``WIDTH`` bytes
(one weight for each offset, byte value and filter), then a rectifier. The
document is covered by chunks of ``CHUNK`` bytes that overlap by half; each
filter is max-pooled over a chunk, and the chunks' maxima are combined by their
mean and their maximum over the whole document into one logistic output. Every
byte takes part; long texts are read in pieces, so memory stays bounded.

Learning: Adam on a bounded sample of labelled rows, ``PER_CLASS`` different
ones of each class in expectation and ``2 * PER_CLASS`` each at most (drawn by
hash of the id, texts of at most ``TRAIN_BYTES``), with gradients flowing through
the maxima alone and both classes weighing the same; the bias then takes up the
class shares of all labels. A fifth of the sample only validates: of the epochs,
the one with the least loss on that fifth is kept. Nothing is chosen by any
other row.

Scoring adds byte-pair tables of the filters (two offsets in one lookup), so a
byte costs ``WIDTH / 2`` gathers. Narrow: one pass, no shuffle.

Edge cases: null and empty texts are one chunk of padding and get its score;
without labels of both classes the score is the share of label 1 (one half
without any); labels other than 0 and 1 are ignored; an id with both labels is
an example of each; rows repeated in either table are one example; only the
named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, whole

FILTERS, WIDTH = 16, 6
CHUNK = 512
STRIDE = CHUNK // 2
#: Sample bound: expected labelled rows of each class, and the longest text that may be drawn.
PER_CLASS, TRAIN_BYTES = 1000, 1 << 16
EPOCHS, BATCH, RATE = 6, 32, 0.01
#: Texts shown in training at least: small samples may be passed over more often; validation picks the epoch.
SHOWN = 12_000
#: One in so many sampled rows validates.
VALIDATE = 5
#: Bytes handled at once; a multiple of the stride.
PIECE = 1 << 19
#: Score from which the label is predicted.
CUT = 0.7


@dataclass
class Net:
    filters: np.ndarray  # WIDTH x 256 x FILTERS
    bias: np.ndarray  # FILTERS
    out: np.ndarray  # 2 * FILTERS: weights of the mean and of the maximum over chunks
    out_bias: float

    def __post_init__(self):
        self.pairs = None

    def tables(self) -> list[np.ndarray]:
        """For each two offsets, the sum of their weights by byte pair (first byte low)."""
        if self.pairs is None:
            f = self.filters.astype(np.float32)
            self.pairs = [(f[2 * k][None, :, :] + f[2 * k + 1][:, None, :]).reshape(65536, -1) for k in range(WIDTH // 2)]
        return self.pairs

    def conv(self, b: np.ndarray, n: int) -> np.ndarray:
        """Filter answers at the first ``n`` places of the bytes ``b`` (``n + WIDTH - 1`` of them)."""
        pair = b[:-1].astype(np.uint16) | b[1:].astype(np.uint16) << np.uint16(8)
        out = np.take(self.tables()[0], pair[:n], axis=0)
        for k in range(1, WIDTH // 2):
            out += np.take(self.tables()[k], pair[2 * k : 2 * k + n], axis=0)
        return out

    def halves(self, data: bytes) -> np.ndarray:
        """Maximum of each filter over each half chunk, before the rectifier."""
        n = max(1, -(-len(data) // STRIDE)) * STRIDE
        b = np.zeros(n + WIDTH - 1, np.uint8)
        b[: len(data)] = np.frombuffer(data, np.uint8)
        found = [self.conv(b[at : (to := min(n, at + PIECE)) + WIDTH - 1], to - at).reshape(-1, STRIDE, FILTERS).max(axis=1) for at in range(0, n, PIECE)]
        return np.concatenate(found) if len(found) > 1 else found[0]

    def features(self, data: bytes) -> np.ndarray:
        half = np.maximum(self.halves(data) + self.bias, 0)
        pooled = np.maximum(half[:-1], half[1:]) if len(half) > 1 else half
        return np.concatenate([pooled.mean(axis=0), pooled.max(axis=0)])

    def score(self, text: str | None) -> float:
        x = float(self.features((text or "").encode("utf-8", "replace")) @ self.out + self.out_bias)
        return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


def fresh(seed: int = 11) -> Net:
    r = np.random.default_rng(seed)
    return Net(r.normal(0, 0.25, (WIDTH, 256, FILTERS)), np.zeros(FILTERS), r.normal(0, 0.1, 2 * FILTERS), 0.0)


def _traced(net: Net, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Half-chunk maxima before the rectifier, and the places that gave them."""
    n = len(data) - WIDTH + 1
    y = net.filters[0][data[:n]]
    for k in range(1, WIDTH):
        y = y + net.filters[k][data[k : k + n]]
    y = y.reshape(-1, STRIDE, FILTERS)
    at = y.argmax(axis=1)
    return np.take_along_axis(y, at[:, None, :], 1)[:, 0, :], at + np.arange(len(y))[:, None] * STRIDE


def train(texts: list[str], labels: list[int], epochs: int | None = None, seed: int = 11, prior: float | None = None) -> Net:
    """Fit on whole texts; Adam over mini-batches, gradients through the pooled places.

    Both classes weigh the same; ``prior``, the share of label 1 among all
    labels (default: among the given ones), then sets the bias. Unless the
    number of epochs is given, every ``VALIDATE``-th text of each class is left
    out of the gradients and picks the epoch.
    """
    net, r = fresh(seed), np.random.default_rng(seed)
    share = float(np.mean(labels)) if labels else 0.5
    if len(set(labels)) < 2:
        flat = Net(np.zeros_like(net.filters), net.bias, np.zeros_like(net.out), 0.0)
        flat.out_bias = float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)).clip(-8, 8))
        return flat
    checked: list[int] = []
    if epochs is None:
        epochs = max(EPOCHS, -(-SHOWN // len(texts)))
        checked = [k for y in (0, 1) for k in r.permutation([j for j, z in enumerate(labels) if z == y])[VALIDATE - 1 :: VALIDATE].tolist()]
    shown = np.array(sorted(set(range(len(texts))) - set(checked)))
    weight, prior = (0.5 / (1 - share), 0.5 / share), share if prior is None else prior
    data = []
    for text in texts:
        raw = text.encode("utf-8", "replace")
        n = max(1, -(-len(raw) // STRIDE)) * STRIDE
        b = np.zeros(n + WIDTH - 1, np.uint8)
        b[: len(raw)] = np.frombuffer(raw, np.uint8)
        data.append(b)
    net.filters = net.filters.astype(np.float32)
    held = {"filters": net.filters, "bias": net.bias, "out": net.out, "out_bias": np.zeros(1)}
    first, second, step = {k: np.zeros_like(v) for k, v in held.items()}, {k: np.zeros_like(v) for k, v in held.items()}, 0
    best = None
    for epoch in range(epochs):
        order = r.permutation(shown)
        rate = RATE * (1 - epoch / epochs)
        for start in range(0, len(order), BATCH):
            grads = {k: np.zeros_like(v) for k, v in held.items()}
            batch = order[start : start + BATCH]
            for k in batch:
                peak, place = _traced(net, data[k])
                half = np.maximum(peak + net.bias, 0)
                two = len(half) > 1
                pooled = np.maximum(half[:-1], half[1:]) if two else half
                mean, most, top = pooled.mean(axis=0), pooled.max(axis=0), pooled.argmax(axis=0)
                x = mean @ net.out[:FILTERS] + most @ net.out[FILTERS:] + held["out_bias"][0]
                d = (1 / (1 + np.exp(-np.clip(x, -30, 30))) - labels[k]) * weight[labels[k]]
                grads["out"] += d * np.concatenate([mean, most])
                grads["out_bias"] += d
                back = np.tile(d * net.out[:FILTERS] / len(pooled), (len(pooled), 1))
                back[top, np.arange(FILTERS)] += d * net.out[FILTERS:]
                down = np.zeros_like(half)
                if two:
                    left = half[:-1] >= half[1:]
                    down[:-1] += back * left
                    down[1:] += back * ~left
                else:
                    down += back
                down *= half > 0
                grads["bias"] += down.sum(axis=0)
                h, f = np.nonzero(down)
                g, p = down[h, f], place[h, f]
                for o in range(WIDTH):
                    np.add.at(grads["filters"][o], (data[k][p + o], f), g)
            step += 1
            for name, value in held.items():
                g = grads[name] / len(batch)
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.99 * second[name] + 0.01 * g * g
                value -= (rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-7)).astype(value.dtype)
        if checked:
            now = Net(net.filters.copy(), net.bias.copy(), net.out.copy(), float(held["out_bias"][0]))
            logits = np.array([now.features(texts[k].encode("utf-8", "replace")) @ now.out + now.out_bias for k in checked])
            y = np.array([labels[k] for k in checked])
            loss = float((np.logaddexp(0, np.where(y == 1, -logits, logits)) * np.where(y == 1, weight[1], weight[0])).mean())
            if best is None or loss < best[0]:
                best = loss, now
    kept = best[1] if best else Net(net.filters, net.bias, net.out, float(held["out_bias"][0]))
    kept.out_bias = float(kept.out_bias + np.log(prior / (1 - prior)))
    kept.pairs = None
    return kept


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", learn: Column | None = None, per_class: int = PER_CLASS) -> Net:
    """Learn from documents that have a label; ``learn`` (of the labels' columns) says which rows may be used."""
    marked = labels if learn is None else labels.filter(learn)
    marked = marked.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("y")).filter("__id IS NOT NULL AND y IN (0, 1)").distinct()
    sizes = {r["y"]: r["count"] for r in marked.groupBy("y").count().collect()}
    if not sizes:
        return train([], [])
    share = F.when(F.col("y") == 1, F.lit(min(1.0, per_class / sizes.get(1, 1)))).otherwise(F.lit(min(1.0, per_class / sizes.get(0, 1))))
    draw = F.pmod(F.xxhash64("__id", F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # no id twice with a label, and a limit: at most 4 * per_class rows, hence a safe broadcast
    chosen = marked.withColumn("draw", draw).filter(F.col("draw") < share).orderBy("draw", "__id", "y").limit(4 * per_class)
    read = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("text")).filter(F.octet_length("text") <= TRAIN_BYTES)
    rows = read.join(F.broadcast(chosen), F.col("__doc") == F.col("__id")).select("text", "y", "draw").distinct().orderBy("draw", "text", "y").limit(4 * per_class).collect()
    rows.sort(key=lambda r: (r["text"], r["y"]))  # row order must not matter
    prior = sizes.get(1, 0) / sum(sizes.values())
    return train([r["text"] for r in rows], [r["y"] for r in rows], prior=prior if 0 < prior < 1 else None)


def score(docs: DataFrame, net: Net, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def make():
        def run(columns):
            return [columns[0], [shared.value.score(x) for x in columns[1]]]

        return run

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text")), make, f"doc_id {kind}, score double")
