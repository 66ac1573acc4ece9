"""Quality of documents by a byte-level convolutional network in numpy.

The bytes of a text pass learned filters of ``WIDTH`` bytes, at every place. The responses are
max-pooled over overlapping chunks that cover the whole text (``CHUNK`` bytes, half of them shared
with the next). A hidden layer turns the pooled responses of a chunk into chunk features; their
mean and their maximum over all chunks of the text give one logistic probability. As a filter
on one-hot bytes is a sum of one table row per place, a response is a sum of ``WIDTH`` look-ups.

Training takes a bounded sample (``PER_LABEL`` rows of each label, of any length) of
rows that are not held out, on the driver, by Adam with weights that restore the shares of the
labels, so that the score is a probability. Of a text longer than ``ROW_BYTES`` it sees about so many
bytes: four spans, one from anywhere in each quarter. The model has a fixed size. Scoring reads whole
texts in pieces of bounded size.

Defined cases: null and empty texts are one chunk of zero bytes and get its score; without rows of both
labels the score is the share of label 1 (0.5 without any); a row with several labels counts
with each; repeated rows are scored each; other columns play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careline.llm.common import appended
from careline.llm.splits import held_out, sampled, spans

PER_LABEL, ROW_BYTES = 900, 12_000
FILTERS, WIDTH, HIDDEN = 16, 5, 16
CHUNK = 256
EPOCHS, BATCH, RATE = 8, 32, 0.02
#: Bytes whose responses are worked out at a time (they stay in the processor's cache), and bytes
#: of texts that are scored together.
PIECE, TOGETHER = 1 << 13, 1 << 20


@dataclass
class Network:
    tables: np.ndarray  # [WIDTH, 256, FILTERS]
    bias: np.ndarray
    hidden: np.ndarray  # [FILTERS, HIDDEN]
    hidden_bias: np.ndarray
    last: np.ndarray  # [2 * HIDDEN]
    last_bias: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.tables, self.bias, self.hidden, self.hidden_bias, self.last, self.last_bias]


def fresh(seed: int = 11) -> Network:
    rng = np.random.default_rng(seed)
    f = (lambda *s, scale: (rng.normal(size=s) * scale).astype(np.float32))
    return Network(f(WIDTH, 256, FILTERS, scale=0.3), np.zeros(FILTERS, np.float32),
                   f(FILTERS, HIDDEN, scale=0.4), np.zeros(HIDDEN, np.float32),
                   f(2 * HIDDEN, scale=0.2), np.zeros(1, np.float32))


def steps_of(size: np.ndarray) -> np.ndarray:
    """Half chunks of texts of so many bytes, two at least."""
    return np.maximum(-(-size // (CHUNK // 2)), 2)


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after another, each filled with zero bytes to whole half chunks and one more, which keeps
    filters from seeing the next text, then WIDTH - 1 more; and the half chunks of each text."""
    half = CHUNK // 2
    steps = steps_of(np.array([len(t) for t in texts]))
    data = b"".join(t.ljust(int(s + 1) * half, b"\0") for t, s in zip(texts, steps))
    return np.frombuffer(data + b"\0" * (WIDTH - 1), np.uint8), steps


def responses(net: Network, data: np.ndarray) -> np.ndarray:
    """[half chunk, place, filter] for bytes of whole half chunks and WIDTH - 1 more."""
    n = len(data) - WIDTH + 1
    out = net.tables[0][data[:n]]
    for k in range(1, WIDTH):
        out += net.tables[k][data[k:k + n]]
    return out.reshape(-1, CHUNK // 2, FILTERS)


def half_maxima(net: Network, data: np.ndarray) -> np.ndarray:
    """Largest response of each filter per half chunk, piece by piece."""
    n = len(data) - WIDTH + 1
    return np.concatenate([responses(net, data[a:min(a + PIECE, n) + WIDTH - 1]).max(1)
                           for a in range(0, n, PIECE)])


def chunk_rows(steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First half chunk of every chunk, and its text."""
    of = np.repeat(np.arange(len(steps)), steps - 1)
    first = np.cumsum(steps + 1) - (steps + 1)
    inside = np.arange(len(of)) - np.repeat(np.cumsum(steps - 1) - (steps - 1), steps - 1)
    return first[of] + inside, of


def probability(net: Network, halves: np.ndarray, steps: np.ndarray) -> np.ndarray:
    at, _ = chunk_rows(steps)
    pooled = np.maximum(np.maximum(halves[at], halves[at + 1]) + net.bias, 0)
    h = np.tanh(pooled @ net.hidden + net.hidden_bias)
    first = np.cumsum(steps - 1) - (steps - 1)
    mean = np.add.reduceat(h, first) / (steps - 1)[:, None]
    z = np.concatenate((mean, np.maximum.reduceat(h, first)), 1) @ net.last + net.last_bias
    return 1 / (1 + np.exp(-np.clip(z.astype(float), -30, 30)))


def score(net: Network, texts: list[str | None]) -> np.ndarray:
    out, held, n = [], [], 0
    for i, t in enumerate(texts):
        held.append((t or "").encode("utf-8", "surrogatepass"))
        n += len(held[-1])
        if n >= TOGETHER or i + 1 == len(texts):
            data, steps = laid_out(held)
            out.append(probability(net, half_maxima(net, data), steps))
            held, n = [], 0
    return np.concatenate(out) if out else np.empty(0)


def gradient(net: Network, texts: list[bytes], labels: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
    """Slopes of the weighted log loss of a batch."""
    data, steps = laid_out(texts)
    r = responses(net, data)
    place = r.argmax(1)  # [half chunk, filter]
    top = np.take_along_axis(r, place[:, None, :], 1)[:, 0]
    at, of = chunk_rows(steps)
    second = top[at + 1] > top[at]
    raw = np.where(second, top[at + 1], top[at]) + net.bias
    pooled = np.maximum(raw, 0)
    h = np.tanh(pooled @ net.hidden + net.hidden_bias)
    chunks = steps - 1
    first = np.cumsum(chunks) - chunks
    mean = np.add.reduceat(h, first) / chunks[:, None]
    most = np.maximum.reduceat(h, first)
    z = np.concatenate((mean, most), 1) @ net.last + net.last_bias
    error = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) * weights / len(texts)).astype(np.float32)
    g_last = np.concatenate((mean, most), 1).T @ error
    g_mean = error[:, None] * net.last[:HIDDEN] / chunks[:, None]
    winner = (h == most[of]).astype(np.float32)
    winner /= np.add.reduceat(winner, first)[of]
    g_h = g_mean[of] + winner * (error[:, None] * net.last[HIDDEN:])[of]
    g_in = g_h * (1 - h * h)
    g_pool = (g_in @ net.hidden.T) * (raw > 0)
    g_tables = np.zeros_like(net.tables)
    spot = np.where(second, (at + 1)[:, None] * (CHUNK // 2) + place[at + 1],
                    at[:, None] * (CHUNK // 2) + place[at])
    column = np.broadcast_to(np.arange(FILTERS), spot.shape)
    for k in range(WIDTH):
        cell = data[spot + k].astype(np.int64) * FILTERS + column
        g_tables[k] = np.bincount(cell.ravel(), g_pool.ravel(), 256 * FILTERS).reshape(256, FILTERS)
    return [g_tables, g_pool.sum(0), pooled.T @ g_in, g_in.sum(0), g_last, error.sum(keepdims=True)]


def train(rows: list[tuple[str, int, float]], epochs: int = EPOCHS, seed: int = 11) -> Network:
    """From (text, label, weight) rows."""
    net = fresh(seed)
    rows = sorted(rows)
    total = sum(w for _, _, w in rows)
    ones = sum(w for _, y, w in rows if y == 1)
    if not 0 < ones < total:
        share = (ones / total) if total else 0.5
        net.last[:] = 0
        net.last_bias[:] = np.log(np.clip(share, 1e-6, 1 - 1e-6) / np.clip(1 - share, 1e-6, 1))
        return net
    net.last_bias[:] = np.log(ones / (total - ones))
    texts = [t.encode("utf-8", "surrogatepass") for t, _, _ in rows]
    labels = np.array([y for _, y, _ in rows], np.float32)
    weights = np.array([w for _, _, w in rows]) * len(rows) / total
    rng = np.random.default_rng(seed)
    first, second = [np.zeros_like(p) for p in net.parts()], [np.zeros_like(p) for p in net.parts()]
    t = 0
    batches = -(-len(rows) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for b in range(0, len(rows), BATCH):
            pick = order[b:b + BATCH]
            slopes = gradient(net, [texts[i] for i in pick], labels[pick], weights[pick])
            t += 1
            rate = RATE * (1 - t / (epochs * batches + 1))
            for p, g, m, v in zip(net.parts(), slopes, first, second):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= (rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)).astype(np.float32)
    return net


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", per_label: int = PER_LABEL) -> Network:
    """A network of the labelled rows that are not held out."""
    known = labels.filter(~held_out(F.col(id_col)) & F.col(label_col).isin(0, 1)).select(
        F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    some, shares = sampled(known, "id", "label", per_label)  # a few thousand ids at most
    texts = docs.filter(F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # characters that hold ROW_BYTES bytes at the text's own bytes a character
    most = F.floor(ROW_BYTES * (F.length("text") / F.greatest(F.octet_length("text"), F.lit(1))))
    rows = texts.join(F.broadcast(some), "id").select("label", F.when(
        F.octet_length("text") <= ROW_BYTES, F.col("text")).otherwise(
            spans(F.col("text"), F.col("id"), most)).alias("text")).collect()
    return train([(r["text"], r["label"], 1 / shares[r["label"]]) for r in rows])


def with_quality(docs: DataFrame, net: Network, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (by default all) with score, which replaces a column of that name."""
    return appended(docs, text_col, "score double", lambda texts: [score(net, texts)], keep)
