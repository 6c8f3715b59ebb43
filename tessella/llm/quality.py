"""Quality classifier: a linear-chain conditional random field over the lines of a text.

Every line gets a label good or bad. Its features are shares of character classes, lengths and whether the
line stands elsewhere in the text too, of itself and of the lines before and after it; forward-backward
gives each line's marginal of being good. A document's quality is their mean, weighted by line length, put
on the scale of the labels by a logistic curve.

Training takes at most TRAIN_DOCS labelled documents (those of least hash), whose lines all carry their
document's label. Scoring is a map over all whole texts: no shuffle, and a model of a few kilobytes.

Null and empty texts are one empty line and get a score as any other. Repeated rows are each scored. With
no labelled document, or labels all alike, the score is the share of good labels (0.5 without any). Only the
id and text columns are read; label rows with null quality don't count, and a document with several labels
has their mean, good from 0.5 up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import buffers, rest, runs

#: Bound of the training sample: documents whose line features come to the driver.
TRAIN_DOCS = 4000
#: A document counts as good from this score.
GOOD = 0.7
BATCH_BYTES = 4 << 20
_CLASSES = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "!", "#*$%&^~@+", "|", ".", ",;:", "<>{}[]()=/\\_", "-'\"`?"]
_CLASS = np.full(256, len(_CLASSES) + 1, np.uint8)
for _k, _s in enumerate(_CLASSES):
    _CLASS[list(_s.encode())] = _k
_CLASS[[9, 11, 12, 13, 32]] = len(_CLASSES)
BASE = 2 * (len(_CLASSES) + 1) + 11
WIDTH = 3 * BASE + 3


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of the rows, the first line of each row (and the end), and the lines' lengths in bytes."""
    docs = len(offsets) - 1
    feeds = np.flatnonzero(data == 10)
    owner = np.searchsorted(offsets, feeds, "right") - 1
    order = np.argsort(np.concatenate([np.arange(docs), owner]), kind="stable")
    starts = np.concatenate([offsets[:-1], feeds + 1])[order]
    first = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=docs) + 1)])
    doc = np.repeat(np.arange(docs), np.diff(first))
    last = np.zeros(len(starts), bool)
    last[first[1:] - 1] = True
    ends = np.where(last, offsets[doc + 1], np.append(starts[1:], 0) - 1)
    n = (ends - starts).astype(np.float64)
    kind = _CLASS[data]
    pad = lambda x: np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
    within = lambda sums: (sums[ends] - sums[starts]).astype(np.float64)
    counts = [within(pad(kind == k)) for k in range(len(_CLASSES) + 1)]
    space = (kind == len(_CLASSES)) | (data == 10)
    begin = ~space
    begin[1:] &= space[:-1]
    words = np.maximum(within(pad(begin)), 0)
    some = np.maximum(n, 1)
    # A line's fingerprint is the sum of its words'; a word that repeats the one before it counts as an echo.
    at = np.flatnonzero(begin)
    value = (data.astype(np.int64) + 11) * ((data.astype(np.int64) * 2654435761) & 0xFFFF)
    value[space] = 0
    word = np.add.reduceat(value, at) if len(at) else np.zeros(0, np.int64)
    echo, sums = np.zeros(len(data), bool), np.zeros(len(data), np.int64)
    echo[at[1:]] = word[1:] == word[:-1]
    sums[at] = word
    echoes = within(pad(echo))
    key = ((pad(sums)[ends] - pad(sums)[starts]) * 1000003 + (ends - starts)) * 1000003 + doc
    _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
    again = (times[inverse] > 1) & (n > 0)
    tail = data[np.maximum(ends - 1, 0)] if len(data) else np.zeros(len(ends), np.uint8)
    cols = [c / some for c in counts] + [np.minimum(c, 8) / 8 for c in counts]
    mean_word = n / np.maximum(words, 1)
    cols += [echoes / np.maximum(words, 1), np.minimum(echoes, 8) / 8, np.log1p(n) / 8, np.log1p(words) / 6, np.minimum(mean_word, 40) / 40, again, np.log1p(times[inverse]) / 5, (n == 0), (n < 30), (tail == 46) & (n > 0), words <= 3]
    own = np.stack(cols, 1).astype(np.float32)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    heads = np.zeros(len(starts), bool)
    heads[first[:-1]] = True
    before[heads], after[last] = 0, 0
    edge = np.stack([heads, last, np.ones(len(starts))], 1).astype(np.float32)
    return np.concatenate([own, before, after, edge], 1), first, n


def marginals(unary: np.ndarray, first: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Each line's probability of being good, the expected transitions (2 x 2) and the log partition function, by
    forward-backward over all rows at once. unary: a good line's log-odds."""
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = first[:-1][order], lengths[order]
    alive = np.searchsorted(-lengths, -np.arange(int(lengths.max()) if len(lengths) else 0), "left")
    potential = np.stack([np.zeros_like(unary), unary], 1)
    alpha, beta = np.zeros_like(potential), np.zeros_like(potential)
    expected = np.zeros((2, 2))
    for t, k in enumerate(alive):
        at = starts[:k] + t
        if t == 0:
            alpha[at] = potential[at]
        else:
            prev = alpha[at - 1]
            alpha[at, 0] = np.logaddexp(prev[:, 0] + transition[0, 0], prev[:, 1] + transition[1, 0])
            alpha[at, 1] = np.logaddexp(prev[:, 0] + transition[0, 1], prev[:, 1] + transition[1, 1]) + unary[at]
    for t in range(len(alive) - 1, 0, -1):
        at = starts[: alive[t]] + t
        nxt = beta[at] + potential[at]
        beta[at - 1, 0] = np.logaddexp(nxt[:, 0] + transition[0, 0], nxt[:, 1] + transition[0, 1])
        beta[at - 1, 1] = np.logaddexp(nxt[:, 0] + transition[1, 0], nxt[:, 1] + transition[1, 1])
    log_z = np.logaddexp(alpha[:, 0] + beta[:, 0], alpha[:, 1] + beta[:, 1])
    good = np.exp(alpha[:, 1] + beta[:, 1] - log_z)
    later = np.ones(len(unary), bool)
    later[first[:-1]] = False
    at = np.flatnonzero(later)
    for a in range(2):
        for b in range(2):
            expected[a, b] = np.exp(alpha[at - 1, a] + transition[a, b] + potential[at, b] + beta[at, b] - log_z[at]).sum()
    return good, expected, float(log_z[first[:-1]].sum())


def weighted_mean(good: np.ndarray, length: np.ndarray, first: np.ndarray) -> np.ndarray:
    w = length + 1
    return np.add.reduceat(good * w, first[:-1]) / np.add.reduceat(w, first[:-1])


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


class LineField:
    """The fitted field: weights of a good line's log-odds, transition weights, and the curve to the labels' scale."""

    def __init__(self, weights, transition, mean, spread, curve):
        self.weights, self.transition, self.mean, self.spread, self.curve = weights, transition, mean, spread, curve

    def quality(self, features, first, length) -> np.ndarray:
        unary = ((features - self.mean) / self.spread) @ self.weights
        good, _, _ = marginals(np.clip(unary, -30, 30), first, self.transition)
        return weighted_mean(good, length, first)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        q = self.quality(*line_features(data, offsets))
        return 1 / (1 + np.exp(-(self.curve[0] * logit(q) + self.curve[1])))


def fit(features: list[np.ndarray], lengths: list[np.ndarray], labels: np.ndarray, steps: int = 60) -> LineField | float:
    """Weights by conditional likelihood on the even documents, the curve on the odd ones."""
    labels = np.asarray(labels, float)
    if len(labels) < 4 or labels.min() == labels.max():
        return float(labels.mean()) if len(labels) else 0.5
    side = np.zeros(len(labels), bool)
    for value in (0.0, 1.0):
        side[np.flatnonzero(labels == value)[::2]] = True

    def joined(which):
        first = np.concatenate([[0], np.cumsum([len(features[i]) for i in which])]).astype(np.int64)
        return np.concatenate([features[i] for i in which]).astype(np.float64), first, np.concatenate([lengths[i] for i in which])

    train, held = np.flatnonzero(side), np.flatnonzero(~side)
    x, first, length = joined(train)
    mean, spread = x.mean(0), x.std(0)
    constant = spread < 1e-9
    mean[constant], spread[constant] = 0, 1
    x = (x - mean) / spread
    counts = np.diff(first)
    y = np.repeat(labels[train], counts)
    # Each document weighs alike, and each label as much as the other.
    share = labels[train].mean()
    weight = np.repeat(np.where(labels[train] == 1, 0.5 / share, 0.5 / (1 - share)) / np.sqrt(counts), counts)
    w, t = np.zeros(x.shape[1]), np.eye(2)
    seen = np.zeros((2, 2))
    seen[0, 0], seen[1, 1] = (counts[labels[train] == 0] - 1).sum(), (counts[labels[train] == 1] - 1).sum()
    m, v = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    for step in range(1, steps + 1):
        good, expected, _ = marginals(np.clip(x @ w, -30, 30), first, t)
        grad = np.concatenate([x.T @ ((good - y) * weight) / len(train) + 1e-3 * w, ((expected - seen) / max(1, seen.sum()) + 1e-2 * t).ravel()])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, t = w - move[:-4], np.clip(t - move[-4:].reshape(2, 2), -3, 3)
    field = LineField(w, t, mean, spread, (1.0, 0.0))
    z, target = logit(field.quality(*joined(held))), labels[held]
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps on two numbers
        p = 1 / (1 + np.exp(-(a * z + b)))
        r, s = p - target, np.maximum(p * (1 - p), 1e-6)
        g = np.array([(r * z).sum() + 0.1 * (a - 1), r.sum() + 0.01 * b])
        h = np.array([[(s * z * z).sum() + 0.1, (s * z).sum()], [(s * z).sum(), s.sum() + 0.01]])
        d = np.linalg.solve(h, g)
        a, b = a - d[0], b - d[1]
        if abs(d).max() < 1e-6:
            break
    field.curve = (max(float(a), 0.05), float(b))
    return field


def held_out(doc_id: Column) -> Column:
    """Rows whose labels training never sees."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> LineField | float:
    """The field fitted on up to ``most`` documents with labels outside the held-out part."""
    known = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    texts = rest(docs, ["doc_id"], "text").join(F.broadcast(known), "doc_id").select("doc_id", "text", "label")

    def features(batches):
        for batch in batches:
            x, first, length = line_features(*buffers(batch.column(1)))
            blobs = [x[a:b].astype("<f4").tobytes() for a, b in zip(first[:-1], first[1:])]
            sizes = [length[a:b].astype("<f4").tobytes() for a, b in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(blobs, pa.binary()), pa.array(sizes, pa.binary())], ["doc_id", "label", "features", "lengths"])

    rows = {r.doc_id: r for r in texts.mapInArrow(features, "doc_id long, label int, features binary, lengths binary").toLocalIterator()}
    rows = [rows[k] for k in sorted(rows)]
    return fit([np.frombuffer(r.features, "<f4").reshape(-1, WIDTH) for r in rows], [np.frombuffer(r.lengths, "<f4").astype(float) for r in rows], np.array([r.label for r in rows]))


def score(docs: DataFrame, model: LineField | float) -> DataFrame:
    """``docs`` with the added columns score and predicted (replaced if they were there)."""
    schema = rest(docs, ["doc_id"], "text")

    def scored(batches):
        for batch in batches:
            data, offs = buffers(batch.column(1))
            for i, j in runs(offs, BATCH_BYTES):
                if isinstance(model, float):
                    s = np.full(j - i, model)
                else:
                    s = model.score(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(s), pa.array((s >= GOOD).astype(np.int32))], ["doc_id", "score", "predicted"])

    return schema.mapInArrow(scored, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the field fitted on ``labels`` predicts good, with all their columns."""
    model = train(docs, labels)
    at = docs.columns.index("text")

    def keep(batches):
        for batch in batches:
            data, offs = buffers(batch.column(at))
            for i, j in runs(offs, BATCH_BYTES):
                s = np.full(j - i, model) if isinstance(model, float) else model.score(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                if (s >= GOOD).any():
                    yield batch.slice(i, j - i).filter(pa.array(s >= GOOD))

    return docs.mapInArrow(keep, docs.schema)
