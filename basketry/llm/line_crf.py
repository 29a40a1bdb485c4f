"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad.  What speaks for either are features of the line and of the lines before and after it; what
ties lines together are transition weights.  Forward-backward gives each line's probability of being good, and a document's
quality is their mean weighted by line length.  Training maximises the likelihood of labelled documents, whose lines all
carry the document's label, by gradient steps in numpy on a bounded sample.

Cases: null and empty texts and texts of blank lines have no lines and get the quality ``empty``, the share of good
documents in training; very long texts are scored whole; rows are independent; an empty table gives an empty table;
without labels of both kinds every document gets the quality 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.arrow_text import Slice, text_slices, words_of
from basketry.llm.frames import extended_schema
from basketry.llm.labelled import sample

#: labelled documents to learn from, and the most lines one of them may have
SAMPLE_DOCS = 4000
SAMPLE_LINES = 400
EPOCHS = 30

_CLASSES = np.zeros(256, np.int64)  # letters and other bytes
_CLASSES[65:91] = 1
_CLASSES[48:58] = 2
_CLASSES[[ord(c) for c in "%$&*#@^~<>{}[]=_\\/+"]] = 3
_CLASSES[ord("!")] = 4
_CLASSES[ord("|")] = 5
_CLASSES[[ord(c) for c in ".,;:?'\"()-"]] = 6
_CLASSES[128:] = 7
_CLASSES[[9, 10, 11, 12, 13, 32]] = 8
_KINDS = 9
OWN = 13
NEIGHBOUR = (0, 2, 4, 5, 6, 9)
N_FEATURES = OWN + 2 * len(NEIGHBOUR) + 2


@dataclass
class Lines:
    """Lines with at least one word: their features and lengths, and for text i the lines first[i]..first[i + 1]."""

    features: np.ndarray
    lengths: np.ndarray
    first: np.ndarray


def lines_of(part: Slice) -> Lines:
    """The lines of all texts of a slice."""
    words = words_of(part, lower=False)
    breaks = part.data == 10
    breaks[part.end] = True  # the blank after each text
    ends = np.flatnonzero(breaks)
    starts = np.append(0, ends[:-1] + 1) if len(ends) else ends
    line = np.searchsorted(ends, words.start)
    n_words = np.bincount(line, minlength=len(ends))
    again = np.zeros(len(words.start), bool)
    if len(again):
        again[1:] = (words.hashes[1:] == words.hashes[:-1]) & (line[1:] == line[:-1])
    repeats = np.bincount(line, again, len(ends))
    kinds = np.zeros((_KINDS, len(part.data) + 1), np.int32)
    for k in range(_KINDS):
        np.cumsum(_CLASSES[part.data] == k, out=kinds[k, 1:])
    kept = np.flatnonzero(n_words)
    starts, ends, n_words, repeats = starts[kept], ends[kept], n_words[kept], repeats[kept]
    counts = (kinds[:, ends] - kinds[:, starts]).astype(float)
    size = np.maximum(ends - starts, 1).astype(float)
    last = _CLASSES[part.data[words.end[np.searchsorted(words.start, ends) - 1] - 1]] if len(kept) else kept
    own = np.stack(
        [
            np.log1p(size) / 8,
            np.log1p(n_words) / 6,
            counts[1] / size,
            counts[2] / size,
            counts[3] / size,
            counts[4] / size,
            counts[5] / np.maximum(n_words, 1),
            counts[6] / size,
            counts[7] / size,
            repeats / np.maximum(n_words, 1),
            np.minimum(size / np.maximum(n_words, 1), 40) / 10,
            (last == 6).astype(float),
            np.ones(len(kept)),
        ],
        axis=1,
    )
    first = np.searchsorted(starts, np.append(part.start, len(part.data)))
    near = own[:, NEIGHBOUR]
    before, after = np.zeros((len(kept), len(NEIGHBOUR) + 1)), np.zeros((len(kept), len(NEIGHBOUR) + 1))
    if len(kept):
        opens, closes = np.zeros(len(kept), bool), np.zeros(len(kept), bool)
        held = np.diff(first) > 0
        opens[first[:-1][held]] = True
        closes[first[1:][held] - 1] = True
        before[1:, :-1], after[:-1, :-1] = near[:-1], near[1:]
        before[opens] = after[closes] = 0
        before[opens, -1] = after[closes, -1] = 1
    return Lines(np.concatenate([own, before, after], axis=1), size, first)


@dataclass
class Model:
    """Weights for good over bad, start weight, transition weights [from, to] with 1 for good, feature scale."""

    weights: np.ndarray
    start: float
    moves: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    empty: float

    def emission(self, features: np.ndarray) -> np.ndarray:
        return ((features - self.mean) / self.scale) @ self.weights


def messages(e: np.ndarray, first: np.ndarray, start: float, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward log odds (with the line itself) and backward log odds of every line; all texts advance together."""
    forward, backward = e.copy(), np.zeros_like(e)
    counts = np.diff(first)
    order = np.argsort(-counts, kind="stable")
    begin, counts = first[:-1][order], counts[order]
    active = len(counts) - np.searchsorted(counts[::-1], np.arange(1, (counts[0] if len(counts) else 0) + 1))
    if len(active):
        forward[begin[: active[0]]] += start
    for t in range(1, len(active)):
        at = begin[: active[t]] + t
        r = forward[at - 1]
        forward[at] += np.logaddexp(r + moves[1, 1], moves[0, 1]) - np.logaddexp(r + moves[1, 0], moves[0, 0])
    for t in range(len(active) - 1, 0, -1):
        at = begin[: active[t]] + t
        q = e[at] + backward[at]
        backward[at - 1] = np.logaddexp(q + moves[1, 1], moves[1, 0]) - np.logaddexp(q + moves[0, 1], moves[0, 0])
    return forward, backward


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def quality(model: Model, lines: Lines) -> np.ndarray:
    """Length-weighted mean of the lines' probabilities of being good, per text."""
    e = model.emission(lines.features)
    forward, backward = messages(e, lines.first, model.start, model.moves)
    good = _sigmoid(forward + backward)
    owner = np.repeat(np.arange(len(lines.first) - 1), np.diff(lines.first))
    n = len(lines.first) - 1
    total = np.bincount(owner, lines.lengths, n)
    return np.where(total > 0, np.bincount(owner, lines.lengths * good, n) / np.maximum(total, 1), model.empty)


def fit(features: np.ndarray, first: np.ndarray, labels: np.ndarray, seed: int = 0, epochs: int = EPOCHS) -> Model:
    """Maximum likelihood by Adam on batches of documents; every document counts the same."""
    rng = np.random.default_rng(seed)
    mean, scale = features.mean(axis=0), features.std(axis=0)
    mean[OWN - 1], scale[scale < 1e-9] = 0.0, 1.0
    x = (features - mean) / scale
    theta = np.zeros(x.shape[1] + 5)
    m, v, step = np.zeros_like(theta), np.zeros_like(theta), 0
    counts = np.diff(first)
    docs = np.flatnonzero(counts)
    for _ in range(epochs):
        # documents of like length go together, batches come in random order
        order = docs[np.lexsort((rng.random(len(docs)), counts[docs]))]
        batches = np.array_split(order, max(1, len(order) // 128))
        for b in rng.permutation(len(batches)):
            own = batches[b]
            size = counts[own]
            rows = np.repeat(first[own], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            begin = np.concatenate(([0], np.cumsum(size)))
            part, y, weight = x[rows], np.repeat(labels[own], size), np.repeat(1 / size, size)
            w, start, moves = theta[:-5], theta[-5], theta[-4:].reshape(2, 2)
            e = part @ w
            forward, backward = messages(e, begin, start, moves)
            p = _sigmoid(forward + backward)
            grad = np.zeros_like(theta)
            grad[:-5] = ((y - p) * weight) @ part
            grad[-5] = ((y - p) * weight)[begin[:-1]].sum()
            inner = np.ones(len(rows), bool)
            inner[begin[1:] - 1] = False
            at = np.flatnonzero(inner)
            if len(at):
                q = e[at + 1] + backward[at + 1]
                joint = np.stack([np.zeros(len(at)), q, forward[at], forward[at] + q], axis=1) + theta[-4:]
                joint = np.exp(joint - joint.max(axis=1, keepdims=True))
                joint /= joint.sum(axis=1, keepdims=True)
                seen = np.zeros_like(joint)
                seen[np.arange(len(at)), np.where(y[at] == 1, 3, 0)] = 1
                grad[-4:] = weight[at] @ (seen - joint)
            grad = grad / len(own) - 1e-4 * theta
            step += 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            theta += 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(theta[:-5], float(theta[-5]), theta[-4:].reshape(2, 2), mean, scale, float(labels.mean()))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held_out: int = 0,
          sample_docs: int = SAMPLE_DOCS, seed: int = 0) -> Model | None:
    """A model from a bounded sample of the labelled documents outside the held-out fold; None without both labels.

    ``empty`` is the share of good ones among all labelled documents outside the fold.
    """
    from basketry.llm.labelled import fold

    def run(batches):
        for part in text_slices(batches, "text"):
            lines = lines_of(part)
            counts = np.diff(lines.first)
            rows = [x.astype(np.float64).ravel() for x in np.split(lines.features, lines.first[1:-1])]
            out = pa.RecordBatch.from_arrays(
                [part.batch.column(0), pa.array(rows, pa.list_(pa.float64())), part.batch.column(2)], names=["doc_id", "x", "y"]
            )
            yield out.filter(pa.array((counts > 0) & (counts <= SAMPLE_LINES)))

    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = sample(docs, labels, label, folds, held_out, sample_docs, seed)
    rows = rows.mapInArrow(run, f"doc_id {id_type}, x array<double>, y int").toPandas()
    y = rows["y"].to_numpy(float)
    if len(set(y)) < 2:
        return None
    rows = rows.sort_values("doc_id", kind="stable")
    y = rows["y"].to_numpy(float)
    x = [np.asarray(r).reshape(-1, N_FEATURES) for r in rows["x"]]
    first = np.concatenate(([0], np.cumsum([len(r) for r in x])))
    model = fit(np.concatenate(x), first, y, seed)
    known = labels.where(F.col(label).isin(0, 1) & (fold("doc_id", folds) != held_out))
    model.empty = float(known.agg(F.avg(label)).first()[0])
    return model


def score(docs: DataFrame, model: Model | None, text: str = "text", out: str = "score") -> DataFrame:
    """Adds the quality of a text column, between 0 and 1."""
    schema = extended_schema(docs, {out: "double"})
    if model is None:
        return docs.withColumn(out, F.lit(0.5))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for part in text_slices(batches, text):
            values = np.clip(quality(shared.value, lines_of(part)), 0.0, 1.0)
            columns = [*part.batch.columns, pa.array(values, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*part.batch.schema.names, out])

    return docs.mapInArrow(run, schema)
