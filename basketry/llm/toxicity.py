"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as a learned vector of its hash, the mean learned vector of its character 4-grams, and how much more often
the word and its strangest 4-gram occur in toxic documents of the training sample.  Windows of 24 words, half overlapping,
go through a gated recurrent layer in both directions; attention pools the states, and a dense layer gives the window's
log odds.  A document's score is that of its most toxic window, over all windows of the whole text.

Labels are known for documents only, so training goes in rounds: the likeliest windows of toxic documents are taken as
toxic, the likeliest and some random windows of others as clean, and the network is fitted to them.

Cases: null and empty texts and texts without words have the score ``empty``, the share of toxic documents in training;
short texts are one window; very long texts are scored whole; rows are independent; an empty table gives an empty table;
without labels of both kinds every document has the score 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.arrow_text import _LOWER, Slice, mix, ranks_within, text_slices, words_of
from basketry.llm.frames import extended_schema
from basketry.llm.labelled import fold, sample

#: labelled documents to learn from, and the most bytes one of them may have
SAMPLE_DOCS = 4000
SAMPLE_BYTES = 1 << 16
ROUNDS = 6
WINDOW, STRIDE = 24, 12
HIDDEN = 8
#: words and 4-grams of fewer documents of the sample say nothing
LEAST_SEEN = 3
#: documents of either label that any word is taken to be in besides those seen
PRIOR = 2.0
WORD_CELLS, GRAM_CELLS = 1 << 16, 1 << 18
WORD_VECTORS, GRAM_VECTORS, DIM = 1 << 14, 1 << 14, 4
GRAM = 4
IN = 2 * DIM + 2


@dataclass
class Tokens:
    """Distinct words of a slice with the cells of their hash and 4-grams, and every word as a number of a distinct one."""

    word: np.ndarray
    grams: np.ndarray
    gram_first: np.ndarray
    which: np.ndarray
    first: np.ndarray


def tokens_of(part: Slice) -> Tokens:
    words = words_of(part)
    hashes, at, which = np.unique(words.hashes, return_index=True, return_inverse=True)
    data = np.concatenate(([32], _LOWER[part.data], [32, 32, 32])).astype(np.uint64)
    # 4-grams of a word with one blank before and after it
    start, size = words.start[at], words.end[at] - words.start[at]
    counts = np.maximum(size + 2 - GRAM + 1, 1)
    places = np.repeat(start, counts) + ranks_within(counts)
    grams = np.zeros(len(places), np.uint64)
    for k in range(GRAM):
        byte = data[places + k]
        grams = grams << np.uint64(8) | np.where(byte <= 32, np.uint64(32), byte)
    return Tokens(hashes, mix(grams), np.concatenate(([0], np.cumsum(counts))), which, words.first)


def windows_of(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window its text, its word places and which of them exist; windows half overlap and cover all words."""
    n = np.diff(first)
    counts = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)), 0)
    owner = np.repeat(np.arange(len(n)), counts)
    start = first[:-1][owner] + ranks_within(counts) * STRIDE
    places = start[:, None] + np.arange(WINDOW)
    held = places < first[1:][owner][:, None]
    return owner, np.where(held, places, 0), held


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Network:
    """Parameters and passes; all arrays are 32-bit."""

    def __init__(self, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        h = HIDDEN

        def normal(*shape: int, scale: float) -> np.ndarray:
            return (rng.normal(size=shape) * scale).astype(np.float32)

        self.p = {
            "word": normal(WORD_VECTORS, DIM, scale=0.05),
            "gram": normal(GRAM_VECTORS, DIM, scale=0.05),
            "attend": normal(2 * h, 2 * h, scale=0.3),
            "query": normal(2 * h, scale=0.3),
            "dense": normal(2 * h, scale=0.3),
            "bias": np.zeros(1, np.float32),
        }
        for d in "fb":
            self.p |= {
                f"x{d}": normal(IN, 3 * h, scale=0.3),
                f"h{d}": normal(h, 3 * h, scale=0.3),
                f"c{d}": np.zeros(3 * h, np.float32),
            }
        self.word_odds = np.zeros(WORD_CELLS, np.float32)
        self.gram_odds = np.zeros(GRAM_CELLS, np.float32)
        self.word_known = np.zeros(WORD_CELLS, bool)
        self.gram_known = np.zeros(GRAM_CELLS, bool)
        self.less: list[tuple[np.ndarray, np.ndarray]] = []
        self.empty = 0.5

    def odds(self, t: Tokens, less: int | None = None) -> np.ndarray:
        """Per distinct word its own log odds and the largest of its 4-grams, in training as if the sample had one
        document of label ``less`` fewer.
        """
        word_odds, gram_odds = (self.word_odds, self.gram_odds) if less is None else self.less[less]
        grams = gram_odds[(t.grams % GRAM_CELLS).astype(np.int64)]
        top = np.maximum.reduceat(grams, t.gram_first[:-1]) if len(t.word) else np.zeros(0, np.float32)
        return np.stack([word_odds[(t.word % WORD_CELLS).astype(np.int64)], top], axis=1)

    def known(self, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """Columns that tell which words and 4-grams the sample has often enough."""
        words, grams = (t.word % WORD_CELLS).astype(np.int64), (t.grams % GRAM_CELLS).astype(np.int64)
        return self.word_known[words][:, None], self.gram_known[grams][:, None]

    def inputs(self, t: Tokens) -> np.ndarray:
        """Input vectors of the distinct words."""
        if not len(t.word):
            return np.zeros((0, IN), np.float32)
        word_known, gram_known = self.known(t)
        grams = self.p["gram"][(t.grams % GRAM_VECTORS).astype(np.int64)] * gram_known
        mean = np.add.reduceat(grams, t.gram_first[:-1], axis=0) / np.diff(t.gram_first)[:, None]
        word = self.p["word"][(t.word % WORD_VECTORS).astype(np.int64)] * word_known
        return np.concatenate([word, mean, self.odds(t)], axis=1).astype(np.float32)

    def _layer(self, d: str, gates: np.ndarray, held: np.ndarray, keep: list | None) -> np.ndarray:
        """States of one direction; gates are the input's share, by window and step."""
        h, n, steps = HIDDEN, len(gates), gates.shape[1]
        u, state = self.p[f"h{d}"], np.zeros((n, HIDDEN), np.float32)
        out = np.zeros((n, steps, h), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            own = state @ u
            zr = _sigmoid(gates[:, t, : 2 * h] + own[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            new = np.tanh(gates[:, t, 2 * h :] + r * own[:, 2 * h :])
            before, state = state, (new + z * (state - new)) * held[:, t : t + 1]
            out[:, t] = state
            if keep is not None:
                keep.append((t, before, z, r, new, own[:, 2 * h :]))
        return out

    def logits(self, x: np.ndarray, which: np.ndarray, held: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Log odds of windows; x are the input vectors of distinct words, ``which`` says which word stands where."""
        held = held.astype(np.float32)
        states = []
        for d in "fb":
            gates = (x @ self.p[f"x{d}"] + self.p[f"c{d}"])[which]
            steps: list | None = [] if keep is not None else None
            states.append(self._layer(d, gates, held, steps))
            if keep is not None:
                keep[d] = steps
        s = np.concatenate(states, axis=2)
        hidden = np.tanh(s @ self.p["attend"])
        score = hidden @ self.p["query"] - 1e4 * (1 - held)
        a = np.exp(score - score.max(axis=1, keepdims=True))
        a /= a.sum(axis=1, keepdims=True)
        pooled = (a[:, :, None] * s).sum(axis=1)
        if keep is not None:
            keep |= {"s": s, "hidden": hidden, "a": a, "pooled": pooled, "held": held}
        return pooled @ self.p["dense"] + self.p["bias"][0]

    def gradients(self, x: np.ndarray, which: np.ndarray, held: np.ndarray, y: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the mean log loss, for the parameters and for the input of every word place."""
        k: dict = {}
        logit = self.logits(x, which, held, k)
        g: dict[str, np.ndarray] = {}
        dl = (_sigmoid(logit) - y) / len(y)
        g["bias"], g["dense"] = dl.sum(keepdims=True), k["pooled"].T @ dl
        dp = dl[:, None] * self.p["dense"]
        ds = k["a"][:, :, None] * dp[:, None, :]
        da = (k["s"] * dp[:, None, :]).sum(axis=2)
        dscore = k["a"] * (da - (k["a"] * da).sum(axis=1, keepdims=True))
        g["query"] = np.einsum("bt,bth->h", dscore, k["hidden"])
        dhid = dscore[:, :, None] * self.p["query"] * (1 - k["hidden"] ** 2)
        g["attend"] = np.einsum("bti,btj->ij", k["s"], dhid)
        ds += dhid @ self.p["attend"].T
        h, dx = HIDDEN, np.zeros((*which.shape, IN), np.float32)
        for n, d in enumerate("fb"):
            u = self.p[f"h{d}"]
            g[f"h{d}"] = np.zeros_like(u)
            dgates = np.zeros((*which.shape, 3 * h), np.float32)
            later = np.zeros((len(y), h), np.float32)
            for t, before, z, r, new, own in reversed(k[d]):
                dstate = (ds[:, t, n * h : (n + 1) * h] + later) * k["held"][:, t : t + 1]
                dnew = dstate * (1 - z) * (1 - new**2)
                dz = dstate * (before - new) * z * (1 - z)
                dr = dnew * own * r * (1 - r)
                dgates[:, t] = np.concatenate([dz, dr, dnew], axis=1)
                down = np.concatenate([dz, dr, dnew * r], axis=1)
                g[f"h{d}"] += before.T @ down
                later = dstate * z + down @ u.T
            g[f"c{d}"] = dgates.sum(axis=(0, 1))
            g[f"x{d}"] = np.einsum("bti,btj->ij", x[which], dgates)
            dx += dgates @ self.p[f"x{d}"].T
        return g, dx

    def text_scores(self, part: Slice) -> np.ndarray:
        """Score of each text of a slice."""
        t = tokens_of(part)
        owner, places, held = windows_of(t.first)
        out = np.full(len(t.first) - 1, -np.inf)
        x = self.inputs(t)
        for at in range(0, len(owner), 4096):
            to = slice(at, at + 4096)
            np.maximum.at(out, owner[to], self.logits(x, t.which[places[to]], held[to]).astype(float))
        return np.where(np.diff(t.first) > 0, _sigmoid(out), self.empty)


def _slice(texts: list[bytes]) -> Slice:
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], names=["text"])
    return next(text_slices([batch], "text", limit=1 << 40))


def fit(texts: list[bytes], labels: np.ndarray, seed: int = 0, rounds: int = ROUNDS) -> Network:
    """Trains a network on whole documents."""
    rng, net = np.random.default_rng(seed), Network(seed)
    parts = []
    for at in range(0, len(texts), 2048):
        t = tokens_of(_slice(texts[at : at + 2048]))
        parts.append((t, *windows_of(t.first)))
    # in how many documents of either kind a word and a 4-gram occur
    seen = {name: np.zeros((2, cells)) for name, cells in (("word", WORD_CELLS), ("gram", GRAM_CELLS))}
    for n, (t, *_) in enumerate(parts):
        doc = np.repeat(np.arange(len(t.first) - 1), np.diff(t.first))
        y = labels[n * 2048 : n * 2048 + len(t.first) - 1]
        pairs = np.unique(doc * len(t.word) + t.which)
        d, w = pairs // len(t.word), pairs % len(t.word)
        grams = np.diff(t.gram_first)[w]
        spread = np.repeat(t.gram_first[:-1][w], grams) + ranks_within(grams)
        for name, cell, owner, cells in (
            ("word", (t.word % WORD_CELLS).astype(np.int64)[w], d, WORD_CELLS),
            ("gram", (t.grams % GRAM_CELLS).astype(np.int64)[spread], np.repeat(d, grams), GRAM_CELLS),
        ):
            once = np.unique(owner * cells + cell)
            for k in (0, 1):
                own = once[y[once // cells] == k] % cells
                seen[name][k] += np.bincount(own, minlength=cells)
    share = np.maximum(np.array([(labels == k).sum() for k in (0, 1)]), 1)

    def odds(counts: np.ndarray) -> np.ndarray:
        rate = (counts + PRIOR) / (share[:, None] + 2 * PRIOR)
        return (np.clip(np.log(rate[1] / rate[0]), -4, 4) / 4).astype(np.float32)

    for name, counts in seen.items():
        known = counts.sum(axis=0) >= LEAST_SEEN
        setattr(net, f"{name}_known", known)
        setattr(net, f"{name}_odds", odds(counts) * known)
    # a document's own words must not tell its label
    for k in (0, 1):
        minus = np.array([[1 - k], [k]])
        net.less.append(tuple(odds(np.maximum(seen[n] - minus, 0)) * getattr(net, f"{n}_known") for n in ("word", "gram")))

    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    for r in range(rounds):
        chosen = []
        for n, (t, owner, places, held) in enumerate(parts):
            y = labels[n * 2048 + owner]
            if r == 0:
                hint = net.odds(t).sum(axis=1)
                value = np.where(held, hint[t.which[places]], -9).max(axis=1) if len(owner) else np.zeros(0)
            else:
                x = net.inputs(t)
                value = np.concatenate([net.logits(x, t.which[places[a : a + 4096]], held[a : a + 4096]) for a in range(0, len(owner), 4096)] or [np.zeros(0)])
            order = np.lexsort((-value, owner))
            rank = np.empty(len(order), int)
            rank[order] = ranks_within(np.bincount(owner, minlength=len(t.first) - 1))
            take = (rank == 0) | ((y == 0) & ((rank == 1) | (rng.random(len(y)) < 0.05)))
            chosen += [(n, int(w), float(y[w])) for w in np.flatnonzero(take)]
        for _ in range(3):
            by_part = [np.array([c[1] for c in chosen if c[0] == n]) for n in range(len(parts))]
            batches = [(n, b) for n, ws in enumerate(by_part) if len(ws) for b in np.array_split(rng.permutation(ws), max(1, len(ws) // 128))]
            for b in rng.permutation(len(batches)):
                n, ws = batches[b]
                t, owner, places, held = parts[n]
                y = labels[n * 2048 + owner[ws]].astype(np.float32)
                which = t.which[places[ws]] * 2 + y.astype(np.int64)[:, None]
                local, back = np.unique(which, return_inverse=True)
                back, of_label, local = back.reshape(which.shape), local % 2, local // 2
                words = _sub(t, local)
                x = net.inputs(words)
                x[:, -2:] = np.where(of_label[:, None] == 1, net.odds(words, 1), net.odds(words, 0))
                g, dx = net.gradients(x, back, held[ws], y)
                _spread_inputs(net, g, t, local, back, dx)
                step += 1
                for name, value in g.items():
                    m, v = moments[name]
                    m *= 0.9
                    m += 0.1 * value
                    v *= 0.99
                    v += 0.01 * value * value
                    net.p[name] -= (0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    net.less = []
    net.empty = float(labels.mean())
    return net


def _sub(t: Tokens, local: np.ndarray) -> Tokens:
    """The tokens of some distinct words."""
    counts = np.diff(t.gram_first)[local]
    at = np.repeat(t.gram_first[:-1][local], counts) + ranks_within(counts)
    return Tokens(t.word[local], t.grams[at], np.concatenate(([0], np.cumsum(counts))), t.which[:0], t.first[:1])


def _spread_inputs(net: Network, g: dict, t: Tokens, local: np.ndarray, back: np.ndarray, dx: np.ndarray) -> None:
    """Adds the gradients of the word and 4-gram vectors."""
    s = _sub(t, local)
    total = np.zeros((len(local), IN), np.float32)
    np.add.at(total, back.ravel(), dx.reshape(-1, IN))
    g["word"], g["gram"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["gram"])
    word_known, gram_known = net.known(s)
    np.add.at(g["word"], (s.word % WORD_VECTORS).astype(np.int64), total[:, :DIM] * word_known)
    counts = np.diff(s.gram_first)
    each = np.repeat(total[:, DIM : 2 * DIM] / counts[:, None], counts, axis=0) * gram_known
    np.add.at(g["gram"], (s.grams % GRAM_VECTORS).astype(np.int64), each)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 3, held_out: int = 1,
          sample_docs: int = SAMPLE_DOCS, seed: int = 0) -> Network | None:
    """A network from a bounded sample of the labelled documents outside the held-out fold; None without both labels."""
    rows = sample(docs, labels, label, folds, held_out, sample_docs, seed)
    rows = rows.where(F.octet_length("text").between(1, SAMPLE_BYTES)).select(F.encode("text", "UTF-8").alias("text"), "label").distinct()
    rows = sorted((bytes(r[0]), r[1]) for r in rows.collect())
    y = np.array([r[1] for r in rows], float)
    if len(set(y)) < 2:
        return None
    order = np.random.default_rng(seed).permutation(len(rows))
    net = fit([rows[i][0] for i in order], y[order], seed)
    known = labels.where(F.col(label).isin(0, 1) & (fold("doc_id", folds) != held_out))
    net.empty = float(known.agg(F.avg(label)).first()[0])
    return net


def score(docs: DataFrame, net: Network | None, text: str = "text", out: str = "score") -> DataFrame:
    """Adds the toxicity of a text column, between 0 and 1."""
    schema = extended_schema(docs, {out: "double"})
    if net is None:
        return docs.withColumn(out, F.lit(0.5))
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for part in text_slices(batches, text):
            columns = [*part.batch.columns, pa.array(shared.value.text_scores(part), pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*part.batch.schema.names, out])

    return docs.mapInArrow(run, schema)
