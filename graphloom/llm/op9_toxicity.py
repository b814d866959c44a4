"""Toxicity: a bidirectional gated recurrent network with attention pooling over word and character inputs.

A word enters as its own embedding (words of the training vocabulary) beside the mean embedding of its character
n-grams (hashed trigrams, and beginnings of 4 to 9 bytes that the word goes on from), so unknown words and inflected
stems still speak through their letters.  The network reads windows of 64 words, one
every 16; attention pools the states of both directions; a document's score is calibrated from its highest window and
from how many windows speak up.  All
of it is trained in numpy on the driver, on a bounded sample of labelled rows outside the held-out fold (at most
``PER_CLASS`` documents and ``labelled.SAMPLE_BYTES`` of text of either label), every fourth of which only calibrates.
Labels stand for documents, so training looks for the telling window of each toxic document and takes any window of the
others.  Training has a fixed number of steps and depends on nothing but the sample.

Plan: one pass over the documents, no shuffle.  What a word contributes to the gates is computed once per distinct
word and remembered.

Cases: null, empty or wordless text: score 0.  Without labels of both kinds, or with fewer than ten texts to train on:
score 0 for all.  Documents labelled both ways teach nothing, equal texts of one label teach once, of repeated ids the
least text does.  Null doc_id and repeated rows: kept.  Empty table: no rows.  Very long texts: all windows.  Other
columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORDS, fold, id_and_text, read_table, rows_to_batch, small_batches
from .labelled import labelled_sample, linear, logistic, sigmoid

WINDOW, STRIDE = 64, 16
PER_CLASS = 1200
HIDDEN, DIM = 6, 4
VOCABULARY, GRAMS = 8192, 1 << 15
HEADS = range(4, 10)
LEAST_WORD, LEAST_GRAM = 6, 10  # documents in which a word or n-gram must be to have an embedding
STEPS = 240  # of training, in batches of windows
THRESHOLD = 0.5
LANES = 64  # words and windows go through products in multiples of so many: a few take other paths and round otherwise


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORDS).split()


def grams_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams of all words, one word after the other, and the number of each word's (at least 1)."""
    size = np.array([len(w) + 2 for w in words])
    data = np.frombuffer(b"".join([b"^" + w + b"$" for w in words]), np.uint8).astype(np.uint64)
    first = np.cumsum(size) - size
    word = np.repeat(np.arange(len(words)), size)
    at = np.arange(len(data)) - first[word]
    mul = np.uint64(0x9E3779B97F4A7C15)
    found, of = [], []

    def add(where, h):
        found.append(((h * mul) >> np.uint64(64 - 15)).astype(np.int64))
        of.append(word[where])

    tri = np.flatnonzero((at + 3 <= size[word]) | (at == 0))
    wide = np.r_[data, 0, 0].astype(np.uint64)
    add(tri, wide[tri] | wide[tri + 1] << np.uint64(8) | wide[tri + 2] << np.uint64(16))
    head, long = np.zeros(len(words), np.uint64), size - 2
    for k in range(1, HEADS[-1] + 1):
        on = np.flatnonzero(long > k)
        head[on] = head[on] * np.uint64(0x100000001B3) + data[first[on] + k] + np.uint64(1)
        if k in HEADS:
            add(first[on], head[on] ^ np.uint64(k << 56))
    found, of = np.concatenate(found), np.concatenate(of)
    return found[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(words))


def windows_of(n: int) -> list[int]:
    """Starts of all windows over n words; the last one ends with the text."""
    if n <= WINDOW:
        return [0]
    starts = list(range(0, n - WINDOW, STRIDE))
    return [*starts, n - WINDOW]


class Network:
    """Parameters in ``p``; words go in as rows of (word index, trigram list)."""

    def __init__(self, vocabulary: dict[bytes, int], seed: int = 11):
        rng = np.random.default_rng(seed)
        self.vocabulary = vocabulary
        d, h = 2 * DIM, HIDDEN
        normal = lambda *s, scale=0.3: (rng.standard_normal(s) * scale).astype(np.float32)
        self.p = {"word": normal(len(vocabulary) + 1, DIM, scale=0.05), "char": normal(GRAMS, DIM, scale=0.05)}
        for side in "fb":
            self.p |= {f"W{side}": normal(d, 3 * h), f"U{side}": normal(h, 3 * h), f"b{side}": np.zeros(3 * h, np.float32)}
        self.p |= {"A": normal(2 * h, h), "a": normal(h), "v": normal(2 * h), "c": np.zeros(1, np.float32)}
        self.calibration = np.array([1.0, 0.0, 0.0, 0.0])

    def inputs(self, words: list[bytes]) -> np.ndarray:
        """One row per word."""
        own = self.p["word"][[self.vocabulary.get(w, 0) for w in words]]
        flat, size = grams_of(words)
        char = np.add.reduceat(self.p["char"][flat], np.cumsum(size) - size) / size[:, None]
        return np.concatenate([own, char], 1).astype(np.float32)

    def gates(self, x: np.ndarray) -> dict[str, np.ndarray]:
        full = np.concatenate([x, np.zeros((-len(x) % LANES, x.shape[1]), x.dtype)])
        return {s: (full @ self.p[f"W{s}"])[: len(x)] + self.p[f"b{s}"] for s in "fb"}

    def states(self, gates: dict, at: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States of both directions (steps x 2h x windows); ``at`` has the gate rows of every window."""
        n, steps = at.shape
        h, out = HIDDEN, np.empty((steps, 2 * HIDDEN, n), np.float32)
        for k, s in enumerate("fb"):
            state, U = np.zeros((h, n), np.float32), np.ascontiguousarray(self.p[f"U{s}"].T)
            for t in range(steps) if s == "f" else range(steps - 1, -1, -1):
                g, r = np.ascontiguousarray(gates[s][at[:, t]].T), U @ state
                zr, m = g[: 2 * h], g[2 * h :]
                zr += r[: 2 * h]
                np.exp(np.negative(zr, out=zr), out=zr)
                zr += 1
                np.reciprocal(zr, out=zr)
                m += zr[h:] * r[2 * h :]
                m *= -2
                np.exp(m, out=m)
                m += 1
                np.divide(2, m, out=m)
                m -= 1
                new = zr[:h] * (state - m)
                new += m
                if keep is not None:
                    keep.append((s, t, state, zr, m, r[2 * h :]))
                out[t, k * h : (k + 1) * h] = state = new
        return out

    def pool(self, states: np.ndarray, real: np.ndarray):
        q = np.tanh(self.p["A"].T @ states)
        e = np.where(real.T, self.p["a"] @ q, np.float32(-1e9))
        w = np.exp(e - e.max(0))
        w /= w.sum(0)
        pooled = (w[:, None] * states).sum(0)
        return self.p["v"] @ pooled + self.p["c"], pooled, w, q

    def logits(self, gates: dict, at: np.ndarray, real: np.ndarray, chunk: int = 2048) -> np.ndarray:
        n, more = len(at), ((0, -len(at) % LANES), (0, 0))
        at, real = np.pad(at, more), np.pad(real, more)
        return np.concatenate([self.pool(self.states(gates, at[i : i + chunk]), real[i : i + chunk])[0] for i in range(0, len(at), chunk)])[:n]

    def gradients(self, x: np.ndarray, at: np.ndarray, real: np.ndarray, y: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the mean cross entropy: of the parameters above the inputs, and of every input row."""
        p, h, keep = self.p, HIDDEN, []
        gates = self.gates(x)
        states = self.states(gates, at, keep)
        z, pooled, w, q = self.pool(states, real)
        dz = ((sigmoid(z) - y) / len(y)).astype(np.float32)
        g = {k: np.zeros_like(v) for k, v in p.items() if k not in ("word", "char")}
        g["v"], g["c"] = pooled @ dz, np.array([dz.sum()], np.float32)
        dpool = p["v"][:, None] * dz
        ds = w[:, None] * dpool
        dw = (states * dpool).sum(1)
        de = w * (dw - (w * dw).sum(0))
        g["a"] = (de[:, None] * q).sum((0, 2))
        dq = de[:, None] * p["a"][:, None] * (1 - q * q)
        g["A"] = (states @ dq.transpose(0, 2, 1)).sum(0)
        ds += p["A"] @ dq
        dgates = {s: np.zeros_like(gates[s]) for s in "fb"}
        carry = {s: np.zeros((h, len(y)), np.float32) for s in "fb"}
        for s, t, state, zr, m, r in reversed(keep):
            k = 0 if s == "f" else h
            d = ds[t, k : k + h] + carry[s]
            zt, rt = zr[:h], zr[h:]
            dm = d * (1 - zt) * (1 - m * m)
            dzt, drt = d * (state - m) * zt * (1 - zt), dm * r * rt * (1 - rt)
            dr = np.concatenate([dzt, drt, dm * rt])
            g[f"U{s}"] += state @ dr.T
            carry[s] = d * zt + p[f"U{s}"] @ dr
            np.add.at(dgates[s], at[:, t], np.concatenate([dzt, drt, dm]).T)
        dx = np.zeros_like(x)
        for s in "fb":
            g[f"W{s}"], g[f"b{s}"] = x.T @ dgates[s], dgates[s].sum(0)
            dx += dgates[s] @ p[f"W{s}"].T
        return g, dx


def _layout(docs: list[list[int]], pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word rows of every window of every document (padded), which are real, and the window's document."""
    at, doc = [], []
    for k, rows in enumerate(docs):
        row = np.array(rows, np.int32)
        for s in windows_of(len(rows)):
            w = row[s : s + WINDOW]
            at.append(np.r_[w, np.full(WINDOW - len(w), pad, np.int32)] if len(w) < WINDOW else w)
            doc.append(k)
    at = np.array(at, np.int32).reshape(-1, WINDOW)
    return at, at != pad, np.array(doc)


def train(sample: list[tuple[str, int]], share: float | None = None, rounds: int = 2, steps: int = STEPS, batch: int = 64, rate: float = 0.01, decay: float = 0.002, seed: int = 5) -> Network | None:
    rng = np.random.default_rng(seed)
    docs, y = [], []
    for words, label in dict.fromkeys((tuple(words_of(text)), label) for text, label in sample):  # equal texts teach once
        if words:
            docs.append(list(words))
            y.append(label)
    tuned = set(range(0, len(docs), 4))  # every fourth document calibrates and teaches nothing
    kept_back, kept_labels = [docs[i] for i in sorted(tuned)], np.array([y[i] for i in sorted(tuned)])
    docs, y = [d for i, d in enumerate(docs) if i not in tuned], np.array([v for i, v in enumerate(y) if i not in tuned])
    if len(y) < 10 or len(set(y.tolist())) < 2:
        return None
    count = [Counter(), Counter()]
    for words, label in zip(docs, y):
        count[label].update(set(words))
    n0, n1 = (y == 0).sum(), (y == 1).sum()
    both = count[0] + count[1]
    frequent = sorted((w for w in both if both[w] >= LEAST_WORD), key=lambda w: (-both[w], w))[:VOCABULARY]
    net = Network({w: i + 1 for i, w in enumerate(frequent)})
    names = sorted({w for d in docs for w in d})
    row = {w: i for i, w in enumerate(names)}
    pad = len(names)
    word_id = np.array([net.vocabulary.get(w, 0) for w in names] + [0])
    flat, size = grams_of([*names, b""])
    begin = np.cumsum(size) - size
    # start: what a word tells by itself, shrunk where it is rare
    tell = np.array([np.log((count[1][w] + 4 * n1 / len(y)) / n1) - np.log((count[0][w] + 4 * n0 / len(y)) / n0) for w in frequent] or [0.0])
    net.p["word"][1 : len(frequent) + 1, 0] = np.clip(tell[: len(frequent)], -1, 4)
    telling = [np.zeros(GRAMS), np.zeros(GRAMS)]
    for words, label in zip(docs, y):
        rows = np.array(sorted({row[w] for w in words}))
        telling[label][np.unique(np.concatenate([flat[begin[r] : begin[r] + size[r]] for r in rows]))] += 1
    for_char = np.log((telling[1] + 4 * n1 / len(y)) / n1) - np.log((telling[0] + 4 * n0 / len(y)) / n0)
    common = (telling[0] + telling[1] >= LEAST_GRAM)[:, None]
    net.p["char"][:, 0] = np.clip(for_char, -1, 4)
    net.p["char"] *= common
    at, real, doc = _layout([[row[w] for w in d] for d in docs], pad)
    first = np.r_[0.0, tell][word_id] + np.maximum.reduceat(net.p["char"][flat, 0], begin)
    order = np.where(real, first[at], 0).max(1) + rng.random(len(at)) * 1e-3
    state, step = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}, 0
    for _ in range(rounds):
        by_doc = np.lexsort((-order, doc))
        best = by_doc[np.r_[True, doc[by_doc][1:] != doc[by_doc][:-1]]]  # the telling window of every document
        pos = best[y[doc[best]] == 1]
        other = np.flatnonzero(y[doc] == 0)
        neg = np.r_[best[y[doc[best]] == 0], rng.choice(other, min(len(other), 2 * len(pos) + 500), replace=False)]
        pick = np.r_[pos, neg]
        target = (y[doc[pick]] == 1).astype(np.float32)
        parts = max(1, len(pick) // batch)
        for _ in range(-(-steps // (rounds * parts))):
            for b in np.array_split(rng.permutation(len(pick)), parts):
                rows, local = np.unique(at[pick[b]], return_inverse=True)
                local = local.reshape(-1, WINDOW)
                own = net.p["word"][word_id[rows]]
                n = size[rows]
                spot = np.cumsum(n) - n
                mine = flat[np.repeat(begin[rows] - spot, n) + np.arange(n.sum())]
                char = (np.add.reduceat(net.p["char"][mine], spot) / n[:, None]).astype(np.float32)
                g, dx = net.gradients(np.concatenate([own, char], 1), local, real[pick[b]], target[b])
                g["word"], g["char"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["char"])
                np.add.at(g["word"], word_id[rows], dx[:, :DIM])
                g["word"][0] = 0
                np.add.at(g["char"], mine, np.repeat(dx[:, DIM:] / n[:, None], n, axis=0))
                g["char"] *= common
                step += 1
                for k, v in net.p.items():
                    m, s = state[k]
                    m += 0.1 * (g[k] - m)
                    s += 0.01 * (g[k] ** 2 - s)
                    v -= rate * decay * v + rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
        order = net.logits(net.gates(_table(net, names)), at, real)
    if len(set(kept_labels.tolist())) == 2:
        names = sorted({w for d in kept_back for w in d})
        row = {w: i for i, w in enumerate(names)}
        at, real, doc = _layout([[row[w] for w in d] for d in kept_back], len(names))
        docs, y, order = kept_back, kept_labels, net.logits(net.gates(_table(net, names)), at, real)
    net.calibration = logistic(pooled(order, doc, len(docs)), y, 0.1, share)
    return net


def pooled(z: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Per document: the highest window's logit, and the logarithms of the windows' summed and mean probability."""
    top, total = np.full(n, -np.inf), np.zeros(n)
    np.maximum.at(top, doc, z)
    np.add.at(total, doc, sigmoid(z.astype(np.float64)))
    return np.c_[np.clip(top, -12, 12), np.log(total + 1e-4), np.log(total / np.maximum(np.bincount(doc, minlength=n), 1) + 1e-4)]


def _table(net: Network, names: list[bytes]) -> np.ndarray:
    """Input rows of the words and, last, of the padding."""
    return np.concatenate([net.inputs(names), net.inputs([b""])]).astype(np.float32)


class Scorer:
    """Remembers the gate rows of the words it has met; the memo is cut when it grows beyond ``limit`` words."""

    def __init__(self, net: Network, limit: int = 200_000):
        self.net, self.limit = net, limit
        self.reset()

    def reset(self):
        self.row: dict[bytes, int] = {b"": 0}
        self.gates = self.net.gates(self.net.inputs([b""]))

    def score(self, texts: list[str | None]) -> list[float]:
        docs = [words_of(t) for t in texts]
        if len(self.row) > self.limit:
            self.reset()
        row = self.row
        new = [w for w in set().union(*docs) if w not in row]
        if new:
            more = self.net.gates(self.net.inputs(new))
            row.update(zip(new, range(len(row), len(row) + len(new))))
            self.gates = {s: np.concatenate([self.gates[s], more[s]]) for s in "fb"}
        some = [i for i, d in enumerate(docs) if d]
        out = [0.0] * len(docs)
        if some:
            at, real, doc = _layout([list(map(row.__getitem__, docs[i])) for i in some], 0)
            x, w = pooled(self.net.logits(self.gates, at, real), doc, len(some)), self.net.calibration
            for i, s in zip(some, sigmoid(linear(x, w))):
                out[i] = float(s)
        return out


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, modulus: int = 5) -> DataFrame:
    net = train(*labelled_sample(docs, labels, "toxic", per_class, modulus))
    shared = docs.sparkSession.sparkContext.broadcast(net)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches):
        scorer = Scorer(shared.value) if shared.value else None
        for rows in small_batches(batches, rows=256):
            scores = scorer.score([t for *_, t in rows]) if scorer else [0.0] * len(rows)
            yield rows_to_batch([(d, h, s, int(s >= THRESHOLD)) for (d, h, _), s in zip(rows, scores)], schema)

    rows = id_and_text(docs).select("doc_id", (fold("doc_id", modulus) == 0).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
