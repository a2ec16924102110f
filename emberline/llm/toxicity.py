"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input joins its own embedding (a small vocabulary of telling words, the rest by hash) and
the mean embedding of its character trigrams. A gated recurrent layer reads each window of words in
both directions, attention pools its states, and a logistic output scores the window. Every word of
a text lies in overlapping windows, all are scored, and the largest score is the document's.

Training needs labels for documents only: in each epoch a document's label goes to the window that
the network scores highest, and clean documents give a further window at random. It uses a bounded
sample of labelled documents (`most_toxic`, `most_clean`, of those with at most `longest_training` characters)
outside the held-out fold, crc32(doc_id as text) mod 5 = 0. Part of the sample calibrates.
Scores never use labels, lang, source or doc_id.

Cases: null and empty texts have one window without words. Repeated rows score alike. Without labels of
both classes every score is the share of toxic labels (0 without labels). Texts are scored whole. An empty table gives no rows.

Word embeddings don't start at random alone: a telling word's first component starts at its log-odds between toxic and clean documents of the sample.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import texts

SPAN, STRIDE = 32, 24
_H, _WORD_DIM, _CHAR_DIM, _ATTENTION = 8, 8, 8, 8
_KNOWN, _HASHED, _GRAMS = 1000, 512, 2048
_MEMO = 250_000
_split = re.compile(r"[^\W_]+")
FOLDS = 5
#: Runs without a space (unspaced scripts, say) are read in pieces.
_RUN, _LAP = 40, 10


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Reader:
    """Words to rows of the two embedding tables."""

    def __init__(self, vocabulary: dict[str, int]):
        self.vocabulary = vocabulary

    def word(self, word: str) -> int:
        k = self.vocabulary.get(word)
        return _KNOWN + zlib.crc32(word.encode("utf-8", "replace")) % _HASHED if k is None else k

    @staticmethod
    def grams(word: str) -> list[int]:
        marked = f"<{word}>".encode("utf-8", "replace")
        return [zlib.crc32(marked[i : i + 3]) % _GRAMS for i in range(max(1, len(marked) - 2))]


def words_of(text: str) -> list[str]:
    """Runs of letters and digits; a run over _RUN characters becomes pieces that overlap by _LAP."""
    found = _split.findall(text.lower())
    if found and max(map(len, found)) > _RUN:
        return [w[i : i + _RUN] for w in found for i in range(0, max(1, len(w) - _LAP), _RUN - _LAP)]
    return found


def windows(ids: np.ndarray) -> np.ndarray:
    """Overlapping windows of SPAN ids, -1 where there is no word."""
    n = len(ids)
    count = max(1, -(-max(0, n - SPAN) // STRIDE) + 1)
    at = np.arange(count)[:, None] * STRIDE + np.arange(SPAN)
    return np.where(at < n, np.append(ids, -1)[np.minimum(at, n)], -1)


class Network:
    def __init__(self, reader: Reader, seed: int = 3, lead: np.ndarray | None = None):
        rng, d = np.random.default_rng(seed), _WORD_DIM + _CHAR_DIM
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.reader = reader
        self.w = {
            "words": rng.standard_normal((_KNOWN + _HASHED, _WORD_DIM)).astype(np.float32) * 0.1,
            "grams": rng.standard_normal((_GRAMS, _CHAR_DIM)).astype(np.float32) * 0.1,
            "a": draw(2 * _H, _ATTENTION), "v": draw(_ATTENTION), "o": draw(2 * _H), "b": np.zeros(1, np.float32),
        }
        for side in "fb":
            self.w |= {f"W{side}": draw(d, 3 * _H), f"U{side}": draw(_H, 3 * _H), f"c{side}": np.zeros(3 * _H, np.float32)}
        if lead is not None:
            self.w["words"][: len(lead), 0] = lead
        self.slope, self.offset = 1.0, 0.0

    def embed(self, found: list[str]) -> np.ndarray:
        w = self.w
        own = w["words"][[self.reader.word(x) for x in found]]
        grams = [self.reader.grams(x) for x in found]
        flat, sizes = np.concatenate([np.array(g) for g in grams]), np.array([len(g) for g in grams])
        return np.c_[own, np.add.reduceat(w["grams"][flat], np.r_[0, np.cumsum(sizes)[:-1]]) / sizes[:, None]].astype(np.float32)

    def _pass(self, x: np.ndarray, mask: np.ndarray, u: np.ndarray, keep: bool):
        """States of one direction. x: inputs of the gates by step [SPAN, n, 3H]; mask [SPAN, n, 1]."""
        h, out, past = np.zeros((x.shape[1], _H), np.float32), [], []
        for t in range(SPAN):
            g = h @ u
            zr = _sigmoid(x[t, :, : 2 * _H] + g[:, : 2 * _H])
            z, r, gn = zr[:, :_H], zr[:, _H:], g[:, 2 * _H :]
            n = np.tanh(x[t, :, 2 * _H :] + r * gn)
            new = n + z * (h - n)
            if keep:
                past.append((h, z, r, gn, n))
            h = np.where(mask[t], new, h)
            out.append(h)
        return np.stack(out), past

    def _pool(self, states: np.ndarray, mask: np.ndarray):
        e = np.tanh(states @ self.w["a"])
        s = np.where(mask[..., 0], e @ self.w["v"], -30.0)
        a = np.exp(s - s.max(0))
        a = (a / a.sum(0)).astype(np.float32)
        pooled = (a[..., None] * np.where(mask, states, 0)).sum(0)
        return pooled @ self.w["o"] + self.w["b"][0], pooled, a, e

    def logits(self, gates: dict[str, np.ndarray], ids: np.ndarray) -> np.ndarray:
        """Scores of windows; gates holds each word's gate inputs by direction, with a row of zeros last."""
        both = []
        mask = (ids >= 0).T[..., None]
        for side, order in (("f", slice(None)), ("b", slice(None, None, -1))):
            x = gates[side][ids.T[order]]
            both.append(self._pass(x, mask[order], self.w[f"U{side}"], False)[0][order])
        return self._pool(np.concatenate(both, 2), mask)[0]

    def gates(self, embedded: np.ndarray) -> dict[str, np.ndarray]:
        zero = np.zeros((1, 3 * _H), np.float32)
        return {s: np.r_[embedded @ self.w[f"W{s}"] + self.w[f"c{s}"], zero] for s in "fb"}

    def step(self, ids: np.ndarray, y: np.ndarray, own: np.ndarray, grams: list[np.ndarray]) -> dict[str, np.ndarray]:
        """Gradients of the mean log-loss of windows (ids into own and grams, the rows of their words)."""
        w, n = self.w, len(ids)
        sizes = np.array([len(g) for g in grams])
        flat = np.concatenate(grams)
        table = np.c_[w["words"][own], np.add.reduceat(w["grams"][flat], np.r_[0, np.cumsum(sizes)[:-1]]) / sizes[:, None]].astype(np.float32)
        gates, mask = self.gates(table), (ids >= 0).T[..., None]
        passes, both = {}, []
        for side, order in (("f", slice(None)), ("b", slice(None, None, -1))):
            states, past = self._pass(gates[side][ids.T[order]], mask[order], w[f"U{side}"], True)
            passes[side] = past
            both.append(states[order])
        states = np.concatenate(both, 2)
        logit, pooled, a, e = self._pool(states, mask)
        d = ((_sigmoid(logit) - y) / n).astype(np.float32)
        grad = {"o": pooled.T @ d, "b": np.array([d.sum()])}
        dp = d[:, None] * w["o"]
        live = np.where(mask, states, 0)
        da = (live * dp).sum(2)
        ds = a * (da - (a * da).sum(0))
        grad["v"] = np.einsum("tn,tnk->k", ds, e)
        de = ds[..., None] * w["v"] * (1 - e * e)
        grad["a"] = np.einsum("tnh,tnk->hk", states, de)
        dstates = np.where(mask, a[..., None] * dp, 0) + de @ w["a"].T
        dtable = np.zeros_like(table)
        for k, (side, order) in enumerate((("f", slice(None)), ("b", slice(None, None, -1)))):
            u, m, dh = w[f"U{side}"], mask[order], np.zeros((n, _H), np.float32)
            dout, steps = dstates[order][..., k * _H : (k + 1) * _H], ids.T[order]
            du, dgates = np.zeros_like(u), np.zeros((len(table) + 1, 3 * _H), np.float32)
            for t in range(SPAN - 1, -1, -1):
                h, z, r, gn, cand = passes[side][t]
                dh = dh + dout[t]
                dnew = np.where(m[t], dh, 0)
                dcand = dnew * (1 - z) * (1 - cand * cand)
                dz = dnew * (h - cand) * z * (1 - z)
                dr = dcand * gn * r * (1 - r)
                dg = np.concatenate([dz, dr, dcand * r], 1)
                du += h.T @ dg
                np.add.at(dgates, steps[t], np.concatenate([dz, dr, dcand], 1))
                dh = np.where(m[t], 0, dh) + dnew * z + dg @ u.T
            dgates = dgates[:-1]
            grad |= {f"U{side}": du, f"W{side}": table.T @ dgates, f"c{side}": dgates.sum(0)}
            dtable += dgates @ w[f"W{side}"].T
        grad["words"], grad["grams"] = np.zeros_like(w["words"]), np.zeros_like(w["grams"])
        np.add.at(grad["words"], own, dtable[:, :_WORD_DIM])
        np.add.at(grad["grams"], flat, np.repeat(dtable[:, _WORD_DIM:] / sizes[:, None], sizes, 0))
        return grad


def fit(docs: list[str], y: np.ndarray, epochs: int = 6, least_steps: int = 400, batch: int = 96, rate: float = 0.01, seed: int = 3) -> Network:
    """Train on whole documents with labels 0 and 1. Every fifth document calibrates only.

    There are at least `epochs` epochs, and up to 30 where they are short of `least_steps` steps.
    """
    rng = np.random.default_rng(seed)
    found = [words_of(t) for t in docs]
    own_docs = [np.arange(len(docs)) % 5 != 4, np.arange(len(docs)) % 5 == 4]
    # telling words: document frequencies by class
    seen = [Counter(), Counter()]
    for k in np.flatnonzero(own_docs[0]):
        seen[int(y[k])].update(set(found[k]))
    n1, n0 = max(1, int(y[own_docs[0]].sum())), max(1, int((1 - y[own_docs[0]]).sum()))
    telling = {w: np.log((seen[1][w] + 0.5) / (n1 + 1)) - np.log((seen[0][w] + 0.5) / (n0 + 1)) for w in seen[1] | seen[0] if seen[1][w] + seen[0][w] >= 8}
    weight = {w: v * np.sqrt(seen[1][w] / n1 + seen[0][w] / n0) for w, v in telling.items()}
    chosen = sorted(weight, key=lambda w: (-abs(weight[w]), w))[:_KNOWN]
    net = Network(Reader({w: k for k, w in enumerate(chosen)}), seed, np.array([np.clip(telling[w], -4, 4) / 2 for w in chosen], np.float32))
    index: dict[str, int] = {}
    cut = [windows(np.array([index.setdefault(w, len(index)) for w in f], int)) for f in found]
    if not index:
        index[""] = 0
    names = list(index)
    word_rows, gram_rows = np.array([net.reader.word(w) for w in names]), [np.array(net.reader.grams(w)) for w in names]
    every, doc_of = np.concatenate(cut), np.repeat(np.arange(len(cut)), [len(c) for c in cut])
    starts = np.r_[0, np.cumsum([len(c) for c in cut])[:-1]]
    lead = np.append(np.array([max(0.0, telling.get(w, 0.0)) if w in telling else 0.0 for w in names]), 0.0)
    score = lead[every].sum(1)
    m = {k: np.zeros_like(v) for k, v in net.w.items()}
    v = {k: np.zeros_like(v) for k, v in net.w.items()}
    tick = 0
    per_epoch = max(1, -(-int(own_docs[0].sum() + (own_docs[0] & (y == 0)).sum()) // batch))
    for _ in range(max(epochs, min(30, -(-least_steps // per_epoch)))):
        top = np.array([starts[d] + int(np.argmax(score[starts[d] : starts[d] + len(cut[d])])) for d in range(len(cut))])
        some = np.array([starts[d] + int(rng.integers(len(cut[d]))) for d in range(len(cut))])
        fit_docs = np.flatnonzero(own_docs[0])
        rows = np.r_[top[fit_docs], some[fit_docs[y[fit_docs] == 0]]]
        rng.shuffle(rows)
        for k in range(0, len(rows), batch):
            part = every[rows[k : k + batch]]
            used, back = np.unique(part, return_inverse=True)
            back = back.reshape(part.shape) - (1 if used[0] == -1 else 0)
            used = used[used >= 0]
            if not len(used):
                continue
            grad = net.step(back, y[doc_of[rows[k : k + batch]]], word_rows[used], [gram_rows[u] for u in used])
            tick += 1
            for name, g in grad.items():
                m[name] = 0.9 * m[name] + 0.1 * g
                v[name] = 0.99 * v[name] + 0.01 * g * g
                net.w[name] = (net.w[name] - rate * (m[name] / (1 - 0.9**tick)) / (np.sqrt(v[name] / (1 - 0.99**tick)) + 1e-7)).astype(np.float32)
        gates = net.gates(net.embed(names))
        score = np.concatenate([net.logits(gates, every[k : k + 8192]) for k in range(0, len(every), 8192)])
    best = np.maximum.reduceat(score, starts)[own_docs[1]]
    target, a, b = y[own_docs[1]], 1.0, 0.0
    if 0 < target.sum() < len(target):
        for _ in range(400):
            p = _sigmoid(a * best + b)
            a, b = a - 0.3 * (((p - target) * best).mean() + 1e-3 * a), b - 0.3 * (p - target).mean()
    net.slope, net.offset = max(float(a), 0.05), float(b)
    return net


class Scorer:
    """Scores texts with a bounded memo of word inputs."""

    def __init__(self, net: Network):
        self.net = net
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.gates = {s: np.zeros((1, 3 * _H), np.float32) for s in "fb"}

    def __call__(self, batch: list[str]) -> np.ndarray:
        if len(self.index) > _MEMO:
            self._reset()
        index, known = self.index, len(self.index)
        cut = [windows(np.fromiter((index.setdefault(w, len(index)) for w in words_of(t)), int)) for t in batch]
        if len(index) > known:
            fresh = self.net.gates(self.net.embed(list(index)[known:]))
            self.gates = {s: np.r_[self.gates[s][:-1], fresh[s]] for s in "fb"}
        every = np.concatenate(cut)
        score = np.concatenate([self.net.logits(self.gates, every[k : k + 2048]) for k in range(0, len(every), 2048)])
        best = np.maximum.reduceat(score, np.r_[0, np.cumsum([len(c) for c in cut])[:-1]])
        return _sigmoid(self.net.slope * best.astype(float) + self.net.offset)


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most_toxic: int = 1500, most_clean: int = 2500, longest_training: int = 6000) -> Network | float:
    """A network fitted on the bounded sample, or the share of toxic labels where a class is missing."""
    marks = labels.filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("_y"))
    order = (F.xxhash64("doc_id", F.lit(9)), F.col("doc_id"))
    short = texts(docs).filter(F.length("text") <= longest_training)
    known = short.select("doc_id").join(marks, "doc_id").distinct()
    chosen = known.filter("_y >= 1").orderBy(*order).limit(most_toxic).union(known.filter("_y < 1").orderBy(*order).limit(most_clean))
    # one text of each chosen id, so the sample is bounded by rows too
    found = short.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "_y").agg(F.max_by("text", F.xxhash64("text")).alias("text"))
    rows = found.select("doc_id", "text", (F.col("_y") >= 1).cast("int").alias("_y")).toPandas().sort_values(["doc_id", "text"])
    rows = rows.sample(frac=1, random_state=7)
    y = rows["_y"].to_numpy(float)
    if len(set(y)) < 2:
        return float(y.mean()) if len(y) else 0.0
    return fit(rows["text"].tolist(), y)


def score(docs: DataFrame, model: Network | float) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    plain = texts(docs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model) if isinstance(model, Network) else None
        for batch in batches:
            found, out, k = batch["text"].tolist(), [], 0
            while k < len(found):  # parts of bounded size, or one long text
                size, e = 0, k
                while e < len(found) and (e == k or size + len(found[e]) <= 1_000_000):
                    size, e = size + len(found[e]), e + 1
                out.append(scorer(found[k:e]) if scorer else np.full(e - k, model))
                k = e
            yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy(), "score": np.concatenate(out) if out else np.array([], float)})

    scored = plain.mapInPandas(run, f"doc_id {dict(plain.dtypes)['doc_id']}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
