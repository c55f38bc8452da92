"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A text's words are read in windows of WINDOW words, each beginning STRIDE words after the last, the final one ending with
the text, so that all words are scored at least once and most twice. A word's input joins a word embedding (hashed) and
those of its character 3- to 5-grams (hashed), in part the greatest and in part the mean. Two gated recurrent layers, one for each direction, read a
window; attention pools their states; a logistic unit gives the window's logit. A document's score is the calibrated
logit of its worst window.

Training is multiple-instance: labels hold for documents, so in each round a positive document contributes its worst
window so far, a negative one its two worst and one at random. The first round ranks by smoothed log odds. The training
sample is bounded by SAMPLE_POSITIVE and SAMPLE_NEGATIVE documents, those whose ids hash lowest, and by SAMPLE_CHARS
characters of all of them; texts in it are read whole. A fifth of it is kept for calibration only. Scoring has no bounds:
every window of every text.

Null and empty texts, and texts without words, have no window; their logit is the network's bias and so their score low.
If the sample lacks either class, all scores are the share of positives, at most 0.5. Repeated rows, extra columns and
empty tables pass through; columns with an output's name are replaced. Very long texts are scored in one go of their own.
Null labels and null ids are never learnt from; of an id with several texts the first in order is, with the label 1 if any.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField

from .common import map_columns

WINDOW, STRIDE = 24, 12
WORD_BUCKETS, GRAM_BUCKETS, WIDTH, HIDDEN, ATTENTION = 1 << 15, 1 << 16, 8, 8, 8
GRAMS = (3, 4, 5)
#: Numbers of a gram of which a word gets the greatest, not the mean: one telling gram is enough.
PEAKS = 4
WORD_CHARS = 24
SAMPLE_POSITIVE, SAMPLE_NEGATIVE, SAMPLE_CHARS = 1_500, 2_500, 40_000_000
ROUNDS, EPOCHS, BATCH, RATE, TABLE_RATE = 2, 3, 128, 0.05, 0.2
#: Weight of the mean rate in a bucket's rate, in documents.
PRIOR = 3.0
THRESHOLD = 0.7
#: Words whose inputs a worker keeps.
CACHED_WORDS = 100_000
_WORD = re.compile(r"\w{1,%d}" % WORD_CHARS)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def features_of(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word bucket, gram buckets, gram mask) of each word."""
    chars = np.array(words, f"U{WORD_CHARS}").view(np.uint32).reshape(len(words), WORD_CHARS)
    sizes = (chars != 0).sum(1)
    framed = np.zeros((len(words), WORD_CHARS + 2), np.uint32)
    framed[:, 0], framed[:, 1:-1] = 1, chars
    framed[np.arange(len(words)), sizes + 1] = 2
    whole = np.zeros(len(words), np.uint32)
    for k in range(framed.shape[1]):
        whole = whole * np.uint32(16777619) + framed[:, k]
    grams, masks = [], []
    for n in GRAMS:
        h = np.zeros((len(words), framed.shape[1] - n + 1), np.uint32)
        for k in range(n):
            h = (h + framed[:, k : k + h.shape[1]]) * np.uint32(2654435761)
            h ^= h >> np.uint32(15)
        grams.append((h + np.uint32(n * 40503)) & np.uint32(GRAM_BUCKETS - 1))
        masks.append(np.arange(h.shape[1])[None] + n <= sizes[:, None] + 2)
    whole ^= whole >> np.uint32(15)
    return (whole * np.uint32(2246822519) >> np.uint32(17)) & np.uint32(WORD_BUCKETS - 1), np.concatenate(grams, 1), np.concatenate(masks, 1)


def windows_of(n_words: int) -> list[int]:
    """The first word of each window."""
    if n_words <= WINDOW:
        return [0] if n_words else []
    starts = list(range(0, n_words - WINDOW, STRIDE))
    return [*starts, n_words - WINDOW]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters, the forward pass, and the gradients of the mean logistic loss."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        init = lambda *s: (rng.standard_normal(s) * 0.3).astype(np.float32)
        d, h = 2 * WIDTH, HIDDEN
        self.p = {"word": init(WORD_BUCKETS, WIDTH) * 0.1, "gram": init(GRAM_BUCKETS, WIDTH) * 0.1, "att": init(2 * h, ATTENTION), "att_b": np.zeros(ATTENTION, np.float32), "att_v": init(ATTENTION), "out": init(2 * h), "out_b": np.full(1, -2, np.float32)}
        for way in "fb":
            self.p |= {f"w{way}": init(d, 3 * h), f"u{way}": init(h, 3 * h), f"c{way}": np.zeros(3 * h, np.float32)}
        self.scale, self.shift, self.prior = 1.0, 0.0, None

    def inputs(self, words: np.ndarray, grams: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """The input of each word: its embedding beside that of its grams, the greatest of the first PEAKS numbers and the mean of the others."""
        out = np.empty((len(words), 2 * WIDTH), np.float32)
        out[:, :WIDTH] = self.p["word"][words]
        for k in range(0, len(words), 4096):
            m, g = mask[k : k + 4096], self.p["gram"][grams[k : k + 4096]]
            out[k : k + 4096, WIDTH : WIDTH + PEAKS] = np.where(m[..., None], g[..., :PEAKS], -9).max(1)
            out[k : k + 4096, WIDTH + PEAKS :] = (g[..., PEAKS:] * m[..., None]).sum(1) / np.maximum(m.sum(1), 1)[:, None]
        return out

    def gates(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x @ self.p["wf"] + self.p["cf"], x @ self.p["wb"] + self.p["cb"]

    def _run(self, way: str, gates: np.ndarray, at: np.ndarray, live: np.ndarray, keep: list | None) -> np.ndarray:
        """States (steps, windows, HIDDEN); gates has a last row for steps past the end."""
        h, u = np.zeros((len(at), HIDDEN), np.float32), self.p[f"u{way}"]
        out = np.empty((at.shape[1], len(at), HIDDEN), np.float32)
        full = live.all(0)
        for t in range(at.shape[1]) if way == "f" else range(at.shape[1] - 1, -1, -1):
            g, hu = gates[at[:, t]], h @ u
            zr = _sigmoid(g[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(g[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
            new = n + z * (h - n)
            if not full[t]:
                new = np.where(live[:, t, None], new, h)
            if keep is not None:
                keep.append((t, h, z, r, n, hu[:, 2 * HIDDEN :]))
            h = out[t] = new
        return out

    def forward(self, gates: tuple[np.ndarray, np.ndarray], at: np.ndarray, live: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows: at holds rows of gates, live where there is a word."""
        tapes = ([], []) if keep is not None else (None, None)
        states = np.concatenate([self._run("f", gates[0], at, live, tapes[0]), self._run("b", gates[1], at, live, tapes[1])], 2)
        u = np.tanh(states @ self.p["att"] + self.p["att_b"])
        e = np.where(live.T, u @ self.p["att_v"], -1e9)
        e = np.exp(e - e.max(0))
        weight = e / e.sum(0)
        pooled = np.einsum("tn,tnh->nh", weight, states)
        if keep is not None:
            keep.update(tapes=tapes, states=states, u=u, weight=weight, pooled=pooled)
        return pooled @ self.p["out"] + self.p["out_b"][0]

    def gradients(self, words, grams, mask, at, live, labels) -> dict[str, np.ndarray]:
        p, h = self.p, HIDDEN
        x = np.vstack([self.inputs(words, grams, mask), np.zeros((1, 2 * WIDTH), np.float32)])
        gates, keep = self.gates(x), {}
        logits = self.forward(gates, at, live, keep)
        d = ((_sigmoid(logits) - labels) / len(labels)).astype(np.float32)
        g = {"out": keep["pooled"].T @ d, "out_b": d.sum(keepdims=True)}
        d_pooled = d[:, None] * p["out"]
        states, u, weight = keep["states"], keep["u"], keep["weight"]
        d_states = weight[..., None] * d_pooled
        d_weight = np.einsum("nh,tnh->tn", d_pooled, states)
        d_e = weight * (d_weight - (weight * d_weight).sum(0))
        g["att_v"] = np.einsum("tn,tna->a", d_e, u)
        d_u = d_e[..., None] * p["att_v"] * (1 - u * u)
        g["att"], g["att_b"] = np.einsum("tnh,tna->ha", states, d_u), d_u.sum((0, 1))
        d_states += d_u @ p["att"].T
        d_x = np.zeros_like(x)
        for k, way in enumerate("fb"):
            d_h, d_u_w = np.zeros((len(at), h), np.float32), np.zeros_like(p[f"u{way}"])
            d_gates = np.zeros_like(gates[k])
            for t, before, z, r, n, hn in reversed(keep["tapes"][k]):
                on = live[:, t, None]
                d_new = (d_h + d_states[t, :, k * h : (k + 1) * h])
                d_n = d_new * (1 - z) * (1 - n * n) * on
                d_z = d_new * (before - n) * z * (1 - z) * on
                d_r = d_n * hn * r * (1 - r)
                pre = np.concatenate([d_z, d_r, d_n], 1)
                np.add.at(d_gates, at[:, t], pre)
                pre[:, 2 * h :] *= r
                d_u_w += before.T @ pre
                d_h = np.where(on, d_new * z, d_new) + pre @ p[f"u{way}"].T
            g[f"u{way}"], g[f"w{way}"], g[f"c{way}"] = d_u_w, x.T @ d_gates, d_gates.sum(0)
            d_x += d_gates @ p[f"w{way}"].T
        d_x = d_x[:-1]
        g["word"] = _scatter(words, d_x[:, :WIDTH], WORD_BUCKETS)
        d_c = d_x[:, WIDTH + PEAKS :] / np.maximum(mask.sum(1), 1)[:, None]
        row, col = np.nonzero(mask)
        at = np.where(mask[..., None], p["gram"][grams][..., :PEAKS], -9).argmax(1)
        each = np.arange(len(grams))
        peaks = [np.bincount(grams[each, at[:, k]], d_x[:, WIDTH + k], GRAM_BUCKETS).astype(np.float32)[:, None] for k in range(PEAKS)]
        g["gram"] = np.concatenate([*peaks, _scatter(grams[row, col], d_c[row], GRAM_BUCKETS)], 1)
        return g

    def probability(self, logit: np.ndarray) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(logit), min(self.prior, 0.5))
        return _sigmoid(self.scale * logit.astype(np.float64) + self.shift)


def _scatter(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(rows, values[:, k], n) for k in range(values.shape[1])], 1).astype(np.float32)


class _Corpus:
    """Training documents as rows of distinct words."""

    def __init__(self, texts: list[str]):
        self.at: dict[str, int] = {}
        self.docs = [np.array([self.at.setdefault(w, len(self.at)) for w in words_of(t)], np.int64) for t in texts]
        self.words, self.grams, self.mask = features_of(list(self.at)) if self.at else features_of(["_"])
        owner, rows, live = [], [], []
        for i, d in enumerate(self.docs):
            for s in windows_of(len(d)):
                w = d[s : s + WINDOW]
                owner.append(i)
                rows.append(np.pad(w, (0, WINDOW - len(w)), constant_values=-1))
        self.owner, self.rows = np.array(owner, np.int64), np.array(rows, np.int64).reshape(-1, WINDOW)
        self.live = self.rows >= 0

    def log_odds(self, labels: np.ndarray, prior: float = PRIOR) -> tuple[np.ndarray, np.ndarray]:
        """For word and gram buckets: how much oftener positive documents hold them, smoothed."""
        out = []
        for buckets, n in ((None, WORD_BUCKETS), (self.grams, GRAM_BUCKETS)):
            counts = np.zeros((2, n))
            for d, y in zip(self.docs, labels, strict=True):
                w = np.unique(d)
                counts[int(y), np.unique(self.words[w] if buckets is None else buckets[w][self.mask[w]])] += 1
            rate = [(counts[k] + prior * (counts.sum(0) + 1) / (len(labels) + 2)) / ((labels == k).sum() + prior) for k in (0, 1)]
            out.append(np.clip(np.log(rate[1] / rate[0]), -3, 3).astype(np.float32))
        return out[0], out[1]

    def logits(self, net: Network) -> np.ndarray:
        g = net.gates(np.vstack([net.inputs(self.words, self.grams, self.mask), np.zeros((1, 2 * WIDTH), np.float32)]))
        return np.concatenate([net.forward(g, self.rows[k : k + 8192], self.live[k : k + 8192]) for k in range(0, len(self.rows), 8192)]) if len(self.rows) else np.zeros(0)


def worst(logits: np.ndarray, owner: np.ndarray, n: int, empty: float) -> np.ndarray:
    out = np.full(n, -np.inf)
    np.maximum.at(out, owner, logits)
    return np.where(np.isinf(out), empty, out)


def train(texts: list[str], labels: list[int], seed: int = 7) -> Network:
    """A network fitted and calibrated to documents' labels."""
    net, y, rng = Network(seed), np.array(labels, np.int64), np.random.default_rng(seed)
    if min((y == 1).sum(), (y == 0).sum()) < 2:
        net.prior = float(y.mean()) if len(y) else 0.0
        return net
    fold = np.zeros(len(y), bool)
    for k in (0, 1):
        own = np.flatnonzero(y == k)
        fold[own[::5]] = len(own) >= 10
    fit, held = np.flatnonzero(~fold), np.flatnonzero(fold) if fold.any() else np.arange(len(y))
    c, labelled = _Corpus([texts[i] for i in fit]), y[fit]
    word, gram = c.log_odds(labelled)
    net.p["word"][:, 0], net.p["gram"][:, 0] = word / 3, gram / 3
    best = word[c.words] + np.where(c.mask, gram[c.grams], -9).max(1)
    score = np.where(c.live, best[c.rows], -9).max(1)
    memory = {k: np.full_like(v, 1e-8) for k, v in net.p.items()}
    for _ in range(ROUNDS):
        order = np.lexsort((-score, c.owner))
        place = np.arange(len(order)) - np.searchsorted(c.owner[order], c.owner[order])
        of = labelled[c.owner[order]]
        chosen = order[(place < 1) & (of == 1) | (place < 2) & (of == 0)]
        spare = rng.permutation(np.flatnonzero(labelled[c.owner] == 0))[: int((labelled == 0).sum())]
        chosen = np.concatenate([chosen, spare])
        for _ in range(EPOCHS):
            rng.shuffle(chosen)
            for k in range(0, len(chosen), BATCH):
                part = chosen[k : k + BATCH]
                used, at = np.unique(c.rows[part], return_inverse=True)
                at = at.reshape(len(part), WINDOW)
                if used[0] < 0:
                    used, at = used[1:], np.where(at == 0, len(used) - 1, at - 1)
                g = net.gradients(c.words[used], c.grams[used], c.mask[used], at, c.live[part], labelled[c.owner[part]].astype(np.float32))
                norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
                for name, v in g.items():
                    v *= min(1.0, 1.0 / max(norm, 1e-9))
                    memory[name] += v * v
                    net.p[name] -= (TABLE_RATE if name in ("word", "gram") else RATE) * v / np.sqrt(memory[name] + 1e-8)
        score = c.logits(net)
    h = _Corpus([texts[i] for i in held])
    net.scale, net.shift = _calibrate(worst(h.logits(net), h.owner, len(held), float(net.p["out_b"][0])), y[held])
    return net


def _calibrate(logit: np.ndarray, y: np.ndarray, steps: int = 50, ridge: float = 1e-2) -> tuple[float, float]:
    """Scale and shift of the logits by penalised logistic regression (Newton steps)."""
    a = np.stack([logit, np.ones_like(logit)], 1)
    w = np.array([1.0, 0.0])
    for _ in range(steps):
        p = _sigmoid(a @ w)
        grad = a.T @ (p - y) + ridge * (w - [1, 0])
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(2), grad)
        w = w - np.clip(step, -1, 1)
    return max(float(w[0]), 1e-3), float(w[1])


class Scorer:
    """Scores of whole texts; the inputs of words seen before are kept."""

    def __init__(self, net: Network):
        self.net = net
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {}
        self.gates = tuple(np.empty((1 << 14, 3 * HIDDEN), np.float32) for _ in "fb")

    def score(self, texts: list[str | None]) -> np.ndarray:
        if len(self.at) > CACHED_WORDS:
            self._clear()
        at, known = self.at, len(self.at)
        docs = [[at.setdefault(w, len(at)) for w in words_of(t)] for t in texts]
        if len(at) > known:
            new = list(at)[known:]
            made = [self.net.gates(self.net.inputs(*features_of(new[k : k + 20_000]))) for k in range(0, len(new), 20_000)]
            while len(at) + 1 > len(self.gates[0]):
                self.gates = tuple(np.concatenate([g, np.empty_like(g)]) for g in self.gates)
            for k in (0, 1):
                self.gates[k][known : len(at)] = np.concatenate([m[k] for m in made])
        empty = len(self.gates[0]) - 1
        flat = np.array([w for d in docs for w in d] + [empty] * WINDOW, np.int64)
        begin, starts, owner, sizes = 0, [], [], []
        for i, d in enumerate(docs):
            for s in windows_of(len(d)):
                starts.append(begin + s)
                owner.append(i)
                sizes.append(min(WINDOW, len(d) - s))
            begin += len(d)
        starts, sizes, owner = np.array(starts, np.int64), np.array(sizes, np.int64), np.array(owner, np.int64)
        logits = np.empty(len(starts))
        for k in range(0, len(starts), 4096):
            live = np.arange(WINDOW)[None] < sizes[k : k + 4096, None]
            rows = np.where(live, flat[np.minimum(starts[k : k + 4096, None] + np.arange(WINDOW)[None], len(flat) - 1)], empty)
            logits[k : k + 4096] = self.net.forward(self.gates, rows, live)
        return self.net.probability(worst(logits, owner, len(docs), float(self.net.p["out_b"][0])))


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Network:
    """A network learnt from a bounded sample of the labelled rows whose id is allowed."""
    known = labels.select(F.col(f"`{id_col}`"), F.col(f"`{label_col}`").cast("int").alias("__y")).where(allowed & F.col("__y").isin(0, 1) & F.col(f"`{id_col}`").isNotNull())
    known = known.groupBy(id_col).agg(F.max("__y").alias("__y"))
    mix = F.xxhash64(F.col(f"`{id_col}`"))
    picked = known.where("__y = 1").orderBy(mix).limit(SAMPLE_POSITIVE).unionByName(known.where("__y = 0").orderBy(mix).limit(SAMPLE_NEGATIVE))
    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").alias("__t")).where("__t is not null")
    rows = rows.join(F.broadcast(picked), id_col).groupBy(id_col, "__y").agg(F.min("__t").alias("__t"))
    upto = F.sum(F.length("__t")).over(Window.orderBy(F.xxhash64(F.col(f"`{id_col}`"))))  # of SAMPLE_POSITIVE + SAMPLE_NEGATIVE rows at most
    rows = rows.withColumn("__upto", upto).where(F.col("__upto") <= SAMPLE_CHARS).collect()
    rows.sort(key=lambda r: r[id_col])
    return train([r["__t"] for r in rows], [r["__y"] for r in rows])


def predict(docs: DataFrame, net: Network, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= THRESHOLD)."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def make():
        scorer = Scorer(shared.value)

        def run(texts: pa.Array):
            s = scorer.score(texts.to_pylist())
            return [pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32))]

        return run

    return map_columns(docs, [text_col], [StructField("score", DoubleType(), False), StructField("predicted", IntegerType(), False)], make, () if keep_text else (text_col,))
