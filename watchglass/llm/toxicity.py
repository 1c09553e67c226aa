"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

Each word has two inputs: an embedding of the word and the mean of embeddings of its character sequences, both from
hashed tables. Gated recurrent units run over a window of words in both directions, attention pools their states,
and a linear layer gives the window's logit. Windows overlap by half and cover the whole text; the highest of all
decides, through a logistic curve fitted on documents. Only documents are labelled, so training picks the window that
the present network finds most toxic in each (the others of a toxic document may well be clean).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchglass.llm.calibration import chance, fit_logistic, prior_weights
from watchglass.llm.common import class_share, held_out, labelled, scored, table

#: Labelled documents of each class that are learned from, at most.
PER_CLASS = 1200
WINDOW, STRIDE = 32, 16
BUCKETS, WIDTH, HIDDEN = 1 << 15, 8, 8
GRAMS = (3, 4, 5)
EPOCHS, BATCH, RATE = 6, 128, 0.05
#: Epochs before which each document's window is chosen anew.
CHOOSE = (2, 4)
#: Windows run through the network at once, and words whose inputs a worker remembers; those that the driver does.
AT_ONCE, REMEMBERED, REMEMBERED_THERE = 2048, 300_000, 50_000
THRESHOLD = 0.5

WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def window_starts(n: int) -> list[int]:
    """First words of the overlapping windows of a text of ``n`` words; the last window ends with the text."""
    if n <= WINDOW:
        return [0] if n else []
    return [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def hashed(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the words, buckets of all their character sequences, and where each word's begin.

    Sequences are of the bytes of the word between two marks, so each word has at least one.
    """
    data = [b"<" + w.encode() + b">" for w in words]
    own = np.array([zlib.crc32(w) % BUCKETS for w in data], np.int64)
    lengths = np.array([len(w) for w in data])
    flat = np.frombuffer(b"".join(data), np.uint8).astype(np.uint64) + np.uint64(1)
    word = np.repeat(np.arange(len(data)), lengths)
    found, owner = [], []
    for n in GRAMS:
        if len(flat) < n:
            continue
        value = np.zeros(len(flat) - n + 1, np.uint64)
        for k in range(n):
            value = value * np.uint64(0x9E3779B97F4A7C15) + flat[k : len(flat) - n + 1 + k]
        value ^= value >> np.uint64(29)
        value *= np.uint64(0xBF58476D1CE4E5B9)
        inside = word[: len(flat) - n + 1] == word[n - 1 :]
        found.append((value[inside] >> np.uint64(40)).astype(np.int64) % BUCKETS)
        owner.append(word[: len(flat) - n + 1][inside])
    grams, owner = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return own, grams[order], np.searchsorted(owner[order], np.arange(len(data)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


@dataclass
class Network:
    word: np.ndarray  # BUCKETS x WIDTH
    chars: np.ndarray  # BUCKETS x WIDTH
    project: np.ndarray  # 2 * WIDTH x 6 * HIDDEN: update, reset and new state, forwards then backwards
    shift: np.ndarray  # 6 * HIDDEN
    recur: np.ndarray  # 2 x HIDDEN x 3 * HIDDEN
    attend: np.ndarray  # 2 * HIDDEN
    out: np.ndarray  # 2 * HIDDEN + 1
    curve: tuple[float, float] = (1.0, 0.0)
    nothing: float = -4.0  # the logit of a text without words
    _most: int = REMEMBERED
    _rows: dict[str, int] = field(default_factory=dict)
    _inputs: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_most": REMEMBERED, "_rows": {}, "_inputs": None}

    def embed(self, own: np.ndarray, grams: np.ndarray, begin: np.ndarray) -> np.ndarray:
        counts = np.diff(np.append(begin, len(grams)))
        mean = np.add.reduceat(self.chars[grams], begin, axis=0) / counts[:, None].astype(np.float32)
        return np.concatenate([self.word[own], mean], 1)

    def inputs(self, words: Sequence[str]) -> np.ndarray:
        """Rows of the projected inputs, which are worked out once for each different word."""
        rows = self._rows
        new = [w for w in dict.fromkeys(words) if w not in rows]
        if len(rows) + len(new) > self._most:
            rows.clear()
            self._inputs, new = None, list(dict.fromkeys(words))
        if new:
            fresh = np.concatenate([self.embed(*hashed(new[k : k + 20000])) @ self.project + self.shift for k in range(0, len(new), 20000)])
            start = len(rows)
            rows.update(zip(new, range(start, start + len(new)), strict=True))
            if self._inputs is None or len(self._inputs) < len(rows):
                grown = np.zeros((max(min(2 * len(rows), self._most), len(rows), 1 << 14), fresh.shape[1]), np.float32)
                if start:
                    grown[:start] = self._inputs[:start]
                self._inputs = grown
            self._inputs[start : len(rows)] = fresh
        return np.array([rows[w] for w in words], np.int64)

    def run(self, x: np.ndarray, mask: np.ndarray | None, keep: list | None = None) -> np.ndarray:
        """Logits of windows whose projected inputs are ``x`` (windows x words x 6 * HIDDEN)."""
        n, steps = x.shape[:2]
        x = x.reshape(n, steps, 2, 3 * HIDDEN)
        both = np.stack([x[:, :, 0], x[:, ::-1, 1]]).transpose(2, 0, 1, 3)  # step, direction, window
        live = None if mask is None else np.stack([mask, mask[:, ::-1]]).transpose(2, 0, 1)[..., None]
        h, states = np.zeros((2, n, HIDDEN), np.float32), np.empty((steps, 2, n, HIDDEN), np.float32)
        for t in range(steps):
            ahead = h @ self.recur
            gates = _sigmoid(both[t, :, :, : 2 * HIDDEN] + ahead[:, :, : 2 * HIDDEN])
            z, r, q = gates[..., :HIDDEN], gates[..., HIDDEN:], ahead[..., 2 * HIDDEN :]
            new = np.tanh(both[t, :, :, 2 * HIDDEN :] + r * q)
            step = new + z * (h - new)
            if live is not None:
                step = np.where(live[t], step, h)
            if keep is not None:
                keep.append((h, z, r, q, new))
            states[t] = h = step
        seen = np.concatenate([states[:, 0], states[::-1, 1]], -1).transpose(1, 0, 2)  # window, word
        weight = seen @ self.attend
        if mask is not None:
            weight = np.where(mask, weight, np.float32(-1e9))
        weight = np.exp(weight - weight.max(1, keepdims=True))
        weight /= weight.sum(1, keepdims=True)
        pooled = np.matmul(weight[:, None], seen)[:, 0]
        if keep is not None:
            keep.append((seen, weight, pooled, live))
        return pooled @ self.out[:-1] + self.out[-1]

    def windows(self, texts: Sequence[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logits of all windows of all texts, with each window's text and first word."""
        owner, first, logits = [], [], []
        for k, words in enumerate(texts):
            starts = window_starts(len(words))
            owner += [k] * len(starts)
            first += starts
        owner, first = np.array(owner, np.int64), np.array(first, np.int64)
        sizes = np.array([len(w) for w in texts], np.int64)
        # Words of a few texts at a time, so that memory doesn't grow with a batch of texts.
        ends, k = np.cumsum(sizes), 0
        while k < len(texts):
            done = int(ends[k - 1]) if k else 0
            stop = max(k + 1, int(np.searchsorted(ends, done + 200_000, "right")))
            rows = self.inputs([w for words in texts[k:stop] for w in words])
            mine = np.flatnonzero((owner >= k) & (owner < stop))
            base = ends - sizes - done
            part = np.empty(len(mine), np.float32)
            full = sizes[owner[mine]] >= WINDOW
            for kind in (True, False):
                chosen = np.flatnonzero(full == kind)
                for a in range(0, len(chosen), AT_ONCE):
                    at = chosen[a : a + AT_ONCE]
                    place = (base[owner[mine[at]]] + first[mine[at]])[:, None] + np.arange(WINDOW)
                    mask = None if kind else np.arange(WINDOW) < sizes[owner[mine[at]]][:, None]
                    part[at] = self.run(self._inputs[rows[np.minimum(place, len(rows) - 1)]], mask)
            logits.append(part)
            k = stop
        return (np.concatenate(logits) if logits else np.zeros(0, np.float32)), owner, first

    def forget(self) -> None:
        """Lets go of the remembered inputs, which no longer hold once the weights change."""
        self._rows, self._inputs = {}, None

    def logits(self, texts: Sequence[str | None]) -> np.ndarray:
        """The highest window's logit of each whole text."""
        return self.highest([words_of(t) for t in texts])

    def highest(self, texts: Sequence[list[str]]) -> np.ndarray:
        """The same for texts given by their words."""
        found, owner, _ = self.windows(texts)
        out = np.full(len(texts), -np.inf)
        np.maximum.at(out, owner, found)
        return np.where(np.isinf(out), self.nothing, out)


class _Trainer:
    """Gradients through the network, and AdaGrad steps."""

    def __init__(self, net: Network):
        self.net, self.sums = net, {k: np.full(getattr(net, k).shape, 1e-3, np.float32) for k in ("word", "chars", "project", "shift", "recur", "attend", "out")}

    def _step(self, name: str, grad: np.ndarray, rows: np.ndarray | None = None) -> None:
        value, total = getattr(self.net, name), self.sums[name]
        at = slice(None) if rows is None else rows
        total[at] += grad * grad
        value[at] -= RATE * grad / np.sqrt(total[at])

    @staticmethod
    def _gathered(rows: np.ndarray, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(rows, kind="stable")
        unique, begin = np.unique(rows[order], return_index=True)
        return unique, np.add.reduceat(grad[order], begin, axis=0)

    def batch(self, windows: Sequence[list[str]], labels: np.ndarray, weight: np.ndarray) -> float:
        net, n = self.net, len(windows)
        names = list(dict.fromkeys(w for ws in windows for w in ws))
        row = {w: i for i, w in enumerate(names)}
        index, mask = np.zeros((n, WINDOW), np.int64), np.zeros((n, WINDOW), bool)
        for k, ws in enumerate(windows):
            index[k, : len(ws)], mask[k, : len(ws)] = [row[w] for w in ws], True
        own, grams, begin = hashed(names)
        embedded = net.embed(own, grams, begin)
        keep: list = []
        logit = net.run((embedded @ net.project + net.shift)[index], mask, keep)
        p = _sigmoid(logit)
        d = ((p - labels) * weight / n).astype(np.float32)

        seen, attention, pooled, live = keep.pop()
        d_pooled = d[:, None] * net.out[:-1]
        self_out = np.append(pooled.T @ d, d.sum())
        d_attention = np.matmul(seen, d_pooled[:, :, None])[..., 0]
        d_weight = attention * (d_attention - (attention * d_attention).sum(1, keepdims=True))
        d_seen = attention[..., None] * d_pooled[:, None] + d_weight[..., None] * net.attend
        d_attend = np.tensordot(d_weight, seen, ((0, 1), (0, 1)))
        by_step = np.stack([d_seen[..., :HIDDEN].transpose(1, 0, 2), d_seen[:, ::-1, HIDDEN:].transpose(1, 0, 2)], 1)
        d_h, d_recur = np.zeros((2, n, HIDDEN), np.float32), np.zeros_like(net.recur)
        d_x = np.zeros((WINDOW, 2, n, 3 * HIDDEN), np.float32)
        for t in range(WINDOW - 1, -1, -1):
            h, z, r, q, new = keep[t]
            total = d_h + by_step[t]
            step = np.where(live[t], total, 0)
            d_z, d_new = step * (h - new) * z * (1 - z), step * (1 - z) * (1 - new * new)
            d_r = d_new * q * r * (1 - r)
            d_x[t] = np.concatenate([d_z, d_r, d_new], -1)
            ahead = np.concatenate([d_z, d_r, d_new * r], -1)
            d_recur += h.transpose(0, 2, 1) @ ahead
            d_h = np.where(live[t], step * z, total) + ahead @ net.recur.transpose(0, 2, 1)
        by_word = np.concatenate([d_x[:, 0].transpose(1, 0, 2), d_x[::-1, 1].transpose(1, 0, 2)], -1)[mask]
        used, d_projected = self._gathered(index[mask], by_word)
        d_embedded = d_projected @ net.project.T
        counts = np.diff(np.append(begin, len(grams)))
        self._step("project", embedded[used].T @ d_projected)
        self._step("shift", d_projected.sum(0))
        self._step("recur", d_recur)
        self._step("attend", d_attend)
        self._step("out", self_out.astype(np.float32))
        rows, grad = self._gathered(own[used], d_embedded[:, :WIDTH])
        self._step("word", grad, rows)
        each = np.zeros((len(names), WIDTH), np.float32)
        each[used] = d_embedded[:, WIDTH:] / counts[used][:, None]
        rows, grad = self._gathered(grams, np.repeat(each, counts, axis=0))
        self._step("chars", grad, rows)
        return float(-(weight * np.where(labels == 1, np.log(p + 1e-7), np.log(1 - p + 1e-7))).mean())


def _fresh(texts: Sequence[list[str]], labels: np.ndarray, seed: int) -> Network:
    """Random weights, with the first column of both tables set to how much likelier toxic texts hold a bucket."""
    rng = np.random.default_rng(seed)
    small = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[-2] if len(shape) > 1 else shape[-1]), shape).astype(np.float32)
    net = Network(
        0.1 * small(BUCKETS, WIDTH) * np.sqrt(np.float32(BUCKETS)), 0.1 * small(BUCKETS, WIDTH) * np.sqrt(np.float32(BUCKETS)), small(2 * WIDTH, 6 * HIDDEN), np.zeros(6 * HIDDEN, np.float32),
        0.5 * small(2, HIDDEN, 3 * HIDDEN), small(2 * HIDDEN), np.append(small(2 * HIDDEN), 0).astype(np.float32),
    )
    seen = np.zeros((2, 2, BUCKETS))
    for words, label in zip(texts, labels, strict=True):
        if words:
            own, grams, _ = hashed(list(dict.fromkeys(words)))
            seen[0, label, np.unique(own)] += 1
            seen[1, label, np.unique(grams)] += 1
    n = np.array([max(1, (labels == v).sum()) for v in (0, 1)])
    for which, name in enumerate(("word", "chars")):
        odds = np.log((seen[which, 1] + 0.5) / (n[1] + 1)) - np.log((seen[which, 0] + 0.5) / (n[0] + 1))
        getattr(net, name)[:, 0] = np.clip(np.where(seen[which].sum(0) >= 3, odds, 0), -2, 4)
    return net


def train(rows: Sequence[tuple[str, int]], share: float, seed: int = 7) -> Network:
    """Trains on labelled texts; ``share`` of label 1 among all texts sets the curve."""
    once: dict[str, str] = {}  # words repeat: a word is one string for all texts, or they would take many times their bytes
    texts, labels = [[once.setdefault(w, w) for w in words_of(t)] for t, _ in rows], np.array([y for _, y in rows], np.int64)
    net = _fresh(texts, labels, seed)
    if len(set(labels.tolist())) < 2:
        net.curve, net.nothing = (0.0, float(np.log(share / (1 - share)))), 0.0
        return net
    net._most = REMEMBERED_THERE
    rng, trainer = np.random.default_rng(seed), _Trainer(net)
    odds = {w: float(net.word[zlib.crc32(b"<" + w.encode() + b">") % BUCKETS, 0]) for w in {w for ws in texts for w in ws}}
    starts = [window_starts(len(ws)) for ws in texts]
    top = []
    for ws, s in zip(texts, starts, strict=True):
        sums = np.cumsum([0.0, *(max(0.0, odds[w]) for w in ws)])
        top.append(max(s, key=lambda a, n=len(ws), sums=sums: sums[min(n, a + WINDOW)] - sums[a]) if s else None)
    for epoch in range(EPOCHS):
        if epoch in CHOOSE:
            logit, owner, first = net.windows(texts)
            net.forget()
            order = np.lexsort((first, -logit, owner))
            owners, at = np.unique(owner[order], return_index=True)
            for k, i in zip(owners, order[at], strict=True):
                top[k] = int(first[i])
        chosen, marks = [], []
        for k, (ws, s) in enumerate(zip(texts, starts, strict=True)):
            if not s:
                continue
            chosen.append(ws[top[k] : top[k] + WINDOW])
            marks.append(labels[k])
            if not labels[k] and len(s) > 1:  # any window of a clean document is clean
                a = s[rng.integers(len(s))]
                chosen.append(ws[a : a + WINDOW])
                marks.append(0)
        marks = np.array(marks, np.float32)
        weight = np.where(marks == 1, len(marks) / max(1, 2 * marks.sum()), len(marks) / max(1, 2 * (1 - marks).sum())).astype(np.float32)
        order = rng.permutation(len(chosen))
        for a in range(0, len(order), BATCH):
            part = order[a : a + BATCH]
            trainer.batch([chosen[i] for i in part], marks[part], weight[part])
    found = net.highest(texts)
    net.forget()
    some = np.array([bool(ws) for ws in texts])
    net.nothing = float(np.quantile(found[some & (labels == 0)], 0.05)) if (some & (labels == 0)).any() else -4.0
    net.curve = fit_logistic(np.clip(found, -12, 12), labels, prior_weights(labels, share))
    return net


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Network:
    """Learns from at most ``per_class`` labelled documents of each class, whole, none of the held-out fold."""
    return train(labelled(docs, labels, "toxic", per_class), class_share(labels, "toxic"))


def with_score(docs: DataFrame, net: Network, name: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score under ``name``, row by row; a column of that name is replaced."""
    return scored(docs, lambda texts: chance(np.clip(net.logits(texts), -12, 12), *net.curve), name=name)


def score(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, score): the chance that each whole text is toxic.

    A null, empty or wordless text gets what a clearly clean one gets. A null doc_id stays null; repeated rows each
    give a row; an empty table gives none. Other columns of ``docs`` are not read.
    """
    return with_score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), net).select("doc_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    done = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return done.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
