"""Hierarchical language discrimination with linear support vector machines.

A word's score vector has one entry per classifier: the first separates the
language families, the others are one-versus-one classifiers inside a family.
Sentence scores are sums of word scores, so a text is scored by looking its
words up and adding; the texts themselves never meet the n-gram features.

Units (sentences, or runs of ``MAX_UNIT`` words where a text has no sentence
ends) are then joined to stretches by a Viterbi pass whose cost of changing the
language depends on the kind of boundary.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import combinations

import numpy as np

# The languages of the reference sentences by family.
FAMILIES = {"germanic": ("de", "en", "nl"), "romance": ("es", "fr", "it", "pt")}
LANGS = tuple(x for v in FAMILIES.values() for x in v)
PAIRS = tuple(p for v in FAMILIES.values() for p in combinations(v, 2))

#: Training rows that must hold an n-gram.
LEAST_GRAM = 3
#: Words a unit has at most.
MAX_UNIT = 10
#: Words kept in a worker's score cache before it starts anew (memory bound only).
CACHE_WORDS = 400_000
#: Cost of changing the language at a paragraph or sentence end, a line end, a cut inside a line.
SWITCH = (4.0, 7.0, 11.0)
#: Words of evidence that a stretch needs: shorter ones are names, codes or headings.
MIN_WORDS = 4

#: Words of a block of the first look at a text, and the gain over the text's own language that calls for a closer one.
BLOCK, BLOCK_GAIN, PAIR_GAIN = 5, 3.5, 2.5
#: A stretch less sure than this takes the language beside it.
MIN_CONFIDENCE = 0.8

_URL = re.compile(r"\w+://\S+|\S+@\S+\.\w+")
_WORD = re.compile(r"[^\W_]+")
_TOKEN = re.compile(r"[^\W_]+|[.!?…]+(?=[\s\"”»’)\]*_|]|$)|\n[^\S\n]*(?:\n\s*)?|[;:|\t]")

def word_grams(word: str) -> set[str]:
    """Features of a lower-case word: the word and its 2- to 4-grams, with word ends."""
    w = f"^{word}$"
    n = len(w)
    grams = {w}
    grams.update([w[i : i + 2] for i in range(n - 1)], [w[i : i + 3] for i in range(n - 2)], [w[i : i + 4] for i in range(n - 3)])
    return grams


def _fit_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, steps: int = 80) -> np.ndarray:
    """Squared-hinge linear SVM without bias by accelerated gradient descent."""
    w = np.zeros(x.shape[1], x.dtype)
    v = w.copy()
    # The largest eigenvalue of X'X bounds the step.
    p = np.full(x.shape[1], x.shape[1] ** -0.5, x.dtype)
    for _ in range(12):
        p = x.T @ (x @ p)
        top = np.linalg.norm(p)
        p /= top
    step = 1.0 / (1.0 + 2.0 * c / len(y) * top)
    for t in range(steps):
        slack = np.maximum(0.0, 1.0 - y * (x @ v))
        grad = v - (2.0 * c / len(y)) * (x.T @ (y * slack))
        new = v - step * grad
        v = new + (t / (t + 3.0)) * (new - w)
        w = new
    return w


class LanguageModel:
    """A row of weights for each n-gram of the training rows; picklable and small."""

    def __init__(self, grams: dict[str, int], weights: np.ndarray, scale: np.ndarray):
        self.grams, self.weights, self.scale = grams, weights, scale
        self._clear()

    def _clear(self) -> None:
        self.cache: dict[str, int] = {}
        self.matrix = np.zeros((4096, self.weights.shape[1]), np.float32)
        self.rows = 1  # row 0 stands for what says nothing about the language

    def __reduce__(self):
        return LanguageModel, (self.grams, self.weights, self.scale)

    def _learn(self, word: str) -> int:
        if not word.isalpha():
            return 0
        if self.rows == len(self.matrix):
            self.matrix = np.concatenate([self.matrix, np.zeros_like(self.matrix)])
        grams = word_grams(word)
        f = [i for i in map(self.grams.get, grams) if i is not None]
        if f:
            self.matrix[self.rows] = self.weights[f].sum(0) / len(grams) ** 0.5
        self.cache[word] = self.rows
        self.rows += 1
        return self.rows - 1

    def ids(self, words: list[str]) -> np.ndarray:
        """Rows of the score matrix for lower-case words."""
        out = list(map(self.cache.get, words))
        if None in out:
            learn = self._learn
            out = [(self.cache.get(w) or learn(w)) if i is None else i for i, w in zip(out, words)]
        return np.array(out, np.int64)

    def tidy(self) -> None:
        """Between batches: bounds the memory of the cache."""
        if self.rows > CACHE_WORDS:
            self._clear()

    def log_odds(self, sums: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Log probability of each language of units with these sums of word scores."""
        z = sums * self.scale / np.sqrt(np.maximum(n, 1))[:, None]
        logp = np.zeros((len(sums), len(LANGS)))
        soft = lambda a: -np.logaddexp(0.0, -a)
        for f, (name, langs) in enumerate(FAMILIES.items()):
            fam = soft(z[:, 0] if f == 0 else -z[:, 0])
            inner = np.zeros((len(sums), len(langs)))
            for k, (a, b) in enumerate(PAIRS):
                if a in langs:
                    inner[:, langs.index(a)] += soft(z[:, 1 + k])
                    inner[:, langs.index(b)] += soft(-z[:, 1 + k])
            inner -= np.logaddexp.reduce(inner, axis=1, keepdims=True)
            for j, x in enumerate(langs):
                logp[:, LANGS.index(x)] = fam + inner[:, j]
        return logp


def train(samples: list[tuple[str, str]], window: int = 5, stride: int = 2) -> LanguageModel:
    """Fits on (language, sentence) rows.

    The caller bounds the number of rows. Whole sentences and windows of ``window``
    words every ``stride`` words are the training examples, so short units are known.
    """
    rows, labels = [], []
    for lang, text in samples:
        if lang not in LANGS or not text:
            continue
        words = [w for w in _WORD.findall(text.lower()) if w.isalpha()]
        parts = [words] + [words[i : i + window] for i in range(0, max(1, len(words) - window + 1), stride)]
        for p in parts:
            if p:
                rows.append(p)
                labels.append(lang)
    seen = Counter(g for r in rows for w in set(r) for g in word_grams(w))
    col = {g: i for i, g in enumerate(sorted(g for g, n in seen.items() if n >= LEAST_GRAM))}
    x = np.zeros((len(rows), len(col)), np.float32)
    for i, r in enumerate(rows):
        for w in r:
            f = word_grams(w)
            x[i, [col[g] for g in f if g in col]] += 1.0 / len(f) ** 0.5
        x[i] /= np.sqrt(len(r))
    labels = np.array(labels)
    weights = np.zeros((len(col), 1 + len(PAIRS)))
    scale = np.ones(1 + len(PAIRS))
    family = np.array([1.0 if x in FAMILIES["germanic"] else -1.0 for x in labels])
    tasks = [(np.ones(len(labels), bool), family)]
    for a, b in PAIRS:
        tasks.append((np.isin(labels, [a, b]), np.where(labels == a, 1.0, -1.0)))
    for k, (keep, y) in enumerate(tasks):
        if keep.sum() < 2:
            continue
        w = _fit_svm(x[keep], y[keep].astype(np.float32))
        weights[:, k] = w
        margin = np.abs(x[keep] @ w)
        # A unit of the usual margin is believed with odds of e^6.
        scale[k] = 6.0 / max(np.median(margin), 1e-6)
    return LanguageModel(col, weights.astype(np.float32), scale)


def _blank_urls(text: str) -> str:
    return _URL.sub(lambda m: " " * len(m.group()), text) if "://" in text or "@" in text else text


def stretches_many(model: LanguageModel, texts: list[str]) -> list[list[tuple[int, str, float, int, int]]]:
    """``stretches`` of each text; texts whose blocks all agree with the whole are done together."""
    model.tidy()
    texts = [_blank_urls(t) for t in texts]
    words = [_WORD.findall(t.lower()) for t in texts]
    out: list[list] = [[] for _ in texts]
    full = [i for i, w in enumerate(words) if w]
    if not full:
        return out
    ids = model.ids([w for i in full for w in words[i]])
    sizes = np.array([len(words[i]) for i in full])
    ends = np.cumsum(sizes)
    begins = ends - sizes
    blocks = np.maximum(1, -(-sizes // BLOCK))
    owner = np.repeat(np.arange(len(full)), blocks)
    first_block = np.cumsum(blocks) - blocks
    at = begins[owner] + (np.arange(len(owner)) - first_block[owner]) * BLOCK
    known = (ids > 0).astype(np.int64)
    sums, n = np.add.reduceat(model.matrix[ids], at, axis=0), np.add.reduceat(known, at)
    logp = model.log_odds(sums, n)
    whole_n = np.add.reduceat(n, first_block)
    whole_sums = np.add.reduceat(sums, first_block, axis=0)
    best = np.argmax(np.add.reduceat(logp, first_block, axis=0), axis=1)
    conf = np.exp(model.log_odds(whole_sums, np.maximum(whole_n, 1)))[np.arange(len(full)), best]
    gain = logp.max(1) - logp[np.arange(len(owner)), best[owner]]
    pair = np.zeros(len(owner))
    if len(owner) > 1:
        two = model.log_odds(sums[:-1] + sums[1:], n[:-1] + n[1:])
        pair[:-1] = np.where(owner[:-1] == owner[1:], two.max(1) - two[np.arange(len(two)), best[owner[:-1]]], 0.0)
    odd = np.maximum.reduceat((gain > BLOCK_GAIN) | (pair > PAIR_GAIN), first_block)
    for k, i in enumerate(full):
        if odd[k]:
            out[i] = stretches(model, texts[i])
        else:
            out[i] = [(0, LANGS[best[k]], round(float(conf[k]), 4) if whole_n[k] else 0.0, 0, len(texts[i]))]
    return out


def stretches(model: LanguageModel, text: str) -> list[tuple[int, str, float, int, int]]:
    """(seg_no, language, confidence, first character, end) of the maximal stretches of one language."""
    words, starts = [], []
    units: list[tuple[int, int, int]] = []  # first word, end word, kind of the boundary before
    begin, kind = 0, 0
    text = _blank_urls(text)
    for m in _TOKEN.finditer(text):
        t = m.group()
        if t[0].isalnum():
            if len(words) - begin >= MAX_UNIT:
                units.append((begin, len(words), kind))
                begin, kind = len(words), 2
            words.append(t.lower())
            starts.append(m.start())
            continue
        if len(words) > begin:
            units.append((begin, len(words), kind))
            begin, kind = len(words), 2
        kind = min(kind, 0 if t[0] in ".!?…" or t.count("\n") > 1 else 1)
    if len(words) > begin:
        units.append((begin, len(words), kind))
    if not words:
        return []
    return join_units(model, model.ids(words), units, starts, len(text))


def join_units(model, ids, units, starts, length):
    s = model.matrix[ids]
    u = np.array([a for a, _, _ in units])
    sums = np.add.reduceat(s, u, axis=0)
    n = np.add.reduceat((ids > 0).astype(np.int64), u)
    logp = model.log_odds(sums, n)
    whole = int(np.argmax(logp.sum(0)))
    gain = logp.max(1) - logp[:, whole]
    if gain.max(initial=0.0) <= min(SWITCH):
        path = np.full(len(units), whole)
    else:
        path = _viterbi(logp, np.array([SWITCH[min(k, 2)] for _, _, k in units]))
    path = _drop_weak(path, n, logp, lambda a, b: model.log_odds(sums[a:b].sum(0, keepdims=True), n[a:b].sum(keepdims=True))[0])
    out, i = [], 0
    while i < len(units):
        j = i
        while j < len(units) and path[j] == path[i]:
            j += 1
        w = n[i:j].sum()
        p = model.log_odds(sums[i:j].sum(0, keepdims=True), np.array([max(w, 1)]))[0]
        conf = float(np.exp(p[path[i]])) if w else 0.0
        a = 0 if i == 0 else starts[units[i][0]]
        b = starts[units[j][0]] if j < len(units) else length
        out.append((len(out), LANGS[path[i]], round(conf, 4), a, b))
        i = j
    return out


def _viterbi(logp: np.ndarray, cost: np.ndarray) -> np.ndarray:
    n, k = logp.shape
    back = np.zeros((n, k), np.int64)
    best = logp[0].copy()
    for t in range(1, n):
        j = int(np.argmax(best))
        jump = best[j] - cost[t]
        stay = best >= jump
        back[t] = np.where(stay, np.arange(k), j)
        best = np.where(stay, best, jump) + logp[t]
    path = np.zeros(n, np.int64)
    path[-1] = int(np.argmax(best))
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def _drop_weak(path: np.ndarray, n: np.ndarray, logp: np.ndarray, odds) -> np.ndarray:
    """Gives stretches with too few words or too little confidence to their neighbours, the weakest first."""
    path = path.copy()
    while True:
        edges = [0, *(np.flatnonzero(np.diff(path)) + 1), len(path)]
        if len(edges) == 2:
            return path
        runs = []
        for a, b in zip(edges, edges[1:]):
            words = int(n[a:b].sum())
            sure = float(np.exp(odds(a, b)[path[a]])) if words else 0.0
            if words < MIN_WORDS or sure < MIN_CONFIDENCE:
                runs.append((words * sure, a, b))
        if not runs:
            return path
        _, a, b = min(runs)
        near = [path[a - 1]] if a else []
        near += [path[b]] if b < len(path) else []
        path[a:b] = max(near, key=lambda x: logp[a:b, x].sum())
