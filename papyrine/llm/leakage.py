"""Problem 9: test items in the corpus, by latent semantic retrieval and exact checks.

The vocabulary is the test items' own: a passage is a window of words, its TF-IDF
weights are projected on the leading directions of the corpus passages (a distributed
randomised SVD over that vocabulary), and windows whose cosine to a window of an item
is high are candidates. Windows made of other words are ruled out by their weight alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.llm.shingles import words_of
from papyrine.plans.layout import cut, spread

#: Words of a window; a shared run of as many words is a leak.
WINDOW = 12
#: Latent directions, and those more that the range finder draws.
RANK, OVERSAMPLE = 64, 8
#: Share of a window's weight that must lie in the items' vocabulary, and the least cosine of a candidate.
SHARE, COSINE = 0.7, 0.93
#: Cells of the latent index: sign bits, and the weakest of an item's bits that are flipped as well.
CELL_BITS, FLIPS = 12, 3
#: Items and their words searched at a time; more are taken in blocks, so what is broadcast has a bound.
ITEM_BLOCK, ITEM_WORDS = 20_000, 2_000_000
#: Tasks for each core that sum over the corpus: each passes on one row a word of the vocabulary, however many files it reads.
SUMMING = 2
#: Paraphrases: share of an item's words in the longest common subsequence, and of its rare words (the answer) in the passage.
LCS_SHARE, ANSWER_SHARE, HITS = 0.6, 0.5, 3


@dataclass
class Items:
    """The test items as vocabulary ids; id 0 is any word that no item holds."""

    ids: list[int]
    words: list[np.ndarray]
    vocabulary: dict[str, int]


def read_items(rows: list[tuple[int, str | None]]) -> Items:
    vocabulary: dict[str, int] = {}
    ids, words = [], []
    for item, text in rows:
        if text:
            ids.append(item)
            words.append(np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text)], np.int32))
    return Items(ids, words, vocabulary)


def _encode(documents: DataFrame, items: Items, key: str, text: str) -> DataFrame:
    """(doc_id, ids): each text as ids of the items' vocabulary, written once for the passes that follow."""
    held = documents.sparkSession.sparkContext.broadcast(items.vocabulary)
    kind = np.uint16 if len(items.vocabulary) < 65_000 else np.int32

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = held.value.get
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "ids": [np.array([get(w, 0) for w in words_of(t)], kind).tobytes() for t in pdf["text"]]})

    rows = spread(documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).where("text is not null"))
    return cut(rows.mapInPandas(run, "doc_id long, ids binary"))


def _read(pdf: pd.DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts one after another, number per text)."""
    kind = np.uint16 if size < 65_000 else np.int32
    n = np.array([len(x) // kind().itemsize for x in pdf["ids"]], np.int64)
    return np.frombuffer(b"".join(pdf["ids"]), kind).astype(np.int64), n


def _slices(batches: Iterator[pd.DataFrame], size: int, words: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Texts a few at a time, so that what is made of their words fits in memory; a very long one stands alone."""
    for pdf in batches:
        ids, n = _read(pdf, size)
        ends, lo, at = np.cumsum(n), 0, 0
        while lo < len(n):
            hi = max(lo + 1, int(np.searchsorted(ends, at + words, side="right")))
            if ends[hi - 1] > at:
                yield ids[at : ends[hi - 1]], n[lo:hi]
            lo, at = hi, int(ends[hi - 1])


def _few(encoded: DataFrame) -> DataFrame:
    """The same rows in a number of partitions that follows the cores and not the corpus, without a shuffle."""
    return encoded.coalesce(SUMMING * encoded.sparkSession.sparkContext.defaultParallelism)


def _weights(encoded: DataFrame, size: int) -> np.ndarray:
    """Squared IDF of each vocabulary word over all documents; words outside weigh as much as one seen once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, docs = np.zeros(size + 1, np.int64), 0
        for pdf in batches:
            ids, n = _read(pdf, size)
            owner = np.repeat(np.arange(len(n)), n)
            seen = np.unique(owner * (size + 1) + ids)
            df += np.bincount(seen % (size + 1), minlength=size + 1)
            docs += len(n)
        df[0] = docs
        yield pd.DataFrame({"word": np.arange(size + 1), "df": df})

    rows = _few(encoded).mapInPandas(run, "word int, df long").groupBy("word").agg(F.sum("df").alias("df")).collect()
    df = np.zeros(size + 1)
    for r in rows:
        df[r.word] = r.df
    docs, df[0] = df[0], 0
    # Squared, so that the words every text is made of do not fill the leading directions.
    return (np.log((docs + 1) / (df + 1)) + 0.1) ** 2


def _directions(encoded: DataFrame, idf: np.ndarray) -> np.ndarray:
    """Leading right singular directions of the TF-IDF matrix of all corpus passages.

    One pass over the passages accumulates A'(A G) for a Gaussian G; its range holds the
    leading directions. What is summed and returned has one row per vocabulary word.
    """
    size, k = len(idf) - 1, RANK + OVERSAMPLE
    g = np.random.default_rng(9).standard_normal((size + 1, k)).astype(np.float32)
    g[0] = 0
    weight = idf.astype(np.float32).copy()
    weight[0] = 0
    wg = g * weight[:, None]
    columns = [f"c{i}" for i in range(k)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size + 1, k))
        for ids, n in _slices(batches, size):
            starts = np.cumsum(n) - n
            at = np.arange(len(ids)) - np.repeat(starts, n)
            first = np.flatnonzero(at % WINDOW == 0)
            y = np.add.reduceat(wg[ids], first, axis=0)
            # Passages weigh alike, whatever rare words they hold.
            y /= np.maximum(np.add.reduceat((weight**2)[ids], first), 1e-6)[:, None]
            owner = np.cumsum(at % WINDOW == 0) - 1
            # Sum over passages of word weight times projection, word by word.
            keep = np.flatnonzero(ids)
            order = keep[np.argsort(ids[keep], kind="stable")]
            if len(order):
                w = ids[order]
                edge = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
                total[w[edge]] += np.add.reduceat(y[owner[order]], edge, axis=0) * weight[w[edge], None]
        out = pd.DataFrame(total[1:], columns=columns)
        out.insert(0, "word", np.arange(1, size + 1))
        yield out

    schema = "word int, " + ", ".join(f"{c} double" for c in columns)
    rows = _few(encoded).mapInPandas(run, schema).groupBy("word").agg(*[F.sum(c).alias(c) for c in columns]).collect()
    b = np.zeros((size + 1, k))
    for r in rows:
        b[r[0]] = r[1:]
    u, _, _ = np.linalg.svd(b, full_matrices=False)
    return u[:, :RANK]


class Index:
    """Item windows in cells of latent sign bits."""

    def __init__(self, items: Items, idf: np.ndarray, directions: np.ndarray):
        self.items, self.idf2 = items, (idf**2)
        self.latent = (directions * idf[:, None]).astype(np.float32)
        self.latent[0] = 0
        owner, start = [], []
        for i, w in enumerate(items.words):
            m = max(0, len(w) - WINDOW + 1)
            owner += [i] * m
            start += range(m)
        self.owner, self.start = np.array(owner, np.int64), np.array(start, np.int64)
        self.offset = np.cumsum([0] + [len(w) for w in items.words])
        self.all = np.concatenate([*items.words, np.zeros(0, np.int32)]).astype(np.int64)
        self.cells: dict[int, np.ndarray] = {}
        if not len(self.owner):
            return
        self.windows = self.all[(self.offset[self.owner] + self.start)[:, None] + np.arange(WINDOW)]
        v = self._project(self.windows)
        self.centre = v.mean(0)
        self.vectors, code, low = v, *self._cell(v)
        entries = [(code, np.arange(len(v)))]
        for f in range(1, 1 << FLIPS):
            c = code.copy()
            for j in range(FLIPS):
                if f >> j & 1:
                    c ^= 1 << low[:, j]
            entries.append((c, np.arange(len(v))))
        code, at = np.concatenate([c for c, _ in entries]), np.concatenate([a for _, a in entries])
        order = np.argsort(code, kind="stable")
        code, at = code[order], at[order]
        edge = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        self.cells = {int(code[s]): at[s:e] for s, e in zip(edge, np.r_[edge[1:], len(code)])}

    def _project(self, windows: np.ndarray) -> np.ndarray:
        v = np.zeros((len(windows), self.latent.shape[1]), np.float32)
        for j in range(WINDOW):  # in word order, so equal windows give equal numbers
            v += self.latent[windows[:, j]]
        return v / np.maximum(np.sqrt(np.einsum("ij,ij->i", v, v))[:, None], 1e-12)

    def _cell(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = (v - self.centre)[:, :CELL_BITS]
        code = ((c > 0) << np.arange(CELL_BITS)).sum(1)
        return code, np.argsort(np.abs(c), axis=1)[:, :FLIPS]

    def search(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window start, item window, cosine) of candidate windows over texts one after another."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if len(ids) < WINDOW or not self.cells:
            return none
        e = np.where(ids > 0, self.idf2[ids], 0.0)
        all_e = np.cumsum(np.r_[0.0, self.idf2[ids]])
        in_e = np.cumsum(np.r_[0.0, e])
        n = len(ids) - WINDOW + 1
        rows = np.repeat(np.arange(len(sizes)), sizes)
        ok = (rows[:n] == rows[WINDOW - 1 :]) & (in_e[WINDOW:] - in_e[:n] >= SHARE * (all_e[WINDOW:] - all_e[:n]) - 1e-9)
        at = np.flatnonzero(ok)
        out = []
        for lo in range(0, len(at), 20_000):
            part = at[lo : lo + 20_000]
            v = self._project(ids[part[:, None] + np.arange(WINDOW)])
            code, _ = self._cell(v)
            order = np.argsort(code, kind="stable")
            edge = np.flatnonzero(np.r_[True, code[order][1:] != code[order][:-1]])
            for s, t in zip(edge, np.r_[edge[1:], len(order)]):
                cell = self.cells.get(int(code[order[s]]))
                if cell is None:
                    continue
                rows_ = order[s:t]
                sim = v[rows_] @ self.vectors[cell].T
                i, j = np.nonzero(sim >= COSINE)
                out.append((part[rows_[i]], cell[j], sim[i, j]))
        if not out:
            return none
        return tuple(np.concatenate(x) for x in zip(*out))


def _lcs(a: np.ndarray, b: np.ndarray) -> int:
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        hit = np.r_[0, row[:-1] + (b == x)]
        row = np.maximum.accumulate(np.maximum(row, hit))
    return int(row[-1])


def _clusters(at: np.ndarray, reach: int) -> np.ndarray:
    """First position of each cluster of hits; a cluster's positions lie within ``reach`` of its first."""
    firsts, at = [], np.unique(at)
    while len(at):
        firsts.append(at[0])
        at = at[np.searchsorted(at, at[0] + reach, side="right") :]
    return np.array(firsts)


def leaked_items(documents: DataFrame, benchmark: DataFrame, paraphrases: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, kind, cosine, lcs_share): documents that hold passages of test items.

    kind "exact": at least WINDOW consecutive words are shared. With ``paraphrases``
    also "paraphrase": several candidate windows, a longest common subsequence of at least
    LCS_SHARE of the item's words and ANSWER_SHARE of its rare words around any cluster of
    those windows, the best of which is given. Null texts hold
    nothing and null items are not sought; items of fewer than WINDOW words cannot be
    found. Repeated rows give repeated results; empty tables give none. The items are
    the stated query set and are read in blocks of ITEM_BLOCK.
    """
    out = documents.sparkSession.createDataFrame([], "doc_id long, item_id long, kind string, cosine double, lcs_share double")
    for items in _item_blocks(benchmark):
        out = out.unionByName(_block(documents, items, paraphrases, key, text))
    return out


def _item_blocks(benchmark: DataFrame) -> Iterator[Items]:
    """The stated queries, at most ITEM_BLOCK items or about ITEM_WORDS words at a time."""
    rows: list[tuple[int, str]] = []
    words = 0
    for r in benchmark.select("item_id", "text").where("item_id is not null and text is not null").orderBy("item_id").toLocalIterator():
        more = len(words_of(r.text))
        if rows and (len(rows) == ITEM_BLOCK or words + more > ITEM_WORDS):
            yield read_items(rows)
            rows, words = [], 0
        rows.append((r.item_id, r.text))
        words += more
    if rows:
        yield read_items(rows)


def _block(documents: DataFrame, items: Items, paraphrases: bool, key: str, text: str) -> DataFrame:
    spark = documents.sparkSession
    encoded = _encode(documents, items, key, text)
    size = len(items.vocabulary)
    idf = _weights(encoded, size)
    directions = _directions(encoded, idf)
    held = spark.sparkContext.broadcast((items, idf, directions))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Index(*held.value)
        rare = np.quantile(index.idf2[1:], 0.5) if size else 0.0
        for pdf in batches:
            for lo in range(0, len(pdf), 1000):
                part = pdf.iloc[lo : lo + 1000]
                ids, n = _read(part, size)
                at, win, cos = index.search(ids, n)
                if not len(at):
                    continue
                ends = np.cumsum(n)
                doc = np.searchsorted(ends, at, side="right")
                same = (ids[at[:, None] + np.arange(WINDOW)] == index.windows[win]).all(1)
                key = doc * len(index.items.ids) + index.owner[win]
                out = []
                exact, where = np.unique(key[same], return_index=True)
                for k, c in zip(exact, cos[same][where]):
                    out.append((part["doc_id"].iloc[k // len(index.items.ids)], index.items.ids[k % len(index.items.ids)], "exact", float(c), None))
                if paraphrases:
                    rest = ~np.isin(key, exact)
                    best = pd.DataFrame({"key": key[rest], "at": at[rest], "cos": cos[rest]}).groupby("key").agg(hits=("at", "nunique"), places=("at", "unique"), cos=("cos", "max"))
                    for r in best[best["hits"] >= HITS].itertuples():
                        doc_no, item_no = r.Index // len(index.items.ids), r.Index % len(index.items.ids)
                        words = index.items.words[item_no]
                        answer = words[index.idf2[words] > rare]
                        share = 0.0
                        for first in _clusters(r.places, len(words)):
                            span = ids[max(int(ends[doc_no] - n[doc_no]), first - len(words)) : min(int(ends[doc_no]), first + 2 * len(words) + WINDOW)]
                            if not len(answer) or np.isin(answer, span).mean() >= ANSWER_SHARE:
                                share = max(share, _lcs(words.astype(np.int64), span) / len(words))
                        if share >= LCS_SHARE:
                            out.append((part["doc_id"].iloc[doc_no], index.items.ids[item_no], "paraphrase", float(r.cos), share))
                if out:
                    yield pd.DataFrame(out, columns=["doc_id", "item_id", "kind", "cosine", "lcs_share"])

    return encoded.mapInPandas(run, "doc_id long, item_id long, kind string, cosine double, lcs_share double")
