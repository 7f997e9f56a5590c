"""Problem 10: text decoded with the wrong code page, found and restored.

A swap of code pages is a substitution cipher on the characters beyond ASCII. What
a run of such characters stands for is a hidden variable: itself, what it undoes to
under a swap, or, where no swap named beforehand explains it, any letter of the
languages. Expectation-maximization over counts of (source, character before, run,
character after) learns the bigrams of the clean languages, which swaps each source shows,
and, for runs that are no letters of the languages, each source's own mapping of symbols to
letters. A mapping that agrees with a pair of code pages stands for that pair, with the
symbols that were not seen; any other is applied as it was learned. A document is undone swap by swap
with ``translate()`` as far as the evidence of its own runs goes.
"""

from __future__ import annotations

import encodings as codecs_
import hashlib
import json
import math
import pkgutil
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.plans.layout import cut, drop, spread

# Code pages that texts of these languages are written in, where learning begins.
PAGES = ("cp1252", "latin-1", "cp437", "cp850", "mac_roman")
# Letters beyond ASCII of the languages, and signs that their texts use.
LETTERS = "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœßÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝŒ"
SIGNS = "‘’‚“”„‹›«»–—…•·€£¥§°ªº²³¹¼½¾±×÷µ¿¡©®™†‡\xa0\xad"
#: Rounds of expectation-maximization, and the prior odds of a run being garbled.
ROUNDS, PRIOR = 2, 0.01
#: Expected number of garbled runs from which on a source shows a swap.
SUPPORT = 0.3
#: Log odds that a document's runs must gather for a swap before any of them is undone.
EVIDENCE = 6.0
#: Times that clean texts must hold a character before anything is restored to it.
KNOWN = 2.0
#: Longer runs, as other scripts have, are counted in parts of this length.
LONG_RUN = 24
#: A mapping is learned in at most so many rounds; a symbol of it needs this many occurrences and share of its letter, and a pair of pages this many symbols.
MAPPING_ROUNDS, SEEN, SURE, SYMBOLS = 40, 5, 0.75, 2
#: Symbols that a mapping without a pair of pages needs, and characters of a symbol at most.
OWN, SYMBOL = 4, 3
_RUN = re.compile("[\x80-\U0010ffff]+")


def _table(page: str) -> dict[str, int]:
    """Character to byte for bytes from 0x80; bytes that a page leaves open stand for the control of that number."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            c = bytes([b]).decode(page)
        except UnicodeDecodeError:
            c = chr(b)
        out[c] = b
    return out


@cache
def page_bytes(page: str) -> dict[str, int]:
    return _table(page)


@cache
def single_byte_pages() -> tuple[str, ...]:
    """Every code page of the standard library that keeps ASCII and gives most other bytes a character each."""
    ascii_ = bytes(range(32, 127))
    out = []
    for name in sorted(m.name for m in pkgutil.iter_modules(codecs_.__path__)):
        try:
            high = [bytes([b]).decode(name, "replace") for b in range(0x80, 0x100)]
            if "escape" not in name and name != "charmap" and ascii_.decode(name) == ascii_.decode("ascii") and len(set(high) - {"\ufffd"}) >= 64 and len(bytes([0x81, 0x40]).decode(name, "replace")) == 2:
                out.append(name)
        except (LookupError, UnicodeError, ValueError, TypeError, AssertionError):
            continue
    return tuple(out)




def _undo_utf8(run: str, page: str) -> str:
    """UTF-8 read as ``page``: valid sequences become their character, anything else stays."""
    table = page_bytes(page)
    out, i, n = [], 0, len(run)
    while i < n:
        b = table.get(run[i])
        size = 0 if b is None else 2 if 0xC2 <= b <= 0xDF else 3 if 0xE0 <= b <= 0xEF else 4 if 0xF0 <= b <= 0xF4 else 0
        if size and i + size <= n:
            rest = [table.get(c) for c in run[i + 1 : i + size]]
            if all(x is not None and 0x80 <= x <= 0xBF for x in rest):
                try:
                    out.append(bytes([b, *rest]).decode("utf-8"))
                    i += size
                    continue
                except UnicodeDecodeError:
                    pass
        out.append(run[i])
        i += 1
    return "".join(out)


@cache
def swap_table(written: str, read: str) -> dict[int, str]:
    back = {b: c for c, b in page_bytes(written).items()}
    return {ord(c): back[b] for c, b in page_bytes(read).items() if back.get(b, c) != c}


CHANNELS = (*(f"utf-8>{p}" for p in PAGES), "utf-8>cp1252 twice", "utf-8>latin-1 twice", *(f"{w}>{r}" for w in PAGES if w != "latin-1" for r in PAGES if r != "latin-1" and w != r))


@cache
def _learned_table(channel: str) -> tuple[dict[int, str], dict[str, str], re.Pattern | None]:
    """(single symbols for translate(), longer symbols, a pattern of those) of a mapping written out in JSON."""
    pairs = json.loads(channel)
    long = {k: v for k, v in pairs.items() if len(k) > 1}
    return str.maketrans({k: v for k, v in pairs.items() if len(k) == 1}), long, re.compile("|".join(sorted(map(re.escape, long), key=len, reverse=True))) if long else None


@lru_cache(100_000)
def undo(run: str, channel: str) -> str:
    if channel[0] == "{":
        single, long, pattern = _learned_table(channel)
        return (pattern.sub(lambda m: long[m.group()], run) if pattern else run).translate(single)
    written, read = channel.split(">")
    if written != "utf-8":
        return run.translate(swap_table(written, read))
    page, _, again = read.partition(" ")
    once = _undo_utf8(run, page)
    return _undo_utf8(once, page) if again and once != run else once


def _class(c: str) -> str:
    """A neighbour as the model knows it: letters in lower case, digits and white space as one each."""
    if not c or c.isspace():
        return " "
    if c.isdigit():
        return "0"
    return c.lower()[:1]


class Bigrams:
    """Counts of (before, character, after) around characters beyond ASCII, with bigram back-off."""

    def __init__(self, counts: dict[tuple[str, str, str], float], shares: dict[str, dict[str, float]] | None = None):
        self.n3, self.shares = counts, shares or {}
        self.left, self.right, self.one = Counter(), Counter(), Counter()
        for (a, c, b), n in counts.items():
            self.left[a, c] += n
            self.right[c, b] += n
            self.one[c] += n
        self.total = max(1.0, sum(self.one.values()))

    def __reduce__(self):
        return Bigrams, (self.n3, self.shares)

    def log(self, a: str, c: str, b: str) -> float:
        if ord(c) < 128:
            return 0.0
        x, y, z = _class(a), c.lower()[:1], _class(b)
        n1 = self.one.get(y, 0.0)
        n = self.n3.get((x, y, z), 0.0)
        if n1:
            n += 0.1 * self.left.get((x, y), 0.0) * self.right.get((y, z), 0.0) / n1
        p = (n + 0.02) / self.total
        if a.isalpha() and a.islower() and c.isupper():
            p *= 1e-4
        return math.log(p)

    def knows(self, value: str) -> bool:
        """Whether clean texts hold all of these characters: two legible ones can also be valid bytes of a third by chance."""
        return all(ord(c) < 128 or self.one.get(c.lower()[:1], 0.0) >= KNOWN for c in value)

    def text(self, a: str, run: str, b: str) -> float:
        t, s = f"{a or ' '}{run}{b or ' '}", 0.0
        for i in range(1, len(t) - 1):
            s += self.log(t[i - 1], t[i], t[i + 1])
        return s


def runs_of(text: str) -> list[tuple[int, str, str, str]]:
    """(start, before, run, after) of the runs beyond ASCII."""
    n = len(text)
    return [(m.start(), text[m.start() - 1] if m.start() else "", m.group(), text[m.end()] if m.end() < n else "") for m in _RUN.finditer(text)]


def options(run: str) -> dict[str, list[str]]:
    """What a run may stand for, and the swaps that say so."""
    out: dict[str, list[str]] = {}
    for k in CHANNELS:
        u = undo(run, k)
        if u != run:
            out.setdefault(u, []).append(k)
    return out


def _counted(rows: DataFrame) -> DataFrame:
    """(source, a, run, b, n) over all documents, pre-aggregated in each task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for pdf in batches:
            for s, t in zip(pdf["source"], pdf["text"]):
                for m in _RUN.finditer(t):
                    i, end = m.span()
                    while i < end:
                        j = min(end, i + LONG_RUN)
                        seen[s, t[i - 1 : i], t[i:j], t[j : j + 1]] += 1
                        i = j
            if len(seen) > 200_000:
                yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["source", "a", "run", "b", "n"])
                seen.clear()
        if seen:
            yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["source", "a", "run", "b", "n"])

    return rows.mapInPandas(run, "source string, a string, run string, b string, n long").groupBy("source", "a", "run", "b").agg(F.sum("n").alias("n"))


def _collect_bigrams(rows: DataFrame) -> Bigrams:
    """The model's size is bounded by the alphabet: classes before and after, and one character."""
    return Bigrams({(r.a, r.c, r.b): r.n for r in rows.groupBy("a", "c", "b").agg(F.sum("n").alias("n")).where("n >= 0.5").collect()})


def _foreign(c: str) -> bool:
    return not c.isascii() and c not in LETTERS and c not in SIGNS


def _odd(run: str, a: str, b: str, may) -> bool:
    """A symbol inside or beside a word that no text of the languages holds and no swap named beforehand turns into one that might."""
    if len(run) > SYMBOL or "\ufffd" in run or not (a.isascii() and a.isalpha() or b.isascii() and b.isalpha()):
        return False
    return any(map(_foreign, run)) and all(any(map(_foreign, u)) for u in may)


def _expected(counted: DataFrame, model: Bigrams | None, last: bool = False) -> DataFrame:
    """One expectation step: (kind, source, value, a, c, b, n).

    kind 0 has expected counts of clean characters c with their neighbours; after the last round
    kind 1 has the expected number of a source's runs that the swap ``value`` garbled, kind 2 the counts
    of symbols c that neither letters nor a swap explain, and kind 3 how often a symbol c stands for ``value`` anywhere.
    """
    held = counted.sparkSession.sparkContext.broadcast(model)
    columns = ["kind", "source", "value", "a", "c", "b", "n"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = held.value
        for pdf in batches:
            clean: Counter = Counter()
            swaps: Counter = Counter()
            odd: Counter = Counter()
            shares: Counter = Counter()
            for s, a, r, b, n in zip(pdf["source"], pdf["a"], pdf["run"], pdf["b"], pdf["n"]):
                if m is None:
                    values = [(r, 1.0)]
                else:
                    may = options(r)
                    found = [(r, m.text(a, r, b))] + [(u, m.text(a, u, b) + math.log(PRIOR)) for u in may]
                    top = max(x for _, x in found)
                    w = [(u, math.exp(x - top)) for u, x in found]
                    z = sum(x for _, x in w)
                    values = [(u, x / z) for u, x in w if x / z > 1e-4]
                if last:
                    for u, p in values:
                        for k in may[u] if u != r else ():
                            swaps[s, k] += n * p
                        if len(r) <= SYMBOL and may:
                            shares[u, r] += n * p
                    if _odd(r, a, b, may):
                        odd[s, _class(a), r, _class(b)] += n
                    continue
                for u, p in values:
                    t = f"{a or ' '}{u}{b or ' '}"
                    for i in range(1, len(t) - 1):
                        if ord(t[i]) > 127 and not (t[i - 1].islower() and t[i].isupper()):
                            clean[_class(t[i - 1]), t[i].lower()[:1], _class(t[i + 1])] += n * p
            rows = [(0, None, None, *k, float(n)) for k, n in clean.items()]
            rows += [(1, *k, None, None, None, float(n)) for k, n in swaps.items()]
            rows += [(2, s, None, a, c, b, float(n)) for (s, a, c, b), n in odd.items()]
            rows += [(3, None, u, None, c, None, float(n)) for (u, c), n in shares.items()]
            if rows:
                yield pd.DataFrame(rows, columns=columns)

    return counted.mapInPandas(run, "kind int, source string, value string, a string, c string, b string, n double")


def symbol_mapping(contexts: list[tuple[str, str, str, float]], model: Bigrams) -> dict[str, tuple[str, float]]:
    """{symbol: (letter, occurrences)}: what the symbols of one source stand for, from rows (before, symbol, after, count).

    Each symbol has a distribution over the letters of the languages, even at first. A round takes
    each occurrence's letter as likely as its symbol's share of it times the bigrams
    around it, and the new shares are the sums.
    """
    letters = [x for x in LETTERS if model.one.get(x.lower(), 0.0) >= KNOWN]
    symbols = sorted({c for _, c, _, _ in contexts})
    if not letters or not symbols:
        return {}
    at = {c: i for i, c in enumerate(symbols)}
    around = sorted({(a, b) for a, _, b, _ in contexts})
    spot = {x: i for i, x in enumerate(around)}
    score = np.array([[model.log(a, x, b) for x in letters] for a, b in around])
    fit = np.exp(score - score.max(1, keepdims=True))
    row = np.array([at[c] for _, c, _, _ in contexts])
    place = np.array([spot[a, b] for a, _, b, _ in contexts])
    n = np.array([x for *_, x in contexts])
    share = np.full((len(symbols), len(letters)), 1.0 / len(letters))
    for _ in range(MAPPING_ROUNDS):
        part = share[row] * fit[place]
        part *= (n / np.maximum(part.sum(1), 1e-300))[:, None]
        new = np.zeros_like(share)
        np.add.at(new, row, part)
        new = (new + 0.01 / len(letters)) / (new.sum(1, keepdims=True) + 0.01)
        done = np.abs(new - share).max() < 1e-4
        share = new
        if done:
            break
    total = np.bincount(row, n, len(symbols))
    best = share.argmax(1)
    # A letter must fit its places better than the languages' letters do on average.
    mean = np.zeros(len(symbols))
    np.add.at(mean, row, n * (score[place, best[row]] - np.log(np.exp(score[place]).mean(1))))
    return {c: (letters[best[i]], float(total[i])) for i, c in enumerate(symbols) if total[i] >= SEEN and share[i, best[i]] >= SURE and mean[i] > total[i]}


@cache
def _garbled_by_pages() -> dict[tuple[str, str], list[tuple[str, str, bool]]]:
    """(symbol, letter) to the pairs of pages (written, read) that make it."""
    out: dict[tuple[str, str], list] = {}
    for read in single_byte_pages():
        to = {b: c for c, b in page_bytes(read).items()}
        for x in LETTERS:
            if all(b in to for b in x.encode()):
                out.setdefault(("".join(to[b] for b in x.encode()), x), []).append(("utf-8", read))
            for written in PAGES:
                b = page_bytes(written).get(x)
                if b is not None and to.get(b, x) != x:
                    out.setdefault((to[b], x), []).append((written, read))
    return out


def channels_of(mapping: dict[str, tuple[str, float]]) -> list[str]:
    """The swaps that explain a learned mapping: pairs of pages, those first that explain most, and what is left as a mapping of its own."""
    out, left = [], dict(mapping)
    while len(left) >= SYMBOLS:
        votes: Counter = Counter()
        several: Counter = Counter()
        for c, (x, n) in left.items():
            # Letters are learned without regard to case where bigrams leave it open.
            for pair in set(_garbled_by_pages().get((c, x), ())) | set(_garbled_by_pages().get((c, x.swapcase()), ())):
                votes[pair] += n
                several[pair] += 1
        if not votes:
            break
        # Of pairs that explain as much, the one written in the page that stands first in the list.
        place = lambda pair: (PAGES.index(pair[0]) if pair[0] in PAGES else -1, pair[1] not in PAGES, pair[1])
        most = max(votes.values())
        written, read = min((pair for pair, n in votes.items() if n > most - 1e-6), key=place)
        if several[written, read] < SYMBOLS:
            break
        out.append(f"{written}>{read}")
        left = {c: v for c, v in left.items() if undo(c, out[-1]) == c}
    if len(left) >= OWN:
        out.append(json.dumps({c: x for c, (x, _) in sorted(left.items())}))
    return [k for k in out if k not in CHANNELS]


def learn(documents: DataFrame) -> tuple[Bigrams, DataFrame]:
    """(bigrams of the clean languages, (source, swaps, learned)): the swaps named beforehand that a source shows, and those learned from its symbols.

    The bigrams also get ``shares``: what symbols that a swap garbles at all stand for, bounded by the symbols of the swaps.
    """
    counted = cut(_counted(documents))
    model = _collect_bigrams(_expected(counted, None))
    for _ in range(ROUNDS):
        model = _collect_bigrams(_expected(counted, model))
    found = cut(_expected(counted, model, last=True))
    drop(counted)
    held = documents.sparkSession.sparkContext.broadcast(model)

    def mapping(pdf: pd.DataFrame) -> pd.DataFrame:
        # One row for each symbol and pair of neighbours: bounded by the alphabets, whatever the source holds.
        rows = list(zip(pdf["a"], pdf["c"], pdf["b"], pdf["n"]))
        return pd.DataFrame({"source": [pdf["source"].iloc[0]], "learned": [channels_of(symbol_mapping(rows, held.value))]})

    shown = found.where("kind = 1").groupBy("source", "value").agg(F.sum("n").alias("n")).where(F.col("n") >= SUPPORT).groupBy("source").agg(F.array_sort(F.collect_list("value")).alias("swaps"))
    symbols = found.where("kind = 2").groupBy("source", "a", "c", "b").agg(F.sum("n").alias("n"))
    learned = symbols.groupBy("source").applyInPandas(mapping, "source string, learned array<string>").where(F.size("learned") > 0)
    # What a symbol stands for is counted over all sources; symbols that are never garbled need no row.
    stands = found.where("kind = 3").groupBy("c", "value").agg(F.sum("n").alias("n"))
    garbled = stands.where("value != c").groupBy("c").agg(F.sum("n").alias("g")).where("g >= 0.5").select("c")
    for r in stands.join(garbled, "c", "left_semi").collect():
        model.shares.setdefault(r.c, {})[r.value] = r.n
    return model, cut(shown.join(learned, "source", "full"))


def _odds(model: Bigrams, a: str, run: str, b: str, value: str, learned: bool) -> float:
    """Log odds of a run standing for ``value`` and not for itself, before the document's own prior.

    Symbols that a swap was learned from are no letters, however often a source's texts hold them.
    """
    if not model.knows(value):
        return -math.inf
    if learned:
        strange = sum(map(_foreign, run))
        return model.text(a, value, b) + strange * math.log(model.total / 0.02) if strange else -math.inf
    x = model.text(a, value, b) - model.text(a, run, b)
    shares = model.shares.get(run)
    return x + max(-3.0, min(3.0, math.log((shares.get(value, 0.0) + 0.05) / (shares.get(run, 0.0) + 0.05)))) if shares else x


def restore(text: str, model: Bigrams, swaps: tuple[str, ...] = CHANNELS, learned: tuple[str, ...] = ()) -> str:
    """The text with all garbling undone; the same text if there is none."""
    seen = set()
    while text not in seen:
        seen.add(text)
        runs = runs_of(text)
        if not runs:
            return text
        known: dict[tuple, list[tuple[str, float]]] = {}
        best_channel, best = None, EVIDENCE
        gathered: Counter = Counter()
        for _, a, r, b in runs:
            key = (a, r, b)
            if key not in known:
                known[key] = [(k, _odds(model, a, r, b, u, False)) for k in swaps if (u := undo(r, k)) != r] + [(k, _odds(model, a, r, b, u, True)) for k in learned if (u := undo(r, k)) != r]
            for k, x in known[key]:
                if x > 0:
                    gathered[k] += x
        for k in (*swaps, *learned):
            if gathered[k] > best + 1e-9:
                best_channel, best = k, gathered[k]
        if best_channel is None:
            return text
        out, at = [], 0
        for i, a, r, b in runs:
            x = next((x for k, x in known[a, r, b] if k == best_channel), 0.0)
            out.append(text[at:i])
            out.append(undo(r, best_channel) if x > 0 else r)
            at = i + len(r)
        text = "".join(out) + text[at:]
    return text


def garbled_documents(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, restored, restored_md5) of the documents with garbled text.

    ``restored`` is null and ``restored_md5`` empty where characters were lost, that is
    where replacement characters stand. Null texts are not garbled; a null source is a
    source of its own; repeated rows each come out; extra columns are ignored.
    """
    source = F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in documents.columns else F.lit("")
    rows = documents.select(F.col(key).cast("long").alias("doc_id"), source.alias("source"), F.col(text).alias("text")).where(F.col("text").rlike("[^\\x00-\\x7f]"))
    rows = spread(rows)
    model, swaps = learn(rows)
    held = documents.sparkSession.sparkContext.broadcast(model)
    # One row a source with a few names of swaps; a mapping of its own has no more entries than a page has places.
    rows = rows.join(swaps, "source", "left").select("doc_id", "text", "swaps", "learned")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = held.value
        for pdf in batches:
            out = []
            for d, t, k, own in zip(pdf["doc_id"], pdf["text"], pdf["swaps"], pdf["learned"]):
                if "\ufffd" in t or "ï¿½" in t:
                    out.append((d, None, ""))
                    continue
                if k is None and own is None:
                    continue
                known = set(k) if k is not None else set()
                fixed = restore(t, m, tuple(x for x in CHANNELS if x in known), tuple(own) if own is not None else ())
                if fixed != t:
                    out.append((d, fixed, hashlib.md5(fixed.encode("utf-8", "surrogatepass")).hexdigest()))
            if out:
                yield pd.DataFrame(out, columns=["doc_id", "restored", "restored_md5"])

    return rows.mapInPandas(run, "doc_id long, restored string, restored_md5 string")
