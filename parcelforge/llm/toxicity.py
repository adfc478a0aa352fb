"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Folding makes look-alikes equal: compatibility forms (full width, mathematical
letters), accented letters and Cyrillic or Greek letters that look Latin become
Latin, digits and signs that stand for letters become those letters, invisible
characters go, all in lower case.

The lexicon holds word beginnings; an entry ending in a space is a whole word.
It is learned: beginnings of 3 to 7 letters that are far more frequent in toxic
training texts than in others, weighed by their log odds. Exceptions are
phrases of a lexicon word and a neighbour that stand in harmless texts mostly;
hits inside them do not count. More entries and exceptions can be given.

A text's score is a logistic function of its weighted hits over its length.
Training takes at most ``TRAIN_ROWS`` labelled rows in the order of a hash of
the id; whole texts are read in training and scoring.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelforge.llm.quality import held_out, training_ids
from parcelforge.llm.tables import in_batches

TRAIN_ROWS = 8000
#: A learned entry is in this share of the toxic training texts and in three of them at least, and so many times as frequent as in others; before exceptions are known, so many times.
LEAST_SHARE, LEAST_DOCS, LEAST_RATIO, FIRST_RATIO = 0.02, 3, 25, 3
#: Characters that are added to each text's length, so that one word is no text.
LENGTH_FLOOR = 200

# Letters that look Latin, and signs that stand for letters.
_ALIKE = {
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ɡ": "g",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o", "đ": "d",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "€": "e",
}


def _fold_table() -> dict[int, str]:
    """Replacements by code point, from the Unicode decompositions of the planes with Latin look-alikes."""
    out: dict[int, str] = {}
    ranges = [(0xA1, 0x250), (0x300, 0x500), (0x1E00, 0x2000), (0x2000, 0x2070), (0x2460, 0x2500), (0xFE00, 0xFE10), (0xFEFF, 0xFF00), (0xFF00, 0xFF60), (0x1D400, 0x1D800)]
    for a, b in ranges:
        for point in range(a, b):
            c = chr(point)
            kind = unicodedata.category(c)
            if kind in ("Mn", "Cf"):
                out[point] = ""
                continue
            plain = "".join(x for x in unicodedata.normalize("NFKD", c).lower() if not unicodedata.combining(x))
            plain = "".join(_ALIKE.get(x, x) for x in plain)
            if plain != c and plain.isalnum():
                out[point] = plain
    out |= {ord(c): x for c, x in _ALIKE.items()}
    return out


FOLD = _fold_table()
_WORD = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    return text.lower().translate(FOLD)


@dataclass
class Lexicon:
    """Weights of word beginnings (or of whole words, with a space at the end), exception phrases, and the logistic function of the weighted density."""

    weights: dict[str, float]
    exceptions: frozenset[str] = frozenset()
    slope: float = 2.0
    offset: float = -4.0
    _automaton: object = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def automaton(self):
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for entry, weight in self.weights.items():
                self._automaton.add_word(entry.rstrip(" "), (len(entry.rstrip(" ")), weight, entry.endswith(" ")))
            for phrase in self.exceptions:
                self._automaton.add_word(phrase, (len(phrase), None, True))
            self._automaton.make_automaton()
        return self._automaton

    def matches(self, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of all entries that begin a word, none inside an exception phrase."""
        found, spared = [], []
        for last, (size, weight, whole) in self.automaton().iter(folded) if self.weights else ():
            start, end = last + 1 - size, last + 1
            if start and folded[start - 1].isalnum() or whole and end < len(folded) and folded[end].isalnum():
                continue
            if weight is None:
                spared.append((start, end))
            else:
                found.append((start, end, weight))
        if not spared:
            return found
        # of the phrases that begin at a match's start or before, the one that reaches furthest
        spared.sort()
        starts, reach = [a for a, _ in spared], list(accumulate((b for _, b in spared), max))
        return [m for m in found if (i := bisect_right(starts, m[0])) == 0 or reach[i - 1] < m[1]]

    def hits(self, folded: str) -> list[tuple[int, int, float]]:
        """Of the matches at one place the heaviest."""
        best: dict[int, tuple[int, int, float]] = {}
        for m in self.matches(folded):
            if m[2] > best.get(m[0], (0, 0, 0.0))[2]:
                best[m[0]] = m
        return list(best.values())

    def density(self, folded: str) -> float:
        return 1000 * sum(w for _, _, w in self.hits(folded)) / (len(folded) + LENGTH_FLOOR)

    def score(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.offset + self.slope * math.log1p(self.density(fold(text or "")))))))


def _closed(found: dict[str, tuple[int, int]]) -> list[str]:
    """The entries, shorter ones first, without those that a longer entry has nearly all toxic texts of: the longer one tells the same more surely."""
    best: dict[str, int] = {}
    for entry, (a, _) in found.items():
        word = entry.rstrip(" ")
        for k in range(3, len(word) + (entry != word)):
            best[word[:k]] = max(best.get(word[:k], 0), a)
    return sorted((e for e, (a, _) in found.items() if best.get(e, 0) < 0.9 * a), key=lambda e: (len(e), e))


def _beginnings(folded: str) -> set[str]:
    out = set()
    for w in set(_WORD.findall(folded)):
        out.add(w + " ")
        out.update(w[:k] for k in range(3, min(7, len(w)) + 1))
    return out


def _phrases(folded: str, lexicon: Lexicon) -> set[str]:
    """The words that matches begin, each with the whole word before and with the whole word after it, one space between."""
    out, n = set(), len(folded)
    for s, e, _ in lexicon.hits(folded):
        while e < n and folded[e].isalpha():
            e += 1
        at, to = s - 1, e + 1
        if at > 0 and folded[at] == " ":
            while at > 0 and folded[at - 1].isalpha():
                at -= 1
            if at < s - 1:
                out.add(folded[at:e])
        if e < n and folded[e] == " ":
            while to < n and folded[to].isalpha():
                to += 1
            if to > e + 1:
                out.add(folded[s:to])
    return out


def learn(docs: DataFrame, labels: DataFrame, extra: dict[str, float] | None = None, exceptions: frozenset[str] = frozenset(), train_rows: int = TRAIN_ROWS) -> Lexicon:
    """The lexicon of the training rows; equal texts count once. Without toxic and other rows it holds ``extra`` alone."""
    ids = F.broadcast(training_ids(labels, "toxic", train_rows))  # train_rows rows at most
    rows = in_batches(docs).select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text")).join(ids, "id").where("text is not null")
    rows = rows.groupBy(F.xxhash64("text").alias("copy")).agg(F.max("label").alias("label"), F.first("text").alias("text")).select("label", "text")
    totals = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, other = totals.get(1, 0), totals.get(0, 0)
    lexicon = Lexicon(dict(extra or {}), frozenset(exceptions))
    if not (toxic and other):
        return lexicon

    def counted(of) -> DataFrame:
        """entry, toxic, other: the texts of either kind that ``of`` finds an entry in."""

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            counts = (Counter(), Counter())
            rows = lambda: pd.DataFrame([(k, counts[1][k], counts[0][k]) for k in counts[0] | counts[1]], columns=["entry", "toxic", "other"])
            for batch in batches:
                for y, text in zip(batch["label"], batch["text"], strict=True):
                    counts[y].update(of(fold(text)))
                if len(counts[0]) + len(counts[1]) > 500_000:
                    yield rows()
                    counts = (Counter(), Counter())
            yield rows()

        return rows.mapInPandas(count, "entry string, toxic long, other long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))

    least = max(LEAST_DOCS, math.ceil(LEAST_SHARE * toxic))
    odds = lambda a, b: math.log((a + 0.5) / toxic * other / (b + 0.5))

    def frequent(counts: DataFrame, times: float) -> dict[str, tuple[int, int]]:
        good = counts.where((F.col("toxic") >= least) & (F.col("toxic") / toxic >= times * (F.col("other") + 0.5) / other))
        # each is in a share of the toxic texts, so they are 1 / LEAST_SHARE times the entries of one text at most
        return {r["entry"]: (r["toxic"], r["other"]) for r in good.collect()}

    first = frequent(counted(_beginnings), FIRST_RATIO)
    lexicon.weights |= {e.rstrip(" "): odds(*first[e]) for e in _closed(first)}
    harmless = counted(lambda folded: _phrases(folded, lexicon)).where((F.col("other") >= LEAST_DOCS) & (F.col("toxic") / toxic < 0.5 * F.col("other") / other))
    spared = frozenset(r["entry"] for r in harmless.collect())  # phrases of TRAIN_ROWS texts
    trial = Lexicon(lexicon.weights, spared | exceptions)
    sure = frequent(counted(lambda folded: {folded[a:b] for a, b, _ in trial.matches(folded)}), LEAST_RATIO)
    lexicon = Lexicon(dict(extra or {}))
    for entry in sorted(sure, key=lambda e: (len(e), e)):
        # a longer entry adds to a shorter one only if it is much surer
        if not any(odds(*sure[entry[:k]]) > 0.7 * odds(*sure[entry]) for k in range(3, len(entry)) if entry[:k] in lexicon.weights and entry[:k] in sure):
            lexicon.weights.setdefault(entry, odds(*sure[entry]))
    lexicon = Lexicon(lexicon.weights, frozenset(p for p in spared if lexicon.matches(p)) | exceptions)

    def densities(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"label": batch["label"], "x": [math.log1p(lexicon.density(fold(t))) for t in batch["text"]]})

    seen = rows.mapInPandas(densities, "label int, x double").toPandas()
    lexicon.slope, lexicon.offset = _logistic(seen["x"].to_numpy(), seen["label"].to_numpy(float))
    return lexicon


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, float]:
    """Slope and offset by Newton's method with a ridge, in a fixed order of rows."""
    order = np.lexsort((y, x))
    a, y, w = np.stack([x[order], np.ones(len(x))], 1), y[order], np.array([1.0, -3.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge * np.eye(2), a.T @ (p - y) + ridge * w)
        w -= np.clip(step, -2, 2)
    return float(w[0]), float(w[1])


def scored(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id and ``score`` of the whole text; null counts as empty."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": [lexicon.score(t) for t in batch["text"]]})

    rows = in_batches(docs).select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(score, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``; equal texts get equal scores, an empty text the score of no hits."""
    out = scored(docs, learn(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
