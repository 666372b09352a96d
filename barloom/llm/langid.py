r"""Language identification by word-first backoff.

A word known from the fit scores by its log frequency in each language. An unseen word falls back to its character
5-grams (with word ends), and where none of those is known to 4-grams, and so on down to single characters. A text's
language has the largest sum over its words.

Fit. Words and n-grams of about `PER_LANG` documents a language, outside the held-out fold: the sampling rate comes from
the language's row count, and a document is taken by hash of its id, so no ranking within a hot language is needed. All
words of those documents that occur twice or more are learned; one that occurs once is left to its n-grams. Words are
letters with their combining marks. Scoring reads only the text column, in Arrow batches, with a bounded cache of words,
and needs no shuffle. A worker holds the table of known words and cache: 4 bytes for each word and language.

Defined cases: null text or a text without letters is `und` with score 0; ties go to the language that sorts first;
with nothing to learn from every text is `und`; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import LETTERS_RE, cut, fold, text_of

PER_LANG = 1500
LONGEST = 5
_ROOM = 400_000


class Backoff(dict):
    """word -> row of self.table (log frequencies by language); unseen words are computed and kept while there is room."""

    def __init__(self, langs: list[str], counts: list[dict[str, int]]) -> None:
        super().__init__()
        self.langs = langs
        width = len(langs)
        known = sorted(set().union(*counts)) if counts else []
        grams: list[list[Counter]] = [[Counter() for _ in langs] for _ in range(LONGEST + 1)]
        for k, words in enumerate(counts):
            for w, c in words.items():
                for n in range(1, LONGEST + 1):
                    into = grams[n][k]
                    for g in _grams(w, n):
                        into[g] += c
        self.grams = [{} for _ in range(LONGEST + 1)]
        for n in range(1, LONGEST + 1):
            names = sorted(g for g, c in sum(grams[n], Counter()).items() if c >= 3)
            self.grams[n] = dict(zip(names, _logs(names, grams[n]), strict=True))
        self.table = np.zeros((len(known) + _ROOM, width), np.float32)
        self.table[: len(known)] = np.array(_logs(known, counts), np.float32).reshape(len(known), width)
        self.fixed = {w: i for i, w in enumerate(known)}
        self.update(self.fixed)
        self.used = len(known)

    def __reduce__(self):
        return _revive, (self.langs, self.fixed, self.grams, self.table[: len(self.fixed)])

    def __missing__(self, word: str) -> int:
        if self.used >= len(self.table):
            raise OverflowError
        for n in range(LONGEST, 0, -1):
            table = self.grams[n]
            if hits := [table[g] for g in _grams(word, n) if g in table]:
                self.table[self.used] = np.mean(hits, axis=0)
                break
        else:
            self.table[self.used] = 0
        self[word] = self.used
        self.used += 1
        return self.used - 1

    def rows(self, words: list[str]) -> np.ndarray:
        """Log frequencies of each word."""
        out = []
        for k in range(0, len(words), _ROOM // 2):
            part = words[k : k + _ROOM // 2]
            try:
                at = np.fromiter(map(self.__getitem__, part), np.int64, len(part))
            except OverflowError:  # the cache is full: start anew
                self.clear()
                self.update(self.fixed)
                self.used = len(self.fixed)
                at = np.fromiter(map(self.__getitem__, part), np.int64, len(part))
            out.append(self.table[at].sum(axis=0, dtype=np.float64))
        return np.sum(out, axis=0)

    def predict(self, text: str | None) -> tuple[str, float]:
        found = LETTERS_RE.findall((text or "").lower())
        if not found or not self.langs or not any(c.isalpha() for w in found for c in w):
            return "und", 0.0
        total = self.rows(found)
        best = int(total.argmax())
        z = (total - total[best]) / len(found) * min(len(found), 20)
        return self.langs[best], float(1 / np.exp(z).sum())


def _revive(langs, fixed, grams, table) -> Backoff:
    out = Backoff([], [])
    out.langs, out.fixed, out.grams, out.used = langs, fixed, grams, len(fixed)
    out.table = np.zeros((len(fixed) + _ROOM, len(langs)), np.float32)
    out.table[: len(fixed)] = table
    out.update(fixed)
    return out


def _grams(word: str, n: int) -> list[str]:
    if n == 1:
        return list(word)
    w = f"^{word}$"
    return [w[i : i + n] for i in range(len(w) - n + 1)]


def _logs(names: list[str], counts: list) -> list[list[float]]:
    sizes = [np.log(sum(c.values()) + 0.5 * max(1, len(names))) for c in counts]
    return [[float(np.log(c.get(x, 0) + 0.5) - s) for c, s in zip(counts, sizes, strict=True)] for x in names]


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found: Counter = Counter()
        for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
            found.update((lang, w) for w in LETTERS_RE.findall(text.lower()))
        yield pd.DataFrame([(k, w, c) for (k, w), c in found.items()], columns=["lang", "word", "n"])


def train(docs: DataFrame) -> Backoff:
    ship(docs.sparkSession)
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), text_of().alias("text")).where("lang IS NOT NULL").where(fold() != 0)
    sizes = cut(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("size")))
    steps = 1 << 20
    taken = rows.join(sizes, "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(steps)) * F.col("size") < F.lit(steps) * F.lit(PER_LANG))
    counts = taken.select("lang", "text").mapInPandas(_count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).where("n > 1")
    by: dict[str, dict[str, int]] = {r["lang"]: {} for r in sizes.collect()}
    for r in counts.select("lang", "word", "n").collect():
        by[r["lang"]][r["word"]] = r["n"]
    langs = sorted(by)
    return Backoff(langs, [by[k] for k in langs])


def predictor(docs: DataFrame, model: Backoff) -> Column:
    """struct(lang_pred, score) of docs' text."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for texts in batches:
            yield pd.DataFrame([known.predict(t) for t in texts], columns=["lang_pred", "score"])

    return predict(text_of())


def language(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row."""
    found = docs.select("doc_id", (fold() == 0).alias("held_out"), predictor(docs, train(docs)).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score")
