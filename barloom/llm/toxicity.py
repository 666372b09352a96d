r"""Toxicity by a factorization machine over hashed terms.

Terms are a text's distinct lower-case words and their 4 and 5 character prefixes, hashed to 2^20 buckets. The machine
has a weight and a factor vector for each bucket, so pairs of terms (an insult with a group mention) count
beyond their sum: score = sigmoid(w0 + sum w_i + sum_{i<j} <v_i, v_j>).

Fit. On at most `POSITIVES` + `NEGATIVES` labelled rows outside the held-out fold, the first by hash of the id, so the
sample is the same wherever rows lie. Every bucket on 3 rows or more (2 in small samples) is fitted, also one that speaks
for clean text or only in a pair; AdaGrad, fixed seed. `SPARSE` draws weights and vectors to zero, save for buckets whose
likelihood ratio alone says that they tell the classes apart; buckets that end at zero add nothing and are left out of
the model. The fit runs in one task, which the sample bounds; the driver gets the model, and broadcasts it. Scoring reads
only the text column, in Arrow batches, without a shuffle.

Defined cases: null text is empty and gets the prior's score; labels without a document, null or conflicting (a
repeated id) are fitted as far as they are usable, of documents with one id the one whose terms sort first; without two classes every score is the prior, 0 if nothing is
labelled; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import LETTERS_RE, fold, fresh, text_of

POSITIVES, NEGATIVES = 4000, 8000
BUCKETS = 1 << 20
FACTORS = 4
EPOCHS = 30
#: L1 penalty of a weight, and of the length of a factor vector.
SPARSE = 1e-3
_CACHE = 400_000


def buckets(word: str) -> list[int]:
    """Hash buckets of a word's terms."""
    out = [zlib.crc32(word.encode("utf-8", "replace")) & (BUCKETS - 1)]
    for n in (4, 5):
        if len(word) > n:
            out.append(zlib.crc32(b"^" + word[:n].encode("utf-8", "replace")) & (BUCKETS - 1))
    return out


def terms(text: str | None) -> np.ndarray:
    """Distinct buckets of a text, ascending."""
    found: set[int] = set()
    for w in set(LETTERS_RE.findall((text or "").lower())):
        found.update(buckets(w))
    return np.array(sorted(found), np.int32)


class Machine:
    """A fitted factorization machine: known buckets, w0, w, v."""

    def __init__(self, known: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray) -> None:
        self.at = {int(b): i for i, b in enumerate(known)}
        self.w0, self.w, self.v = float(w0), w, v
        self._words: dict[str, tuple[int, ...]] = {}

    def raw(self, rows: list[int]) -> float:
        if not rows:
            return self.w0
        v = self.v[rows]
        s = v.sum(axis=0)
        return float(self.w0 + self.w[rows].sum() + 0.5 * (s @ s - (v * v).sum()))

    def score(self, text: str | None) -> float:
        cache, found = self._words, set()
        for w in set(LETTERS_RE.findall((text or "").lower())):
            hit = cache.get(w)
            if hit is None:
                if len(cache) >= _CACHE:
                    cache.clear()
                hit = cache[w] = tuple(self.at[b] for b in buckets(w) if b in self.at)
            if hit:
                found.update(hit)
        return 1.0 / (1.0 + np.exp(-min(max(self.raw(sorted(found)), -30.0), 30.0)))


def fit(rows: list[tuple[int, np.ndarray]], seed: int = 7) -> Machine:
    """rows: (label, distinct buckets)."""
    labels = np.array([r[0] for r in rows], np.float64)
    pos, neg = int(labels.sum()), int(len(labels) - labels.sum())
    none = Machine(np.zeros(0, np.int32), -30.0 if not pos else np.log(pos / max(neg, 1)) if neg else 30.0, np.zeros(0), np.zeros((0, FACTORS)))
    if not pos or not neg:
        return none
    count = [np.zeros(BUCKETS), np.zeros(BUCKETS)]
    for y, b in rows:
        count[int(y)][b] += 1
    p, q = count[1], count[0]
    known = np.flatnonzero(p + q >= (3 if pos >= 50 else 2))
    if not len(known):
        return none
    p, q = p[known], q[known]
    log = lambda a, e: np.where(a > 0, a * np.log(np.maximum(a, 1e-12) / e), 0.0)
    share = (p + q) / (pos + neg)
    g2 = 2 * (log(p, pos * share) + log(q, neg * share) + log(pos - p, pos * (1 - share) + 1e-12) + log(neg - q, neg * (1 - share) + 1e-12))
    sparse = np.where(g2 > 10.83, 0.0, SPARSE)
    place = np.full(BUCKETS, -1, np.int32)
    place[known] = np.arange(len(known))
    data = [x[x >= 0] for x in (place[b] for _, b in rows)]
    rng = np.random.default_rng(seed)
    w0, w, v = np.log(pos / neg), np.zeros(len(known)), rng.normal(0, 0.01, (len(known), FACTORS))
    g0, gw, gv, rate, decay = 1e-6, np.full(len(known), 1e-6), np.full(v.shape, 1e-6), 0.1, 1e-5
    sums = lambda at, x, n: np.stack([np.bincount(at, x[:, k], n) for k in range(FACTORS)], 1)
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 256)):
            flat, row = np.concatenate([data[i] for i in part]), np.repeat(np.arange(len(part)), [len(data[i]) for i in part])
            own = v[flat]
            s = sums(row, own, len(part))
            z = w0 + np.bincount(row, w[flat], len(part)) + 0.5 * ((s * s).sum(1) - np.bincount(row, (own * own).sum(1), len(part)))
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[part]) / len(part)
            d0, dw, dv = err.sum(), np.bincount(flat, err[row], len(known)), sums(flat, err[row, None] * (s[row] - own), len(known)) + decay * v
            g0, gw, gv = g0 + d0 * d0, gw + dw * dw, gv + dv * dv
            step, steps = rate / np.sqrt(gw), rate / np.sqrt(gv)
            w0, w, v = w0 - rate * d0 / np.sqrt(g0), w - step * dw, v - steps * dv
            w = np.sign(w) * np.maximum(np.abs(w) - step * sparse, 0)
            v *= np.maximum(1 - steps.mean(1) * sparse / np.maximum(np.sqrt((v * v).sum(1)), 1e-12), 0)[:, None]
    used = (w != 0) | v.any(axis=1)
    return Machine(known[used], w0, w[used], v[used])


def _featurise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "toxic": pdf["toxic"], "terms": [terms(t).tobytes() for t in pdf["text"]]})


def _fit_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The whole sample in one task, in an order of its own."""
    rows = [(int(y), t) for pdf in batches for y, t in zip(pdf["toxic"], pdf["terms"], strict=True)]
    rows.sort(key=lambda r: (zlib.crc32(r[1]), r[0], r[1]))
    m = fit([(y, np.frombuffer(t, np.int32)) for y, t in rows])
    known = np.fromiter(m.at, np.int32, len(m.at))
    yield pd.DataFrame({"w0": [m.w0], "known": [known.tobytes()], "w": [m.w.tobytes()], "v": [m.v.tobytes()]})


def train(docs: DataFrame, labels: DataFrame) -> Machine:
    """Fit on the labelled documents outside the held-out fold, in a task: the driver sees the model alone."""
    ship(docs.sparkSession)
    usable = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id IS NOT NULL AND toxic IN (0, 1)").where(fold("id") != 0)
    order = [F.xxhash64("id"), "id", "toxic"]
    sample = usable.where("toxic = 1").orderBy(*order).limit(POSITIVES).unionByName(usable.where("toxic = 0").orderBy(*order).limit(NEGATIVES))
    joined = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(sample.distinct()), F.col("doc_id") == F.col("id"))  # at most POSITIVES + NEGATIVES rows
    featured = joined.select("doc_id", "toxic", "text").mapInPandas(_featurise, "doc_id long, toxic int, terms binary")
    one = featured.groupBy("doc_id", "toxic").agg(F.min("terms").alias("terms"))  # no more rows than the sample has, whatever ids repeat
    row = one.select("toxic", "terms").repartition(1).mapInPandas(_fit_rows, "w0 double, known binary, w binary, v binary").first()
    if row is None:
        return fit([])
    w = np.frombuffer(row["w"])
    return Machine(np.frombuffer(row["known"], np.int32), row["w0"], w, np.frombuffer(row["v"]).reshape(len(w), FACTORS))


def scorer(docs: DataFrame, machine: Machine) -> Column:
    """The score of docs' text as a column."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        for texts in batches:
            yield pd.Series([model.score(t) for t in texts], dtype="float64")

    return score(text_of())


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row."""
    scored = docs.select("doc_id", (fold() == 0).alias("held_out"), scorer(docs, train(docs, labels)).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that the machine marks."""
    (score,) = fresh(docs, "score")
    return docs.withColumn(score, scorer(docs, train(docs, labels))).where(F.col(score) < 0.5).drop(score)
