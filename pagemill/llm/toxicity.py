"""Operator 4: toxicity by a counterfactual-regularised classifier.

A text is its set of distinct lower-cased words (runs of letters). A word has the features word and prefixes
of 3 to 6 letters; the logit is a bias, a weight on the logarithm of the number of distinct words, and the
sum of the weights of the features of each distinct word. Labelled rows also appear with their identity
terms swapped inside their group ("women" for "men"); training adds ``COUNTERFACTUAL`` times the mean squared
change of the logit to the logistic loss, so that naming a group does not move the score.

The fit uses at most ``SAMPLE`` labelled rows whose crc32(doc_id as text) mod 5 is not 0, chosen by a hash of
doc_id; features are those that occur in at least ``LEAST`` toxic rows and at least twice as often, relatively,
in toxic rows as in others, the ``FEATURES`` strongest by a likelihood-ratio test. Scoring reads every
whole text and nothing but the text.

Defined results: null texts score as empty ones; with no usable label, or labels of one kind only, every score is
that kind (0 without labels). Rows with null toxic are not learnt from, and of documents
that share a doc_id one is. Repeated rows are scored alike.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHES, crc_bucket, materialise, working

SAMPLE = 20_000
FEATURES = 8192
LEAST = 2
FOLDS = 5
ROWS_AT_ONCE = 200
COUNTERFACTUAL = 4.0
RIDGE = 2e-4
POSITIVE_WEIGHT = 2.0
STEPS = 400
WORDS = re.compile(r"[^\W\d_]+")
#: Groups of identity terms; a term is swapped for the next one of its group.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"), ("mother", "father"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african", "european"), ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "natives", "refugees"), ("disabled", "deaf", "blind"), ("old", "young"),
    ("frauen", "männer"), ("femmes", "hommes"), ("mujeres", "hombres"),
)
SWAP = {t: g[(i + 1) % len(g)] for g in IDENTITY_TERMS for i, t in enumerate(g)}


def word_features(word: str) -> list[int]:
    found = [f"={word}", *(f"^{word[:n]}" for n in range(3, 7) if len(word) > n)]
    return [xxhash.xxh3_64_intdigest(x) >> 1 for x in found]


def words_of(text: str | None) -> set[str]:
    return set(WORDS.findall((text or "").lower()))


@dataclass
class Model:
    weights: dict[int, float] = field(default_factory=dict)
    bias: float = -30.0
    length: float = 0.0

    def scorer(self):
        """text -> score. Word weights are remembered, up to a bound."""
        weights = self.weights

        class Known(dict):
            def __missing__(self, word: str) -> float:
                if len(self) > 150_000:
                    self.clear()
                self[word] = w = sum(weights.get(f, 0.0) for f in word_features(word))
                return w

        known = Known()

        def score(text: str | None) -> float:
            words = words_of(text)
            z = self.bias + self.length * np.log1p(len(words)) + sum(map(known.__getitem__, words))
            return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

        return score


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """toxic, text of the rows to learn from: SAMPLE at most. Of rows that share a doc_id, the smallest text counts."""
    rows = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL").distinct()
    rows = rows.where(crc_bucket(F.col("doc_id"), FOLDS) != 0).orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(SAMPLE)
    rows = F.broadcast(materialise(rows, "label-sample"))  # at most SAMPLE rows of 12 bytes
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(rows, "doc_id")
    return texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("toxic", "text")


class _Features(dict):
    """Word -> its features, up to a bound."""

    def __missing__(self, word: str) -> list[int]:
        if len(self) > 50_000:
            self.clear()
        self[word] = found = word_features(word)
        return found


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[int], list[list[int]], list[list[int] | None]]]:
    """Some rows at a time: (toxic, text), the numbers of distinct words, the features, and those with identity terms swapped (null without any)."""
    working("toxicity")
    of = _Features()
    for whole in batches:
        for lo in range(0, whole.num_rows, ROWS_AT_ONCE):
            b = whole.slice(lo, ROWS_AT_ONCE)
            sizes, plain, swapped = [], [], []
            for text in b.column(1):
                found = words_of(text.as_py())
                sizes.append(len(found))
                plain.append([f for w in found for f in of[w]])
                swapped.append([f for w in found for f in of[SWAP.get(w, w)]] if any(w in SWAP for w in found) else None)
            yield b, sizes, plain, swapped


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(f, p, m) of some rows: the rows that have feature f, the toxic ones and all."""
    for b, _, plain, _ in _featured(batches):
        sets = [np.unique(np.array(x, np.int64)) for x in plain]
        toxic = np.repeat(b.column(0).to_numpy().astype(float), [len(x) for x in sets])
        f, back = np.unique(np.concatenate(sets), return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(np.bincount(back, toxic, len(f))), pa.array(np.bincount(back, minlength=len(f)).astype(float))], ["f", "p", "m"])


def fit(docs: DataFrame, labels: DataFrame, penalty: float = COUNTERFACTUAL) -> Model:
    rows = materialise(_labelled(docs, labels), "toxic-rows")
    totals = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    n, pos = int(totals[0]), int(totals[1])
    if not 0 < pos < n:
        return Model(bias=30.0 if n and pos == n else -30.0)
    counts = rows.mapInArrow(_counted, "f long, p double, m double").groupBy("f").agg(F.sum("p").alias("p"), F.sum("m").alias("m"))
    other = F.col("m") - F.col("p")
    rate = F.lit(pos / n)
    lift = F.col("p") * (n - pos) >= 2 * other * pos
    strength = F.col("p") * F.log(F.col("p") / (F.col("m") * rate)) + F.when(other > 0, other * F.log(other / (F.col("m") * (1 - rate)))).otherwise(0.0)
    best = counts.where((F.col("p") >= LEAST) & lift).select("f", strength.alias("s")).orderBy(F.desc("s"), "f").limit(FEATURES)
    chosen = materialise(best.select("f"), "toxic-features")
    ids = np.sort(np.array([r.f for r in chosen.collect()], np.int64))  # at most FEATURES

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {int(f): k for k, f in enumerate(ids)}
        for b, sizes, plain, swapped in _featured(batches):
            out = [pa.array([None if x is None else [place[f] for f in x if f in place] for x in of], pa.list_(pa.int32())) for of in (plain, swapped)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int32()), *out], ["toxic", "n", "features", "swapped"])

    # at most SAMPLE rows, and of each the chosen features only
    design = rows.mapInArrow(reduced, "toxic int, n int, features array<int>, swapped array<int>").toArrow()
    y, size = design.column("toxic").to_numpy().astype(float), np.log1p(design.column("n").to_numpy())

    def pairs(name: str) -> tuple[np.ndarray, np.ndarray]:
        lists = design.column(name).to_pylist()
        row = np.repeat(np.arange(len(lists)), [len(x or ()) for x in lists])
        return row, np.array([v for x in lists if x for v in x], np.int64)

    (row, col), (row2, col2) = pairs("features"), pairs("swapped")
    has = np.array([x is not None for x in design.column("swapped").to_pylist()])
    k = len(ids)
    w, bias, length = np.zeros(k), float(np.log(pos / (n - pos))), 0.0
    weight = np.where(y > 0, POSITIVE_WEIGHT, 1.0) / n
    step, m1, m2 = 0.1, np.zeros(k + 2), np.zeros(k + 2)
    centre = size.mean()
    for t in range(1, STEPS + 1):
        z = bias + length * (size - centre) + np.bincount(row, w[col], n)
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        grad = np.bincount(col, g[row], k) + RIDGE * w / 1.0
        if len(row2):
            change = np.where(has, np.bincount(row, w[col], n) - np.bincount(row2, w[col2], n), 0.0)
            h = 2 * penalty * change / max(1, has.sum())
            grad += np.bincount(col, (h * has)[row], k) - np.bincount(col2, h[row2], k)
        full = np.concatenate([grad, [g.sum(), (g * (size - centre)).sum()]])
        m1, m2 = 0.9 * m1 + 0.1 * full, 0.999 * m2 + 0.001 * full**2
        move = step * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
        w, bias, length = np.maximum(w - move[:k], 0.0), bias - move[k], length - move[k + 1]
    return Model({int(i): float(v) for i, v in zip(ids, w, strict=True) if v}, bias - length * centre, length)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # at most FEATURES weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("toxicity")
        of = held.value.scorer()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([of(t.as_py()) for t in b.column(1)], pa.float64())], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (crc_bucket(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


#: The scorer of the latest model in this worker process.
_SCORERS: dict[str, Callable[[str | None], float]] = {}
CACHES.append(_SCORERS.clear)


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` with a score under one half; null texts count as empty ones."""
    held, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex  # at most FEATURES weights

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        working("toxicity")
        if name not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[name] = held.value.scorer()
        return texts.map(_SCORERS[name])

    return docs.where(of(F.coalesce(docs.text, F.lit(""))) < 0.5)
