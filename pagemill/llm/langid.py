"""Operator 10: language identification by n-gram filters with language bitmasks.

Texts are lower-cased and everything but letters becomes one blank; the n-grams are the trigrams of code
points of that, word edges included. A language's profile is its ``PROFILE`` most frequent trigrams, ties by code points, so the model
has a bound whatever it is learnt from; a trigram is stored for every language that has it in its profile. All languages lie in one bit-sliced
Bloom filter of ``SLOTS`` slots, with one bit per slot and language and ``HASHES`` slots per trigram; the AND of a trigram's slots
has the bits of all languages that contain it. For a document the bits are counted per language, corrected
by the language's false-positive rate (its fill to the power of ``HASHES``), and the largest share wins; ties go to the first
language by code point. The score is that share over the sum of all.

The counts cover every document whose crc32(doc_id as text) mod 4 is not 2 and whose lang is not null.
Defined results: a null text, or one without letters, is ``und`` with score 0, as is every text when there
is nothing to learn from. Repeated rows are counted and predicted as they come; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_bucket, materialise, splitmix

FOLDS, HELD_OUT = 4, 2
PROFILE = 1000
#: 512 KB for each 63 languages.
SLOTS = 1 << 16
HASHES = 3
PER_WORD = 63
CHUNK = 1 << 20


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def _points(text: str, first: bool = True, last: bool = True) -> np.ndarray:
    """Code points of the lower-cased text with runs of other characters as one blank; a blank at either end of a text."""
    p = np.frombuffer(f"{' ' * first}{text.lower()}{' ' * last}".encode("utf-32-le", "surrogatepass"), np.uint32)
    ok = _letters()[p]
    keep = ok.copy()
    keep[:1] = True
    keep[1:] |= ok[:-1]
    return np.where(ok, p, 32)[keep].astype(np.int64)


def _chunks(text: str) -> Iterator[np.ndarray]:
    """The trigrams of a text, by chunks of about CHUNK characters; the last two code points of one go before the next."""
    before = np.zeros(0, np.int64)
    for lo in range(0, max(1, len(text)), CHUNK):
        p = _points(text[lo : lo + CHUNK], lo == 0, lo + CHUNK >= len(text))
        if len(before) and before[-1] == 32 and len(p) and p[0] == 32:
            p = p[1:]
        p = np.concatenate([before, p])
        yield trigrams(p)
        before = p[-2:]


def trigrams(points: np.ndarray) -> np.ndarray:
    return points[:-2] << 42 | points[1:-1] << 21 | points[2:] if len(points) > 2 else points[:0]


def slots(grams: np.ndarray, size: int) -> list[np.ndarray]:
    """The HASHES places of each trigram in a filter of ``size`` slots, a power of two."""
    h = splitmix(grams.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    step = splitmix(h) | np.uint64(1)
    return [((h + step * np.uint64(i)) & np.uint64(size - 1)).astype(np.int64) for i in range(HASHES)]


def _groups(texts: list[tuple[int, str]]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Trigrams of many texts at once: ids, the trigrams, and the place of the text of each; about CHUNK code points a time."""
    ids: list[int] = []
    parts: list[np.ndarray] = []
    size = 0
    for i, text in texts:
        for p in _chunks(text):
            ids.append(i)
            parts.append(p)
            size += len(p)
            if size >= CHUNK:
                yield ids, np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(x) for x in parts])
                ids, parts, size = [], [], 0
    if ids:
        yield ids, np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(x) for x in parts])


def counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all documents to learn from; each task adds up before anything is sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(of: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            grams, back = np.unique(np.concatenate([g for g, _ in of]), return_inverse=True)
            return grams, np.bincount(back, np.concatenate([n for _, n in of]), len(grams)).astype(np.int64)

        for b in batches:
            by: dict[str, list[tuple[int, str]]] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                by.setdefault(lang, []).append((0, text.as_py()))
            for lang, texts in by.items():
                for _, grams, _ in _groups(texts):
                    of = held.setdefault(lang, [])
                    of.append(np.unique(grams, return_counts=True))
                    if len(of) >= 16:
                        held[lang] = [merged(of)]
        for lang, of in held.items():
            grams, n = merged(of)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n)], ["lang", "gram", "n"])

    rows = docs.where((crc_bucket(F.col("doc_id"), FOLDS) != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    return rows.select("lang", "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages and the filter: (words of PER_WORD languages, slots) masks.

    A language's profile is its ``PROFILE`` most frequent trigrams, so that the filter has one size however much text is learnt from. All
    of a trigram's languages are in it.
    """
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    members = materialise(counts(docs).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= PROFILE).select("lang", "gram"), "lang-grams")
    langs = sorted((r.lang for r in members.select("lang").distinct().collect()), key=lambda x: x.encode())  # one row per language
    if not langs:
        return [], np.zeros((1, 1), np.uint64)
    table = np.zeros((max(1, -(-len(langs) // PER_WORD)), SLOTS), np.uint64)
    index = {x: i for i, x in enumerate(langs)}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = np.array([index[x] for x in b.column(0).to_pylist()], np.int64)
            at = np.concatenate(slots(b.column(1).to_numpy(), SLOTS))
            i = np.tile(i, HASHES)
            yield pa.RecordBatch.from_arrays([pa.array(i // PER_WORD), pa.array(at), pa.array(np.int64(1) << (i % PER_WORD))], ["word", "slot", "bit"])

    masks = members.mapInArrow(place, "word long, slot long, bit long").groupBy("word", "slot").agg(F.bit_or("bit").alias("mask")).toArrow()
    table[masks.column("word").to_numpy(), masks.column("slot").to_numpy()] = masks.column("mask").to_numpy().astype(np.uint64)
    return langs, table


def predict(docs: DataFrame, langs: list[str], table: np.ndarray) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row."""
    held = docs.sparkSession.sparkContext.broadcast((langs, table))  # SLOTS masks for each 63 languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, table = held.value
        bits = [(i // PER_WORD, np.uint64(i % PER_WORD)) for i in range(len(langs))]
        wrong = np.array([((table[w] >> s) & np.uint64(1)).mean() ** HASHES for w, s in bits])
        for b in batches:
            n = b.num_rows
            hits, size = np.zeros((n, max(1, len(langs)))), np.zeros(n)
            texts = [(i, t.as_py()) for i, t in enumerate(b.column(1)) if t.is_valid]
            lettered = np.zeros(n, bool)
            for ids, grams, place in _groups(texts):
                where = np.array(ids, np.int64)[place] if len(place) else np.zeros(0, np.int64)
                size += np.bincount(where, minlength=n)
                at = slots(grams, table.shape[1])
                masks = [table[w][at[0]] & table[w][at[1]] & table[w][at[2]] for w in range(len(table))]
                for j, (w, s) in enumerate(bits):
                    hits[:, j] += np.bincount(where, ((masks[w] >> s) & np.uint64(1)).astype(float), n)
            lettered = size > 0
            names, scores = [], []
            for i in range(n):
                if not langs or not lettered[i]:
                    names.append("und")
                    scores.append(0.0)
                    continue
                share = np.clip((hits[i, : len(langs)] / size[i] - wrong) / np.maximum(1 - wrong, 1e-9), 0, 1)
                k = int(np.argmax(share))
                names.append(langs[k])
                scores.append(float(share[k] / share.sum()) if share.sum() > 0 else 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    found = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", (crc_bucket(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs, *learn(docs))
