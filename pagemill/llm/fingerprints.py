"""Operator 1: document fingerprints from closed syncmers.

A k-mer of code points is a closed syncmer when the smallest hash among its s-mers is that of its first or
its last s-mer. Whether a k-mer is chosen depends on the k-mer alone, so equal passages give equal anchors
wherever they stand. :func:`anchors` returns every chosen k-mer with its position. :func:`fingerprint`
keeps the ``width`` smallest distinct anchor hashes, in ascending order, as eight hex digits each; the
likeness of two fingerprints is the bottom-``width`` estimate of the Jaccard likeness of the anchor sets.

Defined results: null and empty texts have the empty fingerprint; a text without a syncmer (shorter than
``k``, or by chance) has one anchor, the hash of the whole text. Two empty fingerprints have likeness 1, an
empty and another one 0. Rows with null doc_id come after all others in descending order; rows that share a
doc_id are ordered by text. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ranged_by_id, shuffle_partitions, splitmix

K, S, WIDTH = 20, 8, 64
CHUNK = 1 << 20
_A = np.uint64(0x9E3779B97F4A7C15)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_A), n, 1 << 64))


def _spans(first: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hash of each n code points, by doubling; ``first`` holds one value per code point."""
    have, length, done, at = first, 1, None, 0
    while n:
        if n & 1:
            if done is None:
                done, at = have, length
            else:
                m = len(done) - length
                done = done[:m] * _power(length) + have[at : at + m]
                at += length
        n >>= 1
        if n:
            have = have[:-length] * _power(length) + have[length:]
            length *= 2
    return done


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    have, length = x, 1
    while length * 2 <= w:
        have = np.minimum(have[:-length], have[length:])
        length *= 2
    rest = w - length
    return np.minimum(have[: len(have) - rest], have[rest:]) if rest else have


def closed_syncmers(points: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Positions and 64-bit hashes of the closed syncmers among an array of code points."""
    if len(points) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first = splitmix(points.astype(np.uint64) + _A)
    small = splitmix(_spans(first, s))
    w = k - s + 1
    low = _sliding_min(small, w)
    n = len(points) - k + 1
    at = np.flatnonzero((small[:n] == low[:n]) | (small[w - 1 : w - 1 + n] == low[:n]))
    return at, splitmix(_spans(first, k)[at])


def text_anchors(text: str, k: int = K, s: int = S) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The anchors of a text, chunk by chunk, so that memory does not grow with the text."""
    for lo in range(0, max(1, len(text) - k + 1), CHUNK):
        points = np.frombuffer(text[lo : lo + CHUNK + k - 1].encode("utf-32-le", "surrogatepass"), np.uint32)
        at, values = closed_syncmers(points, k, s)
        yield at + lo, values


def sketch(text: str, k: int = K, s: int = S, width: int = WIDTH) -> np.ndarray:
    """The smallest distinct anchor hashes (upper 32 bits), ascending."""
    if not text:
        return np.zeros(0, np.uint32)
    best = np.zeros(0, np.uint32)
    for _, values in text_anchors(text, k, s):
        v = (values >> np.uint64(32)).astype(np.uint32)
        best = np.unique(np.concatenate([best, v]))[:width]
    if not len(best):
        h = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=4).digest()
        best = np.frombuffer(h, "<u4").astype(np.uint32)
    return best


def to_text(values: np.ndarray) -> str:
    return values.astype(">u4").tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4").astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray, width: int = WIDTH) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.union1d(a, b)[:width]
    shared = np.intersect1d(a, b, assume_unique=True)
    return float(np.count_nonzero(shared <= both[-1]) / len(both))


def anchors(docs: DataFrame, k: int = K, s: int = S) -> DataFrame:
    """One row per anchor: doc_id, position (code points), hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for at, values in text_anchors(text.as_py() or "", k, s):
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(at), pa.int64()), pa.array(at, pa.int64()), pa.array(values.view(np.int64))], ["doc_id", "position", "hash"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, position long, hash long")


def fingerprint(docs: DataFrame, k: int = K, s: int = S, width: int = WIDTH) -> DataFrame:
    """doc_id, fingerprint of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [to_text(sketch(t.as_py() or "", k, s, width)) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


def edited_fingerprints(docs: DataFrame, k: int = K, s: int = S, width: int = WIDTH, parts: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited form, and their likeness.

    The edited form replaces the last floor(n_chars / 3) code points by the first as many of the next
    document in descending doc_id; the last document is followed by the first. Texts cross the network
    once, dealt by ranges of doc_id; each range also gets the first document of the next range.
    """
    ranged = ranged_by_id(docs, parts or shuffle_partitions(docs.sparkSession), descending=True, carry_edges=True)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def pair(one: tuple, following: tuple) -> tuple:
        i, text, mine = one
        cut = len(text) // 3
        edited = text[: len(text) - cut] + following[1][:cut]
        other = sketch(edited, k, s, width) if edited != text else mine
        sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        return i, len(text), sha, to_text(mine), to_text(other), likeness(mine, other, width), likeness(mine, following[2], width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            held, part, closed = None, None, False
            for b in batches:
                for i, text, p, edge in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                    if p != part:
                        part, held, closed = p, None, False
                    if closed:
                        continue
                    text = text.as_py()
                    now = (i, text, sketch(text, k, s, width))
                    if held is not None:
                        yield pair(held, now)
                    held, closed = now, edge

        out: list[tuple] = []
        for row in rows():
            out.append(row)
            if len(out) == 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return ranged.select("doc_id", "text", "part", F.col("edge")).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
