"""Operator 13: periodic runs of words, by the dictionary of basic factors.

A run is a stretch of words with smallest period q (words q apart are equal) whose length is at least ``max(least, 2 q)``
and which no neighbouring word extends. The dictionary of basic factors names, for every power of two m, the stretches
of m words so that equal stretches have equal names (a name of 2m words is a pair of names of m words); stretches that occur
once need no name. Runs with m <= q < 2m are proposed by occurrences of one name that lie from m to 2m words apart: a
run's first words, and the same words q later. Occurrences that follow each other at distances up to m/2 form
arithmetic progressions, whose difference is the smallest period of the factor; two inner members of such progressions follow
the same word, so they never start a run, and only pairs with an end of a progression (or with an occurrence outside of any) are
looked at. That is a constant number for each occurrence. A pair is kept if different words precede its two members; the
names, from the longest down, tell how far the two go on alike, which gives the run; of equal stretches the smallest period stays.

Each task works through its own documents in batches of ``BATCH`` words, so nothing is shuffled. A document is held whole, with
4 bytes for each word and each power of two up to the length of its longest repeated stretch.

Defined results: a null or empty text, or one of white space, has no words and no run; repeated rows give repeated
results; a null doc_id keeps its row, and its words are never stretched (see :func:`stretched`). Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile("[^\x20\x09-\x0d]+")
LEAST = 12
#: Words that a task looks at together; a longer document is a batch of its own.
BATCH = 400_000
#: (doc_id, words) -> (first word, period) of the stretch that is made periodic, or None.
Stretch = Callable[[int | None, int], tuple[int, int] | None]

SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
_TYPES = pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in (c.split() for c in SCHEMA.split(", "))])


def basic_factors(x: np.ndarray) -> list[np.ndarray]:
    """names[k][i]: the name of x[i : i + 2^k], or -1 where that stretch occurs once. Ends with the last power that repeats."""
    _, inverse, often = np.unique(x, return_inverse=True, return_counts=True)
    name, m, levels = np.where(often[inverse] > 1, inverse, -1).astype(np.int64), 1, []
    while (name >= 0).any():
        levels.append(name.astype(np.int32))
        at = np.flatnonzero((name[: len(name) - m] >= 0) & (name[m:] >= 0))
        _, inverse, often = np.unique(name[at] << 32 | name[at + m], return_inverse=True, return_counts=True)
        inverse = inverse.reshape(-1)
        name = np.full(len(name), -1, np.int64)
        name[at] = np.where(often[inverse] > 1, inverse, -1)
        m *= 2
    return levels


def _pairs(name: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences (i, p) of one name with m <= p - i < 2m, but for those where both are inside progressions."""
    at = np.flatnonzero(name >= 0)
    at = at[np.argsort(name[at], kind="stable")]
    key = name[at].astype(np.int64) << 32 | at
    gap = np.diff(key)  # within a name the distance, else more than any
    near = np.concatenate([gap < 2 * m, [False]]) | np.concatenate([[False], gap < 2 * m])
    key = key[near]
    if len(key) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gap = np.diff(key)
    inner = np.zeros(len(key), bool)
    inner[1:-1] = (gap[:-1] == gap[1:]) & (gap[1:] <= m // 2)
    ends = np.flatnonzero(~inner)
    out = []
    for lo, hi in ((key[ends] + m, key[ends] + 2 * m), (key[ends] - 2 * m + 1, key[ends] - m + 1)):
        first = np.searchsorted(key, lo)
        n = np.searchsorted(key, hi) - first
        some = np.repeat(ends, n)
        other = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        out.append((np.minimum(some, other), np.maximum(some, other)))
    i, p = (key[np.concatenate(x)] & 0xFFFFFFFF for x in zip(*out, strict=True))
    return i, p


def runs(x: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of every run of the names x, by start, then period. Names that occur once divide stretches."""
    levels = [np.append(a, np.full(1, -1, np.int32)) for a in basic_factors(x)]
    found = []
    for k, name in enumerate(levels):
        i, p = _pairs(name[:-1], 1 << k)
        first = (i == 0) | (x[i - 1] != x[p - 1])
        i, p = i[first], p[first]
        alike, last = np.zeros(len(i), np.int64), len(x)
        for j in range(len(levels) - 1, -1, -1):
            a, b = levels[j][np.minimum(i + alike, last)], levels[j][np.minimum(p + alike, last)]
            alike += np.where((a == b) & (a >= 0), 1 << j, 0)
        q = p - i
        ok = q + alike >= np.maximum(least, 2 * q)
        found.append(np.stack([i[ok], (q + alike)[ok], q[ok]]))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    start, length, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[new], length[new], period[new]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def stretched(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """The query's test stretch: in one document of ten, by the hash of its id, the words from g % n on repeat with a period."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def _rows(docs: list[tuple[int | None, list[str], np.ndarray]], least: int) -> pa.RecordBatch:
    """docs: (doc_id, words, which word stands at each place)."""
    name: dict[str, int] = defaultdict(count().__next__)
    parts, offset, at = [], [], 0
    for k, (_, words, places) in enumerate(docs):
        parts += [np.fromiter(map(name.__getitem__, words), np.int64, len(words))[places], np.array([-1 - k], np.int64)]
        offset.append(at)
        at += len(places) + 1
    start, length, period = runs(np.concatenate(parts), least)
    of = np.searchsorted(np.array(offset), start, side="right") - 1
    bounds = np.searchsorted(of, np.arange(len(docs) + 1))
    out: list[list] = [[] for _ in _TYPES]
    for k, (doc_id, words, places) in enumerate(docs):
        mine = slice(bounds[k], bounds[k + 1])
        s, n, q = start[mine] - offset[k], length[mine], period[mine]
        row: list = [doc_id, len(s), None, None, None, None]
        kept = words
        if len(s):
            top = np.lexsort((q, s, -n))[0]
            row[2:] = [int(s[top]), int(n[top]), int(q[top]), int(1000 * n[top] // q[top])]
            covered = np.zeros(len(places) + 1, np.int64)
            np.add.at(covered, s + q, 1)
            np.add.at(covered, s + n, -1)
            kept = [words[i] for i in places[np.cumsum(covered)[:-1] == 0]]
        elif len(places) and places[-1] != len(places) - 1:
            kept = [words[i] for i in places]
        row += [_hash("".join(f"{a},{b},{c}\n" for a, b, c in zip(s.tolist(), n.tolist(), q.tolist(), strict=True))), _hash(" ".join(kept))]
        for column, v in zip(out, row, strict=True):
            column.append(v)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _TYPES, strict=True)], schema=_TYPES)


def describe(docs: DataFrame, stretch: Stretch | None = None, least: int = LEAST) -> DataFrame:
    """Per document: its runs (count, longest one, digest of all) and the digest of its text without what the runs repeat.

    ``stretch`` makes part of a document periodic before the search.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, list[str], np.ndarray]] = []
        size = 0
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = WORD.findall(text.as_py() or "")
                places = np.arange(len(words))
                if stretch and (made := stretch(doc_id, len(words))):
                    a, p = made
                    places[a:] = a + (places[a:] - a) % p
                if held and size + len(words) > BATCH:
                    yield _rows(held, least)
                    held, size = [], 0
                held.append((doc_id, words, places))
                size += len(words) + 1
        if held:
            yield _rows(held, least)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, SCHEMA)
