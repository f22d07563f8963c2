"""The few functions without a native form (U01-U03), and edit distances of long sequences (A27, U04), on Arrow batches."""

from __future__ import annotations

import difflib
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import pairwise
from operator import ne

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Edits up to which the diagonals are followed before the bit vectors take over: so many, and one in 128 elements.
FEW_EDITS = 512


def _alike(a: Sequence, b: Sequence, i: int, j: int) -> int:
    """How far a from i on and b from j on go on alike: slices are compared, twice as long after each success."""
    start, step = i, 16
    while step:
        if i + step <= len(a) and j + step <= len(b) and a[i : i + step] == b[j : j + step]:
            i, j, step = i + step, j + step, step * 2
        else:
            step //= 2
    return i - start


def _places(a: Sequence) -> dict:
    """For each element the places at which it stands, as bits."""
    at: dict = {}
    for i, x in enumerate(a):
        at.setdefault(x, []).append(i)
    out = {}
    for x, found in at.items():
        if len(found) < 32:
            out[x] = sum(1 << i for i in found)
        else:
            bits = bytearray(len(a) // 8 + 1)
            for i in found:
                bits[i >> 3] |= 1 << (i & 7)
            out[x] = int.from_bytes(bits, "little")
    return out


def _within(a: Sequence, b: Sequence, places: dict, most: int) -> int:
    """An upper bound of the distance (a is the shorter one), which is the distance if that is ``most`` or less.

    Alignments of ``most`` edits stay on a band of diagonals. Bit vectors hold a column's part of the band and move down after some columns;
    what lies outside counts as inserted or deleted.
    """
    n, m = len(a), len(b)
    side = (most - (m - n)) // 2
    tall = m - n + 2 * side + 1
    size = m if n <= 1024 or tall * 4 >= n * 3 else max(64, tall // 4)
    base, top, high, up, down = 0, 0, 0, 0, 0
    for first in range(0, m, size):
        columns = b[first : first + size]
        start, end = (0, n) if size == m else (max(base, first - (m - n) - side), min(n, first + len(columns) + side))
        passed = (1 << (start - base)) - 1
        top += (up & passed).bit_count() - (down & passed).bit_count() + len(columns)
        up, down = up >> (start - base) | ((1 << (end - high)) - 1) << (high - start), down >> (start - base)
        base, high = start, end
        mask = (1 << (high - base)) - 1
        full, here = mask * 2 + 1, {}
        for y in columns:
            eq = here.get(y)
            if eq is None:
                eq = here[y] = places.get(y, 0) >> base & mask
            across = ((((eq & up) + up) ^ up) | eq | down) & mask
            plus = (down | (mask ^ (across | up))) << 1 | 1
            up = ((across & up) << 1 | (full ^ (across | plus))) & mask
            down = plus & across
    return top + up.bit_count() - down.bit_count()


def edits(a: Sequence, b: Sequence) -> int:
    """Edit distance of two strings, or of two lists of words.

    The elements that one has more often than the other are a lower bound, the places that differ an upper one; often they meet. Where few
    edits may do (see ``FEW_EDITS``) the furthest place on each diagonal is known after each edit, so that cost grows with the length and
    the square of the edits. Beyond, bit vectors hold a column of the matrix, or of a band around the lower bound; if the band proves too narrow, it has
    given an upper bound, and a band of that many edits is wide enough.
    """
    if len(a) > len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if not n or a == b:
        return m - n
    there = Counter(b)
    least, most = m - sum(min(k, there[x]) for x, k in Counter(a).items()), sum(map(ne, a, b)) + m - n
    if least == most:
        return most
    few = min(FEW_EDITS, n // 128)
    reached = {0: _alike(a, b, 0, 0)} if least <= few else {}
    for d in range(1, few + 1) if reached else ():
        now = {}
        for k in range(max(-d, -n), min(d, m) + 1):  # diagonal: place in b less place in a
            at = max(reached.get(k, -2) + 1, reached.get(k - 1, -2), reached.get(k + 1, -2) + 1)
            at = min(at, n, m - k)
            if at >= 0:
                now[k] = at + _alike(a, b, at, at + k)
        if now.get(m - n) == n:
            return d
        reached = now
    places, guess = _places(a), min(most, least + least // 8 + 8)
    found = _within(a, b, places, guess)
    return found if found <= guess else _within(a, b, places, found)


@F.arrow_udf(T.LongType())
def char_edits(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([edits(x.as_py() or "", y.as_py() or "") for x, y in zip(a, b, strict=True)], pa.int64())


def _rows(a: pa.Array) -> Iterator[list]:
    """The lists of a column one by one: the batch stays in Arrow's form."""
    ends = a.offsets.to_pylist()
    for start, end in pairwise(ends):
        yield a.values.slice(start, end - start).to_numpy(zero_copy_only=False).tolist()


@F.arrow_udf(T.LongType())
def word_edits(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([edits(x, y) for x, y in zip(_rows(a), _rows(b), strict=True)], pa.int64())


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None else unicodedata.normalize("NFC", x))


def ratio(x: str, y: str) -> float:
    """difflib's ratio, which is 1 for equal texts."""
    return 1.0 if x == y else difflib.SequenceMatcher(None, x, y).ratio()


def reaches(x: str, y: str, least: float) -> bool:
    """Whether the ratio is ``least`` or more; upper bounds by lengths and by characters in common come first."""
    if x == y:
        return least <= 1
    size = len(x) + len(y)
    if 2.0 * min(len(x), len(y)) / size < least:
        return False
    there = Counter(y)
    if 2.0 * sum(min(k, there[c]) for c, k in Counter(x).items()) / size < least:
        return False
    return difflib.SequenceMatcher(None, x, y).ratio() >= least


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")


def sequence_reaches(a: Column, b: Column, least: float) -> Column:
    """Whether :func:`sequence_ratio` is ``least`` or more."""

    @F.pandas_udf(T.BooleanType())
    def reached(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([reaches(x or "", y or "", least) for x, y in zip(a, b, strict=True)], dtype="bool")

    return reached(a, b)


@F.pandas_udf(T.StringType())
def unified_diff(raw: pd.Series, corrected: pd.Series) -> pd.Series:
    def one(x: str, y: str) -> str:
        return "" if x == y else "\n".join(difflib.unified_diff(x.splitlines(), y.splitlines(), "raw_ocr", "corrected_ocr", lineterm=""))

    return pd.Series([one(x or "", y or "") for x, y in zip(raw, corrected, strict=True)])
