"""Operator 11: spelling variants, by search schemes over bidirectional FM-indexes.

Words are the runs of letters of whole texts, counted over all documents; the vocabulary holds those with ``MIN_CHARS`` code points and
``MIN_COUNT`` occurrences. Two words are near if one inserted, deleted or replaced code point is all that differs. Then one
half of the word stands whole in the other: the first half at its start, or the second half at its end. The search
scheme has those two searches: match one half exactly, extend over the other one with one error.

The vocabulary is sorted twice, as it is (for the first search) and reversed (for the second), and cut into shards of at most
``SHARD_WORDS`` words or ``SHARD_CHARS`` characters, more only for a single longer word. A word asks those shards whose range holds words that begin
with its half: nearly always one, so rows grow with the vocabulary. What the driver holds is one bound for each shard. A task builds the
bidirectional FM-index of one shard (:class:`Index`) over the text ``$word$word...$`` and runs all of the shard's queries in
blocks. Since the shard's words are sorted and distinct, the suffix rank of ``$word$`` is the word's number, so the index
needs no suffix array to say what it has found. A shard gives back one row for each query, with the count of near words and the best one;
a word found by both searches counts in the first one only.

Forms are followed to the last by pointer jumping, with tables in the shared folder between the rounds; a form has at least
twice the occurrences of its word, so chains are short and hold no circle.

Defined results: null and empty texts have no words; equal rows count as often as they are there; a null doc_id counts as
an empty one where runs are changed (:func:`mistyped`). Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, materialise

RUN = re.compile("[A-Za-zÀ-ÿ]+")
MIN_CHARS, MIN_COUNT, MIN_RATIO = 5, 3, 2
SHARD_WORDS, SHARD_CHARS = 1 << 15, 1 << 20
#: Distinct words that a task counts before it hands its counts on.
COUNTED = 300_000
#: Queries that are searched together.
BLOCK = 2048
#: (doc_id, run) -> the run as it counts.
Change = Callable[[int | None, str], str]

# an index codes its alphabet: 0 is the delimiter, 1.. are its characters in order
_ONE = np.uint64(1)


def mistyped(doc_id: int | None, run: str) -> str:
    """The query's test errors: one run in 97, by the hash of document and run, loses a code point."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % 97:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def vocabulary(docs: DataFrame, change: Change | None = None) -> DataFrame:
    """(word, n) of every word of all documents that is long and frequent enough. Tasks count before the shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return b

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found = Counter(RUN.findall((text.as_py() or "").encode().lower().decode()))  # of bytes, only A-Z have a lower case
                if change is None:
                    total.update({w: n for w, n in found.items() if len(w) >= MIN_CHARS})
                else:
                    for run, n in found.items():
                        if len(run) >= MIN_CHARS and len(w := change(doc_id, run)) >= MIN_CHARS:
                            total[w] += n
                if len(total) >= COUNTED:
                    yield out()
        yield out()

    counts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def _codes(words: list[str], alphabet: np.ndarray) -> np.ndarray:
    """``$word$...word$`` as codes; characters outside of the alphabet get the code after the last."""
    points = np.frombuffer(("\0" + "\0".join(words) + "\0").encode("utf-32-le"), np.uint32)
    at = np.searchsorted(alphabet, points)
    return np.where(points == 0, 0, np.where(alphabet[np.minimum(at, len(alphabet) - 1)] == points, at + 1, len(alphabet) + 1)).astype(np.uint8)


class _Ranks:
    """Suffix order and prefix-sum ranks of one text: how often codes up to c stand in front of the first i suffixes."""

    def __init__(self, text: np.ndarray, sigma: int) -> None:
        n = len(text)
        # delimiters are ranked by their place, so suffixes end at the next one; words are sorted, so that is the true order
        stops = np.flatnonzero(text == 0)
        rank = text.astype(np.int64) + len(stops)
        rank[stops] = np.arange(1, len(stops) + 1)
        step = 1
        while True:
            after = np.zeros(n, np.int64)
            after[: n - step] = rank[step:]
            after[stops] = 0
            key = rank << 32 | after
            order = np.argsort(key, kind="stable")
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate([[1], np.diff(key[order]) > 0]))
            if rank[order[-1]] == n:
                break
            step *= 2
        self.last = text[order - 1]  # the code in front of each suffix; the text's last delimiter stands in front of the first
        words = n // 64 + 1
        padded = np.full(words * 64, 255, np.uint8)
        padded[:n] = self.last
        self.bits, self.sums = np.zeros((sigma, words), np.uint64), np.zeros((sigma, words), np.int32)
        for c in range(sigma):
            self.bits[c] = np.packbits(padded <= c, bitorder="little").view(np.uint64)
            self.sums[c, 1:] = np.cumsum(np.bitwise_count(self.bits[c]), dtype=np.int32)[:-1]
        total = np.bincount(text, minlength=sigma)[:sigma]
        self.before = np.concatenate([[0], np.cumsum(total)[:-1]])

    def upto(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How many of the first i suffixes have a code <= c in front of them; c may be -1."""
        at = i >> 6
        n = self.sums[c, at] + np.bitwise_count(self.bits[c, at] & ((_ONE << (i & 63).astype(np.uint64)) - _ONE))
        return np.where(c < 0, 0, n).astype(np.int64)


class Index:
    """A bidirectional FM-index over sorted, distinct words: synchronised suffix-rank intervals of a pattern and of its reverse.

    A state is (lo, lo_reversed, size). The text and the reversed text have ranks of their own; extending a pattern to one side is a
    step in one of them, and the other interval moves by the count of smaller codes.
    """

    def __init__(self, words: list[str]) -> None:
        points = np.unique(np.frombuffer("".join(words).encode("utf-32-le"), np.uint32))
        self.alphabet, self.sigma = points, len(points) + 1
        if self.sigma > 250:
            raise ValueError("more than 249 characters in one index")
        self.text = _Ranks(_codes(words, self.alphabet), self.sigma)
        self.reversed = _Ranks(_codes(sorted(w[::-1] for w in words), self.alphabet), self.sigma)
        self.size = len(self.text.last)

    def _step(self, ranks: _Ranks, lo: np.ndarray, other: np.ndarray, size: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        hi = lo + size
        below, through = ranks.upto(c - 1, lo), ranks.upto(c, lo)
        below_hi, through_hi = ranks.upto(c - 1, hi), ranks.upto(c, hi)
        first = through - below
        return ranks.before[c] + first, other + (below_hi - below), (through_hi - below_hi) - first

    def left(self, lo: np.ndarray, rev: np.ndarray, size: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The states of c + pattern."""
        return self._step(self.text, lo, rev, size, c)

    def right(self, lo: np.ndarray, rev: np.ndarray, size: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The states of pattern + c."""
        rev, lo, size = self._step(self.reversed, rev, lo, size, c)
        return lo, rev, size

    def near(self, words: list[str], halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, number of an indexed word) of all that begin with the first ``halves`` code points of the query and have one error after them."""
        n = np.array([len(w) for w in words], np.int64)
        codes = _codes(words, self.alphabet).astype(np.int64)
        start = np.cumsum(n + 1) - n
        known = codes < self.sigma
        q = np.arange(len(words))
        lo, rev, size = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64), np.full(len(q), self.size, np.int64)
        for step in range(int(halves.max(initial=0)) + 1):  # the exact half leftwards, and the delimiter in front of it
            on = np.flatnonzero((step <= halves) & (size > 0))
            at = start[on] + halves[on] - 1 - step
            c, ok = codes[at], known[at]
            a, b, s = self.left(lo[on], rev[on], size[on], np.where(ok, c, 0))
            lo[on], rev[on], size[on] = a, b, np.where(ok, s, 0)
        found_q: list[np.ndarray] = []
        found_w: list[np.ndarray] = []
        exact = (q[size > 0], halves[size > 0], lo[size > 0], rev[size > 0], size[size > 0])
        erred = tuple(np.zeros(0, np.int64) for _ in range(5))
        turn = 0
        while len(exact[0]) or len(erred[0]):
            turn += 1
            if turn % 16 == 0:  # in long words with repeats, errors at many places lead to one state
                erred = tuple(np.unique(np.stack(erred), axis=1))
            # one error here: any code that follows, as a replacement or an insertion, or the query's code left out
            eq, ej, elo, erev, esize = exact
            kid = np.repeat(np.arange(len(eq)), np.minimum(esize, self.sigma))
            nth = np.arange(len(kid)) - np.repeat(np.cumsum(np.minimum(esize, self.sigma)) - np.minimum(esize, self.sigma), np.minimum(esize, self.sigma))
            few = esize[kid] <= self.sigma
            c = np.where(few, self.reversed.last[np.minimum(erev[kid] + nth, self.size - 1)], nth).astype(np.int64)
            once = np.unique(kid << 8 | c)
            kid, c = once >> 8, once & 255
            kid, c = kid[c > 0], c[c > 0]
            a, b, s = self.right(elo[kid], erev[kid], esize[kid], c)
            some = s > 0
            kid, c, a, b, s = kid[some], c[some], a[some], b[some], s[some]
            more = ej[kid] < n[eq[kid]]
            differs = more & (codes[start[eq[kid]] + np.minimum(ej[kid], n[eq[kid]] - 1)] != c)
            skip = ej < n[eq]
            # the erred states go one exact step on: over the query's next code, or its end
            wq, wj, wlo, wrev, wsize = erred
            ends = wj == n[wq]
            c2 = np.where(ends, 0, codes[start[wq] + np.minimum(wj, n[wq] - 1)])
            ok = c2 < self.sigma
            wq, wj, wlo, wrev, wsize, c2, ends = (x[ok] for x in (wq, wj, wlo, wrev, wsize, c2, ends))
            wlo, wrev, wsize = self.right(wlo, wrev, wsize, c2)
            done = ends & (wsize > 0) & (wlo > 0)  # $$, around the text's end, is no word
            found_q.append(wq[done])
            found_w.append(wlo[done] - 1)  # the rank of $word$; the text's last delimiter has rank 0
            on = ~ends & (wsize > 0)
            step = [(wq[on], wj[on] + 1, wlo[on], wrev[on], wsize[on])]
            step.append((eq[kid][differs], ej[kid][differs] + 1, a[differs], b[differs], s[differs]))
            step.append((eq[kid], ej[kid], a, b, s))
            step.append((eq[skip], ej[skip] + 1, elo[skip], erev[skip], esize[skip]))
            erred = tuple(np.concatenate(x) for x in zip(*step, strict=True))
            # and the exact states as well, but not over the end: that would be the word itself
            c3 = codes[start[eq] + np.minimum(ej, n[eq] - 1)]
            ok = (ej < n[eq]) & (c3 < self.sigma)
            eq, ej, elo, erev, esize, c3 = (x[ok] for x in (eq, ej, elo, erev, esize, c3))
            elo, erev, esize = self.right(elo, erev, esize, c3)
            on = esize > 0
            exact = (eq[on], ej[on] + 1, elo[on], erev[on], esize[on])
        query, word = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found_q, found_w))
        both = np.unique(query << 32 | word)
        return both >> 32, both & 0xFFFFFFFF


def _search(index: Index, keys: list[str], n: np.ndarray, queries: list[str], back: bool) -> pa.RecordBatch:
    """One row for each query with near words in this shard. ``back``: words are reversed, and what the other search finds is left out."""
    halves = np.array([len(w) - len(w) // 2 if back else len(w) // 2 for w in queries], np.int64)
    q, w = index.near(queries, halves)
    rows: dict[int, list] = {}
    for i, j in zip(q.tolist(), w.tolist(), strict=True):
        other = keys[j]
        if back:
            other = other[::-1]
            if other.startswith(queries[i][: halves[i] - 1 : -1]):
                continue
        best = (-int(n[j]), other)
        if i in rows:
            rows[i][0] += 1
            rows[i][1] = min(rows[i][1], best)
        else:
            rows[i] = [1, best]
    words = [queries[i][::-1] if back else queries[i] for i in rows]
    columns = [pa.array(words, pa.string()), pa.array([r[0] for r in rows.values()], pa.int64()), pa.array([-r[1][0] for r in rows.values()], pa.int64()), pa.array([r[1][1] for r in rows.values()], pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["word", "near", "best_n", "best"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the shards of a sorted range: a new one where words or characters are over the bound, or the side changes."""
    from pyspark import TaskContext

    shard, rows, chars, side = TaskContext.get().partitionId() << 32, 0, 0, None
    for b in batches:
        if not b.num_rows:
            continue
        of = []
        for k in b.column("key").to_pylist():
            if side is not None and (k[0] != side or rows >= SHARD_WORDS or chars + len(k) > SHARD_CHARS):
                shard, rows, chars = shard + 1, 0, 0
            side, rows, chars = k[0], rows + 1, chars + len(k)
            of.append(shard)
        yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), b.column("key"), b.column("n")], ["shard", "key", "n"])


def near_words(words: DataFrame) -> DataFrame:
    """(word, n) -> (word, near, best_n, best) of every word with near words: their number and the one with largest n."""
    both = words.select(F.explode(F.array(F.concat(F.lit("0"), "word"), F.concat(F.lit("1"), F.reverse("word")))).alias("key"), "n")
    parts = max(1, int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = both.repartitionByRange(parts, "key").sortWithinPartitions("key")
    index = materialise(ranged.mapInArrow(_cut, "shard long, key string, n long"), "spelling-shards")
    bounds = index.groupBy("shard").agg(F.min("key").alias("first")).toArrow()  # one row for each shard
    order = np.argsort(bounds.column("first").to_numpy(zero_copy_only=False).astype(object)) if bounds.num_rows else []
    firsts = [bounds.column("first")[int(i)].as_py() for i in order]
    shards = [bounds.column("shard")[int(i)].as_py() for i in order]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from bisect import bisect_right

        for b in batches:
            to, keys = [], []
            for k in b.column("key").to_pylist():
                m = len(k) - 1
                half = k[: 1 + (m // 2 if k[0] == "0" else m - m // 2)]
                for i in range(max(0, bisect_right(firsts, half) - 1), bisect_right(firsts, half + "\U0010ffff")):
                    if firsts[i][0] == k[0]:
                        to.append(shards[i])
                        keys.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array(keys, pa.string()), pa.nulls(len(to), pa.int64())], ["shard", "key", "n"])

    asked = index.select("key").mapInArrow(ask, "shard long, key string, n long")
    rows = index.unionByName(asked).repartition("shard").sortWithinPartitions("shard", F.col("n").isNull(), "key")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, keys, counts, queries, found = None, [], [], [], None
        for b in batches:
            for s, k, n in zip(*(b.column(c).to_pylist() for c in ("shard", "key", "n")), strict=True):
                if s != shard or len(queries) >= BLOCK:
                    if queries:
                        found = found or Index(keys)
                        yield _search(found, keys, np.array(counts, np.int64), queries, back)
                        queries = []
                    if s != shard:
                        shard, keys, counts, found, back = s, [], [], None, k[0] == "1"
                if n is None:
                    queries.append(k[1:])
                else:
                    keys.append(k[1:])
                    counts.append(n)
        if queries:
            yield _search(found or Index(keys), keys, np.array(counts, np.int64), queries, back)

    hits = rows.mapInArrow(search, "word string, near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("minus"), "best")).alias("b")
    return hits.groupBy("word").agg(F.sum("near").alias("near"), best).select("word", "near", (-F.col("b.minus")).alias("best_n"), "b.best")


def forms(words: DataFrame) -> DataFrame:
    """(word, n) of distinct words -> (word, form, root, n, n_near, form_n)."""
    base = materialise(words, "spelling-words")
    near = near_words(base)
    is_form = F.col("best_n") >= MIN_RATIO * F.col("n")
    found = base.join(near, "word", "left").select(
        "word", F.when(is_form, F.col("best")).alias("form"), "n", F.coalesce("near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best_n")).alias("form_n")
    )
    found = materialise(found, "spelling-forms")
    delete(base)
    at = materialise(found.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        jump = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = at.join(jump, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved"))
        moved = materialise(moved, "spelling-roots")
        delete(at)
        at = moved.select("word", "root")
        at.scratch = moved.scratch
        if moved.where("_moved").isEmpty():
            break
    return found.join(at, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, change: Change | None = None) -> DataFrame:
    """The vocabulary of the documents with the form and root of every word."""
    return forms(vocabulary(docs, change))
