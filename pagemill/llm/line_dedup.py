"""Operator 2: line dedup by a segment-partition edit join.

Lines (texts split at ``\\n``) are normalised: lower-cased, white space runs to one space, trimmed. Every line
that is not empty then takes part. Two lines are linked when their edit distance is at most tau, which is one
edit per ``PER_EDIT`` code points of the shorter line and ``TAU`` at most, so the shortest lines are linked as exact
copies only. A line is cut into tau + 1 even segments, the index side; tau edits leave one of them whole. The
probe side cuts, for every length from its own down to tau (of that length) less, the substrings that can stand
against each segment, by the multi-match-aware window: segment i (from 0) shifts by at most i to either side and,
seen from the right, by at most tau - i around the length difference. Candidates are confirmed by a banded
bit-parallel edit distance after common ends are cut off.

Of each component of linked lines the first occurrence, by doc_id and line number, is kept. Equal lines are one item,
known by a 64-bit hash. Defined results: null and empty texts and blank lines have no part in it; rows with null
doc_id come last, and repeated rows count as one occurrence. Other columns are not read, except that
:func:`dedup_lines` returns them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import linking
from .common import materialise, splitmix, unused, working
from .linking import bitmap, link, may_hold

TAU = 2
PER_EDIT = 12
BINS = 32
#: Characters of lines that a task describes at once.
AT_ONCE = 500_000
_BASE = 0x9E3779B97F4A7C15


def normalised(line: str) -> str:
    return " ".join(line.lower().split())


def _hash(text: str) -> int:
    h = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def edits(length: int) -> int:
    """The edits allowed between a line of this length and one that is not shorter."""
    return min(TAU, length // PER_EDIT)


def segments(length: int, tau: int) -> list[tuple[int, int]]:
    """(start, length) of the tau + 1 even segments; the last ones are one longer."""
    base, longer = divmod(length, tau + 1)
    out, at = [], 0
    for i in range(tau + 1):
        n = base + (i >= tau + 1 - longer)
        out.append((at, n))
        at += n
    return out


def segment_keys(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, key, role) of many lines: role 0 for a line's own segments, 1 for its substrings against the segments of others.

    Lines that allow no edit have no segments: equal lines are one item already. A substring's hash is a polynomial of its
    code points, the difference of two prefix sums.
    """
    n = np.array([len(x) for x in lines], np.int64)
    start = np.cumsum(n) - n
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    powers = np.full(len(points) + 1, _BASE, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    back = np.full(len(points) + 1, pow(_BASE, -1, 1 << 64), np.uint64)
    back[0] = 1
    back = np.cumprod(back, dtype=np.uint64)
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(splitmix(points.astype(np.uint64) + np.uint64(_BASE)) * powers[:-1], dtype=np.uint64, out=sums[1:])
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for tau in range(1, TAU + 1):
        for more in range(tau + 1):
            length = n - more
            some = np.flatnonzero((length >= PER_EDIT) & (np.minimum(TAU, length // PER_EDIT) == tau))
            if not len(some):
                continue
            length, whole, first = length[some], n[some], start[some]
            base, longer = length // (tau + 1), length % (tau + 1)
            for i in range(tau + 1):
                at = i * base + np.maximum(0, i - (tau + 1 - longer))
                size = base + (i >= tau + 1 - longer)
                lo = np.maximum(np.maximum(0, at - i), at + more - (tau - i))
                hi = np.minimum(np.minimum(whole - size, at + i), at + more + (tau - i))
                salt = splitmix((length * (TAU + 1) + i).astype(np.uint64))
                for shift in range(2 * tau + 1):
                    ok = np.flatnonzero(lo + shift <= hi)
                    if not len(ok):
                        break
                    p = first[ok] + lo[ok] + shift
                    h = (sums[p + size[ok]] - sums[p]) * back[p]
                    role = (more > 0) | (lo[ok] + shift != at[ok])
                    found.append((some[ok], splitmix(h ^ salt[ok]).view(np.int64), role.astype(np.int32)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    line, key, role = (np.concatenate(x) for x in zip(*found, strict=True))
    return line, key, role


def within(a: str, b: str, tau: int = TAU) -> bool:
    """Whether the edit distance is at most tau: bit vectors over a diagonal band of 2 tau + 1 cells.

    Bit j of state e says that with e edits or fewer the two prefixes on diagonal j - tau meet here.
    """
    if abs(len(a) - len(b)) > tau:
        return False
    lo, top = 0, min(len(a), len(b))
    step = top
    while step:
        if a[lo : lo + step] == b[lo : lo + step]:
            lo += step
            step = min(step, top - lo)
        else:
            step //= 2
    a, b = a[lo:], b[lo:]
    hi, top, step = 0, min(len(a), len(b)), min(len(a), len(b))
    while step:
        if a[len(a) - hi - step : len(a) - hi] == b[len(b) - hi - step : len(b) - hi]:
            hi += step
            step = min(step, top - hi)
        else:
            step //= 2
    a, b = a[: len(a) - hi], b[: len(b) - hi]
    if not a or not b:
        return len(a) + len(b) <= tau
    mask = (1 << (2 * tau + 1)) - 1
    # states[e]: diagonals reached with e edits; bit tau is the main diagonal, higher bits read more of b
    states = [sum(1 << (tau + d) for d in range(e + 1)) for e in range(tau + 1)]
    for i, c in enumerate(a):
        same = 0
        for j in range(max(0, i - tau), min(len(b), i + tau + 1)):
            if b[j] == c:
                same |= 1 << (j - i + tau)
        before, states = states, [states[0] & same]
        for e in range(1, tau + 1):
            s = (before[e] & same) | before[e - 1] | (before[e - 1] >> 1)
            s |= states[e - 1] << 1
            states.append(s & mask)
        if not states[tau]:
            return False
    return bool(states[tau] >> (len(b) - len(a) + tau) & 1)


def _near(a: np.ndarray, b: np.ndarray, apart: np.ndarray) -> np.ndarray:
    tau = np.minimum(TAU, np.minimum(a, b) // PER_EDIT)
    return (np.abs(a - b) <= tau) & (apart <= 2 * tau)


def _verify(a: bytes, b: bytes) -> bool:
    x, y = a.decode("utf-8", "surrogatepass"), b.decode("utf-8", "surrogatepass")
    return within(x, y, edits(min(len(x), len(y))))


def _alike(contents: list[bytes]):
    """For the lines of a block: which may be within the edits allowed, by length and letter counts, and the check itself."""
    lines = [c.decode("utf-8", "surrogatepass") for c in contents]
    sizes, sigs = np.array([len(x) for x in lines]), np.stack([_letters(x) for x in lines]).astype(np.int16)

    def candidates(i: int, js: np.ndarray) -> np.ndarray:
        js = js[np.abs(sizes[js] - sizes[i]) <= TAU]
        return js[_near(sizes[i], sizes[js], np.abs(sigs[js] - sigs[i]).sum(1))]

    return candidates, lambda i, j: within(lines[i], lines[j], edits(min(len(lines[i]), len(lines[j]))))


def _letters(line: str) -> np.ndarray:
    points = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.minimum(np.bincount(points % BINS, minlength=BINS), 255).astype(np.uint8)


def _lines(text: str | None) -> list[tuple[int, str]]:
    """(line number, normalised line) of the lines that are not blank."""
    return [(k, x) for k, line in enumerate((text or "").lower().split("\n")) if (x := " ".join(line.split()))]


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, line_no, id, own, probes) of every line that is not blank.

    mark: a hash of the text, id: one of the line; own and probes: its keys of role 0 and 1, null where the task has given them before.
    """
    kinds = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("line_no", pa.int32()), ("id", pa.int64()), ("own", pa.list_(pa.int64())), ("probes", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("line_dedup")
        seen: set[int] = set()
        doc, mark, no, ids, new, texts = [], [], [], [], [], []
        size = 0

        def done() -> pa.RecordBatch:
            line, key, role = segment_keys(texts)
            row = np.array(new, np.int64)[line] if len(new) else line
            lists = []
            for r in (0, 1):
                rows, keys = row[role == r], key[role == r]
                by = np.argsort(rows, kind="stable")
                ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(ids)))]).astype(np.int32)
                lists.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[by])))
            cols = [pa.array(x, t) for x, t in zip((doc, mark, no, ids), kinds.types, strict=False)]
            return pa.RecordBatch.from_arrays([*cols, *lists], schema=kinds)

        for b in batches:
            for i, m, text in zip(b.column(0), b.column(2), b.column(1), strict=True):
                i, m = i.as_py(), m.as_py()
                for k, line in _lines(text.as_py()):
                    h = _hash(line)
                    if len(line) >= PER_EDIT and h not in seen:
                        if len(seen) > 200_000:
                            seen.clear()
                        seen.add(h)
                        new.append(len(ids))
                        texts.append(line)
                        size += len(line)
                    doc.append(i)
                    mark.append(m)
                    no.append(k)
                    ids.append(h)
                    if size > AT_ONCE or len(ids) >= 20_000:
                        yield done()
                        doc, mark, no, ids, new, texts = [], [], [], [], [], []
                        size = 0
        yield done()

    return docs.select("doc_id", "text", F.xxhash64("text").alias("mark")).mapInArrow(run, "doc_id long, mark long, line_no int, id long, own array<long>, probes array<long>")


def line_groups(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """(id, component) of the lines (as described) that are linked with another text."""

    def candidates(rows: DataFrame) -> DataFrame:
        keys = [rows.select(F.explode(c).alias("key"), "id", F.lit(r).alias("role")) for r, c in enumerate(("own", "probes"))]
        return keys[0].unionByName(keys[1])

    def store_of(ids: DataFrame) -> DataFrame:
        held = docs.sparkSession.sparkContext.broadcast(bitmap(ids))  # 8 MB at any size
        kinds = pa.schema([("id", pa.int64()), ("size", pa.int64()), ("sig", pa.binary()), ("payload", pa.binary())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            working("line_dedup")
            seen: set[int] = set()
            for b in batches:
                for lo in range(0, b.num_rows, 1000):
                    found = [x for text in b.column(0).slice(lo, 1000) for _, x in _lines(text.as_py()) if len(x) >= PER_EDIT]
                    hashes = np.array([_hash(x) for x in found], np.int64)
                    out = []
                    for k in np.flatnonzero(may_hold(held.value, hashes)).tolist():
                        if (i := int(hashes[k])) in seen:
                            continue
                        if len(seen) > 200_000:
                            seen.clear()
                        seen.add(i)
                        out.append({"id": i, "size": len(found[k]), "sig": _letters(found[k]).tobytes(), "payload": found[k].encode("utf-8", "surrogatepass")})
                    yield pa.RecordBatch.from_pylist(out, kinds)

        return docs.select("text").mapInArrow(run, "id long, size long, sig binary, payload binary").join(ids, "id", "left_semi")

    return link(candidates(lines), candidates(lines.sample(linking.SAMPLED, seed=7)), store_of, _near, _verify, _alike, "line_dedup")


def line_fates(docs: DataFrame) -> DataFrame:
    """Per line that is not blank: doc_id, line_no, class_doc, class_line (the first occurrence of its component), kept."""
    return _fates(docs).drop("mark")


def _fates(docs: DataFrame) -> DataFrame:
    """As :func:`line_fates`, with mark, the hash of the whole text. Occurrences are ordered by (doc_id is null, doc_id, line_no, mark)."""
    lines = materialise(described(docs), "lines")
    groups = line_groups(docs, lines)
    place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "line_no", "mark")
    firsts = materialise(lines.groupBy("id").agg(F.min(place).alias("first")).join(groups, "id", "left"), "line-firsts")
    least = firsts.where("component IS NOT NULL").groupBy("component").agg(F.min("first").alias("least"))
    by_line = materialise(firsts.join(least, "component", "left").select("id", F.coalesce("least", "first").alias("first")), "line-classes")
    out = lines.select("doc_id", "mark", "line_no", "id").join(by_line, "id")
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("line_no") == F.col("first.line_no")) & (F.col("mark") == F.col("first.mark"))
    return out.select("doc_id", "line_no", F.col("first.doc_id").alias("class_doc"), F.col("first.line_no").alias("class_line"), kept.alias("kept"), "mark")


@F.pandas_udf(StringType())
def _without(texts: pd.Series, gone: pd.Series) -> pd.Series:
    """The texts without the lines of these numbers; null where there are none."""

    def of(text: str | None, numbers) -> str | None:
        if text is None or numbers is None:
            return None
        drop = set(numbers.tolist())
        return "\n".join(x for k, x in enumerate(text.split("\n")) if k not in drop)

    return pd.Series([of(t, g) for t, g in zip(texts, gone, strict=True)], dtype=object)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` without the lines that are dropped; n_chars is counted anew, documents left without a line that is not blank go.

    Texts in which no line is dropped stay as they are. Rows that share a doc_id are decided by their own texts; rows with null doc_id stay.
    """
    doc, mark, gone, left, text = unused(docs.columns, "gone_doc", "gone_mark", "gone_lines", "lines_left", "new_text")
    fates = _fates(docs).where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias(doc), F.col("mark").alias(mark))
    fates = fates.agg(F.collect_set(F.when(~F.col("kept"), F.col("line_no"))).alias(gone), F.count_if("kept").alias(left)).where(F.size(gone) > 0)
    d = docs.join(fates, (docs.doc_id == F.col(doc)) & (F.xxhash64(docs.text) == F.col(mark)), "left")
    d = d.where(F.col(left).isNull() | (F.col(left) > 0)).withColumn(text, _without(F.when(F.col(gone).isNotNull(), docs.text), F.col(gone)))
    fresh = {"text": F.coalesce(text, "text")}
    if "n_chars" in docs.columns:
        fresh["n_chars"] = F.when(F.col(text).isNull(), F.col("n_chars")).otherwise(F.length(text).cast("long"))
    return d.select(*(fresh[c].alias(c) if c in fresh else F.col(f"`{c}`") for c in docs.columns))
