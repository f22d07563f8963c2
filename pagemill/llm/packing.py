"""Operator 7: lexical retrieval packing with a sharded BM25 index.

Documents become token ids with an end id. Whole windows of a document longer than a sequence stand alone;
its tail, and every shorter document, is packed. Tails are put in order of ``CODE`` min-wise hashes of their distinct
tokens, which favour rare ones; a shard is a run of ``SHARD`` tails (or ``TOKENS`` tokens) in that order, so shards hold texts
that share rare tokens, copies are neighbours, and more tails make the runs of one token longer, not looser. Each shard has a BM25
inverted index over its tails, with document frequencies and the mean length of the whole corpus. A seed (the rest of a
document that was cut, else the next one unused) asks with its ``QUERY`` weightiest terms; the unused neighbours follow in
order of their scores until the sequence is full, the last one cut there.
What is left of a shard at the end, less than a sequence, is cut at powers of two, so nothing is padded.

Defined results: null and empty texts are the end id alone; every row is a document of its own, rows that
share a doc_id too; null doc_ids are packed with null doc_id. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, shuffle_partitions, splitmix, working
from .tokens import END, encoder, in_runs

LENGTH = 4096
SHARD, TOKENS = 2048, 1 << 20
QUERY = 64
#: Characters encoded at once: each distinct pre-token of them is looked up once.
RUN = 2_000_000
CODE = 3
K1, B = 1.2, 0.75


def _orders(vocabulary: int) -> np.ndarray:
    """CODE random orders of the ids, as numbers: exponential draws with the id as rate, for later ids of a vocabulary are rarer."""
    u = (splitmix(np.arange(CODE * vocabulary, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(float) / (1 << 53)
    return (-np.log(1 - u).reshape(CODE, vocabulary) / np.arange(1, vocabulary + 1)).astype(np.float32)


def _code(distinct: np.ndarray, orders: np.ndarray) -> int:
    """The distinct tokens that come first in each order; texts that share most tokens most likely agree."""
    code = 0
    for k in orders[:, distinct].argmin(1) if len(distinct) else ():
        code = code << 21 | int(distinct[k])
    return code


def tokenised(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """Per row: doc_id, doc_tokens, crcs of its whole windows, tail (ids, fewer than ``length``), code, draw."""
    kinds = pa.schema([("doc_id", pa.int64()), ("doc_tokens", pa.int64()), ("crcs", pa.list_(pa.int64())), ("tail", pa.binary()), ("code", pa.int64()), ("draw", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("packing")
        encode = encoder(tokenizer)
        end = np.array([END], encode.kind).tobytes()
        orders = _orders(encode.vocabulary)
        row = 0
        for b in batches:
            names, k = b.column(0).to_pylist(), 0
            for texts in in_runs((t.as_py() or "" for t in b.column(1)), RUN):
                out = []
                for got in encode.batch(texts):
                    ids = np.frombuffer(got + end, encode.kind)
                    n = len(ids)
                    whole = n // length
                    crcs = [zlib.crc32(ids[length * i : length * (i + 1)].astype("<u4").tobytes()) for i in range(whole)]
                    tail = ids[length * whole :]
                    draw = zlib.crc32(f"{names[k]} {row}".encode())
                    out.append((names[k], n, crcs, tail.tobytes(), _code(np.unique(tail), orders), draw))
                    k += 1
                    row += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds.types, strict=True)], schema=kinds)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, doc_tokens long, crcs array<long>, tail binary, code long, draw long")


def frequencies(tails: DataFrame, kind: str, vocabulary: int) -> tuple[np.ndarray, float]:
    """Document frequency of every id and the mean length, over all tails; the table has one row per id at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary + 1, np.int64)
        for b in batches:
            for t in b.column(0):
                ids = np.frombuffer(t.as_py(), kind)
                total[np.unique(ids)] += 1
                total[-1] += len(ids)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    got = tails.select("tail").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(vocabulary + 1, np.int64)
    table[got.column("id").to_numpy()] = got.column("n").to_numpy()
    return table[:-1], float(table[-1])


class Index:
    """BM25 inverted index of one shard: for every id the documents that hold it, with their weights."""

    def __init__(self, tails: list[np.ndarray], idf: np.ndarray, mean: float) -> None:
        parts = [np.unique(t, return_counts=True) for t in tails]
        sizes = np.array([len(t) for t in tails], float)
        counts = [len(p[0]) for p in parts]
        term = np.concatenate([p[0] for p in parts]).astype(np.int64)
        doc = np.repeat(np.arange(len(tails)), counts)
        tf = np.concatenate([p[1] for p in parts]).astype(float)
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[doc] / max(1.0, mean)))
        self.queries = []
        at = 0
        for n in counts:
            w = weight[at : at + n]
            best = np.argpartition(-w, QUERY - 1)[:QUERY] if n > QUERY else np.arange(n)
            self.queries.append(term[at : at + n][best])
            at += n
        by = np.argsort(term, kind="stable")
        self.terms, self.start = np.unique(term[by], return_index=True)
        self.start = np.append(self.start, len(term))
        self.doc, self.weight = doc[by], weight[by].astype(np.float32)
        self.n = len(tails)

    def scores(self, seed: int) -> np.ndarray:
        out = np.zeros(self.n, np.float32)
        for k in np.searchsorted(self.terms, self.queries[seed]):
            a, b = self.start[k], self.start[k + 1]
            out[self.doc[a:b]] += self.weight[a:b]
        return out


def pack_tails(tails: list[np.ndarray], index: Index, length: int = LENGTH) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences as lists of (document, start in its tail, length), each full or a power of two long."""
    used = np.zeros(len(tails), bool)
    carry: tuple[int, int] | None = None
    following = 0
    while True:
        if carry is None:
            while following < len(tails) and used[following]:
                following += 1
            if following == len(tails):
                return
            carry = (following, 0)
            used[following] = True
        seed, start = carry
        pieces, room, carry = [(seed, start, len(tails[seed]) - start)], length - (len(tails[seed]) - start), None
        if room and not used.all():
            free = np.flatnonzero(~used)
            for i in free[np.argsort(-index.scores(seed)[free], kind="stable")].tolist():
                if not room:
                    break
                used[i] = True
                n = min(room, len(tails[i]))
                pieces.append((i, 0, n))
                room -= n
                if n < len(tails[i]):
                    carry = (i, n)
        if not room:
            yield pieces
            continue
        left = length - room
        while left:
            size = 1 << (left.bit_length() - 1)
            left -= size
            out = []
            while size:
                doc, start, n = pieces.pop(0)
                out.append((doc, start, min(n, size)))
                if n > size:
                    pieces.insert(0, (doc, start + size, n - size))
                size -= out[-1][2]
            yield out


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    local = encoder(tokenizer)
    kind, vocabulary = local.kind, local.vocabulary
    rows = materialise(tokenised(docs, tokenizer, length), "tails")
    df, tokens = frequencies(rows, kind, vocabulary)
    total = max(1, rows.count())
    held = spark.sparkContext.broadcast((np.log(1 + (total - df + 0.5) / (df + 0.5)), tokens / total))  # one number per id
    order = ["code", "draw", "doc_id", "doc_tokens"]
    parts = min(shuffle_partitions(spark), -(-total // SHARD))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        shard, size = [], 0
        for b in batches:
            for name, n, crcs, tail in zip(*(b.column(c) for c in ("doc_id", "doc_tokens", "crcs", "tail")), strict=True):
                ids = np.frombuffer(tail.as_py(), kind)
                shard.append((name.as_py(), n.as_py(), crcs.as_py(), ids))
                size += len(ids)
                if len(shard) == SHARD or size >= TOKENS:
                    yield shard
                    shard, size = [], 0
        if shard:
            yield shard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("packing")
        at = TaskContext.get().partitionId() << 40
        for shard in shards(batches):
            out = []
            for name, n, crcs, _ in shard:
                for k, crc in enumerate(crcs):
                    out.append((name, k * length, length, crc, n, at, 0))
                    at += 1
            some = [x for x in shard if len(x[3])]
            tails = [x[3] for x in some]
            for pieces in pack_tails(tails, Index(tails, *held.value), length) if some else ():
                offset = 0
                for j, start, n in pieces:
                    name, size, crcs, ids = some[j]
                    crc = zlib.crc32(ids[start : start + n].astype("<u4").tobytes())
                    out.append((name, len(crcs) * length + start, n, crc, size, at, offset))
                    offset += n
                at += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names)

    return dealt.select("doc_id", "doc_tokens", "crcs", "tail").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
