"""Operator 9: token files with Elias-Fano encoded document boundaries.

A file holds the ids of its documents, one after the other, as unsigned 16- or 32-bit integers, and where each
document ends as an Elias-Fano sequence: the low bits of every boundary packed, the high bits as a unary bit
vector with a sample of the places of its ones, so that ``select`` finds any boundary without decoding the
others, at about 2 + log2(ids / documents) bits each. Document ids, which ascend, are a second such sequence.

Layout (little-endian): the id array, the boundaries, the doc_ids, and a footer: width of an id in bytes
(u64), documents (u64), ids (u64), smallest doc_id (i64), documents with null doc_id (u64), bytes of the two
sequences (u64 each), magic ``PMTOK001``. So a file is written in one pass.

Executors write the files, one per range of doc_id, into a new folder under the shared folder, under names that no other attempt
uses; only files named by the tasks that finished are read. Defined results: null texts are empty; every document ends with id 2, so
none is empty; null doc_ids come first; rows that share a doc_id are ordered by text. Other columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, ranged_by_id, scratch_path, shuffle_partitions, working
from .tokens import END, encoder, in_runs

MAGIC = b"PMTOK001"
FOOTER = "<QQQqQQQ8s"
SAMPLED = 256
READ_AT_ONCE = 1 << 22


class EliasFano:
    """A non-decreasing sequence of non-negative integers in near-minimal space, with ``select``."""

    HEAD = struct.Struct("<QQI")

    def __init__(self, data: bytes) -> None:
        self.n, self.universe, self.low_bits = self.HEAD.unpack_from(data)
        at = self.HEAD.size
        low_words = (self.n * self.low_bits + 63) // 64 + 1
        self.low = np.frombuffer(data, "<u8", low_words, at)
        at += 8 * low_words
        samples = -(-self.n // SAMPLED)
        self.samples = np.frombuffer(data, "<u8", samples, at)
        at += 8 * samples
        self.high = np.frombuffer(data, np.uint8, offset=at)

    @classmethod
    def encode(cls, values: np.ndarray) -> bytes:
        v = np.asarray(values, np.uint64)
        n, universe = len(v), int(v[-1]) if len(v) else 0
        low_bits = max(0, (universe // n).bit_length() - 1) if n else 0
        low = np.zeros((n * low_bits + 63) // 64 + 1, np.uint64)
        if low_bits:
            part = v & np.uint64((1 << low_bits) - 1)
            bit = np.arange(n, dtype=np.uint64) * np.uint64(low_bits)
            word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
            np.bitwise_or.at(low, word, part << shift)
            over = (shift + np.uint64(low_bits)) > np.uint64(64)
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        ones = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        return cls.HEAD.pack(n, universe, low_bits) + low.astype("<u8").tobytes() + ones[::SAMPLED].astype("<u8").tobytes() + np.packbits(bits, bitorder="little").tobytes()

    def _low(self, i: int) -> int:
        if not self.low_bits:
            return 0
        word, shift = divmod(i * self.low_bits, 64)
        both = int(self.low[word]) | int(self.low[word + 1]) << 64
        return both >> shift & (1 << self.low_bits) - 1

    def select(self, i: int) -> int:
        """The i-th value: from the nearest sampled one, bytes of the bit vector are counted up to the i-th one."""
        at, left = int(self.samples[i // SAMPLED]), i % SAMPLED
        byte, bit = divmod(at, 8)
        word = int(self.high[byte]) >> bit << bit
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        place = 8 * byte + (word & -word).bit_length() - 1
        return (place - i) << self.low_bits | self._low(i)

    def block(self, lo: int, hi: int) -> np.ndarray:
        """The values lo to hi - 1, decoded together; lo: a multiple of SAMPLED."""
        first = int(self.samples[lo // SAMPLED]) // 8
        last = int(self.samples[-(-hi // SAMPLED)]) // 8 + 1 if -(-hi // SAMPLED) < len(self.samples) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[first:last], bitorder="little")) + 8 * first
        ones = ones[ones >= int(self.samples[lo // SAMPLED])][: hi - lo]
        i = np.arange(lo, hi)
        high = (ones - i).astype(np.uint64) << np.uint64(self.low_bits)
        if not self.low_bits:
            return high.astype(np.int64)
        bit = i.astype(np.uint64) * np.uint64(self.low_bits)
        word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
        low = self.low[word] >> shift
        up = shift > 0
        low[up] |= self.low[word[up] + 1] << (np.uint64(64) - shift[up])
        return (high | (low & np.uint64((1 << self.low_bits) - 1))).astype(np.int64)


class TokenFile:
    """Reads one file; ids are fetched by ranges, the sequences are held."""

    def __init__(self, source: pa.NativeFile) -> None:
        self.source = source
        source.seek(source.size() - struct.calcsize(FOOTER))
        self.width, self.n, self.ids, self.base, self.nulls, a, b, magic = struct.unpack(FOOTER, source.read(struct.calcsize(FOOTER)))
        if magic != MAGIC:
            raise ValueError("not a token file")
        source.seek(self.ids * self.width)
        self.ends, self.names = EliasFano(source.read(a)), EliasFano(source.read(b))

    def tokens(self, start: int, end: int) -> np.ndarray:
        self.source.seek(start * self.width)
        return np.frombuffer(self.source.read((end - start) * self.width), f"<u{self.width}")

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document, found by two selects."""
        return self.tokens(self.ends.select(i - 1) if i else 0, self.ends.select(i))

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """doc_id, start, ids of every document in order; boundaries and ids are read by blocks."""
        start = 0
        for lo in range(0, self.n, SAMPLED):
            hi = min(self.n, lo + SAMPLED)
            names, ends = self.names.block(lo, hi).tolist(), self.ends.block(lo, hi).tolist()
            first, whole = start, ends[-1] - start <= READ_AT_ONCE
            held = self.tokens(first, ends[-1]) if whole else None
            for k, (name, end) in enumerate(zip(names, ends, strict=True)):
                ids = held[start - first : end - first] if whole else self.tokens(start, end)
                yield (None if lo + k < self.nulls else name + self.base), start, ids
                start = end


def write(docs: DataFrame, tokenizer: str, parts: int | None = None) -> DataFrame:
    """Write all documents in ascending doc_id order; returns one row per file: part, path, documents, ids.

    The result is a written table. Files lie under the shared folder.
    """
    spark = docs.sparkSession
    parts = parts or shuffle_partitions(spark)
    folder = scratch_path(spark, "token-files")
    ranged = ranged_by_id(docs, parts, descending=False, carry_edges=False).select("doc_id", "text", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("token_files")
        encode = encoder(tokenizer)
        width, end = (2 if encode.small else 4), np.array([END], encode.kind).tobytes()
        store, at = fs.FileSystem.from_uri(folder)
        store.create_dir(at, recursive=True)
        out, part, path = None, None, ""
        names: list[int] = []
        sizes: list[int] = []
        nulls = total = 0
        done: list[tuple] = []

        def finish() -> None:
            base = min(names, default=0)
            ends = EliasFano.encode(np.cumsum(np.array(sizes, np.int64)))
            ids = EliasFano.encode(np.concatenate([np.zeros(nulls, np.int64), np.array(names, np.int64) - base]))
            out.write(ends)
            out.write(ids)
            out.write(struct.pack(FOOTER, width, len(sizes), total, base, nulls, len(ends), len(ids), MAGIC))
            out.close()
            done.append((part, path, len(sizes), total))

        for b in batches:
            ids, which = b.column(0).to_pylist(), b.column(2).to_pylist()
            k = 0
            for texts in in_runs(t.as_py() for t in b.column(1)):
                for got in encode.batch(texts):
                    if which[k] != part:
                        if out is not None:
                            finish()
                        part, path = which[k], f"{at}/part-{which[k]:06d}-{uuid.uuid4().hex}.ids"
                        out, names, sizes, nulls, total = store.open_output_stream(path), [], [], 0, 0
                    out.write(got)
                    out.write(end)
                    n = len(got) // width + 1
                    sizes.append(n)
                    total += n
                    if ids[k] is None:
                        nulls += 1
                    else:
                        names.append(ids[k])
                    k += 1
        if out is not None:
            finish()
        cols = list(zip(*done, strict=True)) or [[], [], [], []]
        kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["part", "path", "documents", "ids"])

    files = materialise(ranged.mapInArrow(run, "part int, path string, documents long, ids long"), "token-manifest")
    return files.withColumn("folder", F.lit(folder))


def read(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files of a manifest."""
    w = Window.orderBy("part")  # one row per file
    placed = files.withColumn("before", F.coalesce(F.sum("ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = placed.withColumn("at", F.row_number().over(w) - 1)
    dealt = placed.repartitionById(max(1, files.count()), F.col("at").cast("int")).select("path", "folder", "before")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, folder, base in zip(*(c.to_pylist() for c in b.columns), strict=True):
                store, _ = fs.FileSystem.from_uri(folder)
                with store.open_input_file(path) as source:
                    out = []
                    for i, start, ids in TokenFile(source).documents():
                        out.append((i, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        if len(out) == 10_000:
                            yield _rows(out)
                            out = []
                    yield _rows(out)

    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True)) or [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "n_tokens", "ids_crc32"])
