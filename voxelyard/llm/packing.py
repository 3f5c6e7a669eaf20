"""Packing along a space-filling curve.

Each document's words are hashed to signs in a few dimensions; the mean is a point, the point
has a key on a Hilbert curve, and documents are dealt by ranges of the key that hold about as many
bytes each: bytes are counted by cells of the curve first. A cell that holds more than a range
(equal documents have one key) is dealt by doc_id. Each range is read in order, encoded, and cut into
sequences. The last tokens of a range fill sequences of power-of-two lengths, so nothing is
padded.

Defined results: a null text is empty (its end id alone is packed); repeated rows are packed
each, those of one id in one range; a very long text runs over as many sequences as it takes; ties of
the key go by doc_id, then text; an empty table gives no pieces; further columns are ignored."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from . import fasttok
from .common import U64, mix, partitions, slices, small_batches, string_buffers, sum_rows, table, text_bytes, words_of

VOCABULARY = "byte_bpe_50k.json"
END_ID = 1
LENGTH = 2048
DIMS, BITS = 4, 12
CELL_BITS = 18  # 262,144 cells of the curve, whatever the input
ROW = 64  # bytes that a document counts beside its text
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def hilbert_key(x: np.ndarray, bits: int) -> np.ndarray:
    """Index along the Hilbert curve of integer points (rows of x), after Skilling (2004)."""
    x = x.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the excess work of the inverse transform
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def document_points(col) -> np.ndarray:
    """A point in [0, 1)**DIMS for each text: the mean of its words' hashed signs, spread out."""
    data, off = string_buffers(col)
    out = np.full((len(off) - 1, DIMS), 0.5)
    for i, j in slices(off, 1 << 18):
        _, _, h, first = words_of(data[off[i] : off[j]], off[i : j + 1] - off[i])
        n = np.diff(first)
        at = np.flatnonzero(n)
        if len(at):
            bits = mix(h)
            for d in range(DIMS):
                sign = ((bits >> U64(7 * d)) & U64(127)).astype(np.float64) - 63.5
                mean = np.add.reduceat(sign, first[:-1][at]) / n[at]
                out[i + at, d] = 0.5 + np.arctan(mean / 12.0) / np.pi
    return out


def curve_keys(col) -> np.ndarray:
    x = np.minimum((document_points(col) * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
    return hilbert_key(x, BITS)


def curve_bytes(docs: DataFrame) -> np.ndarray:
    """Bytes (and ROW for each document) in each cell of the curve."""

    def run(batches):
        total = np.zeros((1 << CELL_BITS, 1))
        for b in batches:
            _, off = string_buffers(b.column("text"))
            total[:, 0] += np.bincount(curve_keys(b.column("text")) >> (DIMS * BITS - CELL_BITS), np.diff(off) + float(ROW), 1 << CELL_BITS)
        return total

    return sum_rows(docs.select("text"), run, 1, 1 << CELL_BITS)[:, 0]


def ranges(weight: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First of n ranges for each cell, and how many ranges share the cell: 1 unless it holds more than one."""
    share = max(float(weight.sum()) / n, 1e-9)
    end = np.cumsum(weight)
    first = np.minimum(((end - weight) / share).astype(np.int64), n - 1)
    last = np.minimum(np.ceil(end / share).astype(np.int64) - 1, n - 1)
    return first, np.where(weight > share, np.maximum(last - first, 0) + 1, 1)


def along_curve(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, text), dealt to n tasks by ranges of the curve and in its order."""
    first, spread = ranges(curve_bytes(docs), n)

    def run(batches):
        for b in batches:
            key = curve_keys(b.column("text"))
            cell = key >> (DIMS * BITS - CELL_BITS)
            ids = b.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            part = first[cell] + (mix(ids.view(U64)) % spread[cell].astype(U64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), pa.array(key), pa.array(part.astype(np.int32))], names=["doc_id", "text", "curve", "part"])

    keyed = docs.mapInArrow(run, "doc_id long, text string, curve long, part int")
    return keyed.repartitionById(n, "part").sortWithinPartitions("curve", "doc_id", "text").select("doc_id", "text")


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID, length: int = LENGTH) -> DataFrame:
    """One row for each piece of a document in a sequence; see SCHEMA."""
    spark = docs.sparkSession
    small_batches(spark)
    path = fasttok.vocabulary(vocabulary)
    docs = docs.select("doc_id", "text")
    _, size = text_bytes(docs)
    ranged = along_curve(docs, partitions(spark, size))

    def run(batches):
        tok = fasttok.load(path)
        part = TaskContext.get().partitionId() << 32
        seq, used = 0, 0
        out: list[tuple] = []
        tail: list[tuple] = []  # pieces of the sequence that is not full

        def emit(rows):
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[f.split()[0] for f in SCHEMA.split(", ")])

        def piece(doc, start, ids, total, s, o):
            return doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, part + s, o

        for b in batches:
            doc_ids = b.column("doc_id").to_pylist()
            for i, j, flat, ends in tok.tokens(b.column("text")):
                for r in range(j - i):
                    ids = np.append(flat[ends[r] : ends[r + 1]], end_id)
                    at, total = 0, len(ids)
                    while at < total:
                        n = min(total - at, length - used)
                        tail.append((doc_ids[i + r], at, ids[at : at + n], total, used))
                        at, used = at + n, used + n
                        if used == length:
                            out += [piece(d, s, x, t, seq, o) for d, s, x, t, o in tail]
                            tail, used, seq = [], 0, seq + 1
            if len(out) > 5000:
                yield emit(out)
                out = []
        bit = 1 << (length.bit_length() - 1)
        room, o = 0, 0
        left = used
        for d, s, x, t, _ in tail:  # the rest, by falling powers of two
            at = 0
            while at < len(x):
                if room == 0:
                    while bit > left:
                        bit >>= 1
                    room, o, left, seq = bit, 0, left - bit, seq + 1
                n = min(room, len(x) - at)
                out.append(piece(d, s + at, x[at : at + n], t, seq - 1, o))
                at, o, room = at + n, o + n, room - n
        yield emit(out)

    return ranged.mapInArrow(run, SCHEMA)


def op4_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
