"""What the operators of this subpackage share: the scratch tables in the shared
folder, vectorised hashing over Arrow text columns, the packed exchange, prefix sums
over an order and connected components."""

from __future__ import annotations

import math
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

U64 = np.uint64
GROUP = 64  # tasks whose arrays are added together
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_OWN_ROOT: dict[str, str] = {}


# ------------------------------------------------------------------ scratch tables
def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where that is unset and all run on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_ROOT:
        _OWN_ROOT[app] = "file://" + tempfile.mkdtemp(prefix="voxelyard-")
    return _OWN_ROOT[app]


class Scratch:
    """Written tables that cut lineage; they survive the loss of any executor."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.base, self.n = spark, f"{shared_root(spark)}/{label}-{uuid.uuid4().hex[:12]}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{self.n}"
        self.n += 1
        conf, before = self.spark.conf, self.spark.conf.get(CLEANUP, None)
        conf.set(CLEANUP, "true")  # the write's shuffle files go when it is done
        df.write.option("compression", "zstd").parquet(path)
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._scratch = path
        return back

    def drop(self, df: DataFrame) -> None:
        """Delete a table of keep() that nothing reads any more."""
        if path := getattr(df, "_scratch", None):
            jvm = self.spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 4 << 20) -> None:
    """Arrow batches of at most so many rows and (but for one row) about so many bytes, so that long texts
    don't add up in a worker. The setting stays: results are computed after an operator has returned."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def text_bytes(docs: DataFrame) -> tuple[int, int]:
    """Rows and UTF-8 bytes of the whole column; sizes partitions, never results."""
    r = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    return r["n"], r["b"] or 0


def partitions(spark: SparkSession, size: float, each: float = 24e6) -> int:
    """Partitions for so many bytes: the session's count, or more."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / each))


def local_name(df: DataFrame, wanted: str) -> str:
    """A column name that clashes with none of df's."""
    while wanted in df.columns:
        wanted = "_" + wanted
    return wanted


# ------------------------------------------------------------------ Arrow text access
def string_buffers(col) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string array; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    kind = np.int64 if wide else np.int32
    o = np.frombuffer(off, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]] if len(o) else d[:0], o - (o[0] if len(o) else 0)


def slices(offsets: np.ndarray, most: int):
    """Ranges of rows with about ``most`` bytes each; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


# ------------------------------------------------------------------ hashing
_RNG = np.random.default_rng(20240229)
BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.int64).astype(U64) | U64(1)
BASE = U64(0x9E3779B97F4A7C15)
BASE_INV = U64(pow(int(BASE), -1, 2**64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length() if n > 1 else 1)
        a = np.full(size, base, U64)
        a[0] = 1
        have = _POWERS[name] = np.multiply.accumulate(a)
    return have[:n]


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """S with hash of [s, e) = (S[e] - S[s]) * BASE_INV**s, modulo 2**64."""
    s = np.zeros(len(codes) + 1, U64)
    np.cumsum(codes * _powers("up", BASE, len(codes)), out=s[1:])
    return s


def span_hash(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each span; the length is mixed in."""
    inv = _powers("down", BASE_INV, len(s))
    return mix((s[end] - s[start]) * inv[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


PIECE = 1 << 19  # bytes whose words are hashed at a time; hashing takes some 60 bytes for each


def _piece_end(data: np.ndarray, offsets: np.ndarray, at: int) -> int:
    """The first place from ``at`` on where no word is cut: white space, or the end of a row."""
    end = int(offsets[np.searchsorted(offsets, at)])
    while at < end:
        space = SPACE[data[at : min(end, at + PIECE)]]
        if space.any():
            return at + int(space.argmax())
        at += len(space)
    return end


def words_of(data: np.ndarray, offsets: np.ndarray):
    """Words ``[^\\x20\\x09-\\x0D]+`` of some rows' bytes, A-Z lowered: start, end, 64-bit
    hash of each word, and the first word of each row (one more entry than rows). Long rows are
    hashed in pieces, so that memory follows the words and not the bytes."""
    found, a = [], 0
    while a < len(data):
        b = _piece_end(data, offsets, a + PIECE) if a + PIECE < len(data) else len(data)
        start, end, h = _words_in(data[a:b], offsets - a)
        found.append((start + a, end + a, h))
        a = b
    if not found:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    start, end, h = found[0] if len(found) == 1 else (np.concatenate(x) for x in zip(*found, strict=True))
    return start, end, h, np.searchsorted(start, offsets)


def _words_in(data: np.ndarray, offsets: np.ndarray):
    n = len(data)
    inside = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[0], edge[n] = True, True
    edge[offsets[(offsets >= 0) & (offsets <= n)]] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before[edge[:n]] = False
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    after[edge[1:]] = False
    end = np.flatnonzero(inside & ~after) + 1
    s = prefix_hash(BYTE_CODE[LOWER[data]])
    return start, end, span_hash(s, start, end)


SHINGLE_MULT = _RNG.integers(1, 2**63, 16, dtype=np.int64).astype(U64) | U64(1)


def shingles_of(word_hash: np.ndarray, first: np.ndarray, k: int = 5):
    """Hashes of all k-word shingles of each row, not yet distinct, and the offsets of the
    rows; a row of fewer words has its whole sequence as one shingle."""
    rows = len(first) - 1
    counts = np.diff(first)
    total = len(word_hash)
    full = np.zeros(total, U64)
    for j in range(k):
        full[: total - j] += word_hash[j:] * SHINGLE_MULT[j]
    n_sh = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    off = np.zeros(rows + 1, np.int64)
    np.cumsum(n_sh, out=off[1:])
    at = np.repeat(first[:-1] - off[:-1], n_sh) + np.arange(off[-1])
    out = mix(full[at])
    for r in np.flatnonzero((counts > 0) & (counts < k)):
        h = U64(counts[r])
        with np.errstate(over="ignore"):
            for j in range(counts[r]):
                h = h + word_hash[first[r] + j] * SHINGLE_MULT[8 + j]
        out[off[r]] = mix(np.array([h], U64))[0]
    return out, off


def distinct_sorted(values: np.ndarray, offsets: np.ndarray):
    """Distinct values of each row, ascending, and the new offsets."""
    values = values.copy()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a > 1:
            values[a:b].sort()
    if not len(values):
        return values, offsets
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    new[offsets[:-1][offsets[:-1] < len(values)]] = True
    cum = np.zeros(len(values) + 1, np.int64)
    np.cumsum(new, out=cum[1:])
    return values[new], cum[offsets]


# ------------------------------------------------------------------ packed exchange
#: Text bytes to a bucket of the packed exchange. The count follows the data alone.
BUCKET_BYTES = 2e6


def buckets_for(size: float) -> int:
    return max(64, math.ceil(size / BUCKET_BYTES))


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    return (((h >> U64(32)) * U64(n)) >> U64(32)).astype(np.int64)


def squeeze(rec: np.ndarray, more: bytes = b"") -> bytes:
    """Records column by column, then further bytes, compressed."""
    import zstandard

    body = len(rec).to_bytes(8, "little") + b"".join(np.ascontiguousarray(rec[f]).tobytes() for f in rec.dtype.names) + more
    return zstandard.ZstdCompressor(level=1).compress(body)


def unsqueeze(x: bytes, dtype: np.dtype) -> tuple[np.ndarray, bytes]:
    import zstandard

    body = zstandard.ZstdDecompressor().decompress(x)
    n, at = int.from_bytes(body[:8], "little"), 8
    rec = np.empty(n, dtype)
    for f in dtype.names:
        rec[f] = np.frombuffer(body, dtype[f], n, at)
        at += n * dtype[f].itemsize
    return rec, body[at:]


def grouped(bucket: np.ndarray):
    """(bucket, positions) for each bucket that occurs."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cuts = np.flatnonzero(np.diff(b)) + 1
    starts = [0, *cuts.tolist()]
    for s, e in zip(starts, [*starts[1:], len(b)], strict=True):
        yield int(b[s]), order[s:e]


def by_bucket(batches, dtype: np.dtype, kind: int | None = None):
    """(bucket, records, other rows) of packed rows that come in the order of their buckets, a bucket at a
    time; rows of another kind are handed on as they are."""
    bucket, parts, other = None, [], []
    for b in batches:
        cols = [b.column(c) for c in (("bucket", "kind", "payload") if kind is not None else ("bucket", "payload"))]
        for i, bk in enumerate(cols[0].to_pylist()):
            if bk != bucket:
                if parts or other:
                    yield bucket, np.concatenate(parts) if parts else np.zeros(0, dtype), other
                bucket, parts, other = bk, [], []
            x = cols[-1][i].as_py()
            if kind is None or cols[1][i].as_py() == kind:
                parts.append(unsqueeze(x, dtype)[0])
            else:
                other.append((bk, cols[1][i].as_py(), x))
    if parts or other:
        yield bucket, np.concatenate(parts) if parts else np.zeros(0, dtype), other


def with_uid(docs: DataFrame, scratch: Scratch, more: tuple = ()) -> DataFrame:
    """(uid, doc_id, text, more columns): uid is doc_id where that is unique and not null; otherwise the rows
    are numbered in the order of (doc_id, text), nulls first. Null texts are empty."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)
    odd = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or doc_id is null").limit(1).count()
    if not odd:
        return rows.select(F.col("doc_id").alias("uid"), "doc_id", "text", *more)
    numbered = running_start(rows.withColumn("one", F.lit(1).cast("long")), [F.col("doc_id").asc(), F.col("text").asc()], "one", "uid", scratch)
    return scratch.keep(numbered.select("uid", "doc_id", "text", *more))


# ------------------------------------------------------------------ prefix sums over an order
def running_start(df: DataFrame, order: list, value: str | list, out: str | list, scratch: Scratch) -> DataFrame:
    """df with the sum of ``value`` over all rows before, in a total order; several values and names go
    as lists. Rows are dealt by range; only one total for each range goes through the driver. df's rows
    should be narrow."""
    spark = df.sparkSession
    values, outs = ([value], [out]) if isinstance(value, str) else (value, out)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    w = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranged = scratch.keep(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    totals = ranged.groupBy("_part").agg(*[F.sum(v).alias(f"_t{k}") for k, v in enumerate(values)])
    base, rows = [0] * len(values), []
    for r in sorted(totals.collect(), key=lambda r: r["_part"]):
        rows.append((r["_part"], *base))
        base = [x + (r[f"_t{k}"] or 0) for k, x in enumerate(base)]
    schema = "_part int" + "".join(f", _base{k} long" for k in range(len(values)))
    bases = F.broadcast(spark.createDataFrame(rows or [(-1, *base)], schema))  # one row for each range
    summed = ranged.withColumns({f"_in{k}": F.coalesce(F.sum(v).over(w), F.lit(0)) for k, v in enumerate(values)}).join(bases, "_part")
    drop = [f"{x}{k}" for x in ("_in", "_base") for k in range(len(values))]
    return summed.withColumns({o: (F.col(f"_base{k}") + F.col(f"_in{k}")).cast("long") for k, o in enumerate(outs)}).drop("_part", *drop)


# ------------------------------------------------------------------ sums of arrays
PIECE_CELLS = 1 << 14  # numbers of one piece of an array: 128 KB before it is compressed


def sum_rows(docs: DataFrame, run, width: int, n: int) -> np.ndarray:
    """Sum over tasks of arrays of n rows and so many columns. The arrays travel in compressed pieces,
    a row each, which are added by ranges of rows; pieces without a number other than 0 stay at home."""
    each = max(1, PIECE_CELLS // width)

    def rows_of(group, at, x):
        return pa.RecordBatch.from_arrays([pa.array(group, pa.int32()), pa.array(at, pa.int32()), pa.array(x, pa.binary())], names=["g", "at", "x"])

    def pack(a: np.ndarray) -> bytes:
        import zstandard

        return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a, "<f8").tobytes())

    def unpack(x: bytes) -> np.ndarray:
        import zstandard

        return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), "<f8")

    def cut(batches):
        total = run(batches)
        group = TaskContext.get().partitionId() // GROUP
        for a in range(0, n, each):
            if total[a : a + each].any():
                yield rows_of([group], [a], [pack(total[a : a + each])])

    def add(batches):
        key, held = None, None  # pieces come in the order of their keys
        for b in batches:
            for g, a, x in zip(b.column("g").to_pylist(), b.column("at").to_pylist(), b.column("x"), strict=True):
                if key != (g, a):
                    if key is not None:
                        yield rows_of([key[0] // GROUP], [key[1]], [pack(held)])
                    key, held = (g, a), 0.0
                held = held + unpack(x.as_py())
        if key is not None:
            yield rows_of([key[0] // GROUP], [key[1]], [pack(held)])

    # GROUP tasks add up first, then GROUP of those, so that no task meets the arrays of all
    schema = "g int, at int, x binary"
    some = docs.mapInArrow(cut, schema)
    for _ in range(2):
        some = some.repartition("g", "at").sortWithinPartitions("g", "at").mapInArrow(add, schema)
    out = np.zeros((n, width))
    for r in some.collect():  # n rows of width numbers, in pieces of at most GROUP groups
        v = unpack(bytes(r["x"])).reshape(-1, width)
        out[r["at"] : r["at"] + len(v)] += v
    return out


# ------------------------------------------------------------------ components
def components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """(node, component) for undirected edges (a, b); the component is its smallest node.
    Labels spread to neighbours and jump to their label's label until nothing changes; each
    round is a written table, the driver sees one count."""
    both = scratch.keep(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = scratch.keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("component")))
    for _ in range(rounds):
        near = both.join(labels, both.b == labels.node).groupBy(both.a).agg(F.min("component").alias("near"))
        best = labels.join(near, labels.node == near.a, "left").select("node", F.col("component").alias("was"), F.least("component", F.coalesce("near", "component")).alias("now"))
        jump = labels.select(F.col("node").alias("now"), F.col("component").alias("far"))
        new = scratch.keep(best.join(jump, "now", "left").select("node", "was", F.least("now", F.coalesce("far", "now")).alias("component")))
        moved = new.filter("was <> component").limit(1).count()
        scratch.drop(labels)
        labels = new.drop("was")
        labels._scratch = new._scratch
        if not moved:
            scratch.drop(both)
            return labels
    raise RuntimeError("components did not settle")
