"""Token ids in a content-addressed store.

A rolling hash over the ids of a document cuts its stream into chunks; equal chunks have equal
digests and are written once. Three tables of files lie in the store's folder: kind=chunk (digest,
ids), kind=recipe as cut, and ``recipes``: in ascending doc_id order, each document's chunk
digests, its place in the stream of all ids and among the documents, and the Merkle root over its
chunks. ``manifest`` holds the tree above these roots: FAN roots in order make a node of level 1, FAN
nodes one of the next level, up to a single root. Reading back takes ids from the chunk files only and
digests them again; first the tree is made anew from the recipes and compared node by node, so a
recipe that is lost, altered or out of its place is refused.

Defined results: a null text is empty (its end id alone); repeated rows are each written, ordered
by (doc_id, root); a null doc_id sorts first; a very long text is one recipe, its chunks stand
apart; an empty table gives an empty store; further columns are ignored."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fasttok
from .common import U64, Scratch, mix, partitions, running_start, small_batches, table, text_bytes

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
WINDOW = 32  # ids that the rolling hash covers
MEAN_BITS = 9  # a cut after 512 ids on average
LEAST, MOST = 64, 4096
FAN = 4096  # roots under one node of the manifest: 64 KB
MAX_SEEN = 2_000_000  # digests a task remembers; beyond, a chunk is sent again and dropped later


def rolling(ids: np.ndarray) -> np.ndarray:
    """h[i] = sum of code(ids[i - j]) << j for j < WINDOW: a gear hash, by doubling."""
    h = mix(ids.astype(U64) + U64(1))
    step = 1
    while step < WINDOW:
        h[step:] += h[:-step] << U64(step)
        step *= 2
    return h


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one document."""
    n = len(ids)
    out, last = [], 0
    if n > LEAST:
        for c in (np.flatnonzero(rolling(ids) >> U64(64 - MEAN_BITS) == 0) + 1).tolist():
            while c - last > MOST:
                last += MOST
                out.append(last)
            if c - last >= LEAST and c < n:
                out.append(c)
                last = c
    while n - last > MOST:
        last += MOST
        out.append(last)
    return [*out, n] if n > last else out


def merkle(digests: list[bytes]) -> bytes:
    """Root of a binary tree over digests; an odd node goes up as it is."""
    level = digests or [xxhash.xxh3_128_digest(b"")]
    while len(level) > 1:
        level = [xxhash.xxh3_128_digest(b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


# ---------------------------------------------------------------- crc32 of parts
_POLY = np.uint32(0xEDB88320)


def _mult(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of polynomials modulo the crc's, bits reflected."""
    p = np.zeros(len(a), np.uint32)
    b = b.copy()
    for i in range(31, -1, -1):
        p ^= np.where((a >> np.uint32(i)) & np.uint32(1), b, np.uint32(0))
        b = np.where(b & np.uint32(1), (b >> np.uint32(1)) ^ _POLY, b >> np.uint32(1))
    return p


def crc_shift(crc: np.ndarray, after: np.ndarray) -> np.ndarray:
    """What a part's crc32 adds to the whole's when so many bytes follow; parts add by xor."""
    p = crc.astype(np.uint32)
    square = np.full(1, 1 << 23, np.uint32)  # x**8: one byte
    left = after.astype(np.int64)
    while left.any():
        odd = (left & 1) == 1
        if odd.any():
            p[odd] = _mult(p[odd], np.repeat(square, int(odd.sum())))
        square = _mult(square, square)
        left >>= 1
    return p


# ---------------------------------------------------------------- write
def write_store(docs: DataFrame, scratch: Scratch, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> tuple[str, DataFrame]:
    """Write the store; its folder, and the recipes as written."""
    spark = docs.sparkSession
    small_batches(spark)
    path = fasttok.vocabulary(vocabulary)
    _, size = text_bytes(docs)
    n = partitions(spark, size)

    def cut(batches):
        tok = fasttok.load(path)
        seen: set[bytes] = set()
        for b in batches:
            doc_ids = b.column("doc_id").to_pylist()
            route, kind, digest, ids_out, docs_out, count, recipe, root = [], [], [], [], [], [], [], []
            for i, j, flat, ends in tok.tokens(b.column("text")):
                for r in range(j - i):
                    ids = np.append(flat[ends[r] : ends[r + 1]], end_id).astype("<u4")
                    at, names = 0, []
                    for e in cuts(ids):
                        raw = ids[at:e].tobytes()
                        d = xxhash.xxh3_128_digest(raw)
                        names.append(d + (e - at).to_bytes(4, "little"))
                        at = e
                        if d not in seen:
                            if len(seen) < MAX_SEEN:
                                seen.add(d)
                            route.append(int.from_bytes(d[:7], "little"))
                            kind.append("chunk")
                            digest.append(d)
                            ids_out.append(pack_ids(raw))
                            for x in (docs_out, count, recipe, root):
                                x.append(None)
                    top = merkle([x[:16] for x in names])
                    route.append(int.from_bytes(top[:7], "little") ^ (doc_ids[i + r] or 0))
                    kind.append("recipe")
                    digest.append(None)
                    ids_out.append(None)
                    docs_out.append(doc_ids[i + r])
                    count.append(len(ids))
                    recipe.append(b"".join(names))
                    root.append(top)
            yield pa.RecordBatch.from_arrays(
                [pa.array(route, pa.int64()), pa.array(kind, pa.string()), pa.array(digest, pa.binary()), pa.array(ids_out, pa.binary()), pa.array(docs_out, pa.int64()), pa.array(count, pa.int64()), pa.array(recipe, pa.binary()), pa.array(root, pa.binary())],
                names=["route", "kind", "digest", "ids", "doc_id", "n_tokens", "recipe", "root"],
            )

    def once(batches):
        seen: set[bytes] = set()
        for b in batches:
            keep = []
            for d in b.column("digest").to_pylist():
                keep.append(d is None or d not in seen)
                if d is not None:
                    seen.add(d)
            yield b.filter(pa.array(keep, pa.bool_()))

    schema = "route long, kind string, digest binary, ids binary, doc_id long, n_tokens long, recipe binary, root binary"
    dealt = docs.select("doc_id", "text").mapInArrow(cut, schema).repartition(n, "route").mapInArrow(once, schema)
    folder = f"{scratch.base}/store"
    dealt.drop("route").write.option("compression", "zstd").partitionBy("kind").parquet(f"{folder}/parts")
    cut_recipes = _parts(spark, folder, "recipe").select("doc_id", "n_tokens", "recipe", "root")
    one = cut_recipes.withColumn("one", F.lit(1).cast("long"))
    placed = running_start(one, [F.col("doc_id").asc_nulls_first(), F.col("root").asc()], ["n_tokens", "one"], ["start", "place"], scratch)
    placed.drop("one").sortWithinPartitions("start").write.option("compression", "zstd").parquet(f"{folder}/recipes")
    recipes = read_recipes(spark, folder)
    write_manifest(recipes, folder)
    return folder, recipes


RECIPE = "doc_id long, n_tokens long, recipe binary, root binary, start long, place long"
NODE = "level int, node long, documents long, n_tokens long, root binary"


def read_recipes(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(RECIPE).parquet(f"{folder}/recipes")


def _node_roots(rows: DataFrame) -> DataFrame:
    """(node, documents, n_tokens, root) of rows (place, documents, n_tokens, root): FAN places to a node."""

    def roots(batches):
        for b in batches:
            out = [merkle([x["root"] for x in r]) for r in b.column("roots").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("documents"), b.column("n_tokens"), pa.array(out, pa.binary())], names=["node", "documents", "n_tokens", "root"])

    each = rows.groupBy(F.floor(F.col("place") / FAN).cast("long").alias("node")).agg(F.sum("documents").alias("documents"), F.sum("n_tokens").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("place", "root"))).alias("roots"))
    return each.mapInArrow(roots, NODE.replace("level int, ", ""))


def _leaves(recipes: DataFrame) -> DataFrame:
    """Of each document: its place, and its root with its id, start and length."""
    whole = F.concat(F.col("root"), F.encode(F.concat_ws(",", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "start", "n_tokens"), "UTF-8"))
    return recipes.select("place", F.lit(1).cast("long").alias("documents"), "n_tokens", F.unhex(F.sha2(whole, 256)).alias("root"))


def write_manifest(recipes: DataFrame, folder: str) -> None:
    """Levels of nodes over the recipes, until one is left; an empty store has none."""
    spark, below, level = recipes.sparkSession, _leaves(recipes), 0
    spark.createDataFrame([], NODE).write.parquet(f"{folder}/manifest")
    while True:
        level += 1
        _node_roots(below).withColumn("level", F.lit(level)).select("level", "node", "documents", "n_tokens", "root").write.mode("append").parquet(f"{folder}/manifest")
        mine = read_manifest(spark, folder).filter(F.col("level") == level)
        if mine.count() <= 1:
            return
        below = mine.select(F.col("node").alias("place"), "documents", "n_tokens", "root")


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(NODE).parquet(f"{folder}/manifest")


def check_manifest(spark: SparkSession, folder: str) -> tuple[int, int]:
    """Documents and ids of the store, as its root says; an error if the recipes don't give the same tree."""
    told = read_manifest(spark, folder)
    levels = told.agg(F.max("level").alias("m")).first()["m"] or 0
    below = _leaves(read_recipes(spark, folder))
    if not levels:
        if below.limit(1).count():
            raise ValueError(f"{folder} has recipes and no manifest")
        return 0, 0
    for level in range(1, levels + 1):
        mine, theirs = _node_roots(below), told.filter(F.col("level") == level).select("node", *[F.col(c).alias(f"told_{c}") for c in ("documents", "n_tokens", "root")])
        same = F.lit(True)
        for c in ("documents", "n_tokens", "root"):
            same = same & F.col(c).eqNullSafe(F.col(f"told_{c}"))
        odd = mine.join(theirs, "node", "full").filter(~same).select("node").limit(5).collect()
        if odd:
            raise ValueError(f"{folder}: nodes {[r['node'] for r in odd]} of level {level} differ from the manifest")
        below = told.filter(F.col("level") == level).select(F.col("node").alias("place"), "documents", "n_tokens", "root")
    top = told.filter(F.col("level") == levels).collect()
    if len(top) != 1:
        raise ValueError(f"{folder}: the manifest has no single root")
    return top[0]["documents"], top[0]["n_tokens"]


def _parts(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    schema = "digest binary, ids binary, doc_id long, n_tokens long, recipe binary, root binary, kind string"
    return spark.read.schema(schema).parquet(f"{folder}/parts").filter(F.col("kind") == kind)


def pack_ids(raw: bytes) -> bytes:
    """ids of a chunk: two bytes each where all fit, marked by the first byte."""
    x = np.frombuffer(raw, "<u4")
    return b"\x02" + x.astype("<u2").tobytes() if x.max(initial=0) < 65536 else b"\x04" + raw


def unpack_ids(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, "<u2", offset=1).astype("<u4") if packed[0] == 2 else np.frombuffer(packed, "<u4", offset=1)


# ---------------------------------------------------------------- read back
def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, verified) of each document, from the files."""

    def digests(batches):
        for b in batches:
            d, c, n = [], [], []
            for x in b.column("ids").to_pylist():
                raw = unpack_ids(x).astype("<u4").tobytes()
                d.append(xxhash.xxh3_128_digest(raw))
                c.append(zlib.crc32(raw))
                n.append(len(raw) // 4)
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.binary()), pa.array(c, pa.int64()), pa.array(n, pa.int64())], names=["found", "crc", "found_n"])

    def spread(batches):
        for b in batches:
            doc, start, total, digest, after, n, bad = [], [], [], [], [], [], []
            for d, s, t, rec, root in zip(*(b.column(c).to_pylist() for c in ("doc_id", "start", "n_tokens", "recipe", "root")), strict=True):
                names = [rec[i : i + 16] for i in range(0, len(rec), 20)]
                sizes = [int.from_bytes(rec[i + 16 : i + 20], "little") for i in range(0, len(rec), 20)]
                left = sum(sizes)
                wrong = merkle(names) != root or left != t
                for x, k in zip(names, sizes, strict=True):
                    left -= k
                    doc.append(d)
                    start.append(s)
                    total.append(t)
                    digest.append(x)
                    after.append(left)
                    n.append(k)
                    bad.append(wrong)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc, start, total)] + [pa.array(digest, pa.binary()), pa.array(after, pa.int64()), pa.array(n, pa.int64()), pa.array(bad, pa.bool_())], names=["doc_id", "start", "total", "digest", "after", "n", "bad"])

    def shift(batches):
        for b in batches:
            crc = np.array(b.column("crc").fill_null(0).to_numpy(zero_copy_only=False), np.int64)
            after = np.array(b.column("after").to_numpy(zero_copy_only=False), np.int64)
            term = crc_shift(crc, after * 4).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("total"), pa.array(term), b.column("n"), b.column("wrong")], names=["doc_id", "start", "total", "term", "n", "wrong"])

    check_manifest(spark, folder)
    chunks = _parts(spark, folder, "chunk").select("ids").mapInArrow(digests, "found binary, crc long, found_n long")
    recipes = read_recipes(spark, folder)
    uses = recipes.mapInArrow(spread, "doc_id long, start long, total long, digest binary, after long, n long, bad boolean")
    met = uses.join(chunks, uses.digest == chunks.found, "left").withColumn("wrong", F.col("bad") | F.col("found").isNull() | (F.col("n") != F.coalesce("found_n", F.lit(-1))))
    parts = met.select("doc_id", "start", "total", "crc", "after", "n", "wrong").mapInArrow(shift, "doc_id long, start long, total long, term long, n long, wrong boolean")
    got = parts.groupBy("doc_id", "start", "total").agg(F.bit_xor("term").alias("ids_crc32"), F.sum("n").alias("n_tokens"), F.max("wrong").alias("wrong"))
    fine = F.when(F.col("wrong") | (F.col("n_tokens") != F.col("total")), F.raise_error(F.lit("the store does not give back a document"))).otherwise(F.lit(True))
    return got.select("doc_id", "start", "n_tokens", "ids_crc32", fine.alias("verified"))


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "token-store")
    folder, _ = write_store(table(spark, sf_dir, "documents"), scratch)
    return read_store(spark, folder)
