"""Document fingerprints: an exact digest of the canonical text.

Canonical: NFKC, case folded, NFKC again, runs of white space as one blank, none at the ends. The
fingerprint is the 128-bit xxh3 of its UTF-8 bytes. Documents with one digest are compared byte by
byte (least and greatest canonical text of the bucket, combined before the shuffle); should a
bucket hold two texts, its fingerprints also carry a SHA-256, so unequal texts stay apart.

The digest is exact, so likeness is 1 for equal canonical texts and 0 otherwise.

Defined results: a null text is empty; rows are ordered by descending doc_id (nulls last, ties by
text); the row after the last is the first, so a single row is its own next; an empty table gives
an empty result; further columns are ignored."""

from __future__ import annotations

import hashlib
import unicodedata

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, partitions, small_batches, table, text_bytes

BROADCAST_BUCKETS = 500_000  # digests of 16 bytes: 8 MB at most; more are joined by a shuffle


def canonical(text: str) -> str:
    if text.isascii():
        return " ".join(text.lower().split())
    return " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold()).split())


def digest(canon: str) -> tuple[str, str]:
    raw = canon.encode("utf-8", "surrogatepass")
    return xxhash.xxh3_128_hexdigest(raw), hashlib.sha256(raw).hexdigest()


def edited(text: str, after: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


_ROW = "doc_id long, n_chars long, edited_sha256 string, fp string, sha string, edited_fp string, edited_sha string, next_fp string, next_sha string"
_NAMES = [x.split()[0] for x in _ROW.split(", ")]


def _row(doc, text, own, after, after_own):
    e = edited(text, after)
    return (doc, len(text), hashlib.sha256(e.encode("utf-8")).hexdigest(), *own, *digest(canonical(e)), *after_own)


def _batch(rows, kinds=None, parts=None, texts=None):
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(_NAMES)
    types = [pa.int64(), pa.int64()] + [pa.string()] * 7
    arrays = [pa.array(c, t) for c, t in zip(cols, types, strict=True)]
    if kinds is None:
        return pa.RecordBatch.from_arrays(arrays, names=_NAMES)
    return pa.RecordBatch.from_arrays([*arrays, pa.array(kinds, pa.int32()), pa.array(parts, pa.int32()), pa.array(texts, pa.string())], names=[*_NAMES, "kind", "part", "text"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row for each document, see op3; also ``class_id``, the least doc_id of its bucket, and
    ``n_equal``, the bucket's rows. One shuffle of the texts, by range of doc_id."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "fingerprints")
    _, size = text_bytes(docs)
    ordered = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    by = [F.col("doc_id").desc(), F.col("text").asc()]
    ranged = ordered.repartitionByRange(partitions(spark, size), F.col("doc_id").desc()).sortWithinPartitions(*by)

    def walk(batches):
        part = TaskContext.get().partitionId()
        held = None
        for b in batches:
            rows, kinds, parts, texts = [], [], [], []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                own = digest(canonical(text))
                if held is None:  # the part's first row is the next of the part before
                    rows.append((doc, len(text), None, *own, None, None, None, None))
                    kinds.append(1)
                    parts.append(part)
                    texts.append(text)
                else:
                    rows.append(_row(*held, text, own))
                    kinds.append(0)
                    parts.append(part)
                    texts.append(None)
                held = (doc, text, own)
            yield _batch(rows, kinds, parts, texts)
        if held is not None:
            doc, text, own = held
            yield _batch([(doc, len(text), None, *own, None, None, None, None)], [2], [part], [text])

    walked = scratch.keep(ranged.mapInArrow(walk, f"{_ROW}, kind int, part int, text string"))
    found = sorted(r["part"] for r in walked.filter("kind = 1").select("part").collect())  # one for each range
    after = spark.createDataFrame([(p, found[(i + 1) % len(found)]) for i, p in enumerate(found)] or [(-1, -1)], "part int, next_part int")
    heads = walked.filter("kind = 1").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"), F.col("fp").alias("nf"), F.col("sha").alias("ns"))
    tails = walked.filter("kind = 2").select("part", "doc_id", "text", "fp", "sha").join(F.broadcast(after), "part").join(heads, "next_part").select("doc_id", "text", "fp", "sha", "next_text", "nf", "ns")

    def last(batches):
        for b in batches:
            yield _batch([_row(d, t, (f, s), nt, (nf, ns)) for d, t, f, s, nt, nf, ns in zip(*(c.to_pylist() for c in b.columns), strict=True)])

    rows = walked.filter("kind = 0").select(*_NAMES).unionByName(tails.mapInArrow(last, _ROW))
    buckets = scratch.keep(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n_equal"), F.min("doc_id").alias("class_id")))
    unlike = _unlike(ordered, buckets.filter("n_equal > 1").select("fp"))
    return _named(rows, buckets, unlike)


def _unlike(docs: DataFrame, shared: DataFrame) -> list[str]:
    """Digests of buckets that hold two texts: none is known, so the list is short."""
    n = shared.count()
    if not n:
        return []

    def canon(batches):
        for b in batches:
            texts = [canonical(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([digest(t)[0] for t in texts], pa.string()), pa.array(texts, pa.string())], names=["fp", "canon"])

    texts = docs.select("text").mapInArrow(canon, "fp string, canon string")
    met = texts.join(F.broadcast(shared) if n <= BROADCAST_BUCKETS else shared, "fp")
    return [r["fp"] for r in met.groupBy("fp").agg(F.min("canon").alias("a"), F.max("canon").alias("b")).filter("a <> b").select("fp").collect()]


def _named(rows: DataFrame, buckets: DataFrame, unlike: list[str]) -> DataFrame:
    name = lambda f, s: F.when(F.col(f).isin(unlike), F.concat(F.col(f), F.lit("-"), F.col(s))).otherwise(F.col(f)) if unlike else F.col(f)
    own, changed, after = name("fp", "sha"), name("edited_fp", "edited_sha"), name("next_fp", "next_sha")
    out = rows.join(buckets, "fp")
    return out.select("doc_id", "n_chars", "edited_sha256", own.alias("fingerprint"), changed.alias("edited_fingerprint"), (own == changed).cast("double").alias("near_edited"), (own == after).cast("double").alias("near_next"), "class_id", "n_equal")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
