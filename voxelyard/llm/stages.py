"""The corpus pipeline's stages. Each takes (spark, docs, sf_dir) and reads what the one before wrote.

Defined results: null and empty texts have no language and go in the first stage; repeated rows and equal ids are separate
documents until the second stage keeps one of each group; null ids are ids like others; columns of documents that are
not there are null; further columns are dropped; an empty table gives an empty table, and no pieces at the end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table, with_uid
from .decontaminate import benchmark_leaks
from .jaccard_join import jaccard_components
from .language_id import language_id
from .packing import pack
from .suffix_dedup import remove_repeats

BROADCAST_IDS = 500_000  # ids of 8 bytes: a few MB; more are joined by a shuffle
TYPES = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}
COLUMNS = [*TYPES]
MORE = ("lang", "source", "n_chars")


def documents(docs: DataFrame) -> DataFrame:
    """The columns of documents, those that are not there as nulls."""
    return docs.select(*[(F.col(c) if c in docs.columns else F.lit(None)).cast(kind).alias(c) for c, kind in TYPES.items()])


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those without a letter go."""
    scratch = Scratch(spark, "pipeline-language")
    rows = with_uid(documents(docs), scratch, MORE)
    said = language_id(rows.select(F.col("uid").alias("doc_id"), "text", "lang"))
    return documents(rows.join(said.filter("lang_pred <> 'und'").select(F.col("doc_id").alias("uid")), "uid", "left_semi"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each component stays; documents without words stay too."""
    scratch = Scratch(spark, "pipeline-jaccard")
    rows = with_uid(documents(docs), scratch, MORE)
    stay = jaccard_components(rows.select("uid", "doc_id", "text"), scratch).filter("uid = component").select("uid")
    return documents(rows.join(stay, "uid", "left_semi"))


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated bytes; a document that has no other goes. Bytes of a character
    that was cut apart go with it."""
    scratch = Scratch(spark, "pipeline-repeats")
    rows = with_uid(documents(docs), scratch, MORE)
    cut = remove_repeats(rows.select("uid", "doc_id", "text"), scratch, kept=True).select("uid", F.col("kept").alias("rest"))
    joined = rows.drop("text", "n_chars").join(cut, "uid").withColumnRenamed("rest", "text")
    return documents(joined.filter(F.trim("text") != "").withColumn("n_chars", F.length("text").cast("long")))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    scratch = Scratch(spark, "pipeline-benchmark")
    rows = with_uid(documents(docs), scratch, MORE)
    found = benchmark_leaks(rows.select(F.col("uid").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    found = scratch.keep(found.select(F.col("doc_id").alias("uid")).distinct())
    few = found.count() <= BROADCAST_IDS
    return documents(rows.join(F.broadcast(found) if few else found, "uid", "left_anti"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences."""
    return pack(documents(docs))


STAGES = [
    ("language ID", language_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("suffix-array dedup", repeat_stage),
    ("benchmark decontamination", benchmark_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        kept = scratch.keep(stage(spark, docs, sf_dir))
        scratch.drop(docs)  # what the stage before wrote; never an input
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
