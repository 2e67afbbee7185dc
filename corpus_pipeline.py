"""A corpus pipeline: five stages, each over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run``
writes as Parquet to shared storage and reads again for the next stage.  All
stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.functions.storage import release, settle
from canopy.llm.common import key_join
from canopy.llm.decontaminate import decontaminate
from canopy.llm.language_id import UNKNOWN, identify, sample
from canopy.llm.line_dedup import line_dedup
from canopy.llm.near_copies import near_groups
from canopy.llm.queries import _vocabulary
from canopy.llm.sentence_pieces import encode

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told, with that as their lang; texts that are null or have no letters go."""
    docs = docs.select(*COLUMNS)
    told = identify(docs, sample(docs)).where(F.col("lang_pred") != UNKNOWN)
    return told.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one; a document that is left without a word goes."""
    docs = docs.select(*COLUMNS)
    out = line_dedup(docs, keep=("lang", "source")).withColumn("text", F.col("kept_text"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (0.8 of the shingles of five words) one document.

    A document is a doc_id with a text: rows that share an id, or have none, stay apart unless their texts are near copies.  The smallest
    doc_id of a group stays (a null one only if there is no other), then the smallest hash of the text, then the smallest other columns.
    """
    docs = docs.select(*COLUMNS)
    groups = settle(near_groups(docs), "near-groups")
    kept = groups.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("k"))
    kept = kept.select("k.doc_id", "k.text_key")
    out = key_join(docs.withColumn("text_key", F.xxhash64("text")), kept, "left_semi")
    # rows that share id and text are copies; the keys alone tell whether there are any
    if groups.groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return out.select(*COLUMNS)
    return out.groupBy("doc_id", "text_key").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*")


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out; a document of which they are more than half goes."""
    docs = docs.select(*COLUMNS)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    out = decontaminate(docs, items, keep=("lang", "source")).where(F.col("clean_text").isNotNull()).withColumn("text", F.col("clean_text"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document, with the scores of its best segmentations."""
    out = encode(docs.select("doc_id", "lang", "source", "text"), _vocabulary("piece_bpe_32k.model"))
    return out.select("doc_id", "lang", "source", "n_pieces", "ids", "ids_crc32", "nbest_scores", "decoded_sha256", "lossless")


STAGES = [
    ("language ID", language),
    ("line dedup", lines),
    ("SimHash near-dedup", near_copies),
    ("benchmark decontamination", benchmarks),
    ("SentencePiece encoding and decoding", pieces),
]

#: A suffix automaton's parse, SimHash and a lattice search have no SQL form; tests/llm/test_pipeline.py holds run() and each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage wrote is deleted when the next one has written.

    Null and empty texts, and texts without letters, go in the first stage; rows without a doc_id, rows that share one and rows
    that repeat each other are handled as each stage states; other columns than those of ``documents`` are not carried.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            release(before)
        before = docs
    return docs
