"""The corpus pipeline: documents -> quality rules -> line dedup -> near duplicates -> substring dedup -> packing.

Every stage takes all that the one before kept and returns the columns of documents, but for the last, which
returns the packed pieces. A document that a stage leaves without words goes.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import discard, materialize, read
from tallyspark.llm.hosts import judge
from tallyspark.llm.jaccard import jaccard_classes
from tallyspark.llm.lines import drop_aligned_lines
from tallyspark.llm.packing import best_fit_pack, token_pieces
from tallyspark.llm.substrings import remove_repeats

#: Documents that a stage drops: so many of their ids (at most 16 bytes each) are broadcast, more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _with_words(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("bigint")).where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the verdict on their source keep, unchanged.

    A null or empty text fails the rules; a null source has no verdict; a null doc_id is kept or goes like any other;
    repeated rows go or stay together and count each in their source's rate; an empty table gives no rows."""
    row = F.xxhash64("doc_id", "text", "source")
    judged = judge(docs.select("doc_id", "text", "source", row.alias("row_hash")), F.col("source"))
    gone = materialize(judged.where("not kept").select(F.col("doc_id").alias("gone_id"), F.col("row_hash").alias("gone_row")).distinct(), "rejected")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (row == F.col("gone_row")), "left_anti").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks of lines that an earlier document has.

    Null texts go, as do documents left without words; a document without doc_id is kept as it is; equal rows are one
    document and both stay; of rows that share a doc_id the one with the smaller text hash is the earlier; an empty
    table gives no rows."""
    return _with_words(drop_aligned_lines(docs, keep=("doc_id", "lang", "source")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates (five-word shingles, similarity 0.8): the smallest doc_id.

    Documents without doc_id stay; of rows that repeat a doc_id the one with the smallest text (then lang, source) stays; texts
    without words are near nothing; an empty table gives no rows."""
    classes = jaccard_classes(docs, n=5, num=80, den=100)
    gone = materialize(classes.where("component_id < doc_id").select("doc_id").distinct(), "near-duplicates")
    left = docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, "doc_id", "left_anti").select(*COLUMNS)
    if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        return left
    one = left.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("row")).select("doc_id", "row.*")
    return one.unionByName(left.where("doc_id is null"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 words or more that start earlier in the corpus.

    Null texts go, as do documents left without words; a document without doc_id is kept as it is; repeated rows are one
    document; an empty table gives no rows."""
    return _with_words(remove_repeats(docs, length=50, keep=("doc_id", "lang", "source")).withColumnRenamed("kept", "text"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one token, the end; a null doc_id and repeated rows are packed like others; an empty table
    gives no rows."""
    pieces = token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048)
    packed = best_fit_pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), capacity=2048)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("packing", packing),
]
#: The tokenizer of the last stage and the alignment of the second can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over the documents table, each stage written and read again."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
