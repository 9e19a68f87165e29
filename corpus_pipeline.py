"""A corpus pipeline: quality filter, near-duplicates, repeated passages, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir), works on all documents that its predecessor kept, and returns documents; the
last one returns tokens. ``run`` applies the stages to ``documents``; each result is written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm import bpe, decontam, nbsvm, rindex, simhash
from framewright.llm.common import written
from framewright.llm.queries import table


#: Repeated passages: words, and bytes of a match.
PASSAGE, BYTES = 50, 240


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches 0.7; the model is fitted on the labelled documents of the stage's input.

    Null and empty texts are scored as texts without features; repeated rows share their fate; without labels of both classes all stay."""
    return nbsvm.keep(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that of the smallest doc_id.

    Texts without words, null ones too, are one group; of repeated rows one stays; a null doc_id stays only where its group has no other."""
    return simhash.keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their passages of ``PASSAGE`` words or more that come again anywhere; null texts stay null, repeated rows lose all they share.

    Matches of ``BYTES`` bytes find them, which any such passage holds unless its words have less than four letters on average; a character cut in two goes as a whole."""
    out = rindex.remove_repeats(docs, BYTES, PASSAGE).withColumn("text", F.col("kept_text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none, repeated rows are judged alike, and an empty benchmark keeps all."""
    return decontam.contaminated(docs, table(spark, sf_dir, "benchmark")).where(F.size("items") == 0).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): the ids as little-endian unsigned 32-bit integers, and the text they decode to.

    Null and empty texts have no ids and decode to an empty text; repeated rows and null doc_ids stay."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    out = bpe.encode(docs, path, pattern, decoded=True)
    return out.select("doc_id", "n_tokens", "ids", F.col("decoded").cast("string").alias("decoded"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeats", repeats), ("leaks", leaks), ("tokens", tokens)]
#: SQL expresses neither a fitted model nor a suffix index; tests/llm/test_whole.py compares all rows of run() on planted cases.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
