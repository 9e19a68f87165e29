"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm import linkrank, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framewright.llm.simhash import near_duplicates

    out = near_duplicates(table(spark, sf_dir, "documents"), words=3, max_distance=2)
    return out.select("doc_id", F.lpad(F.lower(F.hex(F.col("fp")[0])), 16, "0").alias("fingerprint"), "component_id")


def op2_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framewright.llm.linkrank import judge

    return judge(table(spark, sf_dir, "pages"))


def op4_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framewright.llm.warc import crawl, resolve

    out = resolve(crawl(table(spark, sf_dir, "pages")))
    headers = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return out.select(F.col("record_id").alias("page_id"), "canonical", "response_id", "status", headers.alias("headers"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framewright.llm.nbsvm import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framewright.llm.rindex import remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n_removed = F.col("n_bytes") - F.length("kept")
    return out.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("removed").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framewright.llm.cells import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op7_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framewright.llm.consensus import extract

    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from framewright.llm.bpe import encode, sha256

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    out = encode(table(spark, sf_dir, "documents"), path, pattern, decoded=True)
    return out.select("doc_id", "n_tokens", sha256("ids").alias("ids_sha256"), sha256("decoded").alias("decoded_sha256"))


def op9_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framewright.llm.decontam import contaminated

    out = contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", (F.size("items") > 0).alias("contaminated"), F.array_join("items", ",").alias("item_ids"), F.round("containment", 6).alias("containment"))


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from framewright.llm import sstable

    directory = sstable.new_directory(spark)
    manifest = sstable.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2, directory)
    out = sstable.read(spark, directory, manifest)
    return out.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framewright.llm.spelling import variants, word_counts

    return variants(word_counts(table(spark, sf_dir, "documents"), typo=31)).select("word", "form", "root", "n", "n_near", "form_n")


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from framewright.llm.packing import sequences

    out = sequences(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 1)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from framewright.llm.alignment import align

    out = align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.when(F.col("n_a") == 0, "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest)


QUERIES = {"op1_simhash": op1_simhash, "op2_hosts": op2_hosts, "op3_quality": op3_quality, "op4_revisits": op4_revisits, "op5_repeats": op5_repeats, "op6_vectors": op6_vectors, "op7_text": op7_text, "op8_bpe": op8_bpe, "op9_decontam": op9_decontam, "op10_shards": op10_shards, "op11_spelling": op11_spelling, "op12_packing": op12_packing, "op13_alignment": op13_alignment}
ORACLE_SQL: dict[str, str] = {"op2_hosts": linkrank.oracle_sql(), "op4_revisits": warc.ORACLE}
